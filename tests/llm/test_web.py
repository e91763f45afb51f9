"""WARC round trips and salvage, HTML extraction."""

import base64
import hashlib
import io
import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.llm import html_extract, warc, work


def records(n=6):
    return [warc.record(i, f"http://x/{i} é", b"<p>%d</p>" % i * (i + 1) * 50, warc.digest(b"<p>%d</p>" % i * (i + 1) * 50), None, False) for i in range(n)]


def read(data):
    return list(warc.salvage(io.BytesIO(data)))


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_goes_on_after_damage(packed, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 97)
    parts = [warc.member(r) if packed else r for r in records()]
    whole = b"".join(parts)
    assert [x["page_id"] for kind, x in read(whole) if kind == "record"] == list(range(6)) and all(k == "record" for k, _ in read(whole))
    begin = [sum(map(len, parts[:i])) for i in range(7)]
    rng = random.Random(1)
    for lost in range(6):
        for damage in ("flip", "cut", "junk", "head"):
            bad = bytearray(parts[lost])
            if damage == "flip":
                at = len(bad) // 2
                bad[at] ^= 0x55
            elif damage == "cut":
                del bad[len(bad) // 2 :]
            elif damage == "head":
                bad[:5] = b"?????"
            else:
                bad += bytes(rng.randrange(1, 9) for _ in range(40))
            found = read(b"".join(parts[:lost]) + bytes(bad) + b"".join(parts[lost + 1 :]))
            got = [x["page_id"] for kind, x in found if kind == "record"]
            gaps = [x for kind, x in found if kind == "gap"]
            want = [i for i in range(6) if i != lost or damage == "junk"]
            assert got == want, (lost, damage)
            assert len(gaps) == 1 and gaps[0]["reason"]
            size = len(bad)
            assert gaps[0] == {"start": begin[lost] + (len(parts[lost]) if damage == "junk" else 0), "end": begin[lost] + size, "reason": gaps[0]["reason"]}


def test_salvage_edges():
    assert read(b"") == []
    assert [k for k, _ in read(b"\x1f\x8b\x08 nothing here")] == ["gap"]
    assert [k for k, _ in read(b"WARC/1.0\r\nbroken")] == ["gap"]


def test_salvage_is_linear():
    """Megabytes of false starts: wrong lengths, version lines without a header, marks of members, a length beyond the file."""
    good = records(1)[0]
    wrong = good.replace(b"Content-Length: ", b"Content-Length: 9")
    for junk in (wrong * 3000, b"WARC/1.0\r\n" * 100_000, warc.MAGIC * 300_000, b"WARC/1.1\r\nContent-Length: 900000000\r\n\r\n" * 25_000):
        began = time.time()
        found = read(junk + good)
        assert [k for k, _ in found] == ["gap", "record"] and found[0][1]["end"] == len(junk)
        assert time.time() - began < 15


ROWS = [(5, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (9, None, None), (1, "http://c d\n", ""), (7, "http://e", "é" * 5000), (8, "http://f", "<p>same</p>"), (None, "http://g", "<p>own</p>")]


def warc_brute(rows):
    heads = {}
    for i, _, h in rows:
        if i is not None:
            heads[h or ""] = min(heads.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        head = heads.get(h or "")
        revisit = head is not None and i != head
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("head", F.lit("x")).repartition(3)
    manifest = warc.write_archives(pages, work.work_path(spark, "warc"))
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS)
    got = warc.read_archives(manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == warc_brute(ROWS)
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {h or "" for _, _, h in ROWS}
    assert warc.read_archives(warc.write_archives(pages.limit(0), work.work_path(spark, "warc"))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:'</p>'}</style><script>var t="</head><body>no";</script></head>
<body class="page"><nav><ul><li><a href=/a>Menu</a></ul></nav><header><h2>Site</h2></header><div class="cookie-notice"><p>We use cookies</p></div>
<aside>side</aside><!-- <p>hidden</p> --><article class="post header"><h1>Head &amp; tail</h1><p>First&nbsp;line <b>bold<i>er</i></b>
 goes&#32;on.<br>Same block<p>Second <a href="x>y">link</a> text</p><div class="ad"><p>Buy</p></div><blockquote>Short</blockquote><form><label>Mail</label><input></form>
<script>track("</article>")</script><ul><li>one<li>two</ul><span class="advert">x <span>y</span> z</span><section id="comments"><p>Nice post</p></section></article>
<div class="sidebar"><p>Related</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Head & tail\nFirst line bolder goes on. Same block\nSecond link text\nShort\none\ntwo"
    assert html_extract.main_text(PAGE[: PAGE.index("<footer>") + 12]) == html_extract.main_text(PAGE)


def test_line_blocks_without_article():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(4))
    page = f"<body><div class=menu><a>One</a><a>Two</a></div><div>Home</div><div>About</div><h1>Title</h1>{body}<div>x</div><div>y</div><div>z</div><div>w</div></body>"
    got = html_extract.main_text(page).split("\n")
    assert [g for g in got if g.endswith(("0", "1", "2", "3"))] == [" ".join(["word"] * 30) + f" {i}" for i in range(4)] and "Title" in got and "w" not in got and "One" not in " ".join(got)
    assert html_extract.main_text("<p>tiny</p>") == "tiny"


def test_line_blocks_beside_articles():
    body = [f"{'word ' * 30}{i}" for i in range(4)]
    page = "<body><div>Home</div><main>{}</main><article class='comment'><p>Nice post</p></article></body>"
    assert html_extract.main_text(page.format("".join(f"<p>{b}</p>" for b in body))).split("\n")[:4] == body
    page = "<body><div>Home</div><div>{}</div><article class='comment'><p>Nice post</p></article><div>x</div><div>y</div><div>z</div><div>w</div></body>"
    got = html_extract.main_text(page.format("".join(f"<p>{b}</p>" for b in body))).split("\n")
    assert [g for g in got if g in body] == body and "w" not in got
    assert html_extract.main_text(f"<div>Home</div><article><p>{body[0]}</p><p>a</p><p>b</p><p>c</p><p>d</p></article><div>x</div>") == "\n".join([body[0], "a", "b", "c", "d"])
    assert html_extract.main_text(f"<div>Home</div><article>Teaser</article><div><p>{body[0]}</p></div>") == f"Teaser\n{body[0]}"


def test_names_are_read_in_whole():
    text = "First words of it"
    for block in (f'<p title="hidden gem">{text}</p>', f'<p data-id="search">{text}</p>', f'<h1 class="post-header">{text}</h1>', f'<h2 id="form">{text}</h2>', f'<div class="entry-header"><p>{text}</p></div>', f'<p class="ad-libbed">{text}</p>', f"<p title='class=ad'>{text}</p>", f'<div hidden="until-found">{text}</div>'):
        assert html_extract.main_text(f"<article>{block}<p>Last words</p></article>") == f"{text}\nLast words", block
    for block in ('<p class="ad">no</p>', '<div class="x ad-slot">no</div>', "<div id=comments><p>no</p></div>", '<span class="share-buttons">no</span>', "<div hidden>no</div>", '<div style="color:red; display: none">no</div>', '<p class="a notice">no</p>', "<footer>no</footer>", '<ul ROLE="Navigation"><li>no</ul>'):
        assert html_extract.main_text(f"<article><p>{text}</p>{block}<p>Last words</p></article>") == f"{text}\nLast words", block


def spans_brute(weights, heading, least, open_ends):
    n = len(weights)
    high = [k for k in range(n) if sum(weights[k : k + 3]) >= least]
    kept = {i for i in range(n) if any(a <= i for a in high) and any(i <= b + 2 for b in high)}
    if open_ends and high:
        for i in range(min(high), min(high) + 3):  # the lines before the first that the first window needs, or that is a heading
            if i in kept and not heading[i] and weights[i] < 20 and sum(weights[j] for j in range(i + 1, min(min(high) + 3, n))) >= least:
                kept.discard(i)
            else:
                break
        for i in range(min(max(high) + 2, n - 1), max(high), -1):
            if i > min(kept) and weights[i] < 20 and sum(weights[max(high) : i]) >= least:
                kept.discard(i)
            else:
                break
    return sorted(kept)


def test_distribution_against_brute_force():
    rng = random.Random(4)
    for _ in range(4000):
        n = rng.randint(0, 12)
        weights = [rng.choice([1, 5, 20, 40, 90, 200]) for _ in range(n)]
        heading = [rng.random() < 0.2 for _ in range(n)]
        for open_ends in (True, False):
            assert list(html_extract.spans(weights, heading, 80, open_ends)) == spans_brute(weights, heading, 80, open_ends)


def test_recall_of_article_text():
    """Made pages, marked and not, with all that contracts leave out around and between the blocks."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    aside = ["<nav><ul><li><a href=/a>{}</a></ul></nav>", '<div class="ad">{}</div>', "<aside><p>{}</p></aside>", "<form><label>{}</label><input></form>", "<script>{}</script>", '<div id="cookie-notice"><p>{}</p></div>', '<section class="comments"><p>{}</p></section>', "<footer>{}</footer>"]
    for marked in (True, False):
        found = wanted = extra = 0
        for _ in range(60):
            blocks = [words(rng.randint(25, 60)) for _ in range(rng.randint(2, 9))]
            parts = [f"<h1>{words(4)}</h1>" if marked else ""]
            for b in blocks:
                parts += [f"<p>{b}</p>", rng.choice(aside).format(words(30)) if rng.random() < 0.5 else ""]
            body = "".join(parts)
            page = f"<html><head><title>x</title></head><body>{aside[0].format(words(3))}<header>{words(9)}</header>{f'<article>{body}</article>' if marked else f'<div>{body}</div>'}{aside[6].format(words(40))}{aside[7].format(words(20))}</body></html>"
            got = html_extract.main_text(page).split("\n")
            found, wanted = found + sum(b in got for b in blocks), wanted + len(blocks)
            extra += sum(g not in blocks for g in got) - marked
        assert found == wanted and extra == 0


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x" + "</p>" * 100_000, "<b class=ad>" + "<b>" * 200_000 + "</i>" * 100_000, "<" * 1_000_000, "<p>" + " " * 1_000_000, "<a b='" * 100_000, "<head><script>" * 50_000, "<button>x" * 100_000, "&amp;" * 200_000, "<!--" * 200_000, "<p class='" + "a " * 400_000 + "'>x"])
def test_long_broken_pages(page):
    began = time.time()
    html_extract.main_text(page)
    assert time.time() - began < 10


@pytest.mark.parametrize("name", ["button", "select", "object", "svg", "math", "canvas", "audio", "video", "template", "head"])
def test_unclosed_elements_do_not_cut(name):
    page = f"<article><p>First words</p><{name} class=x><p>Last words</p></article>"
    assert html_extract.main_text(page) == "First words\nLast words"
    assert html_extract.main_text("<article><p>First words</p><script><p>Last words</p></article>") == "First words"


@pytest.mark.parametrize("page", ["", "<", "<p", "</p></div>", "<!--", "<script>", "a < b & c", "<p>&#xD800;&bogus;</p>", "<article>", "<a b='>", "\x00", "<head>", "<title>x"])
def test_odd_pages(page):
    assert isinstance(html_extract.main_text(page), str)


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", "<p>" + "é " * 200_000 + "</p>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert {r.n_chars for r in got} == {len(html_extract.main_text(PAGE)), 0, 399_999}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
