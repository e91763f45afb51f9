"""Licence scan, URL filter, decontamination, packing and language ID against plain Python versions."""

import math
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate, language_id, license_scan, packing, url_filter


def license_brute(rows):
    table = [(i, name, set(license_scan.bigrams_of(t))) for i, (name, t) in enumerate(license_scan.TEMPLATES)]
    out = set()
    for doc, text in rows:
        lines, parts = (text or "").split("\n"), re.split(license_scan.BLANK_LINES, text or "")
        units = [*enumerate([text if len(lines) > 1 else "", *lines]), *((-k, p) for k, p in enumerate(parts, 1) if len(parts) > 1 and "\n" in p.strip(" \t\r\n"))]
        for unit, line in units:
            own = set(license_scan.bigrams_of(line or ""))
            scores = [(2 * len(own & b) / (len(own) + len(b)), -i, name) for i, name, b in table if own]
            if scores and 100 * max(scores)[0] >= license_scan.PERCENT:
                d, i, name = max(scores)
                out.add((doc, unit, name, -i, round(d, 6)))
    return out


def test_license_scan(spark):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, "mit"), (4, "Released under the MIT License."), (5, "x\n  RELEASED under the, MIT licence\nLicensed under CC BY-NC 4.0.\n")]
    for i, (_, t) in enumerate(license_scan.TEMPLATES):
        w = t.split()
        rows.append((10 + 2 * i, "some words before\n" + t.upper() + "\nmore"))
        del w[rng.randrange(len(w))]
        rows.append((11 + 2 * i, " ".join(w) + "\nand a line"))
    rows.append((500, "word " * 5000))
    for i, (_, t) in enumerate(license_scan.TEMPLATES):
        rows.append((600 + i, "some other text\nof two lines\n \n\n# " + "\n# ".join(textwrap.wrap(t, 40)) + "\n\nand the\nrest of it\n" * 9))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"unit": F.lit(1), "line": F.lit("q"), "words": F.lit("z")})
    got = {(r.doc_id, r.unit, r.license, r.template, r.dice) for r in license_scan.scan(df).collect()}
    assert got == license_brute(rows) and len(got) > 20
    assert {d for d, unit, *_ in got if unit < 0} >= {600 + i for i, (_, t) in enumerate(license_scan.TEMPLATES) if len(t) > 40}
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_scan_of_long_texts(spark):
    """Many paragraphs, blank lines, blanks and licences in one text."""
    notice = "\n\n".join(t for _, t in license_scan.TEMPLATES) + "\n\n"
    texts = ["x\ny\n\n" * 200_000, "\n" * 1_000_000, " " * 1_000_000, "a b " * 250_000, notice * 50]
    began = time.time()
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {4} and len(got) == 50 * len({t for _, t in license_scan.TEMPLATES}) and time.time() - began < 60


def test_license_scan_runs_no_python(spark):
    plan = license_scan.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_notices_find_wrapped_templates(spark):
    filler = " ".join(f"filler{i}" for i in range(300))
    rows = [(i, f"{filler}\n" + "\n".join(textwrap.wrap(t, 24, break_long_words=False)) + f"\n{filler}") for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    rows += [(100, "Copyright (c) 2020 Jane Doe. Released under the MIT License. All of it"), (101, None), (102, ""), (103, filler), (104, "mit")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = license_scan.notices(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {(r.doc_id, r.template): r for r in out.collect()}
    for i, (name, t) in enumerate(license_scan.TEMPLATES):
        r = got[i, i]
        assert (r.license, r.dice, r.word, r.words) == (name, 1.0, 300, len(license_scan.words_of(t)))
    assert (100, 0) in got and not any(i in (101, 102, 103, 104) for i, _ in got)
    assert all(i == k for i, k in got if i < 100)


URLS = [
    None, "", "nothing", "://", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/", "http://example.com/en", "http://x.example.com/en/?a=1", "http://a.www.example.com/en/9",
    "https://b.net/es/1#t", "https://net/fr/2", "https://notnet/fr/2", "https://c.net/de/1", "https://d.com", "https://d.com/", "https://d.com?x=/en/", "a://b://c.com/x", "https://É.com/ö/1", "http://e.org/en/1?x=1&y=2#z",
]


def rule_brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS * 2)), "page_id long, url string").withColumns({"host": F.lit("h"), "f0": F.lit(1.0), "score": F.lit(2)})
    got = url_filter.filter_urls(df).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = rule_brute((URLS * 2)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, rules=[]).collect()} == {"allow"}


def test_url_trees_learn(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    good = [f"https://{word(6)}.org/{word(5)}/{word(4)}" for _ in range(400)]
    bad = [f"http://{word(4)}-{rng.randrange(10**9)}.{word(3)}.biz/{word(20)}{rng.randrange(10**9)}?{word(2)}={rng.randrange(999)}&b={rng.randrange(999)}" for _ in range(400)]
    rows = [(u, b) for us, b in ((good, False), (bad, True)) for u in us]
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    scored = url_filter.fit(df.where(F.crc32(F.col("url").cast("binary")) % 2 == 0))(df)
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    right = scored.where(F.crc32(F.col("url").cast("binary")) % 2 == 1).select(((F.col("score") >= 0.5) == F.col("blocked")).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    assert right > 0.97


def lexical_brute(url):
    host, path, *_ = rule_brute(url)
    entropy = lambda t: -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) if t else 0.0
    query = m[1] if (m := re.search(r"\?([^#]*)", url)) else ""
    digits = sum(c in "0123456789" for c in url) / max(len(url), 1)
    return [len(url), len(host), len(path), path.count("/"), digits, entropy(url), entropy(host), query.count("&") + 1 if query else 0, host.count("."), host.count("-"), int("#" in url)]


def test_url_trees_against_brute_force(spark, monkeypatch):
    """Features, suffix shares and the walk through every tree, by plain Python."""
    grown = []
    grow = url_filter.grow
    monkeypatch.setattr(url_filter, "grow", lambda *x: grown.append(grow(*x)) or grown[-1])
    rng = random.Random(5)
    urls = [u for u in URLS if u] + [f"http{'s' * rng.randrange(2)}://{rng.choice('ab')}{rng.randrange(99)}.{rng.choice(['x.com', 'y.net', 'z.co.uk'])}/{'p/' * rng.randrange(4)}{rng.randrange(9999)}{'?a=1&b=2' * rng.randrange(2)}" for _ in range(400)]
    rows = [(u, "y.net" in u or len(u) % 7 == 0) for u in urls for _ in range(rng.choice([1, 1, 3]))]
    scored = url_filter.fit(spark.createDataFrame(rows, "url string, blocked boolean"))(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    base, trees = grown[0]
    buckets = {r.url: (r.suffix1, r.suffix2) for r in scored}
    seen = {}
    for u, b in rows:
        for k in buckets[u]:
            n = seen.setdefault(k, [0, 0])
            n[0], n[1] = n[0] + 1, n[1] + b
    overall = (sum(n[1] for n in seen.values()) + 1) / (sum(n[0] for n in seen.values()) + 2)

    def walk(tree, x):
        while not isinstance(tree, float):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    for r in scored:
        x = lexical_brute(r.url)
        assert [round(r[f"f{i}"], 9) for i in range(url_filter.LEXICAL)] == [round(v, 9) for v in x]
        x += [(seen[k][1] + 8 * overall) / (seen[k][0] + 8) for k in buckets[r.url]]
        assert [round(r[f"f{url_filter.LEXICAL + i}"], 9) for i in range(2)] == [round(v, 9) for v in x[-2:]]
        x = [r[f"f{i}"] for i in range(url_filter.LEXICAL + 2)]
        assert abs(r.score - 1 / (1 + math.exp(-base - sum(walk(t, x) for t in trees)))) < 1e-9


def test_url_sample_merges_copies(spark):
    """A labelled url with most of the rows does not fill the sample."""
    rows = [("http://hot.org/a", True)] * 500 + [(f"http://site{i}.org/{'x' * 30 if i % 2 else 'y'}", bool(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    out = url_filter.fit(df, sample_rows=100)(df).where("url <> 'http://hot.org/a'")
    assert out.where("(score >= 0.5) = blocked").count() > 190
    right, most = url_filter.held_out_accuracy(df)
    assert right > 0.9 and 0.5 <= most < 1


def edit_distance(item, text):
    """The least edits of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_contaminated(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(rng.randint(4, 40))) for _ in range(12)] + ["", "tiny", "Twice told  passage of words that counts", "twice told passage of WORDS that counts", "abab" * 40, "a" * 120, "a" * 60 + " b"]
    rows = [(0, None), (1, ""), (90, "a" * 700 + " c"), (91, "ab" * 300), (92, "tiny"), (93, "a tinytiny (TINY)")]
    for n in range(80):
        filler = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(2)]
        text = bytearray(" ".join(rng.choice(items).lower().split()).encode())
        for _ in range(rng.choice([0, 0, 1, 3, len(text) // 20, len(text) // 12, len(text) // 6])):
            if len(text) > 3:
                p = rng.randrange(len(text))
                kind = rng.randrange(3)
                text[p : p + (kind != 1)] = b"" if kind == 2 else bytes([rng.choice(b"abc x")])
        rows.append((n + 2, filler[0] + " " + text.decode() + "\n" + filler[1]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(df, bench).collect()}
    want = {}
    for i, t in rows:
        for k, item in enumerate(items):
            own = decontaminate.normalise(item)
            whole = decontaminate.normalise(t or "")
            if len(own) >= decontaminate.Q and (d := edit_distance(own, whole)) <= decontaminate.budget(len(own)):
                want[i, k] = d
            elif 0 < len(own) < decontaminate.Q and re.search(rb"(?<![0-9a-z\x80-\xff])" + re.escape(own) + rb"(?![0-9a-z\x80-\xff])", whole):
                want[i, k] = 0
    assert got == want and len(got) > 30
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_templated_items(monkeypatch):
    """Items with one prompt, by edit distance; small chunks, segments and batches."""
    for name, size in (("SEGMENT", 50), ("CHUNK", 64), ("WIDTH", 64), ("CELLS", 200)):
        monkeypatch.setattr(decontaminate, name, size)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 8)))
    for prompt, rest in (("answer the question with one of the letters below and say why it is so: ", ""), ("", " and now answer the question with one of the letters below")):
        items = [f"{prompt}{' '.join(word() for _ in range(rng.randint(1, 9)))}{rest}".encode() for _ in range(25)]
        own = decontaminate.Items(list(range(25)), items)
        for _ in range(12):
            parts = []
            for item in rng.sample(items, 4):
                text = bytearray(item)
                for _ in range(rng.choice([0, 2, 5, 9])):
                    text[rng.randrange(len(text))] = 120
                parts += [bytes(text), word().encode()]
            text = b" ".join(parts)
            want = {i: d for i, x in enumerate(items) if (d := edit_distance(x, text)) <= decontaminate.budget(len(x))}
            found = own.matches(text)
            assert {n: edits for n, edits, _ in found} == want
            for n, edits, place in found:
                k = decontaminate.budget(len(items[n]))
                assert edit_distance(items[n], text[max(0, place - k) : place + len(items[n]) + 2 * k]) == edits


def test_decontamination_is_bounded():
    """Equal letters, one prompt over thousands of items, and a text that repeats it."""
    began = time.time()
    rng = random.Random(3)
    one = decontaminate.Items([1, 2], [b"a" * 300, b"a" * 150 + b"b" + b"a" * 149])
    assert [(n, e) for n, e, _ in one.matches(b"a" * 1_000_000)] == [(0, 0), (1, 1)]
    prompt = "answer the question with one of the letters below and say in short why so: "
    items = [(prompt + "".join(rng.choice("abcdefgh ") for _ in range(40))).encode() for _ in range(5000)]
    many = decontaminate.Items(list(range(5000)), items)
    text = (prompt + "something else ").encode() * 40 + bytes(rng.choice(b"abcdefgh ") for _ in range(100_000)) + items[77]
    assert [(n, e) for n, e, _ in many.matches(text)] == [(77, 0)]
    assert time.time() - began < 60


def test_items_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    bench = spark.createDataFrame([(i, f"passage number {i} of a set of words") for i in range(9)], "item_id long, text string")
    df = spark.createDataFrame([(i, f"before passage number {i} of a set of words after") for i in range(9)], "doc_id long, text string")
    assert len(list(decontaminate._blocks(bench))) > 3
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).where("edits = 0").collect()} == {(i, i) for i in range(9)}


def test_pack_round_trip(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(10_001, "a <|endoftext|> b"), (10_002, "x" * 9000 + " tail"), (10_003, "“quotes” 🙂 \u00a0 it's we'll  \n\n 12,5½"), (10_004, " " * 1_000_000), (10_005, "x" + "\n" * 300_000 + "y"), (10_006, " \n" * 200_000), (10_007, "一路" * 100_000), (10_008, "a" * 200_000)]
    df = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("shard", F.lit("s"))
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows + extra}
    pieces = packing.pack(df, window=256).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    assert by_doc.keys() == ids.keys()
    for i, found in by_doc.items():
        spans = sorted((p.start, p.start + p.length) for p in found)
        assert spans[0][0] == 0 and spans[-1][1] == len(ids[i]) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # noqa: B905, RUF007
    for found in by_sequence.values():
        spans = sorted((p.offset, p.offset + p.length) for p in found)
        total = spans[-1][1]
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and total <= 256 and total & (total - 1) == 0  # noqa: B905, RUF007
    assert packing.pack(docs.limit(0)).count() == 0


def test_pack_prefers_neighbours():
    rng = np.random.default_rng(0)
    items = [np.array(rng.integers(1000 * (i % 4), 1000 * (i % 4) + 300, 100), np.uint16) for i in range(80)]
    df = np.zeros(packing.N_IDS)
    for x in items:
        df[np.unique(x)] += 1
    found = list(packing.fill(items, np.log1p((80 - df + 0.5) / (df + 0.5)), 100.0, 512))
    same = [len({i % 4 for i, _, _ in pieces}) for pieces in found]
    assert sum(n == 1 for n in same) >= 0.7 * len(same)


def test_pack_goes_on_by_score():
    def first_window(items, window):
        df = np.zeros(packing.N_IDS)
        for x in items:
            df[np.unique(x)] += 1
        return {i for i, _, _ in next(packing.fill(items, np.log1p((len(items) - df + 0.5) / (df + 0.5)), 40.0, window))}

    rng = np.random.default_rng(3)
    short = [np.array(rng.integers(0, 60, 30), np.uint16) for _ in range(60)]
    other = [np.array(rng.integers(2000, 2060, 31), np.uint16) for _ in range(60)]
    seed = [np.array(rng.integers(0, 60, 40), np.uint16)]
    assert first_window([*other, *short, *seed], 1500) <= set(range(60, 121))  # more than two groups
    # the seed's rarest ids are its own; the others share its most frequent id alone
    seed = [np.array([*range(100, 150), 7], np.uint16)]
    own = [np.array([7, 9000 + i, 9100 + i], np.uint16) for i in range(20)]
    other = [np.array([*range(2000, 2040)], np.uint16) for _ in range(20)]
    assert first_window([*other, *own, *seed], 51 + 60) == set(range(20, 41))


def test_shards_hold_neighbours(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 20)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    rows = []
    for i in range(200):
        text = [word() for _ in range(60)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:-1] + [word()]))]
    rows += [(1000 + i, "one text of many copies") for i in range(100)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shard = {p.doc_id: p.sequence_id >> 25 for p in pieces}
    sizes = [list(shard.values()).count(x) for x in set(shard.values())]
    assert len(sizes) == 25 and set(sizes) == {20}
    assert sum(shard[2 * i] == shard[2 * i + 1] for i in range(200)) >= 140
    again = {p.doc_id: p.sequence_id >> 25 for p in packing.pack(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5)).collect()}
    assert again == shard


def test_powers():
    for total in (1, 2, 3, 300, 511, 2047):
        parts = list(packing.powers([(0, 0, total // 3), (1, 5, total - total // 3)], total))
        assert sum(n for p in parts for _, _, n in p) == total and all((s := sum(n for _, _, n in p)) & (s - 1) == 0 for p in parts)


LANGS = {"aa": "the of an re ti on".split(), "bb": "sch ein und ber ung keit".split(), "cc": "éau que ion les oir".split(), "dd": "ción los mente ñar ado".split()}


def test_language_id(spark):
    rng = random.Random(6)
    rows = []
    for i in range(240):
        lang = rng.choice(list(LANGS))
        rows.append((i, " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang))
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 :: 34", "bb"), (None, "the of an re", "aa"), (1003, "und ein schein " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "held_out": F.lit("x")})
    got = language_id.identify(df, language_id.train(df)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id: r for r in got if r.held_out}
    assert set(held) == {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    truth = {i: lang for i, _, lang in rows}
    judged = [r for r in held.values() if r.doc_id < 1000]
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.97 * len(judged)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1000] == by[1001] == by[1002] == "und" and by[1003] == "bb"
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_language_id_edges(spark, empty):
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    one = spark.createDataFrame([(1, "abc", "xx"), (2, "def", "xx"), (3, "ghi", "xx"), (7, "", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(one, language_id.train(one)).collect()} == {"xx", "und"}


@pytest.mark.parametrize("k", [2, 4, 5, 9, 30])
def test_codewords_are_apart(k):
    code = language_id.codewords(k)
    apart = min(((code[a] != code[b]).sum() for a in range(k) for b in range(a)), default=9)
    assert code.shape[0] == k and apart >= (1 if k == 2 else 3 if k > 5 else 2 ** (k - 2)) and set(np.unique(code)) <= {-1, 1}


def test_language_id_against_brute_force(spark):
    """Margins, losses and scores in plain Python over the model's own tables."""
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)), lang) for i, (lang, words) in enumerate(list(LANGS.items()) * 20)]
    model = language_id.fit([(lang, t) for _, t, lang in rows])
    tests = [t for _, t, _ in rows[:12]] + ["a", "Ünder the keit 12", "the of " * 50 + "ción los " * 50]
    got = [(r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    for text, (lang, score) in zip(tests, got, strict=True):
        data = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + "   "
        raw = data.encode()
        margins = []
        for b in range(model.code.shape[1]):
            total = 0.0
            for o, n in enumerate((2, 3, 4)):
                own = []
                for i in range(len(raw) - 3):
                    g = int.from_bytes(raw[i : i + n], "big")
                    own.append(g if n == 2 else (g * (0x9E3779B1 if n == 3 else 0x85EBCA6B) & 0xFFFFFFFF) >> 16)
                total += sum(float(model.weights[o, k, b]) for k in own) / len(own)
            margins.append(total)
        loss = [sum(model.share[k, b] * math.exp(-float(model.code[k, b]) * min(4, max(-4, margins[b] / model.scale[b]))) for b in range(len(margins))) for k in range(len(model.langs))]
        best = min(range(len(loss)), key=loss.__getitem__)
        assert lang == model.langs[best] and abs(score - (1 / loss[best]) / sum(1 / x for x in loss)) < 1e-6


def test_language_sample_is_bounded(spark, monkeypatch):
    """Repeated rows and ids, dirty and frequent languages, very long texts."""
    monkeypatch.setattr(language_id, "MOST_LANGS", 2)
    monkeypatch.setattr(language_id, "LONGEST", 300)
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 1000)
    fitted = []
    fit = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda rows: fitted.append(rows) or fit(rows))
    rows = [(7, "the of an one text", "aa")] * 50 + [(i, f"sch ein und ber {i}", "bb") for i in range(100)] + [(i, "x" * 200, f"dirty {i}") for i in range(30)] + [(200, "the of " * 1000, "aa"), (7, "another text of seven", "aa")]
    language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    by = {x: [t for lang, t in fitted[0] if lang == x] for x in ("aa", "bb")}
    assert len(fitted[0]) == len(by["aa"]) + len(by["bb"]) and sorted(by["aa"]) in (["another text of seven", "the of an one text"], []) and 0 < len(by["bb"]) <= 100 and sum(map(len, by["bb"])) < 1300


def test_unlearned_languages_are_rejected(spark):
    rng = random.Random(2)
    text = lambda words, n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    rows = [(i, text(words, rng.choice([5, 20, 60])), lang) for i, (lang, words) in enumerate(list(LANGS.items()) * 50)]
    both = [(1000 + i, text(LANGS["aa"], 20) + " " + text(LANGS["cc"], 20), None) for i in range(20)]
    other = [(2000, "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心", None), (2001, "Все люди рождаются свободными и равными в своем достоинстве и правах", "zz"), (2002, "12 ?", None), (2003, None, "aa")]
    kept = language_id.keep_identified(spark.createDataFrame(rows + both + other, "doc_id long, text string, lang string"))
    found = {r.doc_id for r in kept.collect()}
    assert {i for i, _, _ in rows + both} <= found and not found & {2000, 2002, 2003}
