"""Exact, near-duplicate and substring deduplication against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, graph, minhash_dedup, shingles, suffix_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    return {i: (min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows}


def test_normalise_is_the_pattern():
    for t in ["", " ", "\t\n", "a", " a", "a ", " a\x1cb  c\r\n", "a\x85b", "\x0b\x0ca  "]:
        assert exact_dedup.normalise(t.encode()).decode() == normal(t)


def test_exact_groups(docs, rows):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == exact_brute(rows)


def test_exact_edges(spark, empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    odd = spark.createDataFrame([(None, "x"), (None, "y"), (4, "y"), (4, "y"), (9, None)], "doc_id long, text string").withColumns({"key": F.lit(1), "owner": F.lit("o"), "text_sha256": F.lit("s")})
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()), key=str)
    assert got == sorted([(None, None, 1, True), (None, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True), (9, 9, 1, True)], key=str)
    odd = odd.withColumns({"name": F.lit("n"), "Name_": F.lit("m"), "staying": F.lit(0)})
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(4, "y"), (9, None), (None, "x")]
    assert exact_dedup.drop_copies(empty).count() == 0


def test_exact_hot_owner(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PROBE_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "FLUSH_BYTES", 500)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == exact_brute(rows)


def test_index_splits_and_chains():
    index = exact_dedup.ExtendibleIndex(capacity=4)
    keys = [k * 2654435761 % 2**64 for k in range(500)]
    for k in keys:
        assert index.put(k, "", b"%d" % k, k, 1)
    assert not index.put(keys[3], "", b"%d" % keys[3], -1, 2)
    stored = exact_dedup.StoredIndex()
    for bucket in index.buckets():
        stored.load(bucket.pattern, np.array([(k, np.arange(32), e[2], e[3]) for k, chain in bucket.chains.items() for e in chain], exact_dedup._ENTRY).tobytes())
    stored.load(-1, np.array([b.pattern for b in index.slots], "<i8").tobytes())
    assert stored.get(keys[3], bytes(range(32))) == (-1, 3) and stored.get(keys[9], bytes(range(32))) == (keys[9], 1)
    for n in range(20):  # one key, different bytes: a chain that no split can part
        assert index.put(7, "", b"other %d" % n, n, 1)
    assert index.depth >= 6 and len(index.slots) == 1 << index.depth
    assert all(index.slots[i & (len(index.slots) - 1)].pattern == i & ((1 << index.slots[i & (len(index.slots) - 1)].depth) - 1) for i in keys)
    found = {(key, e[1]): e[2:] for _, key, _, e in index.entries()}
    assert len(found) == 520 and found[keys[3], b"%d" % keys[3]] == [-1, 3]


def near_brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize(("block", "few", "most", "words", "percent"), [(256, 64, 20_000, 3, 85), (4, 64, 20_000, 5, 80), (4, 2, 3, 3, 85)])
def test_near_components(docs, rows, monkeypatch, block, few, most, words, percent):
    monkeypatch.setattr(minhash_dedup, "FEW", few)
    monkeypatch.setattr(minhash_dedup, "MOST_GROUP", most)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "PIVOTS", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_components(docs, words, percent).collect()}
    want = near_brute(rows, words, percent)
    assert got == want
    assert max(Counter(c for _, c, _ in want.values()).values()) > 9


def test_near_edges(spark, empty):
    assert minhash_dedup.near_components(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (2, "A B\nc d e f"), (2, "A B\nc d e f"), (8, None), (9, " ")], "doc_id long, text string").withColumns({"class": F.lit(1), "family": F.lit(2), "task": F.lit("t")})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_components(odd).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (5, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True), (8, 0, 8, True), (9, 0, 9, True)], key=str)
    kept = minhash_dedup.drop_near_copies(odd.withColumns({"name": F.lit("n"), "row": F.lit(3)}))
    assert kept.columns == [*odd.columns, "name", "row"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, "a b c d e f"), (2, "A B\nc d e f"), (8, None), (9, " ")], key=str)
    assert minhash_dedup.drop_near_copies(empty).count() == 0


def test_rows_that_share_an_id(spark):
    """Near copies 2 and 5, and another text that is 5 too: it stays."""
    own = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(2, own), (5, own + " x"), (5, other), (5, other), (7, other + " y"), (None, own), (None, own)]
    kept = minhash_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(2, own), (5, other), (None, own), (None, own)], key=str)


def test_agreement_of_pairs_at_the_threshold():
    rng = np.random.default_rng(7)
    for percent in (80, 85):
        count = shingles.banding(percent)
        least, agrees = shingles.agreement(percent, 5 * count), []
        for n in (9, 20, 100, 700):
            for _ in range(60):
                both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                rest = rng.integers(0, 1 << 63, int(n * (100 - percent) / percent), dtype=np.uint64)
                cut = len(rest) // 2
                a, b = (np.frombuffer(shingles.bands(np.unique(np.concatenate((both, x))), count)[1], np.uint8) for x in (rest[:cut], rest[cut:]))
                agrees.append(int((a == b).sum()))
        assert min(agrees) >= least and least > 0.6 * 5 * count
        half = [np.unique(np.concatenate((both[:100], rng.integers(0, 1 << 63, 50, dtype=np.uint64)))) for _ in range(40)]
        sketches = [np.frombuffer(shingles.bands(x, count)[1], np.uint8) for x in half]
        assert np.mean([(x == y).sum() >= least for i, x in enumerate(sketches) for y in sketches[:i]]) < 0.01


@pytest.mark.parametrize("kind", ["chain", "template"])
def test_half_similar_pages_make_no_family(spark, kind, monkeypatch):
    """Pages that share half with the next one, or a template with all: no family, so nothing to verify."""
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    parts = [word(60) for _ in range(401)]
    shared = word(60)
    rows = [(i, " ".join(parts[i] + (parts[i + 1] if kind == "chain" else shared))) for i in range(400)]
    seen = []
    monkeypatch.setattr(minhash_dedup, "_large", lambda *x: seen.append(x))
    own = minhash_dedup.families

    def families(*x):
        out = own(*x)
        seen.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "families", families)
    got = minhash_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("kept").count() == 400 and seen[0] < 8 and len(seen) == 1


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = np.unique(base[:600]), np.unique(base[60:660])  # 540 of 660 in common
    agree = np.mean([(shingles.sketch(shingles.mix(a + np.uint64(s)), 200) == shingles.sketch(shingles.mix(b + np.uint64(s)), 200)).mean() for s in range(20)])
    assert abs(agree - 540 / 660) < 0.02
    small = a[:2]
    assert shingles.sketch(small, 160).max() < np.iinfo(np.uint64).max


def test_components(spark):
    links = [(2, 1), (3, 2), (9, 3), (9, 9), (20, 30), (30, 40), (41, 40), (5, 6), (6, 5)] + [(100, i) for i in range(101, 160)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 30: 20, 40: 20, 41: 20, 6: 5, **{i: 100 for i in range(101, 160)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def suffix_brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        out[i] = len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


@pytest.mark.parametrize(("flush", "sort", "hot"), [(3 << 19, 2 << 20, 10_000), (500, 300, 3), (20_000, 2 << 20, 1)])
def test_remove_repeats(docs, rows, flush, sort, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, flush=flush, sort=sort, hot=hot).collect()}
    want = suffix_brute(rows)
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000


def test_remove_repeats_edges(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    own = "".join(chr(97 + i * i % 26) + chr(97 + i % 23) for i in range(90))
    odd = spark.createDataFrame([(1, own), (1, own), (None, own), (7, None)], "doc_id long, text string").withColumn("kind", F.lit("x"))
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(odd).collect()), key=str)
    assert got == [(1, 180, 0), (1, 180, 0), (7, 0, 0), (None, 180, 180)]


def test_rows_without_id_are_dealt_out(spark):
    texts = ["".join(chr(97 + (i * j * j + j) % 26) for j in range(150)) for i in range(3, 40)]
    odd = spark.createDataFrame([(None, t) for t in texts] + [(3, t) for t in texts], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(odd).collect()]
    assert sum(n for i, n in got if i is None) == 150 * len(texts)
    tags = np.array([hash(t) & ((1 << 63) - 1) for t in texts], np.uint64)
    assert len(set(suffix_dedup.bucket_of(np.full(len(texts), suffix_dedup.NO_ID), tags, 8).tolist())) > 4


def test_hot_anchors_fit_a_bound(spark):
    blobs = [("hot", 0, suffix_dedup.dump(np.arange(400 * i, 400 * i + 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(400) + 10)) for i in range(5)]
    runs = spark.createDataFrame(blobs, "kind string, bucket int, blob binary")
    assert len(suffix_dedup.hot_anchors(runs, 9)) == 2000
    few = suffix_dedup.hot_anchors(runs, 9, most=2000)
    assert 0 < len(few) < 2000 and list(few) == sorted(few)


def test_refine_sorts_suffixes():
    data = np.frombuffer(b"banana" * 30 + b"bandana" * 20 + bytes(range(97, 120)) * 9, np.uint8)
    text = data.tobytes()
    for depth in (8, 20, 100):
        pointer = suffix_dedup.refine(data, depth)
        inner = range(len(text) - depth + 1)
        keys = {i: text[i : i + depth] for i in inner}
        assert all((keys[i] == keys[j]) == (pointer[i] == pointer[j]) for i in inner for j in list(inner)[:: 7])
        assert sorted(inner, key=lambda i: keys[i]) == sorted(inner, key=lambda i: (pointer[i], i))


def test_chunks_cover_every_start():
    text = bytes(range(256)) * 5
    parts = [p for part in suffix_dedup.chunks([(1, 2, text), (3, 4, b"short")], 300) for p in part]
    starts = sorted(at + i for doc, _, piece, at in parts if doc == 1 for i in range(len(piece) - 99))
    assert starts == list(range(len(text) - 99)) and all(piece == text[at : at + len(piece)] for doc, _, piece, at in parts if doc == 1)
