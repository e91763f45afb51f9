"""Texts of a million characters that patterns could trip over, repeated rows, and prefix sums with ties."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import clean, dedup, quotas, sample, scrub, tokens
from textloom.plans import corpus, registry
from textloom.sources import jsonl

N = 1_000_000
LONG = {"blanks": " " * N, "inner blanks": "a" + " " * N + "b", "letters": "a" * N, "roads": "一路" * (N // 2), "digits": "7" * N, "open": "<" * N, "half open": "<a " * (N // 3) + "> <b", "lines": "\n" * N, "at": "a@" * (N // 2), "dots": "1." * (N // 2), "amp": "&a" * (N // 2), "quotes": '"' * N, "name": "患者" * (N // 2), "answers": "答 " * (N // 2), "wide blanks": "，" + "\u3000" * N + "一"}


@pytest.mark.parametrize("name", LONG)
def test_a_million_characters(spark, name):
    df = spark.createDataFrame([(1, LONG[name])], "doc_id long, text string")
    began = time.time()
    assert scrub.scrub(df).select(*(F.col(c) for c in scrub.COUNTS), F.length("text").alias("n")).first().n is not None
    assert df.select(F.length(clean.clean(F.col("text"))).alias("n")).first().n is not None
    for step in (clean.join_cjk, clean.answer_of, clean.strip_numbering, clean.prompt_line, clean.valid_thinking, clean.preview):
        df.select(step(F.col("text")).alias("x")).collect()
    assert df.select(T.strip(F.col("text")).alias("t")).first().t == LONG[name].strip()
    assert time.time() - began < 30


def test_patterns_find_what_the_plain_ones_do(spark):
    plain = next(p for n, _, _, p in scrub.RULES if n == "n_email")
    texts = ["a@b.c_d@e.f", "x.y+z@q-r.st.", "a@b a@b.", "_@a.b-@c.d", "no", "@a.b", "a@@b.c", "a@b.c@d.e", "+a+@b.cc..", "a" * 50 + "@b.c"]
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_replace("t", scrub.LINEAR["n_email"], "#").alias("x")).collect()}
    assert got == {t: re.sub(plain, "#", t) for t in texts}
    address = r"(?:[一-鿿]{1,3}(?:省|市|区|县|镇|乡|村|路|街|道|号|栋|幢|楼|室|单元)){2,}"
    texts = ["湖北省武汉市", "省市区县镇", "一路一路一", "路路路路", "市", "在市区路口", "和平路三单元五楼", "一二三四路五号", "号号", "a市b市", "大道道号"]
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_replace("t", scrub.ADDRESS, "#").alias("x")).collect()}
    assert got == {t: re.sub(address, "#", t) for t in texts}
    texts = ["<a>b</a>", "<>x<y>", "a<b", "a>b<c", "<<a>>", "", ">", "<a\nb>c", "x<"]
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean.clean(F.col("t")).alias("x")).collect()}
    assert got == {t: "\n".join(x.strip() for x in re.sub(r"<[^>]+>", "", t).strip().split("\n") if x.strip()) for t in texts}


def test_each_rule_finds_something(spark):
    rows = scrub.scrub(corpus.named_texts(spark, "/root/testdata/sf0.001")).agg(*(F.sum(c).alias(c) for c in scrub.COUNTS)).first()
    assert all(rows[c] for c in scrub.COUNTS)


def test_repeated_rows_have_one_first(spark):
    rows = [(1, "aaaa bbbb"), (1, "aaaa bbbb"), (1, "aaaa bbbb"), (2, "aaaa bbbb"), (3, "bbbb aaaa b"), (None, "cccc"), (None, "cccc"), (4, None), (5, None), (6, "aaaa bbb" + "b" * 9), (7, ""), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "status": F.lit("x"), "key": F.lit("k"), "fp": F.lit("f")})
    got = sorted(((r.doc_id, r.status) for r in dedup.dedup_status(df).collect()), key=str)
    assert got == sorted([(1, "unique"), (1, "exact_dup"), (1, "exact_dup"), (2, "exact_dup"), (3, "unique"), (None, "unique"), (None, "exact_dup"), (4, "unique"), (5, "exact_dup"), (6, "near_dup"), (7, "unique"), (8, "exact_dup")], key=str)
    assert dedup.dedup_status(df.limit(0)).count() == 0


def test_sums_with_ties_and_nulls(spark):
    rows = [(None, 5), (1, None), *((2, 1) for _ in range(50)), (3, 7)]
    out = sample.prefix_sum(spark.createDataFrame(rows, "o long, v long"), "o", "v", "s").collect()
    assert sorted(r.s for r in out) == sorted([5, 5, *range(6, 56), 62])
    hot = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 1), (None, 2), (None, 3)], "k string, o long").repartition(3)
    got = sorted((str(r.k), r.o, r.n) for r in sample.number_within(hot, "k", F.col("o"), "n").collect())
    assert got == sorted([("a", i, i + 1) for i in range(200)] + [("b", 1, 1), ("None", 2, 1), ("None", 3, 2)])
    need = spark.createDataFrame([("a", 3)], "k string, gap long")
    assert {r.o for r in quotas.shuffled_take(hot, "k", F.col("o"), need).collect()} == {0, 1, 2}


def test_first_sequences(spark):
    df = spark.createDataFrame([(i, list(range(3 * i, 3 * i + 3))) for i in range(9)], "d long, ids array<int>")
    packed = tokens.pack(df, "d", "ids", 4)
    assert [r.input_ids for r in tokens.first_sequences(packed, "chunk", 2).collect()] == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert tokens.first_sequences(packed, "chunk", None).count() == 6 and tokens.pack(df.limit(0), "d", "ids", 4).count() == 0


def test_exact_counter(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    row = spark.createDataFrame([("hello world, hello",)], "t string").select(sample.counted_tokens(F.col("t")).alias("e"), sample.counted_tokens(F.col("t"), tokens.bpe_count(path)).alias("n")).first()
    assert (row.e, row.n) == (12, 4)


def test_index_of_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n":0}\n\n  \n{"n":1}\n')
    (tmp_path / "b.jsonl").write_text('{"n":2}\nbroken\n\n{"n":4}')
    index = jsonl.index(jsonl.lines(spark, str(tmp_path)))
    assert [(r.record, r.value) for r in index.orderBy("record").collect()] == [(0, '{"n":0}'), (1, '{"n":1}'), (2, '{"n":2}'), (3, "broken"), (4, '{"n":4}')]
    assert [r.value for r in jsonl.lookup(index, spark.createDataFrame([(4,), (4,), (1,), (99,)], "record long")).orderBy("record").collect()] == ['{"n":1}', '{"n":4}']
    numbered = jsonl.numbered(jsonl.lines(spark, str(tmp_path)))
    assert [r.line_no for r in numbered.orderBy("line_no").collect()] == list(range(8))


def test_stats_of_an_empty_corpus(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    row = registry.QUERIES["cleanse_stats"](spark, str(tmp_path)).first()
    assert (row.total_input, row.total_output, row.quality_filter_stats) == (0, 0, "")


def test_masks_of_long_conversations(spark):
    """Two thousand turns, a million characters; and spans in plain Python over short ones."""
    from textloom.operators import chat

    turns = "".join(f"<|im_start|>user\n{'q' * 400}<|im_end|>\n<|im_start|>assistant\n{'a' * 500}<|im_end|>\n" for _ in range(1000))
    began = time.time()
    ids = tokens.code_points(F.col("t"))
    mask = spark.createDataFrame([(turns,)], "t string").select(T.held(ids).alias("ids")).select(T.held(chat.assistant_mask(F.col("ids"))).alias("m"))
    row = mask.select(F.size("m").alias("n"), F.aggregate("m", F.lit(0), lambda a, x: a + x).alias("k")).first()
    assert (row.n, row.k) == (len(turns), 1000 * 511) and time.time() - began < 60
    begin, end = "<|im_start|>assistant\n", "<|im_end|>\n"
    texts = ["", "x", begin, begin + "a", begin + end + "b", "x" + begin + "a" + end + begin + "b", begin + begin + end + end, end + begin + "c" + end[:-1], begin[:-1]]
    got = {r.t: r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.held(tokens.code_points(F.col("t"))).alias("ids")).select("t", chat.assistant_mask(F.col("ids")).alias("m")).collect()}
    for t in texts:
        want, at = [0] * len(t), 0
        while (a := t.find(begin, at)) >= 0:
            b = t.find(end, a + len(begin))
            at = len(t) if b < 0 else b + len(end)
            want[a + len(begin) : at] = [1] * (at - a - len(begin))
        assert got[t] == want, t


def exchanged(plan):
    """Types of the columns that the exchanges of a plan carry."""
    plan = plan.initialPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    own = [f.dataType().simpleString() for f in plan.schema().fields()] if plan.nodeName() == "Exchange" else []
    return own + [t for i in range(plan.children().size()) for t in exchanged(plan.children().apply(i))]


@pytest.mark.parametrize("name", ["pack_sequences", "pack_first"])
def test_packing_sends_texts_and_not_ids(spark, name, monkeypatch):
    from textloom.sources import tables

    kept, keep = [], tables.keep
    monkeypatch.setattr(tables, "keep", lambda df, name: kept.extend(f.dataType.simpleString() for f in df.schema.fields) or keep(df, name))
    types = exchanged(registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan())
    assert types and not [t for t in types + kept if t.startswith("array")]


def test_pack_by_texts(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 5)
    monkeypatch.setattr(tokens, "BLOCK", 16)
    rng = random.Random(5)
    rows = [(i // 2, "".join(rng.choice("ab\né😀") for _ in range(rng.choice([0, 1, 4, 5, 6, 10, 61])))) for i in range(41)] + [(7, None), (99, "x" * 500)]
    df = spark.createDataFrame(rows, "d long, t string").coalesce(1)
    whole = [x for _, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]) for x in [1, *(ord(c) + 16 for c in t), 2]]
    ids, size = tokens.segment_ids("t")
    for length in (1, 7, 40):
        want = [whole[i : i + length] for i in range(0, len(whole) - length + 1, length)]
        for most in (None, 5):
            got = tokens.pack(tokens.text_segments(df, "t"), "d", ids, length, size, most).orderBy("chunk").collect()
            assert [(r.chunk, r.input_ids) for r in got] == list(enumerate(want))[:most]
            assert all(r.labels == [-100 if x == 1 and i else x for i, x in enumerate(r.input_ids)] for r in got)


def test_first_sequences_put_no_others_together(spark):
    """All rows are sized, but only those of the first chunks reach the ids."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def own(t):
        seen.add(1)
        return [ord(c) for c in t]

    df = spark.createDataFrame([(i, f"{i:04}") for i in range(2000)], "d long, t string")
    got = tokens.pack(df, "d", own("t"), 8, F.length("t"), 2).orderBy("chunk").collect()
    assert ["".join(map(chr, r.input_ids)) for r in got] == ["00000001", "00020003"] and seen.value == 4
