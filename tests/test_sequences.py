"""Sequence operators against step-by-step Python models."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chat, quotas, sample, tokens, training

B, E = [1, 9], [2, 8]


def python_mask(ids, begin, end):
    mask, i = [0] * len(ids), 0
    while i < len(ids):
        if ids[i : i + len(begin)] != begin:
            i += 1
            continue
        a = i + len(begin)
        j = a
        while j < len(ids) and ids[j : j + len(end)] != end:
            j += 1
        stop = min(j + len(end), len(ids)) if j < len(ids) else len(ids)
        mask[a:stop] = [1] * (stop - a)
        i = max(stop, a)
    return mask


@pytest.mark.parametrize(("begin", "end"), [(B, E), ([1], [2]), ([1, 2, 1], [2, 1])])
def test_span_mask(spark, begin, end):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1, 2, 8, 9]) for _ in range(rng.choice([0, 1, 5, 40]))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, ids array<int>")
    got = {r.i: r.m for r in df.select("i", tokens.span_mask(F.col("ids"), begin, end).alias("m")).collect()}
    assert got == {i: python_mask(ids, begin, end) for i, ids in rows}


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i * 7 % 101, [1, *(rng.randrange(3, 50) for _ in range(rng.choice([0, 1, 9, 200]))), 2]) for i in range(60)]
    whole = [x for _, ids in sorted(rows) for x in ids]
    want = [whole[i : i + 64] for i in range(0, len(whole) - 63, 64)]
    got = tokens.pack(spark.createDataFrame(rows, "o int, ids array<int>"), "o", "ids", 64).orderBy("chunk").collect()
    assert [r.input_ids for r in got] == want
    assert [r.labels for r in got] == [[-100 if x == 1 and i else x for i, x in enumerate(c)] for c in want]
    assert tokens.pack(spark.createDataFrame([], "o int, ids array<int>"), "o", "ids", 64).count() == 0


def test_padding_and_shift(spark):
    df = spark.createDataFrame([([5, 0, 7],)], "ids array<int>").withColumn("mask", F.array(F.lit(0), F.lit(1), F.lit(1)))
    r = df.select(*(c.alias(k) for k, c in tokens.padded(F.col("ids"), 5).items()), tokens.padded_by_id(F.col("ids"), 5)["labels"].alias("by_id")).first()
    assert (r.input_ids, r.labels, r.attention_mask, r.by_id) == ([5, 0, 7, 0, 0], [5, 0, 7, -100, -100], [1, 1, 1, 0, 0], [5, -100, 7, -100, -100])
    r = df.select(*(c.alias(k) for k, c in tokens.shifted(F.col("ids"), F.col("mask"), 5).items())).first()
    assert (r.x, r.y, r["mask"]) == ([5, 0, 7, 0], [0, 7, 0, 0], [1, 1, 0, 0])
    assert tokens.fallback_ids(None, 0, 3) == (3, 3, 3) and tokens.fallback_ids(1, 2, None) == (1, 2, 0)


def test_prefix_sum_and_paging(spark):
    rng = random.Random(3)
    rows = [(i * 37 % 1009, rng.randrange(9)) for i in range(1009)]
    got = {r.o: r.s for r in sample.prefix_sum(spark.createDataFrame(rows, "o long, v long"), "o", "v", "s").collect()}
    total, want = 0, {}
    for o, v in sorted(rows):
        total += v
        want[o] = total
    assert got == want
    df = spark.range(100).withColumnRenamed("id", "o")
    assert [sample.skip_batches(df, "o", 8, k).count() for k in (0, 3, 12, 13, 99)] == [100, 76, 4, 0, 0]
    assert sample.prefix_sum(spark.createDataFrame([], "o long, v long"), "o", "v", "s").count() == 0


@pytest.mark.parametrize(("n_first", "n_second", "share"), [(5, 9, 0.7), (9, 5, 0.7), (0, 4, 0.5), (4, 0, 0.5), (20, 3, 0.1), (6, 6, 0.5)])
def test_interleave(spark, n_first, n_second, share):
    rng = random.Random(n_first)
    draws = [rng.random() < share for _ in range(n_first + n_second)]
    a, b = [("first", i) for i in range(n_first)], [("second", 100 + i) for i in range(n_second)]
    want = []
    for take in draws:
        side, other = (a, b) if take else (b, a)
        want.append((side or other).pop(0))
    frame = lambda n, base: spark.createDataFrame([(i + 1, base + i) for i in range(n)], "rank long, id long")
    got = sample.interleave(frame(n_first, 0), frame(n_second, 100), spark.createDataFrame(list(enumerate(draws)), "step long, take_first boolean"))
    assert [(r.side, r.id) for r in got.orderBy("place").collect()] == want
    assert [r.place for r in got.orderBy("place").collect()] == list(range(1, len(want) + 1))


def test_budget_takes_the_crossing_row(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5)], "o long, t long")
    kept = lambda n: sorted(r.o for r in sample.token_budget(df, "o", "t", n).collect())
    assert kept(10) == [1, 2] and kept(11) == [1, 2, 3] and kept(1000) == [1, 2, 3, 4] and kept(1) == [1]


def test_quotas(spark):
    targets = spark.createDataFrame([("a", 450), ("b", 2), ("c", 0)], "category string, target long")
    done = spark.createDataFrame([("a",), ("b",), ("b",), ("b",), ("x",)], "category string")
    gaps = quotas.gaps(targets, done)
    assert {tuple(r) for r in quotas.with_total(gaps).collect()} == {("a", 450, 1, 449), ("b", 2, 3, 0), ("c", 0, 0, 0), ("total", 452, 4, 449)}
    assert [(r.batch, r.ask) for r in quotas.request_batches(gaps).orderBy("batch").collect()] == [(0, 200), (1, 200), (2, 49)]


def test_chat_shapes(spark):
    df = spark.createDataFrame([("[{\"name\": \"f\"}]", "not json {")], "tools string, bad string")
    r = df.select(F.to_json(chat.parsed_tools(F.col("tools"))).alias("t"), chat.parsed_tools(F.col("bad")).alias("b")).first()
    assert r.t == '[{"name":"f"}]' and r.b is None
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))
    row = spark.range(1).select(chat.render(messages, prompt=True).alias("p"), T.held(chat.sft_record(F.lit("s"), F.lit("u"), F.lit("a"), F.lit("c"), F.lit(3))["metadata"]).alias("m")).first()
    assert row.p == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n" and (row.m.category, row.m.sample_idx) == ("c", 3)


def test_schedule_and_nucleus(spark):
    lr = [r.x for r in spark.range(101).select(training.learning_rate(F.col("id"), 100, 1.0).alias("x"), "id").orderBy("id").collect()]
    assert lr[0] == 0 and lr[5] == 0.5 and abs(lr[10] - 1) < 1e-12 and abs(lr[100] - 0.1) < 1e-12 and lr[10:] == sorted(lr[10:], reverse=True)
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate([3.0, 2.0, 1.0, -9.0])], "k int, i int, x double")
    assert sorted(r.i for r in training.nucleus(df, "k", "i", "x", 0.6).collect()) == [0] and sorted(r.i for r in training.nucleus(df, "k", "i", "x", 0.7).collect()) == [0, 1]
