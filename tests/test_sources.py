"""Scans, collectors, configuration, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from textloom.sources import collectors, config, jsonl, sinks
from textloom.streaming import cleanse

SCHEMA = StructType([StructField("id", LongType()), StructField("text", StringType())])
LINES = ['{"id": 1, "text": "ü"}', "", '{"id": 2', "   ", "[1, 2]", '{"text": null}', '{"id": 3, "text": "x", "more": 1}']


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = tmp_path_factory.mktemp("lines") / "a.jsonl"
    path.write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return str(path)


def test_scans(spark, file):
    lines = jsonl.numbered(jsonl.lines(spark, file))
    rows = jsonl.tolerant(lines, SCHEMA).orderBy("line_no").collect()
    assert [r.value for r in rows] == LINES and [r.line_no for r in rows] == list(range(7))
    assert [r.json_error for r in rows] == [False, True, True, True, True, False, False]
    assert [(r.id, r.text) for r in rows if not r.json_error] == [(1, "ü"), (None, None), (3, "x")]
    assert jsonl.blank_skipping(lines, SCHEMA).count() == 5
    assert jsonl.line_at(jsonl.tolerant(lines, SCHEMA), 6).first().id == 3
    with pytest.raises(Exception, match="FAILFAST"):
        jsonl.strict(lines, SCHEMA).collect()
    assert jsonl.records(spark, file, SCHEMA).where("id = 1").count() == 1


def test_collectors(spark, file, tmp_path):
    rows = [{"text": "a", "prompt": 5, "chosen": "", "messages": [{"role": "user", "content": "m1"}, {"content": "m2"}], "conversations": [{"content": "c"}]}, {"other": 1}]
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    found = collectors.texts_of_files(spark, [str(path), str(tmp_path / "missing")]).orderBy("line_no", "item").collect()
    assert [r.text for r in found] == ["a", "", "c", "m1", "m2"]
    whole = spark.createDataFrame([(json.dumps({"k": {"QUESTION": "q", "CONTEXTS": ["x", "y"], "answer": "z"}, "l": {"reasoning": "r"}}),)], "value string")
    assert [(r.key, r.text) for r in collectors.qa_texts(whole).orderBy("key", "item").collect()] == [("k", "q"), ("k", "x"), ("k", "y"), ("k", "z"), ("l", ""), ("l", "r"), ("l", "")]
    assert collectors.safe_name("a(b+c)") == "a_b_c"
    legacy = spark.createDataFrame([("/x/a_b_c_prompts.txt", "one"), ("/x/a_b_c_prompts.txt", " one "), ("/x/a_b_c_prompts.txt", "two"), ("/x/z_prompts.txt", "q")], "file string, value string")
    known = spark.createDataFrame([("a(b+c)", "two")], "cat string, prompt string")
    assert [tuple(r) for r in collectors.legacy_prompts(legacy, ["a(b+c)"], known).collect()] == [("a(b+c)", "one")]


def test_generated_source(spark):
    def complete(frames):
        for f in frames:
            yield f.assign(text="echo " + f["prompt"])

    assert collectors.generated(spark.createDataFrame([("p",)], "prompt string"), complete, "prompt string, text string").first().text == "echo p"


def test_config():
    tree = {"training": {"lr": 1, "max": {"steps": 9}}, "model": {"hidden_size": 4}, "generation": {"prompts": ["x"]}, "seed": 7}
    assert config.flatten(tree) == {"training_lr": 1, "training_max_steps": 9, "model_hidden_size": 4, "generation_prompts": ["x"], "seed": 7}
    assert config.apply({"lr": 0, "max_steps": 0, "hidden_size": 0, "generate_prompts": None, "seed": 0, "training_lr": 5}, tree) == {"lr": 0, "max_steps": 9, "hidden_size": 4, "generate_prompts": None, "seed": 7, "training_lr": 1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, " é ")], "id long, text string")
    sinks.append(df, f"{tmp_path}/a")
    sinks.append(df, f"{tmp_path}/a")
    assert spark.read.json(f"{tmp_path}/a").count() == 2
    sinks.texts(df, f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t").collect()] == ['{"text":"é"}']
    sinks.raw_lines(df.select(F.col("text").alias("value")), f"{tmp_path}/r")
    sinks.one_file(df, f"{tmp_path}/o")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()] == [" é "]


def test_streams(spark, tmp_path):
    rows = [(i, f"text number {i // 2} " + "word " * 20) for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = cleanse.read(spark, f"{tmp_path}/in", "doc_id long, text string")
    cleanse.drain(cleanse.cleansed(stream).select("doc_id", "text"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted({t.strip() for _, t in rows})
    spark.createDataFrame([(i % 2, [i] * 10) for i in range(12)], "shard long, ids array<int>").repartition(2).write.parquet(f"{tmp_path}/ids")
    packed = cleanse.packed(cleanse.read(spark, f"{tmp_path}/ids", "shard long, ids array<int>"), "shard", 16)
    cleanse.drain(packed, f"{tmp_path}/chunks", f"{tmp_path}/state2")
    chunks = spark.read.parquet(f"{tmp_path}/chunks").collect()
    assert sorted((r.shard, r.chunk) for r in chunks) == [(s, c) for s in (0, 1) for c in range(3)] and all(len(r.input_ids) == 16 for r in chunks)


def test_callbacks_of_a_stream(spark, tmp_path):
    import time

    from textloom.operators import quality
    from textloom.streaming import callbacks, cleanse

    spark.createDataFrame([(i, "passed" if i % 3 else "too_short") for i in range(30)], "doc_id long, reason string").repartition(2).write.parquet(f"{tmp_path}/in")
    logs, ends = [], []
    off = callbacks.listen(spark, callbacks.Callbacks(lambda batch, figures: logs.append(figures["quality"]), ends.append))
    try:
        cleanse.drain(quality.observed(cleanse.read(spark, f"{tmp_path}/in", "doc_id long, reason string")), f"{tmp_path}/out", f"{tmp_path}/state")
        stop = time.time() + 20
        while not ends and time.time() < stop:
            time.sleep(0.1)
    finally:
        off()
    assert ends == [None] and sum(x["rows"] for x in logs) == 30 and sum(x["passed"] for x in logs) == 20


def test_stream_packing_of_long_and_null_documents(spark, tmp_path):
    import time

    from textloom.operators import tokens

    n = 1_000_000
    texts = {0: ["é😀" * (n // 2), None, "", "b" * 37], 1: [None, "ab"], 2: ["x" * 16]}
    spark.createDataFrame([(k, t) for k, own in texts.items() for t in own], "shard long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = cleanse.read(spark, f"{tmp_path}/in", "shard long, text string")
    for name, packed in {"texts": cleanse.packed(stream, "shard", 16, tokens.code_point_encoder()), "ids": cleanse.packed(stream.select("shard", tokens.code_points(F.col("text")).alias("ids")), "shard", 16)}.items():
        began = time.time()
        cleanse.drain(packed, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state")
        assert time.time() - began < 30  # each chunk once copied all that was left of its document
        rows = spark.read.parquet(f"{tmp_path}/{name}").orderBy("shard", "chunk").collect()
        for k, own in texts.items():
            whole = [ord(c) + 16 for t in own for c in t or ""]
            assert [(r.chunk, r.input_ids) for r in rows if r.shard == k] == [(i, whole[16 * i : 16 * i + 16]) for i in range(len(whole) // 16)]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
