"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from textloom.llm import decontaminate

from .test_dedup import exact_brute, near_brute


def test_stages(spark, rows, tmp_path):
    table = [(i, t, "aa", "s", len(t or "")) for i, t in rows] + [(5000, "¿ 12 !", "aa", "s", 6), (5001, "the of an re ti on er in es or nd ha ed ing exactly this item", None, "s", 9)]
    own = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    own.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "The of an re ti on er in es or nd ha ed ing exactly this item"), (2, "not there at all in any document")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
        want = {
            "language_id": lambda: {i for i, t in before if t and any(map(str.isalpha, t))},
            "exact_dedup": lambda: {i for i, x in exact_brute(before).items() if x[2]},
            "minhash_dedup": lambda: {i for i, x in near_brute(before, 5, 80).items() if x[2]},
            "decontaminate": lambda: {i for i, t in before if decontaminate.normalise(items[0][1]) not in decontaminate.normalise(t)},
        }[name]()
        assert kept[name] == want, name
    assert 5000 not in kept["language_id"] and 5001 in kept["minhash_dedup"] and 5001 not in kept["decontaminate"]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept["decontaminate"]
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert whole.where("n <> t").count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing names, an empty table."""
    long = "the of an re ti on er in es or nd ha ed ing st th at en it ly"
    passage = "one passage of the benchmark that is long enough to be found"
    table = [
        (1, long, "aa", "s"), (1, long, "aa", "s"), (2, long + "  ", None, None), (None, long + " x", "aa", None), (None, None, None, None), (None, None, None, None), (5, "", "aa", "s"), (6, "12 !", "aa", "s"),
        (7, "other words of a text that stays", "bb", "s"), (7, "other words of a text that stays", "bb", "s"), (8, f"so {passage} here", "aa", "s"), (9, long + " and", "aa", "s"), (9, "a text of its own with the id of another", "aa", "s"),
    ]
    names = ["name", "row", "name_", "class", "sha", "key", "bands", "family", "component_id", "kept", "staying", "shard", "text_sha256"]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string").withColumns({n: F.lit(n) for n in names})
    spark.createDataFrame([(1, passage), (None, ""), (2, None), (1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda name: sorted(((r.doc_id, r.text) for r in stages[name](spark, docs, str(tmp_path)).collect()), key=str)
    plain = sorted([(i, t) for i, t, _, _ in table], key=str)
    assert rows("language_id") == [x for x in plain if x[1] and any(map(str.isalpha, x[1]))]
    assert rows("exact_dedup") == sorted([(1, long), (None, long + " x"), (5, ""), (6, "12 !"), (7, "other words of a text that stays"), (8, f"so {passage} here"), (9, long + " and"), (9, "a text of its own with the id of another"), (2, long + "  ")], key=str)
    near = rows("minhash_dedup")
    assert near == sorted([(1, long), (None, long + " x"), (None, None), (None, None), (5, ""), (6, "12 !"), (7, "other words of a text that stays"), (8, f"so {passage} here"), (9, "a text of its own with the id of another")], key=str)
    assert rows("decontaminate") == [x for x in plain if passage not in (x[1] or "")]
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert sum(p.length for p in pieces if p.doc_id is None) == sum(p.doc_tokens for p in pieces if p.doc_id is None and p.start == 0) and len({p.sequence_id for p in pieces}) >= 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
