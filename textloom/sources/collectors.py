"""Collectors of text and prompts from sources of several shapes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T

SCALAR_KEYS = ["text", "chosen", "rejected", "prompt"]
MESSAGE_KEYS = ["conversations", "messages"]
_TURNS = "array<struct<content: string>>"


def texts_of_lines(lines: DataFrame, order: str, value: str = "value") -> DataFrame:
    """(order, item, text): the string values of a record's text keys, then its messages' contents, in that order."""
    variant = F.try_parse_json(F.col(value))
    scalar = [F.when(F.schema_of_variant(F.try_variant_get(variant, f"$.{k}", "variant")) == "STRING", F.try_variant_get(variant, f"$.{k}", "string")) for k in SCALAR_KEYS]
    turns = [F.transform(F.coalesce(F.from_json(F.get_json_object(value, f"$.{k}"), _TURNS), F.expr(f"cast(array() as {_TURNS})")), lambda m: m.content) for k in MESSAGE_KEYS]
    items = F.filter(F.concat(F.array(*scalar), *turns), lambda x: x.isNotNull())
    return lines.select(order, F.posexplode(items).alias("item", "text"))


def texts_of_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The texts of all files there are; a missing one is skipped."""
    from textloom.sources import jsonl

    jvm = spark.sparkContext._jvm
    there = [p for p in paths if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(h)]
    out = spark.createDataFrame([], "source string, line_no long, item int, text string")
    for p in there:
        rows = texts_of_lines(jsonl.numbered(jsonl.lines(spark, p)), "line_no")
        out = out.unionByName(rows.withColumn("source", F.lit(p)))
    return out


QA_SCHEMA = "map<string, struct<QUESTION: string, CONTEXTS: array<string>, reasoning: string, answer: string>>"


def qa_texts(whole: DataFrame, value: str = "value") -> DataFrame:
    """(key, item, text) of a JSON object of questions: question, contexts, reasoning if there is one, answer; missing ones are empty."""
    entries = whole.select(F.explode(F.from_json(value, QA_SCHEMA)).alias("key", "qa"))
    empty = F.lit("")
    reasoning = F.when(F.col("qa.reasoning").isNotNull(), F.array("qa.reasoning")).otherwise(F.expr("cast(array() as array<string>)"))
    items = F.concat(F.array(F.coalesce("qa.QUESTION", empty)), F.coalesce("qa.CONTEXTS", F.expr("cast(array() as array<string>)")), reasoning, F.array(F.coalesce("qa.answer", empty)))
    return entries.select("key", F.posexplode(items).alias("item", "text"))


def prompt_cache(categories: DataFrame, prompts: DataFrame) -> DataFrame:
    """(cat, prompts): every category with its prompts in order; other categories are dropped."""
    joined = categories.join(prompts, "cat", "left").groupBy("cat").agg(F.array_sort(F.collect_list(F.when(F.col("prompt").isNotNull(), F.struct("ord", "prompt")))).alias("p"))
    return joined.select("cat", F.transform("p", lambda x: x.prompt).alias("prompts"))


def safe_name(category: str) -> str:
    """A category's file name."""
    return re.sub(r"\)", "", re.sub(r"[(+]", "_", category))


def prompt_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, value): the lines of the prompt files that a pattern names, each a file or a folder of parts."""
    name = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"([^/]*_prompts\.txt)", 1)
    return spark.read.text(pattern).select("value", name.alias("file"))


def legacy_prompts(lines: DataFrame, categories: list[str], known: DataFrame) -> DataFrame:
    """(cat, prompt) of per-category text files (file, value) that are not known yet, each once."""
    names = F.create_map(*(F.lit(x) for c in categories for x in (f"{safe_name(c)}_prompts.txt", c)))
    own = lines.select(F.try_element_at(names, F.substring_index("file", "/", -1)).alias("cat"), T.strip(F.col("value")).alias("prompt"))
    return own.where("cat IS NOT NULL AND prompt <> ''").distinct().join(known.select("cat", "prompt"), ["cat", "prompt"], "left_anti")


def generated(requests: DataFrame, complete, schema: str) -> DataFrame:
    """A remote text source as a plug-in: ``complete`` maps an iterator of pandas frames of requests to frames of ``schema``."""
    return requests.mapInPandas(complete, schema)
