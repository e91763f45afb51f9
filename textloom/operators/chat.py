"""Chat and preference records: message arrays, ChatML, training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import tokens

# The template's marks.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def render(messages: Column, prompt: bool = False) -> Column:
    """ChatML of an array of (role, content), with an open assistant turn if ``prompt``."""
    turns = F.transform(messages, lambda m: F.concat(F.lit(BEGIN), m.role, F.lit("\n"), F.coalesce(m.content, F.lit("")), F.lit(f"{END}\n")))
    return F.concat(F.array_join(turns, ""), F.lit(f"{BEGIN}assistant\n" if prompt else ""))


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """A row for each conversation with its turns in order as ``messages``; dealt by key to as many tasks as shuffles have, since long expressions follow."""
    turns = turns.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))


def source_messages(conversations_col: Column, messages_col: Column) -> Column:
    """The conversation under either name; none is an empty one."""
    return F.coalesce(conversations_col, messages_col, F.expr("cast(array() as array<struct<role: string, content: string>>)"))


def parsed_tools(c: Column) -> Column:
    """Tools or tool calls given as a JSON string, as a variant; null if it is none."""
    return F.try_parse_json(c)


def sft_record(system: Column, user: Column, assistant: Column, category: Column, idx: Column) -> dict[str, Column]:
    """Columns messages and metadata of a training conversation."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    meta = F.struct(category.alias("category"), idx.alias("sample_idx"))
    return {"messages": F.array(turn("system", system), turn("user", user), turn("assistant", assistant)), "metadata": meta}


def flagged(metadata: Column, flag: str) -> Column:
    """Metadata with a flag (supplement, regen) set."""
    return metadata.withField(flag, F.lit(True))


def is_flagged(metadata: Column, flag: str) -> Column:
    return F.coalesce(metadata[flag], F.lit(False))


def dpo_sides(messages: Column, chosen: Column, rejected: Column) -> tuple[Column, Column]:
    """Whole message lists of both sides from a shared prefix and two answers."""
    side = lambda c: F.concat(messages, F.array(F.struct(F.lit("assistant").alias("role"), c.alias("content"))))
    return side(chosen), side(rejected)


def sides_of(messages: Column, chosen: Column, rejected: Column, chosen_list: Column, rejected_list: Column) -> tuple[Column, Column]:
    """Either shape of a preference pair: a prefix with two answers where there are messages, else two whole lists."""
    a, b = dpo_sides(messages, chosen, rejected)
    return F.when(messages.isNotNull(), a).otherwise(chosen_list), F.when(messages.isNotNull(), b).otherwise(rejected_list)


def marker(text: str) -> list[int]:
    """A marker's ids under the code-point stand-in."""
    return [ord(c) + 16 for c in text]


def assistant_mask(ids: Column) -> Column:
    return tokens.span_mask(ids, marker(f"{BEGIN}assistant\n"), marker(f"{END}\n"))


def sft_example(df: DataFrame, messages: str, length: int) -> DataFrame:
    """Adds input_ids and labels of ``length``: only assistant spans are learned."""
    ids = df.withColumn("__ids", F.slice(tokens.code_points(render(F.col(messages))), 1, length)).select("*", T.held(assistant_mask(F.col("__ids"))).alias("__mask"))
    labels = tokens._fill(tokens.masked_labels(F.col("__ids"), F.col("__mask")), tokens.IGNORE, length)
    return ids.withColumns({"input_ids": tokens._fill(F.col("__ids"), tokens.PAD, length), "labels": labels}).drop("__ids", "__mask")
