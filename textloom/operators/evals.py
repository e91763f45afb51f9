"""Evaluation and training-log aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

# Words that score an answer's persona; the words of its identity are the assistant's own names, a parameter.
WARMTH = ["~", "...", "别担心", "陪你", "嗯"]
DISCLAIMER = ["免责", "仅供参考", "建议咨询", "请咨询医生"]


def persona(names: list[str]) -> dict[str, list[str]]:
    """The criteria with their words."""
    return {"warmth": WARMTH, "identity": names, "disclaimer": DISCLAIMER}


def choice_of(answer: Column) -> Column:
    """The first of the letters A to D, or a question mark."""
    return F.coalesce(T.truthy(F.regexp_extract(answer, "[A-D]", 0)), F.lit("?"))


def choice_prompt(question: Column, options: Column) -> Column:
    """A question and its options, one a line, in the map's order."""
    return F.concat(question, F.lit("\n"), F.array_join(F.transform(F.map_entries(options), lambda e: F.concat(e.key, F.lit(". "), e.value)), "\n"))


def accuracy(df: DataFrame, right: Column, *keys: str) -> DataFrame:
    """(keys, correct, total, accuracy)."""
    correct = F.count_if(right)
    return df.groupBy(*keys).agg(correct.alias("correct"), F.count(F.lit(1)).alias("total"), (correct / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("accuracy"))


def winner(a: Column, b: Column, digits: int = 4) -> tuple[Column, Column]:
    """The better track, or ``tie``, and the rounded difference."""
    return F.when(a > b, "A").when(b > a, "B").otherwise("tie"), F.round(a - b, digits)


def thinking_flags(answer: Column) -> dict[str, Column]:
    """has_thinking, and structured: something of over ten characters follows the first closing tag."""
    has = F.contains(answer, F.lit("<thinking>")) & F.contains(answer, F.lit("</thinking>"))
    tail = T.strip(F.element_at(F.split(answer, "</thinking>", 2), -1))
    return {"has_thinking": has, "structured": has & (F.length(tail) > 10)}


def thinking_rates(answers: DataFrame, answer: str, *keys: str) -> DataFrame:
    """(keys, think_tag_rate, structured_rate, think_count, structured_count, total); no answers, null rates."""
    n, flags = F.count(F.lit(1)), thinking_flags(F.col(answer))
    counts = answers.groupBy(*keys).agg(F.count_if(flags["has_thinking"]).alias("think_count"), F.count_if(flags["structured"]).alias("structured_count"), n.alias("total"))
    rate = lambda c: F.col(c) / F.nullif(F.col("total"), F.lit(0))
    return counts.select(*keys, rate("think_count").alias("think_tag_rate"), rate("structured_count").alias("structured_rate"), "think_count", "structured_count", "total")


def comparison(accuracies: DataFrame, thinking: DataFrame, persona_table: DataFrame) -> DataFrame:
    """One row of two tracks' figures: ``mcq`` and ``thinking`` by track, ``personality`` by track and criterion, the better track and the difference."""
    by = lambda df, value: df.agg(F.map_from_entries(F.collect_list(F.struct(F.col("track"), value))).alias("m"))  # noqa: E731  a row for each track
    mcq = by(accuracies, F.struct("correct", "total", "accuracy"))
    flags = by(thinking, F.struct("think_tag_rate", "structured_rate", "total"))
    scores = by(persona_table.groupBy("track").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("criterion", "score")))).alias("s")), F.col("s"))
    one = mcq.select(F.col("m").alias("mcq")).crossJoin(flags.select(F.col("m").alias("thinking"))).crossJoin(scores.select(F.col("m").alias("personality")))  # one row each
    better, diff = winner(F.col("mcq")["A"].accuracy, F.col("mcq")["B"].accuracy)
    return one.select("*", better.alias("winner"), diff.alias("diff"))


def any_of(c: Column, pieces: list[str]) -> Column:
    out = F.lit(False)
    for p in pieces:
        out = out | F.contains(c, F.lit(p))
    return out


def persona_scores(answers: DataFrame, tracks: list[str], names: list[str]) -> DataFrame:
    """(track, criterion, score) over a table with an answer column for each track; one scan."""
    n = F.count(F.lit(1))
    scores = [F.struct(F.lit(t).alias("track"), F.lit(k).alias("criterion"), F.round(F.count_if(any_of(F.col(t), words)) / n, 3).alias("score")) for t in tracks for k, words in persona(names).items()]
    return answers.agg(F.array(*scores).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def compared(first: DataFrame, second: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, a, b): two tracks' answers to the same prompt; prompts that one of them lacks are left out."""
    return first.select(key, F.col(answer).alias("a")).join(second.select(key, F.col(answer).alias("b")), key)


def latency(df: DataFrame, seconds: str, generated: str, *keys: str) -> DataFrame:
    """Mean seconds, mean tokens, and tokens a second as the ratio of the means."""
    s, t = F.avg(seconds), F.avg(generated)
    rate = F.when(s > 0, t / s).otherwise(F.lit(0.0))
    return df.groupBy(*keys).agg(F.round(s, 3).alias("avg_latency_sec"), F.round(t, 1).alias("avg_tokens_generated"), F.round(rate, 1).alias("tokens_per_sec"))


def run_summary(log: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """Of each run: the least loss and its first step, the last loss that was logged and its step, and the perplexities."""
    logged = log.where(F.col(loss).isNotNull())
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col(step).alias("step")))
    last = F.max(F.struct(F.col(step).alias("step"), F.col(loss).alias("loss")))
    rows = logged.groupBy(run).agg(best.alias("b"), last.alias("l"))
    return rows.select(run, F.col("b.loss").alias("best_loss"), F.col("b.step").alias("best_step"), F.col("l.loss").alias("last_loss"), F.col("l.step").alias("last_step"), perplexity(F.col("b.loss")).alias("best_perplexity"))


def training_report(train: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One row from two logs, (step, loss, seconds) and (step, eval_loss): final step, hours, best and last losses; null for what was not logged."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("step", c)))[c]
    best = F.min(F.when(F.col("eval_loss").isNotNull(), F.struct("eval_loss", "step")))
    a = train.agg(F.max("step").alias("final_step"), F.round(F.max("seconds") / 3600, 2).alias("total_time_hours"), F.round(last("loss"), 6).alias("final_train_loss"))
    b = evaluated.agg(best.alias("best"), last("eval_loss").alias("last"))
    one = a.crossJoin(b)  # one row each
    return one.select("final_step", "total_time_hours", F.round("best.eval_loss", 6).alias("best_eval_loss"), F.col("best.step").alias("best_eval_step"), "final_train_loss", F.round("last", 6).alias("final_eval_loss"), F.round(perplexity(F.col("last")), 2).alias("final_eval_perplexity"))


def perplexity(loss: Column) -> Column:
    """e to the loss; infinite where it overflows."""
    return F.exp(loss)
