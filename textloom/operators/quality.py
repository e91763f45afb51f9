"""Quality filter: an ordered chain of rules; a row's reason is the first that fails.

A metric that is missing or null counts as 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textloom.functions import text as T


@dataclass(frozen=True)
class Limits:
    """The thresholds of the rules."""

    min_length: int = 50
    max_length: int = 50_000
    min_lang_score: float = 0.5
    min_perplexity: float = 10
    max_perplexity: float = 5000
    max_char_rep: float = 0.3
    max_word_rep: float = 0.5
    max_special: float = 0.4
    min_alnum: float = 0.5
    max_flagged: float = 0.01


METRICS = ("lang_score", "perplexity", "char_rep_ratio", "word_rep_ratio", "special_char_ratio", "alnum_ratio", "flagged_words_ratio")


def reason(limits: Limits = Limits(), text: str = "text") -> Column:
    """The first rule a row fails, or ``passed``."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    of = {m: F.coalesce(F.col(m), F.lit(0)) for m in METRICS}
    return T.first_of(
        (size < limits.min_length, "too_short"),
        (size > limits.max_length, "too_long"),
        (of["lang_score"] < limits.min_lang_score, "low_lang_score"),
        (~of["perplexity"].between(limits.min_perplexity, limits.max_perplexity), "bad_perplexity"),
        (of["char_rep_ratio"] > limits.max_char_rep, "high_char_rep"),
        (of["word_rep_ratio"] > limits.max_word_rep, "high_word_rep"),
        (of["special_char_ratio"] > limits.max_special, "high_special_chars"),
        (of["alnum_ratio"] < limits.min_alnum, "low_alnum"),
        (of["flagged_words_ratio"] > limits.max_flagged, "high_flagged"),
        otherwise="passed",
    )


#: Words that count as flagged where a corpus brings no such ratio.
FLAGGED = ["idiot", "scum", "worthless", "pathetic", "disgusting", "clown"]


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the metrics for a corpus that has none: shares of characters and words of the text itself.

    ``lang_score`` is the share of letters, ``perplexity`` a stand-in from the length; both only serve to run the rules.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.nullif(F.length(t), F.lit(0))
    kept = lambda pattern: F.length(F.regexp_replace(t, pattern, "")) / n
    own = T.words(t)
    count = F.nullif(F.size(own), F.lit(0))
    return docs.withColumns({
        "lang_score": kept(r"[^\p{L}]"),
        "perplexity": (F.length(t) % 5600).cast("double"),
        "char_rep_ratio": F.greatest(*(T.count_of(t, c) for c in "aeint ")) / n,
        "word_rep_ratio": 1 - F.size(F.array_distinct(own)) / count,
        "special_char_ratio": kept(r"[\p{L}\p{N} \t\n\r]"),
        "alnum_ratio": kept(r"[^\p{L}\p{N}]"),
        "flagged_words_ratio": F.size(F.filter(own, lambda w: w.isin(FLAGGED))) / count,
        "num_words": F.size(own).cast("long"),
    })


def observed(df: DataFrame, name: str = "quality") -> DataFrame:
    """The rows, with counts of rows and of passed rows reported as the plan runs, in batch and in streams."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reason") == "passed").alias("passed"))


def counted(df: DataFrame, **figures: Column) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that holds the figures (aggregates by name) once an action has run over them."""
    found = Observation()
    return df.observe(found, *(c.alias(name) for name, c in figures.items())), found


METRICS_SQL = f"""
SELECT *, list_filter(string_split_regex(t, '[ \\t\\n\\r]+'), lambda w: w <> '') AS ws, nullif(length(t), 0) AS n FROM (SELECT *, coalesce(text, '') AS t FROM documents)
""", f"""
SELECT *,
  length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / n AS lang_score,
  CAST(length(t) % 5600 AS DOUBLE) AS perplexity,
  greatest({", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in "aeint ")}) / n AS char_rep_ratio,
  1 - len(list_distinct(ws)) / nullif(len(ws), 0) AS word_rep_ratio,
  length(regexp_replace(t, '[\\p{{L}}\\p{{N}} \\t\\n\\r]', '', 'g')) / n AS special_char_ratio,
  length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / n AS alnum_ratio,
  len(list_filter(ws, lambda w: w IN ({", ".join(f"'{w}'" for w in FLAGGED)}))) / nullif(len(ws), 0) AS flagged_words_ratio,
  CAST(len(ws) AS BIGINT) AS num_words
FROM split
"""

REASON_SQL = """CASE
  WHEN length(t) < 50 THEN 'too_short' WHEN length(t) > 50000 THEN 'too_long'
  WHEN coalesce(lang_score, 0) < 0.5 THEN 'low_lang_score'
  WHEN coalesce(perplexity, 0) < 10 OR coalesce(perplexity, 0) > 5000 THEN 'bad_perplexity'
  WHEN coalesce(char_rep_ratio, 0) > 0.3 THEN 'high_char_rep' WHEN coalesce(word_rep_ratio, 0) > 0.5 THEN 'high_word_rep'
  WHEN coalesce(special_char_ratio, 0) > 0.4 THEN 'high_special_chars' WHEN coalesce(alnum_ratio, 0) < 0.5 THEN 'low_alnum'
  WHEN coalesce(flagged_words_ratio, 0) > 0.01 THEN 'high_flagged' ELSE 'passed' END"""
