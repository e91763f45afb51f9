"""Training arithmetic over small tensors in rows: losses, schedules, routing, sampling filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def learning_rate(step: Column, total: int, peak: float) -> Column:
    """Linear warm-up over a tenth of the steps, then a cosine down to a tenth of the peak."""
    warm = total * 0.1
    cosine = 0.1 + 0.45 * (1 + F.cos(math.pi * (step - warm) / (total - warm)))
    return F.when(step < warm, peak * (step / warm)).otherwise(peak * cosine)


def gathered(log_probs: Column, label: Column) -> Column:
    """The log-probability at a label's place; null for none."""
    return F.try_element_at(log_probs, label + 1)


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum of a sequence's values where the mask is 1."""
    return F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x)


def dpo_loss(policy_chosen: Column, ref_chosen: Column, policy_rejected: Column, ref_rejected: Column, beta: float = 0.1) -> Column:
    """-log sigmoid(beta * margin) of a pair."""
    margin = (policy_chosen - ref_chosen) - (policy_rejected - ref_rejected)
    return F.log1p(F.exp(-beta * margin))


def cross_entropy(df: DataFrame, log_prob: str, label: str, ignore: int = -100) -> DataFrame:
    """Mean negative log-probability of the labels that count."""
    return df.where(F.col(label) != ignore).agg((-F.avg(log_prob)).alias("loss"), F.count(F.lit(1)).alias("n"))


def nucleus(df: DataFrame, key: str, item: str, logit: str, top_p: float) -> DataFrame:
    """The items of each row set that nucleus sampling keeps: by falling probability, up to and with the one that passes ``top_p``."""
    own = Window.partitionBy(key)
    p = df.withColumn("__m", F.max(logit).over(own)).withColumn("__e", F.exp(F.col(logit) - F.col("__m"))).withColumn("p", F.col("__e") / F.sum("__e").over(own))
    down = own.orderBy(F.desc("p"), item).rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("before", F.sum("p").over(down) - F.col("p")).where(F.col("before") <= top_p).drop("__m", "__e", "before")


def top_logits(df: DataFrame, key: str, logit: str, k: int) -> DataFrame:
    """Items whose logit reaches the k-th largest; ties stay."""
    return df.withColumn("__r", F.rank().over(Window.partitionBy(key).orderBy(F.desc(logit)))).where(F.col("__r") <= k).drop("__r")


def routed(df: DataFrame, scores: str, k: int) -> DataFrame:
    """A row for each token and chosen expert: the k largest router probabilities, made to sum to one."""
    ranked = F.array_sort(F.transform(scores, lambda p, i: F.struct((-p).alias("neg"), i.alias("expert"))))
    top = df.withColumn("__top", F.slice(ranked, 1, k))
    total = F.aggregate("__top", F.lit(0.0), lambda a, e: a - e.neg)
    return top.withColumn("__sum", total).withColumn("__e", F.explode("__top")).select(*(c for c in df.columns), F.col("__e.expert").alias("expert"), (-F.col("__e.neg") / (F.col("__sum") + 1e-9)).alias("weight"))


def load_balance(df: DataFrame, routes: DataFrame, scores: str, experts: int, coefficient: float) -> DataFrame:
    """Sum over experts of load share times mean probability, times experts and coefficient."""
    load = routes.groupBy("expert").agg((F.count(F.lit(1))).alias("n"))
    load = load.crossJoin(F.broadcast(load.agg(F.sum("n").alias("all"))))  # one row
    mean = df.select(F.posexplode(scores).alias("expert", "p")).groupBy("expert").agg(F.avg("p").alias("mean"))
    return mean.join(load, "expert").agg((F.sum(F.col("n") / F.col("all") * F.col("mean")) * experts * coefficient).alias("aux_loss"))


def combined(routes: DataFrame, token: str, value: Column) -> DataFrame:
    """Each token's weighted sum of its experts' outputs."""
    return routes.groupBy(token).agg(F.sum(F.col("weight") * value).alias("combined"))


def token_plan(params: float, per_param: float, batch: int, length: int) -> tuple[int, int]:
    """Tokens to train on and steps for them."""
    tokens = int(params * per_param)
    return tokens, tokens // (batch * length)
