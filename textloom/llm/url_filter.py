"""URL filter: a rule list first, gradient-boosted trees on lexical features for the rest.

Features, all of them column expressions: lengths, path depth, digit ratio, character entropy, numbers of parameters, labels and hyphens, and
suffix statistics: the smoothed share of blocked URLs among all labelled ones whose last one or two host labels hash to the same of ``SUFFIX_BUCKETS`` buckets, a table of that many rows.
Trees are grown on the driver from about ``SAMPLE_ROWS`` distinct labelled URLs, drawn by a hash and weighted by the logarithm of their rows, and become one column expression: scoring runs
in generated code.

Labelled URLs are a table (url, blocked). Without one, the URLs that the rules decide are the labelled ones: the trees then carry the rules' verdicts over to URLs that look alike, and
know no more than that; ``held_out_accuracy`` tells how well they repeat labels that they have not seen.

Cases: a null url, or one without ``://``, has empty host and path and fits no rule; with no labelled URL, or labels of one kind only, the method gives
that kind (allow if none); ties between rules of one length go to the first; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import work

#: The contract's rules: (verdict, host suffix and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Distinct labelled URLs that the trees are grown on.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 24, 3, 0.3, 32, 20, 1.0
#: Buckets of the suffix statistics.
SUFFIX_BUCKETS = 1 << 14
#: Rows of the overall share that every bucket's share is smoothed with.
PRIOR = 8
#: Folds of labelled URLs.
FOLDS = 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """The longest rule that fits, else null."""
    out = F
    for _, rule in sorted(RULES if rules is None else rules, key=lambda r: -len(r[1])):
        suffix, slash, rest = rule.partition("/")
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(slash + rest)
        out = out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is F else out


def _entropy(text: Column) -> Column:
    """Bits a character of a text's own character distribution; 0 for the empty text."""
    n = F.length(text).cast("double")
    chars = F.array_distinct(F.split(text, ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(F.length(text) > 0, -F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc + share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def features(df: DataFrame) -> DataFrame:
    """Adds host, path, the buckets of its suffixes and ``f0``..: the lexical features of column ``url``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    df = df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    values = [
        F.length(url), F.length(host), F.length(path), _count(path, "/"), _count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)), _entropy(url), _entropy(host),
        F.when(query == "", F.lit(0)).otherwise(_count(query, "&") + 1), _count(host, "."), _count(host, "-"), F.locate("#", url).cast("boolean").cast("int"),
    ]
    suffixes = {f"suffix{k}": F.pmod(F.xxhash64(F.lit(k), F.substring_index(host, ".", -k)), F.lit(SUFFIX_BUCKETS)).cast("int") for k in (1, 2)}
    return df.withColumns({f"f{i}": v.cast("double") for i, v in enumerate(values)} | suffixes)


LEXICAL = 11


def fold_of(folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64("url", F.lit(6)), F.lit(folds)).cast("int")


def suffix_shares(labelled: DataFrame) -> tuple[DataFrame, float]:
    """(bucket, fold, share) of the labelled URLs (suffix1, suffix2, fold, blocked, n) by bucket of either suffix, and the overall share.

    A fold's row leaves the URLs of that fold out: with it the trees are grown, so that no URL sees its own label. Fold -1 leaves none out.
    """
    either = labelled.select(F.explode(F.array("suffix1", "suffix2")).alias("bucket"), "fold", F.col("blocked").cast("long").alias("b"), "n")
    counts, _ = work.keep(either.groupBy("bucket", "fold").agg(F.sum("n").alias("n"), F.sum(F.col("b") * F.col("n")).alias("b")), "url-suffixes")  # SUFFIX_BUCKETS * FOLDS rows at most
    every = counts.groupBy("bucket").agg(F.sum("n").alias("all"), F.sum("b").alias("bad"))
    total = every.agg(F.sum("all").alias("n"), F.sum("bad").alias("b")).first()
    base = (total.b + 1) / (total.n + 2) if total.n else 0.5
    share = lambda b, n: ((b + PRIOR * base) / (n + PRIOR)).alias("share")
    without = counts.join(F.broadcast(every), "bucket").select("bucket", "fold", share(F.col("bad") - F.col("b"), F.col("all") - F.col("n")))
    return without.unionByName(every.select("bucket", F.lit(-1).alias("fold"), share(F.col("bad"), F.col("all")))), base


def with_shares(df: DataFrame, shares: DataFrame, base: float, folds: bool = False) -> DataFrame:
    """Adds the features that come from the suffix statistics; with ``folds``, those without the URL's own fold."""
    for k in (1, 2):
        own = shares.select(F.col("bucket").alias(f"suffix{k}"), "fold", F.col("share").alias(f"__share{k}"))
        own = own if folds else own.where("fold = -1").drop("fold")
        df = df.join(F.broadcast(own), [f"suffix{k}", "fold"] if folds else f"suffix{k}", "left").withColumn(f"f{LEXICAL + k - 1}", F.coalesce(f"__share{k}", F.lit(base))).drop(f"__share{k}")
    return df


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, list]:
    """Boosted trees for logistic loss: the base score and nested (feature, cut, left, right) or leaf values."""
    weight = np.ones(len(y)) if weight is None else weight
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    p = min(max(float(np.average(y, weights=weight)), 1e-3), 1 - 1e-3)
    base = math.log(p / (1 - p))
    score, trees = np.full(len(y), base), []

    def node(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = float(-RATE * g / (h + RIDGE))
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * LEAST_ROWS:
            for j, c in enumerate(cuts):
                b = binned[rows, j]
                size = len(c) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = float(gain.max()), j, int(gain.argmax())
        if best[1] is None:
            score[rows] += leaf
            return leaf
        left = binned[rows, best[1]] <= best[2]
        return best[1], float(cuts[best[1]][best[2]]), node(rows[left], grad, hess, depth - 1), node(rows[~left], grad, hess, depth - 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(node(np.arange(len(y)), weight * (p - y), weight * p * (1 - p), DEPTH))
    return base, trees


def _column(tree, names: list[str]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    j, cut, left, right = tree
    return F.when(F.col(names[j]) <= cut, _column(left, names)).otherwise(_column(right, names))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """From (url, blocked): a function that adds ``score``, the share of trees' odds that a URL is to be blocked."""
    own = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()).groupBy("url", "blocked").agg(F.count(F.lit(1)).alias("n"))
    own, path = work.keep(own, "url-labels")
    counts = own.agg(F.count(F.lit(1)).alias("n"), F.min("blocked").alias("low"), F.max("blocked").alias("high")).first()
    if counts.low == counts.high:
        return lambda df: features(df).withColumn("score", F.lit(float(bool(counts.low))))
    draw = F.xxhash64("url", F.lit(3))
    least = math.ceil(min(1.0, 2 * sample_rows / counts.n) * (1 << 30))  # twice the sample pass the hash, so that what is sorted does not grow with the input
    drawn = own.where(F.pmod(F.xxhash64("url", F.lit(4)), F.lit(1 << 30)) < least).orderBy(draw, "url", "blocked").limit(sample_rows)
    shares, base_share = suffix_shares(features(own).select("suffix1", "suffix2", fold_of().alias("fold"), "blocked", "n"))
    names = [f"f{i}" for i in range(LEXICAL + 2)]
    rows = with_shares(features(drawn).withColumn("fold", fold_of()), shares, base_share, folds=True).select("url", "blocked", "n", *names).orderBy("url", "blocked").collect()
    y, n = (np.array([float(r[k]) for r in rows]) for k in (1, 2))
    base, trees = grow(np.array([r[3:] for r in rows], float), y, 1 + np.log2(n))

    def scored(df: DataFrame) -> DataFrame:
        total = sum((_column(t, names) for t in trees), F.lit(base))
        return with_shares(features(df), shares, base_share).withColumn("score", 1 / (1 + F.exp(-total)))

    return scored


def rule_labels(pages: DataFrame, rules=None) -> DataFrame:
    """(url, blocked) of the URLs that the rules decide."""
    rule = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    verdicts = F.create_map(*(F.lit(x) for v, r in (RULES if rules is None else rules) for x in (r, v)))
    return pages.select("url", rule.alias("rule")).where("rule IS NOT NULL").select("url", (F.try_element_at(verdicts, F.col("rule")) == "block").alias("blocked"))


def held_out_accuracy(labelled: DataFrame) -> tuple[float, float]:
    """The share of labelled URLs, a fold of them that the fit does not see, whose label the trees give; and the share of the more frequent label."""
    own = fold_of() == 0
    out = fit(labelled.where(~own))(labelled.where(own)).agg(F.avg(((F.col("score") >= 0.5) == F.col("blocked")).cast("int")).alias("a"), F.avg(F.col("blocked").cast("int")).alias("b")).first()
    return out.a, max(out.b, 1 - out.b)


def filter_urls(pages: DataFrame, rules=None, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score of every url."""
    own = work.spread(pages.select("page_id", "url"))
    scored = fit(rule_labels(own, rules) if labelled is None else labelled)(own).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F
    for v, r in RULES if rules is None else rules:
        verdict = verdict.when(F.col("rule") == r, F.lit(v))
    by_method = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    verdict = by_method if verdict is F else verdict.otherwise(by_method)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """The contract's query over ``pages``."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
