"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams tells the languages that have the
bit from those that have not; its margin is the mean log-odds of a text's n-grams. Decoding takes the language whose codeword has the
least loss, each bit's exponential loss weighted by how well that bit's classifier does on that language, and a text whose two best
languages are close is flagged as ambiguous.

The classifiers are fitted on the driver from a bounded sample, drawn by a hash of id and text: of the ``MOST_LANGS`` languages with the most documents, at most ``SAMPLE_DOCS`` documents
each, of at most ``LONGEST`` bytes each and about ``SAMPLE_BYTES`` together. Every text is judged whole.

Cases: a text that is null or has no letter is ``und`` with score 0; if no language can be learned every text is ``und``, if one, every text with a letter
has it; rows with a null language are judged but not learned from; rows without id are not learned from and not held out; repeated rows give repeated rows, and are learned from once;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import work

#: Documents of a language that the classifiers are fitted on.
SAMPLE_DOCS = 300
#: Bytes of a document that is learned from, and of a language's documents, after which no more are drawn.
LONGEST, SAMPLE_BYTES = 256 << 10, 2 << 20
#: Languages that are learned, those with the most documents first.
MOST_LANGS = 100
FOLDS = 5
BITS = 16
ORDERS = (2, 3, 4)
SMOOTH = 0.5
#: Decoding losses closer than this share of the smaller one are ambiguous.
AMBIGUOUS = 0.1
#: The filter rejects a text whose least loss is over this and over that of every document learned from: with no evidence at all each loss is 1.
MOST_LOSS = 0.9
UND = "und"

_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Bucket numbers of a text's byte n-grams, an order to a row; shorter texts are padded with blanks."""
    data = b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b"   "
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(a) - 3
    h2 = a[:-1] << np.uint32(8) | a[1:]
    h3 = (h2[:-1] << np.uint32(8) | a[2:]) * np.uint32(0x9E3779B1)
    h4 = (h2[:-2] << np.uint32(16) | h2[2:]) * np.uint32(0x85EBCA6B)
    shift = np.uint32(32 - BITS)
    return np.stack([h2[:n], h3[:n] >> shift, h4[:n] >> shift])


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1: every way to part up to five languages, else the best of many random codes by its least distance."""
    if k <= 5:
        cols = [[1 if i == 0 or not c >> (i - 1) & 1 else -1 for i in range(k)] for c in range(1, 1 << max(0, k - 1))]
        return np.array(cols, np.float32).T.reshape(k, -1)
    rng, best, width = np.random.default_rng(seed), None, max(15, math.ceil(10 * math.log2(k)))
    for _ in range(200):
        code = rng.choice([-1, 1], (k, width)).astype(np.float32)
        code = code[:, np.abs(code.sum(0)) < k]
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(k) * width).min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # order x bucket x bit
    scale: np.ndarray  # bit
    share: np.ndarray  # language x bit
    bound: float = MOST_LOSS

    def margins(self, text: str) -> np.ndarray:
        found = grams(text)
        return sum(w[g].mean(0, dtype=np.float64) for w, g in zip(self.weights, found, strict=True))

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Each language's loss."""
        return (self.share * np.exp(-self.code * np.clip(margins / self.scale, -4, 4))).sum(1)

    def accepts(self, text: str | None) -> bool:
        """Whether a text has a letter and, where several languages are known, looks like one of them."""
        if not text or not any(map(str.isalpha, text)):
            return False
        return len(self.langs) < 2 or float(self.losses(self.margins(text)).min()) <= self.bound

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, ambiguity."""
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = self.losses(margins)
        order = np.argsort(loss, kind="stable")
        p = 1 / loss
        return self.langs[order[0]], float(p[order[0]] / p.sum()), bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS * loss[order[0]])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UND, 0.0, False
        return self.decode(self.margins(text))


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (language, text) rows."""
    rows = [(lang, t) for lang, t in sorted(rows) if t and any(map(str.isalpha, t))]
    langs = sorted({lang for lang, _ in rows})
    code = codewords(len(langs)) if langs else np.zeros((0, 0), np.float32)
    counts = np.zeros((len(ORDERS), len(langs), 1 << BITS))
    for lang, t in rows:
        for o, g in enumerate(grams(t)):
            counts[o, langs.index(lang)] += np.bincount(g, minlength=1 << BITS)
    shares = counts / np.maximum(counts.sum(2, keepdims=True), 1)  # languages count alike, however much text each has
    floor = SMOOTH / np.maximum(counts.sum(2).max(1, initial=0), 1)
    weights = np.zeros((len(ORDERS), 1 << BITS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        yes, no = code[:, b] > 0, code[:, b] < 0
        weights[:, :, b] = np.log((shares[:, yes].mean(1) + floor[:, None]) / (shares[:, no].mean(1) + floor[:, None]))
    model = Model(langs, code, weights, np.ones(code.shape[1]), np.ones(code.shape))
    if code.shape[1]:
        margins = np.array([model.margins(t) for _, t in rows])
        own = np.array([code[langs.index(lang)] for lang, _ in rows])
        model.scale = np.maximum(np.median(np.abs(margins), 0), 1e-6)
        right = (np.sign(margins) == own).astype(float)
        accuracy = np.array([right[[lang == x for x, _ in rows]].mean(0) for lang in langs])
        model.share = (accuracy + 1e-3) / (accuracy + 1e-3).sum(1, keepdims=True)
        model.bound = max([MOST_LOSS, *(float(model.losses(m).min()) for m in margins)])
    return model


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits a model on the rows that are not held out."""
    usable = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.octet_length("text").between(1, LONGEST) & ~held_out()
    rows = work.spread(docs.select("doc_id", "lang", "text")).where(usable).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # a hash keeps about three times the sample of each language, so that what is ranked does not grow with the input
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    if not counts:
        return fit([])
    least = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, math.ceil(min(1.0, 3 * sample_docs / n) * (1 << 30)))))
    near = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.try_element_at(least, F.col("lang")))
    near = near.select("lang", "h", F.octet_length("text").alias("size")).distinct()  # a row that is repeated counts once
    drawn = Window.partitionBy("lang").orderBy("h")
    ranked = near.select("lang", "h", F.row_number().over(drawn).alias("place"), (F.sum("size").over(drawn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    chosen = [r.h for r in ranked.where((F.col("place") <= sample_docs) & (F.col("before") < SAMPLE_BYTES)).select("h").collect()]  # at most sample_docs for each language
    found = rows.where(F.col("h").isin(chosen)).dropDuplicates(["lang", "h"]).select("lang", "text").collect() if chosen else []
    return fit([(r.lang, r.text) for r in found])


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # the languages bound its size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in work.pieces(parts):
            ids, held, texts = (c.to_pylist() for c in part.columns)
            yield from work.batches(_OUT, ((i, h, *shared.value.predict(t)) for i, h, t in zip(ids, held, texts, strict=True)))

    own = work.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents in a learned language, with all their columns.

    Those without a letter go, and those that look like none of the learned languages: whose least loss says that the classifiers found next to nothing in them. Texts that mix learned languages
    stay. Where fewer than two languages could be learned, all with a letter stay. The rows themselves pass through, so repeated or missing ids do no harm.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs))  # the languages bound its size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in work.pieces(parts):
            yield part.filter(pa.array([shared.value.accepts(t) for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
