"""Lexical retrieval packing: BM25 neighbours fill the windows of seed documents.

Documents become byte-level BPE ids and an end id. What fills whole windows of a long document is cut off at once; the rest, one item a document,
goes to shards of lexical neighbours: items are ordered by the ids that a weighted MinHash draws first (ids of higher rank in the vocabulary are rarer and
weigh more), and runs of that order are shards. Two items draw the same first id with a chance of their weighted overlap, whatever the number of items;
runs of one first id that are too long for a shard part at the next ids, runs of copies at a hash. A shard holds an inverted index over its items' ids. Seed by seed it retrieves unused neighbours by BM25 score and
places them in the seed's window, a group of the next best at a time, whole ones first; the best of a group that no longer fit is cut, and what is left
of it stays in the index. Only where no unused item of the shard shares an id with the seed, the longest unused ones follow.
Windows are thus full. A shard's last, partial window is cut into pieces whose lengths are powers of two, which need no padding.

Inverse document frequencies and the mean length are of all documents; the vocabulary bounds their size.

The ids are those of ``tokenizers`` for the same vocabulary, without added special tokens; the faster library reads its rank file, and ``tokenizers`` itself takes the texts whose runs of white
space that library refuses.

Cases: null text counts as empty and packs its end id alone; documents without id are packed like others; repeated rows are packed once
each; extra columns are ignored; an empty table gives no piece. Nothing is dropped: each id lies in exactly one piece.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import work
from textloom.operators.sample import prefix_sum

WINDOW = 2048
END_ID = 1
VOCABULARY, WHOLE_VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: The special token that a text may spell out, and its id.
SPECIAL = {"<|endoftext|>": 50256}
N_IDS = 50_257
K1, B = 1.2, 0.75
#: Items of a shard, on the mean.
SHARD_ITEMS = 2_000
#: Shards that a task packs, one after the other, on the mean.
TASK_SHARDS = 16
#: Ids of a seed with the highest weights that query the index first; all its ids do where their neighbours do not fill the window.
QUERY_IDS = 12
#: Neighbours, next by score, that are tried whole before the window's rest goes to the best one's cut.
NEIGHBOURS = 24

_encoders: dict = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str):
    """The encoding of a rank file, once a process."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[path]


def whole_encoder(path: str):
    """The tokenizer of a JSON file, once a process."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        _encoders[path] = Tokenizer.from_file(path)
    return _encoders[path]


def encode(text: str, path: str, whole_path: str | None = None) -> np.ndarray:
    """A text's ids and the end id."""
    try:
        ids = encoder(path).encode_to_numpy(text, allowed_special="all", disallowed_special=())
    except ValueError:  # its pattern runs out of stack on very long runs of white space
        import public_tokenizers

        ids = whole_encoder(whole_path or public_tokenizers.path(WHOLE_VOCABULARY)).encode(text, add_special_tokens=False).ids
    return np.append(ids, END_ID).astype(np.uint16)


def _draws() -> np.ndarray:
    """Each id's exponential draw, by a fixed hash, at the rate of the root of its rank: of a set's ids the least is drawn first."""
    x = np.arange(1, N_IDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return -np.log(((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / np.sqrt(np.arange(1, N_IDS + 1))


DRAWS = _draws()


def shard_key(ids: np.ndarray) -> int:
    """The three ids that are drawn first, 16 bits each, above 15 bits that are free for ties."""
    own = np.unique(ids)
    first = [int(i) for i in own[np.argsort(DRAWS[own], kind="stable")[:3]]] + [0, 0]
    return first[0] << 47 | first[1] << 31 | first[2] << 15


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_CUT = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("key", pa.int64())])
_CUT_DDL = "kind string, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, key long"
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_OUT_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(path: str, window: int, whole_path: str | None = None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(N_IDS, np.int64)
        counts = [0, 0]

        def rows():
            for part in work.pieces(parts):
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    ids = encode(text, path, whole_path)
                    n = len(ids)
                    df[np.flatnonzero(np.bincount(ids, minlength=N_IDS)) if n > 4 * window else np.unique(ids)] += 1
                    counts[0] += 1
                    counts[1] += n
                    whole = n - n % window
                    for at in range(0, whole, window):
                        yield "full", doc_id, at, window, crc(ids[at : at + window]), n, None, None
                    if whole < n:
                        yield "rest", doc_id, whole, n - whole, None, n, ids[whole:].astype("<u2").tobytes(), shard_key(ids[whole:])
            if counts[0]:
                yield "stats", None, counts[0], counts[1], None, None, zstandard.compress(df.astype("<i8").tobytes(), 1), None

        yield from work.batches(_CUT, rows())

    return run


def _add_stats(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, ids, df = 0, 0, np.zeros(N_IDS, np.int64)
    for part in work.pieces(parts):
        for n, m, blob in zip(*(part.column(c).to_pylist() for c in ("start", "length", "ids")), strict=True):
            docs, ids = docs + n, ids + m
            df += np.frombuffer(zstandard.decompress(blob), "<i8")
    if docs:
        yield from work.batches(_CUT, [("stats", None, docs, ids, None, None, zstandard.compress(df.astype("<i8").tobytes(), 1), None)])


def corpus_stats(cut: DataFrame) -> tuple[int, float, np.ndarray]:
    """Documents, mean length, and each id's document frequency, added up in a tree of tasks."""
    stats = cut.where("kind = 'stats'")
    n = stats.count()
    while n > 16:
        n = math.ceil(n / 16)
        stats = stats.withColumn("part", F.pmod(F.xxhash64("ids", "length"), F.lit(n)).cast("int")).repartitionById(n, "part").drop("part").mapInArrow(_add_stats, _CUT_DDL)
    rows = stats.collect()  # at most 16, each bounded by the vocabulary
    docs = sum(r.start for r in rows)
    df = sum((np.frombuffer(zstandard.decompress(bytes(r.ids)), "<i8") for r in rows), np.zeros(N_IDS, np.int64))
    return docs, (sum(r.length for r in rows) / docs if docs else 1.0), df


class Shard:
    """An inverted index over items (id arrays)."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray, mean: float):
        self.items = items
        n = len(items)
        lengths = np.array([len(x) for x in items])
        owners = np.repeat(np.arange(n, dtype=np.int64), lengths)
        pairs, tf = np.unique(np.concatenate(items).astype(np.int64) * n + owners, return_counts=True)
        ids, self.docs = pairs // n, pairs % n
        self.weight = (idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.docs] / mean))).astype(np.float32)
        self.first = np.searchsorted(ids, np.arange(N_IDS + 1))
        self.idf = idf
        self.unused = np.ones(n, bool)

    def neighbours(self, item: int, most: int | None = QUERY_IDS) -> np.ndarray:
        """Unused items by falling score for the seed's ids of highest weight, or all its ids; those that share none of them are left out."""
        ids, tf = np.unique(self.items[item], return_counts=True)
        pay = self.idf[ids] * tf / (tf + K1)
        ids = ids[np.argsort(-pay, kind="stable")[:most]]
        scores = np.zeros(len(self.items), np.float32)
        for t in ids:
            part = slice(self.first[t], self.first[t + 1])
            scores[self.docs[part]] += self.weight[part]
        scores[~self.unused] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]

    def groups(self, item: int) -> Iterator[list[int]]:
        """The neighbours in groups by falling score: those by the ids of highest weight, then what is unused by all ids."""
        for most in (QUERY_IDS, None):
            near = self.neighbours(item, most).tolist()
            for k in range(0, len(near), NEIGHBOURS):
                yield near[k : k + NEIGHBOURS]


def fill(items: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start in it, length); every sequence is full or a power of two long."""
    shard = Shard(items, idf, mean)
    start = [0] * len(items)
    left = [len(x) for x in items]
    order = sorted(range(len(items)), key=lambda i: (-left[i], i))
    at = 0

    def take(i: int, room: int) -> tuple[int, int, int]:
        n = min(left[i], room)
        piece = i, start[i], n
        start[i] += n
        left[i] -= n
        shard.unused[i] = left[i] > 0
        return piece

    while True:
        while at < len(order) and not left[order[at]]:
            at += 1
        if at == len(order):
            return
        seed = order[at]
        pieces = [take(seed, window)]
        room = window - pieces[0][2]
        if room:
            for near in shard.groups(seed):
                for i in near:
                    if room and left[i] <= room:
                        pieces.append(take(i, room))
                        room -= pieces[-1][2]
                rest = [i for i in near if left[i]]
                if room and rest:
                    pieces.append(take(rest[0], room))
                    room -= pieces[-1][2]
                if not room:
                    break
            k = at
            while room:
                while k < len(order) and not left[order[k]]:
                    k += 1
                if k == len(order):
                    break
                pieces.append(take(order[k], room))
                room -= pieces[-1][2]
        if not room:
            yield pieces
            continue
        yield from powers(pieces, window - room)


def powers(pieces: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a partial window, cut into sequences whose lengths are powers of two."""
    room, own = 1 << (total.bit_length() - 1), []
    for i, at, n in pieces:
        while n:
            m = min(n, room)
            own.append((i, at, m))
            at, n, room, total = at + m, n - m, room - m, total - m
            if not room:
                yield own
                own, room = [], 1 << (total.bit_length() - 1) if total else 0


def _pack(idf, mean: float, window: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids", "shard")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        items = [np.frombuffer(r[3], "<u2") for r in rows]
        out = []
        for k, pieces in enumerate(fill(items, idf.value, mean, window)):
            offset = 0
            for i, at, n in pieces:
                doc_id, start, tokens, _, shard = rows[i]
                out.append((doc_id, start + at, n, crc(items[i][at : at + n]), tokens, (shard << 24 | k) << 1, offset))
                offset += n
        return pa.Table.from_batches(work.batches(_OUT, out), _OUT)

    return run


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, whole_path: str | None = None) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    own = work.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), work.text_of()))
    cut, _ = work.keep(own.mapInArrow(_cut(path or vocabulary_path(), window, whole_path), _CUT_DDL).withColumn("row", F.monotonically_increasing_id()), "pack-cut")
    n, mean, df = corpus_stats(cut)
    idf = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))
    rest = cut.where("kind = 'rest'")
    items = rest.count()
    shards = max(1, round(items / SHARD_ITEMS))
    order = rest.select("row", "doc_id", "start", F.xxhash64("doc_id", "ids").alias("h"), "key", F.lit(1).cast("long").alias("one"))
    order = order.withColumn("key", F.col("key") + F.pmod("h", F.lit(1 << 15)))
    place = prefix_sum(order, "key", "one", "place", ["doc_id", "start", "h", "row"])
    shard = place.select("row", F.floor((F.col("place") - 1) * shards / items).cast("long").alias("shard"))
    rest = rest.select("row", "doc_id", "start", "doc_tokens", "ids").join(shard.hint("merge"), "row").drop("row")
    tasks = max(work.buckets(docs), shards // TASK_SHARDS)
    packed = rest.repartition(tasks, "shard").groupBy("shard").applyInArrow(_pack(idf, mean, window), _OUT_DDL)
    full = cut.where("kind = 'full'").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
