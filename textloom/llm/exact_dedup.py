"""Exact deduplication through an extendible-hash index kept on shared files.

The key space of 64-bit hashes is cut into equal ranges. Map tasks normalise texts and merge equal ones of their own rows; an owner task takes each range, in key order, and
fills an extendible-hash table: a directory of slots that doubles when a bucket with as many bits as the directory overflows, and buckets that split by one more bit. Texts
whose keys collide are chained and told apart by comparing bytes; once a key is past, its texts are dropped and the chain keeps their digests. The directory and the buckets are a
Parquet table in the shared folder.

Every document is then looked up in that table: the document's row goes to a task that reads its owner's directory and buckets first, takes the slot of its key, the bucket of the slot, and
the entry of its key and digest. An owner with more than twice the documents of the mean is looked up by several tasks, each with the owner's index and a share of its documents.

Memory of an owner is about 150 bytes for each distinct text of its range, and the texts of one key; ranges multiply with the input. A text that holds a third of all
rows reaches its owner as one row for each 32 MB of a map task, and its documents are looked up by many tasks.

Cases: null text counts as empty, empty texts are equal; the row with the smallest id stays; rows without id stay only where no row of their group has one, and of them ``drop_copies``
keeps one; rows that share id and text are judged alike by ``exact_groups``, and ``drop_copies`` keeps one of them; extra columns of any name do no harm; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.llm import work

#: Entries of a bucket before it splits.
CAPACITY = 64
#: Most bits of the directory; buckets beyond that chain on.
MOST_DEPTH = 24
#: Bytes of distinct texts that a map task holds before it sends them on.
FLUSH_BYTES = 32 << 20
#: Documents that a task looks up in one owner's index: the mean of all owners, and this many at least.
PROBE_ROWS = 256

WHITE = b" \t\n\v\f\r"
_NO_ID = np.iinfo(np.int64).max


def normalise(text: bytes) -> bytes:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space."""
    parts = text.split()
    if not parts:
        return text and b" "
    return b" " * (text[0] in WHITE) + b" ".join(parts) + b" " * (text[-1] in WHITE)


def least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Bucket:
    __slots__ = ("chains", "depth", "pattern", "size")

    def __init__(self, depth: int, pattern: int):
        self.depth, self.pattern, self.size = depth, pattern, 0
        self.chains: dict[int, list[list]] = {}


class ExtendibleIndex:
    """Maps texts to (digest, smallest id, rows); ``key`` decides the slot, bytes decide equality."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.depth = capacity, 0
        self.slots = [Bucket(0, 0)]

    def put(self, key: int, digest: str, text: bytes, keep_id: int | None, rows: int) -> bool:
        """Adds rows of a text; tells whether the text is new."""
        bucket = self.slots[key & (len(self.slots) - 1)]
        chain = bucket.chains.setdefault(key, [])
        for entry in chain:
            if entry[1] == text:
                entry[2], entry[3] = least(entry[2], keep_id), entry[3] + rows
                return False
        chain.append([digest, text, keep_id, rows])
        bucket.size += 1
        while bucket.size > self.capacity and bucket.depth < MOST_DEPTH and len(bucket.chains) > 1:
            bucket = self._split(bucket, key)
        return True

    def seal(self, key: int) -> None:
        """Drops the texts of a key that does not come again."""
        for entry in self.slots[key & (len(self.slots) - 1)].chains[key]:
            entry[1] = b""

    def _split(self, bucket: Bucket, key: int) -> Bucket:
        """Halves a bucket by its next bit, doubling the directory first if it has no such bit."""
        if bucket.depth == self.depth:
            self.slots += self.slots
            self.depth += 1
        bit = 1 << bucket.depth
        halves = Bucket(bucket.depth + 1, bucket.pattern), Bucket(bucket.depth + 1, bucket.pattern | bit)
        for k, chain in bucket.chains.items():
            half = halves[bool(k & bit)]
            half.chains[k] = chain
            half.size += len(chain)
        for i in range(bucket.pattern, len(self.slots), bit):
            self.slots[i] = halves[bool(i & bit)]
        return halves[bool(key & bit)]

    def buckets(self) -> Iterator[Bucket]:
        """Each bucket once."""
        return (b for i, b in enumerate(self.slots) if i == b.pattern)

    def entries(self) -> Iterator[tuple[Bucket, int, int, list]]:
        for b in self.buckets():
            for key, chain in b.chains.items():
                for place, entry in enumerate(chain):
                    yield b, key, place, entry


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _unsigned(key: int) -> int:
    return key & ((1 << 64) - 1)


_COMBINED = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("sha", pa.binary()), ("text", pa.binary()), ("keep_id", pa.int64()), ("rows", pa.int64())])
_COMBINED_DDL = "owner int, key long, sha binary, text binary, keep_id long, rows long"
#: A row for each bucket, and one with bucket -1 for the directory of an owner: its slots' buckets.
_INDEX = pa.schema([("owner", pa.int32()), ("bucket", pa.int64()), ("depth", pa.int32()), ("rows", pa.int64()), ("blob", pa.binary())])
_INDEX_DDL = "owner int, bucket long, depth int, rows long, blob binary"
#: An entry in a bucket's blob, in chain order.
_ENTRY = np.dtype([("key", "<u8"), ("sha", "u1", 32), ("keep", "<i8"), ("rows", "<i8")])


def _combine(n: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            index, held = ExtendibleIndex(), 0
            for part in work.pieces(parts):
                for doc_id, raw in zip(part.column(0).to_pylist(), work.utf8(part.column(1)), strict=True):
                    text = normalise(raw)
                    if index.put(xxhash.xxh3_64_intdigest(text), b"", text, doc_id, 1):
                        held += len(text) + 200
                    if held >= FLUSH_BYTES:
                        yield from flush(index)
                        index, held = ExtendibleIndex(), 0
            yield from flush(index)

        def flush(index):
            for _, key, _, (_, text, keep_id, count) in index.entries():
                yield key * n >> 64, _signed(key), hashlib.sha256(text).digest(), text, keep_id, count

        yield from work.batches(_COMBINED, rows())

    return run


def _packed(bucket: Bucket) -> tuple[bytes, int]:
    """A bucket's entries as bytes, and the rows they stand for."""
    own = [(key, np.frombuffer(e[0], np.uint8), _NO_ID if e[2] is None else e[2], e[3]) for key, chain in bucket.chains.items() for e in chain]
    return np.array(own, _ENTRY).tobytes(), sum(x[3] for x in own)


def _own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by owner and key to the owners' index."""

    def rows():
        owner, last, index = None, None, ExtendibleIndex()
        for part in work.pieces(parts):
            for at, key, sha, text, keep_id, count in zip(*(c.to_pylist() for c in part.columns), strict=True):
                key = _unsigned(key)
                if last is not None and (at, key) != (owner, last):
                    index.seal(last)
                if at != owner:
                    if owner is not None:
                        yield from stored(owner, index)
                    owner, index = at, ExtendibleIndex()
                index.put(key, sha, text, keep_id, count)
                last = key
        if owner is not None:
            yield from stored(owner, index)

    def stored(owner, index):
        yield owner, -1, index.depth, 0, np.array([b.pattern for b in index.slots], "<i8").tobytes()
        for b in index.buckets():
            blob, count = _packed(b)
            yield owner, b.pattern, b.depth, count, blob

    yield from work.batches(_INDEX, rows())


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index over all texts as a table in the shared folder, and the number of owners."""
    n = work.buckets(docs)
    own = work.spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), work.text_of(text_col).alias("text")))
    dealt = own.mapInArrow(_combine(n), _COMBINED_DDL).repartitionById(n, "owner").sortWithinPartitions("owner", "key")
    return work.keep(dealt.mapInArrow(_own, _INDEX_DDL), "exact-index")[0], n


class StoredIndex:
    """An owner's directory and buckets as they were read; buckets are unpacked when a key first meets them."""

    def __init__(self):
        self.slots: np.ndarray | None = None
        self.blobs: dict[int, bytes] = {}
        self.found: dict[int, dict[int, list]] = {}

    def load(self, bucket: int, blob: bytes) -> None:
        if bucket < 0:
            self.slots = np.frombuffer(blob, "<i8")
        else:
            self.blobs[bucket] = blob

    def get(self, key: int, sha: bytes) -> tuple[int | None, int]:
        """The smallest id and the number of rows of a text."""
        bucket = int(self.slots[key & (len(self.slots) - 1)])
        chains = self.found.get(bucket)
        if chains is None:
            chains = self.found[bucket] = {}
            for k, digest, keep, rows in np.frombuffer(self.blobs.pop(bucket), _ENTRY).tolist():
                chains.setdefault(k, []).append((bytes(digest), None if keep == _NO_ID else keep, rows))
        return next((keep, rows) for digest, keep, rows in chains[key] if digest == sha)


_KEYS = pa.schema([("doc_id", pa.int64()), ("owner", pa.int32()), ("key", pa.int64()), ("sha", pa.binary())])
_GROUPS = pa.schema([("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("kept", pa.bool_()), ("text_sha256", pa.string())])


def _keys(n: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in work.pieces(parts):
            texts = [normalise(x) for x in work.utf8(part.column(1))]
            keys = [xxhash.xxh3_64_intdigest(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k * n >> 64 for k in keys], pa.int32()), pa.array(map(_signed, keys), pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], schema=_KEYS)

    return run


def _probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by owner, its index before its documents: each document's entry."""

    def rows():
        owner, index = None, StoredIndex()
        for part in work.pieces(parts, 4096):
            for at, bucket, blob, doc_id, key, sha in zip(*(part.column(c).to_pylist() for c in ("owner", "bucket", "blob", "doc_id", "key", "sha")), strict=True):
                if at != owner:
                    owner, index = at, StoredIndex()
                if sha is None:
                    index.load(bucket, blob)
                else:
                    keep, count = index.get(_unsigned(key), sha)
                    yield doc_id, keep, count, doc_id == keep, sha.hex()

    yield from work.batches(_GROUPS, rows())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    index, n = build_index(docs, id_col, text_col)
    own = work.spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), work.text_of(text_col).alias("text")))
    share = max(PROBE_ROWS, (index.agg(F.sum("rows")).first()[0] or 0) // n)
    # owners that are looked up by several tasks: half of the owners at most
    hot = F.broadcast(index.groupBy("owner").agg(F.sum("rows").alias("all")).where(F.col("all") > 2 * share).select("owner", F.ceil(F.col("all") / share).cast("int").alias("tasks")))
    part = F.pmod(F.col("owner") + F.col("task") * 7919, F.lit(n)).cast("int").alias("part")
    tasks = F.coalesce("tasks", F.lit(1))
    asked = own.mapInArrow(_keys(n), "doc_id long, owner int, key long, sha binary").join(hot, "owner", "left").withColumn("task", F.pmod(F.monotonically_increasing_id(), tasks).cast("int"))
    asked = asked.select(part, "owner", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("blob"), "doc_id", "key", "sha")
    given = index.join(hot, "owner", "left").withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1)))
    given = given.select(part, "owner", "bucket", "blob", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("sha"))
    dealt = given.unionByName(asked).repartitionById(n, "part").sortWithinPartitions("owner", F.col("sha").isNotNull())
    return dealt.mapInArrow(_probe, "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")


def _name(sha: bytes, doc_id: int | None) -> str:
    return f"{sha.hex()}:{'' if doc_id is None else doc_id}"


def _staying(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The name, digest and id, of the row that stays of each entry."""
    for part in work.pieces(parts):
        names = [_name(bytes(sha), None if keep == _NO_ID else keep) for blob in part.column("blob").to_pylist() for _, sha, keep, _ in np.frombuffer(blob, _ENTRY).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])


def _named(text: str, name: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in work.pieces(parts):
            own = part.column(part.num_columns - 1).to_pylist()
            names = [_name(hashlib.sha256(normalise(x)).digest(), i) for i, x in zip(own, work.utf8(part.column(text)), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string())], names=[*part.schema.names[:-1], name])

    return run


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: of each group of equal texts one with the smallest id."""
    index, _ = build_index(docs, id_col, text_col)
    name = work.fresh(docs, "name")
    own = docs.withColumn(name, F.col(f"`{id_col}`").cast("long"))
    named = own.mapInArrow(_named(text_col, name), StructType([*docs.schema.fields, StructField(name, StringType())]))
    staying = index.where("bucket >= 0").mapInArrow(_staying, "name string").select(F.col("name").alias(name))
    kept = named.join(staying.hint("merge"), name, "left_semi")
    return kept.dropDuplicates([name]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
