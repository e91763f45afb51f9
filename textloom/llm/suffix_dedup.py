"""Removal of repeated byte strings by suffix sorting with bucket-pointer refinement.

Every byte that a string of ``LENGTH`` bytes covers goes if that string also starts earlier. All such strings cannot meet in one
suffix array, so they are dealt out by content first:

1. Of the grams in a string of ``LENGTH`` bytes, the one with the least hash is its anchor. Neighbouring strings mostly share it: a run is a maximal row of
   starts with one anchor. Equal strings have equal anchors, so strings whose anchor occurs once are unique.
2. The anchors' hashes are counted, a task's own repeats before the exchange. Runs whose anchor occurs again go on.
3. The bytes under those runs go to shards by anchor. Equal segments of a task are merged before the exchange, of a shard after it: all but the
   first are repeats as a whole.
4. A shard sorts the suffixes of its distinct segments by bucket-pointer refinement, to the depth ``LENGTH``: buckets of the first 8 bytes, refined by sorting on the
   buckets of later offsets, 8, 16, 32 and 36 on, each round reusing the last one's updates. Starts in one bucket are equal strings, compared in full.
   An anchor of more than ``HOT_RUNS`` runs (a passage that very many documents share, each in its own context) would gather them in one shard: its runs are dealt as single
   strings instead, by a hash of all their bytes. At most ``MOST_HOT`` anchors are treated so; beyond that the number of runs is raised.
5. All starts of a bucket but the first in order are repeats; their bytes are removed document by document.

Order: by id, then by start. Cases: null text counts as empty; texts shorter than ``LENGTH`` lose nothing; rows without id come last; of rows that share an id and differ in text
the order is that of a hash of the text; rows that share id and text are one document and get the same result each; extra columns are ignored; nothing is capped.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import shingles, work

LENGTH = 100
#: Bytes of a gram; a string of LENGTH bytes has LENGTH - GRAM + 1 of them.
GRAM = 32
#: Bytes of text that a task turns to runs at once, about 80 times that in memory; positions in it take 24 bits of a packed number.
FLUSH_BYTES = 3 << 19
_PLACE = np.uint64((1 << 24) - 1)
#: Bytes of distinct segments that are sorted at once; segments of one anchor stay together.
SORT_BYTES = 2 << 20
#: Compression of packed rows, the library's own default.
LEVEL = 3
#: Runs of an anchor from which they are dealt as single strings, and the bytes of the list of such anchors that goes to the tasks.
HOT_RUNS = 10_000
MOST_HOT = 1_000_000
NO_ID = np.iinfo(np.int64).max

_BLOB = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("blob", pa.binary())])
_BLOB_DDL = "kind string, bucket int, blob binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

#: A run: anchor hash, id, text hash, start, number of starts.
RUN = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("tag", "<u8"), ("start", "<u4"), ("n", "<u4")])


def dump(*parts) -> bytes:
    return zstandard.compress(pickle.dumps(parts, 5), LEVEL)


def load(blob: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(blob))


def shard_of(anchors: np.ndarray, n: int) -> np.ndarray:
    """Anchors are least hashes, so small ones are the most: they are mixed again."""
    return ((shingles.mix(anchors) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def bucket_of(docs: np.ndarray, tags: np.ndarray, n: int) -> np.ndarray:
    """A document's bucket, by its id and its text's hash: documents that share an id, or have none, are dealt out too."""
    return shard_of(shingles.mix(docs.astype(np.int64).view(np.uint64)) ^ tags.astype(np.uint64), n)


def chunks(docs: list[tuple[int, int, bytes]], size: int = FLUSH_BYTES, length: int = LENGTH) -> Iterator[list[tuple[int, int, bytes, int]]]:
    """Documents in lists of about ``size`` bytes, with the place where each piece begins; longer ones in pieces that share no start of a string."""
    held, total = [], 0
    for doc, tag, text in docs:
        for at in range(0, max(1, len(text) - length + 1), size):
            piece = text[at : at + size + length - 1]
            if held and total + len(piece) > size + length:
                yield held
                held, total = [], 0
            held.append((doc, tag, piece, at))
            total += len(piece)
    if held:
        yield held


def runs_of(docs: list[tuple[int, int, bytes, int]], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The runs of pieces of documents (id, text hash, bytes, place in the text) that hold less than 16 MB together."""
    docs = [d for d in docs if len(d[2]) >= length]
    if not docs:
        return np.zeros(0, RUN)
    data = np.frombuffer(b"".join(d[2] for d in docs), np.uint8)
    sizes = np.array([len(d[2]) for d in docs])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shingles._BYTES[data] * shingles.powers(shingles._BASE, len(data)), dtype=np.uint64)))
    h = shingles.mix((total[gram:] - total[:-gram]) * shingles.powers(shingles._INVERSE, len(data))[: len(data) - gram + 1])
    # the leftmost least hash of every window: hash bits above, place below; equal windows choose alike, whatever they stand in
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: -(width - step)], least[width - step :])
    anchor = (least & _PLACE).astype(np.int64)
    first = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    valid = np.zeros(len(anchor) + 1, np.int8)
    valid[begin] += 1
    np.add.at(valid, begin + sizes - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    first[begin] = True
    starts = np.flatnonzero(first & valid)
    ends = np.append(np.flatnonzero(first | ~valid), len(anchor))
    ends = ends[np.searchsorted(ends, starts, "right")]
    own = np.searchsorted(begin, starts, "right") - 1
    out = np.zeros(len(starts), RUN)
    out["anchor"] = h[anchor[starts]]
    out["doc"] = np.array([d[0] for d in docs], np.int64)[own]
    out["tag"] = np.array([d[1] for d in docs], np.uint64)[own]
    out["start"] = starts - begin[own] + np.array([d[3] for d in docs], np.int64)[own]
    out["n"] = ends - starts
    return out


def _batched(parts: Iterator[pa.RecordBatch], flush: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Documents by about ``flush`` bytes; a longer one is a batch of its own."""
    held, size = [], 0
    for part in work.pieces(parts):
        for doc_id, text in zip(part.column(0).to_pylist(), work.utf8(part.column(1)), strict=True):
            if held and size + len(text) > flush:
                yield held
                held, size = [], 0
            held.append((NO_ID if doc_id is None else doc_id, xxhash.xxh3_64_intdigest(text), text))
            size += len(text)
    if held:
        yield held


def _split(kind: str, rows: np.ndarray, place: np.ndarray) -> Iterator[tuple[str, int, bytes]]:
    """Rows by their bucket, packed."""
    if not len(place):
        return
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    for a, b in zip(cuts, [*cuts[1:], len(place)], strict=True):
        yield kind, int(place[a]), dump(*(rows[name][a:b].copy() for name in rows.dtype.names))


def _rows(parts: tuple, dtype=RUN) -> np.ndarray:
    out = np.zeros(len(parts[0]), dtype)
    for name, values in zip(dtype.names, parts, strict=True):
        out[name] = values
    return out


def _anchors(n: int, flush: int):
    """Runs of each batch of documents. One whose anchor the batch repeats is known to go on (``known``, by document); its anchor is told once with the number (``told``), others are asked about (``once``), by anchor."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for docs in _batched(parts, flush):
                own = {(d[0], d[1]): d for d in docs}
                found = np.concatenate([np.zeros(0, RUN), *(runs_of(part) for part in chunks(list(own.values()), flush))])
                if not len(found):
                    continue
                _, at, back, count = np.unique(found["anchor"], return_index=True, return_inverse=True, return_counts=True)
                again = count[back] > 1
                known, once, told = found[again], found[~again], found[at[count > 1]]
                told["n"] = count[count > 1]
                yield from _split("known", known, bucket_of(known["doc"], known["tag"], n))
                yield from _split("once", once, shard_of(once["anchor"], n))
                yield from _split("told", told, shard_of(told["anchor"], n))

        yield from work.batches(_BLOB, rows())

    return run


def _repeated(n: int, hot: int):
    """Of the runs asked about, those whose anchor came twice, by document; and the anchors of more than ``hot`` runs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            once, told = [], []
            for part in work.pieces(parts):
                for kind, bucket, blob in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if kind == "known":
                        yield "runs", bucket, blob
                    else:
                        (told if kind == "told" else once).append(_rows(load(blob)))
            asked, told = (np.concatenate([np.zeros(0, RUN), *x]) for x in (once, told))
            anchors, back = np.unique(np.concatenate((asked["anchor"], told["anchor"])), return_inverse=True)
            counts = np.bincount(back, np.concatenate((np.ones(len(asked)), told["n"])), len(anchors)).astype(np.int64)
            if (counts > hot).any():
                yield "hot", 0, dump(anchors[counts > hot], counts[counts > hot])
            told = np.unique(told["anchor"])
            order = np.argsort(asked["anchor"], kind="stable")
            asked = asked[order]
            a = asked["anchor"]
            same = a[1:] == a[:-1]
            again = (np.concatenate((same, [False])) | np.concatenate(([False], same)))[: len(a)]
            again |= np.isin(a, told)
            asked = asked[again]
            yield from _split("runs", asked, bucket_of(asked["doc"], asked["tag"], n))

        yield from work.batches(_BLOB, rows())

    return run


def _over(least: int):
    """Of the packed hot anchors, those of more than ``least`` runs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in work.pieces(parts):
                for blob in part.column("blob").to_pylist():
                    anchors, counts = load(blob)
                    if (counts > least).any():
                        yield "hot", 0, dump(anchors[counts > least], counts[counts > least])

        yield from work.batches(_BLOB, rows())

    return run


def hot_anchors(runs: DataFrame, least: int, most: int = MOST_HOT) -> np.ndarray:
    """The anchors of more than ``least`` runs, or of more than so many times 4, 16, .. that their list is small."""
    found = runs.where("kind = 'hot'")
    while (found.agg(F.sum(F.octet_length("blob"))).first()[0] or 0) > 8 * most:
        least *= 4
        found = runs.where("kind = 'hot'").mapInArrow(_over(least), _BLOB_DDL)
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(load(bytes(r.blob))[0] for r in found.select("blob").collect())]))


def _texts(n: int, flush: int):
    """Documents by bucket, packed; those of a batch that share id and text once, with their number."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for docs in _batched(parts, flush):
                times: dict[tuple[int, int], list] = {}
                for doc, tag, text in docs:
                    times.setdefault((doc, tag), [text, 0])[1] += 1
                place = bucket_of(np.array([d for d, _ in times], np.int64), np.array([t for _, t in times], np.uint64), n)
                own = [(*key, *x) for key, x in times.items()]
                for b in np.unique(place):
                    yield "texts", int(b), dump([own[i] for i in np.flatnonzero(place == b)])

        yield from work.batches(_BLOB, rows())

    return run


def _collected(parts: Iterator[pa.RecordBatch]) -> dict[str, list[bytes]]:
    found: dict[str, list[bytes]] = {}
    for part in work.pieces(parts):
        for kind, _, blob in zip(*(c.to_pylist() for c in part.columns), strict=True):
            found.setdefault(kind, []).append(blob)
    return found


def single(runs: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs with those of ``which`` taken apart into their strings; these have the anchor 0 for now."""
    part = runs[which]
    size = part["n"].astype(np.int64)
    out = np.repeat(part, size)
    out["start"] += (np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint32)
    out["n"], out["anchor"] = 1, 0
    return np.concatenate((runs[~which], out))


def _segments(n: int, shared):
    """A bucket's documents and runs: segments by anchor, what the bucket itself repeats, and the documents that may lose bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            found = _collected(parts)
            by_bucket: dict[int, list] = {}
            docs: dict[tuple[int, int], list] = {}
            for blob in found.pop("texts", []):
                for doc, tag, text, times in load(blob)[0]:
                    docs.setdefault((doc, tag), [text, 0])[1] += times
            runs = np.concatenate([np.zeros(0, RUN), *(_rows(load(b)) for b in found.pop("runs", []))])
            runs = single(runs, np.isin(runs["anchor"], shared.value))
            runs = runs[np.lexsort((runs["start"], runs["tag"], runs["doc"]))]
            runs = runs[np.concatenate(([True], runs[1:] != runs[:-1]))[: len(runs)]]  # of rows that share id and text
            seen: set[bytes] = set()
            first: list[int] = []
            segments: list[bytes] = []
            repeat = np.zeros(len(runs), bool)
            touched = set()
            for i, (anchor, doc, tag, start, size) in enumerate(runs.tolist()):
                segment = docs[doc, tag][0][start : start + size + LENGTH - 1]
                if not anchor:
                    runs["anchor"][i] = xxhash.xxh3_64_intdigest(segment)
                touched.add((doc, tag))
                if segment in seen:
                    repeat[i] = True
                else:
                    seen.add(segment)
                    first.append(i)
                    segments.append(segment)
            del seen
            own = runs[first]
            shard = shard_of(own["anchor"], n)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)] if len(cuts) else [], strict=True):
                at = order[a:b]
                yield "segments", int(shard[at[0]]), dump(own[at], b"".join(segments[i] for i in at))
            gone = runs[repeat]
            yield from _split("gone", gone, bucket_of(gone["doc"], gone["tag"], n))
            for (doc, tag), (text, times) in docs.items():
                b = int(bucket_of(np.array([doc]), np.array([tag], np.uint64), n)[0])
                may = (doc, tag) in touched
                by_bucket.setdefault(b, []).append((doc, tag, times, len(text), text if may else hashlib.sha256(text).hexdigest(), may))
            for b, own_docs in by_bucket.items():
                yield "docs", b, dump(own_docs)

        yield from work.batches(_BLOB, rows())

    return run


def refine(data: np.ndarray, depth: int = LENGTH, q: int = 8) -> np.ndarray:
    """Bucket pointers of all positions: equal where the next ``depth`` bytes are; their order is that of the suffixes to that depth.

    A position's pointer is the first place of its bucket in sorted order. Positions alone in their bucket are done.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(q, np.uint8))).astype(np.uint64)
    key = padded[:n].copy()
    for j in range(1, q):
        key = key << np.uint64(8) | padded[j : n + j]
    slots = np.arange(n, dtype=np.int64)
    at = np.argsort(key, kind="stable")
    key = key[at]
    pointer = np.zeros(n + 1, np.int64)
    pointer[n] = n
    done = q
    while True:
        first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        ids = np.maximum.accumulate(np.where(first, slots, 0)) if len(key) else slots
        pointer[at] = ids
        if done == depth:
            return pointer[:n]
        alone = first & np.concatenate((first[1:], [True])) if len(first) else first
        at, slots, ids = at[~alone], slots[~alone], ids[~alone]
        step = min(done, depth - done)
        key = ids * (n + 1) + pointer[np.minimum(at + step, n)]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        done += step


def repeats(runs: np.ndarray, segments: list[bytes]) -> np.ndarray:
    """Of distinct segments in (doc, tag, start) order: the runs of starts whose string starts earlier in one of them."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = runs["n"].astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + LENGTH - 1)[:-1]))
    pointer = refine(data)
    owner = np.repeat(np.arange(len(runs)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bucket = pointer[begin[owner] + offset]
    order = np.argsort(bucket, kind="stable")  # starts are in document order already
    sorted_bucket = bucket[order]
    again = np.zeros(len(order), bool)
    again[order[1:]] = sorted_bucket[1:] == sorted_bucket[:-1]
    edge = again & ~np.concatenate(([False], again[:-1] & (owner[1:] == owner[:-1])))
    starts = np.flatnonzero(edge)
    stop = np.append(np.flatnonzero(edge | ~again), len(again))
    stop = stop[np.searchsorted(stop, starts, "right")]
    out = runs[owner[starts]].copy()
    out["start"] += offset[starts].astype(np.uint32)
    out["n"] = stop - starts
    return out


def _sorted(n: int, most: int):
    """A shard's segments: the runs that start earlier, by document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            runs, pieces = [], []
            for blob in _collected(parts).get("segments", []):
                own, data = load(blob)
                ends = np.cumsum(own["n"].astype(np.int64) + LENGTH - 1)
                runs.append(own)
                pieces += [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            if not runs:
                return
            table = np.concatenate(runs)
            order = np.lexsort((table["start"], table["tag"], table["doc"], table["anchor"]))
            table = table[order]
            seen: set[bytes] = set()
            held: list[int] = []
            texts: list[bytes] = []
            size, repeat = 0, np.zeros(len(table), bool)
            last = None
            for i, (anchor, at) in enumerate(zip(table["anchor"].tolist(), order.tolist(), strict=True)):
                if anchor != last:
                    if size > most:
                        yield from emit(table[held], texts)
                        held, texts, size = [], [], 0
                    last, seen = anchor, set()
                segment = pieces[at]
                if segment in seen:
                    repeat[i] = True
                    continue
                seen.add(segment)
                held.append(i)
                texts.append(segment)
                size += len(segment)
            yield from emit(table[held], texts)
            gone = table[repeat]
            yield from _split("gone", gone, bucket_of(gone["doc"], gone["tag"], n))

        def emit(runs, texts):
            if len(texts) > 1:
                order = np.lexsort((runs["start"], runs["tag"], runs["doc"]))
                gone = repeats(runs[order], [texts[i] for i in order])
                yield from _split("gone", gone, bucket_of(gone["doc"], gone["tag"], n))

        yield from work.batches(_BLOB, rows())

    return run


def removed(size: int, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal spans that (start, number of starts) cover."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(gone):
        stop = start + n + LENGTH - 1
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        else:
            out.append((start, stop))
    return out


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        found = _collected(parts)
        gone: dict[tuple[int, int], list] = {}
        for blob in found.pop("gone", []):
            for _, doc, tag, start, n in _rows(load(blob)).tolist():
                gone.setdefault((doc, tag), []).append((start, n))
        for blob in found.pop("docs", []):
            for doc, tag, times, size, text, may in load(blob)[0]:
                spans = removed(size, gone.get((doc, tag), []))
                sha = text
                if may:
                    kept = hashlib.sha256()
                    at = 0
                    for a, b in [*spans, (size, size)]:
                        kept.update(text[at:a])
                        at = b
                    sha = kept.hexdigest()
                for _ in range(times):
                    yield None if doc == NO_ID else doc, size, sum(b - a for a, b in spans), len(spans), sha

    yield from work.batches(_OUT, rows())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flush: int = FLUSH_BYTES, sort: int = SORT_BYTES, hot: int = HOT_RUNS) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    n = work.buckets(docs)
    own = work.spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), work.text_of(text_col).alias("text")))
    runs, run_path = work.keep(own.mapInArrow(_anchors(n, flush), _BLOB_DDL).repartitionById(n, "bucket").mapInArrow(_repeated(n, hot), _BLOB_DDL), "suffix-runs")
    shared = spark.sparkContext.broadcast(hot_anchors(runs, hot))
    # no step's frame is held by a name, so that its shuffle files can go before the next step writes its own
    path = work.keep_by(own.mapInArrow(_texts(n, flush), _BLOB_DDL).unionByName(runs.where("kind = 'runs'")).repartitionById(n, "bucket").mapInArrow(_segments(n, shared), _BLOB_DDL), "suffix-parts", "kind")
    work.release(spark, run_path)
    parts = lambda: spark.read.schema(_BLOB_DDL).parquet(path).select("kind", "bucket", "blob")
    gone, _ = work.keep(parts().where("kind = 'segments'").repartitionById(n, "bucket").mapInArrow(_sorted(n, sort), _BLOB_DDL), "suffix-gone")
    work.release(spark, f"{path}/kind=segments")
    return parts().unionByName(gone).repartitionById(n, "bucket").mapInArrow(_cut, _OUT_DDL)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), q AS (
  SELECT doc_id, c, substr(h, 2 * c + 1, 2 * (400 + {LENGTH - 1})) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1}, 400)) AS c FROM d WHERE length(h) >= {2 * LENGTH})
), w AS (
  SELECT doc_id, c + j AS p, md5_number(substr(part, CAST(2 * j + 1 AS INT), {2 * LENGTH})) AS x
  FROM (SELECT doc_id, c, part, unnest(range(0, length(part) // 2 - {LENGTH - 1})) AS j FROM q)
), f AS (
  SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, p) > 1
), i AS (
  SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island
  FROM (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} THEN 1 ELSE 0 END AS new FROM f)
), g AS (
  SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM i GROUP BY doc_id, island
), k AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM g
), t AS (
  SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
