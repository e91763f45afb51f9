"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m bytes that occurs in a document with at most k edits shares at least m + 1 - q - k * q of its q-grams with the place, all on diagonals that
lie at most k apart. Shared q-grams are counted in bands of 2 * (k + 1) diagonals that overlap by half, so that one band holds the whole place; bands that
reach the bound are regions, neighbouring ones are one, and a region stays if a banded alignment of the whole item in it needs no more than k edits.

A place of the text counts once in a band, however often the item repeats its q-gram there: places of one q-gram in an item that lie within a band's step are one entry. Shared q-grams
are counted in segments of the text and chunks of entries, so memory does not grow with the text or with the number of items that share a prompt. Regions without an exact
occurrence are aligned many at a time, from the item's end that fewer items share.

Texts and items are compared lower-cased, with every run of white space one blank. The edit budget k is a share of an item's length, at most ``MOST_EDITS``, less where the bound
would not be positive. Items shorter than a q-gram are found where they stand as they are, not within longer words.

Items are a table that may be large: they go to the tasks in blocks of at most ``BLOCK_BYTES``, a pass over the documents for each.

Cases: null texts and items count as empty; an empty item is in no document; rows that repeat an item's id and text are one item, other repeated items are matched each by its own id; rows
without id are matched too; documents of any length are read whole; extra columns are ignored; no items, no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import work

Q = 8
#: Edits allowed, as a share of an item's bytes, and at most.
EDITS, MOST_EDITS = 0.08, 256
#: Bytes of items in one broadcast.
BLOCK_BYTES = 8 << 20
#: Places of a text whose shared q-grams are counted together, entries that are expanded at once, diagonals of one alignment, and cells of a batch of alignments.
SEGMENT, CHUNK, WIDTH, CELLS = 4096, 1 << 18, 1 << 15, 1 << 16
_BITS = 22
_MUL = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(257, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def normalise(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def budget(m: int, edits: float = EDITS, q: int = Q) -> int:
    """The most edits of an item of m bytes: the share, or what leaves a shared q-gram."""
    return max(0, min(int(m * edits), (m - q) // q, MOST_EDITS))


def codes(text: bytes) -> np.ndarray:
    """The q-grams of a text as numbers; q is 8, so a gram is its own code."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for k in range(min(Q, n)):
        part = np.frombuffer(text, "<u8", (len(text) - k) // Q, k)
        out[k::Q] = part
    return out


def _expanded(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, place) of the ranges first .. first + count, some ``CHUNK`` at a time."""
    stop = np.cumsum(count)
    for at in range(0, int(stop[-1]) if len(stop) else 0, CHUNK):
        flat = np.arange(at, min(at + CHUNK, int(stop[-1])))
        owner = np.searchsorted(stop, flat, "right")
        yield owner, first[owner] + flat - (stop[owner] - count[owner])


class Tally:
    """Counts of keys that come in parts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > 8 * CHUNK and len(self.parts) > 1:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, back = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([n for _, n in self.parts]), len(keys)).astype(np.int64)


@dataclass
class Items:
    """Items with an index of their q-grams."""

    ids: list
    texts: list[bytes]

    def __post_init__(self):
        long = [i for i, t in enumerate(self.texts) if len(t) >= Q]
        self.own = np.array(long, np.int64)  # the index's item numbers to places in ``texts``
        sizes = np.array([len(self.texts[i]) for i in long], np.int64)
        self.k = np.array([budget(m) for m in sizes.tolist()], np.int64)
        self.least = sizes + 1 - Q - self.k * Q
        own = [codes(self.texts[i]) for i in long]
        counts = [len(x) for x in own]
        grams = np.concatenate([np.zeros(0, np.uint64), *own])
        item = np.repeat(np.arange(len(own), dtype=np.int64), counts)
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(n, dtype=np.int64) for n in counts)])
        order = np.lexsort((place, item, grams))
        g, i, x = grams[order], item[order], place[order]
        # an entry: places of a gram in an item that lie within a step of each other
        begin = np.concatenate(([True], (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (x[1:] - x[:-1] > self.k[i[1:]] + 1)))[: len(g)]
        first = np.flatnonzero(begin)
        self.item, self.low, self.high = i[first], x[first], x[np.append(first[1:], len(g)) - 1] if len(g) else x
        self.grams, self.first, self.count = np.unique(g[first], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.grams * _MUL) >> np.uint64(64 - _BITS)] = True
        # a place spans at most size + k bytes; of the windows that part it one holds its share of the bound
        self.span = int((sizes + self.k).max(initial=Q))
        self.window = int(np.clip((sizes + self.k).min(initial=self.span), 32, 256))
        parts = -(-(sizes + self.k) // self.window)
        self.dense = int((-(-self.least // parts)).min()) if len(sizes) else 1
        # items whose first half is shared by more items than the second are aligned from their end
        common = np.log(self.count)[np.searchsorted(self.grams, grams)] if len(grams) else np.zeros(0)
        half = place < np.repeat(np.array(counts, np.int64) // 2, counts)
        mean = lambda which: np.bincount(item[which], common[which], len(own)) / np.maximum(np.bincount(item[which], minlength=len(own)), 1)
        self.backward = mean(half) > mean(~half)
        self.short: dict[int, dict[int, list[int]]] = {}
        for n, t in enumerate(self.texts):
            if 0 < len(t) < Q:
                self.short.setdefault(len(t), {}).setdefault(int.from_bytes(t, "little"), []).append(n)

    def regions(self, text: bytes) -> dict[int, list[tuple[int, int]]]:
        """By item, the (first diagonal, last diagonal) of the bands that reach its bound; a diagonal is a place in the text less one in the item."""
        own = codes(text)
        if not len(own) or not len(self.grams):
            return {}
        seen = self.seen[(own * _MUL) >> np.uint64(64 - _BITS)]
        total = np.concatenate(([0], np.cumsum(seen, dtype=np.int32)))
        stop = np.minimum(np.arange(self.window, len(own) + self.window), len(own)) if len(own) < self.window else None
        counts = total[stop] - total[:-1] if stop is not None else total[self.window :] - total[: -self.window]
        dense = np.flatnonzero(counts >= self.dense)
        if not len(dense):
            return {}
        near = np.bincount(np.maximum(dense - self.span, 0), minlength=len(own) + 1) - np.bincount(np.minimum(dense + self.window + self.span, len(own)), minlength=len(own) + 1)
        at = np.flatnonzero(seen & (np.cumsum(near[:-1]) > 0))
        gram = np.searchsorted(self.grams, own[at])
        gram[gram == len(self.grams)] = 0
        real = self.grams[gram] == own[at]
        at, gram = at[real], gram[real]
        if self.count[gram].sum() < self.least.min():
            return {}
        found: list[np.ndarray] = []
        step = max(SEGMENT, 2 * self.span)
        for begin in range(int(at[0]), int(at[-1]) + 1, step):  # a place that begins in a segment lies within it and the span after it
            part = slice(np.searchsorted(at, begin), np.searchsorted(at, begin + step + self.span))
            found.append(self._bands(at[part], gram[part]))
        keys = np.unique(np.concatenate(found))
        if not len(keys):
            return {}
        item, band = keys >> 32, (keys & 0xFFFFFFFF) - 1
        size = self.k[item] + 1
        new = np.concatenate(([True], (item[1:] != item[:-1]) | (band[1:] > band[:-1] + 2)))[: len(keys)]
        # neighbouring bands are one region, up to WIDTH diagonals
        begins, out = np.flatnonzero(new), {}
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=True):
            i, s = int(item[a]), int(size[a])
            most = max(1, WIDTH // s - 2)
            for c in range(int(band[a]), int(band[b - 1]) + 1, most):
                out.setdefault(i, []).append((c * s - self.span, (min(c + most - 1, int(band[b - 1])) + 2) * s - 1 - self.span))
        return out

    def _bands(self, at: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Keys, item and band, of the bands of some places that reach their bound."""
        tally = Tally()
        for owner, entry in _expanded(self.first[gram], self.count[gram]):
            item = self.item[entry]
            step = self.k[item] + 1
            low = (at[owner] - self.high[entry] + self.span) // step  # diagonals from 0 on
            high = (at[owner] - self.low[entry] + self.span) // step
            for which, band in _expanded(low, high - low + 2):  # a band and the one that begins half a band earlier
                tally.add(item[which] << 32 | band)
        keys, hits = tally.total()
        return keys[hits >= self.least[keys >> 32]]

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item's number, edits, place) of the items in a text, the best place of each: where it begins, to within its edits."""
        best: dict[int, tuple[int, int]] = {}
        todo = []
        for i, spans in self.regions(text).items():
            item = self.texts[self.own[i]]
            exact = next((p for low, high in spans if (p := text.find(item, max(0, low), max(0, high) + len(item))) >= 0), -1)
            if exact >= 0:
                best[int(self.own[i])] = 0, exact
            else:
                todo += [(i, low, high) for low, high in spans]
        for i, edits, place in self._aligned(text, todo):
            n = int(self.own[i])
            best[n] = min(best.get(n, (1 << 60, 0)), (edits, place))
        return sorted((n, *x) for n, x in [*best.items(), *self._short(text)])

    def _aligned(self, text: bytes, todo: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        for backward in (False, True):
            own = [(i, low, high) for i, low, high in todo if self.backward[i] == backward]
            if not own:
                continue
            items = [self.texts[self.own[i]] for i, _, _ in own]
            k = [int(self.k[i]) for i, _, _ in own]
            if backward:
                n = len(text)
                spans = [(n - len(x) - high, n - len(x) - low) for x, (_, low, high) in zip(items, own, strict=True)]
                found = align(text[::-1], [x[::-1] for x in items], spans, k)
                places = [n - len(x) - d for x, (_, d) in zip(items, found, strict=True)]
            else:
                found = align(text, items, [x[1:] for x in own], k)
                places = [d for _, d in found]
            for (i, _, _), (edits, _), place, most in zip(own, found, places, k, strict=True):
                if edits <= most:
                    yield i, edits, min(max(place, 0), len(text))

    def _short(self, text: bytes) -> Iterator[tuple[int, tuple[int, int]]]:
        if not self.short or not text:
            return
        own = codes(text + b"\0" * Q)[: len(text)]
        word = _WORD[np.concatenate(([256], np.frombuffer(text, np.uint8).astype(np.int64), [256]))]
        starts = np.flatnonzero(~(word[:-2] & word[1:-1]))
        for size, table in self.short.items():
            at = starts[starts + size <= len(text)]
            at = at[~(word[at + size] & word[at + size + 1])]
            values, first = np.unique(own[at] & np.uint64((1 << 8 * size) - 1), return_index=True)
            for value, f in zip(values.tolist(), first.tolist(), strict=True):
                for n in table.get(value, ()):
                    yield n, (0, int(at[f]))


_FAR = np.int32(1 << 20)


def align(text: bytes, items: list[bytes], spans: list[tuple[int, int]], k: list[int]) -> list[tuple[int, int]]:
    """The least edits of each whole item within its diagonals, low - k .. high + k, and the diagonal of its end there; over k it may be any number over k.

    Row i of an item holds the cost of its first i bytes ending at each diagonal; a match may begin at any of them. Items go through the rows together, in batches.
    """
    out = [(1 << 20, 0)] * len(items)
    order = sorted(range(len(items)), key=lambda r: (spans[r][1] - spans[r][0] + 2 * k[r], len(items[r])))
    pad = max((max(0, -low) + kk + max(0, high + kk + len(x) - len(text)) for x, (low, high), kk in zip(items, spans, k, strict=True)), default=0) + 1
    padded = np.concatenate((np.full(pad, 256, np.int16), np.frombuffer(text, np.uint8).astype(np.int16), np.full(pad, 256, np.int16)))
    at = 0
    while at < len(order):
        width = spans[order[at]][1] - spans[order[at]][0] + 2 * k[order[at]] + 1
        most = max(1, CELLS // (2 * width))
        batch = [r for r in order[at : at + most] if spans[r][1] - spans[r][0] + 2 * k[r] + 1 <= 2 * width]
        at += len(batch)
        batch.sort(key=lambda r: -len(items[r]))
        _batch(padded, pad, len(text), batch, items, spans, k, out)
    return out


def _batch(padded: np.ndarray, pad: int, size: int, batch: list[int], items: list[bytes], spans: list[tuple[int, int]], k: list[int], out: list) -> None:
    """Aligns the items of a batch, longest first, and notes their results."""
    rows = np.array(batch)
    low = np.array([spans[r][0] - k[r] for r in batch])
    wide = np.array([spans[r][1] - spans[r][0] + 2 * k[r] + 1 for r in batch])
    most = np.array([k[r] for r in batch])
    length = np.array([len(items[r]) for r in batch])
    steps = np.arange(int(wide.max()), dtype=np.int32)
    letters = np.zeros((len(batch), int(length.max())), np.int16)
    for n, r in enumerate(batch):
        letters[n, : len(items[r])] = np.frombuffer(items[r], np.uint8)
    place = low[:, None] + steps
    outside = steps >= wide[:, None]
    row = np.where((place >= 0) & (place <= size) & ~outside, 0, _FAR).astype(np.int32)
    place = np.clip(place + pad, 0, len(padded) - 1)
    for i in range(letters.shape[1]):
        c = padded[np.minimum(place + i, len(padded) - 1)]
        new = row + np.where(c == 256, _FAR, c != letters[:, i : i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])  # the item's byte is missing in the text
        new = np.minimum.accumulate(new - steps, axis=1) + steps  # bytes of the text that the item lacks
        new[outside] = _FAR
        row = new
        done = length == i + 1
        if done.any():
            for n in np.flatnonzero(done).tolist():
                d = int(row[n].argmin())
                out[int(rows[n])] = int(row[n, d]), int(low[n]) + d
        if i % 8 == 7 or done.any():
            stay = ~done & (row.min(1) <= most)
            if not stay.all():
                rows, low, most, length, letters, place, outside, row = (x[stay] for x in (rows, low, most, length, letters, place, outside, row))
                if not len(rows):
                    return


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("place", pa.int64()), ("item_bytes", pa.int64())])


def _match(shared):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value

        def rows():
            for part in work.pieces(parts):
                for d, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    yield from ((d, items.ids[n], edits, place, len(items.texts[n])) for n, edits, place in items.matches(normalise(t)))

        yield from work.batches(_OUT, rows())

    return run


def _flag(shared):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in work.pieces(parts):
            yield part.filter(pa.array([not shared.value.matches(normalise(t or "")) for t in part.column("text").to_pylist()], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of a checked size."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), work.text_of()).distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Items([r.item_id for r in rows], [normalise(r.text) for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each item that a document holds: doc_id, item_id, edits, place and item_bytes (in the normalised text)."""
    spark = docs.sparkSession
    own = work.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), work.text_of()))
    out = None
    for items in _blocks(benchmark):
        found = own.mapInArrow(_match(spark.sparkContext.broadcast(items)), "doc_id long, item_id long, edits long, place long, item_bytes long")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    spark = docs.sparkSession
    for items in _blocks(benchmark):
        docs = docs.mapInArrow(_flag(spark.sparkContext.broadcast(items)), docs.schema)
    return docs


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` in all of ``documents``."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
