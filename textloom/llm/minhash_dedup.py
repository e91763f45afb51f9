"""Near-duplicate groups: Fast Similarity Sketching, banding, exact verification.

1. Each text's set of word shingles gets a sketch whose coordinates agree with the probability of the sets' Jaccard similarity; enough
   bands of five coordinates are drawn that a pair at the threshold is missed with a chance of 1e-8. Texts with the same words are one class from here on.
2. Classes that share a band value are a group. Within a group two classes are likely to be linked if their sizes allow it and their sketches agree in as many coordinates as a pair at the
   threshold does but for a chance of 1e-9: half-similar pages share bands by chance, but hardly ever agree so much. Of a group's likely links a spanning forest is told, so as many rows as
   members, never pairs. A value that a task of 32,768 classes meets more than ``FEW`` times, and a group of more than ``MOST_GROUP`` classes, links all its members to one instead, unseen.
3. The components of the likely links are the families; a true component lies within one family. Families are verified on their full sets. A family of up to ``BLOCK`` classes is one task's;
   pairs that are connected already are skipped. A larger family is cut into chunks: each verifies its own pairs and those with the family's pivots. What is still outside the family's
   largest component is then compared, block by block, with all of the family. No pair that could connect two components stays unchecked.
4. The components of the verified links, and every document's class in them, are the result.

Cases: texts that are null or without words are linked with nothing; a text of fewer words than a shingle is one shingle; rows without id are linked with nothing and
have no component; rows that share an id and differ in words are texts of their own, rows that share id and words are one; extra columns of any name do no harm; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.llm import graph, shingles, work

#: Words of a shingle and least similarity in percent, unless a contract says otherwise.
WORDS, PERCENT = 5, 80
#: Classes that a task compares with each other.
BLOCK = 256
#: Classes of a larger family that all the others are compared with.
PIVOTS = 8

#: Classes of a task that may share a band value, and classes of a group, before they are linked to one of them without a look.
FEW, MOST_GROUP = 4096, 20_000
#: Band rows of a task.
BAND_ROWS = 4_000_000

_SKETCH = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
_SKETCH_DDL = "doc_id long, class binary, n_shingles long, bands array<long>, sketch binary"
_BAND = pa.schema([("value", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_BAND_DDL = "value long, a long, b long"
_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ids", pa.list_(pa.int64()))])
_MET_DDL = "a long, b long, ids array<long>"
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Stands for the second node where a member speaks for many, which are linked to it.
_HOT = -1


def class_of(text: bytes) -> bytes:
    """Equal for texts with the same words."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def _sketches(words: int, percent: int):
    count = shingles.banding(percent)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in work.pieces(parts):
                for doc_id, text in zip(part.column(0).to_pylist(), work.utf8(part.column(1)), strict=True):
                    s = shingles.shingle_set(text, words)
                    if len(s) and doc_id is not None:
                        values, sketch = shingles.bands(s, count)
                        yield doc_id, class_of(text), len(s), values, sketch
                    else:
                        yield doc_id, None, len(s), None, None

        yield from work.batches(_SKETCH, rows())

    return run


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return first, np.diff(np.append(first, len(keys)))


def _links(a: np.ndarray, b: np.ndarray, value: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a if value is None else value), pa.array(a), pa.array(b)], schema=_BAND)


def _members(few: int):
    """A task's (band value, class); of a value that it meets more than ``few`` times one class, marked, and links of the others to it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(parts):
            ids = np.asarray(part.column(0))
            table = part.column(1).flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.int64)
            for column in table.T:
                order = np.lexsort((ids, column))
                values, own = column[order], ids[order]
                first, size = _runs(values)
                many = np.repeat(size > few, size)
                lead = np.zeros(len(own), bool)
                lead[first] = True
                yield pa.RecordBatch.from_arrays([pa.array(values[~many]), pa.array(own[~many]), pa.nulls(int((~many).sum()), pa.int64())], schema=_BAND)
                if many.any():
                    hub = np.repeat(own[first], size)
                    yield _links(own[many & lead], np.full(int((many & lead).sum()), _HOT), values[many & lead])
                    yield _links(own[many & ~lead], hub[many & ~lead], values[many & ~lead])

    return run


def _gathered(parts: Iterator[pa.RecordBatch], rows: int = 32_768) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _met(most: int):
    """All members of some band values: links that tasks have found, links of very large groups to one member, and the members of other groups, each set of them once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = lambda n: pa.nulls(n, pa.list_(pa.int64()))
        pieces, marks = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [np.zeros(0, bool)]
        for part in parts:
            b = part.column(2)
            hot = np.asarray(b.fill_null(0)) == _HOT
            known = np.asarray(b.is_valid()) & ~hot
            if known.any():
                found = part.filter(pa.array(known))
                yield pa.RecordBatch.from_arrays([found.column(1), found.column(2), empty(len(found))], schema=_MET)
            pieces.append((np.asarray(part.column(0))[~known], np.asarray(part.column(1))[~known]))
            marks.append(hot[~known])
        values, ids, hot = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]), np.concatenate(marks)
        order = np.lexsort((ids, values))
        values, ids, hot = values[order], ids[order], hot[order]
        if not len(ids):
            return
        first, size = _runs(values)
        blind = (np.add.reduceat(hot, first) > 0) | (size > most)
        far = np.repeat(blind, size)
        hub = np.repeat(ids[first], size)
        far &= ids != hub
        if far.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(hub[far]), empty(int(far.sum()))], schema=_MET)
        mark = np.add.reduceat(shingles.mix(ids.view(np.uint64)), first)
        seen = np.flatnonzero(~blind & (size > 1))
        _, once = np.unique(np.stack([mark[seen], size[seen].astype(np.uint64), ids[first[seen]].view(np.uint64)]), axis=1, return_index=True) if len(seen) else (None, np.zeros(0, np.int64))
        for at in range(0, len(once), 10_000):
            part = seen[np.sort(once)[at : at + 10_000]]
            lists = pa.array([ids[first[g] : first[g] + size[g]] for g in part], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64()), lists], schema=_MET)

    return run


def likely(ids: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, percent: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that span the likely pairs of a group: from each class that is reached to those that are not yet."""
    left = np.arange(len(ids))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            small, large = np.minimum(sizes[left], sizes[x]), np.maximum(sizes[left], sizes[x])
            near = left[100 * small >= percent * large]
            near = near[(sketches[near] == sketches[x]).sum(1) >= least]
            if len(near):
                yield ids[near], np.full(len(near), ids[x])
                queue += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)


def _likely(percent: int):
    least = shingles.agreement(percent, 5 * shingles.banding(percent))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def group():
            ids, sizes = (np.array(x, np.int64) for x in zip(*((i, n) for i, n, _ in held), strict=True))
            for a, b in likely(ids, sizes, np.frombuffer(b"".join(s for _, _, s in held), np.uint8).reshape(len(held), -1), percent, least):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_LINK)

        for part in work.pieces(parts, 8192):
            for g, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if g != key and held:
                    yield from group()
                    held = []
                key = g
                held.append(row)
        if held:
            yield from group()

    return run


def families(classes: DataFrame, percent: int) -> DataFrame:
    """(id, family) of the classes (id, n_shingles, bands, sketch) that are likely to be linked with another."""
    spark = classes.sparkSession
    n = max(work.buckets(classes), classes.count() * shingles.banding(percent) // BAND_ROWS)
    met, met_path = work.keep(classes.select("id", "bands").mapInArrow(_members(FEW), _BAND_DDL).repartition(n, "value").mapInArrow(_met(MOST_GROUP), _MET_DDL), "band-groups")
    groups = met.where("ids IS NOT NULL").select("ids").dropDuplicates(["ids"]).select(F.xxhash64("ids").alias("g"), "ids")
    members = groups.select("g", F.explode("ids").alias("id")).join(classes.select("id", "n_shingles", "sketch").hint("merge"), "id")
    dealt = members.select("g", "id", "n_shingles", "sketch").repartition(n, "g").sortWithinPartitions("g")
    found, found_path = work.keep(dealt.mapInArrow(_likely(percent), "a long, b long").unionByName(met.where("b IS NOT NULL").select("a", "b")).distinct(), "likely-links")
    roots = graph.components(found)
    work.release(spark, met_path, found_path)
    return roots.select("id", F.col("root").alias("family")).unionByName(roots.select(F.col("root").alias("id"), F.col("root").alias("family")).distinct())


class Forest:
    """Union-find over a task's classes."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def verify(rows: list[tuple[int, int, bool, bytes]], words: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect a task's classes (id, component so far, whether on the left, text) where full sets do.

    Pairs of which neither is on the left are not compared.
    """
    forest = Forest()
    sets = []
    for i, comp, left, text in rows:
        forest.join(("c", comp), ("i", i))
        sets.append((("i", i), left, shingles.shingle_set(text, words)))
    sets.sort(key=lambda x: (not x[1], len(x[2]), x[0]))  # the left ones first
    for k, (a, left, s) in enumerate(sets):
        if not left:
            break
        for b, _, t in sets[k + 1 :]:
            if forest.root(a) != forest.root(b) and shingles.linked(s, t, percent):
                forest.join(a, b)
                yield a[1], b[1]


def _verified(words: int, percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            key, held = None, []
            for part in work.pieces(parts):
                columns = [part.column(c).to_pylist() for c in ("task", "id", "comp", "left")]
                for task, i, comp, left, text in zip(*columns, work.utf8(part.column("text")), strict=True):
                    if task != key:
                        yield from verify(held, words, percent)
                        key, held = task, []
                    held.append((i, comp, left, text))
            yield from verify(held, words, percent)

        yield from work.batches(_LINK, links())

    return run


def _run_tasks(tasks: DataFrame, n: int, words: int, percent: int) -> DataFrame:
    """Verified links of tasks: (task, id, comp, left, text)."""
    dealt = tasks.repartition(n, "task").sortWithinPartitions("task")
    return dealt.select("task", "id", "comp", "left", "text").mapInArrow(_verified(words, percent), "a long, b long")


def _of_class(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text is of their class."""
    for part in work.pieces(parts):
        own = [c == class_of(t) for c, t in zip(part.column("class").to_pylist(), work.utf8(part.column("text")), strict=True)]
        yield part.filter(pa.array(own, pa.bool_()))


def _components(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class, n_shingles) of every document, class null where it is linked with nothing; and (class, rep, component_id, head) of every class: its smallest id, that of its component, and
    whether it is the component's first class by id."""
    spark = docs.sparkSession
    n = work.buckets(docs)
    own = work.spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), work.text_of(text_col).alias("text")))
    sketched, _ = work.keep(own.mapInArrow(_sketches(words, percent), _SKETCH_DDL), "sketches")
    whole = sketched.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")))
    classes, _ = work.keep(whole.withColumn("id", F.monotonically_increasing_id()), "classes")  # the written number stays a class's name
    found = families(classes.select("id", "n_shingles", "bands", "sketch"), percent)
    sizes = found.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    members = found.join(sizes, "family").join(classes.select("id", "class", "rep"), "id").hint("merge")  # as many rows as near copies: no bound to broadcast them by
    of_class = own.join(members, F.col("doc_id") == F.col("rep")).select("id", "family", "size", "class", "text").mapInArrow(_of_class, "id long, family long, size long, class binary, text string")
    texts, text_path = work.keep(of_class.drop("class").dropDuplicates(["id"]), "family-texts")
    whole = texts.where(F.col("size") <= BLOCK).select(F.col("family").alias("task"), "id", F.col("id").alias("comp"), F.lit(True).alias("left"), "text")
    links, _ = work.keep(_run_tasks(whole, n, words, percent), "near-links")
    large = texts.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        links = links.unionByName(_large(large, n, words, percent))
    roots = graph.components(links)
    work.release(spark, text_path)
    linked = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct()).join(classes.select("id", "class", "rep"), "id")
    first = linked.groupBy("root").agg(F.min(F.struct("rep", "class")).alias("first"))
    comp = linked.join(first, "root").select("id", F.col("first.rep").alias("component_id"), (F.col("class") == F.col("first.class")).alias("head"))
    comp = classes.select("id", "class", "rep").join(comp, "id", "left")
    return sketched.select("doc_id", "class", "n_shingles"), comp.select("class", "rep", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("head", F.lit(True)).alias("head"))


def near_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept."""
    sketched, comp = _components(docs, words, percent, id_col, text_col)
    out = sketched.join(comp.select("class", "component_id"), "class", "left")
    component = F.when(F.col("class").isNotNull(), F.col("component_id")).when(F.col("n_shingles") == 0, F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _large(texts: DataFrame, n: int, words: int, percent: int) -> DataFrame:
    """Verified links of families of more than ``BLOCK`` classes (id, family, size, text)."""
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    texts = texts.withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("id", F.lit(1)), chunks).cast("int")})
    # pivots: about PIVOTS members, by a hash that does not depend on the chunk
    is_pivot = F.pmod(F.xxhash64("id", F.lit(2)), F.col("size")) < PIVOTS
    each = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    row = lambda task: [task, "id", F.col("id").alias("comp"), F.lit(True).alias("left"), "text"]
    at = lambda *parts: F.xxhash64("family", *parts).alias("task")
    own = texts.where(~is_pivot).select(*row(at("chunk")))
    pivots = texts.where(is_pivot).withColumn("to", each).select(*row(at("to")))
    links, _ = work.keep(_run_tasks(own.unionByName(pivots), n, words, percent), "pivot-links")
    roots = graph.components(links)
    held = texts.join(roots.select(F.col("id").alias("x"), "root"), F.col("id") == F.col("x"), "left").select("id", "family", "chunks", "chunk", "text", F.coalesce("root", "id").alias("comp"))
    held, _ = work.keep(held, "large-families")
    counts = held.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("family").agg(F.max(F.struct("n", "comp")).alias("most")).select(F.col("family").alias("f"), F.col("most.comp").alias("main"))
    held = held.join(main, F.col("family") == F.col("f")).withColumn("outside", F.col("comp") != F.col("main"))
    outside = held.where("outside").groupBy("family").agg(F.count(F.lit(1)).alias("n")).select(F.col("family").alias("g"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    held = held.join(outside, F.col("family") == F.col("g"))  # families of one component are done
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    left = held.where("outside").withColumn("block", block).withColumn("to", each).select(at(F.col("block"), F.col("to")), "id", "comp", F.lit(True).alias("left"), "text")
    right = held.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(at(F.col("to"), F.col("chunk")), "id", "comp", F.lit(False).alias("left"), "text")
    more, _ = work.keep(_run_tasks(left.unionByName(right), n, words, percent), "block-links")
    return links.unionByName(more)


def _named(text: str, name: str):
    """Adds a row's name: its class and id, or, where it is linked with nothing, the number that it came with."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in work.pieces(parts):
            own = zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist(), work.utf8(part.column(text)), strict=True)
            names = [f"row {row}" if i is None or not t.split() else f"{class_of(t).hex()} {i}" for i, row, t in own]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(names, pa.string())], names=[*part.schema.names[:-2], name])

    return run


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one with the smallest id of each component, and all that are linked with nothing or have no id."""
    sketched, comp = _components(docs, words, percent, id_col, text_col)
    of = sketched.where("class IS NOT NULL").join(comp, "class")
    gone = of.where(~F.col("head") | (F.col("doc_id") != F.col("rep")))
    name = work.fresh(docs, "name")
    gone = gone.select(F.concat(F.lower(F.hex("class")), F.lit(" "), F.col("doc_id").cast("string")).alias(name)).distinct()
    numbered = docs.withColumn(name, F.col(f"`{id_col}`").cast("long"))
    numbered = numbered.withColumn(work.fresh(numbered, "row"), F.monotonically_increasing_id())
    named = numbered.mapInArrow(_named(text_col, name), StructType([*docs.schema.fields, StructField(name, StringType())]))
    return named.join(gone.hint("merge"), name, "left_anti").dropDuplicates([name]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``: shingles of three words, similarity of 0.85 or more."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), l AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b
)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept
FROM s JOIN (SELECT id, min(root) AS root FROM r GROUP BY 1) ON id = doc_id
"""
