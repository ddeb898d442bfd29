"""Merkle manifest of a dataset: leaves, a tree for each source, a tree over the sources, and proofs.

A leaf is the SHA-256 of a row's fields. Within a source leaves ascend by doc_id; every three consecutive
nodes (the last run: fewer, even one) become the SHA-256 of their hexadecimal digests until one is
left, the source's subroot. Subroots in the order of sources make the root in the same way.

Trees are climbed by combineByKey. The key is a block of 3 ** height neighbours, the combiner a
``Frontier``: partial parents that gather the digests of their children by place. How many children a
parent waits for follows from its place and the number of nodes on the level, so it never waits for an
end: with the last child it is closed, and its digest is an event for its own parent. What a task
can't close travels to the block's task. A block's top is an event of the next round, whose nodes are
blocks; n nodes take log n / (height log 3) rounds, and no combiner ever holds more than a block, so a
source with a third of all rows is as many blocks as it needs. Proofs go the other way: closed parents
are kept with their blocks, and each block hands the path above its top to its children.

Rules for unusual rows: every null field is written as ``-``. Sources are ordered by their bytes, null
first and apart from the empty one; rows of a source by doc_id, null first, then by leaf, so rows that
repeat a doc_id have a place each and equal rows are interchangeable. A null doc_id is never tampered with.
An empty text is a field of no bytes; a very long one is hashed as a whole where it is read and doesn't
travel. An empty table has no leaves and gives an empty table. Columns other than the five fields are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, read_table, written

ARITY, HEIGHT, EACH = 3, 6, 200_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
BLOCK = "tree long, block long, size long, top string, items array<struct<at:long,digest:string,doc_id:long,tampered:string>>, closed array<struct<level:int,at:long,digests:array<string>>>"
PATH = "tree long, at long, subroot string, path string, sizes array<long>, place array<long>"
ARROW_PATH = pa.schema([("tree", pa.int64()), ("at", pa.int64()), ("subroot", pa.string()), ("path", pa.string()), ("sizes", pa.list_(pa.int64())), ("place", pa.list_(pa.int64()))])
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def spread(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: what the session sets for shuffles, more beyond EACH rows a task."""
    return parts_for(rows, EACH, int(spark.conf.get("spark.sql.shuffle.partitions")))


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(size: int, height: int) -> list[int]:
    """Nodes on each level from the given one up, until one is left or height levels were climbed."""
    out = [size]
    while out[-1] > 1 and len(out) <= height:
        out.append(-(-out[-1] // ARITY))
    return out


class Frontier:
    """The open parents of a block, its closed ones, its items, and its top once all is closed."""

    __slots__ = ("size", "counts", "open", "closed", "items", "top")

    def __init__(self, size: int, height: int):
        self.size, self.counts = size, levels(size, height)
        self.open: dict[tuple[int, int], dict[int, str]] = {}
        self.closed: list[tuple[int, int, list[str]]] = []
        self.items: list[tuple[int, str, int | None, str | None]] = []
        self.top: str | None = None

    def arrive(self, level: int, at: int, digest: str) -> None:
        """A node's digest is known; it closes its parent if it is the last child, and so on upwards."""
        while level < len(self.counts) - 1:
            parent = at // ARITY
            children = self.open.setdefault((level + 1, parent), {})
            children[at % ARITY] = digest
            if len(children) < min(ARITY, self.counts[level] - ARITY * parent):
                return
            del self.open[level + 1, parent]
            run = [children[k] for k in range(len(children))]
            self.closed.append((level + 1, parent, run))
            level, at, digest = level + 1, parent, digest_of(run)
        self.top = digest

    def add(self, item: tuple[int, str, int | None, str | None]) -> Frontier:
        self.items.append(item)
        self.arrive(0, item[0], item[1])
        return self

    def merge(self, other: Frontier) -> Frontier:
        """Take over another task's part of the block; its open parents' children arrive here."""
        self.items += other.items
        self.closed += other.closed
        if other.top is not None:
            self.top = other.top
        for (level, parent), children in other.open.items():
            for k, digest in children.items():
                self.arrive(level - 1, ARITY * parent + k, digest)
        return self


def blocks(events: DataFrame, parts: int, height: int) -> DataFrame:
    """One round: events(tree, size, at, digest, doc_id, tampered) by block of ARITY ** height, as rows of BLOCK.

    size is the number of the tree's nodes on this level; doc_id and tampered are only carried.
    """
    width = ARITY**height

    def event(row) -> tuple[tuple[int, int], tuple]:
        return (row[0], row[2] // width), (row[1], (row[2], row[3], row[4], row[5]))

    def first(value: tuple) -> Frontier:
        return Frontier(value[0], height).add(value[1])

    def row(entry: tuple[tuple[int, int], Frontier]) -> tuple:
        (tree, block), f = entry
        if f.open:
            raise ValueError(f"block {block} of tree {tree} lacks nodes")
        return tree, block, f.size, f.top, sorted(f.items, key=lambda i: i[0]), f.closed

    keyed: RDD = events.select("tree", "size", "at", "digest", "doc_id", "tampered").rdd.map(event)
    made = keyed.combineByKey(first, lambda f, value: f.add(value[1]), lambda f, g: f.merge(g), parts, lambda key: (key[0] * 1_000_003 + key[1]) & 0x7FFFFFFF)
    return written(events.sparkSession.createDataFrame(made.map(row), BLOCK, verifySchema=False), "merkle-blocks")


def climbed(events: DataFrame, height: int) -> list[DataFrame]:
    """The blocks of all rounds, the lowest first. The last block of a tree has the tree's root as top."""
    width, out = ARITY**height, []
    n, most = events.agg(F.count("*"), F.max("size")).first()
    while n:
        out.append(blocks(events, spread(events.sparkSession, n), height))
        if most <= width:
            break
        none = F.lit(None).cast("long"), F.lit(None).cast("string")
        events = out[-1].where(F.col("size") > width).select("tree", F.ceil(F.col("size") / width).cast("long").alias("size"), F.col("block").alias("at"), F.col("top").alias("digest"), none[0].alias("doc_id"), none[1].alias("tampered"))
        n, most = parts_for(n, width), parts_for(most, width)
    return out


def roots(rounds: list[DataFrame], height: int) -> DataFrame:
    """(tree, top) of every tree."""
    out = None
    for blocks in rounds:
        done = blocks.where(F.col("size") <= ARITY**height).select("tree", "top")
        out = done if out is None else out.unionByName(done)
    return out


def siblings(counts: list[int], closed: dict[tuple[int, int], list[str]], at: int) -> tuple[str, list[int], list[int]]:
    """The others of each run from a node up to its block's top, in one string; run sizes; the node's places in them."""
    path, sizes, place = [], [], []
    for level in range(1, len(counts)):
        run = closed[level, at // ARITY]
        k = at % ARITY
        path += run[:k] + run[k + 1 :]
        sizes.append(len(run))
        place.append(k)
        at //= ARITY
    return "".join(path), sizes, place


def folded(digest: str, path: str, sizes: list[int], place: list[int]) -> str:
    """The root that a node and the siblings on its way up give."""
    a = 0
    for size, k in zip(sizes, place):
        others = [path[i : i + 64] for i in range(a, a + 64 * (size - 1), 64)]
        a += 64 * (size - 1)
        digest = digest_of([*others[:k], digest, *others[k:]])
    return digest


def one_by_one(batches: Iterator) -> Iterator[dict]:
    """The rows of batches; only one block at a time becomes Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def handed_down(blocks: DataFrame, above: DataFrame | None, height: int, own_subroot: bool = False) -> DataFrame:
    """Paths (PATH) of the items of blocks, from the paths of their tops; without above, of a last round's own tops."""

    def paths(batches: Iterator) -> Iterator:
        for b in one_by_one(batches):
            counts, closed, out = levels(b["size"], height), {(c["level"], c["at"]): c["digests"] for c in b["closed"]}, []
            for item in b["items"]:
                path, sizes, place = siblings(counts, closed, item["at"])
                out.append({"tree": b["tree"], "at": item["at"], "subroot": item["digest"] if own_subroot else b["subroot"], "path": path + b["path"], "sizes": sizes + b["sizes"], "place": place + b["place"]})
            yield from pa.Table.from_pylist(out, ARROW_PATH).to_batches()

    return written(with_paths(blocks, above).mapInArrow(paths, PATH), "merkle-paths")


def with_paths(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """Blocks and the paths above their tops: one row of each a block, so no key is hot."""
    if above is None:
        empty = F.array().cast("array<long>")
        return blocks.withColumns({"subroot": F.lit(None).cast("string"), "path": F.lit(""), "sizes": empty, "place": empty})
    return blocks.join(above.withColumnRenamed("at", "block"), ["tree", "block"])


def written_field(name: str, text: Column | None = None) -> Column:
    value = F.col(name).cast("string") if text is None else text
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and, where the doc_id is dealt one, the leaf of the tampered row."""
    row = lambda text: F.sha2(F.concat(*(written_field(c) for c in FIELDS[:-1]), written_field("text", text)), 256)
    dealt = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row(F.col("text")).alias("leaf"), F.when(dealt, row(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("tampered"))


def placed(rows: DataFrame, order: list, by: Column, n: int) -> DataFrame:
    """rows with `tree`, the number of rows before the first of their group in the order, `size`, the group's rows, and `at`, their place in it.

    The order must keep groups together. Places come from the ranges of a range exchange: a group is
    counted once a range, so one that fills many ranges is joined in as many parts.
    """
    ranged = rows.withColumn("_g", by).repartitionByRange(spread(rows.sparkSession, n), *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_i", F.monotonically_increasing_id()), "merkle-order")
    ranged = ranged.withColumn("_p", F.shiftright("_i", 33)).withColumn("_i", F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = ranged.groupBy("_g", "_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    # one row a range
    ranges = counts.groupBy("_p").agg(F.sum("_n").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    group = Window.partitionBy("_g")
    pieces = counts.join(ranges, "_p").withColumn("tree", F.min(F.col("_before") + F.col("_first")).over(group)).withColumn("size", F.sum("_n").over(group))
    return ranged.join(pieces.select("_g", "_p", "_before", "tree", "size"), ["_g", "_p"]).withColumn("at", F.col("_before") + F.col("_i") - F.col("tree")).drop("_g", "_p", "_i", "_before")


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and what its tampered or original leaf folds to."""
    found = written(leaves(docs), "merkle-leaves")
    n = found.count()
    if not n:
        return docs.sparkSession.createDataFrame([], PROVED)
    # null first and apart from '': its group key is empty, others start with a mark
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    ordered = placed(found, ["source", "doc_id", "leaf"], key, n)
    low = climbed(ordered.select("tree", "size", "at", F.col("leaf").alias("digest"), "doc_id", "tampered"), height)
    # trees are numbered by their first row, so they are in the order of sources
    tops = written(roots(low, height), "merkle-tops")
    n_sources = tops.count()
    over = placed(tops.withColumnRenamed("tree", "first"), ["first"], F.lit("="), n_sources)
    named = written(over.select("tree", "size", "at", F.col("top").alias("digest"), F.col("first").alias("doc_id"), F.lit(None).cast("string").alias("tampered")), "merkle-sources")
    high = climbed(named, height)
    paths = None
    for i, up in enumerate(reversed(high)):
        paths = handed_down(up, paths, height, own_subroot=i == len(high) - 1)
    root = roots(high, height).first()["top"]
    # a source's own tree goes on from the source's place in the tree of sources
    paths = named.select(F.col("doc_id").alias("first"), "at").join(paths.drop("tree"), "at").select(F.col("first").alias("tree"), F.lit(0).cast("long").alias("at"), "subroot", "path", "sizes", "place")
    below = None
    for k in reversed(range(len(low))):
        # trees that end on this round take their source's path, the others what the round above handed down
        above = paths.join(low[k].where(F.col("size") <= ARITY**height).select("tree"), "tree", "left_semi")
        above = above if below is None else above.unionByName(below)
        if k:
            below = handed_down(low[k], above, height)
    return proofs(with_paths(low[0], above), root, height)


def proofs(blocks: DataFrame, root: str, height: int) -> DataFrame:
    """The rows of the lowest blocks, proved one by one."""

    def run(batches: Iterator) -> Iterator:
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        for b in one_by_one(batches):
            counts, closed, out = levels(b["size"], height), {(c["level"], c["at"]): c["digests"] for c in b["closed"]}, []
            for item in b["items"]:
                path, sizes, place = siblings(counts, closed, item["at"])
                path, sizes, place = path + b["path"], sizes + b["sizes"], place + b["place"]
                end = folded(item["tampered"] or item["digest"], path, sizes, place)
                out.append((item["doc_id"], item["digest"], b["subroot"], root, digest_of([path]), end, end == root))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return blocks.mapInArrow(run, PROVED)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"))
