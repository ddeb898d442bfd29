"""Near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped candidates.

1. A document's set holds the hashes of its distinct shingles. One hash per shingle picks its bin and
   the least of each bin is kept; an empty bin takes the value of a full one that its own probe
   sequence reaches first (optimal densification). BANDS bands of ROWS bins are hashed to buckets; a
   pair at the threshold of 0.8 shares none of 32 with a probability below one in ten million.
2. Documents with equal word sequences are one node, so a group of copies is one row from here on.
3. Buckets of one node are dropped. In each other bucket one member is the centre and its pairs with
   the rest are candidates: no bucket gives more pairs than it has members. Candidates are confirmed
   on the full sets. In the first of ROUNDS rounds the centre is the member that shares the most
   buckets, then another random member of each bucket; those only pair it with members that are not
   yet in its component.
4. What stars leave open is settled exactly. A bucket that still spans components and has more than
   MANY members is parted by longer keys: FINE_BANDS bands of FINE_ROWS of bins of their own, of which
   a pair at the threshold shares none with a probability below one in ten billion. In the buckets
   that are left every pair of two components is compared, by a bound first: the bins of a set's
   parities (some four bits a shingle) differ in no more places than the sets do.
5. Links become components by minimum labels with pointer jumping; every step is a written table.

Rules for unusual rows: a null text or one without words has an empty set, is linked with nothing and
its own component; with fewer words than a shingle the whole sequence is one shingle; a row without
doc_id is kept, with a null component; equal rows get equal results; texts that share a doc_id are
one node; a similarity of exactly the threshold is a link; texts may be of any length, their sets are
held by the task that makes or compares them; an empty table gives an empty table. Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .exchange import Prefix, U, groups, mix
from .substring_dedup import word_hashes

BANDS, ROWS, ROUNDS = 32, 4, 2
FINE_BANDS, FINE_ROWS, MANY = 128, 8, 256
PARITY, WIDEST, BLOCK, BLOCK_BYTES, PAIRS = 10, 20, 4096, 16_000_000, 1 << 16
SIGNED = "doc_id long, n_shingles long, sequence binary, bands array<long>"


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle, in that order."""
    hashes, counts = word_hashes(texts)
    n = np.maximum(counts - words + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(texts)), n)
    begin = np.cumsum(counts) - counts
    start = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    found = mix(Prefix(hashes).of(start, np.minimum(counts, words)[row]))
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = (np.diff(row, prepend=-1) != 0) | (np.diff(found, prepend=U(0)) != 0)
    return row[new], found[new]


def densified(bins: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fill empty bins of each row from full ones, in each bin's own probe order."""
    k = bins.shape[1]
    row, at = np.nonzero(~full & full.any(axis=1, keepdims=True))
    attempt, out = 0, bins.copy()
    while len(row):
        donor = (mix(at.astype(np.uint64) * U(0x10001) + U((attempt * 0x9E3779B97F4A7C15 + 1) % (1 << 64))) % U(k)).astype(np.int64)
        found = full[row, donor]
        out[row[found], at[found]] = bins[row[found], donor[found]]
        row, at, attempt = row[~found], at[~found], attempt + 1
    return out


def signatures(row: np.ndarray, found: np.ndarray, n: int, k: int) -> np.ndarray:
    """n rows of k densified bins from the sorted (row, hash) pairs; rows without a shingle are 0."""
    bits = k.bit_length() - 1
    at = row * k + (found >> U(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1) != 0)
    bins, full = np.zeros(n * k, np.uint64), np.zeros(n * k, bool)
    bins[at[first]], full[at[first]] = found[first], True
    return densified(bins.reshape(n, k), full.reshape(n, k))


def banded(row: np.ndarray, found: np.ndarray, n: int, bands: int, rows: int) -> pa.ListArray:
    """The bucket of each band of n sets from their sorted (row, hash) pairs."""
    bins = signatures(row, found, n, bands * rows).reshape(-1, bands, rows)
    band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bins.shape[:2])
    for i in range(rows):
        band = mix(band * U(0x9E3779B97F4A7C15) + bins[:, :, i])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(band.view(np.int64).ravel()))


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, size of the set, digest of the word sequence, and the bucket of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [(b or b"").lower() for b in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in groups(every):
                texts = every[a:b]
                row, found = shingle_hashes(texts, words)
                sizes = np.bincount(row, minlength=len(texts))
                keys = banded(row, found, len(texts), BANDS, ROWS)
                digest = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), keys], ["doc_id", "n_shingles", "sequence", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """node, shingles (array of distinct hashes) of each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [(b or b"").lower() for b in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in groups(every):
                row, found = shingle_hashes(every[a:b], words)
                edge = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(edge), pa.array(found.view(np.int64)))], ["node", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose sets are at least so similar. b may be in very many pairs, a in few."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    sized = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return sized.where(F.col("shared") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def parities(sets: DataFrame) -> DataFrame:
    """node, size of its set, and for each of some four bins a hash whether an odd number of its hashes is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for hashes in batch.column(1):
                place = hashes.values.to_numpy().view(np.uint64)
                width = 1 << min(WIDEST, max(PARITY, (4 * len(place) - 1).bit_length()))
                odd = np.bincount((place % U(width)).astype(np.int64), minlength=width) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).tobytes())
            sizes = batch.column(1).value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(bits, pa.binary())], ["node", "n", "bits"])

    return sets.where(F.size("shingles") > 0).select("node", "shingles").mapInArrow(run, "node long, n long, bits binary")


def close_pairs(part: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of whole, adjacent groups that parities do not rule out: of two components, and of two blocks if the group has two.

    Sets that may be so similar have as many bins or twice as many; those of the larger are folded.
    """
    every = [part.column(c).to_numpy() for c in ("bucket", "one", "other", "own", "node", "component", "n")]
    wide = np.array([len(b) for b in part.column("bits").to_pylist()], np.int64)
    for width in np.unique(wide):
        rows = np.flatnonzero((wide == width) | (wide == 2 * width))
        bucket, one, other, own, node, component, n = (x[rows] for x in every)
        least = wide[rows] == width
        bits = np.empty((len(rows), width // 8), np.uint64)
        for i, raw in enumerate(part.column("bits").take(pa.array(rows)).to_pylist()):
            x = np.frombuffer(raw, np.uint64).reshape(-1, width // 8)
            bits[i] = x[0] if len(x) == 1 else x[0] ^ x[1]
        new = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(one) != 0) | (np.diff(other) != 0)) + 1
        edge = np.concatenate([[0], new, [len(n)]])
        end = np.repeat(edge[1:], np.diff(edge))
        a, gap, step = np.arange(len(n)), 0, max(1, 32_000_000 // int(width))
        while len(a):
            gap += 1
            a = a[a + gap < end[a]]
            b = a + gap
            most = (n[a] + n[b]) * (100 - percent)
            some = (component[a] != component[b]) & ((own[a] != own[b]) | (one[a] == other[a])) & (least[a] | least[b]) & (np.abs(n[a] - n[b]) * (100 + percent) <= most)
            x, y, most = a[some], b[some], most[some]
            for at in range(0, len(x), step):
                p, q = x[at : at + step], y[at : at + step]
                near = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64) * (100 + percent) <= most[at : at + step]
                if near.any():
                    yield node[p[near]], node[q[near]]


def still_open(members: DataFrame, least: int) -> DataFrame:
    """bucket, node, n, component, size, weight of the members(bucket, node, n, component) of buckets of at least so many that span components."""
    spans = members.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("component").alias("low"), F.max("component").alias("high"))
    spans = spans.where((F.col("low") < F.col("high")) & (F.col("size") >= least)).drop("low", "high")
    return members.select("bucket", "node", "n", "component").join(spans, "bucket").distinct()


def finer(big: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes of big(node, n, component) in buckets of longer keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                size = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                found = part.column(1).flatten().to_numpy().view(np.uint64)
                row = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((found, row))
                yield pa.RecordBatch.from_arrays([part.column(0), banded(row, found[order], len(size), FINE_BANDS, FINE_ROWS)], ["node", "bands"])

    nodes = big.select("node", "n", "component").distinct()
    keys = sets.select("node", "shingles").mapInArrow(run, "node long, bands array<long>")
    return nodes.join(keys, "node").select(F.explode("bands").alias("bucket"), "node", "n", "component")


def left_open(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair(a, b) of two components in one bucket of members(bucket, node, component, size, weight) that may be so similar."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_BYTES)).cast("int")
    dealt = members.select("bucket", "node", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int").alias("own"))
    met = dealt.join(parities(sets), "node").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("bucket", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("other"), "own", "node", "component", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[pa.Table]:
            rest: pa.Table | None = None
            for batch in batches:
                new = pa.Table.from_batches([batch])
                rest = new if rest is None else pa.concat_tables([rest, new])
                key = np.stack([rest.column(c).to_numpy() for c in ("bucket", "one", "other")])
                change = np.flatnonzero((np.diff(key) != 0).any(axis=0))
                if len(change):
                    yield rest.slice(0, change[-1] + 1)
                    rest = rest.slice(change[-1] + 1)
            if rest is not None and len(rest):
                yield rest

        held, count = [], 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held))
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for part in whole():
            for pair in close_pairs(part, percent):
                held.append(pair)
                count += len(pair[0])
                if count > PAIRS:
                    yield out()
                    held, count = [], 0
        if held:
            yield out()

    keys = ["bucket", "one", "other"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, start: DataFrame | None = None, steps: int | None = None) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links(a, b).

    start: labels to begin with. After ``steps`` steps the labels may still be larger ones of the component.
    """
    both = written(links.union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component"))
    if start is not None:
        labels = labels.join(start.withColumnRenamed("component", "before"), "node", "left").select("node", F.least("component", "before").alias("component"))
    labels, made = written(labels, "labels"), 0
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        lower = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "least").alias("to"))
        jumped = lower.join(labels.select(F.col("node").alias("to"), F.col("component").alias("beyond")), "to", "left")
        step = written(jumped.select("node", "was", F.least("to", F.coalesce("beyond", "to")).alias("component")), "labels")
        labels, made = step.select("node", "component"), made + 1
        if made == steps or not step.where("component <> was").take(1):
            return labels


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs(doc_id, text)."""
    rows = written(signed(docs, words), "signatures")
    named = rows.where("doc_id is not null and n_shingles > 0")
    nodes = named.groupBy("sequence").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x")).select("sequence", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n"), F.col("x.bands").alias("bands"))
    nodes = written(nodes, "nodes")
    placed = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = written(placed.join(sizes, "bucket"), "buckets")
    ids = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = written(sets_of(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), words).dropDuplicates(["node", "shingles"]), "sets")
    weight = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    members = shared.join(weight, "node").select("bucket", "node", "n", F.col("node").alias("component"), F.struct(-F.col("weight"), F.xxhash64("node"), "node", "n").alias("turn"))
    links, labels = None, None
    for turn in range(1, rounds + 1):
        centre = members.groupBy("bucket").agg(F.min_by(F.struct("node", "n", "component"), "turn").alias("centre"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        pairs = members.join(centre, "bucket").where((F.col("component") != F.col("centre.component")) & (100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n")))
        pairs = pairs.select(F.col("node").alias("a"), F.col("centre.node").alias("b")).distinct()
        new = written(confirmed(pairs, sets, percent), "confirmed")
        links = new if links is None else links.union(new)
        labels = components(links, labels, steps=2)
        members = shared.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"), F.struct(F.xxhash64("node", "bucket", F.lit(turn)), "node").alias("turn"))
    rest = written(still_open(members, 3), "open")  # the first star has compared the only pair of two
    big = rest.where(F.col("size") > MANY)
    if big.take(1):
        fine = finer(big, sets.join(big.select("node").distinct(), "node", "left_semi"))
        rest = written(rest.where(F.col("size") <= MANY).unionByName(still_open(fine, 2)), "open")
    new = written(confirmed(left_open(rest, sets.join(rest.select("node").distinct(), "node", "left_semi"), percent), sets, percent), "confirmed")
    labels = components(links.union(new), labels)
    found = nodes.join(labels, "node", "left").select("sequence", F.coalesce("component", "node").alias("found"))
    out = rows.select("doc_id", "n_shingles", "sequence").join(found, "sequence", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
