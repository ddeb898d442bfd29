"""Importance resampling towards a target: hashed word n-grams, bucket gains, and a draw without replacement.

Each task numbers the words of its texts and sorts their suffixes by the first three words (a suffix
array whose order stops there: longer prefixes are never asked for; texts end in a mark that is no word). Neighbours in that order
with a common prefix of k words or more are the runs of one k-gram. A run is hashed once, from the CRC-32 of its
words put together arithmetically, and its bucket goes back to all its occurrences; nothing is hashed
per occurrence and no n-gram is ever shuffled. What leaves a task is a count a bucket, then a sum a text.

The gains of 10,000 buckets are the only model, so its size doesn't depend on the data. The draw adds
a Gumbel variable, a function of the doc_id alone, to each weight and takes the highest sums: a
sample without replacement with chances in proportion to exp(weight / 1000). Ranks come from the ranges of a range exchange.

Rules for unusual rows: a null or empty text, or one without words, has no features and weight 0. Rows
that repeat a doc_id are drawn on their own; among equal scores the smaller doc_id goes first (null
before all), then the smaller number of features; beyond that rows are interchangeable. A null doc_id counts as an empty one in its hash. Words
of any length and texts of any length are taken whole: a long text is worked through in stretches of
words that look two words ahead. Empty tables give no rows; with an empty target t and T are 0. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, read_table, written

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
STRETCH, BATCH_BYTES, EACH = 400_000, 4_000_000, 500_000
#: What separates words becomes a space, A-Z becomes lower case; bytes from 0x80 on belong to words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def crc_step(v: np.ndarray) -> np.ndarray:
    """CRC-32's register after another zero byte."""
    v = v.astype(np.uint32)
    for _ in range(8):
        v = np.where(v & 1, (v >> 1) ^ np.uint32(0xEDB88320), v >> 1).astype(np.uint32)
    return v


def apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A linear map of registers, given as a table of its values for each byte of the register."""
    return table[0][v & 255] ^ table[1][(v >> 8) & 255] ^ table[2][(v >> 16) & 255] ^ table[3][v >> 24]


class Zeros:
    """Tables of the maps that so many zero bytes make of a register."""

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        self.powers = [np.stack([crc_step(byte << np.uint32(8 * j)) for j in range(4)])]
        self.made: dict[int, np.ndarray] = {}

    def table(self, n: int) -> np.ndarray:
        if n not in self.made:
            out, k, left = None, 0, n
            while left:
                if len(self.powers) <= k:
                    self.powers.append(apply(self.powers[-1], self.powers[-1]))
                if left & 1:
                    out = self.powers[k] if out is None else apply(self.powers[k], out)
                k, left = k + 1, left >> 1
            if n > 200:
                return out
            self.made[n] = out
        return self.made[n]


ZEROS = Zeros()


def joined_crc(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings from the first's, the second's and the second's length."""
    sizes, which = np.unique(n, return_inverse=True)
    tables = np.stack([ZEROS.table(int(s)) for s in sizes]) if len(sizes) else np.zeros((0, 4, 256), np.uint32)
    out = second.copy()
    for j in range(4):
        out ^= tables[which, j, (first >> np.uint32(8 * j)) & np.uint32(255)]
    return out


class Words:
    """The words of several texts, numbered, with the CRC-32 of each distinct one."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer((b"\n".join(texts) + b"\n").translate(LETTERS), np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = data != 32
        steps = np.diff(inside)
        starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        self.n = len(starts)
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(starts, edges)  # the first word of each text
        self.of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        bounds = np.empty(2 * self.n + 1, np.int64)
        bounds[0:-1:2], bounds[1::2], bounds[-1] = starts, ends, len(data)
        spans = pa.Array.from_buffers(pa.large_binary(), 2 * self.n, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = spans.take(pa.array(np.arange(0, 2 * self.n, 2))).dictionary_encode()
        self.id = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        self.spaced = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))

    def buckets(self, lo: int, hi: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For k from 1 on: the words from lo to hi that begin a k-gram, and its bucket."""
        at = np.arange(lo, hi)
        columns = []
        for k in range(LONGEST):
            there = np.minimum(at + k, self.n - 1)
            columns.append(np.where((at + k < self.n) & (self.of[there] == self.of[at]), self.id[there], -1))
        order = np.lexsort(columns[::-1])
        sorted_ = [c[order] for c in columns]
        common = np.ones(max(0, len(order) - 1), bool)
        out, crc = [], None
        for k, column in enumerate(sorted_):
            common &= column[1:] == column[:-1]  # neighbours that share k + 1 words
            head = np.concatenate([np.ones(min(1, len(order)), bool), ~common])
            run = np.cumsum(head) - 1
            word = column[head]
            if k == 0:
                hashed = self.crc[word]
            else:
                # a run of k words is parted into runs of k + 1, each with its own next word
                hashed = joined_crc(crc[parent[head]], self.spaced[word], self.size[word] + 1)
            bucket = np.empty(len(order), np.int64)
            bucket[order] = (hashed % buckets).astype(np.int64)[run]
            whole = columns[k] >= 0
            out.append((at[whole], bucket[whole]))
            crc, parent = hashed, run
        return out

    def stretches(self, buckets: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        for lo in range(0, self.n, STRETCH):
            yield self.buckets(lo, min(self.n, lo + STRETCH), buckets)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """doc_ids and texts, a few megabytes at a time."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
            ids.append(doc_id)
            texts.append(raw)
            held += len(raw)
            if held >= BATCH_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; a task sends a count a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, some in batches_of(batches):
            for stretch in Words(some).stretches(buckets):
                for _, bucket in stretch:
                    total += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    given = texts.select(F.lit(None).cast("long").alias("doc_id"), F.col(column).alias("text"))
    return given.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) of each bucket: so many numbers, whatever the data."""
    spark = corpus.sparkSession
    s, t = (written(bucket_counts(d, buckets=buckets), name) for d, name in ((corpus, "bucket-counts"), (target, "target-counts")))
    totals = s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("S")).crossJoin(t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("T"))).first()
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    ratio = (F.col("t") + 1.0) * F.lit(float(totals["S"] + buckets)) / ((F.col("s") + 1.0) * F.lit(float(totals["T"] + buckets)))
    out = np.zeros(buckets, np.int64)
    for row in both.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).toLocalIterator():
        out[row["bucket"]] = row["gain"]
    return out


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches_of(batches):
            words = Words(texts)
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for stretch in words.stretches(len(gain)):
                for at, bucket in stretch:
                    of = words.of[at]
                    n += np.bincount(of, minlength=len(texts))
                    # whole numbers below 2 ** 53 add up exactly
                    weight += np.bincount(of, gain[bucket], len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(words.first)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int):
    """floor of a thousandfold Gumbel variable from the digest of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Every row's doc_id, n_features, weight, score, rank (null if not drawn) and n_words.

    Of the N rows with at least least_words words floor(percent * N / 100) are drawn.
    """
    scored = weights(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    # a number of its own, so that even equal rows spread over ranges
    scored = written(scored.withColumn("_row", F.monotonically_increasing_id()), "weights")
    n, fit = scored.agg(F.count("*"), F.count_if(F.col("n_words") >= least_words)).first()
    order = [F.col("n_words") < least_words, F.desc("score"), "doc_id", "n_features", "_row"]
    parts = parts_for(n, EACH, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("_p", F.shiftright("_i", 33))
    # one row a range
    before = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    place = F.col("_before") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = percent * fit // 100
    return ranged.join(before, "_p").select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"), "n_words")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
