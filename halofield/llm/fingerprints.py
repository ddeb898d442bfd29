"""Document fingerprints: one-permutation MinHash, packed low bits, column expressions only.

Each shingle of WORDS words is hashed once; the leading bits name one of BINS bins and the least hash
of a bin is kept. To get all bins in order from one sort, the largest value of every bin is sorted in
with the hashes; a bin that has nothing else is empty. An empty bin i takes the value of a full one:
the first that its probes h(i, 1), h(i, 2) ... meet, and after PROBES of them the full bin j with the
least h(i, j). Both orders depend on i alone, so two documents that miss the same bins look in the
same places (optimal densification). The BITS lowest bits of every bin are packed, 16 bins to a long.

Two fingerprints that agree in a share m of the bins have the likeness (m - c) / (1 - c), c =
2 ** -BITS being the share in which unrelated ones agree; below 0 it counts as 0.

Rules for unusual rows: a null text is empty; a text without a word has an empty fingerprint, alike
(1) to another empty one and to nothing else (0); a text of fewer words than a shingle has one
shingle. Documents stand in descending order of doc_id, null ones last; texts that share a doc_id
stand in descending order of a hash; equal rows stand in one place and give equal rows. The last is
followed by the first, so a single document is followed by itself. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .shingles import with_shingles

WORDS, BINS, BITS, PROBES = 5, 256, 4, 8
REST = (1 << 56) - 1  # what is left of a hash below its bin
LAST = [((b << 56) | REST) - (1 << 64 if b >= 128 else 0) for b in range(BINS)]
NO_ID = -(1 << 63)


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 56)


def empty(h: Column) -> Column:
    return h.bitwiseAND(F.lit(REST)) == REST


def fingerprint(df: DataFrame, text: str, out: str, words: int = WORDS) -> DataFrame:
    """df with the packed fingerprint (array<long>) of a text column; null where the text has no word."""
    df = with_shingles(df, text, "_sh", words).withColumn("_sh", F.sort_array(F.concat("_sh", F.array(*map(F.lit, LAST)))))
    least = F.filter("_sh", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col("_sh"), i - 1))))
    df = df.withColumn("_least", least).withColumn("_full", F.filter("_least", lambda h: ~empty(h)))
    probe = lambda i, t: F.get(F.col("_least"), F.pmod(F.xxhash64(i, t), F.lit(BINS)).cast("int"))
    probed = lambda i: F.get(F.filter(F.transform(F.array(*map(F.lit, range(1, PROBES + 1))), lambda t: probe(i, t)), lambda h: ~empty(h)), F.lit(0))
    ranked = lambda i: F.array_min(F.transform("_full", lambda h: F.struct(F.xxhash64(i, bin_of(h), F.lit("rank")).alias("r"), h.alias("h"))))["h"]
    dense = F.transform("_least", lambda h, i: F.when(empty(h), F.coalesce(probed(i), ranked(i))).otherwise(h))
    df = df.withColumn("_dense", F.when(F.size("_full") > 0, dense))
    packed = F.transform(F.array(*map(F.lit, range(1, BINS, 16))), lambda a: F.aggregate(F.slice("_dense", a, 16), F.lit(0).cast("long"), lambda s, h: F.shiftleft(s, BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << BITS) - 1)))))
    return df.withColumn(out, F.when(F.col("_dense").isNotNull(), packed)).drop("_sh", "_least", "_full", "_dense")


def as_text(packed: str) -> Column:
    """A packed fingerprint in lower-case hex; empty for null."""
    return F.coalesce(F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """The estimated resemblance of two packed fingerprints."""
    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    other = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, n: s + n)
    chance = 2.0**-BITS
    share = (F.lit(1.0) - other / F.lit(float(BINS)) - chance) / (1 - chance)
    both_empty = F.col(a).isNull() & F.col(b).isNull()
    return F.when(both_empty, 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(F.greatest(share, F.lit(0.0)))


def followers(ids: DataFrame) -> DataFrame:
    """id, key, n_chars and the next document's next_id, next_key, from distinct ids(id, key, n_chars).

    Ranges of the order are windows of their own; the one row a range that follows the last of the
    range before is found among the first rows of the ranges, one a partition, and broadcast.
    """
    # two tables, so that the numbers of the partitions are read and not computed again
    placed = written(ids.repartitionByRange(F.desc("id"), F.desc("key")).withColumn("range", F.spark_partition_id()), "ranges")
    heads = placed.groupBy("range").agg(F.max(F.struct("id", "key")).alias("head"))
    around = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("range", F.coalesce(F.lead("head").over(Window.orderBy("range")), F.first("head").over(around)).alias("following"))
    inside = Window.partitionBy("range").orderBy(F.desc("id"), F.desc("key"))
    led = placed.withColumn("next", F.lead(F.struct("id", "key")).over(inside)).join(F.broadcast(heads), "range")
    to = F.coalesce("next", "following")
    return written(led.select("id", "key", "n_chars", to["id"].alias("next_id"), to["key"].alias("next_key")), "followers")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprints of docs(doc_id, text), of their edited texts, and their likeness.

    The edited text has its second half (the smaller one) replaced by the first half of the next
    document. Only the characters that an edit needs travel to it.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    order = followers(texts.select("id", "key", F.length("text").cast("long").alias("n_chars")).distinct())
    half = F.floor(F.col("n_chars") / 2).cast("int")
    asked = order.select(F.col("next_id").alias("id"), F.col("next_key").alias("key"), F.struct(F.col("id").alias("to_id"), F.col("key").alias("to_key"), half.alias("need")).alias("to"))
    # equal rows are sorted next to each other by the join, so one of them is taken without an exchange
    given = texts.join(asked, ["id", "key"]).groupBy("id", "key").agg(F.first("to").alias("to"), F.first(F.expr("substring(text, 1, to.need)")).alias("piece"))
    given = given.select(F.col("to.to_id").alias("id"), F.col("to.to_key").alias("key"), "piece")
    n = F.length("text")
    pairs = texts.join(given, ["id", "key"]).withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("piece")))
    made = pairs.select("id", "key", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    made = fingerprint(fingerprint(made, "text", "own"), "edited", "other").select("id", "key", "n_chars", "edited_sha256", "own", "other")
    made = written(made, "fingerprints")
    following = made.select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("own").alias("following")).dropDuplicates(["next_id", "next_key"])
    out = made.join(order.drop("n_chars"), ["id", "key"]).join(following, ["next_id", "next_key"])
    doc_id = F.when(F.col("id") != NO_ID, F.col("id"))
    return out.select(doc_id.alias("doc_id"), "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "following").alias("near_next"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
