"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item is found in a document if at least THRESHOLD of its distinct shingles of WORDS words occur
there, however long the document is. Column expressions only.

1. Documents are partitioned by size: with 2^p to 2^(p+1) shingles one has 2^(p+1) bins, numbered by
   the leading bits of a shingle's hash, and the least hash of each bin is its sketch. The load of a
   bin is at most one for every size, so a shingle is in the sketch of its document with a
   probability of 0.63 or more, in short and in long documents alike. Only sketches are looked up.
2. The bins of all sizes nest, so items need one table for all of them: each shingle with the
   smallest p from which on it is the least of its bin. One equal least hash makes a candidate. An
   item of SMALL shingles or more shares at least 13 with a document that contains it, and is missed
   with a probability of two in a million.
3. Items of fewer shingles go by their bottom-k MinHash, which loses nothing: of n shingles, need of
   them must occur, so one of the n - need + 1 least hashes does. Of a document, the hashes up to the
   largest of these are looked up, whether they are in its sketch or not. An item of fewer than WORDS
   words is one run of its own length, and is looked up among the document's runs of that length.
4. Candidates are verified on the words: the runs of candidate documents, as texts, are joined with
   those of the items and counted.

The items' tables are broadcast while they have at most BROADCAST rows, the candidates likewise;
beyond that both are shuffled.

Rules for unusual rows: null texts are empty and contain nothing; an item without a word is found
nowhere; rows that repeat a doc_id are told apart by their text, equal rows give one result; equal
items each give a result; a document that holds exactly the threshold's share counts as containing;
documents may be of any length, as nothing depends on it but the number of bins; other columns of
either table are ignored, whatever their names; empty tables give an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .shingles import run_hashes, run_texts, word_list

WORDS, THRESHOLD, SMALL, BROADCAST = 5, 0.8, 16, 1_000_000


def even(h: Column) -> Column:
    """A hash without its last bit, which flags the least ones of a bin."""
    return h.bitwiseAND(F.lit(-2))


def by_length(words: int, of, size: Column) -> Column:
    """of(n) for the run length n of an item of so many words: `words`, or all of them if there are fewer."""
    out = F.when(size >= words, of(words))
    for n in range(1, words):
        out = out.when(size == n, of(n))
    return out.otherwise(F.array())


def item_runs(items: DataFrame, words: int) -> DataFrame:
    """item_id, item (a number for each row), length of its runs, their hashes and their texts."""
    named = items.select("item_id", F.monotonically_increasing_id().alias("item"), word_list("text").alias("w")).withColumn("_h", F.transform("w", lambda w: F.xxhash64(w)))
    size = F.size("w")
    hashes = by_length(words, lambda n: F.transform(run_hashes("_h", n), even), size)
    made = named.select("item_id", "item", F.least(size, F.lit(words)).alias("length"), F.array_sort(F.array_distinct(hashes)).alias("sh"), F.array_distinct(by_length(words, lambda n: run_texts("w", n), size)).alias("texts"))
    return made.where("length > 0").withColumn("n_item", F.size("texts"))


def item_table(runs: DataFrame, words: int, threshold: float) -> DataFrame:
    """item, small, h, least_p of the shingles of each item that documents are asked for."""
    apart = lambda h, i: F.length(F.bin(h.bitwiseXOR(F.get(F.col("sh"), i - 1))))  # noqa: E731  64 less the leading bits in common
    placed = F.transform("sh", lambda h, i: F.struct(h.alias("h"), F.when(i == 0, F.lit(0)).otherwise(F.lit(64) - apart(h, i)).alias("least_p")))
    small = (F.col("n_item") < SMALL) | (F.col("length") < words)
    bottom = (F.size("sh") - F.ceil(F.lit(threshold) * F.size("sh") - 1e-9) + 1).cast("int")
    asked = F.when(small, F.slice(placed, F.lit(1), bottom)).otherwise(placed)
    return runs.select("item", "length", small.alias("small"), F.explode(asked).alias("x")).select("item", "length", "small", "x.h", "x.least_p")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("_text_key"), "text")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def probes(docs: DataFrame, words: int, bound: int | None, shorter: list[int]) -> DataFrame:
    """doc_id, _text_key, p, v of the hashes that are looked up; the last bit of v flags the least of a bin.

    bound: hashes up to it are looked up even if they are not in the sketch. shorter: lengths of items
    of fewer words.
    """
    sets = docs.withColumn("_h", F.transform(word_list("text"), lambda w: F.xxhash64(w))).withColumn("sh", F.sort_array(run_hashes("_h", words)))
    p = F.floor(F.log2(F.greatest(F.size("sh"), F.lit(1)))).cast("int")
    sized = sets.withColumn("p", p).withColumn("drop", (F.lit(63) - F.col("p")).cast("int"))
    bin_of = lambda h: F.call_function("shiftrightunsigned", h, F.col("drop"))  # noqa: E731  the leading p + 1 bits
    first = lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col("sh"), i - 1)))
    flagged = F.transform("sh", lambda h, i: F.when(first(h, i), even(h).bitwiseOR(F.lit(1).cast("long"))).otherwise(even(h)))
    own = lambda v: v.bitwiseAND(F.lit(1).cast("long")) == 1
    sketch = F.filter(flagged, own if bound is None else lambda v: own(v) | (v <= F.lit(bound)))
    short = [F.transform(run_hashes("_h", n), even) for n in shorter]
    return sized.select("doc_id", "_text_key", "p", F.explode(F.concat(sketch, *short)).alias("v"))


def contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, _text_key, item_id, n_item, n_shared, containment of every item found in docs(doc_id, text)."""
    runs = written(item_runs(items, words), "items")
    table = written(item_table(runs, words, threshold), "item-hashes")
    seen = table.where("small").groupBy("length").agg(F.max("h").alias("h")).collect()  # a row for each length up to `words`
    bound = max((r["h"] for r in seen if r["length"] == words), default=None)
    shorter = sorted(r["length"] for r in seen if r["length"] < words)
    of_sketch = (F.col("v").bitwiseAND(F.lit(1)) == 1) & (F.col("p") >= F.col("least_p"))
    met = probes(keyed(docs), words, bound, shorter).join(small(table, BROADCAST), (even(F.col("v")) == F.col("h")) & (F.col("small") | of_sketch))
    found = written(met.select("doc_id", "_text_key", "item").distinct(), "candidates")
    texts = small(found.select(F.coalesce("doc_id", F.lit(0)).alias("same"), "_text_key").distinct(), BROADCAST)
    whole = keyed(docs).withColumn("same", F.coalesce("doc_id", F.lit(0))).join(texts, ["same", "_text_key"], "left_semi")
    whole = whole.withColumn("w", word_list("text"))
    every = F.array_distinct(F.concat(*(run_texts("w", n) for n in [words, *shorter])))
    full = whole.select("doc_id", "_text_key", F.explode(every).alias("run")).distinct()
    wanted = small(runs.select("item", "item_id", "n_item", F.explode("texts").alias("run")), BROADCAST)
    shared = full.join(wanted, "run").groupBy("doc_id", "_text_key", "item").agg(F.first("item_id").alias("item_id"), F.first("n_item").alias("n_item"), F.count("*").alias("n_shared"))
    same = F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("s._text_key") == F.col("c._text_key")) & (F.col("s.item") == F.col("c.item"))
    sure = shared.alias("s").join(small(found, BROADCAST).alias("c"), same, "left_semi")
    share = F.col("n_shared") / F.col("n_item")
    return sure.where(share >= threshold).select("doc_id", "_text_key", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared", share.alias("containment"))


def probed_share(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> float:
    """Which share of the documents' runs of `words` words is looked up at all."""
    table = item_table(item_runs(items, words), words, threshold)
    bound = table.where((F.col("length") == words) & F.col("small")).agg(F.max("h")).first()[0]
    asked = probes(keyed(docs), words, bound, []).count()
    every = docs.select(F.sum(F.greatest(F.size(word_list("text")) - (words - 1), F.lit(0)))).first()[0]
    return asked / every if every else math.nan


def decontaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns."""
    hits = contaminated(docs, items, words, threshold).select(F.coalesce("doc_id", F.lit(0)).alias("same"), F.col("_text_key").alias("key")).distinct()
    same = (F.coalesce(docs["doc_id"], F.lit(0)) == hits["same"]) & (F.xxhash64(docs["text"]) == hits["key"])
    return docs.join(hits, same, "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items).drop("_text_key")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
v AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
l AS (SELECT DISTINCT least(len(w), 5) AS n FROM v WHERE len(w) > 0),
d AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, l WHERE len(w) >= n)),
b AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM v WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) / n_item >= 0.8
"""
