"""Word shingles as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def word_list(text: str) -> Column:
    """The words (runs of letters and digits, lower case) of a text column; null is empty."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_WORD), lambda w: w != "")


def words(text: str) -> Column:
    """Hashes of the words of a text column."""
    return F.transform(word_list(text), lambda w: F.xxhash64(w))


def runs(words: str, n: int) -> Column:
    """Starts of the runs of n words, from a column of words or of their hashes; none if there are fewer."""
    size = F.size(words)
    return F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))


def run_hashes(hashes: str, n: int) -> Column:
    """A hash of every run of n words, from the column of word hashes."""
    return F.transform(runs(hashes, n), lambda i: F.xxhash64(*(F.get(F.col(hashes), i + k) for k in range(n))))


def run_texts(words: str, n: int) -> Column:
    """Every run of n words as a text, the words parted by spaces."""
    return F.transform(runs(words, n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def shingles(hashes: str, n: int) -> Column:
    """A hash of every run of n words, from the column of word hashes.

    Fewer words than n, but at least one, give one shingle of them all; none give an empty array.
    """
    size = F.size(hashes)
    starts = F.when(size > 0, F.sequence(F.lit(0), F.greatest(size - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col(hashes), i + k) for k in range(n))))


def with_shingles(df, text: str, out: str, n: int):
    """df with the shingle hashes of a text column."""
    return df.withColumn("_words", words(text)).withColumn(out, shingles("_words", n)).drop("_words")
