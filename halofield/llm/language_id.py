"""Language identification by compression with per-language raw-content dictionaries.

A text is reduced to its letters (Unicode category L, with their marks) in lower case, cut into
blocks, and every block is compressed once with each language's dictionary; the language whose blocks
are smallest in total wins. The margin is the distance to the second. A narrow margin is a
rejection: under one byte, or under the model's share of the best size.

Learning takes a bounded sample: of every lang value the 2 * DICT_DOCS distinct labelled texts that come first
by a hash of the text, texts of at most LONGEST characters before all others. Texts teach whole or not at all; of a lang that has
none so short its shortest two do. Texts of odd rank fill the dictionary, as many as fit into DICT_BYTES (the first
in any case; less where so many languages would go beyond ALL_BYTES). Those of even rank with CLEAR bytes of letters
or more set the share: NARROW of the relative margin that all but one in a hundred of the rightly predicted ones exceed
(NARROW_DEFAULT where fewer than CALIBRATED are left). More than MOST_LANGUAGES lang values are an error.
Prediction reads nothing but the text, and all of it, in blocks, so a long text needs little memory
beside itself.

Rules for unusual rows: text null or without a letter gives `und`, score 0, rejected; rows with null
lang don't teach; equal texts of one lang teach once; equal sizes go to the language with more labelled
rows, then by name; without any labelled row everything is `und`; repeated rows each give a row; an
empty table gives an empty table. An input column called like one of the results is dropped, all
others are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DICT_BYTES, DICT_DOCS, LONGEST = 49_152, 48, 8192
ALL_BYTES, MOST_LANGUAGES = 64_000_000, 10_000
BLOCK, LEVEL = 1024, 6
NARROW, NARROW_DEFAULT, CALIBRATED, CLEAR = 0.1, 0.01, 20, 200
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
RESULTS = ["lang_pred", "score", "margin", "accepted"]


class Model(NamedTuple):
    """Dictionaries, most frequent language first; the share of the best size under which a margin is narrow."""

    dictionaries: list[tuple[str, bytes]]
    narrow: float = NARROW_DEFAULT


def letters(text: str | None) -> bytes:
    return " ".join(LETTERS.findall((text or "").lower())).encode()


def sample(rows: DataFrame) -> list[tuple[str, int, str]]:
    """(lang, rank, text) of the learning rows, most frequent language first, from rows(text, lang)."""
    labelled = rows.select("lang", "text").where("lang is not null and text is not null")
    spoken = labelled.where(F.col("text").rlike(r"\p{L}"))
    top = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(top) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    turn = {r["lang"]: i for i, r in enumerate(top)}
    size = F.length("text")
    keys = spoken.select("lang", F.when(size <= LONGEST, 0).otherwise(size).alias("late"), F.xxhash64("text").alias("place"))
    order = Window.partitionBy("lang").orderBy("late", "place")
    chosen = keys.distinct().withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= 2 * DICT_DOCS) & ((F.col("late") == 0) | (F.col("rank") <= 2)))
    # at most 2 * DICT_DOCS keys a language and MOST_LANGUAGES languages, so the broadcast is bounded
    texts = spoken.withColumn("place", F.xxhash64("text")).join(F.broadcast(chosen.select("lang", "place", "rank")), ["lang", "place"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    return sorted(((r["lang"], r["rank"], r["text"]) for r in texts.collect()), key=lambda r: (turn[r[0]], r[1]))


def learn(rows: DataFrame) -> Model:
    """The model from the labelled rows of rows(text, lang)."""
    chosen, held = sample(rows), {}
    most = min(DICT_BYTES, ALL_BYTES // max(1, len({lang for lang, _, _ in chosen})))
    for lang, rank, text in chosen:
        got, raw = held.setdefault(lang, bytearray()), letters(text)
        if rank % 2 and (not got or len(got) + len(raw) < most):
            got += raw + b" "
    dictionaries = [(k, bytes(v)) for k, v in held.items() if v]
    coders, shares = compressors(dictionaries), []
    for lang, rank, text in chosen:
        if rank % 2 == 0 and len(raw := letters(text)) >= CLEAR:
            name, _, gap, best = classified(raw, coders)
            if name == lang:
                shares.append(gap / best)
    narrow = NARROW * sorted(shares)[len(shares) // 100] if len(shares) >= CALIBRATED else NARROW_DEFAULT
    return Model(dictionaries, narrow)


def compressors(dictionaries: list[tuple[str, bytes]]) -> list[tuple]:
    """(language, compressing function) of each dictionary."""
    import zstandard as zstd

    out = []
    for name, content in dictionaries:
        d = zstd.ZstdCompressionDict(content.ljust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((name, zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress))
    return out


def classified(raw: bytes, coders: list[tuple]) -> tuple[str, float, int, int]:
    """Language, score, margin and best size of the letters of a text."""
    sizes = [sum(len(code(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for _, code in coders]
    best = min(sizes)
    first = sizes.index(best)
    gap = min((s - best for i, s in enumerate(sizes) if i != first), default=best)
    return coders[first][0], 1 / sum(math.exp((best - s) / 2) for s in sizes), gap, best


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (0 to 1), margin (bytes) and accepted."""
    kept = docs.select([c for c in docs.columns if c not in RESULTS])
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = compressors(model.dictionaries)
        for batch in batches:
            found = []
            for cell in batch.column(at):
                raw = letters(cell.as_py())
                if not raw or not coders:
                    found.append(("und", 0.0, 0, False))
                else:
                    name, score, gap, best = classified(raw, coders)
                    found.append((name, score, gap, gap >= max(1, model.narrow * best)))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.bool_())
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *RESULTS])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, margin long, accepted boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Learn on the rows of docs that aren't held out, predict on all."""
    return predict(docs, learn(docs.where(~held_out())))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), learn(docs.where(~held_out())))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), *RESULTS)
