"""A corpus pipeline of five stages over documents; each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from halofield.llm import byte_bpe, decontaminate, language_id, minhash_dedup, secret_scan
from halofield.llm.common import read_table, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; lang becomes the predicted one."""
    found = language_id.identify(docs).where("accepted")
    return found.withColumn("lang", found["lang_pred"]).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    kept = minhash_dedup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of benchmark."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the names of their kinds."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's ids and of the bytes they decode to."""
    import public_tokenizers as P

    return byte_bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("language ID", languages),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secrets),
    ("byte-level BPE", tokens),
]

#: SQL has no compressor, no byte-pair merges and no connected components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
