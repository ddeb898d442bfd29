"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, fingerprints, language_id, merkle, minhash_dedup, oracles, resample, secret_scan, sentence_pieces, substring_dedup, suffix_dedup, token_files, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_token_files": token_files.op1_token_files,
        "op2_language_id": language_id.op2_language_id,
        "op3_byte_bpe": byte_bpe.op3_byte_bpe,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_minhash_dedup": minhash_dedup.op6_minhash_dedup,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "op10_warc": warc.op10_warc,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_sentence_pieces": sentence_pieces.op12_sentence_pieces,
        "op13_resample": resample.op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_suffix_dedup": oracles.SUFFIX,
        "op5_substring_dedup": oracles.SUBSTRING,
        "op6_minhash_dedup": oracles.NEAR_DUPLICATES,
        "op8_decontaminate": decontaminate.ORACLE,
        "op10_warc": oracles.WARC,
        "op11_merkle_manifest": oracles.MERKLE,
        "op13_resample": oracles.RESAMPLE,
    }
