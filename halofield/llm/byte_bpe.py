"""Byte-level BPE with a local rank file: encode whole texts, decode the ids to raw bytes.

Long texts are cut before the library sees them, at places where its pattern always starts a new
match: between a printable ASCII character and a space or a line feed that follows it. No
alternative of the pattern lets white space follow another character within one match, and the only
look-ahead belongs to runs of white space, which such a cut never divides. A piece without such a
place stays whole. The ids of the pieces in order are the ids of the text.

Rules for unusual rows: a null text counts as empty (no ids); repeated rows each give a row; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CUT = re.compile(r"(?<=[!-~])[ \n]")
CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def safe_pieces(text: str, size: int) -> Iterator[str]:
    """Pieces of about size characters, cut only where a match of the pattern must begin."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class ByteBPE:
    """tiktoken's encoding over a rank file; no special tokens."""

    def __init__(self, path: str, pattern: str, piece: int = 50_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.coding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece = piece

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.piece:
            return self.coding.encode_ordinary(text)
        return [i for p in safe_pieces(text, self.piece) for i in self.coding.encode_ordinary(p)]

    def decode(self, ids: list[int]) -> bytes:
        return self.coding.decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or ByteBPE(path, pattern)
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = pa.array([bpe.encode(t or "") for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) of every row of coded(doc_id, ids); null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or ByteBPE(path, pattern)
            raw = pa.array([bpe.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], ["doc_id", "bytes"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and digest both in one pass; the ids never leave the Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or ByteBPE(path, pattern)
            n, ids_sha, raw_sha = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, CODED)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
