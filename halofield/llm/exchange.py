"""Which hash keys occur more than once in the corpus: a packed exchange between chunks of documents.

Documents are dealt into chunks by a hash of (doc_id, text). Each chunk sends the sorted set of its
64-bit keys to buckets by their leading bits, as blobs of coded differences (three to four bytes a
key); each bucket answers every chunk with one code a key. A chunk computes its keys again, in the
same order, to read the answers. A key is sent once by a chunk however often it occurs there, so a
key that fills a third of the corpus costs one entry a chunk, and no group of rows ever meets.

Chunks are functions of the rows alone and are sorted inside, so a task that runs again, on any
executor, sees and sends the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, text_bytes

CHUNK, KEYS_BITS = 8_000_000, 40
MANY = 256
U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 5)
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int, base: np.uint64, made: dict = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 to n - 1 modulo 2 ** 64, kept from call to call."""
    if len(made.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        made[base] = np.cumprod(out, dtype=np.uint64)
    return made[base][:n]


class Prefix:
    """Prefix polynomial hashes modulo 2 ** 64 of a sequence of values."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * powers(self.n, BASE), out=self.sums[1:])
        self.back = powers(self.n + 1, INVERSE)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of the values from start on, for each start; equal sequences get equal hashes."""
        return (self.sums[start + length] - self.sums[start]) * self.back[start]

    def rolling(self, length: int) -> np.ndarray:
        """Hash of each run of so many values."""
        m = max(0, self.n - length + 1)
        return (self.sums[length : length + m] - self.sums[:m]) * self.back[:m]


def pack(keys: np.ndarray, flags: np.ndarray, checks: np.ndarray) -> bytes:
    """Sorted keys as planes of the bytes of their differences, a byte of flags each, and their checks, if any."""
    import zstandard

    steps = np.diff(keys, prepend=U(0)) if len(keys) else keys
    wide = (int(steps.max()).bit_length() + 7) // 8 if len(keys) else 0
    planes = np.ascontiguousarray(steps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :wide].T
    return zstandard.ZstdCompressor(level=1).compress(bytes([wide, 8 * bool(len(checks))]) + planes.tobytes() + flags.astype(np.uint8).tobytes() + checks.astype("<u8").tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    wide, checked = int(raw[0]), int(raw[1])
    n = (len(raw) - 2) // (wide + 1 + checked)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :wide] = raw[2 : 2 + wide * n].reshape(wide, n).T
    flags, checks = np.split(raw[2 + wide * n :], [n])
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64), flags, np.frombuffer(checks.tobytes(), "<u8")


def distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct pair of key and check first stands, in order; each position's place among them; their counts."""
    if not len(checks):
        _, first, at, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        return first, at, counts
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    new = np.ones(len(keys), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at, np.bincount(at)


def chunked(docs: DataFrame, size: int = CHUNK) -> tuple[DataFrame, int, int]:
    """docs(doc_id, text) with its chunk, dealt out by chunk; the number of chunks; bytes of text."""
    total = text_bytes(docs)
    n = parts_for(total, size)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"), "doc_id", "text")
    return dealt.repartition(n, "chunk"), n, total


def rows_of(table: pa.Table) -> tuple[list, list[bytes]]:
    """doc_ids and UTF-8 texts of a chunk in an order that only depends on the rows; null is empty."""
    doc_id = table.column("doc_id").to_pylist()
    text = [b.as_py() or b"" for c in table.column("text").cast(pa.binary()).chunks for b in c]
    order = sorted(range(len(text)), key=lambda i: (doc_id[i] is not None, doc_id[i] or 0, text[i]))
    return [doc_id[i] for i in order], [text[i] for i in order]


class Sent:
    """The distinct keys of a chunk in order, and where each position's key stands among them.

    Keys with checks, 64 more bits each, are equal only if their checks are.
    """

    def __init__(self, keys: np.ndarray, marked: np.ndarray | None, buckets: int, width: int, checks: np.ndarray | None = None):
        bits = buckets.bit_length() - 1
        checks = np.zeros(0, np.uint64) if checks is None else checks
        first, self.at, counts = distinct(keys, checks)
        self.keys, self.checks = keys[first], checks[first] if len(checks) else checks
        self.flags = (counts > 1).astype(np.uint8)
        if marked is not None:
            any_marked = np.zeros(len(self.keys), np.uint8)
            any_marked[self.at[marked]] = 2
            self.flags |= any_marked
        self.bucket = (self.keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.keys), np.int64)
        self.low = (self.keys << U(bits)) >> U(64 - width)

    def rows(self, chunk: int) -> pa.Table:
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-2))
        blobs = [pack(self.low[a:b], self.flags[a:b], self.checks[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        bucket = self.bucket[edges[:-1]] if len(self.keys) else []
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array([chunk] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def read(self, answers: pa.Table) -> np.ndarray:
        """The code of each position: 0 once in the corpus, 1 repeated, 2 repeated MANY times or more."""
        import zstandard

        if not len(self.keys):
            return np.zeros(0, np.uint8)
        got = sorted(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()), key=lambda x: x[0])
        codes = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(b) for _, b in got), np.uint8)
        if len(codes) != len(self.keys):
            raise ValueError("a chunk's answers don't fit its keys")
        return codes[self.at]


SENT = "bucket int, chunk int, blob binary"


def answer(sent: DataFrame, need_marked: bool) -> DataFrame:
    """Answers (chunk, bucket, blob) to sent(bucket, chunk, blob).

    A key is repeated if it occurs at two places or more in the corpus; with need_marked one of the
    places must also be marked.
    """

    def meet(table: pa.Table) -> pa.Table:
        import zstandard

        order = np.argsort(table.column("chunk").to_numpy(), kind="stable")
        chunk, blob = table.column("chunk").to_numpy()[order], table.column("blob").to_pylist()
        got = [unpack(blob[i]) for i in order]
        sizes = [len(g[0]) for g in got]
        keys, flags, checks = (np.concatenate(parts) for parts in zip(*got))
        del got
        _, at, counts = distinct(keys, checks)
        times = np.bincount(at, 1 + (flags & 1), len(counts))
        code = (times >= 2).astype(np.uint8) + (times >= MANY)
        if need_marked:
            code[np.bincount(at, flags & 2, len(counts)) == 0] = 0
        code, edges, zip1 = code[at].astype(np.uint8), np.cumsum([0, *sizes]), zstandard.ZstdCompressor(level=1)
        out = [zip1.compress(code[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
        bucket = table.column("bucket").to_numpy()[order]
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "blob": pa.array(out, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(meet, "chunk int, bucket int, blob binary")


def buckets_for(total: int, each: int = 8_000_000) -> int:
    """A power of two: buckets for so many bytes of text."""
    return 1 << max(0, (parts_for(total, each) - 1).bit_length())


def groups(texts: list[bytes], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about so many bytes."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def per_chunk(dealt: DataFrame, work: Callable[[int, list, list[bytes]], pa.Table], schema: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        return work(table.column("chunk")[0].as_py(), *rows_of(table))

    return dealt.groupBy("chunk").applyInArrow(run, schema)


def with_answers(dealt: DataFrame, answers: list[DataFrame], work: Callable[..., pa.Table], schema: str) -> DataFrame:
    """Like per_chunk; work also gets the answers to the chunk, one table for each of answers."""
    both = [a.withColumn("round", F.lit(i)) for i, a in enumerate(answers)]
    got, n = both[0], len(both)
    for a in both[1:]:
        got = got.unionByName(a)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("answers without a chunk")
        rounds = right.column("round").to_numpy()
        tables = [right.filter(pa.array(rounds == i)) for i in range(n)]
        return work(left.column("chunk")[0].as_py(), *rows_of(left), *tables)

    return dealt.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(run, schema)
