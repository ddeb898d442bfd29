"""Repeated passages of words: fixed-block anchors.

Every document is cut into non-overlapping reference blocks of BLOCK words, the index. Every rolling
window of BLOCK words probes it. A repeated window of WINDOW = 2 * BLOCK - 1 words holds a whole block
of its own document, and that block equals a rolling window of the other place; so a window can only
be repeated if its own block was hit from elsewhere. Those windows are extended to their full
length: they meet in a second exchange, and the windows found there run together to the maximal
exact repeats. Both exchanges are packed (see exchange.py).

Words are what `[^\\x20\\x09-\\x0D]+` matches, unchanged. The first exchange only proposes. In the second,
windows are equal if the 56 bits of their hash beside the bucket's are, and another 64 bits, a digest
of the very bytes of their words, are too: 120 bits or more, by which two different windows among 10^13
(100 TB) would be taken for equal with a probability of under 10^-10.

Rules for unusual rows: a null text has no words; a document shorter than a window keeps all its
words; windows that overlap each other in one document count as two places; repeated rows are
copies of each other and both lose their words; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .exchange import BYTE, CHUNK, SENT, Prefix, Sent, U, answer, buckets_for, chunked, groups, mix, per_chunk, with_answers

WINDOW = 35
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>"
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and the number of words of each text."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in groups(texts):
        raw = np.frombuffer(b"\n".join([*texts[a:b], b""]), np.uint8)
        edge = np.flatnonzero(np.diff(SPACE[raw], prepend=True))
        start, end = edge[::2], edge[1::2]
        hashes.append(mix(Prefix(BYTE[raw]).of(start, end - start) + (end - start).astype(np.uint64)))
        upto = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts[a:b]]))
        counts.append(np.diff(upto, prepend=0))
    return np.concatenate(hashes), np.concatenate(counts)


class Words:
    """The words of a chunk's documents that are at least a window long, one after the other."""

    def __init__(self, texts: list[bytes], window: int):
        self.block = (window + 1) // 2
        hashes, self.counts = word_hashes(texts)
        self.long = self.counts >= window
        hashes = hashes[np.repeat(self.long, self.counts)]
        n = self.counts[self.long]
        self.ends = np.cumsum(n)
        start = np.repeat(self.ends - n, n)
        self.place, self.left = np.arange(len(hashes)) - start, np.repeat(self.ends, n) - np.arange(len(hashes))
        self.prefix = Prefix(hashes)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, key and whether it is a reference block, of every rolling window of a block's length."""
        at = np.flatnonzero(self.left >= self.block)
        return at, mix(self.prefix.of(at, self.block)), self.place[at] % self.block == 0

    def candidates(self, at: np.ndarray, hit: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and key of the windows whose own reference block was hit."""
        found = np.zeros(len(self.place) + self.block, bool)
        found[at[hit]] = True
        start = np.flatnonzero(self.left >= window)
        start = start[found[start + -self.place[start] % self.block]]
        return start, mix(self.prefix.of(start, window) ^ U(0x5851F42D4C957F2D))

    def digests(self, texts: list[bytes], start: np.ndarray, window: int, slice_of: int = 1 << 16) -> np.ndarray:
        """A digest of the words of each window as bytes, a space after each word."""
        from xxhash import xxh3_64_intdigest

        raw = np.frombuffer(b"\n".join([*compress(texts, self.long), b""]), np.uint8)
        inside = ~SPACE[raw]
        flat = np.where(inside, raw, np.uint8(0x20))[inside | np.append(False, inside)[: len(raw)]]
        edge = np.append(0, np.flatnonzero(flat == 0x20) + 1)
        flat, out = flat.tobytes(), np.empty(len(start), np.uint64)
        for i in range(0, len(start), slice_of):
            own = start[i : i + slice_of]
            spans = zip(edge[own].tolist(), edge[own + window].tolist())
            out[i : i + len(own)] = np.fromiter((xxh3_64_intdigest(flat[a:b]) for a, b in spans), np.uint64, len(own))
        return out


def repeated_passages(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row a document: words, words removed, digest of the rest, and the removed spans.

    spans: start and end (exclusive) of each removed run, in words, one after the other.
    """
    if window % 2 == 0:
        raise ValueError("the window must be odd: two blocks less a word")
    dealt, _, total = chunked(docs, chunk_bytes)
    buckets = buckets_for(total)

    def first(texts: list[bytes]) -> tuple[Words, np.ndarray, Sent]:
        words = Words(texts, window)
        at, keys, block = words.probes()
        return words, at, Sent(keys, block, buckets, 40)

    def second(texts: list[bytes], answers: pa.Table) -> tuple[Words, np.ndarray, Sent]:
        words, at, sent = first(texts)
        start, keys = words.candidates(at, sent.read(answers) > 0, window)
        return words, start, Sent(keys, None, buckets, 56, words.digests(texts, start, window))

    def send_first(chunk: int, doc_ids: list, texts: list[bytes]) -> pa.Table:
        return first(texts)[2].rows(chunk)

    def send_second(chunk: int, doc_ids: list, texts: list[bytes], answers: pa.Table) -> pa.Table:
        return second(texts, answers)[2].rows(chunk)

    def finish(chunk: int, doc_ids: list, texts: list[bytes], first_answers: pa.Table, second_answers: pa.Table) -> pa.Table:
        words, start, sent = second(texts, first_answers)
        start = start[sent.read(second_answers) > 0]
        steps = np.zeros(len(words.place) + 1, np.int64)
        np.add.at(steps, start, 1)
        np.add.at(steps, start + window, -1)
        gone = np.cumsum(steps)[:-1] > 0
        removed, digests, spans, at = [], [], [], iter(zip(words.ends - words.counts[words.long], words.ends))
        for text, is_long in zip(texts, words.long):
            kept, own = text.split(), None
            if is_long:
                a, b = next(at)
                own = gone[a:b]
            if own is not None and own.any():
                kept = list(compress(kept, ~own))
                removed.append(int(own.sum()))
                spans.append(np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist())
            else:
                removed.append(0)
                spans.append([])
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.list_(pa.int32()))})

    one = answer(per_chunk(dealt, send_first, SENT), need_marked=True)
    two = answer(with_answers(dealt, [one], send_second, SENT), need_marked=False)
    return with_answers(dealt, [one, two], finish, RESULT)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
