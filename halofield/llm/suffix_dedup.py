"""Exact substring removal by a sparse suffix sort with hash-compared suffixes.

Every string of LENGTH bytes that starts at two places is removed from both. All suffixes of a corpus
can't be sorted within a few times its size, so only those that may matter are.

1. Each window of LENGTH bytes names an anchor: the smallest hash among its substrings of ANCHOR
   bytes (the leftmost on a tie). Equal windows name equal anchors at the same offset, and about one
   position in seventy is named at all. The anchors' hashes meet in a packed exchange (exchange.py).
2. The windows around each anchor that occurs twice or more travel, as one stretch of bytes, to the
   anchor's bucket. Equal stretches, compared as bytes, settle each other. The suffixes that begin
   at the windows of the others are sorted: prefix polynomial hashes and binary search give the
   longest common extension of two suffixes, so one comparison takes log2(LENGTH) steps, and a
   mergesort, vectorized over all runs of a level, orders them. Neighbours in that order with an
   extension of LENGTH or more are compared as bytes before they count.
3. The repeated windows go back to their chunk, which removes what they cover.

Suffixes of one anchor and offset only are compared, as others can't be equal. An anchor that occurs
MANY times or more is split: windows of SLICE neighbouring offsets go together by the hash of the
bytes that all of them contain, so a frequent line doesn't gather all its surroundings in one group.
Equal stretches travel once a chunk.

Rules for unusual rows: a null text counts as empty; a document under LENGTH bytes keeps all of them;
places may overlap and may lie in one document; repeated rows are copies of each other and both lose
their bytes; what remains may end inside a character, so it is bytes; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .exchange import BYTE, CHUNK, SENT, Prefix, Sent, U, answer, buckets_for, chunked, mix, per_chunk, with_answers

LENGTH, ANCHOR, SLICE, PIECE = 200, 64, 16, 1 << 20
STRETCH = "bucket int, chunk int, uid int, key long, offset int, windows int, multi boolean, bytes binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of so many values: prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces(sizes: list[int], length: int, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of the joined texts and the windows' starts in each; a long text gives several that overlap."""
    ends = np.cumsum(sizes, dtype=np.int64)
    a, starts = 0, []
    for n, end in zip(sizes, ends.tolist()):
        begin = end - n
        if n >= length:
            for s in range(begin, end - length + 1, size):
                e = min(s + size, end - length + 1)
                if starts and e + length - 1 - a > size + length:
                    yield a, starts[-1][-1] + length, np.concatenate(starts) - a
                    starts = []
                if not starts:
                    a = s
                starts.append(np.arange(s, e))
    if starts:
        yield a, starts[-1][-1] + length, np.concatenate(starts) - a


class Stretches:
    """The stretches of windows that share an anchor, of one range of bytes."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, length: int, anchor: int):
        self.raw, self.length = raw, length
        self.prefix = Prefix(BYTE[raw])
        grams = mix(self.prefix.rolling(anchor))
        low = U((1 << 22) - 1)
        least = sliding_min(grams & ~low | np.arange(len(grams), dtype=np.uint64), length - anchor + 1)
        at = (least[starts] & low).astype(np.int64)
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-9) != 1))
        self.start, self.anchor = starts[new], at[new]
        self.windows = np.diff(new, append=len(starts))
        self.key = grams[self.anchor]

    def sliced(self, rows: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
        """key, first window, windows and offset of the given stretches, those of frequent anchors in slices."""
        start, n, key, anchor = self.start[rows], self.windows[rows], self.key[rows], self.anchor[rows]
        few = ~many
        parts = [(key[few], start[few], n[few], start[few] - anchor[few])]
        if many.any():
            own = np.repeat(np.flatnonzero(many), n[many])
            upto = np.cumsum(n[many])
            window = start[own] + np.arange(len(own)) - np.repeat(upto - n[many], n[many])
            piece = (window - anchor[own]) // SLICE
            new = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(piece, prepend=1 << 40) != 0))
            own, piece, first = own[new], piece[new], window[new]
            shared = anchor[own] + piece * SLICE + SLICE - 1
            common = mix(self.prefix.of(shared, self.length - SLICE + 1) + piece.astype(np.uint64))
            parts.append((mix(key[own] ^ common), first, np.diff(new, append=len(window)), first - anchor[own]))
        return tuple(np.concatenate(x) for x in zip(*parts))


def extension(prefix: Prefix, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Longest common extension, at most length, of the suffixes at a and b: binary search on hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        same = prefix.of(a, middle) == prefix.of(b, middle)
        low = np.where(same & open_, middle, low)
        high = np.where(same | ~open_, high, middle - 1)
    return low


def suffix_sort(raw: np.ndarray, prefix: Prefix, start: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """Order the suffixes at start inside each segment (numbers that don't fall); the new order.

    Bottom-up mergesort. At each level the rank of every suffix in the run beside its own comes from
    a binary search there, all suffixes at once; a comparison is one extension and one byte.
    """
    first = np.flatnonzero(np.diff(segment, prepend=-1) != 0)
    size = np.diff(first, append=len(segment))
    base, size = np.repeat(first, size), np.repeat(size, size)
    place = np.arange(len(start)) - base
    order, width = np.arange(len(start)), 1
    while width < (size.max() if len(size) else 0):
        run = place // width
        other = (run ^ 1) * width
        busy = np.flatnonzero((other < size) | (run % 2 == 1))
        low, high = np.minimum(other[busy], size[busy]), np.minimum(other[busy] + width, size[busy])
        from_, right = low.copy(), run[busy] % 2 == 1
        own = start[order[busy]]
        while (live := np.flatnonzero(low < high)).size:
            middle = (low[live] + high[live]) // 2
            with_ = start[order[base[busy[live]] + middle]]
            far = extension(prefix, with_, own[live], length)
            a, b = raw[np.minimum(with_ + far, len(raw) - 1)], raw[np.minimum(own[live] + far, len(raw) - 1)]
            before = np.where(far >= length, right[live], a < b)  # on a tie the left run goes first
            low[live] = np.where(before, middle + 1, low[live])
            high[live] = np.where(before, high[live], middle)
        to = place.copy()
        to[busy] = (run[busy] // 2) * 2 * width + place[busy] - run[busy] * width + low - from_
        moved = np.empty_like(order)
        moved[base + to] = order
        order, width = moved, width * 2
    return order


def repeated_windows(key: np.ndarray, offset: np.ndarray, windows: np.ndarray, multi: np.ndarray, stretch: list[bytes], length: int) -> list[np.ndarray]:
    """For each stretch which of its windows occur elsewhere among the stretches of its key."""
    classes: dict[tuple, list[int]] = {}
    for i, x in enumerate(zip(key.tolist(), offset.tolist(), stretch)):
        classes.setdefault(x, []).append(i)
    members = list(classes.values())
    one = np.array([m[0] for m in members])
    twice = np.array([len(m) > 1 or bool(multi[m[0]]) for m in members])
    found = [np.full(windows[i], t) for i, t in zip(one, twice)]
    _, at, counts = np.unique(key[one], return_inverse=True, return_counts=True)
    for some in batches(np.flatnonzero(counts[at] > 1), at, windows[one]):
        raw = np.frombuffer(b"".join(stretch[one[c]] for c in some), np.uint8)
        n = windows[one[some]]
        begin = np.cumsum([0, *(len(stretch[one[c]]) for c in some[:-1])])
        row = np.repeat(np.arange(len(some)), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        d = offset[one[some]][row] + j
        order = np.lexsort((d, at[some][row]))
        group = at[some][row][order] * (4 * length) + d[order] + 2 * length
        new = np.diff(group, prepend=-1) != 0
        beside = ~new | ~np.append(new[1:], True)  # segments of more than one suffix
        order, group = order[beside], group[beside]
        start = begin[row[order]] + j[order]
        prefix = Prefix(BYTE[raw])
        done = suffix_sort(raw, prefix, start, group, length)
        s, g = start[done], group[done]
        pair = np.flatnonzero(g[1:] == g[:-1])
        pair = pair[prefix.of(s[pair], length) == prefix.of(s[pair + 1], length)]
        view = np.lib.stride_tricks.sliding_window_view(raw, length)
        for p in np.array_split(pair, len(pair) // 20_000 + 1):
            p = p[(view[s[p]] == view[s[p + 1]]).all(axis=1)]  # a collision of hashes doesn't count
            for q in (done[p], done[p + 1]):
                for c, w in zip(row[order[q]].tolist(), j[order[q]].tolist()):
                    found[some[c]][w] = True
    out: list = [None] * len(stretch)
    for m, f in zip(members, found):
        for i in m:
            out[i] = f
    return out


def batches(rows: np.ndarray, group: np.ndarray, weight: np.ndarray, most: int = 400_000) -> Iterator[np.ndarray]:
    """rows in parts that keep groups together, of about so much weight."""
    rows = rows[np.argsort(group[rows], kind="stable")]
    part = np.cumsum(weight[rows]) // most
    if len(rows):
        first = np.flatnonzero(np.diff(group[rows], prepend=-1))
        part = np.repeat(part[first], np.diff(first, append=len(rows)))
        yield from np.split(rows, np.flatnonzero(np.diff(part)) + 1)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row a document: bytes, bytes removed, removed runs, digest of the rest, and the runs' spans.

    spans: start and end (exclusive) of each removed run, in bytes, one after the other.
    """
    dealt, _, total = chunked(docs, chunk_bytes)
    buckets, stretch_buckets = buckets_for(total), buckets_for(total, 4_000_000)

    def stretches(texts: list[bytes]) -> Iterator[tuple[int, Stretches]]:
        joined = np.frombuffer(b"".join(texts), np.uint8)
        for a, b, starts in pieces([len(t) for t in texts], length):
            yield a, Stretches(joined[a:b], starts, length, anchor)

    def anchors(texts: list[bytes]) -> Sent:
        keys = [s.key for _, s in stretches(texts)]
        return Sent(np.concatenate([np.zeros(0, np.uint64), *keys]), None, buckets, 48)

    def send_anchors(chunk: int, doc_ids: list, texts: list[bytes]) -> pa.Table:
        return anchors(texts).rows(chunk)

    def repeated(texts: list[bytes], answers: pa.Table) -> tuple[list, list, list]:
        """The distinct stretches (with a sign if they come twice), and which of them stands where."""
        code, upto = anchors(texts).read(answers), 0
        known: dict[tuple, int] = {}
        rows, times, at = [], [], []
        for a, s in stretches(texts):
            own = code[upto : upto + len(s.key)]
            upto += len(s.key)
            hit = np.flatnonzero(own > 0)
            key, start, n, offset = s.sliced(hit, own[hit] > 1)
            raw = s.raw.tobytes()
            for k, b, w, o in zip(key.view(np.int64).tolist(), start.tolist(), n.tolist(), offset.tolist()):
                row = (k, o, w, raw[b : b + w - 1 + length])
                uid = known.setdefault(row, len(rows))
                if uid == len(rows):
                    rows.append(row)
                    times.append(0)
                times[uid] += 1
                at.append((uid, a + b))
        return rows, times, at

    def send_stretches(chunk: int, doc_ids: list, texts: list[bytes], answers: pa.Table) -> pa.Table:
        rows, times, _ = repeated(texts, answers)
        key, offset, windows, raw = zip(*rows) if rows else ((), (), (), ())
        key_ = np.array(key, np.int64)
        bucket = (mix(key_.view(np.uint64) ^ U(0x2545F4914F6CDD1D)) % U(stretch_buckets)).astype(np.int32)
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "uid": pa.array(range(len(rows)), pa.int32()), "key": pa.array(key_), "offset": pa.array(offset, pa.int32()), "windows": pa.array(windows, pa.int32()), "multi": pa.array([t > 1 for t in times], pa.bool_()), "bytes": pa.array(raw, pa.binary())})

    def settle(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("chunk", "uid", "key", "offset", "windows", "multi")}
        found = repeated_windows(columns["key"], columns["offset"], columns["windows"], columns["multi"], table.column("bytes").to_pylist(), length)
        runs: dict[int, list] = {}
        for c, u, f in zip(columns["chunk"].tolist(), columns["uid"].tolist(), found):
            if f.all():
                runs.setdefault(c, []).append((u, 0, len(f)))
            elif f.any():
                edge = np.flatnonzero(np.diff(f.astype(np.int8), prepend=0, append=0)).tolist()
                runs.setdefault(c, []).extend((u, a, b) for a, b in zip(edge[::2], edge[1::2]))
        blobs = [np.array(r, "<i4").tobytes() for r in runs.values()]
        return pa.table({"chunk": pa.array(runs.keys(), pa.int32()), "bucket": pa.array([0] * len(runs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def finish(chunk: int, doc_ids: list, texts: list[bytes], answers: pa.Table, settled: pa.Table) -> pa.Table:
        rows, _, at = repeated(texts, answers)
        runs = np.concatenate([np.zeros((0, 3), "<i4"), *(np.frombuffer(b, "<i4").reshape(-1, 3) for b in settled.column("blob").to_pylist())])
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        edge = np.searchsorted(runs[:, 0], np.arange(len(rows) + 1))
        steps = np.zeros(sum(map(len, texts)) + 1, np.int64)
        for uid, start in at:
            for _, a, b in runs[edge[uid] : edge[uid + 1]].tolist():
                steps[start + a] += 1
                steps[start + b - 1 + length] -= 1
        gone = np.cumsum(steps)[:-1] > 0
        removed, spans, digests, a = [], [], [], 0
        for text in texts:
            own = gone[a : a + len(text)]
            a += len(text)
            removed.append(int(own.sum()))
            cut = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist() if removed[-1] else []
            spans.append(cut)
            digests.append(hashlib.sha256(b"".join(text[x:y] for x, y in zip([0, *cut[1::2]], [*cut[::2], len(text)]))).hexdigest())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(s) // 2 for s in spans], pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.list_(pa.int64()))})

    codes = answer(per_chunk(dealt, send_anchors, SENT), need_marked=False)
    sent = with_answers(dealt, [codes], send_stretches, STRETCH)
    settled = sent.groupBy("bucket").applyInArrow(settle, SENT.replace("bucket int, chunk int", "chunk int, bucket int"))
    return with_answers(dealt, [codes, settled.select("chunk", "bucket", "blob")], finish, RESULT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
