"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text gets a leading space, spaces become U+2581, and its characters become symbols. An agenda holds
the adjacent pairs of symbols whose joined text is a piece, the best score first and the leftmost
among equals; taking one merges the pair and enters its new neighbours. Symbols that are no piece at
the end are written as their bytes. Where no two characters on either side of a place ever follow each other inside a
piece, no pair spans it, so the ids of a text are those of its stretches in order, and each distinct
stretch is merged once and kept. The places come from the vocabulary: characters that follow each other in a piece are
of one kind, the kind with most characters and all others are the two sorts of stretches, and U+2581 begins a new
one (if it ever follows another character in a piece, a text stays whole).
The agendas of short stretches advance side by side in arrays, that of a long one is a heap; both take pairs in the same order.

Models whose rules differ (not BPE, a normalizer other than the identity, user-defined or unused
pieces, no byte fallback) are refused rather than encoded wrongly.

Rules for unusual rows: a null text counts as empty (the end id alone); repeated rows each give a
row; an empty table gives an empty table; other columns, whatever their names, are ignored. A very
long text is one row and is never cut: its stretches are looked up one by one, and a long stretch
without a space costs n log n. Among pairs of one score the leftmost goes first, so there are no other ties.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .token_files import held, with_end

SPACE = "▁"
#: Stretches up to so many characters are merged side by side. The id of no piece, and the order of no pair.
SHORT, NONE, NEVER = 40, 1 << 20, np.iinfo(np.int32).max
CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, checked boolean"
NORMAL, CONTROL, BYTE = 1, 3, 6


def kinds_of(pieces: Iterable[str]) -> np.ndarray | None:
    """The kind of each code point: 2 for U+2581, 1 for the kind with most characters, 0 for others; None if texts must stay whole."""
    kind: dict[str, str] = {}

    def of(c: str) -> str:
        while kind.setdefault(c, c) != c:
            kind[c] = c = kind[kind[c]]
        return c

    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            if b == SPACE != a:
                return None
            if a != SPACE:
                kind[of(a)] = of(b)
    kinds: dict[str, list[str]] = {}
    for c in sorted(kind):
        kinds.setdefault(of(c), []).append(c)
    out = np.zeros(0x110000, np.int8)
    out[[ord(c) for c in max(kinds.values(), key=len, default=[])]] = 1
    out[ord(SPACE)] = 2
    return out


class PieceModel:
    """Merges and decoding of one model file; keeps some ``keep`` stretches at a time."""

    def __init__(self, path: str, keep: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces if p.type != 2}
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not kinds <= {NORMAL, CONTROL, BYTE}:
            raise ValueError("not a plain BPE model with byte fallback")
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces or not normalizer.add_dummy_prefix:
            raise ValueError("the model changes texts before it encodes them")
        if len(proto.pieces) > NONE:
            raise ValueError("too many pieces")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.cost = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.end = trainer.eos_id
        self.kinds = kinds_of(self.ids)
        self.surface = [p.piece.replace(SPACE, " ") if p.type == NORMAL else "" for p in proto.pieces]
        for b, i in self.bytes.items():
            self.surface[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.leading = [p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces]
        self.single = np.full(0x110000, NONE, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        made = sorted((self.ids[p[:k]] * (NONE + 1) + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.keys, self.made = np.array([k for k, _ in made], np.int64), np.array([i for _, i in made], np.int32)
        # equal scores share a place in the order; NONE comes last
        self.order = np.full(NONE + 1, NEVER, np.int32)
        places = {c: n for n, c in enumerate(sorted(set(self.cost.values())))}
        for piece, i in self.ids.items():
            self.order[i] = places[self.cost[piece]]
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)
        self.decimals = pa.array([str(i) for i in range(len(proto.pieces))])
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge_few(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of some short stretches, and all ids; their agendas lie side by side in arrays.

        A round takes the best pair of every agenda, the leftmost among equals, and looks up the two pairs that
        the new symbol makes with its neighbours; stretches without a pair left are done.
        """
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        symbol = self.single[points]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        place = np.arange(len(points))
        joined = self.pairs(symbol, np.append(symbol[1:], NONE), np.append(owner[1:] == owner[:-1], False))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbol):
            order = self.order[joined]
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(order, starts)
            going = np.repeat(best < NEVER, np.diff(np.append(starts, len(owner))))
            done.append((owner[~going], place[~going], symbol[~going]))
            owner, place, symbol, joined, order = owner[going], place[going], symbol[going], joined[going], order[going]
            at = np.flatnonzero(order == np.repeat(best, np.diff(np.append(starts, len(going))))[going])
            if not len(at):
                break
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
            symbol[at] = joined[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            owner, place, symbol, joined = owner[keep], place[keep], symbol[keep], joined[keep]
            at = at - np.arange(len(at))
            for i in (at, at[at > 0] - 1):
                right = np.minimum(i + 1, len(symbol) - 1)
                joined[i] = self.pairs(symbol[i], symbol[right], (owner[right] == owner[i]) & (right > i))
        owner, place, symbol = (np.concatenate(c) for c in zip(*done)) if done else (owner, place, symbol)
        sort = np.argsort(place, kind="stable")
        owner, symbol, point = owner[sort], symbol[sort], points[place[sort]]
        unknown = symbol == NONE
        wide = np.where(unknown, utf8_size(point), 1)
        ids = np.repeat(symbol, wide)
        raw = point[unknown].astype("<u4").tobytes().decode("utf-32-le").encode()
        ids[ids == NONE] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        return np.bincount(np.repeat(owner, wide), minlength=len(texts)), ids

    def pairs(self, left: np.ndarray, right: np.ndarray, there: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, NONE without one."""
        key = left.astype(np.int64) * (NONE + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(there & (self.keys[at] == key), self.made[at], NONE)

    def merge_long(self, text: str) -> list[int]:
        """The ids of a long stretch; the agenda is a heap of pairs, and those of which a symbol was merged meanwhile are passed over."""
        cost, symbols, n = self.cost, list(text), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, str]] = []

        def enter(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                pair = symbols[left] + symbols[right]
                if pair in cost:
                    heapq.heappush(agenda, (cost[pair], left, pair))

        for i in range(n - 1):
            enter(i, i + 1)
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            right = after[left]
            # an entry is stale once one of its symbols was merged: a symbol that went is empty, one that grew differs
            if not symbols[left] or right < 0 or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            enter(before[left], left)
            enter(left, after[left])
        return [i for s in symbols if s for i in ([self.ids[s]] if s in self.ids else [self.bytes[b] for b in s.encode()])]

    def learn(self, new: list[str]) -> None:
        """Merge new stretches and keep them."""
        few, long = [s for s in new if len(s) <= SHORT], [s for s in new if len(s) > SHORT]
        sizes, flat = [self.sizes], [self.flat]
        for i in range(0, len(few), 50_000):
            n, ids = self.merge_few(few[i : i + 50_000])
            sizes.append(n)
            flat.append(ids)
        for s in long:
            ids = np.array(self.merge_long(s), np.int32)
            sizes.append(np.array([len(ids)]))
            flat.append(ids)
        self.known.update(zip(few + long, range(len(self.known), len(self.known) + len(new))))
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)

    def stretches(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The stretches of all texts, and each text's number of them."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(marked)
        point = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(point) + 1, bool)
        if self.kinds is not None:
            kind = self.kinds[point]
            open_ = kind[:-1] != 2
            first[1:-1] = open_ & (kind[1:] != kind[:-1])
        edges = np.cumsum([0, *map(len, marked)])
        first[edges[:-1]] = True
        first[-1] = False
        starts = np.flatnonzero(first)
        upto = np.concatenate([[0], np.cumsum(utf8_size(point))])
        offsets = np.append(upto[starts], upto[-1]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())]), np.diff(np.searchsorted(starts, edges))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, the end id included, and the ids of all."""
        if len(self.known) > self.keep or len(self.flat) > 16 * self.keep:
            self.forget()
        parts, counts = self.stretches(texts)
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = list(map(self.known.get, words))
        if None in found:
            self.learn([w for w, f in zip(words, found) if f is None])
            found = list(map(self.known.get, words))
        at = np.array(found, np.int64)[coded.indices.to_numpy()]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        begin = np.cumsum(self.sizes) - self.sizes
        take = np.repeat(begin[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        upto, edges = np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(counts)])
        return with_end(upto[edges[1:]] - upto[edges[:-1]], self.flat[take], self.end)

    def encode(self, text: str) -> list[int]:
        """The ids of a text, the end id last."""
        return self([text])[1].tolist()

    def decode(self, ids: list[int]) -> str:
        """Pieces joined; runs of bytes as UTF-8, U+FFFD for each that is part of no character; control ids give nothing; the leading space goes."""
        out = "".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        if first is not None and self.leading[first]:
            out = out[1:]
        try:
            out.encode()
        except UnicodeEncodeError:  # bytes beyond ASCII stand as lone surrogates so far; a control id ends a run of bytes
            runs = [[]]
            for i in ids:
                runs[-1].append(self.surface[i]) if self.surface[i] else runs.append([])
            whole = "".join("".join(run).encode("utf-8", "surrogateescape").decode("utf-8", "halofield-each") for run in runs)
            out = whole[len(whole) and first is not None and self.leading[first] :]
        return out


def utf8_size(point: np.ndarray) -> np.ndarray:
    """Bytes of each code point."""
    return 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)


def each_byte(e: UnicodeError) -> tuple[str, int]:
    return "\ufffd", e.start + 1


codecs.register_error("halofield-each", each_byte)


def piece_model(path: str) -> tuple[PieceModel, object]:
    """The worker's own model and the library's, read once."""
    key = "pieces", path
    if key not in held():
        import sentencepiece

        held()[key] = PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    return held()[key]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>, the end id last) of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches):
            counts, ids = piece_model(path)[0]([t or "" for t in part.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of coded(doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, _ = piece_model(path)
            text = pa.array([model.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode and digest every text; checked tells that the library gave the same ids and the same text.

    The library sees each whole text again, batch by batch, and never replaces a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches):
            model, library = piece_model(path)
            texts = [t or "" for t in part.column(1).to_pylist()]
            counts, flat = model(texts)
            ends = np.cumsum(counts)
            lists = pa.LargeListArray.from_arrays(np.append(0, ends), model.decimals.take(pa.array(flat)))
            ids_sha = [hashlib.sha256(d.as_buffer()).hexdigest() for d in pc.binary_join(lists, " ")]
            text_sha, same = [], []
            for text, a, b in zip(texts, ends - counts, ends):
                ids = flat[a:b].tolist()
                decoded = model.decode(ids)
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                same.append(library.encode(text, add_eos=True) == ids and library.decode(ids) == decoded)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "checked"])

    return docs.select("doc_id", "text").mapInArrow(run, CODED)


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(read_table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"))
