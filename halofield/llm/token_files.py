"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A shard has three files. ``.bin`` holds the ids of its documents one after the other, without any
header, as little-endian unsigned integers (16 bits where the vocabulary fits, else 32). ``.idx``
holds n + 1 offsets into it as little-endian unsigned 64-bit integers, counted in ids. ``.doc``
holds the document ids as signed 64-bit integers, then one byte a document: 1 if the id is null.
Shards are ranges of doc_id in ascending order (nulls first), so the place of a shard in the whole
corpus is the prefix sum of the counts before it. Readers map the files into memory.

Rules for unusual rows: a null text counts as empty and gives the end id only; rows that repeat a
doc_id are ordered by a hash of the text, then by the text, and each keep their own entry; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import os
import sys
import tempfile
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

MANIFEST = "shard int, path string, id_bits int, n_docs long, n_tokens long"
ENTRIES = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: A mark at the end of a word of Latin letters, and what follows it (RE2).
MARKS = r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([.,;:!?]+)([ \t\n\v\f\r]|$)"
LATIN = r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+$"


def held() -> dict:
    """What a Python worker keeps from task to task."""
    return sys.modules.setdefault("halofield_held", types.ModuleType("halofield_held")).__dict__


class WordEncoder:
    """Encodes arrays of texts with a tokenizer whose matches never span white space.

    White space is dropped by such a tokenizer and no match, merge or special token crosses it, so
    the ids of a text are those of its words in order; likewise a Latin letter and a mark such as a
    full stop at the end of a word never share a match, so a space may part them. Each distinct word
    is encoded once and kept, at most ``keep`` at a time. Words of Latin letters alone are one match
    each; they are encoded many at a time and told apart by the number of the match.
    """

    def __init__(self, path: str, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.forget()

    def forget(self) -> None:
        self.words, self.lens, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: pa.Array) -> None:
        """Encode new words; simple ones first, in the order in which they are kept."""
        simple = pc.match_substring_regex(words, LATIN)
        plain, rest = words.filter(simple), words.filter(pc.invert(simple)).to_pylist()
        lens, flat = [self.lens], [self.flat]
        for a in range(0, len(plain), 500):
            part = plain.slice(a, 500).to_pylist()
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            of = np.array(found.word_ids, np.int64)
            if len(of) and of.max() + 1 == len(part) and (np.diff(of) >= 0).all():
                lens.append(np.bincount(of, minlength=len(part)))
                flat.append(np.array(found.ids, np.uint32))
            else:
                self.singly(part, lens, flat)
        self.singly(rest, lens, flat)
        self.words = pa.concat_arrays([self.words, plain, pa.array(rest, pa.string())])
        self.lens, self.flat = np.concatenate(lens), np.concatenate(flat)

    def singly(self, words: list[str], lens: list[np.ndarray], flat: list[np.ndarray]) -> None:
        for a in range(0, len(words), 2000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words[a : a + 2000], add_special_tokens=False)]
            lens.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and the ids of all."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # such strings can be special tokens, in lower case only
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), MARKS, r"\1 \2\3")
        words = pc.ascii_split_whitespace(texts)
        sizes = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        if len(self.words) > self.keep:
            self.forget()
        new = coded.dictionary.filter(pc.is_null(pc.index_in(coded.dictionary, self.words)))
        if len(new):
            self.learn(new)
        at = pc.index_in(coded.dictionary, self.words).to_numpy()[coded.indices.to_numpy()]
        counts = self.lens[at]
        ends = np.cumsum(counts)
        starts = np.cumsum(self.lens) - self.lens
        take = np.repeat(starts[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        upto, edges = np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(sizes)])
        return upto[edges[1:]] - upto[edges[:-1]], self.flat[take]


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer."""
    if path not in held():
        held()[path] = WordEncoder(path)
    return held()[path]


def with_end(counts: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append end_id to each document."""
    ends = np.cumsum(counts + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = ids
    return counts + 1, out


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_bits: int = 16, rows_at_once: int = 700) -> DataFrame:
    """Write the shards of docs(doc_id, text) into folder; returns their manifest, one row a shard.

    One range exchange on (doc_id, hash of the text) brings the documents in order; each task writes its range
    as one shard, document by document. Files appear under their names only when they are whole,
    and a task that runs again writes the same bytes.
    """
    dtype = {16: "<u2", 32: "<u4"}[id_bits]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, encode = task.partitionId(), None
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        base = f"{root}/shard-{shard:06d}"
        tmp = f"{base}.{task.taskAttemptId()}"
        counts, doc_ids, nulls, out = [], [], [], None
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                if encode is None:
                    encode, out = word_encoder(tokenizer_path), store.open_output_stream(f"{tmp}.bin")
                doc_id = part.column(0)
                n, ids = with_end(*encode(pc.fill_null(part.column(1), "")), end_id)
                if id_bits == 16 and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("these ids need 32 bits")
                out.write(ids.astype(dtype).tobytes())
                counts.append(n)
                nulls.append(doc_id.is_null().to_numpy(zero_copy_only=False))
                doc_ids.append(pc.fill_null(doc_id, 0).to_numpy())
        if out is None:
            return
        out.close()
        n = np.concatenate(counts)
        with store.open_output_stream(f"{tmp}.idx") as f:
            f.write(np.concatenate([[0], np.cumsum(n)]).astype("<u8").tobytes())
        with store.open_output_stream(f"{tmp}.doc") as f:
            f.write(np.concatenate(doc_ids).astype("<i8").tobytes() + np.concatenate(nulls).astype("u1").tobytes())
        for end in (".idx", ".doc", ".bin"):
            store.move(tmp + end, base + end)
        pa.default_memory_pool().release_unused()
        row = {"shard": [shard], "path": [base], "id_bits": [id_bits], "n_docs": [len(n)], "n_tokens": [int(n.sum())]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("id_bits", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    spark = docs.sparkSession
    # the bounds of the ranges come from a sample of the keys that Spark takes to the driver: a hash of the text keeps it small
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """One row a document: its id, its place in the corpus, its length and the checksum of its ids.

    The base of a shard is the prefix sum of the manifest's counts (one row a shard, so the window
    without a partition stays small). The ids come from the mapped file; a file in a remote store
    is first copied to the executor's own temporary folder.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with tempfile.TemporaryDirectory() as own:
                    base = row["path"]
                    if not isinstance(store, fs.LocalFileSystem):
                        for end in (".bin", ".idx", ".doc"):
                            fs.copy_files(base + end, f"{own}/shard{end}", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
                        base = f"{own}/shard"
                    ids = np.memmap(f"{base}.bin", {16: "<u2", 32: "<u4"}[row["id_bits"]], "r") if row["n_tokens"] else np.zeros(0, "<u2")
                    idx = np.memmap(f"{base}.idx", "<u8", "r").astype(np.int64)
                    n = row["n_docs"]
                    doc = np.memmap(f"{base}.doc", "<i8", "r", shape=(n,))
                    null = np.memmap(f"{base}.doc", "u1", "r", offset=8 * n, shape=(n,))
                    crc = np.fromiter((zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(idx[:-1], idx[1:])), np.int64, n)
                    columns = [pa.array(doc, mask=null.astype(bool)), pa.array(row["base"] + idx[:-1]), pa.array(np.diff(idx)), pa.array(crc)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    return placed.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(read, ENTRIES)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_bits: int = 16) -> DataFrame:
    """Write docs as token files into the shared folder and read them back (see the module's text)."""
    folder = shared_dir(docs.sparkSession, "token-files")
    return read_shards(write_shards(docs, folder, tokenizer_path, end_id, id_bits), folder)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
