"""Secret scanning with multipart credential linking.

Three strong kinds are reported wherever they stand: `assign`, `access`, `hex`. Three weak kinds are
parts of a credential and say little alone: `identifier` (an account or client name given by
assignment), `secret` (a lone 40-character key) and `endpoint` (an address). A weak part is reported
only if its complements are within its scope, SCOPE code points of the same text:

* `identifier`: a secret part (`assign`, `hex` or `secret`);
* `secret`: an identifying part (`access` or `identifier`) or an `endpoint`;
* `endpoint`: a secret part and an identifying part.

The link is an interval join. The parts of a whole batch lie on one line, each text with a gap of
more than the scope after it, so an interval can only meet intervals of its own text; sorted starts
and running maxima of the ends answer "does any interval of these kinds come within the scope" by
binary search. Work is n log n in the parts, however many share a text, and no pairs are made.

Rules for unusual rows: a null text counts as empty; repeated rows each give a row; an empty table
gives an empty table; a part may lie inside another one and both are reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCOPE = 200
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "secret", "endpoint")
# The strong kinds' patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# The weak kinds' patterns are this module's own.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@+-]{3,}", re.I | re.A)
LONE = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
# An address of any scheme is group 1; a run of scheme characters is read once, from its start.
ENDPOINT = re.compile(r"(?<![A-Za-z0-9+.-])[0-9+.-]*+([A-Za-z][A-Za-z0-9+.-]*+://[^\s\"'<>]+)")
FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def parts(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every part of one text, in code points, end exclusive."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    out += [(3, m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    out += [(4, m.start(), m.end()) for m in LONE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    return out + [(5, m.start(1), m.end()) for m in ENDPOINT.finditer(text)]


def near(start: np.ndarray, end: np.ndarray, others: np.ndarray, scope: int) -> np.ndarray:
    """Which of all intervals have one of the others, not itself, at most scope away."""
    if not others.any():
        return np.zeros(len(start), bool)
    order = np.argsort(start[others], kind="stable")
    s, reach = start[others][order], np.maximum.accumulate(end[others][order])
    upto = np.searchsorted(s, end + scope, "right")
    hit = (upto > 0) & (reach[np.maximum(upto - 1, 0)] >= start - scope)
    return hit & ~others


def link(kind: np.ndarray, start: np.ndarray, end: np.ndarray, scope: int = SCOPE) -> np.ndarray:
    """Which parts are reported; the strong ones always."""
    secret = near(start, end, np.isin(kind, (0, 2, 4)), scope)
    who = near(start, end, np.isin(kind, (1, 3)), scope)
    where = near(start, end, kind == 5, scope)
    return (kind < 3) | (kind == 3) & secret | (kind == 4) & (who | where) | (kind == 5) & secret & who


def scan(texts: list[str], scope: int = SCOPE) -> list[list[tuple[int, int, int]]]:
    """The reported parts of each text, by start, then kind, then end."""
    found = [parts(t) for t in texts]
    rows = np.array([(i, *p) for i, f in enumerate(found) for p in f], np.int64).reshape(-1, 4)
    if not len(rows):
        return found
    gap = np.cumsum([0, *(len(t) + 2 * scope + 2 for t in texts)])
    keep = link(rows[:, 1], rows[:, 2] + gap[rows[:, 0]], rows[:, 3] + gap[rows[:, 0]], scope)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, k, a, b in rows[keep].tolist():
        out[i].append((k, a, b))
    return [sorted(x, key=lambda p: (p[1], p[0], p[2])) for x in out]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row a document with counts, the digest of the strong spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = scan([t or "" for t in part.column(1).to_pylist()], scope)
                base = [[p for p in f if p[0] < 3] for f in found]
                columns = [pa.array([sum(p[0] == k for p in f) for f in base], pa.int64()) for k in range(3)]
                columns.append(pa.array([hashlib.sha256(listed(f).encode()).hexdigest() for f in base], pa.string()))
                columns += [pa.array([listed(f) for f in found], pa.string()), pa.array([len(f) - len(b) for f, b in zip(found, base)], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {FOUND}")


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with every reported span replaced by [kind]; overlapping spans become one, named by the first.

    n_chars, where docs has it, is counted anew for the rows that change. A null text stays null.
    """
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = list(batch.columns), batch.column(at).to_pylist()
            found = scan([t or "" for t in texts], scope)
            for i, spans in enumerate(found):
                out, upto = [], 0
                for k, a, b in spans:
                    if a >= upto:
                        out.append(f"{texts[i][upto:a]}[{KINDS[k]}]")
                    upto = max(upto, b)
                if spans:
                    texts[i] = "".join(out) + texts[i][upto:]
            columns[at] = pa.array(texts, columns[at].type)
            if length is not None:
                columns[length] = pa.array([len(texts[i]) if found[i] else n for i, n in enumerate(columns[length].to_pylist())], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
