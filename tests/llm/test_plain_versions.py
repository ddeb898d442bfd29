"""Secret scan and fingerprints against literal versions: pairwise links, and a one-permutation MinHash bin by bin."""

import hashlib
import random
import struct

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from halofield.llm import fingerprints, secret_scan

SECRETS, NAMES = {"assign", "hex", "secret"}, {"access", "identifier"}
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]


def scanned(text):
    """(kind, start, end) of all parts, from the statements of the kinds."""
    out = []
    for m in regex.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in regex.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in regex.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    plain = lambda c: c.isascii() and c.isalnum()
    for m in regex.finditer(r"(?ai)(username|user|login|account|clientid|client_id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@+-]+)", text):
        if len(m[2]) >= 3 and not (m.start() and plain(text[m.start() - 1])):
            out.append(("identifier", m.start(), m.end()))
    for m in regex.finditer("[A-Za-z0-9+/]+", text):
        w, after = m[0], text[m.end() : m.end() + 1]
        if len(w) == 40 and after not in ("=", "_", "-") and any(map(str.isdigit, w)) and any(map(str.islower, w)) and any(map(str.isupper, w)):
            out.append(("secret", m.start(), m.end()))
    for m in regex.finditer(r"([A-Za-z0-9+.-]+)://[^\s\"'<>]+", text):
        lead = next((i for i, c in enumerate(m[1]) if c.isalpha()), None)
        if lead is not None:
            out.append(("endpoint", m.start() + lead, m.end()))
    return out


def linked(parts, scope):
    """The reported parts; every pair is looked at."""
    def beside(p, kinds):
        return p[0] not in kinds and any(q[0] in kinds and q[1] <= p[2] + scope and q[2] >= p[1] - scope for q in parts)

    kept = []
    for p in parts:
        secret, name, place = beside(p, SECRETS), beside(p, NAMES), beside(p, {"endpoint"})
        if p[0] in ("assign", "access", "hex") or p[0] == "identifier" and secret or p[0] == "secret" and (name or place) or p[0] == "endpoint" and secret and name:
            kept.append(p)
    return sorted(kept, key=lambda p: (p[1], KINDS.index(p[0]), p[2]))


def listed(parts):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in parts)


def test_secret_scan_is_the_literal_one(spark):
    rng = random.Random(12)
    lone = lambda: "aB3" + "".join(rng.choice("abcXYZ019+/") for _ in range(37))
    makers = [lambda: "password: longenough1", lambda: "Token='short'", lambda: "AKIA" + "Q7" * rng.randint(4, 9), lambda: "0af1" * rng.randint(6, 10), lambda: "user=bob_x", lambda: "client_id: 'abc.def'", lone, lambda: lone() + "=", lambda: "https://h.example/a?b", lambda: "9.ftp://x", lambda: "é ñ 😀", lambda: "\n", lambda: "api_key=" + lone()]
    texts = ["".join(rng.choice(makers)() + rng.choice([" ", "\n", " " * rng.randint(1, 260)]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, texts[3]), (901, texts[3]), (None, texts[5])]
    docs = spark.createDataFrame([(d, t, "mine", 7) for d, t in rows], "doc_id long, text string, spans string, n_hex int").repartition(3)
    got = sorted(map(tuple, secret_scan.scan_documents(docs).collect()), key=repr)
    want, kinds = [], set()
    for d, t in rows:
        parts = linked(scanned(t or ""), secret_scan.SCOPE)
        base = [p for p in parts if p[0] in KINDS[:3]]
        kinds |= {p[0] for p in parts}
        want.append((d, *(sum(p[0] == k for p in base) for k in KINDS[:3]), hashlib.sha256(listed(base).encode()).hexdigest(), listed(parts), len(parts) - len(base)))
    assert got == sorted(want, key=repr) and kinds == set(KINDS)


def hashed(*values):
    """Spark's xxhash64 of ints ('i'), longs ('q') and texts, as a signed number."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<" + v[0], v[1])
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_fingerprint(text, words=5, bins=256, bits=4, probes=8):
    found = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    if not found:
        return ""
    each = [hashed(w) for w in found]
    runs = [each[i : i + words] for i in range(max(1, len(each) - words + 1))]
    least = [None] * bins
    for run in runs:
        h = hashed(*(("q", x) for x in run))
        place = (((h & ((1 << 64) - 1)) >> 56) + 128) % bins  # bins stand in the order of signed numbers
        least[place] = h if least[place] is None else min(least[place], h)
    dense = list(least)
    for i in range(bins):
        if least[i] is None:
            tried = [least[hashed(("i", i), ("i", t)) % bins] for t in range(1, probes + 1)]
            full = [h for h in tried if h is not None]
            dense[i] = full[0] if full else min((hashed(("i", i), ("q", (h & ((1 << 64) - 1)) >> 56), "rank"), h) for h in least if h is not None)[1]
    digits = [f"{h & ((1 << bits) - 1):x}" for h in dense]
    return "".join(digits)


def plain_likeness(a, b, bits=4):
    if not a or not b:
        return float(a == b)
    share = sum(x == y for x, y in zip(a, b)) / len(a)
    return max(0.0, (share - 2.0**-bits) / (1 - 2.0**-bits))


def test_fingerprints_are_the_literal_ones(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["alpha", "Beta", "señal", "ß", "x1", "den", "og", "日本", "w%d" % rng.randrange(500)]) for _ in range(n))
    texts = [None, "", "!!", "one", "one two three", *(words(n) for n in (4, 5, 6, 20, 80, 300, 2000, 1500))]
    texts.append(texts[-1].replace("alpha", "omega", 3))
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, "mine", "key") for d, t in rows], "doc_id long, text string, fingerprint string, key string").repartition(3)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for (d, t), (_, after) in zip(order, [*order[1:], order[0]]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, other, following = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(after)
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[d]["fingerprint"], got[d]["edited_fingerprint"]) == (own, other)
        assert got[d]["near_edited"] == pytest.approx(plain_likeness(own, other)) and got[d]["near_next"] == pytest.approx(plain_likeness(own, following))


def test_hashes_are_spark_s(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("señal")).alias("a"), F.xxhash64(F.lit(5), F.lit(7)).alias("b"), F.xxhash64(F.lit(5), F.lit(9).cast("long"), F.lit("rank")).alias("c")).first()
    assert tuple(row) == (hashed("señal"), hashed(("i", 5), ("i", 7)), hashed(("i", 5), ("q", 9), "rank"))
