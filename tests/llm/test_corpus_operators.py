"""Each operator against a plain computation on a small table with nulls, empty and long texts, copies and ties."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from halofield.llm import byte_bpe, decontaminate, exchange, fingerprints, language_id, minhash_dedup, secret_scan, substring_dedup, suffix_dedup, token_files, warc

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, chunk int, spans int, kept int"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(60), prose(300)
    near = base.split()
    near[7], near[150] = "changed", "words"
    texts = [None, "", " \t\n", "x", "Two words", shared, prose(40) + " " + shared + "\n" + prose(30), prose(20) + "  " + shared, base, base, " ".join(near), base + " tail", "ab " * 400, prose(4000), "a" * 3000, prose(3), prose(4), prose(5), "ÀÉ ß 😀 " * 50, shared.upper()]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 0, "x", 1, 2, 3) for i, t in enumerate(texts)]
    return [*rows, (None, base, "en", "s", 0, "x", 1, 2, 3), (5, shared, "fr", "s", 0, "x", 1, 2, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_token_files(docs, none, spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = token_files.token_files(docs, path, 2).orderBy("start").collect()
    texts, start = Counter((r[0], r[1]) for r in corpus()), 0
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    want = Counter()
    for (d, text), n in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += n
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert token_files.token_files(none, path, 2).collect() == []


def test_word_encoder_is_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, texts = Tokenizer.from_file(path), ["It's a <|endoftext|> x", "naïve. Café; don't!! (a.) b.c 12.5, ÉCOLE.", "…. ?. a…. ß. İ. x y. é. ́a", "", "<|STARTOFTEXT|>", "A.b. C,d, e's. f'll; g'."]
    for some in (texts, texts[1:4], texts[5:]):
        encoder = token_files.WordEncoder(path, keep=3)
        for _ in range(2):
            counts, ids = encoder(pa.array(some))
            assert ids.tolist() == [i for x in some for i in t.encode(x, add_special_tokens=False).ids]
            assert counts.tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in some]


def test_byte_bpe(docs, none):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in corpus():
        ids = e.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert rows(byte_bpe.round_trip(docs, path, P.PATTERN)) == sorted(want, key=repr)
    assert byte_bpe.round_trip(none, path, P.PATTERN).collect() == []
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path, P.PATTERN), path, P.PATTERN)
    assert rows(back.select("doc_id", F.col("bytes").cast("string"))) == sorted([(r[0], r[1] or "") for r in corpus()], key=repr)
    small, text = byte_bpe.ByteBPE(path, P.PATTERN, piece=7), "Don't  cut\n\n here 's  .. 12 é😀  \t x" * 20
    assert small.encode(text) == e.encode_ordinary(text)


def test_language_id(spark, none):
    rng = random.Random(1)
    vocabulary = {"aa": ["loro", "mira", "tosa", "vel"], "bb": ["kniv", "stork", "wald", "zehn"]}
    made = [(i, " ".join(rng.choice(vocabulary[k]) for _ in range(rng.randint(30, 200))), k) for i in range(120) for k in [("aa", "bb")[i % 2]]]
    odd = [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (None, made[0][1], None)]
    df = spark.createDataFrame(made + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len(got) == 124 and all(got[i].lang_pred == k for i, _, k in made)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (900, 901, 902))
    assert got[None].lang_pred == "aa"
    assert language_id.identify(none).collect() == []
    assert {r.lang_pred for r in language_id.predict(df, language_id.Model([])).collect()} == {"und"}


def test_language_id_of_repeated_and_long_rows(spark):
    """1,000 equal rows teach once, a long text whole or not at all; digits that count as word characters are no letters."""
    rng = random.Random(2)
    words = {"aa": ["loro", "mira", "tosa", "vel"], "bb": ["kniv", "stork", "wald", "zehn"]}
    prose = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    same, long_ = prose("aa", 40), prose("bb", 5000)
    table = [(i, same, "aa") for i in range(1000)] + [(2000, long_, "bb"), (2001, long_, "bb"), (2002, prose("bb", 9), "bb"), (2002, prose("bb", 9), "bb")]
    df = spark.createDataFrame([*table, (3000, "½ ² Ⅷ", None), (3001, "½ é", None)], "doc_id long, text string, lang string")
    chosen = language_id.sample(df)
    assert [(k, n) for k, n, _ in chosen] == [("aa", 1), ("bb", 1), ("bb", 2)]
    assert all(t == same or len(t) < 100 for _, _, t in chosen)
    alone = language_id.sample(df.where("doc_id <> 2002"))
    assert [(k, n, t) for k, n, t in alone if k == "bb"] == [("bb", 1, long_)]
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert got[3000].lang_pred == "und" and got[3000].score == 0 and got[3001].lang_pred != "und"
    assert got[0].lang_pred == "aa" and got[2000].lang_pred == "bb"


def test_every_language_is_learned(spark):
    rng = random.Random(9)
    spoken = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for i in range(300)}
    made = [(4 * i + j, " ".join(rng.choice(w) for _ in range(60)), k) for i, (k, w) in enumerate(spoken.items()) for j in range(4)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language_id.learn(df)
    assert sorted(k for k, _ in model.dictionaries) == sorted(spoken)
    asked = df.where("doc_id % 100 = 0")
    assert all(r.lang_pred == r.lang for r in language_id.predict(asked, model).collect())


def test_language_id_against_plain_compression(spark):
    """Every row by a loop that compresses its letters once with each dictionary."""
    import zstandard as zstd

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.learn(df.where(~language_id.held_out()))
    assert sorted(k for k, _ in model.dictionaries) == ["de", "en", "es", "fr"] and 0 < model.narrow < 0.05
    assert all(len(v) <= language_id.DICT_BYTES + 1 for _, v in model.dictionaries)
    coder = {}
    for k, content in model.dictionaries:
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        coder[k] = zstd.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    right = n = 0
    for r in language_id.identify(df).collect():
        words, word = [], ""
        for c in (r.text or "").lower() + " ":
            if c.isalpha():
                word += c
            else:
                words, word = words + [word] * bool(word), ""
        raw = " ".join(words).encode()
        if not raw:
            assert (r.lang_pred, r.accepted) == ("und", False)
            continue
        sizes = sorted((sum(len(coder[k].compress(raw[a : a + 1024])) for a in range(0, len(raw), 1024)), i, k) for i, (k, _) in enumerate(model.dictionaries))
        assert r.lang_pred == sizes[0][2] and r.margin == sizes[1][0] - sizes[0][0]
        assert r.accepted == (r.margin >= max(1, model.narrow * sizes[0][0]))
        right += r.lang == r.lang_pred
        n += r.lang is not None
    assert right >= 0.97 * n


def brute_cover(items, n):
    seen = Counter(s[i : i + n] for s in items for i in range(len(s) - n + 1))
    out = []
    for s in items:
        gone = bytearray(len(s))
        for i in range(len(s) - n + 1):
            if seen[s[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append(gone)
    return out


@pytest.mark.parametrize(("chunk", "many", "piece"), [(8_000_000, 256, 1 << 20), (3_000, 2, 900)])
def test_suffix_dedup(docs, none, monkeypatch, chunk, many, piece):
    monkeypatch.setattr(exchange, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "buckets_for", lambda *a: 4)
    texts = [(r[1] or "").encode() for r in corpus()]
    want = []
    for r, t, gone in zip(corpus(), texts, brute_cover(texts, 200)):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((r[0], len(t), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    assert rows(suffix_dedup.repeated_bytes(docs, chunk_bytes=chunk).drop("spans")) == sorted(want, key=repr)
    assert suffix_dedup.repeated_bytes(none).collect() == []


def test_suffix_sort_is_a_suffix_sort():
    import numpy as np

    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 2000).astype(np.uint8)
    start, length = rng.permutation(1900)[:500], 60
    segment = np.sort(rng.integers(0, 9, 500))
    order = suffix_dedup.suffix_sort(raw, exchange.Prefix(exchange.BYTE[raw]), start, segment, length)
    text = raw.tobytes()
    assert (segment[order] == segment).all()
    keys = [(segment[i], text[start[i] : start[i] + length]) for i in order]
    assert keys == sorted(keys)


@pytest.mark.parametrize("chunk", [8_000_000, 3_000])
def test_substring_dedup(docs, none, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "buckets_for", lambda *a: 4)
    words = [tuple((r[1] or "").encode().split()) for r in corpus()]
    want = []
    for r, w, gone in zip(corpus(), words, brute_cover(words, 35)):
        want.append((r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    assert rows(substring_dedup.repeated_passages(docs, chunk_bytes=chunk).drop("spans")) == sorted(want, key=repr)
    assert substring_dedup.repeated_passages(none).collect() == []


def test_substring_dedup_tells_windows_with_equal_hashes_apart(spark, monkeypatch):
    """With a window hash that is the same for all windows, the digest of the words decides alone."""
    import numpy as np

    plain = substring_dedup.Words.candidates

    def blind(self, at, hit, window):
        start, keys = plain(self, at, np.ones_like(hit), window)
        return start, np.zeros_like(keys)

    monkeypatch.setattr(substring_dedup.Words, "candidates", blind)
    shared = [f"s{i}" for i in range(40)]
    texts = [" ".join([*(f"{d}a{i}" for i in range(9)), *shared, *(f"{d}b{i}" for i in range(30))]) for d in range(3)] + [" ".join(f"alone{i}" for i in range(90))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in substring_dedup.repeated_passages(docs, chunk_bytes=700).collect()}
    assert got == {0: [9, 49], 1: [9, 49], 2: [9, 49], 3: []}


def brute_components(table, n, percent):
    sets = []
    for d, t in table:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())))
    ids = sorted(d for d, s in sets if d is not None)
    label = {d: d for d in ids}
    pairs = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if None not in (a, b) and s and t and 100 * len(s & t) >= percent * len(s | t)]
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return sets, label


def test_minhash_dedup(spark, docs, none):
    table = [(r[0], r[1]) for r in corpus()]
    sets, label = brute_components(table, 4, 80)
    want = [(d, len(s), label.get(d), d is None or d == label[d]) for d, s in sets]
    assert rows(minhash_dedup.near_duplicates(docs, words=4)) == sorted(want, key=repr)
    assert minhash_dedup.near_duplicates(none).collect() == []


def test_minhash_dedup_near_the_threshold(spark):
    """Copies that are like their origin, but often not like each other: every component must still be whole."""
    rng, table = random.Random(9), []
    for group in range(6):
        origin = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for k in range(25):
            w = list(origin)
            for p in rng.sample(range(120), rng.randint(0, 4)):
                w[p] = f"v{rng.randrange(10**6)}"
            table.append((group * 25 + k, " ".join(w)))
    sets, label = brute_components(table, 4, 80)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), words=4)
    assert {r.doc_id: r.component_id for r in got.collect()} == label


@pytest.mark.parametrize(("block", "many"), [(4096, 10**6), (60, 30)])
def test_minhash_dedup_finds_pairs_inside_a_dense_family(spark, monkeypatch, block, many):
    """Texts at 0.77 to one another, all in each other's buckets, and 40 pairs at 0.81 that few stars meet."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "MANY", many)
    core, table = [f"c{i}" for i in range(174)], []
    for i in range(400):
        own = [f"p{i // 2}x{k}" if i < 80 and k < 5 else f"o{i}x{k}" for k in range(26)]
        table.append((i, " ".join(core + own)))
    sets, label = brute_components(table, 1, 80)
    assert sorted(Counter(label.values()).values()) == [1] * 320 + [2] * 40
    alike = [len(s & t) / len(s | t) for i, (_, s) in enumerate(sets[80:]) for _, t in sets[80 : 80 + i]]
    assert 0.75 < min(alike) and max(alike) < 0.79
    got = minhash_dedup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(3), words=1)
    assert {r.doc_id: r.component_id for r in got.collect()} == label


def forms(n, seed=4):
    """n filled-in forms of 300 words, 60 of them slots; two of each pair share most slots."""
    rng, table = random.Random(seed), []
    frame = [f"f{i}" for i in range(300)]
    slots = sorted(rng.sample(range(300), 60))
    for i in range(0, n, 2):
        fill = [f"v{rng.randrange(10**6)}" for _ in slots]
        for k in range(2):
            words = list(frame)
            for j, (at, v) in enumerate(zip(slots, fill)):
                words[at] = f"u{rng.randrange(10**6)}" if k and j < i % 9 else v
            table.append((i + k, " ".join(words)))
    return table


def test_minhash_dedup_of_forms(spark):
    """600 forms in common buckets: no pair of equal or nearly equal slots is lost."""
    table = forms(600)
    sets, label = brute_components(table, 4, 80)
    assert 200 < sum(n == 2 for n in Counter(label.values()).values()) <= 300
    got = minhash_dedup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(3), words=4)
    assert {r.doc_id: r.component_id for r in got.collect()} == label


def test_minhash_dedup_parities_never_rule_out_a_pair(spark):
    """Sets of 3 to 5,000 hashes: every pair at the threshold passes the bound, most others of large sets don't."""
    import numpy as np
    import pyarrow as pa

    rng, sets = np.random.default_rng(5), []
    for i in range(60):
        n = int(rng.choice([3, 20, 250, 300, 1100, 5000]))
        base = rng.integers(0, 2**62, n)
        other = np.concatenate([base[: n - int(n * rng.uniform(0, 0.3))], rng.integers(0, 2**62, int(n * rng.uniform(0, 0.2)))])
        sets += [(2 * i, sorted(set(base.tolist()))), (2 * i + 1, sorted(set(other.tolist())))]
    df = minhash_dedup.parities(spark.createDataFrame(sets, "node long, shingles array<long>")).orderBy("node").collect()
    same = len(df)
    part = pa.table({"bucket": [1] * same, "one": [0] * same, "other": [0] * same, "own": [0] * same, "node": [r.node for r in df], "component": [r.node for r in df], "n": [r.n for r in df], "bits": pa.array([bytes(r.bits) for r in df], pa.binary())})
    near = {tuple(sorted(p)) for a, b in minhash_dedup.close_pairs(part, 80) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for j, t in sets for i, s in sets[:j] if 100 * len(set(s) & set(t)) >= 80 * len(set(s) | set(t))}
    assert len(want) > 20 and want <= near and len(near) < len(want) + 30


def test_secret_scan_of_env_files(spark):
    """Keys right after '=', identifiers after '_' and addresses of other schemes than http."""
    key, lone = "AKIA" + "B" * 16, "aB3" + "x" * 37
    texts = [f"AWS_ACCESS_KEY_ID={key}\nAWS_SECRET_ACCESS_KEY={lone}\n", f"DB_USER=bob\nMYSQL_USER=eve\nDB_USERNAME=ann\nKEY={lone}", f"-postgres://h/db KEY={lone} HTTPS://a", f"KEY={lone}", f"KEY={lone}=", "a.-+" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan_documents(df).collect()}
    assert got[0] == "access:18:38,secret:61:101"
    assert got[1] == "identifier:3:11,identifier:18:26,identifier:30:42,secret:47:87"
    assert got[2] == "secret:21:61" and got[3] == got[4] == got[5] == ""
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert clean[0] == "AWS_ACCESS_KEY_ID=[access]\nAWS_SECRET_ACCESS_KEY=[secret]\n"
    assert clean[1] == "DB_[identifier]\nMYSQL_[identifier]\nDB_[identifier]\nKEY=[secret]" and clean[3] == texts[3]


def test_secret_scan(spark, none):
    key, lone = "AKIA" + "B" * 16, "aB3" + "x" * 37
    far = " " * 400
    texts = [None, "", f"password = 'longenough' {key}", "token: short", "x" + "0af" * 11, f"https://a.b/c {far} {lone}", f"user=bob {lone} https://a.b/c", f"client_id: abc{far}password=abcdefgh1", "API_KEY:\"abcd/efgh=\" ſecret=abcdefghi paſsword=abcdefghi", key[:10], "éé " + "password=" + "z" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.scan_documents(df).collect()}
    assert [got[i].spans for i in (0, 1, 3, 5, 9)] == [""] * 5
    assert got[2].spans == "assign:0:22,access:24:44" and (got[2].n_assign, got[2].n_access, got[2].n_hex) == (1, 1, 0)
    assert got[2].base_sha256 == hashlib.sha256(b"assign:0:22,access:24:44").hexdigest()
    assert got[4].spans == "hex:1:34"
    assert got[6].spans == "identifier:0:8,secret:9:49,endpoint:50:63" and got[6].n_linked == 3
    assert got[7].spans.startswith("assign:") and "identifier" not in got[7].spans
    assert got[8].n_assign == 1 and got[10].spans == "assign:3:21"
    assert secret_scan.scan_documents(none).collect() == []
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert clean[2] == "[assign]' [access]" and clean[0] is None and clean[3] == texts[3] and clean[10] == "éé [assign]"


def test_near_is_an_interval_join():
    import numpy as np

    rng = np.random.default_rng(4)
    start = rng.integers(0, 3000, 300)
    end = start + rng.integers(1, 60, 300)
    others = rng.random(300) < 0.1
    want = [not others[i] and any(others[j] and start[j] <= end[i] + 20 and end[j] >= start[i] - 20 for j in range(300)) for i in range(300)]
    assert secret_scan.near(start, end, others, 20).tolist() == want


def brute_contained(table, items, n, threshold):
    words = lambda t: re.sub(r"[^0-9a-zà-ÿ]+", " ", (t or "").lower()).split()
    out = set()
    for item_id, item in items:
        w = words(item)
        k = min(n, len(w))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for d, text in table:
            v = words(text)
            shared = len(own & {tuple(v[i : i + k]) for i in range(len(v) - k + 1)})
            if own and shared >= threshold * len(own):
                out.add((d, item_id, len(own), shared))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontaminate(spark, docs, none, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST", broadcast)
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(1000)}" for _ in range(n))
    items = [(0, prose(30)), (1, prose(8)), (2, None), (3, "one two"), (4, prose(50)), (4, prose(50)), (5, ""), (6, "Seven"), (7, prose(4)), (8, prose(12)), (9, prose(9))]
    half = items[4][1].split()
    table = [(0, prose(3000) + " " + items[0][1].upper() + ". " + prose(10)), (1, prose(9)), (2, items[1][1]), (3, " ".join(half[:46]) + " gap " + prose(5)), (4, " ".join(half[:25])), (5, None), (6, "One, two"), (None, items[0][1]), (0, prose(40)), (2, items[1][1])]
    by = dict(items)
    table += [(7, prose(20_000) + " one two " + prose(3)), (8, "two one"), (9, "sevenfold"), (10, prose(5) + " SEVEN!"), (11, f"{prose(700)} {by[8]} {by[9]}"), (12, f"{by[7]} {prose(90)}")]
    table += [(13, " ".join(by[8].split()[:11]) + " " + prose(30)), (14, " ".join(by[8].split()[:10]) + " " + prose(30)), (15, ""), (16, by[9][:-1])]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("_text_key", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contaminated(df, b).collect()), key=repr)
    want = brute_contained(table, items, 5, 0.8)
    assert got == want and {(7, 3, 1, 1), (10, 6, 1, 1), (12, 7, 1, 1), (13, 8, 8, 7), (None, 0, 26, 26)} <= set(want)
    left, hit = decontaminate.decontaminated(df, b), {d for d, *_ in want}
    assert left.columns == df.columns and {r._text_key for r in left.collect()} == {"x"}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["0", *(str(d) for d, _ in table if d not in hit)])
    assert decontaminate.contaminated(none, b).collect() == [] and decontaminate.contaminated(df, b.limit(0)).collect() == []


def test_decontaminate_sketch_prunes_and_finds(spark):
    """Items of 60 words in documents of 200 to 5,000 words: all are found, though a part of the runs is looked up."""
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    items = [(i, prose(60)) for i in range(40)]
    table = [(i, prose(rng.randint(100, 2500)) + " " + t + " " + prose(rng.randint(100, 2500))) for i, t in items]
    df, b = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, b).collect()) == [(i, i) for i in range(40)]
    assert 0.6 < decontaminate.probed_share(df, b) < 0.83


def test_fingerprints(spark, docs, none):
    got = fingerprints.fingerprints(docs).collect()
    table = corpus()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in table)
    distinct = {(r[0], r[1] or "") for r in table}
    by_text = {}
    for d, t in distinct:
        prints = {r.fingerprint for r in got if r.doc_id == d and r.n_chars == len(t)}
        assert len(prints) == 1
        assert by_text.setdefault(t, prints) == prints
    order = sorted(distinct, key=lambda x: -1 if x[0] is None else x[0], reverse=True)
    at = {}
    for (d, t), (_, nxt) in zip(order, [*order[1:], order[0]]):
        at[d] = hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in got} == at
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 9).near_next == 1.0
    assert fingerprints.fingerprints(none).collect() == []
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "abcd ef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprint_estimates(spark):
    rng, table = random.Random(8), []
    for i in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 400, 2000]))]
        v = [x if rng.random() > 0.03 else "new" for x in w]
        table.append((i, " ".join(w), " ".join(v)))
    df = fingerprints.fingerprint(fingerprints.fingerprint(spark.createDataFrame(table, "i int, a string, b string"), "a", "pa"), "b", "pb")
    gaps = []
    for r in df.select("a", "b", fingerprints.likeness("pa", "pb").alias("s")).collect():
        s, t = ({tuple(x.split()[k : k + 5]) for k in range(len(x.split()) - 4)} for x in (r.a, r.b))
        gaps.append(r.s - len(s & t) / len(s | t))
    assert abs(sum(gaps) / len(gaps)) < 0.02 and max(map(abs, gaps)) < 0.2


def test_warc(spark, tmp_path):
    long_ = "<p>" + "é\r\n" * 40_000
    table = [(3, "http://a/b c", "same"), (1, "http://a/1", "same"), (2, None, None), (5, "u\r\nX: y", long_), (6, "v", long_), (6, "v", long_), (None, "w", "same"), (None, None, long_), (9, "z", "")]
    df = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("first", F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=repr)
    first, want = {"same": 1, "": 2, long_: 5}, []
    for p, _, h in table:
        raw = (h or "").encode()
        again = p is not None and p != first[h or ""]
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=repr)
    assert {r.record_type for r in warc.round_trip(df, least=10**7).collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).collect() == []
    assert warc.unchunked(warc.chunked(b"abc" * 9999, 100)) == b"abc" * 9999


def test_warc_broken_segments_fail(spark):
    seg = [(1, "response", None, "o", None, 1, None, None, "x", b"a"), (1, "continuation", None, "p", "o", 3, 2, None, "x", b"b")]
    with pytest.raises(Exception, match="segments missing"):
        warc.reassemble(spark.createDataFrame(seg, warc.RECORD)).collect()
