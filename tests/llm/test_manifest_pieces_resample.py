"""Merkle manifest, SentencePiece and importance resampling against plain computations on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from halofield.llm import merkle, resample, sentence_pieces

P = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way(levels, i):
    """The digests before and behind a node in its run, from level to level."""
    out = []
    for level in levels[:-1]:
        run, k = level[i // 3 * 3 : i // 3 * 3 + 3], i % 3
        out.append(("".join(run[:k]), "".join(run[k + 1 :])))
        i //= 3
    return out


def plain_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = [sorted((((r[0] is not None, r[0] or 0, leaf(r, r[4])), r) for r in rows if r[1] == s), key=lambda m: m[0]) for s in sources]
    trees = [tree([m[0][2] for m in some]) for some in members]
    top = tree([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for j, some in enumerate(members):
        for i, ((_, _, digest), r) in enumerate(some):
            path = way(trees[j], i) + way(top, j)
            shown = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                shown = leaf(r, r[4].replace("\n", ""))
            for a, b in path:
                shown = sha(a + shown + b)
            out.append((r[0], digest, trees[j][-1][0], root, sha("".join(a + b for a, b in path)), shown, shown == root))
    return out


@pytest.mark.parametrize("n, n_sources, height", [(1, 1, 6), (3, 1, 1), (40, 1, 1), (120, 40, 1), (300, 3, 2)])
def test_merkle_manifest(spark, n, n_sources, height):
    rng = random.Random(n)
    texts = [None, "", "a\nb", "é\n\n", "x" * 5000]
    names = [None, "", "é", *(f"s{k}" for k in range(n_sources))]
    rows = [(i, "s0" if n_sources == 1 or i % 3 == 0 else rng.choice(names), rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice(texts)) for i in range(n)]
    rows += [(None, *r[1:]) for r in rows[:2]]
    # equal rows, and rows that repeat a doc_id with another text
    rows += [(*r[:4], r[4]) for r in rows[:2]] + [(*r[:4], "other\n") for r in rows[:2]]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, at int").repartition(3)
    assert ordered(merkle.manifest(docs, height).collect()) == ordered(plain_manifest(rows))
    assert merkle.manifest(docs.limit(0), height).collect() == []


def test_a_frontier_closes_in_any_order():
    """Parts of a block in any order and grouping give the same top, and open parents wait for all their children."""
    digests = [sha(str(i)) for i in range(23)]
    want = tree(digests)
    rng = random.Random(1)
    for _ in range(30):
        parts = []
        for i in rng.sample(range(23), 23):
            if parts and rng.random() < 0.6:
                rng.choice(parts).add((i, digests[i], i, None))
            else:
                parts.append(merkle.Frontier(23, 6).add((i, digests[i], i, None)))
        assert len(parts) == 1 or all(p.top is None for p in parts)
        while len(parts) > 1:
            parts.append(parts.pop(rng.randrange(len(parts))).merge(parts.pop(rng.randrange(len(parts)))))
        assert parts[0].top == want[-1][0] and not parts[0].open
        assert len(parts[0].closed) == sum(map(len, want[1:]))


def some_texts():
    rng = random.Random(7)
    parts = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "\U0001f600", "中", "ﬁ", "\x00", "́", "th", "ing", " the", "<s>", "​", "ÿ", "\U0010ffff", "\xa0", "=====", "0"]
    return [None, "", " ", "a" * 3000, "word " * 2000, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(150))]


def test_sentence_pieces(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = some_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x y"), (3, "a" * 3000), (5, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    want, ids, back = [], [], []
    for doc_id, text in rows:
        found = library.encode(text or "", add_eos=True)
        want.append((doc_id, len(found), sha(" ".join(map(str, found))), sha(library.decode(found)), True))
        ids.append((doc_id, found))
        back.append((doc_id, library.decode(found)))
    assert ordered(sentence_pieces.round_trip(docs, path).collect()) == ordered(want)
    coded = sentence_pieces.encode_documents(docs, path)
    assert ordered(coded.collect()) == ordered(ids)
    assert ordered(sentence_pieces.decode_documents(coded, path).collect()) == ordered(back)
    assert sentence_pieces.round_trip(docs.limit(0), path).collect() == []


def test_decoding_any_ids_is_the_library_s():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model, library, rng = sentence_pieces.PieceModel(path, keep=5), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([3 + rng.randrange(256), rng.randrange(3, 32000), 1, 2, 28705]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)
    for text in some_texts()[1:]:
        assert model.encode(text) == library.encode(text, add_eos=True)
    assert len(model.known) <= 5 + 45  # forgotten before a text, not within it


def test_models_with_other_rules_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    for change in (lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.trainer_spec, "byte_fallback", False), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.pieces[300], "type", 4)):
        other = pb.ModelProto()
        other.CopyFrom(proto)
        change(other)
        file = tmp_path / "m.model"
        file.write_bytes(other.SerializeToString())
        with pytest.raises(ValueError):
            sentence_pieces.PieceModel(str(file))


def features(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(rows, target):
    found = [features(r[1]) for r in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for text in target for b in features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for (doc_id, _), (words, f) in zip(rows, found):
        h = int(sha(f"42:{'' if doc_id is None else doc_id}")[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is not None, o[0] or 0, o[1]))
    for i, o in enumerate(fit[: 5 * len(fit) // 100]):
        o[4] = i + 1
    return out


def random_text(rng):
    return "".join(rng.choice(["ab", "Cd", "é", "x", "yz1", "Ǝ", "w" * 90, "q" * 300]) + rng.choice([" ", "  ", ".", "\n", "-", "\x00", "_", "{"]) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 50, 300])))


def test_resample(spark):
    rng = random.Random(3)
    rows = [(i if rng.random() > 0.1 else None, rng.choice([None, random_text(rng), random_text(rng)])) for i in range(300)]
    rows += rows[:40]
    target = [random_text(rng) for _ in range(10)] + [None, ""]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, _row int").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resampled(docs, goal).collect()
    assert ordered(got) == ordered(plain_resample(rows, target)) and any(r["rank"] for r in got)
    assert ordered(resample.resampled(docs, goal.limit(0)).collect()) == ordered(plain_resample(rows, []))
    assert resample.resampled(docs.limit(0), goal).collect() == []


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_runs_hash_like_their_words(monkeypatch, stretch):
    """Any cut of a batch into stretches gives the CRC-32 of every n-gram, long words included."""
    monkeypatch.setattr(resample, "STRETCH", stretch)
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(12)] + ["", "one", "z" * 70000 + " end", "Two words"]
    words, got = resample.Words([t.encode() for t in texts]), Counter()
    for some in words.stretches(10000):
        for at, bucket in some:
            got.update(zip(words.of[at].tolist(), bucket.tolist()))
    assert got == Counter((i, b) for i, t in enumerate(texts) for b in features(t)[1])
    assert np.array_equal(np.diff(words.first), [len(features(t)[0]) for t in texts])
