"""The pipeline's stages against plain computations, each on the rows that the one before it kept."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from halofield.llm import language_id, secret_scan

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def corpus():
    rng = random.Random(11)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(300)] for lang, letters in (("en", "abcdefgh"), ("fr", "mnopqrst"))}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, prose(("en", "fr")[i % 2], 120), ("en", "fr")[i % 2], "s", 0) for i in range(120)]
    item = prose("en", 20)
    near = rows[2][1].split()
    near[50] = vocabulary["en"][0]
    rows += [(200, rows[0][1], "en", "s", 0), (201, " ".join(near), "en", "s", 0), (202, prose("en", 60) + " " + item + " " + prose("en", 60), "en", "s", 0)]
    rows += [(203, prose("fr", 100) + " password=abcdefgh1234 " + prose("fr", 20), "fr", "s", 0), (204, None, "en", "s", 0), (205, " 12 ", None, None, None), (None, prose("fr", 90), "fr", "s", 0)]
    return rows, item


def brute_near(rows):
    """The rows that are the smallest doc_id of their group."""
    sets = {}
    for d, text in rows:
        w = (text or "").split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    ids = sorted(d for d in sets if d is not None)
    label = {d: d for d in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return {d for d in ids if label[d] == d} | {d for d, _ in rows if d is None}


def test_pipeline(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = STAGES["language ID"](spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    model = language_id.learn(docs.where(~language_id.held_out()))
    coders = language_id.compressors(model.dictionaries)
    clear = []
    for d, text, *_ in rows:
        if raw := language_id.letters(text):
            name, _, gap, best = language_id.classified(raw, coders)
            if gap >= max(1, model.narrow * best):
                clear.append((d, text, name))
    assert sorted(((r.doc_id, r.text, r.lang) for r in first.collect()), key=repr) == sorted(clear, key=repr)
    assert {204, 205}.isdisjoint(d for d, *_ in clear) and len(clear) >= 110

    kept = brute_near([(d, t) for d, t, _ in clear])
    assert 200 not in kept and 201 not in kept and {0, 2, 202, 203, None} <= kept
    left = [(d, t) for d, t, _ in clear if d in kept and f" {item} " not in f" {t} "]
    assert 202 not in {d for d, _ in left}

    def redacted(text):
        out, upto = "", 0
        for k, a, b in secret_scan.scan([text])[0]:
            if a >= upto:
                out += text[upto:a] + f"[{secret_scan.KINDS[k]}]"
            upto = max(upto, b)
        return out + text[upto:]

    want = {d: hashlib.sha256(redacted(t).encode()).hexdigest() for d, t in left}
    assert "[assign]" in redacted(dict(left)[203]) and "abcdefgh1234" not in redacted(dict(left)[203])
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "decoded_sha256").collect()
    assert len(got) == len(left) and {r.doc_id: r.decoded_sha256 for r in got} == want


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
