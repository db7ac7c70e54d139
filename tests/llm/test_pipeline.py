"""The pipeline's stages, each on its own input and all in a row."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from heddle.llm.common import written


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 8))) for _ in range(600)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    rows = [(i, text(80), ["en", "fr", None][i % 3], f"s{i % 2}") for i in range(240)]
    rows += [(500 + i, rows[i][1], "en", "s0") for i in range(5)]  # exact copies
    rows += [(510 + i, rows[20 + i][1] + " more", "en", "s1") for i in range(5)]  # near copies
    rows += [(520, "12345 67 89 !!", "en", "s0"), (521, None, None, None), (522, "", "en", "s0")]  # no language
    rows += [(530, "too short", "en", "s0"), (531, "again and again " * 30, "en", "s0")]  # fail the base rules
    rows += [(540, text(60) + ' password = "Abc123xyz789QQ" ' + text(10), "en", "s0")]
    rows += [rows[30]]  # a repeated row
    return spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_stages(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "near_duplicates", "secret_scans", "packing"]
    ids = []
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, now, ""))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        ids.append(Counter(r["doc_id"] for r in out.select("doc_id").collect()))
        now = out
    first = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    assert first - ids[0] == Counter([520, 521, 522]) and not now.filter("lang is null").count()
    assert ids[0] - ids[1] == Counter([530, 531])
    assert ids[1] - ids[2] == Counter([*range(500, 505), *range(510, 515), 30])
    assert ids[3] == ids[2]
    row = now.filter("doc_id = 540").collect()[0]
    assert "Abc123xyz789QQ" not in row["text"] and "[secret]" in row["text"] and row["n_chars"] == len(row["text"])
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(ids[3])


def test_near_duplicates_of_ids_with_several_texts(spark):
    rnd = random.Random(7)
    text = lambda: " ".join(rnd.choice("abcdefghijkl") + str(rnd.randint(0, 999)) for _ in range(60))
    old, other, third, fourth = text(), text(), text(), text()
    rows = [(1, old), (7, old + " more"), (7, other), (8, third), (8, fourth), (8, fourth), (9, third + " more"), (None, old), (None, old)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.dtypes == df.dtypes
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got[1, old] == got[7, other] == got[8, fourth] == 1 and got[None, old] == 2 and not got[7, old + " more"]
    assert got[8, third] + got[9, third + " more"] == 1 and sum(got.values()) == 6


def test_empty(spark, docs):
    now = docs.filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, ""))
    assert now.count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    n = out.select("doc_id").distinct().count()
    assert 100 < n < 200
