import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

from .brute import jaccard_components
from .test_classifiers import _quality_rows
from .test_exact_dedup import brute as exact_brute


@pytest.fixture(scope="module")
def docs(spark):
    rows, good = _quality_rows(240, 21)
    r = random.Random(2)
    rows += [(500 + i, rows[i][1]) for i in range(20)] + [(600 + i, rows[i][1].replace(" ", "  ", 1)) for i in range(10)]
    for i in range(40):
        words = rows[i][1].split(" ")
        words[r.randrange(len(words))] = "changed"
        rows.append((700 + i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "é" * 5), (5, rows[5][1]), (None, "Plain words of a row that came without any id at all.")]
    full = [(d, t, r.choice(["en", None]), r.choice(["s1"] * 5 + ["s2", "s3", None]), None if t is None else len(t)) for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def _pairs(df):
    return [(x["doc_id"], x["text"]) for x in df.collect()]


def test_stages_in_turn(spark, docs):
    from stressline.llm.quality import score_quality

    kept = C.quality(spark, docs, "")
    want = {x["doc_id"] for x in score_quality(docs).collect() if x["keep"]}
    assert {d for d, _ in _pairs(kept)} == want and kept.schema == docs.schema
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    once = C.exact(spark, kept, "")
    rows = _pairs(kept)
    assert sorted(map(str, _pairs(once))) == sorted(str(rows[i]) for i, x in enumerate(_in_order(rows)) if x)
    assert once.columns == docs.columns
    once = spark.createDataFrame(once.collect(), once.schema)
    rows = _pairs(once)
    near = C.near(spark, once, "")
    assert sorted(str(d) for d, _ in _pairs(near)) == sorted(str(d) for d, _, c in jaccard_components(rows) if d == c or d is None)
    near = spark.createDataFrame(near.collect(), near.schema)
    mixed = C.mixing(spark, near, "")
    assert mixed.columns == docs.columns
    assert set(_pairs(mixed.select("doc_id", F.lit("").alias("text")))) <= {(d, "") for d, _ in _pairs(near)}
    packed = C.packing(spark, mixed, "")
    assert packed.where("length < 1 or offset + length > 2048").count() == 0 and packed.count() > 0


def _in_order(rows):
    """Which row of each group stays, by brute force on row numbers."""
    flags = [False] * len(rows)
    left = {}
    for d, keep, _, kept, sha in exact_brute(rows):
        if kept:
            left[sha] = keep
    import hashlib
    import re

    best = {}
    for i, (d, t) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        sha = hashlib.sha256(norm.encode()).hexdigest()
        if d == left[sha] and (sha not in best or len(t or "") > len(rows[best[sha]][1] or "")):
            best[sha] = i
    for i in best.values():
        flags[i] = True
    return flags


def test_run_writes_every_stage(spark, sf):
    out = C.run(spark, sf)
    assert out.count() > 0 and C.ORACLE_SQL is None and len(C.STAGES) == 5
