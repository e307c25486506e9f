import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stressline.llm import repeated_spans as R


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc, _), r in zip(rows, raws, strict=True):
        cover = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(b for b, c in zip(r, cover, strict=False) if not c)
        spans = int((cover[:-1] & ~np.r_[False, cover[:-2]]).sum()) if len(r) else 0
        out.append((doc, len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _rows(seed, letters):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    rows = [(0, None), (1, ""), (2, "short"), (3, "x" * 199), (4, "y" * 450), (5, "é" * 130)]
    passages = [word(r.choice([30, 200, 201, 230, 500])) for _ in range(8)]
    for i in range(6, 70):
        text = ""
        for _ in range(r.randint(1, 6)):
            p = r.choice(passages)
            a, b = sorted((r.randrange(len(p) + 1), r.randrange(len(p) + 1)))
            text += r.choice([p, p[a:b], word(r.randint(1, 300)), "\0ab" * r.randint(1, 90), p[:-1] + "é"])
        rows.append((i, text))
    rows += [(7, rows[9][1]), (None, rows[9][1]), (None, rows[12][1][:-3]), (99, word(3000) + rows[20][1] * 2)]
    return rows


@pytest.mark.parametrize(("length", "trigger", "block", "letters"), [(200, 32, 16, "abcdefgh "), (20, 4, 5, "ab"), (40, 8, 16, "abé")])
def test_matches_brute_force(spark, length, trigger, block, letters):
    rows = _rows(length, letters)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, t1 int, spans string").repartition(4)
    got = R.remove_repeats(df, length=length, trigger=trigger, block=block)
    got = [tuple(x) for x in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(brute(rows, length), key=key)


def test_empty_table(spark):
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_bytes_and_spans_agree(spark):
    p = "".join(chr(97 + i * i % 23) for i in range(260))
    rows = [(1, "start " + p + " end"), (2, p), (3, "own text " * 3)]
    out = {x["doc_id"]: x for x in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_bytes=True).collect()}
    assert bytes(out[1]["kept"]) == b"start  end" and [tuple(s) for s in out[1]["removed"]] == [(6, 266)]
    assert bytes(out[2]["kept"]) == b"" and bytes(out[3]["kept"]) == rows[2][1].encode()
