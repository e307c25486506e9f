import random
import zlib

import pytest

from stressline.llm import hilbert_shards as H


@pytest.mark.parametrize(("bits", "dims"), [(1, 1), (3, 2), (4, 3), (2, 4)])
def test_curve_visits_neighbours(bits, dims):
    table = H.hilbert_table(bits, dims)
    assert sorted(table) == list(range(1 << (bits * dims)))
    cells = [0] * len(table)
    for cell, index in enumerate(table):
        cells[index] = cell
    split = lambda c: [(c >> (bits * d)) & ((1 << bits) - 1) for d in range(dims)]
    for a, b in zip(cells, cells[1:], strict=False):
        assert sum(abs(x - y) for x, y in zip(split(a), split(b), strict=True)) == 1


def _docs(spark, n):
    r = random.Random(n)
    rows = [(i, None if i % 17 == 0 else "é" * r.randrange(300), r.choice(["s1", "s10", None, "s2"]), r.choice(["en", "fr", None])) for i in range(n)]
    rows += [(None, "x", "s1", "en")] * 3 if n else []
    return rows, spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, lang string, shard int, rank int").repartition(3)


@pytest.mark.parametrize("n", [0, 1, 10, 500])
def test_law_rows(spark, n):
    rows, df = _docs(spark, n)
    got = H.document_shards(df, 24).collect()
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert sorted((str(x["doc_id"]), x["size"], x["text_crc32"]) for x in got) == want
    slots = [sorted(x["slot"] for x in got if x["shard"] == s) for s in range(24)]
    assert all(s == list(range(len(s))) for s in slots) and sum(map(len, slots)) == len(rows)
    assert max(map(len, slots)) - min(map(len, slots)) <= 1
    by = sorted((x["shard"], x["slot"], x["hilbert"]) for x in got)
    assert [x[2] for x in by] == sorted(x[2] for x in by)
    if n == 500:
        assert len({x["hilbert"] for x in got}) > 50
        spread = [len({x["source"] for x in got if x["shard"] == s}) for s in range(24)]
        assert sum(spread) / 24 < 2.5  # of 4: files hold few sources
    assert all(x["grown_shard"] is None and x["law"] == "rows" for x in got)
