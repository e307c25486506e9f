import random
import re
from collections import Counter, defaultdict

import pytest

from stressline.llm import source_mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if per * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: per * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def _rows(n, seed):
    r = random.Random(seed)
    rows = [(0, None, "b"), (1, "", None), (2, " \n", "a"), (3, "x", None), (None, "no id here", "c")]
    for i in range(4, n):
        src = r.choice(["a"] * 8 + ["b", "c", "é", None, "Z"])
        rows.append((i, " ".join("w%d" % r.randrange(99) for _ in range(r.choice([1, 3, 50, 900]))), src))
    rows += [(7, rows[9][1], "b"), (9, rows[9][1], rows[9][2]), (9, rows[9][1], rows[9][2])]
    return rows


@pytest.mark.parametrize(("block", "n"), [(256, 150), (7, 60), (1, 20)])
def test_targets_and_limits(spark, block, n):
    rows = _rows(n, block)
    df = spark.createDataFrame([(d, t, s, 5, "q") for d, t, s in rows], "doc_id long, text string, source string, size int, block string").repartition(3)
    run = lambda: sorted((tuple(x) for x in M.mix_digest(df, block_words=block).collect()), key=str)
    got = run()
    assert got == run()
    assert Counter((d, n) for d, n, *_ in got) == Counter((d, len(WORD.findall(t or ""))) for d, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = water_fill(dict(sizes))
    source = {d: s for d, _, s in rows if d != 9 and d != 7}
    taken, target = Counter(), {}
    for d, size, source_size, t, got_words in got:
        assert 0 <= got_words <= 2 * size
        if d in source:
            s = source[d]
            assert source_size == sizes[s] and t == pytest.approx(want[s])
        taken[(source_size, t)] += got_words
    for (_, t), words in taken.items():
        assert abs(words - t) <= 1.0, (t, words)


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        df = spark.range(n).withColumn("p", M.permuted(F.col("id"), F.lit(n), [F.lit(3)], 16, 1))
        rows = df.withColumn("back", M.permuted(F.col("p"), F.lit(n), [F.lit(3)], 16, 1, inverse=True)).collect()
        assert sorted(x["p"] for x in rows) == list(range(n)) and all(x["back"] == x["id"] for x in rows)


def test_texts_are_what_was_taken(spark):
    rows = _rows(60, 3)
    df = spark.createDataFrame([(d, t, s, len(t or "")) for d, t, s in rows], "doc_id long, text string, source string, n_chars long")
    mixed = M.mixed_texts(df, block_words=16)
    assert mixed.columns == df.columns
    words = Counter()
    for x in mixed.collect():
        assert any(x["text"] in (t or "") for d, t, _ in rows if d == x["doc_id"]) and x["n_chars"] == len(x["text"])
        words[x["doc_id"]] += len(WORD.findall(x["text"]))
    want = Counter()
    for x in M.mix_digest(df, block_words=16).collect():
        want[x["doc_id"]] += x["taken"]
    assert words == +want


def test_empty_table(spark):
    assert M.mix_digest(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
