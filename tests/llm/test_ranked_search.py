import math
import random
import re

import numpy as np
import pytest

from stressline.llm import ranked_search as R

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    split = [(d, _terms(t)) for d, t in docs]
    n_docs, length = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    df = {w: sum(w in t for _, t in split) for w in set().union(*asked.values())} if asked else {}
    out = []
    for i, words in asked.items():
        found = []
        for d, t in split:
            m = 10 + (90 * len(t) * n_docs) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * t.count(w) // (1000 * t.count(w) + 8 * m)) for w in words if w in t)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, 5, 1.0) for x in docs], "doc_id long, text string, rank int, score double").repartition(3)
    q = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, doc_id int")
    return sorted((tuple(x[c] for c in ("item_id", "rank", "doc_id", "score")) for x in R.rank_documents(d, q, **options).collect()), key=str)


def _docs(seed, n=400):
    r = random.Random(seed)
    words = [f"{a}{i}" for i, a in enumerate(["the", "Of", "é", "İx", "日本", "a_b", "x-y", "Z"] * 12)]
    odds = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, odds, k=r.choice([1, 3, 20, 90])))) for i in range(n)]
    docs += [(None, docs[3][1]), (7, docs[7][1]), (7, docs[7][1]), (n, None), (n + 1, ""), (n + 2, "!? \n"), (n + 3, "the0 " * 30_000 + "Of1")]
    docs += [(1000 + i, "copied Of1 the0 é2 the8") for i in range(150)]
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 2, 8, 30])))) for i in range(40)]
    items += [(40, None), (41, "..."), (None, "the0 é2"), (5, "copied"), (5, "copied the0"), (42, "nowhere at all"), (43, "COPIED of1 THE0")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_rows": 64}, {"shard_postings": 200, "items_at_once": 9}, {"k": 3}])
def test_ranks_equal_brute_force(spark, options):
    docs, items = _docs(1)
    assert run(spark, docs, items, **options) == brute(docs, items, options.get("k", 10))


def test_empty_tables(spark):
    docs, items = _docs(2, 20)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, docs, [(1, None)]) == run(spark, [(1, None), (2, " ")], items) == []


def _shard(seed, n, terms):
    rng = np.random.default_rng(seed)
    t, s, f = [], [], []
    for i in range(terms):
        at = np.sort(rng.choice(n, int(n * rng.random() ** 3) + 1, replace=False))
        t.append(np.full(len(at), i)), s.append(at), f.append(rng.geometric(0.4, len(at)) * rng.choice([1, 1, 1, 400, 90_000], len(at)))
    t, s, f = (np.concatenate(x).astype(np.int64) for x in (t, s, f))
    return R.Shard(t, s, f, rng.integers(10, 900, n)), t, s, f, rng


def test_blocks_are_read_back():
    shard, t, s, f, _ = _shard(1, 90_000, 12)
    for i in range(12):
        p = shard.lists[i]
        slot, tf = shard.read(p.rows, p.count)
        assert (slot == s[t == i]).all() and (tf == f[t == i]).all()
        assert [int(R.impacts(f[t == i][b * 128 : b * 128 + 128], shard.m[s[t == i][b * 128 : b * 128 + 128]]).max()) for b in range(len(p.rows))] == p.top.tolist()


def test_search_rejects_blocks_and_loses_nothing():
    shard, t, s, f, rng = _shard(2, 20_000, 40)
    value = R.impacts(f, shard.m[s])
    acc, total, read = np.zeros(20_000, np.int64), 0, 0
    for _ in range(60):
        terms = np.sort(rng.choice(44, rng.integers(1, 12), replace=False))
        weight = rng.integers(0, 7000, 44)
        full = np.zeros(20_000, np.int64)
        for i in terms:
            full[s[t == i]] += weight[i] * value[t == i]
        floor = max(1, int(np.sort(full)[-rng.choice([1, 10, 500])]))
        slot, score, n = shard.search(terms, weight, 10, floor, acc)
        assert not acc.any() and (score == full[slot]).all()
        last = max(floor, int(np.sort(full)[-10]))
        assert set(np.flatnonzero(full >= last)) <= set(slot.tolist())
        total, read = total + sum(len(shard.lists[i].rows) for i in terms if i in shard.lists), read + n
    assert read < 0.9 * total
