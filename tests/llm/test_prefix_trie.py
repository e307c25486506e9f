import hashlib
import random
import zlib

import numpy as np
import pytest

from stressline.llm import prefix_trie as T

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, graft=(5, 9)):
    """The nodes by plain dictionaries."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), tie, (role, text)))
    convs = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % graft[1] if graft else 0
        base = convs.get(c - int(np.fmod(c, graft[0])), []) if graft else []
        rebuilt[c] = tuple(base[:h]) + tuple(own[h:])
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in below)]
        ends = sorted(c for c in members if len(rebuilt[c]) == len(p))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), len(leaves),
            sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, seq string").repartition(3)
    return sorted((tuple(x[c] for c in COLUMNS) for x in T.prefix_nodes(df, **options).collect()), key=str)


def _rows(seed, convs=60, words=3, most=30):
    r = random.Random(seed)
    rows, kept = [], []
    for c in r.sample(range(-20, 400), convs):
        n = r.choice([1, 2, 3, 5, 9, 17, most])
        seq = r.choice(kept)[: r.randint(1, most)] if kept and r.random() < 0.5 else []
        seq = seq + [(r.choice(["user", "assistant", None]), r.choice([None, "", *("wé" * k for k in range(1, words))])) for _ in range(n)]
        kept.append(seq)
        rows += [(c, t if t else None, *x) for t, x in enumerate(seq)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block", [(1, 8), (2, 8), (3, 1024)])
def test_nodes_equal_brute_force(spark, seed, block):
    rows = _rows(seed)
    assert run(spark, rows, graft=(5, 9), block=block) == brute(rows)


def test_without_grafting_and_with_copies(spark):
    same = [("user", "hello"), ("assistant", "a" * 50_000), ("user", None)] * 9
    rows = [(c, t, *x) for c in range(40) for t, x in enumerate(same)] + [(90, 0, "user", "hello"), (91, 5, None, None), (91, 5, None, None), (None, 1, "user", "lost")]
    assert run(spark, rows, graft=None, block=8) == brute(rows, None)
    assert run(spark, rows, graft=(5, 9), block=8) == brute(rows)


def test_edge_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None, None, None)]) == []
    rows = [(3, None, None, None)]  # h is 8 or less: conversations may lose all their turns
    for c in range(1, 12):
        rows.append((c, c, "r", "t"))
    assert run(spark, rows, graft=(5, 9)) == brute(rows)
    bad = spark.createDataFrame([(1, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    with pytest.raises(ValueError):
        T.prefix_nodes(bad, graft=(5, 9), block=4)


def test_sparse_table_minima():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 9, 77)
    table = T.sparse_table(v)
    lo, hi = np.sort(rng.integers(0, 77, (2, 500)), axis=0)
    assert T.range_min(table, lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]


def test_extents_are_searched_for_each_candidate():
    rng = np.random.default_rng(4)
    lcp = rng.integers(0, 6, 60)
    lcp[0] = -1
    row, depth = np.divmod(np.arange(60 * 6), 6)
    left, right = T.extents(T.sparse_table(lcp), row, depth)
    for i, d, lo, hi in zip(row, depth, left, right, strict=True):
        a = b = i
        while a > 0 and lcp[a] >= d:
            a -= 1
        while b + 1 < 60 and lcp[b + 1] >= d:
            b += 1
        assert (a, b) == (lo, hi)
