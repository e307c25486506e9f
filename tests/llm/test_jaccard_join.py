import random

import numpy as np
import pytest

from stressline.llm import jaccard_join as J

from .brute import jaccard_components

SCHEMA = "doc_id long, text string, n long, term string"


def _rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 5)))
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one Two three"), (4, "ONE two  three"), (5, "one two"), (6, "a b c d e"), (7, "a b c d e f")]
    i = 8
    for family in range(25):
        base = [word() for _ in range(r.choice([4, 5, 6, 9, 30, 120, 700]))]
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy) if r.random() < 0.7 else "\n".join(copy).upper()))
            i += 1
    passage = " ".join(word() for _ in range(60))
    for _ in range(40):
        rows.append((i, passage + " " + " ".join(word() for _ in range(r.randint(3, 40)))))
        i += 1
    rows += [(8, rows[8][1]), (9, "another text under a used id"), (None, rows[20][1]), (None, "lonely words without any id at all")]
    return rows


@pytest.mark.parametrize("tile", [2048, 3])
def test_matches_brute_force(spark, tile):
    rows = _rows()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(5)
    got = [tuple(x) for x in J.jaccard_classes(df, tile_rows=tile, order_terms=50).select("doc_id", "n_shingles", "component_id").collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(jaccard_components(rows), key=key)


def test_empty_table(spark):
    assert J.jaccard_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (5, 40, 41, 300, 900)]
    sets = []
    for b in base * 12:
        s = b.copy()
        at = rng.integers(0, len(s), max(0, len(s) // 9))
        s[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    sizes = np.array([len(s) for s in sets])
    for i, s in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(s, sets[j]))
            if 100 * common >= 80 * (sizes[i] + sizes[j] - common):
                label = J.forest([J.bitmap(x) for x in sets], sizes, np.arange(len(sets)), 80)
                assert label[i] == label[j]
                return
    raise AssertionError("the fixture holds no pair")


def test_groups_of_near_copies_are_merged(spark, monkeypatch):
    """Near copies share shingles in many different subsets; their signatures and sets are sent about once, not once for each subset."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(20):
        base = [word() for _ in range(150)]
        for _ in range(12):
            copy = list(base)
            for _ in range(3):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    saved, save = {}, J.Scratch.save

    def counted(self, df, label):
        out = save(self, df, label)
        saved[label] = out.count()
        return out

    monkeypatch.setattr(J.Scratch, "save", counted)
    got = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(jaccard_components(rows))
    assert saved["member"] < 4 * len(rows) and saved["part"] < 2 * len(rows)
