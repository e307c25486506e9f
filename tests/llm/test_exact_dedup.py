import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stressline.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        keep = rows[best[3]][0]
        out += [(rows[i][0], keep, len(members), i == best[3], hashlib.sha256(norm.encode()).hexdigest()) for *_, i in members]
    return out


ROWS = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, "a b"), (4, "ab"), (5, "a  b"), (6, "a b"), (7, "A b"), (8, "a b\n"), (None, "a   b "), (None, "only here"), (9, "é x"), (10, "éx "), (11, "x" * 30_000)]


@pytest.mark.parametrize("hash_fn", [X.content_hash, lambda n: F.crc32(n.cast("binary")) % 2])
def test_matches_brute_force(spark, hash_fn):
    r = random.Random(1)
    rows = ROWS + [(100 + i, r.choice(["hot text here", "hot  text here", "hot text\there"])) for i in range(200)] + [(400 + i, f"own {i}") for i in range(20)]
    df = spark.createDataFrame([(d, t, "z", 3) for d, t in rows], "doc_id long, text string, h string, points int").repartition(7)
    got = [tuple(x) for x in X.exact_groups(df, hash_fn=hash_fn).collect()]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_repeated_rows_keep_one(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (None, "c"), (None, "c")]
    got = X.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(x["kept"] for x in got) == 2 and {x["group_size"] for x in got} == {3, 2}


def test_empty_table(spark):
    assert X.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
