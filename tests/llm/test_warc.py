import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from stressline.llm import warc as W
from stressline.llm.storage import Scratch


def _pages():
    r = random.Random(3)
    long_ = ["<p>" + "é%d " % i * 400 for i in range(5)]
    rows = [(0, None, None), (1, "", ""), (2, "http://A.example.com:80/x?b=1#f", "a" * 999), (3, "http://b.example.com/", "a" * 999), (4, "x\r\ny z", "b" * 1000), (5, "https://u:p@www.example.com", "b" * 1000)]
    rows += [(10 + i, f"http://h{r.randrange(4)}.example.org/{r.randrange(6)}", r.choice([*long_, "short", None, f"own {i} " * 300])) for i in range(120)]
    return rows + [(10, rows[6][1], rows[6][2]), (None, "http://n/", long_[0]), (None, None, "z" * 2000)]


def brute(rows):
    groups = defaultdict(list)
    for i, (p, _, h) in enumerate(rows):
        raw = (h or "").encode()
        groups[raw if len(raw) >= 1000 else (i,)].append(p)
    out = []
    for i, (p, _, h) in enumerate(rows):
        raw = (h or "").encode()
        known = [x for x in groups[raw if len(raw) >= 1000 else (i,)] if x is not None]
        first = max(known) if known and len(raw) >= 1000 else None
        refers = first if first is not None and p != first else None
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


@pytest.mark.parametrize("segment", [1 << 20, 2000])
def test_round_trip(spark, segment):
    rows = _pages()
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "page_id long, url string, html string, digest string, run int").repartition(4)
    got = W.capture_histories(df, segment_bytes=segment).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted([tuple(x)[:5] for x in got], key=key) == sorted(brute(rows), key=key)
    by = sorted(got, key=lambda x: (x["merge_part"], x["merge_place"]))
    order = [(x["url_key"], x["captured"], x["page_id"] is not None, x["page_id"] or 0) for x in by]
    assert order == sorted(order)
    assert W.capture_histories(df.limit(0)).count() == 0


def test_archives_are_plain_gzip(spark, tmp_path):
    df = spark.createDataFrame(_pages(), "page_id long, url string, html string").coalesce(2)
    paths = W.export_archives(W.write_archives(df, Scratch(spark, "warc"), segment_bytes=3000), str(tmp_path))
    raw = b"".join(gzip.open(p).read() for p in paths)
    assert raw.count(b"WARC/1.1\r\n") == len(_pages())


def test_loser_tree_merges():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(20))) for _ in range(k)]
        assert list(W.LoserTree([iter(x) for x in runs], lambda v: v)) == sorted(v for x in runs for v in x)


def test_url_keys():
    assert W.url_key("http://www.A.example.com:80/x?b=1#f") == "com,example,a)/x?b=1"
    assert W.url_key("https://u:p@example.com") == "com,example)/" and W.url_key(None) == ")/"
