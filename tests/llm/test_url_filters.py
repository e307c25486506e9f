import random

import pytest
from pyspark.sql import functions as F

from stressline.llm import url_filters as U

URLS = [
    None, "", "no scheme/at all", "http://", "https://Example.NET/en/x?b=2&a=1#f", "http://a.b.example.net/EN/", "http://example.net/en", "http://net/", "http://net", "http://notnet/", "ftp://x.net?en/#/", "http://www.x.org:80/fr/1/",
    "http://x.org/fr/1?utm_source=q", "http://X.ORG/fr/1?ref=z", "http://ÀB.example.com/de/ä?x#y://z", "http://example.com/de/", "http://com/a", "http://www.com/a/", "http://com:443/a//?utm_a=1", "http://com/a?utm", "http://com/a?b&a", "http://com/a?a&b#z",
    "http://xexample.net/en/", "a://b://c/d", "http://h\n.com/p\nq?r\ns",
]


def _canonical(url):
    if "://" not in (url or ""):
        return None
    rest = url.split("://", 1)[1]
    rest = rest.split("#", 1)[0]
    path, _, query = rest.partition("?")
    host, slash, path = path.partition("/")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host).removeprefix("www.")
    for port in (":80", ":443"):
        if host.endswith(port):
            host = host[: -len(port)]
            break
    kept = sorted(p for p in query.split("&") if p and not p.startswith(("utm_", "ref=")) and p != "ref")
    return host + (slash + path).rstrip("/") + ("?" + "&".join(kept) if kept else "")


def _judge(url, listed):
    if "://" in (url or ""):
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    else:
        host = path = ""
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        best = max(fits)
        return host, path, best[1], best[2]
    return host, path, None, "block" if _canonical(url) is not None and _canonical(url) in {_canonical(x) for x in listed} else "allow"


@pytest.mark.parametrize("bits, most", [(16, 1 << 17), (1, 1)])
def test_verdicts_equal_brute_force(spark, bits, most):
    r = random.Random(1)
    more = [f"http://{r.choice(['', 'www.'])}h{r.randrange(30)}.info/{r.randrange(30)}{r.choice(['', '/', '?utm_x=1', '#a'])}" for _ in range(1500)]
    urls = URLS + more + ["http://hot.info/x"] * 700
    listed = [*r.sample(more, 200), "HTTP://WWW.com/a", "http://hot.info/x/", None, "junk", "http://com/a?b&a"] * 2
    pages = spark.createDataFrame([(i if i % 50 else None, u, "k") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(5)
    out = U.filter_urls(pages, spark.createDataFrame([(x,) for x in listed], "link string"), bits_a_key=bits, most_blocks=most)
    got = sorted(map(str, out.select("page_id", "host", "path", "rule", "verdict").collect()))
    from pyspark.sql import Row

    want = sorted(str(Row(page_id=i if i % 50 else None, host=h, path=p, rule=x, verdict=v)) for i, u in enumerate(urls) for h, p, x, v in [_judge(u, listed)])
    assert got == want
    assert out.where("listed and not possible").count() == 0  # no false negatives


def test_the_filter_lets_few_others_through(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks, n = U.build_filter(keys, "key")
    assert n == 625 and blocks.count() <= n
    probed = U.probe_filter(spark.range(40_000).select("id", F.concat(F.lit("k"), "id").alias("key")), "key", blocks, n, "possible")
    inside, outside = (probed.where(f"possible and id {c} 20000").count() for c in ("<", ">="))
    assert inside == 20_000 and outside < 300


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.info/b")], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    assert [x["verdict"] for x in U.filter_urls(pages, none).collect()] == ["allow"]
    assert [x["verdict"] for x in U.filter_urls(pages, pages.select("url"), rules=()).collect()] == ["block"]
    assert U.filter_urls(pages.limit(0), pages.select("url")).count() == 0
