"""The remote source against a server on this machine: batch, stream, pushed filters, refusals and the cache."""

import datetime as dt
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from stressline.plans import config as C
from stressline.plans import run as RUN
from stressline.sources import remote as RS

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(12)]


class Server:
    def __init__(self):
        self.asked, self.refuse = [], {}
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                url = urlparse(self.path)
                symbol, q = url.path.strip("/").removesuffix(".csv").replace("%5E", "^"), parse_qs(url.query)
                outer.asked.append((symbol, q["from"][0], q["to"][0]))
                if outer.refuse.get(symbol, 0):
                    outer.refuse[symbol] -= 1
                    self.send_error(503)
                    return
                self.send_response(200)
                self.end_headers()
                rows = [] if symbol == "NONE" else [f"{100 + i},{99 + i},{d} 00:00:00,{101 + i},{100.5 + i},{'' if i == 3 else 10 * i}" for i, d in enumerate(DAYS)]
                self.wfile.write("\n".join(["Open,Low,Date,High,CLOSE,Volume", *rows, ",,,,,"]).encode())

            def log_message(self, *_):
                pass

        self.http = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/{{symbol}}.csv?from={{start}}&to={{end}}"


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def _sorted(df):
    return sorted(map(tuple, df.select("symbol", "date", "open", "high", "low", "close", "volume").collect()))


def test_batch_with_pushed_filters(spark, server):
    df = RS.read_bars(spark, ["A", "^B", "NONE"], url=server.url, end="2024-02-01")
    rows = _sorted(df)
    assert df.rdd.getNumPartitions() == 3 and len(rows) == 24 and rows[3] == ("A", DAYS[3], 103.0, 104.0, 102.0, 103.5, None)
    server.asked.clear()
    some = df.where((F.col("symbol") == "^B") & (F.col("date") > F.lit(DAYS[2])) & (F.col("date") <= F.lit(DAYS[5])) & (F.col("close") > 104))
    assert _sorted(some) == [r for r in rows if r[0] == "^B" and DAYS[2] < r[1] <= DAYS[5] and r[5] > 104]
    assert set(server.asked) == {("^B", "2024-01-04", "2024-01-06")}
    assert _sorted(df.where("symbol in ('A', 'X')")) == rows[:12]
    assert _sorted(df.where("date > date'2030-01-01'")) == []


def test_stream_reads_what_the_batch_reads(spark, server, tmp_path):
    want = _sorted(RS.read_bars(spark, ["A", "B"], url=server.url, start="2024-01-01", end="2024-01-12"))
    for until in ("2024-01-05", "2024-01-05", "2024-01-12"):
        src = spark.readStream.format("bars").options(symbols='["A", "B"]', url=server.url, start="2024-01-01", until=until).load()
        q = src.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        if until == "2024-01-05":
            assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    assert _sorted(spark.read.parquet(f"{tmp_path}/out")) == want and len(want) == 24


def test_refused_partitions_are_asked_again(spark, server):
    server.refuse = {"A": 2}
    assert RS.read_bars(spark, ["A", "B"], url=server.url, wait="0.01").count() == 24
    assert sum(a[0] == "A" for a in server.asked) == 3
    server.refuse = {"A": 9}
    with pytest.raises(Exception, match="503"):
        RS.read_bars(spark, ["A"], url=server.url, wait="0.01", attempts="2").count()
    with pytest.raises(Exception, match="url or a fetch"):
        RS.read_bars(spark, ["A"]).count()


def rows_of(symbol, start, end):
    return [(d, 1, 2, 0.5, float("nan"), None) for d in DAYS] if symbol == "A" else None


def test_a_function_in_place_of_a_url(spark):
    got = _sorted(RS.read_bars(spark, ["A", "B"], fetch="tests.test_remote:rows_of", start="2024-01-11"))
    assert got == [("A", d, 1.0, 2.0, 0.5, None, None) for d in DAYS[10:]]


def test_the_run_fills_and_refreshes_its_cache(spark, server, tmp_path):
    c = C.EngineConfig(C.DataConfig(primary="A", optional=("B", "NONE")))
    load = lambda **o: RUN.load_bars(spark, str(tmp_path), c, wait=0.01, **o)
    first = _sorted(load(url=server.url))
    assert len(first) == 24 and {r[0] for r in first} == {"A", "B"}
    server.asked.clear()
    assert _sorted(load(url=server.url)) == first and {a[0] for a in server.asked} == {"NONE"}
    server.asked.clear()
    assert _sorted(load(url=server.url, refresh=True)) == first and {a[0] for a in server.asked} == {"A", "B", "NONE"}
    server.refuse = {"A": 99, "B": 99, "NONE": 99}
    assert _sorted(load(url=server.url, refresh=True)) == first  # the cache stands in
    assert _sorted(load()) == first
    with pytest.raises(RuntimeError):
        RUN.load_bars(spark, f"{tmp_path}/empty", c)
