"""Named queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stressline.functions.columns import ANNUAL, by_symbol, rounded
from stressline.models import arma as AM
from stressline.models import estimators as E
from stressline.models import garch as GA
from stressline.operators import anomaly as AN
from stressline.operators import events as EV
from stressline.operators import features as FT
from stressline.operators import filters as FL
from stressline.operators import risk as RK
from stressline.operators import statistics as ST
from stressline.operators import stress as SX
from stressline.operators import validation as VA
from stressline.plans import arma as AR
from stressline.plans import reports as RP
from stressline.plans import slices as SL
from stressline.plans import walk_forward as WF
from stressline.sources import bars as B
from stressline.streaming import stateful as SM

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def panel_bars(spark: SparkSession, d: str) -> DataFrame:
    """Five series, one for each order priority."""
    return B.index_bars(_read(spark, d, "orders"), symbol=F.col("o_orderpriority"), date="o_orderdate", value="o_totalprice")


def single_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.index_bars(_read(spark, d, "orders"), symbol=F.lit("IDX"), date="o_orderdate", value="o_totalprice")


def other_bars(spark: SparkSession, d: str, symbol: str = "SEC") -> DataFrame:
    return B.index_bars(_read(spark, d, "lineitem"), symbol=F.lit(symbol), date="l_shipdate", value="l_extendedprice")


def _bars_sql(table: str, symbol: str, date: str, value: str, tag: str = "") -> str:
    return f"""d{tag} as (select {symbol} symbol, cast({date} as date) date, avg({value}) a, min({value}) lo, max({value}) hi, count(*) volume from {table} group by 1, 2),
z{tag} as (select symbol, date, volume, (a - avg(a) over (partition by symbol)) / stddev_samp(a) over (partition by symbol) z, (hi - lo) / hi rng from d{tag}),
p{tag} as (select symbol, date, volume, rng, 1000 * exp(sum(0.01 * z) over (partition by symbol order by date rows unbounded preceding)) as close from z{tag}),
q{tag} as (select *, coalesce(lag(close) over (partition by symbol order by date), close) as open from p{tag}),
bars{tag} as (select symbol, date, round(open, 4) as open, round(greatest(open, close) * (1 + 0.005 * rng), 4) high, round(least(open, close) * (1 - 0.005 * rng), 4) low, round(close, 4) as close, cast(volume as double) volume from q{tag})"""


PANEL = "with " + _bars_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice")
SINGLE = "with " + _bars_sql("orders", "'IDX'", "o_orderdate", "o_totalprice")
OTHER = _bars_sql("lineitem", "'SEC'", "l_shipdate", "l_extendedprice", "2")
BY = "partition by symbol order by date"
RET = ", r as (select *, row_number() over (" + BY + ") - 1 as rn, ln(close) - lag(ln(close)) over (" + BY + ") as ret from bars)"


def _w(n: int) -> str:
    return f"({BY} rows between {n - 1} preceding and current row)"


def _g(agg: str, c: str, n: int) -> str:
    return f"case when count({c}) over {_w(n)} = {n} then {agg}({c}) over {_w(n)} end"


# --- sources and validation -------------------------------------------------------------------------------------------


@query(PANEL + " select * from bars")
def bars_daily(spark: SparkSession, d: str) -> DataFrame:
    return panel_bars(spark, d)


@query(
    "select o_orderpriority symbol, cast(o_orderdate as date) date, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) high, min(o_totalprice) low, arg_max(o_totalprice, o_orderkey) as close, cast(count(*) as double) volume from orders group by 1, 2"
)
def bars_exact(spark: SparkSession, d: str) -> DataFrame:
    return B.exact_bars(_read(spark, d, "orders"), symbol=F.col("o_orderpriority"), date="o_orderdate", value="o_totalprice", order="o_orderkey")


@query("select o_custkey, cast(o_orderdate as date) date, arg_max(o_totalprice, o_orderkey) o_totalprice, max(o_orderkey) o_orderkey from orders group by 1, 2")
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice", "o_orderkey")
    return B.dedup_keep_last(rows, ["o_custkey", "date"], "o_orderkey")


@query("select p_name ticker, replace(replace(replace(p_name, '^', ''), '=', '_'), '/', '_') slug from (select distinct '^' || p_name || '=X/' || p_partkey as p_name from part)")
def ticker_slug(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "part").select(F.concat(F.lit("^"), "p_name", F.lit("=X/"), F.col("p_partkey").cast("string")).alias("ticker")).distinct()
    return t.select("ticker", B.slug(F.col("ticker")).alias("slug"))


@query(PANEL + " select symbol, count(*) as rows, min(date) first_date, max(date) last_date from bars group by 1")
def cache_metadata(spark: SparkSession, d: str) -> DataFrame:
    return B.cache_metadata(panel_bars(spark, d)).drop("content_hash")


def _broken(df: DataFrame) -> DataFrame:
    """Bars with planted faults, by the number of rows traded that day."""
    v = F.col("volume").cast("long")
    return df.withColumns({"high": F.when(v % 7 == 0, F.col("low") - 1).otherwise(F.col("high")), "low": F.when(v % 11 == 0, F.lit(-5.0)).when(v % 5 == 0, F.col("close") + 50).otherwise(F.col("low"))})


_BROKEN = ", bad as (select symbol, date, open, case when cast(volume as bigint) % 7 = 0 then low - 1 else high end high, case when cast(volume as bigint) % 11 = 0 then -5.0 when cast(volume as bigint) % 5 = 0 then close + 50 else low end low, close, volume from bars)"
_RULES = {"close_not_positive": "close <= 0", "high_below_body": "high < greatest(open, close) - 1e-6", "low_above_body": "low > least(open, close) + 1e-6", "low_not_positive": "low <= 0"}


@query(PANEL + _BROKEN + f" select symbol, date, open, high, low, close, volume, not ({' or '.join(_RULES.values())}) valid_ohlc from bad")
def ohlc_validate(spark: SparkSession, d: str) -> DataFrame:
    return VA.validate_ohlc(_broken(panel_bars(spark, d)))


@query(PANEL + _BROKEN + ", v as (" + " union all ".join(f"select symbol, date, '{n}' as rule from bad where {r}" for n, r in _RULES.items()) + ") select symbol, rule, count(*) violations, array_to_string(list_sort(list(date))[1:5], ',') dates from v group by 1, 2")
def ohlc_violations(spark: SparkSession, d: str) -> DataFrame:
    out = VA.ohlc_violations(_broken(panel_bars(spark, d)))
    return out.withColumn("dates", F.array_join(F.transform("dates", lambda x: x.cast("string")), ","))


@query(
    PANEL
    + f""", x as (select *, ln(close) - lag(ln(close)) over ({BY}) ret, date_diff('day', lag(date) over ({BY}), date) gap from bars)
select symbol, count(*) n_rows, min(date) first_date, max(date) last_date, count(*) - count(distinct date) duplicate_dates, count_if(abs(ret) > 0.02) large_moves,
round(100.0 * count_if(volume > 0) / count(*), 2) volume_coverage_pct, count_if(gap > 1) gaps, max(gap) longest_gap_days from x group by 1"""
)
def quality_profile(spark: SparkSession, d: str) -> DataFrame:
    return VA.quality_profile(panel_bars(spark, d), large_move=0.02, gap_days=1)


@query(PANEL + " select symbol, count_if(volume > 0) * 1.0 / count(*) >= 0.9 use_volume from bars group by 1")
def volume_gate(spark: SparkSession, d: str) -> DataFrame:
    return VA.volume_usable(panel_bars(spark, d))


# --- features ---------------------------------------------------------------------------------------------------------


@query(PANEL + RET + f" select symbol, date, round(ret, 8) as \"return\", round(100 * ret, 6) return_pct, round({_g('sum', 'ret', 5)}, 6) rolling_ret_5, round({_g('sum', 'ret', 20)}, 6) momentum_20, round({_g('sum', 'ret', 60)}, 6) momentum_60 from r")
def returns_momentum(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_returns(panel_bars(spark, d))
    return rounded(df.select("symbol", "date", F.round("return", 8).alias("return"), "return_pct", "rolling_ret_5", "momentum_20", "momentum_60"), keep=("return",))


@query(
    PANEL
    + RET
    + f""", v as (select *, {_g('stddev_samp', 'ret', 5)} * sqrt(252.0) rv_5, {_g('stddev_samp', 'ret', 20)} * sqrt(252.0) rv_20, {_g('stddev_samp', 'ret', 60)} * sqrt(252.0) rv_60 from r)
select symbol, date, round(rv_5, 6) rv_5, round(rv_20, 6) rv_20, round(rv_60, 6) rv_60, round(ln(greatest(rv_20, 1e-6)), 6) * case when rv_20 is null then null else 1 end ln_rv20,
case when rv_5 is null or rv_20 is null then null else round(ln(greatest(rv_5 / nullif(rv_20, 0), 1e-6)), 6) end vol_ratio_5_20 from v"""
)
def realized_vol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FT.add_volatility(FT.add_returns(panel_bars(spark, d))).select("symbol", "date", "rv_5", "rv_20", "rv_60", "ln_rv20", "vol_ratio_5_20"))


@query(
    PANEL
    + _BROKEN
    + f""", k as (select *, case when not ({' or '.join(_RULES.values())}) then power(ln(greatest(high / low, 1.0)), 2) / (4 * ln(2.0)) end pd from bad),
m as (select *, sqrt({_g('avg', 'pd', 20)}) * sqrt(252.0) p20 from k)
select symbol, date, round(pd, 8) parkinson_daily, round(p20, 6) parkinson_20, case when p20 is not null then round(ln(greatest(p20, 1e-6)), 6) end ln_parkinson from m"""
)
def parkinson(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_volatility(FT.add_returns(VA.validate_ohlc(_broken(panel_bars(spark, d)))))
    return df.select("symbol", "date", F.round("parkinson_daily", 8).alias("parkinson_daily"), F.round("parkinson_20", 6).alias("parkinson_20"), F.round("ln_parkinson", 6).alias("ln_parkinson"))


@query(PANEL + RET + f", n as (select *, power(least(ret, 0.0), 2) * case when ret is null then null else 1 end dn from r) select symbol, date, round(sqrt({_g('avg', 'dn', 20)}) * sqrt(252.0), 6) downside_semi_dev from n")
def downside_dev(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FT.add_volatility(FT.add_returns(panel_bars(spark, d))).select("symbol", "date", "downside_semi_dev"))


@query(PANEL + f" select symbol, date, round(close / max(close) over ({BY} rows unbounded preceding) - 1, 8) drawdown, round(close / ({_g('max', 'close', 252)}) - 1, 8) drawdown_252 from bars")
def drawdowns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FT.add_drawdowns(panel_bars(spark, d)).select("symbol", "date", "drawdown", "drawdown_252"), 8)


@query(
    PANEL
    + RET
    + f""", v as (select *, ln(greatest({_g('stddev_samp', 'ret', 20)} * sqrt(252.0), 1e-6)) l0, count(ret) over {_w(20)} c from r), l as (select *, case when c = 20 then l0 end lv from v),
y as (select *, {_g('avg', 'lv', 252)} m, {_g('stddev_samp', 'lv', 252)} s from l) select symbol, date, round((lv - m) / greatest(s, 1e-6), 5) vol_zscore_252 from y"""
)
def vol_zscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FT.add_volatility(FT.add_returns(panel_bars(spark, d))).select("symbol", "date", "vol_zscore_252"), 5)


@query(PANEL + RET + f" select symbol, date, round({_g('skewness', 'ret', 60)}, 4) skew_60_descriptive, round({_g('kurtosis', 'ret', 60)}, 4) kurt_60_descriptive from r")
def rolling_skew_kurt(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FT.add_volatility(FT.add_returns(panel_bars(spark, d))).select("symbol", "date", "skew_60_descriptive", "kurt_60_descriptive"), 4)


@query(PANEL + f", s as (select *, {_g('avg', 'close', 50)} s50, {_g('avg', 'close', 200)} s200 from bars) select symbol, date, round(ln(close / s50), 6) ln_p_sma50, round(ln(s50 / s200), 6) ln_sma50_sma200 from s")
def sma_relations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FT.add_trend(panel_bars(spark, d)).select("symbol", "date", "ln_p_sma50", "ln_sma50_sma200"))


@query(PANEL + f", l as (select *, ln(nullif(volume, 0)) lv from bars), y as (select *, {_g('avg', 'lv', 60)} m, {_g('stddev_samp', 'lv', 60)} s from l) select symbol, date, round((lv - m) / greatest(s, 1e-6), 5) volume_z_60 from y")
def volume_z(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FT.add_trend(panel_bars(spark, d)).select("symbol", "date", "volume_z_60"), 5)


_ALIGN = (
    SINGLE
    + ", "
    + OTHER
    + f""", lagged as (select date, lag(close) over (order by date) sc from bars2),
j as (select b.*, l.sc raw from bars b left join lagged l using (date)),
al as (select *, last_value(raw ignore nulls) over ({BY} rows between 3 preceding and current row) sec_close, ln(close) - lag(ln(close)) over ({BY}) ret from j)"""
)


@query(_ALIGN + " select symbol, date, close, sec_close from al")
def calendar_align(spark: SparkSession, d: str) -> DataFrame:
    return FT.align_to_calendar(single_bars(spark, d), other_bars(spark, d), ["close"], lag=1).select("symbol", "date", "close", "sec_close")


@query(
    _ALIGN
    + f""", rr as (select *, ln(sec_close) - lag(ln(sec_close)) over ({BY}) r2 from al),
cc as (select *, count(case when ret is not null and r2 is not null then 1 end) over {_w(60)} n, corr(ret, r2) over {_w(60)} c from rr)
select symbol, date, case when n = 60 then round(c, 6) end corr_sec_60 from cc"""
)
def rolling_corr(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_returns(FT.align_to_calendar(single_bars(spark, d), other_bars(spark, d), ["close"], lag=1))
    return rounded(FT.add_cross_asset(df, "sec_close", "sec").select("symbol", "date", "corr_sec_60"))


@query(_ALIGN + f", lv as (select *, case when sec_close is not null then greatest(sec_close, 1e-3) end vix_level from al) select symbol, date, vix_level, round(ln(vix_level) - lag(ln(vix_level), 20) over ({BY}), 6) vix_change_20 from lv")
def level_change_20(spark: SparkSession, d: str) -> DataFrame:
    df = FT.align_to_calendar(single_bars(spark, d), other_bars(spark, d), ["close"], lag=1)
    return rounded(FT.add_level_change(df, "sec_close", "vix").select("symbol", "date", "vix_level", "vix_change_20"))


@query(SINGLE + ", " + OTHER + " select b.symbol, b.date, b.close, s.close sec_close from bars b asof left join bars2 s on b.date > s.date")
def asof_align(spark: SparkSession, d: str) -> DataFrame:
    return FT.asof_align(single_bars(spark, d), other_bars(spark, d, "IDX"), ["close"]).select("symbol", "date", "close", "sec_close")


@query(
    PANEL
    + RET
    + f""", f as (select symbol, date, {_g('stddev_samp', 'ret', 20)} * sqrt(252.0) rv_20, close / max(close) over ({BY} rows unbounded preceding) - 1 drawdown, ret from r)
select symbol, count(*) n_rows, count(rv_20) n_vol, round(avg(ret), 8) mean_return, round(avg(rv_20), 6) mean_rv_20, round(max(rv_20), 6) max_rv_20, round(min(drawdown), 6) worst_drawdown from f group by 1"""
)
def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    df = FT.build_features(panel_bars(spark, d))
    out = df.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.count("rv_20").alias("n_vol"), F.round(F.avg("return"), 8).alias("mean_return"), F.avg("rv_20").alias("mean_rv_20"), F.max("rv_20").alias("max_rv_20"), F.min("drawdown").alias("worst_drawdown")
    )
    return rounded(out, keep=("mean_return",))


@query(
    PANEL + RET
    + f""", ok as (select *, not ({' or '.join(_RULES.values())}) valid_ohlc, ln(nullif(volume, 0)) lv from r),
f1 as (select *, {_g('stddev_samp', 'ret', 5)} * sqrt(252.0) rv_5, {_g('stddev_samp', 'ret', 20)} * sqrt(252.0) rv_20, {_g('stddev_samp', 'ret', 60)} * sqrt(252.0) rv_60,
 case when valid_ohlc then power(ln(greatest(high / low, 1.0)), 2) / (4 * ln(2.0)) end pd, case when ret is not null then power(least(ret, 0.0), 2) end dn, {_g('avg', 'close', 50)} s50, {_g('avg', 'close', 200)} s200 from ok),
f2 as (select *, case when rv_20 is not null then ln(greatest(rv_20, 1e-6)) end ln20, sqrt({_g('avg', 'pd', 20)}) * sqrt(252.0) p20 from f1)
select symbol, date, round(open, 6) as open, round(high, 6) high, round(low, 6) low, round(close, 6) as close, round(volume, 6) volume, valid_ohlc, rn, round(ret, 6) as "return", round(100 * ret, 6) return_pct,
 round({_g('sum', 'ret', 5)}, 6) rolling_ret_5, round({_g('sum', 'ret', 20)}, 6) momentum_20, round({_g('sum', 'ret', 60)}, 6) momentum_60, round(close / max(close) over ({BY} rows unbounded preceding) - 1, 6) drawdown, round(close / ({_g('max', 'close', 252)}) - 1, 6) drawdown_252,
 round(rv_5, 6) rv_5, round(rv_20, 6) rv_20, round(rv_60, 6) rv_60, round(ln20, 6) ln_rv20, case when rv_5 is not null and rv_20 is not null then round(ln(greatest(rv_5 / nullif(rv_20, 0), 1e-6)), 6) end vol_ratio_5_20, round(pd, 6) parkinson_daily, round(p20, 6) parkinson_20,
 round(sqrt({_g('avg', 'dn', 20)}) * sqrt(252.0), 6) downside_semi_dev, round({_g('skewness', 'ret', 60)}, 4) skew_60_descriptive, round({_g('kurtosis', 'ret', 60)}, 4) kurt_60_descriptive, case when p20 is not null then round(ln(greatest(p20, 1e-6)), 6) end ln_parkinson,
 round((ln20 - {_g('avg', 'ln20', 252)}) / greatest({_g('stddev_samp', 'ln20', 252)}, 1e-6), 5) vol_zscore_252, round(ln(close / s50), 6) ln_p_sma50, round(ln(s50 / s200), 6) ln_sma50_sma200, round((lv - {_g('avg', 'lv', 60)}) / greatest({_g('stddev_samp', 'lv', 60)}, 1e-6), 5) volume_z_60 from f2"""
)
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    df = FT.build_features(VA.validate_ohlc(panel_bars(spark, d)))
    coarse = {"skew_60_descriptive": 4, "kurt_60_descriptive": 4, "vol_zscore_252": 5, "volume_z_60": 5}
    return rounded(df.withColumns({c: F.round(c, n) for c, n in coarse.items()}))


# --- events -----------------------------------------------------------------------------------------------------------

EVENTS_SQL = f""", e0 as (select *, row_number() over ({BY}) - 1 rn, count(*) over (partition by symbol) n, min(close) over ({BY} rows between 1 following and 10 following) / close - 1 fwd from bars),
ev as (select symbol, date, open, high, low, close, volume, rn, fwd fwd_min_ret, case when n - rn > 10 and fwd <= -0.05 then 1 else 0 end event_label from e0)"""
ONSETS_SQL = """, pos as (select symbol, rn from ev where event_label = 1),
chain as (select symbol, min(rn) rn, 0 episode_id from pos group by 1 union all
  select c.symbol, (select min(p.rn) from pos p where p.symbol = c.symbol and p.rn >= c.rn + 20), c.episode_id + 1 from chain c where exists (select 1 from pos p where p.symbol = c.symbol and p.rn >= c.rn + 20)),
on1 as (select e.*, c.rn is not null crisis_onset from ev e left join chain c on e.symbol = c.symbol and e.rn = c.rn),
onsets as (select *, case when event_label = 1 then sum(case when crisis_onset then 1 else 0 end) over (partition by symbol order by rn rows unbounded preceding) - 1 else -1 end episode_id from on1)"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return EV.crisis_onsets(EV.label_events(panel_bars(spark, d)))


@query(PANEL + EVENTS_SQL + " select symbol, date, rn, round(fwd_min_ret, 8) fwd_min_ret, event_label from ev")
def event_labels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.label_events(panel_bars(spark, d)).select("symbol", "date", "rn", "fwd_min_ret", "event_label"), 8)


@query(_recursive(PANEL + EVENTS_SQL + ONSETS_SQL + " select symbol, date, event_label, crisis_onset, cast(episode_id as bigint) episode_id from onsets"))
def crisis_onsets(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("symbol", "date", "event_label", "crisis_onset", "episode_id")


@query(
    _recursive(
        PANEL
        + EVENTS_SQL
        + ONSETS_SQL
        + """, ep as (select o.symbol, o.episode_id, o.rn, o.date,
 (select {'p': b.close, 'd': b.date} from ev b where b.symbol = o.symbol and b.rn between o.rn - 5 and o.rn order by b.close desc, b.rn limit 1) pk,
 (select {'p': b.close, 'd': b.date} from ev b where b.symbol = o.symbol and b.rn between o.rn and o.rn + 29 order by b.close, b.rn limit 1) tr from onsets o where crisis_onset)
select symbol, cast(episode_id as bigint) episode_id, rn onset_rn, date onset_date, pk.d peak_date, tr.d trough_date, pk.p peak_price, tr.p trough_price, round(tr.p / pk.p - 1, 8) max_drawdown, date_diff('day', pk.d, tr.d) duration_days from ep"""
    )
)
def crisis_episodes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.crisis_episodes(_events(spark, d)), 8)


_ALARM = f""", al0 as (select *, close / max(close) over ({BY} rows between 59 preceding and current row) - 1 dd from ev), al as (select *, dd <= -0.05 as alarm from al0)"""
_SPELLS = """, sa as (select *, lag(rn) over (partition by symbol order by rn) prev from al where alarm), sb as (select *, sum(case when prev is null or rn - prev - 1 > 5 then 1 else 0 end) over (partition by symbol order by rn rows unbounded preceding) - 1 sid from sa),
sc as (select symbol, sid, min(rn) s, max(rn) e from sb group by 1, 2)"""


def _alarmed(df: DataFrame) -> DataFrame:
    w = by_symbol().rowsBetween(-59, 0)
    return df.withColumn("dd", F.col("close") / F.max("close").over(w) - 1).withColumn("alarm", F.col("dd") <= -0.05).withColumn("score", -F.col("dd"))


@query(
    PANEL
    + EVENTS_SQL
    + _ALARM
    + _SPELLS
    + " select c.symbol, cast(c.sid as bigint) spell_id, min(a.date) start_date, max(a.date) end_date, c.s start_idx, c.e end_idx, c.e - c.s + 1 duration_days, round(max(-a.dd), 8) peak_msi from sc c join al a on a.symbol = c.symbol and a.rn between c.s and c.e group by c.symbol, c.sid, c.s, c.e"
)
def alarm_spells(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.alarm_spells(_alarmed(EV.label_events(panel_bars(spark, d))), "alarm", score="score"), 8)


# Every row counts: a score that is missing is filled with 0.
_AUC = """, g as (select symbol, coalesce(score, 0.0) score, sum(event_label) p, count(*) n from {src} group by 1, 2),
gc as (select *, sum(p) over w tp, sum(n) over w al_, sum(p) over (partition by symbol) pp, sum(n) over (partition by symbol) nn from g window w as (partition by symbol order by score desc rows unbounded preceding)),
gd as (select *, al_ - tp fp, tp * 1.0 / al_ prec from gc),
gl as (select *, coalesce(lag(tp) over v, 0) tp0, coalesce(lag(fp) over v, 0) fp0, coalesce(lag(prec) over v, 1.0) prec0 from gd window v as (partition by symbol order by score desc)),
auc as (select symbol, sum((tp + tp0) / 2.0 * (fp - fp0)) / nullif(max(pp) * (max(nn) - max(pp)) * 1.0, 0) roc_auc, case when max(pp) between 1 and max(nn) - 1 then sum((prec + prec0) / 2 * (tp - tp0)) / max(pp) end pr_auc from gl group by 1)"""


@query(PANEL + EVENTS_SQL + _ALARM + ", src as (select *, -dd score from al)" + _AUC.format(src="src") + " select symbol, round(roc_auc, 8) roc_auc, round(pr_auc, 8) pr_auc from auc")
def pr_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.curve_areas(_alarmed(EV.label_events(panel_bars(spark, d))), "score", "event_label"), 8)


_WARNING = """, pairs as (select e.symbol, e.episode_id, c.sid, e.rn - c.s lead_ from al e join sc c on e.symbol = c.symbol and e.crisis_onset and e.rn - c.s between 1 and 30),
led as (select symbol, episode_id, min(lead_) ld from pairs group by 1, 2), lagg as (select symbol, count(*) detected, avg(ld) mean_lead, median(ld) median_lead, quantile_cont(ld, 0.75) - quantile_cont(ld, 0.25) iqr_lead from led group by 1),
hit as (select symbol, count(distinct sid) good from pairs group by 1), ns as (select symbol, count(*) spells from sc group by 1),
rows_ as (select symbol, count_if(alarm and event_label = 1) tp, count_if(alarm and event_label = 0) fp, count_if(not alarm and event_label = 0) tn, count_if(not alarm and event_label = 1) fn, count_if(crisis_onset) episodes from al group by 1),
t as (select r.*, coalesce(spells, 0) spells, coalesce(detected, 0) detected, coalesce(detected * 1.0 / nullif(episodes, 0), 0) rec, coalesce(good * 1.0 / nullif(spells, 0), 0) prec, mean_lead, median_lead, iqr_lead, roc_auc, pr_auc from rows_ r left join ns using (symbol) left join hit using (symbol) left join lagg using (symbol) left join auc using (symbol))"""
_WARNING_COLUMNS = """episodes, spells, detected, round(rec, 6) episode_recall, round(prec, 6) spell_precision, round(coalesce(2 * rec * prec / nullif(rec + prec, 0), 0), 6) f1, round(coalesce(mean_lead, 0), 6) mean_lead, round(coalesce(median_lead, 0), 6) median_lead, round(coalesce(iqr_lead, 0), 6) iqr_lead, tp, fp, tn, fn,
round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 6) daily_precision, round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 6) daily_recall, round(coalesce(fp * 1.0 / nullif(fp + tn, 0), 0), 6) false_alarm_rate, round(coalesce(roc_auc, 0.5), 6) roc_auc, round(coalesce(pr_auc, 0), 6) pr_auc"""


@query(
    _recursive(
        PANEL
        + EVENTS_SQL
        + ONSETS_SQL
        + ", al0 as (select *, close / max(close) over (partition by symbol order by date rows between 59 preceding and current row) - 1 dd from onsets), al as (select *, dd <= -0.05 as alarm, -dd score from al0)"
        + _SPELLS
        + _AUC.format(src="al")
        + _WARNING
        + " select symbol, " + _WARNING_COLUMNS + " from t"
    )
)
def early_warning_eval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.evaluate_alarms(_alarmed(_events(spark, d)), "alarm", "score"))


@query(
    _recursive(
        PANEL + EVENTS_SQL + ONSETS_SQL
        + f""", rt as (select *, ln(close) - lag(ln(close)) over ({BY}) ret, close / max(close) over ({BY} rows unbounded preceding) - 1 dd, close / ({_g('max', 'close', 252)}) - 1 dd252 from onsets),
vv as (select *, {_g('stddev_samp', 'ret', 20)} * sqrt(252.0) rv_20, {_g('stddev_samp', 'ret', 60)} * sqrt(252.0) * 100 lvl from rt), ct as (select *, quantile_cont(rv_20, 0.9) over (partition by symbol) cut_ from vv),
al as (select symbol || '|' || m symbol, date, rn, event_label, crisis_onset, episode_id, coalesce(a, false) alarm, s score from (
 select *, 'Stress index' m, least(100.0, -dd * 500) >= 50 a, least(100.0, -dd * 500) s from ct union all select *, 'Realised volatility', rv_20 >= cut_, rv_20 from ct
 union all select *, 'Drawdown', dd252 <= -0.05, -dd252 from ct union all select *, 'Level', lvl >= 24, lvl from ct))"""
        + _SPELLS + _AUC.format(src="al") + _WARNING
        + " select split_part(symbol, '|', 1) symbol, split_part(symbol, '|', 2) model, " + _WARNING_COLUMNS + " from t"
    )
)
def baseline_comparison(spark: SparkSession, d: str) -> DataFrame:
    df = FT.build_features(panel_bars(spark, d)).withColumns({"msi_headline": F.least(F.lit(100.0), -F.col("drawdown") * 500), "level": F.col("rv_60") * 100})
    return rounded(EV.compare_baselines(EV.crisis_onsets(EV.label_events(df)), vix="level"))


@query()
def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.block_bootstrap(_alarmed(EV.label_events(panel_bars(spark, d))), "score", "event_label"))


@query()
def block_bootstrap_roc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EV.block_bootstrap(_alarmed(EV.label_events(panel_bars(spark, d))), "score", "event_label", metric="roc_auc"))


@query(
    PANEL + EVENTS_SQL + _ALARM
    + """, src as (select *, -dd score from al), g as (select symbol, score threshold, sum(event_label) p, count(*) n from src where score is not null group by 1, 2)
select symbol, round(threshold, 8) threshold, round(sum(p) over w * 1.0 / sum(n) over w, 8) as precision, round(coalesce(sum(p) over w * 1.0 / nullif(sum(p) over (partition by symbol), 0), 0), 8) recall from g window w as (partition by symbol order by threshold desc rows unbounded preceding)"""
)
def precision_recall_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(RP.precision_recall_points(_alarmed(EV.label_events(panel_bars(spark, d))), "score", "event_label"), 8)


@query(
    _recursive(
        PANEL + EVENTS_SQL + ONSETS_SQL
        + ", al as (select *, close / max(close) over (partition by symbol order by date rows between 59 preceding and current row) - 1 <= -0.05 as alarm from onsets)"
        + _SPELLS
        + " select e.symbol, cast(e.episode_id as bigint) episode_id, cast(c.sid as bigint) spell_id, e.rn - c.s as lead from al e join sc c on e.symbol = c.symbol and e.crisis_onset and e.rn - c.s between 1 and 30"
    )
)
def lead_matches(spark: SparkSession, d: str) -> DataFrame:
    df = _alarmed(_events(spark, d))
    episodes = df.where("crisis_onset").select("symbol", "episode_id", F.col("rn").alias("onset_rn"))
    return EV.match_leads(episodes, EV.alarm_spells(df, "alarm"))


@query(
    _recursive(
        PANEL + EVENTS_SQL + ONSETS_SQL
        + ", al as (select *, close / max(close) over (partition by symbol order by date rows between 59 preceding and current row) - 1 <= -0.05 as alarm from onsets)"
        + _SPELLS
        + """, led as (select e.symbol, e.episode_id, min(e.rn - c.s) ld from al e join sc c on e.symbol = c.symbol and e.crisis_onset and e.rn - c.s between 1 and 30 group by 1, 2),
hb as (select *, least(12, greatest(count(*) over v, 3)) bins, min(ld) over v lo, max(ld) over v hi from led window v as (partition by symbol))
select symbol, cast(least(floor((ld - case when hi > lo then lo else lo - 0.5 end) / case when hi > lo then (hi - lo) * 1.0 / bins else 1.0 / bins end), bins - 1) as int) bin, count(*) episodes from hb group by 1, 2"""
    )
)
def lead_histogram(spark: SparkSession, d: str) -> DataFrame:
    df = _alarmed(_events(spark, d))
    episodes = df.where("crisis_onset").select("symbol", "episode_id", F.col("rn").alias("onset_rn"))
    leads = EV.match_leads(episodes, EV.alarm_spells(df, "alarm")).groupBy("symbol", "episode_id").agg(F.min("lead").alias("lead"))
    return RP.lead_histogram(leads)


# --- risk -------------------------------------------------------------------------------------------------------------


@query(PANEL + RET + f", l as (select *, -100 * ret loss from r), q9 as (select *, count(loss) over {_w(750)} n, quantile_cont(loss, 0.95) over {_w(750)} a, quantile_cont(loss, 0.99) over {_w(750)} b from l) select symbol, date, case when n >= 375 then round(a, 6) end var_hs_95, case when n >= 375 then round(b, 6) end var_hs_99 from q9")
def hs_var(spark: SparkSession, d: str) -> DataFrame:
    return rounded(RK.historical_var_panel(FT.add_returns(panel_bars(spark, d))).select("symbol", "date", "var_hs_95", "var_hs_99"))


@query(
    SINGLE
    + RET
    + f", l as (select *, -100 * ret loss from r), q9 as (select *, count(loss) over {_w(750)} n, quantile_cont(loss, 0.95) over {_w(750)} a, list(loss) over {_w(750)} held from l) select symbol, date, case when n >= 375 then round(a, 6) end var_hs_95, case when n >= 375 then round(list_avg(list_filter(held, lambda x: x >= a)), 6) end es_hs_95 from q9"
)
def hs_es(spark: SparkSession, d: str) -> DataFrame:
    return rounded(RK.historical_var(FT.add_returns(single_bars(spark, d)), 0.95).select("symbol", "date", "var_hs_95", "es_hs_95"))


_COND = f", c as (select symbol, date, -100 * ret loss, 0.05 as mu, {_g('stddev_samp', 'ret', 20)} * 100 sg from r)"


def _conditional(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_volatility(FT.add_returns(panel_bars(spark, d)))
    return df.select("symbol", "date", "return_pct", (-F.col("return_pct")).alias("loss"), F.lit(0.05).alias("mu"), (F.col("rv_20") / ANNUAL * 100).alias("sg"))


@query(PANEL + RET + _COND + " select symbol, date, round(-mu + sg * 1.6448536269514722, 6) var_norm_95, round(-mu + sg * 2.0627128075074257, 6) es_norm_95, round(-mu + sg * 2.3263478740408408, 6) var_norm_99, round(-mu + sg * 2.6652142203458076, 6) es_norm_99 from c")
def cond_normal_var(spark: SparkSession, d: str) -> DataFrame:
    df = _conditional(spark, d)
    cols = {}
    for q in (0.95, 0.99):
        v, e = RK.normal_var_es("mu", "sg", q)
        cols |= {f"var_norm_{round(q * 100)}": v, f"es_norm_{round(q * 100)}": e}
    return rounded(df.select("symbol", "date", *(c.alias(n) for n, c in cols.items())))


_T6 = 3.142668403290985  # fixed value: the 0.99 quantile of Student's t with six degrees


@query(
    PANEL + RET + _COND
    + f""", t as (select {_T6} t, sqrt(4.0 / 6) k, gamma(3.5) / (sqrt(6 * pi()) * gamma(3.0)) * power(1 + {_T6} * {_T6} / 6, -3.5) f)
select symbol, date, round(-mu + sg * k * t, 6) var_t_99, round(-mu + sg * k * f / 0.01 * (6 + t * t) / 5, 6) es_t_99 from c, t"""
)
def cond_student_var(spark: SparkSession, d: str) -> DataFrame:
    df = _conditional(spark, d)
    v, e = RK.student_var_es("mu", "sg", 6.0, 0.99)
    return rounded(df.select("symbol", "date", v.alias("var_t_99"), e.alias("es_t_99")))


@query(
    PANEL
    + RET
    + """, s as (select symbol, quantile_cont(-100 * ret, 0.9) u, count(ret) n from r where ret is not null group by 1), x as (select s.symbol, u, n, count_if(-100 * ret > u) n_u, avg(case when -100 * ret > u then -100 * ret - u end) me from r join s using (symbol) group by s.symbol, u, n)
select symbol, round(u, 6) u, n, n_u, round(me, 6) mean_excess from x"""
)
def pot_threshold(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_returns(panel_bars(spark, d)).where("return is not null").withColumn("loss", -F.col("return_pct"))
    w = Window.partitionBy("symbol")
    df = df.withColumn("u", F.percentile("loss", F.lit(0.9)).over(w))
    out = df.groupBy("symbol", "u").agg(F.count("*").alias("n"), F.count_if(F.col("loss") > F.col("u")).alias("n_u"), F.avg(F.when(F.col("loss") > F.col("u"), F.col("loss") - F.col("u"))).alias("mean_excess"))
    return rounded(out)


@query(
    """with f as (select p_partkey, 1.0 + p_size / 100.0 u, (p_size - 10) / 60.0 xi, 0.3 + p_size / 50.0 beta, 1000.0 n, 100.0 n_u from part),
g as (select *, n / n_u * 0.01 p, case when abs(xi) < 1e-6 then u - beta * ln(n / n_u * 0.01) else u + beta / nullif(xi, 0) * (power(n / n_u * 0.01, -xi) - 1) end z from f),
h as (select *, (z + beta - xi * u) / (1 - xi) es from g) select p_partkey, round(z, 6) z_99, round(case when es < z then 1.05 * z else es end, 6) es_99 from h"""
)
def gpd_quantiles(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    df = _read(spark, d, "part").select("p_partkey", (1 + s / 100).alias("u"), ((s - 10) / 60).alias("xi"), (0.3 + s / 50).alias("beta"), F.lit(1000.0).alias("n"), F.lit(100.0).alias("n_u"))
    df = df.withColumn("z_99", RK.gpd_quantile(F.col("u"), F.col("xi"), F.col("beta"), F.col("n"), F.col("n_u"), 0.99))
    return rounded(df.select("p_partkey", "z_99", RK.gpd_shortfall(F.col("z_99"), F.col("u"), F.col("xi"), F.col("beta")).alias("es_99")))


@query(
    PANEL
    + RET
    + """, l as (select symbol, -100 * ret loss from r where ret is not null), q7 as (select symbol, quantile_cont(loss, 0.7) a, quantile_cont(loss, 0.98) b from l group by 1), gr as (select symbol, point, a + (b - a) * point / 49 threshold from q7, range(0, 50) t(point)),
m as (select gr.symbol, point, threshold, count(loss) n, avg(loss - threshold) me, stddev_samp(loss - threshold) sd from gr left join l on l.symbol = gr.symbol and loss > threshold group by 1, 2, 3)
select symbol, cast(point as int) as point, round(threshold, 6) threshold, n, case when n > 10 then round(me, 6) end mean_excess, case when n > 10 then round(me - 1.96 * sd / sqrt(n), 6) end as lower, case when n > 10 then round(me + 1.96 * sd / sqrt(n), 6) end as upper from m"""
)
def mean_residual_life(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_returns(panel_bars(spark, d)).where("return is not null").withColumn("loss", -F.col("return_pct"))
    return rounded(RK.mean_residual_life(df, "loss"))


_COUNTS = """, b as (select symbol, date, loss > -mu + sg * 1.6448536269514722 br from c where loss is not null and sg is not null), bl as (select *, lag(br) over (partition by symbol order by date) pb from b),
k as (select symbol, count(*) n, count_if(br) x, count_if(pb = false and br = false) n00, count_if(pb = false and br) n01, count_if(pb and br = false) n10, count_if(pb and br) n11 from bl group by 1)"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    df = _conditional(spark, d)
    v, _ = RK.normal_var_es("mu", "sg", 0.95)
    return RK.breach_counts(df.withColumn("breach", F.col("loss") > v), ["symbol"], "breach")


@query(
    PANEL + RET + _COND + _COUNTS
    + " select symbol, n, x, n00, n01, n10, n11, round(greatest(0, -2 * ((n - x) * ln(0.95) + x * ln(0.05) - (n - x) * ln(1 - x * 1.0 / n) - x * ln(x * 1.0 / n))), 6) kupiec_lr from k"
)
def kupiec(spark: SparkSession, d: str) -> DataFrame:
    return rounded(RK.coverage_tests(_counts(spark, d), F.lit(0.05)).select("symbol", "n", "x", "n00", "n01", "n10", "n11", "kupiec_lr"))


@query(
    PANEL + RET + _COND + _COUNTS
    + """, pr as (select *, greatest(1e-10, least(1 - 1e-10, n01 * 1.0 / (n00 + n01))) p01, greatest(1e-10, least(1 - 1e-10, coalesce(n11 * 1.0 / nullif(n10 + n11, 0), 0))) p11, greatest(1e-10, least(1 - 1e-10, (n01 + n11) * 1.0 / (n00 + n01 + n10 + n11))) pp from k)
select symbol, round(greatest(0, -2 * ((n00 + n10) * ln(1 - pp) + (n01 + n11) * ln(pp) - n00 * ln(1 - p01) - n01 * ln(p01) - n10 * ln(1 - p11) - n11 * ln(p11))), 6) christoffersen_lr from pr"""
)
def christoffersen(spark: SparkSession, d: str) -> DataFrame:
    return rounded(RK.coverage_tests(_counts(spark, d), F.lit(0.05)).select("symbol", "christoffersen_lr"))


@query()
def var_scorecard(spark: SparkSession, d: str) -> DataFrame:
    df = _conditional(spark, d)
    for q in (0.95, 0.99):
        v, e = RK.normal_var_es("mu", "sg", q)
        t, s = RK.student_var_es("mu", "sg", 6.0, q)
        df = df.withColumns({f"nv{q}": v, f"ne{q}": e, f"tv{q}": t, f"te{q}": s})
    long = [RK.to_models(df.select(*(F.col(f"`{c}`").alias(c.replace(".", "_")) for c in df.columns)), {"Normal": (f"nv{q}".replace(".", "_"), f"ne{q}".replace(".", "_")), "Student": (f"tv{q}".replace(".", "_"), f"te{q}".replace(".", "_"))}, round(1 - q, 2)) for q in (0.95, 0.99)]
    return rounded(RK.var_scorecard(long[0].unionByName(long[1])))


_SCORES = {f"{m}|{a}": (v, a) for a, m, v in ((0.05, "Normal", 1.6448536269514722), (0.05, "Student", "1.9431802805153018 * sqrt(4.0 / 6)"), (0.01, "Normal", 2.3263478740408408), (0.01, "Student", f"{_T6} * sqrt(4.0 / 6)"))}


@query(
    PANEL + RET + _COND
    + ", lg as (" + " union all ".join(f"select symbol || '|{k}' symbol, date, loss, -mu + sg * {v} vr, {a} alpha from c where loss is not null and sg is not null" for k, (v, a) in _SCORES.items()) + ")"
    + """, b as (select *, loss > vr br from lg), bl as (select *, lag(br) over (partition by symbol order by date) pb from b),
k as (select symbol, alpha, count(*) n, count_if(br) x, count_if(pb = false and br = false) n00, count_if(pb = false and br) n01, count_if(pb and br = false) n10, count_if(pb and br) n11 from bl group by 1, 2),
pr as (select *, greatest(1e-10, least(1 - 1e-10, coalesce(n01 * 1.0 / nullif(n00 + n01, 0), 0))) p01, greatest(1e-10, least(1 - 1e-10, coalesce(n11 * 1.0 / nullif(n10 + n11, 0), 0))) p11, greatest(1e-10, least(1 - 1e-10, (n01 + n11) * 1.0 / (n00 + n01 + n10 + n11))) pp from k where n >= 20),
lr as (select *, greatest(0, -2 * ((n - x) * ln(1 - alpha) + x * ln(alpha) - case when n > x then (n - x) * ln(1 - x * 1.0 / n) else 0 end - case when x > 0 then x * ln(x * 1.0 / n) else 0 end)) ku,
 greatest(0, -2 * ((n00 + n10) * ln(1 - pp) + (n01 + n11) * ln(pp) - n00 * ln(1 - p01) - n01 * ln(p01) - n10 * ln(1 - p11) - n11 * ln(p11))) ch from pr)
select split_part(symbol, '|', 1) symbol, split_part(symbol, '|', 2) model, round(cast(alpha as double), 6) alpha, round(x * 1.0 / n, 6) observed_rate, x breaches, n as "days", round(ku, 6) kupiec_lr, round(ch, 6) christoffersen_lr, round(exp(-(ku + ch) / 2), 6) joint_cc_p,
 case when alpha <= 0.02 then case when x * 250.0 / n <= 4.9 then 'Green' when x * 250.0 / n <= 9.9 then 'Yellow' else 'Red' end else case when ku <= 3.841458820694124 then 'Green' when ku <= 6.634896601021213 then 'Yellow' else 'Red' end end traffic_light from lr"""
)
def coverage_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the scorecard that need no bootstrap and no chi-square tail."""
    return var_scorecard(spark, d).select("symbol", "model", "alpha", "observed_rate", "breaches", "days", "kupiec_lr", "christoffersen_lr", "joint_cc_p", "traffic_light")


@query(PANEL + RET + " select symbol, date, round(100 * ret, 6) return_pct from r where abs(ret) > 0.1")
def large_moves(spark: SparkSession, d: str) -> DataFrame:
    return rounded(VA.large_moves(panel_bars(spark, d)))


# --- statistics -------------------------------------------------------------------------------------------------------


@query(PANEL + RET + " select symbol, count(ret) n, round(avg(ret), 8) mean, round(stddev_samp(ret), 8) std, round(min(ret), 8) as min, round(max(ret), 8) as max, round(kurtosis_pop(ret), 5) excess_kurtosis, round(skewness(ret) * (count(ret) - 2) / sqrt(count(ret) * (count(ret) - 1.0)), 5) skew from r group by 1")
def series_summary(spark: SparkSession, d: str) -> DataFrame:
    df = ST.series_summary(FT.add_returns(panel_bars(spark, d)), "return")
    return rounded(df.withColumns({c: F.round(c, 5) for c in ("skew", "excess_kurtosis")}), 8)


@query(
    PANEL + RET
    + ", m as (select symbol, count(ret) n, skewness(ret) * (count(ret) - 2) / sqrt(count(ret) * (count(ret) - 1.0)) s, kurtosis_pop(ret) k from r group by 1), j as (select *, n / 6.0 * (s * s + k * k / 4) jb from m) select symbol, n, round(jb, 4) jb, round(exp(-jb / 2), 6) p_value from j"
)
def jarque_bera(spark: SparkSession, d: str) -> DataFrame:
    out = ST.jarque_bera(FT.add_returns(panel_bars(spark, d)), "return")
    return out.select("symbol", "n", F.round("jb", 4).alias("jb"), F.round("p_value", 6).alias("p_value"))


_ACF = ", a0 as (select symbol, date, ret, ret - avg(ret) over (partition by symbol) dv from r where ret is not null), lg(k) as (select unnest(range(1, 26))), ai as (select symbol, row_number() over (partition by symbol order by date) i, dv from a0), acf as (select x.symbol, k lag_, sum(x.dv * y.dv) / max(t.s0) acf, max(t.n) n from ai x join lg on true join ai y on x.symbol = y.symbol and y.i = x.i - k join (select symbol, sum(dv * dv) s0, count(*) n from ai group by 1) t on t.symbol = x.symbol group by 1, 2)"


@query(PANEL + RET + _ACF + " select symbol, cast(lag_ as int) lag, round(acf, 7) acf, round(1.96 / sqrt(n), 7) band, abs(acf) > 1.96 / sqrt(n) outside from acf")
def acf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ST.acf_bands(ST.autocorrelations(FT.add_returns(panel_bars(spark, d)), "return")).select("symbol", "lag", "acf", "band", "outside"), 7)


_ACF_OF = {"squared": "ret * ret", "absolute": "abs(ret)"}


@query(
    PANEL + RET
    + ", rs as (" + " union all ".join(f"select symbol || '|{k}' symbol, date, {v} ret from r where ret is not null" for k, v in _ACF_OF.items()) + ")"
    + _ACF.replace("from r where", "from rs where")
    + ", lb as (select symbol, m, max(n) * (max(n) + 2.0) * sum(acf * acf / (n - lag_)) q from acf join (values (10), (20)) v(m) on lag_ <= m group by 1, 2) select split_part(symbol, '|', 1) symbol, split_part(symbol, '|', 2) series, cast(m as int) lag, round(q, 4) q from lb"
)
def ljung_box_of_volatility(spark: SparkSession, d: str) -> DataFrame:
    """Ljung-Box statistics of squared and absolute returns."""
    r = F.col("return")
    df = FT.add_returns(panel_bars(spark, d)).withColumns({"squared": r * r, "absolute": F.abs(r)})
    parts = [ST.ljung_box(ST.autocorrelations(df, k)).select("symbol", F.lit(k).alias("series"), "lag", F.round("q", 4).alias("q")) for k in _ACF_OF]
    return parts[0].unionByName(parts[1])


@query(PANEL + RET + _ACF + ", lb as (select symbol, m, max(n) * (max(n) + 2.0) * sum(acf * acf / (n - lag_)) q from acf join (values (10), (20)) v(m) on lag_ <= m group by 1, 2) select symbol, cast(m as int) lag, round(q, 5) q from lb")
def acf_ljung_box(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ST.ljung_box(ST.autocorrelations(FT.add_returns(panel_bars(spark, d)), "return")).select("symbol", "lag", "q"), 5)


@query(
    _recursive(
        PANEL + RET + _ACF
        + """, ad as (select symbol, list(acf * n / (n - lag_) order by lag_) rk from acf group by 1),
dl(symbol, k, phi, last_, rk) as (select symbol, 1, [rk[1]], rk[1], rk from ad union all
 select symbol, k + 1, list_append([phi[j] - p * phi[k + 1 - j] for j in range(1, k + 1)], p), p, rk
 from (select *, (rk[k + 1] - list_sum([phi[j] * rk[k + 1 - j] for j in range(1, k + 1)])) / (1 - list_sum([phi[j] * rk[j] for j in range(1, k + 1)])) p from dl where k < 25))
select symbol, cast(k as int) lag, round(last_, 6) pacf from dl"""
    )
)
def pacf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ST.partial_autocorrelations(FT.add_returns(panel_bars(spark, d)), "return"))


@query()
def adf_kpss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ST.stationarity(panel_bars(spark, d), "close"))


@query()
def residual_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ST.residual_diagnostics(FT.add_returns(panel_bars(spark, d)), "return_pct"))


_FC = f", fc as (select *, avg(ret) over ({BY} rows between unbounded preceding and 1 preceding) m, avg(ret) over ({BY} rows between 20 preceding and 1 preceding) m20, avg(ret * ret) over ({BY} rows between 20 preceding and 1 preceding) v20 from r)"


def _forecasts(spark: SparkSession, d: str) -> DataFrame:
    w = by_symbol()
    r = F.col("return")
    return FT.add_returns(panel_bars(spark, d)).withColumns({"m": F.avg(r).over(w.rowsBetween(Window.unboundedPreceding, -1)), "m20": F.avg(r).over(w.rowsBetween(-20, -1)), "v20": F.avg(r * r).over(w.rowsBetween(-20, -1))})


@query(PANEL + RET + _FC + " select symbol, count(ret - m20) n, round(sqrt(avg((ret - m20) * (ret - m20))), 8) rmse, round(avg(abs(ret - m20)), 8) mae, round(avg(case when ret is not null and m20 is not null then case when sign(ret) = sign(m20) then 1.0 else 0.0 end end), 6) dir_acc from fc group by 1")
def forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = ST.forecast_metrics(_forecasts(spark, d), "return", "m20")
    return rounded(out.withColumn("dir_acc", F.round("dir_acc", 6)), 8)


@query(
    PANEL + RET + _FC
    + """, dd as (select symbol, date, power(100 * (ret - m), 2) - power(100 * (ret - m20), 2) x from fc where ret is not null and m is not null and m20 is not null), dm as (select symbol, count(*) n, avg(x) mean_diff, var_pop(x) g from dd group by 1)
select symbol, n, round(mean_diff, 7) mean_diff, round(mean_diff / sqrt(g / n) * sqrt((n - 1.0) / n), 5) dm_stat from dm"""
)
def dm_test(spark: SparkSession, d: str) -> DataFrame:
    df = _forecasts(spark, d).withColumns({"ea": 100 * (F.col("return") - F.col("m")), "eb": 100 * (F.col("return") - F.col("m20"))})
    out = ST.diebold_mariano(df, "ea", "eb")
    return out.select("symbol", "n", F.round("mean_diff", 7).alias("mean_diff"), F.round("dm_stat", 5).alias("dm_stat"))


@query(PANEL + RET + _FC + ", ql as (select symbol, date, greatest(10000 * ret * ret, 1e-8) rv, greatest(10000 * v20, 1e-8) fv from fc where ret is not null and v20 is not null) select symbol, count(*) n, round(avg(rv / fv - ln(rv / fv) - 1), 6) qlike from ql group by 1")
def dm_qlike(spark: SparkSession, d: str) -> DataFrame:
    df = _forecasts(spark, d).withColumn("l", ST.qlike(10000 * F.col("return") * F.col("return"), 10000 * F.col("v20")))
    return rounded(df.groupBy("symbol").agg(F.count("l").alias("n"), F.avg("l").alias("qlike")))


_REG = f", g0 as (select *, {_g('stddev_samp', 'ret', 20)} v, close / max(close) over ({BY} rows unbounded preceding) - 1 drawdown from r), g1 as (select symbol, date, ret, drawdown, case when v < 0.009 then 0 when v < 0.012 then 1 else 2 end regime from g0 where v is not null)"


@query(
    PANEL + RET + _REG
    + """, ag as (select symbol, regime, count(*) n, avg(ret) m, stddev_samp(ret) s, skewness(ret) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) sk, kurtosis_pop(ret) ku, avg(drawdown) dd, quantile_cont(ret, 0.05) q from g1 group by 1, 2),
dim as (select symbol, regime, regime_name from (select distinct symbol from g1), (values (0, 'Calm'), (1, 'Elevated'), (2, 'Stress'), (3, 'Unseen')) t(regime, regime_name))
select symbol, regime, regime_name, coalesce(n, 0) as days, round(100.0 * coalesce(n, 0) / sum(n) over (partition by symbol), 2) occupancy_pct, case when n > 5 then round(m * 25200, 2) end ann_mean_pct, case when n > 5 then round(s * 100 * sqrt(252.0), 2) end ann_vol_pct,
case when n > 5 then round(sk, 2) end skew, case when n > 5 then round(ku, 2) end excess_kurtosis, case when n > 5 then round(dd * 100, 2) end mean_drawdown_pct, case when n > 5 then round(q * 100, 2) end var5_pct from dim left join ag using (symbol, regime)"""
)
def regime_stats(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_drawdowns(FT.add_volatility(FT.add_returns(panel_bars(spark, d)))).where("rv_20 is not null")
    v = F.col("rv_20") / ANNUAL
    df = df.withColumn("regime", F.when(v < 0.009, 0).when(v < 0.012, 1).otherwise(2))
    return ST.regime_statistics(df, "regime", ("Calm", "Elevated", "Stress", "Unseen"))


@query("select o_orderpriority symbol, o_orderstatus as value, count(*) n, round(count(*) * 1.0 / sum(count(*)) over (partition by o_orderpriority), 8) share from orders group by 1, 2")
def value_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ST.value_shares(_read(spark, d, "orders").withColumn("symbol", F.col("o_orderpriority")), "o_orderstatus"), 8)


# --- stress -----------------------------------------------------------------------------------------------------------

_STRESS_FEATURES = f", s0 as (select *, {_g('stddev_samp', 'ret', 20)} vol, abs(close / ({_g('max', 'close', 252)}) - 1) dd, (rn % 101) / 100.0 prob, (rn % 37) / 36.0 anom from r)"
_ECDF = """, sc as (select s.symbol, s.date, s.rn, round(prob, 4) c_hmm, round(anom, 4) c_anomaly, case when vol is not null then round(coalesce((select count(*) * 1.0 from s0 t where t.symbol = s.symbol and t.rn < 600 and t.vol <= s.vol) / nullif((select count(vol) from s0 t where t.symbol = s.symbol and t.rn < 600), 0), 0), 4) end c_vol,
case when dd is not null then round(coalesce((select count(*) * 1.0 from s0 t where t.symbol = s.symbol and t.rn < 600 and t.dd <= s.dd) / nullif((select count(dd) from s0 t where t.symbol = s.symbol and t.rn < 600), 0), 0), 4) end c_drawdown from s0 s)"""
_COMP = ("c_hmm", "c_vol", "c_drawdown", "c_anomaly")


def _stress_components(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_drawdowns(FT.add_volatility(FT.add_returns(FT.with_row_number(panel_bars(spark, d)))))
    df = df.withColumns({"conditional_vol": F.round(F.col("rv_20"), 10), "drawdown_252": F.round("drawdown_252", 10), "prob_stress": (F.col("rn") % 101) / 100.0, "anomaly_percentile": (F.col("rn") % 37) / 36.0})
    df = SX.build_components(df, 600)
    return df.withColumns({c: F.round(c, 4) for c in _COMP})


_SX_SQL = PANEL + RET + _STRESS_FEATURES.replace("vol, abs(", "vol0, abs(").replace(" from r)", " from r), s1 as (select * exclude (vol0, dd), round(vol0 * sqrt(252.0), 10) vol, abs(round(-dd, 10)) dd from s0)") + _ECDF.replace("s0", "s1")
_EQ = "100 * (coalesce(c_hmm, 0) + coalesce(c_vol, 0) + coalesce(c_drawdown, 0) + coalesce(c_anomaly, 0)) / ((c_hmm is not null)::int + (c_vol is not null)::int + (c_drawdown is not null)::int + (c_anomaly is not null)::int)"


@query(_SX_SQL + " select symbol, date, round(c_hmm, 8) c_hmm, c_vol, c_drawdown, round(c_anomaly, 8) c_anomaly from sc")
def stress_components(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_stress_components(spark, d).select("symbol", "date", *_COMP), 8)


@query(_SX_SQL + f", ix as (select *, {_EQ} msi from sc) select symbol, date, round(msi, 6) msi_eq, case when msi >= 75 then 'Severe' when msi >= 50 then 'High Risk' when msi >= 25 then 'Elevated' else 'Normal' end stress_band, msi >= 50 alarm_primary, msi >= 75 alarm_secondary from ix")
def stress_index_eq(spark: SparkSession, d: str) -> DataFrame:
    df = _stress_components(spark, d).withColumn("msi_eq", SX.aggregate_index(_COMP))
    df = SX.alarms(df.withColumn("stress_band", SX.band("msi_eq")), "msi_eq")
    return rounded(df.select("symbol", "date", "msi_eq", "stress_band", "alarm_primary", "alarm_secondary"))


@query(
    _SX_SQL
    + """, ix as (select *, 100 * (0.4 * c_hmm + coalesce(0.3 * c_vol, 0) + coalesce(0.2 * c_drawdown, 0) + 0.1 * c_anomaly) / (0.5 + case when c_vol is not null then 0.3 else 0 end + case when c_drawdown is not null then 0.2 else 0 end) p, 100 / (1 + exp(-(2 * c_hmm + c_vol - 0.5 * c_drawdown + 0.3 * c_anomaly - 1))) l from sc)
select symbol, date, round(p, 6) msi_pca, round(l, 6) msi_logit from ix"""
)
def stress_index_weighted(spark: SparkSession, d: str) -> DataFrame:
    df = _stress_components(spark, d)
    pca = SX.aggregate_index(_COMP, "W-PCA", weights={"c_hmm": 0.4, "c_vol": 0.3, "c_drawdown": 0.2, "c_anomaly": 0.1})
    logit = SX.aggregate_index(_COMP, "W-LOGIT", logit=((2.0, 1.0, -0.5, 0.3), -1.0))
    return rounded(df.select("symbol", "date", pca.alias("msi_pca"), logit.alias("msi_logit")))


@query(_SX_SQL + ", k as (select *, (c_hmm is not null)::int + (c_vol is not null)::int + (c_drawdown is not null)::int + (c_anomaly is not null)::int n from sc) select symbol, date, round(100 * c_hmm / n, 6) contrib_hmm, round(100 * c_vol / n, 6) contrib_vol, round(100 * c_drawdown / n, 6) contrib_drawdown, round(100 * c_anomaly / n, 6) contrib_anomaly from k")
def stress_contributions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(SX.contributions(_stress_components(spark, d), _COMP).select("symbol", "date", *(c.replace("c_", "contrib_", 1) for c in _COMP)))


@query(PANEL + RET + " select symbol, date, round(abs(ret), 8) score from r where ret is not null order by score desc, date, symbol limit 20")
def top_anomalies(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_returns(panel_bars(spark, d)).where("return is not null").select("symbol", "date", F.round(F.abs("return"), 8).alias("score"))
    return df.orderBy(F.desc("score"), "date", "symbol").limit(20)


# --- recursive filters with fixed parameters --------------------------------------------------------------------------

GARCH = {"mu": 0.02, "omega": 0.02, "alpha": 0.08, "gamma": 0.04, "beta": 0.88, "start": 1.0}


@query(
    _recursive(
        SINGLE + RET
        + """, x as (select row_number() over (order by date) i, date, 100 * ret r from r where ret is not null),
g as (select i, date, r, cast(1.0 as double) v from x where i = 1 union all select x.i, x.date, x.r, 0.02 + (0.08 + case when g.r - 0.02 < 0 then 0.04 else 0 end) * power(g.r - 0.02, 2) + 0.88 * g.v from g join x on x.i = g.i + 1)
select 'IDX' symbol, date, round(sqrt(v), 7) sigma, round((r - 0.02) / sqrt(v), 6) z from g union all select 'IDX', min(date), null, null from r"""
    )
)
def garch_filter(spark: SparkSession, d: str) -> DataFrame:
    out = FL.garch_filter(FT.add_returns(single_bars(spark, d)), GARCH)
    return out.select("symbol", "date", F.round("sigma", 7).alias("sigma"), F.round("z", 6).alias("z"))


@query(
    _recursive(
        SINGLE + RET
        + """, x as (select row_number() over (order by date) i, date, lag(100 * ret) over (order by date) pr from r),
e as (select i, date, cast(pr * pr as double) v from x where i = 3 union all select x.i, x.date, 0.94 * e.v + 0.06 * x.pr * x.pr from e join x on x.i = e.i + 1)
select 'IDX' symbol, x.date, round(sqrt(e.v), 7) ewma_vol from x left join e using (i)"""
    )
)
def ewma_vol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FL.ewma_volatility(FT.add_returns(single_bars(spark, d))), 7)


@query(
    _recursive(
        SINGLE + RET
        + """, x as (select row_number() over (order by date) i, date, ln(power(greatest(abs(100 * ret), 1e-4), 2)) l from r where ret is not null), y as (select i, date, (l + 1.2) / 2.2 x from x),
c as (select i, date, greatest(0, cast(x - 0.5 as double)) p0, greatest(0, cast(-x - 0.5 as double)) n0, cast(0 as bigint) since, false ah, false al_ from y where i = 1 union all
 select y.i, y.date, greatest(0, (case when c.p0 > 5 then 0 else c.p0 end) + y.x - 0.5), greatest(0, (case when c.n0 > 5 then 0 else c.n0 end) - y.x - 0.5), case when c.p0 > 5 or c.n0 > 5 then 0 else c.since + 1 end, false, false from c join y on y.i = c.i + 1)
select 'IDX' symbol, date, p0 > 5 alarm_high, n0 > 5 alarm_low, round(case when p0 > 5 then 0 else p0 end, 6) s_pos, round(case when n0 > 5 then 0 else n0 end, 6) s_neg, case when p0 > 5 or n0 > 5 then 0 else since + 1 end days_since from c"""
    )
)
def cusum(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_returns(single_bars(spark, d)).where("return_pct is not null")
    out = FL.cusum(df, "return_pct", mean=-1.2, std=2.2)
    return rounded(out.select("symbol", "date", "alarm_high", "alarm_low", "s_pos", "s_neg", "days_since"))


@query(
    _recursive(
        PANEL + RET
        + """, x as (select symbol, row_number() over (partition by symbol order by date) - 1 i, date, ln(power(greatest(abs(100 * ret), 1e-4), 2)) l, rn from r where ret is not null),
k as (select symbol, avg(l) m, stddev_samp(l) s from x where rn < 150 group by 1), y as (select x.symbol, i, date, (l - m) / s x from x join k using (symbol)),
c as (select symbol, i, date, greatest(0, cast(x - 0.5 as double)) p0, greatest(0, cast(-x - 0.5 as double)) n0, cast(0 as bigint) since from y where i = 0 union all
 select y.symbol, y.i, y.date, greatest(0, (case when c.p0 > 3 then 0 else c.p0 end) + y.x - 0.5), greatest(0, (case when c.n0 > 3 then 0 else c.n0 end) - y.x - 0.5), case when c.p0 > 3 or c.n0 > 3 then 0 else c.since + 1 end from c join y on y.symbol = c.symbol and y.i = c.i + 1)
select symbol, date, p0 > 3 alarm_high, n0 > 3 alarm_low, round(case when p0 > 3 then 0 else p0 end, 6) s_pos, round(case when n0 > 3 then 0 else n0 end, 6) s_neg, case when p0 > 3 or n0 > 3 then 0 else since + 1 end days_since from c
union all select symbol, min(date), false, false, 0, 0, 0 from r group by symbol"""
    )
)
def cusum_calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated on the first 150 rows of each series; the first row has no return and reports no alarm."""
    return rounded(FL.cusum(FT.add_returns(panel_bars(spark, d)), "return_pct", h=3.0, train_rows=150))


SKEWED = {"mu": 0.02, "omega": 0.02, "alpha": 0.05, "alpha_2": 0.04, "gamma": 0.06, "beta": 0.85, "nu": 7.0, "skew": -0.1, "start": 1.0}


@query(
    _recursive(
        PANEL + RET
        + """, x as (select symbol, row_number() over (partition by symbol order by date) i, 100 * ret r from r where ret is not null),
k0 as (select exp(lgamma(4.0) - lgamma(3.5)) / sqrt(pi() * 5) c), k1 as (select c, 4 * -0.1 * c * 5 / 6 a from k0), k as (select *, sqrt(1 + 3 * 0.01 - a * a) b from k1),
g as (select symbol, i, r - 0.02 e, cast(1.0 as double) v, cast(1.0 as double) e2 from x where i = 1 union all
 select x.symbol, x.i, x.r - 0.02, 0.02 + (0.05 + case when g.e < 0 then 0.06 else 0 end) * g.e * g.e + 0.04 * g.e2 + 0.85 * g.v, g.e * g.e from g join x on x.symbol = g.symbol and x.i = g.i + 1)
select symbol, count(*) n, round(sum(ln(b) + ln(c) - 4 * ln(1 + power((b * e / sqrt(v) + a) / case when e / sqrt(v) < -a / b then 1.1 else 0.9 end, 2) / 5) - 0.5 * ln(v)), 4) loglik from g, k group by 1"""
    )
)
def garch_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Of a GARCH(2,1,1) with skewed t shocks at fixed parameters."""
    return rounded(_per_symbol(FT.add_returns(panel_bars(spark, d)), "return_pct", lambda x: [{"n": len(x), "loglik": GA.log_likelihood(x, SKEWED, SKEWED["start"], "skewt")}], "n long, loglik double"), 4)


@query(
    PANEL + RET
    + """, x as (select symbol, row_number() over (partition by symbol order by date) i, 100 * ret - 0.02 y from r where ret is not null), e as (select symbol, i, case when i = 1 then y * sqrt(1 - 0.09) else y - 0.3 * lag(y) over (partition by symbol order by i) end e from x)
select symbol, count(*) n, round(-0.5 * count(*) * (ln(2 * pi() * avg(e * e)) + 1) + 0.5 * ln(1 - 0.09), 4) loglik, round(avg(e * e), 6) sigma2, round(0.02 + 0.3 * (select y from x z where z.symbol = e.symbol order by i desc limit 1), 6) forecast from e group by 1"""
)
def arma_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Exact likelihood of a first-order autoregression at fixed parameters, by the filter that all orders use."""

    def at(x: np.ndarray) -> list[dict]:
        ll, s2, ahead = AM.log_likelihood(x, np.array([0.02]), np.array([[0.3]]), np.zeros((1, 0)))
        return [{"n": len(x), "loglik": round(float(ll[0]), 4), "sigma2": float(s2[0]), "forecast": 0.02 + float(ahead[0])}]

    return rounded(_per_symbol(FT.add_returns(panel_bars(spark, d)), "return_pct", at, "n long, loglik double, sigma2 double, forecast double"))


HMM = {"startprob": [0.6, 0.4], "transmat": [[0.95, 0.05], [0.1, 0.9]], "means": [[0.02], [-0.1]], "covars": [[[0.5]], [[2.5]]]}


@query(
    _recursive(
        SINGLE + RET
        + """, x as (select row_number() over (order by date) i, date, 100 * ret v from r where ret is not null),
b as (select i, date, exp(-0.5 * power(v - 0.02, 2) / 0.500001) / sqrt(0.500001) b0, exp(-0.5 * power(v + 0.1, 2) / 2.500001) / sqrt(2.500001) b1 from x),
h as (select i, date, cast(0.6 * b0 / (0.6 * b0 + 0.4 * b1) as double) a from b where i = 1 union all
 select b.i, b.date, (h.a * 0.95 + (1 - h.a) * 0.1) * b.b0 / ((h.a * 0.95 + (1 - h.a) * 0.1) * b.b0 + (h.a * 0.05 + (1 - h.a) * 0.9) * b.b1) from h join b on b.i = h.i + 1)
select 'IDX' symbol, date, round(a, 7) prob_calm, round(1 - a, 7) prob_stress, case when a >= 0.5 then 0 else 1 end regime from h"""
    )
)
def hmm_forward(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_returns(single_bars(spark, d)).where("return_pct is not null")
    out = FL.hmm_forward(df, ["return_pct"], HMM)
    return out.select("symbol", "date", F.round(out["probs"][0], 7).alias("prob_calm"), F.round(out["probs"][1], 7).alias("prob_stress"), "regime")


@query(
    """with p as (select p_partkey, 0.02 as omega, 0.05 + p_size / 1000.0 alpha, 0.80 + p_size / 1000.0 beta, p_size / 2000.0 gamma from part), t as (select *, alpha + beta + gamma / 2 total from p)
select p_partkey, round(total, 8) persistence, round(case when total < 1 then omega / (1 - total) end, 6) unconditional_variance, round(case when total < 1 then ln(0.5) / ln(total) end, 6) half_life from t"""
)
def garch_summary(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    df = _read(spark, d, "part").select("p_partkey", F.lit(0.02).alias("omega"), (0.05 + s / 1000).alias("alpha"), (0.80 + s / 1000).alias("beta"), (s / 2000).alias("gamma"))
    out = FL.garch_summary_columns(df).select("p_partkey", F.round("persistence", 8).alias("persistence"), "unconditional_variance", "half_life")
    return rounded(out, keep=("persistence",))


@query(
    _recursive(
        SINGLE + RET
        + """, x as (select row_number() over (order by date) i, date, 100 * ret v from r where ret is not null),
b as (select i, date, exp(-0.5 * power(v - 0.02, 2) / 0.500001) / sqrt(0.500001) b0, exp(-0.5 * power(v + 0.1, 2) / 2.500001) / sqrt(2.500001) b1 from x),
h as (select i, date, cast(0.6 * b0 / (0.6 * b0 + 0.4 * b1) as double) a from b where i = 1 union all
 select b.i, b.date, (h.a * 0.95 + (1 - h.a) * 0.1) * b.b0 / ((h.a * 0.95 + (1 - h.a) * 0.1) * b.b0 + (h.a * 0.05 + (1 - h.a) * 0.9) * b.b1) from h join b on b.i = h.i + 1)
select 'IDX' symbol, date, round(1.0 / 3 + (1 - a - 1.0 / 3) * 0.85, 7) stress_1, round(1.0 / 3 + (1 - a - 1.0 / 3) * power(0.85, 5), 7) stress_5, round(1.0 / 3 + (1 - a - 1.0 / 3) * power(0.85, 10), 7) stress_10 from h"""
    )
)
def regime_ahead(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_returns(single_bars(spark, d)).where("return_pct is not null")
    return rounded(FL.stress_ahead(FL.hmm_forward(df, ["return_pct"], HMM), HMM["transmat"]).select("symbol", "date", "stress_1", "stress_5", "stress_10"), 7)


@query(
    _recursive(
        PANEL + RET
        + """, x as (select symbol, row_number() over (partition by symbol order by date) i, date, 100 * ret r from r where ret is not null),
g as (select symbol, i, date, r, cast(1.0 as double) v from x where i = 1 union all select x.symbol, x.i, x.date, x.r, 0.02 + (0.08 + case when g.r - 0.02 < 0 then 0.04 else 0 end) * power(g.r - 0.02, 2) + 0.88 * g.v from g join x on x.symbol = g.symbol and x.i = g.i + 1),
f as (select *, 0.02 + (0.08 + case when r - 0.02 < 0 then 0.04 else 0 end) * power(r - 0.02, 2) + 0.88 * v first_ from g)
select symbol, date, round(sqrt(v), 6) sigma, round((r - 0.02) / sqrt(v), 6) z, """
        + ", ".join(f"round(first_ * power(0.98, {h - 1}) + 0.02 * (1 - power(0.98, {h - 1})) / (1 - 0.98), 6) var_{h}" for h in range(1, 11))
        + " from f union all select symbol, min(date), null, null, " + ", ".join(["null"] * 10) + " from r group by symbol"
    )
)
def garch_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FL.garch_forecasts(FL.garch_filter(FT.add_returns(panel_bars(spark, d)), GARCH), GARCH))


# --- estimators -------------------------------------------------------------------------------------------------------


def _spread(df: DataFrame) -> DataFrame:
    """Small rows, heavy fits: a fixed number of partitions, so that adaptive execution does not put all series into one task."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, "symbol")


def _per_symbol(df: DataFrame, value: str, fn: Callable[[np.ndarray], list[dict]], schema: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")["v"].to_numpy(float)
        return pd.DataFrame([{"symbol": pdf["symbol"].iloc[0]} | r for r in fn(x[~np.isnan(x)])])

    return df.select("symbol", "date", F.col(value).cast("double").alias("v")).groupBy("symbol").applyInPandas(run, "symbol string, " + schema)


@query()
def garch_fit(spark: SparkSession, d: str) -> DataFrame:
    def fit(x: np.ndarray) -> list[dict]:
        g = E.fit_garch(x)
        return [{k: float(v) for k, v in (g | E.garch_summary(g)).items() if k not in ("sigma", "z", "n", "n_params", "start")}]

    return rounded(_per_symbol(FT.add_returns(panel_bars(spark, d)), "return_pct", fit, ", ".join(f"{k} double" for k in ("mu", "omega", "alpha", "gamma", "beta", "nu", "loglik", "persistence", "unconditional_variance", "half_life", "aic", "bic"))), 4)


@query()
def gpd_fit(spark: SparkSession, d: str) -> DataFrame:
    def fit(x: np.ndarray) -> list[dict]:
        g = E.fit_gpd(-x)
        return [{k: float(g[k]) for k in ("u", "xi", "beta")} | {"n": g["n"], "n_u": g["n_u"], "z_99": E.gpd_quantile_es(g, 0.99)[0], "es_99": E.gpd_quantile_es(g, 0.99)[1]}]

    return rounded(_per_symbol(FT.add_returns(panel_bars(spark, d)), "return_pct", fit, "u double, xi double, beta double, n long, n_u long, z_99 double, es_99 double"), 4)


@query()
def hmm_fit(spark: SparkSession, d: str) -> DataFrame:
    """Three regimes a series. A series of fewer than 100 complete rows has one row that says so."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")[["return", "ln_rv20", "drawdown"]].dropna().to_numpy(float)
        if len(x) < 100:
            return pd.DataFrame({"symbol": pdf["symbol"].iloc[:1], "regime": pd.array([None], "Int32"), "occupancy": np.nan, "mean_ln_rv20": np.nan, "expected_days": np.nan, "stationary": np.nan, "bic": np.nan, "note": f"{len(x)} complete rows, 100 needed"})
        m = E.fit_hmm(x, 3)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "regime": [0, 1, 2], "occupancy": m["occupancy"], "mean_ln_rv20": m["means"][:, 1], "expected_days": E.expected_durations(m["transmat"]), "stationary": E.stationary(m["transmat"]), "bic": m["bic"], "note": None})

    df = _spread(FT.add_drawdowns(FT.add_volatility(FT.add_returns(panel_bars(spark, d)))).select("symbol", "date", "return", "ln_rv20", "drawdown"))
    out = df.groupBy("symbol").applyInPandas(fit, "symbol string, regime int, occupancy double, mean_ln_rv20 double, expected_days double, stationary double, bic double, note string")
    return rounded(out.select("symbol", "regime", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("occupancy", "mean_ln_rv20", "expected_days", "stationary", "bic")), "note"), 3)


@query()
def iforest(spark: SparkSession, d: str) -> DataFrame:
    """A forest a series, fitted to the first half of its complete rows (50 at least). Rows with a missing feature have NULLs, as have all rows of a series without a complete one."""
    cols = list(WF.WalkForwardConfig().forest_features)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        full = pdf[cols].notna().all(axis=1).to_numpy()
        x = pdf.loc[full, cols].to_numpy(float)
        score, pct = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
        if len(x):
            m = E.fit_forest(x[: max(50, len(x) // 2)])
            score[full] = E.forest_score(m, x)
            pct[full] = E.ecdf(m["train"], score[full])[0]
        return pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"], "score": score, "percentile": pct, "flag": pct >= 0.99})

    df = _spread(FT.add_drawdowns(FT.add_volatility(FT.add_returns(panel_bars(spark, d)))).select("symbol", "date", *cols))
    out = df.groupBy("symbol").applyInPandas(fit, "symbol string, date date, score double, percentile double, flag boolean")
    known = F.col("score").isNotNull() & ~F.isnan("score")
    return rounded(out.select("symbol", "date", F.when(known, F.col("score")).alias("score"), F.when(known, F.col("percentile")).alias("percentile"), F.when(known, F.col("flag")).alias("flag")))


@query()
def panel_iforest(spark: SparkSession, d: str) -> DataFrame:
    """One forest over all series, fitted to the first half of each one's complete rows (50 at least)."""
    cols = list(WF.WalkForwardConfig().forest_features)
    df = FT.add_drawdowns(FT.add_volatility(FT.add_returns(panel_bars(spark, d))))
    full = AN.complete(cols).cast("int")
    df = df.withColumns({"_k": F.sum(full).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum(full).over(Window.partitionBy("symbol"))})
    return rounded(AN.panel_forest(df, cols, train=F.col("_k") <= F.greatest(F.col("_n") / 2, F.lit(50))))


@query()
def pelt(spark: SparkSession, d: str) -> DataFrame:
    def fit(x: np.ndarray) -> list[dict]:
        return [{"factor": c, "n_breaks": len(e) - 1, "breaks": e[:-1]} for c, e in E.pelt_grid(x).items()]

    return _per_symbol(FT.add_returns(panel_bars(spark, d)), "return_pct", fit, "factor double, n_breaks int, breaks array<int>")


@query()
def arma_select(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_returns(FT.with_row_number(panel_bars(spark, d)))
    fits = AR.order_fits(df, "return_pct", slices=SL.parallelism(df))
    return rounded(AR.chosen(fits, ["symbol"]).select("symbol", "p", "q", "constant", "n_params", "bic", "forecast"), 3)


@query()
def arma_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    df = FT.add_returns(FT.with_row_number(single_bars(spark, d)))
    return rounded(AR.compare(AR.arma_walk_forward(df, "return_pct")), 4)


def _held(df: DataFrame, _: str) -> DataFrame:
    """Kept and filled at once: several later plans read it. A lost block is computed again."""
    df = df.persist()
    df.count()
    return df


@query()
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """The out-of-sample table of one series."""
    return rounded(WF.walk_forward(FT.build_features(VA.validate_ohlc(single_bars(spark, d))), keep=_held).oos)


@query()
def walk_forward_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(WF.walk_forward(FT.build_features(VA.validate_ohlc(single_bars(spark, d))), keep=_held).scorecard)


# --- event-time bars --------------------------------------------------------------------------------------------------


@query("select event_type symbol, date_trunc('hour', ts) as start, date_trunc('hour', ts) + interval 1 hour as end, arg_min(value, ts) as open, max(value) high, min(value) low, arg_max(value, ts) as close, count(*) volume from events group by 1, 2, 3")
def event_bars(spark: SparkSession, d: str) -> DataFrame:
    return SM.stream_bars(_read(spark, d, "events"))


@query(
    """with g as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 30 minute then 1 else 0 end new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) sid from g) select user_id, min(ts) as start, max(ts) + interval 30 minute as end, count(*) events from s group by user_id, sid"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return SM.stream_sessions(_read(spark, d, "events"))

