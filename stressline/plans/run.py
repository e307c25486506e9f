"""The whole run: bars -> validation -> alignment -> features -> diagnostics -> walk-forward -> tables, metrics and reports.

    python -m stressline.plans.run --bars PATH --out PATH [--config FILE] [--url URL] [--refresh]

PATH of the bars is a Parquet cache by symbol with date, open, high, low, close and volume. With a URL, series that it lacks (with --refresh, all) are read from there and kept in it."""

from __future__ import annotations

import argparse
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stressline.operators import features as FT
from stressline.operators import statistics as ST
from stressline.operators import validation as VA
from stressline.plans import reports as RP
from stressline.plans import walk_forward as WF
from stressline.plans.config import EngineConfig, config_hash, load_config
from stressline.sources import bars as B
from stressline.sources import feature_sink as FS
from stressline.sources import remote as RS


def prepare(bars: DataFrame, c: EngineConfig) -> DataFrame:
    """Features of the primary series with its optional series aligned to its calendar."""
    primary = VA.validate_ohlc(bars.where(F.col("symbol") == c.data.primary))
    if not primary.limit(1).count():
        raise RuntimeError(f"no rows of the primary series {c.data.primary}")
    gate = VA.volume_usable(primary, c.data.min_volume_coverage).first()
    df = FT.build_features(primary, c.features, bool(gate["use_volume"]))
    for symbol in c.data.optional:
        other = bars.where(F.col("symbol") == symbol)
        if other.limit(1).count():
            name = symbol.lower()
            df = FT.align_to_calendar(df, other, ["close"], lag=c.data.lags.get(symbol, 0), limit=c.data.max_fill, prefix=f"{name}_")
            df = FT.add_level_change(FT.add_cross_asset(df, f"{name}_close", name, c.features), f"{name}_close", name, c.features)
    return df


def load_bars(spark: SparkSession, cache: str, c: EngineConfig, *, refresh: bool = False, attempts: int = 3, wait: float = 2.0, **source) -> DataFrame:
    """The primary series, without which there is no run, and those optional ones that some source has; ``source`` are options of the remote bars. Each
    series is fetched on an executor, one at a time, as the cache is filled by series."""
    fetch = lambda s: lambda: RS.read_bars(spark, [s], attempts="1", **source)  # noqa: E731 - load_series does the further attempts
    load = lambda s: B.load_series(spark, s, cache, [fetch(s)] if source else [], refresh=refresh, attempts=attempts, wait=wait)
    return B.resolve(load(c.data.primary), [], {s: load(s) for s in c.data.optional})


def run(spark: SparkSession, bars: DataFrame, out: str, reports: str, c: EngineConfig) -> WF.WalkForwardResults:
    began = time.time()

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    quality = keep(VA.quality_profile(bars), "quality")
    features = FS.write_features(prepare(bars, c), f"features_{uuid.uuid4().hex}", path=f"{out}/features")  # every later window reads it
    result = WF.walk_forward(features, c.walk, keep=keep)
    tables = {"scorecard": keep(result.scorecard, "scorecard"), "early_warning": keep(result.early_warning, "early_warning"), "baselines": keep(result.baselines, "baselines")}
    diagnostics = {
        "Stationarity of the close": RP.with_notes(ST.stationarity(features, "close"), RP.stationarity_note), "Stationarity of returns": RP.with_notes(ST.stationarity(features, "return"), RP.stationarity_note),
        "Ljung-Box": RP.with_notes(ST.ljung_box(ST.autocorrelations(features, "return")), RP.ljung_box_note), "Residuals": RP.with_notes(ST.residual_diagnostics(result.oos, "std_resid"), RP.arch_note),
    }
    RP.write_report(f"{reports}/data_quality.md", "Data quality", {"Profile": quality, "Violations": VA.ohlc_violations(bars), "Large moves": VA.large_moves(bars)})
    RP.write_report(f"{reports}/diagnostics.md", "Diagnostics", diagnostics)
    RP.write_report(f"{reports}/results.md", "Results", {"Bands": ST.value_shares(result.oos, "stress_band"), "Tail risk": tables["scorecard"], "Early warning": tables["early_warning"], "Baselines": tables["baselines"]})
    RP.write_metrics(f"{reports}/metrics.json", tables)
    B.write_json(f"{reports}/manifest.json", {"config_sha256": config_hash(c), "seconds": round(time.time() - began, 1), "tables": out})
    return result


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser()
    a.add_argument("--bars", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--reports", default=".")
    a.add_argument("--config")
    a.add_argument("--url")
    a.add_argument("--refresh", action="store_true")
    args = a.parse_args(argv)
    spark, c = SparkSession.builder.getOrCreate(), load_config(args.config)
    run(spark, load_bars(spark, args.bars, c, refresh=args.refresh, **({"url": args.url} if args.url else {})), args.out, args.reports, c)


if __name__ == "__main__":
    main()
