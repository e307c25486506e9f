"""Walk-forward evaluation: expanding refits fanned out as rows, then frozen parameters filtered forward.

refit grid -> random starts of the regime fits, dealt over slices of a series -> one chain a series, in which every refit also starts from the one before
-> all other fits, dealt over slices again -> one row of parameters a refit -> frozen parameters filtered over each block, by slice -> everything else is plain
columns: VaR and ES, components, index, bands, alarms, contributions, scorecards, evaluation. A slice holds a series once and cuts the prefixes of its refits itself, so slices x rows
are shuffled, not refits x rows / 2.

Choices where intent and code of the usual recipe differ: sigma of a day uses earlier returns only; regime
filtering starts at the first complete row; the fitted logit uses the four fitted components; all three headline
methods work."""

from __future__ import annotations

import io
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stressline.functions import recursions as R
from stressline.functions.columns import by_symbol
from stressline.models import estimators as E
from stressline.operators import events as EV
from stressline.operators import risk as RK
from stressline.operators import stress as S
from stressline.plans import slices as SL
from stressline.sources.once import written_once


@dataclass(frozen=True)
class WalkForwardConfig:
    initial_train: int = 1260
    cadence: int = 63
    seed: int = 42
    leverage: bool = False
    density: str = "t"
    q_u: float = 0.90
    min_exceedances: int = 50
    levels: tuple[float, float] = (0.95, 0.99)
    regimes: int = 3
    hmm_features: tuple[str, ...] = ("return", "ln_rv20", "drawdown")
    hmm_starts: int = 10
    hmm_chain: bool = True
    trees: int = 300
    anomaly_percentile: float = 0.99
    forest_features: tuple[str, ...] = ("return", "ln_rv20", "vol_ratio_5_20", "drawdown_252", "momentum_20", "ln_parkinson")
    cusum_k: float = 0.5
    cusum_h: float = 5.0
    corr: str | None = None
    headline: str = "W-EQ"
    event_h: int = 10
    event_x: float = 0.05
    refractory: int = 20
    embargo: int = 5
    max_gap: int = 5
    max_lead: int = 30
    hs_window: int = 750
    extra: dict = field(default_factory=dict)


class WalkForwardResults(NamedTuple):
    oos: DataFrame
    refits: DataFrame
    scorecard: DataFrame
    early_warning: DataFrame
    baselines: DataFrame


REFIT_SCHEMA = (
    "symbol string, refit_idx int, t_refit int, t_next int, train_start date, train_end date, garch map<string,double>, gpd map<string,double>, "
    "z_95 double, es_95 double, z_99 double, es_99 double, startprob array<double>, transmat array<array<double>>, means array<array<double>>, covars array<array<array<double>>>, hmm_bic double, occupancy array<double>, "
    "cusum_mean double, cusum_std double, ecdf_vol array<double>, ecdf_dd array<double>, ecdf_corr array<double>, pca array<double>, logit array<double>, forest binary"
)


def refit_grid(n: int, initial: int, cadence: int) -> list[tuple[int, int, int]]:
    """(refit, first row, next refit's first row)."""
    if n <= initial + cadence:
        raise ValueError(f"{n} rows are too few for {initial} training rows and a block of {cadence}")
    starts = list(range(initial, n, cadence))
    return [(i, t, u) for i, (t, u) in enumerate(zip(starts, [*starts[1:], n], strict=True))]


def _complete(x: np.ndarray) -> np.ndarray:
    return ~np.isnan(x).any(axis=1)


def pack_arrays(model: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: np.asarray(v) for k, v in model.items()})
    return out.getvalue()


def unpack_arrays(raw: bytes) -> dict:
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


HMM_SCHEMA = "symbol string, refit_idx int, start int, loglik double, startprob array<double>, transmat array<array<double>>, means array<array<double>>, covars array<array<array<double>>>, occupancy array<double>"
_HMM = ("startprob", "transmat", "means", "covars", "occupancy")


def _regime_rows(rows: pd.DataFrame, until: int, c: WalkForwardConfig) -> np.ndarray:
    x = rows.loc[rows["rn"] < until, list(c.hmm_features)].to_numpy(float)
    return x[_complete(x)]


def _model_row(symbol: str, refit: int, start: int, m: dict) -> dict:
    return {"symbol": symbol, "refit_idx": refit, "start": start, "loglik": float(m["loglik"])} | {k: np.asarray(m[k]).tolist() for k in _HMM}


def regime_model(row) -> dict:
    """Start, transitions, means and covariances of a row of parameters."""
    return {k: np.array(_nested(getattr(row, k)), float) for k in _HMM[:4]}


def _model(row) -> dict:
    return regime_model(row) | {"occupancy": np.array(_nested(row.occupancy), float), "loglik": float(row.loglik)}


def chain_regimes(rows: pd.DataFrame, found: dict[int, dict], c: WalkForwardConfig) -> list[dict]:
    """The best model of every refit of one series in order: the best random start, or the model of the refit before taken on over the longer prefix."""
    out, last = [], None
    for i, t, _ in refit_grid(len(rows), c.initial_train, c.cadence):
        best = found[i]
        if last is not None and c.hmm_chain:
            warm = E.baum_welch(_regime_rows(rows, t, c), last)
            best = max(best, warm, key=lambda m: m["loglik"])
        last = E.relabel(best, c.hmm_features.index("ln_rv20"), c.hmm_features.index("return"))
        out.append(_model_row(rows["symbol"].iloc[0], i, -1 if best is not found[i] else 0, last))
    return out


def fit_regimes(panel: DataFrame, c: WalkForwardConfig, slices: int) -> DataFrame:
    """One regime model a (symbol, refit). Random starts are independent and dealt over slices; the chain runs through a series in order, one start a refit."""
    columns = [x.split()[0] for x in SL.fields(HMM_SCHEMA)]

    def starts(rows: pd.DataFrame, k: int) -> pd.DataFrame:
        tasks = [(i, t, s) for i, t, _ in refit_grid(len(rows), c.initial_train, c.cadence) for s in range(c.hmm_starts)]
        out = []
        for i, t, s in tasks[k::slices]:
            x = _regime_rows(rows, t, c)
            out.append(_model_row(rows["symbol"].iloc[0], i, s, E.baum_welch(x, E.hmm_start(x, c.regimes, c.seed + 100 * s))))
        return pd.DataFrame(out, columns=columns)

    need = list(c.hmm_features)
    tried = SL.by_slice(panel, need, slices, starts, HMM_SCHEMA)
    rest = [x for x in columns if x not in ("symbol", "refit_idx")]
    best = tried.groupBy("symbol", "refit_idx").agg(F.max_by(F.struct(*rest), F.struct("loglik", -F.col("start"))).alias("b")).select("symbol", "refit_idx", "b.*")  # ties: the earlier start

    def chain(rows: pd.DataFrame, _: int, found: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(chain_regimes(rows, {int(r.refit_idx): _model(r) for r in found.itertuples(index=False)}, c), columns=columns)

    return SL.by_slice(panel, need, 1, chain, HMM_SCHEMA, beside=best.withColumn("slice", F.lit(0)))


def fit_refit(train: pd.DataFrame, c: WalkForwardConfig, hmm: dict) -> dict:
    """All parameters from one training prefix and its regime model."""
    ret = train["return_pct"].to_numpy(float)
    garch = E.fit_garch(ret, leverage=c.leverage, density=c.density)
    sigma, z = garch.pop("sigma"), garch.pop("z")
    at = np.flatnonzero(~np.isnan(ret))
    full_sigma = np.full(len(ret), np.nan)
    full_sigma[at] = sigma
    losses = -z
    gpd = E.fit_gpd(losses, q_u=c.q_u, least=c.min_exceedances)
    tail = [E.gpd_quantile_es(gpd, q, losses) for q in c.levels]
    xh = train[list(c.hmm_features)].to_numpy(float)
    ok = _complete(xh)
    bic = E.hmm_parameters(c.regimes, xh.shape[1]) * np.log(ok.sum()) - 2 * hmm["loglik"]
    _, probs = R.hmm_filter(None, xh[ok], hmm)
    xf = train[list(c.forest_features)].to_numpy(float)
    forest = E.fit_forest(xf[_complete(xf)], trees=c.trees, seed=c.seed)
    cus = R.cusum_calibrate(R.CusumState(), z)
    clean = lambda v: np.sort(v[~np.isnan(v)])
    ecdf_vol, dd = clean(full_sigma), np.abs(train["drawdown_252"].to_numpy(float))
    ecdf_dd = clean(dd)
    corr = clean(train[c.corr].to_numpy(float)) if c.corr else np.zeros(0)
    comp = np.column_stack(
        [
            probs[:, -1],
            E.ecdf(ecdf_vol, pd.Series(full_sigma).ffill().to_numpy()[ok])[0],
            E.ecdf(ecdf_dd, np.nan_to_num(dd)[ok])[0],
            E.ecdf(forest["train"], E.forest_score(forest, np.nan_to_num(xf)[ok]))[0],
        ]
    )
    logit = E.fit_logit(comp, train["event_label"].to_numpy(float)[ok], purge=c.event_h, embargo=c.embargo)
    return {
        "garch": {k: float(v) for k, v in (garch | E.garch_summary(garch)).items()}, "gpd": {k: float(v) for k, v in gpd.items()},
        "z_95": tail[0][0], "es_95": tail[0][1], "z_99": tail[1][0], "es_99": tail[1][1],
        **{k: hmm[k].tolist() for k in ("startprob", "transmat", "means", "covars", "occupancy")}, "hmm_bic": float(bic), "cusum_mean": cus.mean, "cusum_std": cus.std,
        "ecdf_vol": ecdf_vol.tolist(), "ecdf_dd": ecdf_dd.tolist(), "ecdf_corr": corr.tolist() if len(corr) > 10 else [], "pca": E.pca_weights(comp).tolist(), "logit": None if logit is None else logit.tolist(), "forest": pack_arrays(forest),
    }


def fit_refits(panel: DataFrame, c: WalkForwardConfig) -> DataFrame:
    """One row of parameters a (symbol, refit), each from the prefix that the refit may see: rn < t_refit."""
    need = ["return_pct", "drawdown_252", "event_label", *c.hmm_features, *c.forest_features, *([c.corr] if c.corr else [])]
    cols = list(dict.fromkeys(need))
    symbols = SL.lengths(panel, c.initial_train + c.cadence, "initial_train + cadence").agg(F.count_if(F.col("n") > 0)).first()[0]
    slices = SL.slices_for(panel, symbols)
    regimes = written_once(fit_regimes(panel, c, slices), "regimes")

    def run(rows: pd.DataFrame, k: int, models: pd.DataFrame) -> pd.DataFrame:
        out, by = [], {int(m.refit_idx): _model(m) for m in models.itertuples(index=False)}
        for i, t, u in refit_grid(len(rows), c.initial_train, c.cadence)[k::slices]:
            train = rows[rows["rn"] < t]
            head = {"symbol": rows["symbol"].iloc[0], "refit_idx": i, "t_refit": t, "t_next": u, "train_start": train["date"].iloc[0], "train_end": train["date"].iloc[-1]}
            out.append(head | fit_refit(train, c, by[i]))
        return pd.DataFrame(out, columns=[x.split()[0] for x in SL.fields(REFIT_SCHEMA)])

    return SL.by_slice(panel, ["date", *cols], slices, run, REFIT_SCHEMA, beside=regimes.withColumn("slice", F.col("refit_idx") % slices))


OOS_SCHEMA = (
    "symbol string, date date, refit_idx int, conditional_vol double, std_resid double, prob_calm double, prob_elevated double, prob_stress double, regime int, "
    "mu double, nu double, z_95 double, es_z_95 double, z_99 double, es_z_99 double, t_95 double, et_95 double, t_99 double, et_99 double, "
    "anomaly_score double, anomaly_percentile double, anomaly_flag boolean, cusum_alarm_high boolean, cusum_alarm_low boolean, cusum_s_pos double, cusum_s_neg double, days_since_cusum long, "
    "c_hmm double, c_vol double, c_drawdown double, c_anomaly double, c_cross_asset double, w_hmm double, w_vol double, w_drawdown double, w_anomaly double, logit array<double>"
)


def filter_block(rows: pd.DataFrame, r, c: WalkForwardConfig) -> pd.DataFrame:
    """Out-of-sample columns of one block: the frozen parameters of refit r, filtered over the rows up to the next refit; without CUSUM."""
    rows = rows.sort_values("rn").reset_index(drop=True)
    ret, xh, xf = rows["return_pct"].to_numpy(float), rows[list(c.hmm_features)].to_numpy(float), rows[list(c.forest_features)].to_numpy(float)
    t, u = int(r.t_refit), int(r.t_next)
    g = dict(r.garch)
    _, sigma, z = R.garch_filter(R.GarchState(), ret[:u], g, g["start"])
    hmm = regime_model(r)
    _, probs = R.hmm_filter(None, xh[:u], hmm)
    forest = unpack_arrays(r.forest)
    score = E.forest_score(forest, np.nan_to_num(xf[t:u]))
    pct, _ = E.ecdf(forest["train"], score)
    nu = g["nu"] if np.isfinite(g["nu"]) else 1e6
    (t95, e95), (t99, e99) = (RK.student_constants(nu, q) for q in c.levels)
    dd = np.abs(rows["drawdown_252"].to_numpy(float)[t:u])
    share = lambda train, v: np.where(np.isnan(v), np.nan, E.ecdf(np.asarray(train, float), v)[0])
    p = probs[t:u]
    out = pd.DataFrame({"symbol": rows["symbol"][t:u], "date": rows["date"][t:u], "refit_idx": r.refit_idx})
    out["conditional_vol"], out["std_resid"] = sigma[t:u], z[t:u]
    out["prob_calm"], out["prob_elevated"], out["prob_stress"] = p[:, 0], p[:, 1] if p.shape[1] > 2 else np.nan, p[:, -1]
    out["regime"] = pd.Series(np.where(np.isnan(p[:, 0]), -1, np.nan_to_num(p).argmax(axis=1)), index=out.index)
    for name, v in {"mu": g["mu"], "nu": nu, "z_95": r.z_95, "es_z_95": r.es_95, "z_99": r.z_99, "es_z_99": r.es_99, "t_95": t95, "et_95": e95, "t_99": t99, "et_99": e99}.items():
        out[name] = float(v)
    out["anomaly_score"], out["anomaly_percentile"], out["anomaly_flag"] = score, pct, pct >= c.anomaly_percentile
    out["cusum_mean"], out["cusum_std"] = float(r.cusum_mean), float(r.cusum_std)
    out["c_hmm"], out["c_vol"], out["c_drawdown"], out["c_anomaly"] = p[:, -1], share(r.ecdf_vol, sigma[t:u]), share(r.ecdf_dd, dd), pct
    out["c_cross_asset"] = share(r.ecdf_corr, rows[c.corr].to_numpy(float)[t:u]) if c.corr and len(r.ecdf_corr) else np.nan
    for name, w in zip(("w_hmm", "w_vol", "w_drawdown", "w_anomaly"), r.pca, strict=True):
        out[name] = float(w)
    out["logit"] = [None if r.logit is None else list(map(float, r.logit))] * len(out)
    return out


CUSUM_COLUMNS = ("cusum_alarm_high", "cusum_alarm_low", "cusum_s_pos", "cusum_s_neg", "days_since_cusum")


def cusum_series(table: pa.Table, c: WalkForwardConfig) -> pa.Table:
    """CUSUM columns of one series: its state is carried across the blocks, each with the calibration of its refit."""
    table = table.sort_by("date")
    refit = table["refit_idx"].to_numpy()
    z, mean, std = (table[c].to_numpy(zero_copy_only=False).astype(float) for c in ("std_resid", "cusum_mean", "cusum_std"))
    state, parts = R.CusumState(), []
    for at in np.split(np.arange(len(refit)), np.flatnonzero(np.diff(refit)) + 1):
        state.mean, state.std = float(mean[at[0]]), float(std[at[0]])
        state, found = R.cusum(state, z[at], c.cusum_k, c.cusum_h)
        parts.append(found)
    out = table.drop_columns(["cusum_mean", "cusum_std"])
    for name, key in zip(CUSUM_COLUMNS, ("alarm_high", "alarm_low", "s_pos", "s_neg", "days_since"), strict=True):
        out = out.append_column(name, pa.array(np.concatenate([np.asarray(x[key]) for x in parts])))
    return out


def _nested(v):
    return [_nested(x) for x in v] if hasattr(v, "__len__") else v


def frozen_filter(panel: DataFrame, refits: DataFrame, c: WalkForwardConfig) -> DataFrame:
    """Blocks are dealt over slices of a series, each of which holds the series once; only CUSUM goes through the blocks in order."""
    cols = list(dict.fromkeys(["return_pct", "drawdown_252", *c.hmm_features, *c.forest_features, *([c.corr] if c.corr else [])]))
    slices = SL.slices_for(panel, refits.select("symbol").distinct().count())

    def run(rows: pd.DataFrame, _: int, fits: pd.DataFrame) -> pd.DataFrame:
        done = [filter_block(rows[rows["rn"] < r.t_next], r, c) for r in fits.itertuples(index=False)]
        return pd.concat(done, ignore_index=True)

    fields = [x.strip() for x in OOS_SCHEMA.split(",")]
    late = {f"{n} {k}" for n, k in zip(CUSUM_COLUMNS, ("boolean", "boolean", "double", "double", "long"), strict=True)}
    kind = [x for x in fields if x not in late] + ["cusum_mean double", "cusum_std double"]
    blocks = SL.by_slice(panel, ["date", *cols], slices, run, ", ".join(kind), beside=refits.withColumn("slice", F.col("refit_idx") % slices))
    done = blocks.groupBy("symbol").applyInArrow(lambda t: cusum_series(t, c), ", ".join([*kind[:-2], *(x for x in fields if x in late)]))
    done = done.select(*(x.split()[0] for x in fields))
    return done.select(*(F.when(~F.isnan(n), F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in done.dtypes))


#: Names of the models.
VAR_MODELS = {"Historical Simulation": "hs", "Conditional Normal": "norm", "Conditional Student-t": "t", "GARCH-EVT (POT)": "evt"}
FITTED = ("c_hmm", "c_vol", "c_drawdown", "c_anomaly")


def assemble(panel: DataFrame, filtered: DataFrame, c: WalkForwardConfig) -> DataFrame:
    """VaR and ES of four models, breaches, index by three methods, band, alarms and contributions: columns only."""
    df = filtered.join(panel.select("symbol", "date", "rn", F.col("close").alias("price"), "return_pct", "rv_20", "drawdown_252", "event_label", "crisis_onset", "episode_id", "var_hs_95", "es_hs_95", "var_hs_99", "es_hs_99"), ["symbol", "date"])
    loss, sigma, mu = -F.col("return_pct"), F.col("conditional_vol"), F.col("mu")
    new = {"loss_pct": loss}
    for q in c.levels:
        tag = round(q * 100)
        v, e = RK.normal_var_es(mu, sigma, q)
        new |= {f"var_norm_{tag}": v, f"es_norm_{tag}": e}
        v, e = RK.evt_var_es(mu, sigma, f"z_{tag}", f"es_z_{tag}")
        new |= {f"var_evt_{tag}": v, f"es_evt_{tag}": e}
        v, e = -mu + sigma * F.col(f"t_{tag}"), -mu + sigma * F.col(f"et_{tag}")
        new |= {f"var_t_{tag}": v, f"es_t_{tag}": F.when(e < v, v * 1.05).otherwise(e)}
    names = F.array(*(F.lit(x) for x in E.regime_names(c.regimes)))
    new["regime_name"] = F.when(F.col("regime") >= 0, F.element_at(names, F.col("regime") + 1))
    df = df.withColumns(new)
    df = df.withColumns({f"breach_{m}_{t}": F.coalesce(F.col("loss_pct") > F.col(f"var_{m}_{t}"), F.lit(False)) for m in VAR_MODELS.values() for t in (95, 99)})
    weights = {f"c_{k}": F.col(f"w_{k}") for k in ("hmm", "vol", "drawdown", "anomaly")}
    equal = S.index_equal(S.COMPONENTS)
    logit = S.index_logit(FITTED, [F.element_at("logit", i + 1) for i in range(4)], F.element_at("logit", 5))
    df = df.withColumns({"msi_eq": equal, "msi_pca": S.index_weighted(S.COMPONENTS, weights), "msi_logit": F.when(F.col("logit").isNull(), equal).otherwise(logit)})
    df = df.withColumn("msi_headline", F.col({"W-EQ": "msi_eq", "W-PCA": "msi_pca", "W-LOGIT": "msi_logit"}[c.headline]))
    df = S.contributions(S.alarms(df.withColumn("stress_band", S.band("msi_headline")), "msi_headline"), S.COMPONENTS)
    helpers = ["mu", "nu", "logit", *(f"{a}_{t}" for t in (95, 99) for a in ("z", "es_z", "t", "et")), *(f"w_{k}" for k in ("hmm", "vol", "drawdown", "anomaly"))]
    return df.drop(*helpers)


def label_panel(features: DataFrame, c: WalkForwardConfig) -> DataFrame:
    """Features with labels, onsets and historical-simulation columns."""
    df = EV.crisis_onsets(EV.label_events(features, h=c.event_h, x=c.event_x), refractory=c.refractory)
    return df.join(RK.historical_var_panel(df, c.levels, window=c.hs_window), ["symbol", "date"])


def walk_forward(features: DataFrame, c: WalkForwardConfig = WalkForwardConfig(), *, keep=lambda df, name: df) -> WalkForwardResults:
    """``keep`` may write intermediate tables (panel, refits, oos) and return them read again, to cut lineage."""
    panel = keep(label_panel(features, c), "panel")
    refits = keep(fit_refits(panel, c), "refits")
    oos = keep(assemble(panel, frozen_filter(panel, refits, c), c), "oos")
    cards = [RK.var_scorecard(RK.to_models(oos, {n: (f"var_{m}_{t}", f"es_{m}_{t}") for n, m in VAR_MODELS.items()}, a)) for t, a in ((95, 0.05), (99, 0.01))]
    numbered = oos.withColumn("rn", F.row_number().over(by_symbol()) - 1)
    warning = EV.evaluate_alarms(numbered, "alarm_primary", "msi_headline", max_gap=c.max_gap, max_lead=c.max_lead)
    slice_ = EV.crisis_onsets(EV.label_events(numbered.drop("event_label", "crisis_onset", "episode_id"), h=c.event_h, x=c.event_x, price="price"), refractory=c.refractory)
    return WalkForwardResults(oos, refits, cards[0].unionByName(cards[1]), warning, EV.compare_baselines(slice_, max_gap=c.max_gap))

