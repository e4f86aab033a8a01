"""Signal checks: volatility forecasts, mispricing regressions, threshold trades, recalibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.mathx import h_eff, lit, ln_ratio, norm_of_tail, norm_tail, safe_div, z_score
from .bootstrap import Ratio, intervals
from ..session import cut
from .grid import block_window, blocked, rolling_sums, unblocked

HORIZONS, FEE = (1, 2, 3, 5, 8), 0.07
SIGMAS = ("sigma_1m", "sig_rv240", "sig_rv60", "sig_rv30", "sig_rv15")


def split_label(val_start: str, test_start: str) -> str:
    return f"CASE WHEN ts < TIMESTAMP_NTZ'{val_start}' THEN 'train' WHEN ts < TIMESTAMP_NTZ'{test_start}' THEN 'val' ELSE 'test' END"


def signal_frame(frame: DataFrame, val_start: str, test_start: str, horizons=HORIZONS) -> DataFrame:
    """Volatility measures, future variances, future moves inside the window, gaps to fair value. Rows go to
    their blocks once, with the 250 before and those ahead that moves and variances look at."""
    f = frame.select("idx", "ts", "t0", "k", "date", "mid_close", "yes_bid_close", "yes_ask_close", "quote_ok", "moneyness", "sigma_1m", "brti_rv_1s", "ret_1m", "spread", "log_volume", "log_oi", "hour", "outcome_brti", "brti_ret_l10", "brti_ret_l30", "mid_ret_1m", F.expr("power(ret_1m, 2)").alias("r2_1m"))
    b = blocked(f, 250, ahead=max(10, *horizons))
    w = block_window()
    sizes = (15, 30, 60, 240)
    b = rolling_sums(b, "brti_rv_1s", sizes).withColumns({f"sig_rv{n}": F.expr(f"CASE WHEN n_{n} >= {n // 2} THEN sqrt(s_{n} / n_{n}) END") for n in sizes}).drop(*[f"{c}_{n}" for c in "ns" for n in sizes])
    names = {"old": "sigma_1m", "rv15": "sig_rv15", "rv30": "sig_rv30", "rv60": "sig_rv60", "rv240": "sig_rv240"}
    b = b.withColumns({f"z_{n}": F.expr(z_score("moneyness", s, h_eff("k"))) for n, s in names.items()})
    # tails are columns first: written out in place, they are worked out anew
    b = b.withColumns({f"tail_{n}": F.expr(norm_tail(f"z_{n}")) for n in names})
    b = b.withColumns({f"p_{n}": F.expr(norm_of_tail(f"z_{n}", f"tail_{n}")) for n in names}).drop(*[f"tail_{n}" for n in names])

    def ahead(c):
        over = w.rowsBetween(1, 10)
        return F.when(F.count(c).over(over) == 10, F.avg(c).over(over))

    cols = {f"dp_{n}": F.col(f"p_{n}") - F.lag(f"p_{n}").over(w) for n in ("old", "rv60")} | {"fut_rv": ahead("brti_rv_1s"), "fut_r2": ahead("r2_1m")}
    for h in horizons:
        # h rows on is inside the window, as rows are a complete grid
        ok = F.lead("quote_ok", h).over(w) & (F.col("k") + h <= 13)
        cols |= {f"d{h}": F.when(ok, F.lead("mid_close", h).over(w) - F.col("mid_close")), f"bid{h}": F.when(ok, F.lead("yes_bid_close", h).over(w)), f"ask{h}": F.when(ok, F.lead("yes_ask_close", h).over(w))}
    f = unblocked(b.withColumns(cols))
    f = f.withColumns({f"gap_{n}": F.col(f"p_{n}") - F.col("mid_close") for n in names})
    f = f.selectExpr(
        "*", "CAST(k AS DOUBLE) AS kf", "CAST(hour AS DOUBLE) AS hour_f", "coalesce(mid_ret_1m, 0e0) AS mid_ret", f"{safe_div('ret_1m', 'sigma_1m')} AS ret_std", f"{safe_div('brti_ret_l10', 'sig_rv60')} AS l10_std", f"{safe_div('brti_ret_l30', 'sig_rv60')} AS l30_std",
        # the index's last move as a move of the fair value
        *[f"exp(-0.5e0 * z_rv60 * z_rv60) / sqrt(2e0 * pi()) * {safe_div(f'brti_ret_l{n}', f'(sig_rv60 * sqrt({h_eff(chr(107))}))')} AS l{n}_fair" for n in (10, 30)],
        f"{ln_ratio('sig_rv15', 'sig_rv240')} AS vol_ratio", f"{ln_ratio('sig_rv60', 'sigma_1m')} AS vol_new_old",
    )
    return f.withColumn("split", F.expr(split_label(val_start, test_start)))


def _stacked(f: DataFrame, keep: list[str], cases: list[dict[str, object]]) -> DataFrame:
    """One row of ``f`` for each case, a set of columns by SQL expression (or a plain value): the frame
    is read once, however many cases there are."""
    names = list(cases[0])
    value = lambda x: x if isinstance(x, str) else repr(x)
    structs = [f"struct({', '.join(f'{value(c[n])} AS {n}' for n in names)})" for c in cases]
    return f.selectExpr(*keep, f"inline(array({', '.join(structs)}))")


def vol_quality(f: DataFrame) -> DataFrame:
    """By sigma and split: correlation of logs and QLIKE on the forecast's own level. The means, one
    row a group, join back."""
    d = _stacked(f.where("fut_rv > 0 AND fut_r2 > 0"), ["split", "fut_rv AS a", "fut_r2 AS b"], [{"sigma": f"'{s}'", "s2": f"CASE WHEN {s} > 0 THEN power({s}, 2) END"} for s in SIGMAS]).where("s2 IS NOT NULL")
    m = d.groupBy("split", "sigma").agg(F.avg("s2").alias("ms"), F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    d = d.join(F.broadcast(m), ["split", "sigma"]).selectExpr("split", "sigma", "ln(s2) AS ls", "ln(a) AS la", "a / (s2 * ma / ms) AS ra", "b / (s2 * mb / ms) AS rb")
    return d.groupBy("split", "sigma").agg(F.corr("ls", "la").alias("corr_log"), F.expr("avg(ra - ln(ra) - 1e0)").alias("qlike_rv"), F.expr("avg(rb - ln(rb) - 1e0)").alias("qlike_r2"), F.count("*").alias("n"))


def ols_days(f: DataFrame, horizons=HORIZONS, gaps=("gap_old", "gap_rv60", "gap_rv15")) -> DataFrame:
    """By horizon, gap, split and day: rows, squared errors of the line fitted on train (d_h on the gap
    by least squares) and of no change. Blocks of an interval, and all that the skill needs."""
    o = f.where("quote_ok AND k <= 12 AND gap_old IS NOT NULL AND gap_rv60 IS NOT NULL")
    d = _stacked(o, ["split", "date"], [{"h": h, "gap": f"'{g}'", "y": f"d{h}", "x": g} for h in horizons for g in gaps]).where("y IS NOT NULL AND x IS NOT NULL")
    line = d.where("split = 'train'").groupBy("h", "gap").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base"))
    t = d.where("split <> 'train'").join(F.broadcast(line), ["h", "gap"])  # a row for each horizon and gap
    return t.groupBy("h", "gap", "split", "date").agg(F.first("slope").alias("slope"), F.count("*").alias("n"), F.expr("sum(power(y - (base + slope * x), 2))").alias("se"), F.expr("sum(power(y, 2))").alias("se_0"))


def ols_gap(f: DataFrame, horizons=HORIZONS, gaps=("gap_old", "gap_rv60", "gap_rv15")) -> DataFrame:
    """d_h on the gap by least squares over train; out-of-sample skill against no change."""
    return ols_days(f, horizons, gaps).groupBy("h", "gap", "split").agg(F.first("slope").alias("slope"), F.expr("1e0 - sum(se) / sum(se_0)").alias("skill"), F.sum("n").alias("n"))


def ols_intervals(f: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Day-block intervals of the skills of ``ols_gap``."""
    return intervals(ols_days(f), ["h", "gap", "split"], [Ratio("skill", "se", "se_0", skill=True)], n_boot, seed)


def trades(f: DataFrame, horizons=HORIZONS, thresholds=(0.01, 0.02)) -> DataFrame:
    """Every trade: enter at the quote when the fair value is off by more than a threshold, leave h
    minutes later at the quote. Dollars a contract before and after spread and fee."""
    cases = [{"h": h, "threshold": f"{thr!r}e0", "d": f"CASE WHEN abs(gap_rv60) > {thr!r}e0 THEN d{h} END", "bid_h": f"bid{h}", "ask_h": f"ask{h}"} for h in horizons for thr in thresholds]
    d = _stacked(f.where("quote_ok AND k <= 12"), ["split", "date", "signum(gap_rv60) AS s", "yes_bid_close AS bid", "yes_ask_close AS ask"], cases).where("d IS NOT NULL")
    d = d.selectExpr("h", "threshold", "split", "date", "s * d AS gross", "CASE WHEN s > 0 THEN bid_h - ask ELSE bid - ask_h END AS net", "CASE WHEN s > 0 THEN ask ELSE bid END AS p_in", "CASE WHEN s > 0 THEN bid_h ELSE ask_h END AS p_out")
    return d.withColumn("pnl", F.expr(f"net - {FEE!r}e0 * (p_in * (1e0 - p_in) + p_out * (1e0 - p_out))"))


def trade_days(f: DataFrame) -> DataFrame:
    """By horizon, threshold, split and day: trades and the sum of what they made."""
    return trades(f).groupBy("h", "threshold", "split", "date").agg(F.count("*").cast("double").alias("trades"), F.sum("pnl").alias("pnl"))


def trade_sim(f: DataFrame, horizons=HORIZONS, thresholds=(0.01, 0.02)) -> DataFrame:
    """Cents a contract of ``trades`` by horizon, threshold and split."""
    t = trades(f, horizons, thresholds).groupBy("h", "threshold", "split")
    return t.agg(F.count("*").alias("trades"), F.expr("100e0 * avg(gross)").alias("gross_c"), F.expr("100e0 * avg(net)").alias("net_c"), F.expr("100e0 * avg(pnl)").alias("pnl_c"), F.expr("avg(CASE WHEN gross > 0 THEN 1e0 ELSE 0e0 END)").alias("hit"))


def trade_intervals(f: DataFrame, least: int = 30, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Day-block intervals of cents a trade, where there are ``least`` trades."""
    days = trade_days(f)
    enough = days.groupBy("h", "threshold", "split").agg(F.sum("trades").alias("all")).where(F.col("all") >= least).drop("all")
    return intervals(days.join(F.broadcast(enough), ["h", "threshold", "split"]), ["h", "threshold", "split"], [Ratio("pnl_c", "pnl", "trades", cents=True)], n_boot, seed)


MINUTE_FEATURES = ("mid_close", "kf", "spread", "gap_old", "z_old", "dp_old", "mid_ret", "ret_std", "log_volume", "log_oi", "hour_f")
TICK_FEATURES = ("gap_rv15", "gap_rv30", "gap_rv60", "gap_rv240", "z_rv60", "dp_rv60", "l10_std", "l30_std", "l10_fair", "l30_fair", "vol_ratio", "vol_new_old")
FEATURES = (*MINUTE_FEATURES, *TICK_FEATURES)
#: trees at most: the error on validation stops before
TREES = 2000


def _boosted(f: DataFrame, h: int, trees: int, features: tuple[str, ...] = FEATURES):
    """The rows with their prediction, the fitted trees and their features (those that ``f`` has); None
    where train or val is empty. Moves are in cents, so that the share of the error that another tree must
    gain is one of about 1. A feature that is undefined in a row is the mean of train there (0 where it
    always is)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    f = f if "kf" in f.columns else f.withColumn("kf", F.col("k").cast("double"))
    features = tuple(c for c in features if c in f.columns)
    d = f.where(f"quote_ok AND k <= 12 AND d{h} IS NOT NULL AND gap_old IS NOT NULL AND gap_rv60 IS NOT NULL").withColumns({"val_": F.col("split") == "val", "y_": F.col(f"d{h}") * 100})
    means = d.where("split = 'train'").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in features]).first()
    if not means["n"] or d.where("val_").isEmpty():
        return None
    d = d.fillna({c: means[c] or 0.0 for c in features})
    d = cut(VectorAssembler(inputCols=list(features), outputCol="features").transform(d))
    model = GBTRegressor(labelCol="y_", maxIter=trees, maxDepth=4, minInstancesPerNode=20, stepSize=0.05, validationIndicatorCol="val_", validationTol=0.001, seed=0).fit(d.where("split IN ('train', 'val')"))
    return model.transform(d).withColumn("prediction", F.col("prediction") / 100), model, features


def gbt_signal(f: DataFrame, h: int = 3, trees: int = TREES) -> DataFrame:
    """Boosted trees on minute and one-second features, stopped on validation; skill by split."""
    made = _boosted(f, h, trees)
    if made is None:
        return f.sparkSession.createDataFrame([], "split string, n long, skill double")
    return made[0].groupBy("split").agg(F.count("*").alias("n"), F.expr(f"1e0 - sum(power(d{h} - prediction, 2)) / sum(power(d{h}, 2))").alias("skill"))


def gbt_days(f: DataFrame, horizons=(3,), trees: int = TREES) -> DataFrame:
    """By horizon, features (1m, or 1m+ticks), split and day: trees, rows, squared errors of the trees and
    of no change. Every horizon and feature set is a fit of its own."""
    out = None
    for h in horizons:
        for name, features in (("1m", MINUTE_FEATURES), ("1m+ticks", FEATURES)):
            made = _boosted(f, h, trees, features)
            if made is not None:
                t = made[0].where("split <> 'train'").groupBy("split", "date").agg(F.count("*").alias("n"), F.expr(f"sum(power(d{h} - prediction, 2))").alias("se"), F.expr(f"sum(power(d{h}, 2))").alias("se_0"))
                t = cut(t.select(F.lit(h).alias("h"), F.lit(name).alias("features"), F.lit(made[1].getNumTrees).alias("trees"), "*"))
                out = t if out is None else out.unionByName(t)
    return f.sparkSession.createDataFrame([], "h int, features string, trees int, split string, date date, n long, se double, se_0 double") if out is None else out


def gbt_comparison(f: DataFrame, horizons=(3,), trees: int = TREES, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """h, features, split, n, skill and its day-block interval: what ticks add to minutes."""
    days = gbt_days(f, horizons, trees)
    keys = ["h", "features", "split"]
    skill = days.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr("1e0 - sum(se) / sum(se_0)").alias("skill"))
    return skill.join(intervals(days.select(*keys, "date", "se", "se_0"), keys, [Ratio("skill", "se", "se_0", skill=True)], n_boot, seed).drop("stat"), keys)


def gbt_importances(f: DataFrame, h: int = 3, trees: int = TREES, top: int = 8) -> DataFrame:
    """place, feature, share of the features that the trees of ``gbt_signal`` gained most from."""
    made = _boosted(f, h, trees)
    gain = made[1].featureImportances.toArray().tolist() if made else []
    best = sorted(zip(gain, made[2] if made else (), strict=True), key=lambda x: (-x[0], x[1]))[:top]
    return f.sparkSession.createDataFrame([(i, n, float(g)) for i, (g, n) in enumerate(best, 1)], "place int, feature string, share double")


#: raw fair values, and the features of each recalibration (a constant comes first)
RAW_FAIR = {"fair_old": "p_old", "fair_rv60": "p_rv60", "fair_rv15": "p_rv15"}
RECALIBRATIONS = {"quote": ("lg",), "quote_z_old": ("lg", "z_old"), "quote_z_rv60": ("lg", "z_rv60"), "quote_z_rv": ("lg", "z_rv15", "z_rv60", "z_rv240")}
#: the penalty on squared weights (half of it), but for the constant's
RIDGE = 0.1


def logit_line(weights, columns) -> str:
    """The logistic function of a weighted sum, the constant first."""
    return "(1e0 / (1e0 + exp(-(" + " + ".join([str(weights[0]), *(f"{w} * {c}" for w, c in zip(weights[1:], columns, strict=True))]) + "))))"


def settled_rows(f: DataFrame) -> DataFrame:
    """The origins of settlement checks: usable quote, all four z, a known outcome y; lg is the quote's logit."""
    p = "greatest(1e-4, least(1e0 - 1e-4, mid_close))"
    d = f.where("quote_ok AND k <= 13 AND outcome_brti IS NOT NULL AND z_old IS NOT NULL AND z_rv15 IS NOT NULL AND z_rv60 IS NOT NULL AND z_rv240 IS NOT NULL")
    return d.selectExpr("split", "date", "mid_close", f"ln({p} / (1e0 - {p})) AS lg", "CAST(outcome_brti AS DOUBLE) AS y", "z_old", "z_rv15", "z_rv60", "z_rv240", *(c for c in RAW_FAIR.values() if c in f.columns))


def newton_logit(rows: DataFrame, sets: dict[str, tuple[str, ...]], ridge: float = RIDGE, steps: int = 50) -> dict[str, list[float]]:
    """Penalised logistic regressions of y on several feature sets at once: a Newton step is one aggregate
    of all sets' gradients and Hessians, a few dozen sums, from which the driver solves for the weights."""
    weights = {s: np.zeros(1 + len(c)) for s, c in sets.items()}
    for _ in range(steps):
        told = rows.selectExpr("*", *[f"{logit_line([lit(float(w)) for w in weights[s]], c)} AS p_{s}" for s, c in sets.items()])
        sums = {}
        for s, c in sets.items():
            x = ("1e0", *c)
            sums |= {f"{s}_g{i}": f"sum((p_{s} - y) * {a})" for i, a in enumerate(x)}
            sums |= {f"{s}_h{i}_{j}": f"sum(p_{s} * (1e0 - p_{s}) * {a} * {x[j]})" for i, a in enumerate(x) for j in range(i + 1)}
        got = told.agg(*[F.expr(e).alias(k) for k, e in sums.items()]).first()
        moved = 0.0
        for s, c in sets.items():
            n = 1 + len(c)
            free = np.array([0.0, *[ridge] * len(c)])
            hessian = np.array([[got[f"{s}_h{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(n)] for i in range(n)]) + np.diag(free)
            step = np.linalg.lstsq(hessian, np.array([got[f"{s}_g{i}"] or 0.0 for i in range(n)]) + free * weights[s], rcond=None)[0]
            weights[s] = weights[s] - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-11:
            break
    return {s: w.tolist() for s, w in weights.items()}


def recalibration_days(f: DataFrame) -> DataFrame:
    """By forecast (raw fair values, and the quote recalibrated on train with several features), split and
    day: rows, squared errors of the forecast and of the quote. Nothing where train knows one outcome only."""
    rows = cut(settled_rows(f))
    if rows.where("split = 'train'").select("y").distinct().count() < 2:
        return rows.sparkSession.createDataFrame([], "features string, split string, date date, n long, se double, se_0 double")
    weights = newton_logit(rows.where("split = 'train'"), RECALIBRATIONS)
    forecasts = {s: c for s, c in RAW_FAIR.items() if c in rows.columns} | {s: logit_line([lit(w) for w in weights[s]], c) for s, c in RECALIBRATIONS.items()}
    d = _stacked(rows, ["split", "date", "y", "mid_close"], [{"features": f"'{s}'", "p": e} for s, e in forecasts.items()])
    return d.groupBy("features", "split", "date").agg(F.count("*").alias("n"), F.expr("sum(power(p - y, 2))").alias("se"), F.expr("sum(power(mid_close - y, 2))").alias("se_0"))


def logit_recalibration(f: DataFrame) -> DataFrame:
    """Brier skill against the quote of ``recalibration_days``, by forecast and split."""
    return recalibration_days(f).groupBy("features", "split").agg(F.sum("n").alias("n"), F.expr("1e0 - sum(se) / sum(se_0)").alias("bss"))


def recalibration_intervals(f: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Day-block intervals of the skills of ``logit_recalibration``."""
    return intervals(cut(recalibration_days(f)).drop("n"), ["features", "split"], [Ratio("bss", "se", "se_0", skill=True)], n_boot, seed)
