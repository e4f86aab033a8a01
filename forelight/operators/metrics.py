"""Skill, calibration and settlement scores of long forecasts, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.mathx import FAN_Q_COLS, Q_COLS, clip, pinball, pit, skill
from ..session import cut
from .grid import ZERO

# The edges of the calibration bins.
CAL_EDGES = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0 + 1e-9)
EPS, PIT_BINS = 1e-4, 1024
SOURCES = {"model": "mean_fc", "persistence": "persist", "rw": "rw_p"}


def scored(forecasts: DataFrame) -> DataFrame:
    """Per-row losses that every score is a mean of."""
    log_loss = lambda p: f"-(o * ln({clip(p, EPS, 1 - EPS)}) + (1e0 - o) * ln(1e0 - {clip(p, EPS, 1 - EPS)}))"
    brier = lambda p: f"power({clip(p, EPS, 1 - EPS)} - o, 2)"
    f = forecasts.selectExpr("*", "CASE WHEN is_settlement AND outcome_price IS NOT NULL THEN CASE WHEN outcome_price THEN 1e0 ELSE 0e0 END END AS o")
    return f.selectExpr(
        "*", "power(mean_fc - actual, 2) AS se", "power(persist - actual, 2) AS se_p", "power(rw_p - actual, 2) AS se_rw", "abs(median - actual) AS ae", "abs(fan_q50 - actual) AS ae_p",
        f"{pinball(Q_COLS, 'actual')} AS pb", f"{pinball(FAN_Q_COLS, 'actual')} AS pb_f", f"{pit(Q_COLS, 'actual')} AS u",
        "abs(mean_fc - persist) > 1e-9 AND abs(actual - persist) > 1e-9 AS moves", "signum(mean_fc - persist) = signum(actual - persist) AS right_way",
        f"{brier('mean_fc')} AS br", f"{brier('persist')} AS br_p", f"{brier('rw_p')} AS br_rw", f"{log_loss('mean_fc')} AS ll", f"{log_loss('persist')} AS ll_p",
    )


_SHARE = "avg(CASE WHEN {} THEN 1e0 ELSE 0e0 END)"
_BASE = {
    "n": "count(*)", "n_windows": "count(DISTINCT t0)", "n_days": "count(DISTINCT date)", "mse": "avg(se)", "mse_p": "avg(se_p)", "mse_rw": "avg(se_rw)", "mae": "avg(ae)", "mae_p": "avg(ae_p)",
    "pb_": "avg(pb)", "pbf_": "avg(pb_f)", "bias": "avg(mean_fc - actual)", "cover80": _SHARE.format("actual >= q10 AND actual <= q90"), "cover60": _SHARE.format("actual >= q20 AND actual <= q80"),
    "cover80_fan": _SHARE.format("actual >= fan_q10 AND actual <= fan_q90"), "width": "avg(q90 - q10)", "width_fan": "avg(fan_q90 - fan_q10)", "dir_acc": "avg(CASE WHEN moves THEN CASE WHEN right_way THEN 1e0 ELSE 0e0 END END)",
    "dir_n": "count_if(moves)", "settle_n": "count(o)", "settle_brier": "avg(br)", "settle_brier_persist": "avg(br_p)", "settle_brier_rw": "avg(br_rw)", "settle_logloss": "avg(ll)", "settle_logloss_persist": "avg(ll_p)",
}
_FINAL = {
    "rmse_c": "100e0 * sqrt(mse)", "rmse_c_persist": "100e0 * sqrt(mse_p)", "rmse_c_rw": "100e0 * sqrt(mse_rw)", "skill_mse": skill("mse", "mse_p"), "skill_mse_rw": skill("mse_rw", "mse_p"), "bias_c": "100e0 * bias",
    "mae_c": "100e0 * mae", "mae_c_persist": "100e0 * mae_p", "skill_mae": skill("mae", "mae_p"), "pinball_c": "100e0 * pb_", "pinball_c_fan": "100e0 * pbf_", "skill_pinball": skill("pb_", "pbf_"),
    "width80_c": "100e0 * width", "width80_c_fan": "100e0 * width_fan", "settle_bss_persist": skill("settle_brier", "settle_brier_persist"), "settle_bss_rw": skill("settle_brier", "settle_brier_rw"),
}
METRIC_COLUMNS = (
    "n", "n_windows", "n_days", "rmse_c", "rmse_c_persist", "rmse_c_rw", "skill_mse", "skill_mse_rw", "bias_c", "mae_c", "mae_c_persist", "skill_mae", "pinball_c", "pinball_c_fan", "skill_pinball", "cover80", "cover60",
    "cover80_fan", "width80_c", "width80_c_fan", "pit_ks", "dir_acc", "dir_n", "settle_n", "settle_brier", "settle_brier_persist", "settle_brier_rw", "settle_bss_persist", "settle_bss_rw", "settle_logloss", "settle_logloss_persist", "settle_ece",
)


def _ks_bin(u: str = "u") -> str:
    return f"CAST(least(floor({u} * {PIT_BINS}), {PIT_BINS - 1}) AS BIGINT)"


def _ks_candidates(bins: DataFrame, by: list[str]) -> DataFrame:
    """by..., bin, before, total of the bins in which the largest gap can lie. ``bins``: by..., bin, c.
    Inside a bin ranks and values are known up to the bin's own count and width, which bounds its gaps
    from above, and its first and last value from below. At most ``PIT_BINS`` rows a group."""
    w = Window.partitionBy(*by)
    t = bins.withColumns({"before": F.coalesce(F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("c").over(w)})
    low, high = f"(bin / {PIT_BINS}e0)", f"((bin + 1) / {PIT_BINS}e0)"
    first, last = "(before / total)", "((before + c) / total)"
    t = t.withColumns({"most": F.expr(f"greatest({last} - {low}, {high} - {first})"), "least": F.expr(f"greatest({last} - {high}, {low} - {first})")})
    return t.withColumn("sure", F.max("least").over(w)).where("most >= sure - 1e-9").select(*by, "bin", "before", "total")


def _ks_gaps(rows: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """by..., pit_ks from the rows (by..., u) of candidate bins: a rank is what comes before the bin plus
    the rank inside it. Null keys are keys."""
    r = rows.where("u IS NOT NULL").withColumn("bin", F.expr(_ks_bin()))
    c = candidates.select("before", "total", *[F.col(k).alias(f"c_{k}") for k in (*by, "bin")])
    on = F.lit(True)
    for k in (*by, "bin"):
        on = on & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    r = r.join(F.broadcast(c), on).select(*by, "u", "bin", "before", "total")  # at most PIT_BINS rows a group
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*by, "bin").orderBy("u"))
    gap = F.greatest(F.col("rank") / F.col("total") - F.col("u"), F.col("u") - (F.col("rank") - 1) / F.col("total"))
    return r.withColumn("rank", rank).withColumn("gap", gap).groupBy(*by).agg(F.max("gap").alias("pit_ks"))


def pit_ks(rows: DataFrame, by: list[str]) -> DataFrame:
    """Kolmogorov-Smirnov distance of ``u`` from uniform per group, exact: only the few bins of u that
    can hold the largest gap are ranked."""
    r = rows.select(*by, "u").where("u IS NOT NULL")
    bins = cut(r.groupBy(*by, F.expr(_ks_bin()).alias("bin")).agg(F.count("*").alias("c")))
    return _ks_gaps(r, _ks_candidates(bins, by), by)


def cal_bin(p: str) -> str:
    return "CASE " + " ".join(f"WHEN {p} >= {lo!r}e0 AND {p} < {('%.10f' % hi)}e0 THEN {k}" for k, (lo, hi) in enumerate(zip(CAL_EDGES, CAL_EDGES[1:], strict=False))) + " END"


def calibration(rows: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """bin_lo, bin_hi, n, p_mean, freq_up, gap, se of each non-empty bin. ``rows`` needs o."""
    by = by or []
    t = rows.where("o IS NOT NULL").withColumn("bin", F.expr(cal_bin(p))).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.expr(f"sum({p})").alias("p_sum"), F.sum("o").alias("o_sum"), F.max("bin").alias("bin_"))
    # a condition on bin itself is moved down to the rows, where p is written out once for each edge
    return _calibrated(t.where("bin_ IS NOT NULL"), by)


def _calibrated(t: DataFrame, by: list[str]) -> DataFrame:
    """The table of ``calibration`` from by..., bin, n, p_sum, o_sum."""
    low = F.array(*[F.lit(float(x)) for x in CAL_EDGES[:-1]])
    high = F.array(*[F.lit(min(float(x), 1.0)) for x in CAL_EDGES[1:]])
    t = t.withColumns({"p_mean": F.col("p_sum") / F.col("n"), "freq_up": F.col("o_sum") / F.col("n"), "bin": F.col("bin").cast("int")})
    t = t.withColumns({"bin_lo": low[F.col("bin")], "bin_hi": high[F.col("bin")], "gap": F.col("freq_up") - F.col("p_mean"), "se": F.expr("sqrt(greatest(freq_up * (1e0 - freq_up), 1e-12) / n)")})
    return t.select(*by, "bin_lo", "bin_hi", "n", "p_mean", "freq_up", "gap", "se")


def ece(rows: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return calibration(rows, p, by).groupBy(*by).agg(F.expr("sum(n * abs(gap)) / sum(n)").alias("ece"))


DAY_SUMS = {"se": "mse", "se_p": "mse_p", "ae": "mae", "ae_p": "mae_p", "pb": "pb_", "pb_f": "pbf_"}
_DAY_ZERO = "DATE'1970-01-01'"


class ScoreSets:
    """Every score of several groupings from three readings of the forecasts.

    ``sets`` names groupings, lists of keys (an empty one: all rows), ``where`` conditions of some. Each
    reading gives a row to all groupings at once. The first sums by grouping, keys and day, the second counts
    by bin of u and calibration bin: both merge on each task, and are as few as there are groups, days and
    bins. The third reads u in the bins that can hold the largest gap. Windows start on quarters of an hour,
    so those of a day are 96 bits."""

    def __init__(self, forecasts: DataFrame, sets: dict[str, list[str]], where: dict[str, str] | None = None):
        self.sets, self.keys = sets, sorted({k for ks in sets.values() for k in ks})
        rows, p = scored(forecasts), clip("mean_fc", EPS, 1 - EPS)
        kinds = dict(forecasts.dtypes)
        key = lambda name, k: f"CAST({k if k in sets[name] else 'NULL'} AS {kinds[k]}) AS key_{k}"
        within = lambda name, e: f"CASE WHEN {where[name] if where and name in where else 'true'} THEN {e} END"
        member = lambda name, *more: f"struct('{name}' AS in_, {', '.join([key(name, k) for k in self.keys] + ['0 AS none_', *more])})"
        # the array is a column first: what explode itself evaluates is interpreted row by row
        every = lambda df, *structs: df.withColumn("g_", F.expr(f"array({', '.join(structs)})")).withColumn("g", F.explode("g_")).drop("g_").where("g IS NOT NULL")
        self.group = ["in_", *[f"key_{k}" for k in self.keys]]
        told = every(rows.withColumn("day", F.expr(f"datediff(date, {_DAY_ZERO})")).where("day IS NOT NULL"), *[within(n, member(n)) for n in sets]).select("*", "g.*")
        window = f"(timestampdiff(MINUTE, {ZERO}, t0) div 15) % 96"
        sums = {"c": "count(*)", "w1": f"bit_or(CASE WHEN {window} < 64 THEN shiftleft(1L, CAST({window} AS INT)) ELSE 0L END)", "w2": f"bit_or(CASE WHEN {window} >= 64 THEN shiftleft(1L, CAST({window} AS INT) - 64) ELSE 0L END)", "t_first": "min(t0)", "t_last": "max(t0)"}
        for c, e in _BASE.items():
            if e.startswith("avg("):
                sums |= {f"s_{c}": f"sum({e[4:-1]})", f"n_{c}": f"count({e[4:-1]})"}
        sums |= {"n_dir": "count(CASE WHEN moves THEN 1 END)", "n_o": "count(o)"}
        self.days = cut(told.groupBy(*self.group, F.col("day").cast("long").alias("sub")).agg(*[F.expr(e).alias(c) for c, e in sums.items()]))
        cell = lambda part, sub, x: (f"'{part}' AS part", f"CAST({sub} AS BIGINT) AS sub", f"{x} AS p")
        parts = []
        for name in sets:
            told = [cell("pit", f"CASE WHEN u IS NOT NULL THEN {_ks_bin()} END", "CAST(NULL AS DOUBLE)")]
            plain = not sets[name] and not (where and name in where)
            for part, x in {"ece": p, **({f"cal_{s}": c for s, c in SOURCES.items()} if plain else {})}.items():
                told.append(cell(part, f"CASE WHEN o IS NOT NULL THEN {cal_bin(x)} END", x))
            parts += [within(name, member(name, *c)) for c in told]
        binned = every(rows, *parts).where("g.sub IS NOT NULL").select("o", "g.*")
        self.parts = cut(binned.groupBy(*self.group, "part", "sub").agg(F.count("*").alias("c"), F.sum("p").alias("p_sum"), F.expr("sum(CASE WHEN part <> 'pit' THEN o END)").alias("o_sum")))
        bins = self.parts.where("part = 'pit'").select(*self.group, F.col("sub").alias("bin"), "c")
        spread = every(rows, *[within(n, member(n)) for n in sets]).select("g.*", "u")
        self.ks = cut(_ks_gaps(spread, _ks_candidates(bins, self.group), self.group))

    def _of(self, table: DataFrame, name: str) -> DataFrame:
        mine = self.sets[name]
        return table.where(F.col("in_") == name).select(*[F.col(f"key_{k}").alias(k) for k in mine], *[c for c in table.columns if c not in self.group])

    def metrics(self, name: str) -> DataFrame:
        """The 32 scores of one grouping."""
        by = self.sets[name]
        days = self._of(self.days, name)
        sums = [c for c in days.columns if c[:2] in ("s_", "n_")]
        t = days.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.bit_count("w1") + F.bit_count("w2")).cast("long").alias("n_windows"), F.count("*").alias("n_days"), *[F.sum(c).alias(c) for c in sums])
        t = t.where("n IS NOT NULL")
        means = {c: F.expr(f"CASE WHEN n_{c} > 0 THEN s_{c} / n_{c} END") for c, e in _BASE.items() if e.startswith("avg(")}
        t = t.withColumns(means | {"dir_n": F.col("n_dir"), "settle_n": F.col("n_o")})
        t = t.withColumns({c: F.expr(e) for c, e in _FINAL.items()})
        bins = self._of(self.parts.where("part = 'ece'"), name).withColumn("gap", F.expr("abs(o_sum - p_sum)"))
        e = bins.groupBy(*by).agg((F.sum("gap") / F.sum("c")).alias("settle_ece"))
        ks = self._of(self.ks, name)
        if not by:
            return t.join(F.broadcast(ks), F.lit(True), "left").join(F.broadcast(e), F.lit(True), "left").select(*METRIC_COLUMNS)  # one row each
        same = lambda a: [F.col(f"t.{k}").eqNullSafe(F.col(f"{a}.{k}")) for k in by]
        out = t.alias("t").join(ks.alias("ks"), same("ks"), "left").join(e.alias("e"), same("e"), "left")
        return out.select(*[F.col(f"t.{k}").alias(k) for k in by], *METRIC_COLUMNS)

    def day_sums(self, name: str) -> DataFrame:
        """by..., date and the seven sums that the block bootstrap needs."""
        days = self._of(self.days, name)
        return days.select(*self.sets[name], F.expr(f"date_add({_DAY_ZERO}, CAST(sub AS INT))").alias("date"), *[F.col(f"s_{c}").alias(n) for n, c in DAY_SUMS.items()], F.col("c").cast("double").alias("one"))

    def calibrations(self, name: str) -> DataFrame:
        """The calibration tables of all sources, for a grouping of all rows."""
        t = self._of(self.parts.where("part LIKE 'cal_%'"), name)
        return _calibrated(t.select(F.substring("part", 5, 20).alias("source"), F.col("sub").alias("bin"), F.col("c").alias("n"), "p_sum", "o_sum"), ["source"])

    def span(self, name: str) -> dict:
        """Rows, windows, days, first and last window of a grouping of all rows."""
        m, t = self.metrics(name).first(), self._of(self.days, name).agg(F.min("t_first"), F.max("t_last")).first()
        counts = (m["n"], m["n_windows"], m["n_days"]) if m else (0, 0, 0)
        return dict(zip(("scored_steps", "windows", "days", "first", "last"), (*counts, *t), strict=True))


def settlement_calibration(forecasts: DataFrame) -> DataFrame:
    """The calibration tables of all sources from one reading of the forecasts."""
    each = ", ".join(f"struct('{name}' AS source, {c} AS p)" for name, c in SOURCES.items())
    rows = scored(forecasts).where("o IS NOT NULL").selectExpr("o", f"array({each}) AS g_").select("o", F.explode("g_").alias("g")).select("o", "g.*")
    t = calibration(rows, "p", ["source"])
    return t.select(*[c for c in t.columns if c != "source"], "source")


def metrics_by(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """All 32 scores by group."""
    return ScoreSets(forecasts, {"by": by}).metrics("by")


def day_statistics(forecasts: DataFrame, key: str) -> DataFrame:
    """The seven sums a day and key that the block bootstrap needs."""
    s = scored(forecasts)
    return s.groupBy("date", key).agg(*[F.sum(c).alias(c) for c in ("se", "se_p", "ae", "ae_p", "pb", "pb_f")], F.count("*").cast("double").alias("one"))


def pit_histogram(forecasts: DataFrame, bins: int = 20) -> DataFrame:
    return scored(forecasts).groupBy(F.least(F.floor(F.col("u") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def coverage_by(forecasts: DataFrame, by: str = "m_group") -> DataFrame:
    """Empirical against nominal coverage of the four central intervals, from one reading."""
    levels = ((10, 90, 0.8), (20, 80, 0.6), (30, 70, 0.4), (40, 60, 0.2))
    t = forecasts.groupBy(by).agg(F.count("*").alias("n"), *[F.expr(_SHARE.format(f"actual >= q{lo} AND actual <= q{hi}")).alias(f"c{lo}") for lo, hi, _ in levels])
    each = ", ".join(f"struct(c{lo} AS coverage, n, {nominal}e0 AS nominal)" for lo, _, nominal in levels)
    return t.select(by, F.explode(F.expr(f"array({each})")).alias("g")).select(by, "g.*")


def skill_grid(forecasts: DataFrame) -> DataFrame:
    """skill_mse by minute and step."""
    return scored(forecasts).groupBy("m", "h").agg(F.expr("avg(se)").alias("mse"), F.expr("avg(se_p)").alias("mse_p")).selectExpr("m", "h", f"{skill('mse', 'mse_p')} AS skill_mse")


def trajectories(forecasts: DataFrame, minutes=(0, 5, 10), every: int = 7, limit: int = 12) -> DataFrame:
    """Whole forecast paths of every n-th window at chosen minutes, for plots."""
    w = forecasts.where(F.col("m").isin(*minutes)).select("t0").distinct()
    w = w.where(F.expr(f"(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', t0) div 900) % {every} = 0")).orderBy("t0").limit(limit)
    return forecasts.where(F.col("m").isin(*minutes)).join(w, "t0", "left_semi").select("t0", "m", "h", "q10", "median", "q90", "actual")
