import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from forelight.functions.mathx import Q_COLS, norm_cdf, pinball, pit
from forelight.operators import bootstrap, metrics


def test_normal_distribution(spark):
    zs = [x / 4 for x in range(-40, 41)]
    got = spark.createDataFrame([(z,) for z in zs], "z double").selectExpr("z", f"{norm_cdf('z')} AS p").collect()
    assert max(abs(r["p"] - 0.5 * (1 + math.erf(r["z"] / math.sqrt(2)))) for r in got) < 1e-14
    assert spark.sql(f"SELECT {norm_cdf('CAST(NULL AS DOUBLE)')} AS p").first()["p"] is None


def _row(spark, q, y):
    return spark.createDataFrame([(*map(float, q), float(y))], ", ".join(f"{c} double" for c in (*Q_COLS, "y")))


def test_pinball_of_a_point_is_half_the_error(spark):
    assert _row(spark, [0.4] * 9, 0.7).selectExpr(pinball(Q_COLS, "y")).first()[0] == pytest.approx(0.15)


@pytest.mark.parametrize("y, want", [(0.1, 0.1), (0.5, 0.5), (0.55, 0.55), (0.9, 0.9), (0.0, 0.1 * math.exp(-1)), (1.0, 1 - 0.1 * math.exp(-1))])
def test_pit(spark, y, want):
    assert _row(spark, [k / 10 for k in range(1, 10)], y).selectExpr(pit(Q_COLS, "y")).first()[0] == pytest.approx(want)


def test_ks_matches_sorting(spark):
    u = np.random.default_rng(3).beta(2, 1, 500).round(3)
    got = metrics.pit_ks(spark.createDataFrame([("a", float(x)) for x in u], "g string, u double"), ["g"]).first()["pit_ks"]
    s, n = np.sort(u), len(u)
    assert got == pytest.approx(max((np.arange(1, n + 1) / n - s).max(), (s - np.arange(n) / n).max()))


def test_calibration_bins_and_ece(spark):
    rows = spark.createDataFrame([(0.02, 0.0), (0.03, 1.0), (1.0, 1.0), (0.5, None)], "p double, o double")
    t = {r["bin_lo"]: r for r in metrics.calibration(rows, "p").collect()}
    assert set(t) == {0.0, 0.95} and t[0.0]["n"] == 2 and t[0.0]["gap"] == pytest.approx(0.475) and t[0.95]["bin_hi"] == 1.0
    assert metrics.ece(rows, "p").first()[0] == pytest.approx(2 / 3 * 0.475)


def test_bootstrap_interval():
    num, den = np.full((30, 2), 2.0), np.full((30, 2), 4.0)
    lo, hi = bootstrap.ratio_interval(num, den)
    assert np.allclose(lo, 0.5) and np.allclose(hi, 0.5)
    r = np.random.default_rng(0)
    lo, hi = bootstrap.ratio_interval(r.normal(1, 0.2, (200, 1)), np.ones((200, 1)))
    assert lo[0] < 1 < hi[0] and hi[0] - lo[0] < 0.1
    assert np.isnan(bootstrap.ratio_interval(np.zeros((0, 1)), np.zeros((0, 1)))[0]).all()


def test_subsample_matches_linspace(spark):
    from forelight.operators import splits

    for n, k in ((23, 7), (100, 9), (5, 9), (8, 8)):
        df = spark.range(n).withColumn("g", F.lit(1))
        assert sorted(r["id"] for r in splits.subsample(df, "id", k, "g").collect()) == splits.spread_rows(n, k)


def test_ticks_moves_and_scores_are_summed_by_hash(spark, sf, monkeypatch):
    """Neither ticks nor moves are sorted by group, and explode evaluates nothing but a column."""
    from forelight.operators import baselines
    from forelight.operators.bars import aggregate
    from forelight.sources import fixtures

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan(aggregate(fixtures.ticks(spark, sf), "1m"))
    frame = spark.range(900).selectExpr("id AS idx", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, CAST(id AS INT)) AS ts", "CAST(id % 15 AS INT) AS k", "CAST(id % 7 AS DOUBLE) / 10 AS mid_close")
    fan = baselines.persistence_fan(frame)
    assert re.search(r"HashAggregate\(keys=\[k_ctx#\d+, h#\d+, bucket#\d+, [^\]]*\bd#", plan(fan))
    rows = spark.createDataFrame([(0.2, 0.5)], "last_mid double, x double").selectExpr("last_mid", "0 AS k_ctx", "1 AS h")
    applied = baselines.apply_fan(rows, fan)
    assert "lambda" not in plan(applied) and 0 <= applied.first()["fan_q10"] <= applied.first()["fan_q90"] <= 1
    plans = []
    monkeypatch.setattr(metrics, "cut", lambda df: plans.append(plan(df)) or df)
    f = spark.range(1).selectExpr("CAST(id AS DOUBLE) AS mean_fc", "CAST(id AS DOUBLE) AS actual", "CAST(id AS DOUBLE) AS persist", "CAST(id AS DOUBLE) AS rw_p", "CAST(id AS DOUBLE) AS median", "id = 0 AS is_settlement", "id = 0 AS outcome_price", "DATE'2024-01-01' AS date", "TIMESTAMP_NTZ'2024-01-01' AS t0", *[f"CAST(id AS DOUBLE) AS {c}" for c in (*metrics.Q_COLS, *metrics.FAN_Q_COLS)])
    metrics.ScoreSets(f, {"all": []})
    assert any("explode(g_" in p for p in plans) and not any("explode(array" in p for p in plans)


def test_calibrations_and_coverage_read_forecasts_once(spark):
    """all sources and levels come from one scan, with the numbers of each alone."""
    f = spark.range(300).selectExpr("id % 11 / 11e0 AS mean_fc", "id % 7 / 7e0 AS actual", "id % 5 / 5e0 AS persist", "id % 3 / 3e0 AS rw_p", "0.5e0 AS median", "id % 2 = 0 AS is_settlement", "id % 4 = 0 AS outcome_price", "CAST(id % 2 AS INT) AS m_group", *[f"{k / 10} AS q{10 * k}" for k in range(1, 10)], *[f"{k / 10} AS fan_q{10 * k}" for k in range(1, 10)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    table, cover = metrics.settlement_calibration(f), metrics.coverage_by(f)
    assert plan(table).count("Range (0") == 1 and plan(cover).count("Range (0") == 1
    for name, c in metrics.SOURCES.items():
        assert sorted(table.where(f"source = '{name}'").drop("source").collect()) == sorted(metrics.calibration(metrics.scored(f), c).collect())
    got = {(r["m_group"], r["nominal"]): (r["coverage"], r["n"]) for r in cover.collect()}
    want = [sum(20 <= 100 * (i % 7) / 7 <= 80 for i in range(g, 300, 2)) / 150 for g in (0, 1)]
    assert len(got) == 8 and [got[g, 0.6] for g in (0, 1)] == [(pytest.approx(w), 150) for w in want]


def test_fair_value_is_scored_once_a_row(spark):
    """the logarithm of the score stands once in the plan, and the fan is sorted by cell."""
    from forelight.operators import forecast

    rows = spark.range(3).selectExpr("100e0 + id AS brti_close", "101e0 AS strike", "1e-3 * id AS sigma_1m", "CAST(id AS INT) AS m", "0.4e0 AS last_mid", "0 AS k_ctx", "1 AS h", *[f"{k / 10} AS {c}" for k, c in enumerate(Q_COLS)])
    out = forecast.add_baselines(rows, None)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ln(") == 1
    z = [0, -math.log(101 / 101) / 1e-3, math.log(102 / 101) / (2e-3 * math.sqrt(12 + 1 / 3))]
    assert [r["rw_p"] for r in out.orderBy("m").collect()] == [pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2)))) for x in z]
