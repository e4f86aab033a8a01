"""Exact quantiles by radix selection, and score sets against plain aggregates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forelight.operators import metrics, runs
from forelight.operators.select import ordered_key, quantiles, ranked_values


def numbers():
    rng = random.Random(8)
    x = [rng.gauss(0, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(400)] + [rng.uniform(1, 1.000001) for _ in range(500)]
    x += [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308]
    x += [y for e in (-1074, -1030, -3, 0, 1, 52, 53, 1000) for p in (2.0**e,) for y in (p, math.nextafter(p, 0), math.nextafter(p, math.inf), -p)]
    return x + [0.25] * 300


def test_keys_are_in_the_order_of_the_numbers(spark):
    rows = spark.createDataFrame([(float(x),) for x in numbers()], "x double").selectExpr("x", f"{ordered_key('x')} AS key").collect()
    rows.sort(key=lambda r: r["key"])
    assert all((a["x"] < b["x"]) == (a["key"] < b["key"]) and a["x"] <= b["x"] for a, b in zip(rows, rows[1:], strict=False))
    # the key of a positive number is its own bits
    assert all(np.float64(r["x"]).view(np.int64) == r["key"] for r in rows if r["x"] > 0)


@pytest.mark.parametrize("values", [numbers(), [0.1 + 0.2] * 9, [3.5], list(range(1000)), [1.0, None, 2.0, None]])
def test_selected_ranks(spark, values):
    df = spark.createDataFrame([(None if x is None else float(x),) for x in values], "x double")
    have = sorted(x for x in values if x is not None)
    n = len(have)
    ranks = sorted({0, n - 1, n // 2, n // 3, (2 * n) // 3})
    assert ranked_values(df, "x", ranks) == [have[r] for r in ranks]
    shares = (0.0, 1 / 3, 0.5, 0.99, 1.0)
    assert quantiles(df, "x", shares, interpolate=False) == [have[max(0, math.ceil(q * n) - 1)] for q in shares]
    want = df.where("x IS NOT NULL").agg(F.expr(f"percentile(x, array({', '.join(f'{q!r}D' for q in shares)}))")).first()[0]
    assert quantiles(df, "x", shares) == want


def test_no_values_no_quantiles(spark):
    assert quantiles(spark.createDataFrame([(None,)], "x double"), "x", (0.5, 0.9)) == [None, None]


def test_all_groupings_read_the_forecasts_twice(spark, sf):
    from forelight import catalogue

    f = catalogue.assembled(spark, sf)
    rows = metrics.scored(f).toPandas()
    tables, span = runs.score_tables(f, n_boot=20)
    assert span["scored_steps"] == len(rows) and span["windows"] == rows["t0"].nunique() and span["first"] == rows["t0"].min()
    for name, by in (("overall", []), ("by_h", ["h"]), ("by_mh", ["m", "h"]), ("by_vol", ["vol_bucket"]), ("not_settlement", [])):
        got = {tuple(r[k] for k in by): r for r in tables[f"metrics_{name}"].collect()}
        some = rows[~rows["is_settlement"]] if name == "not_settlement" else rows
        groups = {tuple(k if isinstance(k, tuple) else (k,)): g for k, g in some.groupby(by if len(by) > 1 else by[0])} if by else {(): some}
        assert set(got) == {tuple(int(x) for x in k) for k in groups}
        for k, g in groups.items():
            r = got[tuple(int(x) for x in k)]
            u, n = np.sort(g["u"].dropna().to_numpy()), g["u"].notna().sum()
            ks = max((np.arange(1, n + 1) / n - u).max(), (u - np.arange(n) / n).max())
            assert r["n"] == len(g) and r["n_windows"] == g["t0"].nunique() and r["n_days"] == g["date"].nunique()
            assert r["pit_ks"] == pytest.approx(ks, abs=1e-12) and r["mae_c"] == pytest.approx(100 * g["ae"].mean()) and r["rmse_c"] == pytest.approx(100 * math.sqrt(g["se"].mean()))
            settled = g["o"].notna().sum()
            assert r["settle_n"] == settled and (r["settle_brier"] is None if not settled else r["settle_brier"] == pytest.approx(g["br"].mean()))
    again = {(r["source"], r["bin_lo"]): (r["n"], pytest.approx(r["p_mean"]), pytest.approx(r["gap"])) for r in metrics.settlement_calibration(f).collect()}
    assert {(r["source"], r["bin_lo"]): (r["n"], r["p_mean"], r["gap"]) for r in tables["settlement_calibration"].collect()} == again
    sums = metrics.day_statistics(f, "h").groupBy("h").agg(F.sum("pb").alias("pb"), F.sum("one").alias("one"))
    mine = metrics.ScoreSets(f, {"x": ["h"]}).day_sums("x").groupBy("h").agg(F.sum("pb").alias("pb"), F.sum("one").alias("one"))
    assert {r["h"]: (pytest.approx(r["pb"]), r["one"]) for r in mine.collect()} == {r["h"]: (r["pb"], r["one"]) for r in sums.collect()}


def test_gaps_are_exact_whatever_the_values(spark):
    rng = np.random.default_rng(5)
    cases = {"flat": rng.random(3000), "ends": rng.choice([0.0, 1.0, 0.5], 500), "one": np.array([0.37]), "low": rng.random(800) ** 4, "bin": 0.5 + rng.random(2000) / 4000}
    rows = spark.createDataFrame([(g, float(x)) for g, u in cases.items() for x in u] + [("flat", None)], "g string, u double")
    got = {r["g"]: r["pit_ks"] for r in metrics.pit_ks(rows, ["g"]).collect()}
    for g, u in cases.items():
        s, n = np.sort(u), len(u)
        assert got[g] == pytest.approx(max((np.arange(1, n + 1) / n - s).max(), (s - np.arange(n) / n).max()), abs=1e-12), g
