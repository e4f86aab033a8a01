"""Steps that grow with the ticks: how often they read, deal and work out their rows."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from forelight.functions.mathx import norm_cdf, norm_cdf_of
from forelight.operators import bars as B, covariates, frame as FR, metrics, origins as O, signals
from forelight.operators.grid import block_window, blocked, rolling_sums, unblocked
from forelight.sources import fixtures


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def deals(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def some_frame(spark, sf):
    bars = B.to_bars(fixtures.ticks(spark, sf), "1m").localCheckpoint()
    return FR.build_frame(bars, fixtures.candles(bars).localCheckpoint(), 60, 30)


def test_minute_bars_read_the_ticks_once(spark):
    ticks = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, s), float(s)) for s in range(30)], "ts timestamp_ntz, value double")
    out = B.to_bars(ticks, "1m")
    assert "Window" not in optimised(out) and out.count() == 1
    assert B.to_bars(ticks.where("ts IS NULL"), "1m").count() == 0


def test_frame_and_signals_deal_rows_to_blocks_once(spark, sf):
    f = some_frame(spark, sf)
    # bars and candles meet by time, and rows go to blocks beside what they carry
    assert deals(f) <= 5
    assert deals(signals.signal_frame(f.localCheckpoint(), "2024-01-01 01:00:00", "2024-01-01 02:00:00")) == 1


def test_rolling_sums_are_those_of_whole_frames(spark):
    rows = spark.range(0, 9000).selectExpr("id AS idx", "CASE WHEN id % 11 = 3 OR id BETWEEN 3500 AND 3700 THEN NULL ELSE sin(id) + id % 7 END AS x")
    w, sizes = block_window(), (15, 30, 40, 240)
    b = rolling_sums(blocked(rows, 250), "x", sizes)
    over = lambda s: w.rowsBetween(-(s - 1), 0)
    b = b.withColumns({f"c{s}": F.count("x").over(over(s)) for s in sizes} | {f"t{s}": F.coalesce(F.sum("x").over(over(s)), F.lit(0.0)) for s in sizes})
    wrong = " OR ".join(f"n_{s} <> c{s} OR abs(s_{s} - t{s}) > 1e-9" for s in sizes)
    out = unblocked(b)
    assert out.count() == 9000 and out.where(wrong).isEmpty()


def test_calibration_writes_its_bins_out_once(spark):
    rows = spark.range(100).selectExpr("id / 99e0 AS p", "CAST(id % 3 = 0 AS DOUBLE) AS o").unionByName(spark.sql("SELECT 2e0 AS p, 1e0 AS o UNION ALL SELECT NULL, 1e0"))
    out = metrics.calibration(rows.withColumn("q", F.expr("p * 1e0 + 0e0")), "q")
    assert not any("Filter" in line and "0.95" in line for line in optimised(out).splitlines())
    assert out.agg(F.sum("n")).first()[0] == 100 and out.where("bin_lo IS NULL").isEmpty()


def test_paths_are_the_fair_values_of_the_expression(spark):
    z = np.array([-37.5, -9.0, -8.0, -7.1, -1.3, 0.0, 0.2, 7.2, 8.0, 38.0])
    want = [r[0] for r in spark.createDataFrame([(float(x),) for x in z], "z double").selectExpr(f"{norm_cdf('z')} AS p").collect()]
    assert np.allclose(norm_cdf_of(z), want, rtol=1e-14, atol=1e-16)
    table = pa.table({"off": pa.array([0.001, None, 0.5]), "sigma": pa.array([0.0005, 0.1, None]), "k": pa.array([3, 4, 14])})
    paths = covariates.with_paths(table)["path"].to_pylist()
    assert [len(p) for p in paths] == [15] * 3 and np.allclose(paths[1:], 0.5)
    assert math.isclose(paths[0][0], norm_cdf_of(np.array([0.001 / (0.0005 * math.sqrt(13 - 4 + 1 / 3))]))[0], rel_tol=1e-14)


def test_sums_of_tensors_need_no_tensors_outside_their_task(spark, sf):
    f = some_frame(spark, sf).localCheckpoint()
    o = O.make_origins(f, O.OriginSpec(context=32, max_gap_frac=0.1)).localCheckpoint()
    got = {(r["i"], r["name"]): r["total"] for r in covariates.tensor_sums(f, o, 32).collect()}
    past, future = covariates.preset("full")
    rows = covariates.tensors(f, o, 32).collect()
    assert rows and len(got) == len(rows) * (1 + len(past) + len(future))
    for r in rows:
        for name, x in zip(("target", *past, *future), (r["target"], *r["past"], *r["future"]), strict=True):
            assert math.isclose(got[r["i"], name], float(np.nansum(np.array(x, np.float64))), rel_tol=1e-9, abs_tol=1e-9), name
