import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from forelight import catalogue as C
from forelight.operators import audit, bars as B, baselines, covariates, forecast, frame as FR, metrics, origins as O, splits
from forelight.session import cut
from forelight.sources import fixtures


@pytest.fixture(scope="module")
def frame(spark, sf):
    return C.minute_frame(spark, sf)


@pytest.fixture(scope="module")
def origins(frame):
    return cut(C.all_origins(frame))


def test_labels_and_strike(frame):
    # a candle labelled with the minute's end sits on the bar of that minute
    assert frame.where("has_candle AND brti_is_gap").isEmpty()
    # the quoted strike is the mean of the bar before the window
    bad = frame.where("abs(strike - strike_from_brti) > 1e-6 AND NOT strike_imputed")
    assert bad.isEmpty()
    assert frame.groupBy("t0").agg(F.count_distinct("strike").alias("n")).where("n > 1").isEmpty()
    assert not frame.where("strike_imputed").isEmpty()


def test_misaligned_candles_show_in_the_audit(spark, sf, frame):
    good = audit.describe_frame(frame).first()
    bad = audit.describe_frame(C.minute_frame(spark, sf, shift=1)).first()
    assert good["outcome_disagreement"] == 0 and bad["strike_err_p50"] > 1 > good["strike_err_p50"]


def test_two_contracts_a_minute_fail(spark, sf):
    bars = C.minute_bars(spark, sf)
    c = fixtures.candles(bars)
    twice = c.unionByName(c.limit(1).withColumn("ticker", F.lit("other")))
    with pytest.raises(Exception, match="more than one contract"):
        FR.relabel(twice).count()


def test_no_feature_looks_ahead(spark, sf, frame):
    """Poisoning ticks after a moment changes no bar-based feature at or before it."""
    cutoff = dt.datetime(2024, 1, 1, 1, 0)
    t = fixtures.ticks(spark, sf)
    poisoned = t.withColumn("value", F.when(F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz"), F.col("value") * 3).otherwise(F.col("value")))
    bars, clean = B.to_bars(poisoned, "1m"), B.to_bars(t, "1m")
    candles = fixtures.candles(clean)
    cols = ["ts", "ret_1m", "sigma_1m", "sigma_rv", "vol_ratio", "moneyness", "rw_z_rv", "mid_ret_1m"]
    a, b = (FR.build_frame(x, candles, 60, 30).where(F.col("ts") < F.lit(cutoff).cast("timestamp_ntz")).select(cols) for x in (bars, clean))
    assert a.exceptAll(b).isEmpty()


def test_origin_arithmetic(origins):
    ok = origins.where("ok")
    assert ok.where("n_steps <> 15 - m OR origin_ts <> timestampadd(MINUTE, m, t0)").isEmpty()
    assert set(r[0] for r in origins.select("drop_reason").distinct().collect()) - {None} <= set(O.REASONS)
    assert origins.where("i < 31 AND drop_reason <> 'insufficient_history'").isEmpty()


def test_specs_are_checked():
    assert O.parse_minutes("3-5,14") == (3, 4, 5, 14)
    for bad in ("15", "", "a-b"):
        with pytest.raises(ValueError):
            O.parse_minutes(bad)
    with pytest.raises(ValueError):
        O.OriginSpec(context=33)
    with pytest.raises(ValueError):
        O.OriginSpec(horizon=60)


def test_persistence_forecast_has_no_skill(spark, frame, origins):
    """A forecaster that repeats the reference scores zero against persistence."""
    long = forecast.valid_steps(frame, origins).join(origins.select("i", "k_ctx"), "i")
    ref = "CASE WHEN k_ctx = 14 THEN 0.5e0 ELSE last_mid END"
    long = long.selectExpr("i", "h", "k", f"{ref} AS median", *[f"{ref} AS q{10 * j}" for j in range(1, 10)], "actual")
    m = metrics.metrics_by(forecast.assemble(long, frame, origins, None), []).first()
    assert m["skill_mse"] == pytest.approx(0, abs=1e-12) and m["skill_mae"] == pytest.approx(0, abs=1e-12)
    assert m["pinball_c"] == pytest.approx(m["mae_c"] / 2)


def test_fan_modes(frame):
    start = frame.agg(F.min("ts")).first()[0]
    _, info = baselines.fit_fan(frame, start, 1)
    assert info["fan_mode"] == "point"  # the smallest tables fill no cell
    assert baselines.fit_fan(frame, start, stored=baselines.persistence_fan(frame))[1] == {"fan_mode": "file"}


def test_model_forecast_contract(frame, origins):
    import numpy as np

    t = covariates.tensors(frame, origins, 32)

    def predict(x, horizon):
        last = np.nan_to_num(x[:, -1])[:, None] + np.zeros((len(x), horizon))
        return last, np.repeat(last[:, :, None], 10, axis=2) + np.linspace(-0.1, 0.1, 10)

    long = forecast.model_forecast(frame, origins, t, predict)
    assert long.count() == forecast.valid_steps(frame, origins).count()
    assert long.where("q10 < 0 OR q90 > 1 OR q10 > q20").isEmpty()
    with pytest.raises(ValueError):
        forecast.check_prediction(np.zeros((2, 3)), np.zeros((2, 3, 8)), 2, 3)


def test_tensors_see_only_their_context(frame, origins):
    t = covariates.tensors(frame, origins, 32).orderBy("i").first()
    mids = [r[0] for r in frame.where(f"idx BETWEEN {t['i'] - 31} AND {t['i']}").orderBy("idx").select("mid_close").collect()]
    known = [(a, b) for a, b in zip(t["target"], mids, strict=True) if b is not None]
    assert all(abs(a - b) < 1e-3 for a, b in known) and len(t["past"]) == 17 and len(t["future"]) == 7 and len(t["future"][0]) == 96


def test_interpolation_and_flat_blocks():
    import numpy as np

    nan = float("nan")
    x = np.array([[nan, 1, nan, 3, nan], [nan] * 5])
    assert covariates.interpolate_rows(x).tolist() == [[1, 1, 2, 3, 3], [0] * 5]
    assert np.isnan(covariates.interpolate_rows(x, True)[0, 0])
    y, n = covariates.sanitise(np.ones((2, 64)))
    assert n == 4 and y.std() > 0 and abs(y - 1).max() < 1e-4
    assert covariates.sanitise(np.arange(64.0)[None])[1] == 0


def test_splits_are_disjoint_with_embargo():
    b = splits.split_bounds(dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 21), 0.2, 0.2, 30)
    assert b.train[1] + dt.timedelta(minutes=30) == b.val[0] and b.val[1] + dt.timedelta(minutes=30) == b.test[0]
    with pytest.raises(ValueError):
        splits.split_bounds(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 5))
    assert splits.spread_rows(10, 4) == [0, 3, 6, 9] and splits.spread_rows(3, 5) == [0, 1, 2]
    assert splits.lr_at(0, 100, 10, 1.0) == pytest.approx(0.1) and splits.lr_at(100, 100, 10, 1.0) == pytest.approx(0)


def test_learning_rate_counts_from_zero():
    """Step s here is step s + 1 of a schedule that counts from 1."""
    from_one = lambda n: n / 10 if n <= 10 else 0.5 * (1 + np.cos(np.pi * (n - 10) / 100))
    assert all(splits.lr_at(s, 110, 10, 1.0) == pytest.approx(from_one(s + 1)) for s in range(110))


def test_given_split_dates_and_no_common_rows(spark, origins, frame):
    first = frame.agg(F.min("ts")).first()[0]
    day = dt.datetime(2024, 1, 1)
    b = splits.split_bounds(first, day + dt.timedelta(hours=2, minutes=10), embargo_minutes=5, val_start=day + dt.timedelta(hours=1), test_start=day + dt.timedelta(hours=1, minutes=40))
    s = splits.assign_splits(origins.where("ok"), first, b).where("split IS NOT NULL")
    reach = s.selectExpr("split", "explode(sequence(i + 1, i + n_steps)) AS target")
    parts = [reach.where(f"split = '{n}'").select("target") for n in splits.SPLITS]
    assert all(not p.isEmpty() for p in parts)
    assert all(parts[i].intersect(parts[j]).isEmpty() for i in range(3) for j in range(i))


def test_interpolation_by_rows_matches_numpy():
    r = np.random.default_rng(4)
    x = np.where(r.random((40, 30)) < 0.6, np.nan, r.normal(size=(40, 30)))
    for row, got in zip(x, covariates.interpolate_rows(x), strict=True):
        have = np.flatnonzero(~np.isnan(row))
        assert np.allclose(got, np.interp(np.arange(30), have, row[have]) if len(have) else 0.0)
