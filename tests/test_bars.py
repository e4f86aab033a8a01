import datetime as dt
import math

import pytest

from forelight.operators import audit, bars as B
from forelight.sources import fixtures

T0 = dt.datetime(2024, 1, 1)


def ticks(spark, rows):
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=s), float(v)) for s, v in rows], "ts timestamp_ntz, value double")


def rows(df):
    return [r.asDict() for r in df.orderBy("ts").collect()]


def test_prices_gap_and_grid(spark):
    out = rows(B.to_bars(ticks(spark, [(0, 10), (1, 12), (2, 9), (59, 11), (120, 20)]), "1m"))
    assert [r["n_ticks"] for r in out] == [4, 0, 1]
    assert (out[0]["open"], out[0]["high"], out[0]["low"], out[0]["close"]) == (10, 12, 9, 11)
    assert out[0]["mean"] == pytest.approx(10.5) and out[0]["std"] == pytest.approx(math.sqrt(1.25))
    assert out[1]["is_gap"] and out[1]["close"] is None and not out[2]["is_full"] and out[2]["std"] == 0


def test_realised_variance_needs_half_of_the_returns(spark):
    full = rows(B.to_bars(ticks(spark, [(s, 100 + s % 2) for s in range(60)]), "1m"))[0]
    r = math.log(101 / 100)
    assert full["rv_1s"] == pytest.approx(r * r * 60)
    assert rows(B.to_bars(ticks(spark, [(s, 100) for s in range(30)]), "1m"))[0]["rv_1s"] is None


def test_returns_stop_at_midnight_and_long_gaps(spark):
    out = rows(B.aggregate(ticks(spark, [(86398, 1), (86399, 2), (86400, 4), (86401, 8)]), "1s"))
    assert [r["rv_1s"] is None for r in out] == [True, False, True, False]
    out = rows(B.aggregate(ticks(spark, [(0, 1), (61, 2)]), "1s"))
    assert out[1]["rv_1s"] is None


def test_tail_returns(spark):
    out = rows(B.to_bars(ticks(spark, [(s, math.exp(s / 1000)) for s in range(60)]), "1m"))[0]
    assert out["ret_l10"] == pytest.approx(0.010) and out["ret_l30"] == pytest.approx(0.030)
    assert rows(B.to_bars(ticks(spark, [(s, 5) for s in range(50)]), "1m"))[0]["ret_l10"] is None


def test_subsecond_ticks_change_counts_only(spark, sf):
    quiet, loud = (B.to_bars(fixtures.ticks(spark, sf, x), "1m") for x in (False, True))
    same = [c for c in quiet.columns if c != "n_raw_ticks"]
    assert quiet.select(same).exceptAll(loud.select(same)).isEmpty()
    assert loud.agg({"n_raw_ticks": "sum"}).first()[0] == 2 * quiet.agg({"n_raw_ticks": "sum"}).first()[0]


def test_offset_grid_is_an_error(spark):
    with pytest.raises(ValueError, match="whole second"):
        B.to_bars(ticks(spark, [(0.5, 1), (1.5, 2)]), "1m")


def test_whole_history_equals_day_by_day(spark, tmp_path):
    from forelight.sources import store

    t = ticks(spark, [(s * 37, 100 + s % 7) for s in range(7000)])
    store.write_days(t, str(tmp_path / "days"))
    whole = B.aggregate(t, "5m")
    days = [B.aggregate(store.read_days(spark, str(tmp_path / "days"), d, d), "5m") for d in (T0.date(), dt.date(2024, 1, 2), dt.date(2024, 1, 3), dt.date(2024, 1, 4))]
    parts = days[0].union(days[1]).union(days[2]).union(days[3])
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()


def test_store_checks_version_and_grid(spark, tmp_path):
    from forelight.sources import store

    b = B.to_bars(ticks(spark, [(0, 1), (600, 2)]), "1m")
    store.write_bars(b, str(tmp_path / "a"), "1m")
    assert store.load_bars(spark, str(tmp_path / "a"), "1m").count() == 11
    with pytest.raises(ValueError, match="build them anew"):
        store.load_bars(spark, str(tmp_path / "a"), "5m")
    store.write_bars(b.where("NOT is_gap"), str(tmp_path / "b"), "1m")
    with pytest.raises(ValueError, match="holes"):
        store.load_bars(spark, str(tmp_path / "b"), "1m")


def test_gap_runs_join_over_midnight(spark):
    b = B.to_bars(ticks(spark, [(0, 1), (60, 1), (86400 + 600, 1)]), "1m")
    assert [(r["start"], r["length"]) for r in audit.gap_runs(b).collect()] == [(T0 + dt.timedelta(minutes=2), 1440 + 10 - 2)]


def test_ticks_of_one_time_and_far_years(spark):
    at = lambda rows: spark.createDataFrame([(dt.datetime(2045, 1, 1) + dt.timedelta(seconds=s), float(v)) for s, v in rows], "ts timestamp_ntz, value double")
    one, two = (rows(B.to_bars(at(x), "1m")) for x in ([(0, 3), (0, 1), (5, 2), (5, 9)], [(5, 9), (0, 1), (5, 2), (0, 3)]))
    assert one == two and (one[0]["open"], one[0]["close"], one[0]["ts"]) == (1, 9, dt.datetime(2045, 1, 1))


def test_blocks_of_ticks_change_no_return_and_need_one_shuffle(spark):
    """F3-F18: a return over the end of a block, and none over midnight, belongs to its later tick."""
    end = B.BLOCK_S
    out = {r["ts"]: r for r in B.aggregate(ticks(spark, [(end - 61, 1), (end - 60, 2), (end - 1, 4), (end, 8), (end + 1, 8), (86399, 1), (86400, 2)]), "1s").collect()}
    rv = {(t - T0).total_seconds(): r["rv_1s"] for t, r in out.items()}
    two = math.log(2) ** 2
    assert {t: x and round(x / two, 6) for t, x in rv.items()} == {end - 61: None, end - 60: 1, end - 1: 1, end: 1, end + 1: 0, 86399: None, 86400: None}
    assert {r["n_raw_ticks"] for r in out.values()} == {1}
    plan = B.aggregate(ticks(spark, [(0, 1)]), "1m")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "date_trunc" not in plan
