"""Stores that follow their sources day by day equal whole builds, and write only what changed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from forelight.operators.bars import to_bars
from forelight.operators.frame import build_frame
from forelight.sources import fixtures, incremental as I, store


def ticks(spark, first_s, last_s, step=20):
    return spark.range(first_s, last_s, step).selectExpr("timestampadd(SECOND, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts", "100000e0 + 40 * sin(id / 900e0) + id % 7 AS value")


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_bars_and_frames_follow_by_day(spark, tmp_path):
    raw, bars, quotes, frame = (str(tmp_path / x) for x in ("ticks", "bars", "candles", "frame"))
    day = 86_400
    # the first day begins late, the third has no tick, the fourth ends early
    store.write_days(ticks(spark, 70_000, 2 * day).unionByName(ticks(spark, 3 * day + 500, 3 * day + 60_000)), raw)
    names = lambda *d: [f"2024-01-{x:02}" for x in d]
    assert I.update_bars(spark, raw, bars) == names(1, 2, 3, 4)
    assert I.update_bars(spark, raw, bars) == []
    whole = lambda: to_bars(store.read_days(spark, raw), "1m")
    assert rows(I.stored_bars(spark, bars)) == rows(whole())

    def candles():
        store.write_days(fixtures.candles(whole()), quotes)

    candles()
    assert I.update_frame(spark, bars, quotes, frame, 60, 30) == names(1, 2, 3, 4)
    made = lambda: rows(build_frame(whole(), store.read_candles(spark, quotes), 60, 30))
    assert rows(I.stored_frame(spark, frame)) == made()
    assert I.update_frame(spark, bars, quotes, frame, 60, 30) == []
    # a new day: it is built, and the one that it completes
    store.write_days(ticks(spark, 4 * day, 4 * day + 30_000), raw)
    before = {d: x for d, x in I.fingerprints(spark, f"{bars}/days").items()}
    assert I.update_bars(spark, raw, bars) == names(4, 5)
    now = I.fingerprints(spark, f"{bars}/days")
    assert all(now[d] == before[d] for d in names(1, 2, 3))
    assert rows(I.stored_bars(spark, bars)) == rows(whole())
    fresh = fixtures.candles(whole()).where("ts >= TIMESTAMP_NTZ'2024-01-04 12:00:00'").where("to_date(ts) >= DATE'2024-01-05'")
    store.write_days(fresh, quotes)
    assert I.update_frame(spark, bars, quotes, frame, 60, 30) == names(4, 5)
    assert rows(I.stored_frame(spark, frame)) == made()
    # a changed day: it and those that look back on it
    store.write_days(ticks(spark, day, 2 * day, 30), raw)
    assert I.update_bars(spark, raw, bars) == names(2)
    assert I.update_frame(spark, bars, quotes, frame, 60, 30)[0] == names(2)[0]
    assert rows(I.stored_bars(spark, bars)) == rows(whole()) and rows(I.stored_frame(spark, frame)) == made()
    # other look-backs are another key
    assert I.update_frame(spark, bars, quotes, frame, 30, 30) == names(1, 2, 3, 4, 5)
    with pytest.raises(ValueError, match="no day"):
        I.update_bars(spark, str(tmp_path / "none"), bars)


def test_a_build_that_breaks_off_is_taken_up(spark, tmp_path, monkeypatch):
    raw, bars = str(tmp_path / "ticks"), str(tmp_path / "bars")
    store.write_days(ticks(spark, 0, 90_000, 60), raw)
    I.update_bars(spark, raw, bars)
    store.write_days(ticks(spark, 86_400, 100_000, 60), raw)

    def broken(*_):
        raise OSError("disk")

    with monkeypatch.context() as m:
        m.setattr(I, "_replace", broken)
        with pytest.raises(OSError):
            I.update_bars(spark, raw, bars)
    assert I.update_bars(spark, raw, bars) == ["2024-01-02"]
    assert rows(I.stored_bars(spark, bars)) == rows(to_bars(store.read_days(spark, raw), "1m"))
    assert I.stored_bars(spark, bars).agg(F.max("ts")).first()[0] == dt.datetime(2024, 1, 2, 3, 46)
