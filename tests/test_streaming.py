import datetime as dt
import os
import random

import pytest

from forelight.operators.bars import BAR_COLUMNS, to_bars
from forelight.streaming import bars as S


def test_stream_closes_the_same_bars_as_batch(spark, sf):
    got = {r["ts"]: (r["open"], r["high"], r["low"], r["close"], r["n_ticks"]) for r in S.bars_of_available(spark, sf).collect()}
    batch = to_bars(spark.read.parquet(f"{sf}/events.parquet"), "15m", every_tick=True).where("NOT is_gap")
    want = {r["ts"]: (r["open"], r["high"], r["low"], r["close"], r["n_ticks"]) for r in batch.collect()}
    assert len(want) - 3 <= len(got) <= len(want) and all(want[t] == v for t, v in got.items())


def uneven_ticks(rng):
    """Holes of minutes, half seconds, repeated times, a midnight, values that have no logarithm."""
    start, out, s = dt.datetime(2024, 1, 1, 23, 40), [], 0.0
    while s < 3600:
        out.append((start + dt.timedelta(seconds=s), round(100 + rng.gauss(0, 1), 3) if rng.random() > 0.01 else -1.0))
        if rng.random() < 0.05:
            out.append((out[-1][0], 99.5))
        s += rng.choice((0.5, 1, 1, 1, 2)) if rng.random() > 0.01 else rng.choice((45, 61, 200))
    return out


def same(a, b):
    return a == b if not isinstance(a, float) or b is None else a == pytest.approx(b, rel=1e-9, abs=1e-12)


def test_the_full_stream_gives_the_batch_bars(spark, tmp_path):
    """Five batches in order, with late ticks inside the watermark: each closed interval is handed on once,
    as the batch has it, empty ones too; so is each series on its own."""
    ticks = uneven_ticks(random.Random(6))
    shuffled = sorted(ticks, key=lambda t: (t[0] + dt.timedelta(seconds=random.Random(str(t)).uniform(0, 90)), t[1]))
    folder = str(tmp_path / "ticks")
    parts = [shuffled[len(shuffled) * k // 5 : len(shuffled) * (k + 1) // 5] for k in range(5)]
    S.stateful(spark)
    schema = "series string, ts timestamp_ntz, value double"
    for k, part in enumerate(parts):
        rows = [("a", *t) for t in part] + [("b", t[0], t[1] + 5) for t in part[::3]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet") and os.path.getmtime(f"{folder}/{f}") > 1e9 + 10 * k + 9:
                os.utime(f"{folder}/{f}", (1e9 + 10 * k, 1e9 + 10 * k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    S.run_to_table(S.full_stream_bars(stream, 60, "2 minutes", "series"), str(tmp_path / "bars"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "bars"))
    end = max(t[0] for t in ticks) - dt.timedelta(minutes=3)
    for name, own in (("a", ticks), ("b", [(t[0], t[1] + 5) for p in parts for t in p[::3]])):
        want = {r["ts"]: r for r in to_bars(spark.createDataFrame(own, "ts timestamp_ntz, value double"), "1m").collect() if r["ts"] <= end}
        got = out.where(f"series = '{name}'").select(*BAR_COLUMNS).collect()
        rows = {r["ts"]: r for r in got}
        assert len(rows) == len(got) and set(want) <= set(rows) and sum(r["is_gap"] for r in got) > 2
        for ts, r in want.items():
            assert all(same(rows[ts][c], r[c]) for c in BAR_COLUMNS), (rows[ts], r)


def test_full_bars_of_ticks_that_are_there(spark, sf):
    from forelight.sources import fixtures

    ticks = fixtures.ticks(spark, sf, loud=True)
    got = {r["ts"]: r for r in S.full_bars_of_available(spark, ticks).collect()}
    batch = {r["ts"]: r for r in to_bars(ticks, "1m").collect()}
    assert len(batch) - 12 <= len(got) < len(batch)
    assert all(same(got[ts][c], batch[ts][c]) for ts in got for c in BAR_COLUMNS)


def test_full_bars_are_dealt_by_day(spark, sf, tmp_path):
    """Days are keys of their own, and days without a tick are still whole; state is written by many tasks."""
    import json

    rng = random.Random(3)
    days = [dt.datetime(2024, 1, 1, 22) + dt.timedelta(days=d) for d in (0, 1, 2, 5, 6)]
    ticks = [(t + dt.timedelta(seconds=s * 7), rng.gauss(100, 1)) for t in days for s in range(1500)]
    rows = spark.createDataFrame(ticks, "ts timestamp_ntz, value double").repartition(3)
    got = {r["ts"]: r for r in S.full_bars_of_available(spark, rows).collect()}
    batch = {r["ts"]: r for r in to_bars(rows, "1m").collect() if r["ts"] + dt.timedelta(minutes=11) <= max(ticks)[0]}
    assert set(got) == set(batch) and len(got) > 7000
    assert all(same(got[ts][c], batch[ts][c]) for ts in got for c in BAR_COLUMNS)
    rows.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema("ts timestamp_ntz, value double").parquet(str(tmp_path / "ticks"))
    q = S.run_to_table(S.full_stream_bars(stream, days=True), str(tmp_path / "bars"), str(tmp_path / "state"))
    q.awaitTermination()
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in json.loads(p.json)["stateOperators"]) > 2 * len(days)
