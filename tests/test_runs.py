import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from forelight import catalogue as C
from forelight.config import Config
from forelight.operators import baselines, bootstrap, forecast, metrics, origins as O, runs, signals, splits
from forelight.session import cut, shared_dir
from forelight.sources import fixtures, manifest as M, store

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark, sf):
    frame = C.minute_frame(spark, sf)
    o = cut(C.all_origins(frame))
    fan = cut(baselines.persistence_fan(frame))
    return cut(forecast.assemble(forecast.drift_forecast(frame, o), frame, o, fan)), fan


def test_a_run_is_stored_and_scored_anew(spark, rows, tmp_path):
    forecasts, fan = rows
    first = runs.store_run(forecasts, fan, {"context": 32}, str(tmp_path / "run"), n_boot=50)
    again = runs.rescore(spark, str(tmp_path / "run"), str(tmp_path / "again"))
    for name in first:
        a, b = (sorted(map(str, t[name].select(*sorted(t[name].columns)).collect())) for t in (first, again))
        assert a == b and (name == "settlement_calibration" or a)
    usable = runs.rescore(spark, str(tmp_path / "run"), str(tmp_path / "usable"), require_quote_ok=True)
    assert usable["metrics_overall"].first()["n"] == forecasts.where("quote_ok").count() < forecasts.count()
    meta = json.loads(spark.read.text(str(tmp_path / "usable" / "meta")).first()["value"])
    assert meta["config"] == {"context": 32, "require_quote_ok": True, "fan": "own"}
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "run" / "summary")).collect()]
    assert {f"== {x} ==" for x in ("overall", "by steps ahead", "skill_mse, minutes by steps")} <= set(lines) and f"scored_steps: {forecasts.count()}" in lines
    spark.range(1).selectExpr("1 AS h").write.mode("overwrite").parquet(str(tmp_path / "run" / "baselines"))
    with pytest.raises(ValueError, match="no price buckets"):
        runs.rescore(spark, str(tmp_path / "run"), str(tmp_path / "old"))


def test_a_backtest_by_its_settings(spark, sf, tmp_path):
    """Settings choose origins, fan and draws; the run keeps what was dropped and where its fan is from; a
    run that breaks off leaves the one before in place."""
    frame = C.minute_frame(spark, sf)
    path = str(tmp_path / "run")
    config = Config({"origins": {"context": 32, "max_gap_frac": 0.1}, "run": {"max_windows": 3, "bootstrap_days": 20}}, {"FORELIGHT_RUN_STRIDE_WINDOWS": "1"})
    tables = runs.backtest_of(config, frame, forecast.drift_forecast, path)
    f, fan, info = runs.load_run(spark, path)
    assert f.select("t0").distinct().count() == 3 and info["n_boot"] == 20 and fan is None and info["provenance"] == {"fan_mode": "point"}
    dropped = {r["drop_reason"]: r["n"] for r in tables["drops"].collect()}
    assert dropped and set(dropped) <= set(O.REASONS)
    given = runs.backtest_of(config, frame, forecast.drift_forecast, path, cut(baselines.persistence_fan(frame)))
    assert runs.load_run(spark, path)[2]["provenance"] == {"fan_mode": "file"} and given["metrics_overall"].count() == 1

    def broken(frame, origins):
        return forecast.drift_forecast(frame, origins).withColumn("q10", F.raise_error(F.lit("no model")).cast("double"))

    with pytest.raises(Exception, match="no model"):
        runs.backtest_of(config, frame, broken, path)
    assert runs.load_run(spark, path)[2]["provenance"] == {"fan_mode": "file"}
    before = runs.load_run(spark, path)[0].count()
    runs.rescore(spark, path, path)  # onto its own place
    assert runs.load_run(spark, path)[0].count() == before and spark.read.parquet(f"{path}/drops").count() == len(dropped)
    with pytest.raises(ValueError, match="no origin"):
        runs.run_backtest(frame, forecast.drift_forecast, O.OriginSpec(context=32), path, start=dt.date(2030, 1, 1))


def test_intervals_weigh_whole_days(rows):
    """Against drawing days one by one with the same counts."""
    forecasts, _ = rows
    got = {(r["key"], r["stat"]): (r["lo"], r["hi"]) for r in bootstrap.bootstrap_by(forecasts, "m_group", 40).collect()}
    sums = metrics.day_statistics(forecasts, "m_group").toPandas()
    days = sorted(sums["date"].unique())
    counts = bootstrap.day_counts(len(days), 40, 0)
    for key in sums["m_group"].unique():
        of = {d: sums[(sums["date"] == d) & (sums["m_group"] == key)] for d in days}
        for name, a, b in (("mae_c", "ae", "one"), ("skill_mse", "se", "se_p")):
            drawn = []
            for c in counts:
                x, y = (sum(n * float(of[d][col].sum()) for n, d in zip(c, days, strict=True)) for col in (a, b))
                if y:
                    drawn.append(100 * x / y if name == "mae_c" else 1 - x / y)
            assert got[key, name] == pytest.approx(np.quantile(drawn, [0.025, 0.975]))
    lo, hi = bootstrap.ratio_interval([[1.0], [0.0]], [[2.0], [0.0]], 30)
    assert lo[0] == hi[0] == 0.5  # draws without a denominator do not count


def test_signals(spark):
    """Lines, trades, trees and recalibration on a frame with a known answer."""
    r = np.random.default_rng(0)
    out = []
    for i in range(1200):
        gap, side = float(r.normal(0, 0.05)), ["train", "val", "test"][i % 3]
        mid, z = float(r.uniform(0.2, 0.8)), float(r.normal())
        move = 0.4 * gap + float(r.normal(0, 0.002))
        out.append((side, DAY + dt.timedelta(days=i % 9), i % 13, mid, mid - 0.01, mid + 0.01, True, gap, move, mid + move - 0.01, mid + move + 0.01, z, bool(r.random() < 1 / (1 + np.exp(-2 * z)))))
    f = spark.createDataFrame(out, "split string, date date, k int, mid_close double, yes_bid_close double, yes_ask_close double, quote_ok boolean, gap_rv60 double, d3 double, bid3 double, ask3 double, z_old double, outcome_brti boolean")
    f = f.withColumns({c: F.col("gap_rv60") for c in ("gap_old", "gap_rv15", "gap_rv240")} | {c: F.col("z_old") for c in ("z_rv60", "z_rv15", "z_rv240")} | {c: F.lit(0.02) for c in ("spread", "log_volume", "log_oi")})
    line = signals.ols_gap(f, (3,), ("gap_rv60",)).where("split = 'test'").first()
    assert line["slope"] == pytest.approx(0.4, abs=0.01) and line["skill"] > 0.95 and line["n"] == 400
    sums = signals.ols_days(f, (3,), ("gap_rv60",)).where("split = 'test'").collect()
    assert len(sums) == 3 and line["skill"] == pytest.approx(1 - sum(x["se"] for x in sums) / sum(x["se_0"] for x in sums))
    t = signals.trade_sim(f, (3,), (0.02,)).where("split = 'test'").first()
    took = [x for x in out if x[0] == "test" and abs(x[7]) > 0.02]
    gains = [(x[9] - x[5] if x[7] > 0 else x[4] - x[10]) - signals.FEE * sum(p * (1 - p) for p in ((x[5], x[9]) if x[7] > 0 else (x[4], x[10]))) for x in took]
    assert t["trades"] == len(took) and t["pnl_c"] == pytest.approx(100 * np.mean(gains)) and t["hit"] > 0.9
    skills = {r["split"]: r["skill"] for r in signals.gbt_signal(f).collect()}
    assert set(skills) == {"train", "val", "test"} and skills["test"] > 0.4
    best = signals.gbt_importances(f).collect()
    assert len(best) == 8 and best[0]["share"] >= best[-1]["share"] and sum(r["share"] for r in best if "gap" in r["feature"]) > 0.5
    bss = {(r["features"], r["split"]): r["bss"] for r in signals.logit_recalibration(f).collect()}
    assert bss["quote_z_old", "test"] > bss["quote", "test"] and bss["quote_z_old", "test"] > 0.2
    none = f.limit(0)
    assert signals.gbt_signal(none).count() == signals.gbt_importances(none).count() == signals.logit_recalibration(none).count() == signals.ols_gap(none, (3,)).count() == 0


def test_recalibration_and_trees_by_day(spark):
    """Newton's weights are the optimum; the days add up; all feature sets and intervals are there."""
    r = np.random.default_rng(3)
    rows = []
    for i in range(900):
        z = r.normal(size=4)
        mid = float(r.uniform(0.05, 0.95))
        p = 1 / (1 + np.exp(-(np.log(mid / (1 - mid)) + 0.8 * z[0] - 0.3 * z[3])))
        rows.append((["train", "val", "test"][i % 3], DAY + dt.timedelta(days=i % 10), i % 14, mid, True, bool(r.random() < p), *map(float, z), mid, mid, mid))
    f = spark.createDataFrame(rows, "split string, date date, k int, mid_close double, quote_ok boolean, outcome_brti boolean, z_old double, z_rv15 double, z_rv60 double, z_rv240 double, p_old double, p_rv60 double, p_rv15 double")
    train = signals.settled_rows(f).where("split = 'train'")
    weights = signals.newton_logit(train, signals.RECALIBRATIONS)
    pdf = train.toPandas()
    for s, c in signals.RECALIBRATIONS.items():
        x, w = np.c_[np.ones(len(pdf)), pdf[list(c)]], np.array(weights[s])
        gradient = x.T @ (1 / (1 + np.exp(-x @ w)) - pdf["y"]) + signals.RIDGE * np.r_[0, w[1:]]
        assert np.abs(gradient).max() < 1e-8
    days = signals.recalibration_days(f)
    assert {x["features"] for x in days.select("features").distinct().collect()} == {*signals.RAW_FAIR, *signals.RECALIBRATIONS}
    bss = {(x["features"], x["split"]): x["bss"] for x in signals.logit_recalibration(f).collect()}
    assert bss["fair_old", "test"] == pytest.approx(0) and bss["quote_z_rv", "train"] > bss["quote", "train"]
    ends = {(x["features"], x["split"]): (x["lo"], x["hi"], x["n_days"]) for x in signals.recalibration_intervals(f, 200).collect()}
    assert set(ends) == set(bss) and all(lo <= bss[k] <= hi and n == 10 for k, (lo, hi, n) in ends.items())


def test_epochs_are_permutations_that_resume(spark):
    from forelight.operators import splits

    n = 500
    df = spark.range(n).selectExpr("id * 37 + 5 AS i", "id AS at")
    got = {(r["epoch"], r["place"]): r for r in splits.epochs(df, "i", 0, 3, 32, seed=4).collect()}
    assert len(got) == 4 * n and {p for _, p in got} == set(range(4 * n))
    for e in range(4):
        order = [got[e, e * n + k]["at"] for k in range(n)]
        assert sorted(order) == list(range(n)) and order != sorted(order)
        # neither near its old place nor near its old neighbours
        assert np.mean(np.abs(np.diff(order)) < 20) < 0.15 and abs(np.corrcoef(order, range(n))[0, 1]) < 0.15
        assert e == 0 or order != [got[e - 1, (e - 1) * n + k]["at"] for k in range(n)]
    assert all(r["batch"] == p // 32 for (_, p), r in got.items())
    again = splits.epochs(df.orderBy(F.rand(1)), "i", 1, 2, 32, seed=4, start=700).collect()
    assert {(r["epoch"], r["place"], r["at"]) for r in again} == {(e, p, r["at"]) for (e, p), r in got.items() if e in (1, 2) and p >= 700}
    assert splits.epochs(df.limit(0), "i", 0, 1, 8).count() == 0
    one = splits.epochs(df.limit(1), "i", 0, 2, 2).collect()
    assert sorted((r["epoch"], r["place"], r["batch"]) for r in one) == [(0, 0, 0), (1, 1, 0), (2, 2, 1)]


def test_stores_are_built_where_stale(spark, sf, tmp_path):
    ticks, bars, candles, frame = (str(tmp_path / x) for x in ("ticks", "bars", "candles", "frame"))
    store.write_days(fixtures.ticks(spark, sf), ticks)
    n = store.build_bars(spark, ticks, bars).count()
    made = store.newest(spark, f"{bars}/bars")
    assert store.build_bars(spark, ticks, bars).count() == n and store.newest(spark, f"{bars}/bars") == made
    assert store.build_bars(spark, ticks, bars, "5m").count() < n  # another width is another key
    store.build_bars(spark, ticks, bars, force=True)
    fixtures.candles(store.load_bars(spark, bars, "1m")).write.parquet(candles)
    f = store.build_frame_store(spark, bars, candles, frame, 60, 30)
    made = store.newest(spark, f"{frame}/frame")
    assert f.count() == n and store.newest(spark, f"{frame}/frame") == made
    with pytest.raises(ValueError, match="build it anew"):
        store.load_frame(spark, frame, 240, 30)
    fixtures.candles(store.load_bars(spark, bars, "1m")).limit(10).write.mode("append").parquet(candles)
    fixtures.candles(store.load_bars(spark, bars, "1m")).write.mode("overwrite").parquet(candles)
    assert store.build_frame_store(spark, bars, candles, frame, 60, 30).count() == n and store.newest(spark, f"{frame}/frame") > made
    with pytest.raises(ValueError, match="no day from"):
        store.read_days(spark, ticks, dt.date(2030, 1, 1), strict=True)


def lines_of(day):
    """A stream of three ticks; the second day closes with another count, the third breaks off, the
    fourth is limited."""
    yield from ("event: meta", 'data: {"table": "ticks", "columns": ["ts", "value"]}', "")
    if day.endswith("04"):
        raise M.RateLimited(0)
    for s in range(3):
        yield from (f'data: {{"ts": "{day}T00:00:0{s}Z", "value": {s}}}', "")
    if not day.endswith("03"):
        yield from ("event: done", f'data: {{"rows": {5 if day.endswith("02") else 3}}}', "")


def test_ingestion(spark, tmp_path):
    kept, record = str(tmp_path / "ticks"), str(tmp_path / "manifest")
    days = M.candidate_days(spark, "2024-01-01", "2024-01-03 10:00:00")
    quick = M.Retry(attempts=2, first_wait=0.0, sleep=_no_wait)
    report = {r["day"].day: (r["rows"], r["told"], r["ok"]) for r in M.ingest(spark, lines_of, days, "2024-01-03 10:00:00", kept, record, quick).collect()}
    assert report == {1: (3, 3, True), 2: (3, 5, False), 3: (3, None, False)}
    assert [r[0] for r in store.read_days(spark, kept).select(F.to_date("ts")).distinct().collect()] == [DAY]
    assert {r["day"].day: r["complete"] for r in M.load(spark, record).collect()} == {1: True, 2: False, 3: False}
    due = M.plan_days(days, M.load(spark, record), "2024-01-03 10:00:00")
    assert sorted(r["day"].day for r in due.collect()) == [2, 3]
    with pytest.raises(Exception, match="rate limited"):
        M.fetch(spark.createDataFrame([(dt.date(2024, 1, 4),)], "day date"), lines_of, quick).collect()
    with pytest.raises(ValueError, match="another stream"):
        list(M.day_rows(lines_of("2024-01-01"), "2024-01-01", key="other", spec=M.TableSpec("candles", {"ts": "timestamp_ntz"})))
    with pytest.raises(ValueError, match="a row of"):
        list(M.day_rows(lines_of("2024-01-01"), "2024-01-09"))
    assert M.load(spark, str(tmp_path / "none")).count() == 0


def _no_wait(_):
    pass


def test_settings_have_an_order(spark, tmp_path):
    (tmp_path / "c.toml").write_text("[origins]\ncontext = 64\nmax_gap_frac = 0.2\n")
    c = Config.load(spark, str(tmp_path / "c.toml"))
    c.env = {"FORELIGHT_ORIGINS_CONTEXT": "96", "FORELIGHT_ORIGINS_HORIZON": "128", "FORELIGHT_RUN_PLOT": "no"}
    assert c.pick(32, "origins", "context", 1) == 32 and c.pick(None, "origins", "context", 1) == 64
    assert c.pick(None, "origins", "horizon", 64) == 128 and c.pick(None, "run", "plot", True) is False and c.pick(None, "run", "label") is None
    spec = c.fill("origins", O.OriginSpec, minutes="0-4")
    assert (spec.context, spec.horizon, spec.max_gap_frac, spec.minutes) == (64, 128, 0.2, (0, 1, 2, 3, 4))
    with pytest.raises(ValueError):
        Config(env={"FORELIGHT_A_B": "maybe"}).pick(None, "a", "b", True)


def test_shared_folder_is_named(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert splits.SPLITS == ("train", "val", "test")
