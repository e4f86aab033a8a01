import datetime as dt
import json

import pytest

from forelight.sources import manifest as M, wire as W


def test_event_frames_by_both_parsers(spark):
    text = [": hello", "event: meta", 'data: {"a":', "data: 1}", "", "data: x", "", "data: lost"]
    assert list(W.parse_events(text)) == [("meta", '{"a":\n1}'), ("message", "x")]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(text)], "file string, no long, line string")
    assert [(r["event"], r["data"]) for r in W.event_frames(df).orderBy("no").collect()] == [("meta", '{"a":\n1}'), ("message", "x")]


def test_frames_keep_id_retry_and_events_without_data(spark):
    long = "x" * 1_200_000
    text = [":", "event: meta", 'data: {"a": 1}', "retry: 10000", "", "event: row", "data: {}", "id: 7", "", "event: ping", "", f"data: {long}", "data", "retry: soon", "", "", "id: 9", "", "event: done", "data: {}"]
    want = [("meta", '{"a": 1}', None, 10_000), ("row", "{}", "7", None), ("ping", "", None, None), ("message", long + "\n", None, None)]
    assert list(W.parse_frames(f"{x}\r\n" for x in text)) == want
    # line numbers beyond 32 bits order lines as well
    df = spark.createDataFrame([("f", (1 << 33) + i, s) for i, s in enumerate(text)], "file string, no long, line string")
    assert [(r["event"], r["data"], r["id"], r["retry"]) for r in W.event_frames(df).orderBy("no").collect()] == want


def test_times():
    assert W.parse_time("2024-01-01T02:00:00.1234567+02:00") == dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    assert W.parse_time(W.format_time(dt.datetime(2024, 5, 6, 7, 8, 9, 10))) == dt.datetime(2024, 5, 6, 7, 8, 9, 10)
    assert W.parse_time(None) is None
    with pytest.raises(ValueError):
        W.parse_time("yesterday")


def write_day(path, day, rows, told=None):
    lines = ["event: meta", "data: " + json.dumps({"columns": ["ts", "value"]}), ""]
    for ts, v in rows:
        lines += ["data: " + json.dumps({"ts": ts, "value": v, "extra": 1}), ""]
    lines += ["event: done", "data: " + json.dumps({"rows": len(rows) if told is None else told}), ""]
    (path / f"{day}.sse").write_text("\n".join(lines) + "\n")


def test_recorded_source(spark, tmp_path):
    spark.dataSource.register(W.EventStreamSource)
    write_day(tmp_path, "2024-01-01", [("2024-01-01T00:00:00Z", 1.5), ("2024-01-01T00:00:01Z", None)])
    write_day(tmp_path, "2024-01-02", [("2024-01-02T00:00:00Z", 2)])
    read = spark.read.format("recorded_events").option("path", str(tmp_path)).option("table", "ticks")
    assert [r["value"] for r in read.load().orderBy("ts").collect()] == [1.5, None, 2.0]
    assert read.option("from", "2024-01-02").load().count() == 1
    write_day(tmp_path, "2024-01-03", [("2024-01-03T00:00:00Z", 2)], told=5)
    with pytest.raises(Exception, match="closes with"):
        read.option("from", "2024-01-03").load().count()


def test_json_rows(spark):
    df = spark.createDataFrame([('{"ts": "2024-01-01T01:00:00.5Z", "value": NaN, "x": 1}',), ('{"ts": "2024-01-01T01:00:00Z", "value": 2}',)], "j string")
    assert [(r["ts"], r["value"]) for r in W.rows_of_json(df, "j", W.TICKS).orderBy("ts").collect()] == [(dt.datetime(2024, 1, 1, 1), 2.0), (dt.datetime(2024, 1, 1, 1, 0, 0, 500000), None)]


def test_plan_merge_and_reconcile(spark):
    days = M.candidate_days(spark, "2024-01-01", "2024-01-04 10:00:00")
    have = spark.createDataFrame([(dt.date(2024, 1, 1), 5, True, True), (dt.date(2024, 1, 2), 5, False, True), (dt.date(2024, 1, 4), 5, True, True)], M.FIELDS)
    plan = sorted(r["day"].day for r in M.plan_days(days, have, "2024-01-04 10:00:00").collect())
    assert plan == [2, 3, 4]
    assert M.plan_days(days, have, "2024-01-04 10:00:00", force=True).count() == 4
    news = spark.createDataFrame([(dt.date(2024, 1, 2), 9, True, True)], M.FIELDS)
    assert {r["day"].day: r["rows"] for r in M.merge(have, news).collect()} == {1: 5, 2: 9, 4: 5}
    old = M.migrate(spark.createDataFrame([(dt.date(2024, 1, 1), 0)], "day date, rows long")).first()
    assert old["complete"] and not old["file_exists"]
    got = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "ts timestamp_ntz")
    told = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 3)], "day date, told long")
    assert {r["day"].day: r["ok"] for r in M.reconcile(got, told).collect()} == {1: True, 2: False}


def test_retries():
    waits: list[float] = []
    r = M.Retry(attempts=3, sleep=waits.append)
    state = {"n": 0}

    def limited():
        state["n"] += 1
        if state["n"] == 1:
            raise M.RateLimited(7)
        yield 1

    assert r.fetch(limited) == ([1], True) and waits == [7]

    def broken():
        yield 1
        raise M.BrokenStream

    assert r.fetch(broken) == ([1], False)

    def down():
        raise ConnectionError
        yield

    with pytest.raises(ConnectionError):
        r.fetch(down)


def test_days_fail_alone(spark, tmp_path):
    """One day whose connection fails, one that is refused, one that breaks off: the others are stored and
    recorded; what a broken day had is kept apart until the day comes whole."""
    from forelight.sources import store

    kept, record = str(tmp_path / "ticks"), str(tmp_path / "manifest")
    days = M.candidate_days(spark, "2024-01-01", "2024-01-06 10:00:00")
    quick = M.Retry(attempts=2, first_wait=0.0, sleep=_still, renew=_still)
    got = {r["day"].day: (r["state"], r["rows"], r["ok"]) for r in M.ingest(spark, troubled, days, "2024-01-06 10:00:00", kept, record, quick).collect()}
    assert got == {1: ("whole", 3, True), 2: ("failed", 0, False), 3: ("broken", 2, False), 4: ("empty", 0, True), 5: ("failed", 0, False), 6: ("whole", 3, True)}
    stored = lambda **how: sorted(r[0] for r in store.read_days(spark, kept, **how).selectExpr("day(ts)").distinct().collect())
    assert stored() == [1, 6] and stored(partial=True) == [1, 3, 6]
    recorded = {r["day"].day: (r["rows"], r["complete"]) for r in M.load(spark, record).collect()}
    assert recorded == {1: (3, True), 3: (2, False), 4: (0, True), 6: (3, False)}  # the snapshot does not close the 6th
    later = "2024-01-07 10:00:00"
    assert sorted(r["day"].day for r in M.plan_days(M.candidate_days(spark, "2024-01-01", later), M.load(spark, record), later).collect()) == [2, 3, 5, 6, 7]
    report = {r["day"].day: r["failure"] for r in M.ingest(spark, calm, days, later, kept, record, quick).collect()}
    assert report == {2: None, 3: None, 5: None, 6: None}
    assert stored() == stored(partial=True) == [1, 2, 3, 5, 6] and all(r["complete"] for r in M.load(spark, record).collect())


def _still(*_):
    pass


def calm(day, rows=3, told=3):
    yield from ("event: meta", 'data: {"table": "ticks", "columns": ["ts", "value"]}', "")
    for s in range(rows):
        yield from ("event: row", f'data: {{"ts": "{day}T00:00:0{s}Z", "value": {s}}}', "")
    if told is not None:
        yield from ("event: done", f'data: {{"rows": {told}}}', "")


def troubled(day):
    if day.endswith("02"):
        raise ConnectionError("500")
    if day.endswith("05"):
        raise M.Rejected("401")
    yield from {"03": calm(day, 2, None), "04": calm(day, 0, 0)}.get(day[-2:], calm(day))


def test_tokens_are_renewed_once_and_limits_counted_apart():
    events: list[str] = []
    script = iter([M.Rejected(), M.RateLimited(1), ConnectionError(), M.RateLimited(None), M.BrokenStream(), None])

    def stream():
        e = next(script)
        if e is not None:
            raise e
        yield 1

    r = M.Retry(attempts=3, throttled=3, ladder=(10, 20), first_wait=2.0, sleep=lambda s: events.append(round(s)), renew=lambda: events.append("renewed"))
    assert r.fetch(stream) == ([1], True) and events[:3] == ["renewed", 1, 2] and 16 <= events[3] <= 24 and events[4:] == [4]

    def refused():
        raise M.Rejected
        yield

    with pytest.raises(M.Rejected):
        r.fetch(refused)
    assert M.Retry(attempts=2, first_wait=0, sleep=_still).fetch(lambda: iter([1, 2]), whole=lambda rows: len(rows) == 3) == ([1, 2], False)


def test_candles_come_by_the_same_road(spark, tmp_path):
    from forelight.sources import store

    names = list(W.CANDLES.columns)
    meta = json.dumps({"table": "candles", "columns": names})

    def stream(day):
        row = {"ts": f"{day}T00:01:00Z", "ticker": "W1", "yes_bid_close": "0.25", "volume": 3, "other": 1}
        yield from ("event: meta", f"data: {meta}", "", f"data: {json.dumps(row)}", "", "event: done", 'data: {"rows": 1}', "")

    kept, record = str(tmp_path / "candles"), str(tmp_path / "m")
    days = M.candidate_days(spark, "2024-01-01", "2024-01-02 10:00:00")
    report = M.ingest(spark, stream, days, "2024-01-02 10:00:00", kept, record, M.Retry(attempts=1), spec=W.CANDLES)
    assert {r["state"] for r in report.collect()} == {"whole"}
    c = store.read_candles(spark, kept, start=dt.date(2024, 1, 2))
    assert c.columns == names and [(r["ticker"], r["yes_bid_close"], r["yes_ask_close"], r["volume"]) for r in c.collect()] == [("W1", 0.25, None, 3.0)]
    wrong = M.ingest(spark, stream, days, "2024-01-02 10:00:00", str(tmp_path / "x"), str(tmp_path / "y"), M.Retry(attempts=1))
    assert all(r["state"] == "failed" and "another stream" in r["failure"] for r in wrong.collect())


def test_a_date_reads_only_its_days(spark, tmp_path):
    """Predicates on ts leave files of other days unread, by the source and by Spark's own reader."""
    ticks = spark.range(0, 4 * 86400, 3600).selectExpr("timestampadd(SECOND, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts", "CASE WHEN id % 7 > 0 THEN id / 8e0 END AS value")
    path = str(tmp_path / "streams")
    W.record(ticks, path)
    whole = W.recorded_source(spark, path)
    want = sorted((r["ts"], r["value"]) for r in ticks.collect() if r["ts"].day == 2)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, ticks.collect()), key=str)
    # files of other days can't be parsed: reading any of them would fail
    import glob

    for f in glob.glob(f"{path}/date=*/*.txt"):
        if "2024-01-02" not in f:
            with open(f, "w") as bad:
                bad.write("data: no json\n\n")
    day = whole.where("ts >= TIMESTAMP_NTZ'2024-01-02 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-03 00:00:00'")
    assert sorted(map(tuple, day.collect()), key=str) == sorted(want, key=str)
    assert whole.where("ts = TIMESTAMP_NTZ'2024-01-02 05:00:00'").count() == 1
    with pytest.raises(Exception, match="JSON|Expecting"):
        whole.where("ts >= TIMESTAMP_NTZ'2024-01-02 00:00:00'").count()
    by_spark = W.recorded(spark, path, start=dt.date(2024, 1, 2), end=dt.date(2024, 1, 2))
    assert sorted(map(tuple, by_spark.collect()), key=str) == sorted(want, key=str)
    assert "PartitionFilters" in by_spark._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="breaks off"):
        list(W.stream_rows([], "2024-01-01", W.TICKS))
