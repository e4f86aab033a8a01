"""Ticks to regular bars: once-per-second statistics, realised variance, tail returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.mathx import safe_ln
from ..session import cut
from .grid import at_second, complete

FREQ_SECONDS = {"1s": 1, "5s": 5, "15s": 15, "30s": 30, "1m": 60, "5m": 300, "15m": 900, "1h": 3600}
ON_SECOND = "CAST(date_trunc('SECOND', ts) AS TIMESTAMP_NTZ) = ts"
#: whole seconds since 1970 of a time without a zone, whatever the session's zone
SEC = "unix_timestamp(ts)"
MAX_RETURN_GAP_S, TAIL_TOLERANCE_S = 60, 5
#: seconds whose ticks are put in order together (or one bar, if that is longer)
BLOCK_S = 900
#: seconds of bars that are few beside their ticks
FEW_S = 60
BAR_COLUMNS = ("ts", "open", "high", "low", "close", "mean", "std", "rv_1s", "ret_l10", "ret_l30", "n_ticks", "n_raw_ticks", "is_gap", "is_full")


def aggregate(ticks: DataFrame, freq: str, every_tick: bool = False) -> DataFrame:
    """Bars of the intervals that hold ticks. Only ticks on a whole second enter prices
    and returns (all ticks with ``every_tick``); a return belongs to its later tick, spans
    a minute at most and never crosses a UTC day. So work is dealt in blocks of seconds that hold whole
    bars, each with the last minute of the block before (its halo): neighbours are found and bars summed
    with one shuffle, and the sort finds blocks by number. Ticks of one time are taken by value, the
    least first; a tick without a time is in no bar."""
    s = FREQ_SECONDS[freq]
    size = max(s, BLOCK_S)
    on = "true" if every_tick else "window(ts, '1 second').start = ts"
    t = ticks.where("ts IS NOT NULL").selectExpr("ts", "value", f"{on} AS on_sec", f"{SEC} AS sec")
    late = f"CASE WHEN sec < 0 THEN sec % {size} > -{MAX_RETURN_GAP_S} ELSE sec % {size} >= {size - MAX_RETURN_GAP_S} END"
    t = t.selectExpr("ts", "value", "on_sec", f"explode(CASE WHEN {late} THEN array(sec div {size}, sec div {size} + 1) ELSE array(sec div {size}) END) AS block").repartition("block")
    w = Window.partitionBy("block", "on_sec").orderBy("ts", "value")
    t = t.withColumns({"before": F.lag("ts").over(w), "lag_value": F.lag("value").over(w), "next": F.lead("ts").over(w)})
    t = t.selectExpr("block", "value", "on_sec", f"{SEC} AS sec", "unix_timestamp(before) AS before", "unix_timestamp(next) AS after", f"{safe_ln('value')} AS lv", f"{safe_ln('lag_value')} AS lag_lv").where(f"sec div {size} = block")
    day = lambda x: f"({x} - pmod({x}, 86400))"
    t = t.selectExpr(
        "*", f"sec div {s} AS bar", f"sec % {s} AS off", f"CASE WHEN on_sec AND sec - before <= {MAX_RETURN_GAP_S} AND {day('sec')} = {day('before')} THEN lv - lag_lv END AS r",
        f"after IS NULL OR after div {s} <> sec div {s} AS ends", f"before IS NULL OR before div {s} <> sec div {s} AS starts",
    )
    here = "FILTER (WHERE on_sec)"
    # a tick is known as its bar's first or last from its neighbours, so every aggregate keeps one number
    one = lambda x, where: f"max(CASE WHEN on_sec AND {where} THEN {x} END)"

    def tail(n: int) -> str:
        mark = s - 1 - n
        early = f"off <= {mark} AND off > {mark - TAIL_TOLERANCE_S} AND (ends OR after % {s} > {mark})"
        return f"CASE WHEN max(off) {here} >= {s - TAIL_TOLERANCE_S} THEN {one('lv', 'ends')} - {one('lv', early)} END"

    exprs = {
        "open": one("value", "starts"), "high": f"max(value) {here}", "low": f"min(value) {here}", "close": one("value", "ends"), "mean": f"avg(value) {here}", "std": f"stddev_pop(value) {here}",
        "rv_1s": f"CASE WHEN count(r) >= {max(s // 2, 1)} THEN sum(r * r) * {s} / count(r) END", "ret_l10": tail(10), "ret_l30": tail(30), "n_ticks": "count_if(on_sec)", "n_raw_ticks": "count(*)",
    }
    return t.groupBy("block", "bar").agg(*[F.expr(e).alias(c) for c, e in exprs.items()]).selectExpr(f"{at_second(f'bar * {s}')} AS ts", *exprs)


def to_bars(ticks: DataFrame, freq: str = "1m", every_tick: bool = False) -> DataFrame:
    """Bars on a complete grid. Ticks that all miss the whole second are an error."""
    size, made = FREQ_SECONDS[freq], aggregate(ticks, freq, every_tick)
    if size >= FEW_S:
        # such bars are few beside the ticks: kept, they tell the grid's ends, and ticks are read once
        made = cut(made)
        low, high, whole = made.agg(F.expr("unix_timestamp(min(ts))"), F.expr("unix_timestamp(max(ts))"), F.max("n_ticks")).first()
        missed = not whole and not ticks.isEmpty()
    else:
        label = lambda x: f"(unix_timestamp({x}) div {size}) * {size}"
        # Three scalars from one scan without a shuffle; the aggregate itself runs once.
        low, high, n = ticks.agg(F.expr(label("min(ts)")), F.expr(label("max(ts)")), F.count("*")).first()
        missed = n and not every_tick and ticks.where(ON_SECOND).isEmpty()
    if missed and not every_tick:
        raise ValueError("there are ticks, but none on a whole second: once-per-second bars can't be built")
    return flagged(complete(made, size, low, high), freq).select(*BAR_COLUMNS)


def flagged(bars: DataFrame, freq: str) -> DataFrame:
    """Bars joined to a grid, with counts of 0 where there is none, is_gap and is_full."""
    out = bars.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_ticks", "n_raw_ticks")})
    return out.withColumns({"is_gap": F.col("n_ticks") == 0, "is_full": F.col("n_ticks") == FREQ_SECONDS[freq]})
