"""Audits of bars and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .grid import ZERO
from .select import quantiles


def gap_runs(bars: DataFrame, seconds: int = 60) -> DataFrame:
    """start, length of each run of gap bars. Days are numbered apart; only runs that touch a
    midnight, two a day at most, are compared with each other across days."""
    g = bars.where("is_gap").selectExpr("ts", f"timestampdiff(SECOND, {ZERO}, ts) div {seconds} AS n", "to_date(ts) AS day")
    g = g.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy("day").orderBy("n")))
    runs = g.groupBy("day", "island").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.min("ts").alias("start"))
    runs = runs.withColumn("edge", F.expr(f"(a * {seconds}) % 86400 < {seconds} OR ((b + 1) * {seconds}) % 86400 < {seconds}"))
    w = Window.orderBy("a")
    edge = runs.where("edge").withColumn("new", (F.col("a") != F.lag("b", 1, -9).over(w) + 1).cast("int")).withColumn("run", F.sum("new").over(w))
    joined = edge.groupBy("run").agg(F.min("start").alias("start"), (F.max("b") - F.min("a") + 1).alias("length")).select("start", "length")
    return joined.unionByName(runs.where("NOT edge").selectExpr("start", "b - a + 1 AS length"))


def tick_density(bars: DataFrame) -> DataFrame:
    """By day: raw ticks over seconds with ticks, and whether that is once a second."""
    d = bars.groupBy(F.to_date("ts").alias("day")).agg(F.sum("n_raw_ticks").alias("raw"), F.sum("n_ticks").alias("sec"))
    return d.selectExpr("day", "raw", "sec", "CASE WHEN sec > 0 THEN raw / CAST(sec AS DOUBLE) END AS ratio", "CASE WHEN sec > 0 THEN raw / CAST(sec AS DOUBLE) < 1.5e0 END AS once_per_second")


def tick_histogram(bars: DataFrame) -> DataFrame:
    return bars.groupBy("n_ticks").agg(F.count("*").alias("bars"))


def describe_bars(bars: DataFrame, seconds: int = 60) -> DataFrame:
    run = gap_runs(bars, seconds).agg(F.coalesce(F.max("length"), F.lit(0)).alias("largest_gap_bars"))
    days = tick_density(bars).agg(F.count_if(F.col("once_per_second")).alias("days_once_per_second"), F.count_if(~F.col("once_per_second")).alias("days_sub_second"))
    one = bars.agg(F.count("*").alias("n_bars"), F.count_if("is_gap").alias("n_gaps"), F.count_if(~F.col("is_full")).alias("n_not_full"), F.count_if(F.col("rv_1s").isNull()).alias("n_no_rv"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return one.join(F.broadcast(run), F.lit(True)).join(F.broadcast(days), F.lit(True))  # one row each


def describe_frame(frame: DataFrame) -> DataFrame:
    """Windows, completeness, imputed strikes, degenerate quotes, the strike identity's error and
    how often the price's and the index's outcome disagree. Quantiles take the nearest rank."""
    with_candle = frame.where("has_candle")
    first = lambda c: F.expr(f"min_by({c}, ts)").alias(c)
    wins = with_candle.groupBy("t0").agg(F.count("*").alias("n"), first("strike_imputed"), first("outcome_price"), first("outcome_brti"), F.expr("min_by(floor_strike, ts) FILTER (WHERE floor_strike IS NOT NULL)").alias("kalshi"), first("strike_from_brti"))
    wins = cut(wins.withColumn("e", F.expr("abs(kalshi - strike_from_brti)")))
    half, most = (F.lit(x).cast("double") for x in quantiles(wins, "e", (0.5, 0.99), interpolate=False))
    a = wins.agg(
        F.count("*").alias("n_windows"), F.count_if(F.col("n") == 15).alias("n_complete_windows"), F.count_if("strike_imputed").alias("n_windows_strike_imputed"),
        F.max(half).alias("strike_err_p50"), F.max(most).alias("strike_err_p99"),
        F.expr("avg(CASE WHEN outcome_price IS NOT NULL AND outcome_brti IS NOT NULL THEN CASE WHEN outcome_price <> outcome_brti THEN 1e0 ELSE 0e0 END END)").alias("outcome_disagreement"),
    )
    b = frame.agg(F.count("*").alias("n_rows"), F.count_if("has_candle").alias("n_rows_with_candle"), F.count_if(F.col("sigma_rv").isNull()).alias("n_rows_no_sigma_rv"), F.count_if(F.expr("has_candle AND target_valid AND NOT quote_ok")).alias("n_rows_quote_degenerate"))
    return b.join(F.broadcast(a), F.lit(True))  # one row each
