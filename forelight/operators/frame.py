"""The minute feature frame: bars beside re-labelled quote candles, strikes, features, fair values, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.mathx import WINDOW_MINUTES, h_eff, ln_ratio, norm_of_tail, norm_tail, safe_div, safe_ln, z_score
from .grid import block_window, blocked, bucket, carry_last, rolling_sums, unblocked

MAX_QUOTE_SPREAD, RV_FAST, RV_SLOW = 0.10, 15, 240


def relabel(candles: DataFrame) -> DataFrame:
    """End-labelled candles on the bar they describe; one contract a minute, the last row wins."""
    c = candles.withColumn("bar_ts", F.expr("timestampadd(MINUTE, -1, ts)")).drop("ts")
    w = Window.partitionBy("bar_ts")
    several = F.when(F.min("ticker").over(w) != F.max("ticker").over(w), F.raise_error(F.lit("more than one contract per minute")).cast("boolean")).otherwise(F.lit(True))
    c = c.withColumn("one", several).withColumn("place", F.row_number().over(w.orderBy(F.desc("ticker")))).where("one AND place = 1")
    return c.drop("one", "place").withColumnsRenamed({f"price_{x}": f"trade_{x}" for x in ("open", "high", "low", "close", "mean")})


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with idx, which is arithmetic on the complete grid."""
    low = bars.agg(F.min("ts")).first()[0]
    return bars.selectExpr("*", f"timestampdiff(MINUTE, TIMESTAMP_NTZ'{low}', ts) AS idx")


def core(bars: DataFrame, candles: DataFrame) -> DataFrame:
    """Numbered bars LEFT JOIN candles with clock columns."""
    frame = bars.withColumnsRenamed({c: f"brti_{c}" for c in bars.columns if c not in ("ts", "idx", "n_ticks", "n_raw_ticks")})
    frame = frame.join(relabel(candles), F.col("ts") == F.col("bar_ts"), "left").drop("bar_ts")
    return frame.selectExpr(
        "*", f"{bucket('ts', 900)} AS t0", "minute(ts) % 15 AS k", "to_date(ts) AS date", "hour(ts) AS hour",
        "hour(ts) * 60 + minute(ts) AS minute_of_day", "ticker IS NOT NULL AS has_candle",
    )


def with_moves(b: DataFrame, vol_lookback: int = 240, rv_lookback: int = 30) -> DataFrame:
    """What comes from the rows before: returns, volatilities, and at a window's start the mean of the bar
    before it. ``b``: blocks with a halo, and ``carried``, the last price before the halo."""
    w = block_window()
    filled = F.coalesce(F.last("brti_close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "carried")
    before = {"prev_settle": F.when(F.col("k") == 0, F.lag("brti_mean").over(w)), "mid_ret_1m": F.when(F.col("k") > 0, F.col("mid_close") - F.lag("mid_close").over(w))}
    b = b.withColumns({"filled": filled, **before}).withColumn("lfill", F.expr(safe_ln("filled")))
    b = b.withColumn("ret_1m", F.col("lfill") - F.lag("lfill").over(w)).drop("carried", "filled", "lfill")
    b = rolling_sums(b, "brti_rv_1s", sorted({RV_FAST, rv_lookback, RV_SLOW}))
    over = w.rowsBetween(-(vol_lookback - 1), 0)
    b = b.withColumn("sigma_1m", F.when(F.count("ret_1m").over(over) >= max(10, vol_lookback // 4), F.stddev_samp("ret_1m").over(over)))
    rv = lambda size: F.expr(f"CASE WHEN n_{size} >= {max(size // 2, 1)} THEN sqrt(s_{size} / n_{size}) END")
    b = b.withColumns({"sigma_rv": rv(rv_lookback), "rv_fast": rv(RV_FAST), "rv_slow": rv(RV_SLOW)})
    return b.withColumn("vol_ratio", F.expr(ln_ratio("rv_fast", "rv_slow"))).drop("rv_fast", "rv_slow", *[f"{c}_{s}" for c in "ns" for s in {RV_FAST, rv_lookback, RV_SLOW}])


def _whole_window():
    """All rows of a contract window; blocks have enough of their neighbours to hold those of their own rows."""
    return Window.partitionBy("block", "t0").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def with_quotes(frame: DataFrame) -> DataFrame:
    """What a row's own quotes tell."""
    mid = {f"mid_{x}": f"(yes_bid_{x} + yes_ask_{x}) / 2e0" for x in ("close", "open", "high", "low")}
    frame = frame.withColumns({c: F.expr(e) for c, e in mid.items()} | {"spread": F.expr("yes_ask_close - yes_bid_close"), "log_volume": F.log1p("volume"), "log_oi": F.log1p("open_interest")})
    return frame.withColumns({
        "trade_close_imp": F.coalesce("trade_close", "mid_close"), "trade_mean_imp": F.coalesce("trade_mean", "mid_close"),
        "target_valid": F.expr("has_candle AND yes_bid_close IS NOT NULL AND yes_ask_close IS NOT NULL"), "is_settlement": F.col("k") == 14,
    }).withColumn("quote_ok", F.expr(f"target_valid AND spread <= {MAX_QUOTE_SPREAD!r}e0"))


def with_strikes(b: DataFrame) -> DataFrame:
    """One strike a window: the quoted one, else the mean of the bar before the window."""
    first = lambda c: F.first(c, ignorenulls=True).over(_whole_window())
    b = b.withColumns({"kalshi": first("floor_strike"), "strike_from_brti": first("prev_settle"), "win_ticker": first("ticker")})
    return b.withColumns({"strike": F.coalesce("kalshi", "strike_from_brti"), "strike_imputed": F.col("kalshi").isNull() & F.col("strike_from_brti").isNotNull()}).drop("kalshi", "prev_settle")


def with_fair_values(frame: DataFrame) -> DataFrame:
    """Index-only fair values; a settled row is judged on the mean that settles it."""
    frame = frame.withColumn("moneyness", F.expr(ln_ratio("brti_close", "strike")))
    frame = frame.withColumn("num", F.expr(f"CASE WHEN is_settlement THEN {ln_ratio('brti_mean', 'strike')} ELSE moneyness END"))
    h = h_eff("k")
    frame = frame.withColumns({"rw_z": F.expr(z_score("num", "sigma_1m", h)), "rw_z_rv": F.expr(z_score("num", "sigma_rv", h)), "ret_l10_std": F.expr(safe_div("brti_ret_l10", "sigma_rv")), "ret_l30_std": F.expr(safe_div("brti_ret_l30", "sigma_rv"))})
    # tails are columns first: written out in place, they are worked out anew
    frame = frame.withColumns({"tail_": F.expr(norm_tail("rw_z")), "tail_rv": F.expr(norm_tail("rw_z_rv"))})
    frame = frame.withColumns({"rw_p": F.expr(norm_of_tail("rw_z", "tail_")), "rw_p_rv": F.expr(norm_of_tail("rw_z_rv", "tail_rv"))})
    return frame.withColumn("rw_gap_rv", F.col("rw_p_rv") - F.col("mid_close")).drop("num", "tail_", "tail_rv")


def with_outcomes(b: DataFrame) -> DataFrame:
    price = F.expr("CASE WHEN is_settlement AND target_valid THEN mid_close > 0.5e0 END")
    index = F.expr("CASE WHEN is_settlement THEN brti_mean > strike END")
    first = lambda c: F.first(c, ignorenulls=True).over(_whole_window())
    b = b.withColumns({"op_": price, "ob_": index})
    return b.withColumns({"outcome_price": first("op_"), "outcome_brti": first("ob_")}).drop("op_", "ob_")


def build_frame(bars: DataFrame, candles: DataFrame, vol_lookback: int = 240, rv_lookback: int = 30) -> DataFrame:
    """The frame of complete bars. Rows go to their blocks once, with as many neighbours as every rolling
    frame and contract window needs; all windows run there."""
    bars = numbered(bars)
    back = max(vol_lookback, rv_lookback, RV_SLOW) + 1
    b = blocked(with_quotes(core(bars, candles)), back, ahead=WINDOW_MINUTES)
    b = b.join(carry_last(bars, "close", back), "block", "left")
    b = with_outcomes(with_strikes(with_moves(b, vol_lookback, rv_lookback)))
    return with_fair_values(unblocked(b))
