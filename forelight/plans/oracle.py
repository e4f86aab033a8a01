"""The catalogue's queries as plain SQL: one chain of named steps from ``events`` to scores.

Written for a single-node engine, without blocks, halos or bins, so that it checks the
distributed plans by a different route. Only scalar formulas are shared with them.
"""

from __future__ import annotations

from ..functions.mathx import DECILES, FAN_Q_COLS, Q_COLS, clip, decile_mean, h_eff, ln_ratio, m_group, norm_cdf, nudge, persist_ref, pinball, pit, price_bucket, safe_div, safe_ln, skill, z_score
from ..operators.baselines import DQ, fair_now
from ..operators.covariates import PAST, PRESETS, calendar_exprs, jitter
from ..operators.metrics import _BASE, _FINAL, METRIC_COLUMNS, SOURCES, cal_bin, CAL_EDGES, EPS
from ..operators.signals import FEE, RAW_FAIR, RECALIBRATIONS, RIDGE, SIGMAS, logit_line

INTS = set("k hour minute_of_day m n_steps k_ctx h bucket vol_bucket bin pos step".split())
ZERO = "TIMESTAMP '2024-01-01 00:00:00'"


def final(source: str, columns: dict[str, int | None], tail: str = "") -> str:
    out = []
    for c, places in columns.items():
        if places is not None:
            out.append(f"CAST(round({c} + {nudge(places)!r}, {places}) AS DOUBLE) + 0e0 AS {c}")
        else:
            out.append(f"CAST({c} AS INTEGER) AS {c}" if c in INTS else c)
    return f"SELECT {', '.join(out)} FROM {source} {tail}"


def ticks(loud: bool = False) -> list[str]:
    steps = [
        "ev AS (SELECT event_id, value, (SELECT count(*) FROM events) AS n FROM events)",
        "tk AS (SELECT event_id + g * n AS s, 100000e0 + value AS value FROM ev, range(8) r(g))",
        "ticks AS (SELECT s, value FROM tk WHERE s % 10007 < 600 OR s % 10007 > 690)",
    ]
    return steps


def bars(s: int, loud: bool = False, native: bool = False) -> list[str]:
    here = f"""
  SELECT *, ln(value) AS lv, s % {s} AS off, s - s % {s} AS b, s - lag(s) OVER (PARTITION BY s // 86400 ORDER BY s) AS dt,
         ln(value) - lag(ln(value)) OVER (PARTITION BY s // 86400 ORDER BY s) AS dl FROM ticks"""

    def tail(n: int) -> str:
        mark = s - 1 - n
        return f"CASE WHEN max(off) >= {s - 5} THEN arg_max(lv, s) - arg_max(lv, s) FILTER (WHERE off <= {mark} AND off > {mark - 5}) END"

    raw = "2 * count(*)" if loud else "count(*)"
    return [
        *ticks(),
        f"t AS ({here})",
        f"""agg AS (SELECT b, arg_min(value, s) AS open, max(value) AS high, min(value) AS low, arg_max(value, s) AS close, avg(value) AS mean, stddev_pop(value) AS std,
  CASE WHEN count(r) >= {max(s // 2, 1)} THEN sum(r * r) * {s} / count(r) END AS rv_1s, {tail(10)} AS ret_l10, {tail(30)} AS ret_l30, count(*) AS n_ticks, {raw} AS n_raw_ticks
  FROM (SELECT *, CASE WHEN dt <= 60 THEN dl END AS r FROM t) GROUP BY b)""",
        f"""bars AS (SELECT {ZERO} + to_seconds(g) AS ts, g, open, high, low, close, mean, std, rv_1s, ret_l10, ret_l30, coalesce(n_ticks, 0) AS n_ticks, coalesce(n_raw_ticks, 0) AS n_raw_ticks,
  coalesce(n_ticks, 0) = 0 AS is_gap, coalesce(n_ticks, 0) = {s} AS is_full
  FROM (SELECT unnest(range((SELECT min(b) FROM agg), (SELECT max(b) FROM agg) + 1, {s})) AS g) LEFT JOIN agg ON g = b)""",
    ]


NATIVE_15M = [
    "t AS (SELECT ts, value, time_bucket(INTERVAL 15 MINUTE, ts) AS b, ln(CASE WHEN value > 0 THEN value END) AS lv, (epoch_us(ts) // 1000000) AS sec, CAST(ts AS DATE) AS d FROM events)",
    "u AS (SELECT *, sec - lag(sec) OVER w AS dt, lv - lag(lv) OVER w AS dl FROM t WINDOW w AS (PARTITION BY d ORDER BY ts))",
    "agg AS (SELECT b, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n_ticks FROM u GROUP BY b)",
    "bars AS (SELECT g AS ts, open, high, low, close, mean, std, coalesce(n_ticks, 0) AS n_ticks, coalesce(n_ticks, 0) = 0 AS is_gap FROM (SELECT unnest(generate_series((SELECT min(b) FROM agg), (SELECT max(b) FROM agg), INTERVAL 15 MINUTE)) AS g) LEFT JOIN agg ON g = b)",
]


def candles(shift: int = 0) -> list[str]:
    move = {"open": -0.001, "high": 0.002, "low": -0.002, "close": 0.0}
    quotes = ", ".join(f"{side} + {d!r}e0 AS yes_{side}_{n}" for side in ("bid", "ask") for n, d in move.items())
    trades = ", ".join(f"CASE WHEN NOT idle THEN mid + {d!r}e0 END AS trade_{n}" for n, d in (*move.items(), ("mean", 0.0)))
    return [
        "cb AS (SELECT g, mean, n_ticks, is_gap, g // 900 AS w, (g // 60) % 15 AS k, lag(mean) OVER (ORDER BY g) AS before FROM bars)",
        "cs AS (SELECT *, max(CASE WHEN k = 0 THEN before END) OVER (PARTITION BY w) AS strike FROM cb)",
        """cm AS (SELECT *, CASE WHEN k = 14 THEN CASE WHEN mean > strike THEN 0.999e0 ELSE 0.001e0 END ELSE greatest(0.02e0, least(0.98e0, round((mean - 100030e0) / 40e0, 3))) END AS mid,
  w % 13 = 5 AND k < 14 AS wide, (w * 15 + k) % 20 = 0 AS idle FROM cs WHERE NOT is_gap AND NOT (w % 17 = 4 AND k IN (3, 4)) AND NOT (w % 19 = 6 AND k = 14))""",
        """cq AS (SELECT *, CASE WHEN wide THEN 0.4e0 WHEN k = 14 THEN greatest(0e0, mid - 0.001e0) ELSE mid - 0.005e0 END AS bid,
  CASE WHEN wide THEN 1e0 WHEN k = 14 THEN least(1e0, mid + 0.001e0) ELSE mid + 0.005e0 END AS ask FROM cm)""",
        f"""candles AS (SELECT g + {60 * shift} AS cg, 'W' || w AS ticker, CASE WHEN w % 11 <> 3 THEN strike END AS floor_strike, {quotes}, {trades},
  CASE WHEN idle THEN 0e0 ELSE CAST(n_ticks * (w % 7 + 1) AS DOUBLE) END AS volume, CAST(1000 + n_ticks AS DOUBLE) AS open_interest FROM cq)""",
    ]


def frame(vol: int = 60, rv: int = 30, shift: int = 0) -> list[str]:
    def roll(agg: str, c: str, n: int, least: int) -> str:
        over = f"OVER (ORDER BY g ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN count({c}) {over} >= {least} THEN {agg}({c}) {over} END"

    h = h_eff("k")
    return [
        *bars(60),
        *candles(shift),
        """f1 AS (SELECT g, ts, g // 60 - (SELECT min(g) // 60 FROM bars) AS idx, ZERO_ + to_seconds(g // 900 * 900) AS t0, g // 900 AS w, (g // 60) % 15 AS k, CAST(ts AS DATE) AS date, extract(hour FROM ts) AS hour,
  (g // 60) % 1440 AS minute_of_day, open AS brti_open, high AS brti_high, low AS brti_low, close AS brti_close, mean AS brti_mean, std AS brti_std, rv_1s AS brti_rv_1s, ret_l10 AS brti_ret_l10, ret_l30 AS brti_ret_l30, n_ticks, n_raw_ticks, is_gap AS brti_is_gap, is_full AS brti_is_full,
  c.*, ticker IS NOT NULL AS has_candle, lag(mean) OVER (ORDER BY g) AS prev_mean FROM bars LEFT JOIN candles c ON g = cg)""".replace("ZERO_", ZERO),
        """f2 AS (SELECT *, first_value(floor_strike IGNORE NULLS) OVER w_ AS kalshi, first_value(CASE WHEN k = 0 THEN prev_mean END IGNORE NULLS) OVER w_ AS strike_from_brti, first_value(ticker IGNORE NULLS) OVER w_ AS win_ticker
  FROM f1 WINDOW w_ AS (PARTITION BY w ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
        "f3 AS (SELECT *, coalesce(kalshi, strike_from_brti) AS strike, kalshi IS NULL AND strike_from_brti IS NOT NULL AS strike_imputed FROM f2)",
        f"""f4 AS (SELECT *, (yes_bid_close + yes_ask_close) / 2e0 AS mid_close, (yes_bid_open + yes_ask_open) / 2e0 AS mid_open, (yes_bid_high + yes_ask_high) / 2e0 AS mid_high, (yes_bid_low + yes_ask_low) / 2e0 AS mid_low,
  yes_ask_close - yes_bid_close AS spread, {ln_ratio("brti_close", "strike")} AS moneyness, ln(1e0 + volume) AS log_volume, ln(1e0 + open_interest) AS log_oi,
  {safe_ln("last_value(brti_close IGNORE NULLS) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS lfill FROM f3)""",
        "f5 AS (SELECT *, lfill - lag(lfill) OVER (ORDER BY g) AS ret_1m, CASE WHEN k > 0 THEN mid_close - lag(mid_close) OVER (ORDER BY g) END AS mid_ret_1m FROM f4)",
        f"""f6 AS (SELECT *, {roll("stddev_samp", "ret_1m", vol, max(10, vol // 4))} AS sigma_1m, sqrt({roll("avg", "brti_rv_1s", rv, max(rv // 2, 1))}) AS sigma_rv,
  sqrt({roll("avg", "brti_rv_1s", 15, 7)}) AS rv_fast, sqrt({roll("avg", "brti_rv_1s", 240, 120)}) AS rv_slow FROM f5)""",
        f"""f7 AS (SELECT *, {ln_ratio("rv_fast", "rv_slow")} AS vol_ratio, coalesce(trade_close, mid_close) AS trade_close_imp, coalesce(trade_mean, mid_close) AS trade_mean_imp,
  has_candle AND yes_bid_close IS NOT NULL AND yes_ask_close IS NOT NULL AS target_valid, k = 14 AS is_settlement FROM f6)""",
        f"f8 AS (SELECT *, target_valid AND spread <= 0.1e0 AS quote_ok, CASE WHEN is_settlement THEN {ln_ratio('brti_mean', 'strike')} ELSE moneyness END AS num FROM f7)",
        f"f9 AS (SELECT *, {z_score('num', 'sigma_1m', h)} AS rw_z, {z_score('num', 'sigma_rv', h)} AS rw_z_rv, {safe_div('brti_ret_l10', 'sigma_rv')} AS ret_l10_std, {safe_div('brti_ret_l30', 'sigma_rv')} AS ret_l30_std FROM f8)",
        f"fa AS (SELECT *, {norm_cdf('rw_z')} AS rw_p, {norm_cdf('rw_z_rv')} AS rw_p_rv FROM f9)",
        """frame AS (SELECT *, rw_p_rv - mid_close AS rw_gap_rv, first_value(CASE WHEN is_settlement AND target_valid THEN mid_close > 0.5e0 END IGNORE NULLS) OVER w_ AS outcome_price,
  first_value(CASE WHEN is_settlement THEN brti_mean > strike END IGNORE NULLS) OVER w_ AS outcome_brti FROM fa WINDOW w_ AS (PARTITION BY w ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
    ]


def origins(context: int = 32, frac: float = 0.1, quote: bool = False) -> list[str]:
    c = context
    return [
        *frame(),
        f"""o1 AS (SELECT *, (k + 1) % 15 AS m, 15 - (k + 1) % 15 AS n_steps, sum(CASE WHEN target_valid THEN 0 ELSE 1 END) OVER (ORDER BY g ROWS BETWEEN {c - 1} PRECEDING AND CURRENT ROW) AS n_ctx_gaps,
  lag(target_valid, {c - 1}) OVER (ORDER BY g) AS first_valid, sum(CASE WHEN target_valid THEN 1 ELSE 0 END) OVER (ORDER BY g) AS cum FROM frame)""",
        f"""o2 AS (SELECT a.idx AS i, a.m, a.n_steps, a.k AS k_ctx, a.n_ctx_gaps, CASE WHEN a.m = 0 THEN a.brti_mean ELSE a.strike END AS strike, a.ts + INTERVAL 1 MINUTE AS origin_ts, a.mid_close AS last_mid, a.yes_bid_close AS last_bid,
  a.yes_ask_close AS last_ask, a.spread AS last_spread, a.brti_close, a.sigma_1m, coalesce(a.quote_ok, false) AS quote_ok, a.target_valid, a.first_valid,
  coalesce(b.cum, (SELECT max(cum) FROM o1)) - a.cum AS n_valid, (SELECT max(idx) FROM o1) AS last_idx FROM o1 a LEFT JOIN o1 b ON b.idx = a.idx + a.n_steps)""",
        f"""o3 AS (SELECT *, CASE WHEN i < {c - 1} THEN 'insufficient_history' WHEN i + n_steps > last_idx THEN 'horizon_beyond_data' WHEN NOT target_valid THEN 'no_contract' WHEN NOT first_valid THEN 'ctx_start_gap'
  WHEN n_ctx_gaps > {frac!r}e0 * {c} THEN 'ctx_gaps' WHEN sigma_1m IS NULL OR NOT sigma_1m > 0 THEN 'no_sigma' WHEN strike IS NULL THEN 'no_strike' WHEN n_valid = 0 THEN 'no_valid_step' {"WHEN NOT quote_ok THEN 'degenerate_quote'" if quote else ""} END AS drop_reason FROM o2)""",
        "origins AS (SELECT *, drop_reason IS NULL AS ok, time_bucket(INTERVAL 15 MINUTE, origin_ts) AS t0, CAST(time_bucket(INTERVAL 15 MINUTE, origin_ts) AS DATE) AS date, extract(hour FROM time_bucket(INTERVAL 15 MINUTE, origin_ts)) AS hour FROM o3)",
    ]


def fan(hi: str | None = None, strict: bool = False) -> list[str]:
    """After frame(); targets and starts before ``hi`` where given."""
    until = f"AND a.ts < TIMESTAMP '{hi}'" if hi else ""
    until += f" AND b.ts < TIMESTAMP '{hi}'" if hi and strict else ""
    q = ", ".join(f"quantile_cont(d, {x!r}e0) AS {c}" for x, c in zip(DECILES, DQ, strict=True))
    return [
        f"d0 AS (SELECT a.k AS k_ctx, b.idx - a.idx AS h, {persist_ref('a.mid_close', 'a.k')} AS ref, b.mid_close AS then_mid FROM frame a JOIN frame b ON b.idx - a.idx BETWEEN 1 AND 15 WHERE b.idx - a.idx <= 15 - (a.k + 1) % 15 AND b.mid_close IS NOT NULL {until})",
        f"d1 AS (SELECT k_ctx, h, {price_bucket('ref')} AS bucket, then_mid - ref AS d FROM d0 WHERE ref IS NOT NULL)",
        f"fan AS (SELECT k_ctx, h, bucket, count(*) AS n, {q} FROM d1 GROUP BY ALL UNION ALL SELECT k_ctx, h, -1 AS bucket, count(*) AS n, {q} FROM d1 GROUP BY k_ctx, h)",
    ]


def forecasts() -> list[str]:
    mid = "(o.last_mid + 0.001e0 * h)"
    qs = ", ".join(f"greatest(0e0, least(1e0, {mid} + 0.01e0 * {j - 4})) AS {c}" for j, c in enumerate(Q_COLS))
    sort = ", ".join(f"f_[{j + 1}] AS {c}" for j, c in enumerate(FAN_Q_COLS))
    cells = ", ".join(f"greatest(0e0, least(1e0, a.persist + coalesce(l.{c}, p.{c}, 0e0)))" for c in DQ)
    return [
        *origins(),
        f"longf AS (SELECT o.i, h, o.m + h - 1 AS k, greatest(0e0, least(1e0, {mid})) AS median, {qs}, f.mid_close AS actual FROM (SELECT *, unnest(range(1, n_steps + 1)) AS h FROM origins WHERE ok) o JOIN frame f ON f.idx = o.i + h WHERE f.target_valid)",
        *fan(),
        "wins AS (SELECT t0, arg_min(outcome_price, ts) AS outcome_price, arg_min(outcome_brti, ts) AS outcome_brti, arg_min(win_ticker, ts) AS ticker, arg_min(strike_imputed, ts) AS strike_imputed FROM frame GROUP BY t0)",
        f"""a0 AS (SELECT l.*, o.* EXCLUDE (i), w.* EXCLUDE (t0), l.k = 14 AS is_settlement, {m_group("o.m")} AS m_group, {fair_now("o.brti_close", "o.strike", "o.sigma_1m", "o.m")} AS rw_p, {decile_mean(Q_COLS)} AS mean_fc,
  {persist_ref("o.last_mid", "o.k_ctx")} AS persist FROM longf l JOIN origins o ON o.i = l.i LEFT JOIN wins w ON w.t0 = o.t0 WHERE o.ok)""",
        "cuts AS (SELECT quantile_cont(sigma_1m, 1e0 / 3e0) AS c1, quantile_cont(sigma_1m, 2e0 / 3e0) AS c2 FROM a0)",
        f"a1 AS (SELECT *, CASE WHEN sigma_1m <= c1 THEN 0 WHEN sigma_1m <= c2 THEN 1 ELSE 2 END AS vol_bucket, {price_bucket('persist')} AS level_ FROM a0, cuts)",
        f"a2 AS (SELECT a.*, list_sort([{cells}]) AS f_ FROM a1 a LEFT JOIN (SELECT * FROM fan WHERE n >= 30 AND bucket <> -1) l ON l.k_ctx = a.k_ctx AND l.h = a.h AND l.bucket = a.level_ LEFT JOIN (SELECT * FROM fan WHERE n >= 30 AND bucket = -1) p ON p.k_ctx = a.k_ctx AND p.h = a.h)",
        f"fc AS (SELECT *, {sort} FROM a2)",
    ]


def scored() -> list[str]:
    ll = lambda p: f"-(o * ln({clip(p, EPS, 1 - EPS)}) + (1e0 - o) * ln(1e0 - {clip(p, EPS, 1 - EPS)}))"
    br = lambda p: f"power({clip(p, EPS, 1 - EPS)} - o, 2)"
    return [
        *forecasts(),
        "s0 AS (SELECT *, CASE WHEN is_settlement AND outcome_price IS NOT NULL THEN CASE WHEN outcome_price THEN 1e0 ELSE 0e0 END END AS o FROM fc)",
        f"""sc AS (SELECT *, power(mean_fc - actual, 2) AS se, power(persist - actual, 2) AS se_p, power(rw_p - actual, 2) AS se_rw, abs(median - actual) AS ae, abs(fan_q50 - actual) AS ae_p, {pinball(Q_COLS, "actual")} AS pb, {pinball(FAN_Q_COLS, "actual")} AS pb_f,
  {pit(Q_COLS, "actual")} AS u, abs(mean_fc - persist) > 1e-9 AND abs(actual - persist) > 1e-9 AS moves, sign(mean_fc - persist) = sign(actual - persist) AS right_way,
  {br("mean_fc")} AS br, {br("persist")} AS br_p, {br("rw_p")} AS br_rw, {ll("mean_fc")} AS ll, {ll("persist")} AS ll_p FROM s0)""",
    ]


def calibration(p: str, by: str = "", name: str = "cal", source: str = "sc") -> list[str]:
    low = "[" + ", ".join(f"{x!r}e0" for x in CAL_EDGES[:-1]) + "]"
    high = "[" + ", ".join(f"{min(x, 1.0)!r}e0" for x in CAL_EDGES[1:]) + "]"
    key = f"{by}, " if by else ""
    return [
        f"{name}_b AS (SELECT {key}{cal_bin(p)} AS bin, {p} AS p, o FROM {source} WHERE o IS NOT NULL)",
        f"{name} AS (SELECT {key}{low}[bin + 1] AS bin_lo, {high}[bin + 1] AS bin_hi, count(*) AS n, avg(p) AS p_mean, avg(o) AS freq_up, avg(o) - avg(p) AS gap, sqrt(greatest(avg(o) * (1e0 - avg(o)), 1e-12) / count(*)) AS se FROM {name}_b WHERE bin IS NOT NULL GROUP BY {key}bin)",
    ]


def metrics(by: str = "", where: str = "true") -> list[str]:
    key = by or "zero"
    base = ", ".join(f"{e.replace('count_if(moves)', 'count(*) FILTER (WHERE moves)')} AS {c}" for c, e in _BASE.items())
    fin = ", ".join(f"{e} AS {c}" for c, e in _FINAL.items())
    keys = key.split(", ")
    on = lambda a: " AND ".join(f"m0.{k} IS NOT DISTINCT FROM {a}.{k}" for k in keys)
    rest = ", ".join(f"m0.{c}" if c in _BASE else c for c in METRIC_COLUMNS if c not in ("pit_ks", "settle_ece"))
    return [
        *scored(),
        f"sg AS (SELECT *, 0 AS zero FROM sc WHERE {where})",
        f"m_ AS (SELECT {key}, {base} FROM sg GROUP BY {key})",
        f"m0 AS (SELECT *, {fin} FROM m_)",
        f"kr AS (SELECT {key}, u, row_number() OVER (PARTITION BY {key} ORDER BY u) AS r, count(*) OVER (PARTITION BY {key}) AS t FROM sg)",
        f"ks AS (SELECT {key}, max(greatest(r / t - u, u - (r - 1) / t)) AS pit_ks FROM kr GROUP BY {key})",
        *calibration(clip("mean_fc", EPS, 1 - EPS), key, "cal", "sg"),
        f"ec AS (SELECT {key}, sum(n * abs(gap)) / sum(n) AS settle_ece FROM cal GROUP BY {key})",
        f"mm AS (SELECT {'' if not by else ', '.join('m0.' + k for k in keys) + ', '}{rest}, pit_ks, settle_ece FROM m0 LEFT JOIN ks ON {on('ks')} LEFT JOIN ec ON {on('ec')})",
    ]


def signals(val_start: str, test_start: str) -> list[str]:
    def past(n: int) -> str:
        over = f"OVER (ORDER BY g ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN count(brti_rv_1s) {over} >= {n // 2} THEN sqrt(avg(brti_rv_1s) {over}) END AS sig_rv{n}"

    def ahead(c: str, name: str) -> str:
        over = "OVER (ORDER BY g ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"
        return f"CASE WHEN count({c}) {over} = 10 THEN avg({c}) {over} END AS {name}"

    moves = []
    for h in (1, 2, 3, 5, 8):
        ok = f"lead(quote_ok, {h}) OVER t_ AND k + {h} <= 13"
        moves += [f"CASE WHEN {ok} THEN lead(mid_close, {h}) OVER t_ - mid_close END AS d{h}", f"CASE WHEN {ok} THEN lead(yes_bid_close, {h}) OVER t_ END AS bid{h}", f"CASE WHEN {ok} THEN lead(yes_ask_close, {h}) OVER t_ END AS ask{h}"]
    names = {"old": "sigma_1m", "rv15": "sig_rv15", "rv60": "sig_rv60", "rv240": "sig_rv240"}
    return [
        *frame(),
        "g0 AS (SELECT *, power(ret_1m, 2) AS r2_1m FROM frame)",
        f"g1 AS (SELECT *, {', '.join(past(n) for n in (15, 30, 60, 240))}, {ahead('brti_rv_1s', 'fut_rv')}, {ahead('r2_1m', 'fut_r2')} FROM g0)",
        f"g2 AS (SELECT *, {', '.join(moves)} FROM g1 WINDOW t_ AS (PARTITION BY w ORDER BY k))",
        "g3 AS (SELECT *, " + ", ".join(f"{z_score('moneyness', s, h_eff('k'))} AS z_{n}" for n, s in names.items()) + " FROM g2)",
        "g4 AS (SELECT *, " + ", ".join(f"{norm_cdf(f'z_{n}')} AS p_{n}" for n in names) + " FROM g3)",
        "sig AS (SELECT *, " + ", ".join(f"p_{n} - mid_close AS gap_{n}" for n in names) + f", CASE WHEN ts < TIMESTAMP '{val_start}' THEN 'train' WHEN ts < TIMESTAMP '{test_start}' THEN 'val' ELSE 'test' END AS split FROM g4)",
    ]


def vol_quality() -> str:
    parts = []
    for s in SIGMAS:
        parts.append(f"""SELECT split, corr(ln(s2), ln(a)) AS corr_log, avg(a / (s2 * ma / ms) - ln(a / (s2 * ma / ms)) - 1e0) AS qlike_rv, avg(b / (s2 * mb / ms) - ln(b / (s2 * mb / ms)) - 1e0) AS qlike_r2, count(*) AS n, '{s}' AS sigma
  FROM (SELECT *, avg(s2) OVER p AS ms, avg(a) OVER p AS ma, avg(b) OVER p AS mb FROM (SELECT split, power({s}, 2) AS s2, fut_rv AS a, fut_r2 AS b FROM sig WHERE {s} > 0 AND fut_rv > 0 AND fut_r2 > 0) WINDOW p AS (PARTITION BY split)) GROUP BY split""")
    return " UNION ALL ".join(parts)


def ols() -> str:
    parts = []
    for h in (1, 2, 3, 5, 8):
        for g in ("gap_old", "gap_rv60", "gap_rv15"):
            d = f"(SELECT split, d{h} AS y, {g} AS x FROM sig WHERE quote_ok AND k <= 12 AND gap_old IS NOT NULL AND gap_rv60 IS NOT NULL AND d{h} IS NOT NULL AND {g} IS NOT NULL)"
            parts.append(f"SELECT {h} AS h, '{g}' AS gap, split, any_value(slope) AS slope, 1e0 - sum(power(y - (base + slope * x), 2)) / sum(power(y, 2)) AS skill, count(*) AS n FROM {d}, (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM {d} WHERE split = 'train') WHERE split <> 'train' GROUP BY split")
    return " UNION ALL ".join(parts)


def ols_days() -> str:
    parts = []
    for h in (1, 2, 3, 5, 8):
        for g in ("gap_old", "gap_rv60", "gap_rv15"):
            d = f"(SELECT split, date, d{h} AS y, {g} AS x FROM sig WHERE quote_ok AND k <= 12 AND gap_old IS NOT NULL AND gap_rv60 IS NOT NULL AND d{h} IS NOT NULL AND {g} IS NOT NULL)"
            parts.append(f"SELECT {h} AS h, '{g}' AS gap, split, date, count(*) AS n, sum(power(y - (base + slope * x), 2)) AS se, sum(power(y, 2)) AS se_0 FROM {d}, (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM {d} WHERE split = 'train') WHERE split <> 'train' GROUP BY split, date")
    return " UNION ALL ".join(parts)


def trade_days() -> str:
    out = trades().replace("(SELECT split, sign", "(SELECT split, date, sign").replace("GROUP BY split", "GROUP BY split, date")
    mean = out[out.index("100e0 * avg(net - ") : out.index(" AS pnl_c")]
    first = out.index("count(*) AS trades")
    head, tail = out[first : out.index(" AS hit") + len(" AS hit")], f"date, CAST(count(*) AS DOUBLE) AS trades, {mean.replace('100e0 * avg(', 'sum(')} AS pnl"
    return out.replace(head, tail)


def trades() -> str:
    parts = []
    for h in (1, 2, 3, 5, 8):
        for thr in (0.01, 0.02):
            parts.append(f"""SELECT {h} AS h, {thr!r}e0 AS threshold, split, count(*) AS trades, 100e0 * avg(gross) AS gross_c, 100e0 * avg(net) AS net_c, 100e0 * avg(net - {FEE!r}e0 * (p_in * (1e0 - p_in) + p_out * (1e0 - p_out))) AS pnl_c, avg(CASE WHEN gross > 0 THEN 1e0 ELSE 0e0 END) AS hit
  FROM (SELECT split, sign(gap_rv60) * d{h} AS gross, CASE WHEN gap_rv60 > 0 THEN bid{h} - yes_ask_close ELSE yes_bid_close - ask{h} END AS net, CASE WHEN gap_rv60 > 0 THEN yes_ask_close ELSE yes_bid_close END AS p_in, CASE WHEN gap_rv60 > 0 THEN bid{h} ELSE ask{h} END AS p_out
        FROM sig WHERE quote_ok AND k <= 12 AND d{h} IS NOT NULL AND abs(gap_rv60) > {thr!r}e0) GROUP BY split""")
    return " UNION ALL ".join(parts)


def recalibration(steps: int = 9) -> list[str]:
    """After signals(): ``rcd`` (features, split, p, y, mid_close). Newton steps as queries: sums, then the
    linear system solved column by column, from weights of 0 on."""
    p = "greatest(1e-4, least(1e0 - 1e-4, mid_close))"
    out = [
        f"""rc AS MATERIALIZED (SELECT split, date, mid_close, ln({p} / (1e0 - {p})) AS lg, CASE WHEN outcome_brti THEN 1e0 ELSE 0e0 END AS y, z_old, z_rv15, z_rv60, z_rv240, p_old, p_rv60, p_rv15 FROM sig
  WHERE quote_ok AND k <= 13 AND outcome_brti IS NOT NULL AND z_old IS NOT NULL AND z_rv15 IS NOT NULL AND z_rv60 IS NOT NULL AND z_rv240 IS NOT NULL)""",
    ]
    for s, c in RECALIBRATIONS.items():
        x, n = ("1e0", *c), 1 + len(c)
        w = ", ".join(f"w{i}" for i in range(n))
        out.append(f"{s}_0 AS (SELECT {', '.join(f'0e0 AS w{i}' for i in range(n))})")
        for t in range(1, steps + 1):
            cells = [f"sum(p * (1e0 - p) * {x[i]} * {x[j]}) + {RIDGE if i == j and i else 0.0!r}e0 AS a{i}_{j}" for i in range(n) for j in range(n)]
            cells += [f"sum((p - y) * {x[i]}) + {RIDGE if i else 0.0!r}e0 * any_value(w{i}) AS b{i}" for i in range(n)]
            sql = f"SELECT {', '.join(f'any_value(w{i}) AS w{i}' for i in range(n))}, {', '.join(cells)} FROM (SELECT *, {logit_line([f'w{i}' for i in range(n)], c)} AS p FROM rc, {s}_{t - 1} WHERE split = 'train')"
            for k in range(n):  # the k-th unknown leaves all other equations
                new = [f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" if i != k else f"a{i}_{j}" for i in range(n) for j in range(n)]
                new += [f"b{i} - a{i}_{k} / a{k}_{k} * b{k} AS b{i}" if i != k else f"b{i}" for i in range(n)]
                sql = f"SELECT {w}, {', '.join(new)} FROM ({sql})"
            out.append(f"{s}_{t} AS MATERIALIZED (SELECT {', '.join(f'w{i} - b{i} / a{i}_{i} AS w{i}' for i in range(n))} FROM ({sql}))")
    parts = [f"SELECT '{s}' AS features, split, date, {c} AS p, y, mid_close FROM rc" for s, c in RAW_FAIR.items()]
    parts += [f"SELECT '{s}' AS features, split, date, {logit_line([f'w{i}' for i in range(1 + len(c))], c)} AS p, y, mid_close FROM rc, {s}_{steps}" for s, c in RECALIBRATIONS.items()]
    return [*out, "rcd AS (" + " UNION ALL ".join(parts) + ")"]


def past_covariates(name: str) -> str:
    past, _ = PRESETS[name]
    return ", ".join(f"coalesce({e}, 0e0) AS {c}" if fill == "zero" else f"{e} AS {c}" for c in past for e, fill in [PAST[c]])


def calendar() -> str:
    return ", ".join(f"{e} AS {c}" for c, e in calendar_exprs().items())


def tensor_cells(context: int = 32, name: str = "full", horizon: int = 64) -> list[str]:
    """After origins(): ``cells`` (i, name, pos, x float, flat) of every origin's tensors."""
    past, future = PRESETS[name]
    patch, end = 32, context - 1
    raws = {"target": "CASE WHEN target_valid THEN mid_close END", **{c: f"coalesce({e}, 0e0)" if fill == "zero" else e for c in past for e, fill in [PAST[c]]}, "rw_fair_path": "rw_p"}
    z = f"(CASE WHEN sigma_1m > 0 AND brti_close > 0 AND strike > 0 THEN greatest(-8e0, least(8e0, ln(brti_close / strike) / (sigma_1m * sqrt({h_eff('kf')})))) ELSE 0e0 END)"
    turns = calendar_exprs("kk", "mm")
    noise = ", ".join(f"{float(x)!r}::FLOAT" for x in jitter(context + horizon))
    return [
        "tn AS (SELECT o.i, o.n_steps, o.k_ctx, o.brti_close, o.strike, o.sigma_1m, f.minute_of_day FROM origins o JOIN frame f ON f.idx = o.i WHERE o.ok)",
        f"tc AS (SELECT o.i, f.idx - o.i + {end} AS pos, {', '.join(f'{e} AS c_{c}' for c, e in raws.items())} FROM (SELECT i FROM tn) o JOIN frame f ON f.idx BETWEEN o.i - {end} AND o.i)",
        "tu AS (" + " UNION ALL ".join(f"SELECT i, '{c}' AS name, pos, CAST(c_{c} AS DOUBLE) AS raw FROM tc" for c in raws) + ")",
        """tw AS (SELECT *, last_value(CASE WHEN raw IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, last_value(raw IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN raw IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1, first_value(raw IGNORE NULLS) OVER f AS v1
  FROM tu WINDOW b AS (PARTITION BY i, name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY i, name ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        "ti AS (SELECT i, name, pos, CASE WHEN raw IS NOT NULL THEN raw WHEN p0 IS NULL AND p1 IS NULL THEN 0e0 WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ((pos - p0) / (p1 - p0)) END AS value FROM tw)",
        f"ts0 AS (SELECT *, (k_ctx + pos - {end} + {15 * context}) % 15 AS kk, (minute_of_day + pos - {end} + {1440 * context}) % 1440 AS mm, (k_ctx + least(pos - {end}, n_steps)) % 15 AS kf FROM tn, range({context + horizon}) q(pos))",
        f"tf AS (SELECT i, pos, {norm_cdf(z)} AS value FROM ts0 WHERE pos > {end})",
        "ta AS (SELECT * FROM ti UNION ALL SELECT i, 'rw_fair_path' AS name, pos, value FROM tf UNION ALL " + " UNION ALL ".join(f"SELECT i, '{c}' AS name, pos, {e} AS value FROM ts0" for c, e in turns.items() if c in future) + ")",
        f"tb AS (SELECT i, name, pos, CAST(value AS FLOAT) AS v, pos // {patch} AS block FROM ta)",
        "tg AS (SELECT i, name, block, min(v) = max(v) AS flat FROM tb GROUP BY ALL)",
        f"cells AS (SELECT i, name, pos, flat, block, CASE WHEN flat THEN CAST(v + [{noise}][pos + 1] AS FLOAT) ELSE v END AS x FROM tb JOIN tg USING (i, name, block))",
        "cell_sums AS (SELECT i, name, sum(CAST(x AS DOUBLE)) AS total, count(DISTINCT CASE WHEN flat THEN block END) AS flats FROM cells GROUP BY i, name)",
    ]


def chain(steps: list[str], select: str) -> str:
    return "WITH " + ",\n".join(steps) + "\n" + select


__all__ = ["SOURCES", "chain", "skill"]
