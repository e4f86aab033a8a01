"""Guarded arithmetic, the normal distribution and horizon helpers, as SQL text and columns.

NULL stands for every undefined value; NaN and infinities never leave an expression.
The texts are valid in any engine with DOUBLE literals written ``0.5e0``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, functions as F

DECILES = tuple(round(0.1 * k, 1) for k in range(1, 10))
Q_COLS = tuple(f"q{10 * k}" for k in range(1, 10))
FAN_Q_COLS = tuple(f"fan_q{10 * k}" for k in range(1, 10))
WINDOW_MINUTES, SETTLE_K, Z_CLIP = 15, 14, 8.0

# Hart's rational approximation of the normal tail (double precision).
_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def lit(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def _poly(coefficients, x: str) -> str:
    out = lit(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {lit(c)})"
    return out


def norm_tail(z: str) -> str:
    """Probability beyond +-``z``."""
    a = f"abs({z})"
    near = f"exp(-{a} * {a} / 2e0) * {_poly(_NUM, a)} / {_poly(_DEN, a)}"
    far = f"exp(-{a} * {a} / 2e0) / (({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0))))) * 2.506628274631e0)"
    return f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {near} ELSE {far} END)"


def norm_of_tail(z: str, tail: str) -> str:
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} > 0e0 THEN 1e0 - {tail} ELSE {tail} END)"


def norm_cdf(z: str) -> str:
    """Normal distribution function of SQL expression ``z`` (NULL stays NULL)."""
    return norm_of_tail(z, norm_tail(z))


def norm_cdf_of(z: np.ndarray) -> np.ndarray:
    """``norm_cdf`` of finite numbers, in the same steps."""
    a = np.abs(z)
    poly = lambda coefficients: reduce(lambda s, c: s * a + c, coefficients[1:], np.full_like(a, coefficients[0]))
    bell = np.exp(-a * a / 2)
    far = bell / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) * 2.506628274631)
    tail = np.where(a > 37, 0.0, np.where(a < 7.07106781186547, bell * poly(_NUM) / poly(_DEN), far))
    return np.where(z > 0, 1 - tail, tail)


def h_eff(k: str) -> str:
    """Bars of variance left until settlement, from the close of row k."""
    return f"(CASE WHEN {k} >= {SETTLE_K} THEN 1e-4 ELSE ({SETTLE_K - 1} - {k}) + 1e0 / 3e0 END)"


def safe_ln(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"


def ln_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 AND {a} > 0 THEN ln({a} / {b}) END)"


def safe_div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} <> 0 THEN {a} / {b} END)"


def z_score(num: str, sigma: str, h: str) -> str:
    """num / (sigma sqrt(h)) within +-8; a zero sigma gives the sign's limit, 0/0 NULL."""
    return (
        f"(CASE WHEN {num} IS NULL OR {sigma} IS NULL THEN NULL WHEN {sigma} = 0 THEN CASE WHEN {num} > 0 THEN 8e0 WHEN {num} < 0 THEN -8e0 END "
        f"ELSE greatest(-8e0, least(8e0, {num} / ({sigma} * sqrt({h})))) END)"
    )


def m_group(m: str) -> str:
    return f"(CASE WHEN {m} <= 4 THEN '0-4' WHEN {m} <= 9 THEN '5-9' ELSE '10-14' END)"


def persist_ref(last_mid: str, k_ctx: str) -> str:
    return f"(CASE WHEN {k_ctx} = {SETTLE_K} THEN 0.5e0 ELSE {last_mid} END)"


def price_bucket(ref: str) -> str:
    return f"CAST(least(greatest(floor(coalesce({ref}, 0.5e0) * 10e0), 0e0), 9e0) AS INT)"


def pinball(cols, y: str) -> str:
    parts = [f"greatest({lit(a)} * ({y} - {c}), {lit(round(a - 1, 1))} * ({y} - {c}))" for a, c in zip(DECILES, cols, strict=True)]
    return "((" + " + ".join(parts) + ") / 9e0)"


def decile_mean(cols) -> str:
    return "((" + " + ".join(cols) + ") / 9e0)"


def pit(q, y: str) -> str:
    """Distribution function at y: linear between sorted deciles, exponential tails with the
    slope of the outer segment; the first segment that holds y wins."""
    spread = f"greatest({q[8]} - {q[0]}, 1e-12)"
    low = f"(CASE WHEN {q[1]} - {q[0]} > 0 THEN {q[1]} - {q[0]} ELSE {spread} / 8e0 END)"
    high = f"(CASE WHEN {q[8]} - {q[7]} > 0 THEN {q[8]} - {q[7]} ELSE {spread} / 8e0 END)"
    out = f"CASE WHEN {y} < {q[0]} THEN 0.1e0 * exp(({y} - {q[0]}) / {low}) WHEN {y} > {q[8]} THEN 1e0 - 0.1e0 * exp(-({y} - {q[8]}) / {high})"
    for k in range(8):
        a, b = q[k], q[k + 1]
        out += f" WHEN {y} >= {a} AND {y} <= {b} THEN {lit((k + 1) / 10)} + 0.1e0 * (CASE WHEN {b} > {a} THEN ({y} - {a}) / ({b} - {a}) ELSE 0e0 END)"
    return f"greatest(0e0, least(1e0, {out} END))"


def clip(x: str, low: float, high: float) -> str:
    return f"greatest({lit(low)}, least({lit(high)}, {x}))"


def skill(score: str, ref: str) -> str:
    return f"(CASE WHEN {ref} > 0 THEN 1e0 - {score} / {ref} END)"


def nudge(places: int) -> float:
    """A thousandth of the last place: results that lie exactly between two roundings (means over
    a price grid often do) go up whatever the last bit of their sum is."""
    return 1.3 * 10.0 ** -(places + 3)


def rounded(df, columns: dict[str, int | None]):
    """The named columns, doubles rounded to the given places (None: as they are)."""
    out: list[Column] = []
    for c, places in columns.items():
        out.append(F.col(c) if places is None else (F.round(F.col(c) + F.lit(nudge(places)), places) + F.lit(0.0)).alias(c))
    return df.select(*out)
