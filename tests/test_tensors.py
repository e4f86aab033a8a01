"""Tensors and the forecaster that reads them, against windows built one by one."""

import math

import numpy as np
import pyarrow as pa
import pytest

from forelight.operators import covariates, forecast
from forelight.functions.mathx import Q_COLS


def series(rng, n):
    rows = {"idx": np.arange(n) + 700, "k": (np.arange(n) + 5) % 15, "minute_of_day": (np.arange(n) + 1200) % 1440}
    gaps = lambda share: np.where(rng.random(n) < share, np.nan, rng.normal(size=n))
    rows["target"], rows["fair_"] = gaps(0.3), gaps(0.1)
    for c in covariates.PRESETS["full"][0]:
        rows[f"past_{c}"] = gaps(rng.choice([0.0, 0.4, 0.97]))
    rows["past_rw_z"][:400] = 2.5  # flat patches
    return rows


def as_table(rows, origins, halo):
    n = len(rows["idx"])
    m = (rows["k"] + 1) % 15
    steps = [15 - int(m[r]) if r in origins else None for r in range(n)]
    paths = [[0.01 * (r % 50) + 0.02 * s for s in range(1, 16)] if r in origins else None for r in range(n)]
    columns = {c: pa.array(v, from_pandas=True) for c, v in rows.items()} | {"m": pa.array([int(m[r]) if r in origins else None for r in range(n)]), "n_steps": pa.array(steps), "path": pa.array(paths, pa.list_(pa.float64())), "halo": pa.array([r in halo for r in range(n)])}
    return pa.table(columns)


@pytest.mark.parametrize(("context", "cells"), [(32, 1), (64, 30_000), (1024, 1 << 22)])
def test_batches_are_the_windows_cut_one_by_one(context, cells):
    rng = np.random.default_rng(context)
    n = 1400
    rows = series(rng, n)
    origins = set(rng.choice(np.arange(context - 1, n), 25, replace=False).tolist()) | {n - 1, context - 1}
    halo = {r for r in range(n) if r < context - 1 or r >= n - 3}
    spec = covariates.TensorSpec(*covariates.preset("full"), context, 64)
    shuffled = as_table(rows, origins, halo).take(pa.array(rng.permutation(n)))
    seen = []
    for b in covariates.batches_of(shuffled, spec, cells):
        assert len(b["i"]) * spec.cells <= max(cells, spec.cells)
        for j, i in enumerate(b["i"].tolist()):
            r = i - 700
            seen.append(r)
            ctx = slice(r - context + 1, r + 1)
            raw = covariates.interpolate_rows(rows["target"][None, ctx], keep_leading=True)[0]
            want, flat = covariates.sanitise(raw)
            assert np.array_equal(b["targets"][j], want, equal_nan=True) and np.array_equal(b["mask"][j], np.isnan(raw))
            for c, got in zip(spec.past, b["past"][j], strict=True):
                want, more = covariates.sanitise(covariates.interpolate_rows(rows[f"past_{c}"][None, ctx])[0])
                assert np.array_equal(got, want), c
                flat += more
            m = (r + 5 + 1) % 15
            left = 15 - m
            for c, got in zip(spec.future, b["future"][j], strict=True):
                assert got.shape == (context + 64,)
                if c == "rw_fair_path":
                    path = [0.01 * (r % 50) + 0.02 * min(s, left) for s in range(1, 65)]
                    want, more = covariates.sanitise(np.concatenate([covariates.interpolate_rows(rows["fair_"][None, ctx])[0], path]))
                    assert np.allclose(got, want, atol=1e-7)
                else:
                    k = (r + 5 + np.arange(1 - context, 65)) % 15
                    minute = (r + 1200 + np.arange(1 - context, 65)) % 1440
                    ttl = [1e-4 if x >= 14 else 13 - x + 1 / 3 for x in k]
                    want = {"k_frac": k / 14, "k_sin": np.sin(2 * np.pi * k / 15), "k_cos": np.cos(2 * np.pi * k / 15), "sqrt_ttl": np.sqrt(np.array(ttl) / (13 + 1 / 3)), "tod_sin": np.sin(2 * np.pi * minute / 1440), "tod_cos": np.cos(2 * np.pi * minute / 1440)}[c]
                    more = covariates.sanitise(want)[1]
                    assert np.allclose(got, want, atol=1e-4)
                flat += more
            assert b["n_flat"][j] == flat
            for s in range(1, 16):
                good = s <= left and r + s < n and not math.isnan(rows["target"][r + s])
                assert b["valid"][j, s - 1] == good and b["step_k"][j, s - 1] == m + s - 1
                assert b["target"][j, s - 1] == rows["target"][r + s] if good else math.isnan(b["target"][j, s - 1])
    assert sorted(seen) == sorted(origins - halo)


def test_contexts_must_lie_in_the_rows():
    rows = series(np.random.default_rng(1), 100)
    spec = covariates.TensorSpec((), (), 64, 64)
    with pytest.raises(ValueError, match="before the first row"):
        list(covariates.batches_of(as_table(rows, {40}, set()), spec, 1 << 20))
    assert list(covariates.batches_of(as_table(rows, set(), set()), spec, 1 << 20)) == []


def test_widths_are_checked():
    line = lambda t, steps, po, pf: (t[:, -1:] + np.zeros((1, steps)), np.repeat((t[:, -1:] + np.zeros((1, steps)))[:, :, None], 10, axis=2))
    t = np.full((2, 64), 0.5, np.float32)
    with pytest.raises(ValueError, match="past_future must be"):
        forecast.checked_predict(line, t, 64, None, np.zeros((2, 1, 64 + 15)))
    with pytest.raises(ValueError, match="past_future must be"):
        forecast.checked_predict(line, t, 15, None, np.zeros((2, 1, 64 + 15)))
    for past in (np.zeros((2, 1, 63)), np.zeros((3, 1, 64)), np.zeros((2, 64))):
        with pytest.raises(ValueError, match="past_only must be"):
            forecast.checked_predict(line, t, 64, past)
    median, q = forecast.checked_predict(line, t, 15, np.zeros((2, 3, 64)), np.zeros((2, 1, 128)))
    assert median.shape == (2, 15) and q.shape == (2, 15, 9)
    empty = forecast.checked_predict(line, np.zeros((0, 32)), 64)
    assert empty[0].shape == (0, 64) and empty[1].shape == (0, 64, 9)
    wide = lambda t, steps, po, pf: (np.full((len(t), steps), 2.0), np.full((len(t), steps, 9), np.linspace(1.5, -0.5, 9)))
    median, q = forecast.checked_predict(wide, t, 7)
    assert median.max() == 1 and q.min() == 0 and (np.diff(q, axis=-1) >= 0).all()
    with pytest.raises(ValueError, match="a forecaster returned"):
        forecast.checked_predict(lambda t, steps, po, pf: (np.zeros((2, steps - 1)), np.zeros((2, steps, 9))), t, 7)


def test_a_model_sees_each_origin_in_order(spark, sf):
    from forelight import catalogue

    frame = catalogue.minute_frame(spark, sf)
    origins = catalogue.cut(catalogue.all_origins(frame))
    t = {r["i"]: r for r in covariates.tensors(frame, origins, 32).collect()}

    def predict(targets, steps, past, future):
        assert steps == 64 and past.shape[1:] == (17, 32) and future.shape[1:] == (7, 96)
        mid = past[:, 0, -1:] + future[:, 6, 32:]
        return mid, np.repeat(mid[:, :, None], 9, axis=2)

    out = forecast.covariate_forecast(frame, origins, predict, 32, horizon=20, cells=20_000)
    rows = out.collect()
    want = {(r["i"], r["h"]): (r["k"], r["actual"]) for r in forecast.valid_steps(frame, origins).collect()}
    assert {(r["i"], r["h"]): (r["k"], r["actual"]) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        x = t[r["i"]]
        assert r["median"] == pytest.approx(min(1, max(0, np.float32(x["past"][0][-1]) + np.float32(x["future"][6][31 + r["h"]])))) and r["n_flat"] == x["n_flat"]
        assert x["valid"][r["h"] - 1] and x["tgt"][r["h"] - 1] == r["actual"] and x["step_k"][r["h"] - 1] == r["k"]
    assert [c for c in out.columns if c.startswith("q")] == list(Q_COLS)
    none = covariates.tensors(frame, origins, 32, "none").first()
    assert none["past"] == [] and none["future"] == [] and len(none["target"]) == 32
