"""Scans of two levels against one loop."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraweave.operators import ordered as O
from terraweave.operators import series as T


def series(seed, n=4000):
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 0.5  # one sensor has half of the rows
    f = pd.DataFrame({"sensor": np.where(hot, 0, rng.integers(1, 6, n)), "t_us": rng.integers(0, 40 * 86400, n) * 1_000_000, "event_id": rng.permutation(n)})
    for c in ("rate", "wx", "wy", "wz"):
        f[c] = rng.normal(0, 1e-4 if c != "rate" else 10, n)
    return f


def slow_attitudes(rows, gap):
    out, q, last = [], np.array([0.0, 0, 0, 1]), None
    for t, *w in rows:
        w = np.array(w)
        if last is not None:
            dt = t - last[0]
            turn = (w + last[1]) / 2 * dt
            angle = np.linalg.norm(turn)
            step = np.concatenate([turn * (np.sin(angle / 2) / angle if angle > 1e-12 else 0.5), [np.cos(angle / 2)]])
            q = np.array([0.0, 0, 0, 1]) if dt > gap else O.turned(q, step)
        out.append(q)
        last = (t, w)
    return np.array(out)


@pytest.mark.parametrize("bucket", [3600.0, 86400.0, 1e9])
def test_two_levels_are_one_loop(spark, bucket):
    f = series(5)
    got = T.ema(spark.createDataFrame(f[["sensor", "t_us", "event_id", "rate"]]), "sensor", 0.7, bucket).toPandas().set_index("event_id").ema
    for _, rows in f.sort_values(["t_us", "event_id"]).groupby("sensor"):
        y = None
        for k, x in zip(rows.event_id, rows.rate, strict=True):
            y = x if y is None else 0.7 * x + 0.3 * y
            assert abs(got[k] - y) < 1e-9
    f = f.drop_duplicates(["sensor", "t_us"])
    got = T.attitudes(spark.createDataFrame(f[["sensor", "t_us", "wx", "wy", "wz"]]), "sensor", 6000.0, bucket).toPandas()
    assert len(got) == len(f)
    for sensor, rows in f.sort_values("t_us").groupby("sensor"):
        own = got[got.sensor == sensor].sort_values("t_us")
        want = slow_attitudes(np.column_stack([rows.t_us / 1e6, rows[["wx", "wy", "wz"]]]), 6000.0)
        assert (want[:, 3] == 1).sum() > 1  # there are new beginnings
        assert np.abs(own[["qx", "qy", "qz", "qw"]].to_numpy() - want).max() < 1e-9


@pytest.mark.parametrize("fold", [O.Ema("rate", 0.3), O.Attitude(("a", "b", "c"), 2.0)])
def test_joining_is_associative_and_tells_what_a_run_does(fold):
    rng = np.random.default_rng(1)
    t, v = np.cumsum(rng.exponential(1.0, 60)), rng.normal(0, 1, (60, len(fold.takes)))
    parts = [fold.element(t[a:b], v[a:b]) for a, b in ((0, 1), (1, 20), (20, 21), (21, 60))]
    left = parts[0]
    for p in parts[1:]:
        left = fold.join(left, p)
    right = fold.join(parts[0], fold.join(parts[1], fold.join(parts[2], parts[3])))
    assert np.allclose(left, right, atol=1e-12) and np.allclose(left, fold.element(t, v), atol=1e-12)
    whole = fold.run(None, t, v)
    assert np.allclose(np.concatenate([fold.run(None, t[:20], v[:20]), fold.run(fold.element(t[:20], v[:20]), t[20:], v[20:])]), whole, atol=1e-12)


def test_nulls_drop_out_and_an_empty_table_gives_an_empty_result(spark):
    rows = [(1, 0, 1, 2.0), (1, None, 2, 3.0), (1, 5_000_000, 3, None), (None, 1, 4, 1.0), (1, 9_000_000, 5, 4.0)]
    df = spark.createDataFrame(rows, "sensor long, t_us long, event_id long, rate double")
    assert {r.event_id: round(r.ema, 9) for r in T.ema(df, "sensor", 0.5).collect()} == {1: 2.0, 5: 3.0}
    assert T.ema(df.where(F.lit(False)), "sensor").count() == 0


def dense_smoothing(p, sensor, radius, iterations, least):
    """A point at a time against all points."""
    alive, p = np.ones(len(p), bool), p.copy()
    for step in range(iterations):
        near = ((p[:, None] - p[None]) ** 2).sum(-1) <= radius**2
        raw, count = np.zeros_like(p), np.zeros(len(p))
        for k in range(len(p)):
            own = p[near[k] & alive]
            count[k] = len(own)
            raw[k] = np.linalg.eigh(np.cov(own.T, bias=True))[1][:, 0] if len(own) > 1 else [1.0, 0, 0]
        known = alive & (count > 2)
        moved, new = p.copy(), np.zeros_like(p)
        for k in range(len(p)):
            c = raw @ raw[k]
            w = np.where(near[k] & known & (np.abs(c) >= least), c, 0)
            n = (w[:, None] * raw).sum(0)
            new[k] = n / (np.linalg.norm(n) or 1)
            if known[k] and (w != 0).sum() > 1:
                centre = (np.abs(w)[:, None] * p).sum(0) / np.abs(w).sum()
                moved[k] = p[k] - ((p[k] - centre) @ new[k]) * new[k]
        alive = known if step == 0 else alive
        toward = np.sign(((sensor - moved) * new).sum(1, keepdims=True))
        normal, p = new * np.where(toward < 0, -1.0, 1.0), moved
    return p, normal, alive & (np.linalg.norm(normal, axis=1) > 0.5)


def test_smoothing_by_cells_is_smoothing_against_all_points(monkeypatch):
    from terraweave.operators import surfaces as S

    rng = np.random.default_rng(4)
    flat = np.concatenate([np.column_stack([rng.uniform(0, 2, (300, 2)), rng.normal(0, 0.01, 300)]), np.column_stack([rng.uniform(0, 2, 150), rng.normal(0, 0.01, 150), rng.uniform(0, 2, 150)]), rng.uniform(0, 2, (20, 3))]) + 1000.0
    sensor = np.array([1001.0, 1003.0, 1004.0])
    want = dense_smoothing(flat, sensor, 0.25, 2, 0.8660254)
    for most in (1 << 20, 500):
        monkeypatch.setattr(S, "MOST_PAIRS", most)
        p, n, ok = S.smooth_block(flat, sensor, 0.25, 2, 0.8660254)
        sure = ok & want[2]
        assert (ok == want[2]).mean() > 0.99 and sure.sum() > 400
        assert np.quantile(np.abs(p[sure] - want[0][sure]).max(1), 0.98) < 1e-6 and np.quantile(np.abs(n[sure] - want[1][sure]).max(1), 0.98) < 1e-5
    assert len(S.smooth_block(flat[:1], sensor, 0.25, 2, 0.8)[0]) == 1
