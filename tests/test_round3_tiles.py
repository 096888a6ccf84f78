"""Smoothing in tiles, odometry from kept candidates, folds in bounded partitions."""

import re

import numpy as np
import pytest

from terraweave.operators import points as P
from terraweave.operators import surfaces as S
from terraweave.operators.neighbours import CellIndex, Followed
from terraweave.plans import catalog
from terraweave.streaming import odometry


def smoothed_plainly(p, sensor, radius, iterations, least):
    """Every pair of a block."""
    alive = np.ones(len(p), bool)
    for step in range(iterations):
        near = (((p[:, None] - p[None]) ** 2).sum(-1) <= radius * radius) & alive
        raw = np.zeros_like(p)
        for k, row in enumerate(near):
            if row.any():
                q = p[row] - p[row].mean(0)
                raw[k] = S.smallest_eigen(np.array([[(q[:, a] * q[:, b]).mean() for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]]))[1][0]
        known = alive & (near.sum(1) > 2)
        cosine = raw @ raw.T
        w = np.where(near & known & (np.abs(cosine) >= least), cosine, 0)
        normal = w @ raw
        normal /= np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300)
        share = np.abs(w)
        shift = (share @ p - share.sum(1)[:, None] * p) / np.maximum(share.sum(1), 1e-300)[:, None]
        move = (((share > 0).sum(1) > 1) & known)[:, None]
        p = np.where(move, p + (shift * normal).sum(1, keepdims=True) * normal, p)
        alive = known if step == 0 else alive
    return p, normal * np.where(((sensor - p) * normal).sum(1, keepdims=True) < 0, -1, 1), alive & (np.linalg.norm(normal, axis=1) > 0.5)


@pytest.mark.parametrize("kind", ["ball", "floor", "wall"])
def test_smoothing_cuts_dense_blocks_into_tiles(spark, monkeypatch, kind):
    monkeypatch.setattr(S, "TILE", 256)
    rng = np.random.default_rng(11)
    p = rng.normal(0.3, 0.08, (1500, 3)) if kind == "ball" else rng.uniform(-0.2, 0.6, (1500, 3))
    p[:, 2 if kind == "floor" else 0] *= {"ball": 1, "floor": 0.01, "wall": 0}[kind]
    p[-3:] = [[3, 3, 3], [3, 3, 3.01], [9, 9, 9]]  # too few neighbours
    pts = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(p)] + [(5000, None, 0.0, 0.0), (5001, float("nan"), 0.0, 0.0)], "point_id long, x double, y double, z double")
    tiles = S._packed(P.halo_blocks(pts.where("point_id < 5000"), 0.5, 0.15), 0.15).toPandas()
    assert tiles.groupby("tile").id.agg(lambda v: sum(map(len, v))).max() < 700 and tiles.id.map(len).max() <= S.CHUNK
    got = {r.point_id: r[1:] for r in S.smoothed_surface(pts, 0.5, 0.15, 0.15, (0.0, 0.0, 5.0)).collect()}
    want = {}
    for _, block in P.halo_blocks(pts.where("point_id < 5000"), 0.5, 0.15).toPandas().groupby(["kx", "ky", "kz"]):
        q, n, ok = smoothed_plainly(block[["x", "y", "z"]].to_numpy(), np.array([0.0, 0.0, 5.0]), 0.15, 2, 0.8660254037844386)
        want |= {block.point_id.iloc[k]: (*q[k], *n[k]) for k in np.flatnonzero(ok & block.core.to_numpy())}
    assert got.keys() == want.keys() and 1400 < len(got) <= 1497
    assert max(np.abs(np.array(got[k]) - np.array(want[k])).max() for k in want) < 1e-6


@pytest.mark.parametrize("kind", ["cloud", "lattice", "sparse", "none"])
def test_followed_points_are_the_nearest_ones(kind):
    rng = np.random.default_rng(12)
    known = {"cloud": rng.uniform(0, 4, (8000, 3)), "lattice": np.argwhere(np.ones((12, 12, 12))) / 4.0, "sparse": rng.uniform(0, 30, (300, 3)), "none": np.zeros((0, 3))}[kind]
    index, p = CellIndex(known, 0.5), rng.uniform(-0.5, 4.5, (300, 3))
    if kind == "lattice":
        p = np.floor(p * 8) / 8
    followed = Followed(index, 5, 1.8)
    assert Followed(index, 5, 1.8).nearest(p[:0])[0].shape == (0, 5)
    for move in (0, 1e-3, 0.02, 0.3, 0, 5.0, 0.125):
        p = p + move * np.array([1, 0, 0] if kind == "lattice" else rng.normal(0, 0.5, 3))
        for got, want in zip(followed.nearest(p), index.nearest(p, 5, 1.8), strict=True):
            assert np.array_equal(got, want)


def test_odometry_does_not_look_through_the_map_each_round(monkeypatch):
    rng, pairs = np.random.default_rng(13), []
    within = CellIndex.within
    monkeypatch.setattr(CellIndex, "within", lambda self, p, rings: pairs.append(len(p)) or within(self, p, rings))
    state, matched = odometry.State(), 0
    for k in range(3):
        matched = odometry.register(state, rng.uniform(0, 4, (3000, 3)) * [1, 1, 0.02] + [0.02 * k, 0, 0])
    asked = len(odometry.downsampled(rng.uniform(0, 4, (3000, 3)) * [1, 1, 0.02], 1.5 * odometry.VOXEL))
    assert matched > 20 and sum(pairs) < 2 * 8 * asked  # two scans of up to 20 rounds


def test_folded_stages_are_dealt_once_into_partitions_by_what_is_read(spark, sf):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        text = catalog.QUERIES["a44_folded_stages"](spark, sf)._jdf.queryExecution().executedPlan().toString()
        splits = spark.read.parquet(f"{sf}/lineitem.parquet").rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert text.count("Exchange") == 1 and int(re.search(r"Exchange hashpartitioning\(\S+, (\d+)\)", text)[1]) == 8 * splits > 8
