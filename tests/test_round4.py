"""Projections of points on the same place next to each other; smoothing by fewer comparisons."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweave.operators import surfaces as S
from terraweave.plans import catalog

UP, LEAST = np.array([0.0, 0.0, 5.0]), 0.8660254037844386


def test_projections_of_one_place_are_written_next_to_each_other(spark, sf, tmp_path):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").limit(400).drop("copy")
    copies = items.withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(6)])))
    keys = {c: F.col(c) + F.col("copy") * 1_000_000 for c in ("l_orderkey", "l_partkey", "l_suppkey")}
    copies.withColumns(keys).repartition(6, "copy").drop("copy").write.parquet(f"{tmp_path}/lineitem.parquet")
    shutil.copy(f"{sf}/supplier.parquet", tmp_path)
    found = catalog.QUERIES["f12_m01_j06_projection"](spark, str(tmp_path))
    found.write.parquet(f"{tmp_path}/out")
    rows = changes = places = 0
    for part in tmp_path.glob("out/*.parquet"):
        t = spark.read.parquet(str(part)).toPandas()
        for _, own in t.groupby("photo", sort=False):
            at = own[["u", "v", "theta", "dist"]]
            rows, places = rows + len(at), places + len(at.drop_duplicates())
            changes += int((at != at.shift()).any(axis=1).sum())
    assert rows > 6 * 400 * 5 and changes == places < rows / 5


def chunked(p, radius):
    found = S.leaves(p, S.CHUNK)
    at, held = np.zeros((3, len(found), S.CHUNK)), np.arange(S.CHUNK) < np.array([len(f) for f in found])[:, None]
    at[:, held] = p[np.concatenate(found)].T
    return S.Chunks(at, np.zeros_like(at), held, radius), np.concatenate(found)


@pytest.mark.parametrize("kind", ["dense", "lattice", "far", "sparse"])
def test_neighbours_are_those_by_differences_and_few_pairs_are_compared(monkeypatch, kind):
    rng, near, compared = np.random.default_rng(21), S.Chunks.near, []
    p = {"dense": rng.normal(0, 0.125, (12000, 3)), "lattice": np.argwhere(np.ones((15, 15, 15))) * 0.05, "far": rng.normal(0, 0.125, (3000, 3)) + 1e5, "sparse": rng.normal(0, 30.0, (3000, 3))}[kind]
    monkeypatch.setattr(S.Chunks, "near", lambda self, k, rows, *more: compared.append(len(rows) * S.CHUNK) or near(self, k, rows, *more))
    own, order = chunked(p, 0.2)
    sums = S.Covariances(own)
    sums.add(p.T, np.zeros_like(p.T))
    want = [int((((q - p) ** 2)[:, 0] + ((q - p) ** 2)[:, 1] + ((q - p) ** 2)[:, 2] <= 0.2 * 0.2).sum()) for q in p[order]]
    assert sums.sums[own.held][:, 1].tolist() == want
    assert sum(compared) < {"dense": 0.5, "sparse": 0.2}.get(kind, 1) * len(p) ** 2


def test_smoothing_does_not_depend_on_the_order_of_points():
    rng = np.random.default_rng(11)
    p = rng.normal(0.3, 0.08, (1500, 3))  # at its edge there are points with one neighbour, whose normals rounding chose
    p[:4] = [[5, 5, 5], [5.05, 5.02, 5.01], [5.1, 5.04, 5.02], [5.15, 5.06, 5.03]]
    places, normals, ok = S.smooth_block(p, UP, 0.15, 2, LEAST)
    assert ok[:4].all() and 1400 < ok.sum() < 1500
    for seed in range(4):
        order = np.random.default_rng(seed).permutation(len(p))
        q, n, same = S.smooth_block(p[order], UP, 0.15, 2, LEAST)
        assert np.array_equal(same, ok[order]) and np.abs(q - places[order])[same].max() < 1e-9 and np.abs(n - normals[order])[same].max() < 1e-9


def test_blocks_smoothed_by_one_task_are_those_smoothed_in_tiles(spark, monkeypatch):
    p = np.random.default_rng(22).normal(0.0, 0.12, (1200, 3))
    pts = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(p)], "point_id long, x double, y double, z double")
    whole = S.smoothed_surface(pts, 0.5, 0.2, 0.2, UP).toPandas().set_index("point_id").sort_index()
    monkeypatch.setattr(S, "TILE", 256)
    tiles = S.smoothed_surface(pts, 0.5, 0.2, 0.2, UP).toPandas().set_index("point_id").sort_index()
    assert whole.index.equals(tiles.index) and len(whole) > 1100 and (whole - tiles).abs().to_numpy().max() < 1e-9
    assert S.smoothed_surface(pts.where("point_id < 0"), 0.5, 0.2, 0.2, UP).count() == 0
