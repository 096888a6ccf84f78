"""Exposure of photos from points that several of them see, and consensus colours.

Spark aggregates the normal equations; what reaches the driver is their unknowns, whose number is that of the photos
(times the cells of their grid), not of the points.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.functions.camera import huber_weight, linear, srgb
from terraweave.functions.geometry import d

CHANNELS = ("r", "g", "b")


def view_pairs(views: DataFrame, most: int = 4) -> DataFrame:
    """The best view of each point against its others, as far as both can be compared: scores not too far apart, no
    edges, no clipped channels, no gross differences."""
    slots = F.array_sort(F.collect_list(F.struct("slot", "photo", "score", "gradient", *CHANNELS)))
    grouped = views.groupBy("point_id").agg(slots.alias("s")).where(F.size("s") > 1)
    pairs = grouped.select("point_id", F.get("s", F.lit(0)).alias("a"), F.explode(F.slice("s", 2, most - 1)).alias("b"))
    low = F.least(*[F.col(f"{s}.{c}") for s in "ab" for c in CHANNELS])
    high = F.greatest(*[F.col(f"{s}.{c}") for s in "ab" for c in CHANNELS])
    gap = F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in CHANNELS])
    fit = (F.col("a.score") > 0) & (F.col("b.score") > 0.1 * F.col("a.score")) & (F.col("a.gradient") < 22) & (F.col("b.gradient") < 22)
    return pairs.where(fit & (low > 12) & (high < 243) & (gap < 40)).select("point_id", F.col("b.slot").alias("slot"), F.col("a.photo").alias("photo_a"), F.col("b.photo").alias("photo_b"), *[(F.col(f"b.{c}") - F.col(f"a.{c}")).cast("double").alias(f"d{c}") for c in CHANNELS])


def normal_matrix(edges: DataFrame, weight: Column, value: Column) -> tuple[DataFrame, DataFrame]:
    """A'WA as (i, j, a) and A'Wy as (i, y) of edges (node_a, node_b) that say x[node_a] - x[node_b] = value."""
    w = edges.select("node_a", "node_b", weight.alias("w"), value.alias("v"))
    entries = F.array(*[F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (F.col("w") * s).alias("a")) for i, j, s in (("node_a", "node_a", 1), ("node_b", "node_b", 1), ("node_a", "node_b", -1), ("node_b", "node_a", -1))])
    matrix = w.select(F.explode(entries).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.a").alias("a"))
    sides = F.array(F.struct(F.col("node_a").alias("i"), (F.col("w") * F.col("v")).alias("y")), F.struct(F.col("node_b").alias("i"), (-F.col("w") * F.col("v")).alias("y")))
    return matrix, w.select(F.explode(sides).alias("e")).groupBy("e.i").agg(F.sum("e.y").alias("y"))


def solve_offsets(edges: DataFrame, nodes: int, ridge: float = 0.15, huber: float = 8.0, rounds: int = 4, prior: np.ndarray | None = None, smooth: list[tuple[int, int, float]] | None = None, clamp: float = 32.0) -> np.ndarray:
    """Robust least squares by reweighting: offsets of `nodes` unknowns, at most a few thousand. edges are read in each round,
    so they had best be a written table."""
    x = np.zeros(nodes) if prior is None else prior.astype(float).copy()
    base = np.zeros(nodes) if prior is None else prior.astype(float)
    for _ in range(rounds):
        known = F.array(*[d(v) for v in x])
        residual = F.col("value") - (F.get(known, F.col("node_a").cast("int")) - F.get(known, F.col("node_b").cast("int")))
        matrix, side = normal_matrix(edges, huber_weight(residual, huber), F.col("value"))
        a, y = np.eye(nodes) * ridge, base * ridge
        for r in matrix.collect():
            a[r["i"], r["j"]] += r["a"]
        for r in side.collect():
            y[r["i"]] += r["y"]
        for i, j, w in smooth or ():
            a[i, i] += w
            a[j, j] += w
            a[i, j] -= w
            a[j, i] -= w
        x = np.linalg.solve(a, y)
    return np.clip(x, -clamp, clamp)


def grid_edges(photos: int, nx: int = 8, ny: int = 6, weight: float = 80.0) -> list[tuple[int, int, float]]:
    """Neighbouring cells, right and down, of each photo's grid."""
    out = []
    for p in range(photos):
        for iy in range(ny):
            for ix in range(nx):
                k = p * nx * ny + iy * nx + ix
                out += [(k, k + 1, weight)] if ix + 1 < nx else []
                out += [(k, k + nx, weight)] if iy + 1 < ny else []
    return out


def field_bilinear(views: DataFrame, field: DataFrame, value: str = "offset") -> DataFrame:
    """Offset of a photo's grid (photo, ix, iy, offset) at (gx, gy), bilinear: each view joins its four cells."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    at = views.withColumns({"_x": F.floor("gx").cast("int"), "_y": F.floor("gy").cast("int")}).withColumn("_c", F.explode(corners))
    fx, fy = F.col("gx") - F.col("_x"), F.col("gy") - F.col("_y")
    w = F.when(F.col("_c.a") == 1, fx).otherwise(1 - fx) * F.when(F.col("_c.b") == 1, fy).otherwise(1 - fy)
    placed = at.withColumns({"ix": F.least(F.col("_x") + F.col("_c.a"), F.lit(7)), "iy": F.least(F.col("_y") + F.col("_c.b"), F.lit(5)), "_w": w})
    joined = placed.join(field, ["photo", "ix", "iy"])
    return joined.groupBy(*views.columns).agg(F.sum(F.col("_w") * F.col(value)).alias(value))


def fixed_point(c00: Column, c10: Column, c01: Column, c11: Column, gx: Column, gy: Column) -> Column:
    """The same with 8-bit weights and 8-bit fractions, in whole numbers; c: offsets times 256."""
    wx, wy = F.floor((gx - F.floor(gx)) * 256 + 0.5).cast("long"), F.floor((gy - F.floor(gy)) * 256 + 0.5).cast("long")
    total = c00 * (256 - wx) * (256 - wy) + c10 * wx * (256 - wy) + c01 * (256 - wx) * wy + c11 * wx * wy
    return F.floor(total / 65536).cast("long")


def consensus(views: DataFrame, robust: bool = True, most: int = 4) -> DataFrame:
    """Colour of each point from its views (slot, score, gradient, r, g, b in 0..255), and whether several were blended.

    Robust: the anchor is the view that differs least from the others (the best view if it lies on an edge); others:
    the best view. Views count by score, by how near they are to the anchor and by how even the photo is there, in
    linear light.
    """
    cap, reach = 48.0, 22.0
    slot = F.struct("slot", "score", "gradient", *CHANNELS)
    grouped = views.groupBy("point_id").agg(F.slice(F.array_sort(F.collect_list(slot)), 1, most).alias("s"))
    best = F.get("s", F.lit(0))
    usable = lambda v: (v["score"] > 0.1 * best["score"]) & (v["gradient"] < reach) | (v["slot"] == best["slot"])
    grouped = grouped.withColumn("s", F.filter("s", usable))
    gap = lambda a, b: F.greatest(*[F.abs(a[c] - b[c]) for c in CHANNELS]).cast("double")
    if robust:
        costs = F.transform("s", lambda a: F.aggregate("s", d(0), lambda acc, b: acc + F.least(gap(a, b), d(cap))))
        first = F.array_position(costs, F.array_min(costs)) - 1
        anchor = F.when(best["gradient"] >= reach, best).otherwise(F.get("s", first.cast("int")))
    else:
        anchor = best
    grouped = grouped.withColumn("anchor", anchor)
    top = F.get("s", F.lit(0))["score"]

    def weight(v: Column) -> Column:
        near = F.greatest(d(0), 1 - F.pow(gap(v, F.col("anchor")) / cap, d(2)))
        return F.sqrt(F.try_divide(v["score"], top)) * near * near / (1 + F.pow(v["gradient"] / reach, d(2)))

    total = F.aggregate("s", d(0), lambda acc, v: acc + weight(v))
    mixed = [srgb(F.try_divide(F.aggregate("s", d(0), lambda acc, v: acc + weight(v) * linear(v[c] / 255.0)), total)) * 255 for c in CHANNELS]  # noqa: B023
    used = F.size(F.filter("s", lambda v: weight(v) > 0))
    return grouped.select("point_id", *[m.alias(c) for m, c in zip(mixed, CHANNELS, strict=True)], (used > 1).alias("blended"))
