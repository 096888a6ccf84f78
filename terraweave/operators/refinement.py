"""Refinement of poses against planes, frame by frame, by Gauss-Newton steps.

A step is an equi-join of points to nearby planes, an aggregation of 27 sums a frame, and the solution of a 6 x 6 system
a frame; points are never gathered by frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.functions import geometry as G
from terraweave.functions.geometry import d, xyz
from terraweave.session import kept
from terraweave.operators.points import CELL, with_cells

STEP = ["wx", "wy", "wz", "tx", "ty", "tz"]


def apply_steps(pts: DataFrame, steps: DataFrame) -> DataFrame:
    """Points of each frame turned by the small rotation w about the origin and moved by t."""
    j = pts.join(steps.select("frame", *STEP), "frame", "left")
    w, t = ([F.coalesce(F.col(c), d(0)) for c in cols] for cols in (STEP[:3], STEP[3:]))
    angle = G.norm(w)
    p = xyz()
    sine = F.when(angle > 1e-12, F.try_divide(F.sin(angle), angle)).otherwise(d(1))
    versine = F.when(angle > 1e-12, F.try_divide(1 - F.cos(angle), angle * angle)).otherwise(d(0.5))
    c1 = G.cross(w, p)
    c2 = G.cross(w, c1)
    moved = [a + sine * b + versine * c + s for a, b, c, s in zip(p, c1, c2, t, strict=True)]
    return j.withColumns(dict(zip("xyz", moved, strict=True))).drop(*STEP)


def matches(pts: DataFrame, planes: DataFrame, reach: float, cutoff: float) -> DataFrame:
    """Each point with its nearest plane (mx, my, mz, nx, ny, nz) within reach whose plane it is within the cutoff of."""
    m = planes.select("mx", "my", "mz", "nx", "ny", "nz", *[G.cell(F.col(f"m{c}"), reach).alias(k) for c, k in zip("xyz", CELL, strict=True)])
    away = G.sub(xyz(), [F.col(c) for c in ("mx", "my", "mz")])
    d2, r = G.dot(away, away), G.dot(away, [F.col(c) for c in ("nx", "ny", "nz")])

    def near_planes(queries: DataFrame) -> DataFrame:
        probes = with_cells(queries, reach)
        for c in CELL:
            probes = probes.withColumn("_o", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(c, F.col(c) + F.col("_o")).drop("_o")
        return probes.join(m, CELL).withColumns({"_d": d2, "r": r}).where((F.col("_d") <= reach * reach) & (F.abs("r") <= cutoff))

    # Least distances are hashed; a minimum of structs would sort all pairs, so planes come from a second look, at these distances.
    own = ["frame", "point_id", "x", "y", "z"]
    least = near_planes(pts.select(*own)).groupBy(*own).agg(F.min("_d").alias("_least"))
    near = near_planes(least).where(F.col("_d") <= F.col("_least"))
    return near.groupBy("frame", "point_id").agg(F.min(F.struct("_d", "x", "y", "z", "nx", "ny", "nz", "r")).alias("b")).select("frame", "point_id", "b.*")


def refine_poses(pts: DataFrame, planes: DataFrame, reach: float = 0.3, cutoff: float = 0.10, noise: float = 0.02, least: int = 250, rounds: int = 3, most_shift: float = 0.05, most_turn: float = np.deg2rad(0.5)) -> DataFrame:
    """(frame, wx..tz, matches, cost): the correction of each frame that has enough matches, within the limits.

    Residuals count by a Cauchy weight of the noise. A frame whose correction exceeds a limit keeps its pose.
    """

    def solve(batches):
        names = [f"h{i}{j}" for i in range(6) for j in range(i, 6)]
        for b in batches:
            h = np.zeros((b.num_rows, 6, 6))
            for n in names:
                i, j = int(n[1]), int(n[2])
                h[:, i, j] = h[:, j, i] = b.column(n).to_numpy()
            g = np.stack([b.column(f"g{i}").to_numpy() for i in range(6)], -1)
            x = np.linalg.solve(h + np.eye(6) * 1e-5, -g[..., None])[..., 0] if b.num_rows else g
            yield pa.RecordBatch.from_arrays([b.column("frame"), *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(6)], b.column("matches"), b.column("cost")], names=["frame", *STEP, "matches", "cost"])

    total, planes = None, kept(planes, "planes")  # computed once, and broadcast if small
    for _ in range(rounds):
        at = pts if total is None else apply_steps(pts, total)
        m = matches(at, planes, reach, cutoff)
        normal = [F.col(c) for c in ("nx", "ny", "nz")]
        jac = [*G.cross(xyz(), normal), *normal]
        w = 1 / (1 + (F.col("r") / noise) * (F.col("r") / noise))
        sums = m.groupBy("frame").agg(F.count("*").alias("matches"), F.sum(F.log1p((F.col("r") / noise) * (F.col("r") / noise))).alias("cost"), *[F.sum(w * jac[i] * jac[j]).alias(f"h{i}{j}") for i in range(6) for j in range(i, 6)], *[F.sum(w * jac[i] * F.col("r")).alias(f"g{i}") for i in range(6)])
        step = sums.where(F.col("matches") >= least).mapInArrow(solve, "frame long, " + ", ".join(f"{c} double" for c in STEP) + ", matches long, cost double")
        if total is None:
            total = step
        else:  # small rotations add up
            a, b = total.alias("a"), step.alias("b")
            total = a.join(b, "frame").select("frame", *[(F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c) for c in STEP], F.col("b.matches").alias("matches"), F.col("b.cost").alias("cost"))
        total = kept(total, "steps")  # a row a frame
    turn, shift = (G.norm([F.col(c) for c in cols]) for cols in (STEP[:3], STEP[3:]))
    ok = (turn <= most_turn) & (shift <= most_shift)
    return total.select("frame", *[F.when(ok, F.col(c)).otherwise(d(0)).alias(c) for c in STEP], "matches", "cost", ok.alias("accepted"))
