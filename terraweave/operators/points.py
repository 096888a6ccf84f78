"""Operators on point clouds: validity, voxels, halos, rays, density."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terraweave.functions import geometry as G
from terraweave.functions.geometry import d, xyz

CELL = ["cx", "cy", "cz"]


def valid_returns(pts: DataFrame, least: float = 0.5, most: float = 100.0, near: float = 30.0, bad_bits: int = 0x30) -> DataFrame:
    """Returns with finite coordinates, a range between the bounds and none of the bad tag bits; adds range and near."""
    p = xyz()
    r2 = G.dot(p, p)
    kept = pts.where(G.finite(*p) & (r2 >= least * least) & (r2 <= most * most) & (F.col("tag").bitwiseAND(bad_bits) == 0))
    return kept.withColumns({"range": F.sqrt(r2), "near": r2 <= near * near})


def with_cells(pts: DataFrame, size: float, names: Sequence[str] = CELL) -> DataFrame:
    return pts.withColumns(G.cells(xyz(), size, names))


def nearest_to_centre(pts: DataFrame, size: float, *carried: str) -> DataFrame:
    """One point a voxel: the nearest to the voxel's centre, ties to the smaller point_id. One shuffle of (key, struct)."""
    celled = with_cells(pts, size)
    off = [v - G.centre(F.col(c), size) for v, c in zip(xyz(), CELL, strict=True)]
    best = F.min(F.struct(G.dot(off, off).alias("off"), F.col("point_id"), *[F.col(c) for c in ("x", "y", "z", *carried)]))
    return celled.groupBy(*CELL).agg(best.alias("b")).select(*CELL, "b.point_id", F.sqrt("b.off").alias("off"), *[f"b.{c}" for c in ("x", "y", "z", *carried)])


def first_in_voxel(pts: DataFrame, size: float, order: Column, group: Sequence[str] = ()) -> DataFrame:
    """One point a voxel (and group): the first in the given unique order."""
    return with_cells(pts, size).groupBy(*group, *CELL).agg(F.min_by("point_id", order).alias("point_id"))


def first_n_in_voxel(pts: DataFrame, size: float, n: int, within: float) -> DataFrame:
    """At most n points a voxel, by point_id, of those within a distance of the origin."""
    near = with_cells(pts.where(G.norm(xyz()) <= within), size)
    return near.withColumn("place", F.row_number().over(Window.partitionBy(*CELL).orderBy("point_id"))).where(F.col("place") <= n)


def fused(pts: DataFrame, size: float, least_frames: int = 1) -> DataFrame:
    """Centroid, samples and distinct frames of each voxel that enough frames have seen."""
    per_frame = with_cells(pts, size).groupBy(*CELL, "frame").agg(*[F.sum(c).alias(c) for c in "xyz"], F.count("*").alias("n"))
    cells = per_frame.groupBy(*CELL).agg(*[F.sum(c).alias(f"s{c}") for c in "xyz"], F.sum("n").alias("samples"), F.count("*").alias("frames"))
    return cells.where(F.col("frames") >= least_frames).select(*CELL, *[(F.col(f"s{c}") / F.col("samples")).alias(c) for c in "xyz"], "samples", "frames")


def occupied(pts: DataFrame, size: float) -> DataFrame:
    """Distinct voxels with their centres."""
    return with_cells(pts, size).select(*CELL).distinct().withColumns({f"centre_{n}": (F.col(c) + 0.5) * size for n, c in zip("xyz", CELL, strict=True)})


def halo_blocks(pts: DataFrame, size: float, halo: float) -> DataFrame:
    """Each point once for every block whose centre is within size / 2 + halo of it on all axes; core marks its own.

    Closed form on each axis: the own block, and a neighbour only if the point is within the halo of the face to it.
    """
    out = pts
    for v, c in zip("xyz", ("kx", "ky", "kz"), strict=True):
        own = G.cell(F.col(v), size)
        inner = F.col(v) - own * size
        near = F.array_compact(F.array(own, F.when(inner < halo, own - 1), F.when(size - inner < halo, own + 1)))
        out = out.withColumn(f"_{c}", own).withColumn(c, F.explode(near))
    core = (F.col("_kx") == F.col("kx")) & (F.col("_ky") == F.col("ky")) & (F.col("_kz") == F.col("kz"))
    return out.withColumn("core", core).drop("_kx", "_ky", "_kz")


def density_blocks(pts: DataFrame, trajectory: DataFrame, size: float = 1.0, least_points: int = 7, near: float = 1.0) -> DataFrame:
    """Blocks with more than least_points points, the distance of their centre to the nearest of the trajectory (a
    dimension of a few rows: broadcast by the planner if its size allows) and whether repeated observation is required."""
    blocks = with_cells(pts, size, ("kx", "ky", "kz")).groupBy("kx", "ky", "kz").agg(F.count("*").alias("n")).where(F.col("n") > least_points)
    away = G.sub([(F.col(c) + 0.5) * size for c in ("kx", "ky", "kz")], [F.col(c) for c in ("ox", "oy", "oz")])
    found = blocks.crossJoin(trajectory).groupBy("kx", "ky", "kz", "n").agg(F.min(G.norm(away)).alias("to_trajectory"))
    return found.withColumn("required", F.when(F.col("to_trajectory") <= near, 1).otherwise(0))


def level_of(spacing: Column, bounds: Sequence[float] = (0.005, 0.010, 0.020)) -> Column:
    """0 for the densest points, one more for each bound that the mean spacing reaches."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(spacing >= b, 1).otherwise(0)
    return out.cast("int")


def stencil_count(cells: DataFrame, reach: int, keys: Sequence[str], counted: Column, names: Sequence[str] = CELL) -> DataFrame:
    """For rows a of cells, how many rows b within `reach` cells on each axis, and of the same keys, satisfy `counted`.

    Cells are looked up by offset: each row of one side is emitted for every offset, then it is an equi-join.
    """
    offsets = F.array(*[F.lit(k) for k in range(-reach, reach + 1)])
    probes = cells
    for c in names:
        probes = probes.withColumn(f"_{c}", F.explode(offsets)).withColumn(f"_{c}", F.col(c) + F.col(f"_{c}"))
    probes = probes.alias("a")
    targets = cells.select(*keys, *[F.col(c).alias(f"_{c}") for c in names], *[c for c in cells.columns if c not in (*keys, *names)]).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col(f"a._{c}") == F.col(f"b._{c}") for c in names]
    joined = probes.join(targets, on, "left")
    return joined.groupBy(*[F.col(f"a.{c}").alias(c) for c in cells.columns]).agg(F.count_if(counted).alias("neighbours"))


def nearest_other(pts: DataFrame, group: str, size: float) -> DataFrame:
    """Distance of each point to the nearest other one of its group, if that is within one cell's size.

    Each point probes its 27 cells. Where the spacing is unknown, take a size of at least the largest distance sought.
    """
    celled = with_cells(pts.select(group, "point_id", "x", "y", "z"), size)
    around = F.sequence(F.lit(-1), F.lit(1))
    probes = celled
    for c in CELL:
        probes = probes.withColumn(f"p{c}", F.explode(around)).withColumn(f"p{c}", F.col(c) + F.col(f"p{c}"))
    a, b = probes.alias("a"), celled.alias("b")
    on = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.point_id") != F.col("b.point_id"))
    for c in CELL:
        on = on & (F.col(f"a.p{c}") == F.col(f"b.{c}"))
    gap = G.norm(G.sub(xyz("a."), xyz("b.")))
    return a.join(b, on).where(gap <= size).groupBy(F.col(f"a.{group}").alias(group), F.col("a.point_id").alias("point_id")).agg(F.min(gap).alias("spacing"))


# --- rays -----------------------------------------------------------------------------------------------------------


def rays(pts: DataFrame, origins: DataFrame, least: float = 0.01, most2: float = 40000.0) -> DataFrame:
    """Rays from the origin of a point's frame to the point: finite, and with a squared length between the bounds."""
    joined = pts.join(origins, "frame")
    step = G.sub(xyz(), [F.col(c) for c in ("ox", "oy", "oz")])
    d2 = G.dot(step, step)
    return joined.where(G.finite(*xyz(), *[F.col(c) for c in ("ox", "oy", "oz")]) & d2.between(least, most2)).withColumn("distance", F.sqrt(d2))


def clipped_rays(found: DataFrame, low: Sequence[float], high: Sequence[float], margin: float = 0.06) -> DataFrame:
    """Rays that meet the box grown by the margin, where on them the box itself begins, and whether the end is inside."""
    o, e = [F.col(c) for c in ("ox", "oy", "oz")], xyz()
    hits, _, _ = G.segment_box(o, e, [v - margin for v in low], [v + margin for v in high])
    core, entry, _ = G.segment_box(o, e, low, high)
    start = F.when(core, F.greatest(entry, d(0)) * F.col("distance"))
    return found.where(hits).withColumns({"start_distance": start, "endpoint_inside": G.in_box(e, low, high)})


def crossed(o: np.ndarray, p: np.ndarray, distance: np.ndarray, size: float, least: float, most: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(ray, cell) of the voxels that rays from o to p cross, in the order of the rays."""
    with np.errstate(divide="ignore", invalid="ignore"):
        u, t1 = (p - o) / distance[:, None], np.minimum(distance - margin, most)
    rays = np.flatnonzero(t1 > least)
    o, u, t1 = o[rays], u[rays], t1[rays]
    number, t = [np.tile(np.arange(len(rays)), 2)], [np.repeat(float(least), len(rays)), t1]
    for a, b in zip(o.T, u.T, strict=True):
        first, last = (np.floor((a + b * end) / size).astype(np.int64) for end in (least, t1))
        many = np.abs(last - first)
        ray = np.repeat(np.arange(len(rays)), many)
        plane = np.repeat(np.minimum(first, last) + 1 - (np.cumsum(many) - many), many) + np.arange(len(ray))
        at = (plane * size - a[ray]) / b[ray]
        kept = (at >= least) & (at <= t1[ray])
        number.append(ray[kept])
        t.append(at[kept])
    number, t = np.concatenate(number), np.concatenate(t)
    order = np.lexsort((t, number))
    number, t = number[order], t[order]
    piece = np.flatnonzero((number[1:] == number[:-1]) & (t[1:] != t[:-1]))
    ray, middle = number[piece], (t[piece] + t[piece + 1]) / 2
    return rays[ray], np.floor((o[ray] + u[ray] * middle[:, None]) / size).astype(np.int64)


_ENDS = ["ox", "oy", "oz", "x", "y", "z", "distance"]


def _crossed_in(batch: pa.RecordBatch, *how: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first ray, ray, cell) for pieces of a batch, so that a task holds the cells of few rays at a time."""
    ends = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _ENDS], -1).astype(float)
    for at in range(0, len(ends), 4096):
        some = ends[at : at + 4096]
        yield at, *crossed(some[:, :3], some[:, 3:6], some[:, 6], *how)


def ray_cells(found: DataFrame, size: float, least: float = 0.1, most: float = 30.0, margin: float = 0.06) -> DataFrame:
    """(ray, cell) for each voxel that a ray crosses between `least` and min(distance - margin, most) of its length.

    Closed form: the lengths at which the ray crosses a voxel plane of any axis, sorted, cut it into pieces, and the
    middle of a piece names its voxel. The number of rows follows from the length of the rays. All columns of rays go along,
    so select few.
    """
    names = [*found.columns, *CELL]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ray, cell in _crossed_in(batch, size, least, most, margin):
                own = batch.take(pa.array(ray + at))
                yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c) for c in cell.T]], names=names)

    return found.mapInArrow(run, StructType([*found.schema.fields, *[StructField(c, LongType()) for c in CELL]]))


def crossings(found: DataFrame, size: float, least: float = 0.1, most: float = 30.0, margin: float = 0.06) -> DataFrame:
    """(ox, oy, oz, cell, n): how many rays from an origin cross a voxel. Counted in each piece of a batch first, so rows are
    not one a ray and voxel."""
    origin = _ENDS[:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ray, cell in _crossed_in(batch, size, least, most, margin):
                own = batch.select(origin).take(pa.array(ray + at))
                all_ = pa.Table.from_arrays([*own.columns, *[pa.array(c) for c in cell.T]], names=[*origin, *CELL])
                yield from all_.group_by([*origin, *CELL]).aggregate([([], "count_all")]).select([*origin, *CELL, "count_all"]).rename_columns([*origin, *CELL, "n"]).to_batches()

    schema = ", ".join([*[f"{c} double" for c in origin], *[f"{c} long" for c in CELL], "n long"])
    counted = found.select(*[F.col(c).cast("double").alias(c) for c in _ENDS]).mapInArrow(run, schema)
    return counted.groupBy(*origin, *CELL).agg(F.sum("n").alias("n"))


def ray_evidence(found: DataFrame, size: float, reference: float = 30.0, free: float = 0.1) -> DataFrame:
    """Score of each occupied voxel: rays that cross it speak against it, in inverse proportion to their distance from
    the origin; rays that end in it speak for it."""
    ends = with_cells(found, size).groupBy(*CELL).agg(F.count_if(F.col("distance") <= reference).alias("n"))
    centre = [(F.col(c) + 0.5) * size for c in CELL]
    away = G.norm(G.sub(centre, [F.col(c) for c in ("ox", "oy", "oz")]))
    crossing = crossings(found, size).join(ends.select(*CELL), CELL).select(*CELL, (free * reference / (away + reference) * F.col("n")).alias("e"))
    final = ends.where("n > 0").select(*CELL, (-F.col("n")).cast("double").alias("e"))
    return crossing.unionByName(final).groupBy(*CELL).agg(F.sum("e").alias("score"))


def classified(pts: DataFrame, scores: DataFrame, size: float, above: float = 0.2, dead: float = 1e-6) -> DataFrame:
    """Points with the score of their voxel (0 without one) and whether it makes them noise."""
    joined = with_cells(pts, size).join(scores, CELL, "left")
    score = F.coalesce("score", d(0))
    return joined.withColumn("score", score).withColumn("noise", (F.abs(score) >= dead) & (score > above))


# --- quality --------------------------------------------------------------------------------------------------------


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): how many rows break each rule; a rule that comes out null is broken."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules]))
    return counts.select(pairs.alias("p")).select("p.*")
