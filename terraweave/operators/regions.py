"""Regions: boxes with polygon tests, unions of regions, slice trees, previews."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.functions import geometry as G
from terraweave.functions.geometry import d, xyz


@dataclass(frozen=True)
class Outline:
    """A polygon test: inside it, or (ring) outside but within `expand` of an edge."""

    vertices: Sequence[tuple[float, float]]
    ring: bool = False
    expand: float = 0.0

    def test(self, x: Column, y: Column) -> Column:
        inside = G.inside_outline(x, y, self.vertices)
        return ~inside & (G.distance_to_outline(x, y, self.vertices) <= self.expand) if self.ring else inside


@dataclass(frozen=True)
class Region:
    """A closed box, null for open ends, and outlines that all have to hold."""

    low: Sequence[float | None]
    high: Sequence[float | None]
    outlines: Sequence[Outline] = field(default=())

    def test(self, p: Sequence[Column]) -> Column:
        low = [float("-inf") if v is None else v for v in self.low]
        high = [float("inf") if v is None else v for v in self.high]
        out = G.in_box(p, [d(v) for v in low], [d(v) for v in high])
        for o in self.outlines:
            out = out & o.test(p[0], p[1])
        return out


def in_regions(regions: Sequence[Region], p: Sequence[Column] | None = None) -> Column:
    """Whether a point is in any of the regions."""
    p = p or xyz()
    out = F.lit(False)
    for r in regions:
        out = out | r.test(p)
    return out


def select_regions(pts: DataFrame, regions: Sequence[Region]) -> DataFrame:
    """Each point once that is in a region; boxes reach the scan as filters."""
    return pts.where(in_regions(regions))


def semi_join_regions(pts: DataFrame, regions: DataFrame) -> DataFrame:
    """The same for a table of boxes (x0, x1, y0, y1): a semi-join on 1-unit cells that a box covers, then the test."""
    cells = regions.withColumn("cx", F.explode(F.sequence(F.floor("x0"), F.floor("x1")))).withColumn("cy", F.explode(F.sequence(F.floor("y0"), F.floor("y1"))))
    p, r = pts.withColumns({"cx": F.floor("x"), "cy": F.floor("y")}).alias("p"), cells.alias("r")
    inside = F.col("p.x").between(F.col("r.x0"), F.col("r.x1")) & F.col("p.y").between(F.col("r.y0"), F.col("r.y1"))
    return p.join(r, (F.col("p.cx") == F.col("r.cx")) & (F.col("p.cy") == F.col("r.cy")) & inside, "left_semi").drop("cx", "cy")


def effective_boxes(slices: DataFrame, depth: int = 64) -> DataFrame:
    """Each slice with its box cut by those of all its ancestors, empty boxes as null, and its level."""
    slices.createOrReplaceTempView("_slices")
    return slices.sparkSession.sql(f"""
      WITH RECURSIVE up (id, parent, x0, x1, level) AS (
        SELECT id, parent, x0, x1, 0 FROM _slices WHERE parent IS NULL
        UNION ALL
        SELECT s.id, s.parent, greatest(s.x0, up.x0), least(s.x1, up.x1), up.level + 1 FROM _slices s JOIN up ON s.parent = up.id WHERE up.level < {depth})
      SELECT id, level, CASE WHEN x0 <= x1 THEN x0 END AS x0, CASE WHEN x0 <= x1 THEN x1 END AS x1 FROM up""")


def descendants(slices: DataFrame, root: int, depth: int = 64) -> DataFrame:
    slices.createOrReplaceTempView("_slices")
    return slices.sparkSession.sql(f"""
      WITH RECURSIVE down (id, level) AS (
        SELECT id, 0 FROM _slices WHERE id = {int(root)}
        UNION ALL
        SELECT s.id, down.level + 1 FROM _slices s JOIN down ON s.parent = down.id WHERE down.level < {depth})
      SELECT id, level FROM down""")


def systematic_sample(pts: DataFrame, budget: int) -> DataFrame:
    """Points of pts(point_id, ...), at most `budget` and about as many, the same in every run: those of the smallest hashes.

    Ids of any pattern do. Points are counted for each of 65536 beginnings of the MD5 of their ids, and as many beginnings are
    kept as the budget holds; all points, where they are no more than it.
    """
    hashed = pts.withColumn("_h", F.substring(F.md5(F.col("point_id").cast("string")), 1, 4))
    counts = hashed.groupBy("_h").agg(F.count("*").alias("n"))  # 65536 rows at most
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("_h")))
    return hashed.join(F.broadcast(upto.where(F.col("upto") <= budget).select("_h")), "_h", "left_semi").drop("_h")


def moved(p: Sequence[Column], matrix: Sequence[Sequence[Column]], origin: Sequence[float], shift: Sequence[float]) -> list[Column]:
    """Rotation about an origin, then a shift."""
    o = [d(v) for v in origin]
    return G.add(G.add(G.rotate(matrix, G.sub(p, o)), o), [d(v) for v in shift])


def bounds_under(pts: DataFrame, mask: Column) -> DataFrame:
    return pts.where(mask).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in enumerate((F.min, F.max))])
