"""Choosing photos: shortlists, keyframes, rescue of points without a view, and comparison of choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.functions import camera as C
from terraweave.functions import geometry as G
from terraweave.functions.geometry import d, xyz
from terraweave.operators.points import CELL, with_cells


def geometric_scores(pts: DataFrame, photos: DataFrame, size: float) -> DataFrame:
    """(representative, n, photo, score) of each cell and photo, by geometry alone; 0 for surfaces that face away."""
    normal = ("nx", "ny", "nz")
    first = F.min(F.struct("point_id", *"xyz", *normal)).alias("p")
    cells = with_cells(pts, size).groupBy(*CELL).agg(first, F.count("*").alias("n")).select(F.col("p.point_id").alias("representative"), "n", *[f"p.{c}" for c in (*"xyz", *normal)])
    away = G.sub(xyz(), [F.col(c) for c in ("px", "py", "pz")])
    dist, theta = G.norm(away), F.atan2(F.sqrt(away[0] * away[0] + away[1] * away[1]), away[2])
    facing = -G.dot([F.col(c) for c in normal], away) / dist
    score = F.when(facing > 0.05, C.view_score(theta, dist, facing)).otherwise(d(0))
    return cells.crossJoin(F.broadcast(photos)).select("representative", "n", "photo", score.alias("score"))


def shortlist(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("representative").orderBy(F.desc("score"), "photo")
    return scores.where("score > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def keyframes(scores: DataFrame, count: int, second: float = 0.35, most: int = 64) -> DataFrame:
    """Greedy coverage: step by step the photo that adds most to the weighted sum of each cell's best score and `second`
    times its second best; ties to the smaller photo. One aggregation a step, and count steps.

    The photos chosen so far travel as a literal list; each cell's scores are an array of at most as many as photos.
    """
    per_cell = scores.groupBy("representative").agg(F.sqrt(F.least(F.max("n"), F.lit(most)).cast("double")).alias("w"), F.map_from_entries(F.collect_list(F.struct("photo", "score"))).alias("by")).cache()
    photos = [r["photo"] for r in scores.select("photo").distinct().orderBy("photo").collect()]
    chosen: list[tuple[int, int, float]] = []
    for step in range(min(count, len(photos))):
        known = [p for p, _, _ in chosen]

        def value(extra: int, known: list[int] = known) -> Column:
            held = F.array_sort(F.array(*[F.coalesce(F.element_at("by", F.lit(p)), d(0)) for p in (*known, extra)]))
            return F.element_at(held, -1) + (second * F.element_at(held, -2) if known else d(0))

        gains = per_cell.agg(*[F.sum(F.col("w") * value(p)).alias(str(p)) for p in photos if p not in known]).first()
        best = max((p for p in photos if p not in known), key=lambda p: (gains[str(p)] or 0.0, -p))
        chosen.append((best, step, float(gains[str(best)] or 0.0)))
    per_cell.unpersist()
    return scores.sparkSession.createDataFrame(chosen, "photo long, step int, value double")


def rescued(kept: DataFrame, spare: DataFrame) -> DataFrame:
    """kept, and for representatives without any the best of spare."""
    none = spare.join(kept.select("representative").distinct(), "representative", "left_anti")
    best = none.groupBy("representative").agg(F.min_by("photo", F.struct(-F.col("score"), F.col("photo"))).alias("photo"))
    return kept.select("representative", "photo").withColumn("rescued", F.lit(False)).unionByName(best.withColumn("rescued", F.lit(True)))


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """How the (point_id, photo) of two choices overlap, and on how many points both have a first view."""
    left, right = a.select("point_id", "photo"), b.select("point_id", "photo")
    both = left.withColumn("a", F.lit(1)).join(right.withColumn("b", F.lit(1)), ["point_id", "photo"], "full")
    counts = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count_if(F.col("b").isNull()).alias("lost"), F.count_if(F.col("a").isNull()).alias("gained"))
    tops = a.where("slot = 0").select("point_id").join(b.where("slot = 0").select("point_id"), "point_id").agg(F.count("*").alias("same_top"))
    return counts.crossJoin(tops)
