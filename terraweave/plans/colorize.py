"""From points with normals, photos and their pixels to coloured points, as stages of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.functions import camera as C
from terraweave.operators import exposure as E
from terraweave.operators import visibility as O
from terraweave.session import kept


def candidates(pts: DataFrame, photos: DataFrame, pixels: DataFrame, excluded: DataFrame | None, camera: C.Camera) -> DataFrame:
    """The best views of each point with their colours and their place on the photo's grid."""
    seen = O.visibility(O.projected(pts, photos, camera), pts).where("visible")
    views = O.top_views(O.scored(O.unmasked(seen, excluded) if excluded is not None else seen))
    kept = views.select("point_id", F.col("slot").cast("long").alias("slot"), "photo", "score", "u", "v")
    gx, gy = C.grid_coordinates(F.col("u"), F.col("v"), camera.width, camera.height)
    coloured = O.coloured(kept, O.pixel_quads(pixels)).withColumns({"gx": gx, "gy": gy})
    return coloured.select("point_id", "slot", "photo", "score", "gradient", "gx", "gy", *[F.col(f"{c}_").alias(c) for c in "rgb"])


def exposure(views: DataFrame, photos: int) -> DataFrame:
    """(photo, channel, offset): offsets that bring the photos' colours together. The unknowns are one a photo."""
    pairs = kept(E.view_pairs(views), "pairs")
    rows = []
    for c in E.CHANNELS:
        edges = pairs.select(F.col("photo_b").cast("long").alias("node_a"), F.col("photo_a").cast("long").alias("node_b"), F.col(f"d{c}").alias("value"))
        rows += [(k, c, float(v)) for k, v in enumerate(E.solve_offsets(edges, photos))]
    return views.sparkSession.createDataFrame(rows, "photo long, channel string, offset double")


def corrected(views: DataFrame, offsets: DataFrame) -> DataFrame:
    wide = offsets.groupBy("photo").pivot("channel", list(E.CHANNELS)).agg(F.first("offset"))
    renamed = wide.select("photo", *[F.col(c).alias(f"o{c}") for c in E.CHANNELS])
    return views.join(F.broadcast(renamed), "photo", "left").withColumns({c: C.clipped(F.col(c) - F.coalesce(F.col(f"o{c}"), F.lit(0.0)), 0, 255) for c in E.CHANNELS}).drop(*[f"o{c}" for c in E.CHANNELS])  # a row a photo


def blended(views: DataFrame, offsets: DataFrame) -> DataFrame:
    """Consensus colours in 16 bits of points that a photo sees."""
    mixed = E.consensus(corrected(views, offsets))
    return mixed.select("point_id", *[C.colour16(F.col(c)).alias(n) for c, n in zip(E.CHANNELS, ("red", "green", "blue"), strict=True)], "blended")


def colorize(pts: DataFrame, photos: DataFrame, pixels: DataFrame, excluded: DataFrame | None, camera: C.Camera, count: int) -> DataFrame:
    """Points with their colours; points that no photo sees have none."""
    views = kept(candidates(pts, photos, pixels, excluded, camera), "views")
    return pts.join(blended(views, exposure(views, count)), "point_id", "left")
