"""Commands: inspect a recording, estimate a run, colour a cloud, make a preview, export regions.

    python -m terraweave.cli inspect RECORDING.bag
    python -m terraweave.cli colorize --geometry G --photos P --pixels X --output DIR [--masks M] [--camera JSON]
    python -m terraweave.cli preview --source CLOUD --output DIR --budget 1000000
    python -m terraweave.cli export-slices SPEC.json
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.functions import camera as C
from terraweave.operators import jobs as J
from terraweave.operators import regions as R
from terraweave.plans import colorize, manifest
from terraweave.session import local_session
from terraweave.sources import bag, records


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by its kind: a folder or file of PLY, PCD or LAS by name, else Parquet."""
    for fmt in ("ply", "pcd", "las"):
        if path.lower().rstrip("/").endswith((f".{fmt}", f"_{fmt}")):
            return spark.read.format(fmt).load(path)
    return spark.read.parquet(path)


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """Messages, bytes and time span of each topic."""
    m = spark.read.format("bag").load(path)
    return m.groupBy("topic", "type").agg(F.count("*").alias("messages"), F.sum(F.octet_length("data")).alias("bytes"), ((F.max("bag_ns") - F.min("bag_ns")) / 1e9).alias("seconds"))


def preview(spark: SparkSession, source: str, output: str, budget: int) -> int:
    """Positions relative to the middle of the bounds, and colours of 8 bits, of at most about `budget` points."""
    pts = load(spark, source)
    if "point_id" not in pts.columns:
        pts = pts.withColumn("point_id", F.abs(F.xxhash64("x", "y", "z")))
    middle = pts.agg(*[((F.min(c) + F.max(c)) / 2).alias(f"m{c}") for c in "xyz"])
    colours = [F.coalesce(F.rint(F.col(c) / 257.0).cast("int"), F.lit(184)).alias(c) if c in pts.columns else F.lit(184).alias(c) for c in ("red", "green", "blue")]
    kept = R.systematic_sample(pts, budget).crossJoin(F.broadcast(middle))  # one row
    kept.select("point_id", *[(F.col(c) - F.col(f"m{c}")).cast("float").alias(c) for c in "xyz"], *colours).write.parquet(output)
    return spark.read.parquet(output).count()


def region(spec: dict) -> R.Region:
    outlines = [R.Outline([tuple(v) for v in o["vertices"]], o.get("mode") == "ring", float(o.get("expand", 0))) for o in spec.get("outlines", ())]
    return R.Region(spec.get("low", [None] * 3), spec.get("high", [None] * 3), outlines)


def export_slices(spark: SparkSession, spec: dict) -> int:
    """Points of each source that lie in any of its regions, after its transform; nothing left is an error. Sources are
    not compared with each other."""
    parts = []
    for s in spec["sources"]:
        pts = load(spark, s["path"])
        if t := s.get("transform"):
            from terraweave.functions.geometry import d, euler_matrix, xyz

            moved = R.moved(xyz(), euler_matrix(*[d(v) for v in t.get("rotation", (0, 0, 0))]), t.get("origin", (0, 0, 0)), t.get("shift", (0, 0, 0)))
            pts = pts.withColumns(dict(zip("xyz", moved, strict=True)))
        for c in ("red", "green", "blue"):
            pts = pts.withColumn(c, F.col(c).cast("int") if c in pts.columns else F.lit(47000))
        parts.append(R.select_regions(pts, [region(r) for r in s["regions"]]).select(*[F.col(c).cast("double") for c in "xyz"], "red", "green", "blue"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if out.isEmpty():
        raise ValueError("no point is in the regions")
    out.write.format("las").mode("append").option("path", spec["output"]).save()
    return out.count()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="terraweave", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("inspect").add_argument("recording")
    e = sub.add_parser("estimate")
    e.add_argument("--photos", type=int, required=True)
    e.add_argument("--points", type=int, required=True)
    e.add_argument("--percent", type=int, default=0)
    c = sub.add_parser("colorize")
    for name in ("geometry", "photos", "pixels", "output"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--masks")
    c.add_argument("--camera")
    c.add_argument("--drop-uncolored", action="store_true")
    c.add_argument("--profile", choices=sorted(manifest.PROFILES), default="balanced")
    v = sub.add_parser("preview")
    v.add_argument("--source", required=True)
    v.add_argument("--output", required=True)
    v.add_argument("--budget", type=int, default=1_000_000)
    sub.add_parser("export-slices").add_argument("spec")
    a = p.parse_args(argv)
    if a.command == "estimate":
        kept = J.keyframe_budget(a.photos, a.percent)
        print(json.dumps({"candidate_bytes": 128 * a.points, "pairs": a.points * a.photos, "keyframes": kept, "speedup": round(1 / (0.31 + 0.69 * kept / max(1, a.photos)), 2)}))
        return 0
    spark = spark or local_session()
    records.register(spark)
    bag.register(spark)
    if a.command == "inspect":
        inspect(spark, a.recording).orderBy("topic").show(truncate=False)
    elif a.command == "preview":
        if not 10_000 <= a.budget <= 60_000_000:
            p.error("the budget is between 10000 and 60000000")
        print(json.dumps({"points": preview(spark, a.source, a.output, a.budget)}))
    elif a.command == "export-slices":
        with open(a.spec) as f:
            print(json.dumps({"points": export_slices(spark, json.load(f))}))
    else:
        for k, value in manifest.PROFILES[a.profile].items():
            spark.conf.set(k, value)
        camera = C.Camera(**json.loads(a.camera)) if a.camera else C.Camera()
        photos = spark.read.parquet(a.photos)
        count = int(photos.agg(F.max("photo")).first()[0]) + 1
        run = manifest.Run(spark, a.output, {"camera": a.camera, "drop": a.drop_uncolored}, {k: getattr(a, k) for k in ("geometry", "photos", "pixels", "masks")})
        masks = spark.read.parquet(a.masks) if a.masks else None
        views = run.stage("candidates", lambda: colorize.candidates(load(spark, a.geometry), photos, spark.read.parquet(a.pixels), masks, camera))
        field = run.stage("global", lambda: colorize.exposure(views, count))
        colours = run.stage("blend", lambda: colorize.blended(views, field))
        how = "inner" if a.drop_uncolored else "left"
        out = run.stage("export", lambda: load(spark, a.geometry).join(colours, "point_id", how))
        print(json.dumps(dict(zip(("points", "colored_points", "blended_points"), out.agg(F.count("*"), F.count("red"), F.count_if("blended")).first(), strict=True)) | {"cached": run.cached}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
