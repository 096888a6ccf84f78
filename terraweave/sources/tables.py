"""Text and JSON inputs: poses, state tables, calibrations, camera frames, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSE = ["frame", "t", "x", "y", "z", "qx", "qy", "qz", "qw"]


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Poses as nine columns of text, comments left out; of a frame that comes twice the later line counts.

    The place of a line is the file's name and its offset, which a text scan does not tell; so lines carry the id that
    Spark gives them in the order of the file.
    """
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    w = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(w) >= 9).select("_at", F.get(w, F.lit(0)).try_cast("long").alias("frame"), *[F.get(w, F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(POSE) if k])
    last = Window.partitionBy("frame").orderBy(F.desc("_at"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1 AND frame IS NOT NULL").select(*POSE)


def write_poses(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in POSE]).alias("value")).write.text(path)


#: Groups of a state table and the bits that say which of them are known.
STATE = {"pos": 3, "quat": 4, "vel": 3, "bg": 3, "ba": 3, "g": 3}


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """State rows of 22 numbers: frame, time, mask and the groups, each an array, null where its bit is not set. A row of
    another length is an error."""
    w = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.trim("value").rlike("^(#|$|[A-Za-z])"))
    lines = lines.withColumn("w", F.when(F.size(w) == 3 + sum(STATE.values()), w).otherwise(F.raise_error(F.lit("a state row has another number of columns"))))
    cols, at = [], 3
    mask = F.get("w", F.lit(2)).cast("int")
    for k, (name, n) in enumerate(STATE.items()):
        cols.append(F.when(mask.bitwiseAND(1 << k) != 0, F.transform(F.slice("w", at + 1, n), lambda v: v.cast("double"))).alias(name))
        at += n
    return lines.select(F.get("w", F.lit(0)).cast("long").alias("frame"), F.get("w", F.lit(1)).cast("double").alias("t"), *cols)


def read_calibration(text: str) -> dict[str, list[float]]:
    """Named lists of numbers of a calibration file such as 'name: [1, 2, 3]'; a dimension of a few rows."""
    import re

    out = {}
    for name, values in re.findall(r"([A-Za-z_]\w*)\s*:\s*\[([^\]]*)\]", text):
        out[name] = [float(v) for v in values.replace("\n", " ").split(",") if v.strip()]
    for name, value in re.findall(r"([A-Za-z_]\w*)\s*:\s*(-?[\d.]+(?:[eE][-+]?\d+)?)\s*$", text, re.M):
        out.setdefault(name, [float(value)])
    return out


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Events of runs, a JSON object a line; lines that are none are left out, unknown fields ignored."""
    schema = "ts double, stage string, kind string, done bigint, total bigint, unit string, message string"
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_camera_frames(spark: SparkSession, path: str) -> DataFrame:
    """Camera frames of a JSON document {frames: [{camera, image, timestamp, centre, rotation}]}."""
    schema = "frames array<struct<camera: string, image: string, timestamp: double, centre: array<double>, rotation: array<double>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("frames").alias("f")).select("f.*")


def camera_frame_violations(frames: DataFrame) -> DataFrame:
    """(rule, rows) of frames whose rotation is none or whose image comes twice."""
    from terraweave.operators.points import violations

    r = [F.get("rotation", F.lit(k)) for k in range(9)]
    rows = [r[0:3], r[3:6], r[6:9]]
    off = F.lit(0.0)
    for a in range(3):
        for b in range(3):
            off = F.greatest(off, F.abs(sum((x * y for x, y in zip(rows[a], rows[b], strict=True)), F.lit(0.0)) - (1.0 if a == b else 0.0)))
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    stem = F.regexp_extract("image", r"([^/]*?)(\.[^./]*)?$", 1)
    twice = F.count("*").over(Window.partitionBy("camera", stem))
    return violations(frames.withColumn("twice", twice), {"rotation": (off <= 1e-3) & (F.abs(det - 1) <= 1e-3), "unique_image": F.col("twice") == 1})


def write_coloured(df: DataFrame, path: str, fmt: str = "ply", drop_uncoloured: bool = False, fallback: tuple[int, int, int] = (184, 184, 184)) -> None:
    """Points with red, green and blue: uncoloured ones dropped or given a fallback; nothing left is an error, and
    nothing is overwritten."""
    known = F.col("red").isNotNull() & F.col("green").isNotNull() & F.col("blue").isNotNull()
    kept = df.where(known) if drop_uncoloured else df.withColumns({c: F.coalesce(F.col(c), F.lit(v)).cast("int") for c, v in zip(("red", "green", "blue"), fallback, strict=True)})
    if kept.isEmpty():
        raise ValueError("no point is left to write")
    kept.write.format(fmt).mode("append").option("path", path).save()
