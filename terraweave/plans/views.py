"""Point clouds, photos, poses and series as views of the input tables: once as DataFrames, once as SQL.

Every view but photos is a projection or a filter of one table, so that filters and columns reach the scan; photos are
grouped, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.functions.geometry import d
from terraweave.session import spread, table

#: Nations, by whose number photos are counted: a dimension that is the same at every scale.
PHOTOS = 25


def points(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """point_id, x, y, z, nx, ny, nz, frame, t_us, intensity, tag, r, g, b: one point a line item.

    point_id is 60 bits of a hash of the columns that identify a line item, so no global order is needed. more: columns of
    the line item that go along.
    """
    cents = F.rint(F.col("l_extendedprice") * 100).cast("long")
    key = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents.cast("string"))
    n = [((F.col("l_partkey") % 7) - 3).cast("double"), ((F.col("l_suppkey") % 5) - 2).cast("double"), -(1.0 + F.col("l_orderkey") % 3)]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return spread(items).select(
        F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("point_id"),
        (F.col("l_quantity") / 10.0).alias("x"),
        (F.col("l_extendedprice") / 20000.0).alias("y"),
        ((F.col("l_discount") + F.col("l_tax")) * 20.0).alias("z"),
        *[(v / size).alias(c) for v, c in zip(n, ("nx", "ny", "nz"), strict=True)],
        F.col("l_linenumber").cast("long").alias("frame"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t_us"),
        (F.col("l_quantity") * 4).cast("int").alias("intensity"),
        (F.col("l_partkey") % 64).cast("int").alias("tag"),
        *[((F.col(c) * k) % 256).cast("int").alias(n_) for c, k, n_ in (("l_partkey", 7, "r"), ("l_suppkey", 11, "g"), ("l_orderkey", 13, "b"))],
        *more,
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, frame, sample, x, y, z: the points as scans; a recording has the items of twenty suppliers, so there are
    more of them with more data."""
    key = F.floor(F.col("l_suppkey") / 20).cast("long")
    found = points(spark, sf_dir, key.alias("recording"))
    return found.select("recording", "frame", F.col("point_id").alias("sample"), "x", "y", "z")


POINTS = """pts AS (SELECT ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round_even(l_extendedprice * 100, 0) AS BIGINT))), 1, 15))::BIGINT AS point_id,
  l_quantity / 10.0::DOUBLE AS x, l_extendedprice / 20000.0::DOUBLE AS y, (l_discount + l_tax) * 20.0::DOUBLE AS z,
  ((l_partkey % 7) - 3)::DOUBLE / sqrt(((l_partkey % 7) - 3)::DOUBLE ** 2 + ((l_suppkey % 5) - 2)::DOUBLE ** 2 + (1.0 + l_orderkey % 3)::DOUBLE ** 2) AS nx,
  ((l_suppkey % 5) - 2)::DOUBLE / sqrt(((l_partkey % 7) - 3)::DOUBLE ** 2 + ((l_suppkey % 5) - 2)::DOUBLE ** 2 + (1.0 + l_orderkey % 3)::DOUBLE ** 2) AS ny,
  -(1.0 + l_orderkey % 3)::DOUBLE / sqrt(((l_partkey % 7) - 3)::DOUBLE ** 2 + ((l_suppkey % 5) - 2)::DOUBLE ** 2 + (1.0 + l_orderkey % 3)::DOUBLE ** 2) AS nz,
  l_linenumber::BIGINT AS frame, epoch_us(l_shipdate) AS t_us, trunc(l_quantity * 4)::INT AS intensity, (l_partkey % 64)::INT AS tag,
  ((l_partkey * 7) % 256)::INT AS r, ((l_suppkey * 11) % 256)::INT AS g, ((l_orderkey * 13) % 256)::INT AS b FROM lineitem)"""
SCANS = "scans AS (SELECT l_suppkey // 20 AS recording, p.frame, p.point_id AS sample, p.x, p.y, p.z FROM (SELECT l_suppkey, " + POINTS[len("pts AS (SELECT ") : -1] + ") p)"


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo, px, py, pz: a camera centre below the cloud, looking up, for each nation that has a supplier.

    All suppliers are read; nations are a dimension, so there are as many photos at every scale.
    """
    nation = table(spark, sf_dir, "supplier").where("s_nationkey IS NOT NULL").groupBy("s_nationkey").agg(F.min("s_acctbal").alias("low"))
    return nation.select(F.col("s_nationkey").cast("long").alias("photo"), (F.col("s_nationkey") / 10.0).alias("px"), (F.col("low") / 4000.0).alias("py"), d(-1.0).alias("pz"))


PHOTO_SQL = "photos AS (SELECT s_nationkey::BIGINT AS photo, s_nationkey / 10.0::DOUBLE AS px, min(s_acctbal) / 4000.0::DOUBLE AS py, -1.0::DOUBLE AS pz FROM supplier WHERE s_nationkey IS NOT NULL GROUP BY s_nationkey)"


def surfels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, z, nx, ny, nz, label: a small cloud with normals, from the first six components of embeddings."""
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(6)]
    size = F.sqrt(e[3] * e[3] + e[4] * e[4] + e[5] * e[5])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), *[v.alias(c) for v, c in zip(e[:3], "xyz", strict=True)], *[(v / size).alias(c) for v, c in zip(e[3:], ("nx", "ny", "nz"), strict=True)], F.col("label").cast("long").alias("label"))


SURFELS = """ept0 AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c, label::BIGINT AS label FROM embeddings),
ept AS (SELECT point_id, x, y, z, a / sqrt(a * a + b * b + c * c) AS nx, b / sqrt(a * a + b * b + c * c) AS ny, c / sqrt(a * a + b * b + c * c) AS nz, label FROM ept0)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_us, x, y, z and a rotation about z as qz, qw, for each viewing event; recording: the stream of one user."""
    half = (F.col("value") / 100.0) / 2
    return table(spark, sf_dir, "events").where("event_type = 'view'").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), d(0).alias("z"), F.sin(half).alias("qz"), F.cos(half).alias("qw"), (F.col("user_id") % 4).alias("recording"))


POSES = "poses AS (SELECT epoch_us(ts) AS t_us, value AS x, user_id::DOUBLE AS y, 0.0::DOUBLE AS z, sin((value / 100.0::DOUBLE) / 2) AS qz, cos((value / 100.0::DOUBLE) / 2) AS qw, user_id % 4 AS recording FROM events WHERE event_type = 'view')"


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shot, t_us, recording: times of photos."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("shot"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), (F.col("user_id") % 4).alias("recording"))


SHOTS = "shots AS (SELECT event_id AS shot, epoch_us(ts) AS t_us, user_id % 4 AS recording FROM events WHERE event_type = 'purchase')"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor, t_us, rate, event_id: series of a sensor each, from the events of a user."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("sensor"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col("value").alias("rate"), "event_id", "event_type")


SAMPLES = "imu AS (SELECT user_id % 16 AS sensor, epoch_us(ts) AS t_us, value AS rate, event_id, event_type FROM events)"


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent, box: regions as roots, nations as their children, and a grandchild for each nation."""
    k = F.col("n_nationkey").cast("double")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), d(0).alias("x0"), (10.0 + F.col("r_regionkey")).alias("x1"))
    nation = table(spark, sf_dir, "nation").select((100 + F.col("n_nationkey")).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"), (k / 5 - 1).alias("x0"), (k / 3 + 4).alias("x1"))
    leaf = table(spark, sf_dir, "nation").select((200 + F.col("n_nationkey")).cast("long").alias("id"), (100 + F.col("n_nationkey")).cast("long").alias("parent"), (k / 4).alias("x0"), (k / 2 + 2).alias("x1"))
    return region.union(nation).union(leaf)


SLICES = """slices AS (SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent, 0.0::DOUBLE AS x0, (10.0 + r_regionkey)::DOUBLE AS x1 FROM region
  UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_nationkey::DOUBLE / 5 - 1, n_nationkey::DOUBLE / 3 + 4 FROM nation
  UNION ALL SELECT 200 + n_nationkey, 100 + n_nationkey, n_nationkey::DOUBLE / 4, n_nationkey::DOUBLE / 2 + 2 FROM nation)"""
