"""Queries that once read a part of their input, over all of it."""

from pyspark.sql import functions as F

from terraweave.operators import points as P
from terraweave.plans import catalog, clouds
from terraweave.plans import views as V
from terraweave.streaming import odometry


def test_every_return_casts_its_ray(spark, sf):
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    pts = V.points(spark, sf)
    far = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 + (F.col("z") - F.col("oz")) ** 2) > 1e-9
    assert pts.count() == n and P.rays(pts, clouds.origins(spark)).count() == pts.join(clouds.origins(spark), "frame").where(far).count()
    assert all(" tag < " not in sql and "s_suppkey < " not in sql for sql in catalog.ORACLE.values())


def test_odometry_reads_every_return(spark, sf):
    pts = V.scans(spark, sf).toPandas()
    pts.loc[len(pts)] = [pts.recording.min(), 99, 1, 1e3, 0.0, 0.0]  # a frame out of reach still has a pose
    want = []
    for recording, rows in pts.groupby("recording"):
        want += odometry.steps(odometry.State(), rows, int(recording))
    got = sorted(map(tuple, catalog.QUERIES["t01_j19_a05_odometry"](spark, sf).collect()))
    whole = sorted(map(tuple, odometry.table(spark.createDataFrame(pts)).collect()))
    assert [r for r in whole if r[1] != 99] == got and len(whole) == len(want)
    for a, b in zip(whole, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[-1] == b[-1] and all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
