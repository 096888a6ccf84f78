"""Commands on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from terraweave import cli
from terraweave.functions.geometry import d


def test_estimate(capsys):
    assert cli.main(["estimate", "--photos", "124", "--points", "1000"]) == 0
    assert json.loads(capsys.readouterr().out) == {"candidate_bytes": 128000, "pairs": 124000, "keyframes": 40, "speedup": 1.88}


def test_export_and_preview(spark, tmp_path, capsys):
    pts = spark.range(20000).select(F.col("id").alias("point_id"), (F.col("id") % 100).cast("double").alias("x"), F.floor(F.col("id") / 100).cast("double").alias("y"), d(1).alias("z"))
    pts.write.parquet(str(tmp_path / "cloud"))
    spec = {"output": str(tmp_path / "out_las"), "sources": [{"path": str(tmp_path / "cloud"), "transform": {"shift": [1000, 0, 0]}, "regions": [{"low": [1010, None, None], "high": [1019, 9, None]}, {"outlines": [{"vertices": [[1009.5, -1], [1012.5, -1], [1012.5, 20.5], [1009.5, 20.5]]}]}]}]}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    cli.main(["export-slices", str(tmp_path / "spec.json")], spark)
    assert json.loads(capsys.readouterr().out)["points"] == 10 * 10 + 3 * 11
    assert cli.load(spark, str(tmp_path / "out_las")).agg(F.min("x")).first()[0] == pytest.approx(1010)
    cli.main(["preview", "--source", str(tmp_path / "cloud"), "--output", str(tmp_path / "preview"), "--budget", "10000"], spark)
    assert json.loads(capsys.readouterr().out)["points"] == 10000


def test_colorize_resumes(spark, tmp_path, capsys):
    grid = spark.range(100).select(F.col("id").alias("point_id"), ((F.col("id") % 10) / 10.0 - 0.5).alias("x"), (F.floor(F.col("id") / 10) / 10.0 - 0.5).alias("y"), d(2).alias("z"), d(0).alias("nx"), d(0).alias("ny"), d(-1).alias("nz"))
    grid.write.parquet(str(tmp_path / "g"))
    spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.1, 0.0, 0.0)], "photo long, px double, py double, pz double").write.parquet(str(tmp_path / "p"))
    px = spark.range(2).select(F.col("id").alias("photo"), F.explode(F.sequence(F.lit(0), F.lit(159))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(119))))
    px.select("photo", "x", "y", *[F.lit(v).alias(c) for v, c in ((100, "r"), (120, "g"), (140, "b"))]).write.parquet(str(tmp_path / "x"))
    args = ["colorize", *(f"--{n}={tmp_path / f}" for n, f in (("geometry", "g"), ("photos", "p"), ("pixels", "x"), ("output", "run")))]
    cli.main(args, spark)
    first = json.loads(capsys.readouterr().out)
    cli.main(args, spark)
    again = json.loads(capsys.readouterr().out)
    assert first["points"] == 100 and first["colored_points"] > 60 and first["cached"] == [] and again["cached"] == ["candidates", "global", "blend", "export"]
    assert {k: v for k, v in first.items() if k != "cached"} == {k: v for k, v in again.items() if k != "cached"}
