"""Sources, sinks, runs and streams."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweave.plans import colorize, manifest
from terraweave.functions import camera as C
from terraweave.functions.geometry import d
from terraweave.sources import bag, records, tables
from terraweave.streaming import odometry, progress


@pytest.fixture(scope="module")
def cloud(spark):
    records.register(spark)
    bag.register(spark)
    return spark.range(1000).select((F.col("id") / 7).alias("x"), (F.col("id") % 13 - 5.0).alias("y"), (F.col("id") % 3).cast("double").alias("z"), (F.col("id") % 100).cast("int").alias("intensity"), *[((F.col("id") * k) % 256).cast("int").alias(c) for k, c in ((1, "red"), (3, "green"), (5, "blue"))])


@pytest.mark.parametrize("fmt", ["ply", "pcd", "las"])
def test_round_trip(spark, cloud, tmp_path, fmt):
    path = str(tmp_path / "cloud")
    cloud.repartition(3).write.format(fmt).mode("append").option("path", path).save()
    assert len(os.listdir(path)) == 3
    back = spark.read.format(fmt).option("records", 100).load(path)
    tolerance = 6e-5 if fmt == "las" else 0
    a, b = (f.select("x", "y", "z", "intensity", "red", "green", "blue").toPandas().sort_values(["x", "y", "z"]).to_numpy(float) for f in (cloud, back))
    assert a.shape == b.shape and np.abs(a - b).max() <= tolerance
    with pytest.raises(Exception):
        cloud.write.format(fmt).mode("append").option("path", path).save()


def test_records_behind_a_header(spark, cloud, tmp_path):
    path = str(tmp_path / "frames")
    some = cloud.select("x", F.col("intensity").cast("smallint").alias("intensity"))
    how = {"path": path, "header": 160, "magic": "FRAME01", "suffix": ""}
    some.repartition(2).write.format("records").mode("append").options(**how).save()
    back = spark.read.format("records").options(**how, fields="x:f8,intensity:u2", records=100).load()
    assert back.dtypes == [("x", "double"), ("intensity", "int")]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, some.collect()))
    with pytest.raises(Exception):
        spark.read.format("records").options(**how | {"magic": "OTHER"}, fields="x:f8,intensity:u2").load().count()


def test_bad_files_are_refused(spark, cloud, tmp_path):
    def ply(head, body=b""):
        (tmp_path / "bad.ply").write_bytes(head + body)
        return str(tmp_path / "bad.ply")

    for head in (b"ply\nformat ascii 1.0\nelement vertex 0\nproperty float x\nend_header\n", b"ply\nformat binary_little_endian 1.0\nelement face 0\nend_header\n", b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n", b"nothing"):
        with pytest.raises(Exception):
            spark.read.format("ply").load(ply(head)).count()


def test_coloured_sink(spark, cloud, tmp_path):
    some = cloud.withColumn("red", F.when(F.col("red") < 10, F.col("red")))
    tables.write_coloured(some, str(tmp_path / "a"), drop_uncoloured=True)
    tables.write_coloured(some, str(tmp_path / "b"))
    n = some.where("red IS NOT NULL").count()
    assert spark.read.format("ply").load(str(tmp_path / "a")).count() == n and spark.read.format("ply").load(str(tmp_path / "b")).where("red = 184").count() >= 1000 - n
    with pytest.raises(ValueError):
        tables.write_coloured(some.where("x < 0"), str(tmp_path / "c"))


def record(head, data):
    h = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k + b"=" + v for k, v in head.items())
    return struct.pack("<I", len(h)) + h + struct.pack("<I", len(data)) + data


def test_bag(spark, cloud, tmp_path):
    points = np.zeros(5, bag.RETURN)
    points["x"], points["offset_ns"], points["tag"] = np.arange(5), np.arange(5) * 10, 3
    lidar = struct.pack("<4I", 1, 10, 20, 3) + b"lid" + struct.pack("<QI", 10_000_000_020, 5) + b"\0" * 4 + struct.pack("<I", 5) + points.tobytes()
    imu = struct.pack("<4I", 1, 10, 50, 0) + struct.pack("<37d", *range(37))
    conns = [record({b"op": b"\7", b"conn": struct.pack("<I", k), b"topic": t}, record({}, b"")[8:] + struct.pack("<I", 6) + b"type=x") for k, t in ((0, b"/lidar"), (1, b"/imu"))]
    chunk = b"".join([*conns, *[record({b"op": b"\2", b"conn": struct.pack("<I", k), b"time": struct.pack("<2I", 10, t)}, data) for k, t, data in ((0, 1, lidar), (1, 2, imu), (1, 3, imu))]])
    (tmp_path / "a.bag").write_bytes(bag.MAGIC + record({b"op": b"\3"}, b" ") + record({b"op": b"\5", b"compression": b"none"}, chunk) + b"".join(conns))
    m = spark.read.format("bag").load(str(tmp_path / "a.bag"))
    assert {r["topic"]: r["count"] for r in m.groupBy("topic").count().collect()} == {"/lidar": 1, "/imu": 2}
    r = bag.lidar_returns(m.where("topic = '/lidar'")).orderBy("sample").toPandas()
    assert r.x.tolist() == [0, 1, 2, 3, 4] and r.offset_ns.tolist() == [0, 10, 20, 30, 40] and set(r.tag) == {3} and set(r.header_ns) == {10_000_000_020}
    i = bag.imu_samples(m.where("topic = '/imu'")).first()
    assert (i.t_ns, i.wx, i.ax) == (10_000_000_050, 13, 25)


def test_text_tables(spark, tmp_path):
    (tmp_path / "poses.txt").write_text("# origin 5\n0 0.0 1 2 3 0 0 0 1\n1 0.1 2 2 3 0 0 0 1\n1 0.1 9 2 3 0 0 0 1\nbad line\n")
    p = tables.read_poses(spark, str(tmp_path / "poses.txt")).orderBy("frame").collect()
    assert [(r["frame"], r["x"]) for r in p] == [(0, 1), (1, 9)]
    (tmp_path / "states.txt").write_text("STATE 1\n0 0.5 3 " + " ".join(map(str, range(19))) + "\n")
    s = tables.read_states(spark, str(tmp_path / "states.txt")).first()
    assert s.pos == [0, 1, 2] and s.quat == [3, 4, 5, 6] and s.vel is None
    assert tables.read_calibration("a: [1, 2.5]\nu0: 79.5\n") == {"a": [1, 2.5], "u0": [79.5]}
    (tmp_path / "frames.json").write_text('{"format": 1, "frames": [{"camera": "l", "image": "a/1.jpg", "timestamp": 1, "centre": [0,0,0], "rotation": [1,0,0,0,1,0,0,0,1]}, {"camera": "l", "image": "b/1.png", "timestamp": 2, "centre": [0,0,0], "rotation": [2,0,0,0,1,0,0,0,1]}]}')
    v = tables.camera_frame_violations(tables.read_camera_frames(spark, str(tmp_path / "frames.json")))
    assert {r["rule"]: r["rows"] for r in v.collect()} == {"rotation": 1, "unique_image": 2}


def test_runs_skip_what_is_done_and_refuse_other_inputs(spark, tmp_path):
    made = []

    def build(_):
        made.append(1)
        return spark.range(5)

    folder = str(tmp_path / "run")
    for options in ({"size": 1, "workers": 2}, {"size": 1, "workers": 9}):
        run = manifest.Run(spark, folder, options, {"scan": 3})
        assert manifest.run_stages(run, [("a", build), ("b", lambda t: t["a"].where("id > 2"))])["b"].count() == 2
    assert len(made) == 1 and run.cached == ["a", "b"]
    with pytest.raises(ValueError):
        manifest.run_stages(manifest.Run(spark, folder, {"size": 2}, {"scan": 3}), [("a", build)])


def test_colorize(spark):
    camera = C.Camera(64, 48, 18, 0, 18, 32, 24, 1.5, (0, 0, 0, 0, 0, 0))
    pts = spark.range(200).select(F.col("id").alias("point_id"), ((F.col("id") % 20) / 20.0 - 0.5).alias("x"), (F.floor(F.col("id") / 20) / 10.0 - 0.5).alias("y"), d(2).alias("z"), d(0).alias("nx"), d(0).alias("ny"), d(-1).alias("nz"))
    photos = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.1, 0.0, 0.0)], "photo long, px double, py double, pz double")
    grid = spark.range(2).select(F.col("id").alias("photo"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(47))))
    pixels = grid.select("photo", "x", "y", *[(F.lit(v) + F.col("photo") * 10).cast("int").alias(c) for v, c in ((100, "r"), (120, "g"), (140, "b"))])
    out = colorize.colorize(pts, photos, pixels, None, camera, 2).toPandas()
    assert len(out) == 200 and out.red.notna().mean() > 0.5
    seen = out[out.red.notna()]
    assert seen.red.between(100 * 257, 111 * 257).all() and seen.red.max() - seen.red.min() < 2 * 257


def test_odometry_follows_a_moving_sensor(spark):
    rng = np.random.default_rng(1)
    walls = np.concatenate([np.stack([rng.uniform(-5, 5, 900), rng.uniform(-5, 5, 900), np.full(900, -2.0)], -1), np.stack([np.full(900, 6.0), rng.uniform(-5, 5, 900), rng.uniform(-2, 2, 900)], -1), np.stack([rng.uniform(-5, 5, 900), np.full(900, 6.0), rng.uniform(-2, 2, 900)], -1)])
    rows = [(1, f, k, *map(float, p - np.array([0.1 * f, 0.05 * f, 0.0]))) for f in range(6) for k, p in enumerate(walls)]
    scans = spark.createDataFrame(rows, "recording long, frame long, sample long, x double, y double, z double")
    poses = odometry.table(scans).orderBy("frame").toPandas()
    assert np.abs(poses[["tx", "ty", "tz"]].to_numpy() - np.array([[0.1 * f, 0.05 * f, 0] for f in range(6)])).max() < 0.03


def test_state_survives(spark):
    s = odometry.State()
    odometry.register(s, np.random.default_rng(0).uniform(-3, 3, (300, 3)))
    t = odometry.State.load(s.dump())
    assert (t.map == s.map).all() and len(t.map)


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.json").write_text('{"ts": 1, "stage": "a", "done": 1, "total": 5}\n{"ts": 2, "stage": "a", "done": 4, "total": 5, "other": 1}\nnot json\n{"ts": 1, "stage": "b", "done": 2, "total": 2}\n')
    events = tables.read_events(spark, str(src), stream=True)
    q = progress.latest(events).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    assert q.awaitTermination(90)
    assert {r["stage"]: r["done"] for r in spark.table("latest").collect()} == {"a": 4, "b": 2}
    timed = events.withColumn("at", F.timestamp_seconds("ts"))
    q = progress.once(timed, "at", ["stage"]).writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start(out)
    assert q.awaitTermination(90) and spark.read.parquet(out).count() == 2
