"""Files of one frame each, exports in pairs, permutations and comparisons by place."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraweave.functions import geometry as G
from terraweave.functions.geometry import d
from terraweave.operators import jobs as J
from terraweave.sources import frames as S
from terraweave.sources import records


def scan(path, points, extra=()):
    fields = [("x", "f4"), ("y", "f4"), ("z", "f4"), ("intensity", "f4"), *extra]
    raw = np.zeros(len(points), np.dtype([(n, f"<{t}") for n, t in fields]))
    for k, n in enumerate("xyz"):
        raw[n] = [p[k] for p in points]
    path.write_bytes(records.pcd_header(fields, len(raw)) + raw.tobytes())


def poses(spark, numbers):
    half = 0.5**0.5
    rows = [(n, float(n), 1.0 * n, 0.0, 0.0, 0.0, 0.0, 2 * half, 2 * half) for n in numbers]  # a quarter turn, not of length 1
    return spark.createDataFrame(rows, "frame long, t double, x double, y double, z double, qx double, qy double, qz double, qw double")


def test_registered_clouds_and_their_ranges(spark, tmp_path):
    for n in (2, 10, 30):
        scan(tmp_path / f"{n}.pcd", [(1.0, 0.0, 5.0), (float("nan"), 0, 0), (2.0, 1.0, 0.0)])
    (tmp_path / "notes.pcd").write_bytes(b"no scan")
    (tmp_path / "40.pcd").write_bytes(b"never opened")
    got = S.registered_cloud(spark, str(tmp_path), poses(spark, [2, 10, 30]), last=30).orderBy("frame", "sample").collect()
    assert [(r.frame, r.sample) for r in got] == [(2, 0), (2, 1), (10, 0), (10, 1), (30, 0), (30, 1)]
    assert np.allclose([(r.x, r.y, r.z) for r in got[:2]], [(2, 1, 5), (1, 2, 0)]) and (got[2].ox, got[2].t) == (10, 10)
    assert {r.frame for r in S.registered_cloud(spark, str(tmp_path), poses(spark, [2, 10]), first=5, last=20).collect()} == {10}
    with pytest.raises(ValueError, match=r"without a pose: \[10\]"):
        S.registered_cloud(spark, str(tmp_path), poses(spark, [2, 30]), last=30)
    with pytest.raises(ValueError, match="no scan"):
        S.registered_cloud(spark, str(tmp_path), poses(spark, [2]), first=11, last=12)


def test_long_recordings_lose_their_ends_unless_all_is_asked_for(spark, tmp_path):
    for n in range(300):
        scan(tmp_path / f"{n}.pcd", [(0.0, 0.0, 0.0)])
    known = poses(spark, range(300))
    span = lambda **k: S.registered_cloud(spark, str(tmp_path), known, **k).agg(F.min("frame"), F.max("frame"), F.count("*")).first()
    assert tuple(span()) == (100, 199, 100) and tuple(span(every=True)) == (0, 299, 300) and tuple(span(first=0)) == (0, 299, 300)


def test_filters_on_frames_choose_files():
    r = S.ScanReader({"path": "x"}, ".pcd")
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    left = list(r.pushFilters([GreaterThan(("frame",), 3), LessThanOrEqual(("frame",), 9), In(("frame",), (4, 9, 20)), EqualTo(("x",), 1.0)]))
    assert [n for n in range(30) if r.wanted(n)] == [4, 9] and left == [EqualTo(("x",), 1.0)]


def observed(spark, frames, n=40, change=None):
    rng = np.random.default_rng(0)
    rows = []
    for f in frames:
        order = rng.permutation(n // 2)
        for k in range(n):
            rows.append({"frame": f, "origin_ns": 9, "raw_count": 3 * n, "export_count": n // 2, "begin": 1.0 * f, "end": f + 0.1, "tx": 0.0, "ty": 0.0, "tz": 0.0, "qx": 0.0, "qy": 0.0, "qz": 0.0, "qw": 1.0, "vx": 0.0, "vy": 0.0, "vz": 0.0, "imu_shift": 0.0, **{c: float(v) for c, v in zip(("x", "y", "z", "raw_x", "raw_y", "raw_z"), rng.normal(size=6), strict=True)}, "range": 1.0, "sample": 3 * k, "offset_ns": 1000 * k, "intensity": k % 256, "tag": 1, "line": 2, "export_rank": float(order[k // 2]) if k % 2 else None})
    frame = pd.DataFrame(rows)
    if change:
        change(frame)
    return spark.createDataFrame(frame).withColumn("export_rank", F.when(~F.isnan("export_rank"), F.col("export_rank")).cast("long"))


def test_observation_frames_come_back_and_become_scans(spark, tmp_path):
    path, scans = str(tmp_path / "obs"), str(tmp_path / "scans")
    df = observed(spark, [3, 7, 12])
    S.write_observations(df, path)
    names = [c.split()[0] for c in S.OBSERVATIONS.split(", ")]
    got = spark.read.format("observations").option("path", path).load()
    values = lambda f: np.array([list(r) for r in f.select(*names).fillna(-1, ["export_rank"]).orderBy("frame", "sample").collect()])
    assert np.allclose(values(got), values(df), atol=1e-5)
    assert sorted(p.name for p in (tmp_path / "obs").iterdir()) == ["12.obs", "3.obs", "7.obs", "result.json"]
    assert json.loads((tmp_path / "obs" / "result.json").read_text()) == {"frames": 3, "rows": 120}
    S.write_scans(got, scans)
    points = spark.read.format("scans").option("path", scans).load().where("frame = 7").orderBy("sample").collect()
    want = df.where("frame = 7 AND export_rank IS NOT NULL").orderBy("export_rank").collect()
    assert np.allclose([r.x for r in points], [r.x for r in want], atol=1e-6) and [r.intensity for r in points] == [r.intensity for r in want]
    assert np.allclose([r.curvature for r in points], [(r.begin + r.offset_ns * 1e-9 - r.end) * 1000 for r in want], atol=1e-3)


@pytest.mark.parametrize(("column", "row", "value", "why"), [("export_rank", 1, 0.0, "permutation"), ("sample", 5, 3, "order"), ("x", 0, np.inf, "finite"), ("qw", slice(None), 2.0, "contradicts"), ("end", slice(None), 0.0, "contradicts"), ("offset_ns", 3, 2_000_000_000, "order")])
def test_odd_observations_are_refused_and_nothing_is_left(spark, tmp_path, column, row, value, why):
    def change(f):
        if column == "export_rank":
            f.loc[f.export_rank.notna(), "export_rank"] = value
        else:
            f.loc[row if isinstance(row, slice) else [row], column] = value

    with pytest.raises(Exception, match=why):
        S.write_observations(observed(spark, [3], change=change), str(tmp_path / "o"))
    assert not list((tmp_path / "o").glob("[0-9]*.obs"))


def test_truncated_and_foreign_frames_are_refused(spark, tmp_path):
    S.write_observations(observed(spark, [3]), str(tmp_path))
    raw = (tmp_path / "3.obs").read_bytes()
    for content in (raw[:-1], b"X" + raw[1:], raw[:100]):
        (tmp_path / "3.obs").write_bytes(content)
        with pytest.raises(Exception, match="observation frame|shorter"):
            spark.read.format("observations").option("path", str(tmp_path)).load().collect()


def coloured(spark, n):
    seen = F.col("id") % 3 != 0
    return spark.range(n).select(F.col("id").alias("point_id"), (F.col("id") / 7.0 - 3).alias("x"), (F.col("id") * 0.5).alias("y"), d(1e6).alias("z"), *[F.when(seen, F.lit(v)).alias(c) for v, c in ((1, "red"), (65535, "green"), (3, "blue"))], (F.col("id") % 2 == 0).alias("blended"))


def test_exports_have_ids_beside_points_and_counts(spark, tmp_path):
    path = str(tmp_path / "out")
    S.export(coloured(spark, 1000), path, points_a_file=200)
    said = json.loads((tmp_path / "out" / "result.json").read_text())
    assert said == {"coloured_points": 666, "blended_points": 333, "input_points": 1000, "coordinate_quantization_m": 1e-4}
    ids, xs = [], []
    records.register(spark)
    for part in sorted((tmp_path / "out").glob("*.las")):
        own = np.frombuffer((tmp_path / "out" / part.name.replace("coloured", "source-indices").replace(".las", ".u64")).read_bytes(), "<u8")
        ids += own.tolist()
        xs += [r.x for r in spark.read.format("las").option("path", str(part)).load().collect()]
    assert ids == [k for k in range(1000) if k % 3] and np.allclose(xs, [k / 7 - 3 for k in ids], atol=1e-4)
    assert len(list((tmp_path / "out").glob("*.las"))) > 2 and not list((tmp_path / "out").glob("_staged*"))
    with pytest.raises(FileExistsError):
        S.export(coloured(spark, 10), path)
    for bad in (coloured(spark, 1), coloured(spark, 100).withColumn("x", F.col("point_id") * 1e7), coloured(spark, 9).withColumn("y", d(float("nan")))):
        with pytest.raises(ValueError, match="no coloured|do not fit"):
            S.export(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_an_export_that_fails_leaves_neither_file(spark, tmp_path):
    broken = coloured(spark, 1000).withColumn("red", F.when(F.col("point_id") == 998, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("red")))
    with pytest.raises(Exception, match="broken"):
        S.export(broken, str(tmp_path / "out"), points_a_file=200)
    assert not (tmp_path / "out").exists() or not [p for p in (tmp_path / "out").iterdir() if p.suffix in (".las", ".u64", ".json") and not p.name.startswith("_staged")]


def test_places_of_a_permutation(spark):
    df = spark.range(5000).withColumn("id", F.col("id") * 64)
    one, again = ([(r.id, r.place) for r in J.shuffled(df.repartition(p), "id").orderBy("id").collect()] for p in (1, 7))
    other = [r.place for r in J.shuffled(df, "id", 1).orderBy("id").collect()]
    places = [p for _, p in one]
    assert one == again and sorted(places) == list(range(5000)) and sorted(other) == list(range(5000)) and places != other
    assert abs(np.corrcoef(places, range(5000))[0, 1]) < 0.05
    assert J.shuffled(df.limit(0), "id").count() == 0


def test_rows_of_many_files_have_dense_places(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    t = J.placed(spark.read.parquet(str(tmp_path / "t")))
    rows = sorted((r.place, r.id) for r in t.collect())
    import pyarrow.parquet as pq

    want = [i for f in sorted((tmp_path / "t").glob("*.parquet")) for i in pq.read_table(f)["id"].to_pylist()]
    assert [i for _, i in rows] == want and [p for p, _ in rows] == list(range(1000))


def test_comparisons_report_what_differs(spark):
    a = spark.createDataFrame([(0, 1.0, 5), (1, 2.0, None), (2, None, 7), (3, 4.0, 8)], "place long, x double, c int")
    b = spark.createDataFrame([(0, 1.25, 5), (1, 2.0, None), (2, 3.0, 7), (9, 0.0, 0)], "place long, x double, c int")
    assert tuple(J.compared(a, b, {"x": 0.5, "c": 0}).first()) == (3, 1, 1, float("inf"), 0.0, False)
    assert tuple(J.compared(a, a, {"x": 0, "c": 0}).first())[-1] is True
    assert tuple(J.compared(a.limit(0), a.limit(0), {"x": 0}).first()) == (0, 0, 0, 0.0, True)


def test_stages_are_observed_as_they_run(spark):
    o = J.Observed(spark)
    some = o.stage("all", spark.range(100), "id").where("id >= 40")
    o.stage("few", some).write.format("noop").mode("overwrite").save()
    assert [tuple(r) for r in o.table().collect()] == [("all", 100, 0.0, 99.0), ("few", 60, None, None)]
    found = J.stage_metrics(spark)
    assert found.count() > 0 and found.agg(F.max("tasks")).first()[0] > 0


def outline(v, by, sign):
    """The boundary by hand, a corner at a time."""
    out, n = [], len(v)
    for i in range(n):
        (ax, ay), (x, y), (bx, by_) = v[i - 1], v[i], v[(i + 1) % n]
        e, f = np.array([x - ax, y - ay]), np.array([bx - x, by_ - y])
        p, q = (sign * np.array([w[1], -w[0]]) / np.hypot(*w) for w in (e, f))
        if (e[0] * f[1] - e[1] * f[0]) * sign > 0:
            turn = (np.arctan2(q[1], q[0]) - np.arctan2(p[1], p[0])) % (2 * np.pi)
            turn = turn if sign > 0 else turn - 2 * np.pi
            steps = max(2, int(np.ceil(abs(turn) / (np.pi / 12))))
            a = np.arctan2(p[1], p[0]) + turn * np.arange(steps + 1) / steps
            out += [(x + by * np.cos(t), y + by * np.sin(t)) for t in a]
        else:
            m = (p + q) / np.linalg.norm(p + q)
            out.append((x + m[0] * by / max(0.2, m @ p), y + m[1] * by / max(0.2, m @ p)))
    return np.array(out)


@pytest.mark.parametrize("reverse", [False, True])
def test_band_outlines_of_convex_and_concave_corners(spark, reverse):
    v = [(0.0, 0.0), (6.0, 0.0), (6.0, 5.0), (3.5, 5.0), (3.2, 1.0), (2.0, 4.5), (-1.0, 4.0)]
    v = v[::-1] if reverse else v
    got = spark.range(1).select(F.explode(G.band_outline(G.polygon(v), 0.4)).alias("p")).select("p.*").collect()
    want = outline(v, 0.4, -1 if reverse else 1)
    assert np.allclose(np.array(got), want, atol=1e-9) and len(want) > 20
    same = spark.range(1).select(G.band_outline(G.polygon(v), 0.0).alias("p"), F.size(G.band_outline(G.polygon(v[:2]), 1.0)).alias("n")).first()
    assert [tuple(p) for p in same.p] == v and same.n == 2


def test_previews_are_cached_by_what_they_show(spark, tmp_path):
    pts = coloured(spark, 3000)
    path, said = S.preview(pts, str(tmp_path), 1000, "cloud 1")
    positions, colours = np.fromfile(f"{path}/positions.f4", "<f4").reshape(-1, 3), np.fromfile(f"{path}/colours.u1", "u1").reshape(-1, 3)
    assert 980 <= said["points"] == len(positions) == len(colours) <= 1000
    back = positions + np.array(said["middle"])
    assert set(np.rint((back[:, 0] + 3) * 7).astype(int)) <= set(range(3000)) and (np.diff(back[:, 0]) > 0).all() and said["bounds"][0][2] == 1e6
    assert {tuple(c) for c in colours.tolist()} == {(0, 255, 0), (184, 184, 184)}
    again, _ = S.preview(pts.where("point_id < 0"), str(tmp_path), 1000, "cloud 1")  # not read: it is there
    assert again == path and S.preview(pts, str(tmp_path), 500, "cloud 1")[0] != path
    with pytest.raises(ValueError, match="no points"):
        S.preview(pts.where("point_id < 0"), str(tmp_path), 1000, "cloud 2")


def test_files_that_a_copy_lacks(spark, tmp_path):
    import os

    for side in ("a", "b"):
        (tmp_path / side / "in").mkdir(parents=True)
        for name, body in (("x.bin", b"12345"), ("in/y.bin", b"1"), ("in/z.bin", b"333")):
            (tmp_path / side / name).write_bytes(body)
            os.utime(tmp_path / side / name, (1000, 1000))
    (tmp_path / "b" / "x.bin").write_bytes(b"1234")
    os.utime(tmp_path / "b" / "in" / "y.bin", (1000, 2000))
    a, b = (S.listing(spark, str(tmp_path / side)) for side in "ab")
    assert sorted(r.path for r in S.to_copy(a, b).collect()) == ["in/y.bin", "x.bin"] and S.to_copy(a, a).count() == 0
    assert S.folder_size(a) == 9 and S.folder_size(a.where("length < 0")) == 0


@pytest.mark.parametrize("array", [np.arange(12, dtype="<f4").reshape(4, 3), np.arange(5, dtype="<i8"), np.array([(1, 2.5, (3, 4)), (5, 6.5, (7, 8))], [("a", "<u4"), ("b", "<f8"), ("v", "<i2", (2,))])])
def test_numpy_files(spark, tmp_path, array):
    np.save(tmp_path / "s.npy", array)
    records.register(spark)
    rows = spark.read.format("npy").option("path", str(tmp_path)).load().collect()
    flat = [[*r][:2] + list(r[2]) for r in array.tolist()] if array.dtype.names else array.reshape(len(array), -1).tolist()
    assert [list(r) for r in rows] == flat
    (tmp_path / "s.npy").write_bytes((tmp_path / "s.npy").read_bytes()[:-1])
    with pytest.raises(Exception, match="size does not agree"):
        spark.read.format("npy").option("path", str(tmp_path)).load().collect()
