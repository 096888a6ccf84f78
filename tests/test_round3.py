"""What the findings of the third round say, held small."""

import re
import types
import weakref

import duckdb
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from terraweave.functions import geometry as G
from terraweave.operators import series as T
from terraweave.operators import surfaces as S
from terraweave.operators import visibility as O
from terraweave.operators.refinement import matches
from terraweave.plans import catalog, photos
from terraweave.plans import views as V
from terraweave.sources import frames


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("name", ["s10_observation_frames", "s14_s15_registered_cloud"])
def test_frames_are_read_without_filter_pushdown(spark, sf, name):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
        got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.execute(catalog.ORACLE[name]).df()
        assert got.sort_values("frame").reset_index(drop=True).astype(float).equals(want.sort_values("frame").reset_index(drop=True)[list(got.columns)].astype(float))
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_ids_of_points_are_made_once_and_not_for_each_pair(spark, sf):
    text = plan(O.projected(V.points(spark, sf), V.photos(spark, sf), photos.CAMERA), "optimizedPlan")
    below = text[text.index("Join") :]
    made = re.search(r"explode\(array\((point_id#\d+L)", below)
    assert "md5" not in text[: text.index("Join")] and made and below.index("md5") > made.start()


def test_depth_buffers_hash_and_do_not_sort(spark, sf):
    text = plan(O.depth_buffer(O.projected(V.points(spark, sf), V.photos(spark, sf), photos.CAMERA)))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_visibility_is_not_written_out_in_the_join(spark, sf):
    pts = V.points(spark, sf)
    text = plan(O.visibility(O.projected(pts, V.photos(spark, sf), photos.CAMERA), pts).where("visible"), "optimizedPlan")
    assert re.search(r"Filter .*visible", text) and not re.search(r"Join.*exact.*tag|Join Inner.*1000000", text)


def test_outlines_compute_what_they_share_once(spark):
    shape = G.polygon([(0, 0), (4, 0), (4, 3), (1, 1)])
    for made in (G.offset_polygon(shape, 0.5), G.band_outline(shape, 0.5)):  # three roots each, and the plan says each twice
        assert plan(spark.range(1).select(F.size(made)), "analyzed").lower().count("sqrt(") <= 6


def test_series_slide_no_windows(spark, sf):
    for name in ("j01_m04_f23_pose_at_shot", "m02_m03_slerp", "w08_trailing_rate"):
        text = plan(catalog.QUERIES[name](spark, sf), "analyzed")
        assert "unboundedfollowing" not in text.lower() and "-86400000000" not in text


def test_trailing_rates_of_gaps_peers_and_missing_values(spark):
    rows = [(1, 0, 1.0), (1, 4_000_000, 3.0), (1, 10_000_000, 6.0), (1, 10_500_000, 7.0), (1, 99_000_000, 0.0), (None, 0, 5.0), (None, 2_000_000, 9.0), (2, None, 1.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, g int, t long, v double")
    got = {r.id: r.trailing for r in T.trailing_rate(df, "g", "t", "v", 10).collect()}
    assert got == {0: None, 1: 0.5, 2: 0.5, 3: pytest.approx(4 / 6.5), 4: None, 5: None, 6: 2.0, 7: None}


def test_exports_do_not_hold_batches(monkeypatch, tmp_path):
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    made, most = [], [0]

    def batches():
        for k in range(20):
            b = pa.RecordBatch.from_arrays([pa.array([k]), *[pa.array([1.0 * k])] * 3, *[pa.array([k], pa.int32())] * 4], names=list("abcdefgh"))
            made.append(weakref.ref(b))
            most[0] = max(most[0], sum(r() is not None for r in made))
            yield b
            del b

    said = frames.ColouredWriter({"path": str(tmp_path), "offset": "[0, 0, 0]", "scale": "0.1", "points": "20"}).write(batches())
    assert most[0] <= 3 and said.counts == {"coloured_points": 20, "blended_points": 190}


def test_nearest_planes_are_not_sorted_out_of_all_pairs(spark, sf):
    e = V.surfels(spark, sf)
    planes = e.select(*[F.col(c).alias(f"m{c}") for c in "xyz"], "nx", "ny", "nz")
    pts = e.withColumn("frame", F.lit(1).cast("long"))
    for df in (S.match_planes(e, e, 0.15, 0.1), matches(pts, planes, 0.3, 0.1)):
        assert re.search(r" HashAggregate\(.*partial_min\((?!struct)", plan(df))  # what takes all pairs
