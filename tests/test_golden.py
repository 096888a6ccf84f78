"""Facts that can be worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweave.functions import camera as C
from terraweave.functions import geometry as G
from terraweave.functions.geometry import d
from terraweave.operators import exposure as E
from terraweave.operators import jobs as J
from terraweave.operators import points as P
from terraweave.operators import refinement as M
from terraweave.operators import regions as R
from terraweave.operators import selection as K
from terraweave.operators import series as T
from terraweave.operators import surfaces as S
from terraweave.operators import visibility as O


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def grid(spark):
    """A lattice of 15 columns and 12 rows."""
    return spark.range(180).select(F.col("id").alias("point_id"), (F.col("id") % 15).cast("double").alias("x"), F.floor(F.col("id") / 15).cast("double").alias("y"), d(0).alias("z"))


def test_regions_on_a_grid(spark):
    triangle = [(2.25, 1.75), (11.75, 1.75), (2.25, 9.25)]
    region, ring = R.Region([None] * 3, [None] * 3, [R.Outline(triangle)]), R.Region([None] * 3, [None] * 3, [R.Outline(triangle, True, 0.8)])

    def away(x, y):
        ends = [(np.array(a), np.array(b)) for a, b in zip(triangle, triangle[1:] + triangle[:1], strict=True)]
        foot = [a + np.clip((np.array([x, y]) - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1) * (b - a) for a, b in ends]
        return min(np.hypot(*(f - [x, y])) for f in foot)

    lattice = {(x, y) for x in range(15) for y in range(12)}
    within = {(x, y) for x, y in lattice if x > 2.25 and y > 1.75 and (x - 2.25) / 9.5 + (y - 1.75) / 7.5 < 1}
    around = {(x, y) for x, y in lattice - within if away(x, y) <= 0.8}
    for regions, want in (([region], within), ([ring], around), ([region, ring], within | around)):
        got = [(r["x"], r["y"]) for r in R.select_regions(grid(spark), regions).collect()]
        assert len(got) == len(want) and set(got) == want and want


def test_outlines_known_beforehand_agree_with_polygon_columns(spark):
    points = [(4.5, 4.5), (10.5, 4.0), (9.0, 12.0), (8.0, 6.0), (8.0, 6.0), (2.0, 11.0)]
    x, y, v = F.col("x"), F.col("y"), G.polygon(points)
    both = grid(spark).select(G.inside_polygon(x, y, v).alias("a"), G.inside_outline(x, y, points).alias("b"), (G.distance_to_edges(x, y, v) - G.distance_to_outline(x, y, points)).alias("d"))
    assert both.where("a <> b OR abs(d) > 1e-12").count() == 0 and both.where("a").count() > 20


def test_overlapping_boxes_give_each_point_once(spark):
    line = spark.range(10).select("id", (F.col("id") + 100.0).alias("x"), d(200).alias("y"), d(0).alias("z"))
    boxes = [R.Region([102, None, None], [105, None, None]), R.Region([104, None, None], [107, None, None])]
    assert R.select_regions(line, boxes).count() == 6
    turned = R.moved([d(3), d(-2), d(7)], G.euler_matrix(d(0), d(0), d(np.pi)), (1, 4, 0), (-6, 2, 0.25))
    assert np.allclose(list(one(spark, *turned)), [-7, 12, 7.25])


@pytest.mark.parametrize("stride", [1, 64])
def test_preview_stays_within_its_budget(spark, stride):
    pts = spark.range(17000).select((F.col("id") * stride).alias("point_id"))
    kept = [r[0] for r in R.systematic_sample(pts, 2500).collect()]
    assert 2490 <= len(kept) <= 2500 and len(set(kept)) == len(kept)
    assert sorted(kept) == sorted(r[0] for r in R.systematic_sample(pts.repartition(5), 2500).collect())
    assert abs(np.mean(kept) / (8500 * stride) - 1) < 0.05 and R.systematic_sample(pts, 17000).count() == 17000


def test_slice_boxes_are_cut_by_their_ancestors(spark):
    s = spark.createDataFrame([(1, None, 0.0, 10.0), (2, 1, 5.0, 15.0), (3, 2, 12.0, 20.0)], "id long, parent long, x0 double, x1 double")
    assert {r["id"]: (r["x0"], r["x1"]) for r in R.effective_boxes(s).collect()} == {1: (0, 10), 2: (5, 10), 3: (None, None)}


def test_polygon_measures(spark):
    square = G.polygon([(0, 0), (4, 0), (4, 4), (0, 4)])
    grown = F.transform(G.offset_polygon(square, 1.0), lambda p: F.array(p["x"], p["y"]))
    row = one(spark, G.area(square).alias("a"), G.distance_to_edges(d(2), d(1), square).alias("m"), grown.alias("o"))
    assert row.a == 16 and row.m == 1
    assert sorted(tuple(np.round(p, 6)) for p in row.o) == [(-1, -1), (-1, 5), (5, -1), (5, 5)]


def test_twenty_rays_through_a_point_make_it_noise(spark):
    rows = [(0, 1.0, 0.0, 0.0)] + [(k, 2.0, 0.0, 0.0) for k in range(1, 21)]
    pts = spark.createDataFrame([(*r, 1) for r in rows], "point_id long, x double, y double, z double, frame long").withColumns({c: F.col(c) + 0.001 for c in "xyz"})
    origin = spark.createDataFrame([(1, 0.001, 0.001, 0.001)], "frame long, ox double, oy double, oz double")
    found = P.classified(pts, P.ray_evidence(P.rays(pts, origin), 0.015), 0.015)
    assert {r["point_id"] for r in found.where("noise").collect()} == {0}


def test_segment_and_box(spark):
    hits, entry, leave = G.segment_box([d(0), d(0.5), d(0.5)], [d(4), d(0.5), d(0.5)], [1, 0, 0], [2, 1, 1])
    assert tuple(one(spark, hits.alias("h"), entry.alias("e"), leave.alias("l"))) == (True, 0.25, 0.5)
    hits, _, _ = G.segment_box([d(0), d(2), d(0.5)], [d(4), d(2), d(0.5)], [1, 0, 0], [2, 1, 1])
    assert one(spark, hits.alias("h")).h is False


def test_occluder(spark):
    camera = C.Camera(8, 8, 1, 0, 1, 3, 3, 1.3, (0, 0, 0, 0, 0, 0))
    pts = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 2.0)], "point_id long, x double, y double, z double").withColumns({"nx": d(0), "ny": d(0), "nz": d(-1)})
    photos = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "photo long, px double, py double, pz double")
    seen = O.visibility(O.projected(pts, photos, camera), pts)
    assert {r["point_id"]: r["visible"] for r in seen.collect()} == {0: True, 1: False}


@pytest.mark.parametrize(("scores", "kept"), [([(3, 1.0), (4, 1.0), (5, 1.0), (6, 1.0), (7, 1.0)], [3, 4, 5, 6]), ([(0, 0.9), (1, 0.9), (2, 0.9), (3, 0.9), (4, 1.0)], [4, 1, 2, 3])])
def test_views_by_insertion(spark, scores, kept):
    df = spark.createDataFrame([(1, p, s) for p, s in scores], "point_id long, photo long, score double")
    assert [r["photo"] for r in O.top_views_by_insertion(df).orderBy("slot").collect()] == kept


def test_packed_keys_come_back(spark):
    cells = [F.lit(v).cast("long") for v in (-5, 77, -(1 << 20) + 1)]
    assert tuple(one(spark, *[c.alias(str(k)) for k, c in enumerate(G.unpacked_key(G.packed_key(*cells)))])) == (-5, 77, -(1 << 20) + 1)
    assert one(spark, G.packed_key(F.lit(1 << 20).cast("long"), cells[0], cells[1]).alias("k")).k is None


def test_consensus_rejects_a_bad_best_view(spark):
    views = spark.createDataFrame([(1, 0, 0.75, 0.0, 210.0), (1, 1, 0.7, 0.0, 88.0), (1, 2, 0.65, 0.0, 90.0), (1, 3, 0.6, 0.0, 91.0)], "point_id long, slot long, score double, gradient double, r double").withColumns({"g": F.col("r"), "b": F.col("r")})
    row = E.consensus(views).first()
    assert 87 < row.r < 92 and row.blended
    assert E.consensus(views, robust=False).first().r > 110


def test_exposure_offsets(spark):
    rng = np.random.default_rng(3)
    truth = np.array([3.0, -2.0, 1.0, -2.0])
    rows = [(int(a), int(b), float(truth[a] - truth[b] + rng.normal(0, 0.1) + (30 if rng.random() < 0.05 else 0))) for a, b in rng.integers(0, 4, (500, 2)) if a != b]
    x = E.solve_offsets(spark.createDataFrame(rows, "node_a long, node_b long, value double"), 4)
    assert np.abs(x - truth).max() < 0.3
    assert (E.solve_offsets(spark.createDataFrame([], "node_a long, node_b long, value double"), 4) == 0).all()
    assert len(E.grid_edges(1)) == 7 * 6 + 8 * 5


def test_quality_rules(spark):
    rows = P.violations(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double"), {"number": G.finite(F.col("v"))})
    assert rows.first().rows == 2


def test_pose_bracket(spark):
    poses = spark.createDataFrame([(0, t, x, 0.0, 0.0, 0.0, 1.0) for t, x in ((0, 0.0), (100_000, 1.0), (2_000_000, 2.0))], "recording long, t_us long, x double, y double, z double, qz double, qw double")
    shots = spark.createDataFrame([(0, 1, 50_000), (0, 2, 1_000_000), (0, 3, 9_000_000), (0, 4, 0), (0, 5, 100_000)], "recording long, shot long, t_us long")
    by_bucket = [{r["shot"]: (r["reason"], r["x"]) for r in T.interpolated(T.bracket(shots, poses, "recording", ["x", "y", "z", "qz", "qw"], bucket), 0.5).collect()} for bucket in (0.04, 1.0, 86400.0)]
    found = by_bucket[0]
    assert by_bucket[1] == found == by_bucket[2]
    assert found[1] == (None, 0.5) and found[2][0] == "pose gap exceeds limit" and found[3][0] == found[4][0] == "outside pose coverage" and found[5] == (None, 1.0)


def test_attitude_of_a_constant_rate(spark):
    s = spark.range(101).select(F.lit(1).cast("long").alias("sensor"), (F.col("id") * 10_000).alias("t_us"), d(0).alias("wx"), d(0).alias("wy"), d(np.pi / 2).alias("wz"))
    last = T.attitudes(s, "sensor", 0.1).orderBy(F.desc("t_us")).first()
    assert np.allclose([last.qz, last.qw], [np.sin(np.pi / 4), np.cos(np.pi / 4)])


def test_ground_plane_of_a_tilted_floor(spark):
    rng = np.random.default_rng(4)
    x, y = rng.uniform(-10, 10, (2, 4000))
    z = np.tan(np.deg2rad(5)) * y + 2 + rng.normal(0, 0.01, 4000)
    z[::10] += rng.uniform(0.5, 3, 400)
    pts = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(zip(x, y, z, strict=True))], "point_id long, x double, y double, z double")
    n, away, count = T.ground_plane(pts)
    assert abs(np.rad2deg(np.arccos(n[2])) - 5) < 0.3 and abs(away / n[2] - 2) < 0.1 and count >= 3500


def test_smoothing_flattens_and_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(5)
    p = np.stack([*rng.uniform(0, 1, (2, 900)), rng.normal(0, 0.005, 900)], -1)
    pts = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(p)], "point_id long, x double, y double, z double")
    one_block = S.smoothed_surface(pts, 4.0, 0.4, 0.1, (0, 0, 5)).orderBy("point_id").toPandas()
    many = S.smoothed_surface(pts, 0.5, 0.4, 0.1, (0, 0, 5)).orderBy("point_id").toPandas()
    assert one_block.z.std() < 0.5 * p[:, 2].std() and (one_block.nz > 0.9).all()
    assert len(one_block) == len(many) and np.abs(one_block[["x", "y", "z"]].to_numpy() - many[["x", "y", "z"]].to_numpy()).max() < 1e-9


def test_refinement_recovers_a_shift(spark):
    rng = np.random.default_rng(6)
    planes, pts = [], []
    for axis in range(3):
        for _ in range(60):
            m, n = rng.uniform(-2, 2, 3), np.eye(3)[axis]
            m[axis] = 2.0
            planes.append((*map(float, m), *map(float, n)))
            for _ in range(6):
                q = m + rng.normal(0, 0.05, 3) * (1 - n)
                pts.append((len(pts), 1, *map(float, q + np.array([0.02, -0.01, 0.03]))))
    plane = spark.createDataFrame(planes, "mx double, my double, mz double, nx double, ny double, nz double")
    cloud = spark.createDataFrame(pts, "point_id long, frame long, x double, y double, z double")
    r = M.refine_poses(cloud, plane, least=100).first()
    assert r.accepted and np.allclose([r.tx, r.ty, r.tz], [-0.02, 0.01, -0.03], atol=4e-3)


def test_keyframes_match_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    score = rng.random((40, 6))
    n = rng.integers(1, 100, 40)
    rows = [(k, int(n[k]), p, float(score[k, p])) for k in range(40) for p in range(6)]
    got = [r["photo"] for r in K.keyframes(spark.createDataFrame(rows, "representative long, n long, photo long, score double"), 4).orderBy("step").collect()]
    w, chosen = np.sqrt(np.minimum(n, 64)), []
    for _ in range(4):
        def gain(p):
            s = np.sort(score[:, [*chosen, p]], axis=1)
            return (w * (s[:, -1] + (0.35 * s[:, -2] if chosen else 0))).sum()
        chosen.append(max((p for p in range(6) if p not in chosen), key=gain))
    assert got == chosen
    assert [J.keyframe_budget(124), J.keyframe_budget(62), J.keyframe_budget(124, 20)] == [40, 20, 24]


def test_stages_become_ready_in_order():
    names = J.planned()
    assert J.ready(names, set(), set()) == ["decode", "photos"]
    assert J.ready(names, {"decode", "photos"}, set()) == ["pack", "masks"]
    assert J.ready(names, {"decode", "photos"}, {"pack"}) == ["masks"]
    assert "masks" not in J.planned(mask=False) and J.planned("build")[-1] == "geometry" and J.planned("colorize")[0] == "masks"


def test_text_helpers(spark):
    row = one(spark, J.slug(F.lit(" My Scan: No. 1! ")).alias("s"), J.progress_of(F.lit("filter: 12/40 blocks")).alias("p"), J.vertices_of(F.lit("1 2; x y; 3,4.5")).alias("v"), J.duration_text(d(3725)).alias("d"), J.fnv1a(F.lit("hello")).alias("f"))
    assert row.s == "my-scan-no-1" and tuple(row.p) == (12, 40, "blocks") and [tuple(p) for p in row.v] == [(1, 2), (3, 4.5)] and row.d == "1 h 2 min" and row.f == 0x4F9F2CAB
