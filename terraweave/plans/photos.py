"""Queries on photos: visibility, ranking of views, exposure, consensus colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.functions import camera as C
from terraweave.functions import geometry as G
from terraweave.functions.geometry import d, xyz
from terraweave.operators import exposure as E
from terraweave.operators import selection as K
from terraweave.operators import visibility as O
from terraweave.plans import views as V
from terraweave.plans.registry import Family, rounded
from terraweave.session import kept, table

_f = Family()
QUERIES, ORACLE = _f.queries, _f.oracle
CAMERA = C.Camera()
_BENT = "0.0::DOUBLE"
for _k in reversed(CAMERA.k):
    _BENT = f"({_BENT} + ({_k})) * theta"

PROJ = f"""WITH {V.POINTS}, {V.PHOTO_SQL},
p0 AS (SELECT *, x - px AS ax, y - py AS ay, z - pz AS az FROM pts, photos),
p1 AS (SELECT *, sqrt(ax * ax + ay * ay) AS rho, sqrt(ax * ax + ay * ay + az * az) AS dist, atan2(sqrt(ax * ax + ay * ay), az) AS theta FROM p0),
p2 AS (SELECT *, CASE WHEN rho <= 1e-10 THEN 1.0 ELSE ({_BENT} + 1.0) * theta / rho END AS s FROM p1),
p3 AS (SELECT *, 58.0::DOUBLE * ax * s + -3.0::DOUBLE * ay * s + 79.0::DOUBLE AS u, 55.0::DOUBLE * ay * s + 61.0::DOUBLE AS v FROM p2),
proj AS (SELECT *, floor(u / 4)::INT AS qx, floor(v / 4)::INT AS qy FROM p3 WHERE dist > 0.1 AND u >= 0 AND u < 159 AND v >= 0 AND v < 119 AND theta < 1.4)"""
BUFFER = PROJ + """, b0 AS (SELECT photo, qx, qy, min({s: round_even(dist * 1e6, 0)::BIGINT, p: point_id}) AS b FROM proj GROUP BY photo, qx, qy),
buffer AS (SELECT photo, qx, qy, b, b.s AS step, b.p AS point_id FROM b0)"""
MINIMUM = BUFFER + """, minimum AS (SELECT a.photo, a.qx, a.qy, any_value(a.step) AS exact, (min(b.b)).p AS blocker FROM buffer a JOIN buffer b ON a.photo = b.photo AND abs(a.qx - b.qx) <= 3 AND abs(a.qy - b.qy) <= 3 GROUP BY a.photo, a.qx, a.qy)"""
VISIBLE = MINIMUM + """, j AS (SELECT proj.*, exact, blocker, ax / dist AS rx, ay / dist AS ry, az / dist AS rz, b.x AS wx, b.y AS wy, b.z AS wz, b.nx AS bnx, b.ny AS bny, b.nz AS bnz FROM proj JOIN minimum USING (photo, qx, qy) JOIN pts b ON b.point_id = blocker),
j1 AS (SELECT *, bnx * rx + bny * ry + bnz * rz AS den, -(nx * rx + ny * ry + nz * rz) AS incidence FROM j),
j2 AS (SELECT *, (bnx * (wx - px) + bny * (wy - py) + bnz * (wz - pz)) / CASE WHEN abs(den) > 0.05 THEN den ELSE 1.0 END AS plane FROM j1),
j3 AS (SELECT *, abs(den) > 0.15 AND plane > 0.1 AND sqrt((px + rx * plane - wx) ** 2 + (py + ry * plane - wy) ** 2 + (pz + rz * plane - wz) ** 2) < 0.04 AS reliable FROM j2),
j4 AS (SELECT *, reliable AND dist > plane + 0.02 AS rejected FROM j3),
vis AS (SELECT *, dist <= exact / 1e6 + 0.025 + 0.005 * dist AND NOT rejected AND incidence > 0.05 AS visible FROM j4)"""
SCORED = VISIBLE + """, masked AS (SELECT * FROM vis WHERE visible AND NOT EXISTS (SELECT 1 FROM (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy) WHERE trunc(u)::INT + dx BETWEEN 45 AND 60 AND trunc(v)::INT + dy BETWEEN 35 AND 50 AND photo % 2 = 0)),
scored AS (SELECT *, exp(-2.0 * theta * theta) / (dist * dist + 0.25) * greatest(incidence, 0.05) * greatest(incidence, 0.05) AS score FROM masked)"""
TOP = SCORED + """, tops AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY score DESC, photo) - 1 AS slot FROM scored), views AS (SELECT * FROM tops WHERE slot < 4)"""
PIXEL = "({x} * 7 + {y} * 13 + photo * 29 + {c}) % 256"


def excluded(spark):
    """Masked pixels of every other photo: a rectangle."""
    return spark.range(0, V.PHOTOS, 2).select(F.col("id").alias("photo"), F.explode(F.sequence(F.lit(45), F.lit(60))).alias("mx")).withColumn("my", F.explode(F.sequence(F.lit(35), F.lit(50))))


def pixels(spark):
    """Pixel table of the photos: colours by a rule."""
    grid = spark.range(V.PHOTOS).select(F.col("id").alias("photo"), F.explode(F.sequence(F.lit(0), F.lit(CAMERA.width - 1))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(CAMERA.height - 1))))
    return grid.select("photo", "x", "y", *[((F.col("x") * 7 + F.col("y") * 13 + F.col("photo") * 29 + c) % 256).cast("int").alias(n) for c, n in ((0, "r"), (40, "g"), (80, "b"))])


def _projected(spark, sf):
    return O.projected(V.points(spark, sf), V.photos(spark, sf), CAMERA)


def _depths(spark, sf):
    return O.sighted_depths(*O.sighted(V.points(spark, sf), V.photos(spark, sf), CAMERA), CAMERA)


def _seen(spark, sf, pairs=O.sighted_pairs):
    pts = V.points(spark, sf)
    met = O.sighted(pts, V.photos(spark, sf), CAMERA)
    return O.visibility(pairs(*met, CAMERA), pts, O.sighted_depths(*met, CAMERA))


def _scored(spark, sf):
    return O.scored(O.unmasked(_seen(spark, sf, O.unhidden_pairs).where("visible"), excluded(spark)))


def _views(spark, sf):
    return O.top_views(_scored(spark, sf))


@_f.query("f12_m01_j06_projection", PROJ + " SELECT photo, point_id, round(u, 4) + 0.0 AS u, round(v, 4) + 0.0 AS v, round(theta, 5) + 0.0 AS theta, round(dist, 5) + 0.0 AS dist FROM proj")
def f12(spark, sf):
    made, seen = O.sighted(V.points(spark, sf), V.photos(spark, sf), CAMERA)
    return O.sighted_pairs(O.by_place(made), seen, CAMERA).select("photo", "point_id", rounded(F.col("u"), 4).alias("u"), rounded(F.col("v"), 4).alias("v"), rounded(F.col("theta")).alias("theta"), rounded(F.col("dist")).alias("dist"))


@_f.query("f24_p04_pruned_projection", PROJ + " SELECT photo, count(*) AS n, min(point_id) AS first FROM proj GROUP BY photo")
def f24(spark, sf):
    """What the projection through cells that a photo may see has for each photo."""
    return _projected(spark, sf).groupBy("photo").agg(F.count("*").alias("n"), F.min("point_id").alias("first"))


@_f.query("a20_m15_depth_buffer", BUFFER + " SELECT photo, qx, qy, step, point_id, step * 1000 + point_id % 1000 AS key FROM buffer")
def a20(spark, sf):
    b = _depths(spark, sf)
    return b.withColumn("key", F.try_add(F.try_multiply(F.col("step"), F.lit(1000).cast("long")), F.col("point_id") % 1000))


@_f.query("a21_w06_depth_minimum", MINIMUM + " SELECT * FROM minimum")
def a21(spark, sf):
    return O.depth_minimum(kept(_depths(spark, sf), "depth-buffer")).select(*O.PIXEL, "exact", "blocker")


@_f.query("f13_j07_j08_visibility", VISIBLE + " SELECT photo, count(*) AS n, count(*) FILTER (WHERE reliable) AS reliable, count(*) FILTER (WHERE rejected) AS rejected, count(*) FILTER (WHERE visible) AS visible FROM vis GROUP BY photo")
def f13(spark, sf):
    return _seen(spark, sf).groupBy("photo").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("reliable", "rejected", "visible")])


@_f.query("f14_j26_mask", SCORED + " SELECT photo, count(*) AS n FROM masked GROUP BY photo")
def f14(spark, sf):
    return _scored(spark, sf).groupBy("photo").agg(F.count("*").alias("n"))


@_f.query("f27_without_occlusion", PROJ + ", i AS (SELECT photo, -(nx * ax + ny * ay + nz * az) / dist AS incidence FROM proj) SELECT photo, count(*) AS n FROM i WHERE incidence > 0.05 GROUP BY photo")
def f27(spark, sf):
    p = _projected(spark, sf)
    ray = [v / F.col("dist") for v in G.sub(xyz(), [F.col(c) for c in ("px", "py", "pz")])]
    return p.where(C.incidence([F.col(c) for c in ("nx", "ny", "nz")], ray) > 0.05).groupBy("photo").agg(F.count("*").alias("n"))


@_f.query("a22_top_views", TOP + " SELECT point_id, slot, photo, round(score, 5) + 0.0 AS score, round(greatest(0.0, least(7.0, u / 160 * 8 - 0.5)), 5) + 0.0 AS gx, round(greatest(0.0, least(5.0, v / 120 * 6 - 0.5)), 5) + 0.0 AS gy FROM views")
def a22(spark, sf):
    gx, gy = C.grid_coordinates(F.col("u"), F.col("v"), CAMERA.width, CAMERA.height)
    return _views(spark, sf).select("point_id", F.col("slot").cast("long").alias("slot"), "photo", rounded(F.col("score")).alias("score"), rounded(gx).alias("gx"), rounded(gy).alias("gy"))


_PUT = "CASE WHEN one[1].score > list_min([s.score FOR s IN slots]) THEN list_transform(slots, lambda s, i: CASE WHEN i = list_position([t.score FOR t IN slots], list_min([t.score FOR t IN slots])) THEN one[1] ELSE s END) ELSE slots END"


@_f.query("a22_views_by_insertion", SCORED + f""", g AS (SELECT point_id, list({{photo: photo, score: score}} ORDER BY photo, score) AS kept FROM scored GROUP BY point_id),
f AS (SELECT point_id, list_reduce([[{{photo: -1::BIGINT, score: 0.0::DOUBLE}} FOR k IN range(4)]] || [[k] FOR k IN kept], lambda slots, one: {_PUT}) AS slots FROM g),
p AS (SELECT point_id, unnest(slots) AS s, unnest(range(4)) AS spot FROM f)
SELECT point_id, (row_number() OVER (PARTITION BY point_id ORDER BY s.score DESC, spot) - 1)::INT AS slot, s.photo, round(s.score, 5) + 0.0 AS score FROM p WHERE s.photo >= 0""")
def a22_fold(spark, sf):
    """The order-dependent eviction is a fold over a point's photos."""
    kept = O.top_views_by_insertion(_scored(spark, sf).select("point_id", "photo", "score"))
    return kept.withColumn("score", rounded(F.col("score")))


@_f.query("a23_best_view", SCORED + " SELECT point_id, arg_min(photo, {s: -score, p: photo}) AS photo FROM scored GROUP BY point_id")
def a23(spark, sf):
    return _scored(spark, sf).groupBy("point_id").agg(F.min_by("photo", F.struct(-F.col("score"), F.col("photo"))).alias("photo"))


@_f.query("a24_slot_counts", TOP + " SELECT photo, slot, count(*) AS n FROM views GROUP BY photo, slot")
def a24(spark, sf):
    return _views(spark, sf).groupBy("photo", F.col("slot").cast("long").alias("slot")).agg(F.count("*").alias("n"))


_Q = {c: {k: PIXEL.format(x=f"(xi + {k[0]})", y=f"(yi + {k[1]})", c=o) for k in ((0, 0), (1, 0), (0, 1), (1, 1))} for c, o in (("r", 0), ("g", 40), ("b", 80))}
COLOURED = TOP + """, located AS (SELECT *, floor(u)::INT AS xi, floor(v)::INT AS yi, u - floor(u) AS fx, v - floor(v) AS fy FROM views), col AS (SELECT point_id, slot, photo, score, u, v, """ + ", ".join(f"({q[0, 0]}) * (1 - fx) * (1 - fy) + ({q[1, 0]}) * fx * (1 - fy) + ({q[0, 1]}) * (1 - fx) * fy + ({q[1, 1]}) * fx * fy AS {c}_" for c, q in _Q.items()) + ", greatest(" + ", ".join(f"abs({q[k]} - {q[0, 0]})" for q in _Q.values() for k in ((1, 0), (0, 1))) + ")::DOUBLE AS gradient FROM located)"


def _coloured(spark, sf):
    kept = _views(spark, sf).select("point_id", F.col("slot").cast("long").alias("slot"), "photo", "score", "u", "v")
    return O.coloured(kept, O.pixel_quads(pixels(spark)))


@_f.query("j21_m17_m18_sampled_colours", COLOURED + " SELECT point_id, slot, round(r_, 4) + 0.0 AS r, round(g_, 4) + 0.0 AS g, round(b_, 4) + 0.0 AS b, gradient FROM col")
def j21(spark, sf):
    return _coloured(spark, sf).select("point_id", "slot", *[rounded(F.col(f"{c}_"), 4).alias(c) for c in "rgb"], "gradient")


# Views of a synthetic kind whose colours agree but for the exposure of their photo: orders as points, parts as views.
_VIEWS = """vw AS (SELECT * EXCLUDE rn FROM (SELECT l_orderkey AS point_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 8, l_extendedprice, l_partkey, l_linenumber) - 1 AS slot, l_suppkey % 8 AS photo,
  1.0 / (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 8, l_extendedprice, l_partkey, l_linenumber)) AS score, (l_partkey % 30)::DOUBLE AS gradient, (100 + l_orderkey % 50 + (l_suppkey % 8) * 2 + l_linenumber % 3)::DOUBLE AS r, (90 + l_orderkey % 40 - (l_suppkey % 8) + l_linenumber % 2)::DOUBLE AS g, (120 + l_orderkey % 30 + l_linenumber)::DOUBLE AS b, 0 AS rn FROM lineitem) WHERE slot < 4)"""


def _exposed(spark, sf):
    from pyspark.sql import Window

    from terraweave.session import table

    order = Window.partitionBy("l_orderkey").orderBy(F.col("l_suppkey") % 8, "l_extendedprice", "l_partkey", "l_linenumber")
    li = table(spark, sf, "lineitem").withColumn("slot", F.row_number().over(order).cast("long") - 1).where("slot < 4")
    photo, line = F.col("l_suppkey") % 8, F.col("l_linenumber")
    return li.select(F.col("l_orderkey").alias("point_id"), "slot", photo.alias("photo"), (1.0 / (F.col("slot") + 1)).alias("score"), (F.col("l_partkey") % 30).cast("double").alias("gradient"), (100 + F.col("l_orderkey") % 50 + photo * 2 + line % 3).cast("double").alias("r"), (90 + F.col("l_orderkey") % 40 - photo + line % 2).cast("double").alias("g"), (120 + F.col("l_orderkey") % 30 + line).cast("double").alias("b"))


PAIRS = f"""WITH {_VIEWS}, pairs AS (SELECT a.point_id, b.slot, a.photo AS photo_a, b.photo AS photo_b, b.r - a.r AS dr, b.g - a.g AS dg, b.b - a.b AS db FROM vw a JOIN vw b ON a.point_id = b.point_id AND a.slot = 0 AND b.slot > 0
 WHERE a.score > 0 AND b.score > 0.1 * a.score AND a.gradient < 22 AND b.gradient < 22 AND least(a.r, a.g, a.b, b.r, b.g, b.b) > 12 AND greatest(a.r, a.g, a.b, b.r, b.g, b.b) < 243 AND greatest(abs(a.r - b.r), abs(a.g - b.g), abs(a.b - b.b)) < 40)"""


@_f.query("f15_j22_exposure_pairs", PAIRS + " SELECT * FROM pairs")
def f15(spark, sf):
    return E.view_pairs(_exposed(spark, sf))


@_f.query("f16_holdout", PAIRS + " SELECT point_id % 5 <> 0 AS train, count(*) AS n FROM pairs GROUP BY 1")
def f16(spark, sf):
    return E.view_pairs(_exposed(spark, sf)).groupBy((F.pmod("point_id", F.lit(5)) != 0).alias("train")).agg(F.count("*").alias("n"))


@_f.query("a25_normal_matrix", PAIRS + ", w AS (SELECT photo_b AS na, photo_a AS nb, least(1.0, coalesce(8.0 / nullif(abs(dr), 0), 1.0)) AS w FROM pairs) SELECT i, j, round(sum(a), 4) + 0.0 AS a FROM (SELECT na AS i, na AS j, w AS a FROM w UNION ALL SELECT nb, nb, w FROM w UNION ALL SELECT na, nb, -w FROM w UNION ALL SELECT nb, na, -w FROM w) GROUP BY i, j")
def a25(spark, sf):
    edges = E.view_pairs(_exposed(spark, sf)).select(F.col("photo_b").alias("node_a"), F.col("photo_a").alias("node_b"), F.col("dr").alias("value"))
    matrix, _ = E.normal_matrix(edges, C.huber_weight(F.col("value"), 8.0), F.col("value"))
    return matrix.withColumn("a", rounded(F.col("a"), 4))


@_f.query("a26_a27_a28_exposure")
def a26(spark, sf):
    """Rows only: iterated weights; tests hold the solution against NumPy. Held-out error before and after."""
    pairs = E.view_pairs(_exposed(spark, sf)).select((F.pmod("point_id", F.lit(5)) != 0).alias("train"), F.col("photo_b").cast("long").alias("node_a"), F.col("photo_a").cast("long").alias("node_b"), F.col("dr").alias("value"))
    x = E.solve_offsets(kept(pairs.where("train"), "train"), V.PHOTOS)
    known = F.array(*[d(v) for v in x])
    left = F.abs(F.col("value") - (F.get(known, F.col("node_a").cast("int")) - F.get(known, F.col("node_b").cast("int"))))
    held = pairs.where("NOT train").select(F.abs("value").alias("before"), left.alias("after"))
    return held.agg(*[F.percentile(c, d(p)).alias(f"{c}_{n}") for c in ("before", "after") for p, n in ((0.5, "median"), (0.95, "p95"))])


@_f.query("a28_held_out_error", PAIRS + " SELECT quantile_cont(abs(dr), 0.5) AS median, round(quantile_cont(abs(dr), 0.95), 5) + 0.0 AS p95 FROM pairs WHERE point_id % 5 = 0")
def a28(spark, sf):
    held = E.view_pairs(_exposed(spark, sf)).where(F.pmod("point_id", F.lit(5)) == 0)
    return held.agg(F.percentile(F.abs("dr"), F.lit(0.5)).alias("median"), rounded(F.percentile(F.abs("dr"), F.lit(0.95))).alias("p95"))


_FIELD = "field AS (SELECT p AS photo, ix, iy, ((p * 17 + ix * 5 + iy * 3) % 41 - 20)::DOUBLE AS \"offset\" FROM range(25) a(p), range(8) b(ix), range(6) c(iy))"


def _field(spark):
    grid = spark.range(V.PHOTOS).select(F.col("id").alias("photo"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("ix")).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return grid.withColumn("offset", ((F.col("photo") * 17 + F.col("ix") * 5 + F.col("iy") * 3) % 41 - 20).cast("double"))


@_f.query("m19_m20_field", TOP + f""", {_FIELD}, g AS (SELECT point_id, slot, photo, greatest(0.0, least(7.0, u / 160 * 8 - 0.5)) AS gx, greatest(0.0, least(5.0, v / 120 * 6 - 0.5)) AS gy FROM views),
c AS (SELECT g.*, floor(gx)::INT AS xi, floor(gy)::INT AS yi, gx - floor(gx) AS fx, gy - floor(gy) AS fy FROM g),
q AS (SELECT c.*, a."offset" AS c00, b."offset" AS c10, e."offset" AS c01, h."offset" AS c11 FROM c JOIN field a ON a.photo = c.photo AND a.ix = xi AND a.iy = yi JOIN field b ON b.photo = c.photo AND b.ix = least(xi + 1, 7) AND b.iy = yi JOIN field e ON e.photo = c.photo AND e.ix = xi AND e.iy = least(yi + 1, 5) JOIN field h ON h.photo = c.photo AND h.ix = least(xi + 1, 7) AND h.iy = least(yi + 1, 5))
SELECT point_id, slot, round(c00 * (1 - fx) * (1 - fy) + c10 * fx * (1 - fy) + c01 * (1 - fx) * fy + c11 * fx * fy, 4) + 0.0 AS "offset" FROM q""")
def m19(spark, sf):
    gx, gy = C.grid_coordinates(F.col("u"), F.col("v"), CAMERA.width, CAMERA.height)
    at = _views(spark, sf).select("point_id", F.col("slot").cast("long").alias("slot"), "photo", gx.alias("gx"), gy.alias("gy"))
    return E.field_bilinear(at, _field(spark)).select("point_id", "slot", rounded(F.col("offset"), 4).alias("offset"))


@_f.query("m20_fixed_point", "WITH a AS (SELECT o_orderkey AS i, (o_orderkey % 97) / 13.9::DOUBLE AS gx, (o_custkey % 71) / 14.3::DOUBLE AS gy, o_custkey AS c FROM orders), w AS (SELECT *, floor((gx - floor(gx)) * 256 + 0.5)::BIGINT AS wx, floor((gy - floor(gy)) * 256 + 0.5)::BIGINT AS wy FROM a) SELECT i AS id, floor(((i % 50 - 25) * (256 - wx) * (256 - wy) + (c % 30) * wx * (256 - wy) + (i % 20 - 40) * (256 - wx) * wy + (c % 10) * wx * wy) / 65536.0::DOUBLE)::BIGINT AS value FROM w")
def m20(spark, sf):
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(i.alias("id"), E.fixed_point(i % 50 - 25, c % 30, i % 20 - 40, c % 10, (i % 97) / 13.9, (c % 71) / 14.3).alias("value"))


_GAP = "greatest(abs(a.r - b.r), abs(a.g - b.g), abs(a.b - b.b))"
_LIN = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_SRGB = "(CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4::DOUBLE) - 0.055 END) * 255"


def _consensus_sql(anchor: str) -> str:
    return f"""WITH {_VIEWS}, top AS (SELECT point_id, score AS s0, gradient AS g0 FROM vw WHERE slot = 0),
u AS (SELECT vw.*, s0, g0 FROM vw JOIN top USING (point_id) WHERE slot = 0 OR (score > 0.1 * s0 AND gradient < 22)),
cost AS (SELECT a.point_id, a.slot, sum(least({_GAP}, 48.0)) AS cost FROM u a JOIN u b USING (point_id) GROUP BY 1, 2),
anc AS (SELECT u.point_id, arg_min(u.slot, {{c: CASE WHEN {anchor} THEN u.slot::DOUBLE ELSE cost END, s: u.slot}}) AS slot FROM u JOIN cost USING (point_id, slot) GROUP BY 1),
w AS (SELECT a.*, sqrt(a.score / a.s0) * greatest(0.0, 1 - pow({_GAP} / 48.0, 2)) * greatest(0.0, 1 - pow({_GAP} / 48.0, 2)) / (1 + pow(a.gradient / 22, 2)) AS w FROM u a JOIN anc ON anc.point_id = a.point_id JOIN u b ON b.point_id = anc.point_id AND b.slot = anc.slot),
m AS (SELECT point_id, sum(w * {_LIN.format(c='r')}) / sum(w) AS r, sum(w * {_LIN.format(c='g')}) / sum(w) AS g, sum(w * {_LIN.format(c='b')}) / sum(w) AS b, count(*) FILTER (WHERE w > 0) > 1 AS blended FROM w GROUP BY point_id)
SELECT point_id, round({_SRGB.format(c='r')}, 4) + 0.0 AS r, round({_SRGB.format(c='g')}, 4) + 0.0 AS g, round({_SRGB.format(c='b')}, 4) + 0.0 AS b, blended FROM m"""


def _blend(spark, sf, robust):
    out = E.consensus(_exposed(spark, sf), robust)
    return out.select("point_id", *[rounded(F.col(c), 4).alias(c) for c in "rgb"], "blended")


@_f.query("a29_m21_j23_consensus", _consensus_sql("g0 >= 22"))
def a29(spark, sf):
    return _blend(spark, sf, True)


@_f.query("a30_plain_blend", _consensus_sql("TRUE"))
def a30(spark, sf):
    return _blend(spark, sf, False)


@_f.query("f17_a43_coloured_points", f"WITH {_VIEWS}, b AS (SELECT point_id, max(score) AS score, count(*) > 1 AS several FROM vw GROUP BY point_id) SELECT count(*) AS points, count(*) FILTER (WHERE score > 0) AS coloured, count(*) FILTER (WHERE several) AS several FROM b")
def f17(spark, sf):
    per = _exposed(spark, sf).groupBy("point_id").agg(F.max("score").alias("score"), (F.count("*") > 1).alias("several"))
    return per.agg(F.count("*").alias("points"), F.count_if(F.col("score") > 0).alias("coloured"), F.count_if("several").alias("several"))


@_f.query("m22_grid_node", TOP + " SELECT photo * 48 + round_even(greatest(0.0, least(5.0, v / 120 * 6 - 0.5)), 0)::BIGINT * 8 + round_even(greatest(0.0, least(7.0, u / 160 * 8 - 0.5)), 0)::BIGINT AS node, count(*) AS n FROM views GROUP BY 1")
def m22(spark, sf):
    gx, gy = C.grid_coordinates(F.col("u"), F.col("v"), CAMERA.width, CAMERA.height)
    return _views(spark, sf).groupBy(C.grid_node(gx, gy, F.col("photo")).alias("node")).agg(F.count("*").alias("n"))


@_f.query("j24_grid_neighbours", """WITH field AS (SELECT l_suppkey AS photo, l_linenumber % 8 AS ix, (l_partkey % 6) AS iy, sum(CAST(l_quantity AS BIGINT)) AS "offset" FROM lineitem GROUP BY 1, 2, 3)
SELECT a.photo, count(*) AS n, sum(abs(a."offset" - b."offset"))::BIGINT AS roughness FROM field a JOIN field b ON a.photo = b.photo AND ((b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.ix = a.ix AND b.iy = a.iy + 1)) GROUP BY a.photo""")
def j24(spark, sf):
    """Neighbours, right and down, of the nodes of a grid; each supplier's items make the values of one."""
    items = table(spark, sf, "lineitem")
    field = items.groupBy(F.col("l_suppkey").alias("photo"), (F.col("l_linenumber") % 8).cast("long").alias("ix"), (F.col("l_partkey") % 6).cast("long").alias("iy")).agg(F.sum(F.col("l_quantity").cast("long")).alias("offset"))
    # Each node is sent to the nodes left of it and above it: an equi-join, and one pass over the field.
    sent = field.select("photo", F.explode(F.array(F.struct((F.col("ix") - 1).alias("ix"), F.col("iy").alias("iy")), F.struct(F.col("ix").alias("ix"), (F.col("iy") - 1).alias("iy")))).alias("to"), F.col("offset").alias("other"))
    both = field.join(sent.select("photo", "to.ix", "to.iy", "other"), ["photo", "ix", "iy"])
    return both.groupBy("photo").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("offset") - F.col("other"))).alias("roughness"))


_GEO = f"""WITH {V.SURFELS}, {V.PHOTO_SQL}, c AS (SELECT floor(x / 0.1)::BIGINT AS cx, floor(y / 0.1)::BIGINT AS cy, floor(z / 0.1)::BIGINT AS cz, min(point_id) AS representative, count(*) AS n FROM ept GROUP BY 1, 2, 3),
q0 AS (SELECT c.*, photo, x - px AS ax, y - py AS ay, z - pz AS az, nx, ny, nz FROM c JOIN ept ON point_id = representative, photos), q1 AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS dist, atan2(sqrt(ax * ax + ay * ay), az) AS theta FROM q0),
q AS (SELECT representative, n, photo, CASE WHEN -(nx * ax + ny * ay + nz * az) / dist > 0.05 THEN exp(-2.0 * theta * theta) / (dist * dist + 0.25) * (-(nx * ax + ny * ay + nz * az) / dist) * (-(nx * ax + ny * ay + nz * az) / dist) ELSE 0.0 END AS score FROM q1)"""


@_f.query("a32_photo_shortlist", _GEO + ", r AS (SELECT *, row_number() OVER (PARTITION BY representative ORDER BY score DESC, photo)::INT AS place FROM q WHERE score > 0) SELECT representative, photo, place, round(score, 5) + 0.0 AS score FROM r WHERE place <= 4")
def a32(spark, sf):
    q = K.geometric_scores(V.surfels(spark, sf), V.photos(spark, sf), 0.1)
    return K.shortlist(q, 4).select("representative", "photo", "place", rounded(F.col("score")).alias("score"))


@_f.query("a33_w12_w13_keyframes")
def a33(spark, sf):
    """Rows only: greedy choice, one aggregation a step; tests hold it against a plain loop."""
    return K.keyframes(K.geometric_scores(V.surfels(spark, sf), V.photos(spark, sf), 0.1), 3)


@_f.query("a34_rescue", _GEO + ", r AS (SELECT *, row_number() OVER (PARTITION BY representative ORDER BY score DESC, photo) AS place FROM q WHERE score > 0), kept AS (SELECT representative, photo FROM r WHERE place <= 2 AND photo % 2 = 0), spare AS (SELECT r.representative, r.photo, r.score FROM r WHERE place <= 4 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.representative = r.representative)), best AS (SELECT representative, arg_min(photo, {s: -score, p: photo}) AS photo FROM spare GROUP BY 1) SELECT representative, photo, FALSE AS rescued FROM kept UNION ALL SELECT representative, photo, TRUE FROM best")
def a34(spark, sf):
    short = K.shortlist(K.geometric_scores(V.surfels(spark, sf), V.photos(spark, sf), 0.1), 4)
    return K.rescued(short.where("place <= 2 AND photo % 2 = 0"), short).select("representative", "photo", "rescued")


@_f.query("a42_j32_u04_j23_metrics", TOP + ", best AS (SELECT point_id, photo, slot FROM views), alt AS (SELECT point_id, photo, slot FROM views WHERE photo % 3 <> 0) SELECT (SELECT count(*) FROM (SELECT point_id, photo FROM best INTERSECT SELECT point_id, photo FROM alt)) AS common, (SELECT count(*) FROM (SELECT point_id, photo FROM best EXCEPT SELECT point_id, photo FROM alt)) AS lost, (SELECT count(*) FROM (SELECT point_id, photo FROM alt EXCEPT SELECT point_id, photo FROM best)) AS gained, (SELECT count(*) FROM best a JOIN alt b ON a.point_id = b.point_id AND a.slot = 0 AND b.slot = 0) AS same_top")
def a42(spark, sf):
    best = _views(spark, sf).select("point_id", "photo", "slot")
    return K.coverage(best, best.where("photo % 3 <> 0"))


@_f.query("m05_camera_pose", f"WITH {V.POSES}, m AS (SELECT t_us, x, y, z, 1 - 2 * (qz / sqrt(qz*qz+qw*qw)) * (qz / sqrt(qz*qz+qw*qw)) AS c, 2 * (qz / sqrt(qz*qz+qw*qw)) * (qw / sqrt(qz*qz+qw*qw)) AS s FROM poses) SELECT t_us, round(x + c * 0.1 - s * 0.2, 4) + 0.0 AS px, round(y + s * 0.1 + c * 0.2, 4) + 0.0 AS py, round(z + 0.3, 4) + 0.0 AS pz FROM m")
def m05(spark, sf):
    q = [d(0), d(0), F.col("qz"), F.col("qw")]
    at = G.transform(q, xyz(), [d(0.1), d(0.2), d(0.3)])
    return V.poses(spark, sf).select("t_us", *[rounded(v, 4).alias(n) for v, n in zip(at, ("px", "py", "pz"), strict=True)])


@_f.query("m16_m35_costs", f"WITH {V.SURFELS} SELECT point_id, round(CASE WHEN abs(x * 50) <= 8 THEN 0.5 * abs(x * 50) * abs(x * 50) ELSE 8 * (abs(x * 50) - 4) END, 5) + 0.0 AS huber, round(ln(1 + y * y / 0.01), 5) + 0.0 AS cauchy, round(exp(-2.0 * x * x) / (y * y + 0.25) * greatest(z, 0.05) * greatest(z, 0.05), 5) + 0.0 AS score FROM ept")
def m16(spark, sf):
    e = V.surfels(spark, sf)
    return e.select("point_id", rounded(C.huber_cost(F.col("x") * 50, 8.0)).alias("huber"), rounded(C.cauchy_cost(F.col("y"), 0.1)).alias("cauchy"), rounded(C.view_score(F.col("x"), F.abs("y"), F.col("z"))).alias("score"))


@_f.query("m42_intervals", f"WITH {V.SURFELS} SELECT point_id, round(least(x * nx, x * (nx + 1), (x + 1) * nx, (x + 1) * (nx + 1)), 5) + 0.0 AS low, round(greatest(x * nx, x * (nx + 1), (x + 1) * nx, (x + 1) * (nx + 1)), 5) + 0.0 AS high FROM ept")
def m42(spark, sf):
    low, high = C.interval_product((F.col("x"), F.col("x") + 1), (F.col("nx"), F.col("nx") + 1))
    return V.surfels(spark, sf).select("point_id", rounded(low).alias("low"), rounded(high).alias("high"))
