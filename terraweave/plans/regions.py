"""Queries on regions, outlines and slices."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terraweave.functions import geometry as G
from terraweave.functions.geometry import d, xyz
from terraweave.operators import regions as R
from terraweave.plans import views as V
from terraweave.plans.registry import Family, rounded

_f = Family()
QUERIES, ORACLE = _f.queries, _f.oracle
W = "WITH " + V.POINTS

# A concave outline and a box, in coordinates of the point view.
OUTLINE = [(0.5, 0.5), (4.5, 0.7), (4.0, 3.5), (2.5, 2.0), (1.0, 4.0)]
_E = [(OUTLINE[k - 1], OUTLINE[k]) for k in range(len(OUTLINE))]
INSIDE_SQL = "(" + " + ".join(f"CASE WHEN ({b[1]} > y) <> ({a[1]} > y) AND x < ({a[0]} - {b[0]})::DOUBLE * (y - {b[1]}) / ({a[1]} - {b[1]}) + {b[0]} THEN 1 ELSE 0 END" for a, b in _E) + ") % 2 = 1"
DIST_SQL = "sqrt(least(" + ", ".join(f"(x - ({a[0]} + greatest(0.0, least(1.0, ((x - {a[0]}) * {b[0] - a[0]!r}::DOUBLE + (y - {a[1]}) * {b[1] - a[1]!r}::DOUBLE) / {(b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2!r})) * {b[0] - a[0]!r}::DOUBLE)) ** 2 + (y - ({a[1]} + greatest(0.0, least(1.0, ((x - {a[0]}) * {b[0] - a[0]!r}::DOUBLE + (y - {a[1]}) * {b[1] - a[1]!r}::DOUBLE) / {(b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2!r})) * {b[1] - a[1]!r}::DOUBLE)) ** 2" for a, b in _E) + "))"
OPEN = [None, None, None]
REGIONS = [R.Region([1, 1, None], [2, 3, None]), R.Region(OPEN, OPEN, [R.Outline(OUTLINE)]), R.Region(OPEN, [None, None, 1.5], [R.Outline(OUTLINE, ring=True, expand=0.3)])]


@_f.query("f20_inside_polygon", W + f" SELECT count(*) AS n, round(sum(x), 3) + 0.0 AS sx FROM pts WHERE {INSIDE_SQL}")
def f20(spark, sf):
    return V.points(spark, sf).where(G.inside_outline(F.col("x"), F.col("y"), OUTLINE)).agg(F.count("*").alias("n"), rounded(F.sum("x"), 3).alias("sx"))


@_f.query("f21_m33_ring", W + f" SELECT point_id, round({DIST_SQL}, 4) + 0.0 AS away FROM pts WHERE NOT ({INSIDE_SQL}) AND {DIST_SQL} <= 0.3")
def f21(spark, sf):
    away = G.distance_to_outline(F.col("x"), F.col("y"), OUTLINE)
    return V.points(spark, sf).where(R.Outline(OUTLINE, True, 0.3).test(F.col("x"), F.col("y"))).select("point_id", rounded(away, 4).alias("away"))


@_f.query("f19_u01_j28_regions", W + f" SELECT point_id FROM pts WHERE (x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 3) OR {INSIDE_SQL} OR (z <= 1.5 AND NOT ({INSIDE_SQL}) AND {DIST_SQL} <= 0.3)")
def f19(spark, sf):
    return R.select_regions(V.points(spark, sf), REGIONS).select("point_id")


@_f.query("f22_height_window", W + " SELECT count(*) FILTER (WHERE z >= 1.5) AS from_below, count(*) FILTER (WHERE z <= 2.5) AS to_top, count(*) FILTER (WHERE z BETWEEN 1.5 AND 2.5) AS both FROM pts")
def f22(spark, sf):
    window = lambda lo, hi: R.Region([None, None, lo], [None, None, hi]).test(xyz())
    return V.points(spark, sf).agg(F.count_if(window(1.5, None)).alias("from_below"), F.count_if(window(None, 2.5)).alias("to_top"), F.count_if(window(1.5, 2.5)).alias("both"))


@_f.query("j28_box_semi_join", W + ", boxes AS (SELECT n_nationkey / 5.0::DOUBLE AS x0, n_nationkey / 5.0::DOUBLE + 0.1 AS x1, n_nationkey / 6.0::DOUBLE AS y0, n_nationkey / 6.0::DOUBLE + 0.3 AS y1 FROM nation) SELECT point_id FROM pts WHERE EXISTS (SELECT 1 FROM boxes WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)")
def j28(spark, sf):
    from terraweave.session import table

    k = F.col("n_nationkey")
    boxes = table(spark, sf, "nation").select((k / 5.0).alias("x0"), (k / 5.0 + 0.1).alias("x1"), (k / 6.0).alias("y0"), (k / 6.0 + 0.3).alias("y1"))
    return R.semi_join_regions(V.points(spark, sf), boxes).select("point_id")


@_f.query("u02_u05_sources", W + " SELECT source, count(*) AS n FROM (SELECT 'a' AS source FROM pts WHERE x BETWEEN 1 AND 3 UNION ALL SELECT 'b' FROM pts WHERE y BETWEEN 1 AND 3) GROUP BY source")
def u02(spark, sf):
    p = V.points(spark, sf)
    a, b = (R.select_regions(p, [R.Region(low, high)]).select(F.lit(n).alias("source")) for n, low, high in (("a", [1, None, None], [3, None, None]), ("b", [None, 1, None], [None, 3, None])))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"))


@_f.query("j27_u03_m34_effective_boxes", "WITH RECURSIVE " + V.SLICES + ", up AS (SELECT id, x0, x1, 0 AS level FROM slices WHERE parent IS NULL UNION ALL SELECT s.id, greatest(s.x0, up.x0), least(s.x1, up.x1), up.level + 1 FROM slices s JOIN up ON s.parent = up.id) SELECT id, level, CASE WHEN x0 <= x1 THEN x0 END AS x0, CASE WHEN x0 <= x1 THEN x1 END AS x1 FROM up")
def j27(spark, sf):
    return R.effective_boxes(V.slices(spark, sf))


@_f.query("j27_descendants", "WITH RECURSIVE " + V.SLICES + ", down AS (SELECT 2::BIGINT AS id, 0 AS level UNION ALL SELECT s.id, down.level + 1 FROM slices s JOIN down ON s.parent = down.id) SELECT * FROM down")
def j27b(spark, sf):
    return R.descendants(V.slices(spark, sf), 2)


@_f.query("w11_s26_preview", W + ", h AS (SELECT point_id, x, substr(md5(point_id::VARCHAR), 1, 4) AS h FROM pts), c AS (SELECT h, count(*) AS n FROM h GROUP BY h), u AS (SELECT h, sum(n) OVER (ORDER BY h) AS upto FROM c) SELECT point_id, round(x - 2.5, 5) + 0.0 AS x FROM h WHERE h IN (SELECT h FROM u WHERE upto <= 5000)")
def w11(spark, sf):
    return R.systematic_sample(V.points(spark, sf), 5000).select("point_id", rounded(F.col("x") - 2.5).alias("x"))


_C, _S = math.cos(0.5), math.sin(0.5)


@_f.query("m28_display_transform", W + f" SELECT point_id, round((x - 1) * {_C!r}::DOUBLE - (y - 2) * {_S!r}::DOUBLE + 1 + 0.5, 4) + 0.0 AS x, round((x - 1) * {_S!r}::DOUBLE + (y - 2) * {_C!r}::DOUBLE + 2, 4) + 0.0 AS y, round(z + 0.25, 4) + 0.0 AS z FROM pts")
def m28(spark, sf):
    at = R.moved(xyz(), G.euler_matrix(d(0), d(0), d(0.5)), (1, 2, 0), (0.5, 0, 0.25))
    return V.points(spark, sf).select("point_id", *[rounded(v, 4).alias(c) for v, c in zip(at, "xyz", strict=True)])


@_f.query("a40_bounds_under_mask", W + f" SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) + 0.0 AS z0, max(z) AS z1 FROM pts WHERE {INSIDE_SQL}")
def a40(spark, sf):
    return R.bounds_under(V.points(spark, sf), R.Outline(OUTLINE).test(F.col("x"), F.col("y"))).withColumn("z0", F.col("z0") + 0.0)


def _triangles(spark, sf):
    """A triangle for each part."""
    from terraweave.session import spread, table

    p = F.col("p_partkey").cast("double")
    s = F.col("p_size").cast("double")
    v = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((d(0), d(0)), (s, d(1)), (s / 2, s + 1))])
    return spread(table(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", p.alias("p"), s.alias("s"), v.alias("v"))


@_f.query("m29_m32_polygon_measures", "SELECT p_partkey, round(abs(p_size::DOUBLE * (p_size + 1) - p_size / 2.0::DOUBLE) / 2, 4) + 0.0 AS area, round((p_size + p_size / 2.0::DOUBLE) / 3, 4) + 0.0 AS cx, round((1 + p_size + 1) / 3.0::DOUBLE, 4) + 0.0 AS cy, -0.5::DOUBLE AS x0, (p_size + 1.5)::DOUBLE AS y1 FROM part")
def m29(spark, sf):
    v = F.col("v")
    cx, cy = G.centroid(v)
    b = G.bounds(v, 0.5)
    return _triangles(spark, sf).select("p_partkey", rounded(G.area(v), 4).alias("area"), rounded(cx, 4).alias("cx"), rounded(cy, 4).alias("cy"), b[0].alias("x0"), b[3].alias("y1"))


@_f.query("m30_placed_shape", f"SELECT p_partkey, round(p_size * {_C!r}::DOUBLE - {_S!r}::DOUBLE + 3, 4) + 0.0 AS x, round(p_size * {_S!r}::DOUBLE + {_C!r}::DOUBLE - 1, 4) + 0.0 AS y FROM part")
def m30(spark, sf):
    at = F.get(G.placed(F.col("v"), d(0.5), d(3), d(-1)), F.lit(1))
    return _triangles(spark, sf).select("p_partkey", rounded(at["x"], 4).alias("x"), rounded(at["y"], 4).alias("y"))


_CORNERS = "[{x: 0.0::DOUBLE, y: 0.0::DOUBLE, ax: s / 2, ay: s + 1, bx: s, b_y: 1.0::DOUBLE}, {x: s, y: 1.0::DOUBLE, ax: 0.0::DOUBLE, ay: 0.0::DOUBLE, bx: s / 2, b_y: s + 1}, {x: s / 2, y: s + 1, ax: s, ay: 1.0::DOUBLE, bx: 0.0::DOUBLE, b_y: 0.0::DOUBLE}]"


@_f.query("m31_offset_polygon", f"WITH t AS (SELECT p_partkey, p_size::DOUBLE AS s FROM part), c AS (SELECT p_partkey, unnest({_CORNERS}) AS c FROM t), e AS (SELECT p_partkey, c.x, c.y, c.x - c.ax AS dx, c.y - c.ay AS dy, c.bx - c.x AS ex, c.b_y - c.y AS ey FROM c), n AS (SELECT *, dy / sqrt(dx * dx + dy * dy) AS px, -dx / sqrt(dx * dx + dy * dy) AS py, ey / sqrt(ex * ex + ey * ey) AS qx, -ex / sqrt(ex * ex + ey * ey) AS qy FROM e), m AS (SELECT *, px + qx AS mx, py + qy AS my, sqrt((px + qx) * (px + qx) + (py + qy) * (py + qy)) AS m FROM n) SELECT p_partkey, round(x + mx / m * 0.5 / greatest((px * mx + py * my) / m, 0.3), 4) + 0.0 AS x, round(y + my / m * 0.5 / greatest((px * mx + py * my) / m, 0.3), 4) + 0.0 AS y FROM m")
def m31(spark, sf):
    return _triangles(spark, sf).select("p_partkey", F.explode(G.offset_polygon(F.col("v"), 0.5)).alias("p")).select("p_partkey", rounded(F.col("p.x"), 4).alias("x"), rounded(F.col("p.y"), 4).alias("y"))


_ARCS = f"""WITH t AS (SELECT p_partkey, p_size::DOUBLE AS s FROM part), c AS (SELECT p_partkey, unnest({_CORNERS}) AS c FROM t),
e AS (SELECT p_partkey, c.x, c.y, c.x - c.ax AS dx, c.y - c.ay AS dy, c.bx - c.x AS ex, c.b_y - c.y AS ey FROM c),
n AS (SELECT *, atan2(-dx, dy) AS first, atan2(-ex, ey) - atan2(-dx, dy) AS turn FROM e),
w AS (SELECT p_partkey, x, y, first, CASE WHEN turn < 0 THEN turn + 2 * pi() ELSE turn END AS turn FROM n),
k AS (SELECT *, greatest(2, ceil(turn / (15 * pi() / 180))::BIGINT) AS steps FROM w),
o AS (SELECT *, unnest(range(steps + 1)) AS i FROM k)
SELECT p_partkey, round(x + 0.5 * cos(first + turn * i / steps), 4) + 0.0 AS x, round(y + 0.5 * sin(first + turn * i / steps), 4) + 0.0 AS y FROM o"""


@_f.query("m31_band_outline", _ARCS)
def m31_band(spark, sf):
    """Outlines half a unit around triangles, whose corners are all convex; tests have concave ones."""
    out = _triangles(spark, sf).select("p_partkey", F.explode(G.band_outline(F.col("v"), 0.5)).alias("p"))
    return out.select("p_partkey", rounded(F.col("p.x"), 4).alias("x"), rounded(F.col("p.y"), 4).alias("y"))
