"""Queries on point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.functions import camera as C
from terraweave.functions import geometry as G
from terraweave.functions.geometry import d, xyz
from terraweave.operators import points as P
from terraweave.operators import surfaces as S
from terraweave.plans import views as V
from terraweave.plans.registry import Family, rounded

_f = Family()
QUERIES, ORACLE = _f.queries, _f.oracle
W = "WITH " + V.POINTS
WE = "WITH " + V.SURFELS
ORIGIN_SQL = "origins AS (SELECT f::BIGINT AS frame, f / 2.0::DOUBLE AS ox, f / 3.0::DOUBLE AS oy, -2.0::DOUBLE AS oz FROM range(1, 8) r(f))"
CELL_SQL = "floor(x / {s})::BIGINT AS cx, floor(y / {s})::BIGINT AS cy, floor(z / {s})::BIGINT AS cz"


def origins(spark):
    """Sensor position of each of the seven frames."""
    return spark.range(1, 8).select(F.col("id").alias("frame"), (F.col("id") / 2.0).alias("ox"), (F.col("id") / 3.0).alias("oy"), d(-2.0).alias("oz"))


@_f.query("f01_valid_returns", W + " SELECT point_id, round(sqrt(x * x + y * y + z * z), 5) + 0.0 AS range, x * x + y * y + z * z <= 9.0 AS near FROM pts WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND x * x + y * y + z * z BETWEEN 0.25 AND 10000.0 AND tag & 48 = 0")
def f01(spark, sf):
    return P.valid_returns(V.points(spark, sf), near=3.0).select("point_id", rounded(F.col("range")).alias("range"), "near")


@_f.query("f04_frame_range", W + " SELECT frame, count(*) AS n, round(sum(intensity), 2) + 0.0 AS intensity FROM pts WHERE frame BETWEEN 2 AND 4 GROUP BY frame")
def f04(spark, sf):
    return V.points(spark, sf).where(F.col("frame").between(2, 4)).groupBy("frame").agg(F.count("*").alias("n"), rounded(F.sum("intensity").cast("double"), 2).alias("intensity"))


@_f.query("f05_finite", W + ", odd AS (SELECT point_id, CASE WHEN tag = 1 THEN 'nan'::DOUBLE WHEN tag = 2 THEN 'inf'::DOUBLE ELSE x END AS x FROM pts) SELECT count(*) AS kept FROM odd WHERE isfinite(x)")
def f05(spark, sf):
    odd = V.points(spark, sf).withColumn("x", F.when(F.col("tag") == 1, d(float("nan"))).when(F.col("tag") == 2, d(float("inf"))).otherwise(F.col("x")))
    return odd.where(G.finite(F.col("x"))).agg(F.count("*").alias("kept"))


@_f.query("f06_rays", W + f", {ORIGIN_SQL} SELECT point_id, frame, round(sqrt((x-ox)*(x-ox)+(y-oy)*(y-oy)+(z-oz)*(z-oz)), 5) + 0.0 AS distance FROM pts JOIN origins USING (frame) WHERE (x-ox)*(x-ox)+(y-oy)*(y-oy)+(z-oz)*(z-oz) BETWEEN 0.01 AND 20.0")
def f06(spark, sf):
    return P.rays(V.points(spark, sf), origins(spark), 0.01, 20.0).select("point_id", "frame", rounded(F.col("distance")).alias("distance"))


def _slab(axis, o, low, high):
    step = f"({axis} - {o})"
    return f"CASE WHEN abs{step} < 1e-12 THEN 0.0 ELSE greatest(0.0, least(({low} - {o}) / {step}, ({high} - {o}) / {step})) END", f"CASE WHEN abs{step} < 1e-12 THEN 1.0 ELSE least(1.0, greatest(({low} - {o}) / {step}, ({high} - {o}) / {step})) END", f"(abs{step} >= 1e-12 OR {axis} BETWEEN {low} AND {high})"


def _box(low, high):
    s = [_slab(a, o, lo, hi) for a, o, lo, hi in zip("xyz", ("ox", "oy", "oz"), low, high, strict=True)]
    return f"greatest({', '.join(x[0] for x in s)})", f"least({', '.join(x[1] for x in s)})", " AND ".join(x[2] for x in s)


_LOW, _HIGH = (1.0, 0.5, 0.5), (3.0, 2.5, 2.0)
_grown = _box([v - 0.06 for v in _LOW], [v + 0.06 for v in _HIGH])
_core = _box(_LOW, _HIGH)


@_f.query("f07_f08_f09_ray_clipping", W + f", {ORIGIN_SQL}, rays AS (SELECT *, sqrt((x-ox)*(x-ox)+(y-oy)*(y-oy)+(z-oz)*(z-oz)) AS distance FROM pts JOIN origins USING (frame)), boxed AS (SELECT *, {_grown[0]} AS ge, {_grown[1]} AS gl, {_grown[2]} AS gp, {_core[0]} AS ce, {_core[1]} AS cl, {_core[2]} AS cp FROM rays WHERE distance * distance BETWEEN 0.01 AND 40000) SELECT point_id, CASE WHEN cp AND ce <= cl THEN round(ce * distance, 5) + 0.0 END AS start_distance, x BETWEEN 1 AND 3 AND y BETWEEN 0.5 AND 2.5 AND z BETWEEN 0.5 AND 2 AS endpoint_inside FROM boxed WHERE gp AND ge <= gl")
def f09(spark, sf):
    found = P.clipped_rays(P.rays(V.points(spark, sf), origins(spark)), _LOW, _HIGH)
    return found.select("point_id", rounded(F.col("start_distance")).alias("start_distance"), "endpoint_inside")


@_f.query("m08_m11_voxel_cells", W + " SELECT point_id, floor(x / 0.3)::BIGINT AS cx, floor(y / 0.3)::BIGINT AS cy, floor((z - 2.0) / 0.3)::BIGINT AS cz, ((floor(x / 0.3)::BIGINT + 1048576) * 4398046511104 + (floor(y / 0.3)::BIGINT + 1048576) * 2097152 + (floor((z - 2.0) / 0.3)::BIGINT + 1048576)) + 1 AS key, trunc(CASE WHEN (z - 2.0) / 0.5 < 0 THEN (z - 2.0) / 0.5 - 1 ELSE (z - 2.0) / 0.5 END)::BIGINT AS down, trunc((x - 2.0) / 0.05)::BIGINT + 11 AS smooth FROM pts")
def m08(spark, sf):
    p = V.points(spark, sf).select("point_id", "x", "y", (F.col("z") - 2.0).alias("z"))
    keyed = P.with_cells(p, 0.3).withColumn("key", G.packed_key(*[F.col(c) for c in P.CELL]))
    return keyed.select("point_id", *P.CELL, "key", G.downsample_cell(F.col("z"), 0.5).alias("down"), G.truncated_cell(F.col("x"), d(2.0), 0.05).alias("smooth"))


@_f.query("a03_first_in_voxel", W + f", c AS (SELECT *, {CELL_SQL.format(s=0.6)} FROM pts), r AS (SELECT frame, cx, cy, cz, arg_min(point_id, {{t: t_us, p: point_id}}) AS point_id FROM c GROUP BY frame, cx, cy, cz) SELECT * FROM r")
def a03(spark, sf):
    return P.first_in_voxel(V.points(spark, sf), 0.6, F.struct("t_us", "point_id"), ["frame"]).select("frame", *P.CELL, "point_id")


@_f.query("a04_voxel_fusion", W + f", c AS (SELECT *, {CELL_SQL.format(s=0.4)} FROM pts) SELECT cx, cy, cz, round(avg(x), 5) + 0.0 AS x, round(avg(y), 5) + 0.0 AS y, round(avg(z), 5) + 0.0 AS z, count(*) AS samples, count(DISTINCT frame) AS frames FROM c GROUP BY cx, cy, cz HAVING count(DISTINCT frame) >= 2")
def a04(spark, sf):
    return P.fused(V.points(spark, sf), 0.4, 2).select(*P.CELL, *[rounded(F.col(c)).alias(c) for c in "xyz"], "samples", "frames")


@_f.query("a05_first_n_in_voxel", W + f", c AS (SELECT *, {CELL_SQL.format(s=0.8)} FROM pts WHERE sqrt(x * x + y * y + z * z) <= 4.0), r AS (SELECT cx, cy, cz, point_id, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY point_id)::INT AS place FROM c) SELECT * FROM r WHERE place <= 5")
def a05(spark, sf):
    return P.first_n_in_voxel(V.points(spark, sf), 0.8, 5, 4.0).select(*P.CELL, "point_id", "place")


@_f.query("a06_occupied_voxels", W + f", c AS (SELECT DISTINCT {CELL_SQL.format(s=0.25)} FROM pts) SELECT cx, cy, cz, (cx + 0.5) * 0.25 AS centre_x, (cy + 0.5) * 0.25 AS centre_y, (cz + 0.5) * 0.25 AS centre_z FROM c")
def a06(spark, sf):
    return P.occupied(V.points(spark, sf), 0.25)


@_f.query("a09_nearest_to_centre", W + f", c AS (SELECT *, {CELL_SQL.format(s=0.2)} FROM pts), o AS (SELECT *, (x - (cx + 0.5) * 0.2) * (x - (cx + 0.5) * 0.2) + (y - (cy + 0.5) * 0.2) * (y - (cy + 0.5) * 0.2) + (z - (cz + 0.5) * 0.2) * (z - (cz + 0.5) * 0.2) AS o2 FROM c), b AS (SELECT cx, cy, cz, min({{o2: o2, p: point_id}}) AS b FROM o GROUP BY cx, cy, cz) SELECT cx, cy, cz, b.p AS point_id, round(sqrt(b.o2), 5) + 0.0 AS off FROM b")
def a09(spark, sf):
    return P.nearest_to_centre(V.points(spark, sf), 0.2).select(*P.CELL, "point_id", rounded(F.col("off")).alias("off"))


@_f.query("a10_first_writer", W + f", c AS (SELECT point_id, frame % 2 AS context, intensity % 3 AS level, trunc((x - 2.5) / 0.5)::BIGINT + 1 AS cx, trunc((y - 2.5) / 0.5)::BIGINT + 1 AS cy FROM pts) SELECT context, level, cx, cy, min(point_id) AS point_id FROM c GROUP BY context, level, cx, cy")
def a10(spark, sf):
    p = V.points(spark, sf).select("point_id", (F.col("frame") % 2).alias("context"), (F.col("intensity") % 3).alias("level"), G.truncated_cell(F.col("x"), d(2.5), 0.5).alias("cx"), G.truncated_cell(F.col("y"), d(2.5), 0.5).alias("cy"))
    return p.groupBy("context", "level", "cx", "cy").agg(F.min("point_id").alias("point_id"))


@_f.query("a11_a13_j16_density_blocks", W + f", {ORIGIN_SQL}, b AS (SELECT floor(x)::BIGINT AS kx, floor(y)::BIGINT AS ky, floor(z)::BIGINT AS kz, count(*) AS n FROM pts GROUP BY 1, 2, 3 HAVING count(*) > 7), t AS (SELECT kx, ky, kz, n, min(sqrt((kx + 0.5 - ox) ** 2 + (ky + 0.5 - oy) ** 2 + (kz + 0.5 - oz) ** 2)) AS d FROM b, origins GROUP BY ALL) SELECT kx, ky, kz, n, round(d, 5) + 0.0 AS to_trajectory, CASE WHEN d <= 3 THEN 1 ELSE 0 END AS required FROM t")
def a11(spark, sf):
    return P.density_blocks(V.points(spark, sf), origins(spark).drop("frame"), near=3.0).withColumn("to_trajectory", rounded(F.col("to_trajectory")))


@_f.query("a12_j15_spacing", WE + ", n AS (SELECT a.label, a.point_id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS s FROM ept a JOIN ept b ON a.label = b.label AND a.point_id <> b.point_id WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 0.25 GROUP BY 1, 2), m AS (SELECT label, count(*) AS n, avg(s) AS spacing FROM n GROUP BY label) SELECT label, n, round(spacing, 5) + 0.0 AS spacing, (CASE WHEN spacing >= 0.05 THEN 1 ELSE 0 END + CASE WHEN spacing >= 0.07 THEN 1 ELSE 0 END + CASE WHEN spacing >= 0.1 THEN 1 ELSE 0 END)::INT AS level FROM m")
def a12(spark, sf):
    near = P.nearest_other(V.surfels(spark, sf), "label", 0.25).groupBy("label").agg(F.count("*").alias("n"), F.avg("spacing").alias("spacing"))
    return near.select("label", "n", rounded(F.col("spacing")).alias("spacing"), P.level_of(F.col("spacing"), (0.05, 0.07, 0.1)).alias("level"))


@_f.query("j12_a14_stencil", W + f", c AS (SELECT frame % 2 AS context, {CELL_SQL.format(s=0.5)}, min(t_us) AS t FROM pts GROUP BY 1, 2, 3, 4) SELECT a.context, a.cx, a.cy, a.cz, count(*) FILTER (WHERE abs(a.t - b.t) > 86400000000 * 30) AS neighbours FROM c a JOIN c b ON a.context = b.context AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.cz - b.cz) <= 1 GROUP BY 1, 2, 3, 4")
def a14(spark, sf):
    cells = P.with_cells(V.points(spark, sf), 0.5).groupBy((F.col("frame") % 2).alias("context"), *P.CELL).agg(F.min("t_us").alias("t"))
    apart = F.abs(F.col("a.t") - F.col("b.t")) > 86400000000 * 30
    return P.stencil_count(cells, 1, ["context"], apart).drop("t")


@_f.query("j13_halo_blocks", W + ", o AS (SELECT unnest([-1, 0, 1]) AS o), e AS (SELECT point_id, x, y, z, floor(x)::BIGINT AS ox, floor(y)::BIGINT AS oy, floor(z)::BIGINT AS oz, floor(x)::BIGINT + a.o AS kx, floor(y)::BIGINT + b.o AS ky, floor(z)::BIGINT + c.o AS kz FROM pts, o a, o b, o c) SELECT kx, ky, kz, count(*) AS n, count(*) FILTER (WHERE kx = ox AND ky = oy AND kz = oz) AS core FROM e WHERE (kx = ox OR CASE WHEN kx < ox THEN x - ox < 0.05 ELSE 1 - (x - ox) < 0.05 END) AND (ky = oy OR CASE WHEN ky < oy THEN y - oy < 0.05 ELSE 1 - (y - oy) < 0.05 END) AND (kz = oz OR CASE WHEN kz < oz THEN z - oz < 0.05 ELSE 1 - (z - oz) < 0.05 END) GROUP BY kx, ky, kz")
def j13(spark, sf):
    return P.halo_blocks(V.points(spark, sf), 1.0, 0.05).groupBy("kx", "ky", "kz").agg(F.count("*").alias("n"), F.count_if("core").alias("core"))


@_f.query("j14_a18_a19_subfiles", W + ", s AS (SELECT floor(x / 2.5)::BIGINT AS kx, floor(y / 2.5)::BIGINT AS ky, floor(z / 2.5)::BIGINT AS kz, * FROM pts) SELECT kx, ky, kz, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) + 0.0 AS z0, max(z) AS z1 FROM s GROUP BY kx, ky, kz HAVING count(*) >= 64")
def j14(spark, sf):
    sub = P.halo_blocks(V.points(spark, sf), 2.5, 0.05).where("core").groupBy("kx", "ky", "kz").agg(F.count("*").alias("n"), *[f(F.col(c)).alias(f"{c}{k}") for c in "xyz" for k, f in enumerate((F.min, F.max))])
    return sub.where("n >= 64").withColumn("z0", F.col("z0") + 0.0)


_AWAY = "sqrt(((cx + 0.5) * 0.5 - ox) ** 2 + ((cy + 0.5) * 0.5 - oy) ** 2 + ((cz + 0.5) * 0.5 - oz) ** 2)"
_RAYS_SQL = f"""{ORIGIN_SQL},
rays AS (SELECT *, sqrt((x-ox)*(x-ox)+(y-oy)*(y-oy)+(z-oz)*(z-oz)) AS distance FROM pts p JOIN origins USING (frame)),
dir AS (SELECT *, (x-ox)/distance AS ux, (y-oy)/distance AS uy, (z-oz)/distance AS uz, 0.1::DOUBLE AS t0, least(distance - 0.06, 30.0) AS t1 FROM rays WHERE distance * distance BETWEEN 0.01 AND 40000),
ends AS (SELECT *, floor((ox+ux*t0)/0.5)::BIGINT AS x0, floor((ox+ux*t1)/0.5)::BIGINT AS x1, floor((oy+uy*t0)/0.5)::BIGINT AS y0, floor((oy+uy*t1)/0.5)::BIGINT AS y1, floor((oz+uz*t0)/0.5)::BIGINT AS z0, floor((oz+uz*t1)/0.5)::BIGINT AS z1 FROM dir WHERE t1 > t0),
cutlist AS (SELECT *, list_sort(list_distinct(list_filter([t0, t1] || [(k * 0.5 - ox) / ux FOR k IN range(least(x0, x1) + 1, greatest(x0, x1) + 1)] || [(k * 0.5 - oy) / uy FOR k IN range(least(y0, y1) + 1, greatest(y0, y1) + 1)] || [(k * 0.5 - oz) / uz FOR k IN range(least(z0, z1) + 1, greatest(z0, z1) + 1)], lambda t: t BETWEEN t0 AND t1))) AS cuts FROM ends),
mids AS (SELECT *, unnest([(cuts[i] + cuts[i + 1]) / 2 FOR i IN range(1, len(cuts))]) AS tm FROM cutlist),
walked AS (SELECT point_id, ox, oy, oz, floor((ox+ux*tm)/0.5)::BIGINT AS cx, floor((oy+uy*tm)/0.5)::BIGINT AS cy, floor((oz+uz*tm)/0.5)::BIGINT AS cz FROM mids),
vox AS (SELECT DISTINCT {CELL_SQL.format(s=0.5)} FROM dir),
ev AS (SELECT cx, cy, cz, 0.1 * 30.0 / ({_AWAY} + 30.0) AS e FROM walked JOIN vox USING (cx, cy, cz) UNION ALL SELECT {CELL_SQL.format(s=0.5)}, -1.0 FROM dir WHERE distance <= 30),
scores AS (SELECT cx, cy, cz, sum(e) AS score FROM ev GROUP BY cx, cy, cz)"""


def _rays(spark, sf):
    return P.rays(V.points(spark, sf), origins(spark))


@_f.query("m12_x07_ray_cells", W + f", {_RAYS_SQL} SELECT cx, cy, cz, count(*) AS rays FROM walked GROUP BY cx, cy, cz")
def m12(spark, sf):
    return P.crossings(_rays(spark, sf), 0.5).groupBy(*P.CELL).agg(F.sum("n").alias("rays"))


@_f.query("a07_j10_j11_ray_evidence", W + f", {_RAYS_SQL} SELECT cx, cy, cz, round(score, 5) + 0.0 AS score FROM scores")
def a07(spark, sf):
    return P.ray_evidence(_rays(spark, sf), 0.5).withColumn("score", rounded(F.col("score")))


@_f.query("f10_f11_j09_a08_noise", W + f", {_RAYS_SQL}, c AS (SELECT point_id, {CELL_SQL.format(s=0.5)} FROM pts), k AS (SELECT coalesce(score, 0) AS score FROM c LEFT JOIN scores USING (cx, cy, cz)) SELECT count(*) AS points, count(*) FILTER (WHERE abs(score) >= 1e-6 AND score > 0.2) AS noise, count(*) FILTER (WHERE NOT (abs(score) >= 1e-6 AND score > 0.2)) AS kept FROM k")
def f10(spark, sf):
    found = P.classified(V.points(spark, sf), P.ray_evidence(_rays(spark, sf), 0.5), 0.5)
    return found.agg(F.count("*").alias("points"), F.count_if("noise").alias("noise"), F.count_if(~F.col("noise")).alias("kept"))


@_f.query("m13_intensity", W + " SELECT point_id, trunc(greatest(0.0, least(255.0, CASE WHEN intensity <= 50 THEN intensity * 4.0::DOUBLE ELSE (intensity - 50) * 55.0::DOUBLE / 205.0 + 200.0 END)))::INT AS stretched FROM pts")
def m13(spark, sf):
    return V.points(spark, sf).select("point_id", C.stretched_intensity(F.col("intensity")).alias("stretched"))


@_f.query("m14_point_times", W + ", f AS (SELECT frame, min(t_us) AS t FROM pts GROUP BY frame) SELECT point_id, round((f.t - (SELECT min(t) FROM f)) / 1e6 + pts.intensity * 0.001, 5) + 0.0 AS seconds FROM pts JOIN f USING (frame)")
def m14(spark, sf):
    p = V.points(spark, sf)
    frames = p.groupBy("frame").agg(F.min("t_us").alias("t"))
    first = frames.agg(F.min("t").alias("first"))
    return p.join(frames, "frame").crossJoin(first).select("point_id", rounded((F.col("t") - F.col("first")) / 1e6 + F.col("intensity") * 0.001).alias("seconds"))


@_f.query("m27_a31_j25_cell_index", WE + ", c AS (SELECT *, floor(x / 0.1)::BIGINT AS cx, floor(y / 0.1)::BIGINT AS cy, floor(z / 0.1)::BIGINT AS cz, (CASE WHEN nx >= 0 THEN 1 ELSE 0 END + CASE WHEN ny >= 0 THEN 2 ELSE 0 END + CASE WHEN nz >= 0 THEN 4 ELSE 0 END)::INT AS octant FROM ept), g AS (SELECT cx, cy, cz, octant, min(point_id) AS representative, count(*) AS n FROM c GROUP BY cx, cy, cz, octant) SELECT point_id, representative, n, octant FROM c JOIN g USING (cx, cy, cz, octant)")
def m27(spark, sf):
    celled = P.with_cells(V.surfels(spark, sf), 0.1).withColumn("octant", G.octant([F.col(c) for c in ("nx", "ny", "nz")]))
    key = [*P.CELL, "octant"]
    return celled.join(S.cell_index(celled, key), key).select("point_id", "representative", "n", "octant")


@_f.query("a35_plane_moments", W + f", c AS (SELECT *, {CELL_SQL.format(s=0.5)} FROM pts) SELECT cx, cy, cz, count(*) AS n, count(DISTINCT frame) AS frames, round(avg(x), 5) + 0.0 AS mx, round(avg(y), 5) + 0.0 AS my, round(avg(z), 5) + 0.0 AS mz, round(covar_pop(x, x), 5) + 0.0 AS xx, round(covar_pop(x, y), 5) + 0.0 AS xy, round(covar_pop(z, z), 5) + 0.0 AS zz FROM c GROUP BY cx, cy, cz HAVING count(*) >= 8 AND count(DISTINCT frame) >= 3")
def a35(spark, sf):
    m = S.plane_moments(P.with_cells(V.points(spark, sf), 0.5), P.CELL, 8, 3)
    return m.select(*P.CELL, "n", "frames", *[rounded(F.col(c)).alias(c) for c in ("mx", "my", "mz", "xx", "xy", "zz")])


@_f.query("a35_m26_a36_surfels")
def a36(spark, sf):
    """Rows only: eigenvectors are beyond SQL; tests hold them against NumPy."""
    return S.surfels(S.plane_moments(P.with_cells(V.points(spark, sf), 0.5), P.CELL, 8, 3), P.CELL)


@_f.query("a15_a16_a17_surface_smoothing")
def a15(spark, sf):
    """Rows only: neighbourhood covariances, normals and plane projections in blocks with a halo."""
    return S.smoothed_surface(V.surfels(spark, sf).drop("nx", "ny", "nz"), block=0.5, halo=0.2, radius=0.2, sensor=(0.0, 0.0, 5.0))


@_f.query("j17_j18_nearest_plane", WE + ", m AS (SELECT * FROM ept WHERE point_id % 2 = 0), q AS (SELECT * FROM ept WHERE point_id % 2 = 1), k AS (SELECT q.point_id, min({d: (q.x-m.x)*(q.x-m.x)+(q.y-m.y)*(q.y-m.y)+(q.z-m.z)*(q.z-m.z), m: m.point_id, r: (q.x-m.x)*m.nx+(q.y-m.y)*m.ny+(q.z-m.z)*m.nz}) AS k FROM q JOIN m ON (q.x-m.x)*(q.x-m.x)+(q.y-m.y)*(q.y-m.y)+(q.z-m.z)*(q.z-m.z) <= 0.0225 AND abs((q.x-m.x)*m.nx+(q.y-m.y)*m.ny+(q.z-m.z)*m.nz) <= 0.1 GROUP BY 1) SELECT point_id, k.m AS plane, round(k.r, 5) + 0.0 AS residual FROM k")
def j17(spark, sf):
    e = V.surfels(spark, sf)
    return S.match_planes(e.where("point_id % 2 = 1"), e.where("point_id % 2 = 0"), reach=0.15, residual=0.1).select("point_id", "plane", rounded(F.col("residual")).alias("residual"))


@_f.query("j20_modular_groups", W + " SELECT (frame // 10) % 3 AS map_group, ((frame // 10) + 1) % 3 AS align_to, ((frame // 10) + 2) % 3 AS validate_on, frame // 10 AS time_group, count(*) AS n FROM (SELECT point_id, frame * 7 AS frame FROM pts) GROUP BY ALL")
def j20(spark, sf):
    group = F.floor(F.col("frame") * 7 / 10).cast("long")
    return V.points(spark, sf).groupBy((group % 3).alias("map_group"), ((group + 1) % 3).alias("align_to"), ((group + 2) % 3).alias("validate_on"), group.alias("time_group")).agg(F.count("*").alias("n"))


@_f.query("f18_violations", W + " SELECT 'finite' AS rule, count(*) FILTER (WHERE NOT isfinite(x)) AS rows FROM pts UNION ALL SELECT 'unit_normal', count(*) FILTER (WHERE NOT abs(nx*nx+ny*ny+nz*nz-1) <= 1e-8) FROM pts UNION ALL SELECT 'range', count(*) FILTER (WHERE NOT x*x+y*y+z*z <= 30) FROM pts")
def f18(spark, sf):
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    return P.violations(V.points(spark, sf), {"finite": G.finite(F.col("x")), "unit_normal": F.abs(G.dot(n, n) - 1) <= 1e-8, "range": G.dot(xyz(), xyz()) <= 30})


@_f.query("f26_w03_export_rank", W + ", r AS (SELECT frame, point_id, row_number() OVER (PARTITION BY frame ORDER BY t_us, point_id) - 1 AS export_rank FROM pts) SELECT * FROM r")
def f26(spark, sf):
    return S.export_ranks(V.points(spark, sf)).select("frame", "point_id", "export_rank")


@_f.query("m23_m24_quantized", W + ", o AS (SELECT floor(min(x)) AS ox, floor(min(y)) AS oy, floor(min(z)) AS oz FROM pts) SELECT point_id, round_even((x - ox) / 1e-4, 0)::BIGINT AS qx, round_even((y - oy) / 1e-4, 0)::BIGINT AS qy, round_even((z - oz) / 1e-4, 0)::BIGINT AS qz, round_even(greatest(0.0, least(255.0, r::DOUBLE)) * 257, 0)::INT AS red, round_even(greatest(0.0, least(1.0, g / 255.0::DOUBLE)) * 65535, 0)::INT AS green, round_even(0.72 * 255, 0)::INT AS grey FROM pts, o")
def m23(spark, sf):
    p = V.points(spark, sf)
    o = p.agg(*[F.floor(F.min(c)).cast("double").alias(f"o{c}") for c in "xyz"])
    q = p.crossJoin(o)
    return q.select("point_id", *[C.quantized(F.col(c), F.col(f"o{c}")).alias(f"q{c}") for c in "xyz"], C.colour16(F.col("r").cast("double")).alias("red"), C.unit_colour16(F.col("g") / 255.0).alias("green"), C.unit_colour8(F.lit(None).cast("double")).alias("grey"))


@_f.query("a37_m35_pose_refinement")
def a37(spark, sf):
    """Rows only: Gauss-Newton steps of each frame against the planes of the cloud; tests recover a known shift."""
    from terraweave.operators.refinement import refine_poses

    pts = P.with_cells(V.points(spark, sf), 0.5)
    planes = S.surfels(S.plane_moments(pts, P.CELL, 8, 3), P.CELL, flat=0.5)
    return refine_poses(pts.drop(*P.CELL), planes, least=50, rounds=2, most_shift=0.5, most_turn=0.1)


@_f.query("t01_j19_a05_odometry")
def t01(spark, sf):
    """Rows only: scans of each recording registered one after the other; tests follow a known motion."""
    from terraweave.streaming import odometry

    return odometry.table(V.scans(spark, sf))


def _seen_scans(spark, sf):
    """Scans in world coordinates with the sensor's place."""
    placed = V.scans(spark, sf).join(F.broadcast(origins(spark)), "frame")  # seven rows
    return placed.select("recording", "frame", "sample", "x", "y", "z", F.col("ox").alias("sx"), F.col("oy").alias("sy"), F.col("oz").alias("sz"))


@_f.query("t04_a36_plane_cells", f"WITH {V.SCANS}, c AS (SELECT recording, {CELL_SQL.format(s=0.4)}, frame, x, y, z FROM scans) SELECT recording, cx, cy, cz, count(*) AS n, count(DISTINCT frame) AS frames, round(avg(x), 5) + 0.0 AS mx, round(avg(y), 5) + 0.0 AS my, round(avg(z), 5) + 0.0 AS mz FROM c GROUP BY recording, cx, cy, cz")
def t04_cells(spark, sf):
    """The map after the last frame; these clouds lie within its reach, so no cell is given up."""
    from terraweave.streaming import plane_map

    return plane_map.planes(_seen_scans(spark, sf)).select("recording", "cx", "cy", "cz", "n", "frames", *[rounded(F.col(c)).alias(c) for c in ("mx", "my", "mz")])


@_f.query("t04_plane_matches")
def t04_matches(spark, sf):
    """Rows only: what the planes of earlier frames say about the points of each frame; tests hold it against a plain loop."""
    from terraweave.streaming import plane_map

    return plane_map.table(_seen_scans(spark, sf))


@_f.query("t02_t03_inertial_states")
def t02(spark, sf):
    """Rows only: states at the ends of scans; samples are means of a scan's points, and each point lies near a plane through
    it. Tests hold propagation and corrections against disturbed starts and known motions."""
    from terraweave.streaming import inertial

    s = V.scans(spark, sf)
    half = F.pmod("sample", F.lit(2))
    means = s.groupBy("recording", "frame", half.alias("half")).agg(*[F.avg(c).alias(c) for c in "xyz"])
    rates = [((F.col(c) - 2.0) / 100).alias(n) for c, n in zip("xyz", ("ax", "ay", "az"), strict=True)]
    forces = [((F.col(c) - 2.0) / 50 + (9.81 if c == "z" else 0.0)).alias(n) for c, n in zip("xyz", ("bx", "by", "bz"), strict=True)]
    samples = means.select("recording", (F.col("frame") / 10 + F.col("half") / 20).alias("t"), F.lit(0).alias("kind"), "frame", F.col("half").alias("sample"), *rates, *forces)
    axis, off = F.pmod("sample", F.lit(3)), (F.pmod(F.floor(F.col("sample") / 3), F.lit(101)) - 50) / 5000
    on = {n: F.when(axis == k, d(1)).otherwise(d(0)) for k, n in enumerate(("cx", "cy", "cz"))}
    points = s.select("recording", (F.col("frame") / 10 + 0.03).alias("t"), F.lit(1).alias("kind"), "frame", "sample", *[F.col(c).alias(f"a{c}") for c in "xyz"], *[(F.col(c) + off * on[f"c{c}"]).alias(f"b{c}") for c in "xyz"], *[v.alias(n) for n, v in on.items()], d(9e-4).alias("variance"))
    return inertial.table(points.unionByName(samples, allowMissingColumns=True).fillna(0.0, ["cx", "cy", "cz", "variance"]))


@_f.query("w12_w13_spaced_ids", "WITH c AS (SELECT count(*) AS n FROM orders), k AS (SELECT i, floor(i * (n - 1) / 499.0::DOUBLE)::BIGINT AS id, i // 62 AS win FROM range(500) r(i), c) SELECT win, count(DISTINCT id) AS ids, min(id) AS first, max(id) AS last FROM k GROUP BY win")
def w12(spark, sf):
    """Evenly spaced ids, in windows of 62."""
    from terraweave.session import table

    n = table(spark, sf, "orders").agg(F.count("*").alias("n"))
    k = spark.range(500).crossJoin(n).select(F.floor(F.col("id") / 62).cast("long").alias("win"), F.floor(F.col("id") * (F.col("n") - 1) / 499.0).cast("long").alias("id"))
    return k.groupBy("win").agg(F.count_distinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"))


@_f.query("s31_far_returns", W + " SELECT point_id, frame, round(sqrt(x * x + y * y + z * z), 5) + 0.0 AS range FROM pts WHERE x * x + y * y + z * z >= 25.0")
def s31(spark, sf):
    r2 = G.dot(xyz(), xyz())
    return V.points(spark, sf).where(r2 >= 25.0).select("point_id", "frame", rounded(F.sqrt(r2)).alias("range"))
