"""Queries on series in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terraweave.functions.geometry import d
from terraweave.operators import series as T
from terraweave.plans import views as V
from terraweave.plans.registry import Family, rounded

_f = Family()
QUERIES, ORACLE = _f.queries, _f.oracle
W = "WITH " + V.SAMPLES
GAP = 3600.0
_ASOF = f"""WITH {V.POSES}, {V.SHOTS}, a AS (SELECT s.*, p.t_us AS a_t, p.x AS ax, p.y AS ay, p.qz AS aqz, p.qw AS aqw FROM shots s ASOF LEFT JOIN poses p ON s.recording = p.recording AND s.t_us > p.t_us),
b AS (SELECT a.*, p.t_us AS b_t, p.x AS wx, p.y AS wy, p.qz AS bqz, p.qw AS bqw FROM a ASOF LEFT JOIN poses p ON a.recording = p.recording AND a.t_us <= p.t_us),
c AS (SELECT *, (t_us - a_t) / (b_t - a_t)::DOUBLE AS share, CASE WHEN a_t IS NULL OR b_t IS NULL THEN 'outside pose coverage' WHEN (b_t - a_t) / 1e6 > {GAP} THEN 'pose gap exceeds limit' END AS reason FROM b)"""


def _asof(spark, sf):
    found = T.bracket(V.shots(spark, sf), V.poses(spark, sf), "recording", ["x", "y", "z", "qz", "qw"])
    return T.interpolated(found, GAP)


@_f.query("j01_m04_f23_pose_at_shot", _ASOF + " SELECT shot, reason, CASE WHEN reason IS NULL THEN round(ax + (wx - ax) * share, 4) + 0.0 END AS x, CASE WHEN reason IS NULL THEN round(ay + (wy - ay) * share, 4) + 0.0 END AS y FROM c")
def j01(spark, sf):
    ok = F.col("reason").isNull()
    return _asof(spark, sf).select("shot", "reason", *[F.when(ok, rounded(F.col(c), 4)).alias(c) for c in "xy"])


@_f.query("m02_m03_slerp", _ASOF + """, k AS (SELECT *, CASE WHEN aqz * bqz + aqw * bqw < 0 THEN -1.0 ELSE 1.0 END AS sg, abs(aqz * bqz + aqw * bqw) AS co FROM c WHERE reason IS NULL),
w AS (SELECT *, CASE WHEN co > 0.9995 THEN 1 - share ELSE sin((1 - share) * acos(least(co, 1.0))) / sin(acos(least(co, 1.0))) END AS wa, CASE WHEN co > 0.9995 THEN share ELSE sin(share * acos(least(co, 1.0))) / sin(acos(least(co, 1.0))) END AS wb FROM k),
m AS (SELECT shot, wa * aqz + wb * sg * bqz AS z, wa * aqw + wb * sg * bqw AS w FROM w) SELECT shot, round(z / sqrt(z * z + w * w), 4) + 0.0 AS qz, round(w / sqrt(z * z + w * w), 4) + 0.0 AS qw FROM m""")
def m03(spark, sf):
    return _asof(spark, sf).where("reason IS NULL").select("shot", rounded(F.col("qz"), 4).alias("qz"), rounded(F.col("qw"), 4).alias("qw"))


@_f.query("j04_left_with_fallback", f"WITH {V.POSES}, {V.SHOTS}, p AS (SELECT recording, max(t_us) AS t, arg_max(x, t_us) AS x FROM poses WHERE recording < 3 GROUP BY recording) SELECT shot, round(coalesce(p.x, -1.0), 4) + 0.0 AS x, p.x IS NULL AS fallback FROM shots LEFT JOIN p USING (recording)")
def j04(spark, sf):
    last = V.poses(spark, sf).where("recording < 3").groupBy("recording").agg(F.max_by("x", "t_us").alias("x"))
    return V.shots(spark, sf).join(last, "recording", "left").select("shot", rounded(F.coalesce("x", d(-1)), 4).alias("x"), F.col("x").isNull().alias("fallback"))


@_f.query("j03_missing_is_error", f"WITH {V.POSES}, {V.SHOTS} SELECT count(*) AS missing FROM shots WHERE NOT EXISTS (SELECT 1 FROM poses p WHERE p.recording = shots.recording AND p.recording < 3)")
def j03(spark, sf):
    return V.shots(spark, sf).join(V.poses(spark, sf).where("recording < 3").select("recording").distinct(), "recording", "left_anti").agg(F.count("*").alias("missing"))


@_f.query("f02_a01_a02_stationary", W + ", f AS (SELECT *, min(t_us) OVER (PARTITION BY sensor) AS t0 FROM imu), g AS (SELECT sensor, count(*) AS n, avg(rate) AS bias, var_pop(rate) AS variance FROM f WHERE t_us - t0 < 864000 * 1e6 GROUP BY sensor) SELECT sensor, n, round(bias, 4) + 0.0 AS bias, round(variance, 3) + 0.0 AS variance, n >= 20 AND variance <= 3000 AS usable FROM g")
def f02(spark, sf):
    out = T.stationary(V.samples(spark, sf), "sensor", 864000, 20, 3000)
    return out.select("sensor", "n", rounded(F.col("bias"), 4).alias("bias"), rounded(F.col("variance"), 3).alias("variance"), "usable")


@_f.query("f03_t07_coverage", W + ", r AS (SELECT sensor, min(t_us) AS lo, max(t_us) AS hi FROM imu WHERE event_type <> 'view' GROUP BY sensor) SELECT imu.sensor, count(*) FILTER (WHERE t_us BETWEEN lo AND hi) AS covered, count(*) FILTER (WHERE NOT t_us BETWEEN lo AND hi) AS skipped FROM imu JOIN r USING (sensor) WHERE event_type = 'view' GROUP BY imu.sensor")
def f03(spark, sf):
    s = V.samples(spark, sf)
    span = s.where("event_type <> 'view'").groupBy("sensor").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    inside = F.col("t_us").between(F.col("lo"), F.col("hi"))
    return s.where("event_type = 'view'").join(span, "sensor").groupBy("sensor").agg(F.count_if(inside).alias("covered"), F.count_if(~inside).alias("skipped"))


@_f.query("w01_monotone", W + ", l AS (SELECT sensor, t_us - lag(t_us) OVER (PARTITION BY sensor ORDER BY t_us) AS dt, rate - lag(rate) OVER (PARTITION BY sensor ORDER BY t_us) AS dv FROM imu) SELECT sensor, count(*) FILTER (WHERE dt <= 0) AS not_increasing, count(*) FILTER (WHERE dv < 0) AS falling, max(dt) / 1e6 AS widest FROM l GROUP BY sensor")
def w01(spark, sf):
    s = T.steps(V.samples(spark, sf), "sensor", "t_us", "rate")
    return s.groupBy("sensor").agg(F.count_if(F.col("dt") <= 0).alias("not_increasing"), F.count_if(F.col("dv") < 0).alias("falling"), F.max("dt").alias("widest"))


@_f.query("w09_step_rate", W + ", l AS (SELECT event_id, rate - lag(rate) OVER w AS dv, (t_us - lag(t_us) OVER w) / 1e6 AS dt FROM imu WINDOW w AS (PARTITION BY sensor ORDER BY t_us)) SELECT event_id, round(dv / nullif(dt, 0), 5) + 0.0 AS speed FROM l")
def w09(spark, sf):
    return T.steps(V.samples(spark, sf), "sensor", "t_us", "rate").select("event_id", rounded(F.col("speed")).alias("speed"))


@_f.query("w05_exclusive_sum", "WITH p AS (SELECT l_suppkey % 8 AS photo, l_partkey % 16 AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT photo, bucket, n, coalesce(sum(n) OVER (PARTITION BY photo ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p")
def w05(spark, sf):
    from terraweave.session import table

    counts = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("photo"), (F.col("l_partkey") % 16).alias("bucket")).agg(F.count("*").alias("n"))
    return T.exclusive_sum(counts, "photo", "bucket", "n")


@_f.query("w08_trailing_rate", W + ", l AS (SELECT event_id, (last(rate) OVER w - first(rate) OVER w) AS dv, (last(t_us) OVER w - first(t_us) OVER w) / 1e6 AS dt FROM imu WINDOW w AS (PARTITION BY sensor ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)) SELECT event_id, round(dv / nullif(dt, 0), 5) + 0.0 AS trailing FROM l")
def w08(spark, sf):
    return T.trailing_rate(V.samples(spark, sf), "sensor", "t_us", "rate", 86400).select("event_id", rounded(F.col("trailing")).alias("trailing"))


@_f.query("w10_last_twelve", W + ", r AS (SELECT sensor, event_id, row_number() OVER (PARTITION BY sensor ORDER BY t_us DESC)::INT AS recent FROM imu) SELECT * FROM r WHERE recent <= 12")
def w10(spark, sf):
    return T.last_n(V.samples(spark, sf), "sensor", "t_us", 12).select("sensor", "event_id", "recent")


@_f.query("w07_velocity_ema", "WITH RECURSIVE imu AS (SELECT user_id % 16 AS sensor, epoch_us(ts) AS t_us, value AS rate, event_id FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY t_us) AS k FROM imu), e AS (SELECT sensor, event_id, k, rate AS ema FROM o WHERE k = 1 UNION ALL SELECT o.sensor, o.event_id, o.k, 0.7 * o.rate + (1 - 0.7::DOUBLE) * e.ema FROM o JOIN e ON o.sensor = e.sensor AND o.k = e.k + 1) SELECT sensor, event_id, round(ema, 4) + 0.0 AS ema FROM e")
def w07(spark, sf):
    return T.ema(V.samples(spark, sf), "sensor").withColumn("ema", rounded(F.col("ema"), 4))


_RATES = """WITH RECURSIVE imu AS (SELECT user_id % 16 AS sensor, epoch_us(ts) AS t_us, value / 1e5 AS wx, value / 2e5 AS wy, 0.0001::DOUBLE AS wz FROM events),
o AS (SELECT *, row_number() OVER w AS k, (t_us - lag(t_us) OVER w) / 1e6 AS dt, lag(wx) OVER w AS vx, lag(wy) OVER w AS vy, lag(wz) OVER w AS vz FROM imu WINDOW w AS (PARTITION BY sensor ORDER BY t_us, wx)),
h AS (SELECT sensor, t_us, k, dt, (wx + vx) / 2 * dt AS x, (wy + vy) / 2 * dt AS y, (wz + vz) / 2 * dt AS z FROM o),
g AS (SELECT *, sqrt(x * x + y * y + z * z) AS angle FROM h),
s AS (SELECT sensor, t_us, k, dt, x * sin(angle / 2) / nullif(angle, 0) AS sx, y * sin(angle / 2) / nullif(angle, 0) AS sy, z * sin(angle / 2) / nullif(angle, 0) AS sz, cos(angle / 2) AS sw FROM g),
e AS (SELECT sensor, t_us, k, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS qw FROM s WHERE k = 1
  UNION ALL SELECT s.sensor, s.t_us, s.k, CASE WHEN dt > 86400 THEN 0 WHEN sx IS NULL THEN qx ELSE qw * sx + qx * sw + qy * sz - qz * sy END, CASE WHEN dt > 86400 THEN 0 WHEN sx IS NULL THEN qy ELSE qw * sy - qx * sz + qy * sw + qz * sx END,
    CASE WHEN dt > 86400 THEN 0 WHEN sx IS NULL THEN qz ELSE qw * sz + qx * sy - qy * sx + qz * sw END, CASE WHEN dt > 86400 THEN 1 WHEN sx IS NULL THEN qw ELSE qw * sw - qx * sx - qy * sy - qz * sz END
  FROM s JOIN e ON s.sensor = e.sensor AND s.k = e.k + 1)
SELECT sensor, t_us, round(qx, 5) + 0.0 AS qx, round(qy, 5) + 0.0 AS qy, round(qz, 5) + 0.0 AS qz, round(qw, 5) + 0.0 AS qw FROM e"""


@_f.query("w02_m06_j02_attitude", _RATES)
def w02(spark, sf):
    s = V.samples(spark, sf).select("sensor", "t_us", (F.col("rate") / 1e5).alias("wx"), (F.col("rate") / 2e5).alias("wy"), d(0.0001).alias("wz"))
    return T.attitudes(s, "sensor", 86400.0).select("sensor", "t_us", *[rounded(F.col(c)).alias(c) for c in ("qx", "qy", "qz", "qw")])


@_f.query("m07_deskew", "WITH " + V.POINTS + ", e AS (SELECT *, (max(t_us) OVER (PARTITION BY frame) - t_us) / 1e12 AS dt FROM pts) SELECT point_id, round(x * cos(0.3 * dt) - y * sin(0.3 * dt) + 0.1 * dt, 4) + 0.0 AS x, round(x * sin(0.3 * dt) + y * cos(0.3 * dt) + 0.2 * dt, 4) + 0.0 AS y FROM e")
def m07(spark, sf):
    p = V.points(spark, sf)
    ends = p.groupBy("frame").agg(F.max("t_us").alias("end_us"))
    moved = T.deskewed(p.join(ends, "frame").withColumn("dt", (F.col("end_us") - F.col("t_us")) / 1e12), [d(0.1), d(0.2), d(0)], d(0.3))
    return moved.select("point_id", rounded(F.col("x"), 4).alias("x"), rounded(F.col("y"), 4).alias("y"))


@_f.query("w14_m39_time_groups", W + " SELECT strftime(make_timestamp(t_us), '%Y-%m') AS month, count(*) AS n, min(t_us * 1000) AS first_ns FROM imu GROUP BY 1")
def w14(spark, sf):
    return V.samples(spark, sf).groupBy(F.date_format(F.timestamp_micros("t_us"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min(F.col("t_us") * 1000).alias("first_ns"))


@_f.query("k04_w04_stable_order", W + " SELECT sensor, event_id, row_number() OVER (PARTITION BY sensor, event_type ORDER BY rate DESC, event_id) - 1 AS slot FROM imu QUALIFY slot < 4")
def k04(spark, sf):
    w = Window.partitionBy("sensor", "event_type").orderBy(F.desc("rate"), "event_id")
    return V.samples(spark, sf).select("sensor", "event_id", (F.row_number().over(w).cast("long") - 1).alias("slot")).where("slot < 4")


@_f.query("a39_ground_plane")
def a39(spark, sf):
    """Rows only: random planes; tests hold it against a tilted plane."""
    normal, offset, inliers = T.ground_plane(V.points(spark, sf).select("point_id", "x", "y", (F.col("z") / 10).alias("z")))
    return spark.createDataFrame([(*map(float, normal), offset, inliers)], "nx double, ny double, nz double, away double, inliers long")
