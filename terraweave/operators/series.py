"""Series in time: bracketing joins, differences, rates, ordered folds, robust ground planes.

Nothing here orders all rows: every window is over one sensor, recording or stage.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.functions import geometry as G
from terraweave.functions.geometry import d, xyz
from terraweave.operators.ordered import Attitude, Ema, folded


def bracket(shots: DataFrame, poses: DataFrame, group: str, carried: Sequence[str], bucket: float = 86400.0) -> DataFrame:
    """Each shot with the last pose before it (a_...) and the first at or after it (b_...), null where there is none.

    As-of by union and a window: both sides are sorted together by time, and the last pose is carried on. At equal times
    the shot comes first, so a pose at the very time of a shot is the one after it. Windows run over `bucket` seconds of
    a group, so that a long recording is many tasks; a shot without a pose in its bucket takes the nearest bucket's last
    or first one, from a table with a row for each bucket.
    """
    span = F.floor(F.col("t_us") / int(bucket * 1e6)).cast("long").alias("_k")
    value = F.struct("t_us", *carried)
    p = poses.select(group, span, "t_us", F.lit(1).alias("kind"), F.lit(None).cast(shots.schema["shot"].dataType).alias("shot"), value.alias("v"))
    s = shots.select(group, span, "t_us", F.lit(0).alias("kind"), "shot", F.lit(None).cast(p.schema["v"].dataType).alias("v"))
    # Both windows grow from their first row; one that ends at the last row would be gone through anew for each row.
    own, line = Window.partitionBy(group, "_k"), ("t_us", "kind", "shot", "v")
    earlier, later = (own.orderBy(*[to(c) for c in line]).rowsBetween(Window.unboundedPreceding, -1) for to in (F.asc, F.desc))
    found = p.unionByName(s).withColumns({"a": F.last("v", ignorenulls=True).over(earlier), "b": F.last("v", ignorenulls=True).over(later)}).where("kind = 0")
    ends = p.unionByName(s).groupBy(group, "_k").agg(F.max("v").alias("last"), F.min("v").alias("first"))  # structs by time; shots have none
    before, after = (Window.partitionBy(group).orderBy(to("_k")).rowsBetween(Window.unboundedPreceding, -1) for to in (F.asc, F.desc))
    around = ends.select(group, "_k", F.last("last", ignorenulls=True).over(before).alias("before"), F.last("first", ignorenulls=True).over(after).alias("after"))
    joined = found.join(around, [group, "_k"]).withColumns({"a": F.coalesce("a", "before"), "b": F.coalesce("b", "after")})
    return joined.select(group, "shot", "t_us", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in "ab" for c in ("t_us", *carried)])


def interpolated(found: DataFrame, max_gap: float) -> DataFrame:
    """Position and rotation at the shot's time, and why it is refused: outside the poses, or in too wide a gap."""
    gap = (F.col("b_t_us") - F.col("a_t_us")) / 1e6
    share = F.try_divide(F.col("t_us") - F.col("a_t_us"), F.col("b_t_us") - F.col("a_t_us"))
    reason = F.when(F.col("a_t_us").isNull() | F.col("b_t_us").isNull(), "outside pose coverage").when(gap > max_gap, "pose gap exceeds limit")
    at = [F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * share for c in "xyz"]
    q = G.slerp([d(0), d(0), F.col("a_qz"), F.col("a_qw")], [d(0), d(0), F.col("b_qz"), F.col("b_qw")], share)
    return found.withColumns({"reason": reason, "gap": gap, **dict(zip("xyz", at, strict=True)), "qz": q[2], "qw": q[3]})


def steps(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Difference to the row before in the group, in time and value, and the rate."""
    w = Window.partitionBy(group).orderBy(order)
    dt = (F.col(order) - F.lag(order).over(w)) / 1e6
    dv = F.col(value) - F.lag(value).over(w)
    return df.withColumns({"dt": dt, "dv": dv, "speed": F.try_divide(dv, dt)})


def exclusive_sum(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(value).over(w), F.lit(0)))


def trailing_rate(df: DataFrame, group: str, order: str, value: str, seconds: float) -> DataFrame:
    """Change of a value per second over the trailing window, null for a single sample.

    A window's first sample is the first at or after its begin, which bracket() finds; a sliding window would be gone through
    anew for each row. Rows without a time have no rate.
    """
    span = int(seconds * 1e6)
    timed = df.where(F.col(order).isNotNull())
    key = F.struct(F.col(group)).alias("_g")  # so that rows without a group are one
    peers = Window.partitionBy(group, F.floor(F.col(order) / max(span, 1))).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = timed.select(key, (F.col(order) - span).alias("t_us"), F.struct(*df.columns, F.last(value).over(peers).alias("_last")).alias("shot"))
    found = bracket(ends, timed.select(key, F.col(order).cast("long").alias("t_us"), F.col(value).alias("_first")), "_g", ["_first"], max(seconds, 1.0))
    rate = F.try_divide(F.col("shot._last") - F.col("b__first"), (F.col(f"shot.{order}") - F.col("b_t_us")) / 1e6)
    rows = found.select(*[F.col(f"shot.{c}").alias(c) for c in df.columns], rate.alias("trailing"))
    return rows.unionByName(df.where(F.col(order).isNull()).withColumn("trailing", d(F.lit(None))))


def last_n(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return df.withColumn("recent", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("recent") <= n)


def stationary(df: DataFrame, group: str, seconds: float, least: int, most_variance: float) -> DataFrame:
    """Mean and variance of each group's first seconds, and whether they will do for a start."""
    first = Window.partitionBy(group).orderBy("t_us").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    window = df.withColumn("_t0", F.min("t_us").over(first)).where((F.col("t_us") - F.col("_t0")) < seconds * 1e6)
    out = window.groupBy(group).agg(F.count("*").alias("n"), F.avg("rate").alias("bias"), F.var_pop("rate").alias("variance"))
    return out.withColumn("usable", (F.col("n") >= least) & (F.col("variance") <= most_variance))


def ema(df: DataFrame, group: str, new: float = 0.7, bucket: float = 86400.0) -> DataFrame:
    """(group, event_id, ema): exponential mean in order of time and event_id, as a scan of two levels."""
    return folded(df, group, Ema("rate", new), ["event_id"], bucket).select(group, "event_id", "ema")


def attitudes(df: DataFrame, group: str, max_gap: float, bucket: float = 86400.0) -> DataFrame:
    """(group, t_us, qx, qy, qz, qw): attitude at each sample as a product of turns by the mean rates between samples, in
    order of time. A gap above max_gap seconds starts anew. A scan of two levels: no task holds a sensor."""
    return folded(df, group, Attitude(("wx", "wy", "wz"), max_gap), (), bucket)


def deskewed(pts: DataFrame, velocity: Sequence[Column], spin: Column) -> DataFrame:
    """Points moved to the end of their scan: rotation about z at a constant rate, and a constant velocity."""
    dt = F.col("dt")
    angle = spin * dt
    c, s = F.cos(angle), F.sin(angle)
    x, y, z = xyz()
    return pts.withColumns({"x": x * c - y * s + velocity[0] * dt, "y": x * s + y * c + velocity[1] * dt, "z": z + velocity[2] * dt})


def ground_plane(pts: DataFrame, tolerance: float = 0.06, least_up: float = 0.7, rounds: int = 300, sample: int = 60_000, seed: int = 12345) -> tuple[np.ndarray, float, int]:
    """(normal, offset, inliers) of the ground: random planes through three points of a bounded sample, scored there;
    then least squares over the inliers among all points, from sums alone."""
    n = pts.count()
    held = pts.where(F.pmod("point_id", F.lit(max(1, -(-n // sample)))) == 0).orderBy("point_id").limit(2 * sample).select("x", "y", "z").toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    best, count = (np.array([0.0, 0, 1]), 0.0), -1
    for _ in range(rounds if len(held) >= 3 else 0):
        a, b, c = held[rng.choice(len(held), 3, replace=False)]
        m = np.cross(b - a, c - a)
        size = np.linalg.norm(m)
        if size < 1e-9:
            continue
        m = m / size * (1 if m[2] >= 0 else -1)
        if m[2] < least_up:
            continue
        k = int((np.abs((held - a) @ m) <= tolerance).sum())
        if k > count:
            best, count = (m, float(a @ m)), k
    m, o = best
    off = d(m[0]) * F.col("x") + d(m[1]) * F.col("y") + d(m[2]) * F.col("z") - d(o)
    near = pts.where(F.abs(off) <= tolerance)
    s = near.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"], *[F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]).first()
    if not s["n"] or s["n"] < 3:
        return m, o, int(s["n"] or 0)
    cov = np.array([[s["xx"], s["xy"], s["xz"]], [s["xy"], s["yy"], s["yz"]], [s["xz"], s["yz"], s["zz"]]])
    normal = np.linalg.eigh(cov)[1][:, 0]
    normal *= 1 if normal[2] >= 0 else -1
    return normal, float(normal @ np.array([s["x"], s["y"], s["z"]])), int(s["n"])
