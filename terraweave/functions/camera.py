"""Fisheye cameras, scores and colours as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.functions.geometry import Vec, d, dot, once, rotate, sub, xyz


@dataclass(frozen=True)
class Camera:
    """A polynomial fisheye model: angle -> distorted angle by powers 2 to 7, then an affine map to pixels."""

    width: int = 160
    height: int = 120
    a11: float = 58.0
    a12: float = -3.0
    a22: float = 55.0
    u0: float = 79.0
    v0: float = 61.0
    max_angle: float = 1.4
    k: Sequence[float] = field(default=(-0.00234, 0.02452, -0.02327, 0.03899, -0.02704, 0.00771))


def with_projection(pairs: DataFrame, camera: Camera, world_to_camera: Sequence[Sequence[Column]] | None = None) -> DataFrame:
    """Adds u, v, theta and dist of points x, y, z as seen from px, py, pz; without a rotation the camera looks along z.

    Step by step, so that what a later step uses several times is computed once. The last step goes through an array of
    one element: filters on the results are evaluated on values then, and not, written out in full, below the join.
    """
    at = sub(xyz(), [F.col(c) for c in ("px", "py", "pz")])
    out = pairs.withColumns(dict(zip(("_x", "_y", "_z"), rotate(world_to_camera, at) if world_to_camera else at, strict=True)))
    x, y, z, rho, theta = (F.col(c) for c in ("_x", "_y", "_z", "_rho", "theta"))
    out = out.withColumns({"_rho": F.sqrt(x * x + y * y), "dist": F.sqrt(x * x + y * y + z * z)}).withColumn("theta", F.atan2(rho, z))
    bent = d(0)
    for c in reversed(camera.k):
        bent = (bent + c) * theta
    out = out.withColumn("_s", F.when(rho <= 1e-10, d(1)).otherwise(F.try_divide((bent + 1.0) * theta, rho)))
    s = F.col("_s")
    done = F.struct((camera.a11 * x * s + camera.a12 * y * s + camera.u0).alias("u"), (camera.a22 * y * s + camera.v0).alias("v"), theta, F.col("dist"))
    kept = [F.col(c) for c in pairs.columns]
    return out.select(*kept, once(done).alias("_p")).select(*kept, "_p.u", "_p.v", "_p.theta", "_p.dist")


def projection(x: np.ndarray, y: np.ndarray, z: np.ndarray, camera: Camera) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u, v and dist of with_projection(), and valid_projection(), of points x, y, z around cameras that look along z."""
    across = x * x + y * y
    rho, dist = np.sqrt(across), np.sqrt(across + z * z)
    theta = np.arctan2(rho, z)
    bent = np.zeros_like(theta)
    for c in reversed(camera.k):
        bent = (bent + c) * theta
    s = np.where(rho <= 1e-10, 1.0, (bent + 1.0) * theta / np.where(rho > 0, rho, 1.0))
    u, v = camera.a11 * x * s + camera.a12 * y * s + camera.u0, camera.a22 * y * s + camera.v0
    return u, v, dist, (dist > 0.1) & (u >= 0) & (u < camera.width - 1) & (v >= 0) & (v < camera.height - 1) & (theta < camera.max_angle)


def valid_projection(u: Column, v: Column, theta: Column, dist: Column, camera: Camera) -> Column:
    inside = (u >= 0) & (u < camera.width - 1) & (v >= 0) & (v < camera.height - 1)
    return (dist > 0.1) & ~F.isnan(u) & ~F.isnan(v) & inside & (theta < camera.max_angle)


def depth_step(dist: Column) -> Column:
    """Depth in millionths, half to even."""
    return F.rint(dist * 1e6).cast("long")


def depth_key(dist: Column, point_id: Column, points: int) -> Column:
    """Depth and point in one number for boundaries that need it; within the engine a struct of both is safer."""
    return F.try_add(F.try_multiply(depth_step(dist), F.lit(points).cast("long")), point_id)


def view_score(theta: Column, dist: Column, incidence: Column) -> Column:
    """Weight of a view: small angles, short distances and frontal surfaces count most."""
    seen = F.greatest(incidence, d(0.05))
    return F.exp(-2.0 * theta * theta) / (dist * dist + 0.25) * seen * seen


def grid_coordinates(u: Column, v: Column, width: int, height: int, gx: int = 8, gy: int = 6) -> tuple[Column, Column]:
    clip = lambda x, top: F.greatest(d(0), F.least(d(top), x))
    return clip(u / width * gx - 0.5, gx - 1), clip(v / height * gy - 0.5, gy - 1)


def grid_node(gx: Column, gy: Column, photo: Column, nx: int = 8, ny: int = 6) -> Column:
    return photo * (nx * ny) + F.rint(gy).cast("long") * nx + F.rint(gx).cast("long")


def linear(c: Column) -> Column:
    """sRGB 0..1 to linear light."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, d(2.4)))


def srgb(c: Column) -> Column:
    """Linear light to sRGB 0..1."""
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, d(1 / 2.4)) - 0.055)


def clipped(c: Column, low: float, high: float) -> Column:
    return F.greatest(d(low), F.least(d(high), c))


def colour16(c: Column) -> Column:
    """0..255 to 16 bits, half to even."""
    return F.rint(clipped(c, 0, 255) * 257).cast("int")


def unit_colour16(c: Column, missing: int = 47000) -> Column:
    """0..1 to 16 bits; a constant where there is none."""
    return F.coalesce(F.rint(clipped(c, 0, 1) * 65535).cast("int"), F.lit(missing))


def unit_colour8(c: Column, missing: float = 0.72) -> Column:
    return F.rint(clipped(F.coalesce(c, d(missing)), 0, 1) * 255).cast("int")


def quantized(v: Column, offset: Column | float, scale: float = 1e-4) -> Column:
    return F.rint((v - offset) / scale).cast("long")


def stretched_intensity(i: Column) -> Column:
    """Intensities up to 50 spread over the lower 200 steps, the rest over the upper 55."""
    spread = F.when(i <= 50, i * 4.0).otherwise((i - 50) * 55.0 / 205.0 + 200.0)
    return clipped(spread, 0, 255).cast("int")


def huber_cost(r: Column, bound: float) -> Column:
    a = F.abs(r)
    return F.when(a <= bound, 0.5 * a * a).otherwise(bound * (a - 0.5 * bound))


def huber_weight(r: Column, bound: float) -> Column:
    return F.least(d(1), F.coalesce(F.try_divide(d(bound), F.abs(r)), d(1)))


def cauchy_cost(r: Column, scale: float) -> Column:
    return F.log1p(r * r / (scale * scale))


Interval = tuple[Column, Column]


def interval_product(a: Interval, b: Interval) -> Interval:
    products = [a[0] * b[0], a[0] * b[1], a[1] * b[0], a[1] * b[1]]
    return F.least(*products), F.greatest(*products)


def interval_sum(*parts: Interval) -> Interval:
    low, high = parts[0]
    for a, b in parts[1:]:
        low, high = low + a, high + b
    return low, high


def interval_scaled(a: Interval, k: float) -> Interval:
    return (a[0] * k, a[1] * k) if k >= 0 else (a[1] * k, a[0] * k)


def interval_square(a: Interval) -> Interval:
    """Squares of what an interval holds: from 0 where it holds 0."""
    low, high = F.least(F.abs(a[0]), F.abs(a[1])), F.greatest(F.abs(a[0]), F.abs(a[1]))
    return F.when((a[0] <= 0) & (a[1] >= 0), d(0)).otherwise(low * low), high * high


#: What is added to intervals for the rounding of doubles, relative to coordinates and to pixels.
SLACK = 1e-6


def with_box_view(boxes: DataFrame, low: Sequence[Column], high: Sequence[Column], camera: Camera, world_to_camera: Sequence[Sequence[Column]] | None = None) -> DataFrame:
    """Adds may_see: whether a point of the box low..high may have a valid projection as seen from px, py, pz.

    Intervals of camera coordinates, angle, bent angle (Horner steps) and pixels hold the values of every point of the box,
    so no box with a valid projection is refused; one whose intervals are not finite is not refused either.
    """
    at = [F.col(c) for c in ("px", "py", "pz")]
    middle, half = [(a + b) / 2 for a, b in zip(low, high, strict=True)], [(b - a) / 2 for a, b in zip(low, high, strict=True)]
    away = sub(middle, at)
    if world_to_camera:
        away = rotate(world_to_camera, away)
        half = [sum((F.abs(m) * h for m, h in zip(row, half, strict=True)), d(0)) for row in world_to_camera]
    box = {}
    for k, (c, h) in enumerate(zip(away, half, strict=True)):
        room = h + SLACK * (1 + F.abs(c) + h)
        box |= {f"_a{k}": c - room, f"_b{k}": c + room}
    out = boxes.withColumns(box)
    x, y, z = ((F.col(f"_a{k}"), F.col(f"_b{k}")) for k in range(3))
    across, along = interval_sum(interval_square(x), interval_square(y)), interval_square(z)
    out = out.withColumns({"_r0": F.sqrt(across[0]), "_r1": F.sqrt(across[1]), "_far": F.sqrt(across[1] + along[1])})
    # The angle grows with the distance from the axis, and falls along it.
    out = out.withColumns({"_t0": F.greatest(d(0), F.atan2(F.col("_r0"), z[1]) - SLACK), "_t1": F.least(d(camera.max_angle), F.atan2(F.col("_r1"), z[0]) + SLACK)})
    theta = (F.col("_t0"), F.col("_t1"))
    bent: Interval = (d(0), d(0))
    for n, c in enumerate(reversed(camera.k)):
        step = interval_product((bent[0] + c, bent[1] + c), theta)
        out = out.withColumns({f"_h{n}": step[0], f"_i{n}": step[1]})
        bent = (F.col(f"_h{n}"), F.col(f"_i{n}"))
    reach = interval_product((bent[0] + 1.0, bent[1] + 1.0), theta)
    out = out.withColumns({"_p0": reach[0], "_p1": reach[1]})

    def share(a: Interval) -> Interval:
        """x / rho, which is -1 to 1, and within x over both ends of rho where the axis is not in the box."""
        over = interval_product(a, tuple(F.coalesce(F.try_divide(d(1), F.col(c)), d(float("inf"))) for c in ("_r1", "_r0")))
        off = F.col("_r0") > 0
        return F.when(off, F.greatest(d(-1), over[0])).otherwise(d(-1)), F.when(off, F.least(d(1), over[1])).otherwise(d(1))

    bx, by = (interval_product((F.col("_p0"), F.col("_p1")), share(a)) for a in (x, y))
    out = out.withColumns({"_u0": bx[0], "_u1": bx[1], "_v0": by[0], "_v1": by[1]})
    bx, by = (F.col("_u0"), F.col("_u1")), (F.col("_v0"), F.col("_v1"))
    u, v = interval_sum(interval_scaled(bx, camera.a11), interval_scaled(by, camera.a12)), interval_scaled(by, camera.a22)
    room = SLACK * (abs(camera.a11) + abs(camera.a12) + abs(camera.a22) + camera.width + camera.height)
    outside = [u[1] + camera.u0 < -room, u[0] + camera.u0 > camera.width - 1 + room, v[1] + camera.v0 < -room, v[0] + camera.v0 > camera.height - 1 + room, F.col("_t0") >= camera.max_angle, F.col("_far") < 0.1]
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in (*bx, *by, F.col("_t0"), F.col("_t1"), F.col("_far"))]
    sure = finite[0]
    for f in finite[1:]:
        sure = sure & f
    gone = outside[0]
    for o in outside[1:]:
        gone = gone | o
    seen = once(~F.coalesce(sure & gone, F.lit(False))).alias("may_see")
    return out.select(*boxes.columns, seen)


def incidence(normal: Vec, ray: Vec) -> Column:
    """Cosine between a surface normal and the direction back along the ray."""
    return -dot(normal, ray)
