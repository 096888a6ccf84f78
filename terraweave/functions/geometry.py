"""Geometry as column expressions: voxels, boxes, rotations, polygons. Nothing here leaves whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def d(value) -> Column:
    return value.cast("double") if isinstance(value, Column) else F.lit(float(value))


def once(c: Column) -> Column:
    """A column to select whose value is computed once for each row, by way of an array of one element: what a join or a filter
    follows is otherwise written out below it, and run for each pair or use."""
    return F.explode(F.array(c))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def sub(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def add(a: Vec, b: Vec) -> list[Column]:
    return [x + y for x, y in zip(a, b, strict=True)]


def scaled(a: Vec, k: Column) -> list[Column]:
    return [x * k for x in a]


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def xyz(prefix: str = "", names: str = "xyz") -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in names]


def finite(*cols: Column) -> Column:
    """True where all are numbers other than NaN and the infinities."""
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


# --- voxels ---------------------------------------------------------------------------------------------------------


def cell(v: Column, size: float, origin: float = 0.0) -> Column:
    """Index of the cell of the given size: floor((v - origin) / size)."""
    return F.floor((v - origin) / size).cast("long") if origin else F.floor(v / size).cast("long")


def centre(index: Column, size: float) -> Column:
    """Centre of a cell, (index + 0.5) * size with the size as written, in decimals: points that lie alike on either side of it
    are equally far. A product of doubles misses it by a last digit, which then decides between them."""
    above, below = Decimal(repr(size)).as_integer_ratio()
    return ((index * 2 + 1) * F.lit(above).cast("long")).cast("double") / float(2 * below)


def cells(p: Vec, size: float, names: Sequence[str] = ("cx", "cy", "cz")) -> dict[str, Column]:
    return {n: cell(v, size) for n, v in zip(names, p, strict=True)}


def truncated_cell(v: Column, centre: Column, size: float, extent: float = 1.1) -> Column:
    """Cell of a smoothing grid around a centre: truncation toward zero, then half of the grid's width on top."""
    return ((v - centre) / size).cast("long") + int(extent / size * 0.5)


def downsample_cell(v: Column, size: float) -> Column:
    """Truncated after one is taken off negative quotients: floor, except that whole negative quotients go one lower."""
    q = v / size
    return F.when(q < 0, q - 1).otherwise(q).cast("long")


BIAS = 1 << 20


def packed_key(cx: Column, cy: Column, cz: Column) -> Column:
    """Three 21-bit cells in one number, plus 1, so that 0 stands for no cell; null beyond 21 bits."""
    inside = (F.abs(cx) < BIAS) & (F.abs(cy) < BIAS) & (F.abs(cz) < BIAS)
    key = F.shiftleft(cx + BIAS, 42).bitwiseOR(F.shiftleft(cy + BIAS, 21)).bitwiseOR(cz + BIAS) + 1
    return F.when(inside, key)


def unpacked_key(key: Column) -> list[Column]:
    k = key - 1
    mask = F.lit((1 << 21) - 1).cast("long")
    return [F.shiftright(k, s).bitwiseAND(mask) - BIAS for s in (42, 21, 0)]


# --- boxes ----------------------------------------------------------------------------------------------------------


def in_box(p: Vec, low: Sequence, high: Sequence) -> Column:
    """Closed box."""
    out = F.lit(True)
    for v, a, b in zip(p, low, high, strict=True):
        out = out & v.between(a, b)
    return out


def segment_box(a: Vec, b: Vec, low: Sequence, high: Sequence) -> tuple[Column, Column, Column]:
    """(hits, entry, exit) of the segment a-b and a box by slabs, entry and exit as shares of the segment in 0..1.

    Along an axis in which the segment moves by less than 1e-12, it has to lie between the planes.
    """
    entry, leave, possible = d(0), d(1), F.lit(True)
    for p, q, lo, hi in zip(a, b, low, high, strict=True):
        step = q - p
        flat = F.abs(step) < 1e-12
        t0, t1 = F.try_divide(d(lo) - p, step), F.try_divide(d(hi) - p, step)
        entry = F.when(flat, entry).otherwise(F.greatest(entry, F.least(t0, t1)))
        leave = F.when(flat, leave).otherwise(F.least(leave, F.greatest(t0, t1)))
        possible = possible & (~flat | p.between(lo, hi))
    return possible & (entry <= leave), entry, leave


# --- rotations ------------------------------------------------------------------------------------------------------


def quaternion_matrix(q: Sequence[Column]) -> list[list[Column]]:
    """Rotation matrix of (x, y, z, w), normalized first."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    x, y, z, w = (v / n for v in q)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def rotate(m: Sequence[Sequence[Column]], p: Vec) -> list[Column]:
    return [dot(row, p) for row in m]


def transposed(m: Sequence[Sequence[Column]]) -> list[list[Column]]:
    return [list(c) for c in zip(*m, strict=True)]


def transform(q: Sequence[Column], t: Vec, p: Vec) -> list[Column]:
    """Rigid transform: rotation by a quaternion, then translation."""
    return add(rotate(quaternion_matrix(q), p), t)


def slerp(a: Sequence[Column], b: Sequence[Column], share: Column) -> list[Column]:
    """Spherical interpolation along the shorter arc; nearly equal rotations are interpolated in a straight line."""
    raw = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    sign = F.when(raw < 0, -1.0).otherwise(1.0)
    cosine = F.abs(raw)
    near = cosine > 0.9995
    angle = F.acos(F.least(cosine, d(1)))
    sine = F.sin(angle)
    wa = F.when(near, 1 - share).otherwise(F.try_divide(F.sin((1 - share) * angle), sine))
    wb = F.when(near, share).otherwise(F.try_divide(F.sin(share * angle), sine))
    mixed = [wa * x + wb * sign * y for x, y in zip(a, b, strict=True)]
    n = F.sqrt(mixed[0] * mixed[0] + mixed[1] * mixed[1] + mixed[2] * mixed[2] + mixed[3] * mixed[3])
    return [v / n for v in mixed]


def euler_matrix(x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rz * Ry * Rx, angles in radians."""
    cx, sx, cy, sy, cz, sz = F.cos(x), F.sin(x), F.cos(y), F.sin(y), F.cos(z), F.sin(z)
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def octant(n: Vec) -> Column:
    """Three bits, one for each component that is zero or more."""
    bits = [F.when(v >= 0, 1 << k).otherwise(0) for k, v in enumerate(n)]
    return (bits[0] + bits[1] + bits[2]).cast("int")


# --- polygons: ARRAY<STRUCT<x, y>> ----------------------------------------------------------------------------------


def polygon(points: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(d(x).alias("x"), d(y).alias("y")) for x, y in points])


def edges(v: Column) -> Column:
    """Each vertex b with the one before it, a."""
    return F.transform(v, lambda b, i: F.struct(b.alias("b"), F.when(i == 0, F.element_at(v, -1)).otherwise(F.get(v, i - 1)).alias("a")))


def crosses(x, y, a: tuple, b: tuple):
    """Whether the edge from a to b, its upper end left out, is met by the ray from (x, y) to the right.

    The sign of the area that edge and point span tells the side of the edge on which the point lies.
    """
    side = (b[0] - a[0]) * (y - a[1]) - (x - a[0]) * (b[1] - a[1])
    return ((y >= a[1]) & (y < b[1]) & (side > 0)) | ((y >= b[1]) & (y < a[1]) & (side < 0))


def edge_distance2(x, y, a: tuple, b: tuple):
    """Squared distance to an edge: across it where the foot of the perpendicular is on it, else to its nearer end."""
    along, to_a, to_b = (b[0] - a[0], b[1] - a[1]), (x - a[0], y - a[1]), (x - b[0], y - b[1])

    def dot2(p: tuple, q: tuple) -> Column:
        return p[0] * q[0] + p[1] * q[1]

    area2 = along[0] * to_a[1] - along[1] * to_a[0]
    on_it = (dot2(to_a, along) > 0) & (dot2(to_b, along) < 0)
    return F.when(on_it, area2 * area2 / dot2(along, along)).otherwise(F.least(dot2(to_a, to_a), dot2(to_b, to_b)))


def _ends(e: Column) -> tuple[tuple, tuple]:
    return (e["a"]["x"], e["a"]["y"]), (e["b"]["x"], e["b"]["y"])


def inside_polygon(x: Column, y: Column, v: Column) -> Column:
    """Even-odd rule: whether the ray to the right meets an odd number of edges."""
    return F.aggregate(edges(v), F.lit(False), lambda odd, e: odd != F.coalesce(crosses(x, y, *_ends(e)), F.lit(False)))


def distance_to_edges(x: Column, y: Column, v: Column) -> Column:
    """Distance to the nearest edge; an edge without length is its vertex."""
    return F.sqrt(F.aggregate(edges(v), d(float("inf")), lambda least, e: F.least(least, edge_distance2(x, y, *_ends(e)))))


def _known_edges(points: Sequence[tuple[float, float]]) -> list[tuple[tuple, tuple]]:
    return [(points[k - 1], points[k]) for k in range(len(points))]


def inside_outline(x: Column, y: Column, points: Sequence[tuple[float, float]]) -> Column:
    """inside_polygon() of a polygon that is known beforehand: its edges become plain arithmetic, which is compiled.

    An edge is met where the height of the point is between its ends and the point is left of the edge at that height. The
    steps of an edge are differences of its coordinates as written, so points on edges fall as they do in the SQL.
    """
    met = []
    for a, b in _known_edges(points):
        dx, dy = (float(Decimal(repr(p)) - Decimal(repr(q))) for p, q in zip(a, b, strict=True))
        if dy:
            met.append((((d(b[1]) > y) != (d(a[1]) > y)) & (x < dx * (y - d(b[1])) / dy + d(b[0]))).cast("int"))
    return sum(met[1:], met[0]) % 2 == 1 if met else F.lit(False)


def distance_to_outline(x: Column, y: Column, points: Sequence[tuple[float, float]]) -> Column:
    """distance_to_edges() of a polygon that is known beforehand: to the nearest place on each edge."""
    near = []
    for a, b in _known_edges(points):
        dx, dy = float(b[0] - a[0]), float(b[1] - a[1])
        on = F.greatest(d(0), F.least(d(1), ((x - d(a[0])) * dx + (y - d(a[1])) * dy) / (dx**2 + dy**2))) if dx or dy else d(0)
        away = x - (d(a[0]) + on * dx), y - (d(a[1]) + on * dy)
        near.append(away[0] * away[0] + away[1] * away[1])
    return F.sqrt(F.least(*near) if len(near) > 1 else near[0])


def area(v: Column) -> Column:
    """Shoelace formula, without sign."""
    return F.abs(F.aggregate(edges(v), d(0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def centroid(v: Column) -> list[Column]:
    """Mean of the vertices."""
    return [F.aggregate(v, d(0), lambda acc, p: acc + p[k]) / F.size(v) for k in ("x", "y")]  # noqa: B023


def centred(v: Column) -> Column:
    cx, cy = centroid(v)
    return F.transform(v, lambda p: F.struct((p["x"] - cx).alias("x"), (p["y"] - cy).alias("y")))


def placed(v: Column, angle: Column, tx: Column, ty: Column) -> Column:
    """Rotated about the origin, then moved."""
    c, s = F.cos(angle), F.sin(angle)
    return F.transform(v, lambda p: F.struct((p["x"] * c - p["y"] * s + tx).alias("x"), (p["x"] * s + p["y"] * c + ty).alias("y")))


def bounds(v: Column, margin: float = 0.0) -> list[Column]:
    """Least x, least y, most x, most y, with a margin around."""
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return [F.array_min(xs) - margin, F.array_min(ys) - margin, F.array_max(xs) + margin, F.array_max(ys) + margin]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: as the only element of an array, where an expression is written out, and
    within a lambda evaluated, at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _corner(v: Column, n: Column, p: Column, i: Column) -> Column:
    """A vertex x, y, the steps ax, ay to it and bx, by from it."""
    a, b = F.get(v, F.pmod(i + n - 1, n)), F.get(v, F.pmod(i + 1, n))
    return F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["x"] - a["x"]).alias("ax"), (p["y"] - a["y"]).alias("ay"), (b["x"] - p["x"]).alias("bx"), (b["y"] - p["y"]).alias("by"))


def _lengths(c: Column) -> Column:
    return F.struct(F.sqrt(c["ax"] * c["ax"] + c["ay"] * c["ay"]).alias("a"), F.sqrt(c["bx"] * c["bx"] + c["by"] * c["by"]).alias("b"))


def offset_polygon(v: Column, by: float, least: float = 0.3) -> Column:
    """Each vertex moved along the bisector of its edges; the cosine of the half angle counts as `least` at least."""
    n = F.size(v)

    def normals(c: Column) -> Column:
        return let(_lengths(c), lambda s: F.struct((c["ay"] / s["a"]).alias("ax"), (-c["ax"] / s["a"]).alias("ay"), (c["by"] / s["b"]).alias("bx"), (-c["bx"] / s["b"]).alias("by")))

    def bisector(o: Column) -> Column:
        return F.struct((o["ax"] + o["bx"]).alias("x"), (o["ay"] + o["by"]).alias("y"), o["ax"].alias("nx"), o["ay"].alias("ny"))

    def placed_at(c: Column, m: Column) -> Column:
        def at(size: Column) -> Column:
            cosine = F.greatest(F.try_divide(m["nx"] * m["x"] + m["ny"] * m["y"], size), d(least))
            return let(cosine, lambda k: F.struct((c["x"] + F.try_divide(m["x"], size) * by / k).alias("x"), (c["y"] + F.try_divide(m["y"], size) * by / k).alias("y")))

        return let(F.sqrt(m["x"] * m["x"] + m["y"] * m["y"]), at)

    return F.transform(v, lambda p, i: let(_corner(v, n, p, i), lambda c: let(normals(c), lambda o: let(bisector(o), lambda m: placed_at(c, m)))))


def band_outline(v: Column, by: float, least: float = 0.2, step: float = 15.0) -> Column:
    """Outline of what lies within `by` of a polygon, outside of it: an arc of points at most `step` degrees apart (three at
    least) around each convex corner, and at a concave one the point where the moved edges meet, the cosine of the half angle
    counting as `least` at least. Either direction of traversal; fewer than three vertices or a distance of 0 or less: as it is.
    """
    n = F.size(v)
    turned = F.aggregate(F.sequence(F.lit(0), n - 1), d(0), lambda a, i: a + F.get(v, i)["x"] * F.get(v, F.pmod(i + 1, n))["y"] - F.get(v, F.pmod(i + 1, n))["x"] * F.get(v, i)["y"])
    pi = 3.141592653589793

    def normals(c: Column, sign: Column) -> Column:
        def out(s: Column) -> Column:
            return F.struct((sign * c["ay"] / s["a"]).alias("ax"), (-sign * c["ax"] / s["a"]).alias("ay"), (sign * c["by"] / s["b"]).alias("bx"), (-sign * c["bx"] / s["b"]).alias("by"))

        real = lambda s: F.struct(*[F.when(s[k] > 0, s[k]).otherwise(d(1)).alias(k) for k in "ab"])
        return let(let(_lengths(c), real), out)

    def arc(c: Column, o: Column, sign: Column) -> Column:
        first = F.atan2(o["ay"], o["ax"])
        wrapped = lambda t: F.when((sign > 0) & (t < 0), t + 2 * pi).when((sign < 0) & (t > 0), t - 2 * pi).otherwise(t)
        turn = let(F.atan2(o["by"], o["bx"]) - first, wrapped)
        told = let(F.struct(first.alias("first"), turn.alias("turn")), lambda t: F.struct(t["first"].alias("first"), t["turn"].alias("turn"), F.greatest(F.lit(2), F.ceil(F.abs(t["turn"]) / (step * pi / 180)).cast("int")).alias("steps")))
        point = lambda at: F.struct((c["x"] + by * F.cos(at)).alias("x"), (c["y"] + by * F.sin(at)).alias("y"))
        return let(told, lambda t: F.transform(F.sequence(F.lit(0), t["steps"]), lambda k: let(t["first"] + t["turn"] * k / t["steps"], point)))

    def meet(c: Column, o: Column) -> Column:
        def at(m: Column) -> Column:
            far = by / F.greatest((m["x"] * o["ax"] + m["y"] * o["ay"]) / m["m"], d(least))
            return let(far, lambda f: F.array(F.struct((c["x"] + m["x"] / m["m"] * f).alias("x"), (c["y"] + m["y"] / m["m"] * f).alias("y"))))

        both = F.struct((o["ax"] + o["bx"]).alias("x"), (o["ay"] + o["by"]).alias("y"))
        size = lambda b: let(F.sqrt(b["x"] * b["x"] + b["y"] * b["y"]), lambda m: F.struct(b["x"].alias("x"), b["y"].alias("y"), F.when(m > 0, m).otherwise(d(1)).alias("m")))
        return let(let(both, size), at)

    def around(p: Column, i: Column, sign: Column) -> Column:
        convex = lambda c: (c["ax"] * c["by"] - c["ay"] * c["bx"]) * sign > 0
        return let(_corner(v, n, p, i), lambda c: let(normals(c, sign), lambda o: F.when(convex(c), arc(c, o, sign)).otherwise(meet(c, o))))

    sign = let(turned, lambda t: F.when(t > 0, d(1)).otherwise(d(-1)))
    outline = let(sign, lambda s: F.flatten(F.transform(v, lambda p, i: around(p, i, s))))
    same = F.transform(v, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.when((n < 3) | (F.lit(by) <= 0), same).otherwise(outline)
