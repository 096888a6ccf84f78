"""Surfaces: cell index, plane moments and surfels, smoothing in blocks, matching to planes.

Blocks of a cloud that was thinned to one point a voxel (nearest_to_centre) hold a bounded number of points, whatever the size
of the cloud; smoothing does not need that, as it cuts blocks into tiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraweave.functions import geometry as G
from terraweave.functions.geometry import xyz
from terraweave.operators.points import CELL, halo_blocks, with_cells
from terraweave.session import kept


def cell_index(celled: DataFrame, key: Sequence[str]) -> DataFrame:
    """Representative (smallest point_id) and number of points of each cell."""
    return celled.groupBy(*key).agg(F.min("point_id").alias("representative"), F.count("*").alias("n"))


def export_ranks(pts: DataFrame) -> DataFrame:
    """Place of each point in its frame by time: 0, 1, ... without gaps."""
    return pts.withColumn("export_rank", F.row_number().over(Window.partitionBy("frame").orderBy("t_us", "point_id")).cast("long") - 1)


def plane_moments(celled: DataFrame, key: Sequence[str], least_points: int, least_frames: int) -> DataFrame:
    """Means and covariances (divided by n) of each cell with enough points from enough frames; sums only are shuffled."""
    per_frame = celled.groupBy(*key, "frame").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in "xyz"], *[F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])
    names = ["sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]
    sums = per_frame.groupBy(*key).agg(F.sum("n").alias("n"), F.count("*").alias("frames"), *[F.sum(c).alias(c) for c in names])
    kept = sums.where((F.col("n") >= least_points) & (F.col("frames") >= least_frames))
    means = kept.select(*key, "n", "frames", *[(F.col(f"s{c}") / F.col("n")).alias(f"m{c}") for c in "xyz"], *names[3:])
    return means.select(*key, "n", "frames", "mx", "my", "mz", *[(F.col(f"s{a}{b}") / F.col("n") - F.col(f"m{a}") * F.col(f"m{b}")).alias(f"{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])


def smallest_eigen(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in growing order, and the eigenvector of the smallest, of rows xx, xy, xz, yy, yz, zz. The sign is such
    that the component of the largest size is positive. Where the two smallest are one, as for points on a line, rounding would
    choose among the vectors across the largest's; it is the one nearest to the z axis, or for lines along z to the x axis."""
    xx, xy, xz, yy, yz, zz = moments.T
    values, vectors = np.linalg.eigh(np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2))
    line = vectors[..., 2]
    along = np.where(line[..., 2:] ** 2 > 0.9, [1.0, 0.0, 0.0], [0.0, 0.0, 1.0])
    across = along - (along * line).sum(-1, keepdims=True) * line
    across /= np.linalg.norm(across, axis=-1, keepdims=True)
    normal = np.where((values[..., 1] - values[..., 0] <= 1e-9 * values[..., 2])[..., None], across, vectors[..., 0])
    lead = np.take_along_axis(normal, np.abs(normal).argmax(-1)[..., None], -1)
    return values, normal * np.where(lead < 0, -1.0, 1.0)


def surfels(moments: DataFrame, key: Sequence[str], flat: float = 0.1, wide: float = 0.05) -> DataFrame:
    """Plane of each cell whose smallest extent is at most `flat` of the middle one, and that at least `wide` of the
    largest: normal, eigenvalues and the weight 1 - smallest / middle."""

    def run(batches):
        for b in batches:
            m = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("xx", "xy", "xz", "yy", "yz", "zz")], -1)
            values, normal = smallest_eigen(m) if len(m) else (np.zeros((0, 3)), np.zeros((0, 3)))
            values = np.maximum(values, 0)
            kept = (values[:, 0] <= flat * values[:, 1]) & (values[:, 1] >= wide * values[:, 2]) & (values[:, 1] > 0)
            weight = 1 - values[:, 0] / np.where(values[:, 1] > 0, values[:, 1], 1)
            cols = [*[b.column(k) for k in (*key, "n", "mx", "my", "mz")], *[pa.array(normal[:, k]) for k in range(3)], *[pa.array(values[:, k]) for k in range(3)], pa.array(weight)]
            yield pa.RecordBatch.from_arrays(cols, names=[*key, "n", "mx", "my", "mz", "nx", "ny", "nz", "l0", "l1", "l2", "weight"]).filter(pa.array(kept))

    return moments.mapInArrow(run, ", ".join(f"{k} long" for k in (*key, "n")) + ", " + ", ".join(f"{k} double" for k in ("mx", "my", "mz", "nx", "ny", "nz", "l0", "l1", "l2", "weight")))


#: Points of a chunk, the unit that is sent and skipped; of a tile, whose neighbours one task sums; pairs of a chunk at a time, and of
#: chunks and points.
CHUNK, TILE, MOST_PAIRS, MOST_SPLIT = 64, 8192, 1 << 15, 1 << 18
_NUMBERS = ("x", "y", "z", "nx", "ny", "nz")
_CHUNKS = "kx long, ky long, kz long, tile string, chunk long, id array<long>, core array<boolean>, known array<boolean>, " + ", ".join(f"{c} array<double>" for c in _NUMBERS)
_NAMES = [c.split()[0] for c in _CHUNKS.split(", ")]


def leaves(p: np.ndarray, most: int) -> list[np.ndarray]:
    """Indices of points in compact groups of at most `most`, halved along the widest axis."""
    out, left = [], [np.arange(len(p))]
    while left:
        at = left.pop()
        if len(at) <= most:
            out.append(at)
            continue
        axis = np.ptp(p[at], axis=0).argmax()
        at = at[np.argsort(p[at, axis], kind="stable")]
        half = most * ((len(at) + 2 * most - 1) // (2 * most))
        left += [at[half:], at[:half]]
    return out


def outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 9 products of three rows with three rows, as the last axis."""
    return np.stack([a[i] * b[j] for i in range(3) for j in range(3)], -1)


class Chunks:
    """Points whose neighbours are summed, as arrays of CHUNK columns: places (NaN where there is no point), normals (0 there).

    What of other points is surely within the radius of a whole chunk, and what may be of some of its points, is told by its ball:
    the first counts as sums, the second is compared point by point.
    """

    def __init__(self, at: np.ndarray, normal: np.ndarray, held: np.ndarray, radius: float):
        self.held, self.radius = held, radius
        self.at, self.normal = np.where(held, at, np.nan), np.where(held, normal, 0.0)
        middle = at[:, held].mean(1) if held.any() else np.zeros(3)
        self.middle = middle[:, None]
        off = self.at - middle[:, None, None]
        low, high = np.fmin.reduce(off, 2), np.fmax.reduce(off, 2)
        centre = (low + high) / 2
        ball = np.sqrt(np.fmax.reduce(((off - centre[..., None]) ** 2).sum(0), 1)) * (1 + 1e-9)
        # Products with rows() are squares of distances, less one of the radius.
        self.left = np.stack([np.ones(held.shape), (off * off).sum(0) - radius * radius, *(-2 * off)], -1)
        self.balls = np.stack([np.ones(len(held)), (centre * centre).sum(0), *(-2 * centre)], -1)
        #: How far products may be off.
        self.room = 1e-14 * (2 * np.nanmax(np.abs(off), initial=0) * 3**0.5 + radius + 2 * np.nanmax(ball, initial=0)) ** 2
        self.inner = np.where(ball < radius, (radius - ball) ** 2 - self.room, -1.0)[:, None]
        self.outer = ((radius + ball) ** 2 + self.room)[:, None]

    def rows(self, at: np.ndarray, *more: np.ndarray) -> np.ndarray:
        """x2 + y2 + z2, 1, x, y, z around the middle, and more, of each point."""
        off = at - self.middle
        return np.stack([(off * off).sum(0), np.ones(at.shape[1]), *off, *more], -1)

    def split(self, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(some chunks, points wholly within the radius of each, those that may partly be), so many at a time."""
        step = max(1, MOST_SPLIT // max(len(rows), 1))
        for s in range(0, len(self.held), step):
            part = slice(s, s + step)
            away = self.balls[part] @ rows[:, :5].T
            whole = away <= self.inner[part]
            yield part, whole, (away <= self.outer[part]) & ~whole

    def pieces(self, chosen: np.ndarray, spaces: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """(chunk of the rows of chosen, some points, arrays for numbers of their pairs). The arrays are used again: to get new ones of
        this size from the system takes longer than to fill them."""
        step = max(1, MOST_PAIRS // CHUNK)
        space = np.empty((spaces, CHUNK * step))
        for k in np.flatnonzero(chosen.any(1)):
            points = np.flatnonzero(chosen[k])
            for s in range(0, len(points), step):
                some = points[s : s + step]
                yield k, some, [a[: CHUNK * len(some)].reshape(CHUNK, -1) for a in space]

    def near(self, k: int, rows: np.ndarray, space: np.ndarray, at: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Which points at[:, some], of these rows, are within the radius of those of chunk k. Where the products leave a doubt,
        differences tell."""
        above = np.matmul(self.left[k], rows[:, :5].T.copy(), out=space)
        out, possible = above <= -self.room, above <= self.room
        if np.count_nonzero(out) != np.count_nonzero(possible):
            i, j = np.nonzero(possible & ~out)
            d = self.at[:, k, i] - at[:, some[j]]
            out[i, j] = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= self.radius * self.radius
        return out


class Covariances:
    """Normals of the points' neighbourhoods, from sums around the middle of the tile."""

    def __init__(self, own: Chunks):
        self.own = own
        self.sums = np.zeros((*own.held.shape, 10))

    def add(self, at: np.ndarray, normal: np.ndarray) -> None:
        x, y, z = at - self.own.middle
        rows = self.own.rows(at, x * x, x * y, x * z, y * y, y * z)
        for part, whole, partly in self.own.split(rows):
            self.sums[part] += (whole.astype(float) @ rows)[:, None]
            for k, some, (space, taken) in self.own.pieces(partly, 2):
                theirs = rows.take(some, 0)
                taken[...] = self.own.near(k + part.start, theirs, space, at, some)
                self.sums[k + part.start] += taken @ theirs

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """The normals, and which points have more than two neighbours, themselves included."""
        square, n, x, y, z, xx, xy, xz, yy, yz = np.moveaxis(self.sums, -1, 0)
        many = np.maximum(n, 1)
        pairs = ((xx, x, x), (xy, x, y), (xz, x, z), (yy, y, y), (yz, y, z), (square - xx - yy, z, z))
        cov = np.stack([ab / many - a / many * (b / many) for ab, a, b in pairs], -1)
        raw = smallest_eigen(cov.reshape(-1, 6))[1].reshape(*n.shape, 3)
        return np.moveaxis(raw, -1, 0), self.own.held & (n > 2)


class Projections:
    """Points moved onto the planes of neighbours of a like normal, from sums over these.

    The normals of a chunk lie within an angle of an axis, signs aside, so that other normals are alike for all of them, or for none,
    or are compared.
    """

    def __init__(self, own: Chunks, least_cosine: float):
        self.own, self.least = own, least_cosine
        # Of the neighbours: number, sums of |cosine| and of |cosine| x place, sum of cosine x normal (that up to its sign).
        self.sums = np.zeros((*own.held.shape, 8))
        turn = np.where((own.normal * own.normal[:, :, :1]).sum(0) < 0, -1.0, 1.0)
        mean = (own.normal * turn).sum(2)
        size = np.linalg.norm(mean, axis=0)
        self.axis = (mean / np.where(size > 0, size, 1)).T
        cosine = np.einsum("ak,kap->ap", self.axis, own.normal)
        self.mine = np.moveaxis(own.normal * np.where(cosine < 0, -1.0, 1.0), 0, -1).copy()
        angle, limit = np.where(own.held, np.arccos(np.clip(np.abs(cosine), 0, 1)), 0).max(1), np.arccos(least_cosine)
        self.alike = np.where(angle < limit - 1e-7, np.cos(np.maximum(limit - 1e-7 - angle, 0)), 2.0)[:, None]
        self.possible = np.cos(np.minimum(limit + 1e-7 + angle, np.pi / 2))[:, None] - 1e-12
        # With normals turned to the axis, those of the others too, no pair of theirs that counts has a negative cosine.
        self.turned = angle + limit < np.pi / 2 - 1e-7

    def add(self, at: np.ndarray, normal: np.ndarray) -> None:
        rows = self.own.rows(at, *normal)
        place = rows[:, 1:5].T
        even = np.concatenate([place[:1], outer(normal, normal).T]).T.copy()
        odd = np.concatenate([normal * c for c in place]).T.copy()
        for part, whole, partly in self.own.split(rows):
            cosine = self.axis[part] @ normal
            size = np.abs(cosine)
            # Where all normals are alike, the sums are products of the points' sums with each one's own normal.
            alike = whole & (size >= self.alike[part])
            left = (whole | partly) & (size >= self.possible[part]) & ~alike
            sign = alike.astype(float)
            e, o = sign @ even, np.copysign(sign, cosine, out=sign) @ odd
            self.sums[part, :, 0] += e[:, None, 0]
            self.sums[part, :, 1:5] += self.mine[part] @ np.moveaxis(o.reshape(-1, 4, 3), 1, 2)
            self.sums[part, :, 5:] += self.mine[part] @ e[:, 1:].reshape(-1, 3, 3)
            for k, some, (w, share, taken) in self.own.pieces(left, 3):
                theirs, to = rows.take(some, 0), cosine[k, some]
                theirs[:, 5:] *= np.copysign(1.0, to)[:, None]
                k += part.start
                close = self.own.near(k, theirs, w, at, some)
                np.matmul(self.mine[k], theirs[:, 5:].T.copy(), out=w)
                share = w if self.turned[k] else np.abs(w, out=share)
                taken[...] = close & (share >= self.least)
                self.sums[k, :, 0] += taken @ theirs[:, 1]
                w *= taken
                if self.turned[k]:
                    self.sums[k, :, 1:] += w @ theirs[:, 1:]
                    continue
                share *= taken
                self.sums[k, :, 1:5] += share @ theirs[:, 1:5]
                self.sums[k, :, 5:] += w @ theirs[:, 5:]

    def done(self, known: np.ndarray, sensor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and normals toward the sensor."""
        p, normal = self.own.at, np.moveaxis(self.sums[..., 5:], -1, 0)
        size = np.linalg.norm(normal, axis=0)
        new = normal / np.where(size > 0, size, 1)
        total = self.sums[..., 1]
        shift = np.moveaxis(self.sums[..., 2:5], -1, 0) / np.where(total > 0, total, 1) + np.where(total > 0, self.own.middle[..., None] - p, 0)
        enough = (self.sums[..., 0] > 1) & known
        moved = np.where(enough, p + (shift * new).sum(0) * new, p)
        toward = ((sensor[:, None, None] - moved) * new).sum(0)
        return moved, new * np.where(toward < 0, -1.0, 1.0)


def smooth_block(p: np.ndarray, sensor: np.ndarray, radius: float, iterations: int, least_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points of a block moved onto the planes of their neighbourhoods, their normals, and which of them have one."""
    found = leaves(p, CHUNK)
    held = np.arange(CHUNK) < np.array([len(f) for f in found])[:, None]
    at, normal = np.zeros((3, *held.shape)), np.zeros((3, *held.shape))
    order = np.concatenate(found)
    at[:, held] = p[order].T
    alive = held

    def added(sums, taken: np.ndarray):
        points, theirs = at[:, taken], normal[:, taken]
        for s in range(0, points.shape[1], TILE):
            sums.add(points[:, s : s + TILE], theirs[:, s : s + TILE])
        return sums

    for step in range(iterations):
        normal, known = added(Covariances(Chunks(at, normal, alive, radius)), alive).done()
        if step == 0:
            alive = known
        at, normal = added(Projections(Chunks(at, normal, held, radius), least_cosine), known).done(known, sensor)
    places, normals, ok = np.empty_like(p), np.empty_like(p), np.empty(len(p), bool)
    places[order], normals[order] = at[:, held].T, normal[:, held].T
    ok[order] = (alive & ((normal * normal).sum(0) > 0.25))[held]
    return places, normals, ok


def _arrays(rows: pa.Table, *names: str) -> np.ndarray:
    """Columns of arrays as rows of CHUNK, filled up with zeros."""
    n = pc.list_value_length(rows.column("x")).to_numpy()
    at = np.arange(CHUNK) < n[:, None]
    out = np.zeros((len(names), *at.shape))
    for k, c in enumerate(names):
        out[k][at] = np.concatenate([[]] + [part.flatten().to_numpy(zero_copy_only=False) for part in rows.column(c).chunks])
    return out


def _lists(of: np.ndarray, held: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(held.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(of[held], kind))


def _packed(pts: DataFrame, edge: float, most: int | None = None) -> DataFrame:
    """Chunks of the tiles of each block: cells of an edge, slabs along x of cells with many points, parts by a hash of slabs with
    many still, so that no tile holds more than some `most` (TILE) points."""
    most = most or TILE
    block, cell = ["kx", "ky", "kz"], list(CELL)
    celled = with_cells(pts, edge)
    slabs = celled.groupBy(*block, *cell).agg(F.ceil(F.count("*") / most).alias("slabs"))
    slab = F.least(F.floor((F.col("x") / edge - F.col("cx")) * F.col("slabs")), F.col("slabs") - 1).alias("slab")
    cut = celled.join(slabs, [*block, *cell]).select(*block, *cell, slab, "point_id", "x", "y", "z", "core")
    parts = cut.groupBy(*block, *cell, "slab").agg(F.ceil(F.count("*") / (2 * most)).alias("parts"))
    part = F.pmod(F.xxhash64("point_id"), F.col("parts"))
    dealt = cut.join(parts, [*block, *cell, "slab"]).select(*block, F.concat_ws(" ", *block, *cell, "slab", part).alias("tile"), "point_id", "x", "y", "z", "core")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("point_id")
        p = np.stack([t.column(c).to_numpy() for c in "xyz"], -1)
        found = leaves(p, CHUNK)
        ends, order = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)), np.concatenate(found)
        lists = {"id": t.column("point_id"), "core": t.column("core"), "known": pa.array(np.ones(len(p), bool)), **{c: t.column(c) for c in "xyz"}, **{c: pa.array(np.zeros(len(p))) for c in _NUMBERS[3:]}}
        cols = {c: pa.ListArray.from_arrays(ends, v.take(pa.array(order)).combine_chunks() if isinstance(v, pa.ChunkedArray) else v.take(pa.array(order))) for c, v in lists.items()}
        same = {c: t.column(c).take(pa.array(np.zeros(len(found), int))) for c in (*block, "tile")}
        return pa.table({**same, "chunk": pa.array(np.arange(len(found))), **cols}).select(_NAMES)

    return dealt.groupBy("tile").applyInArrow(run, _CHUNKS)


def _tiles_with_near(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table | None]]:
    """(whether it is a tile's own, rows) in pieces, a tile's own rows first and whole; (False, None) after the last."""
    name, own, asked = None, [], False
    for batch in batches:
        t = pa.Table.from_batches([batch])
        to, first = (t.column(c).to_numpy() for c in ("to", "own"))
        starts = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (first[1:] != first[:-1])])) if len(to) else []
        for s, e in zip(starts, [*starts[1:], len(to)], strict=True):
            if name is not None and name != to[s]:
                if not asked:
                    yield True, pa.concat_tables(own)
                yield False, None
                own, asked = [], False
            name = to[s]
            if first[s]:
                own.append(t.slice(s, e - s))
                continue
            if not asked:
                yield True, pa.concat_tables(own)
                asked = True
            for k in range(s, e, TILE // CHUNK):
                yield False, t.slice(k, min(TILE // CHUNK, e - k))
    if name is not None:
        if not asked:
            yield True, pa.concat_tables(own)
        yield False, None


def _summed(chunks: DataFrame, radius: float, sums, finish, schema: str, core: bool) -> DataFrame:
    """finish(rows, sums) of each tile (only those with points of the block's own, if core) after all chunks within the radius were
    added. A task holds one tile, its sums and a batch of chunks."""
    box = [f"{side}{c}" for c in "xyz" for side in "lh"]
    lows = chunks.select("*", *[f(c).alias(f"{side}{c}") for c in "xyz" for side, f in (("l", F.array_min), ("h", F.array_max))])
    tiles = lows.groupBy("kx", "ky", "kz", "tile").agg(*[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in box], F.max(F.exists("core", lambda v: v)).alias("asks"))
    ask = tiles.where("asks") if core else tiles

    def close(a: str, b: str):
        gap = [F.greatest(F.col(f"{a}l{c}") - F.col(f"{b}h{c}"), F.col(f"{b}l{c}") - F.col(f"{a}h{c}"), F.lit(0.0)) for c in "xyz"]
        return G.dot(gap, gap) <= radius * radius * (1 + 1e-9)

    pairs = ask.select("kx", "ky", "kz", F.col("tile").alias("to"), *[F.col(c).alias(f"q{c}") for c in box]).join(tiles.drop("asks"), ["kx", "ky", "kz"]).where(close("q", "")).select("to", "tile", *[f"q{c}" for c in box])
    own = F.col("to") == F.col("tile")
    sent = lows.join(pairs, "tile").where(own | close("q", "")).select("to", own.alias("own"), *[F.when(own, F.col(c)).alias(c) if c in ("id", "core") else c for c in _NAMES])
    least = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(max(least, 4 * chunks.sparkSession.sparkContext.defaultParallelism), "to").sortWithinPartitions("to", F.desc("own"), "tile", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = total = None
        for mine, t in _tiles_with_near(batches):
            if t is None:
                yield from finish(rows, total).to_batches()
                continue
            values = _arrays(t, *_NUMBERS, "known")
            held = np.arange(CHUNK) < pc.list_value_length(t.column("x")).to_numpy()[:, None]
            if mine:
                asked = held & (_arrays(t, "core")[0] > 0) if core else held
                rows, total = t, sums(Chunks(values[:3], values[3:6], asked, radius))
            for k in range(0, t.num_rows, TILE // CHUNK):
                part = slice(k, k + TILE // CHUNK)
                known = held[part] & (values[6, part] > 0)
                total.add(values[:3, part][:, known], values[3:6, part][:, known])

    return dealt.mapInArrow(run, schema)


def smoothed_surface(pts: DataFrame, block: float, halo: float, radius: float, sensor: Sequence[float], iterations: int = 2, least_cosine: float = 0.8660254037844386) -> DataFrame:
    """point_id, smoothed x, y, z and normals toward the sensor, of points with enough neighbours.

    Points go to their block and, within the halo, to the blocks around; a point is returned by its own block alone. Within a
    block, tiles of bounded size meet the chunks within the radius: what is wholly within it, and of like normals, as sums, the
    rest point by point. So blocks may be dense; the work still grows faster than the points where these lie ever closer. Where
    no block has more points than a tile, a task smooths a block.
    """
    at = np.array(sensor, float)
    placed = halo_blocks(pts.select("point_id", "x", "y", "z").where(G.finite(F.col("x")) & G.finite(F.col("y")) & G.finite(F.col("z"))), block, halo)
    placed, block_of = kept(placed, "smooth-blocks"), ["kx", "ky", "kz"]
    most, total = placed.groupBy(*block_of).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    if most <= TILE:

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("point_id")
            p, normal, ok = smooth_block(np.stack([t.column(c).to_numpy() for c in "xyz"], -1), at, radius, iterations, least_cosine)
            keep = np.flatnonzero(ok & t.column("core").to_numpy())
            return pa.table({"point_id": t.column("point_id").take(pa.array(keep)), **dict(zip(_NUMBERS, np.concatenate([p, normal], 1)[keep].T, strict=True))})

        return placed.groupBy(*block_of).applyInArrow(run, "point_id long, " + ", ".join(f"{c} double" for c in _NUMBERS))
    # Chunks are sent to each tile around, so tiles are as large as leaves each core eight.
    tile = max(TILE, min(4 * TILE, total // (8 * pts.sparkSession.sparkContext.defaultParallelism)))
    chunks = kept(_packed(placed, radius, tile), "smooth-chunks")

    def table_of(rows: pa.Table, held: np.ndarray, known: np.ndarray, numbers: np.ndarray) -> pa.Table:
        whole = np.arange(CHUNK) < pc.list_value_length(rows.column("x")).to_numpy()[:, None]
        keep = pa.array(held[whole])
        flat = {c: pa.chunked_array([part.flatten() for part in rows.column(c).chunks]).combine_chunks().filter(keep) for c in ("id", "core")}
        ends = pa.array(np.concatenate([[0], np.cumsum(held.sum(1))]).astype(np.int32))
        cols = {c: pa.ListArray.from_arrays(ends, v) for c, v in flat.items()}
        out = {**{c: rows.column(c) for c in _NAMES[:5]}, **cols, "known": _lists(known, held, pa.bool_()), **{c: _lists(v, held, pa.float64()) for c, v in zip(_NUMBERS, numbers, strict=True)}}
        return pa.table(out).filter(pa.array(held.any(1)))

    for step in range(iterations):
        last = step == iterations - 1

        def covered(rows: pa.Table, total: Covariances, step=step) -> pa.Table:
            raw, known = total.done()
            return table_of(rows, known if step == 0 else total.own.held, known, np.concatenate([total.own.at, raw]))

        def projected(rows: pa.Table, total: Projections) -> pa.Table:
            known = _arrays(rows, "known")[0] > 0
            return table_of(rows, total.own.held, np.ones_like(known), np.concatenate(total.done(known, at)))

        chunks = kept(_summed(chunks, radius, Covariances, covered, _CHUNKS, False), "smooth-normals")
        chunks = kept(_summed(chunks, radius, lambda own: Projections(own, least_cosine), projected, _CHUNKS, last), "smooth-places")
    z = chunks.select(F.explode(F.arrays_zip("id", "core", *_NUMBERS)).alias("p")).select("p.*")
    return z.where(F.col("core") & (G.dot([F.col(c) for c in _NUMBERS[3:]], [F.col(c) for c in _NUMBERS[3:]]) > 0.25)).select(F.col("id").alias("point_id"), *_NUMBERS)


def match_planes(queries: DataFrame, planes: DataFrame, reach: float, residual: float) -> DataFrame:
    """Nearest plane (point and normal) within `reach` of each query whose plane it is within `residual` of.

    Each query probes the 27 cells around it, so that this is an equi-join on cells of the size of the reach.
    """
    around = F.sequence(F.lit(-1), F.lit(1))
    m = with_cells(planes, reach).alias("m")
    on = (F.col("q.cx") == F.col("m.cx")) & (F.col("q.cy") == F.col("m.cy")) & (F.col("q.cz") == F.col("m.cz"))
    away = G.sub(xyz("q."), xyz("m."))
    d2, r = G.dot(away, away), G.dot(away, [F.col(f"m.{c}") for c in ("nx", "ny", "nz")])

    def near_planes(points: DataFrame) -> DataFrame:
        probes = with_cells(points, reach)
        for c in CELL:
            probes = probes.withColumn("_o", F.explode(around)).withColumn(c, F.col(c) + F.col("_o")).drop("_o")
        return probes.alias("q").join(m, on).where((d2 <= reach * reach) & (F.abs(r) <= residual))

    # Least distances are hashed; a minimum of structs would sort all pairs, so planes come from a second look, at these distances.
    own = ["point_id", "x", "y", "z"]
    least = near_planes(queries.select(*own)).groupBy(*[F.col(f"q.{c}").alias(c) for c in own]).agg(F.min(d2).alias("least"))
    near = near_planes(least).where(d2 <= F.col("q.least"))
    best = near.groupBy(F.col("q.point_id").alias("point_id")).agg(F.min(F.struct(d2.alias("d"), F.col("m.point_id").alias("m"), r.alias("r"))).alias("b"))
    return best.select("point_id", F.col("b.m").alias("plane"), F.col("b.r").alias("residual"), F.sqrt("b.d").alias("distance"))
