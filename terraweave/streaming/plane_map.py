"""A map of planes that grows with a stream of scans: moments of cells as keyed state.

A cell keeps the number, the mean and the scatter of its points, the mean place of the sensors that saw it and in how many
frames. With enough points of enough frames that lie flat it is a plane, whose normal faces its sensors. Cells whose mean is
too far from the sensor are given up after each frame, so the state of a recording is bounded by the volume around it. A scan
is matched to the planes of the frames before it, then added. The same map serves a stream (transformWithState, the cells a
MapState) and a table (a fold over sorted scans, one of which is held at a time).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terraweave.streaming.odometry import whole_scans

GRID, MOST_DISTANCE = 0.4, 35.0
#: A plane has so many points and frames, a second eigenvalue of SPREAD or more and a first of FLAT and a share of the second at most.
LEAST_POINTS, LEAST_FRAMES, SPREAD, FLAT, FLAT_SHARE, NOISE = 12, 2, 0.0004, 0.0004, 0.1, 0.03
#: A point is matched within so many cells of a plane's mean, seen under this cosine or more, and no further off the plane.
REACH, LEAST_COSINE, MOST_OFF = 1.5, float(np.cos(np.radians(75.0))), 0.15
SCANS = ["recording", "frame", "sample", "x", "y", "z", "sx", "sy", "sz"]
STATS = "recording long, frame long, points long, matched long, no_plane long, backface long, grazing long, off_plane long, cells long, planes long"
CELLS = "recording long, cx long, cy long, cz long, n long, frames long, mx double, my double, mz double, nx double, ny double, nz double, variance double, plane boolean"
#: A cell: n, frames, last frame, mean (3), scatter (3 x 3), sensor (3), plane, normal (3), variance.
_WIDTH = 23
_UP = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
_VALUE = "n double, frames double, last double, mx double, my double, mz double, xx double, xy double, xz double, yy double, yz double, zz double, vx double, vy double, vz double"


def cells_of(p: np.ndarray, grid: float) -> np.ndarray:
    cell = np.floor(p / grid)
    if not (np.isfinite(cell).all() and (np.abs(cell) <= 1e8).all()):
        raise ValueError("a coordinate is not finite or too large for the map")
    return cell.astype(np.int64)


class PlaneMap:
    def __init__(self, grid: float = GRID, most_distance: float = MOST_DISTANCE):
        self.grid, self.most, self.cells = grid, most_distance, {}

    def add(self, points: np.ndarray, sensor: np.ndarray, frame: int) -> tuple[set, set]:
        """Adds the points of a frame, seen from one sensor place each; returns the cells changed and those given up."""
        touched: set = set()
        if len(points):
            keys, of = np.unique(cells_of(points, self.grid), axis=0, return_inverse=True)
            of = of.ravel()
            n = np.bincount(of)
            total = lambda v: np.stack([np.bincount(of, v[:, k]) for k in range(v.shape[1])], -1)
            mean = total(points) / n[:, None]
            off = points - mean[of]
            scatter = total((off[:, :, None] * off[:, None, :]).reshape(-1, 9))
            seen = total(sensor) / n[:, None]
            now = np.zeros((len(keys), _WIDTH))
            names = list(map(tuple, keys.tolist()))
            old = [self.cells.get(k) for k in names]
            known = np.array([o is not None for o in old])
            if known.any():
                now[known] = [o for o in old if o is not None]
            before, after = now[:, 0].copy(), now[:, 0] + n
            shift = mean - now[:, 3:6]
            now[:, 1] += ~known | (now[:, 2] != frame)
            now[:, 0], now[:, 2] = after, frame
            now[:, 3:6] += shift * (n / after)[:, None]
            now[:, 6:15] += scatter + (shift[:, :, None] * shift[:, None, :]).reshape(-1, 9) * (before * n / after)[:, None]
            now[:, 15:18] += (seen - now[:, 15:18]) * (n / after)[:, None]
            self._fit(now)
            self.cells.update(zip(names, now, strict=True))
            touched = set(names)
        here = sensor.mean(0) if len(sensor) else None
        gone = self._leave(here) if here is not None else set()
        return touched - gone, gone

    @staticmethod
    def _fit(cells: np.ndarray) -> None:
        cells[:, 18:] = 0
        at = np.flatnonzero((cells[:, 0] >= LEAST_POINTS) & (cells[:, 1] >= LEAST_FRAMES))
        if len(at):
            values, vectors = np.linalg.eigh(cells[at, 6:15].reshape(-1, 3, 3) / cells[at, :1, None])
            ok = (values[:, 1] >= SPREAD) & (values[:, 0] <= FLAT) & (values[:, 0] <= FLAT_SHARE * values[:, 1])
            at, values, normal = at[ok], values[ok], vectors[ok, :, 0]
            away = np.einsum("ij,ij->i", normal, cells[at, 15:18] - cells[at, 3:6]) < 0
            normal[away] *= -1
            cells[at, 18], cells[at, 19:22], cells[at, 22] = 1, normal, NOISE**2 + np.maximum(0, values[:, 0])

    def _leave(self, here: np.ndarray) -> set:
        if not self.cells:
            return set()
        names = list(self.cells)
        means = np.array([self.cells[k][3:6] for k in names])
        gone = {names[k] for k in np.flatnonzero(((means - here) ** 2).sum(1) > self.most**2)}
        for k in gone:
            del self.cells[k]
        return gone

    def match(self, points: np.ndarray, sensor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What became of each point (0 matched, 1 no plane, 2 back face, 3 grazing, 4 off the plane), and the planes."""
        why, plane = np.ones(len(points), np.int64), np.zeros((len(points), _WIDTH))
        if not len(points) or not self.cells:
            return why, plane
        cell, best = cells_of(points, self.grid), np.full(len(points), np.inf)
        for step in np.ndindex(3, 3, 3):
            found = [self.cells.get(k) for k in map(tuple, (cell + np.array(step) - 1).tolist())]
            at = np.array([k for k, f in enumerate(found) if f is not None and f[18]], np.int64)
            if len(at):
                there = np.array([found[k] for k in at])
                d2 = ((points[at] - there[:, 3:6]) ** 2).sum(1)
                nearer = (d2 <= (REACH * self.grid) ** 2) & (d2 < best[at])
                best[at[nearer]], plane[at[nearer]] = d2[nearer], there[nearer]
        sight = sensor - points
        length = np.linalg.norm(sight, axis=1)
        cosine = np.einsum("ij,ij->i", plane[:, 19:22], sight) / np.where(length > 0, length, 1)
        off = np.abs(np.einsum("ij,ij->i", plane[:, 19:22], points - plane[:, 3:6]))
        why = np.select([~np.isfinite(best), cosine <= 0, cosine < LEAST_COSINE, off > MOST_OFF], [1, 2, 3, 4], 0)
        return why, plane

    def take(self, points: np.ndarray, sensor: np.ndarray, frame: int) -> tuple[tuple, set, set]:
        """Matches a scan, then adds it: the row of its counts, and what add() returns. Points that are not finite drop out."""
        fit = np.isfinite(points).all(1) & np.isfinite(sensor).all(1)
        points, sensor = points[fit], sensor[fit]
        why, _ = self.match(points, sensor)
        changed, gone = self.add(points, sensor, frame)
        planes = sum(1 for c in self.cells.values() if c[18])
        return (frame, len(points), *(int((why == k).sum()) for k in range(5)), len(self.cells), planes), changed, gone

    def rows(self, recording: int) -> list[tuple]:
        return [(recording, *k, int(c[0]), int(c[1]), *c[3:6].tolist(), *c[19:23].tolist(), bool(c[18])) for k, c in sorted(self.cells.items())]


class PlaneMapper(StatefulProcessor):
    """Counts of each frame; the cells are a MapState, of which a batch writes what has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("cells", "x long, y long, z long", _VALUE)

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        m, changed, gone = PlaneMap(), set(), set()
        held = [(tuple(int(v) for v in k), np.array(v, float)) for k, v in self.state.iterator()]
        if held:
            cells = np.zeros((len(held), _WIDTH))
            values = np.array([v for _, v in held])
            cells[:, :6], cells[:, 15:18] = values[:, :6], values[:, 12:15]
            for k, (a, b) in enumerate(_UP):
                cells[:, 6 + 3 * a + b] = cells[:, 6 + 3 * b + a] = values[:, 6 + k]
            PlaneMap._fit(cells)
            m.cells = {k: c for (k, _), c in zip(held, cells, strict=True)}
        out = []
        for frame, scan in pd.concat(rows).sort_values(["frame", "sample"], kind="stable").groupby("frame", sort=True):
            row, new, left = m.take(scan[["x", "y", "z"]].to_numpy(float), scan[["sx", "sy", "sz"]].to_numpy(float), int(frame))
            out.append((int(key[0]), *row))
            changed, gone = (changed | new) - left, (gone | left) - new
        known = {k for k, _ in held}
        for k in gone & known:
            self.state.removeKey(k)
        for k in changed:
            c = m.cells[k]
            self.state.updateValue(k, tuple(float(v) for v in (*c[:6], *(c[6 + 3 * a + b] for a, b in _UP), *c[15:18])))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATS.split(", ")])

    def close(self) -> None:
        pass


def stream(scans: DataFrame) -> DataFrame:
    """Counts of each frame of a stream of SCANS, points in world coordinates and the sensor's place (sx, sy, sz) with each.

    All points of a frame come in one micro-batch, frames of a recording in their order.
    """
    return scans.select(*SCANS).groupBy("recording").transformWithStateInPandas(PlaneMapper(), STATS, "Append", "None")


def _folded(scans: DataFrame, schema: str, last_only: bool) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, m = None, PlaneMap()
        for recording, frame, p in whole_scans(batches):
            if recording != last:
                if last_only and last is not None:
                    yield emit(m.rows(last))
                last, m = recording, PlaneMap()
            row, _, _ = m.take(p[:, :3], p[:, 3:], frame)
            if not last_only:
                yield emit([(recording, *row)])
        if last_only and last is not None:
            yield emit(m.rows(last))

    order = ["recording", "frame", "sample"]
    known = scans.where("recording IS NOT NULL AND frame IS NOT NULL").select(*SCANS)
    return known.repartition("recording").sortWithinPartitions(*order).mapInArrow(fold, schema)


def table(scans: DataFrame) -> DataFrame:
    """The rows of stream() for a table of the same columns: recordings in parallel, scans of one in their order.

    A task holds one scan and the map of one recording, which its distance bounds. Rows without recording or frame drop out.
    """
    return _folded(scans, STATS, False)


def planes(scans: DataFrame) -> DataFrame:
    """The cells of each recording's map after its last frame: number, frames, mean, and normal and variance of planes."""
    return _folded(scans, CELLS, True)
