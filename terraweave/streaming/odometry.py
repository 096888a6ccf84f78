"""Odometry over a stream of scans: each scan is registered to the map of the scans before it.

Registration is point-to-plane; the map is a bounded number of points a voxel within a bounded distance, so the state of
a recording is bounded. The order of scans within a recording is inherent: recordings run in parallel, scans of one
recording do not. The same step serves a stream (transformWithStateInPandas) and a table (a fold over sorted,
thinned scans).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terraweave.operators.neighbours import CellIndex, Followed

VOXEL, MOST_POINTS, REACH, SIGMA = 0.5, 20, 30.0, 0.3
POSES = "recording long, frame long, tx double, ty double, tz double, wx double, wy double, wz double, matched long"


def rotation(w: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if angle < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * k @ k


def rotation_vector(r: np.ndarray) -> np.ndarray:
    angle = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    return v * (angle / np.sin(angle) if angle > 1e-9 else 1.0)


def downsampled(p: np.ndarray, size: float) -> np.ndarray:
    """The first point of each voxel."""
    _, first = np.unique(np.floor(p / size).astype(np.int64), axis=0, return_index=True)
    return p[np.sort(first)]


class State:
    """Pose, the motion of the last step, and the points of the local map."""

    def __init__(self):
        self.r, self.t, self.dr, self.dt, self.map = np.eye(3), np.zeros(3), np.eye(3), np.zeros(3), np.zeros((0, 3))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, r=self.r, t=self.t, dr=self.dr, dt=self.dt, map=self.map)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> State:
        s = cls()
        with np.load(io.BytesIO(raw)) as z:
            s.r, s.t, s.dr, s.dt, s.map = (z[k] for k in ("r", "t", "dr", "dt", "map"))
        return s


def register(s: State, scan: np.ndarray, rounds: int = 20, gate: float = 3 * SIGMA) -> int:
    """Moves the state to the pose of a scan; returns how many points found a plane.

    A coarse thinning of the scan is matched, a finer one goes into the map. Planes are those of the five nearest map points
    within 2 gates, from the cells around a point in the first round, then from what was near in it.
    """
    p = downsampled(scan[np.linalg.norm(scan, axis=1) <= REACH], VOXEL / 2)
    source = downsampled(p, 1.5 * VOXEL)
    first = not len(s.map)
    r, t = (s.r, s.t) if first else (s.r @ s.dr, s.r @ s.dt + s.t)
    matched = 0
    known = Followed(CellIndex(s.map, VOXEL), 5, 2 * gate)
    for _ in range(0 if first or len(s.map) < 6 else rounds):
        q = source @ r.T + t
        at, _ = known.nearest(q)
        q, at = q[found := at[:, -1] >= 0], at[found]
        if len(q) < 6:
            matched = len(q)
            break
        near = s.map[at]
        mean = near.mean(1)
        off = near - mean[:, None]
        values, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", off, off) / near.shape[1])
        normal = vectors[..., 0]
        ok = values[:, 0] <= 0.1 * np.maximum(values[:, 1], 1e-12)
        res = ((q - mean) * normal).sum(1)
        ok &= np.abs(res) <= gate
        matched = int(ok.sum())
        if matched < 6:
            break
        jac = np.concatenate([np.cross(q[ok], normal[ok]), normal[ok]], 1)
        w = 1 / (1 + (res[ok] / SIGMA) ** 2)
        x = np.linalg.solve(jac.T @ (jac * w[:, None]) + np.eye(6) * 1e-6, -jac.T @ (w * res[ok]))
        dr = rotation(x[:3])
        r, t = dr @ r, dr @ t + x[3:]
        if np.linalg.norm(x) < 1e-5:
            break
    if not first:
        s.dr, s.dt = s.r.T @ r, s.r.T @ (t - s.t)
    s.r, s.t = r, t
    grown = np.concatenate([s.map, p @ r.T + t])
    grown = grown[np.linalg.norm(grown - t, axis=1) <= REACH]
    cell = np.floor(grown / VOXEL).astype(np.int64)
    order = np.lexsort((np.arange(len(grown)), cell[:, 2], cell[:, 1], cell[:, 0]))
    c = cell[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]).any(1)
    place = np.arange(len(c)) - np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
    s.map = grown[np.sort(order[place < MOST_POINTS])]
    return matched


def steps(s: State, rows: pd.DataFrame, recording: int) -> Iterator[tuple]:
    for frame, scan in rows.sort_values(["frame", "sample"], kind="stable").groupby("frame", sort=True):
        matched = register(s, scan[["x", "y", "z"]].to_numpy(float))
        yield (recording, int(frame), *map(float, s.t), *map(float, rotation_vector(s.r)), matched)


class Odometer(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "raw binary")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        s = State.load(self.state.get()[0]) if self.state.exists() else State()
        out = list(steps(s, pd.concat(rows), int(key[0])))
        self.state.update((s.dump(),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in POSES.split(", ")])

    def close(self) -> None:
        pass


def stream(scans: DataFrame) -> DataFrame:
    """Poses of a stream of (recording, frame, sample, x, y, z); all points of a frame come in one micro-batch."""
    return scans.groupBy("recording").transformWithStateInPandas(Odometer(), POSES, "Append", "None")


def thinned(scans: DataFrame) -> DataFrame:
    """The points that register() keeps of each scan: within reach, the first of each voxel. All others of a scan become
    one row, which register() drops, so that no frame is lost."""
    near = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) <= REACH
    at = [F.when(near, F.floor(F.col(c) / (VOXEL / 2))).alias(f"_{c}") for c in "xyz"]
    return scans.groupBy("recording", "frame", *at).agg(F.min(F.struct("sample", "x", "y", "z")).alias("p")).select("recording", "frame", "p.*")


def whole_scans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(recording, frame, values) of each scan from sorted batches of recording, frame, sample and columns of numbers."""
    key, parts = None, []
    for batch in batches:
        own, frame, _, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(own):
            continue
        p = np.stack(rest, axis=1).astype(float)
        starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (frame[1:] != frame[:-1])]))
        for s, e in zip(starts, [*starts[1:], len(own)], strict=True):
            if parts and key != (own[s], frame[s]):
                yield int(key[0]), int(key[1]), np.concatenate(parts)
                parts = []
            key = own[s], frame[s]
            parts.append(p[s:e])
    if parts:
        yield int(key[0]), int(key[1]), np.concatenate(parts)


def table(scans: DataFrame) -> DataFrame:
    """Poses of a table of the same columns: a task reads the thinned scans of a recording in their order and holds one of
    them, the map and a batch of rows, never a recording."""
    names = ["recording", "frame", "sample", "x", "y", "z"]
    kinds = [pa.int64() if "long" in c else pa.float64() for c in POSES.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, State()
        for recording, frame, scan in whole_scans(batches):
            if recording != last:
                last, state = recording, State()
            matched = register(state, scan)
            row = (recording, frame, *map(float, state.t), *map(float, rotation_vector(state.r)), matched)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in POSES.split(", ")])

    parts = int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return thinned(scans).select(*names).repartition(parts, "recording").sortWithinPartitions(*names[:3]).mapInArrow(fold, POSES)
