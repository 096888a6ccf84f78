"""Inertial states along a recording: an 18-component error state that is propagated through samples and corrected by planes.

Components: rotation, position, velocity, biases of rate and acceleration, gravity. Between scans the state and its
covariance go from sample to sample by the mean of two neighbours; at a scan's end points on planes correct it, as the most
likely state under what was predicted. The last state and the samples after it are a recording's whole memory, for a stream
(transformWithState) as for a table (a fold over sorted rows).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terraweave.streaming.odometry import rotation, rotation_vector

ROT, POS, VEL, BG, BA, GRAV = (slice(k, k + 3) for k in range(0, 18, 3))
#: Samples further apart than this, in seconds, do not cover the time between them.
MOST_GAP = 0.1
#: Densities of the noise of rate and acceleration and of the drift of their biases.
NOISE = (0.001, 0.01, 0.0001, 0.001)
#: A row is a sample (kind 0: ax..cz are rate and acceleration) or a point on a plane (kind 1: point, mean, normal, variance).
ROWS = ["recording", "t", "kind", "frame", "sample", *(a + b for a in "abc" for b in "xyz"), "variance"]
STATES = (
    "recording long, frame long, t double, reason string, accepted boolean, observations long, pose_rank long, iterations long, first_rms double, last_rms double, "
    "px double, py double, pz double, rx double, ry double, rz double, vx double, vy double, vz double, spread double"
)


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


@dataclass
class Inertial:
    r: np.ndarray = field(default_factory=lambda: np.eye(3))
    p: np.ndarray = field(default_factory=lambda: np.zeros(3))
    v: np.ndarray = field(default_factory=lambda: np.zeros(3))
    bg: np.ndarray = field(default_factory=lambda: np.zeros(3))
    ba: np.ndarray = field(default_factory=lambda: np.zeros(3))
    g: np.ndarray = field(default_factory=lambda: np.array([0.0, 0, -9.81]))
    cov: np.ndarray = field(default_factory=lambda: np.diag(np.repeat([0.01, 0.01, 0.1, 0.001, 0.1, 0.05], 3) ** 2))
    t: float = 0.0

    def moved(self, x: np.ndarray) -> Inertial:
        return replace(self, r=self.r @ rotation(x[ROT]), p=self.p + x[POS], v=self.v + x[VEL], bg=self.bg + x[BG], ba=self.ba + x[BA], g=self.g + x[GRAV])


def propagate(s: Inertial, dt: float, gyro: tuple, accel: tuple, noise=NOISE) -> Inertial:
    """One step by the mean of two samples (a, b) of rates and accelerations; ValueError where they do not cover it."""
    if not 0 < dt <= MOST_GAP or not np.isfinite([*gyro, *accel]).all():
        raise ValueError("samples do not cover the interval")
    w, a = np.add(*gyro) / 2 - s.bg, np.add(*accel) / 2 - s.ba
    middle = s.r @ rotation(w * dt / 2)
    world = middle @ a + s.g
    f, one = np.zeros((18, 18)), np.eye(3)
    f[ROT, ROT], f[ROT, BG], f[POS, VEL] = -skew(w), -one, one
    f[VEL, ROT], f[VEL, BA], f[VEL, GRAV] = -middle @ skew(a), -middle, one
    whole, half = np.eye(18) + f * dt + f @ f * (dt * dt / 2), np.eye(18) + f * (dt / 2)
    drive = np.zeros((18, 12))
    drive[ROT, :3], drive[VEL, 3:6], drive[BG, 6:9], drive[BA, 9:] = -one, -middle, one, one
    driven = half @ drive * np.repeat(noise, 3)  # a product with its transpose cannot have negative directions
    cov = whole @ s.cov @ whole.T + driven @ driven.T * dt
    return Inertial(s.r @ rotation(w * dt), s.p + s.v * dt + world * (dt * dt / 2), s.v + world * dt, s.bg, s.ba, s.g, (cov + cov.T) / 2, s.t + dt)


def through(s: Inertial, samples: np.ndarray, end: float, noise=NOISE) -> Inertial:
    """The state at `end`, from samples (t, rate, acceleration) in order of time that reach from s.t to there.

    Samples at both ends are interpolated, never extrapolated: ValueError where they do not reach.
    """
    t = samples[:, 0]
    if len(t) < 2 or s.t < t[0] or end > t[-1] or end < s.t:
        raise ValueError("samples do not cover the interval")

    def at(time: float) -> np.ndarray:
        hi = int(np.searchsorted(t, time))
        if t[hi] == time:
            return samples[hi]
        if t[hi] - t[hi - 1] > MOST_GAP:
            raise ValueError("samples do not cover the interval")
        u = (time - t[hi - 1]) / (t[hi] - t[hi - 1])
        return (1 - u) * samples[hi - 1] + u * samples[hi]

    inner = samples[(t > s.t) & (t < end)]
    knots = [at(s.t), *inner, at(end)]
    for a, b in zip(knots, knots[1:], strict=False):
        if b[0] > a[0]:
            s = replace(propagate(s, b[0] - a[0], (a[1:4], b[1:4]), (a[4:7], b[4:7]), noise), t=float(b[0]))
    return s


def right_jacobian(w: np.ndarray) -> np.ndarray:
    """How a small turn after the turn w changes w: its inverse transports tangents."""
    angle, k = np.linalg.norm(w), skew(w)
    if angle < 1e-5:
        return np.eye(3) - k / 2 + k @ k / 6
    return np.eye(3) - (1 - np.cos(angle)) / angle**2 * k + (angle - np.sin(angle)) / angle**3 * k @ k


@dataclass
class Report:
    reason: str = ""
    accepted: bool = False
    observations: int = 0
    pose_rank: int = 0
    iterations: int = 0
    first_rms: float = 0.0
    last_rms: float = 0.0


@dataclass(frozen=True)
class Limits:
    rounds: int = 10
    least: int = 12
    rank: int = 6
    rank_share: float = 1e-7
    huber: float = 3.0
    still: float = 1e-6
    turn_step: float = 0.15
    move_step: float = 0.3
    most_turn: float = 0.5
    most_move: float = 1.0


def update(prior: Inertial, points: np.ndarray, planes: np.ndarray, normals: np.ndarray, variance: np.ndarray | float = 0.03**2, limits: Limits = Limits()) -> tuple[Inertial, Report]:  # noqa: B008
    """The most likely state under prior and residuals n . (R x + p - m), reweighted beyond `huber` deviations.

    Gauss-Newton with a bounded step that is halved until the cost does not rise. Refused, with the reason and the prior as
    it was: too few observations, planes that leave a direction of the pose open (at the start or the end), a step that no
    halving makes good within the bounds of the correction, or no standstill within the rounds.
    """
    out = Report(observations=len(points))
    if len(points) < limits.least:
        out.reason = "too few observations"
        return prior, out
    variance = np.broadcast_to(np.asarray(variance, float), len(points))
    precision = np.linalg.inv(prior.cov)

    def linearized(e: np.ndarray):
        s, to = prior.moved(e), np.eye(18)
        to[ROT, ROT] = right_jacobian(e[ROT])
        res = ((points @ s.r.T + s.p - planes) * normals).sum(1)
        own = np.zeros((len(points), 18))
        own[:, ROT], own[:, POS] = np.cross(points, normals @ s.r), normals
        z = np.abs(res) / np.sqrt(variance)
        w = np.minimum(1, limits.huber / np.maximum(z, 1e-300)) / variance
        jac = own @ to
        cost = e @ precision @ e / 2 + np.where(z <= limits.huber, z * z / 2, limits.huber * (z - limits.huber / 2)).sum()
        pose = own[:, :6].T @ (own[:, :6] * w[:, None])
        return precision + jac.T @ (jac * w[:, None]), precision @ e + jac.T @ (w * res), cost, float(np.sqrt((res * res).mean())), pose

    def rank(pose: np.ndarray) -> int:
        values = np.linalg.eigvalsh(pose)
        return int((values > max(1e-12, values[-1] * limits.rank_share)).sum())

    e = np.zeros(18)
    h, g, cost, rms, pose = linearized(e)
    out.first_rms = out.last_rms = rms
    out.pose_rank = rank(pose)
    if out.pose_rank < limits.rank:
        out.reason = "degenerate geometry"
        return prior, out
    still = False
    for k in range(limits.rounds):
        out.iterations = k + 1
        x = -np.linalg.solve(h, g)
        if np.linalg.norm(x) < limits.still:
            still = True
            break
        x = x * min(1.0, limits.turn_step / max(np.linalg.norm(x[ROT]), 1e-30), limits.move_step / max(np.linalg.norm(x[POS]), 1e-30))
        for _ in range(20):
            there = e + x
            if np.linalg.norm(there[ROT]) <= limits.most_turn and np.linalg.norm(there[POS]) <= limits.most_move and (found := linearized(there))[2] <= cost:
                break
            x = x / 2
        else:
            out.reason = "no step within bounds"
            return prior, out
        e, (h, g, cost, rms, pose) = there, found
        out.last_rms = rms
    still = still or np.linalg.norm(np.linalg.solve(h, g)) < limits.still
    out.pose_rank = rank(pose)
    if out.pose_rank < limits.rank or not still:
        out.reason = "degenerate geometry" if out.pose_rank < limits.rank else "no standstill"
        return prior, out
    to = np.eye(18)
    to[ROT, ROT] = right_jacobian(e[ROT])
    cov = to @ np.linalg.inv(h) @ to.T
    out.reason, out.accepted = "accepted", True
    return replace(prior.moved(e), cov=(cov + cov.T) / 2), out


class Filter:
    """A recording's state, the samples since, and scans that wait for a sample at or after their end."""

    def __init__(self):
        self.state, self.samples, self.begun = Inertial(), np.zeros((0, 7)), False
        self.waiting: list[np.ndarray] = []  # scans whose end no sample has reached

    def dump(self) -> bytes:
        out, s = io.BytesIO(), self.state
        np.savez(out, r=s.r, v=np.stack([s.p, s.v, s.bg, s.ba, s.g]), cov=s.cov, t=s.t, samples=self.samples, begun=self.begun, waiting=np.concatenate([np.zeros((0, 13)), *self.waiting]), sizes=np.array([len(w) for w in self.waiting], int))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Filter:
        f = cls()
        with np.load(io.BytesIO(raw)) as z:
            f.state, f.samples, f.begun = Inertial(z["r"], *z["v"], z["cov"], float(z["t"])), z["samples"], bool(z["begun"])
            f.waiting = np.split(z["waiting"], np.cumsum(z["sizes"])[:-1]) if len(z["sizes"]) else []
        return f

    def sampled(self, t: np.ndarray, rates: np.ndarray) -> None:
        if not self.begun and len(t):
            self.state, self.begun = replace(self.state, t=float(t[0])), True
        self.samples = np.concatenate([self.samples, np.column_stack([t, rates])])

    def scan(self, t: float, seen: np.ndarray) -> Report:
        """Moves the state to a scan's end at t and corrects it by seen (point, mean, normal, variance).

        Samples that the next scan does not need go. Where samples do not cover the way, the state begins anew there.
        """
        try:
            self.state = through(self.state, self.samples, t)
            ok = np.isfinite(seen).all(1) & (seen[:, 9] > 0)
            seen = seen[ok]
            self.state, report = update(self.state, seen[:, :3], seen[:, 3:6], seen[:, 6:9], seen[:, 9])
        except ValueError as e:
            report = Report(reason=str(e), observations=len(seen))
            self.state = replace(Inertial(), r=self.state.r, p=self.state.p, t=t)
        self.samples = self.samples[max(0, int(np.searchsorted(self.samples[:, 0], t, side="right")) - 1) :]
        return report

    def rows(self, recording: int, v: np.ndarray, last: bool = False) -> Iterator[tuple]:
        """States at the ends of scans: v has t, kind, frame, ax..cz, variance in order of time, samples before scans at the
        same time, and all rows of a scan. A scan is due when a sample reaches its end; with `last` all are."""
        starts = np.flatnonzero(np.concatenate([[True], np.any(v[1:, :3] != v[:-1, :3], axis=1) & ((v[1:, 1] == 1) | (v[:-1, 1] == 1))])) if len(v) else []
        for s, e in zip(starts, [*starts[1:], len(v)][: len(starts)], strict=True):
            if v[s, 1] == 0:
                self.sampled(v[s:e, 0], v[s:e, 3:9])
                yield from self._due(recording, float(v[e - 1, 0]))
            else:
                self.waiting.append(v[s:e])
                yield from self._due(recording, float(self.samples[-1, 0]) if len(self.samples) else -np.inf)
        if last:
            yield from self._due(recording, np.inf)

    def _due(self, recording: int, upto: float) -> Iterator[tuple]:
        while self.waiting and self.waiting[0][0, 0] <= upto:
            part = self.waiting.pop(0)
            report, x = self.scan(float(part[0, 0]), part[:, 3:]), self.state
            yield (recording, int(part[0, 2]), float(part[0, 0]), report.reason, report.accepted, report.observations, report.pose_rank, report.iterations, report.first_rms, report.last_rms, *x.p.tolist(), *rotation_vector(x.r).tolist(), *x.v.tolist(), float(np.sqrt(np.trace(x.cov[POS, POS]))))


_NAMES = [c.split()[0] for c in STATES.split(", ")]
_ORDER = ["recording", "t", "kind", "frame", "sample"]
_NUMBERS = ["t", "kind", "frame", *ROWS[5:]]


class InertialFilter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("filter", "raw binary")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        f = Filter.load(self.held.get()[0]) if self.held.exists() else Filter()
        v = pd.concat(rows).sort_values(_ORDER[1:], kind="stable")[_NUMBERS].to_numpy(float)
        out = list(f.rows(int(key[0]), v))
        self.held.update((f.dump(),))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def _whole(rows: DataFrame) -> DataFrame:
    return rows.select(*ROWS).where("recording IS NOT NULL AND t IS NOT NULL AND kind IS NOT NULL")


def stream(rows: DataFrame) -> DataFrame:
    """STATES of a stream of ROWS; a recording's rows come in order of time, all of a scan in one micro-batch. A scan's row
    comes with the batch whose samples reach its end."""
    return _whole(rows).groupBy("recording").transformWithStateInPandas(InertialFilter(), STATES, "Append", "None")


def table(rows: DataFrame) -> DataFrame:
    """The same of a table: recordings in parallel; a task holds a batch, a scan and the samples since the last one."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in STATES.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, rest = None, Filter(), np.zeros((0, 13))

        def emit(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=_NAMES)

        for batch in batches:
            own = batch.column(0).to_numpy()
            v = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(1, batch.num_columns)], -1)
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
            for s, e in zip(starts, [*starts[1:], len(own)][: len(starts)], strict=True):
                if own[s] != now:
                    if now is not None:
                        yield emit(list(f.rows(now, rest, last=True)))
                    now, f, rest = int(own[s]), Filter(), rest[:0]
                rest = np.concatenate([rest, v[s:e]])
                # What may go on in the next batch waits: the last scan, or the samples at the end.
                cut = len(rest) - int(np.argmax(np.any(rest[::-1, :3] != rest[-1, :3], axis=1))) if rest[-1, 1] == 1 and np.any(rest[:, :3] != rest[-1, :3]) else (0 if rest[-1, 1] == 1 else len(rest))
                yield emit(list(f.rows(now, rest[:cut])))
                rest = rest[cut:]
        if now is not None:
            yield emit(list(f.rows(now, rest, last=True)))

    known = _whole(rows).repartition("recording").sortWithinPartitions(*_ORDER)
    return known.select("recording", *[F.col(c).cast("double") for c in _NUMBERS]).mapInArrow(fold, STATES)
