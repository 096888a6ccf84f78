"""Folds in order of time as scans of two levels, for folds whose steps can be joined.

Rows are dealt by group and time bucket. Each bucket is summed up by one element; the elements of a group, a row for each
bucket, are joined in order; and each bucket is folded again from what was joined before it. So a long series is as many
tasks as it has buckets, a task holds a batch of rows, and the result is that of one loop over the series, but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fold(Protocol):
    #: Columns of numbers that are folded, and those that come out.
    takes: Sequence[str]
    gives: Sequence[str]

    def element(self, t: np.ndarray, v: np.ndarray) -> np.ndarray:
        """What a run of rows does, as numbers; t in seconds, v a row of `takes` each."""

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The element of a run of which a and b are the parts; associative."""

    def run(self, before: np.ndarray | None, t: np.ndarray, v: np.ndarray) -> np.ndarray:
        """`gives` of each row of a run, after what `before` is the element of."""


class Ema:
    """y = new * x + (1 - new) * y before; the first y is the first x. An element is (first x, a, b): last y = a * first y + b."""

    gives = ("ema",)

    def __init__(self, value: str, new: float):
        self.takes, self.new = (value,), new

    def element(self, t, v):
        x = v[:, 0]
        rest = list(accumulate(x[1:].tolist(), lambda y, s: self.new * s + (1 - self.new) * y, initial=0.0))
        return np.array([x[0], (1 - self.new) ** (len(x) - 1), rest[-1]])

    def join(self, a, b):
        old = 1 - self.new
        return np.array([a[0], b[1] * old * a[1], b[1] * (self.new * b[0] + old * a[2]) + b[2]])

    def run(self, before, t, v):
        x = v[:, 0].tolist()
        if before is not None:
            x[0] = self.new * x[0] + (1 - self.new) * (before[1] * before[0] + before[2])
        return np.array(list(accumulate(x, lambda y, s: self.new * s + (1 - self.new) * y)))[:, None]


def turned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of unit quaternions (x, y, z, w), row by row, again of length 1."""
    (ax, ay, az, aw), (bx, by, bz, bw) = np.moveaxis(a, -1, 0), np.moveaxis(b, -1, 0)
    q = np.stack([aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz], -1)
    return q / np.linalg.norm(q, axis=-1, keepdims=True)


class Attitude:
    """Product of turns by the mean of two neighbours' rates; a gap above max_gap begins anew at no turn.

    An element is the first row (t, rates), the last row, the product since the last new beginning, and whether there was one.
    """

    gives = ("qx", "qy", "qz", "qw")
    NONE = np.array([0.0, 0.0, 0.0, 1.0])

    def __init__(self, rates: Sequence[str], max_gap: float):
        self.takes, self.max_gap = tuple(rates), max_gap

    def _steps(self, t, v):
        """Turns to each row from the one before, and where a new beginning is."""
        dt = np.diff(t)
        w = (v[1:] + v[:-1]) / 2 * dt[:, None]
        angle = np.linalg.norm(w, axis=1)
        half = np.where(angle > 1e-12, np.sin(angle / 2) / np.where(angle > 1e-12, angle, 1), 0.5)
        new = dt > self.max_gap
        q = np.concatenate([w * half[:, None], np.cos(angle / 2)[:, None]], 1)
        q[new] = self.NONE
        return q, new

    @staticmethod
    def _products(q, new):
        """Running products from each new beginning, by doubling; and whether there has been one so far."""
        q, new, d = q.copy(), new.copy(), 1
        while d < len(q):
            joined = turned(q[:-d], q[d:])
            q[d:] = np.where(new[d:, None], q[d:], joined)
            new[d:] |= new[:-d]
            d *= 2
        return q, new

    def element(self, t, v):
        q, new = self._products(*self._steps(t, v)) if len(t) > 1 else (self.NONE[None], np.zeros(1, bool))
        return np.concatenate([t[:1], v[0], t[-1:], v[-1], q[-1], [new[-1]]])

    def join(self, a, b):
        (bridge,), (gap,) = self._steps(np.array([a[4], b[0]]), np.stack([a[5:8], b[1:4]]))
        new = bool(b[12] or gap)
        q = b[8:12] if new else turned(turned(a[8:12], bridge), b[8:12])
        return np.concatenate([a[:4], b[4:8], q, [new or a[12]]])

    def run(self, before, t, v):
        if before is None:
            q, _ = self._products(np.concatenate([self.NONE[None], (s := self._steps(t, v))[0]]), np.concatenate([[False], s[1]]))
            return q
        q, new = self._steps(np.concatenate([before[4:5], t]), np.concatenate([before[5:8][None], v]))
        q[0] = q[0] if new[0] else turned(before[8:12], q[0])
        return self._products(q, new)[0]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """(group, bucket) and the rows of it that stand together, in pieces; the first two columns are the key."""
    for batch in batches:
        if batch.num_rows:
            g, b = (batch.column(k).to_numpy() for k in (0, 1))
            starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (b[1:] != b[:-1])]))
            for s, e in zip(starts, [*starts[1:], len(g)], strict=True):
                yield (int(g[s]), int(b[s])), batch.slice(s, e - s)


def folded(df: DataFrame, group: str, fold: Fold, ties: Sequence[str] = (), bucket: float = 86400.0) -> DataFrame:
    """(group, t_us, ties..., gives...) of each row of df(group, t_us, ties..., takes...), folded in order of t_us and ties.

    Columns of ties are whole numbers. Rows with a null in any of these columns drop out; rows equal in time and ties are
    taken in the order of their values. bucket: seconds of a series that are one task's.
    """
    names = [group, "t_us", *ties, *fold.takes]
    key = [F.col(group).cast("long").alias("_g"), F.floor(F.col("t_us") / int(bucket * 1e6)).cast("long").alias("_b")]
    whole = [F.col(c).cast("long").alias(f"_o{k}") for k, c in enumerate(["t_us", *ties])]
    base = df.select(*names).dropna().select(*key, *whole, *[F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(fold.takes)])
    at, values = [f"_o{k}" for k in range(1 + len(ties))], [f"_v{k}" for k in range(len(fold.takes))]

    def arrays(rows: pa.RecordBatch, skip: int) -> tuple[np.ndarray, np.ndarray]:
        first = skip + len(at)
        return rows.column(skip).to_numpy() / 1e6, np.stack([rows.column(first + k).to_numpy(zero_copy_only=False) for k in range(len(values))], -1)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        g, b, e = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.record_batch({"_g": pa.array(g, pa.int64()), "_b": pa.array(b, pa.int64()), "_e": pa.array([None if x is None else x.tolist() for x in e], pa.list_(pa.float64()))})

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, None
        for own, rows in _runs(batches):
            one = fold.element(*arrays(rows, 2))
            if own != now and now is not None:
                yield packed([(*now, done)])
            done, now = (fold.join(done, one) if own == now else one), own
        if now is not None:
            yield packed([(*now, done)])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, None
        for batch in batches:
            out = []
            for g, b, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                done = done if g == last else None
                out.append((g, b, done))
                last, done = g, (np.array(e) if done is None else fold.join(done, np.array(e)))
            yield packed(out)

    gives = [f"_r{k}" for k in range(len(fold.gives))]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, None
        for own, rows in _runs(batches):
            if own != now:  # the row of what was before comes first
                now, done = own, rows.column(3)[0].as_py()
                done, rows = None if done is None else np.array(done), rows.slice(1)
            if rows.num_rows:
                t, v = arrays(rows, 4)
                out = fold.run(done, t, v)
                one = fold.element(t, v)
                done = one if done is None else fold.join(done, one)
                cols = [rows.column(0), *[rows.column(4 + k) for k in range(len(at))], *[pa.array(np.ascontiguousarray(out[:, k])) for k in range(len(gives))]]
                yield pa.RecordBatch.from_arrays(cols, names=["_g", *at, *gives])

    dealt = base.repartition("_g", "_b").sortWithinPartitions("_g", "_b", *at, *values)
    elements = dealt.mapInArrow(sum_up, "_g long, _b long, _e array<double>")
    before = elements.repartition("_g").sortWithinPartitions("_g", "_b").mapInArrow(carry, "_g long, _b long, _e array<double>")
    marked = before.select("_g", "_b", F.lit(0).alias("_k"), "_e").unionByName(base.withColumn("_k", F.lit(1)), allowMissingColumns=True).select("_g", "_b", "_k", "_e", *at, *values)
    out = marked.repartition("_g", "_b").sortWithinPartitions("_g", "_b", "_k", *at, *values).mapInArrow(replay, ", ".join(["_g long", *[f"{c} long" for c in at], *[f"{c} double" for c in gives]]))
    return out.select(*[F.col(a).alias(b) for a, b in zip(["_g", *at, *gives], [group, "t_us", *ties, *fold.gives], strict=True)])
