"""Nearest points by hashed cells, within a task: for maps and blocks whose size is bounded."""

from __future__ import annotations

import numpy as np

#: Cells are numbered by 21 bits an axis around the first point.
_HALF, _BITS = 1 << 20, 21


class CellIndex:
    """Points in the order of their cells; a probe reads runs of cells that are neighbours along z."""

    def __init__(self, points: np.ndarray, size: float):
        self.size = size
        self.origin = np.floor(points[0] / size) if len(points) else np.zeros(3)
        key = self._key(self._cells(points)) if len(points) else np.zeros(0, np.int64)
        self.order = np.argsort(key, kind="stable")
        self.points, self.keys = points[self.order], key[self.order]

    def _cells(self, p: np.ndarray) -> np.ndarray:
        cell = np.floor(p / self.size) - self.origin
        if len(cell) and not (np.abs(cell) < _HALF - 64).all():
            raise ValueError("points lie too far apart for cells of this size")
        return cell.astype(np.int64) + _HALF

    @staticmethod
    def _key(cell: np.ndarray) -> np.ndarray:
        return (cell[..., 0] << 2 * _BITS) | (cell[..., 1] << _BITS) | cell[..., 2]

    def within(self, p: np.ndarray, rings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, squared distance) of all points in the cells up to `rings` around each query's."""
        cell = self._cells(p)
        step = np.arange(-rings, rings + 1)
        across = np.stack(np.meshgrid(step, step, indexing="ij"), -1).reshape(-1, 2)
        base = cell[:, None, :2] + across[None]
        low = self._key(np.concatenate([base, np.broadcast_to(cell[:, None, 2:] - rings, (*base.shape[:2], 1))], -1))
        begin, end = np.searchsorted(self.keys, low.ravel()), np.searchsorted(self.keys, low.ravel() + 2 * rings, side="right")
        n = end - begin
        query = np.repeat(np.repeat(np.arange(len(p)), len(across)), n)
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        off = p[query] - self.points[at]
        return query, at, np.einsum("ij,ij->i", off, off)

    def nearest(self, p: np.ndarray, k: int, reach: float, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the k nearest points of each query, nearest first, and their distances; all k within reach, else
        index -1 and an infinite distance. Ties go to the point of the smaller cell, then to the earlier one.

        Cells are probed ring by ring: what lies nearer than the rings are wide is complete, so a query is done as soon as
        its k-th point is, and no query is compared with the whole map.
        """
        found, far = np.full((len(p), k), -1), np.full((len(p), k), np.inf)
        for start in range(0, len(p), chunk):
            left, rings = np.arange(start, min(start + chunk, len(p))), 1
            while len(left):
                width = rings * self.size
                query, at, d2 = self.within(p[left], rings)
                order = np.lexsort((at, d2, query))
                query, at, d2 = query[order], at[order], d2[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                best = place < k
                number = np.bincount(query[best], minlength=len(left))
                kth = np.full(len(left), np.inf)
                kth[query[place == k - 1]] = np.sqrt(d2[place == k - 1])
                done = (number == k) & (kth <= min(width, reach))
                keep = best & done[query]
                found[left[query[keep]], place[keep]], far[left[query[keep]], place[keep]] = self.order[at[keep]], np.sqrt(d2[keep])
                left = left[~done] if width < reach else left[:0]
                rings = min(2 * rings, int(np.ceil(reach / self.size))) if width < reach else rings
        return found, far


class Followed:
    """The nearest points of queries that are asked again after small moves: what CellIndex.nearest gives, from some candidates
    of each query for as long as no other point can be nearer."""

    def __init__(self, index: CellIndex, k: int, reach: float, most: int = 32):
        self.index, self.k, self.reach, self.most = index, k, reach, most
        self.points = np.concatenate([index.points, np.full((1, 3), np.inf)])
        self.order = np.append(index.order, -1)
        self.asked, self.near, self.bound = np.zeros((0, 3)), np.zeros((0, most), int), np.zeros(0)

    def _searched(self, which: np.ndarray, p: np.ndarray, chunk: int = 128) -> None:
        """Candidates of some queries, as places in the index in growing order, and the distance beyond which all others are."""
        self.asked[which], self.bound[which] = p, 0.0
        for start in range(0, len(p), chunk):
            left, rings, last = np.arange(start, min(start + chunk, len(p))), 1, int(np.ceil(self.reach / self.index.size))
            while len(left):
                query, at, d2 = self.index.within(p[left], rings)
                number = np.bincount(query, minlength=len(left))
                begin = np.cumsum(number) - number
                far = np.full((len(left), max(number.max(), self.most + 1)), np.inf)
                far[query, np.arange(len(query)) - begin[query]] = d2
                best = np.argpartition(far, self.most, axis=1)[:, : self.most + 1]
                d = np.take_along_axis(far, best, 1)
                bound = np.minimum(np.sqrt(d[:, -1]), rings * self.index.size)
                done = np.sqrt(np.partition(d[:, :-1], self.k - 1, axis=1)[:, self.k - 1]) < bound
                place = np.append(at, 0)[np.minimum(begin[:, None] + best[:, :-1], len(at))]
                place[best[:, :-1] >= number[:, None]] = len(self.index.points)
                self.near[which[left[done]]], self.bound[which[left[done]]] = np.sort(place[done], 1), bound[done]
                left, rings = left[~done] if rings < last else left[:0], min(2 * rings, last)

    def _looked_up(self, p: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and distances of the nearest candidates, nearest first, and whether these are the nearest points."""
        near = self.near[which]
        off = p[which, None] - self.points[near]
        d2 = np.einsum("nkj,nkj->nk", off, off)
        best = np.argsort(d2, axis=1, kind="stable")[:, : self.k]
        far = np.sqrt(np.take_along_axis(d2, best, 1))
        away = p[which] - self.asked[which]
        sure = far[:, -1] + np.sqrt((away * away).sum(1)) < self.bound[which] * (1 - 1e-12)
        return np.take_along_axis(near, best, 1), far, sure & (far[:, -1] <= self.reach)

    def nearest(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As CellIndex.nearest; each call has the same queries, moved."""
        if len(self.asked) != len(p):
            self.asked, self.near, self.bound = p.copy(), np.full((len(p), self.most), len(self.index.points)), np.zeros(len(p))
        at, far, sure = self._looked_up(p, np.arange(len(p)))
        if len(again := np.flatnonzero(~sure)):
            self._searched(again, p[again])
            at[again], far[again], sure[again] = self._looked_up(p, again)
        found = self.order[at]
        if len(rest := np.flatnonzero(~sure)):  # too few within reach, or equal distances where candidates end
            found[rest], far[rest] = self.index.nearest(p[rest], self.k, self.reach)
        return found, far
