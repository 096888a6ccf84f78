"""Maps that grow with scans, and neighbours by cells, against plain loops."""

import numpy as np
import pandas as pd
import pytest

from terraweave.operators.neighbours import CellIndex
from terraweave.streaming import plane_map as M


@pytest.mark.parametrize(("seed", "n", "spread"), [(0, 4000, 6.0), (1, 400, 3.0), (2, 3, 1.0)])
def test_nearest_points_are_those_of_a_full_search(seed, n, spread):
    rng = np.random.default_rng(seed)
    known, asked = rng.normal(0, spread, (n, 3)), rng.normal(0, spread * 1.2, (700, 3))
    known[: n // 10] = known[n // 10 : n // 10 * 2][: n // 10]  # repeated points
    at, far = CellIndex(known, 0.5).nearest(asked, 5, 1.8)
    d = np.sqrt(((asked[:, None] - known[None]) ** 2).sum(-1))
    best = np.sort(d, 1)[:, :5] if n >= 5 else np.full((700, 5), np.inf)
    whole = best[:, -1] <= 1.8
    assert (at[~whole] == -1).all() and (whole.any() or n < 5)
    assert np.allclose(far[whole], best[whole]) and np.allclose(np.take_along_axis(d[whole], at[whole], 1), best[whole])


def test_cells_far_from_the_origin_and_an_empty_map():
    far = np.array([[4e6, -4e6, 10.0], [4e6 + 0.1, -4e6, 10.0]])
    at, _ = CellIndex(far, 0.5).nearest(far, 1, 1.0)
    assert at[:, 0].tolist() == [0, 1]
    assert (CellIndex(np.zeros((0, 3)), 0.5).nearest(far - far[0], 1, 1.0)[0] == -1).all()


class Plain:
    """A point at a time."""

    def __init__(self, grid, most):
        self.grid, self.most, self.cells = grid, most, {}

    def take(self, points, sensor, frame):
        count = [0] * 5
        for p in points:
            k, best, near = tuple(int(v) for v in np.floor(p / self.grid)), None, np.inf
            for step in np.ndindex(3, 3, 3):
                c = self.cells.get(tuple(a + b - 1 for a, b in zip(k, step, strict=True)))
                if c and c["plane"]:
                    d2 = ((p - c["mean"]) ** 2).sum()
                    if d2 <= (1.5 * self.grid) ** 2 and d2 < near:
                        near, best = d2, c
            if best is None:
                count[1] += 1
                continue
            sight = sensor - p
            cosine = best["normal"] @ sight / np.linalg.norm(sight)
            count[2 if cosine <= 0 else 3 if cosine < np.cos(np.radians(75)) else 4 if abs(best["normal"] @ (p - best["mean"])) > 0.15 else 0] += 1
        for p in points:
            c = self.cells.setdefault(tuple(int(v) for v in np.floor(p / self.grid)), {"points": [], "seen": [], "frames": set()})
            c["points"].append(p)
            c["seen"].append(sensor)
            c["frames"].add(frame)
        for k, c in list(self.cells.items()):
            x = np.array(c["points"])
            c["mean"], c["plane"] = x.mean(0), False
            if len(x) >= 12 and len(c["frames"]) >= 2:
                e, v = np.linalg.eigh(np.cov(x.T, bias=True))
                if e[1] >= 0.0004 and e[0] <= 0.0004 and e[0] <= 0.1 * e[1]:
                    n = v[:, 0]
                    c["plane"], c["normal"] = True, n if n @ (np.mean(c["seen"], 0) - c["mean"]) >= 0 else -n
            if ((c["mean"] - sensor) ** 2).sum() > self.most**2:
                del self.cells[k]
        return (frame, len(points), *count, len(self.cells), sum(c["plane"] for c in self.cells.values()))


def corridor(rng, frames, step):
    """Scans of a floor and a wall by a sensor that moves along x."""
    for f in range(frames):
        x = f * step
        floor = np.stack([rng.uniform(x - 2, x + 2, 400), rng.uniform(-1, 1, 400), rng.normal(-1, 0.005, 400)], -1)
        wall = np.stack([rng.uniform(x - 2, x + 2, 300), rng.normal(1.02, 0.005, 300), rng.uniform(-1, 1, 300)], -1)
        stray = rng.uniform(-2, 2, (30, 3)) + [x, 0, 0]
        yield f, np.concatenate([floor, wall, stray]), np.array([x, 0.0, 0.0])


def test_planes_as_a_plain_loop_finds_them_and_a_bounded_map():
    m, plain, sizes = M.PlaneMap(0.4, 4.0), Plain(0.4, 4.0), []
    for f, points, sensor in corridor(np.random.default_rng(3), 14, 1.0):
        row, _, _ = m.take(points, np.broadcast_to(sensor, points.shape), f)
        assert row == plain.take(points, sensor, f)
        sizes.append(row[-2])
    assert row[2] > 100 and row[-1] > 20  # planes are found
    assert max(sizes[5:]) < 1.5 * sizes[4]  # what lies behind is given up
    assert sorted(m.cells) == sorted(plain.cells)


def test_a_point_that_is_not_finite_drops_out_and_an_empty_scan_does_no_harm():
    m = M.PlaneMap()
    row, _, _ = m.take(np.array([[np.nan, 0, 0], [1.0, 1, 1]]), np.zeros((2, 3)), 0)
    assert row[1] == 1 and m.take(np.zeros((0, 3)), np.zeros((0, 3)), 1)[0][1] == 0


def test_stream_and_table_have_the_same_planes(spark, tmp_path):
    rows = [(r, f, k, *map(float, p), *map(float, s)) for r in (1, 2) for f, points, s in corridor(np.random.default_rng(r), 5, 12.0 if r == 2 else 0.5) for k, p in enumerate(points)]
    frame = pd.DataFrame(rows, columns=M.SCANS)
    src = tmp_path / "in"
    src.mkdir()
    whole = spark.createDataFrame(frame)
    for part, keep in enumerate([frame.frame < 2, frame.frame.between(2, 3), frame.frame > 3]):
        frame[keep].to_parquet(src / f"{part}.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    read = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src))
    q = M.stream(read).writeStream.format("memory").queryName("planes").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(180)
    want = sorted(map(tuple, M.table(whole).collect()))
    assert sorted(map(tuple, spark.table("planes").collect())) == want and len(want) == 10
    held = M.planes(whole).toPandas()
    assert held.plane.any() and held[held.plane].variance.between(0.0009, 0.0014).all()
    assert set(held[held.recording == 2].cx * 0.4 > 9) == {True}  # far cells of the second recording are gone
