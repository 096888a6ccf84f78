"""Intervals of what a box looks like in a photo never lose a valid projection, and cull."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraweave.functions import camera as C
from terraweave.functions.geometry import d
from terraweave.operators import visibility as O


def project(p, seat, r, camera):
    a = (p - seat) @ r.T
    rho, dist = np.hypot(a[:, 0], a[:, 1]), np.linalg.norm(a, axis=1)
    theta = np.arctan2(rho, a[:, 2])
    bent = np.zeros(len(p))
    for k in reversed(camera.k):
        bent = (bent + k) * theta
    s = np.where(rho <= 1e-10, 1.0, (bent + 1) * theta / np.where(rho > 0, rho, 1))
    u = camera.a11 * a[:, 0] * s + camera.a12 * a[:, 1] * s + camera.u0
    v = camera.a22 * a[:, 1] * s + camera.v0
    return (dist > 0.1) & (u >= 0) & (u < camera.width - 1) & (v >= 0) & (v < camera.height - 1) & (theta < camera.max_angle)


@pytest.mark.parametrize("camera", [C.Camera(), C.Camera(64, 48, 18, 2, 17, 32, 24, 1.5, (0.01, -0.2, 0.05, 0.1, -0.05, 0.02)), C.Camera(2000, 1500, 600, -5, 610, 1000, 750, 2.6)])
def test_no_box_with_a_valid_point_is_refused(spark, camera):
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    r = q * np.sign(np.linalg.det(q))
    seat = np.array([0.3, -0.2, 0.1])
    size = rng.choice([0.05, 0.5, 2.0], 3000)
    low = rng.normal(0, 4, (3000, 3))
    low[:200] = seat - size[:200, None] * rng.uniform(0, 1, (200, 3))  # the photo is in the box
    low[200:400] = seat + r.T[:, 2] * rng.uniform(0, 8, (200, 1)) - size[200:400, None] / 2  # the axis goes through it
    valid = np.zeros(3000, bool)
    for corner in [*np.ndindex(2, 2, 2), *[None] * 60]:
        at = np.array(corner, float) if corner is not None else rng.uniform(0, 1, (3000, 3))
        valid |= project(low + size[:, None] * at, seat, r, camera)
    boxes = spark.createDataFrame(pd.DataFrame({"k": range(3000), "x": low[:, 0], "y": low[:, 1], "z": low[:, 2], "size": size}))
    boxes = boxes.withColumns({c: d(float(v)) for c, v in zip(("px", "py", "pz"), seat, strict=True)})
    turned = [[d(float(v)) for v in row] for row in r]
    xyz = [F.col(c) for c in "xyz"]
    seen = C.with_box_view(boxes, xyz, [c + F.col("size") for c in xyz], camera, turned).orderBy("k").toPandas().may_see.to_numpy()
    assert not (valid & ~seen).any()
    assert valid.any() and (~seen).mean() > 0.3 * (~valid).mean()  # and boxes are refused


def test_boxes_without_finite_bounds_stay(spark):
    boxes = spark.createDataFrame([(0, float("nan")), (1, float("inf")), (2, -1e9)], "k long, x double").withColumns({c: d(0) for c in ("px", "py", "pz")})
    seen = C.with_box_view(boxes, [F.col("x"), d(0), d(-5)], [F.col("x") + 1, d(1), d(-4)], C.Camera()).orderBy("k").collect()
    assert [s.may_see for s in seen] == [True, True, False]


def test_culled_projection_is_the_full_product_with_fewer_pairs(spark):
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame(pd.DataFrame(rng.uniform(-20, 20, (4000, 3)), columns=list("xyz"))).withColumn("point_id", F.monotonically_increasing_id())
    pts = pts.unionByName(spark.createDataFrame([(float("nan"), 0.0, 0.0, -1)], "x double, y double, z double, point_id long"))
    photos = spark.createDataFrame([(k, *map(float, rng.uniform(-20, 20, 3))) for k in range(12)], "photo long, px double, py double, pz double")
    camera = C.Camera(max_angle=0.9)
    full = C.with_projection(pts.where("point_id >= 0").crossJoin(photos), camera)
    full = full.where(C.valid_projection(*[F.col(c) for c in ("u", "v", "theta", "dist")], camera))
    want = {(r.point_id, r.photo, r.u, r.v) for r in full.collect()}
    got = O.projected(pts, photos, camera, 1.0)
    assert {(r.point_id, r.photo, r.u, r.v) for r in got.collect()} == want and len(want) > 100
    cells = O.P.with_cells(pts.where("point_id >= 0"), 1.0)
    pairs = cells.join(O.visible_cells(cells.select(*O.P.CELL).distinct(), photos, 1.0, camera), O.P.CELL).count()
    assert len(want) <= pairs < 0.4 * 4000 * 12
