"""What the open findings of the third round say, held small."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraweave.functions import geometry as G
from terraweave.operators import points as P
from terraweave.plans import catalog, regions


def test_points_alike_on_either_side_of_a_centre_are_equally_far(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(1 << 60)), (2 * cx + 1) / 10.0, ((2 * cy + 1) * 200_000 + off) / 100 / 20000.0, 0.2) for cx in range(8) for cy in range(26) for off in (-12345, 12345)]
    pts = pd.DataFrame(rows, columns=["point_id", "x", "y", "z"])
    con = duckdb.connect()
    con.register("made", pts)
    want = con.execute("WITH pts AS (SELECT * FROM made), c AS " + catalog.ORACLE["a09_nearest_to_centre"].split(", c AS ", 1)[1]).df()
    got = P.nearest_to_centre(spark.createDataFrame(pts), 0.2).toPandas()
    assert len(got) == len(want) == 208 and set(got.point_id) == set(want.point_id)


@pytest.mark.parametrize("reach", [0, 0.3])
def test_points_on_the_edge_of_an_outline_fall_as_in_sql(spark, reach):
    """Tenths along x, cents along y, around all places at a distance of 0 or 0.3 of an edge or a corner."""
    found = set()
    for q in range(1, 51):
        x = q / 10
        for a, b in regions._E:
            at = [v[1] + s * max(0, reach * reach - (x - v[0]) ** 2) ** 0.5 for v in (a, b) for s in (-1, 1)]
            step = reach * np.hypot(b[0] - a[0], b[1] - a[1]) / abs(b[0] - a[0])
            at += [a[1] + (x - a[0]) / (b[0] - a[0]) * (b[1] - a[1]) + s * step for s in (-1, 1)]
            found |= {(q, round(y * 2e6) + k) for y in at for k in (-1, 0, 1)}
    pts = pd.DataFrame([(i, q / 10.0, c / 100 / 20000.0) for i, (q, c) in enumerate(sorted(found))], columns=["point_id", "x", "y"])
    con = duckdb.connect()
    con.register("pts", pts)
    want = con.execute(f"SELECT point_id, {regions.INSIDE_SQL} AS inside, {regions.DIST_SQL} <= 0.3 AS near FROM pts ORDER BY 1").df()
    x, y = F.col("x"), F.col("y")
    got = spark.createDataFrame(pts).select("point_id", G.inside_outline(x, y, regions.OUTLINE).alias("inside"), (G.distance_to_outline(x, y, regions.OUTLINE) <= 0.3).alias("near")).orderBy("point_id").toPandas()
    assert (got.inside == want.inside).all() and (got.near == want.near).all() and want.near.sum() > 20


def test_a_worker_loads_a_tokenizer_once():
    import public_tokenizers

    from terraweave.llm.token_files import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    made = [Encoder(path, 0) for _ in range(3)]
    assert len({id(e.tokenizer) for e in made}) == 1 and made[0].tails is not made[1].tails
    text = "a word, another <|endoftext|> one\n and the last"
    own = Encoder(path, 0, special_as_text=True)
    assert own.tokenizer is not made[0].tokenizer and own.tokenizer.encode_special_tokens and not made[0].tokenizer.encode_special_tokens
    assert made[2].encode([text])[0].tolist() == [*made[0].tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_rays_of_a_batch_cross_the_cells_that_each_crosses(spark):
    rng = np.random.default_rng(5)
    o, p = rng.uniform(-2, 2, (300, 3)), rng.uniform(-4, 4, (300, 3)).round(1)
    p[0], p[1] = o[0], [o[1][0], o[1][1], 3.0]  # no length; along an axis
    away = np.linalg.norm(p - o, axis=1)
    ray, cell = P.crossed(o, p, away, 0.5, 0.1, 30.0, 0.06)
    for k in range(300):
        u, end = (p[k] - o[k]) / max(away[k], 1e-9), away[k] - 0.06
        at = np.arange(0.1, end, 1e-3) if end > 0.1 else np.zeros(0)
        mine = {tuple(c) for c in cell[ray == k].tolist()}
        assert {tuple(c) for c in np.floor((o[k] + at[:, None] * u) / 0.5).astype(int).tolist()} <= mine and len(mine) <= len(at) and len(mine) == (ray == k).sum()
    found = spark.createDataFrame(pd.DataFrame(np.concatenate([o, p, away[:, None]], 1), columns=P._ENDS))
    assert P.ray_cells(found, 0.5).count() == len(ray) == P.crossings(found, 0.5).agg(F.sum("n")).first()[0]
    text = P.ray_evidence(found, 0.5)._jdf.queryExecution().executedPlan().toString().lower()
    assert "array_sort" not in text and "transform(" not in text


def test_depth_buffers_and_views_of_batches_are_those_of_all_pairs(spark, sf, monkeypatch):
    from terraweave.operators import visibility as O
    from terraweave.plans import photos
    from terraweave.plans import views as V

    monkeypatch.setattr(O, "MOST_PAIRS", 300)
    pts = V.points(spark, sf)
    pts = pts.union(pts.withColumn("point_id", F.col("point_id") - 7))  # ties in depth
    met = O.sighted(pts, V.photos(spark, sf), photos.CAMERA)
    rows = lambda df: sorted(map(tuple, df.collect()))
    pairs = O.sighted_pairs(*met, photos.CAMERA)
    want = rows(O.depth_buffer(pairs).select(*O.PIXEL, "step", "point_id"))
    buffer = O.kept(O.sighted_depths(*met, photos.CAMERA), "test-buffer")
    assert rows(buffer.select(*O.PIXEL, "step", "point_id")) == want and len(want) > 1000
    found = [rows(O.visibility(p, pts, buffer).where("visible").select("photo", "point_id", "dist", "incidence")) for p in (pairs, O.unhidden_pairs(*met, photos.CAMERA))]
    assert found[0] == found[1] and found[0]
