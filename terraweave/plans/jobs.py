"""Queries on jobs, text and files, and checks of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.functions.geometry import d
from terraweave.operators import jobs as J
from terraweave.plans import views as V
from terraweave.plans.registry import Family, rounded
from terraweave.session import in_parts, table

_f = Family()
QUERIES, ORACLE = _f.queries, _f.oracle


_NEEDS = ", ".join(f"('{name}', '{b}')" for name, _, before in J.STAGES for b in before)
_NAMES = ", ".join(f"({k}, '{name}', '{lane}')" for k, (name, lane, _) in enumerate(J.STAGES))


@_f.query("j30_o02_ready_stages", f"""WITH s(k, stage, lane) AS (VALUES {_NAMES}), needs(stage, before) AS (VALUES {_NEEDS}),
done AS (SELECT DISTINCT l_orderkey AS run, stage FROM lineitem JOIN s ON k = l_linenumber - 1 WHERE l_linestatus = 'F'),
open AS (SELECT o_orderkey AS run, s.* FROM orders, s WHERE NOT EXISTS (SELECT 1 FROM done WHERE run = o_orderkey AND done.stage = s.stage)),
unmet AS (SELECT DISTINCT o.run, o.stage FROM open o JOIN needs USING (stage) WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.run = o.run AND done.stage = needs.before)),
first AS (SELECT o.run, o.lane, min({{k: k, s: o.stage}}) AS f FROM open o WHERE NOT EXISTS (SELECT 1 FROM unmet u WHERE u.run = o.run AND u.stage = o.stage) GROUP BY o.run, o.lane)
SELECT run, lane, f.s AS stage FROM first""")
def j30(spark, sf):
    """For each order as a run, whose shipped items are stages that are done: the first stage of each lane that can run."""
    s = spark.createDataFrame([(k, n, lane, list(before)) for k, (n, lane, before) in enumerate(J.STAGES)], "k long, stage string, lane string, before array<string>")
    done = table(spark, sf, "lineitem").where("l_linestatus = 'F'").join(s, F.col("k") == F.col("l_linenumber") - 1).groupBy(F.col("l_orderkey").alias("run")).agg(F.collect_set("stage").alias("done"))
    return J.ready_lanes(table(spark, sf, "orders").select(F.col("o_orderkey").alias("run")).join(done, "run", "left"), s)


@_f.query("j30_j31_ready_orders", "WITH needs AS (SELECT o_orderkey AS name, o_orderkey - 1 AS before FROM orders WHERE o_orderkey % 3 <> 0), done AS (SELECT o_orderkey AS name FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey AS name FROM orders WHERE o_orderkey NOT IN (SELECT name FROM done) AND NOT EXISTS (SELECT 1 FROM needs WHERE needs.name = o_orderkey AND before NOT IN (SELECT name FROM done))")
def j30b(spark, sf):
    o = table(spark, sf, "orders")
    needs = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("name"), (F.col("o_orderkey") - 1).alias("before"))
    return J.ready_table(o.select(F.col("o_orderkey").alias("name")), needs, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("name")))


@_f.query("j29_runs_and_receipts", "SELECT o_orderkey, count(l_linenumber) AS receipts, round(coalesce(sum(l_quantity), 0), 2) + 0.0 AS wall FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def j29(spark, sf):
    receipts = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("receipts"), F.sum("l_quantity").alias("wall"))
    return table(spark, sf, "orders").select("o_orderkey").join(receipts, "o_orderkey", "left").select("o_orderkey", F.coalesce("receipts", F.lit(0)).cast("long").alias("receipts"), rounded(F.coalesce("wall", d(0)), 2).alias("wall"))


@_f.query("j05_j33_s33_lookup_and_leftovers", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j31(spark, sf):
    used = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.left_over(table(spark, sf, "customer").select("c_custkey"), used, ["c_custkey"])


@_f.query("u06_j32_changed_keys", "WITH a AS (SELECT p_partkey AS key, p_brand AS value FROM part WHERE p_size < 40), b AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE p_brand END AS value FROM part WHERE p_size > 10) SELECT key, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value")
def u06(spark, sf):
    p = table(spark, sf, "part")
    before = p.where("p_size < 40").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value"))
    after = p.where("p_size > 10").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(F.col("p_brand")).alias("value"))
    return J.changed_keys(before, after)


_RUNS = "rows AS (SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, l_partkey % 3 <> 0 AS hidden, CASE l_suppkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'waiting' ELSE 'done' END AS status, l_quantity AS wall FROM lineitem)"


@_f.query("a44_folded_stages", f"WITH {_RUNS}, h AS (SELECT *, coalesce(max(CASE WHEN NOT hidden THEN place END) OVER (PARTITION BY run ORDER BY place), 0) AS host FROM rows) SELECT run, host, arg_min(status, CASE status WHEN 'failed' THEN 0 WHEN 'running' THEN 1 WHEN 'waiting' THEN 2 ELSE 3 END) AS status, sum(wall) AS wall, count(*) AS rows FROM h GROUP BY run, host")
def a44(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("run").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    k = F.col("l_suppkey") % 4
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = in_parts(items, "run").select("run", F.row_number().over(order).cast("long").alias("place"), (F.col("l_partkey") % 3 != 0).alias("hidden"), F.when(k == 0, "failed").when(k == 1, "running").when(k == 2, "waiting").otherwise("done").alias("status"), F.col("l_quantity").alias("wall"))
    return J.folded_stages(rows)


@_f.query("a41_w10_predicted_time", "WITH " + V.SAMPLES + ", r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t_us DESC) AS k FROM imu) SELECT event_type, round(quantile_cont(rate / 10, 0.5), 5) + 0.0 AS ratio, count(*) AS runs FROM r WHERE k <= 12 GROUP BY event_type")
def a41(spark, sf):
    return J.predicted(V.samples(spark, sf), "event_type", "t_us", F.col("rate") / 10).withColumn("ratio", rounded(F.col("ratio")))


@_f.query("s05_a38_a45_inventory", "SELECT event_type AS topic, count(*) AS messages, max(value) AS peak, round(sum(value), 2) + 0.0 AS size FROM events GROUP BY event_type")
def s05(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("topic")).agg(F.count("*").alias("messages"), F.max("value").alias("peak"), rounded(F.sum("value"), 2).alias("size"))


@_f.query("s01_p01_topic_pushdown", "SELECT count(*) AS n, min(event_id) AS first FROM events WHERE event_type IN ('view', 'purchase')")
def s01(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("view", "purchase")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@_f.query("m36_identity", "SELECT s_suppkey, sha256(s_name) AS sha256, md5(s_name || '|' || s_nationkey) AS identity FROM supplier")
def m36(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.sha2("s_name", 256).alias("sha256"), F.md5(F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string"))).alias("identity"))


@_f.query("m36_fnv1a", "SELECT s_suppkey, lower(lpad(to_hex(list_reduce([2166136261::BIGINT] || list_transform(string_split(s_name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0')) AS fnv FROM supplier")
def m36b(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.lpad(F.lower(F.hex(J.fnv1a(F.col("s_name")))), 8, "0").alias("fnv"))


@_f.query("m37_text", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def m37(spark, sf):
    return table(spark, sf, "part").select("p_partkey", J.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@_f.query("m38_t06_log_progress", "SELECT event_id, CAST(regexp_extract(line, '(\\d+) */ *(\\d+) *([a-z]*)', 1) AS BIGINT) AS done, CAST(regexp_extract(line, '(\\d+) */ *(\\d+) *([a-z]*)', 2) AS BIGINT) AS total FROM (SELECT event_id, event_type || ': ' || (event_id % 50) || '/50 blocks' AS line FROM events)")
def m38(spark, sf):
    line = F.concat("event_type", F.lit(": "), (F.col("event_id") % 50).cast("string"), F.lit("/50 blocks"))
    p = J.progress_of(line)
    return table(spark, sf, "events").select("event_id", p["done"].alias("done"), p["total"].alias("total"))


@_f.query("m41_s28_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), 7) AS missing FROM events")
def m41(spark, sf):
    parsed = F.from_json("props", "k bigint, missing bigint")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.coalesce(parsed["missing"], F.lit(7).cast("long")).alias("missing"))


@_f.query("m39_durations", "SELECT event_id, CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN (s // 60) || ' min ' || (s % 60) || ' s' ELSE (s // 3600) || ' h ' || (s % 3600 // 60) || ' min' END AS took FROM (SELECT event_id, floor(value * 50 + 0.5)::BIGINT AS s FROM events)")
def m39(spark, sf):
    return table(spark, sf, "events").select("event_id", J.duration_text(F.col("value") * 50).alias("took"))


@_f.query("m40_cost_model", "SELECT p_partkey, round(1 / (0.31 + 0.69 * (p_size / 50.0::DOUBLE)), 5) + 0.0 AS speedup, p_size * 128 AS candidate_bytes FROM part")
def m40(spark, sf):
    return table(spark, sf, "part").select("p_partkey", rounded(J.matching_speedup(F.col("p_size") / 50.0)).alias("speedup"), (F.col("p_size") * 128).alias("candidate_bytes"))


@_f.query("k03_k05_k07_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def k05(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@_f.query("k01_k06_seeded_order", "SELECT o_orderkey, md5('20909' || o_orderkey) AS place FROM orders")
def k06(spark, sf):
    """A shuffle that is the same in every run and engine: the order by a seeded hash."""
    return table(spark, sf, "orders").select("o_orderkey", F.md5(F.concat(F.lit("20909"), F.col("o_orderkey").cast("string"))).alias("place"))


@_f.query("k06_s34_permutation", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('20909' || o_orderkey), o_orderkey) - 1 AS place FROM orders")
def k06_places(spark, sf):
    """Places of a seeded permutation, 0 to n - 1."""
    return J.shuffled(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "place")


@_f.query("j33_compared_by_place", """WITH p AS (SELECT p_partkey, p_retailprice::DOUBLE AS price, p_size, row_number() OVER () - 1 AS place FROM part),
a AS (SELECT place, price + CASE WHEN p_partkey % 100 = 0 THEN 0.25 ELSE 0 END AS price, p_size FROM p WHERE p_size < 50), b AS (SELECT place, price, p_size FROM p WHERE p_size > 1)
SELECT count(*) FILTER (WHERE a.place IS NOT NULL AND b.place IS NOT NULL) AS "rows", count(*) FILTER (WHERE a.place IS NULL) AS missing, count(*) FILTER (WHERE b.place IS NULL) AS surplus,
  round(max(abs(a.price - b.price)), 5) + 0.0 AS max_price, max(abs(a.p_size - b.p_size))::DOUBLE AS max_size, false AS passed FROM a FULL JOIN b ON a.place = b.place""")
def j33(spark, sf):
    """A result and a reference compared row by row, by their places in the file."""
    p = J.placed(table(spark, sf, "part")).select("place", "p_partkey", F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").alias("size"))
    result = p.where("size < 50").withColumn("price", F.col("price") + F.when(F.col("p_partkey") % 100 == 0, 0.25).otherwise(0.0))
    return J.compared(result, p.where("size > 1"), {"price": 0.1, "size": 0.0}).withColumn("max_price", rounded(F.col("max_price")))


@_f.query("a38_x05_observed_stages", """WITH l AS (SELECT * FROM lineitem), f AS (SELECT * FROM l WHERE l_quantity >= 10), g AS (SELECT l_suppkey, sum(l_quantity) AS q FROM f GROUP BY 1)
SELECT 'read' AS stage, count(*) AS "rows", round(min(l_quantity), 2) + 0.0 AS least, round(max(l_quantity), 2) + 0.0 AS most FROM l UNION ALL SELECT 'filter', count(*), round(min(l_discount), 2) + 0.0, round(max(l_discount), 2) + 0.0 FROM f UNION ALL SELECT 'sum', count(*), round(min(q), 2) + 0.0, round(max(q), 2) + 0.0 FROM g""")
def a38(spark, sf):
    """Rows and extremes of the stages of a run, observed while it runs."""
    o = J.Observed(spark)
    read = o.stage("read", table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount"), "l_quantity")
    some = o.stage("filter", read.where("l_quantity >= 10"), "l_discount")
    o.stage("sum", some.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")), "q").write.format("noop").mode("overwrite").save()
    return o.table().select("stage", "rows", rounded(F.col("least"), 2).alias("least"), rounded(F.col("most"), 2).alias("most"))


_OBSERVED = f"""WITH {V.POINTS}, o AS (SELECT p.*, l_orderkey // 500 AS scan FROM (SELECT l_orderkey, {V.POINTS[len("pts AS (SELECT ") : -1]}) p),
e AS (SELECT *, CASE WHEN intensity >= 100 THEN row_number() OVER (PARTITION BY scan, intensity >= 100 ORDER BY t_us, point_id) - 1 END AS export_rank FROM o)"""


def _observations(spark, sf):
    """Frames of observations: those of 500 order keys each, so there are more with more data; bright ones are exported."""
    from pyspark.sql import Window

    p = V.points(spark, sf, F.floor(F.col("l_orderkey") / 500).cast("long").alias("scan")).drop("frame").withColumnRenamed("scan", "frame")
    own = Window.partitionBy("frame")
    rank = F.row_number().over(Window.partitionBy("frame", F.col("intensity") >= 100).orderBy("t_us", "point_id")) - 1
    p = p.withColumns({"export_rank": F.when(F.col("intensity") >= 100, rank).cast("long"), "sample": (F.row_number().over(own.orderBy("point_id")) - 1).cast("long"), "raw_count": F.count("*").over(own), "export_count": F.count_if(F.col("intensity") >= 100).over(own)})
    begin = F.col("frame") / 10.0
    fixed = {"origin_ns": F.lit(1).cast("long"), "begin": begin, "end": begin + 0.1, "tx": begin, "ty": d(0), "tz": d(0), "qx": d(0), "qy": d(0), "qz": d(0), "qw": d(1), "vx": d(0), "vy": d(0), "vz": d(0), "imu_shift": d(0)}
    return p.withColumns({**fixed, **{f"raw_{c}": F.col(c) for c in "xyz"}, "range": F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), "offset_ns": F.pmod("point_id", F.lit(100_000_000)), "intensity": F.col("intensity") % 256, "line": F.lit(0)})


@_f.query("s10_observation_frames", _OBSERVED + " SELECT scan AS frame, count(*) AS n, count(export_rank) AS exported, max(export_rank) AS last_rank, round(sum(x), 3) + 0.0 AS x, sum(tag)::BIGINT AS tags, sum(point_id % 100000000)::BIGINT AS offsets FROM e GROUP BY scan")
def s10(spark, sf):
    """Observation frames written as files, one for each frame, and read again."""
    from terraweave.session import shared_path
    from terraweave.sources import frames

    path = shared_path(spark, "observations")
    frames.write_observations(_observations(spark, sf), path)
    got = spark.read.format("observations").option("path", path).load()
    return got.groupBy("frame").agg(F.count("*").alias("n"), F.count("export_rank").alias("exported"), F.max("export_rank").alias("last_rank"), rounded(F.sum("x"), 3).alias("x"), F.sum("tag").alias("tags"), F.sum("offset_ns").alias("offsets"))


@_f.query("s14_s15_registered_cloud", _OBSERVED + " SELECT scan AS frame, count(*) AS n, round(avg(x) + scan / 10.0, 3) + 0.0 AS x, round(avg(y), 3) + 0.0 AS y, round(avg(z), 3) + 0.0 AS z, max(intensity)::DOUBLE AS intensity FROM e WHERE export_rank IS NOT NULL AND scan >= 1 GROUP BY scan")
def s15(spark, sf):
    """Scans written in export order, one file a frame, and registered by their poses; frame 0 is never opened."""
    from terraweave.session import shared_path
    from terraweave.sources import frames

    path = shared_path(spark, "scans")
    seen = _observations(spark, sf)
    frames.write_scans(seen, path)
    poses = seen.select("frame", F.col("end").alias("t"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"), "qx", "qy", "qz", "qw").distinct()
    cloud = frames.registered_cloud(spark, path, poses, first=1)
    return cloud.groupBy("frame").agg(F.count("*").alias("n"), *[rounded(F.avg(c), 3).alias(c) for c in "xyz"], F.max("intensity").cast("double").alias("intensity"))


@_f.query("s20_coloured_export", "WITH " + V.POINTS + " SELECT count(*) AS coloured_points, count(*) FILTER (WHERE intensity >= 150) AS blended_points, (SELECT count(*) FROM pts) AS input_points, sum(point_id % 1000003)::BIGINT AS ids, sum(r)::BIGINT AS red, round(avg(x), 4) + 0.0 AS x FROM pts WHERE intensity >= 50")
def s20(spark, sf):
    """Coloured points as LAS files beside the ids of their points, and the counts of result.json; both are read again."""
    import json

    from terraweave.session import shared_path
    from terraweave.sources import frames, records

    path = shared_path(spark, "export")
    p = V.points(spark, sf)
    seen = F.col("intensity") >= 50
    frames.export(p.select("point_id", "x", "y", "z", *[F.when(seen, F.col(a)).alias(b) for a, b in (("r", "red"), ("g", "green"), ("b", "blue"))], (F.col("intensity") >= 150).alias("blended")), path)
    records.register(spark)
    fs, at = records.opened(path)
    with fs.open_input_stream(f"{at}/result.json") as f:
        counts = json.loads(f.read())
    las = spark.read.format("las").option("path", path).load().agg(F.count("*").alias("n"), F.sum("red").alias("red"), rounded(F.avg("x"), 4).alias("x"))
    ids = spark.read.format("records").options(path=path, fields="point_id:i8", suffix=".u64").load().agg(F.sum(F.col("point_id") % 1000003).alias("ids"), F.count("*").alias("m"))
    both = las.crossJoin(ids).where("n = m")  # a row each
    return both.select(F.col("n").alias("coloured_points"), F.lit(counts["blended_points"]).cast("long").alias("blended_points"), F.lit(counts["input_points"]).cast("long").alias("input_points"), "ids", "red", "x")
