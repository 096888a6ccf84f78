"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.llm.storage import materialize, release


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(u, v): root is the smallest node that can be reached.

    Every round each node points to its smallest neighbour (itself, if it is smaller), and the graph is rewritten in
    terms of what its nodes point to, so it shrinks by a constant factor a round. The rounds' tables are written to the
    shared folder: a lost executor costs one round. A node with very many links is aggregated before the shuffle and,
    in the joins, split by adaptive execution. Null ends are dropped; an empty table gives an empty result.
    """
    spark = links.sparkSession
    edges = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    edges, held = materialize(edges.distinct(), "links")
    ends = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    roots, at = materialize(ends.withColumn("root", F.col("node")), "roots")
    while not edges.isEmpty():
        both = edges.select(F.col("u").alias("node"), "v").union(edges.select(F.col("v").alias("node"), F.col("u").alias("v")))
        parent, parent_at = materialize(both.groupBy("node").agg(F.least(F.min("v"), F.col("node")).alias("parent")), "parents")
        p, q = (parent.select(F.col("node").alias(a), F.col("parent").alias(b)) for a, b in (("u", "pu"), ("v", "pv")))
        moved = edges.join(p, "u").join(q, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
        chained = p.select(F.col("pu").alias("u")).join(p, "u").select("u", F.col("pu").alias("v"))
        rest = moved.union(chained).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        edges, rest_at = materialize(rest, "links")
        new, new_at = materialize(roots.join(parent.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
        release(spark, held, at, parent_at)
        roots, held, at = new, rest_at, new_at
    release(spark, held)
    return roots
