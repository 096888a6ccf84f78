"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words. Every document of the source is expected target / source_size times in the
mix. The expected copies are summed up along an order of the source's documents, one offset is added, and a document is
emitted once per integer boundary that its stretch of the sum crosses. As the order runs from small to large documents,
every size is represented in proportion, so that words come near the target and not only documents.

The sum needs the rank of each document in its source. One window over a source would put a hot source into one task;
here a source is cut into cells (size bin, hash of doc_id modulo `slices`), ranks are found within cells, and the counts of
the cells are summed over each bin, those of the bins over each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.llm.storage import materialize

#: A word is a run of characters other than blank and 0x09 to 0x0D, which is what \S says to the JVM.
WORD = r"\S+"
#: Documents that a cell may expect to hold; the number of slices follows from it and the number of documents.
CELL_ROWS = 20_000
#: Offsets that a source's sample may start from. Sums of words depend on which of the few largest documents are met;
#: of these systematic samples, each source gets the one whose words come nearest to its target.
OFFSETS = tuple((2 * k + 1) / 32 for k in range(16))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """Targets of sources: (source, size) per document in, (source, source_size, target) out.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes. A target stops at cap
    times its source's size; the excess is reshared by weight until no target is above. Solved at once: along growing
    cap / weight the first sources are capped, and the rest share what is left by weight. The windows here run over one
    row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull().cast("int"), F.col("source"))
    weighed = total.withColumn("weight", F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1)
    along = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = weighed.select(
        "*",
        F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
        F.sum("source_size").over(everything).alias("all_words"),
        F.sum("weight").over(everything).alias("all_weight"),
    )
    # The share of one unit of weight if exactly the sources before this one are capped.
    s = s.withColumn("unit", (F.col("all_words") - F.col("capped")) / (F.col("all_weight") - F.col("weight_before")))
    s = s.withColumn("is_capped", F.col("unit") * F.col("weight") > F.col("source_size") * cap)
    # Sources that are not capped form the tail of the order; its first row has their unit, and later rows have less.
    s = s.withColumn("first_unit", F.max(F.when(~F.col("is_capped"), F.col("unit"))).over(everything))
    target = F.when(F.col("is_capped"), (F.col("source_size") * cap).cast("double")).otherwise(F.least(F.col("first_unit") * F.col("weight"), (F.col("source_size") * cap).cast("double")))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def size_bin(size: Column) -> Column:
    """A few hundred bins that widen with the size: below 64 each size has its own, above there are 16 to a doubling."""
    return F.when(size < 64, size).otherwise(F.floor(F.log2(size.cast("double")) * 16).cast("long") - 32).cast("long")


def mix(docs: DataFrame, cap: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of each row of docs(doc_id, text, source).

    Null and empty texts have size 0 and are taken 0 words; their copies still follow their source. Null sources form
    one source. Rows with the same doc_id or the same text are rows like any others; ties in the order go by doc_id,
    rows that also share the doc_id are interchangeable. An empty table gives an empty result. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    return mix_sizes(base, cap, cell_rows)


def mix_sizes(base: DataFrame, cap: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """As mix(), from rows (doc_id, source, size, ...) whose other columns are carried along.

    The rows are written once: sizes are used several times below, and counting words is what takes the time.
    """
    base, _ = materialize(base, "sizes")
    counted = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    rows = counted.agg(F.max("n")).first()[0] or 0
    slices = max(8, -(-rows // cell_rows))
    targets = source_targets(counted.select("source", "size"), cap)
    spread = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")  # ids with a common stride, too
    cells = base.select("*", size_bin(F.col("size")).alias("_bin"), F.pmod(spread, F.lit(slices)).alias("_slice"))
    key = ["source", "_bin", "_slice"]
    within = Window.partitionBy(*key).orderBy("size", "doc_id")
    ranked = cells.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
    counts = cells.groupBy(*key).agg(F.count("*").alias("_n"))
    # Bins of a source, a few hundred, then the slices of each bin: no window has all cells of a source.
    of_bins = counts.groupBy("source", "_bin").agg(F.sum("_n").alias("_n"))
    of_bins = of_bins.select(F.col("source").alias("_s"), F.col("_bin").alias("_b"), F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    along = Window.partitionBy("source", "_bin").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start"))
    starts = starts.join(of_bins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b"))).select(*key, (F.col("_start") + F.col("_before")).alias("_start"))
    same = [F.col("r.source").eqNullSafe(F.col("s.source")), F.col("r._bin") == F.col("s._bin"), F.col("r._slice") == F.col("s._slice")]
    joined = ranked.alias("r").join(starts.alias("s"), same).select("r.*", "s._start")
    joined = joined.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(1.0))
    placed = joined.withColumns({"_rate": rate, "_rank": F.col("_start") + F.col("_rank")})

    def copies(offset) -> Column:
        return F.least(F.floor(offset + (F.col("_rank") + 1) * F.col("_rate")) - F.floor(offset + F.col("_rank") * F.col("_rate")), F.lit(cap)).cast("int")

    sums = placed.groupBy("source").agg(*[F.sum(F.col("size") * copies(F.lit(u))).alias(f"_s{k}") for k, u in enumerate(OFFSETS)], F.first("target").alias("_t"))
    nearest = F.least(*[F.struct(F.abs(F.col(f"_s{k}") - F.col("_t")).alias("off"), F.lit(u).alias("u")) for k, u in enumerate(OFFSETS)])
    chosen = sums.select("source", nearest["u"].alias("_offset"))
    joined = placed.alias("r").join(chosen.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source"))).select("r.*", "o._offset").withColumn("copies", copies(F.col("_offset")))
    carried = [c for c in base.columns if c not in ("doc_id", "size")]
    return joined.select("doc_id", *carried, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def emit(docs: DataFrame, cap: int = 3) -> DataFrame:
    """The rows of docs, as they are, each as often as mix() takes it.

    Null and empty texts are emitted as their source's rate says, although they add no words; repeated rows are rows like any
    others. An empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # packed, so that no column's name can clash
    mixed = mix_sizes(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row.alias("_row")), cap)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
