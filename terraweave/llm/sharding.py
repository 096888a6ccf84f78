"""Sharding by sampled splitters.

Records are ordered by a 63-bit key: the CRC of the text above a hash of doc_id, so that equal texts are neighbours and
yet hardly a key is hot. A sample, drawn with probability in proportion to size, gives quantile boundaries for ranges of
about equal bytes; records are range-partitioned by them. A key that fills ranges by itself (rows equal in doc_id and text)
has a range of its own. Ranges that came out overfull are subdivided along the key, those of one key by the place of their
rows in the table. Prefix sums of bytes over ranges, over their parts, then over the records within each, cut the order into
shards of equal bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.llm.storage import materialize

#: Bytes that each record counts besides its text.
RECORD_BYTES = 16
#: The sample is expected to hold so many keys for each range; the keys and splitters are what the driver sees.
KEYS_PER_RANGE = 16
#: Bytes of a part, which one task sorts; ranges are as large where there are fewer than MOST_RANGES, beyond that they are
#: subdivided into parts.
RANGE_BYTES = 16 << 20
MOST_RANGES = 4096
OUTPUTS = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, _key, _row): what place() needs; the row itself is packed, so that no name can clash."""
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    spread = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), 33)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = docs.select(F.col("doc_id"), record_size(F.col("text")).alias("size"), crc.alias("text_crc32"), row.alias("_row"), spread.alias("_spread"))
    return found.select("doc_id", "size", "text_crc32", F.shiftleft(F.col("text_crc32"), 31).bitwiseOR(F.col("_spread")).alias("_key"), "_row")


def shard(docs: DataFrame, shards: int = 40, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs(doc_id, text).

    The law is `bytes`: record r goes to shard floor(shards * (bytes before r) / (all bytes)), so shards differ by less
    than one record of size. Equal texts are neighbours in the order, and a group of them lies in one shard unless a cut
    falls into it. Null texts count as empty; null and repeated doc_ids are placed each for itself, ties in (key, doc_id)
    by size alone; rows equal in doc_id and text are interchangeable. An empty table gives an empty result. Other columns
    are ignored.
    """
    return place(keyed(docs.select("doc_id", "text")).drop("_row"), shards, range_bytes)


def place(rows: DataFrame, shards: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As shard(), from rows(doc_id, size, text_crc32, _key[, _row]).

    Where there is a _row, its columns are returned too, before the others; those named like one of OUTPUTS, other than
    doc_id, get the ending _in. The rows are written once, and their place in that table is what splits rows of one key.
    """
    rows, _ = materialize(rows.withColumn("_tie", F.monotonically_increasing_id()), "keyed")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = int(min(MOST_RANGES, max(shards, -(-total // range_bytes))))
    rate = ranges * KEYS_PER_RANGE / max(total, 1)
    # A hash of the key says who is in the sample: the same records whenever a task is run again.
    chance = F.shiftrightunsigned(F.xxhash64("_key", "_tie", F.lit(7)), 11) / F.lit(float(1 << 53))
    share = F.col("size") * F.lit(rate)
    drawn = rows.where(chance < share).select("_key", F.greatest(share, F.lit(1.0)).alias("w")).toPandas().sort_values("_key")  # about KEYS_PER_RANGE * MOST_RANGES keys
    upto = np.cumsum(drawn["w"].to_numpy(float))
    cuts = drawn["_key"].to_numpy(np.int64)[np.searchsorted(upto, np.arange(1, ranges) * (upto[-1] / ranges))] if len(drawn) else np.zeros(0, np.int64)
    keys, times = np.unique(cuts, return_counts=True)
    # Keys are compared as doubles, which keeps their order; a key that is a cut twice begins and ends a range.
    splitters = np.unique(np.concatenate([keys.astype(float), np.nextafter(keys[times > 1].astype(float), np.inf)]))
    bucket = Bucketizer(splits=[-float("inf"), *(splitters.tolist() or [0.0]), float("inf")], inputCol="_at", outputCol="_range")
    ranged = bucket.transform(rows.withColumn("_at", F.col("_key").cast("double"))).withColumn("_range", F.col("_range").cast("int"))
    # Overfull ranges are cut again, evenly along the key between their least and greatest key.
    stats = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.min("_key").alias("_least"), F.max("_key").alias("_most"))
    goal = max(1.0, 2.0 * min(range_bytes, total / max(1, ranges)))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_bytes") / F.lit(goal))).cast("long")
    stats = F.broadcast(stats.select("_range", "_least", parts.alias("_parts"), (F.col("_most") - F.col("_least") + 1).cast("double").alias("_width")))  # one row a range, twice MOST_RANGES at most
    along_key = F.least(F.floor((F.col("_key") - F.col("_least")).cast("double") / F.col("_width") * F.col("_parts")).cast("long"), F.col("_parts") - 1)
    part = F.when(F.col("_width") > 1, along_key).otherwise(F.pmod(F.xxhash64("_tie"), F.col("_parts")))
    cut = ranged.join(stats, "_range").withColumn("_part", part).drop("_least", "_parts", "_width", "_at", "_tie")
    within = Window.partitionBy("_range", "_part").orderBy("_key", "doc_id", "size")
    summed = cut.withColumns({"_upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_row_no": F.row_number().over(within)})
    sums = cut.groupBy("_range", "_part").agg(F.sum("size").alias("_b"), F.count("*").alias("_n"))

    def before(name: str, over: Window) -> Column:
        return F.coalesce(F.sum(name).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    of_ranges = sums.groupBy("_range").agg(F.sum("_b").alias("_b"), F.sum("_n").alias("_n"))  # a row for each range
    of_ranges = of_ranges.select("_range", *[before(c, Window.orderBy("_range")).alias(f"{c}r") for c in ("_b", "_n")])
    along = Window.partitionBy("_range").orderBy("_part")
    starts = sums.select("_range", "_part", *[before(c, along).alias(f"{c}p") for c in ("_b", "_n")]).join(F.broadcast(of_ranges), "_range")
    starts = starts.select("_range", "_part", (F.col("_bp") + F.col("_br")).alias("_b0"), (F.col("_np") + F.col("_nr")).alias("_n0"))
    placed = summed.join(starts, ["_range", "_part"]).withColumns({"_at": F.col("_b0") + F.col("_upto") - F.col("size"), "_rank": F.col("_n0") + F.col("_row_no") - 1})
    placed = placed.withColumn("shard", F.least(F.floor(F.col("_at").cast("decimal(38,0)") * shards / F.lit(max(total, 1)).cast("decimal(38,0)")).cast("int"), F.lit(shards - 1)))
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("_rank").alias("_first")))  # a row for each shard
    out = placed.join(firsts, "shard").withColumns({"slot": (F.col("_rank") - F.col("_first")).cast("long"), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    if "_row" not in rows.columns:
        return out.select(*OUTPUTS)
    names = [f.name for f in rows.schema["_row"].dataType.fields]
    taken = {c.lower() for c in OUTPUTS[1:]}
    carried = [F.col("_row").getField(c).alias(f"{c}_in" if c.lower() in taken else c) for c in names]
    return out.select(*carried, *OUTPUTS[1:])
