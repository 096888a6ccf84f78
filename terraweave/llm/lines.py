"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines ends a chunk, so boundaries move along with the lines when text is
put in or taken out before them. Chunks of two or more lines that occur more than once, compared byte by byte, stay in
the first document only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.llm.storage import materialize

#: A chunk ends where the rolling hash of WINDOW lines is divisible by DIVISOR.
WINDOW, DIVISOR = 2, 4
MOST_HOT = 1024
_MULTIPLIER, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def cut(text: str | None, window: int = WINDOW, divisor: int = DIVISOR) -> list[list[bytes]]:
    """The lines of a text, as chunks."""
    if not text:
        return []
    chunks, now, recent = [], [], []
    for line in text.encode().split(b"\n"):
        now.append(line)
        recent = [*recent[1 - window :], xxhash.xxh64_intdigest(line)] if window > 1 else [xxhash.xxh64_intdigest(line)]
        rolled = 0
        for h in recent:
            rolled = (rolled * _MULTIPLIER + h) & _MASK
        if (rolled >> 20) % divisor == 0:
            chunks.append(now)
            now = []
    return [*chunks, now] if now else chunks


def keys_of(chunk: bytes) -> tuple[int, int]:
    """A 128-bit hash as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(chunk)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (h >> 64, h & _MASK))


def _chunk_rows(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            ids, h1, h2, body = [], [], [], []
            for doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                for chunk in dict.fromkeys(b"\n".join(c) for c in cut(text) if len(c) > 1):
                    a, b = keys_of(chunk)
                    ids.append(doc)
                    h1.append(a)
                    h2.append(b)
                    body.append(chunk)
            cols = [pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(body, pa.binary())] if with_bytes else cols, names=["doc_id", "h1", "h2", "chunk"][: 4 if with_bytes else 3])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2): chunks that each document must give up, as an earlier document has the same bytes."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    full = base.mapInArrow(lambda it: _chunk_rows(it, True), "doc_id long, h1 long, h2 long, chunk binary")
    # The bytes are part of the key, so only equal bytes meet; where two texts share a hash, none of them is removed.
    texts = full.groupBy("h1", "h2", "chunk").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    known = texts.groupBy("h1", "h2").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min("first_doc").alias("first_doc")).where("texts = 1 AND n > 1").select("h1", "h2", "n", "first_doc")
    known, _ = materialize(known, "chunks")
    rows = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # A chunk that has at least a share of 1 / MOST_HOT of all repeats would fill a task of the join; there are at most
    # MOST_HOT such chunks, so they are broadcast, and their rows go on with keys that spread and meet nothing.
    hot = known.where(F.col("n") * MOST_HOT >= rows).select("h1", "h2", F.col("first_doc").alias("hot_first"))
    cold = known.where(F.col("n") * MOST_HOT < rows).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("first_doc").alias("cold_first"))
    narrow = base.mapInArrow(lambda it: _chunk_rows(it, False), "doc_id long, h1 long, h2 long")
    told = narrow.join(F.broadcast(hot), ["h1", "h2"], "left")
    dealt = told.withColumns({"k1": F.when(F.col("hot_first").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id", "h1")), "k2": F.when(F.col("hot_first").isNull(), F.col("h2")).otherwise(F.lit(0))})
    found = dealt.join(cold, ["k1", "k2"], "left").withColumn("first_doc", F.coalesce("hot_first", "cold_first"))
    return found.where("first_doc <> doc_id").select("doc_id", "h1", "h2")


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, n_removed_bytes, text, kept_sha256) of each row.

    Of equal chunks of two or more lines the one in the document with the smallest doc_id stays, in it the first; the
    others go, each with its line feed. Chunks of one line stay. Null and empty texts have no lines and stay as they
    are. Rows with equal doc_id are one document: they keep what they share with each other. Rows with a null doc_id
    lose repeats within themselves only. An empty table gives an empty result; other columns are ignored.
    """
    lost = repeated_chunks(docs).groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    alone = rows.where("doc_id IS NULL").withColumn("lost", F.lit(None).cast(lost.schema["lost"].dataType))  # one key that meets nothing
    joined = rows.where("doc_id IS NOT NULL").join(lost, "doc_id", "left").unionByName(alone)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", "n_removed_bytes", "text", "kept_sha256"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for doc, text, gone in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    gone = {(g["h1"], g["h2"]) for g in gone or ()}
                    chunks, seen, kept, removed = cut(text), set(), [], []
                    for chunk in chunks:
                        body = b"\n".join(chunk)
                        drop = len(chunk) > 1 and (body in seen or bool(gone) and keys_of(body) in gone)
                        seen.add(body)
                        (removed if drop else kept).append(chunk)
                    left = b"\n".join(line for c in kept for line in c)
                    rows.append((doc, sum(map(len, chunks)), len(chunks), len(removed), sum(map(len, removed)), len((text or "").encode()) - len(left), None if text is None else left.decode(), hashlib.sha256(left).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("text", "kept_sha256") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return joined.mapInArrow(keep, "doc_id long, n_lines long, n_chunks long, n_removed_chunks long, n_removed_lines long, n_removed_bytes long, text string, kept_sha256 string")
