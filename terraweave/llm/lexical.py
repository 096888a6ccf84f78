"""Ranked lexical search by branch and bound over max trees.

Documents are dealt to ranges of bounded size. The index has a row for each range and term: the term's postings, places
and occurrences, in that range. For a block of queries, each range's postings of their terms become scores, and over them
each term gets a tree of maxima: leaves of LEAF documents, FAN nodes under one above. A query's bound at a node is the sum
of its terms' weights times their maxima there. Best first, the node of the highest bound is opened, until k documents score
more than any bound that is left; nodes with a bound equal to the k-th score are opened too, as a tie goes to the smaller
doc_id. The ranges' best are merged by a window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraweave.llm.storage import materialize, release

#: A range holds at most so many documents, and bytes of text (more only in a document that is a range by itself).
RANGE_DOCS, RANGE_BYTES = 2048, 8 << 20
LEAF, FAN = 8, 8
#: Queries are searched in blocks of about so many terms.
BLOCK_TERMS = 16384
INDEX = "range long, term string, places array<int>, counts array<int>, ids array<long>"

#: Bytes of UTF-8 to what they are in a term: ASCII letters and digits, A-Z lower-cased, and all beyond ASCII; the rest ends it.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order, with repeats."""
    return text.translate(_BYTES).split() if text else []


def _postings(number: int, ids: list[int], docs: list[list[bytes]]) -> pa.RecordBatch:
    """The index of one range: its document row (no term: lengths as counts) and a row for each term."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    docs, lengths = [docs[k] for k in order], np.array([len(docs[k]) for k in order], np.int64)
    words = pa.array([t for d in docs for t in d], pa.binary()).dictionary_encode()
    key = words.indices.to_numpy().astype(np.int64) * len(docs) + np.repeat(np.arange(len(docs)), lengths)
    key, counts = np.unique(key, return_counts=True)
    term, place = np.divmod(key, len(docs))
    ends = np.flatnonzero(np.diff(term, append=-1)) + 1
    offsets = pa.array(np.concatenate([[0, len(docs)], len(docs) + ends]).astype(np.int32))
    n = len(ends)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, number, np.int64)),
            pa.concat_arrays([pa.array([None], pa.string()), words.dictionary.take(pa.array(term[ends - 1])).cast(pa.string())]),
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.arange(len(docs)), place]).astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([lengths, counts]).astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(n + 1, len(docs))].astype(np.int32)), pa.array(np.array(ids, np.int64)[order])),
        ],
        names=["range", "term", "places", "counts", "ids"],
    )


def build(docs: DataFrame, range_docs: int = RANGE_DOCS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The index of docs(doc_id, text): rows (range, term, places, counts, ids).

    The row of a range without a term has its documents: ids in ascending order and their numbers of terms as counts.
    Documents without a doc_id or without a term are not in it. Rows are dealt out evenly, whatever their keys.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    tasks = max(1, -(-n // range_docs), -(-size // range_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, held, size = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py()
                if held and (len(held) >= range_docs or size + len(raw) > range_bytes):
                    yield _postings(number, ids, held)
                    number, ids, held, size = number + 1, [], [], 0
                if terms := terms_of(raw):
                    ids.append(doc.as_py())
                    held.append(terms)
                    size += len(raw)
        if held:
            yield _postings(number, ids, held)

    return base.repartition(int(tasks)).mapInArrow(run, INDEX)


class MaxTree:
    """Scores of the terms of a block in one range, and the maxima over them.

    row: term of each posting, ascending; place: document, ascending within a term; value: its score.
    """

    def __init__(self, terms: int, documents: int, row: np.ndarray, place: np.ndarray, value: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.leaf, self.fan, leaves = leaf, fan, -(-documents // leaf)
        levels = [np.zeros((terms, leaves), np.int64)]
        key = row * leaves + place // leaf
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if len(first):
            levels[0].reshape(-1)[key[first]] = np.maximum.reduceat(value, first)
        while levels[-1].shape[1] > 1:
            below = levels[-1]
            levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], fan), axis=1))
        self.levels = levels
        by_leaf = np.argsort(place // leaf, kind="stable")
        self.row, self.place, self.value = row[by_leaf], place[by_leaf], value[by_leaf]
        self.ends = np.searchsorted(self.place // leaf, np.arange(leaves + 1))

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, place) with a score above 0, equal scores by ascending place; rows: the query's terms."""
        weight = np.zeros(len(self.levels[0]), np.int64)
        weight[rows] = weights
        top = len(self.levels) - 1
        queue = [(-int(weights @ self.levels[top][rows, 0]), top, 0)]
        best: list[tuple[int, int]] = []  # a heap: the least score first, among equals the largest place
        while queue:
            bound, level, at = heapq.heappop(queue)
            if not bound or (len(best) == k and -bound < best[0][0]):
                break
            if level:
                children = slice(at * self.fan, (at + 1) * self.fan)
                bounds = weights @ self.levels[level - 1][rows, children]
                for j in np.flatnonzero(bounds).tolist():
                    heapq.heappush(queue, (-int(bounds[j]), level - 1, at * self.fan + j))
                continue
            s = slice(self.ends[at], self.ends[at + 1])
            scores = np.zeros(self.leaf, np.int64)
            np.add.at(scores, self.place[s] - at * self.leaf, weight[self.row[s]] * self.value[s])
            for j in np.flatnonzero(scores).tolist():
                found = (int(scores[j]), -(at * self.leaf + j))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return [(score, -place) for score, place in sorted(best, reverse=True)]


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 20 * m), m = 50 + (50 * n * N) div L."""
    m = 50 + (50 * lengths * documents) // all_terms
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def search(index: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item of items(item_id, text), by the index that build()
    makes, best read from a written table.

    Rows that share an item_id are one item of all their terms; items without an id or without a term give no rows, nor do
    documents that share no term of weight. Equal scores are ranked by ascending doc_id; rows of one doc_id are documents
    of their own. An empty index or no items give an empty result.
    """
    spark = index.sparkSession
    split = F.split(F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    asked = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.explode(split).alias("term")).where("term <> ''").distinct()
    asked, asked_at = materialize(asked, "asked")
    ranges = index.where("term IS NULL")
    lengths = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    documents, all_terms, _ = ranges.agg(F.coalesce(F.sum(F.size("counts")), F.lit(0)), F.coalesce(F.sum(lengths), F.lit(0)), F.count("*")).first()
    hits, hits_at = materialize(index.where("term IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi").drop("ids"), "hits")
    df = hits.groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    blocks = max(1, -(-asked.count() // block_terms))
    weighed = asked.join(df.select("term", weight.alias("w")), "term").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    terms = weighed.where("w > 0").groupBy("block", "term").agg(F.first("w").alias("w"), F.collect_list("item_id").alias("items"))  # at most block_terms items, or one
    postings = hits.join(terms, "term").select("range", "block", "term", "w", "items", "places", "counts")
    own = ranges.select("range", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "ids", F.col("counts").alias("lengths"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"item_id": [], "doc_id": [], "score": []}
        if left.num_rows and right.num_rows:
            left = left.combine_chunks()
            ids, n = (right.column(c).combine_chunks().values.to_numpy() for c in ("ids", "lengths"))
            places, counts, asking = (left.column(c).combine_chunks() for c in ("places", "counts", "items"))
            row = np.repeat(np.arange(left.num_rows), np.diff(places.offsets.to_numpy()))
            place, count = places.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
            tree = MaxTree(left.num_rows, len(ids), row, place, impacts(count, n.astype(np.int64)[place], documents, all_terms))
            w = left.column("w").to_numpy()
            item, of = asking.flatten().to_numpy(), np.repeat(np.arange(left.num_rows), np.diff(asking.offsets.to_numpy()))
            order = np.argsort(item, kind="stable")
            item, of = item[order], of[order]
            begins = np.flatnonzero(np.diff(item, prepend=item[0] - 1)) if len(item) else []
            for asker, rows in zip(item[begins].tolist(), np.split(of, begins[1:]), strict=True):
                found = tree.search(rows, w[rows], k)
                out["item_id"] += [asker] * len(found)
                out["doc_id"] += [int(ids[p]) for _, p in found]
                out["score"] += [s for s, _ in found]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in out.items()})

    found = postings.groupBy("range", "block").cogroup(own.groupBy("range", "block")).applyInArrow(best, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked, _ = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")
    release(spark, asked_at, hits_at)
    return ranked


def rank(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """search() of items over an index of docs(doc_id, text), which is written once and released.

    Null texts have no terms. Documents without a doc_id take no part, nor in the counts.
    """
    index, at = materialize(build(docs), "lexical")
    found = search(index, items, k)
    release(docs.sparkSession, at)
    return found
