"""Exact top-k by inner product, term at a time.

A vector is a sparse row of whole-number weights over its components, the terms. Queries and candidates are cut into
blocks, and each pair of a query block and a candidate block is one group: for one term after the other, the weights of
the queries that have it scatter the term's postings (candidates and weights) into a dense score array. Partition
selection leaves k candidates a query and block, and a window merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 1024, 4096, 16
#: What a score can be; products beyond are ranked as they are and reported as the nearer of these.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): components scale * x as doubles, for vectors without null or non-finite components.

    A component that is finite but too large to be scaled counts as non-finite.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * float(scale)) < float("inf")))
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") * float(scale)).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists as rows of a matrix of whole numbers, floors of theirs; short ones filled with zeros: a missing term has no
    posting."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    out = np.zeros((len(column), n.max(initial=0)))
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n]) if len(n) else np.zeros(0, int)] = flat
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of a tile of queries, one term's postings after the other; exact, as all are whole numbers."""
    terms = min(queries.shape[1], candidates.shape[1])
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(terms, 1)
    kind = np.float64 if bound < 2**53 else object
    if kind is object:
        queries, candidates = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (queries, candidates))
    q, postings = queries, np.ascontiguousarray(candidates.T)
    scores, part = np.zeros((len(q), len(candidates)), kind), np.empty((len(q), len(candidates)), kind)
    for t in range(terms):
        has = np.flatnonzero(q[:, t])
        if len(has) == len(q):
            np.multiply(q[:, t, None], postings[t], out=part)
            scores += part
        elif len(has):
            scores[has] += q[has, t, None] * postings[t]
    return scores


def select(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest of one row of scores, ties to the first; allowed: those that take part."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        s = scores[at]
        bar = np.partition(s, len(s) - k)[len(s) - k]
        over, tied = at[s > bar], at[s == bar]
        at = np.concatenate([over, tied[: k - len(over)]])
    return at


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose vec_id is divisible by `every`, the k others of the highest
    inner product of components floor(scale * x), ties to the smaller vec_id; all others if there are fewer.

    Null vectors, vectors with null or non-finite components and null ids take no part. Empty vectors score 0, shorter
    ones as if filled with zeros. Rows with the vec_id of the query are its own. Products beyond the range of a long, which
    only components of 2^27 and more can make, are ranked within a block of candidates as they are, and among blocks, as in
    the result, as the end of that range. An empty table gives an empty result.
    """
    base = scaled(vectors, scale)
    n = base.count()
    chunks = max(1, -(-n // CANDIDATE_BLOCK))
    queries = base.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK)) if n else 1
    numbered = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count))
    upto = lambda count: F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))
    q = queries.select(numbered(blocks, 1).alias("block"), F.explode(upto(chunks)).alias("chunk"), "vec_id", "v")
    c = base.select(F.explode(upto(blocks)).alias("block"), numbered(chunks, 2).alias("chunk"), "vec_id", "v")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        qid, cid = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        order = np.argsort(cid, kind="stable")
        cid = cid[order]
        if len(qid) and len(cid):
            qv, cv = matrix(left.column("v")), matrix(right.column("v"))[order]
            for at in range(0, len(qid), TILE):
                scores = accumulate(qv[at : at + TILE], cv)
                for own, row in zip(qid[at : at + TILE], scores, strict=True):
                    best = select(row, cid != own, k)
                    out["query_id"].append(np.full(len(best), own, np.int64))
                    out["vec_id"].append(cid[best])
                    out["score"].append(np.array([min(max(int(x), LEAST), MOST) for x in row[best]], np.int64))
        return pa.table({name: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64) for name, parts in out.items()})

    found = q.groupBy("block", "chunk").cogroup(c.groupBy("block", "chunk")).applyInArrow(score, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
