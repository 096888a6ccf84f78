"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint is cut into segments of two bits and mapped to the vector of its segments' bit counts. The Manhattan
distance of two vectors is at most the Hamming distance of their fingerprints. The range-join under that lower bound
uses grids, each of which looks at some of the coordinates only: two vectors meet in a grid when those agree.

* Exact grids: the coordinates form 6 groups, and there is a grid for each 3 of them. A distance of 3 or less touches at
  most 3 groups, so two such vectors agree on 3 groups at least and meet in some grid: no link is lost.
* Random grids, for thresholds at which exact grids would be of no use: random sets of coordinates.

Within a cell, candidates are verified by the Hamming distance itself. Equal fingerprints are one node from the start.
A cell with more than TILE nodes is dealt out as pairs of tiles, and each task passes on edges that span its links, at
most one a node, never all pairs.

Where similarity of shingle sets is asked for, links of fingerprints are candidates only, and the sets decide: first for the
edges passed on, then, in groups whose members those edges did not join, for the other candidates between different parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.llm.components import components
from terraweave.llm.storage import materialize, release

#: Nodes of a cell that one task compares with each other.
TILE = 4096
#: Random grids: coordinates of each, and their number, for so many nodes. At a Jaccard similarity of 0.8 two fingerprints of
#: 128 bits agree on a segment's count with probability 0.73; simulated, 97 % of such pairs meet in one of 80 sets of 8.
#: Unrelated ones agree with probability 3/8, so with 8/3 times the nodes a set has one coordinate more, and there are
#: 1 / 0.73 times as many of them: cells and recall stay as they are.
SET_SIZE, SETS, SET_NODES, SET_SEED, AGREE = 8, 80, 1 << 18, 20240501, 0.73
#: Bits in which candidates differ at most: at a similarity of 0.8 the distance is 19.4 on average, with a deviation of 4.1.
CANDIDATE_BITS = 34
#: Nodes of a tile and bytes of their shingle sets, where members of a group are compared by their sets.
SET_TILE, SET_TILE_BYTES = 1024, 16 << 20
#: Tasks that the members of one group are dealt to where they meet what is known of the group.
SALTS = 64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of characters other than ASCII white space, as UTF-8."""
    return text.encode().lower().split() if text else []


def shingles_of(words: list[bytes], n: int) -> list[bytes]:
    """All runs of n words, joined by a blank; the whole sequence if there are fewer words; none for none."""
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    return [joined[s : e - 1] for s, e in zip([0, *ends], ends[n - 1 :], strict=False)]


def majority(hashes: list[np.ndarray], width: int) -> np.ndarray:
    """For each array of n x width bytes, the bits that are set in over half of its rows; zero for no rows."""
    n = np.array([len(h) for h in hashes])
    owner = np.repeat(np.arange(len(hashes)), n) * 256
    flat = np.concatenate(hashes) if len(hashes) else np.zeros((0, width), np.uint8)
    out = np.zeros((len(hashes), width), np.uint8)
    for k in range(width):
        counts = np.bincount(owner + flat[:, k], minlength=len(hashes) * 256).reshape(len(hashes), 256) @ _BITS
        out[:, k] = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, f0): 64 bits of SimHash over each row's word shingles, repeats included; bits are those of XXH64, seed 42.

    Null, empty and blank texts have no shingles and the fingerprint zero.
    """

    def hashed(text: str | None) -> np.ndarray:
        h = [xxhash.xxh64_intdigest(g, 42) for g in shingles_of(words_of(text), shingle)]
        return np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bits = majority([hashed(t.as_py()) for t in part.column(1)], 8).view("<i8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.ascontiguousarray(bits[:, 0]))], names=["doc_id", "f0"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, f0 long")


def segment_counts(f: np.ndarray) -> np.ndarray:
    """n x lanes fingerprints to n x 32 * lanes bit counts of two-bit segments."""
    raw = np.ascontiguousarray(f).view(np.uint8).reshape(len(f), -1)
    pairs = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(f), -1, 2)
    return pairs[:, :, 0] + pairs[:, :, 1]


def exact_grids() -> list[np.ndarray]:
    """The coordinates that each grid looks at, for distances up to 3 of 64 bits."""
    groups = np.array_split(np.arange(32), 6)
    return [np.concatenate([groups[g] for g in three]) for three in combinations(range(6), 3)]


def random_grids(nodes: int, lanes: int) -> list[np.ndarray]:
    """As many sets of coordinates as SETS says for so many nodes."""
    more = max(0, ceil(log(max(1, nodes) / SET_NODES) / log(8 / 3)))
    rng = np.random.default_rng(SET_SEED)
    return [np.sort(rng.choice(32 * lanes, SET_SIZE + more, replace=False)) for _ in range(ceil(SETS / AGREE**more))]


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that rows with equal first `keys` columns come together."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        changed = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:keys]]))
        cut = changed[-1] + 1 if len(changed) else 0
        if cut:
            yield [c[:cut] for c in cols]
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as the links (a, b), one for each node but the smallest of its component."""
    nodes, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ab[: len(a)], ab[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    kept = label != np.arange(len(nodes))
    return nodes[kept], nodes[label[kept]]


def close_pairs(f: np.ndarray, start: int, size: int, left: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one run whose fingerprints differ in few bits, for 128 rows at a time, as among near copies most pairs
    are close; left: marks one side, and only mixed pairs count."""
    mine = f[start : start + size]
    rows, cols = (np.flatnonzero(left), np.flatnonzero(~left)) if left is not None else (np.arange(size), np.arange(size))
    for at in range(0, len(rows), 128):
        r = rows[at : at + 128]
        near = sum(np.bitwise_count(mine[r, k][:, None] ^ mine[cols, k][None, :]).astype(np.uint8) for k in range(f.shape[1])) <= distance
        i, j = np.nonzero(near)
        i, j = r[i], cols[j]
        if left is None:
            i, j = i[i < j], j[i < j]
        yield i + start, j + start


def links(nodes: DataFrame, sets: list[np.ndarray], lanes: int, distance: int, tile: int = TILE) -> DataFrame:
    """(u, v): edges whose components are those of nodes(node, f0, ...) that meet in a grid and are linked at `distance` bits
    or fewer."""
    lane_names = [f"f{k}" for k in range(lanes)]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                f = np.stack([part.column(1 + k).to_numpy() for k in range(lanes)], axis=1)
                v = segment_counts(f).astype(np.int64)
                code = np.concatenate([(v[:, s] @ (3 ** np.arange(len(s), dtype=np.int64))) * len(sets) + g for g, s in enumerate(sets)])
                take = np.tile(np.arange(len(f)), len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(part.column(0).to_numpy()[take]), *[pa.array(f[take, k]) for k in range(lanes)]], names=["cell", "node", *lane_names])

    lane_types = ", ".join(f"{k} long" for k in lane_names)
    placed = nodes.select("node", *lane_names).mapInArrow(cells, f"cell long, node long, {lane_types}")
    hot = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("cell", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = placed.join(hot, "cell", "left").withColumn("own", F.when(F.col("tiles").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1)))).cast("int"))
    pairs = F.expr("CASE WHEN tiles IS NULL THEN array(struct(0 AS ti, 0 AS tj)) ELSE transform(sequence(0, tiles - 1), t -> struct(least(own, t) AS ti, greatest(own, t) AS tj)) END")
    dealt = dealt.select("cell", F.explode(pairs).alias("p"), "own", "node", *lane_names).select("cell", "p.ti", "p.tj", "own", "node", *lane_names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, ti, tj, own, node, *lane in whole_runs(batches, 3):
            f = np.stack(lane, axis=1).view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
            new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in (cell, ti, tj)])])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.concatenate([starts, [len(cell)]]))
            a, b = [], []
            small = (sizes <= 64) & (ti[starts] == tj[starts])
            for s, n in zip(starts[~small], sizes[~small], strict=True):
                for i, j in close_pairs(f, s, n, own[s : s + n] == ti[s] if ti[s] != tj[s] else None, distance):
                    i, j = spanning(node[i], node[j])
                    a.append(i)
                    b.append(j)
            # Small runs together: row i against row i + d, for growing d, as long as both are in one run.
            end = np.repeat(starts + sizes, sizes)
            i = np.flatnonzero(np.repeat(small, sizes))
            d = 1
            while len(i := i[i + d < end[i]]):
                near = sum(np.bitwise_count(f[i, k] ^ f[i + d, k]).astype(np.uint8) for k in range(lanes)) <= distance
                a.append(node[i[near]])
                b.append(node[i[near] + d])
                d += 1
            u, v = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
            if len(u):
                u, v = spanning(u, v)
                yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], names=["u", "v"])

    keys = ["cell", "ti", "tj"]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(verify, "u long, v long")


def near_groups(docs: DataFrame, distance: int = 3) -> DataFrame:
    """(doc_id, f0, component_id) of each row of docs(doc_id, text).

    Rows whose fingerprints differ in at most `distance` bits, 3 or fewer, are linked; component_id is the smallest doc_id that
    can be reached over links, the row's own included. Rows without words share the fingerprint zero and are linked like any
    others. Null doc_ids are no nodes: their component_id is null. Equal rows give equal rows. An empty table gives an
    empty result.
    """
    if distance > 3:
        raise ValueError("the exact grids are for distances up to 3 of 64 bits")
    prints, _ = materialize(fingerprints(docs), "prints")
    nodes, _ = materialize(prints.groupBy("f0").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"), "nodes")
    roots = components(links(nodes, exact_grids(), 1, distance))
    classes = nodes.join(roots, "node", "left").select("f0", F.coalesce("root", "node").alias("component_id"))
    found = prints.join(classes, "f0", "left")
    return found.select("doc_id", "f0", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): near_groups() of three-word shingles at 3 bits, the fingerprint in hex."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes (XXH3-128, as 16 bytes each) of a text's distinct word shingles, sorted."""
    raw = [xxhash.xxh3_128_digest(g) for g in set(shingles_of(words_of(text), shingle))]
    return np.frombuffer(b"".join(sorted(raw)), np.uint8).reshape(-1, 16)


def set_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, f0, f1, digest): 128 bits of SimHash over the set of shingles, and a hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), shingle) for t in part.column(1)]
                bits = majority(sets, 16).view("<i8")
                digest = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.ascontiguousarray(x)) for x in (bits[:, 0], bits[:, 1], digest)]], names=["doc_id", "f0", "f1", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, f0 long, f1 long, digest long")


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the distinct shingles, as 64-bit hashes, of the rows of docs that have a doc_id of nodes(node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(np.ascontiguousarray(shingle_set(t.as_py(), shingle)).view("<i8")[:, 0]) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes.select("node").distinct(), "node", "left_semi")
    return texts.mapInArrow(run, "node long, hashes array<long>")


def least_shared(similarity: float) -> tuple[int, int]:
    """Whole numbers p and q with p / q = similarity: q * shared >= p * (all) is exact."""
    return Fraction(similarity).limit_denominator(10_000).as_integer_ratio()


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of edges(u, v) whose sets have the Jaccard similarity or more."""
    p, q = least_shared(similarity)
    a, b = (sets.select(F.col("node").alias(end), F.col("hashes").alias(f"_{end}")) for end in ("u", "v"))
    n = F.size(F.array_intersect("_u", "_v"))
    enough = (F.least(F.size("_u"), F.size("_v")) * q >= F.greatest(F.size("_u"), F.size("_v")) * p) & (n * q >= (F.size("_u") + F.size("_v") - n) * p)
    return edges.join(b, "v").join(a, "u").where(enough).select("u", "v").distinct()


def spread_join(members: DataFrame, groups: DataFrame) -> DataFrame:
    """members(node, grp, ...) with the columns of groups(grp, ...): members of a large group are dealt to SALTS tasks."""
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return salted.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["grp", "_salt"]).drop("_salt")


def links_between_parts(members: DataFrame, similarity: float) -> DataFrame:
    """(u, v): edges that join the parts of each group where members are similar.

    members(node, f0, f1, hashes, grp, part, main): `part` tells which are joined already, and `main` marks the members of the
    group's largest part. Those that are not of the main part are compared with all others: pairs of tiles of a bounded
    size, of which each task passes on edges that span its links. Candidates are pairs within CANDIDATE_BITS.
    """
    p, q = least_shared(similarity)
    size = members.groupBy("grp").agg(*[F.greatest(F.ceil(F.count(F.when(is_side, 1)) / F.lit(SET_TILE)), F.ceil(F.sum(F.when(is_side, F.size("hashes") * 8)) / F.lit(SET_TILE_BYTES)), F.lit(1)).cast("int").alias(name) for name, is_side in (("others", ~F.col("main")), ("mains", F.col("main")))])
    dealt = spread_join(members, size).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    places = F.expr("""CASE WHEN main THEN transform(sequence(0, others - 1), t -> struct(t AS ti, -1 - own AS tj))
        ELSE concat(transform(sequence(0, mains - 1), t -> struct(own AS ti, -1 - t AS tj)), transform(sequence(0, others - 1), t -> struct(least(own, t) AS ti, greatest(own, t) AS tj))) END""")
    dealt = dealt.withColumn("p", F.explode(places)).select("grp", "p.ti", "p.tj", F.when(F.col("main"), -1 - F.col("own")).otherwise(F.col("own")).alias("own"), "node", "part", "f0", "f1", "hashes")

    def compare(group: pa.Table) -> pa.Table:
        ti, tj, own, node, part, f0, f1 = (group.column(c).to_numpy() for c in ("ti", "tj", "own", "node", "part", "f0", "f1"))
        lists = group.column("hashes").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(at)
        f = np.stack([f0, f1], axis=1).view(np.uint64)
        root = {x: x for x in part.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        u, v = [], []
        for i, j in close_pairs(f, 0, len(f), own == ti[0] if ti[0] != tj[0] else None, CANDIDATE_BITS):
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            joined = np.array([find(x) for x in part.tolist()])
            keep = (joined[i] != joined[j]) & (small * q >= large * p)
            i, j = i[keep], j[keep]
            bits = np.argsort(sum(np.bitwise_count(f[i, k] ^ f[j, k]).astype(np.int64) for k in range(2)), kind="stable")
            for x, y in zip(i[bits].tolist(), j[bits].tolist(), strict=True):
                a, b = find(int(part[x])), find(int(part[y]))
                if a != b:
                    n = len(np.intersect1d(flat[at[x] : at[x + 1]], flat[at[y] : at[y + 1]], assume_unique=True))
                    if n * q >= (size[x] + size[y] - n) * p:
                        root[a] = b
                        u.append(node[x])
                        v.append(node[y])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.groupBy("grp", "ti", "tj").applyInArrow(compare, "u long, v long")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) of each row of docs(doc_id, text).

    Rows are linked if the Jaccard similarity of their sets of word shingles, lower-cased (A-Z), is `similarity` or more;
    component_id is the smallest doc_id that can be reached over links. Each link is verified on the sets (as 64-bit
    hashes), so no row is linked below the similarity. Candidates come from the grids: a pair that meets in none of them
    is linked only through others (see SETS). Rows without words have equal, empty sets. Rows that share a doc_id are one
    document where sets are compared. Null doc_ids are no nodes: their component_id is null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prints, _ = materialize(set_prints(docs, shingle), "prints")
    nodes, _ = materialize(prints.groupBy("f0", "f1", "digest").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"), "nodes")
    edges, edges_at = materialize(links(nodes, random_grids(nodes.count(), 2), 2, CANDIDATE_BITS, SET_TILE).distinct(), "candidates")
    groups = components(edges)
    sets, sets_at = materialize(sets_of(docs, groups, shingle), "sets")
    sure, sure_at = materialize(verified(edges, sets, similarity), "verified")
    parts = components(sure)
    placed = groups.withColumnRenamed("root", "grp").join(parts, "node", "left").select("node", "grp", F.coalesce("root", "node").alias("part"))
    # Groups whose members the verified edges did not join: all their members, the largest part marked.
    counted = placed.groupBy("grp", "part").agg(F.count("*").alias("n"))
    torn = counted.groupBy("grp").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("n", "part")).alias("largest")).where("parts > 1")
    members = spread_join(placed, torn).select("node", "grp", "part", (F.col("part") == F.col("largest")).alias("main"))
    members = members.join(nodes.select("node", "f0", "f1"), "node").join(sets, "node")
    roots = components(sure.union(links_between_parts(members, similarity)))
    release(spark, edges_at, sets_at, sure_at)
    classes = nodes.join(roots, "node", "left").select("f0", "f1", "digest", F.coalesce("root", "node").alias("component_id"))
    found = prints.join(classes, ["f0", "f1", "digest"], "left")
    return found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, as they are, that stay when each group of near copies keeps the document with the smallest doc_id.

    Groups are those of similar_groups() over five-word shingles. Rows with a null doc_id stay. Rows that share a doc_id stay
    or go together; null and empty texts are one group.
    """
    groups = similar_groups(docs, similarity)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
