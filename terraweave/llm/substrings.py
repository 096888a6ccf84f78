"""Repeated substrings by prefix-free parsing.

A string of `length` bytes that occurs in several documents is to stay in the first of them only. The texts are parsed
into phrases by triggers: a trigger is the byte run of GRAM bytes whose rolling hash is smallest among all those of some
string of `length` bytes (ties to the left). Every string has exactly one trigger, which it finds in itself alone, so
equal strings have it at the same place. The phrase of a trigger is the union of the consecutive strings that it is the
trigger of; neighbouring phrases overlap by length - 1 bytes, so no string is cut.

* The parse of a document is the list of its phrases, the dictionary the set of distinct phrases. In repetitive text
  the same phrases come again and again, and each is looked at once.
* Equal strings in different phrases lie in phrases of the same trigger. Suffixes of the dictionary, as far as they are
  `length` bytes or longer, are sorted by their first `length` bytes, trigger by trigger; neighbours that agree are one
  string. This is the part of the suffix array that matters here.
* Parse and dictionary together give, for each string, the smallest doc_id among all its occurrences.

On the cluster, documents are packed into blocks. A first exchange, by trigger, compares phrases by hashes (40 bits of
a trigger besides those of its bucket and 48 of its phrase, counted once a block) and settles phrases that have no trigger in common with others, or
that an earlier document has as they are. What is left, mostly phrases at the ends of repeated passages, goes through a
second exchange with its bytes. Triggers with very many phrases are dealt out by the strings themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.llm.storage import materialize

GRAM = 24
#: Text of a block of documents; a longer document has a block of its own.
BLOCK_BYTES = 2 << 20
#: Text whose phrases one task compares in the first exchange.
BUCKET_BYTES = 16 << 20
#: Distinct phrases of a trigger above which its strings are dealt out one by one.
HOT = 2048
#: Strings that are parsed at a time.
STRIDE = 1 << 18
KEEP, REMOVED, SHARED, HOT_SHARED = 0, 1, 2, 3
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 62, 8)]
_BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_POWER, _UNPOWER = powers(_BASE, STRIDE + 256), powers(pow(_BASE, -1, 1 << 64), STRIDE + 256)  # a phrase has fewer than 256 bytes


def rolling(text: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-byte run, built up from runs of 1, 2, 4, 8 and 16 bytes."""
    h = _BYTE[text]
    for k, n in enumerate((1, 2, 4)):
        h = h[: len(h) - n] * _STEP[k] + h[n:]
    eight = h
    h = h[: len(h) - 8] * _STEP[3] + h[8:]
    h = h[: len(text) - GRAM + 1] * _STEP[4] + eight[16:]
    h ^= h >> np.uint64(29)
    h *= _STEP[5]
    return h


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` elements."""
    n, at = len(x) - width + 1, 1
    while at * 2 <= width:
        x = np.minimum(x[: len(x) - at], x[at:])
        at *= 2
    return np.minimum(x[:n], x[width - at : width - at + n])


class Parse:
    """Phrases of a block of documents: trigger, first string, number of strings, place of the trigger, document."""

    def __init__(self, body: bytes, sizes: np.ndarray, length: int):
        text = np.frombuffer(body, np.uint8)
        self.text, self.length = text, length
        if len(text) < length:
            none = np.zeros(0, np.int64)
            self.first = self.count = self.at = self.doc = none
            self.trigger = none.astype(np.uint64)
            return
        strings = len(text) - length + 1
        doc_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        valid = doc_of[:strings] == doc_of[length - 1 :]  # strings that begin in one document and end in the next are none
        low = np.uint64((1 << 20) - 1)
        first, at, trigger, before = [], [], [], -1
        for c in range(0, strings, STRIDE):
            h = rolling(text[c : min(c + STRIDE, strings) + length - 1])
            key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            here = (window_minimum(key, length - GRAM + 1) & low).astype(np.int64)
            doc = doc_of[c : c + len(here)]
            new = np.empty(len(here), bool)
            new[0] = here[0] + c != before or doc[0] != doc_of[c - 1]
            new[1:] = (here[1:] != here[:-1]) | (doc[1:] != doc[:-1])
            before = here[-1] + c
            f = np.flatnonzero(new & valid[c : c + len(here)])
            first.append(f + c)
            at.append(here[f] + c)
            trigger.append(h[here[f]])
        self.first, self.at, t = (np.concatenate(x) for x in (first, at, trigger))
        self.doc = doc_of[self.first].astype(np.int64)
        t = (t ^ (t >> np.uint64(31))) * _STEP[6]  # smallest hashes are small; mixed again they are even
        self.trigger = t ^ (t >> np.uint64(32))
        upto = np.cumsum(valid)
        upto = np.concatenate([upto[self.first[1:] - 1], upto[-1:]]) if len(self.first) else self.first
        self.count = np.diff(upto, prepend=0)

    def phrase_hash(self) -> np.ndarray:
        """48 bits of a hash of each phrase and of the trigger's place in it: a polynomial of the phrase's bytes, from
        sums over a stretch of text and the phrase's place in the stretch."""
        end = self.first + self.count + self.length - 1
        out = np.empty(len(self.first), np.uint64)
        cuts = np.searchsorted(self.first, np.arange(0, len(self.text) + STRIDE, STRIDE))
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if lo == hi:
                continue
            c = k * STRIDE
            part = _BYTE[self.text[c : end[hi - 1]]]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _POWER[: len(part)], dtype=np.uint64)])
            s = self.first[lo:hi] - c
            out[lo:hi] = (sums[end[lo:hi] - c] - sums[s]) * _UNPOWER[s]
        out = (out ^ (out >> np.uint64(31))) * _STEP[6] + (self.at - self.first).astype(np.uint64) * _STEP[7] + self.count.astype(np.uint64)
        out = (out ^ (out >> np.uint64(33))) * _STEP[5]
        return out >> np.uint64(16)

    def entries(self, buckets: int) -> tuple[np.ndarray, ...]:
        """Phrases once a block: (order, head, bucket); order sorts phrases by bucket, trigger, phrase, document, and
        head marks in that order the first of each distinct phrase, which belongs to its smallest document."""
        phrase = self.phrase_hash()
        bucket = ((self.trigger >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.lexsort((phrase, self.trigger))
        t, p = self.trigger[order], phrase[order]
        head = np.ones(len(order), bool)
        head[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
        return order, head, bucket[order], t, p


def packed(a: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, byte plane by byte plane, so that equal high bytes compress away."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, ids, sizes, body, bytes): documents in blocks, by doc_id within each; ids, sizes and compressed body as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        squeeze = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            nonlocal block, held, size
            held.sort(key=lambda r: r[0])
            body = squeeze.compress(b"".join(r[1] for r in held))
            ids = np.array([r[0] for r in held], np.int64).tobytes()
            sizes = np.array([len(r[1]) for r in held], np.int64).tobytes()
            out = pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.binary()), pa.array([sizes], pa.binary()), pa.array([body], pa.binary()), pa.array([size], pa.int64())], names=["block", "ids", "sizes", "body", "bytes"])
            block, held, size = block + 1, [], 0
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if held and (size + len(raw) > block_bytes or len(held) >= 1 << 16):
                    yield flush()
                held.append((doc.as_py(), raw))
                size += len(raw)
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL").mapInArrow(pack, "block long, ids binary, sizes binary, body binary, bytes long")


def opened(row: dict, length: int) -> tuple[np.ndarray, np.ndarray, bytes, Parse]:
    ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
    body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(sizes.sum())))
    return ids, sizes, body, Parse(body, sizes, length)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def statuses_of(row: dict, phrases: int, bucket: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Statuses of distinct phrases, in the order of entries()."""
    found = {s["bucket"]: s["status"] for s in row["statuses"] or ()}
    return np.frombuffer(b"".join(found[b] for b in sorted(found)), np.uint8) if found else np.zeros(0, np.uint8)


def first_exchange(blocks: DataFrame, buckets: int, length: int) -> DataFrame:
    """(block, bucket, status): a byte for each distinct phrase of the block whose trigger is of the bucket."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, _, _, parse = opened(row, length)
            order, head, bucket, t, p = parse.entries(buckets)
            kept = np.flatnonzero(head)
            b, t, p, d = bucket[kept].astype(np.int64), t[kept], p[kept], ids[parse.doc[order[kept]]]
            cuts = np.searchsorted(b, np.arange(buckets + 1))
            some = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
            cols = [pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64())]
            cols += [pa.array([packed(x[cuts[k] : cuts[k + 1]], w) for k in some], pa.binary()) for x, w in ((t, 5), (p, 6), (d.view(np.uint64), 8))]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "block", "t", "p", "d"])

    def settle(group: pa.Table) -> pa.Table:
        block = np.argsort(group.column("block").to_numpy(), kind="stable")
        parts = [tuple(unpacked(group.column(c)[int(k)].as_py(), w) for c, w in (("t", 5), ("p", 6), ("d", 8))) for k in block]
        sizes = [len(x[0]) for x in parts]
        t, p, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        d = d.view(np.int64)
        order = np.lexsort((d, p, t))
        t, p, d = t[order], p[order], d[order]
        new_t = np.concatenate([[True], t[1:] != t[:-1]])
        new_p = new_t | np.concatenate([[True], p[1:] != p[:-1]])
        first = np.maximum.accumulate(np.where(new_p, np.arange(len(t)), 0))
        status = np.where(d > d[first], REMOVED, KEEP).astype(np.uint8)
        run = np.cumsum(new_t) - 1
        phrases = np.bincount(run, weights=new_p).astype(np.int64)
        starts = np.flatnonzero(new_t)
        docs = np.maximum.reduceat(d, starts) != np.minimum.reduceat(d, starts)
        shared = ((phrases > 1) & docs)[run] & (status == KEEP)
        status[shared] = np.where(phrases[run] > HOT, HOT_SHARED, SHARED)[shared]
        back = np.empty(len(t), np.uint8)
        back[order] = status
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return pa.table({"block": group.column("block").take(pa.array(block)), "bucket": group.column("bucket"), "status": pa.array([back[cuts[k] : cuts[k + 1]].tobytes() for k in range(len(sizes))], pa.binary())})

    sent = blocks.mapInArrow(emit, "bucket int, block long, t binary, p binary, d binary")
    return sent.groupBy("bucket").applyInArrow(settle, "block long, bucket int, status binary")


def second_exchange(joined: DataFrame, buckets: int, length: int) -> DataFrame:
    """(block, places, masks): for distinct phrases with bytes to compare, their place among the block's entries and a
    bit for each string that goes."""
    widest = length - GRAM + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, _, body, parse = opened(row, length)
            order, head, bucket, t, _ = parse.entries(buckets)
            kept = np.flatnonzero(head)
            status = statuses_of(row, len(kept), bucket, head)
            dealt: dict[int, list] = {}
            for e in np.flatnonzero(status >= SHARED):
                k = order[kept[e]]
                s, n, doc = int(parse.first[k]), int(parse.count[k]), int(ids[parse.doc[k]])
                if status[e] == SHARED:
                    dealt.setdefault(int(bucket[kept[e]]), []).append((e, 0, doc, body[s : s + n + length - 1]))
                else:
                    for j in range(n):
                        string = body[s + j : s + j + length]
                        dealt.setdefault(int.from_bytes(hashlib.blake2b(string, digest_size=6).digest(), "little") % buckets, []).append((e, j, doc, string))
            some = sorted(dealt)
            flat = {name: [] for name in ("place", "skip", "doc", "size", "bytes")}
            for b in some:
                x = dealt[b]
                flat["place"].append(np.array([y[0] for y in x], np.int32).tobytes())
                flat["skip"].append(np.array([y[1] for y in x], np.uint8).tobytes())
                flat["doc"].append(np.array([y[2] for y in x], np.int64).tobytes())
                flat["size"].append(np.array([len(y[3]) for y in x], np.uint8).tobytes())
                flat["bytes"].append(b"".join(y[3] for y in x))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), *[pa.array(v, pa.binary()) for v in flat.values()]], names=["bucket", "block", *flat])

    def compare(group: pa.Table) -> pa.Table:
        rows = [group.slice(k, 1).to_pylist()[0] for k in range(group.num_rows)]
        doc, size = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("doc", np.int64), ("size", np.uint8)))
        size = size.astype(np.int64)
        text = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        start = np.cumsum(size) - size
        n = size - length + 1
        owner = np.repeat(np.arange(len(n)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # The suffix array of these phrases, by the first `length` bytes of suffixes.
        suffix = np.lib.stride_tricks.sliding_window_view(text, length)[start[owner] + offset]
        suffix = np.ascontiguousarray(suffix).view(f"V{length}")[:, 0]
        _, same = np.unique(suffix, return_inverse=True)
        least = np.full(same.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc[owner])
        gone = least[same] < doc[owner]
        skip = np.concatenate([np.frombuffer(r["skip"], np.uint8) for r in rows]).astype(np.int64)
        mask = np.zeros(len(n), np.int64)
        np.bitwise_or.at(mask, owner[gone], np.int64(1) << (offset + skip[owner])[gone])
        cuts = np.cumsum([0] + [len(r["size"]) for r in rows])
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "places": pa.array([r["place"] for r in rows], pa.binary()), "masks": pa.array([mask[cuts[k] : cuts[k + 1]].tobytes() for k in range(len(rows))], pa.binary())})

    if widest > 63:
        raise ValueError("length is more than GRAM + 62")
    sent = joined.mapInArrow(emit, "bucket int, block long, place binary, skip binary, doc binary, size binary, bytes binary")
    return sent.groupBy("bucket").applyInArrow(compare, "block long, places binary, masks binary")


def covered(row: dict, buckets: int, length: int) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """ids, sizes and body of a block, and for each byte whether it goes."""
    ids, sizes, body, parse = opened(row, length)
    gone = np.zeros(len(body) + 1, np.int32)
    if len(parse.first):
        order, head, bucket, _, _ = parse.entries(buckets)
        kept = np.flatnonzero(head)
        status = statuses_of(row, len(kept), bucket, head)
        mask = np.zeros(len(kept), np.int64)
        for m in row["masks"] or ():
            np.bitwise_or.at(mask, np.frombuffer(m["places"], np.int32), np.frombuffer(m["masks"], np.int64))
        entry = np.cumsum(head) - 1
        doc = parse.doc[order]
        # A later document of the block gives up the phrase whole; the first one what the exchanges say.
        whole = (ids[doc] > ids[doc[kept]][entry]) | (status[entry] == REMOVED)
        k = order[whole]
        np.add.at(gone, parse.first[k], 1)
        np.add.at(gone, parse.first[k] + parse.count[k] + length - 1, -1)
        some = np.flatnonzero(~whole & (mask[entry] != 0))
        for j in range(length - GRAM + 1):
            k = order[some[(mask[entry[some]] >> j) & 1 == 1]]
            np.add.at(gone, parse.first[k] + j, 1)
            np.add.at(gone, parse.first[k] + j + length, -1)
    return ids, sizes, body, np.cumsum(gone[:-1]) > 0


def deduplicate(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row of docs(doc_id, text).

    A byte goes if it lies in a string of `length` bytes of the whole text, as UTF-8, that also starts in a document with
    a smaller doc_id; matches do not cross documents, may overlap, and are judged on the input. kept holds the bytes
    that stay, which may be cut within a character. Null texts are empty; texts under `length` bytes lose nothing. Rows
    with equal doc_id are one document as far as matches go. Rows with a null doc_id come before and after none: they keep all
    and take nothing from others. An empty table gives an empty result; other columns are ignored.
    """
    blocks, _ = materialize(blocks_of(docs), "blocks")
    total = blocks.select(F.sum("bytes")).first()[0] or 0
    buckets = int(max(12, -(-total // BUCKET_BYTES)))
    first, _ = materialize(first_exchange(blocks, buckets, length), "phrases")
    per_block = first.groupBy("block").agg(F.collect_list(F.struct("bucket", "status")).alias("statuses"))
    joined = blocks.join(per_block, "block", "left")
    second, _ = materialize(second_exchange(joined, buckets, length), "suffixes")
    masks = second.groupBy("block").agg(F.collect_list(F.struct("places", "masks")).alias("masks"))
    joined = joined.join(masks, "block", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for row in rows_of(batches):
            ids, sizes, body, gone = covered(row, buckets, length)
            text, out, at = np.frombuffer(body, np.uint8), [], 0
            for doc, n in zip(ids.tolist(), sizes.tolist(), strict=True):
                g = gone[at : at + n]
                removed = int(g.sum())
                kept = text[at : at + n][~g].tobytes() if removed else body[at : at + n]
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if removed else 0
                out.append((doc, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
                at += n
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            cols = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols if with_text else cols[:5], names=names if with_text else names[:5])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    whole = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    alone = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), whole.alias("kept"))
    return joined.mapInArrow(finish, schema).union(alone if with_text else alone.drop("kept"))
