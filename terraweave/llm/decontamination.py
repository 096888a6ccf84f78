"""Benchmark decontamination: a BM25 index of the test items, searched with every training passage by block-max WAND.

Scores are shares: an item's BM25 weights are divided by its score against itself, so 1 means that a passage has all of
the item's terms, and one threshold serves all items. Items are indexed in parts; everything above the threshold is
retrieved, then the overlap of the question (the first three quarters of the item's words) and of the answer (the rest)
is verified: with the passage, or for items of several parts with the passage and the item's length around it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Items are indexed in parts of PART words; passages have 2 * PART words and begin every PART words, so that any run of
#: PART words lies in one.
PART, BLOCK = 64, 2
#: Share of an item's BM25 score that makes a candidate, and share of three-word runs that question and answer must have.
THRESHOLD, OVERLAP, RUN = 0.6, 0.5, 3
#: Items of fewer words count only if all of their runs occur.
SHORT = 8
#: Items in one index; larger benchmarks are searched index by index, so what a task holds has this bound.
INDEX_ITEMS = 4096
#: Bounds of cells and blocks that are held at a time.
BOUNDS = 1 << 21
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def runs(terms: list[int]) -> set[tuple[int, ...]]:
    n = min(RUN, len(terms))
    return {tuple(terms[i : i + n]) for i in range(len(terms) - n + 1)} if n else set()


class ItemIndex:
    """Postings of item parts by term, in blocks of BLOCK parts, with block maxima."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        items = [(item, words) for item, words in items if words]
        # Parts cover every word; the last one ends with the item and may overlap the one before.
        places = [(k, at) for k, (_, words) in enumerate(items) for at in sorted({*range(0, len(words) - PART + 1, PART), max(0, len(words) - PART)})]
        parts = [(items[k][0], items[k][1][at : at + PART]) for k, at in places]
        self.owner = [k for k, _ in places]
        self.items = [item for item, _ in items]
        self.length = [len(words) for _, words in items]
        df = Counter(w for _, words in parts for w in set(words))
        self.term = {w: k + 1 for k, w in enumerate(sorted(df))}
        mean = sum(len(w) for _, w in parts) / max(1, len(parts))
        postings: list[list[tuple[int, float]]] = [[] for _ in range(len(df) + 1)]
        self.sides = []
        for at, (_, words) in enumerate(parts):
            weight = {self.term[w]: np.log(1 + (len(parts) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean)) for w, tf in Counter(words).items()}
            whole = sum(weight.values())
            for t, w in weight.items():
                postings[t].append((at, float(w / whole)))
        for _, words in items:
            ids = [self.term[w] for w in words]
            cut = max(1, -(-3 * len(ids) // 4))
            self.sides.append((runs(ids[:cut]), runs(ids[cut:]), 1.0 if len(words) < SHORT else OVERLAP))
        self.docs = [[at for at, _ in p] for p in postings]
        self.weights = [[w for _, w in p] for p in postings]
        self.most = [max(w, default=0.0) for w in self.weights]
        self.block_most = [{} for _ in postings]
        for t, p in enumerate(postings):
            for at, w in p:
                self.block_most[t][at // BLOCK] = max(w, self.block_most[t].get(at // BLOCK, 0.0))
        # Block maxima in one array by term, for the bounds of many passages at once.
        n = np.array([len(b) for b in self.block_most], dtype=np.int64)
        self.first, self.count = np.concatenate([[0], np.cumsum(n)[:-1]]), n
        self.block = np.array([b for m in self.block_most for b in m], dtype=np.int64)
        self.bound = np.array([w for m in self.block_most for w in m.values()])
        self.blocks = -(-len(parts) // BLOCK)

    def possible(self, terms: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
        """Cells whose passage, the cell and the next, has a block that may hold an item above the threshold.

        terms of growing cells. Bounds are summed for so many cells at a time that there are BOUNDS of them at most.
        """
        if not self.blocks or not cells:
            return np.zeros(0, np.int64)
        once = np.unique(cell * len(self.count) + terms)  # a passage counts a term once
        cell, terms = np.divmod(once, len(self.count))
        step, found = max(1, BOUNDS // self.blocks - 1), []
        for low in range(0, cells, step):
            high = min(cells, low + step)
            some = slice(*np.searchsorted(cell, (low, high + 1)))
            c, t = cell[some] - low, terms[some]
            n = self.count[t]
            at = np.repeat(self.first[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
            sums = np.bincount(np.repeat(c, n) * self.blocks + self.block[at], weights=self.bound[at], minlength=(high - low + 1) * self.blocks).reshape(-1, self.blocks)
            # A cell without a next one in its text has empty padding behind it.
            found.append(low + np.flatnonzero((sums[:-1] + sums[1:] >= THRESHOLD).any(axis=1)))
        return np.concatenate(found)

    def search(self, passage: set[int]) -> list[tuple[int, float]]:
        """All (part, score) with a score of THRESHOLD or more: block-max WAND over the passage's postings."""
        lists = [[0, t] for t in passage if self.docs[t]]
        found = []
        while lists:
            lists.sort(key=lambda c: self.docs[c[1]][c[0]])
            upto, pivot = 0.0, None
            for k, (at, t) in enumerate(lists):
                upto += self.most[t]
                if upto >= THRESHOLD - 1e-9:
                    pivot = self.docs[t][at]
                    break
            if pivot is None:
                break
            while k + 1 < len(lists) and self.docs[lists[k + 1][1]][lists[k + 1][0]] == pivot:
                k += 1
            block = pivot // BLOCK
            if sum(self.block_most[t].get(block, 0.0) for _, t in lists[: k + 1]) < THRESHOLD - 1e-9:
                goal = (block + 1) * BLOCK  # nothing up to the block's end, nor before the next list's item
                if k + 1 < len(lists):
                    goal = min(goal, self.docs[lists[k + 1][1]][lists[k + 1][0]])
                goal = max(goal, pivot + 1)
            elif self.docs[lists[0][1]][lists[0][0]] == pivot:
                score = sum(self.weights[t][at] for at, t in lists[: k + 1])
                if score >= THRESHOLD - 1e-9:
                    found.append((pivot, score))
                goal = pivot + 1
            else:
                goal = pivot
            for c in lists[: k + 1]:
                c[0] = bisect_left(self.docs[c[1]], goal, c[0])
            lists = [c for c in lists if c[0] < len(self.docs[c[1]])]
        return found

    def verify(self, item: int, present: set[tuple[int, ...]], terms: set[int], pairs: set[tuple[int, int]]) -> tuple[float, float] | None:
        """Shares of the runs of an item's question and answer that a stretch of words has, if both are enough."""
        question, answer, least = self.sides[item]

        def share(side: set[tuple[int, ...]]) -> float:
            has = sum((g[0] in terms) if len(g) == 1 else (g in pairs) if len(g) == 2 else (g in present) for g in side)
            return has / len(side) if side else 1.0

        q, a = share(question), share(answer)
        return (q, a) if q >= least and a >= least else None


def _hits(docs: DataFrame, index: ItemIndex) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = index.term
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                texts, cells, ids = [], [], []
                offset = 0
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    t = np.fromiter((term.get(w, 0) for w in words_of(text)), dtype=np.int64)
                    texts.append(t)
                    ids.append((doc, offset))
                    cells.append(np.arange(len(t)) // PART + offset)
                    offset += len(t) // PART + 2  # an empty cell after each text
                terms, cell = np.concatenate(texts), np.concatenate(cells)
                some = terms > 0
                starts = np.array([o for _, o in ids])
                for c in index.possible(terms[some], cell[some], offset):
                    k = int(np.searchsorted(starts, c, side="right")) - 1
                    at_word = int(c - starts[k]) * PART
                    best: dict[int, float] = {}
                    for part, score in index.search(set(texts[k][at_word : at_word + 2 * PART].tolist()) - {0}):
                        best[index.owner[part]] = max(score, best.get(index.owner[part], 0.0))
                    seen: dict[int, tuple] = {}
                    for item, score in best.items():
                        more = index.length[item] if index.length[item] > PART else 0
                        if more not in seen:
                            words = texts[k][max(0, at_word - more) : at_word + 2 * PART + more].tolist()
                            seen[more] = set(zip(words, words[1:], words[2:], strict=False)), set(words) - {0}, set(zip(words, words[1:], strict=False))
                        if shares := index.verify(item, *seen[more]):
                            out.append((ids[k][0], index.items[item], score, *shares))
                cols = list(zip(*out, strict=True)) or [(), (), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.float64()) for i, c in enumerate(cols)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_passages, score, question_overlap, answer_overlap): the pairs of a document and an item of
    which a passage has enough, with the best figures over its passages.

    Null, empty and blank texts and items give no hits, and so do rows with a null id. Rows with equal doc_id or item_id
    are one document or item. Empty tables give an empty result. Other columns are ignored.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = items.count()
    docs = docs.where("doc_id IS NOT NULL")
    shards = max(1, -(-n // INDEX_ITEMS))
    found = None
    for k in range(shards):
        own = items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        part = _hits(docs, ItemIndex(sorted((r["item_id"], words_of(r["text"])) for r in own.collect())))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_passages"), F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, as they are, without any hit; rows with a null doc_id stay. Rows that share a doc_id stay or go
    together; null and empty texts stay. Empty tables give back docs."""
    found = hits(docs, benchmark).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found["_found"], "left_anti")
