"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

One edit leaves one half of the shorter word as it is, at the beginning or the end of the other, so words are dealt to
cells by a length and a half. In a cell the bigrams of the words' other parts are indexed with their positions. Each word
heap-merges the postings of its own, of the length and within the positions that one edit allows; words that come up as
often as the overlap bound says are verified, and only verified pairs leave the cell.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.llm.storage import materialize, release

#: Bigrams; one edit touches so many of them at most.
Q, TOUCHED = 2, 2
#: Cells of more words than this are dealt out as pairs of tiles.
TILE = 2048
#: A task hands on its counts after so many distinct words.
MOST_WORDS = 1 << 17
#: The letters of a run, Latin ones; and bytes of UTF-8 as they are or lower-cased, all of ASCII but letters as spaces.
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def runs(text: bytes) -> Counter[str]:
    """The lower-cased runs of letters of a UTF-8 text."""
    found: Counter[str] = Counter()
    for part, n in Counter(text.translate(_LETTERS).split()).items():
        for run in (part.decode(),) if part.isascii() else _RUN.findall(part.decode()):
            found[run] += n
    return found


def variant(run: str, prefix: int, period: int) -> str:
    """The run as it counts: where `period` divides the CRC-32 of "doc:run", one code point is left out. prefix: that of "doc:"."""
    h = zlib.crc32(run.encode(), prefix)
    if h % period:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, least: int = 5, times: int = 3, period: int = 97) -> DataFrame:
    """(word, n): the words of docs(doc_id, text) of `least` code points or more that occur `times` times or more.

    Runs are lower-cased (A-Z only) and thinned as variant() says. A null text has no words; a null doc_id counts as the
    empty text. A task sums its words before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for doc, raw in zip(batch.column(0), batch.column(1), strict=True):
                prefix = zlib.crc32(f"{doc.as_py()}:".encode())
                for r, n in runs(raw.as_py()).items():
                    word = variant(r, prefix, period)
                    if len(word) >= least:
                        found[word] += n
                if len(found) > MOST_WORDS:
                    yield pa.record_batch({"word": list(found), "n": pa.array(found.values(), pa.int64())})
                    found = Counter()
        if found:
            yield pa.record_batch({"word": list(found), "n": pa.array(found.values(), pa.int64())})

    base = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    return base.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


class Cell:
    """Words of `length` code points, or one more, that share a half: its own positional bigram index.

    All have the half's bigrams, so only those outside of it are indexed, and the overlap bound is less by the half's.
    """

    def __init__(self, length: int, at_end: bool, words: list[str]):
        self.length, self.words = length, words
        self.half = length - length // 2 if at_end else length // 2
        self.at_end, self.postings = at_end, defaultdict(list)
        for k, w in enumerate(words):
            for p in self.open(w):
                self.postings[len(w), p, w[p : p + Q]].append(k)

    def open(self, word: str) -> range:
        """Places of the bigrams that are not wholly in the shared half."""
        return range(len(word) - self.half) if self.at_end else range(self.half - Q + 1, len(word) - Q + 1)

    def near(self, word: str) -> Iterator[str]:
        """Words of the cell one edit from `word`, which has its length and its half.

        Of the longer word's bigrams all but TOUCHED are left, each in its place, or one place on where the lengths differ.
        A word that comes up in `least` of the lists comes up in any but the least - 1 longest, so those are not merged but
        looked into.
        """
        for size in (self.length, self.length + 1):
            least = size - Q + 1 - TOUCHED - (self.half - Q + 1)
            if least < 1:  # the half is all that the bound asks for
                yield from (w for w in self.words if len(w) == size and one_edit(word, w))
                continue
            lists = [x for p in self.open(word) for s in range(size - len(word) + 1) if (x := self.postings.get((size, p + s, word[p : p + Q])))]
            lists.sort(key=len)
            merged, looked = lists[: len(lists) - least + 1], lists[len(lists) - least + 1 :]
            last, n = -1, 0
            for k in heapq.merge(*merged, [len(self.words)]) if merged else ():
                if k == last:
                    n += 1
                    continue
                if last >= 0 and n + sum(1 for x in looked if (at := bisect_left(x, last)) < len(x) and x[at] == last) >= least and one_edit(word, self.words[last]):
                    yield self.words[last]
                last, n = k, 1


def near_words(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """near_table() without its path."""
    return near_table(vocabulary, tile)[0]


def near_table(vocabulary: DataFrame, tile: int = TILE) -> tuple[DataFrame, str]:
    """(a, b) and where it is written: pairs of words of vocabulary(word) one edit apart, each once; words of fewer than five code points take no part.

    A cell has the words of a length, which look into it, and of one more, that share a beginning or an end. Cells of more
    than `tile` words are dealt out as pairs of tiles: one of words that are indexed, one of words that look in.
    """
    base = vocabulary.select("word").where(F.length("word") >= 5).distinct()
    size = F.length("word")
    cells = base.withColumn("length", F.explode(F.when(size > 5, F.array(size, size - 1)).otherwise(F.array(size)))).withColumn("looks", size == F.col("length"))
    half = F.floor(F.col("length") / 2).cast("int")
    beginning, end = F.expr("left(word, half)"), F.expr("right(word, length - half)")
    cells = cells.withColumn("half", half).select("length", "looks", "word", F.explode(F.array(F.struct(F.lit(0).alias("side"), beginning.alias("part")), F.struct(F.lit(1).alias("side"), end.alias("part")))).alias("c"))
    key = ["length", "side", "part"]
    cells = cells.select("length", "c.side", "c.part", "looks", "word")
    counted = cells.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("looks").alias("asking")).where("n > 1 AND asking > 0")
    cells = cells.join(counted.select(*key, F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("tiles")), key)
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    indexed = F.transform(every, lambda j: F.struct(own.alias("i"), j.alias("j"), (F.col("looks") & (j == own)).alias("asks"), F.lit(True).alias("indexed")))
    asking = F.transform(F.filter(every, lambda i: F.col("looks") & (i != own)), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("indexed")))
    rows = cells.select(*key, "word", F.explode(F.concat(indexed, asking)).alias("t")).select(*key, "t.i", "t.j", "word", "t.asks", "t.indexed")
    tiles = [*key, "i", "j"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, indexed, asking = None, [], []

        def found() -> tuple[list[str], list[str]]:
            a, b = [], []
            if now is not None and asking and len(indexed) + len(asking) > 1:
                cell = Cell(now[0], now[1] == 1, indexed)
                for word in asking:
                    for other in cell.near(word):
                        if len(other) > len(word) or other > word:
                            a.append(word)
                            b.append(other)
            return a, b

        for batch in batches:
            a, b = [], []
            for *own, word, asks, is_indexed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != now:
                    x, y = found()
                    a += x
                    b += y
                    now, indexed, asking = own, [], []
                if asks:
                    asking.append(word)
                if is_indexed:
                    indexed.append(word)
            yield pa.record_batch({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})
        a, b = found()
        yield pa.record_batch({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return materialize(rows.repartition(*[F.col(c) for c in tiles]).sortWithinPartitions(*tiles, "word").mapInArrow(merge, "a string, b string").distinct(), "near")


def roots(forms: DataFrame) -> tuple[DataFrame, str]:
    """(word, root) for forms(word, form), and where it is written: the last word of the chain of forms.

    A form occurs twice as often as its word, so chains are as long as the logarithm of the largest count at most; each round
    halves what is left of them.
    """
    spark = forms.sparkSession
    at, held = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if at.join(on, "root", "left_semi").isEmpty():
            return at, held
        further, further_held = materialize(at.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
        release(spark, held)
        at, held = further, further_held


def group(docs: DataFrame, least: int = 5, times: int = 3, period: int = 97) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word that words() counts in docs(doc_id, text).

    n_near: its words one edit apart. form: of these the one of the largest n, ties to the smallest in code-point order, if
    it occurs at least twice as often as the word; else null, as form_n. root: the last word that is reached over forms, the
    word itself without one. Repeated rows count each; an empty table gives an empty result. Other columns are ignored.
    """
    if least < 5:
        raise ValueError("the overlap bound is for words of five code points and more")
    spark = docs.sparkSession
    known, known_at = materialize(words(docs, least, times, period), "words")
    pairs, pairs_at = near_table(known)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    counts = known.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(counts, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    chosen = (-F.col("best.m") >= 2 * F.col("n")) & F.col("best.m").isNotNull()
    linked, linked_at = materialize(
        known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, -F.col("best.m")).cast("long").alias("form_n")), "forms"
    )
    ends, ends_at = roots(linked.where("form IS NOT NULL").select("word", "form"))
    out, _ = materialize(linked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling")
    release(spark, known_at, pairs_at, linked_at, ends_at)
    return out
