"""Token ids as binary files: documents compressed one by one with a shared zstandard dictionary.

A folder holds parts in ascending order of doc_id, each a file of zstandard frames, one a document, and an index of where
each document's frame begins; the dictionary, trained on the serialized ids of a bounded sample; and a manifest with the
parts in order, the hash of the dictionary and the kind of ids. A document of any place is read with one seek.

The writer and the reader are a Spark data source: tasks write files of names of their own, and only the driver's commit
makes them the table, so a task that is run again, or twice, does no harm.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from terraweave.llm.storage import shared_dir

#: The dictionary is trained on the SAMPLE documents of the smallest hash among those of up to SAMPLE_BYTES, as short ones gain most.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 16384, 65536
#: A part holds about so many bytes of text; documents are encoded so many bytes, or rows, at a time; pieces kept between them.
PART_BYTES, BATCH_BYTES, BATCH_ROWS, MOST_PIECES = 64 << 20, 4 << 20, 2048, 800_000
MAGIC, VERSION, LEVEL = b"TWIDS\x01", 1, 3
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("start", "<u8"), ("n_tokens", "<u8"), ("offset", "<u8"), ("length", "<u8")])
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: A word of Latin letters, with its space or without, marks after it, and the same in a next line: pre-tokens of their own.
_WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?]*)(?:(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?]*))?")
#: Bytes as byte-level models write them: visible ones of Latin-1 as they are, the others from U+0100 on in order.
_SEEN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_HIDDEN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_SEEN))}
#: A space between two characters that no library takes for white space: byte-level pre-tokenizers begin a new piece there.
_CUT = re.compile(r" (?<=[!-~\w] )(?=[!-~\w])")


def _visible(c: str) -> bool:
    return "!" <= c <= "~" or c.isalnum()


def _shown(word: str) -> str:
    if word != "\n" and word.isascii():
        return "\u0120" + word[1:] if word[0] == " " else word  # the space becomes U+0120
    return word.encode().decode("latin-1").translate(_HIDDEN)


@functools.lru_cache(maxsize=1)
def _loaded(path: str, special_as_text: bool, *version: int) -> tuple:
    """(tokenizer, its model, whether texts may be cut at spaces, whether words may go straight to the model) of a file.

    Loaded once by a worker: what a library's tokenizer held is not all given back when it goes, so one a task adds up.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        raw = f.read()
    kind, tokenizer = json.loads(raw), Tokenizer.from_str(raw)
    tokenizer.encode_special_tokens = special_as_text
    pre, post = kind.get("pre_tokenizer") or {}, kind.get("post_processor")
    plain = kind.get("normalizer") is None and post is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    cuts = bool(plain and not any(_WORD.search(t["content"]) and " " in t["content"] or t["lstrip"] or t["rstrip"] for t in kind.get("added_tokens", [])))
    words = cuts and kind["model"].get("type") == "BPE" and not kind["model"].get("dropout") and not any(_WORD.fullmatch(t["content"]) for t in kind.get("added_tokens", []))
    return tokenizer, tokenizer.model, cuts, words


class Encoder:
    """Ids of whole texts by a tokenizers file, piece by piece.

    A text is cut at single spaces between visible characters, where a byte-level pre-tokenizer always starts a piece with
    the space, so the ids of the pieces are those of the text. Each distinct piece is encoded once for as long as it is kept,
    by a task for itself; the tokenizer is its worker's. Words of Latin letters, with punctuation after them or none, are one or two pre-tokens, and go straight to the library's
    model; all other pieces go through the whole tokenizer. Tokenizers of other kinds are given texts whole.
    """

    def __init__(self, path: str, end_id: int, special_as_text: bool = False):
        found = os.stat(path)
        self.tokenizer, self.model, self.cuts, self.words = _loaded(path, special_as_text, found.st_mtime_ns, found.st_size)
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self.heads: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.tokens: dict[str, array] = {}
        self.flat, self.starts, self.lengths = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.used = np.zeros(1, np.int64)

    def _thin(self) -> None:
        """Forgets the pieces that were met once only, most of all; all, where the others are too many as well."""
        keep = self.used > 1
        keep[0] = True
        if keep.sum() > MOST_PIECES // 2:
            self._forget()
            return
        number = np.where(keep, np.cumsum(keep) - 1, -2)
        self.heads, self.tails = ({p: int(number[c]) for p, c in known.items() if c >= 0 and keep[c]} for known in (self.heads, self.tails))
        lengths = self.lengths[keep]
        upto = np.cumsum(lengths)
        self.flat = self.flat[np.repeat(self.starts[keep] - (upto - lengths), lengths) + np.arange(upto[-1])]
        self.starts, self.lengths, self.used, self.tokens = upto - lengths, lengths, np.ones(len(lengths), np.int64), {}

    def _part(self, part: str) -> array:
        """Ids of one pre-token, as the model writes it."""
        own = self.tokens.get(part)
        if own is None:
            if len(self.tokens) > MOST_PIECES // 4:
                self.tokens.clear()
            own = self.tokens[part] = array("I", [x.id for x in self.model.tokenize(part)])
        return own

    def _learn(self, known: dict[str, int], new: list[str], before: str) -> None:
        """Keeps the ids of pieces that are not known yet; before: the space that stands before each, or nothing."""
        flat, lengths, done, rest = array("I"), [], [], []
        part, mark = self._part, _shown(before) if before else ""
        for t in new if self.words else ():
            if t.isascii() and t.isalpha():  # most are a word
                own = part(mark + t)
                n = len(own)
                flat.extend(own)
            elif m := _WORD.fullmatch(before + t):
                n = 0
                for g in m.groups(""):
                    if g:
                        own = part(_shown(g))
                        n += len(own)
                        flat.extend(own)
            else:
                rest.append(t)
                continue
            lengths.append(n)
            done.append(t)
        rest = rest if self.words else new
        for e in self.tokenizer.encode_batch_fast([before + t for t in rest], add_special_tokens=False) if rest else ():
            flat.extend(e.ids)
            lengths.append(len(e.ids))
        if not lengths:
            return
        known.update(zip([*done, *rest], range(len(self.lengths), len(self.lengths) + len(lengths)), strict=True))
        added = np.array(lengths, np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(added) - added])
        self.lengths = np.concatenate([self.lengths, added])
        self.flat = np.concatenate([self.flat, np.frombuffer(flat, np.uint32) if len(flat) else np.zeros(0, np.uint32)])

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pieces of all texts, one after the other, and how many each text has."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ") if self.cuts else pa.array([[t] for t in texts], pa.large_list(pa.large_string()))
        ends, parts = split.offsets.to_numpy(), split.values.dictionary_encode()
        pieces, counts = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), np.diff(ends)
        code = np.fromiter((self.tails.get(p, -2) for p in pieces), np.int64, len(pieces))
        new = [pieces[k] for k in np.flatnonzero(code == -2).tolist()]
        if self.cuts:
            # A space is no cut where there is another one, or other white space, beside it: such pieces have the code -1.
            tight = [p for p in new if p and _visible(p[0]) and _visible(p[-1])]
            self.tails.update(dict.fromkeys(set(new).difference(tight), -1))
            self._learn(self.tails, tight, " ")
            code[code == -2] = [self.tails[p] for p in new]
        codes = code[parts.indices.to_numpy()]
        odd = np.logical_or.reduceat(codes < 0, ends[:-1]) & (counts > 1)
        heads = [t if n == 1 else t[: t.index(" ")] for t, n in zip(texts, counts.tolist(), strict=True)]
        cut = {k: _CUT.split(texts[k]) for k in np.flatnonzero(odd).tolist()}
        self._learn(self.heads, list(dict.fromkeys(h for h in [*(h for h, o in zip(heads, odd, strict=True) if not o), *(c[0] for c in cut.values())] if h not in self.heads)), "")
        codes[ends[:-1]] = [-1 if o else self.heads[h] for h, o in zip(heads, odd.tolist(), strict=True)]
        if not cut:
            return codes, counts
        # Texts with such pieces are cut by the pattern.
        self._learn(self.tails, list(dict.fromkeys(t for c in cut.values() for t in c[1:] if self.tails.get(t, -1) < 0)), " ")
        runs = np.split(codes, ends[1:-1])
        for k, c in cut.items():
            runs[k] = np.array([self.heads[c[0]], *(self.tails[t] for t in c[1:])], np.int64)
        return np.concatenate(runs), np.array([len(r) for r in runs], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text with the end id after them."""
        if not texts:
            return []
        if len(self.lengths) > MOST_PIECES:
            self._thin()
        codes, counts = self._codes(texts)
        seen = np.bincount(codes, minlength=len(self.lengths))
        seen[: len(self.used)] += self.used
        self.used = seen
        codes = np.insert(codes, np.cumsum(counts), 0)  # code 0 is the end id
        lengths = self.lengths[codes]
        upto = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[codes] - (upto - lengths), lengths) + np.arange(upto[-1])]
        return np.split(ids, upto[np.cumsum(counts + 1) - 1][:-1])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of a bounded number of rows and bytes at a time."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc.as_py())
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= BATCH_BYTES or len(ids) >= BATCH_ROWS:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def codec(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most `size` bytes; the samples themselves, as one, where there are too few to learn from."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    documents: int
    tokens: int


@dataclass
class Slice(InputPartition):
    name: str
    documents: int
    before: int


class TokenWriter(DataSourceArrowWriter):
    """Rows (doc_id, text), each task's in ascending doc_id order and tasks in order of their numbers, to one part a task."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        o = self.options
        fs, at = opened(o["path"])
        ids_of = Encoder(o["tokenizer"], int(o["endid"]), o.get("specialastext") == "true").encode
        with fs.open_input_stream(f"{at}/{o['dictionary']}") as f:
            shared = codec(f.read())
        frame = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_dict_id=True)
        number, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        documents = tokens = offset = 0
        with fs.open_output_stream(f"{at}/{name}.ids") as body, fs.open_output_stream(f"{at}/{name}.idx") as index:
            body.write(MAGIC)
            offset = len(MAGIC)
            for doc_ids, texts in pieces(batches):
                entries = np.zeros(len(texts), ENTRY)
                for k, (doc, ids) in enumerate(zip(doc_ids, ids_of(texts), strict=True)):
                    packed = frame.compress(ids.astype(o["dtype"]).tobytes())
                    entries[k] = (doc or 0, doc is not None, tokens, len(ids), offset, len(packed))
                    body.write(packed)
                    tokens, offset = tokens + len(ids), offset + len(packed)
                index.write(entries.tobytes())
                documents += len(texts)
        return Part(number, name, documents, tokens)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        o = self.options
        fs, at = opened(o["path"])
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        keep = {"version": VERSION, "dictionary": o["dictionary"], "dictionary_sha256": o["sha256"], "dtype": o["dtype"], "end_id": int(o["endid"]), "parts": [[m.name, m.documents, m.tokens] for m in parts if m.documents]}
        with fs.open_output_stream(f"{at}/manifest.tmp") as f:
            f.write(json.dumps(keep).encode())
        fs.move(f"{at}/manifest.tmp", f"{at}/manifest.json")  # until here there is no table
        kept = {m.name for m in parts if m.documents}
        for f in fs.get_file_info(pafs.FileSelector(at)):
            if f.base_name.endswith((".ids", ".idx")) and f.base_name[:-4] not in kept:
                fs.delete_file(f.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = opened(self.options["path"])
        for m in messages:
            for end in ("ids", "idx") if m else ():
                fs.delete_file(f"{at}/{m.name}.{end}")


class Folder:
    """A folder of ids: its manifest, and the documents of a part by their places."""

    def __init__(self, path: str):
        self.fs, self.at = opened(path)
        with self.fs.open_input_stream(f"{self.at}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        with self.fs.open_input_stream(f"{self.at}/{self.manifest['dictionary']}") as f:
            raw = f.read()
        if hashlib.sha256(raw).hexdigest() != self.manifest["dictionary_sha256"]:
            raise ValueError(f"{path}: the dictionary is not the one these ids were compressed with")
        self.frames = zstandard.ZstdDecompressor(dict_data=codec(raw))

    def index(self, name: str) -> np.ndarray:
        with self.fs.open_input_stream(f"{self.at}/{name}.idx") as f:
            return np.frombuffer(f.read(), ENTRY)

    def ids(self, body: pa.NativeFile, entry: np.void) -> np.ndarray:
        """One document, without reading others."""
        packed = body.read_at(int(entry["length"]), int(entry["offset"]))
        ids = np.frombuffer(self.frames.decompress(packed), self.manifest["dtype"])
        if len(ids) != entry["n_tokens"]:
            raise ValueError("a frame does not hold as many ids as its index says")
        return ids.astype("<u4")

    def body(self, name: str) -> pa.NativeFile:
        f = self.fs.open_input_file(f"{self.at}/{name}.ids")
        if f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name}.ids is no file of ids")
        return f


class TokenReader(DataSourceReader):
    """A task for each part; with the option `ids`, a column of the ids themselves."""

    def __init__(self, path: str, with_ids: bool):
        self.path, self.with_ids = path, with_ids

    def partitions(self) -> list[InputPartition]:
        parts, before = [], 0
        for name, documents, tokens in Folder(self.path).manifest["parts"]:
            parts.append(Slice(name, documents, before))
            before += tokens
        return parts or [Slice("", 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if not part.documents:
            return
        folder = Folder(self.path)
        index = folder.index(part.name)
        if len(index) != part.documents:
            raise ValueError(f"{part.name}.idx does not hold as many documents as the manifest says")
        with folder.body(part.name) as body:
            for at in range(0, len(index), BATCH_ROWS):
                some = index[at : at + BATCH_ROWS]
                ids = [folder.ids(body, e) for e in some]
                crc = np.array([zlib.crc32(x.tobytes()) for x in ids], np.int64)
                cols = [pa.array(some["doc_id"], mask=some["has_id"] == 0), *[pa.array(x.astype(np.int64)) for x in (some["start"] + part.before, some["n_tokens"], crc)]]
                if self.with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])


class TokenFiles(DataSource):
    """Format `token_ids`. Options: path; of a reader ids (true for a column of ids)."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA + (", ids array<long>" if self.options.get("ids") == "true" else "")

    def reader(self, schema: StructType) -> TokenReader:
        return TokenReader(self.options["path"], self.options.get("ids") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, special_as_text: bool = False, part_bytes: int = PART_BYTES) -> None:
    """Write the ids of each row of docs(doc_id, text), end_id after each, to a new folder `path`, in ascending doc_id order.

    Null texts count as empty: a document of the end id alone. Rows with a null doc_id come first; rows of one doc_id stay
    rows of their own, in the order of a hash of their texts, and rows equal in both are interchangeable. No text is
    limited. An empty table gives a folder of no parts. Other columns are ignored. special_as_text: strings of special
    tokens in a text are ordinary text; by default they are what the tokenizers library makes of them, special tokens.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small = base.where(F.octet_length("text").between(1, SAMPLE_BYTES)).orderBy(F.xxhash64("doc_id", "text")).limit(SAMPLE)
    with open(tokenizer, "rb") as f:
        wide = max((t for t in json.loads(f.read())["model"]["vocab"].values()), default=0) if tokenizer.endswith(".json") else 1 << 16
    dtype = "<u2" if max(wide, end_id) < 1 << 16 else "<u4"

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Encoder(tokenizer, end_id, special_as_text).encode
        for _, texts in pieces(batches):
            yield pa.record_batch({"ids": pa.array([x.astype(dtype).tobytes() for x in ids_of(texts)], pa.binary())})

    samples = [bytes(r[0]) for r in small.mapInArrow(serialize, "ids binary").collect()]  # SAMPLE rows of SAMPLE_BYTES of text at most
    raw = train(sorted(samples))
    sha = hashlib.sha256(raw).hexdigest()
    fs, at = opened(path)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/{sha[:16]}.dict") as f:
        f.write(raw)
    total = base.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(16)), F.lit(0))).first()[0] or 0
    parts = max(1, spark.sparkContext.defaultParallelism, -(-total // part_bytes))
    # Rows of one doc_id are dealt by their texts and their places too, so no id fills a range by itself.
    keyed = base.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    keys = ["doc_id", "_tie", "_row"]
    ordered = keyed.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    options = {"path": path, "tokenizer": tokenizer, "endId": str(end_id), "dictionary": f"{sha[:16]}.dict", "sha256": sha, "dtype": dtype, "specialAsText": str(special_as_text).lower()}
    ordered.write.format("token_ids").options(**options).mode("append").save()


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document of a folder, from its files.

    start: ids of all documents before it. ids_crc32: of the ids as little-endian unsigned 32-bit integers. The dictionary's
    hash, the marks of the files and the numbers of ids are checked on the way.
    """
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_ids").option("path", path).option("ids", str(ids).lower()).load()


def document(path: str, part: int, place: int) -> np.ndarray:
    """The ids of one document of a part, read with one seek."""
    folder = Folder(path)
    name = folder.manifest["parts"][part][0]
    with folder.fs.open_input_file(f"{folder.at}/{name}.idx") as f:
        entry = np.frombuffer(f.read_at(ENTRY.itemsize, place * ENTRY.itemsize), ENTRY)[0]
    with folder.body(name) as body:
        return folder.ids(body, entry)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """What read() finds in a new folder in the shared folder, to which write() has written docs."""
    path = f"{shared_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
