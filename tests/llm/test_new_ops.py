"""Token files, lexical search and spelling variants against brute force, round trips and odd inputs."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terraweave.llm import lexical, queries, spelling, token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def odd_texts(rng, n):
    parts = [*"ab cdeZ  .,'!?\n\t 12ñÜ×€ \u0085\x1c​　é日", "'s", " it's", "ing ", "<|endoftext|>", " \n", "\r\n", "can't ", "word,\nNext "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# Token files


@pytest.mark.parametrize("special", [False, True])
def test_pieces_have_the_ids_of_whole_texts(special):
    e = token_files.Encoder(BPE, 0, special)
    assert e.cuts and e.words
    texts = odd_texts(random.Random(4), 6000) + ["", " ", "  x", "x ", "ö" * 3000, "word " * 5000]
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        for t, ids in zip(some, e.encode(some), strict=True):
            assert ids.tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_a_tokenizer_of_another_kind_gets_texts_whole():
    e = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"), 7)
    texts = odd_texts(random.Random(5), 300)
    assert not e.cuts
    assert [x.tolist() for x in e.encode(texts)] == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def test_token_files_hold_every_document_in_order(spark, tmp_path):
    rng = random.Random(6)
    texts = odd_texts(rng, 300) + [None, "", "long text, " * 30000]
    rows = [(k * 3 - 50, t) for k, t in enumerate(texts)] + [(10, "twice"), (10, "twice"), (10, "and again"), (None, "no id")]
    rng.shuffle(rows)
    path = str(tmp_path / "ids")
    docs = docs_of(spark, rows).withColumn("start", F.lit("x")).withColumn("size", F.lit(1))
    token_files.write(docs, path, BPE, part_bytes=50_000)
    got = token_files.read(spark, path, ids=True).collect()
    tokenizer = token_files.Encoder(BPE, 0).tokenizer
    want = Counter((d, *tokenizer.encode(t or "", add_special_tokens=False).ids, 0) for d, t in rows)
    assert Counter((r.doc_id, *r.ids) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)
    manifest = json.loads((tmp_path / "ids" / "manifest.json").read_text())
    assert len(manifest["parts"]) > 3 and hashlib.sha256((tmp_path / "ids" / manifest["dictionary"]).read_bytes()).hexdigest() == manifest["dictionary_sha256"]
    assert sorted(p.name for p in (tmp_path / "ids").iterdir()) == sorted([manifest["dictionary"], "manifest.json", *(f"{n}.{e}" for n, _, _ in manifest["parts"] for e in ("ids", "idx"))])
    one = token_files.document(path, 1, 0)
    first = next(r for r in got if r.start == manifest["parts"][0][2])
    assert one.tolist() == first.ids
    (tmp_path / "ids" / manifest["dictionary"]).write_bytes(b"another")
    with pytest.raises(Exception, match="dictionary"):
        token_files.read(spark, path).collect()


def test_token_files_of_no_documents(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write(docs_of(spark, []), path, BPE)
    assert token_files.read(spark, path).collect() == []


def test_short_documents_gain_from_the_shared_dictionary(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 2000")
    path = str(tmp_path / "ids")
    token_files.write(docs, path, BPE)
    import zstandard

    alone = sum(len(zstandard.compress(np.array(r.ids, "<u2").tobytes())) for r in token_files.read(spark, path, ids=True).collect())
    assert sum(f.stat().st_size for f in (tmp_path / "ids").glob("*.ids")) < 0.8 * alone


# Lexical search


def slow_rank(rows, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(d, Counter(pattern.findall(t.translate(lower)))) for d, t in rows if d is not None and t is not None]
    docs = [(d, c) for d, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None and t:
            asked[i] |= set(pattern.findall(t.translate(lower)))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[t] + 1)))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "shape"), [(1, (8, 1 << 20)), (2, (2048, 300)), (3, (64, 8 << 20))])
def test_lexical_search_ranks_as_a_full_scan(spark, seed, shape):
    rng = random.Random(seed)
    words = [*"alpha Beta GAMMA delta épsilon Ünder 12 x9 日本 naïve a b c d e f g h".split(), *(f"w{k}" for k in range(60))]
    rows = [(rng.randint(-5, 300), " ".join(rng.choice(words[: rng.randint(5, len(words))]) for _ in range(rng.choice([0, 1, 5, 40])))) for _ in range(260)]
    rows += [(500 + k, "equal alpha texts tie") for k in range(30)] + [(600, None), (601, ""), (602, "... !!"), (None, "alpha beta"), (603, "alpha " * 20000), (500, "equal alpha texts tie")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 15)))) for k in range(25)] + [(90, "equal texts"), (91, None), (92, ""), (93, "nowhere"), (None, "alpha"), (94, "alpha"), (94, "Beta"), (95, "alpha " * 3000)]
    docs = docs_of(spark, rows).withColumn("score", F.lit(1.5)).withColumn("term", F.lit("t"))
    index = lexical.build(docs, *shape)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, lexical.search(index, table, 12, block_terms=40).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == slow_rank(rows, items, 12)


def test_lexical_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical.rank(docs_of(spark, []), items).count() == 0
    assert lexical.rank(docs_of(spark, [(1, "alpha")]), items.limit(0)).count() == 0


def test_trees_open_nodes_of_equal_bounds_for_ties():
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 200):
        hit = rng.random((5, n)) < 0.6
        row, place = np.nonzero(hit)
        value = rng.integers(1, 4, len(row)) * 10
        tree = lexical.MaxTree(5, n, row, place, value, 4, 2)
        weights = np.array([1, 2, 1, 3, 1])
        scores = np.zeros(n, int)
        np.add.at(scores, place, weights[row] * value)
        want = sorted(((int(s), p) for p, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))
        for k in (1, 3, 50):
            assert tree.search(np.arange(5), weights, k) == want[:k]


# Spelling


def slow_groups(rows, period=97):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % period == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, count = {}, {}
    for w, c in words.items():
        close = [x for x in words if x != w and near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w], count[w] = (best if best is not None and words[best] >= 2 * c else None), len(close)
    out = []
    for w, c in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, c, count[w], words[form[w]] if form[w] is not None else None))
    return sorted(out)


@pytest.mark.parametrize(("seed", "period"), [(1, 97), (2, 5)])
def test_spelling_groups_as_all_pairs_do(spark, seed, period):
    rng = random.Random(seed)
    letters = "abcdeéßÿñ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    for w in list(base):  # families one and two edits away
        for _ in range(4):
            k = rng.randrange(len(w))
            base.append(rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa", "x" * 300, "x" * 299 + "y"]
    rows = [(k, " ".join(rng.choice([str.upper, str.lower, str])(w) + rng.choice([",", " 1", "-", ""]) for w in rng.choices(base, weights=[1 + (j % 7) ** 2 for j in range(len(base))], k=120))) for k in range(80)]
    rows += [(None, "aaaaa aaaab " * 4), (7, None), (8, ""), (9, "日本語 12 ×÷ ª")] + [(10, "Twice twice")] * 3
    docs = docs_of(spark, rows).withColumn("word", F.lit(1)).withColumn("n", F.lit("n"))
    got = sorted(map(tuple, spelling.group(docs, period=period).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    want = slow_groups(rows, period)
    assert got == want and sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)


def test_cells_of_many_words_are_dealt_as_tiles(spark):
    rng = random.Random(3)
    words = sorted({"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(4, 6))) for _ in range(500)} | {"".join(rng.choice("abc") for _ in range(5)) for _ in range(150)})
    got = {(r.a, r.b) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), tile=16).collect()}
    assert {tuple(sorted(p)) for p in got} == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if spelling.one_edit(a, b)}
    assert len(got) == len({tuple(sorted(p)) for p in got}) > 500


def test_spelling_of_nothing(spark):
    assert spelling.group(docs_of(spark, [])).count() == 0 and spelling.group(docs_of(spark, [(1, "one two")])).count() == 0


def test_queries_are_registered_over_whole_tables(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {"op11_token_files", "op12_lexical_search", "op13_spelling"} <= set(queries.queries())
    got = queries.op11_token_files(spark, sf)
    assert got.count() == n and got.agg(F.max(F.col("start") + F.col("n_tokens")) == F.sum("n_tokens")).first()[0]
