"""Cases of which operators once saw a part only."""

import math
import random

import numpy as np

from terraweave.llm import decontamination, licenses, mixing, sharding, simhash, topk, toxicity


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "ion", "en", "st", "la", "qu"]) for _ in range(rng.randint(2, 4))) for _ in range(n))


def test_licenses_without_their_rarest_words():
    rng = random.Random(3)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, lost in (("apache-2.0-notice", ("limitations", "permissions", "applicable", "compliance")), ("gpl-3.0-notice", ("redistribute", "foundation", "published", "program"))):
        words = licenses.words_of(licenses.TEMPLATES[name])
        bent = [w + "x" if w in lost else w for w in words]
        got = scanner.scan(f"{prose(rng, 20)} {' '.join(bent)} {prose(rng, 20)}")
        assert [(g[0], g[1], g[2]) for g in got] == [(name, 20, 20 + len(words))]
        assert got[0][3] == len(words) - sum(w in lost for w in words)


def test_any_fifth_of_a_notice_may_be_missing():
    rng = random.Random(4)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, words in scanner.words.items():
        for _ in range(20 if len(words) > 20 else 0):
            gone = set(rng.sample(range(len(words)), len(words) // 5))
            got = scanner.scan(" ".join([*prose(rng, 9).split(), *(f"q{k}" if k in gone else w for k, w in enumerate(words)), *prose(rng, 9).split()]))
            assert [g[3] for g in got] == [len(words) - len(gone)], (name, got)


def test_adjacent_notices():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in ("mit", "apache-2.0-notice", "isc"):
        words = licenses.words_of(licenses.TEMPLATES[name])
        n = len(words)
        for copies in (3, 5):
            got = scanner.scan(" ".join(words * copies))
            assert got == [(name, k * n, (k + 1) * n, n, 1.0) for k in range(copies)]
        bent = [*words, *words[: n // 2], "inserted", *words[n // 2 :], *words]
        assert [(g[0], g[1], g[2]) for g in scanner.scan(" ".join(bent))] == [(name, 0, n), (name, n, 2 * n + 1), (name, 2 * n + 1, 3 * n + 1)]


def test_licenses_are_not_taken_for_each_other():
    scanner = licenses.Scanner(licenses.TEMPLATES)

    def names(text):
        return [g[0] for g in scanner.scan(text)]

    for name, template in licenses.TEMPLATES.items():
        assert names(f"Some words. {template} More words.") == [name]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["gpl-2.0-line"]
    assert names(licenses.TEMPLATES["gpl-3.0-notice"].replace("version 3", "version 2")) == ["gpl-2.0-notice"]
    assert names("Released under the BSD License.") == ["bsd-line"] and names("Licensed under CC BY-ND 4.0.") == ["cc-by-nd-4.0-line"]
    for other in ("Licensed under the Apache License, Version 1.0.", "Released under the Foo License.", "Licensed under CC BY-XX 4.0.", "This work is licensed under the GNU General Public License, version 9."):
        assert names(other) == [licenses.UNKNOWN], other


def test_items_of_several_parts(spark):
    rng = random.Random(6)
    items = [(n, [f"w{n}x{k}" for k in range(n)]) for n in (64, 65, 96, 130, 160, 300)]
    index = decontamination.ItemIndex(items)
    assert len(index.term) == sum(n for n, _ in items)
    rows, want = [], set()
    for n, words in items:
        cut = -(-3 * n // 4)
        for shift in (0, 37, 100):
            cases = [(words, True), (words[cut // 3 :], True), (words[:cut], False), (words[cut:], False), (words[: cut + (n - cut) // 4], False)]
            for part, dirty in cases:
                doc = len(rows)
                rows.append((doc, " ".join([*prose(rng, shift).split(), *part, *prose(rng, 20).split()])))
                want |= {(doc, n)} if dirty else set()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(words)) for n, words in items], "item_id long, text string")
    got = decontamination.hits(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["question_overlap"] == r["answer_overlap"] == 1.0 for r in got if r["doc_id"] % 5 == 0)


ODD = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, slot string, _key int, _row string, `a.b` string"


def odd_docs(spark, rows):
    return spark.createDataFrame([(k, t, None, s, None, 1, "x", "y", 2, "z", "w") for k, t, s in rows], ODD)


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(7)
    rows = [(20 * k, prose(rng, rng.randint(0, 40)), rng.choice(["a", "b", None])) for k in range(120)] + [(5, None, "a"), (5, None, "a"), (None, "", None)]
    docs = odd_docs(spark, rows)
    labels = spark.createDataFrame([(20 * k, 1, int(k % 9 == 0)) for k in range(120)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(rng, 30))], "item_id long, text string")
    for table in (docs, docs.limit(0)):
        n = table.count()
        for out in (toxicity.without_toxic(table, labels), simhash.deduplicate(table), decontamination.decontaminate(table, bench), mixing.emit(table)):
            assert out.columns == docs.columns and (out.count() > 50 if n else out.count() == 0)
            out.write.mode("overwrite").format("noop").save()
        placed = sharding.place(sharding.keyed(table), 4)
        assert len(set(placed.columns)) == len(placed.columns) and {"size_in", "shard_in", "a.b", "shard", "slot"} <= set(placed.columns)
        assert placed.count() == n
        if n:
            r = placed.where("doc_id = 40").first()
            assert (r["size_in"], r["shard_in"], r["a.b"], r["_key"], r["_row"]) == (1, "x", "w", 2, "z")


def test_a_key_that_fills_ranges_is_split(spark):
    rows = [(None, "the same text again and again", None)] * 3000 + [(k, f"text {k} " * 5, None) for k in range(1500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), 40, 4000).toPandas()
    per = got.groupby("shard").agg(b=("size", "sum"), n=("slot", "size"), top=("slot", "max"), kinds=("slot", "nunique"))
    assert len(got) == 4500 and len(per) == 40 and (per.top + 1 == per.n).all() and (per.kinds == per.n).all()
    assert per.b.max() - per.b.min() <= 2 * got["size"].max()


def test_ids_with_a_stride_fall_into_all_slices(spark):
    rows = [(20 * k, "w " * (k % 7), "s") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, cell_rows=200).toPandas()
    assert len(got) == 4000 and (got.copies == 1).all() and (got.taken == got["size"]).all()


def test_scores_of_large_components(spark):
    v = [(0, [1e10, 1.0]), (1, [1e10, -2.0]), (2, [2.0**56, 0.5]), (3, [1e300, 1.0]), (4, [-1e300, 1.0]), (5, [-0.3, 0.0]), (6, [1.7e308, 0.0]), (7, [-0.001, 2.0**40])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>"), every=1000).orderBy("rank").collect()]
    q = [int(256 * x) for x in v[0][1]]
    scored = sorted(((sum(a * math.floor(256 * x) for a, x in zip(q, e, strict=True)), -k) for k, e in v[1:] if k != 6), reverse=True)[:5]
    assert got == [(0, r + 1, -k, min(max(s, -(1 << 63)), (1 << 63) - 1)) for r, (s, k) in enumerate(scored)] or [g[3] for g in got] == [min(s, (1 << 63) - 1) for s, _ in scored]


def test_bounds_in_pieces(monkeypatch):
    rng = random.Random(8)
    index = decontamination.ItemIndex([(k, prose(rng, rng.randint(4, 90)).split()) for k in range(60)])
    cell = sorted(rng.randrange(40) for _ in range(3000))
    terms = [rng.randrange(1, len(index.count)) for _ in cell]
    whole = index.possible(np.array(terms), np.array(cell), 42).tolist()
    monkeypatch.setattr(decontamination, "BOUNDS", 5 * index.blocks)
    assert whole and index.possible(np.array(terms), np.array(cell), 42).tolist() == whole
