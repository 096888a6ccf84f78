"""Operators against brute force on small tables with nulls, blanks, ties, repeats and columns whose names clash."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from terraweave.llm import decontamination, extraction, licenses, lines, mixing, sharding, simhash, substrings, topk, toxicity
from terraweave.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, copies string, score string, cell string, node string"


def docs_of(spark, rows):
    """(doc_id, text[, source]) rows with the other columns, some of them named like columns of the operators."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None, 1, "x", "x", "x", "x", "x") for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "la", "mu", "nu", "xi"]) + rng.choice("abcdefghij") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    shared = prose(rng, 30)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, f"{prose(rng, 5)} {shared} {prose(rng, 7)}") for k in range(6)]
    rows += [(200 + k, base[3]) for k in range(5)] + [(300, None), (301, ""), (302, " \n "), (303, "é" * 200), (304, "x" * 300), (305, "x" * 120), (306, prose(rng, 4000))]
    rows += [(400 + k, base[7].replace("alphaa", "omega", 1) + " end") for k in range(3)]
    return rows


def test_substrings_match_brute_force(spark, texts, monkeypatch):
    for hot, block in ((2048, 2 << 20), (1, 700)):
        monkeypatch.setattr(substrings, "HOT", hot)
        monkeypatch.setattr(substrings.blocks_of, "__defaults__", (block,))
        got = {r["doc_id"]: r for r in substrings.deduplicate(docs_of(spark, texts), with_text=True).collect()}
        assert len(got) == len(texts)
        seen = set()
        for doc, text in sorted(texts):
            b = (text or "").encode()
            gone, mine = np.zeros(len(b), bool), set()
            for k in range(len(b) - 49):
                s = b[k : k + 50]
                mine.add(s)
                if s in seen:
                    gone[k : k + 50] = True
            seen |= mine
            kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
            r = got[doc]
            assert (r["n_bytes"], r["n_removed"], bytes(r["kept"]), r["kept_sha256"]) == (len(b), gone.sum(), kept, hashlib.sha256(kept).hexdigest())
            assert r["n_spans"] == gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()


def test_substrings_of_null_ids_and_empty_tables(spark):
    r = substrings.deduplicate(docs_of(spark, [(None, "a" * 80), (1, "a" * 80)])).collect()
    assert sorted((x["doc_id"] or 0, x["n_removed"]) for x in r) == [(0, 0), (1, 0)]
    assert substrings.deduplicate(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


def test_lines_match_brute_force(spark):
    rng = random.Random(3)
    pool = [prose(rng, 4) for _ in range(25)]
    passage = [prose(rng, 3) for _ in range(12)]
    rows = []
    for k in range(40):
        body = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        if k % 3 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = passage
        rows.append((k, "\n".join(body)))
    rows += [(50, rows[3][1]), (51, rows[3][1] + "\n" + rows[3][1]), (52, None), (53, ""), (54, "\n\n\n")]
    got = {r["doc_id"]: r for r in lines.deduplicate(docs_of(spark, rows)).collect()}
    seen, removed = set(), 0
    for doc, text in sorted(rows):
        kept = []
        mine = set()
        for chunk in lines.cut(text):
            body = b"\n".join(chunk)
            if len(chunk) > 1 and (body in seen or body in mine):
                removed += 1
                continue
            mine.add(body)
            kept += chunk
        seen |= {b for b in mine}
        assert got[doc]["text"] == (None if text is None else b"\n".join(kept).decode()), doc
    assert removed > 10


def test_line_chunks_resist_shifts():
    rng = random.Random(1)
    body = [prose(rng, 5) for _ in range(60)]
    a = {b"\n".join(c) for c in lines.cut("\n".join(body))}
    b = {b"\n".join(c) for c in lines.cut("\n".join(["new", "lines", *body]))}
    assert len(a & b) >= len(a) - 2


def test_mixing_reaches_targets_and_repeats_itself(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.randint(0, 60)), rng.choice(["a", "b", "B", "ü", None] + ["big"] * 8)) for k in range(3000)] + [(5000, "one", "tiny"), (5001, None, "void")]
    d = docs_of(spark, rows)
    got = mixing.mix(d).toPandas()
    assert sorted(got.doc_id) == sorted(r[0] for r in rows)
    assert mixing.mix(d.repartition(7)).toPandas().sort_values("doc_id")["taken"].tolist() == got.sort_values("doc_id")["taken"].tolist()
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, _ in rows}
    assert all(sizes[k] == s for k, s in zip(got.doc_id, got["size"], strict=True))
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), n=("doc_id", "size"))
    names = sorted([s for s in {r[2] for r in rows} if s is not None]) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    size = {s: sum(sizes[r[0]] for r in rows if r[2] == s) for s in names}
    free, left = set(names), float(sum(size.values()))
    while True:  # share, cap, share the rest again
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
        free -= over
    for s in free:
        target[s] = unit * weight[s]
    for s, row in per.iterrows():
        s = None if s != s else s
        assert abs(row.target - target[s]) < 1e-6
        assert row.n < 50 or abs(row.taken - row.target) <= 0.02 * row.target + 60
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mix(d.limit(0)).count() == 0
    emitted = mixing.emit(d).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert emitted == {k: c for k, c in zip(got.doc_id, got.copies, strict=True) if c}


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.randint(0, 80))) for k in range(2500)] + [(9000 + k, "same text " * 30) for k in range(1500)] + [(20000, None), (20001, ""), (20002, "é" * 9000), (3, "again")]
    for size in (16 << 20, 2000):
        got = sharding.shard(docs_of(spark, rows), 40, size).toPandas()
        assert sorted(got.doc_id) == sorted(r[0] for r in rows)
        crc = sorted((k, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for k, t in rows)
        assert sorted(zip(got.doc_id, got.text_crc32, got["size"], strict=True)) == crc
        per = got.groupby("shard").agg(b=("size", "sum"), n=("slot", "size"), top=("slot", "max"), kinds=("slot", "nunique"))
        assert len(per) == 40 and (per.top + 1 == per.n).all() and (per.kinds == per.n).all()
        assert per.b.max() - per.b.min() <= 2 * got["size"].max()
        assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    assert sharding.shard(docs_of(spark, rows).limit(0)).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 6000 + k) for k in range(200)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash_matches_brute_force(spark, texts, tile, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (tile,))
    rows = texts + [(500 + k, " ".join(["word"] * (k + 3)) + " tail") for k in range(12)]
    got = {r["doc_id"]: r for r in simhash.fingerprint_groups(docs_of(spark, rows)).collect()}
    fp = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        fp[doc] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    root = {d: d for d in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 3 and root[a] > root[b]:
                    root[a] = root[b]
                    changed = True
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{f:016x}" for d, f in fp.items()}
    assert {d: r["component_id"] for d, r in got.items()} == root
    assert len(set(root.values())) < len(root) - 10


def test_simhash_deduplicate_keeps_one_of_each_group(spark, texts):
    rows = [*texts, (None, "no id at all"), (None, texts[3][1])]
    kept = simhash.deduplicate(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and 3 in ids and not {200, 201, 202, 203, 204} & set(ids)
    assert len({400, 401, 402} & set(ids)) <= 1 and {k for k, _ in texts[:40]} - {3, 7} - set(ids) == set()
    assert simhash.deduplicate(docs_of(spark, rows).limit(0)).count() == 0


def jaccard(a, b, n=5):
    sets = [{" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} or ({" ".join(w)} if w else set()) for w in (t.lower().split() for t in (a, b))]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def edited(rng, text, share):
    """A copy with words replaced until about `share` of the five-word runs are left in common."""
    words = text.split()
    out = list(words)
    while jaccard(text, " ".join(out)) > share:
        out[rng.randrange(len(out))] = "new" + str(rng.randrange(10**6))
    return " ".join(out)


@pytest.mark.parametrize("tile", [1024, 2])
def test_similarity_decides(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "SET_TILE", tile)
    rng = random.Random(15)
    rows, pairs = [], []
    for k in range(240):
        base = prose(rng, rng.randint(60, 250))
        copy = edited(rng, base, (0.65, 0.76, 0.84, 0.9)[k % 4])
        rows += [(2 * k, base), (2 * k + 1, copy)]
        pairs.append((2 * k, 2 * k + 1, jaccard(base, copy)))
    root = prose(rng, 200)  # a family: all near the root, not all near each other
    family = [(1000 + k, edited(rng, root, 0.85)) for k in range(25)]
    rows += [*family, (2000, root), (3000, "Short text"), (3001, "short TEXT"), (3002, None), (3003, ""), (None, root)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs_of(spark, rows)).collect()}
    assert all(got[a] != got[b] for a, b, j in pairs if j < 0.8)
    near = [got[a] == got[b] for a, b, j in pairs if j >= 0.8]
    assert len(near) > 100 and np.mean(near) >= 0.97
    assert {got[k] for k, _ in family} | {got[2000]} == {1000}
    assert got[3001] == 3000 and got[3003] == 3002 and got[None] is None


def test_parts_are_joined_where_spanning_edges_fail(spark):
    """Two chains of near copies in one group, some of whose candidates are not similar enough."""
    rng = random.Random(16)
    words = prose(rng, 120).split()
    rows = []
    for k in range(30):
        rows.append((k, " ".join(words)))
        words = words[2:] + prose(rng, 2).split()
    want = {k: k for k, _ in rows}
    for a, x in rows:
        for b, y in rows:
            if a < b and jaccard(x, y) >= 0.8:
                lo, hi = sorted((want[a], want[b]))
                want = {k: lo if r == hi else r for k, r in want.items()}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs_of(spark, rows)).collect()}
    assert got == want
    members = simhash.sets_of(docs_of(spark, rows), spark.range(30).withColumnRenamed("id", "node"), 5)
    prints = simhash.set_prints(docs_of(spark, rows), 5).withColumnRenamed("doc_id", "node")
    members = members.join(prints, "node").selectExpr("node", "0L AS grp", "node AS part", "node % 3 = 0 AS main", "f0", "f1", "hashes")
    found = [tuple(r) for r in simhash.links_between_parts(members, 0.8).collect()]
    assert found and all(jaccard(rows[u][1], rows[v][1]) >= 0.8 for u, v in found)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v = [(int(k), [float(x) for x in rng.normal(size=6)]) for k in range(230)]
    v += [(1000 + k, [0.5] * 6) for k in range(40)] + [(5000, [0.5] * 6), (5050, []), (600, None), (7001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (7002, [float("nan")] + [0.0] * 5), (7003, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (7004, [1.0, 2.0])]
    ok = [(k, [int(np.floor(256 * x)) for x in e]) for k, e in v if k is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = set()
    for q, a in ok:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in ok if c != q)[:5]
            want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)}
    frame = spark.createDataFrame([(*r, "x", 1) for r in v], "vec_id long, embedding array<double>, score string, block int")
    got = {tuple(r) for r in topk.top_k(frame).collect()}
    assert got == want
    assert topk.top_k(frame.limit(0)).count() == 0


def plain_scores(stems, examples, text):
    """The scores of a text, from dictionaries."""
    fold = toxicity.Stems(stems).of
    n, prior = len(examples), sum(y for _, y, _ in examples) / len(examples)
    counted = []
    for doc, y, words in examples:
        c = {}
        for w in words:
            c[fold(w)] = c.get(fold(w), 0) + 1
        counted.append((doc, y, c, int(math.log2(len(c) + 1))))
    share = {b: (sum(y for _, y, _, x in counted if x == b) + prior) / (sum(x == b for *_, x in counted) + 1) for b in {x for *_, x in counted}}
    weight = {}
    for t in {t for _, _, c, _ in counted for t in c}:
        has = [(y, share[b]) for _, y, c, b in counted if t in c]
        df, d1, e1 = len(has), sum(y for y, _ in has), sum(s for _, s in has)
        g = (2 * d1 * math.log(d1 / e1) if d1 else 0) + (2 * (df - d1) * math.log((df - d1) / (df - e1)) if df > d1 else 0)
        weight[t] = (math.log((n + 1) / (df + 1)) + 1) * (1 + (0.5 * math.sqrt(max(0, g - 15)) if d1 > e1 else 0))

    def unit(c):
        v = {t: k * weight.get(t, math.log(n + 1) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    c = {}
    for w in text:
        c[fold(w)] = c.get(fold(w), 0) + 1
    q = unit(c)
    scored = sorted(((round(sum(x * q.get(t, 0) for t, x in unit(e).items()), 9), doc, y) for doc, y, e, _ in counted if e), reverse=True)
    scored = [x for x in scored if x[0] > 0]
    least = scored[14][0] if len(scored) > 15 else 0
    near = [x for x in scored if x[0] >= least]
    votes = [(1 / (1.1 - min(1, s)), y) for s, _, y in near]
    return {doc for _, doc, _ in near}, (sum(v * y for v, y in votes) + prior) / (sum(v for v, _ in votes) + 1)


def test_nearest_examples_are_exact():
    rng = random.Random(9)
    words = [a + b for a in "abcdefgh" for b in ("x", "yz", "yzzz", "w")]
    stems = ["ayz", "byzzz$"]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    examples = [(k, int(rng.random() < 0.3), draw(rng.randint(0, 6))) for k in range(300)]
    examples += [(400 + k, 1, ["gw", *draw(3)]) for k in range(60)] + [(500 + k, 0, ["ax", "bx"]) for k in range(40)]
    s = toxicity.Stems(stems)

    def index_of(examples):
        found = [s.counts(Counter(w)) for _, _, w in examples]
        flat = [np.concatenate([np.zeros(0, kind), *(f[k] for f in found)]) for k, kind in enumerate((np.uint64, np.int32))]
        return toxicity.ExampleIndex(s, *(np.array([e[k] for e in examples], np.int64) for k in (0, 1)), np.array([len(f[0]) for f in found], np.int64), *flat)

    index = index_of(examples)
    for k in range(120):
        text = draw(rng.randint(1, 9)) + ["unheard"] * (k % 3)
        near, want = plain_scores(stems, examples, text)
        ((found, _),) = index.nearest([index.vector(Counter(text))])
        assert set(index.ids[found].tolist()) == near
        assert abs(index.scores([Counter(text)])[0][0] - want) < 1e-9
    assert [s for s, _ in index.scores([Counter(), Counter(["unheard"])])] == [index.prior] * 2
    assert index_of([]).scores([Counter("ab")] * 2) == [(0.0, [])] * 2 and index.scores([]) == []


def test_toxicity_matches_brute_force(spark):
    rng = random.Random(14)
    rows = [(k, prose(rng, rng.randint(0, 25))) for k in range(150)]
    labels = [(k, 1, int(k % 5 == 0 or "alphaa" in t)) for k, t in rows if k % 3]
    rows += [(1000, None), (1001, ""), (1002, "99 !"), (1003, "unheard of"), (0, rows[0][1])]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs_of(spark, rows), lab).collect())
    # Copies count once; three-word runs of random prose share their smallest hash only where all words are equal.
    texts, seen, examples = dict(rows), set(), []
    for k, _, y in sorted(labels):
        w = toxicity.words_of(texts[k])
        if zlib.crc32(str(k).encode()) % 4 != 2 and tuple(w) not in seen:
            seen.add(tuple(w))
            examples.append((k, y, w))
    index = toxicity.fit(docs_of(spark, rows), lab)
    stems = sorted(index.stems.stems)
    assert sorted(index.ids.tolist()) == [k for k, _, _ in examples]
    prior = sum(y for _, y, _ in examples) / len(examples)
    want = sorted((k, plain_scores(stems, examples, toxicity.words_of(t))[1] if toxicity.words_of(t) else prior) for k, t in rows)
    assert len(got) == len(want) and all(a == b and abs(x - y) < 1e-8 for (a, x), (b, y) in zip(got, want, strict=True))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(900):
        t = prose(rng, rng.randint(5, 80)).split()
        y = int(rng.random() < 0.2)
        if y:
            for _ in range(2 + len(t) // 40):
                t[rng.randrange(len(t))] = rng.choice(["Nasty", "nastier", "vile!!", "VILE"])
        rows.append((k, " ".join(t)))
        labels.append((k, 1, y))
    rows += [(2000, None), (2001, ""), (2002, "nasty vile " * 3000), (0, rows[0][1])]
    labels += [(None, 1, 1), (3, 1, None), (99999, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs_of(spark, rows), lab).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    truth = {k: y for k, _, y in labels}
    held = got[got.held_out & (got.doc_id < 900)]
    assert all(h == (zlib.crc32(str(k).encode()) % 4 == 2) for k, h in zip(got.doc_id, got.held_out, strict=True))
    assert np.mean([p == truth[k] for k, p in zip(held.doc_id, held.predicted, strict=True)]) > 0.97
    by = got.set_index("doc_id").predicted
    assert by[2002] == 1 and by[2000] == by[2001] == 0
    clean = toxicity.without_toxic(docs_of(spark, rows), lab)
    assert clean.columns == docs_of(spark, rows).columns and clean.count() == int((got.predicted == 0).sum())
    assert toxicity.score(docs_of(spark, rows).limit(0), lab).count() == 0
    assert {r["score"] for r in toxicity.score(docs_of(spark, rows), lab.limit(0)).collect()} == {0.0}


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(10)
    index = decontamination.ItemIndex([(k, prose(rng, rng.randint(4, 90)).split()) for k in range(60)])
    for _ in range(200):
        passage = set(rng.sample(range(1, len(index.docs)), rng.randint(1, len(index.docs) - 1)))
        scores = {}
        for t in passage:
            for at, w in zip(index.docs[t], index.weights[t], strict=True):
                scores[at] = scores.get(at, 0.0) + w
        want = sorted(at for at, s in scores.items() if s >= decontamination.THRESHOLD - 1e-9)
        assert sorted(at for at, _ in index.search(passage)) == want


def test_decontamination_finds_planted_items(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, n)) for k, n in enumerate((20, 35, 60, 150, 9, 5))] + [(90, None), (91, ""), (None, "alphaa betaa"), (92, "...")]
    clean = [(k, prose(rng, rng.randint(0, 300))) for k in range(60)]
    dirty = [(100 + k, f"{prose(rng, 50 * k)} {items[k][1].upper()}!! {prose(rng, 40)}") for k in range(6)] + [(110, items[1][1].replace("alphaa", "omega"))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    d = docs_of(spark, clean + dirty + [(300, None), (301, ""), (None, items[0][1])])
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.hits(d, bench).collect()}
    assert {(100 + k, k) for k in range(6)} | {(110, 1)} <= got
    assert {doc for doc, _ in got} <= {k for k, _ in dirty} | {k for k, t in clean if items[5][1] in t or items[4][1] in t}
    kept = decontamination.decontaminate(d, bench)
    assert kept.columns == d.columns and kept.count() == len(clean) + 3
    assert decontamination.hits(d, bench.limit(0)).count() == 0 and decontamination.hits(d.limit(0), bench).count() == 0


def test_patience_alignment():
    rng = random.Random(12)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
    assert licenses.increasing([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]


def test_license_places(spark):
    rng = random.Random(13)
    notice = licenses.TEMPLATES["apache-2.0-notice"]
    bent = notice.replace("compliance", "accordance").replace("obtain", "get").replace("governing", "about")
    line = licenses.TEMPLATES["mit-line"]
    rows = [(1, f"{prose(rng, 40)} {bent} {prose(rng, 30)}"), (2, f"{line}\n{prose(rng, 9)}\n{line.upper()}"), (3, prose(rng, 300)), (4, None), (5, ""), (6, f"{prose(rng, 4000)} {line}"), (2, line), (None, line)]
    got = [(r["doc_id"], r["license"], r["first_word"]) for r in licenses.scan(docs_of(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "apache-2.0-notice", 40), (2, "mit-line", 0), (2, "mit-line", 14), (6, "mit-line", 4000), (2, "mit-line", 0), (None, "mit-line", 0)]))
    assert licenses.scan(docs_of(spark, rows).limit(0)).count() == 0


PAGE = """<!doctype html><html><head><title>no</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body><div class="cookie-notice">no no</div>
<nav><ul><li><a href="/">no</a></li><li><a href="/x">no</a></li></ul></nav><div class="ad">no &amp; no</div>
<article><h1>The  head</h1><p>One &amp; two
 three, and so on for a while.<p><b>Four</b> fi<i>ve</i> &lt;six&gt;, and again some more words here.</p><p>x</p></article>
<aside class="sidebar"><h3>no</h3><a href="#">no</a></aside><div id="comments"><div class="comment"><p>no, said a reader, no.</p></div></div><form><input name="q"><button>no</button></form><footer>&copy; no</footer></body></html>"""


@pytest.fixture(scope="module")
def trees(spark):
    return extraction.fit(spark)


def test_extraction(spark, trees):
    want = "The head\nOne & two three, and so on for a while.\nFour five <six>, and again some more words here.\nx"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "   "), (5, "u", "<div"), (6, "u", PAGE[: PAGE.index("<p>x</p>")]), (1, "u", PAGE), (None, "u", PAGE), (7, "u", "<" * 2000), (8, "u", PAGE.replace("<p>x</p>", "<p>" + "long " * 20000 + "</p>"))]
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in extraction.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string"), trees).collect()}
    by = {p: t for p, t, _ in got}
    assert by[1] == by[None] == want and by[2] == by[3] == by[4] == by[5] == by[7] == ""
    assert by[6] == want[: want.rindex("\n")] and len(by[8]) > 99_000 and all(len(t) == n for _, t, n in got)


def test_extraction_of_plain_prose(spark, trees):
    rows = [(1, "u", "No markup\n at all, &amp; so all of it."), (2, "u", "before <p>and some more words after it.</p>")]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), trees).collect()}
    assert got[1] == "No markup at all, & so all of it." and got[2] == "before\nand some more words after it."


def test_extraction_of_whole_pages(spark, trees, sf):
    import html as h

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extraction.extract(pages, trees).collect()}
    for r in pages.collect():
        body = re.split(r"<footer", re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1])[0]
        blocks = [" ".join(h.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", body))]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_decoding_has_no_contradictions(trees):
    page = extraction.Page(PAGE)
    rng = np.random.default_rng(0)
    for _ in range(50):
        kept = extraction.decode(page, rng.random(len(page.tag)))
        assert all(kept[p] for k, p in enumerate(page.parent) if kept[k] and p >= 0)
