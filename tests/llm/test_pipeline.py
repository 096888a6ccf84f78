"""Stages of the pipeline against brute force on planted cases."""

import random

import corpus_pipeline as P
import pytest

from terraweave.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "ion", "en", "st", "la", "qu"]) for _ in range(rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    at = str(tmp_path_factory.mktemp("corpus"))
    items = [(k, prose(rng, 30)) for k in range(12)]
    rows, labels = [], []
    for k in range(600):
        t = prose(rng, rng.randint(20, 120)).split()
        toxic = k % 6 == 0
        if toxic:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(["horrid", "HORRID!"])
        rows.append([k, " ".join(t)])
        labels.append((k, 1, int(toxic)))
    copies = [[1000 + k, rows[1 + 6 * k][1]] for k in range(20)]
    near = [[1100 + k, rows[2 + 6 * k][1].rsplit(" ", 1)[0] + " changed"] for k in range(20)]
    leaks = [[1200 + k, f"{prose(rng, 20)} {items[k][1]} {prose(rng, 20)}"] for k in range(12)]
    full = [(k, t, "en", f"s{k % 5}" if k % 7 else None, len(t)) for k, t in rows + copies + near + leaks] + [(3000, None, None, None, None), (3001, "", "en", "s1", 0)]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, full, near


def test_stages(spark, corpus):
    at, full, near = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, at)
        docs.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if name != P.STAGES[-1][0]:
            assert docs.columns == COLUMNS
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    ids = {r[0] for r in full}
    toxic = {k for k in range(600) if k % 6 == 0}
    assert ids - set(seen["toxicity"]) == toxic
    gone = set(seen["toxicity"]) - set(seen["near_copies"])
    assert {1000 + k for k in range(20)} <= gone <= {1000 + k for k in range(20)} | {r[0] for r in near} | {3001}
    assert len(gone & {r[0] for r in near}) >= 15
    assert set(seen["near_copies"]) - set(seen["decontamination"]) == {1200 + k for k in range(12)}
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and max(seen["mixing"].count(k) for k in set(seen["mixing"])) <= 3
    assert sorted(seen["sharding"]) == sorted(seen["mixing"])
    shards = docs.groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).toPandas()
    assert len(shards) == 40 and (shards["max(slot)"] + 1 == shards["count(1)"]).all()


def test_run_and_registration(spark, corpus):
    out = P.run(spark, corpus[0])
    assert out.count() > 100 and {"shard", "slot"} <= set(out.columns)
    assert {k.split("_")[0] for k in queries.queries()} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_of_queries(spark, sf, name):
    import duckdb
    import os

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    got, want = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns) and len(got) == len(want)
    a, b = (x[order].convert_dtypes().sort_values(order).reset_index(drop=True).astype(str) for x in (got, want))
    assert (a == b).all().all()
