"""The stored index and the versioned tables below it."""

import random

import pytest
from pyspark.sql import functions as F

from sparrowdoc.functions.text import lexical_tokens
from sparrowdoc.operators import retrieval
from sparrowdoc.operators.index import Index, terms_of
from sparrowdoc.sources.versions import Conflict, Versioned

WORDS = ["adam", "beta", "warm", "step", "the", "loss", "Ünit", "x1"]


def chunks(spark, seed, papers, n=6):
    r = random.Random(seed)
    rows = [(p, f"{p}-{i}", " ".join(r.choices(WORDS, k=r.randint(0, 12)))) for p in papers for i in range(n)]
    return spark.createDataFrame(rows, "paper_id string, chunk_id string, text string"), rows


def scores(df):
    return sorted((r[0], r[1], round(r[2], 9)) for r in df.select("query_id", "chunk_id", "score").collect())


def direct(spark, rows, queries, scope=None):
    df = spark.createDataFrame(rows, "paper_id string, chunk_id string, text string").withColumn("tokens", lexical_tokens(F.col("text")))
    return scores(retrieval.bm25(None, df, queries, ["chunk_id"], query_key="query_id", query_text="query", scope=scope))


def test_index_follows_puts_and_drops(spark, tmp_path):
    queries = spark.createDataFrame([(1, "adam the the", "a"), (2, "ÜNIT zzz", "b"), (3, "", "a")], "query_id int, query string, paper_id string")
    index = Index(spark, f"{tmp_path}/index")
    df, rows = chunks(spark, 1, "abc")
    assert index.put(df) == 1
    assert scores(index.search(queries)) == direct(spark, rows, queries)
    assert scores(index.search(queries, scoped=True)) == direct(spark, rows, queries, ["paper_id"])
    new, changed = chunks(spark, 2, "bd", 4)
    index.put(new)
    rows = [r for r in rows if r[0] != "b"] + changed
    assert scores(index.search(queries)) == direct(spark, rows, queries)
    index.drop(spark.createDataFrame([("a",), ("unknown",)], "paper_id string"))
    rows = [r for r in rows if r[0] != "a"]
    assert scores(index.search(queries)) == direct(spark, rows, queries)
    assert scores(index.search(queries, scoped=True)) == direct(spark, rows, queries, ["paper_id"])
    held = {}
    for _, _, text in rows:
        for t in set(text.lower().split()):
            held[t] = held.get(t, 0) + 1
    assert {r["term"]: r["df"] for r in terms_of(index).collect()} == held
    # what was there before is still there for those who began before
    first = [r for r in chunks(spark, 1, "abc")[1]]
    assert scores(index.search(queries, at=1)) == direct(spark, first, queries)
    index.vacuum()
    assert scores(index.search(queries)) == direct(spark, rows, queries)


def test_retrieve_fills_up_with_chunks_of_no_score(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/index")
    index.put(spark.createDataFrame([("p", 1, "x"), ("p", 2, "adam"), ("p", 3, None), ("q", 4, "")], "paper_id string, chunk_id int, text string"))
    q = spark.createDataFrame([(1, "adam", "p"), (2, "none", "q")], "query_id int, query string, paper_id string")
    got = [(r.query_id, r.chunk_id, r.score > 0) for r in index.retrieve(q, k=3, scoped=True).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, True), (1, 1, False), (1, 3, False), (2, 4, False)]


def test_a_search_reads_no_text_and_its_own_buckets(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/index")
    index.put(chunks(spark, 1, "ab")[0])
    found = index.search(spark.createDataFrame([(1, "adam")], "query_id int, query string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket#") or "bucket#" in plan
    files = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in found.inputFiles() if "/postings/" in f}
    assert len(files) <= len({f for f in index.store.everything("postings").inputFiles()})


def test_versions(spark, tmp_path):
    store = Versioned(spark, f"{tmp_path}/t", ["k"])
    assert store.generation() == 0

    def put(rows, gone=(), based_on=None):
        change = store.change(based_on)
        df = spark.createDataFrame(rows, "k string, v int") if rows else None
        if rows:
            change.write("rows", df)
        keys = [(k, True) for k in {r[0] for r in rows}] + [(k, False) for k in gone]
        return change.commit(spark.createDataFrame(keys, "k string, alive boolean"))

    read = lambda **o: sorted(tuple(r) for r in store.read("rows", **o).collect())
    put([("a", 1), ("a", 2), ("b", 3)])
    before = store.read("rows")  # a reader that begins here
    put([("a", 9)], gone=["b"])
    assert read() == [("a", 9)] and read(at=1) == [("a", 1), ("a", 2), ("b", 3)]
    assert sorted(tuple(r) for r in before.collect()) == [("a", 1), ("a", 2), ("b", 3)]
    with pytest.raises(Conflict):
        put([("c", 1)], based_on=1)
    assert read() == [("a", 9)]
    # a writer that died before its commit leaves nothing to see, and the next one writes over it
    store.change().write("rows", spark.createDataFrame([("a", 77)], "k string, v int"))
    assert read() == [("a", 9)]
    put([("b", 5)])
    assert read() == [("a", 9), ("b", 5)]
    assert read(keys=spark.createDataFrame([("b",)], "k string")) == [("b", 5)]
    store.vacuum()
    assert read() == [("a", 9), ("b", 5)]
