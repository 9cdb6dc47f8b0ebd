"""Queries against their SQL on small tables of odd texts, and ranks of nearly equal scores."""

import os

import oracle
import pytest
from pyspark.sql import functions as F

from sparrowdoc import registry
from sparrowdoc.functions import text as T
from sparrowdoc.functions import vectors
from sparrowdoc.operators import evaluation, retrieval

TEXTS = [
    None, "", " \n ", "The a an.", "a—b the—end an… the", "été a l'an; the, x", "1. 41 is the first of many numbers 4\n2. 4 another line of over twenty signs 4. 3.3 and a third line with a three 3",
    "  Blanks stand on both sides of this sentence.   And of this other one too   ", "tabs\tand\vfeeds\fin a text of the words",
]


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The smallest tables with documents of odd texts in place of theirs."""
    d = tmp_path_factory.mktemp("odd")
    for t in oracle.TABLES:
        if t != "documents":
            os.symlink(f"{sf}/{t}.parquet", d / f"{t}.parquet")
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["squad_normalize", "sentence_split_evaluator"])
def test_odd_texts(spark, odd, name):
    assert oracle.difference(registry.queries()[name](spark, odd), registry.oracle_sql()[name], oracle.connection(odd)) == ""


def test_evaluator_sentences_keep_their_ends(spark):
    """The first, second, third part began or ended with the digit of its place, which was cut off."""
    parts = ["0 is where this sentence begins and ends 0", "1 is where this sentence begins and ends 1", "2 is where this sentence begins and ends 2"]
    assert spark.range(1).select(T.evaluator_sentences(F.lit(" . ".join(parts))).alias("s")).first().s == parts


def test_pooled_token_f1_grows_with_the_tokens(spark):
    """The same as over arrays; these took every pair of a group's tokens, so that 60,000 of them did not end."""
    texts = [("en", "the cat sat"), ("en", "a cat, again"), ("de", "nothing"), (None, None), ("fr", "")]
    gold = spark.createDataFrame([("the cat",), ("sat cat cat",), (None,)], "text string")
    got = {r.lang: r.evidence_f1 for r in evaluation.pooled_token_f1(spark.createDataFrame(texts, "lang string, text string"), gold, by="lang").collect()}
    arrays = evaluation.token_f1(F.lit("the cat sat a cat, again"), F.lit("the cat sat cat cat"))
    assert got == {"en": spark.range(1).select(arrays.alias("x")).first().x, "de": 0.0, None: None, "fr": 0.0}
    many = spark.range(60_000).select(F.lit("en").alias("lang"), F.concat(F.lit("word"), "id").alias("text"))
    assert evaluation.pooled_token_f1(many, many, by="lang").first().evidence_f1 == 1.0


def test_evidence_token_f1_uses_whole_texts(spark, sf, tmp_path):
    """Words beyond a text's first 200 characters were left out, in the query and in its SQL."""
    for t in oracle.TABLES:
        if t not in ("documents", "benchmark"):
            os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    texts = [("pad " * 300 + "cat the sat", "en"), ("cat", "en"), (None, "en"), ("x" * 195 + " catalogue", "de"), ("b " * 5000 + "cat " * 5, "fr")]
    rows = [(i, t, lang, "src1", len(t or "")) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "A cat sat."), (2, "the cat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["evidence_token_f1"](spark, str(tmp_path))
    assert {r.lang: r.evidence_f1 for r in got.collect()} == {"en": round(6 / 306, 6), "de": 0.0, "fr": round(4 / 5008, 6)}
    assert oracle.difference(got, registry.oracle_sql()["evidence_token_f1"], oracle.connection(str(tmp_path))) == ""


def test_equal_scores_are_ranked_by_place(spark):
    """Sums of the same terms in another order differ in the last digits, which ranked copies of a text at random."""
    scored = spark.createDataFrame([("q", 1, 0.3), ("q", 2, 0.1 + 0.2), ("q", 3, 0.3 - 1e-15)], "q string, pos long, score double")
    chunks, asked = spark.range(1, 4).select(F.col("id").alias("pos")), spark.createDataFrame([("q",)], "q string")
    top = retrieval.bm25_top(scored, chunks, asked, query_key="q", pos="pos", k=3)
    assert [r.pos for r in top.orderBy("rank").collect()] == [1, 2, 3]


def test_halves_are_rounded_as_in_sql(spark):
    import duckdb

    values = [k / n for n in (64, 128, 640, 1280, 3200, 6400, 12800) for k in range(1, n, 2)]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").coalesce(1).select("i", vectors.rounded(F.col("v"), 6).alias("x")).orderBy("i").collect()]
    assert got == duckdb.execute("select list_transform($1::double[], lambda v: round(v, 6))", [values]).fetchall()[0][0]
