"""Published values of the pure functions, readers and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from sparrowdoc import models
from sparrowdoc.functions import text as T
from sparrowdoc.functions import vectors as V
from sparrowdoc.operators import chunking, discovery, evaluation, grading, layout, retrieval
from sparrowdoc.sources import readers, sinks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("a,b,f1", [("The cat sat on the mat.", "a cat sat", 0.666667), ("", "", 1.0), ("the", "an", 1.0), ("yes", "no", 0.0), ("8 P100 GPUs", "eight P100 GPUs", 0.666667), ("a a b b b", "b b c", 0.666667)])
def test_token_f1(spark, a, b, f1):
    assert round(one(spark, x=evaluation.token_f1(F.lit(a), F.lit(b))).x, 6) == f1


@pytest.mark.parametrize("n,starts", [(0, []), (1, [0]), (412, [0]), (413, [0, 412]), (512, [0, 412]), (825, [0, 412, 824]), (1000, [0, 412, 824])])
def test_chunk_windows(spark, n, starts):
    tokens = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("string")) if n else F.array().cast("array<string>")
    w = one(spark, w=chunking.windows(tokens)).w
    assert [x.start for x in w] == starts and all(len(x.tokens) == min(512, n - x.start) for x in w)


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "adam optimizer beta"), (1, "attention is all"), (2, "adam beta adam warmup steps")], "id int, t string").select("id", T.lexical_tokens(F.col("t")).alias("tokens"))
    q = spark.createDataFrame([("adam beta",), ("attention",), ("adam adam",), ("zzz",)], "q string")
    rows = retrieval.bm25(retrieval.postings(docs, ["id"]), docs, q, ["id"], query_key="q", query_text="q").collect()
    got = {(r.q, r.id): round(r.score, 6) for r in rows}
    assert got == {("adam beta", 0): 0.139086, ("adam beta", 2): 0.136547, ("attention", 1): 0.556345, ("adam adam", 0): 0.139086, ("adam adam", 2): 0.163345}


def test_rrf(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 3), ("q", "z", 10)], "q string, item string, rank int")
    b = spark.createDataFrame([("q", "x", 1), ("q", "y", 1)], "q string, item string, rank int")
    got = {r.item: round(r.rrf_score, 6) for r in retrieval.reciprocal_rank_fusion(a, b, by="q", item="item").collect()}
    assert got == {"x": 0.032787, "y": 0.032266, "z": 0.014286}


@pytest.mark.parametrize("top,f,r,out", [(1.0, 0.5, 0.9, "generation"), (1.0, 0.9, 0.3, "generation"), (0.0, 0.9, 0.4, "retrieval"), (-1.0, 0.9, 0.9, "retrieval"), (None, 0.04, 0.9, "retrieval"), (None, 0.05, 0.9, "generation"), (None, 0.9, 0.5, "retrieval")])
def test_diagnose(spark, top, f, r, out):
    assert one(spark, x=grading.diagnose(F.lit(top).cast("double"), F.lit(f), F.lit(r))).x == out


@pytest.mark.parametrize("failure,attempt,plan", [("retrieval", 2, (True, 0)), ("retrieval", 3, (True, 3)), ("generation", 2, (False, 4)), ("generation", 3, (True, 3))])
def test_retry(spark, failure, attempt, plan):
    assert tuple(one(spark, x=grading.retry_plan(F.lit(failure), F.lit(attempt))).x) == plan


def test_texts(spark):
    r = one(
        spark, s=T.grader_sentences(F.lit("**Head**\nFirst sentence is here. Tiny. Second sentence is here\n\n")), n=T.is_negation(F.lit(" No, it does not. ")), m=T.is_negation(F.lit("Nothing of that kind")),
        v=T.verdict(F.lit("INCORRECT")), c=T.strip_chunk_refs(F.lit("As (Chunk 1) said in Chunk 2, this holds .")), w=T.written_part(F.lit("think STEP 2 — WRITE **ESSENCE: x")), e=T.strip_scaffolding(F.lit("## FINAL ANSWER FORMAT\nNow writing it\n\nThe answer")),
        t=T.is_title_case(F.lit("3.1 Self-Attention")), u=T.is_title_case(F.lit("Self-attention")), a=T.arxiv_id(F.lit("http://arxiv.org/abs/cs/0112017v3")), f=T.strip_fence(F.lit('```json\n{"a":1}\n```')), k=T.collection_name(F.lit("--My Paper!é 1--")),
        md=T.markdown_table(F.array(F.array(F.lit("a "), F.lit(None)), F.array(F.lit("1"), F.lit("2")))), refs=T.before_references(F.lit("body\nReferences\n[1]")), skip=T.is_skippable_error(F.lit("HTTP 429")),
    )
    assert r.s == ["**Head**", "First sentence is here.", "Second sentence is here"] and r.n and not r.m and r.v == "INCORRECT"
    assert r.c == "As said this holds." and r.w == "**ESSENCE: x" and r.e == "The answer" and r.t and not r.u and r.a == "cs/0112017"
    assert r.f == '{"a":1}' and r.k == "my-paper-é-1" and r.md == "| a |  |\n| --- | --- |\n| 1 | 2 |" and r.refs == "body" and r.skip


def test_vectors_and_confidence(spark):
    r = one(spark, c=V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), d=V.squared_l2(F.array(F.lit(1.0)), F.array(F.lit(3.0))), k=evaluation.confidence(F.lit(0.9), F.lit(0.5)), b=evaluation.judge_bucket(F.lit(0.25)))
    assert tuple(r) == (0.0, 4.0, 78.0, "PARTIAL")


def test_readers(spark, tmp_path):
    plan = spark.createDataFrame([('{"answer_type":"critique"}',), ("not json",), ("[1]",)], "raw string").select(readers.parse_plan(F.col("raw"), F.lit("q")).alias("p")).collect()
    assert [(r.p.answer_type, r.p.sub_questions, r.p.complexity) for r in plan] == [("critique", ["q"], "simple"), ("factual", ["q"], "simple"), ("factual", ["q"], "simple")]
    (tmp_path / "papers.json").write_text(json.dumps({"a": {"paper_id": "a", "filename": "f", "status": "ready", "uploaded_at": "2026-05-18T10:00:00"}, "b": {"paper_id": "b", "status": "failed", "uploaded_at": "2026-05-18T10:00:00+00:00"}}))
    assert {(r.paper_id, r.status, r.source_id) for r in readers.registry(spark, str(tmp_path / "papers.json")).collect()} == {("a", "ready", None), ("b", "failed", None)}
    xml = '<feed><entry><id>http://arxiv.org/abs/1706.03762v5</id><title>All\n you need</title><summary>s</summary><published>2017-06-12</published><author><name>A</name></author><author><name>B</name></author><link title="pdf" href="http://arxiv.org/pdf/1706.03762v5"/></entry></feed>'
    p = readers.arxiv_feed(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (p.id, p.title, p.year, p.pdf_url, p.authors) == ("1706.03762", "All you need", 2017, "https://arxiv.org/pdf/1706.03762v5.pdf", ["A", "B"])
    s = readers.scholar_results(spark.createDataFrame([('{"data":[{"paperId":"x","title":null,"openAccessPdf":null}]}',)], "json string")).first()
    assert (s.id, s.title, s.authors, s.pdf_url) == ("x", "", [], None)
    paper = {"p": {"title": "t", "abstract": "abs", "full_text": [{"section_name": "", "paragraphs": ["a", " ", "b"]}, {"section_name": "E", "paragraphs": []}, {"section_name": "L", "paragraphs": ["c"]}], "qas": []}}
    got = readers.paper_sections(readers.papers(spark.createDataFrame([(json.dumps(paper),)], "json string"))).collect()
    assert sorted((r.page_num, r.heading, r.body) for r in got) == [(0, "Abstract", "abs"), (1, "Section 1", "a\n\nb"), (3, "L", "c")]
    frames = spark.range(1).select(readers.sse_frames(F.lit('event: open\ndata: {"a":1}\n\nevent: x\ndata: {bad\n\nevent: cut')).alias("f")).first().f
    assert [(x.event, x.data) for x in frames] == [("open", '{"a":1}')]


def test_layout(spark):
    assert one(spark, x=layout.group_lines(F.array(*[F.lit(x) for x in (10.0, 11.5, 13.0, 30.0)]))).x == [10.0, 13.0, 30.0]


def test_discovery_and_registry(spark, tmp_path):
    rows = spark.createDataFrame([("q", 0, "Attention Is All You Need, a long title that goes on"), ("q", 1, "attention is all you need a long title that differs"), ("q", 2, "Other"), ("q", 3, "other!"), ("q", 4, "!!!")], "q string, pos long, title string")
    assert sorted(r.pos for r in discovery.dedup_titles(rows, by=["q"], title="title", pos="pos").collect()) == [0, 2]
    records = spark.createDataFrame([("a", "processing", None, None), ("b", "processing", None, None)], "paper_id string, status string, completed_at long, error string")
    updates = spark.createDataFrame([("a", 1, "failed", "x"), ("a", 2, "ready", ""), ("zz", 3, "ready", None)], "paper_id string, at long, status string, error string")
    assert {tuple(r) for r in sinks.registry_state(records, updates).collect()} == {("a", "ready", 2, None), ("b", "processing", None, None)}
    sinks.append_log(spark.createDataFrame([("p", "q" * 300, 12, 1.234)], "paper_id string, question string, duration_ms long, confidence double"), str(tmp_path / "log"))
    log = readers.query_log(spark, str(tmp_path / "log")).first()
    assert len(log.question) == 200 and log.confidence == 1.23 and len(log.req_id) == 8


def test_grades_and_attempts(spark):
    s = spark.createDataFrame([(1, 1, "x" * 70 + "a", False), (1, 2, "x" * 70 + "b", True), (1, 3, "third", False)], "q int, pos int, sentence string, negation boolean")
    g = spark.createDataFrame([(1, 1, "x" * 60, "DIRECT"), (1, 2, "x" * 60, "UNSUPPORTED")], "q int, pos int, sentence string, grade string")
    assert [(r.grade, r.kept) for r in grading.join_grades(s, g, by=["q"]).orderBy("pos").collect()] == [("UNSUPPORTED", False), ("UNSUPPORTED", False), ("INFERRED", True)]
    assert [r.grade for r in grading.zip_grades(s, g.select("q", "pos", "grade"), by=["q"]).orderBy("pos").collect()] == ["DIRECT", "INFERRED", "UNSUPPORTED"]
    q = spark.createDataFrame([(1, 90.0), (2, 40.0), (3, 10.0)], "qid int, base double")
    attempt = lambda df, n: df.select("qid", "base", (F.col("base") + 10.0 * n).alias("confidence"), F.lit(0.5).alias("relevancy"), F.lit("retrieval").alias("failure_type"))
    out = {r.qid: (r.attempt, r.confidence) for r in grading.answer_loop(q, attempt, by="qid", cut=lambda d: d).collect()}
    assert out == {1: (1, 100.0), 2: (1, 50.0), 3: (3, 40.0)}


def test_models(spark):
    class Broken:
        def complete(self, messages, max_tokens, temperature):
            raise RuntimeError("429 rate")

    class Fine:
        def complete(self, messages, max_tokens, temperature):
            return messages[0]["content"].upper()

    p = models.Providers([("a", Broken()), ("b", Fine())])
    assert p.complete([{"content": "x"}]) == "X" and p.calls == ["b"]
    with pytest.raises(RuntimeError):
        models.Providers([("a", Broken())]).complete([{"content": "x"}])
    df = spark.createDataFrame([("hello",)], "prompt string")
    assert models.complete(df, "prompt", "out", Fine).first().out == "HELLO"
    v = df.select(models.hashed_embedding(F.col("prompt"), 8).alias("v")).first().v
    assert abs(sum(x * x for x in v) - 1) < 1e-9
