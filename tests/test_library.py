"""Operators that no table of the driver exercises: pages, prompts, grading, evaluation and streams, on small fixtures."""

import json
import math
import os
import random
import sys
import tarfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sparrowdoc import prompts
from sparrowdoc.operators import chunking, discovery, evaluation, grading, ingest, library, pages, retrieval
from sparrowdoc.sources import readers, sinks
from sparrowdoc.streaming import events as S


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models below go to the workers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


class Says:
    """A model that answers each prompt by the first of its keys that the prompt holds."""

    def __init__(self, replies):
        self.replies = replies

    def complete(self, messages, max_tokens, temperature):
        for key, reply in self.replies.items():
            if key in messages[0]["content"]:
                if reply is None:
                    raise RuntimeError("down")
                return reply
        raise RuntimeError("no reply")


def glyphs(spark, rows):
    """Words as glyphs of 5 points a character: (page, x, top, text, size)."""
    out = []
    for page, x, top, text, size in rows:
        at = x
        for c in text:
            if c != " ":
                out.append(("p", page, 600.0, c, float(at), float(at + 5), float(top), 800.0 - top - size, 800.0 - top, float(size), True))
            at += 5
    return spark.createDataFrame(out, pages.GLYPHS)


def test_two_columns_are_read_left_then_right(spark):
    rows = [(1, 50, 20, "A wide title that flows through the middle of the page and further on to its right end now", 12)]
    for i in range(12):
        rows.append((1, 50, 100 + i * 20, f"left line {i:02d} with some words in it", 10))
        rows.append((1, 330, 100 + i * 20, f"right line {i:02d} with some words", 10))
    rows.append((1, 50, 600, "a footer that flows through the middle of the page and further on to the right end of it", 8))
    rows += [(2, 50, 100 + i * 20, f"only line {i} that runs from one margin of the page to the other, through its middle", 10) for i in range(6)]
    table = glyphs(spark, rows)
    rotated = table.limit(1).withColumns({"upright": F.lit(False), "text": F.lit("@")})
    got = pages.page_lines(table.unionByName(rotated)).orderBy("page_num", "line_index").collect()
    first = [r.text for r in got if r.page_num == 1]
    assert first[0].startswith("A wide title") and first[-1].startswith("a footer") and len(first) == 26
    assert first[1:13] == [f"left line {i:02d} with some words in it" for i in range(12)]
    assert first[13:25] == [f"right line {i:02d} with some words" for i in range(12)]
    assert [r.text[:11] for r in got if r.page_num == 2] == [f"only line {i}" for i in range(6)]
    assert {r.page_num for r in pages.column_boundary(table).collect()} == {1}
    assert pages.page_text(pages.page_lines(table.where("page_num = 2"))).first().text.split("\n")[1].startswith("only line 1")


def test_headings_to_sections(spark):
    rows = [(1, 50, 20, "1 Introduction", 14), (1, 50, 60, "some body text in plain words, which ends with a stop.", 10), (1, 50, 80, "more body text in plain words, which ends with a stop.", 10), (1, 50, 120, "Figure One", 14), (1, 50, 160, "last words of the body here, which end with a stop too.", 10)]
    table = glyphs(spark, rows)
    lines = pages.page_lines(table)
    found = pages.heading_candidates(lines, pages.body_size(table))
    assert [(r.id, r.candidate_line) for r in found.orderBy("id").collect()] == [(1, "1 Introduction"), (2, "Figure One")]
    assert found.where("id = 1").first().context.startswith("some body text")
    replies = prompts.confirm_headings(found, lambda: Says({"1 Introduction": "1 | SECTION\n2 | NONE"}))
    good = pages.confirmed(found, replies)
    assert [r.candidate_line for r in good.collect()] == ["1 Introduction"]
    marked = pages.headed(lines, good)
    assert [r.is_heading for r in marked.orderBy("line_index").collect()] == [True, False, False, False, False]


def test_pdf_scan_and_archive(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x|y")
    (tmp_path / "b.PDF").write_bytes(b"z")
    parse = lambda: lambda content: [(600, [{"text": t, "x0": 0.0, "upright": True} for t in content.decode().split("|")]), (600, [])]
    got = pages.scan_pdf(spark, str(tmp_path), parse).collect()
    assert [(r.paper_id, r.page_num, r.text, r.upright) for r in got] == [("a", 1, "x", True), ("a", 1, "y", True)]
    (tmp_path / "qasper.json").write_text('{"p": {"title": "t"}}')
    with tarfile.open(tmp_path / "q.tgz", "w:gz") as tar:
        tar.add(tmp_path / "qasper.json", "deep/qasper.json")
    assert json.loads(readers.qasper_archive(spark, str(tmp_path / "q.tgz"), "qasper.json").first().json) == {"p": {"title": "t"}}
    (tmp_path / "c.json").write_text('[{"id": 1, "confidence": 3.5, "label": null}, {"id": 2, "label": "BAD"}]')
    assert [(r.id, r.confidence, r.label) for r in readers.calibration(spark, str(tmp_path / "c.json")).collect()] == [(1, 3.5, None), (2, None, "BAD")]
    xml = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1706.03762v5</id><title>T</title><summary>s</summary><published>2017-06-12</published><author><name>A</name></author></entry></feed>'
    p = readers.arxiv_feed(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (p.id, p.title, p.pdf_url) == ("1706.03762", "T", "https://arxiv.org/pdf/1706.03762.pdf")


def test_ingest(spark):
    sections = spark.createDataFrame([("p", 1, "Intro", "body", 1, "one two three four five"), ("p", 2, "Blank", "body", 1, "  "), ("p", 3, "Again", "body", 2, "four five")], "paper_id string, section_no long, heading string, type string, page_num int, body string")
    tables = pages.tables(spark.createDataFrame([("p", 3, 0, [["a", "b"], ["1", None]]), ("p", 3, 1, [["only"], ["x"]])], "paper_id string, page_num int, pos int, cells array<array<string>>"))
    chunks = ingest.paper_chunks(ingest.chunk_sections(sections, size=3, overlap=1), tables).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.section, r.chunk_index, r.total_chunks_in_section, r.text) for r in chunks[:3]] == [(1, "Intro", 0, 3, "one two three"), (2, "Intro", 1, 3, "three four five"), (3, "Intro", 2, 3, "five")]
    assert chunks[-1].section == "Table 1 (page 3)" and chunks[-1].text == "| a | b |\n| --- | --- |\n| 1 |  |" and len(chunks) == 5
    rows = ingest.ingest(sections, tables, embed=lambda t: F.array(F.length(t).cast("float")), size=2, overlap=0)
    assert sum(r.document == "five" for r in rows.collect()) == 1 and rows.first().metadata.asDict().keys() == set(ingest.METADATA)
    up = chunking.upsert(spark.createDataFrame([("p", "x", 9)], "paper_id string, text string, chunk_id int"), spark.createDataFrame([("p", "x", 2), ("p", "x", 1)], "paper_id string, text string, chunk_id int"), order=["chunk_id"])
    assert [(r.text, r.chunk_id) for r in up.collect()] == [("x", 1)]
    shown = ingest.sources(spark.createDataFrame([("q", 1, "p", "s", None, 3, None, "t" * 700)], "query_id string, rank int, paper_id string, section string, section_type string, page_num int, chunk_index int, text string")).first()
    assert (shown.section_type, shown.chunk_index, len(shown.text)) == ("text", 0, 600)


def test_bm25_fills_with_chunks_of_score_zero(spark):
    chunks = spark.createDataFrame([("a", 1, "x y"), ("a", 2, "z"), ("a", 3, "w"), ("b", 4, "x")], "paper string, id int, t string").select("paper", "id", F.split("t", " ").alias("tokens"))
    q = spark.createDataFrame([("a", 7, "x"), ("b", 8, "nothing")], "paper string, q int, said string")
    scored = retrieval.bm25(retrieval.postings(chunks, ["paper", "id"]), chunks, q, ["id"], query_key="q", query_text="said", scope=["paper"])
    got = retrieval.bm25_top(scored, chunks, q, query_key="q", pos="id", k=2, scope=["paper"]).orderBy("q", "rank").collect()
    assert [(r.q, r.id, r.rank) for r in got] == [(7, 1, 1), (7, 2, 2), (8, 4, 1)] and got[1].score == 0.0
    a = spark.createDataFrame([("q", "x", 1, "lexical")], "q string, item string, rank int, p string")
    b = spark.createDataFrame([("q", "x", 2, "dense"), ("q", "y", 1, "dense")], "q string, item string, rank int, p string")
    assert {r.item: r.p for r in retrieval.reciprocal_rank_fusion(a, b, by="q", item="item", payload=["p"]).collect()} == {"x": "lexical", "y": "dense"}


def test_scoped_hybrid_and_route(spark):
    texts = ["adam optimizer beta", "attention is all you need", "adam beta warmup steps", "beams search width"]
    chunks = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)] + [("other", 9, texts[0])], "paper string, chunk_id int, text string")
    plan = lambda kind, subs: {"answer_type": kind, "key_concepts": [], "sub_questions": subs, "answer_structure": [], "complexity": "multi_hop" if subs else "simple"}
    rows = [("p", 1, "adam beta", plan("factual", []), "warmup"), ("p", 2, "attention", plan("analysis", ["beams", "attention"]), None)]
    asked = spark.createDataFrame(rows, "paper string, query_id int, query string, plan struct<answer_type:string,key_concepts:array<string>,sub_questions:array<string>,answer_structure:array<string>,complexity:string>, hyde string")
    out = retrieval.route(asked, chunks, scope=["paper"]).orderBy("query_id", "new_rank").collect()
    assert {r.chunk_id for r in out} <= {0, 1, 2, 3} and [r.chunk_id for r in out if r.query_id == 1][:2] == [0, 2] and len([r for r in out if r.query_id == 1]) == 3
    assert [r.chunk_id for r in out if r.query_id == 2][0] == 1
    plain = retrieval.route(asked, chunks, scope=["paper"], reranked=False, hyde=False).where("query_id = 2").orderBy("new_rank").collect()
    assert plain[0].chunk_id == 1 and [r.new_rank for r in plain] == [1, 2, 3, 4]


ANSWER = "**Head**\nThe first sentence is here. A second sentence is here. The paper does not say more. Tiny.\n\n\n\nA last sentence stands here"


def brute_grade(answer, grades):
    """The reconstruction by loops."""
    sentences = []
    for line in (x.strip() for x in answer.split("\n")):
        if line.startswith("**") and line.endswith("**") and line:
            sentences.append(line)
            continue
        parts = line.split(". ")
        sentences += [u for u in ((p.strip() + "." if i < len(parts) - 1 else p.strip()) for i, p in enumerate(parts) if p.strip()) if len(u) > 15]
    queue, given = list(grades), {}
    for s in sentences:
        low = s.lower()
        g = ("INFERRED", "negation") if low.startswith("the paper does not") else queue.pop(0) if queue else ("INFERRED", "none")
        given[s[:60].strip()] = g
    return [(s, given[s[:60].strip()][0]) for s in sentences]


def test_grade_answers(spark):
    grades = [("**Head**", "INFERRED"), ("The first sentence is here.", "DIRECT"), ("A second sentence is here.", "UNSUPPORTED")]
    raw = "```json\n" + json.dumps([{"sentence": s, "grade": g, "chunk_ref": "header" if s.startswith("**") else "1"} for s, g in grades]) + "\n```"
    rows = spark.createDataFrame([(1, ANSWER, raw), (2, ANSWER, "no list"), (3, "", raw), (4, "The paper does not say so at all.", "no list")], "id int, answer string, raw string")
    out = {r.id: r for r in grading.grade_answers(rows.withColumn("grades", grading.parse_grades(F.col("raw"))), by=["id"]).collect()}
    assert [(g.sentence, g.grade) for g in out[1].grades] == brute_grade(ANSWER, [(g, "1") for _, g in grades])
    assert out[1].cleaned_answer == "**Head**\nThe first sentence is here. The paper does not say more. Tiny.\n\nA last sentence stands here"
    assert (out[1].removed_count, out[1].grading_failed) == (1, False)
    assert out[2].grading_failed and out[2].cleaned_answer == ANSWER and out[2].grades == []
    assert (out[3].cleaned_answer, out[3].grades, out[3].grading_failed) == ("", [], False)
    assert out[4].grades[0].chunk_ref == "negation" and not out[4].grading_failed
    ratio = spark.createDataFrame([out[1]]).select(grading.direct_ratio(F.col("grades")).alias("r")).first().r
    assert (ratio.direct, ratio.inferred, ratio.ratio, ratio.bucket) == (1, 2, pytest.approx(1 / 3), "weak")
    assert grading.flag(" Yes ") and not grading.flag("0") and [grading.attempts_setting(x) for x in ("9", "0", "two", None)] == [3, 1, 3, 3]


def test_evaluate_questions(spark):
    preds = spark.createDataFrame([("a", "the cat sat", True), ("b", "cannot answer", True), ("c", "x", False)], "question_id string, answer string, passed boolean")
    golds = spark.createDataFrame([("a", 0, "extractive", True, "a cat sat", ["cat sat here", " "]), ("a", 1, "abstractive", True, "dog", ["cat sat here", "more"]), ("b", 0, "none", False, "", [])], "question_id string, pos int, type string, answerable boolean, text string, evidence array<string>")
    found = spark.createDataFrame([("a", 1, "a cat sat there"), ("a", 2, "other")], "question_id string, rank int, text string")
    out = {r.question_id: r for r in evaluation.evaluate_questions(preds, golds, found).collect()}
    assert (out["a"].answer_f1, out["a"].gold_type, out["a"].evidence_recall, out["a"].answerable_correct) == (1.0, "extractive", 0.5, True)
    # cat sat here more against cat sat there other
    assert out["a"].evidence_f1 == pytest.approx(0.5) and out["b"].evidence_f1 is None and out["b"].evidence_recall is None
    assert (out["b"].answer_f1, out["b"].gold_type, out["b"].answerable_correct) == (1.0, "unanswerable", True)
    assert (out["c"].answer_f1, out["c"].gold_answerable, out["c"].gold_type) == (0.0, False, "unanswerable")
    papers = spark.createDataFrame([(0, "p", ["x"], [{"question_id": "1", "question": "q", "answers": []}, {"question_id": "2", "question": "r", "answers": []}]), (1, "empty", [], [])], "pos int, paper_id string, full_text array<string>, qas array<struct<question_id:string,question:string,answers:array<string>>>")
    assert [r.question_id for r in evaluation.question_rows(papers, per_paper=1).collect()] == ["1"]
    assert evaluation.question_rows(papers).count() == 2
    votes = spark.createDataFrame([(1, "CORRECT"), (1, "INCORRECT"), (1, "ERROR"), (2, "UNPARSED")], "id int, verdict string")
    got = {r.id: (r.score, r.verdict, r.n_votes) for r in evaluation.judge_votes(votes, by=["id"]).collect()}
    assert got == {1: (0.5, "PARTIAL", 2), 2: (None, "UNPARSED", 0)}


def test_ablations(spark):
    questions = spark.createDataFrame([(1,)], "id int")
    out = evaluation.run_ablations(questions, lambda q, off: q.withColumn("off", F.lit(",".join(sorted(off)))), ["full", "no_hyde"])
    assert {(r.config, r.off) for r in out.collect()} == {("full", ""), ("no_hyde", "hyde")}
    with pytest.raises(ValueError, match="nope"):
        evaluation.run_ablations(questions, lambda q, off: q, ["nope"])
    r = one(spark, h=evaluation.hits_expected(F.lit("3 Results"), F.lit(4), F.lit("results"), F.lit(9)), m=evaluation.hits_expected(F.lit("x"), F.lit(4), F.lit("y"), F.lit(5)), d=evaluation.duration_ms(F.lit("2026-01-01 00:00:00").cast("timestamp"), F.lit("2026-01-01 00:00:01.5").cast("timestamp")), i=evaluation.run_id(F.lit("2026-01-02 03:04:05").cast("timestamp")))
    assert (r.h, r.m, r.d, r.i) == (True, False, 1500, "20260102_030405")
    rows = spark.createDataFrame([(True, 0.0, "w"), (True, 0.0, None), (False, 9.0, None)], "gold_answerable boolean, confidence double, warning string")
    assert evaluation.gradable(rows).count() == 1


def test_prompts(spark):
    replies = {
        "Plan how": '```json\n{"answer_type":"critique","key_concepts":["a"],"complexity":"multi_hop"}\n```', "Write three": "a passage", "Split this": '["x","y"]', "Answer the question": "thinking [WRITE] **ESSENCE:** yes, see Chunk 3.",
        "Grade each": "broken", "Rewrite this": None, "OFFTOPIC": "offtopic.", "Is the answer right": "That is INCORRECT", "List the technical": '[{"term":"t","definition":"d"}]', "three short searches": '["s1","s2","s3","s4"]',
    }
    client = lambda: Says(replies)
    rows = spark.createDataFrame([(1, "why?", "paper")], "query_id int, query string, paper string")
    planned = prompts.plan_queries(rows, client)
    p = planned.first().plan
    assert (p.answer_type, p.key_concepts, p.sub_questions, p.complexity) == ("critique", ["a"], ["why?"], "multi_hop")
    assert prompts.hypothetical(planned, client).first().hyde == "a passage" and prompts.hypothetical(planned, lambda: Says({})).first().hyde == "why?"
    assert prompts.decompose(rows, client).first().sub_questions == ["x", "y"] and prompts.decompose(rows, lambda: Says({"Split": '["x"]'})).first().sub_questions == ["why?"]
    assert prompts.decompose(rows, lambda: Says({"Split": "[1, 2]"})).first().sub_questions == ["why?"]
    found = spark.createDataFrame([(1, "paper", 2, "S", 3, "two"), (1, "paper", 1, None, None, "one")], "query_id int, paper_id string, rank int, section string, page_num int, text string")
    block = prompts.context(found, "query_id")
    assert block.first().context == "[Chunk 1 | Section: ? | Page: ?]\none\n\n---\n\n[Chunk 2 | Section: S | Page: 3]\ntwo"
    full = prompts.generate(planned.join(block, "query_id"), client)
    a = full.first()
    assert (a.reasoning, a.answer, a.failed) == ("thinking [WRITE]", "**ESSENCE:** yes, .", False) or a.answer.startswith("**ESSENCE:** yes,")
    assert prompts.generate(planned.join(block, "query_id"), lambda: Says({})).first().failed
    g = prompts.grade(spark.createDataFrame([(1, "A sentence to be graded here", "c")], "query_id int, answer string, context string"), client, by=["query_id"]).first()
    assert g.grading_failed and g.cleaned_answer == "A sentence to be graded here"
    assert prompts.expand(rows, client).first().expanded == "why?" and prompts.off_topic(rows, client).first().off_topic and not prompts.off_topic(rows, lambda: Says({})).first().off_topic
    judged = prompts.judge(spark.createDataFrame([(1, "q", ["g"], "a")], "query_id int, question string, gold array<string>, answer string"), client, by=["query_id"]).first()
    assert (judged.score, judged.verdict, judged.n_votes) == (0.0, "INCORRECT", 3)
    assert prompts.judge(spark.createDataFrame([(1, "q", ["g"], "a")], "query_id int, question string, gold array<string>, answer string"), lambda: Says({}), by=["query_id"]).first().verdict == "ERROR"
    assert [(r.term, r.definition) for r in prompts.glossary(found, client).collect()] == [("t", "d")] and prompts.glossary(found, lambda: Says({})).count() == 0
    assert [r.search_query for r in prompts.related_queries(found, client).orderBy("pos").collect()] == ["s1", "s2", "s3"]


def test_registry_and_lists(spark, tmp_path):
    new = library.register(spark.createDataFrame([("f.pdf", None)], "filename string, source_id string")).first()
    assert new.status == "processing" and len(new.paper_id) == 36 and new.uploaded_at.endswith(("Z", "+00:00"))
    library.insert(str(tmp_path / "r"), spark.createDataFrame([("a",)], "paper_id string"))
    library.insert(str(tmp_path / "r"), spark.createDataFrame([("b",)], "paper_id string"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert library.uploads(spark.createDataFrame([("x.pdf",), ("y.PDF",)], "path string")).count() == 1
    hits = spark.createDataFrame([("q", "1", "t", 1), ("q", "1", "t", 2), ("q", "", "u", 3)], "paper string, id string, title string, pos int")
    assert [(r.id, r.rank) for r in discovery.recommendations(hits, by="paper", order=["pos"]).orderBy("rank").collect()] == [("1", 1), ("", 2)]
    with pytest.raises(ValueError):
        sinks.write_summary(spark.range(sinks.SUMMARY_ROWS + 1), str(tmp_path / "s"))
    sinks.write_rows(spark.range(3), str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 3


def stream(spark, tmp_path, batches, schema, build, mode="append"):
    """Runs ``build`` as a stream over one file a batch, oldest first, and gives the sink's rows."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    df = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    S.drain(df, str(out), str(tmp_path / "state"), mode)
    return spark.read.schema(df.schema).parquet(str(out)).collect()


def test_progress_stream_drops_late_events(spark, tmp_path):
    at = lambda minute, second=0: f"2026-01-01T00:{minute:02d}:{second:02d}Z"
    batches = [
        [{"req_id": "a", "at": at(0), "stage": "planning"}, {"req_id": "a", "at": at(0, 40), "stage": "done"}, {"req_id": "b", "at": at(0), "stage": "planning"}],
        [{"req_id": "a", "at": at(0, 20), "stage": "retrieving"}],  # late, but within the watermark
        [{"req_id": "c", "at": at(40), "stage": "planning"}],
        [{"req_id": "c", "at": at(40, 30), "stage": "error"}],  # late rows are told by the watermark of the batch before
        [{"req_id": "b", "at": at(0, 10), "stage": "done"}],  # beyond the watermark
        [{"req_id": "d", "at": at(59), "stage": "planning"}],
        [{"req_id": "e", "at": at(59), "stage": "planning"}],
    ]
    got = stream(spark, tmp_path, batches, "req_id string, at timestamp, stage string", lambda df: S.outcome(S.progress(df)))
    rows = {r.req_id: (r.stages, r.outcome) for r in got}
    assert rows["a"] == (["planning", "retrieving", "done"], "done") and rows["b"] == (["planning"], "timeout") and rows["c"] == (["planning", "error"], "error") and "d" not in rows


def test_log_and_dedup_streams(spark, tmp_path):
    row = lambda minute, ok, attempts=1, c=50.0: {"at": f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "passed": ok, "attempts": attempts, "confidence": c}
    batches = [[row(1, True), row(2, False, 0, 0.0)], [row(90, True)], [row(91, True)], [row(3, True)], [row(300, True)], [row(301, True)]]
    got = stream(spark, tmp_path, batches, "at timestamp, passed boolean, attempts int, confidence double", S.log_windows)
    assert sorted((r.start.hour, r.n, r.passed, r.mean_confidence) for r in got) == [(0, 2, 1, 25.0), (1, 2, 2, 50.0)]
    (tmp_path / "d").mkdir()
    twice = [[{"event_id": 1, "ts": "2026-01-01T00:00:00Z"}], [{"event_id": 1, "ts": "2026-01-01T00:00:00Z"}, {"event_id": 2, "ts": "2026-01-01T00:00:01Z"}]]
    assert sorted(r.event_id for r in stream(spark, tmp_path / "d", twice, "event_id long, ts timestamp", S.deduplicated)) == [1, 2]


def test_status_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"paper_id": "a", "at": 1, "status": "ready", "error": null}')
    records = spark.createDataFrame([("a", "processing", None, None)], "paper_id string, status string, completed_at long, error string")
    seen = []
    source = spark.readStream.schema("paper_id string, at long, status string, error string").json(str(tmp_path / "in"))
    S.upsert_status(source, lambda rows, _: seen.extend(sinks.registry_state(records, rows).collect())).awaitTermination()
    assert [(r.paper_id, r.status, r.completed_at) for r in seen] == [("a", "ready", 1)]


def test_line_anchors_are_the_loop(spark):
    r = random.Random(4)
    tops = [round(r.uniform(0, 60), 1) for _ in range(80)]
    anchors = []
    for t in sorted(tops):
        if not anchors or abs(t - anchors[-1]) > 2:
            anchors.append(t)
    table = spark.createDataFrame([("p", 1, t) for t in tops], "paper_id string, page_num int, top double")
    got = {(x.top, x.y) for x in pages.lined(table, pages.PAGE).collect()}
    assert got == {(t, max(a for a in anchors if a <= t)) for t in tops} and not math.isnan(sum(tops))


def test_knn_in_blocks_is_knn(spark):
    r = random.Random(2)
    v = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(60)], "id int, v array<double>")
    q = v.where("id % 3 = 0")
    run = lambda rows: sorted(map(tuple, retrieval.knn(q, v, query_id="id", query_vector="v", vector_id="id", vector="v", k=3, rows=rows).collect()))
    assert run(50_000) == run(7) and len(run(7)) == 60


def test_titles_of_one_beginning(spark):
    r = random.Random(3)
    start = "a study of long titles that go on and on"
    titles = [start + " " + "".join(r.choice("xyz") for _ in range(3)) for _ in range(20)] + [start[:20], start[:33], start[:12], "b" * 14, "b" * 40, "b" * 13, start[:30] + " other words at the end of it"]
    r.shuffle(titles)
    kept = []
    for i, t in enumerate(titles):
        alike = lambda o: o == t or (len(min(o, t, key=len)) > 12 and sorted((o, t), key=len)[1].startswith(sorted((o, t), key=len)[0][:35]))
        if not any(alike(o) for _, o in kept):
            kept.append((i, t))
    df = spark.createDataFrame([("q", i, t) for i, t in enumerate(titles)], "q string, pos long, title string")
    assert sorted(x.pos for x in discovery.dedup_titles(df, by=["q"], title="title", pos="pos").collect()) == [i for i, _ in kept]


class Writer:
    """Plans simply, answers with the passages' first sentence, and grades everything as direct."""

    def complete(self, messages, max_tokens, temperature):
        text = messages[0]["content"]
        if text.startswith("Answer the question"):
            if "nonsense" in text.rsplit("Question:", 1)[1]:
                return "[WRITE] Something else entirely that no passage of the paper holds"
            return "[WRITE] " + text.split("]\n", 1)[1].split("\n")[0]
        if text.startswith("Grade each"):
            n = text.rsplit("Sentences:", 1)[1].count("\n")
            return json.dumps([{"sentence": "s", "grade": "DIRECT", "chunk_ref": "1"}] * n)
        raise RuntimeError("429")


def test_answers_and_comparison(spark):
    from sparrowdoc import qa

    chunks = spark.createDataFrame([("p", 1, "Intro", 1, "The optimizer is adam with beta values of the usual kind"), ("p", 2, "Data", 2, "The corpus has ten thousand sentences of plain news text"), ("o", 3, "Intro", 1, "The optimizer is plain descent without any momentum at all")], "paper_id string, chunk_id int, section string, page_num int, text string")
    asked = spark.createDataFrame([(1, "p", "Paper", "The optimizer is adam with beta values of the usual kind"), (2, "p", "Paper", "nonsense zebra")], "query_id int, paper_id string, paper string, query string")
    out = {r.query_id: r for r in qa.answer(asked, chunks, Writer).collect()}
    assert out[1].cleaned_answer.startswith("The optimizer is adam") and out[1].passed and out[1].attempt == 1 and out[1].faithfulness == 1.0
    assert not out[2].passed and out[2].confidence < 50
    both = qa.ablate(asked.where("query_id = 1"), chunks, Writer, ["full", "baseline"]).collect()
    assert {r.config for r in both} == {"full", "baseline"}
    top = qa.hybrid_with_rerank(asked, chunks, k=1).where("query_id = 1").first()
    assert (top.chunk_id, top.new_rank) == (1, 1)
    answers, sources = qa.compare(spark.createDataFrame([(7, "which optimizer", "p", "o")], "query_id int, query string, paper_a string, paper_b string"), chunks, Writer)
    assert answers.first().answer and {(r.paper_id, r.label) for r in sources.collect()} == {("p", "A"), ("o", "B")}
    paper = {"p": {"title": "t", "abstract": "an abstract", "full_text": [{"section_name": "S", "paragraphs": ["some words here"]}], "qas": []}}
    stored = qa.ingest_papers(readers.papers(spark.createDataFrame([(json.dumps(paper),)], "json string"))).collect()
    assert {r.document for r in stored} == {"an abstract", "some words here"}
