"""Calls of models: deadlines, concurrency, what they cost, and pairs scored in batches."""

import json
import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sparrowdoc import models, prompts, qa
from sparrowdoc.operators import retrieval
from sparrowdoc.sources import readers

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Sleeper:
    """Answers after as many tenths of a second as the prompt says."""

    name = "sleeper"

    def complete(self, messages, max_tokens, temperature):
        said = messages[0]["content"]
        if said == "down":
            raise RuntimeError("broken")
        time.sleep(int(said) / 10)
        return f"slept {said}"


class Limited:
    def complete(self, messages, max_tokens, temperature):
        raise RuntimeError("429 too many requests")


class Null:
    def complete(self, messages, max_tokens, temperature):
        return None


def asked(spark, said):
    return models.accounted(spark.createDataFrame(list(enumerate(said)), "n int, p string").coalesce(1))


def test_a_call_beyond_its_deadline_is_a_value(spark):
    rows = asked(spark, ["0", "40", "1", "down", "0"])
    got = sorted(models.complete(rows, "p", "r", Sleeper, deadline=1.0, fallback=lambda p: f"no {p}").collect())
    assert [r.r for r in got] == ["slept 0", "no 40", "slept 1", "no down", "slept 0"]
    assert [r.calls[0].status for r in got] == ["ok", "expired", "ok", "failed", "ok"]
    assert 1000 <= got[1].calls[0].ms < 3900 and got[0].calls[0].provider == "sleeper"


def test_calls_of_a_task_run_together_and_keep_their_places(spark):
    rows = asked(spark, [str(4 - i % 5) for i in range(20)])
    models.complete(rows.limit(1), "p", "r", Sleeper).collect()
    began = time.time()
    got = sorted(models.complete(rows, "p", "r", Sleeper, at_once=10).collect())
    assert time.time() - began < 3  # one after the other they would sleep for four seconds
    assert [r.r for r in got] == [f"slept {4 - i % 5}" for i in range(20)]


def chain():
    return models.Providers([("first", Limited()), ("second", Null()), ("third", Sleeper())])


def test_the_account_names_who_answered(spark):
    once = models.complete(asked(spark, ["0", "down"]), "p", "r", chain)
    twice = models.complete(once.drop("r"), "p", "r", lambda: models.Providers([("only", Sleeper())]))
    a, b = twice.withColumns(models.call_totals(F.col("calls"))).orderBy("n").collect()
    assert (a.llm_calls, a.providers, [c.tries for c in a.calls]) == (2, ["third", "only"], [3, 1])
    assert (b.llm_calls, b.providers, [c.status for c in b.calls]) == (0, [], ["failed", "failed"])
    assert models.complete(asked(spark, ["0"]).drop("calls"), "p", "r", chain).columns == ["n", "p", "r"]


def test_clients_say_how_they_are_asked(spark):
    def client():
        return Sleeper()

    client.deadline = 0.5
    got = prompts.ask(asked(spark, ["30"]), F.col("p"), client, max_tokens=5, temperature=0.0).first()
    assert got.reply is None and got.calls[0].status == "expired"


class Writer:
    """Plans, writes and grades; never sure of itself for questions on nothing."""

    name = "writer"

    def complete(self, messages, max_tokens, temperature):
        said = messages[0]["content"]
        if said.startswith("Plan"):
            return json.dumps({"answer_type": "factual", "key_concepts": ["adam"], "sub_questions": [], "answer_structure": ["say it"], "complexity": "simple"})
        if "[WRITE]" in said:
            return "[WRITE] **ESSENCE:** The optimizer is adam with warm restarts and decay. **DETAIL:** none" if "adam" in said.split("Question:")[1] else "[WRITE] Volcanoes erupt far from any harbour every spring morning."
        if said.startswith("Grade"):
            return "[]"
        return "a passage"


def test_answers_are_logged_with_what_they_cost(spark, tmp_path):
    chunks = spark.createDataFrame([("p", 1, "Methods", 1, "The optimizer is adam with warm restarts and decay."), ("p", 2, "Data", 2, "The corpus holds letters.")], "paper_id string, chunk_id int, section string, page_num int, text string")
    questions = spark.createDataFrame([(1, "p", "Paper", "which adam optimizer is it with warm restarts and decay"), (2, "p", "Paper", "zzz qqq")], "query_id int, paper_id string, paper string, query string")
    answers = qa.answer(questions, chunks, Writer)
    good, bad = answers.orderBy("query_id").collect()
    assert good.passed and good.warning is None and good.failure_type is None
    assert good.llm_calls == len(good.providers) >= 3 and set(good.providers) == {"writer"} and good.duration_ms >= 0
    assert not bad.passed and bad.warning and bad.failure_type in ("out_of_domain", "retrieval", "generation")
    qa.log_answers(answers, questions, f"{tmp_path}/log")
    log = {r.question: r for r in readers.query_log(spark, f"{tmp_path}/log").collect()}
    assert log["zzz qqq"].llm_calls == bad.llm_calls and log["zzz qqq"].paper_id == "p" and not log["zzz qqq"].passed
    assert sorted(log["zzz qqq"].providers) == sorted(bad.providers)


class Overlap:
    """Counts shared words; tells when it was built and how long its batches are."""

    def __call__(self, queries, texts):
        assert len(queries) <= 4 and sorted(map(len, texts)) == [len(t) for t in texts]
        return np.array([len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.lower().split()))) for q, t in zip(queries, texts, strict=True)])


def test_pairs_are_scored_in_batches_by_length(spark):
    said = ["adam beta", "adam", "", None, "beta adam warm steps", "the corpus", "a b c d e f adam", "BETA"]
    pairs = spark.createDataFrame([(i % 2, i, "adam beta", t) for i, t in enumerate(said * 3)], "q int, n int, query string, text string").coalesce(1)
    one = retrieval.rerank(pairs.na.fill(""), by="q", query="query", text="text", tie="n", k=5).select("q", "n", "new_rank").collect()
    with pytest.raises(Exception, match="AssertionError"):
        models.score_pairs(pairs, "query", "text", "s", Overlap, batch=5).collect()
    two = models.score_pairs(pairs, "query", "text", "rerank_score", Overlap, batch=4)
    two = retrieval.top(two, "q", [F.desc(F.round("rerank_score", 6)), F.col("n")], 5, "new_rank").select("q", "n", "new_rank").collect()
    assert sorted(one) == sorted(two)
