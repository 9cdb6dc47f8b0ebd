"""Operators that ask a chat model: each builds a prompt column, asks once for each row, reads the reply, and falls back.

``client`` is a factory, called once in each task (models.complete). A call that fails gives a null reply, which every
operator turns into its own fallback; only ``generate`` marks the row as failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import context_entry, numbered, split_response, strip_chunk_refs, strip_fence, verdict
from .models import ChatModel, complete
from .operators import evaluation, grading
from .sources.readers import parse_plan

Client = Callable[[], ChatModel]


def ask(rows: DataFrame, prompt: Column, client: Client, *, max_tokens: int, temperature: float, out: str = "reply") -> DataFrame:
    """``rows`` with the model's reply; null where the call failed. A column ``calls`` gets the call appended.

    A client may say, by its attributes ``at_once`` and ``deadline``, how many calls a task has under way and for how long.
    """
    options = {k: getattr(client, k) for k in ("at_once", "deadline") if hasattr(client, k)}
    asked = complete(rows.withColumn("_prompt", prompt), "_prompt", out, client, max_tokens=max_tokens, temperature=temperature, **options)
    return asked.drop("_prompt")


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def string_list(raw: Column, least: int = 1) -> Column:
    """A JSON list of strings, with or without a code fence; null for anything else or for fewer than ``least``."""
    bare = strip_fence(raw)
    items = F.from_json(bare, "array<string>")
    plain = F.forall(F.from_json(bare, "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    return F.when(F.startswith(bare, F.lit("[")) & F.try_parse_json(bare).isNotNull() & (F.size(items) >= least) & plain, items)


def plan_queries(rows: DataFrame, client: Client, *, query: str = "query") -> DataFrame:
    """``rows`` with ``plan``; a reply that is no plan gives a simple plan for the question."""
    prompt = _lines("Plan how to answer a question about a paper. Reply with one JSON object: answer_type, key_concepts,", "sub_questions, answer_structure (lists of strings) and complexity (simple or multi_hop).", F.concat(F.lit("Question: "), query))
    asked = ask(rows, prompt, client, max_tokens=400, temperature=0.0)
    return asked.withColumn("plan", parse_plan(strip_fence(F.coalesce("reply", F.lit(""))), F.col(query))).drop("reply")


def hypothetical(rows: DataFrame, client: Client, *, query: str = "query") -> DataFrame:
    """``rows`` (with ``plan``) and ``hyde``, a passage as the paper might hold it; the question where there is none."""
    concepts = F.col("plan.key_concepts")
    hints = F.when(F.size(concepts) > 0, F.concat(F.lit("Use these terms: "), F.array_join(concepts, ", ")))
    prompt = _lines("Write three or four sentences that a paper answering this question might contain.", hints, F.concat(F.lit("Question: "), query), "Passage:")
    asked = ask(rows, prompt, client, max_tokens=180, temperature=0.3)
    return asked.withColumn("hyde", F.coalesce(F.nullif(F.trim("reply"), F.lit("")), F.col(query))).drop("reply")


def decompose(rows: DataFrame, client: Client, *, query: str = "query") -> DataFrame:
    """``rows`` with ``sub_questions``: two or more from the reply, else the question alone."""
    prompt = _lines("Split this question into two or three simpler ones. Reply with a JSON list of strings.", F.concat(F.lit("Question: "), query))
    asked = ask(rows, prompt, client, max_tokens=400, temperature=0.1)
    return asked.withColumn("sub_questions", sub_questions(F.col("reply"), F.col(query))).drop("reply")


def sub_questions(raw: Column, query: Column) -> Column:
    return F.coalesce(string_list(raw, 2), F.array(query))


def context(retrieved: DataFrame, by: str, *, rank: str = "rank") -> DataFrame:
    """(by, context): the chunks of a question in rank order as one block."""
    entry = context_entry(F.col("_i"), F.col("_s.section"), F.col("_s.page_num"), F.col("_s.text"))
    rows = retrieved.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("_r"), "section", "page_num", "text"))).alias("_a"))
    each = rows.select(by, F.posexplode("_a").alias("_p", "_s")).withColumn("_i", F.col("_p") + 1)
    return each.select(by, F.struct("_p", entry.alias("e")).alias("e")).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["e"]), "\n\n---\n\n").alias("context"))


def generate(rows: DataFrame, client: Client, *, query: str = "query") -> DataFrame:
    """``rows`` (with ``context`` and ``plan``) and ``reasoning``, ``answer`` and ``failed``, which tells that the call failed."""
    steps = numbered(F.coalesce(F.col("plan.answer_structure"), F.array().cast("array<string>")))
    prompt = _lines("Answer the question from the passages alone. First think, then write [WRITE] and the answer, with", "**ESSENCE:** in one sentence and **DETAIL:** below it. Do not name passage numbers.", "Structure:", steps, "Passages:", F.col("context"), F.concat(F.lit("Question: "), query))
    asked = ask(rows, prompt, client, max_tokens=2048, temperature=0.1)
    parts = split_response(F.coalesce("reply", F.lit("")))
    return asked.withColumns({"reasoning": parts["reasoning"], "answer": strip_chunk_refs(parts["answer"]), "failed": F.col("reply").isNull()}).drop("reply")


def grade(rows: DataFrame, client: Client, *, by: list[str], answer: str = "answer") -> DataFrame:
    """(by, cleaned_answer, original_answer, grades, removed_count, grading_failed) of answers with their ``context``."""
    said = F.filter(grading.grader_sentences(F.col(answer)), lambda s: ~grading.is_negation(s))
    prompt = _lines("Grade each sentence against the passages: DIRECT, INFERRED or UNSUPPORTED. Reply with a JSON list of objects", "with sentence, grade and chunk_ref, in order.", "Passages:", F.col("context"), "Sentences:", numbered(said, ""))
    asked = ask(rows, prompt, client, max_tokens=1024, temperature=0.0)
    return grading.grade_answers(asked.withColumn("grades", grading.parse_grades(F.col("reply"))), by=by, answer=answer)


def expand(rows: DataFrame, client: Client, *, query: str = "query", paper: str = "paper") -> DataFrame:
    """``rows`` with ``expanded``, the question in the paper's own terms; the question where the call failed."""
    prompt = _lines(F.concat(F.lit("Rewrite this question in the technical terms of '"), F.col(paper), F.lit("'. Reply with the question alone.")), F.concat(F.lit("Question: "), query))
    asked = ask(rows, prompt, client, max_tokens=80, temperature=0.3)
    return asked.withColumn("expanded", F.coalesce("reply", query)).drop("reply")


def off_topic(rows: DataFrame, client: Client, *, query: str = "query") -> DataFrame:
    """``rows`` with ``off_topic``; false where the call failed."""
    prompt = _lines("Reply OFFTOPIC if this has nothing to do with a research paper, else ONTOPIC.", F.col(query))
    asked = ask(rows, prompt, client, max_tokens=5, temperature=0.0)
    return asked.withColumn("off_topic", F.startswith(F.upper(F.trim(F.coalesce("reply", F.lit("")))), F.lit("OFFTOPIC"))).drop("reply")


def confirm_headings(candidates: DataFrame, client: Client, *, paper: str = "paper_id") -> DataFrame:
    """(paper, reply): one batched prompt for each paper; pages.confirmed reads the verdicts."""
    line = F.concat(F.col("id").cast("string"), F.lit(" | "), F.col("candidate_line"), F.lit(" | "), F.col("context"))
    asked = candidates.groupBy(paper).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda s: s["l"]), "\n").alias("_list"))
    prompt = _lines("For each candidate heading (id | line | what follows) reply with one line 'id | SECTION', 'id | SUBSECTION' or 'id | NONE'.", F.col("_list"))
    return ask(asked, prompt, client, max_tokens=500, temperature=0.0).drop("_list")


def judge(rows: DataFrame, client: Client, *, by: list[str], votes: int = 3) -> DataFrame:
    """(by, score, verdict, n_votes, vote_verdicts) of rows (by, question, gold, answer); gold is an array of references.

    A vote whose call failed is ERROR, one without a verdict UNPARSED; neither has a score.
    """
    each = rows.withColumn("_vote", F.explode(F.sequence(F.lit(1), F.lit(max(1, votes)))))
    gold = F.array_join(F.transform(F.filter("gold", lambda g: F.trim(g) != ""), lambda g: F.concat(F.lit("- "), g)), "\n")
    prompt = _lines("Is the answer right? Reply CORRECT, PARTIAL or INCORRECT.", F.concat(F.lit("Question: "), F.col("question")), "References:", gold, F.concat(F.lit("Answer: "), F.col("answer")))
    asked = ask(each, prompt, client, max_tokens=8, temperature=0.0)
    said = asked.withColumn("verdict", F.when(F.col("reply").isNull(), "ERROR").otherwise(verdict(F.col("reply"))))
    return evaluation.judge_votes(said, by=by)


PROBE = "a paper's main contribution, method, results and key findings"


def probe_text(retrieved: DataFrame, by: str, *, chunks: int, clip: int) -> DataFrame:
    """(by, context): the first ``chunks`` chunks of a probe, ``clip`` characters of each."""
    first = retrieved.where(F.col("rank") <= chunks)
    return first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, clip).alias("t")))), lambda s: s["t"]), "\n\n").alias("context"))


def glossary(retrieved: DataFrame, client: Client, *, by: str = "paper_id") -> DataFrame:
    """(by, term, definition) from a paper's first 10 chunks; a reply that can't be read gives no rows."""
    prompt = _lines("List the technical terms of this text with short definitions, as a JSON list of objects with term and definition.", F.col("context"))
    asked = ask(probe_text(retrieved, by, chunks=10, clip=600), prompt, client, max_tokens=1800, temperature=0.1)
    rows = F.from_json(strip_fence(F.coalesce("reply", F.lit(""))), "array<struct<term:string,definition:string>>")
    return asked.select(by, F.explode(rows).alias("g")).select(by, "g.term", "g.definition").where("term is not null")


def related_queries(retrieved: DataFrame, client: Client, *, by: str = "paper_id") -> DataFrame:
    """(by, pos, search_query): up to three searches for related papers, from a paper's first 5 chunks."""
    prompt = _lines("Give three short searches for papers related to this text, as a JSON list of strings.", F.col("context"))
    asked = ask(probe_text(retrieved, by, chunks=5, clip=400), prompt, client, max_tokens=150, temperature=0.1)
    return asked.select(by, F.posexplode(F.slice(string_list(F.col("reply")), 1, 3)).alias("pos", "search_query"))
