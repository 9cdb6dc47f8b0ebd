"""Questions to answers: planning, retrieval, writing, grading, scoring and retries, each step over all questions at once.

Questions are rows (query_id, paper_id, paper, query), chunks rows (paper_id, chunk_id, section, page_num, text) whose
chunk_id is one for all papers. ``client`` builds a chat model once in each task. ``cut`` ends lineage after steps that ask
a model, so that no call is made twice; by default that is a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import prompts
from .models import accounted, call_totals, hashed_embedding
from .operators import evaluation, grading, ingest, retrieval
from .sources import readers, sinks

SCOPE = ["paper_id"]


def _checkpoint(df: DataFrame) -> DataFrame:
    return df.checkpoint()


def _shown(routed: DataFrame, chunks: DataFrame) -> DataFrame:
    return routed.join(chunks, "chunk_id").withColumnRenamed("new_rank", "rank")


def attempt(questions: DataFrame, n: int, chunks: DataFrame, client: prompts.Client, *, embed=hashed_embedding, cut: Callable = _checkpoint, off: frozenset = frozenset(), scorer=None) -> DataFrame:
    """One attempt at each question; later ones have ``failure_type`` of the last, which decides on expansion and slice.

    ``off`` switches features off: grader, rerank, hyde.
    """
    rows = accounted(questions.withColumn("asked", F.col("query")))
    if n > 1:
        plan = grading.retry_plan(F.col("failure_type"), F.lit(n))
        rows = prompts.expand(rows.withColumn("_p", plan), client)
        rows = rows.withColumn("query", F.when(F.col("_p.expand"), F.col("expanded")).otherwise(F.col("query"))).withColumn("_slice", F.col("_p.slice")).drop("_p", "expanded")
    else:
        rows = rows.withColumn("_slice", F.lit(0))
    planned = prompts.plan_queries(rows, client)
    planned = cut(planned.withColumn("hyde", F.lit(None).cast("string")) if "hyde" in off else prompts.hypothetical(planned, client))
    found = _shown(retrieval.route(planned, chunks, scope=SCOPE, embed=embed, scorer=scorer, reranked="rerank" not in off, hyde="hyde" not in off), chunks.drop(*SCOPE))
    found = cut(found.join(planned.select("query_id", "_slice"), "query_id").where((F.col("_slice") == 0) | (F.col("rank") <= F.col("_slice"))).drop("_slice"))
    written = cut(prompts.generate(planned.join(prompts.context(found, "query_id"), "query_id", "left"), client))
    if "grader" in off:
        graded = written.select("query_id", "calls", F.col("answer").alias("cleaned_answer"), F.col("answer").alias("original_answer"), F.lit(0).alias("removed_count"), F.lit(False).alias("grading_failed"))
    else:
        graded = prompts.grade(written, client, by=["query_id", "calls"]).drop("grades")
    answers = cut(written.select("query_id", "asked", "plan", "reasoning", "failed").join(graded, "query_id"))
    scored = grading.evaluate_answers(answers.select("query_id", F.col("asked").alias("question"), F.col("cleaned_answer").alias("answer")), found, by="query_id", embed=embed)
    failure = grading.diagnose(F.lit(None).cast("double"), F.col("faithfulness"), F.col("answer_relevancy"))
    return answers.join(scored, "query_id").withColumns({"relevancy": F.col("answer_relevancy"), "failure_type": failure, "passed": grading.passes(F.col("confidence")) & ~F.col("failed")})


def answer(questions: DataFrame, chunks: DataFrame, client: prompts.Client, *, attempts: int = grading.MAX_ATTEMPTS, cut: Callable = _checkpoint, **options) -> DataFrame:
    """The best attempt at each question: only those that don't pass are tried again, but not questions out of domain.

    With it come the calls of all attempts: llm_calls, providers (one for each call), duration_ms; and a warning where the
    answer doesn't pass, with failure_type, which is null otherwise.
    """
    best = grading.answer_loop(questions, lambda rows, n: attempt(rows, n, chunks, client, cut=cut, **options), by="query_id", attempts=attempts, cut=cut)
    outside = ~F.col("passed") & (F.col("attempt") == 1) & (F.col("relevancy") < grading.OUT_OF_DOMAIN)
    kind = F.when(F.col("passed"), F.lit(None)).when(outside, "out_of_domain").otherwise(F.col("failure_type"))
    return best.withColumns(call_totals(F.col("calls"))).withColumns({"warning": grading.warning(F.col("passed"), F.col("confidence"), outside), "failure_type": kind})


def log_answers(answers: DataFrame, questions: DataFrame, path: str) -> None:
    """Append answers to the query log that ``readers.query_log`` reads."""
    rows = answers.join(questions.select("query_id", "paper_id"), "query_id")
    sinks.append_log(rows.select("paper_id", F.col("asked").alias("question"), "duration_ms", "confidence", F.col("attempt").alias("attempts"), "passed", "llm_calls", "providers"), path)


def ablate(questions: DataFrame, chunks: DataFrame, client: prompts.Client, names: list[str] | None = None, **options) -> DataFrame:
    """Answers under each configuration, tagged with ``config``."""
    run = lambda rows, off: answer(rows, chunks, client, attempts=1 if "retry" in off else grading.MAX_ATTEMPTS, off=off, **options)
    return evaluation.run_ablations(questions, run, names)


def hybrid_with_rerank(questions: DataFrame, chunks: DataFrame, *, k: int = 5, scorer=None, embed=hashed_embedding) -> DataFrame:
    """(query_id, chunk_id, rerank_score, new_rank): ten fused chunks of each question, re-ranked to the best ``k``."""
    asked = questions.select(*SCOPE, "query_id", "query", F.array().cast("array<string>").alias("boost"), F.lit(None).cast("string").alias("hyde"))
    found = retrieval.hybrid_retrieve(asked, chunks, scope=SCOPE, k=retrieval.CANDIDATES, embed=embed)
    pairs = found.join(asked.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return retrieval.rerank(pairs, by="query_id", query="query", text="text", tie="rank", k=k, scorer=scorer).select("query_id", "chunk_id", "rerank_score", "new_rank")


def compare(questions: DataFrame, chunks: DataFrame, client: prompts.Client, *, k: int = 10, scorer=None, embed=hashed_embedding, cut: Callable = _checkpoint) -> tuple[DataFrame, DataFrame]:
    """Answers to questions (query_id, query, paper_a, paper_b) about two papers, and their distinct sources by paper.

    Each paper's chunks are found and re-ranked on their own and taken by turns.
    """
    sides = questions.select("query_id", "query", F.explode(F.array(F.struct(F.lit("A").alias("label"), F.col("paper_a").alias("paper_id")), F.struct(F.lit("B").alias("label"), F.col("paper_b").alias("paper_id")))).alias("s"))
    sides = sides.select(F.concat_ws("/", F.col("query_id").cast("string"), "s.label").alias("side"), F.col("query_id").alias("_q"), "query", "s.label", "s.paper_id")
    found = hybrid_with_rerank(sides.withColumnRenamed("side", "query_id"), chunks, k=k, scorer=scorer, embed=embed)
    found = found.join(sides.select(F.col("side").alias("query_id"), "_q", "label", "paper_id"), "query_id").drop("query_id").withColumnRenamed("_q", "query_id")
    turns = retrieval.compare_retrieve(found.withColumnRenamed("new_rank", "rank"), by="query_id", k=k)
    shown = cut(turns.drop("rank").withColumnRenamed("position", "rank").join(chunks.drop("paper_id"), "chunk_id"))
    planned = cut(prompts.plan_queries(questions, client))
    answers = cut(prompts.generate(planned.join(prompts.context(shown, "query_id"), "query_id", "left"), client))
    cols = [c for c in ("section_type", "chunk_index") if c not in shown.columns]
    sources = ingest.sources(shown.withColumns({c: F.lit(None).cast("string" if c == "section_type" else "int") for c in cols}), label="label")
    return answers, ingest.distinct_sources(sources, ["query_id", "paper_id", "section", "page"])


def ingest_papers(papers: DataFrame, *, embed=hashed_embedding, **options) -> DataFrame:
    """Stored chunks of question-answering papers (readers.papers): abstract first, then their sections."""
    sections = readers.paper_sections(papers)
    numbered = sections.withColumn("section_no", F.row_number().over(Window.partitionBy("paper_id").orderBy("page_num")))
    return ingest.ingest(numbered, None, embed=embed, **options)
