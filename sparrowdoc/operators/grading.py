"""Sentence grading, confidence, diagnosis and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import evaluator_sentences, grader_sentences, is_negation, lexical_tokens, once, reconstruct, strip_fence
from ..functions.vectors import cosine
from ..models import QUERY_PREFIX
from .evaluation import confidence

FAITHFUL, RELEVANT, SCORE_OK, UNSURE = 0.80, 0.40, 0.0, 0.05
PASS, OUT_OF_DOMAIN, MAX_ATTEMPTS = 50, 0.05, 3
#: Cosine from which a chunk supports a sentence.
SUPPORT = 0.55


def coverage_grade(sentence: Column, context: Column) -> Column:
    """This library's offline grader: the share of a sentence's words that the context holds."""
    s = F.array_distinct(lexical_tokens(sentence))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(s, F.array_distinct(lexical_tokens(context)))), F.size(s)), F.lit(0.0))
    return F.when(share >= 0.8, "DIRECT").when(share >= 0.5, "INFERRED").otherwise("UNSUPPORTED")


def join_grades(sentences: DataFrame, grades: DataFrame, *, by: list[str], prefix: int = 60) -> DataFrame:
    """Grades by the sentence's first ``prefix`` characters; the last of repeats wins, none reads INFERRED."""
    key = lambda c: F.substring(F.trim(F.col(c)), 1, prefix).alias("_k")
    last = grades.select(*by, key("sentence"), "pos", "grade").groupBy(*by, "_k").agg(F.max_by("grade", "pos").alias("grade"))
    out = sentences.withColumn("_k", key("sentence")).join(last, [*by, "_k"], "left").drop("_k")
    return out.withColumn("grade", F.coalesce("grade", F.lit("INFERRED"))).withColumn("kept", F.col("grade") != "UNSUPPORTED")


def zip_grades(sentences: DataFrame, grades: DataFrame, *, by: list[str]) -> DataFrame:
    """Grades by position among the sentences that are no negations; negations and a shortfall are INFERRED."""
    w = Window.partitionBy(*by, "negation").orderBy("pos")
    numbered = sentences.withColumn("_n", F.when(~F.col("negation"), F.row_number().over(w)))
    given = grades.select(*by, F.col("pos").alias("_n"), "grade")
    out = numbered.join(given, [*by, "_n"], "left").drop("_n")
    return out.withColumn("grade", F.when(F.col("negation"), "INFERRED").otherwise(F.coalesce("grade", F.lit("INFERRED"))))


def diagnose(top_score: Column, faithfulness: Column, relevancy: Column) -> Column:
    """retrieval or generation, by the best re-rank score (or, without one, by faithfulness)."""
    ok = F.when(top_score.isNotNull(), top_score >= SCORE_OK).otherwise(faithfulness >= UNSURE)
    return F.when(~ok, "retrieval").when(faithfulness < FAITHFUL, "generation").when(relevancy < RELEVANT, "generation").otherwise("retrieval")


def retry_plan(failure: Column, attempt: Column) -> Column:
    """Struct (expand, slice) of the next attempt; a slice of 0 means all chunks."""
    expand = (failure == "retrieval") | (attempt >= 3)
    slice_ = F.when(attempt >= 3, 3).when(failure == "generation", 4).otherwise(0)
    return F.struct(expand.alias("expand"), slice_.alias("slice"))


def best_attempt(attempts: DataFrame, *, by: str) -> DataFrame:
    """The attempt of greatest confidence; the earliest of equals."""
    w = Window.partitionBy(by).orderBy(F.desc("confidence"), "attempt")
    return attempts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def answer_loop(questions: DataFrame, attempt, *, by: str, attempts: int = MAX_ATTEMPTS, cut=None) -> DataFrame:
    """``attempt(failing, n)`` gives rows with confidence, relevancy and failure_type; only failing ones go on.

    ``cut`` (for example a write to a table) ends lineage between attempts, so that models aren't called again.
    """
    cut = cut or (lambda df: df.checkpoint())
    failing, every = questions, None
    for n in range(1, max(1, min(attempts, MAX_ATTEMPTS)) + 1):
        rows = cut(attempt(failing, n).withColumn("attempt", F.lit(n)))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
        outside = (F.lit(n) == 1) & (F.col("relevancy") < OUT_OF_DOMAIN)
        failing = questions.drop("failure_type").join(rows.where((F.col("confidence") < PASS) & ~outside).select(by, "failure_type"), by)
    best = best_attempt(every, by=by)
    if "calls" not in every.columns:
        return best
    # the calls of all attempts, in order
    calls = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "calls"))), lambda a: a["calls"]))
    return best.drop("calls").join(every.groupBy(by).agg(calls.alias("calls")), by)


def warning(passed: Column, confidence: Column, outside: Column) -> Column:
    """What a reader is told of an answer that doesn't pass; null for one that does."""
    low = F.format_string(f"The answer's confidence is %.1f of 100, under {PASS}; the paper may not hold what was asked for.", confidence)
    return F.when(passed, F.lit(None)).when(outside, "The question seems to be about something other than this paper.").otherwise(low)


def parse_grades(raw: Column) -> Column:
    """Array of (sentence, grade, chunk_ref) from a model's reply, a JSON list with or without a code fence; else null."""
    bare = strip_fence(raw)
    rows = F.from_json(bare, "array<struct<sentence:string,grade:string,chunk_ref:string>>")
    filled = F.transform(rows, lambda r: F.struct(F.coalesce(r["sentence"], F.lit("")).alias("sentence"), F.coalesce(r["grade"], F.lit("INFERRED")).alias("grade"), F.coalesce(r["chunk_ref"], F.lit("none")).alias("chunk_ref")))
    return F.when(F.startswith(bare, F.lit("[")) & F.try_parse_json(bare).isNotNull(), filled)


def grade_answers(answers: DataFrame, *, by: list[str], answer: str = "answer", grades: str = "grades") -> DataFrame:
    """(by, cleaned_answer, original_answer, grades, removed_count, grading_failed) of answers with a grader's ``grades``.

    ``grades`` (parse_grades) holds one entry for each sentence that is no negation, in order; null says that grading
    failed, and the answer stays. Negations are INFERRED, as is a shortfall. A sentence's grade is the last one given to
    its first 60 characters.
    """
    kind = "array<struct<sentence:string,grade:string,chunk_ref:string>>"
    said = grader_sentences(F.col(answer))
    entry = lambda s, g, r: F.struct(s.alias("sentence"), g.alias("grade"), r.alias("chunk_ref"))
    rows = answers.withColumns({"_s": said, "_neg": F.transform(said, is_negation)})
    # the how many-th graded sentence each is
    given = lambda i: F.get(F.col(grades), F.size(F.filter(F.slice("_neg", F.lit(1), i + 1), lambda n: ~n)) - 1)
    merged = F.transform("_s", lambda s, i: F.when(F.get("_neg", i), entry(s, F.lit("INFERRED"), F.lit("negation"))).otherwise(F.coalesce(given(i), entry(s, F.lit("INFERRED"), F.lit("none")))))
    rows = rows.withColumn("_m", merged.cast(kind))
    key = lambda text: F.trim(F.substring(text, 1, 60))
    last = lambda s: F.element_at(F.concat(F.array(entry(s, F.lit("INFERRED"), F.lit("none"))), F.filter("_m", lambda g: key(g["sentence"]) == key(s))), -1)
    rich = F.transform("_s", lambda s: once(last(s), lambda g: F.struct(s.alias("sentence"), g["grade"].alias("grade"), g["chunk_ref"].alias("chunk_ref"), (g["grade"] != "UNSUPPORTED").alias("kept"))))
    nothing = F.array().cast("array<struct<sentence:string,grade:string,chunk_ref:string,kept:boolean>>")
    failed = F.col(grades).isNull() & (F.size(F.filter("_neg", lambda n: ~n)) > 0)
    rows = rows.withColumn("_g", F.when(failed, nothing).otherwise(rich))
    gone = F.transform(F.filter("_g", lambda g: ~g["kept"]), lambda g: g["sentence"])
    cleaned = F.when(failed | (F.size("_s") == 0), F.col(answer)).otherwise(reconstruct(F.col(answer), gone))
    return rows.select(*by, cleaned.alias("cleaned_answer"), F.col(answer).alias("original_answer"), F.col("_g").alias("grades"), removed_count(F.col("_g")).alias("removed_count"), failed.alias("grading_failed"))


def removed_count(grades: Column) -> Column:
    return F.size(F.filter(grades, lambda g: ~g["kept"]))


def shown_grades(grades: Column) -> Column:
    """Grades that are shown: kept ones but for headers."""
    return F.filter(grades, lambda g: g["kept"] & (F.coalesce(g["chunk_ref"], F.lit("none")) != "header"))


def direct_ratio(grades: Column) -> Column:
    """Struct (direct, inferred, ratio, bucket): share of DIRECT among the shown grades, 1 without any."""
    shown = shown_grades(grades)
    count = lambda kind: F.size(F.filter(shown, lambda g: g["grade"] == kind))
    ratio = F.coalesce(F.try_divide(count("DIRECT"), F.size(shown)), F.lit(1.0))
    return F.struct(count("DIRECT").alias("direct"), count("INFERRED").alias("inferred"), ratio.alias("ratio"), F.when(ratio > 0.75, "strong").when(ratio > 0.45, "mixed").otherwise("weak").alias("bucket"))


def passes(confidence: Column, gate: float = PASS) -> Column:
    return confidence >= gate


def out_of_domain(attempt: Column, relevancy: Column) -> Column:
    return (attempt == 1) & (relevancy < OUT_OF_DOMAIN)


def flag(text: str | None) -> bool:
    """Whether a setting is on: 1, true or yes in any case."""
    return (text or "").strip().lower() in ("1", "true", "yes")


def attempts_setting(text: str | None, default: int = MAX_ATTEMPTS) -> int:
    """A number of attempts between 1 and 3; what is no number is the default."""
    try:
        return max(1, min(int(text), MAX_ATTEMPTS)) if text is not None else default
    except ValueError:
        return default


def evaluate_answers(answers: DataFrame, chunks: DataFrame, *, by: str, embed, question: str = "question", answer: str = "answer", text: str = "text", prefix: str = QUERY_PREFIX, support: float = SUPPORT) -> DataFrame:
    """(by, faithfulness, answer_relevancy, method, confidence) of answers by the vectors of ``embed`` (a Column function).

    Faithfulness is the share of sentences whose greatest cosine with a chunk of the answer is ``support`` or more;
    relevancy is the cosine of the prefixed question and the answer. Answers without chunks with text, and blank
    answers, score 0 and say so in ``method``.
    """
    own = chunks.where(F.trim(text) != "").select(by, embed(F.col(text)).alias("_c"))
    said = answers.select(by, F.posexplode(evaluator_sentences(F.col(answer))).alias("_pos", "_s")).withColumn("_v", embed(F.col("_s")))
    best = said.join(own, by).groupBy(by, "_pos").agg(F.max(cosine(F.col("_v"), F.col("_c"))).alias("_best"))
    share = best.groupBy(by).agg(F.avg((F.col("_best") >= support).cast("double")).alias("_f"))
    held = own.select(by).distinct().withColumn("_has", F.lit(True))
    rows = answers.join(held, by, "left").join(share, by, "left")
    blank = F.trim(F.coalesce(F.col(answer), F.lit(""))) == ""
    method = F.when(F.col("_has").isNull(), "error_no_chunks").when(blank, "error_no_answer").otherwise("local")
    relevancy = cosine(embed(F.concat(F.lit(prefix), F.col(question))), embed(F.coalesce(F.col(answer), F.lit(""))))
    scored = rows.select(by, F.when(method == "local", F.coalesce("_f", F.lit(0.0))).otherwise(0.0).alias("faithfulness"), F.when(method == "local", relevancy).otherwise(0.0).alias("answer_relevancy"), method.alias("method"))
    return scored.withColumn("confidence", confidence(F.col("faithfulness"), F.col("answer_relevancy")))


def retrieval_ok(scores: DataFrame, answers: DataFrame, *, by: str, score: str = "score") -> DataFrame:
    """``answers`` (with faithfulness) and ``retrieval_ok``: the best score, nulls left out, is 0 or more; without any
    score, faithfulness is 0.05 or more."""
    best = scores.groupBy(by).agg(F.max(score).alias("top_score"))
    return answers.join(best, by, "left").withColumn("retrieval_ok", F.when(F.col("top_score").isNotNull(), F.col("top_score") >= SCORE_OK).otherwise(F.col("faithfulness") >= UNSURE))


def retry_chunks(ranked: DataFrame, plans: DataFrame, *, by: str, rank: str = "rank") -> DataFrame:
    """The chunks that the next attempt of a failed answer gets: plans (by, failure_type, attempt) say how many."""
    sliced = plans.select(by, retry_plan(F.col("failure_type"), F.col("attempt")).alias("_p"))
    return ranked.join(sliced, by).where((F.col("_p.slice") == 0) | (F.col(rank) <= F.col("_p.slice"))).withColumn("expand", F.col("_p.expand")).drop("_p")


def unsupported(graded: DataFrame, kept: DataFrame, *, by: list[str]) -> DataFrame:
    """Sentences of the one table that the other does not hold."""
    return graded.join(kept.select(*by).distinct(), by, "left_anti")
