"""Answer and retrieval metrics, calibration and ablation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_abstention, squad_tokens


def token_f1(prediction: Column, truth: Column) -> Column:
    """Multiset overlap of normalised tokens; both empty 1, one empty 0."""
    p, t = squad_tokens(prediction), squad_tokens(truth)
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    same = F.aggregate(F.array_distinct(F.array_intersect(p, t)), F.lit(0), lambda a, w: a + F.least(times(p, w), times(t, w)))
    return F.when((F.size(p) == 0) & (F.size(t) == 0), 1.0).when((F.size(p) == 0) | (F.size(t) == 0) | (same == 0), 0.0).otherwise(2.0 * same / (F.size(p) + F.size(t)))


def answer_f1(golds: DataFrame, *, by: str, answerable: str = "answerable", score: str = "f1", no_answer: str = "no_answer") -> DataFrame:
    """The best annotator: an unanswerable gold scores 1 for no answer, an answerable one 0."""
    own = F.when(~F.col(answerable), F.col(no_answer).cast("double")).when(F.col(no_answer), 0.0).otherwise(F.col(score))
    return golds.groupBy(by).agg(F.max(own).alias("answer_f1"), (F.count_if(F.col(answerable)) * 2 >= F.count("*")).alias("is_answerable"))


def evidence_recall(evidence: DataFrame, retrieved: DataFrame, *, by: str, threshold: float = 0.5) -> DataFrame:
    """Share of gold paragraphs of whose unique tokens some retrieved text holds ``threshold``."""
    gold = evidence.select(by, "evidence_id", F.array_distinct(squad_tokens(F.col("evidence"))).alias("g"))
    got = retrieved.select(by, F.array_distinct(squad_tokens(F.col("text"))).alias("c"))
    cover = F.coalesce(F.try_divide(F.size(F.array_intersect("g", "c")), F.size("g")), F.lit(0.0))
    best = gold.join(got, by, "left").groupBy(by, "evidence_id").agg(F.max(cover).alias("cover"))
    return best.groupBy(by).agg(F.avg((F.coalesce("cover", F.lit(0.0)) >= threshold).cast("double")).alias("evidence_recall"))


def hit_and_mrr(ranks: DataFrame, *, by: list[str] | None = None, hit: str = "hit", rank: str = "rank", query: str = "query_id", k: int = 5) -> DataFrame:
    """Hit@k and mean reciprocal rank; queries without a hit count 0."""
    by = by or []
    first = ranks.groupBy(*by, query).agg(F.min(F.when(F.col(hit) & (F.col(rank) <= k), F.col(rank))).alias("first"))
    grouped = first.groupBy(*by) if by else first.groupBy()
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 6).alias("hit_at_k"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def threshold_sweep(rows: DataFrame, thresholds: list[int], *, score: str, good: str) -> DataFrame:
    """Confusion counts, accuracy, precision and recall for each threshold, in one pass over the rows."""
    each = rows.select(F.col(score).alias("s"), F.col(good).alias("g"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    yes = F.col("s") >= F.col("threshold")
    out = each.groupBy("threshold").agg(F.count_if(yes & F.col("g")).alias("tp"), F.count_if(~yes & ~F.col("g")).alias("tn"), F.count_if(yes & ~F.col("g")).alias("fp"), F.count_if(~yes & F.col("g")).alias("fn"))
    part = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    return out.withColumns({"accuracy": part(tp + tn, tp + tn + fp + fn), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn)})


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The least of those with the greatest accuracy."""
    return sweep.agg(F.max_by("threshold", F.struct(F.col("accuracy"), -F.col("threshold"))).alias("best_threshold"), F.max("accuracy").alias("accuracy"))


def judge_bucket(score: Column) -> Column:
    return F.when(score >= 0.75, "CORRECT").when(score >= 0.25, "PARTIAL").when(score.isNotNull(), "INCORRECT")


def vote_score(verdict: Column) -> Column:
    return F.when(verdict == "CORRECT", 1.0).when(verdict == "PARTIAL", 0.5).when(verdict == "INCORRECT", 0.0)


def confidence(faithfulness: Column, relevancy: Column) -> Column:
    return F.round((0.7 * faithfulness + 0.3 * relevancy) * 100, 2)


def effect(before: Column, after: Column) -> Column:
    return F.when(before.isNull() | after.isNull(), "unjudged").when(after > before, "helped").when(after < before, "hurt").otherwise("neutral")


def gold_type(kind: Column, answerable: Column, pos: Column) -> Column:
    """Aggregate: unanswerable by majority, else the commonest answerable kind (the first seen of equals)."""
    kinds = F.array_sort(F.filter(F.collect_list(F.struct(pos.alias("pos"), kind.alias("kind"), answerable.alias("ok"))), lambda r: r["ok"]))
    ranked = F.transform(kinds, lambda r: F.struct(F.size(F.filter(kinds, lambda o: o["kind"] == r["kind"])).alias("n"), (-r["pos"]).alias("p"), r["kind"].alias("kind")))
    return F.when(F.count_if(answerable) * 2 < F.count("*"), "unanswerable").otherwise(F.array_max(ranked)["kind"])


def answerable_correct(no_answer: Column, answerable: Column) -> Column:
    return ~no_answer == answerable


def predicts_no_answer(passed: Column, answer: Column) -> Column:
    return ~passed | is_abstention(answer)


def hits_expected(section: Column, page: Column, expected_section: Column, expected_page: Column) -> Column:
    """Whether a chunk is where the answer stands: the section holds the expected name in any case, or the page is it."""
    return F.coalesce(F.contains(F.lower(section), F.lower(expected_section)), F.lit(False)) | F.coalesce(page == expected_page, F.lit(False))


def gold_evidence(annotations: DataFrame, *, by: str, evidence: str = "evidence", pos: str = "pos") -> DataFrame:
    """(by, evidence): the annotators' paragraphs in order, each once, without blank ones."""
    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(pos, evidence))), lambda s: s[evidence]))
    return annotations.groupBy(by).agg(F.array_distinct(F.filter(every, lambda e: F.trim(e) != "")).alias("evidence"))


def evidence_token_f1(retrieved: Column, evidence: Column) -> Column:
    """Token F1 of all retrieved texts and all gold paragraphs, each joined by blanks; null without gold."""
    return F.when(F.size(evidence) > 0, token_f1(F.array_join(retrieved, " "), F.array_join(evidence, " ")))


def pooled_token_f1(retrieved: DataFrame, evidence: DataFrame, *, by: str, text: str = "text", gold: str = "text") -> DataFrame:
    """(by, evidence_f1): as ``evidence_token_f1``, of all texts of a group and all of ``evidence``, whose counted tokens are joined.

    Null for a group whose texts are all null.
    """
    counted = lambda df, keys, column: df.select(*keys, F.explode_outer(squad_tokens(F.col(column))).alias("_token"), F.col(column).isNotNull().alias("_said")).groupBy(*keys, "_token").agg(F.count("_token").alias("_n"), F.max("_said").alias("_said"))
    truth = counted(evidence, [], gold).where("_token is not null").select("_token", F.col("_n").alias("_m"))
    size = truth.agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_t"))
    both = counted(retrieved, [by], text).join(truth, "_token", "left")
    sums = both.groupBy(by).agg(F.sum("_n").alias("_p"), F.sum(F.least("_n", F.coalesce("_m", F.lit(0)))).alias("_same"), F.max("_said").alias("_said")).crossJoin(F.broadcast(size))
    f1 = F.when(F.col("_p") + F.col("_t") == 0, 1.0).otherwise(2.0 * F.col("_same") / (F.col("_p") + F.col("_t")))
    return sums.select(by, F.when(F.col("_said"), f1).alias("evidence_f1"))


def question_rows(papers: DataFrame, *, per_paper: int = 0, papers_limit: int | None = None) -> DataFrame:
    """(paper_id, question_id, question, answers, n) of papers (pos, paper_id, full_text, qas) with text and questions.

    The first ``papers_limit`` papers in file order; of each the first ``per_paper`` questions, 0 for all.
    """
    usable = papers.where((F.size("qas") > 0) & (F.size("full_text") > 0)).orderBy("pos")
    chosen = usable.limit(papers_limit) if papers_limit else usable
    each = chosen.select("paper_id", F.posexplode("qas").alias("n", "q"))
    return each.where(F.lit(per_paper == 0) | (F.col("n") < per_paper)).select("paper_id", F.col("q.question_id").alias("question_id"), F.col("q.question").alias("question"), F.col("q.answers").alias("answers"), "n")


def evaluate_questions(predictions: DataFrame, golds: DataFrame, retrieved: DataFrame, *, by: str = "question_id", threshold: float = 0.5) -> DataFrame:
    """One scored row for each prediction (by, answer, passed, ...).

    ``golds`` (by, pos, type, answerable, text, evidence) are the annotators' answers, ``retrieved`` (by, rank, text) the
    chunks: answer_f1, answerable_correct, gold_type, gold_answerable, evidence_recall and evidence_f1 (null without gold
    evidence). Questions without golds count as unanswerable.
    """
    asked = predictions.withColumn("predicted_no_answer", predicts_no_answer(F.col("passed"), F.col("answer")))
    own = golds.join(asked.select(by, F.col("answer").alias("_answer"), F.col("predicted_no_answer").alias("no_answer")), by)
    scored = answer_f1(own.withColumn("f1", token_f1(F.col("_answer"), F.col("text"))), by=by).withColumnRenamed("is_answerable", "gold_answerable")
    kinds = golds.groupBy(by).agg(gold_type(F.col("type"), F.col("answerable"), F.col("pos")).alias("gold_type"))
    evidence = gold_evidence(golds, by=by).where(F.size("evidence") > 0)
    recall = evidence_recall(evidence.select(by, F.posexplode("evidence").alias("evidence_id", "evidence")), retrieved, by=by, threshold=threshold)
    texts = retrieved.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("_texts"))
    overlap = evidence.join(texts, by, "left").select(by, evidence_token_f1(F.coalesce("_texts", F.array().cast("array<string>")), F.col("evidence")).alias("evidence_f1"))
    out = asked.join(scored, by, "left").join(kinds, by, "left").join(recall, by, "left").join(overlap, by, "left")
    out = out.withColumns({"answer_f1": F.coalesce("answer_f1", F.lit(0.0)), "gold_answerable": F.coalesce("gold_answerable", F.lit(False)), "gold_type": F.coalesce("gold_type", F.lit("unanswerable"))})
    return out.withColumn("answerable_correct", answerable_correct(F.col("predicted_no_answer"), F.col("gold_answerable")))


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over scored questions, in all or for each ``by``: nulls are left out, and of durations zeros too."""
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), mean("answer_f1").alias("answer_f1"), mean(F.col("answerable_correct").cast("double")).alias("answerable_accuracy"),
        mean("evidence_recall").alias("evidence_recall"), mean("confidence").alias("mean_confidence"), mean("faithfulness").alias("mean_faithfulness"),
        mean(F.nullif(F.col("duration_ms"), F.lit(0))).alias("mean_duration_ms"), mean("llm_calls").alias("mean_llm_calls"), mean("judge_score").alias("judge_accuracy"),
    )


def verdict_map(rows: DataFrame, by: list[str] | None = None, verdict: str = "judge_verdict") -> DataFrame:
    """A map of verdicts to their counts; null verdicts are left out."""
    counted = rows.where(F.col(verdict).isNotNull()).groupBy(*(by or []), verdict).agg(F.count("*").alias("n"))
    return counted.groupBy(*(by or [])).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(verdict, "n")))).alias("judge_dist"))


def judge_votes(votes: DataFrame, *, by: list[str], verdict: str = "verdict") -> DataFrame:
    """(by, score, verdict, n_votes, vote_verdicts): the mean of the votes that could be read, and its bucket."""
    score = F.avg(vote_score(F.col(verdict)))
    out = votes.groupBy(*by).agg(score.alias("score"), F.count(vote_score(F.col(verdict))).alias("n_votes"), F.sort_array(F.collect_list(verdict)).alias("vote_verdicts"))
    return out.withColumn("verdict", F.coalesce(judge_bucket(F.col("score")), F.get("vote_verdicts", F.lit(0))))


# The configurations of the ablation, with the features that each switches off.
ABLATIONS = {"full": (), "baseline": ("grader", "rerank", "hyde", "retry"), "no_grader": ("grader",), "no_rerank": ("rerank",), "no_hyde": ("hyde",), "no_retry": ("retry",)}


def unknown_configs(names: list[str]) -> list[str]:
    """Names that are no configuration, in order."""
    return [n for n in names if n not in ABLATIONS]


def run_ablations(questions: DataFrame, answer, names: list[str] | None = None) -> DataFrame:
    """``answer(questions, off)`` for each configuration, its rows tagged with ``config``; ``off`` names what is switched off."""
    names = list(ABLATIONS) if names is None else names
    if wrong := unknown_configs(names):
        raise ValueError(f"unknown configurations: {', '.join(wrong)}")
    out = None
    for name in names:
        rows = answer(questions, frozenset(ABLATIONS[name])).withColumn("config", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def ablation_matrix(rows: DataFrame, config: str = "config") -> DataFrame:
    """One summary row for each configuration."""
    return summary(rows, [config])


def paired_effects(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What grading did to answers (score_original, score_cleaned, removed_count): counts of effects and means."""
    kind = effect(F.col("score_original"), F.col("score_cleaned"))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(F.col("removed_count") > 0).alias("n_removed"), *[F.count_if(kind == k).alias(k) for k in ("helped", "hurt", "neutral", "unjudged")],
        F.round(F.avg("score_original"), 6).alias("mean_original"), F.round(F.avg("score_cleaned"), 6).alias("mean_cleaned"),
    )


def gradable(rows: DataFrame) -> DataFrame:
    """Answerable questions whose answer did not degrade (confidence 0 with a warning)."""
    return rows.where(F.col("gold_answerable") & ~((F.coalesce("confidence", F.lit(0.0)) == 0) & F.col("warning").isNotNull()))


def pipeline_deltas(ranks: DataFrame, *, baseline: str, pipeline: str = "pipeline") -> DataFrame:
    """Hit@5 and MRR of each pipeline, and their differences to ``baseline``'s."""
    scores = hit_and_mrr(ranks, by=[pipeline])
    base = scores.where(F.col(pipeline) == baseline).select(F.col("hit_at_k").alias("_h"), F.col("mrr").alias("_m"))
    return scores.crossJoin(F.broadcast(base)).select(pipeline, "n", "hit_at_k", "mrr", F.round(F.col("hit_at_k") - F.col("_h"), 6).alias("hit_delta"), F.round(F.col("mrr") - F.col("_m"), 6).alias("mrr_delta"))


def with_labels(results: DataFrame, labels: DataFrame, *, by: str = "id") -> DataFrame:
    """Results with labels put in where a label is given; others keep theirs."""
    given = labels.select(by, F.col("label").alias("_label"))
    return results.join(given, by, "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")


def calibration_order(rows: DataFrame, by: str = "id") -> DataFrame:
    return rows.orderBy(F.desc("confidence"), by)


def worst_bad(rows: DataFrame, *, label: str = "label", score: str = "confidence", by: str = "id") -> DataFrame:
    """The BAD row of least score, the first of equals: the one a retry gate has to catch."""
    return rows.where(F.col(label) == "BAD").agg(F.min(F.struct(score, by)).alias("_w")).where("_w is not null").select(f"_w.{by}", f"_w.{score}")


def client_stats(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Averages a client shows: nulls count as 0."""
    zero = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), zero("confidence").alias("avg_confidence"), zero("faithfulness").alias("avg_faithfulness"), F.round(F.avg((F.col("complexity") == "multi_hop").cast("double")), 6).alias("multi_hop_rate"))


def duration_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)


def run_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")
