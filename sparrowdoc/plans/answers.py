"""Answer scoring, grading, calibration and ablation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import grading as G
from ..registry import query
from ..session import read_table
from .retrieval import NORM, OVERLAP_SQL, WORDS

PAIRS_SQL = """pairs as (select * from (select conv_id, turn, role, text question, lead(role) over w r, lead(text) over w answer from conversations window w as (partition by conv_id order by turn))
where role = 'user' and r = 'assistant')"""


def pairs(spark, sf_dir) -> DataFrame:
    """A user turn that an assistant turn follows directly."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read_table(spark, sf_dir, "conversations").withColumns({"_r": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return rows.where("role = 'user' and _r = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("flashcards", f"with {PAIRS_SQL} select conv_id, turn, question, left(answer, 500) answer from pairs")
def flashcards(spark, sf_dir):
    return pairs(spark, sf_dir).withColumn("answer", F.left("answer", F.lit(500)))


F1_SQL = f"""f as (select conv_id, turn, {NORM.format('answer')} p, {NORM.format('question')} t, answer from pairs),
f1 as (select conv_id, turn, answer, case when len(p) = 0 and len(t) = 0 then 1.0 when len(p) = 0 or len(t) = 0 then 0.0
else 2.0 * coalesce(list_sum(list_transform(list_distinct(list_intersect(p, t)), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(t, lambda y: y = w))))), 0) / (len(p) + len(t)) end::double f1 from f)"""


@query("token_f1", f"with {PAIRS_SQL}, {F1_SQL} select conv_id, turn, round(f1, 6) f1 from f1")
def token_f1(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(E.token_f1(F.col("answer"), F.col("question")), 6).alias("f1"))


@query("answer_f1_best", f"""with {PAIRS_SQL}, {F1_SQL}, g as (select conv_id, f1, turn % 4 <> 2 as answerable, length(answer) < 40 as no_answer from f1)
select conv_id, round(max(case when not answerable then (case when no_answer then 1.0 else 0.0 end) when no_answer then 0.0 else f1 end), 6) answer_f1,
count(*) filter (where answerable) * 2 >= count(*) is_answerable from g group by 1""")
def answer_f1_best(spark, sf_dir):
    golds = pairs(spark, sf_dir).select("conv_id", E.token_f1(F.col("answer"), F.col("question")).alias("f1"), (F.col("turn") % 4 != 2).alias("answerable"), (F.length("answer") < 40).alias("no_answer"))
    return E.answer_f1(golds, by="conv_id").withColumn("answer_f1", F.round("answer_f1", 6))


@query("squad_normalize", f"select doc_id, md5(list_aggregate({NORM.format('text')}, 'string_agg', ' ')) normal from documents")
def squad_normalize(spark, sf_dir):
    tokens = read_table(spark, sf_dir, "documents").select("doc_id", T.squad_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.md5(F.when(F.size("t") > 0, F.array_join("t", " "))).alias("normal"))


SENTENCES = """flatten(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''),
 lambda l: case when starts_with(l, '**') and ends_with(l, '**') then [l] else list_filter(list_transform(string_split(l, '. '), lambda p, i: case when trim(p) = '' then '' when i < len(string_split(l, '. ')) then trim(p) || '.' else trim(p) end), lambda s: length(s) > 15) end))"""
JOINED = "coalesce(array_to_string({}, '|'), '')"


@query("sentence_split_grader", f"select doc_id, len({SENTENCES}) n, md5({JOINED.format(SENTENCES)}) joined from documents")
def sentence_split_grader(spark, sf_dir):
    s = T.grader_sentences(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("joined"))


EVAL_SENTENCES = "list_filter(list_transform(string_split(replace({}, chr(10), '. '), '. '), lambda s: trim(s)), lambda s: length(s) > 20)"


@query("sentence_split_evaluator", f"select doc_id, len({EVAL_SENTENCES.format('text')}) n, md5({JOINED.format(EVAL_SENTENCES.format('text'))}) joined from documents")
def sentence_split_evaluator(spark, sf_dir):
    s = T.evaluator_sentences(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.coalesce(F.array_join("s", "|"), F.lit(""))).alias("joined"))


_STARTS = " or ".join(f"starts_with(l, '{p.replace(chr(39), chr(39) * 2)}') or l = '{p.rstrip(' .,').replace(chr(39), chr(39) * 2)}'" for p in T.NEGATIONS)


@query("negation_flag", f"select conv_id, turn, ({_STARTS}) negation, ({' or '.join(f'contains(l, {chr(39)}{p}{chr(39)})' for p in T.ABSTENTIONS)}) abstention from (select conv_id, turn, trim(lower(text)) l from conversations)")
def negation_flag(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_negation(F.col("text")).alias("negation"), T.is_abstention(F.col("text")).alias("abstention"))


SHARE = OVERLAP_SQL.format(q=WORDS.format("lower(s)"), t=WORDS.format("lower(question)"))
GRADES_SQL = f"""{PAIRS_SQL}, g as (select conv_id, turn, case when share >= 0.8 then 'DIRECT' when share >= 0.5 then 'INFERRED' else 'UNSUPPORTED' end grade
from (select conv_id, turn, {SHARE} share from (select conv_id, turn, question, unnest({SENTENCES.replace('text', 'answer')}) s from pairs)))"""


def _grades(spark, sf_dir) -> DataFrame:
    each = pairs(spark, sf_dir).select("conv_id", "turn", "question", F.explode(T.grader_sentences(F.col("answer"))).alias("s"))
    return each.select("conv_id", "turn", G.coverage_grade(F.col("s"), F.col("question")).alias("grade"))


@query("grade_sentences", f"with {GRADES_SQL} select conv_id, turn, grade, count(*) n from g group by all")
def grade_sentences(spark, sf_dir):
    return _grades(spark, sf_dir).groupBy("conv_id", "turn", "grade").agg(F.count("*").alias("n"))


@query("faithfulness_overlap", f"""with {GRADES_SQL}, f as (select conv_id, turn, avg(case when grade <> 'UNSUPPORTED' then 1.0 else 0.0 end) f, count(*) filter (where grade = 'UNSUPPORTED') removed from g group by 1, 2)
select conv_id, turn, round(f, 6) faithfulness, removed removed_count, round((0.7 * f + 0.3 * 0.5) * 100, 2) confidence, round((0.7 * f + 0.3 * 0.5) * 100, 2) >= 50 as passed from f""")
def faithfulness_overlap(spark, sf_dir):
    f = _grades(spark, sf_dir).groupBy("conv_id", "turn").agg(F.avg((F.col("grade") != "UNSUPPORTED").cast("double")).alias("f"), F.count_if(F.col("grade") == "UNSUPPORTED").alias("removed_count"))
    c = E.confidence(F.col("f"), F.lit(0.5))
    return f.select("conv_id", "turn", F.round("f", 6).alias("faithfulness"), "removed_count", c.alias("confidence"), (c >= G.PASS).alias("passed"))


SCORED_SQL = "scored as (select doc_id, least(100.0, n_chars / 50.0)::double score, quality = 1 as good, quality, toxic, lang, n_chars from labels join documents using (doc_id))"


def _scored(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return read_table(spark, sf_dir, "labels").join(docs, "doc_id").withColumns({"score": F.least(F.lit(100.0), F.col("n_chars") / 50.0), "good": F.col("quality") == 1})


SWEEP_SQL = f"""with {SCORED_SQL}, c as (select threshold, count(*) filter (where score >= threshold and good) tp, count(*) filter (where score < threshold and not good) tn,
count(*) filter (where score >= threshold and not good) fp, count(*) filter (where score < threshold and good) fn from scored, (select unnest([50, 55, 60, 65, 70]) threshold) group by 1),
sweep as (select threshold, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn)::double, 6) accuracy, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) as "precision", round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) recall from c)"""


@query("threshold_sweep", SWEEP_SQL + " select * from sweep")
def threshold_sweep(spark, sf_dir):
    return E.threshold_sweep(_scored(spark, sf_dir), [50, 55, 60, 65, 70], score="score", good="good")


@query("best_threshold", SWEEP_SQL + " select threshold best_threshold, accuracy from sweep order by accuracy desc, threshold limit 1")
def best_threshold(spark, sf_dir):
    return E.best_threshold(threshold_sweep(spark, sf_dir))


VERDICTS_SQL = "v as (select conv_id, case length(text) % 4 when 0 then 'CORRECT' when 1 then 'PARTIAL' when 2 then 'INCORRECT' else 'UNPARSED' end verdict from conversations)"


def _verdicts(spark, sf_dir) -> DataFrame:
    raw = F.array(F.lit("correct."), F.lit("Partial"), F.lit("That is INCORRECT"), F.lit("?"))
    return read_table(spark, sf_dir, "conversations").select("conv_id", T.verdict(F.get(raw, F.length("text") % 4)).alias("verdict"))


@query("judge_bucket", f"""with {VERDICTS_SQL}, s as (select conv_id, avg(case verdict when 'CORRECT' then 1.0 when 'PARTIAL' then 0.5 when 'INCORRECT' then 0.0 end) score from v group by 1)
select conv_id, round(score, 6) score, case when score >= 0.75 then 'CORRECT' when score >= 0.25 then 'PARTIAL' when score is not null then 'INCORRECT' end verdict from s""")
def judge_bucket(spark, sf_dir):
    s = _verdicts(spark, sf_dir).groupBy("conv_id").agg(F.avg(E.vote_score(F.col("verdict"))).alias("s"))
    return s.select("conv_id", F.round("s", 6).alias("score"), E.judge_bucket(F.col("s")).alias("verdict"))


@query("diagnose", f"""with {SCORED_SQL} select doc_id, case when not (case when toxic = 1 then quality >= 1 else score / 100 >= 0.05 end) then 'retrieval' when score / 100 < 0.8 then 'generation'
when (n_chars % 100) / 100.0::double < 0.4 then 'generation' else 'retrieval' end failure_type from scored""")
def diagnose(spark, sf_dir):
    top = F.when(F.col("toxic") == 1, F.when(F.col("quality") >= 1, 1.0).otherwise(-1.0))
    return _scored(spark, sf_dir).select("doc_id", G.diagnose(top, F.col("score") / 100, F.col("n_chars") % 100 / 100.0).alias("failure_type"))


@query("best_attempt", "select user_id, event_id attempt, value confidence from (select *, row_number() over (partition by user_id order by value desc, event_id) n from events) where n = 1")
def best_attempt(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("attempt"), F.col("value").alias("confidence"))
    return G.best_attempt(rows, by="user_id")


@query("gold_type", """with g as (select conv_id, turn, role, text is not null and role <> 'system' as ok from conversations),
c as (select conv_id, role, count(*) n, min(turn) f from g where ok group by 1, 2), b as (select conv_id, role from (select *, row_number() over (partition by conv_id order by n desc, f) k from c) where k = 1),
m as (select conv_id, count(*) filter (where ok) * 2 < count(*) none from g group by 1)
select conv_id, case when none then 'unanswerable' else role end gold_type from m left join b using (conv_id)""")
def gold_type(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    ok = F.col("text").isNotNull() & (F.col("role") != "system")
    return rows.groupBy("conv_id").agg(E.gold_type(F.col("role"), ok, F.col("turn")).alias("gold_type"))
