"""Hybrid, multi-hop and routed retrieval, grading and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import rounded
from ..operators import evaluation, grading, retrieval
from ..registry import query
from ..session import read_table
from .answers import PAIRS_SQL, pairs
from .retrieval import NORM, OVERLAP_SQL, WORDS, bm25_sql

LETTERS = "etaoinsh"


def letter_vector(text: Column) -> Column:
    """How often eight letters stand in a text, rounded shares: a vector that SQL can follow."""
    n = F.greatest(F.length(text), F.lit(1))
    return F.array(*[rounded((F.length(text) - F.length(F.replace(text, F.lit(c)))) / n, 6) for c in LETTERS])


def vector_sql(text: str) -> str:
    return "[" + ", ".join(f"round((length({text}) - length(replace({text}, '{c}', ''))) / greatest(length({text}), 1)::double, 6)" for c in LETTERS) + "]"


def hybrid_sql(asked: str, k: int) -> str:
    """CTEs from ``asked`` (qid, said, seed) to hybrid(qid, doc_id, rrf_score, rank) over all documents."""
    lexical = bm25_sql("units", "doc_id").replace("from benchmark", f"from {asked}").replace("lower(text)", "lower(said)").replace("item_id", "qid").replace(", 4) score", ", 9) score")
    return f"""units as (select doc_id, {WORDS.format('lower(text)')} tokens from documents),{lexical},
filler as (select a.qid, d.doc_id, 0.0::double score from {asked} a, (select doc_id from documents order by doc_id limit 20) d where (a.qid, d.doc_id) not in (select qid, doc_id from scored)),
lex as (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) rank from (select qid, doc_id, score from scored union all select * from filler) qualify rank <= 10),
dv as (select doc_id, {vector_sql('text')} v from documents), qv as (select qid, {vector_sql('seed')} w from {asked}),
den as (select qid, doc_id, row_number() over (partition by qid order by round(list_sum(list_transform(list_zip(w, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6), doc_id) rank from qv, dv qualify rank <= 10),
fused as (select coalesce(l.qid, d.qid) qid, coalesce(l.doc_id, d.doc_id) doc_id, round(coalesce(1.0::double / (60 + l.rank), 0) + coalesce(1.0::double / (60 + d.rank), 0), 9) rrf_score, l.rank lr, d.rank dr from lex l full join den d on l.qid = d.qid and l.doc_id = d.doc_id),
hybrid as (select qid, doc_id, rrf_score, row_number() over (partition by qid order by rrf_score desc, lr nulls last, dr nulls last) rank from fused qualify rank <= {k})"""


def _chunks(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _planned(spark, sf_dir) -> DataFrame:
    """Benchmark items as questions with plans: halves as sub-questions, the first two words as key concepts."""
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    words = T.words(F.col("query"))
    half = F.floor(F.size(words) / 2).cast("int")
    subs = F.array(F.array_join(F.slice(words, F.lit(1), half), " "), F.col("query"), F.array_join(F.slice(words, half + 1, F.size(words)), " "))
    kind = F.get(F.array(F.lit("factual"), F.lit("analysis"), F.lit("unheard of")), (F.col("query_id") % 3).cast("int"))
    plan = F.struct(kind.alias("answer_type"), F.slice(words, 1, 2).alias("key_concepts"), subs.alias("sub_questions"), F.when(F.col("query_id") % 2 == 0, "multi_hop").otherwise("simple").alias("complexity"))
    return items.select("query_id", "query", plan.alias("plan"), F.reverse("query").alias("hyde"))


PLANNED_SQL = f"""w as (select item_id qid, text, {WORDS.format('text')} w from benchmark),
planned as (select qid, text, array_to_string(w[:2], ' ') boost, [array_to_string(w[:len(w) // 2], ' '), text, array_to_string(w[len(w) // 2 + 1:], ' ')] subs, case qid % 3 when 1 then 12 else 10 end rk, case qid % 3 when 0 then 3 when 1 then 7 else 5 end lk, qid % 2 = 0 as multi from w)"""


@query("hybrid_retrieve", f"with {PLANNED_SQL}, asked as (select qid, text || ' ' || boost said, reverse(text) seed from planned), {hybrid_sql('asked', 5)} select qid query_id, doc_id chunk_id, rrf_score, rank from hybrid")
def hybrid_retrieve(spark, sf_dir):
    asked = _planned(spark, sf_dir).select("query_id", "query", F.col("plan.key_concepts").alias("boost"), "hyde")
    return retrieval.hybrid_retrieve(asked, _chunks(spark, sf_dir), embed=letter_vector).withColumn("rank", F.col("rank").cast("long"))


HOPS_SQL = """hops as (select qid q0, pass, qid || '/' || pass qid, query || ' ' || boost said, query seed, rk from (select qid, boost, rk, multi, unnest(list_concat([text], list_filter(subs, lambda s: s <> text))) query, unnest(range(0, 1 + len(list_filter(subs, lambda s: s <> text)))) pass from planned){})"""
MULTI_SQL = """found as (select q0, pass, hybrid.doc_id, hybrid.rank, md5(d.text) t from hybrid join hops using (qid) join documents d on d.doc_id = hybrid.doc_id where hybrid.rank <= rk),
multi as (select * from found qualify row_number() over (partition by q0, t order by pass, rank) = 1)"""


@query("multihop_retrieve", f"with {PLANNED_SQL}, {HOPS_SQL.format('')}, {hybrid_sql('hops', 20)}, {MULTI_SQL} select q0 query_id, doc_id chunk_id, pass, rank from multi")
def multihop_retrieve(spark, sf_dir):
    asked = _planned(spark, sf_dir).select("query_id", "query", F.col("plan.key_concepts").alias("boost"), F.col("plan.sub_questions").alias("sub_questions"), retrieval.plan_config(F.col("plan.answer_type"))["retrieval_k"].alias("retrieval_k"))
    found = retrieval.multihop_retrieve(asked, _chunks(spark, sf_dir), embed=letter_vector)
    return found.select("query_id", "chunk_id", F.col("pass").cast("long").alias("pass"), F.col("rank").cast("long").alias("rank"))


_SHARE = OVERLAP_SQL.format(q=WORDS.format("lower(p.text)"), t=WORDS.format("lower(d.text)"))
ROUTE_SQL = f"""with {PLANNED_SQL},
hops0 as (select qid q0, unnest(list_concat([text], list_filter(subs, lambda s: s <> text))) query, unnest(range(0, 1 + len(list_filter(subs, lambda s: s <> text)))) pass, boost, rk, multi from planned),
hops as (select q0, pass, q0 || '/' || pass qid, query || ' ' || boost said, case when multi then query else reverse(query) end seed, rk from hops0 where multi or pass = 0), {hybrid_sql('hops', 20)}, {MULTI_SQL.replace('partition by q0, t', 'partition by q0, case when q0 % 2 = 0 then t else doc_id::varchar end')},
ordered as (select q0, doc_id, row_number() over (partition by q0 order by pass, rank) n from multi),
s as (select o.q0, o.doc_id, o.n, p.lk, round({_SHARE}, 6) s from ordered o join planned p on p.qid = o.q0 join documents d on d.doc_id = o.doc_id)
select q0 query_id, doc_id chunk_id, row_number() over (partition by q0 order by s desc, n) new_rank from s qualify new_rank <= lk"""


@query("route_query", ROUTE_SQL)
def route_query(spark, sf_dir):
    routed = retrieval.route(_planned(spark, sf_dir), _chunks(spark, sf_dir), embed=letter_vector)
    return routed.select("query_id", "chunk_id", F.col("new_rank").cast("long").alias("new_rank"))


@query("plan_config", "select item_id, case item_id % 3 when 1 then 12 else 10 end retrieval_k, case item_id % 3 when 0 then 3 when 1 then 7 else 5 end llm_k from benchmark")
def plan_config(spark, sf_dir):
    config = retrieval.plan_config(F.col("plan.answer_type"))
    return _planned(spark, sf_dir).select(F.col("query_id").alias("item_id"), config["retrieval_k"].alias("retrieval_k"), config["llm_k"].alias("llm_k"))


UNITS = "list_transform(string_split(trim(l), '. '), lambda p, i: case when trim(p) = '' then '' when i < len(string_split(trim(l), '. ')) then trim(p) || '.' else trim(p) end)"
RECONSTRUCT_SQL = f"""with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) i, unnest(string_split(text, chr(10))) l from documents),
k as (select doc_id, i, case when trim(l) = '' then l when starts_with(trim(l), '**') and ends_with(trim(l), '**') then l else
 array_to_string(list_filter({UNITS}, lambda u: u <> '' and (length(u) <= 15 or length(u) % 3 <> 0)), ' ') end x, trim(l) <> '' and len(list_filter({UNITS}, lambda u: u <> '' and (length(u) <= 15 or length(u) % 3 <> 0))) = 0 gone from l)
select doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(string_agg(x, chr(10) order by i) filter (where not gone), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), chr(10) || ' ')) cleaned from k group by 1"""


@query("reconstruct_answer", RECONSTRUCT_SQL)
def reconstruct_answer(spark, sf_dir):
    """Documents as answers, of which the sentences with a length that three divides are unsupported."""
    gone = F.filter(T.grader_sentences(F.col("text")), lambda s: F.length(s) % 3 == 0)
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(F.btrim(T.reconstruct(F.col("text"), gone), F.lit("\n "))).alias("cleaned"))


CHECK_SENTENCES = "list_filter(list_transform(string_split(replace(answer, chr(10), '. '), '. '), lambda s: trim(s)), lambda s: length(s) > 20)"
COSINE = "case when sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x))) < 1e-9 then 0 else list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x)))) end"
FAITHFUL_SQL = f"""with {PAIRS_SQL}, a as (select conv_id || '-' || turn id, question, answer from pairs), c as (select a.id, {vector_sql('t.text')} v from a join conversations t on a.id = t.conv_id || '-' || (t.turn - 1) or a.id = t.conv_id || '-' || (t.turn - 2) where trim(t.text) <> '' and t.turn % 3 > 0),
s as (select id, i, {vector_sql('s')} v from (select id, unnest({CHECK_SENTENCES}) s, unnest(range(len({CHECK_SENTENCES}))) i from a)),
b as (select s.id, s.i, max({COSINE.format(a='s.v', b='c.v')}) best from s join c using (id) group by all), f as (select id, avg(case when best >= 0.55 then 1.0 else 0.0 end) f from b group by 1),
m as (select a.id, question, answer, case when c.id is null then 'error_no_chunks' when trim(answer) = '' then 'error_no_answer' else 'local' end method from a left join (select distinct id from c) c using (id)),
r as (select id, method, case when method = 'local' then coalesce(f, 0) else 0 end f, case when method = 'local' then {COSINE.format(a=vector_sql("('Q: ' || question)"), b=vector_sql('answer'))} else 0 end r from m left join f using (id))
select id, method, round(f, 6) faithfulness, round(r, 4) answer_relevancy from r"""


@query("faithfulness_cosine", FAITHFUL_SQL)
def faithfulness_cosine(spark, sf_dir):
    """Answers against the turns that follow the question, as far as these are chunks."""
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    answers = pairs(spark, sf_dir).select(key.alias("id"), "question", "answer")
    turns = read_table(spark, sf_dir, "conversations").where("turn % 3 > 0")
    chunks = turns.select("text", F.explode(F.array(F.col("turn") - 1, F.col("turn") - 2)).alias("turn"), "conv_id").select(key.alias("id"), "text")
    out = grading.evaluate_answers(answers, chunks, by="id", embed=letter_vector, prefix="Q: ")
    return out.select("id", "method", F.round("faithfulness", 6).alias("faithfulness"), F.round("answer_relevancy", 4).alias("answer_relevancy"))


ROWS_SQL = """rows as (select doc_id id, lang gold_type, quality::double answer_f1, toxic = 0 as answerable_correct, case when n_chars % 3 > 0 then (n_chars % 10) / 10.0::double end evidence_recall, (n_chars % 100)::double confidence, 0.5::double faithfulness,
n_chars % 400 duration_ms, case when n_chars % 4 > 0 then n_chars % 4 end llm_calls, case when n_chars % 5 > 0 then (n_chars % 3) / 2.0::double end judge_score, case n_chars % 5 when 0 then null when 1 then 'CORRECT' when 2 then 'PARTIAL' else 'INCORRECT' end judge_verdict,
source config, case when quality is not null then 1 - quality end::double score_original, toxic::double score_cleaned, n_chars % 3 removed_count from documents left join labels using (doc_id))"""


def _rows(spark, sf_dir) -> DataFrame:
    n = F.col("n_chars")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("gold_type"), F.col("quality").cast("double").alias("answer_f1"), (F.col("toxic") == 0).alias("answerable_correct"), F.when(n % 3 > 0, n % 10 / 10.0).alias("evidence_recall"), (n % 100).cast("double").alias("confidence"), F.lit(0.5).alias("faithfulness"),
        (n % 400).alias("duration_ms"), F.when(n % 4 > 0, n % 4).alias("llm_calls"), F.when(n % 5 > 0, n % 3 / 2.0).alias("judge_score"), F.when(n % 5 == 1, "CORRECT").when(n % 5 == 2, "PARTIAL").when(n % 5 > 2, "INCORRECT").alias("judge_verdict"),
        F.col("source").alias("config"), (1 - F.col("quality")).cast("double").alias("score_original"), F.col("toxic").cast("double").alias("score_cleaned"), (n % 3).alias("removed_count"),
    )


_MEANS = """count(*) n, round(avg(answer_f1), 6) answer_f1, round(avg(case when answerable_correct then 1.0 when not answerable_correct then 0.0 end), 6) answerable_accuracy, round(avg(evidence_recall), 6) evidence_recall, round(avg(confidence), 6) mean_confidence,
round(avg(faithfulness), 6) mean_faithfulness, round(avg(nullif(duration_ms, 0)), 6) mean_duration_ms, round(avg(llm_calls), 6) mean_llm_calls, round(avg(judge_score), 6) judge_accuracy from rows"""


@query("eval_summary", f"with {ROWS_SQL} select {_MEANS}")
def eval_summary(spark, sf_dir):
    return evaluation.summary(_rows(spark, sf_dir))


@query("eval_summary_by_type", f"with {ROWS_SQL} select gold_type, {_MEANS} group by 1")
def eval_summary_by_type(spark, sf_dir):
    return evaluation.summary(_rows(spark, sf_dir), ["gold_type"])


@query("ablation_matrix", f"with {ROWS_SQL} select config, {_MEANS} group by 1")
def ablation_matrix(spark, sf_dir):
    return evaluation.ablation_matrix(_rows(spark, sf_dir))


@query("paired_effect", f"""with {ROWS_SQL}, e as (select *, case when score_original is null or score_cleaned is null then 'unjudged' when score_cleaned > score_original then 'helped' when score_cleaned < score_original then 'hurt' else 'neutral' end k from rows)
select gold_type, count(*) n, count(*) filter (where removed_count > 0) n_removed, count(*) filter (where k = 'helped') helped, count(*) filter (where k = 'hurt') hurt, count(*) filter (where k = 'neutral') neutral, count(*) filter (where k = 'unjudged') unjudged,
round(avg(score_original), 6) mean_original, round(avg(score_cleaned), 6) mean_cleaned from e group by 1""")
def paired_effect(spark, sf_dir):
    return evaluation.paired_effects(_rows(spark, sf_dir), ["gold_type"])


@query("judge_distribution", f"with {ROWS_SQL} select gold_type, judge_verdict, count(*) n from rows where judge_verdict is not null group by 1, 2")
def judge_distribution(spark, sf_dir):
    return evaluation.verdict_map(_rows(spark, sf_dir), ["gold_type"]).select("gold_type", F.explode("judge_dist").alias("judge_verdict", "n"))


@query("client_stats", "with r as (select user_id, case when value > 20 then value end c, value / 100 f, event_type = 'click' m from events) select user_id, count(*) n, round(avg(coalesce(c, 0)), 6) avg_confidence, round(avg(f), 6) avg_faithfulness, round(avg(m::int), 6) multi_hop_rate from r group by 1")
def client_stats(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("user_id", F.when(F.col("value") > 20, F.col("value")).alias("confidence"), (F.col("value") / 100).alias("faithfulness"), F.when(F.col("event_type") == "click", "multi_hop").otherwise("simple").alias("complexity"))
    return evaluation.client_stats(rows, ["user_id"])


@query("worst_bad_row", "select doc_id as id, round(least(100.0, n_chars / 50.0), 4)::double confidence from labels join documents using (doc_id) where quality = 0 order by least(100.0, n_chars / 50.0), doc_id limit 1")
def worst_bad_row(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.round(F.least(F.lit(100.0), F.col("n_chars") / 50.0), 4).alias("confidence"))
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "BAD").otherwise("GOOD").alias("label"))
    return evaluation.worst_bad(evaluation.with_labels(docs.withColumn("label", F.lit(None).cast("string")), labels))


@query("evidence_token_f1", f"""with e as (select lang, string_agg(text, ' ' order by doc_id) t from documents group by 1), r as (select string_agg(text, ' ' order by item_id) g from benchmark),
f as (select lang, {NORM.format('t')} p, {NORM.format('g')} q from e, r) select lang, round(2.0 * coalesce(list_sum(list_transform(list_distinct(list_intersect(p, q)), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(q, lambda y: y = w))))), 0) / (len(p) + len(q)), 6)::double evidence_f1 from f""")
def evidence_token_f1(spark, sf_dir):
    out = evaluation.pooled_token_f1(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), by="lang")
    return out.withColumn("evidence_f1", F.round("evidence_f1", 6))


@query("pipeline_deltas", """with r as (select event_type pipeline, user_id query_id, row_number() over (partition by event_type, user_id order by event_id) rank, value > 30 hit from events),
f as (select pipeline, query_id, min(case when hit and rank <= 5 then rank end) f from r group by 1, 2), m as (select pipeline, count(*) n, round(avg(case when f is null then 0.0 else 1.0 end), 6) h, round(avg(case when f is null then 0.0::double else 1.0::double / f end), 6) m from f group by 1)
select m.pipeline, m.n, m.h hit_at_k, m.m mrr, round(m.h - b.h, 6) hit_delta, round(m.m - b.m, 6) mrr_delta from m, (select * from m where pipeline = 'view') b""")
def pipeline_deltas(spark, sf_dir):
    w = Window.partitionBy("event_type", "user_id").orderBy("event_id")
    ranks = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("pipeline"), F.col("user_id").alias("query_id"), F.row_number().over(w).alias("rank"), (F.col("value") > 30).alias("hit"))
    return evaluation.pipeline_deltas(ranks, baseline="view")


@query("retry_chunks", """with p as (select c_custkey q, case when c_custkey % 2 = 0 then 'retrieval' else 'generation' end f, 2 + c_custkey % 3 // 2 a from customer), r as (select o_custkey q, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) rank from orders)
select q, o_orderkey, rank, f = 'retrieval' or a >= 3 as expand from r join p using (q) where case when a >= 3 then rank <= 3 when f = 'generation' then rank <= 4 else true end""")
def retry_chunks(spark, sf_dir):
    k = F.col("c_custkey")
    plans = read_table(spark, sf_dir, "customer").select(k.alias("q"), F.when(k % 2 == 0, "retrieval").otherwise("generation").alias("failure_type"), (F.floor(k % 3 / 2) + 2).cast("int").alias("attempt"))
    ranked = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"))
    return grading.retry_chunks(ranked, plans, by="q").withColumn("rank", F.col("rank").cast("long"))


@query("retrieval_ok", """with s as (select user_id q, max(case when value > 10 then value - 95 end) t from events group by 1), a as (select c_custkey q, (c_custkey % 20) / 100.0::double f from customer)
select q, f faithfulness, t top_score, case when t is not null then t >= 0 else f >= 0.05 end retrieval_ok from a left join s using (q)""")
def retrieval_ok(spark, sf_dir):
    scores = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("q"), F.when(F.col("value") > 10, F.col("value") - 95).alias("score"))
    answers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q"), (F.col("c_custkey") % 20 / 100.0).alias("faithfulness"))
    return grading.retrieval_ok(scores, answers, by="q")
