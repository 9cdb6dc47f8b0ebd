"""Chunking, BM25, nearest neighbours, fusion and re-ranking over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import context_entry, lexical_tokens
from ..functions.vectors import cosine
from ..operators import chunking, evaluation, retrieval
from ..operators.index import Index
from ..registry import query
from ..session import read_table, shared_folder

SIZE, OVERLAP = 256, 50

WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda t: t <> '')"
CHUNKS_SQL = f"""
toks as (select doc_id, {WORDS.format('lower(text)')} w from documents),
chunks as (select doc_id, s // {SIZE - OVERLAP} chunk_index, s as start, list_slice(w, s + 1, s + {SIZE}) tokens
           from (select doc_id, w, unnest(range(0, len(w), {SIZE - OVERLAP})) s from toks))"""


def bm25_sql(units: str, key: str) -> str:
    """CTEs from ``units`` (key, tokens) to scored(item_id, key, score)."""
    return f"""
stats as (select count(*) n, avg(len(tokens)) avgdl from {units}),
post as (select {key}, term, dl, count(*) tf from (select {key}, len(tokens) dl, unnest(tokens) term from {units}) group by all),
df as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) raw from post, stats group by term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from df) else raw end idf from df),
q as (select item_id, term, count(*) times from (select item_id, unnest({WORDS.format('lower(text)')}) term from benchmark) group by all),
scored as (select item_id, {key}, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) score
           from q join idf using (term) join post using (term), stats group by item_id, {key})"""


def _chunks(spark, sf_dir) -> DataFrame:
    return chunking.chunk_texts(read_table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")), size=SIZE, overlap=OVERLAP)


def _best(spark, sf_dir, units: DataFrame, keys: list[str], k: int) -> DataFrame:
    return retrieval.bm25_best(units, read_table(spark, sf_dir, "benchmark"), keys, query_key="item_id", query_text="text", k=k, digits=4)


def _documents(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", lexical_tokens(F.col("text")).alias("tokens"))


def _ranked_documents(spark, sf_dir, k: int) -> DataFrame:
    return _best(spark, sf_dir, _documents(spark, sf_dir), ["doc_id"], k)


DOCS_SQL = f"units as (select doc_id, {WORDS.format('lower(text)')} tokens from documents)," + bm25_sql("units", "doc_id") + """,
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from scored)"""


@query("chunk_windows", f"with {CHUNKS_SQL} select doc_id, chunk_index, start, len(tokens) token_count from chunks")
def chunk_windows(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("start"), F.col("token_count").cast("long").alias("token_count"))


@query("bm25_topk", f"with {CHUNKS_SQL}, units as (select doc_id, chunk_index, tokens from chunks)," + bm25_sql("units", "doc_id, chunk_index") + """
select item_id, doc_id, chunk_index, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id, chunk_index) rank from scored) where rank <= 5""")
def bm25_topk(spark, sf_dir):
    out = _best(spark, sf_dir, _chunks(spark, sf_dir), ["doc_id", "chunk_index"], 5)
    return out.select("item_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "score", F.col("rank").cast("long").alias("rank"))


@query("bm25_documents", f"with {DOCS_SQL} select item_id, doc_id, score, rank from ranked where rank <= 10")
def bm25_documents(spark, sf_dir):
    return _ranked_documents(spark, sf_dir, 10).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _index(spark, sf_dir) -> Index:
    """The documents of each source as a paper."""
    index = Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", paper="source", pos="doc_id")
    index.put(read_table(spark, sf_dir, "documents").select("source", "doc_id", "text"))
    return index


def _indexed(spark, sf_dir, index: Index, k: int) -> DataFrame:
    out = index.best(read_table(spark, sf_dir, "benchmark"), k=k, digits=4, query_key="item_id", query="text")
    return out.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("indexed_bm25", f"with {DOCS_SQL} select item_id, doc_id, score, rank from ranked where rank <= 10")
def indexed_bm25(spark, sf_dir):
    return _indexed(spark, sf_dir, _index(spark, sf_dir), 10)


@query("reindexed_bm25", "with documents as (select * replace (case when source = 'src1' then text || ' ' || lang || ' ' || source else text end as text) from documents where source <> 'src2')," + f"""
{DOCS_SQL} select item_id, doc_id, score, rank from ranked where rank <= 10""")
def reindexed_bm25(spark, sf_dir):
    """As before, after one paper is replaced and one deleted."""
    index, docs = _index(spark, sf_dir), read_table(spark, sf_dir, "documents")
    index.put(docs.where("source = 'src1'").select("source", "doc_id", F.concat_ws(" ", "text", "lang", "source").alias("text")))
    index.drop(docs.where("source = 'src2'").select("source"))
    return _indexed(spark, sf_dir, index, 10)


SCOPED_SQL = f"""with q as (select item_id, term, count(*) times from (select item_id, unnest({WORDS.format('lower(text)')}) term from benchmark) group by all),
u as (select source, doc_id, {WORDS.format('lower(text)')} tokens from documents),
stats as (select source, count(*) n, avg(len(tokens)) avgdl from u group by 1),
post as (select source, doc_id, dl, term, count(*) tf from (select source, doc_id, len(tokens) dl, unnest(tokens) term from u) group by all),
df as (select source, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) raw from post join stats using (source) group by source, term, n),
idf as (select source, term, case when raw < 0 then 0.25 * avg(raw) over (partition by source) else raw end idf from df),
scored as (select item_id, source, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) score from q join idf using (term) join post using (source, term) join stats using (source) where source = 'src' || item_id % 20 group by all)
select item_id, source, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from scored) where rank <= 3"""


@query("indexed_bm25_by_paper", SCOPED_SQL)
def indexed_bm25_by_paper(spark, sf_dir):
    """Each item asked in one paper, with that paper's statistics."""
    index = _index(spark, sf_dir)
    asked = read_table(spark, sf_dir, "benchmark").withColumn("source", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    out = index.best(asked, k=3, digits=4, query_key="item_id", query="text", scoped=True)
    return out.select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), "doc_id", "score", F.col("rank").cast("long").alias("rank"))


HIT_SQL = f"with {DOCS_SQL}, hits as (select r.item_id, r.rank, contains(d.text, b.text) hit from ranked r join documents d using (doc_id) join benchmark b using (item_id) where rank <= 5)"


@query("hit_mrr", HIT_SQL + """ select count(*) n, round(avg(case when f is null then 0.0 else 1.0 end), 6) hit_at_k, round(avg(case when f is null then 0.0::double else 1.0::double / f end), 6) mrr
from (select item_id, min(case when hit then rank end) f from hits group by 1)""")
def hit_mrr(spark, sf_dir):
    docs, items = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    ranks = _ranked_documents(spark, sf_dir, 5).join(docs, "doc_id").join(items, "item_id").select("item_id", "rank", F.contains("text", "item").alias("hit"))
    return evaluation.hit_and_mrr(ranks, query="item_id")


NORM = "list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda t: t not in ('', 'a', 'an', 'the'))"


@query("evidence_recall", f"""with {DOCS_SQL}, c as (select r.item_id, list_distinct({NORM.format('d.text')}) c from ranked r join documents d using (doc_id) where rank <= 5),
g as (select item_id, list_distinct({NORM.format('text')}) g from benchmark)
select item_id, case when max(coalesce(len(list_intersect(g, c)) / nullif(len(g), 0)::double, 0)) >= 0.5 then 1.0 else 0.0 end::double evidence_recall from g left join c using (item_id) group by 1""")
def evidence_recall(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = _ranked_documents(spark, sf_dir, 5).join(docs, "doc_id").select("item_id", "text")
    gold = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").alias("evidence_id"), F.col("text").alias("evidence"))
    return evaluation.evidence_recall(gold, got, by="item_id")


OVERLAP_SQL = "coalesce(len(list_intersect(list_distinct({q}), list_distinct({t}))) / nullif(len(list_distinct({q})), 0)::double, 0.0)"


@query("rerank_overlap", f"""with {DOCS_SQL}, p as (select r.item_id, r.doc_id, round({OVERLAP_SQL.format(q=WORDS.format('lower(b.text)'), t=WORDS.format('lower(d.text)'))}, 6) rerank_score
from ranked r join documents d using (doc_id) join benchmark b using (item_id) where rank <= 10)
select item_id, doc_id, rerank_score, new_rank from (select *, row_number() over (partition by item_id order by rerank_score desc, doc_id) new_rank from p) where new_rank <= 5""")
def rerank_overlap(spark, sf_dir):
    docs, items = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    pairs = _ranked_documents(spark, sf_dir, 10).join(docs, "doc_id").join(items, "item_id")
    out = retrieval.rerank(pairs, by="item_id", query="item", text="text", tie="doc_id", k=5)
    return out.select("item_id", "doc_id", "rerank_score", F.col("new_rank").cast("long").alias("new_rank"))


@query("hybrid_rrf", f"""with {DOCS_SQL}, a as (select item_id, doc_id, rank from ranked where rank <= 10),
p as (select r.item_id, r.doc_id, round({OVERLAP_SQL.format(q=WORDS.format('lower(b.text)'), t=WORDS.format('lower(d.text)'))}, 6) s from ranked r join documents d using (doc_id) join benchmark b using (item_id) where rank <= 50),
o as (select item_id, doc_id, row_number() over (partition by item_id order by s desc, doc_id) rank from p),
f as (select item_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) rrf_score from (select * from a union all select * from o where rank <= 10) group by 1, 2)
select item_id, doc_id, rrf_score, rank from (select *, row_number() over (partition by item_id order by rrf_score desc, doc_id) rank from f) where rank <= 5""")
def hybrid_rrf(spark, sf_dir):
    docs, items = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    ranked = _ranked_documents(spark, sf_dir, 50)
    second = retrieval.rerank(ranked.join(docs, "doc_id").join(items, "item_id"), by="item_id", query="item", text="text", tie="doc_id", k=10).select("item_id", "doc_id", F.col("new_rank").alias("rank"))
    fused = retrieval.reciprocal_rank_fusion(ranked.where(F.col("rank") <= retrieval.CANDIDATES), second, by="item_id", item="doc_id")
    return retrieval.top(fused, "item_id", [F.desc("rrf_score"), F.col("doc_id")], 5).withColumn("rank", F.col("rank").cast("long"))


DIST = "round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), 6)"
KNN_SQL = f"""near as (select q.vec_id query_id, v.vec_id, {DIST} distance, q.label = v.label same from embeddings q, embeddings v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id),
nn as (select * from (select *, row_number() over (partition by query_id order by distance, vec_id) rank from near) where rank <= 5)"""


def _neighbours(spark, sf_dir) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0")  # the stated query set, against all rows
    near = retrieval.knn(queries, vectors, query_id="vec_id", query_vector="embedding", vector_id="vec_id", vector="embedding", k=6)
    others = near.where("query_id <> vec_id").drop("rank")
    return retrieval.top(others, "query_id", [F.col("distance"), F.col("vec_id")], 5)


@query("knn_topk", f"with {KNN_SQL} select query_id, vec_id, distance, rank from nn")
def knn_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("query_id", "vec_id", "distance", F.col("rank").cast("long").alias("rank"))


@query("knn_label_mrr", f"""with {KNN_SQL} select count(*) n, round(avg(case when f is null then 0.0 else 1.0 end), 6) hit_at_k, round(avg(case when f is null then 0.0::double else 1.0::double / f end), 6) mrr
from (select query_id, min(case when same then rank end) f from nn group by 1)""")
def knn_label_mrr(spark, sf_dir):
    label = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = _neighbours(spark, sf_dir).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return evaluation.hit_and_mrr(near.select("query_id", "rank", (F.col("label") == F.col("own")).alias("hit")))


@query("cosine_neighbours", """select a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double))
 / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double)))), 6) relevancy
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark, sf_dir):
    v = read_table(spark, sf_dir, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("relevancy"))


def _lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    by_source = read_table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    rank = lambda c: by_source.select("lang", "source", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(c), "source")).alias("rank")).where("rank <= 10")
    return rank("n"), rank("c")


LISTS_SQL = """s as (select lang, source, count(*) n, sum(n_chars) c from documents group by 1, 2),
a as (select * from (select lang, source, row_number() over (partition by lang order by n desc, source) rank from s) where rank <= 10),
b as (select * from (select lang, source, row_number() over (partition by lang order by c desc, source) rank from s) where rank <= 10)"""


@query("rrf_fusion", f"with {LISTS_SQL} select lang, source, round(sum(1.0::double / (60 + rank)), 9) rrf_score from (select * from a union all select * from b) group by 1, 2")
def rrf_fusion(spark, sf_dir):
    return retrieval.reciprocal_rank_fusion(*_lists(spark, sf_dir), by="lang", item="source")


@query("compare_interleave", f"""with {LISTS_SQL} select lang, source, label, rank, row_number() over (partition by lang order by rank, label) as position
from (select *, 'A' as label from a union all select *, 'B' as label from b)""")
def compare_interleave(spark, sf_dir):
    out = retrieval.interleave(*_lists(spark, sf_dir), by="lang")
    return out.select("lang", "source", "label", F.col("rank").cast("long").alias("rank"), F.col("position").cast("long").alias("position"))


@query("multihop_dedup", "select doc_id, source from (select *, row_number() over (partition by md5(text) order by source, doc_id) n from documents) where n = 1")
def multihop_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("key"))
    return retrieval.first_occurrences(docs, ["key"], ["source", "doc_id"]).select("doc_id", "source")


@query("source_dedup", "select lang, source, min(doc_id) doc_id from documents group by 1, 2")
def source_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return retrieval.first_occurrences(docs, ["lang", "source"], ["doc_id"])


@query("context_block", """select lang, md5(string_agg('[Chunk ' || n || ' | Section: ' || source || ' | Page: ' || doc_id || ']' || chr(10) || left(text, 600), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n)) block
from (select *, row_number() over (partition by lang order by doc_id) n from documents) where n <= 5 group by 1""")
def context_block(spark, sf_dir):
    rows = retrieval.top(read_table(spark, sf_dir, "documents"), "lang", [F.col("doc_id")], 5, "n")
    text = context_entry(F.col("n"), F.col("source"), F.col("doc_id"), F.left("text", F.lit(600)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda s: s["t"]), "\n\n---\n\n")
    return rows.groupBy("lang").agg(F.md5(joined).alias("block"))
