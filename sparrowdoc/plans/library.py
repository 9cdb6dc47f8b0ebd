"""The registry, discovery and lists over the driver's tables; orders stand in for uploads, parts for search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import discovery, library
from ..registry import query
from ..session import read_table

RECORDS_SQL = "rec as (select c_custkey paper_id, case c_custkey % 5 when 0 then 'failed' when 1 then 'processing' else 'ready' end status, case when c_custkey % 3 = 0 then 'p' || c_custkey end source_id, c_name uploaded_at from customer)"


def _records(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    status = F.when(k % 5 == 0, "failed").when(k % 5 == 1, "processing").otherwise("ready")
    return read_table(spark, sf_dir, "customer").select(k.alias("paper_id"), status.alias("status"), F.when(k % 3 == 0, F.concat(F.lit("p"), k.cast("string"))).alias("source_id"), F.col("c_name").alias("uploaded_at"))


@query("status_counts", f"with {RECORDS_SQL} select count(*) filter (where status = 'ready') n_ready, count(*) filter (where status = 'processing') n_processing, count(*) filter (where status = 'failed') n_failed from rec")
def status_counts(spark, sf_dir):
    return library.status_counts(_records(spark, sf_dir))


@query("newest_papers", f"with {RECORDS_SQL} select paper_id, row_number() over (order by uploaded_at desc) as place from rec where status = 'ready' qualify place <= 20")
def newest_papers(spark, sf_dir):
    rows = library.newest_first(library.ready(_records(spark, sf_dir))).limit(20).agg(F.collect_list("paper_id").alias("ids"))
    return rows.select(F.posexplode("ids").alias("place", "paper_id")).select("paper_id", (F.col("place") + 1).cast("long").alias("place"))


@query("paper_gate", f"with {RECORDS_SQL} select o_orderkey, case when rec.paper_id is null then 'not found' when status <> 'ready' then 'not ready' end problem from orders left join rec on rec.paper_id = o_custkey + 100")
def paper_gate(spark, sf_dir):
    asked = read_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 100).alias("paper_id"))
    return library.checked(asked, _records(spark, sf_dir)).select("o_orderkey", "problem")


@query("delete_papers", f"with {RECORDS_SQL}, gone as (select distinct o_custkey k from orders where o_orderkey % 7 = 0) select 'record' kind, count(*) n from rec where paper_id not in (select k from gone) union all select 'chunk', count(*) from orders where o_custkey not in (select k from gone)")
def delete_papers(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_id"), "o_orderkey")
    records, chunks = library.without(_records(spark, sf_dir), orders, orders.where("o_orderkey % 7 = 0"))
    return records.select(F.lit("record").alias("kind")).unionByName(chunks.select(F.lit("chunk").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


RESULTS_SQL = """res as (select p_brand q, 'p' || p_partkey id, p_name title, case when p_partkey % 2 = 0 then 'arxiv' else 'scholar' end source, p_partkey pos, case when p_partkey % 4 < 3 then 'u' || p_partkey end pdf_url,
case when p_partkey % 5 > 0 then p_size end citations, case when p_partkey % 7 > 0 then 2000 + p_size % 20 end as year from part)"""


def _results(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    name = k.cast("string")
    return read_table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("q"), F.concat(F.lit("p"), name).alias("id"), F.col("p_name").alias("title"), F.when(k % 2 == 0, "arxiv").otherwise("scholar").alias("source"), k.alias("pos"),
        F.when(k % 4 < 3, F.concat(F.lit("u"), name)).alias("pdf_url"), F.when(k % 5 > 0, F.col("p_size")).alias("citations"), F.when(k % 7 > 0, F.col("p_size") % 20 + 2000).alias("year"),
    )


@query("in_library", f"with {RECORDS_SQL}, {RESULTS_SQL} select id, id in (select source_id from rec where source_id is not null) in_library from res")
def in_library(spark, sf_dir):
    return library.in_library(_results(spark, sf_dir), _records(spark, sf_dir)).select("id", "in_library")


@query("imported_papers", f"with {RECORDS_SQL}, {RESULTS_SQL} select id source_id, left(title, 80) || '.pdf' filename, 'processing' status from res where pdf_url is not null and id not in (select source_id from rec where source_id is not null)")
def imported_papers(spark, sf_dir):
    return library.imports(_results(spark, sf_dir), _records(spark, sf_dir)).select("source_id", "filename", "status")


@query("per_source_results", f"with {RESULTS_SQL} select q, source, id from res qualify row_number() over (partition by q, source order by pos) <= 15")
def per_source_results(spark, sf_dir):
    return discovery.per_source(_results(spark, sf_dir), by="q", limit=40).select("q", "source", "id")


@query("merged_sources", f"with {RESULTS_SQL} select q, id, row_number() over (partition by q order by source, pos) pos from res")
def merged_sources(spark, sf_dir):
    rows = _results(spark, sf_dir)
    parts = [rows.where(F.col("source") == s).drop("source") if s == "arxiv" else rows.where(F.col("source") == s) for s in ("arxiv", "scholar")]
    return discovery.union_sources(parts, by="q").select("q", "id", F.col("pos").cast("long").alias("pos"))


@query("search_papers", f"""with {RESULTS_SQL}, c as (select *, row_number() over (partition by q order by source, pos) n from (select * from res qualify row_number() over (partition by q, source order by pos) <= 15)),
k as (select *, trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g')) key from c), f as (select * from k where key <> '' qualify row_number() over (partition by q, key order by n) = 1)
select q, id, row_number() over (partition by q order by (pdf_url is not null) desc, coalesce(citations, 0) desc, coalesce(year, 0) desc, n) rank from f qualify rank <= 20""")
def search_papers(spark, sf_dir):
    """Titles of parts are far apart unless they are equal, which the SQL makes use of."""
    rows = _results(spark, sf_dir)
    found = discovery.search([rows.where("source = 'arxiv'"), rows.where("source = 'scholar'")], by="q", limit=20)
    return found.select("q", "id", F.col("rank").cast("long").alias("rank"))


@query("recommended", """with r as (select l_suppkey s, 'p' || l_partkey id, l_orderkey o, l_linenumber n from lineitem), f as (select * from r qualify row_number() over (partition by s, id order by o, n) = 1)
select s paper_id, id, o search_query, row_number() over (partition by s order by o, n, id) rank from f qualify rank <= 12""")
def recommended(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("paper_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.lit("t").alias("title"), F.col("l_orderkey").alias("search_query"), F.col("l_linenumber").alias("n"))
    out = discovery.recommendations(rows, by="paper_id", order=["search_query", "n", "id"])
    return out.select("paper_id", "id", "search_query", F.col("rank").cast("long").alias("rank"))


@query("recent_searches", "select o_custkey, o_orderpriority as query, row_number() over (partition by o_custkey order by max(o_orderkey) desc) rank from orders group by 1, 2 qualify rank <= 3")
def recent_searches(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("query"), F.col("o_orderkey").alias("at"))
    return discovery.recent(rows, by="o_custkey", limit=3).select("o_custkey", "query", F.col("rank").cast("long").alias("rank"))


@query("glossary_search", "select p_partkey from part where contains(lower(p_name), 'red') or contains(lower(p_type), 'red')")
def glossary_search(spark, sf_dir):
    return discovery.matching(read_table(spark, sf_dir, "part"), "RED", ["p_name", "p_type"]).select("p_partkey")
