"""Lines, sections, headings, titles and page geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, discovery, layout
from ..registry import query
from ..session import read_table


def _lines(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.withColumn("is_heading", F.length("text") <= 40)


LINES_SQL = """l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no, unnest(string_split(text, chr(10))) as text from documents)"""


@query("forward_fill_sections", f"""with {LINES_SQL}, m as (select *, length(text) <= 40 h from l),
s as (select *, sum(h::int) over w section_no, last_value(case when h then text end ignore nulls) over w heading, max(starts_with(lower(trim(text)), 'references')::int) over w ended from m
 window w as (partition by doc_id order by line_no rows unbounded preceding))
select doc_id, section_no, heading, coalesce(md5(string_agg(case when not h then text end, chr(10) order by line_no)), md5('')) body, count(*) n_lines from s where section_no > 0 and ended = 0 group by 1, 2, 3""")
def forward_fill_sections(spark, sf_dir):
    out = layout.sections(_lines(spark, sf_dir), paper="doc_id", order=["line_no"])
    return out.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "heading", F.md5("body").alias("body"), "n_lines")


TITLE = "(regexp_matches(text, '\\p{Lu}') and not regexp_matches(text, '\\p{L}\\p{Lu}') and not regexp_matches(text, '(^|[^\\p{L}])\\p{Ll}'))"


@query("heading_score", f"""with {LINES_SQL}, p as (select doc_id, line_no, trim(text) as text, lag(length(text)) over (partition by doc_id order by line_no) - length(text) gap, length(text) size from l)
select doc_id, line_no, (case when size / 10.0 > 11.5 then 3 else 0 end) + (case when len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) between 1 and 8 then 2 else 0 end)
+ (case when not regexp_matches(text, '[.,:;!?]$') then 2 else 0 end) + (case when regexp_matches(text, '^\\d+(\\.\\d+)*\\s+') then 2 else 0 end)
+ (case when {TITLE} or (upper(text) = text and lower(text) <> text) then 1 else 0 end) + (case when gap > 10 then 2 else 0 end) score from p""")
def heading_score(spark, sf_dir):
    from pyspark.sql import Window

    rows = _lines(spark, sf_dir).withColumn("gap", F.lag(F.length("text")).over(Window.partitionBy("doc_id").orderBy("line_no")) - F.length("text"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), layout.heading_score(F.col("text"), F.length("text") / 10.0, F.lit(10.0), F.col("gap")).cast("long").alias("score"))


GLYPHS_SQL = "g as (select l_returnflag page, l_quantity x0, l_quantity + l_discount * 100 x1, 60.0 width from lineitem)"


def _glyphs(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("x1"), F.lit(60.0).alias("width"))


@query("histogram_bins", f"""with {GLYPHS_SQL}, h as (select page, unnest(range(greatest(0, floor(x0)::bigint), least(60, floor(x1)::bigint) + 1)) bin from g),
b as (select page, unnest(range(0, 61)) bin from (select distinct page from g))
select b.page, b.bin, count(h.bin) cov from b left join h using (page, bin) group by 1, 2""")
def histogram_bins(spark, sf_dir):
    return layout.coverage(_glyphs(spark, sf_dir), "page", "width").select("page", F.col("bin").cast("long").alias("bin"), F.col("cov").cast("long").alias("cov"))


@query("range_join_lines", """select a.l_orderkey page, a.l_linenumber left_line, b.l_linenumber right_line from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
where a.l_linenumber <= 3 and b.l_linenumber > 3 and abs(a.l_quantity - b.l_quantity) <= 2 and b.l_discount * 100 - a.l_tax * 100 < 8""")
def range_join_lines(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem")
    left = rows.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("y"), (F.col("l_tax") * 100).alias("x1"), F.col("l_linenumber").alias("left_line"))
    right = rows.where("l_linenumber > 3").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("x0"), F.col("l_linenumber").alias("text"))
    return layout.pair_columns(left, right, page="page").select("page", "left_line", F.col("rtext").alias("right_line"))


@query("mode_first_seen", "select lang, source as mode from (select lang, source, row_number() over (partition by lang order by count(*) desc, min(doc_id)) k from documents group by 1, 2) where k = 1")
def mode_first_seen(spark, sf_dir):
    return layout.mode_first_seen(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang"], "source", "doc_id")


@query("collection_clean", "select page_id, lower(trim(regexp_replace(url, '[^\\p{L}\\p{N}-]', '-', 'g'), '-')) as name from pages")
def collection_clean(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", T.collection_name(F.col("url")).alias("name"))


@query("page_headings", "select page_id, len(regexp_extract_all(html, '<h[12][^>]*>')) n_headings, length(html) - length(replace(html, '<p', '<')) n_paragraphs from pages")
def page_headings(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<h[12][^>]*>"), F.lit(0))).cast("long").alias("n_headings"), (F.length("html") - F.length(F.replace("html", F.lit("<p"), F.lit("<")))).cast("long").alias("n_paragraphs"))


@query("md5_upsert", """with n as (select lang, md5(text) id, min(source) src from documents group by 1, 2)
select lang, count(*) n, count(distinct id) ids from n group by 1""")
def md5_upsert(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("lang").alias("paper_id"), "text")
    out = chunking.upsert(docs.where("paper_id = 'en'"), docs)
    return out.groupBy(F.col("paper_id").alias("lang")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("text_clips", """select doc_id, md5(case when length(text) > 600 then left(text, 600) || '…' else text end) clipped,
md5(case when length(o) > 240 then rtrim(left(o, 240)) || ' …' else o end) as one from (select doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) o from documents)""")
def text_clips(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clip(F.col("text"), 600)).alias("clipped"), F.md5(T.collapse(F.col("text"), 240)).alias("one"))


@query("title_dedup")
def title_dedup(spark, sf_dir):
    """Greedy folds have no SQL; a test holds this against a loop."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return discovery.dedup_titles(rows, by=["source"], title="title", pos="doc_id").select("doc_id", "source")


@query("search_ranking", """select p_brand, p_partkey, rank from (select *, row_number() over (partition by p_brand order by (p_size % 3 <> 0)::int desc, coalesce(case when p_size > 10 then p_size end, 0) desc, p_retailprice::int desc, p_partkey) rank from part) where rank <= 20""")
def search_ranking(spark, sf_dir):
    rows = read_table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 3 != 0, "x").alias("pdf_url"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("citations"), F.bround("p_retailprice").cast("int").alias("year"))
    return discovery.rank_results(rows, by="p_brand", limit=20, pos="p_partkey").select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("library_flag", "select d.doc_id, l.doc_id is not null as in_library from documents d left join (select distinct doc_id from labels) l using (doc_id)")
def library_flag(spark, sf_dir):
    known = read_table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_k", F.lit(True))
    return read_table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("_k", F.lit(False)).alias("in_library"))


@query("unlabelled_documents", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def unlabelled_documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id").join(read_table(spark, sf_dir, "labels"), "doc_id", "left_anti")
