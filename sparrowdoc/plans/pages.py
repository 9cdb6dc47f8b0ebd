"""Page layout, headings, tables and ingestion over the driver's tables; order lines stand in for glyphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ingest, pages, papers, tables
from ..registry import query
from ..session import read_table, shared_folder
from .retrieval import WORDS

GLYPHS_SQL = """g as (select l_suppkey paper_id, l_linenumber page_num, 612.0::double page_width, left(l_returnflag, 1) as text, (l_partkey * 7919 % 560)::double + 20 x0, (l_partkey * 7919 % 560)::double + 25 x1,
l_quantity * 14 as top, l_discount * 100 + 8 size, l_linestatus = 'O' as upright from lineitem)"""


def glyphs(spark, sf_dir) -> DataFrame:
    """Order lines as glyphs: a page for each supplier and line number."""
    x0 = (F.col("l_partkey") * 7919 % 560).cast("double") + 20
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("paper_id"), F.col("l_linenumber").alias("page_num"), F.lit(612.0).alias("page_width"), F.left("l_returnflag", F.lit(1)).alias("text"), x0.alias("x0"), (x0 + 5).alias("x1"),
        (F.col("l_quantity") * 14).alias("top"), (F.col("l_discount") * 100 + 8).alias("size"), (F.col("l_linestatus") == "O").alias("upright"),
    )


BODY_SQL = f"""{GLYPHS_SQL}, e as (select paper_id, page_num, min(top) page_top, max(top) page_bottom from g where upright group by 1, 2),
b0 as (select g.* from g join e using (paper_id, page_num) where upright and page_bottom - page_top >= 50 and top >= page_top + (page_bottom - page_top) * 0.30::double),
b as (select * from (select *, count(*) over (partition by paper_id, page_num) n from b0) where n >= 20)"""


@query("page_extent", f"with {BODY_SQL} select paper_id, page_num, page_top, page_bottom from e")
def page_extent(spark, sf_dir):
    return pages.page_extent(pages.upright(glyphs(spark, sf_dir)))


@query("body_glyphs", f"with {BODY_SQL} select paper_id, page_num, count(*) n, round(sum(top), 4) tops from b group by 1, 2")
def body_glyphs(spark, sf_dir):
    body = pages.body_glyphs(pages.upright(glyphs(spark, sf_dir)))
    return body.groupBy("paper_id", "page_num").agg(F.count("*").alias("n"), F.round(F.sum("top"), 4).alias("tops"))


BOUNDARY_SQL = """h as (select paper_id, page_num, bin, count(*) cov from (select paper_id, page_num, unnest(range(greatest(0, trunc(x0)::int), least(612, trunc(x1)::int) + 1)) bin from b) group by all),
p as (select distinct paper_id, page_num from b), bins as (select p.paper_id, p.page_num, r.bin, coalesce(cov, 0) cov from p cross join (select unnest(range(0, 613)) bin) r left join h on h.paper_id = p.paper_id and h.page_num = p.page_num and h.bin = r.bin),
m as (select paper_id, page_num, median(cov) filter (where cov > 0) med from bins group by 1, 2),
mid as (select * from bins where bin between 214 and 397), seed as (select paper_id, page_num, arg_min(bin, cov * 1000 + bin) seed from mid group by 1, 2),
thin as (select paper_id, page_num, bin, seed, bin - row_number() over (partition by paper_id, page_num order by bin) run from mid join m using (paper_id, page_num) join seed using (paper_id, page_num) where cov <= med * 0.15::double or bin = seed),
r as (select paper_id, page_num, run, seed, min(bin) lo, max(bin) hi from thin group by all)"""
BOUNDARY = "select paper_id, page_num, ((lo + hi) / 2)::double boundary from r where seed between lo and hi and hi - lo >= 5"


@query("column_boundary", f"with {BODY_SQL}, {BOUNDARY_SQL} {BOUNDARY}")
def column_boundary(spark, sf_dir):
    return pages.column_boundary(pages.upright(glyphs(spark, sf_dir)))


LINES_SQL = """l as (select paper_id, page_num, i - 1 line_index, t as text, (8 + length(t) % 7)::double avg_size, (1000 - 14 * i - length(t) % 5)::double y0, (1000 - 14 * i + 9 - length(t) % 3)::double y1
from (select source paper_id, doc_id page_num, i, left(parts[i], 12 + i * 7 % 30) t from (select source, doc_id, string_split(text, chr(10)) parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from documents)))"""


def _lines(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("page_num"), F.posexplode(F.split("text", "\n")).alias("line_index", "text"))
    rows = rows.withColumn("text", F.left("text", (F.col("line_index") + 1) * 7 % 30 + 12))
    n, i = F.length("text"), F.col("line_index") + 1
    return rows.withColumns({"avg_size": (n % 7 + 8).cast("double"), "y0": (1000 - i * 14 - n % 5).cast("double"), "y1": (1000 - i * 14 + 9 - n % 3).cast("double")})


@query("heading_candidates", f"""with {LINES_SQL}, w as (select *, lag(y0) over p - y1 gap, trim(coalesce(lead(text, 1) over p, '') || coalesce(' ' || lead(text, 2) over p, '') || coalesce(' ' || lead(text, 3) over p, '')) as context, trim(text) t from l window p as (partition by paper_id, page_num order by line_index)),
s as (select *, len({WORDS.format('t')}) nw, case when avg_size > 11.5 then 3 else 0 end + case when len({WORDS.format('t')}) between 1 and 8 then 2 else 0 end + case when not regexp_matches(t, '[.,:;!?]$') then 2 else 0 end + case when regexp_matches(t, '^\\d+(\\.\\d+)*\\s+') then 2 else 0 end
+ case when (regexp_matches(t, '\\p{{Lu}}') and not regexp_matches(t, '\\p{{L}}\\p{{Lu}}') and not regexp_matches(t, '(^|[^\\p{{L}}])\\p{{Ll}}')) or (upper(t) = t and lower(t) <> t) then 1 else 0 end + case when coalesce(gap > 10, false) then 2 else 0 end score from w)
select paper_id, page_num, line_index, row_number() over (partition by paper_id order by page_num, line_index) id, md5(text) line, md5(context) context, score from s where score >= 8""")
def heading_candidates(spark, sf_dir):
    bodies = read_table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("page_num"), F.lit(10.0).alias("body"))
    found = pages.heading_candidates(_lines(spark, sf_dir), bodies)
    return found.select("paper_id", "page_num", F.col("line_index").cast("long").alias("line_index"), F.col("id").cast("long").alias("id"), F.md5("candidate_line").alias("line"), F.md5(F.trim("context")).alias("context"), F.col("score").cast("long").alias("score"))


@query("confirmed_headings", """with c as (select n_regionkey paper_id, row_number() over (partition by n_regionkey order by n_nationkey) id, n_name from nation),
v as (select *, case n_regionkey_ when 0 then 'SECTION' when 1 then 'SUBSECTION' else 'NONE' end verdict from (select *, id % 3 n_regionkey_ from c)) select paper_id, id, n_name candidate_line, verdict from v where verdict <> 'NONE'""")
def confirmed_headings(spark, sf_dir):
    """A model's reply of 'id | verdict' lines, with lines that aren't any between them, meets its candidates."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    c = read_table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("paper_id"), F.row_number().over(w).alias("id"), F.col("n_name").alias("candidate_line"))
    line = F.concat(F.col("id").cast("string"), F.lit(" | "), F.get(F.array(F.lit("section"), F.lit(" SUBSECTION | sure"), F.lit("none")), F.col("id") % 3))
    replies = c.groupBy("paper_id").agg(F.concat(F.lit("Here:\nx | SECTION\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n99 | MAYBE")).alias("reply"))
    return pages.confirmed(c, replies).select("paper_id", F.col("id").cast("long").alias("id"), "candidate_line", "verdict")


@query("headed_lines", f"with {LINES_SQL}, h as (select distinct paper_id, page_num, line_index from l where length(text) % 11 = 3) select paper_id, page_num, line_index, h.line_index is not null is_heading from l left join h using (paper_id, page_num, line_index)")
def headed_lines(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return pages.headed(lines, lines.where(F.length("text") % 11 == 3)).select("paper_id", "page_num", F.col("line_index").cast("long").alias("line_index"), "is_heading")


@query("table_chunks", """with t as (select n_regionkey paper_id, n_nationkey % 2 as pos, list(n_name order by n_nationkey) names, list(n_nationkey::varchar order by n_nationkey) keys from nation group by 1, 2),
k as (select *, row_number() over (partition by paper_id order by pos) n from t where len(names) >= 2)
select paper_id, 'Table ' || n || ' (page 1)' section, '| ' || names[1] || ' | ' || keys[1] || ' |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(range(2, len(names) + 1), lambda i: '| ' || names[i] || ' | ' || keys[i] || ' |'), chr(10)) as text from k""")
def table_chunks(spark, sf_dir):
    rows = read_table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("paper_id"), (F.col("n_nationkey") % 2).alias("pos"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.array(s["n_name"], F.concat(F.lit(" "), s["n_nationkey"].cast("string"))))
    found = rows.agg(cells.alias("cells")).withColumn("page_num", F.lit(1))
    noise = found.withColumns({"cells": F.slice("cells", 1, 1), "pos": F.col("pos") - 5})
    return pages.tables(found.unionByName(noise)).select("paper_id", "section", "text")


SECTIONS_SQL = f"""t as (select source paper_id, doc_id section_no, {WORDS.format('text')} w from documents where trim(text) <> ''),
c as (select paper_id, section_no, s // 412 chunk_index, list_slice(w, s + 1, s + 512) k, count(*) over (partition by section_no) total from (select paper_id, section_no, w, unnest(range(0, len(w), 412)) s from t))"""


def _sections(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("section_no"), F.col("lang").alias("heading"), F.lit("body").alias("type"), F.lit(1).alias("page_num"), F.col("text").alias("body"))


@query("section_chunks", f"with {SECTIONS_SQL} select paper_id, section_no, chunk_index, total total_chunks_in_section, len(k) token_count, md5(array_to_string(k, ' ')) id, row_number() over (partition by paper_id order by section_no, chunk_index) chunk_id from c")
def section_chunks(spark, sf_dir):
    cut = ingest.chunk_sections(_sections(spark, sf_dir)).withColumn("number", F.col("section_no"))
    numbered = ingest.paper_chunks(cut)
    return numbered.select("paper_id", F.col("number").alias("section_no"), F.col("chunk_index").cast("long").alias("chunk_index"), "total_chunks_in_section", F.col("token_count").cast("long").alias("token_count"), F.md5("text").alias("id"), F.col("chunk_id").cast("long").alias("chunk_id"))


@query("ingested_chunks", f"""with {SECTIONS_SQL}, d as (select paper_id, md5(array_to_string(k, ' ')) id, section_no, chunk_index, len(k) n from c)
select paper_id, id, chunk_index, n token_count from (select *, row_number() over (partition by paper_id, id order by section_no, chunk_index) r from d) where r = 1""")
def ingested_chunks(spark, sf_dir):
    rows = ingest.ingest(_sections(spark, sf_dir), None, embed=lambda t: F.array(F.length(t).cast("float")))
    return rows.select("paper_id", "id", F.col("metadata.chunk_index").cast("long").alias("chunk_index"), F.col("metadata.token_count").cast("long").alias("token_count"))


@query("ingest_summary", f"""with {SECTIONS_SQL}, n as (select paper_id, count(*) n_chunks, sum(len(k)) n_tokens from c group by 1), s as (select source paper_id, count(*) n_sections from documents group by 1)
select paper_id, n_sections, coalesce(n_chunks, 0) n_chunks, 0::bigint n_tables, coalesce(n_tokens, 0)::bigint n_tokens from s left join n using (paper_id)""")
def ingest_summary(spark, sf_dir):
    sections = _sections(spark, sf_dir)
    return ingest.summary(sections, ingest.paper_chunks(ingest.chunk_sections(sections)))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ."
TYPED_SQL = BODY_SQL.replace(GLYPHS_SQL, f"""g as (select l_suppkey paper_id, l_linenumber page_num, 612.0::double page_width, substr('{LETTERS}', (l_orderkey % 27 + 1)::int, 1) as text, (l_partkey * 7919 % 560)::double + 20 x0, (l_partkey * 7919 % 560)::double + 25 x1,
l_quantity * 14 as top, round(l_discount * 100) + 8 size, l_linestatus = 'O' as upright, 800 - l_quantity * 14 - round(l_discount * 100) - 8 y0, 800 - l_quantity * 14 y1, l_orderkey * 8 + l_linenumber pos from lineitem)""")
READ_SQL = f"""{TYPED_SQL}, {BOUNDARY_SQL}, bd as ({BOUNDARY}),
sided as (select g.*, case when boundary is null then 'S' when (x0 + x1) / 2 < boundary then 'L' else 'R' end side from g left join bd using (paper_id, page_num) where upright),
ends as (select paper_id, page_num, side, top, min(x0) x0, max(x1) x1 from sided group by all),
whole as (select l.paper_id, l.page_num, l.top from ends l join ends r on l.paper_id = r.paper_id and l.page_num = r.page_num and l.top = r.top and l.side = 'L' and r.side = 'R' and r.x0 - l.x1 < 8),
put as (select s.* exclude (side), case when w.top is not null and side <> 'S' then 'W' else side end side from sided s left join whole w using (paper_id, page_num, top)),
pieces as (select *, case when x0 - lag(x1) over (partition by paper_id, page_num, side, top order by x0, text) > 2 then ' ' || text else text end piece from put),
said as (select paper_id, page_num, side, top, trim(string_agg(piece, '' order by x0, piece)) as text, avg(size) avg_size, min(y0) y0, max(y1) y1 from pieces group by all),
zones as (select *, case when side = 'R' then 2 when side = 'W' and top < min(case when side in ('L', 'R') then top end) over pg then 0 when side = 'W' and top > max(case when side in ('L', 'R') then top end) over pg then 3 else 1 end as zone from said window pg as (partition by paper_id, page_num)),
l as (select paper_id, page_num, row_number() over (partition by paper_id, page_num order by zone, top, side) - 1 line_index, text, avg_size, y0, y1 from zones where text <> '')"""


def typed(spark, sf_dir) -> DataFrame:
    """Order lines as glyphs of letters, with sizes and heights."""
    size = F.round(F.col("l_discount") * 100) + 8
    x0 = (F.col("l_partkey") * 7919 % 560).cast("double") + 20
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("paper_id"), F.col("l_linenumber").alias("page_num"), F.lit(612.0).alias("page_width"), F.substring(F.lit(LETTERS), F.col("l_orderkey") % 27 + 1, F.lit(1)).alias("text"), x0.alias("x0"), (x0 + 5).alias("x1"),
        (F.col("l_quantity") * 14).alias("top"), size.alias("size"), (F.col("l_linestatus") == "O").alias("upright"), (800 - F.col("l_quantity") * 14 - size).alias("y0"), (800 - F.col("l_quantity") * 14).alias("y1"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
    )


@query("page_lines", f"with {READ_SQL} select paper_id, page_num, line_index, text, round(avg_size, 6) avg_size, y0, y1 from l")
def page_lines(spark, sf_dir):
    return pages.page_lines(typed(spark, sf_dir)).withColumns({"line_index": F.col("line_index").cast("long"), "avg_size": F.round("avg_size", 6)})


@query("page_text", f"with {READ_SQL} select paper_id, page_num, string_agg(text, chr(10) order by line_index) as text from l group by 1, 2")
def page_text(spark, sf_dir):
    return pages.page_text(pages.page_lines(typed(spark, sf_dir)))


class Marks:
    """A chat model that confirms heading candidates by their numbers."""

    name = "marks"

    def complete(self, messages, max_tokens, temperature):
        ids = [int(line.split("|")[0]) for line in messages[0]["content"].split("\n")[1:] if "|" in line]
        return "\n".join(f"{i} | {('SECTION', 'SUBSECTION', 'NONE')[i % 3]}" for i in ids)


HEADED_SQL = f"""{READ_SQL}, sizes as (select paper_id, page_num, size, count(*) n, min(pos) f from g group by 1, 2, 3),
body as (select paper_id, page_num, size body from sizes qualify row_number() over (partition by paper_id, page_num order by n desc, f) = 1),
near as (select *, lag(y0) over p - y1 gap, trim(text) t from l join body using (paper_id, page_num) window p as (partition by paper_id, page_num order by line_index)),
points as (select *, case when avg_size > body + 1.5 then 3 else 0 end + case when len({WORDS.format('t')}) between 1 and 8 then 2 else 0 end + case when not regexp_matches(t, '[.,:;!?]$') then 2 else 0 end + case when regexp_matches(t, '^\\d+(\\.\\d+)*\\s+') then 2 else 0 end
+ case when upper(t) = t and lower(t) <> t then 1 else 0 end + case when coalesce(gap > 10, false) then 2 else 0 end score from near),
asked as (select *, row_number() over (partition by paper_id order by page_num, line_index) id from points where score >= 8),
heads as (select paper_id, page_num, line_index, case id % 3 when 0 then 'SECTION' when 1 then 'SUBSECTION' end as type from asked where id % 3 <> 2),
running as (select l.*, h.type, count(h.type) over (partition by paper_id order by page_num, line_index) section_no from l left join heads h using (paper_id, page_num, line_index)),
sections as (select paper_id, section_no, max(case when type is not null then trim(text) end) heading, max(type) as type, max(case when type is not null then page_num end) page_num, trim(coalesce(string_agg(trim(text), chr(10) order by page_num, line_index) filter (where type is null), '')) body from running where section_no > 0 group by 1, 2)"""
STORED_SQL = f"""words as (select *, {WORDS.format('body')} w from sections where body <> ''),
cut as (select paper_id, section_no, heading, type, page_num, s // 412 chunk_index, list_slice(w, s + 1, s + 512) k from (select *, unnest(range(0, len(w), 412)) s from words)),
stored as (select paper_id, md5(array_to_string(k, ' ')) id, heading section, type section_type, page_num, chunk_index, len(k) token_count from cut qualify row_number() over (partition by paper_id, md5(array_to_string(k, ' ')) order by section_no, chunk_index) = 1)"""


@query("ingest_glyphs", f"with {HEADED_SQL}, {STORED_SQL} select * from stored")
def ingest_glyphs(spark, sf_dir):
    """Glyphs to the chunks that a collection holds, through headings that a model confirms."""
    collection = papers.Collection(spark, f"{shared_folder(spark)}/papers-{uuid.uuid4().hex}")
    cut = lambda df: df.checkpoint()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")
    collection.put(papers.ingest_glyphs(typed(spark, sf_dir), Marks, embed=lambda t: F.array(F.length(t).cast("float")), cut=cut))
    rows = collection.scan()
    return rows.select("paper_id", "id", "section", "section_type", "page_num", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("token_count").cast("long").alias("token_count"))


@query("scanned_chunks", f"""with {SECTIONS_SQL}, d as (select paper_id, md5(array_to_string(k, ' ')) id, section_no, chunk_index, len(k) n from c where paper_id in ('src1', 'src2', 'src3', 'src4'))
select paper_id, id, chunk_index, n token_count from d where paper_id <> 'src2' qualify row_number() over (partition by paper_id, id order by section_no, chunk_index) = 1""")
def scanned_chunks(spark, sf_dir):
    """Chunks of four papers from a collection of all, one of them deleted; only their folders are read."""
    collection = papers.Collection(spark, f"{shared_folder(spark)}/papers-{uuid.uuid4().hex}")
    collection.put(ingest.ingest(_sections(spark, sf_dir), None, embed=lambda t: F.array(F.length(t).cast("float"))))
    names = read_table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id")).distinct()
    collection.drop(names.where("paper_id = 'src2'"))
    rows = collection.scan(names.where("paper_id in ('src1', 'src2', 'src3', 'src4')"))
    return rows.select("paper_id", "id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("token_count").cast("long").alias("token_count"))


FOUND_SQL = """with s as (select s_nationkey paper_id, s_name, s_suppkey, floor(s_acctbal)::bigint bal, row_number() over (partition by s_nationkey order by s_suppkey) n from supplier)
select paper_id, 0::bigint as pos, max(n_name) || '|-|-/' || string_agg(s_name || '|' || s_suppkey || '|' || bal, '/' order by n) as cells from s join nation on n_nationkey = paper_id group by 1
union all select paper_id, 1::bigint, string_agg(s_suppkey || '|row ' || n, '/' order by n) from s group by 1"""


@query("found_tables", FOUND_SQL)
def found_tables(spark, sf_dir):
    """A page for each nation: a ruled table of its suppliers under a cell that spans the columns, a second one beside it."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    suppliers = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("paper_id"), F.lit(1).alias("page_num"), "s_suppkey", "s_name", F.floor("s_acctbal").cast("long").alias("bal"), F.row_number().over(w).alias("n"))
    nations = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("paper_id"), F.lit(1).alias("page_num"), "n_name")
    shake = (F.col("s_suppkey") % 3) * 0.4  # rulings of one line are never quite at one place
    box = lambda x0, x1, top, text, off=F.lit(0.0): F.struct((F.lit(float(x0)) + off).alias("x0"), (F.lit(float(x1)) + off).alias("x1"), (top + off).cast("double").alias("top"), (top + 20 + off).cast("double").alias("bottom"), text.cast("string").alias("text"))
    top, side = F.lit(100) + F.col("n") * 20, F.lit(90) + F.col("n") * 20
    mine = F.array(box(50, 150, top, F.col("s_name"), shake), box(150, 250, top, F.col("s_suppkey"), shake), box(250, 350, top, F.col("bal"), shake), box(400, 500, side + 25, F.col("s_suppkey"), shake), box(500, 600, side + 25, F.concat(F.lit("row "), F.col("n")), shake))
    head = suppliers.select("paper_id", "page_num").distinct().join(nations, ["paper_id", "page_num"]).select("paper_id", "page_num", box(50, 350, F.lit(100), F.col("n_name")).alias("b"))
    boxes = suppliers.select("paper_id", "page_num", F.explode(mine).alias("b")).unionByName(head).select("paper_id", "page_num", "b.*")
    said = boxes.select("paper_id", "page_num", "text", (F.col("x0") + 8).alias("x0"), (F.col("x0") + 70).alias("x1"), (F.col("top") + 5).alias("top"), F.lit(9.0).alias("size"))
    loose = nations.select("paper_id", "page_num", F.lit("loose").alias("text"), F.lit(50.0).alias("x0"), F.lit(80.0).alias("x1"), F.lit(20.0).alias("top"), F.lit(9.0).alias("size"))
    out = tables.found(tables.edges(boxes), said.unionByName(loose))
    return out.select("paper_id", "pos", F.array_join(F.transform("cells", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit("-"))), "|")), "/").alias("cells"))
