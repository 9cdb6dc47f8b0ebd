"""Readers of registries, logs, feeds and question sets; every path is opened by Spark."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import arxiv_id, clip

PAPER = "struct<paper_id:string,filename:string,status:string,uploaded_at:string,completed_at:string,error:string,source_id:string>"
LOG = "timestamp string, req_id string, paper_id string, question string, duration_ms bigint, confidence double, attempts int, passed boolean, llm_calls int, providers array<string>"
ANSWER = "struct<unanswerable:boolean,yes_no:boolean,extractive_spans:array<string>,free_form_answer:string,evidence:array<string>>"
QASPER = f"struct<title:string,abstract:string,full_text:array<struct<section_name:string,paragraphs:array<string>>>,qas:array<struct<question:string,question_id:string,answers:array<struct<answer:{ANSWER}>>>>>"
PLAN = "struct<answer_type:string,key_concepts:array<string>,sub_questions:array<string>,answer_structure:array<string>,complexity:string>"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of papers, one row each; an empty file has none. Times are parsed, whatever their zone."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{PAPER}>").alias("m"))
    rows = raw.select(F.explode("m").alias("key", "p")).select("p.*")
    return rows.withColumn("uploaded", F.try_to_timestamp("uploaded_at"))


def query_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def pdf_landing(spark: SparkSession, path: str) -> DataFrame:
    """PDF files (suffix in lower case) as they land in a folder, as a stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(path)


CALIBRATION = "id int, query string, answer string, faithfulness double, answer_relevancy double, confidence double, method string, label string"


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of answered and perhaps labelled questions."""
    return spark.read.schema(CALIBRATION).option("multiLine", True).json(path)


def qasper_archive(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(json) of one member of tar archives: the one of that name, else the first that ends with it."""

    def run(batches):
        import io
        import tarfile

        for b in batches:
            found = []
            for content in b.column("content").to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    names = [m.name for m in tar.getmembers() if m.isfile()]
                    pick = next((n for n in names if n == member), None) or next((n for n in names if n.endswith(member)), None)
                    if pick is None:
                        raise FileNotFoundError(f"{member} is not in the archive")
                    found.append(tar.extractfile(pick).read().decode())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["json"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "json string")


def arxiv_feed(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Entries of Atom feeds, with or without a default namespace."""
    schema = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,link:array<struct<_title:string,_href:string>>>>"
    feeds = feeds.withColumn(xml, F.regexp_replace(xml, r"(?s)(<feed\b[^>]*?)\sxmlns=[\"'][^\"']*[\"']", "$1"))
    e = feeds.select(F.explode(F.from_xml(xml, schema)["entry"]).alias("e")).select("e.*")
    line = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s*\n\s*", " "))
    href = F.replace(F.get(F.filter("link", lambda x: x["_title"] == "pdf"), 0)["_href"], F.lit("http://"), F.lit("https://"))
    pdf = F.when(F.endswith(href, F.lit(".pdf")), href).otherwise(F.concat(href, F.lit(".pdf")))
    own = F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id(F.col("id")), F.lit(".pdf"))
    return e.select(
        arxiv_id(F.col("id")).alias("id"), line("title").alias("title"), F.slice(F.col("author.name"), 1, 5).alias("authors"), F.expr("try_cast(left(published, 4) as int)").alias("year"),
        clip(line("summary"), 600).alias("abstract"), F.lit("arxiv").alias("source"), F.col("id").alias("source_url"), F.coalesce(pdf, own).alias("pdf_url"), F.lit(None).cast("int").alias("citations"), F.lit(None).cast("string").alias("venue"),
    )


def scholar_results(pages: DataFrame, body: str = "json") -> DataFrame:
    schema = "data array<struct<paperId:string,title:string,abstract:string,year:int,venue:string,citationCount:int,url:string,openAccessPdf:struct<url:string>,authors:array<struct<name:string>>>>"
    e = pages.select(F.explode(F.from_json(body, schema)["data"]).alias("e")).select("e.*")
    return e.select(
        F.col("paperId").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.slice(F.col("authors.name"), 1, 5), F.array().cast("array<string>")).alias("authors"), "year",
        clip(F.coalesce("abstract", F.lit("")), 600).alias("abstract"), F.lit("semantic_scholar").alias("source"), F.col("url").alias("source_url"), F.col("openAccessPdf.url").alias("pdf_url"), F.col("citationCount").alias("citations"), "venue",
    )


def sse_frames(body: Column) -> Column:
    """Array of (event, data) of a stream's text; a frame that isn't complete or holds no JSON is left out."""
    frames = F.slice(F.split(body, "\n\n"), F.lit(1), F.greatest(F.size(F.split(body, "\n\n")) - 1, F.lit(0)))
    parsed = F.transform(frames, lambda f: F.struct(F.regexp_extract(f, r"(?m)^event:\s*(.*)$", 1).alias("event"), F.regexp_extract(f, r"(?m)^data:\s*(.*)$", 1).alias("data")))
    return F.filter(parsed, lambda p: F.try_parse_json(p["data"]).isNotNull() & (p["data"] != ""))


def sse_encode(event: Column, payload: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def parse_plan(raw: Column, query: Column) -> Column:
    """A plan with a default for each missing field; what is no JSON object is a simple plan for the query."""
    p = F.from_json(raw, PLAN)
    usable = F.try_parse_json(raw).isNotNull() & F.startswith(F.ltrim(raw), F.lit("{"))
    none = F.array().cast("array<string>")
    field = lambda c, d: F.when(usable, F.coalesce(p[c], d)).otherwise(d)
    return F.struct(field("answer_type", F.lit("factual")).alias("answer_type"), field("key_concepts", none).alias("key_concepts"), field("sub_questions", F.array(query)).alias("sub_questions"), field("answer_structure", none).alias("answer_structure"), field("complexity", F.lit("simple")).alias("complexity"))


def papers(raw: DataFrame, body: str = "json") -> DataFrame:
    """Question-answering papers from a JSON map: (paper_id, title, abstract, full_text, qas)."""
    return raw.select(F.posexplode(F.map_entries(F.from_json(body, f"map<string,{QASPER}>"))).alias("pos", "e")).select("pos", F.col("e.key").alias("paper_id"), "e.value.*")


def paper_sections(papers: DataFrame) -> DataFrame:
    """The abstract as page 0, then sections numbered by place; blank paragraphs and empty sections go."""
    abstract = papers.where("trim(coalesce(abstract, '')) <> ''").select("paper_id", F.lit("Abstract").alias("heading"), F.lit("abstract").alias("type"), F.lit(0).alias("page_num"), F.trim("abstract").alias("body"))
    each = papers.select("paper_id", F.posexplode("full_text").alias("i", "s"))
    body = F.array_join(F.filter(F.coalesce(F.col("s.paragraphs"), F.array().cast("array<string>")), lambda p: F.trim(p) != ""), "\n\n")
    name = F.coalesce(F.nullif(F.trim(F.col("s.section_name")), F.lit("")), F.concat(F.lit("Section "), (F.col("i") + 1).cast("string")))
    return abstract.unionByName(each.select("paper_id", name.alias("heading"), F.lit("body").alias("type"), (F.col("i") + 1).alias("page_num"), body.alias("body")).where("body <> ''"))


def normal_answer(a: Column) -> Column:
    """Gold answers by priority: unanswerable, yes or no, spans, free text, none."""
    spans = F.filter(F.coalesce(a["extractive_spans"], F.array().cast("array<string>")), lambda s: F.trim(s) != "")
    free = F.trim(F.coalesce(a["free_form_answer"], F.lit("")))
    row = lambda ok, kind, text: F.struct(F.lit(ok).alias("answerable"), F.lit(kind).alias("type"), text.alias("text"))
    none = F.lit("")
    return F.when(F.coalesce(a["unanswerable"], F.lit(False)), row(False, "none", none)).when(a["yes_no"].isNotNull(), row(True, "boolean", F.when(a["yes_no"], "yes").otherwise("no"))).when(F.size(spans) > 0, row(True, "extractive", F.array_join(spans, " ; "))).when(free != "", row(True, "abstractive", free)).otherwise(row(False, "none", none))
