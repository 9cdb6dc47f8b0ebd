"""From glyphs to stored chunks, and the collection that holds them.

``ingest_glyphs`` is one plan of two phases: lines in reading order and their heading candidates, one prompt for each
paper; then its verdicts, sections, tables and numbered chunks. ``Collection`` keeps the chunks of papers as generations of
a versioned table, so that a paper is replaced or deleted whole while readers go on with what they began with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import prompts
from ..sources.versions import Versioned
from . import ingest, pages


def assemble(lines: DataFrame, headings: DataFrame, *, paper: str = "paper_id", page: str = "page_num") -> DataFrame:
    """(paper, section_no, heading, type, page_num, body) of lines and confirmed headings (paper, page, line_index, verdict).

    A section's lines are those up to the next heading; what stands before the first heading belongs to none, and a line
    that begins with 'references' ends the paper. The page is the heading's.
    """
    by = [paper, page, "line_index"]
    marked = lines.join(headings.select(*by, F.col("verdict").alias("_type")).dropDuplicates(by), by, "left")
    so_far = Window.partitionBy(paper).orderBy(page, "line_index").rowsBetween(Window.unboundedPreceding, 0)
    line = F.trim("text")
    opened = F.when(F.col("_type").isNotNull(), F.struct(line.alias("heading"), F.col("_type").alias("type"), F.col(page).alias("page_num")))
    placed = marked.withColumns({"_ended": F.max(F.startswith(F.lower(line), F.lit("references")).cast("int")).over(so_far), "_open": F.last(opened, True).over(so_far), "section_no": F.count("_type").over(so_far)})
    kept = placed.where("section_no > 0 and _ended = 0")
    said = F.array_sort(F.collect_list(F.when(F.col("_type").isNull(), F.struct(page, "line_index", line.alias("t")))))
    body = F.trim(F.array_join(F.transform(said, lambda s: s["t"]), "\n"))
    return kept.groupBy(paper, "section_no").agg(F.first("_open").alias("_h"), body.alias("body")).select(paper, "section_no", "_h.heading", "_h.type", "_h.page_num", "body")


def sections_of(glyphs: DataFrame, client: prompts.Client, *, cut: Callable[[DataFrame], DataFrame], bodies: DataFrame | None = None) -> DataFrame:
    """Sections of papers' glyphs. ``cut`` ends lineage (a checkpoint, a written table) where the plan would run twice."""
    lines = cut(pages.page_lines(glyphs))
    candidates = cut(pages.heading_candidates(lines, bodies if bodies is not None else pages.body_size(glyphs)))
    replies = cut(prompts.confirm_headings(candidates, client))
    return assemble(lines, pages.confirmed(candidates, replies))


def ingest_glyphs(glyphs: DataFrame, client: prompts.Client, *, embed, tables: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """Stored chunks of papers from their glyphs; ``tables`` are found tables (tables.found), whose chunks follow the text's."""
    cut = cut or (lambda df: df.checkpoint())
    sections = sections_of(glyphs, client, cut=cut)
    return ingest.ingest(sections, pages.tables(tables) if tables is not None else None, embed=embed, **options)


BUCKETS = 256


class Collection:
    """Stored chunks (paper_id, id, embedding, document, metadata) under ``path``."""

    def __init__(self, spark: SparkSession, path: str, paper: str = "paper_id"):
        self.paper, self.store = paper, Versioned(spark, path, [paper])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.paper), F.lit(BUCKETS)).cast("int")

    def put(self, chunks: DataFrame, facts: DataFrame | None = None) -> int:
        """Store the chunks of papers in place of those they had.

        ``facts``: a row for each paper with more columns for the manifest; papers without chunks may be among them.
        """
        change = self.store.change()
        written = change.write("chunks", chunks.withColumn("bucket", self.bucket()), ["bucket", self.paper])
        counted = written.groupBy(self.paper).agg(F.count("*").alias("n_chunks"))
        rows = counted if facts is None else facts.join(counted, self.paper, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long")))
        return change.commit(rows.withColumn("alive", F.lit(True)))

    def drop(self, papers: DataFrame) -> int:
        """Delete papers; unknown ones do no harm."""
        gone = papers.select(self.paper).distinct()
        return self.store.change().commit(gone.withColumns({"n_chunks": F.lit(0).cast("long"), "alive": F.lit(False)}))

    def scan(self, papers: DataFrame | None = None, *, at: int | None = None) -> DataFrame:
        """(paper_id, id, embedding, document, and each field of metadata) of all papers, or of those asked for.

        Only the folders of the asked papers' buckets are read.
        """
        where = None
        if papers is not None:
            wanted = [r["b"] for r in papers.select(self.bucket().alias("b")).distinct().collect()]  # at most BUCKETS numbers
            where = F.col("bucket").isin(wanted)
        return self.store.read("chunks", at=at, keys=papers, where=where).select(self.paper, "id", "embedding", "document", "metadata.*")

    def papers(self, at: int | None = None) -> DataFrame:
        """(paper_id, n_chunks, ...) of what the collection holds."""
        return self.store.alive(at).drop("alive", "generation")
