"""Ingestion: sections and tables to numbered, stored chunks of a paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from . import chunking

SECTION = ["paper_id", "section_no"]


def blank_tokens(text: Column) -> Column:
    """The offline tokenizer: blank-separated words, joined again by blanks."""
    return words(text)


def chunk_sections(sections: DataFrame, *, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, encode=blank_tokens, decode=lambda tokens: F.array_join(tokens, " ")) -> DataFrame:
    """(paper_id, section_no, section, section_type, page_num, chunk_index, total_chunks_in_section, text, token_count).

    ``encode`` and ``decode`` are the tokenizer's slot: Column functions between a text and its tokens. Sections with
    blank bodies give no chunks.
    """
    cut = sections.where(F.trim("body") != "").select(*SECTION, F.col("heading").alias("section"), F.col("type").alias("section_type"), "page_num", chunking.windows(encode(F.col("body")), size, overlap).alias("_w"))
    each = cut.select("*", F.size("_w").cast("long").alias("total_chunks_in_section"), F.posexplode("_w").alias("chunk_index", "_c"))
    return each.select(*SECTION, "section", "section_type", "page_num", "chunk_index", "total_chunks_in_section", decode(F.col("_c.tokens")).alias("text"), F.size("_c.tokens").alias("token_count"))


def paper_chunks(text_chunks: DataFrame, table_chunks: DataFrame | None = None) -> DataFrame:
    """Text chunks, then table chunks, with chunk_id counting from 1 over the paper."""
    text = text_chunks.withColumns({"_part": F.lit(0), "_at": F.col("section_no").cast("long")})
    every = text.drop("section_no")
    if table_chunks is not None:
        numbers = F.regexp_extract("section", r"^Table (\d+)", 1).cast("long")
        every = every.unionByName(table_chunks.withColumns({"_part": F.lit(1), "_at": numbers}))
    order = Window.partitionBy("paper_id").orderBy("_part", "_at", "chunk_index")
    return every.withColumn("chunk_id", F.row_number().over(order)).drop("_part", "_at")


METADATA = ("section", "section_type", "page_num", "chunk_index", "total_chunks_in_section", "token_count")


def stored(chunks: DataFrame, embed) -> DataFrame:
    """(paper_id, id, embedding, document, metadata): the id is the text's MD5; chunk_id is not kept."""
    return chunks.select("paper_id", F.md5("text").alias("id"), embed(F.col("text")).alias("embedding"), F.col("text").alias("document"), F.struct(*METADATA).alias("metadata"))


def ingest(sections: DataFrame, table_chunks: DataFrame | None, *, embed, **options) -> DataFrame:
    """Stored chunks of papers, one row for each paper and text: of repeats the first by chunk_id."""
    chunks = paper_chunks(chunk_sections(sections, **options), table_chunks)
    first = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("paper_id", F.md5("text")).orderBy("chunk_id"))).where("_n = 1")
    return stored(first.drop("_n"), embed)


def summary(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, n_sections, n_chunks, n_tables, n_tokens) of an ingestion."""
    counted = chunks.groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("section_type") == "table").alias("n_tables"), F.sum("token_count").alias("n_tokens"))
    return sections.groupBy("paper_id").agg(F.count("*").alias("n_sections")).join(counted, "paper_id", "full").na.fill(0, ["n_sections", "n_chunks", "n_tables", "n_tokens"])


def nonblank(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.where(F.trim(text) != "")


def sources(retrieved: DataFrame, *, clip: int = 600, label: str | None = None) -> DataFrame:
    """What an answer shows of its chunks: section, type (text by default), page, index and the first characters.

    ``label``: a column that tells two papers of a comparison apart, kept with its paper.
    """
    own = ["paper_id", label] if label else []
    return retrieved.select("query_id", "rank", *own, "section", F.coalesce("section_type", F.lit("text")).alias("section_type"), F.col("page_num").alias("page"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.substring("text", 1, clip).alias("text"))


def distinct_sources(shown: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The first source by rank of each section and page (and paper, in a comparison)."""
    by = by or ["query_id", "section", "page"]
    return shown.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).where("_n = 1").drop("_n")
