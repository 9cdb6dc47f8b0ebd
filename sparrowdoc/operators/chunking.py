"""Sections to overlapping token chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, words

SIZE, OVERLAP = 512, 100


def windows(tokens: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Starts 0, step, 2*step, ... below the token count; the last chunk may hold nothing but overlap."""
    step = size - overlap

    def cut(held: Column) -> Column:
        starts = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.size(held) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(held, s + 1, F.lit(size)).alias("tokens")))

    return once(tokens, cut)  # within the lambda a text would be split again for each of its chunks


def chunk_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, start, tokens, token_count) of every text; no shuffle."""
    cut = docs.select(key, F.posexplode(windows(words(F.col(text)), size, overlap)).alias("chunk_index", "c"))
    return cut.select(key, "chunk_index", F.col("c.start").alias("start"), F.col("c.tokens").alias("tokens"), F.size("c.tokens").alias("token_count"))


def number_chunks(chunks: DataFrame, paper: str, section: str) -> DataFrame:
    """chunk_id within a paper (1-based), and each section's total."""
    return chunks.withColumns({
        "chunk_id": F.row_number().over(Window.partitionBy(paper).orderBy(section, "chunk_index")),
        "total_chunks_in_section": F.count("*").over(Window.partitionBy(paper, section)),
    })


def upsert(stored: DataFrame, incoming: DataFrame, *, paper: str = "paper_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """Chunks keyed by paper and MD5 of the text: incoming rows replace stored ones; of repeats the first by ``order``."""
    keyed = lambda df: df.withColumn("id", F.md5(F.col(text)))
    order = order or [c for c in incoming.columns if c not in (paper, text)]
    first = Window.partitionBy(paper, "id").orderBy(*(order or [text]))
    new = keyed(incoming).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return keyed(stored).join(new.select(paper, "id"), [paper, "id"], "left_anti").unionByName(new, allowMissingColumns=True)
