"""Search results: union of sources, fuzzy title dedup, ranking, membership in a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_key


def similar(a: Column, b: Column) -> Column:
    """Equal keys, or the shorter is over 12 long and its first 35 characters begin the longer."""
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | ((F.length(short) > 12) & F.startswith(long_, F.substring(short, 1, 35)))


def dedup_titles(rows: DataFrame, *, by: list[str], title: str, pos: str) -> DataFrame:
    """Greedy, in ``pos`` order: a title stays unless it is similar to one that stays. Titles similar to each other
    share their first 13 key characters or are equal, so each such block is folded alone, by its distinct beginnings of
    35 characters."""
    keyed = rows.withColumn("_key", title_key(F.col(title))).where("_key <> ''").withColumn("_block", F.substring("_key", 1, 13))
    # of titles with the same first 35 characters only the first can stay: what is similar to it is to all of them
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*by, F.left("_key", F.lit(35))).orderBy(pos))).where("_n = 1")
    seq = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_key").alias("k"))))
    fold = F.aggregate(seq, F.array().cast("array<struct<p:bigint,k:string>>"), lambda acc, s: F.when(F.exists(acc, lambda o: similar(o["k"], s["k"])), acc).otherwise(F.concat(acc, F.array(F.struct(s["p"].cast("bigint").alias("p"), s["k"].alias("k"))))))
    kept = first.groupBy(*by, "_block").agg(fold.alias("kept")).select(*by, F.explode("kept.p").alias(pos))
    return rows.join(kept, [*by, pos], "left_semi")


def rank_results(rows: DataFrame, *, by: str, limit: int, pos: str) -> DataFrame:
    """With a PDF first, then citations and year, nulls as 0; at most ``limit`` (40 at most) for each query."""
    order = [F.desc(F.col("pdf_url").isNotNull()), F.desc(F.coalesce("citations", F.lit(0))), F.desc(F.coalesce("year", F.lit(0))), F.col(pos)]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= min(limit, 40))


def per_source(rows: DataFrame, *, by: str, source: str = "source", pos: str = "pos", limit: int = 20) -> DataFrame:
    """The first ``limit`` (15 at most) results of each source for a query."""
    w = Window.partitionBy(by, source).orderBy(pos)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= min(limit, 15)).drop("_n")


def union_sources(parts: list[DataFrame], *, by: str, pos: str = "pos") -> DataFrame:
    """Results of several sources one after the other, numbered anew; a source that failed is left out of ``parts``."""
    every = None
    for i, part in enumerate(parts):
        part = part.withColumn("_source", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_source", pos)
    return every.withColumn(pos, F.row_number().over(w)).drop("_source")


def search(parts: list[DataFrame], *, by: str, limit: int = 20, title: str = "title", pos: str = "pos") -> DataFrame:
    """Sources merged, alike titles dropped, the rest ranked; queries without text have no results."""
    every = union_sources([per_source(p, by=by, pos=pos, limit=limit) for p in parts], by=by, pos=pos).where(F.trim(by) != "")
    return rank_results(dedup_titles(every, by=[by], title=title, pos=pos), by=by, limit=limit, pos=pos)


def recommendations(rows: DataFrame, *, by: str, query: str = "search_query", order: list[str], limit: int = 12) -> DataFrame:
    """Results of several queries for one paper: the first of each id (or title), ``limit`` in all, tagged with its query."""
    keyed = rows.withColumn("_id", F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("title")))
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_id").orderBy(*order))).where("_n = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= limit).drop("_n", "_id")


def recent(searches: DataFrame, *, by: str, query: str = "query", at: str = "at", limit: int = 5) -> DataFrame:
    """A user's last searches, each once, the latest first."""
    last = searches.groupBy(by, query).agg(F.max(at).alias(at))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), query))).where(F.col("rank") <= limit)


def matching(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which some column holds ``text``, whatever the case; an empty text matches all."""
    low = text.lower()
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
    return rows.where(test)
