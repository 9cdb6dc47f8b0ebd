"""The registry of papers as tables: inserts, listings, gates and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def register(uploads: DataFrame) -> DataFrame:
    """Registry rows of new uploads (filename, source_id): a new id, status processing, uploaded now (UTC)."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return uploads.select(F.uuid().alias("paper_id"), "filename", F.lit("processing").alias("status"), now.alias("uploaded_at"), F.lit(None).cast("string").alias("completed_at"), F.lit(None).cast("string").alias("error"), "source_id")


def insert(registry_path: str, rows: DataFrame) -> None:
    """Append new records; readers see the files of whole commits only."""
    rows.write.mode("append").json(registry_path)


def newest_first(records: DataFrame) -> DataFrame:
    """Papers by their upload stamp as text, the latest first."""
    return records.orderBy(F.desc("uploaded_at"))


def ready(records: DataFrame) -> DataFrame:
    return records.where("status = 'ready'")


def status_counts(records: DataFrame) -> DataFrame:
    return records.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ready", "processing", "failed")])


def checked(asked: DataFrame, records: DataFrame, *, key: str = "paper_id") -> DataFrame:
    """``asked`` with ``problem``: 'not found', 'not ready' or null."""
    known = records.select(key, F.col("status").alias("_status"))
    problem = F.when(F.col("_status").isNull(), "not found").when(F.col("_status") != "ready", "not ready")
    return asked.join(known, key, "left").withColumn("problem", problem).drop("_status")


def without(records: DataFrame, chunks: DataFrame, gone: DataFrame, *, key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """Registry and chunks without the papers of ``gone``; unknown ids do no harm."""
    keys = gone.select(key).distinct()
    return records.join(keys, key, "left_anti"), chunks.join(keys, key, "left_anti")


def in_library(found: DataFrame, records: DataFrame, *, key: str = "id") -> DataFrame:
    """Search results with ``in_library``: their id is the source of a registered paper."""
    own = records.where("source_id is not null").select(F.col("source_id").alias(key), F.lit(True).alias("in_library")).distinct()
    return found.join(own, key, "left").withColumn("in_library", F.coalesce("in_library", F.lit(False)))


def file_name(title: str = "title", length: int = 80):
    """What an imported paper's file is called."""
    return F.coalesce(F.nullif(F.substring(F.col(title), 1, length), F.lit("")), F.lit("paper"))


def uploads(paths: DataFrame, *, path: str = "path") -> DataFrame:
    """Rows of a landing folder that are PDF files (the suffix counts in lower case only)."""
    return paths.where(F.endswith(F.col(path), F.lit(".pdf")))


def imports(found: DataFrame, records: DataFrame) -> DataFrame:
    """New registry rows for search results with a PDF that the library does not hold; repeats count once."""
    fresh = in_library(found, records).where("pdf_url is not null and not in_library")
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("title"))).where("_n = 1")
    return register(first.select(F.concat(file_name(), F.lit(".pdf")).alias("filename"), F.col("id").alias("source_id")))
