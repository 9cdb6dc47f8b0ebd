"""Writers: paper tables by partition, registry events, logs and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, paper: str = "paper_id") -> None:
    """Replace the partitions of the papers at hand; other papers' stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(paper).parquet(path)


def without_paper(rows: DataFrame, gone: DataFrame, paper: str = "paper_id") -> DataFrame:
    return rows.join(gone.select(paper).distinct(), paper, "left_anti")


def registry_state(records: DataFrame, updates: DataFrame) -> DataFrame:
    """Records after an append-only table of updates (paper_id, at, status, error): the last one counts.

    completed_at is set by 'ready' alone, error only where one is given; updates of unknown papers change nothing.
    """
    w = Window.partitionBy("paper_id").orderBy(F.desc("at"))
    last = updates.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("paper_id", F.col("at").alias("_at"), F.col("status").alias("_status"), F.col("error").alias("_error"))
    out = records.join(last, "paper_id", "left")
    return out.withColumns({
        "completed_at": F.when(F.col("_status") == "ready", F.col("_at")).otherwise(F.col("completed_at")),
        "error": F.when(F.coalesce("_error", F.lit("")) != "", F.col("_error")).otherwise(F.col("error")),
        "status": F.coalesce("_status", "status"),
    }).drop("_at", "_status", "_error")


def log_rows(rows: DataFrame) -> DataFrame:
    """Log records with the question clipped to 200 characters and the confidence at two places."""
    return rows.withColumns({"question": F.substring("question", 1, 200), "confidence": F.round("confidence", 2), "req_id": F.left(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), F.lit(8)), "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")})


def append_log(rows: DataFrame, path: str) -> None:
    log_rows(rows).write.mode("append").json(path)


#: Rows that a summary may have.
SUMMARY_ROWS = 10_000


def write_summary(rows: DataFrame, path: str) -> None:
    """A summary as one JSON file; a table of more than SUMMARY_ROWS rows is none."""
    if rows.limit(SUMMARY_ROWS + 1).count() > SUMMARY_ROWS:
        raise ValueError(f"a summary has at most {SUMMARY_ROWS} rows")
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Scored rows as JSON lines, one file for each partition."""
    rows.write.mode("overwrite").json(path)


def write_flashcards(cards: DataFrame, path: str) -> None:
    cards.select("question", "answer").write.mode("overwrite").option("sep", "\t").csv(path)
