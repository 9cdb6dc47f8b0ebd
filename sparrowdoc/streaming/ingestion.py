"""Papers that land in a folder, ingested micro-batch by micro-batch, each exactly once.

A batch is applied in two commits to a collection (operators.papers): its papers become ``processing``, then, with their
chunks, ``ready`` or ``failed``. The second commit notes the stream and the batch's epoch, and that is the ledger: a batch
that Spark hands over again after a crash changes nothing if the ledger has it, and is done anew if a crash came before
the second commit, of which then nothing is seen. A batch opens only the commits that came since the one before it, so
it costs the same however many there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.papers import Collection


def _ledger(collection: Collection, generations: set[int] | None = None) -> DataFrame | None:
    """The manifest's rows of all commits, or of some generations."""
    store = collection.store
    folders = [f"{store.path}/manifest/generation={g}" for g in store._generations("manifest", store.generation()) if generations is None or g in generations]
    return store.spark.read.option("basePath", f"{store.path}/manifest").option("mergeSchema", True).parquet(*folders) if folders else None


def _note(stream: str, epoch: int) -> str:
    return f"{epoch} {stream}"


def applied(collection: Collection, stream: str, epoch: int) -> bool:
    """Whether a batch has been ingested to its end. Of commits without notes the manifests tell."""
    notes = collection.store.notes()
    if _note(stream, epoch) in notes.values():
        return True
    bare = {g for g, note in notes.items() if note is None}
    rows = _ledger(collection, bare) if bare else None
    if rows is None or "epoch" not in rows.columns:
        return False
    return not rows.where((F.col("stream") == stream) & (F.col("epoch") == epoch) & F.col("status").isin("ready", "failed")).isEmpty()


def apply_batch(collection: Collection, rows: DataFrame, epoch: int, ingest: Callable[[DataFrame], tuple[DataFrame, DataFrame]], *, stream: str = "landing") -> bool:
    """Ingest a batch's papers (paper_id, ...); false if that was done before.

    ``ingest(rows)`` gives stored chunks and (paper_id, error) of the papers that could not be read; a paper that has
    neither chunks nor an error holds no text and fails, too. Of a paper that lands twice in a batch all rows are its own.
    """
    if applied(collection, stream, epoch):
        return False
    paper = collection.paper
    facts = {"stream": F.lit(stream), "epoch": F.lit(epoch).cast("long"), "at": F.current_timestamp()}
    begun = rows.select(paper).distinct().withColumns(facts).withColumns({"status": F.lit("processing"), "error": F.lit(None).cast("string"), "n_chunks": F.lit(0).cast("long"), "alive": F.lit(True)})
    # the papers are read back: a batch is an RDD of whole rows, in which Spark prunes no column
    papers = collection.store.told(collection.store.change().commit(begun), begun.schema).select(paper)
    chunks, errors = ingest(rows)
    change = collection.store.change()
    written = change.write("chunks", chunks.withColumn("bucket", collection.bucket()), ["bucket", paper])
    counted = written.groupBy(paper).agg(F.count("*").alias("n_chunks"))
    ended = papers.withColumns(facts).join(counted, paper, "left").join(errors.groupBy(paper).agg(F.min("error").alias("error")), paper, "left")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("n_chunks").isNull(), "no text")
    ended = ended.withColumn("error", error).withColumns({"status": F.when(F.col("error").isNull(), "ready").otherwise("failed"), "n_chunks": F.coalesce("n_chunks", F.lit(0).cast("long")), "alive": F.lit(True)})
    change.commit(ended, _note(stream, epoch))
    return True


def run(landed: DataFrame, collection: Collection, ingest: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, *, stream: str = "landing", trigger: dict | None = None):
    """Start ingesting a stream of landed papers; by default what is there now, then stop."""

    def one(rows: DataFrame, epoch: int) -> None:
        apply_batch(collection, rows, epoch, ingest, stream=stream)

    return landed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def history(collection: Collection) -> DataFrame:
    """(paper_id, status, error, at, generation): every change of a paper's status, in the order of generations."""
    return _ledger(collection).select(collection.paper, "status", "error", "at", "generation")
