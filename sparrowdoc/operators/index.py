"""A stored BM25 index: postings by bucket of their term, replaced paper by paper.

``Index.put`` stores the postings of new or changed papers as a generation of ``Versioned`` tables, ``Index.drop`` leaves
papers out; both write what they touch and nothing else. What BM25 needs of the whole collection is kept so that a change
of some papers is a sum: the manifest has each paper's number of chunks and of tokens; ``terms`` holds changes of a term's
document frequency, and ``degrees`` how many terms came to have a frequency or ceased to, from which the mean idf of the
vocabulary follows for any number of chunks. A search reads the postings of its own terms' buckets, the manifest and the
degrees, never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens
from ..functions.vectors import rounded
from ..sources.versions import Change, Versioned
from . import retrieval

BUCKETS = 64


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _raw(n: Column, df: Column) -> Column:
    """idf before negative ones are replaced."""
    return F.log(n - df + 0.5) - F.log(df + 0.5)


class Index:
    """The index under ``path`` of chunks (paper, pos, text)."""

    def __init__(self, spark: SparkSession, path: str, *, paper: str = "paper_id", pos: str = "chunk_id", text: str = "text"):
        self.spark, self.paper, self.pos, self.text = spark, paper, pos, text
        self.store = Versioned(spark, path, [paper])

    def put(self, chunks: DataFrame) -> int:
        """Index the papers of ``chunks``, in place of what the index had of them."""
        tokens = chunks.select(self.paper, self.pos, lexical_tokens(F.col(self.text)).alias("tokens"))
        change = self.store.change()
        posted = retrieval.postings(tokens, [self.paper, self.pos]).withColumn("bucket", bucket(F.col("term")))
        posted = change.write("postings", posted.select("bucket", "term", self.paper, self.pos, "tf", "dl"), ["bucket", "term", self.paper])
        held = change.write("chunks", tokens.select(self.paper, self.pos, F.size("tokens").alias("dl")))
        facts = held.groupBy(self.paper).agg(F.count("*").alias("n"), F.sum(F.col("dl").cast("long")).alias("length"))
        within = posted.groupBy(self.paper, "term").agg(F.count("*").alias("df")).join(facts, self.paper)
        means = within.groupBy(self.paper).agg(F.avg(_raw(F.col("n"), F.col("df"))).alias("mean_raw"))
        return self._commit(change, facts.join(means, self.paper, "left").withColumn("alive", F.lit(True)), posted)

    def drop(self, papers: DataFrame) -> int:
        """Leave papers out; unknown ones do no harm."""
        gone = papers.select(self.paper).distinct()
        none = {"n": F.lit(0).cast("long"), "length": F.lit(0).cast("long"), "mean_raw": F.lit(None).cast("double"), "alive": F.lit(False)}
        return self._commit(self.store.change(), gone.withColumns(none), None)

    def _commit(self, change: Change, manifest: DataFrame, posted: DataFrame | None) -> int:
        """Add the changes of terms and degrees that the manifest's papers bring about."""
        at = change.based_on
        parts = [] if posted is None else [posted.groupBy("term").agg(F.count("*").alias("d"))]
        if at:
            known = self.store.alive(at).join(manifest.select(self.paper), self.paper, "left_semi").select(self.paper)
            parts.append(self.store.read("postings", at=at, keys=known).groupBy("term").agg((-F.count("*")).alias("d")))
        if parts:
            changed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            changed = changed.groupBy("term").agg(F.sum("d").alias("d")).where("d <> 0").select(bucket(F.col("term")).alias("bucket"), "term", "d")
            changed = change.write("terms", changed, ["bucket", "term"])
            before = self.store.everything("terms", at).groupBy("term").agg(F.sum("d").alias("df")) if at else None
            moved = changed.join(before, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))) if at else changed.withColumn("df", F.lit(0).cast("long"))
            steps = F.array(F.struct(F.col("df").alias("df"), F.lit(-1).alias("terms")), F.struct((F.col("df") + F.col("d")).alias("df"), F.lit(1).alias("terms")))
            change.write("degrees", moved.select(F.explode(steps).alias("s")).where("s.df > 0").groupBy("s.df").agg(F.sum("s.terms").alias("terms")))
        return change.commit(manifest)

    def vacuum(self) -> None:
        """Delete postings that no search reads any more; sums of changes stay."""
        self.store.vacuum(keep=("terms", "degrees"))

    def chunks(self, at: int | None = None) -> DataFrame:
        """(paper, pos, dl) of the chunks that the index holds."""
        return self.store.read("chunks", at=at)

    def search(self, queries: DataFrame, *, query_key: str = "query_id", query: str = "query", scoped: bool = False, at: int | None = None) -> DataFrame:
        """(query_key, paper, pos, score) of every chunk that shares a term with a query.

        ``scoped``: each query has a paper, within which it searches and statistics are taken. The scores are those of
        ``retrieval.bm25`` over the same chunks.
        """
        scope = [self.paper] if scoped else []
        hits, weights = self._asked(queries, query_key=query_key, query=query, scoped=scoped, at=at)
        tf = F.col("tf")
        part = F.col("_w") * tf * (retrieval.K1 + 1) / (tf + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("dl") / F.col("_avgdl")))
        return hits.join(retrieval.small(weights), [*scope, "term"]).groupBy(query_key, self.paper, self.pos).agg(F.sum(part).alias("score"))

    def best(self, queries: DataFrame, *, k: int, digits: int, query_key: str = "query_id", query: str = "query", scoped: bool = False, at: int | None = None) -> DataFrame:
        """(query_key, paper, pos, score, rank): the best ``k`` rows of ``search``, rounded before they are ranked, ties by ``pos``.

        A chunk's postings are brought together once, whatever queries ask for them; where the queries' terms can't be
        held by a task, or have no positive weight, ``search`` is ranked.
        """
        hits, weights = self._asked(queries, query_key=query_key, query=query, scoped=scoped, at=at)
        term = lambda: F.concat_ws("\n", self.paper, "term") if scoped else F.col("term")
        means = [F.first("avgdl").alias("avgdl")] if scoped else []
        if scoped:
            hits = hits.join(weights.select(self.paper, F.col("_avgdl").alias("avgdl")).distinct(), self.paper)
        chunks = hits.groupBy(self.paper, self.pos).agg(F.collect_list(F.struct(term().alias("term"), "tf")).alias("p"), F.first("dl").alias("dl"), *means)
        rows = chunks.select(self.pos, self.paper, F.col("p.term").alias("terms"), F.col("p.tf").alias("times"), "dl", *(["avgdl"] if scoped else []))
        scored = retrieval.held_best(rows, weights.withColumn("term", term()), [self.pos, self.paper], query_key=query_key, k=k, digits=digits)
        if scored is None:
            scored = self.search(queries, query_key=query_key, query=query, scoped=scoped, at=at).withColumn("score", rounded(F.col("score"), digits))
        return retrieval.top(scored.select(query_key, self.paper, self.pos, "score"), query_key, [F.desc("score"), F.col(self.pos)], k)

    def _asked(self, queries: DataFrame, *, query_key: str, query: str, scoped: bool, at: int | None) -> tuple[DataFrame, DataFrame]:
        """The postings of the queries' terms, and (query_key, term, _w, _avgdl): weights of the terms, by paper where ``scoped``."""
        at = self.store.generation() if at is None else at
        scope = [self.paper] if scoped else []
        terms = queries.select(*scope, query_key, F.explode(lexical_tokens(F.col(query))).alias("term")).groupBy(*scope, query_key, "term").agg(F.count("*").alias("_times")).withColumn("bucket", bucket(F.col("term")))
        wanted = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        asked = retrieval.small(terms.select(*scope, "bucket", "term").distinct())
        hits = self.store.read("postings", at=at, keys=queries.select(self.paper) if scoped else None, where=F.col("bucket").isin(wanted)).join(asked, [*scope, "bucket", "term"], "left_semi")
        papers = self.store.alive(at)
        # of a term that is asked for, all postings are here, so they tell its document frequency
        frequency = hits.groupBy(*scope, "term").agg(F.count("*").alias("_df"))
        if scoped:
            facts = papers.select(self.paper, F.col("n").alias("_n"), (F.col("length") / F.col("n")).alias("_avgdl"), F.col("mean_raw").alias("_mean"))
            known = frequency.join(facts, scope)
        else:
            whole = papers.agg(F.sum("n").alias("_n"), (F.sum("length") / F.sum("n")).alias("_avgdl"))
            degrees = self.store.everything("degrees", at).groupBy("df").agg(F.sum("terms").alias("terms"))
            mean = degrees.crossJoin(F.broadcast(whole)).agg((F.sum(F.col("terms") * _raw(F.col("_n"), F.col("df"))) / F.sum("terms")).alias("_mean"))
            known = frequency.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(mean))  # one row each
        raw = _raw(F.col("_n"), F.col("_df"))
        idf = known.select(*scope, "term", "_avgdl", F.when(raw < 0, retrieval.EPSILON * F.col("_mean")).otherwise(raw).alias("_idf"))
        return hits, terms.drop("bucket").join(idf, [*scope, "term"]).withColumn("_w", F.col("_times") * F.col("_idf")).drop("_times", "_idf")

    def retrieve(self, queries: DataFrame, *, k: int = 5, query_key: str = "query_id", query: str = "query", scoped: bool = False) -> DataFrame:
        """(query_key, pos, score, rank): the best ``k`` chunks, those of score 0 last; ``pos`` tells chunks apart, across papers if not scoped."""
        at = self.store.generation()
        scored = self.search(queries, query_key=query_key, query=query, scoped=scoped, at=at)
        return retrieval.bm25_top(scored, self.chunks(at), queries, query_key=query_key, pos=self.pos, k=k, scope=[self.paper] if scoped else None)


def terms_of(index: Index, at: int | None = None) -> DataFrame:
    """(term, df) of the vocabulary."""
    return index.store.everything("terms", at).groupBy("term").agg(F.sum("d").alias("df")).where("df > 0")

