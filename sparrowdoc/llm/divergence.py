"""Source divergence audit: how far the sources of a language are apart in their terms, by sparse sums.

A term is a run of ASCII letters and characters from U+0080 on, A to Z in lower case. A language keeps the terms that
stand in at least ``least`` of its documents. Smoothed rates ``p`` of a source and ``q`` of another or of the whole
language differ by ``(p - q)^2 / (p + q)``, rounded down, in units of ``SCALE``.

The sum over all kept terms of a pair of sources is put together from supports, by inclusion and exclusion: histograms
of a source's counts price its terms as if the other had none; a join of the two sources' postings corrects the terms
that both hold; the terms that neither holds are a constant each. So no source is ever laid out over the vocabulary.

Texts are counted in the tasks that read them, by Arrow batches, and only sums of a source and term are dealt out, so that
a source with a third of all rows is as many rows as it has terms. A language's sources are priced in tiles of ``BLOCK``
by ``BLOCK``. All arithmetic is in whole numbers; products that could leave 64 bits are decimals.

Defined cases: null texts, languages and sources are empty strings; an empty text, or one without terms, still makes its
source a group, against which the others are priced; rows that repeat count each time; ties rank by the item's bytes; a
language without kept terms prices every pair at 0; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import drop, long, materialize, small_batches, string

LEAST_DOCUMENTS, TOP, SCALE = 10, 10, 1_000_000_000
#: Sums that a task holds before it hands them on, and sources of a language that are priced in one go.
HELD, BLOCK = 200_000, 16

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_TALLY = [string("lang"), string("source"), string("term"), long("n"), long("docs")]


def _tally(batches):
    """Counts of (lang, source, term): occurrences and documents."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def out():
        for group in n:
            terms = list(n[group])
            columns = [*(pa.array(c, pa.string()) for c in ([group[0]] * len(terms), [group[1]] * len(terms), [t.decode() for t in terms])), pa.array(n[group].values(), pa.int64()), pa.array([docs[group][t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in _TALLY])
        n.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
            terms = Counter(_TERM.findall(text.encode().lower()))  # of bytes, lower() changes A to Z alone
            group = (lang, source)
            if group not in n:
                n[group], docs[group] = Counter(), Counter()
            held -= len(n[group])
            n[group].update(terms)
            docs[group].update(terms.keys())
            held += len(n[group])
            if held > HELD:
                yield from out()
                held = 0
    yield from out()


def tallies(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of ``docs`` (text, lang, source)."""
    small_batches(docs.sparkSession)
    parts = docs.mapInArrow(_tally, T.StructType(_TALLY))
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def rate(n: Column, total: Column, kept: Column) -> Column:
    """1 + SCALE * (n + 2) / (total + 2 * kept), rounded down."""
    wide = T.DecimalType(19, 0)
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast(T.DecimalType(10, 0)) * (n + 2).cast(wide), (total + 2 * kept).cast(wide))


def apart(p: Column, q: Column) -> Column:
    """The difference of two rates."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language, and a source's ``top`` terms."""
    plain = lambda c, to: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(to)
    docs = docs.select(plain(text_col, "text"), plain(lang_col, "lang"), plain(source_col, "source"))
    counted = materialize(tallies(docs), "tallies")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= least).select("lang", "term", "all_n")
    postings = materialize(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "postings")
    langs = postings.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("total"))
    held = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = docs.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "support", "v")]).withColumn("none", F.when(F.col("v") > 0, rate(F.lit(0), F.col("total"), F.col("v"))))
    groups = materialize(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    langs = materialize(langs, "langs")
    rated = postings.join(groups.select("lang", "source", "id", "v", "total", "none"), ["lang", "source"]).withColumn("p", rate(F.col("n"), F.col("total"), F.col("v"))).drop("total")
    rated = materialize(rated, "rated")
    out = _pairs(rated, groups).unionByName(_terms(rated, langs, top))
    drop(counted, postings)
    return out


def _terms(rated: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    """A source's terms that it holds oftener than its language does."""
    beside = rated.select("lang", "source", "term", "p", "all_n", "v").join(langs.select("lang", "total"), "lang")
    rows = beside.withColumn("q", rate(F.col("all_n"), F.col("total"), F.col("v"))).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _pairs(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """Both directions of every pair of a language's sources."""
    sized = groups.join(groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "lang")
    sized = sized.withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = lambda df: df.withColumns({"row": F.col("own"), "column": every})
    right = lambda df: df.withColumns({"column": F.col("own"), "row": every})
    tile = ["lang", "row", "column"]
    ends = [F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")]

    # terms of one side, as if the other had none of them
    histograms = rated.groupBy("lang", "id", "p").agg(F.count("*").alias("terms")).join(sized.select("id", "blocks", "own"), "id")
    others = right(sized).select(*tile, F.col("id").alias("ib"), F.col("none").alias("none_b"))
    prices = left(histograms).select(*tile, F.col("id").alias("ia"), "p", "terms").join(others, tile).where("ia <> ib")
    one = prices.groupBy(*ends).agg(F.sum(F.col("terms") * apart(F.col("p"), F.col("none_b"))).alias("value"))

    # terms of both sides: the true difference in place of the two prices, and of the constant that is taken once too often
    side = lambda i, p, none: rated.select("lang", "term", F.col("id").alias(i), F.col("p").alias(p), F.col("none").alias(none))
    met = side("ia", "pa", "na").join(side("ib", "pb", "nb"), ["lang", "term"]).where("ia < ib")
    correction = apart(F.col("pa"), F.col("pb")) - apart(F.col("pa"), F.col("nb")) - apart(F.col("na"), F.col("pb")) + apart(F.col("na"), F.col("nb"))
    both = met.groupBy(F.col("ia").alias("a"), F.col("ib").alias("b")).agg(F.sum(correction).alias("value"))

    # terms of neither side
    part = lambda df, x: df.select(*tile, F.col("id").alias(f"i{x}"), F.col("source").alias(f"s{x}"), F.col("none").alias(f"n{x}"), F.col("support").alias(f"k{x}"), F.col("v").alias(f"v{x}"))
    facts = part(left(sized), "a").join(part(right(sized), "b").drop("vb"), tile).where("ia < ib").withColumnRenamed("va", "v")
    neither = facts.select("lang", F.col("ia").alias("a"), F.col("ib").alias("b"), "sa", "sb", F.when(F.col("v") > 0, (F.col("v") - F.col("ka") - F.col("kb")) * apart(F.col("na"), F.col("nb"))).otherwise(F.lit(0)).alias("constant"))

    summed = one.unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
    whole = neither.join(summed, ["a", "b"], "left").withColumn("value", F.col("constant") + F.coalesce("value", F.lit(0)))
    turned = F.explode(F.array(F.struct(F.col("sa").alias("source"), F.col("sb").alias("item")), F.struct(F.col("sb").alias("source"), F.col("sa").alias("item")))).alias("x")
    rows = whole.select("lang", turned, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", F.col("value").cast("long").alias("value"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
