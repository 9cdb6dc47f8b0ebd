"""Reading order of pages from glyphs, heading candidates, and tables: from parsed pages to sections.

A glyph is a row (paper, page, text, x0, x1, top, y0, y1, size, upright); ``page_width`` comes with it. Parsing a PDF file
to glyphs is the caller's (``GlyphParser``); everything after is a plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import heading_verdicts, markdown_table, once
from . import layout

PAGE = ["paper_id", "page_num"]
#: A page has two columns if its glyphs span so much height and the lower part holds so many.
LEAST_HEIGHT, LEAST_GLYPHS, BODY_FROM = 50, 20, 0.30
GUTTER, HEADING = 8.0, 8
#: What a glyph has but its page.
GLYPH = ["x0", "x1", "text", "size", "y0", "y1", "top"]
GLYPHS = "paper_id string, page_num int, page_width double, text string, x0 double, x1 double, top double, y0 double, y1 double, size double, upright boolean"


class GlyphParser(Protocol):
    """A PDF parser: the pages of a file's bytes, each (page_width, glyphs as dicts)."""

    def __call__(self, content: bytes) -> Iterable[tuple[float, list[dict]]]: ...


def scan_pdf(spark: SparkSession, path: str, parser: Callable[[], GlyphParser]) -> DataFrame:
    """Glyphs of the PDF files under ``path``; pages are numbered from 1, pages without glyphs give no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("paper_id"), "content")
    names = ["text", "x0", "x1", "top", "y0", "y1", "size", "upright"]

    def run(batches):
        parse = parser()
        for b in batches:
            for paper, content in zip(b.column("paper_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                for number, (width, glyphs) in enumerate(parse(content), 1):
                    if glyphs:
                        rows = [{"paper_id": paper, "page_num": number, "page_width": float(width), **{n: g.get(n) for n in names}} for g in glyphs]
                        yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("paper_id", pa.string()), ("page_num", pa.int32()), ("page_width", pa.float64()), ("text", pa.string()), *[(n, pa.float64()) for n in names[1:7]], ("upright", pa.bool_())])
    return files.mapInArrow(run, GLYPHS)


def upright(glyphs: DataFrame) -> DataFrame:
    """Glyphs that aren't rotated; a null flag counts as rotated."""
    return glyphs.where(F.coalesce("upright", F.lit(False)))


def page_extent(glyphs: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """(by, page_top, page_bottom) of each page's glyphs."""
    return glyphs.groupBy(*by).agg(F.min("top").alias("page_top"), F.max("top").alias("page_bottom"))


def body_glyphs(glyphs: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """Glyphs from 30 percent of the page's height on, of pages high enough and with glyphs enough there."""
    w = Window.partitionBy(*by)
    placed = glyphs.withColumns({"_t": F.min("top").over(w), "_b": F.max("top").over(w)})
    body = placed.where((F.col("_b") - F.col("_t") >= LEAST_HEIGHT) & (F.col("top") >= F.col("_t") + (F.col("_b") - F.col("_t")) * BODY_FROM))
    return body.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= LEAST_GLYPHS).drop("_t", "_b", "_n")


def column_boundary(glyphs: DataFrame, by: list[str] = PAGE, *, low: float = 0.15, least: int = 5) -> DataFrame:
    """(by, boundary) of the pages with two columns: the middle of the run of thin bins around the least covered bin.

    Bins are whole points of x; only the middle 30 percent of the width counts, also for the run's ends. A bin is thin
    with at most ``low`` of the median of the covered bins; the run has to be ``least`` wide. A page's glyphs come together
    as an array of four numbers each, and all bins are counted there: none is a row.
    """
    spots = F.collect_list(F.struct(F.col("top").alias("top"), F.col("x0").alias("x0"), F.col("x1").alias("x1"), F.col("page_width").alias("w")))
    pages = glyphs.groupBy(*by).agg(spots.alias("_spots"), F.min("top").alias("_t"), F.max("top").alias("_b")).where(F.col("_b") - F.col("_t") >= LEAST_HEIGHT)

    def body(spots: Column) -> Column:
        """The glyphs that ``body_glyphs`` keeps."""
        lower = F.filter(spots, lambda g: g["top"] >= F.col("_t") + (F.col("_b") - F.col("_t")) * BODY_FROM)
        return once(lower, lambda g: F.when(F.size(g) >= LEAST_GLYPHS, placed(g)))

    def placed(spots: Column) -> Column:
        return once(F.array_max(F.transform(spots, lambda g: g["w"])), lambda w: covered(spots, w))

    def covered(spots: Column, w: Column) -> Column:
        last = w.cast("int")
        over = lambda g: F.sequence(F.greatest(F.lit(0), g["x0"].cast("int")), F.greatest(F.lit(0), F.least(last, g["x1"].cast("int"))))
        hit = F.array_sort(F.filter(F.flatten(F.array_compact(F.transform(spots, over))), lambda x: x <= last))
        # equal bins stand together: a bin's glyphs are from where it begins to where the next one does
        first = once(hit, lambda h: F.filter(F.transform(h, lambda x, i: F.struct(x.alias("bin"), i.alias("at"), (F.coalesce(F.get(h, i - 1), F.lit(-1)) != x).alias("new"))), lambda s: s["new"]))
        counted = once(F.struct(first.alias("f"), F.size(hit).alias("n")), lambda c: F.transform(c["f"], lambda s, i: F.struct(s["bin"].alias("bin"), (F.coalesce(F.get(c["f"], i + 1)["at"], c["n"]) - s["at"]).alias("cov"))))
        return once(counted, lambda bins: middle(bins, F.greatest(F.lit(0), (w * 0.35).cast("int")), F.least(last, (w * 0.65).cast("int"))))

    def middle(bins: Column, from_: Column, to: Column) -> Column:
        covers = F.array_sort(F.transform(bins, lambda b: b["cov"]))
        page = F.struct(from_.alias("from"), to.alias("to"), once(covers, half).alias("med"), F.filter(bins, lambda b: (b["bin"] >= from_) & (b["bin"] <= to)).alias("bins"))
        return F.when(from_ <= to, once(page, seeded))

    def half(covers: Column) -> Column:
        at = lambda n: F.get(covers, F.floor(n / 2).cast("int"))
        return (at(F.size(covers) - 1) + at(F.size(covers))) / 2

    def seeded(page: Column) -> Column:
        # bins follow each other up to the first that nothing covers; of all covered ones the least and leftmost is the seed
        bare = page["from"] + F.size(F.filter(page["bins"], lambda b, i: b["bin"] == page["from"] + i))
        leftmost = F.array_min(F.transform(page["bins"], lambda b: F.struct(b["cov"], b["bin"])))["bin"]
        return once(F.when(bare <= page["to"], bare).otherwise(leftmost), lambda seed: run(page, seed))

    def run(page: Column, seed: Column) -> Column:
        thick = F.filter(page["bins"], lambda b: (b["cov"] > page["med"] * low) & (b["bin"] != seed))
        left, right = F.filter(thick, lambda b: b["bin"] < seed), F.filter(thick, lambda b: b["bin"] > seed)
        ends = F.struct(F.coalesce(F.get(left, F.size(left) - 1)["bin"] + 1, page["from"]).alias("lo"), F.coalesce(F.get(right, F.lit(0))["bin"] - 1, page["to"]).alias("hi"))
        return once(ends, lambda e: F.when(e["hi"] - e["lo"] >= least, (e["lo"] + e["hi"]) / 2))

    return pages.select(*by, F.explode(F.array_compact(F.array(body(F.col("_spots"))))).alias("boundary"))


def lined(glyphs: DataFrame, by: list[str], tolerance: float = 2.0) -> DataFrame:
    """Glyphs with ``y``, the top of their line's first glyph: a line starts over ``tolerance`` below the one before."""
    rest = [c for c in glyphs.columns if c not in by]
    together = glyphs.groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias("_g"), layout.group_lines(F.collect_set(F.col("top").cast("double")), tolerance).alias("_a"))
    return together.select(*by, "_a", F.explode("_g").alias("_g")).select(*by, "_g.*", F.array_max(F.filter("_a", lambda a: a <= F.col("_g.top"))).alias("y"))


def page_lines(glyphs: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """(by, line_index, text, avg_size, y0, y1) in reading order.

    Pages with one column run from top to bottom. With two, lines that flow through the gutter are whole ones: those
    above the columns come first, then the left column with those between, the right column, and those below.
    """
    sided = upright(glyphs).join(column_boundary(upright(glyphs), by), by, "left")
    side = F.when(F.col("boundary").isNull(), "S").when((F.col("x0") + F.col("x1")) / 2 < F.col("boundary"), "L").otherwise("R")
    placed = lined(sided.select(*by, side.alias("side"), *GLYPH), [*by, "side"])
    lines = placed.groupBy(*by, "side", "y").agg(F.min("x0").alias("l"), F.max("x1").alias("r"), F.collect_list(F.struct(*GLYPH)).alias("_g"))
    # the two sides of one whole line: each line looks at those around it, and everything stays where its page is
    around = Window.partitionBy(*by).orderBy("y").rangeBetween(-3, 3)
    lines = lines.withColumn("_near", F.collect_list(F.when(F.col("side") != "S", F.struct("side", "y", "l", "r"))).over(around))
    left, right = (F.col("side") == "L"), (F.col("side") == "R")
    meets = lambda o: (F.abs(F.col("y") - o["y"]) <= 2) & ((left & (o["side"] == "R") & (o["l"] - F.col("r") < GUTTER)) | (right & (o["side"] == "L") & (F.col("l") - o["r"] < GUTTER)))
    pair = lambda o: F.struct(F.when(left, F.col("y")).otherwise(o["y"]).alias("ly"), F.when(left, o["y"]).otherwise(F.col("y")).alias("ry"))
    lines = lines.select(*by, "side", "y", "_g", F.explode_outer(F.transform(F.filter("_near", meets), pair)).alias("_w"))
    whole = F.col("_w").isNotNull()
    lines = lines.select(*by, F.when(whole, "W").otherwise(F.col("side")).alias("side"), F.when(whole, F.least("_w.ly", "_w.ry")).otherwise(F.col("y")).alias("y"), F.coalesce("_w.ly", F.lit(0.0)).alias("ly"), F.coalesce("_w.ry", F.lit(0.0)).alias("ry"), "_g")
    # a line's glyphs from left to right, a blank where they are over 2 points apart
    row = lambda g: F.array_sort(F.transform(g, lambda x: F.struct(x["x0"], x["text"], x["x1"])))
    piece = lambda r: F.transform(r, lambda x, i: F.struct(x["x0"], F.when(x["x0"] - F.get(r, i - 1)["x1"] > 2, F.concat(F.lit(" "), x["text"])).otherwise(x["text"]).alias("p")))
    said = lambda g: F.trim(F.array_join(F.transform(F.array_sort(once(row(g), piece)), lambda x: x["p"]), ""))
    mean = lambda sizes: F.try_divide(F.aggregate(sizes, F.lit(0.0), lambda total, x: total + x), F.size(sizes))
    own = lambda g, name: F.transform(g, lambda x: x[name])
    line = lambda g: F.struct(said(g).alias("text"), once(F.array_compact(own(g, "size").cast("array<double>")), mean).alias("avg_size"), F.array_min(own(g, "y0")).alias("y0"), F.array_max(own(g, "y1")).alias("y1"))
    rows = lines.groupBy(*by, "side", "y", "ly", "ry").agg(F.flatten(F.collect_list("_g")).alias("_g"))
    rows = rows.select(*by, "side", "y", F.explode(F.array(once(F.col("_g"), line))).alias("_l")).select(*by, "side", "y", "_l.*")
    page, own = Window.partitionBy(*by), F.when(F.col("side").isin("L", "R"), F.col("y"))
    top, bottom = F.min(own).over(page), F.max(own).over(page)
    zone = F.when(F.col("side") == "R", 2).when((F.col("side") == "W") & (F.col("y") < top), 0).when((F.col("side") == "W") & (F.col("y") > bottom), 3).otherwise(1)
    order = Window.partitionBy(*by).orderBy("_zone", "y", "side")
    return rows.withColumn("_zone", zone).where("text <> ''").withColumn("line_index", F.row_number().over(order) - 1).select(*by, "line_index", "text", "avg_size", "y0", "y1")


def page_text(lines: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """(by, text): the page's lines joined by newlines."""
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "text"))), lambda s: s["text"]), "\n").alias("text"))


def body_size(glyphs: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """(by, body): the commonest rounded glyph size, the first seen of equals; pages without sizes get 10."""
    sized = glyphs.withColumns({"_size": F.bround("size"), "_pos": F.monotonically_increasing_id()}) if "pos" not in glyphs.columns else glyphs.withColumns({"_size": F.bround("size"), "_pos": F.col("pos")})
    found = layout.mode_first_seen(sized.where("_size is not null"), by, "_size", "_pos")
    return glyphs.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("mode", F.lit(10.0)).alias("body"))


def heading_candidates(lines: DataFrame, bodies: DataFrame, *, paper: str = "paper_id", page: str = "page_num", least: int = HEADING) -> DataFrame:
    """(paper, page, line_index, id, candidate_line, context, score) of lines that score ``least`` of 12 or more.

    The gap above is the last line's least y0 less this line's greatest y1; the context is the next three lines; ids
    count a paper's candidates from 1.
    """
    w = Window.partitionBy(paper, page).orderBy("line_index")
    gap = F.lag("y0").over(w) - F.col("y1")
    ahead = F.array_join(F.filter(F.array(*[F.lead("text", i).over(w) for i in (1, 2, 3)]), lambda x: x.isNotNull()), " ")
    scored = lines.join(bodies, [paper, page]).withColumns({"score": layout.heading_score(F.col("text"), F.col("avg_size"), F.col("body"), gap), "context": ahead})
    ids = Window.partitionBy(paper).orderBy(page, "line_index")
    return scored.where(F.col("score") >= least).select(paper, page, "line_index", F.row_number().over(ids).alias("id"), F.col("text").alias("candidate_line"), "context", "score")


def confirmed(candidates: DataFrame, replies: DataFrame, *, paper: str = "paper_id", reply: str = "reply") -> DataFrame:
    """Candidates whose verdict in the paper's reply ('id | verdict' lines) is SECTION or SUBSECTION."""
    verdicts = replies.select(paper, F.explode(heading_verdicts(F.col(reply))).alias("id", "verdict"))
    return candidates.join(verdicts, [paper, "id"]).where(F.col("verdict").isin("SECTION", "SUBSECTION"))


def headed(lines: DataFrame, headings: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """Lines with ``is_heading``, joined with the confirmed candidates by page and line."""
    marks = headings.select(*by, "line_index", F.lit(True).alias("is_heading")).distinct()
    return lines.join(marks, [*by, "line_index"], "left").withColumn("is_heading", F.coalesce("is_heading", F.lit(False)))


def tables(found: DataFrame, *, paper: str = "paper_id", page: str = "page_num", pos: str = "pos", cells: str = "cells", count=None) -> DataFrame:
    """Chunks of a paper's tables (cells: array of rows): two rows and two columns at least, numbered over the paper.

    ``count``: a Column function for the tokens of a text; by default blank-separated words.
    """
    count = count or (lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")))
    good = found.where((F.size(cells) >= 2) & (F.size(F.get(cells, 0)) >= 2)).withColumn("text", markdown_table(F.col(cells))).where("trim(text) <> ''")
    numbered = good.withColumn("_n", F.row_number().over(Window.partitionBy(paper).orderBy(page, pos)))
    name: Column = F.concat(F.lit("Table "), F.col("_n").cast("string"), F.lit(" (page "), F.col(page).cast("string"), F.lit(")"))
    return numbered.select(paper, name.alias("section"), F.lit("table").alias("section_type"), F.col(page).alias("page_num"), F.lit(0).alias("chunk_index"), F.lit(1).cast("long").alias("total_chunks_in_section"), "text", count(F.col("text")).alias("token_count"))
