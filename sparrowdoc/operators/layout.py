"""Page geometry: glyphs to lines, columns, headings and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_title_case


def group_lines(tops: Column, tolerance: float = 2.0) -> Column:
    """Sorted tops to line anchors: a line starts where a top is over ``tolerance`` below its first top."""
    return F.aggregate(F.array_sort(tops), F.array().cast("array<double>"), lambda acc, t: F.when((F.size(acc) == 0) | (F.abs(t - F.element_at(acc, F.when(F.size(acc) == 0, 1).otherwise(-1))) > tolerance), F.concat(acc, F.array(t))).otherwise(acc))


def coverage(glyphs: DataFrame, page: str, width: str) -> DataFrame:
    """Glyphs over each whole x of a page; bins without any count 0."""
    hits = glyphs.select(page, F.explode(F.sequence(F.greatest(F.lit(0), F.col("x0").cast("int")), F.least(F.col(width).cast("int"), F.col("x1").cast("int")))).alias("bin")).groupBy(page, "bin").agg(F.count("*").alias("cov"))
    bins = glyphs.select(page, width).distinct().select(page, F.explode(F.sequence(F.lit(0), F.col(width).cast("int"))).alias("bin"))
    return bins.join(hits, [page, "bin"], "left").withColumn("cov", F.coalesce("cov", F.lit(0)))


def pair_columns(left: DataFrame, right: DataFrame, *, page: str, tolerance: float = 2.0, gap: float = 8.0) -> DataFrame:
    """Left and right lines at one height and close together. The band of y makes the range join an equi-join."""
    band = lambda c: F.floor(F.col(c) / tolerance)
    l = left.withColumn("_b", F.explode(F.array(band("y") - 1, band("y"), band("y") + 1)))  # noqa: E741
    r = right.select(page, F.col("y").alias("ry"), F.col("x0").alias("rx0"), F.col("text").alias("rtext")).withColumn("_b", band("ry"))
    return l.join(r, [page, "_b"]).where((F.abs(F.col("y") - F.col("ry")) <= tolerance) & (F.col("rx0") - F.col("x1") < gap)).drop("_b")


def heading_score(text: Column, size: Column, body: Column, gap: Column) -> Column:
    """Of 12: size 3, up to eight words 2, no stop at the end 2, a number 2, title or upper case 1, space above 2."""
    bit = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    line = F.trim(text)
    n = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    cased = is_title_case(line) | ((F.upper(line) == line) & (F.lower(line) != line))
    return bit(size > body + 1.5, 3) + bit((n >= 1) & (n <= 8), 2) + bit(~line.rlike(r"[.,:;!?]$"), 2) + bit(line.rlike(r"^\d+(\.\d+)*\s+"), 2) + bit(cased, 1) + bit(gap > 10, 2)


def mode_first_seen(rows: DataFrame, by: list[str], value: str, pos: str) -> DataFrame:
    """The commonest value of a group, the first seen of equals."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias("mode"))


def sections(lines: DataFrame, *, paper: str, order: list[str], text: str = "text", heading: str = "is_heading") -> DataFrame:
    """Lines under the heading before them; what stands before the first is dropped, and all from 'references' on."""
    w = Window.partitionBy(paper).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"section_no": F.sum(F.col(heading).cast("int")).over(w), "heading": F.last(F.when(F.col(heading), F.col(text)), True).over(w), "ended": F.max(F.startswith(F.lower(F.trim(F.col(text))), F.lit("references")).cast("int")).over(w)})
    body = marked.where((F.col("section_no") > 0) & (F.col("ended") == 0))
    pieces = F.array_sort(F.collect_list(F.when(~F.col(heading), F.struct(*order, F.col(text).alias("_t")))))
    return body.groupBy(paper, "section_no", "heading").agg(F.array_join(F.transform(pieces, lambda s: s["_t"]), "\n").alias("body"), F.count("*").alias("n_lines"))
