"""Tables of a page from its ruling lines: edges, crossings, cells, rows.

An edge is a row (paper_id, page_num, orientation, pos, lo, hi): a horizontal one ('h') at height ``pos`` from x ``lo`` to
``hi``, a vertical one ('v') at x ``pos`` from top ``lo`` to ``hi``. ``edges`` cuts rectangles into four.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["paper_id", "page_num"]
#: Points within which edges are one, ends meet, and lines cross.
SNAP, JOIN, CROSS = 3.0, 3.0, 3.0
#: Shortest edge that counts, once ends are joined.
LEAST = 3.0
#: Width of the bands in which crossings are looked for.
BAND = 64.0


def edges(rectangles: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """Edges of rectangles (by, x0, x1, top, bottom). One that is thin in a direction is a line, and its two edges become one."""
    edge = lambda o, pos, lo, hi: F.struct(F.lit(o).alias("orientation"), F.col(pos).cast("double").alias("pos"), F.col(lo).cast("double").alias("lo"), F.col(hi).cast("double").alias("hi"))
    four = F.array(edge("h", "top", "x0", "x1"), edge("h", "bottom", "x0", "x1"), edge("v", "x0", "top", "bottom"), edge("v", "x1", "top", "bottom"))
    return rectangles.select(*by, F.explode(four).alias("e")).select(*by, "e.*").where("hi > lo")


def snapped(edges_: DataFrame, by: list[str] = PAGE, tolerance: float = SNAP) -> DataFrame:
    """Edges of one direction that follow each other within ``tolerance``, at their mean position."""
    w = Window.partitionBy(*by, "orientation").orderBy("pos")
    begins = F.coalesce((F.col("pos") - F.lag("pos").over(w) > tolerance).cast("int"), F.lit(0))
    numbered = edges_.withColumn("_new", begins).withColumn("_c", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("pos", F.round(F.avg("pos").over(Window.partitionBy(*by, "orientation", "_c")), 6)).drop("_new", "_c")


def joined(edges_: DataFrame, by: list[str] = PAGE, tolerance: float = JOIN, least: float = LEAST) -> DataFrame:
    """(by, orientation, pos, lo, hi): edges at one position whose ends meet within ``tolerance`` are one; short ones go."""
    line = [*by, "orientation", "pos"]
    w = Window.partitionBy(*line).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = edges_.withColumn("_new", F.coalesce((F.col("lo") - reach > tolerance).cast("int"), F.lit(0))).withColumn("_r", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*line, "_r").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_r").where(F.col("hi") - F.col("lo") >= least)


def crossings(lines: DataFrame, by: list[str] = PAGE, tolerance: float = CROSS) -> DataFrame:
    """(by, x, y, v, h): where a vertical line meets a horizontal one; v and h name the lines.

    A band of x makes the range join an equi-join: a horizontal line is in every band it passes, a vertical one in its own.
    """
    name = F.struct("pos", "lo", "hi")
    band = lambda x: F.floor(x / BAND)
    h = lines.where("orientation = 'h'").select(*by, F.col("pos").alias("y"), F.col("lo").alias("left"), F.col("hi").alias("right"), name.alias("h"), F.explode(F.sequence(band(F.col("lo") - tolerance), band(F.col("hi") + tolerance))).alias("_b"))
    v = lines.where("orientation = 'v'").select(*by, F.col("pos").alias("x"), F.col("lo").alias("upper"), F.col("hi").alias("lower"), name.alias("v"), band(F.col("pos")).alias("_b"))
    met = h.join(v, [*by, "_b"]).where((F.col("x") >= F.col("left") - tolerance) & (F.col("x") <= F.col("right") + tolerance) & (F.col("y") >= F.col("upper") - tolerance) & (F.col("y") <= F.col("lower") + tolerance))
    return met.select(*by, "x", "y", "v", "h")


def cells(points: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """(by, x0, top, x1, bottom): for each crossing the smallest rectangle below and to the right whose corners are crossings
    of its own two lines and of two that join them; the nearest crossing below counts first, then the nearest to the right.

    Two vertical lines and a horizontal one that crosses both are a side of a rectangle, and the next such line below is its
    other side. So there is a row for each two crossings of one horizontal line, not for each two of a vertical one, of which
    a long table has as many as rows.
    """
    left = points.select(*by, "h", F.col("x").alias("x0"), F.col("v").alias("v0"), F.col("y").alias("top"))
    right = points.select(*by, "h", F.col("x").alias("x1"), F.col("v").alias("v1"))
    sides = left.join(right, [*by, "h"]).where("x1 > x0").select(*by, "x0", "top", "x1", "v0", "v1").distinct()
    below = F.lead("top").over(Window.partitionBy(*by, "v0", "v1").orderBy("top"))
    best = F.min(F.struct("bottom", "x1"))
    return sides.withColumn("bottom", below).where("bottom is not null").groupBy(*by, "x0", "top").agg(best.alias("_m")).select(*by, "x0", "top", F.col("_m.x1").alias("x1"), F.col("_m.bottom").alias("bottom"))


def _tables(page: pd.DataFrame) -> pd.DataFrame:
    """A page's cells with ``table``: cells that share a corner are of one table. Tables count from the top, then the left."""
    parent = list(range(len(page)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple[float, float], int] = {}
    for i, (x0, top, x1, bottom) in enumerate(page[["x0", "top", "x1", "bottom"]].itertuples(index=False)):
        for corner in ((x0, top), (x1, top), (x0, bottom), (x1, bottom)):
            parent[root(i)] = root(seen.setdefault(corner, i))
    roots = [root(i) for i in range(len(page))]
    first = page.assign(_r=roots).sort_values(["top", "x0"]).drop_duplicates("_r")["_r"].tolist()
    place = {r: i for i, r in enumerate(first)}
    return page.assign(table=[place[r] for r in roots])


def cell_texts(placed: DataFrame, glyphs: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """``placed`` cells with ``text``: the glyphs whose middle is in the cell, line by line, left to right.

    Lines are told by whole heights; a blank stands where glyphs are over 3 points apart.
    """
    band = lambda y: F.floor(y / BAND)
    middle = glyphs.select(*by, "text", F.col("x0").alias("_l"), F.col("x1").alias("_r"), F.col("top").alias("_t"), ((F.col("x0") + F.col("x1")) / 2).alias("_x"), (F.col("top") + F.coalesce("size", F.lit(0.0)) / 2).alias("_y")).withColumn("_b", band(F.col("_y")))
    key = [*by, "table", "x0", "top"]
    wide = placed.select(*key, "x1", "bottom", F.explode(F.sequence(band(F.col("top")), band(F.col("bottom")))).alias("_b"))
    inside = wide.join(middle, [*by, "_b"]).where("_x >= x0 and _x < x1 and _y >= top and _y < bottom").withColumn("_line", F.round("_t"))
    w = Window.partitionBy(*key, "_line").orderBy("_l", "text")
    piece = F.when(F.col("_l") - F.lag("_r").over(w) > 3, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    lines = inside.withColumns({"_p": piece, "_n": F.row_number().over(w)}).groupBy(*key, "_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_p"))), lambda s: s["_p"]), "").alias("_s"))
    said = lines.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_s"))), lambda s: s["_s"]), "\n").alias("text"))
    return placed.join(said, key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def found(edges_: DataFrame, glyphs: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """(by, pos, cells) of the tables on pages, as ``pages.tables`` takes them: an array of rows, each an array of texts.

    A table has a column for each left end of its cells and a row for each top; where a merged cell leaves no cell of its
    own, the text is null. Cells that share a corner are one table (a page's cells come together for that).
    """
    placed = cells(crossings(joined(snapped(edges_, by), by), by), by)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    tabled = placed.groupBy(*by).applyInPandas(_tables, f"{kinds}, table long")
    filled = cell_texts(tabled, glyphs, by)
    grid = [*by, "table"]
    lefts = filled.groupBy(*grid).agg(F.array_sort(F.collect_set("x0")).alias("_lefts"))
    rows = filled.groupBy(*grid, "top").agg(F.map_from_entries(F.collect_list(F.struct("x0", "text"))).alias("_row")).join(lefts, grid)
    rows = rows.withColumn("_cells", F.transform("_lefts", lambda x: F.try_element_at("_row", x)))
    return rows.groupBy(*grid).agg(F.transform(F.array_sort(F.collect_list(F.struct("top", "_cells"))), lambda r: r["_cells"]).alias("cells")).withColumnRenamed("table", "pos")
