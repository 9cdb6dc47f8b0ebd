"""Tables from ruling lines, sections, the collection of papers, and papers that land as a stream."""

import pytest
from pyspark.sql import functions as F

from sparrowdoc.operators import pages, papers, tables
from sparrowdoc.streaming import ingestion


def words(spark, rows):
    return spark.createDataFrame([("p", page, t, float(x), float(x + 5 * len(t)), float(top), 8.0) for page, x, top, t in rows], "paper_id string, page_num int, text string, x0 double, x1 double, top double, size double")


def rules(spark, rows):
    return spark.createDataFrame([("p", r[0], r[1], *map(float, r[2:])) for r in rows], "paper_id string, page_num int, orientation string, pos double, lo double, hi double")


def test_tables_are_found_from_their_rulings(spark):
    edges = [
        # page 1: three rows and three columns; the first row's last two cells are one, drawn with gaps and shakes
        *[(1, "h", y + d, 50.0, 120.0) for y, d in ((100, 0), (120, 0.5), (140, -0.5), (160, 0))], *[(1, "h", y, 121.0, 300.0) for y in (100.0, 120.0, 140.0, 160.0)],
        (1, "v", 50.0, 100.0, 160.0), (1, "v", 120.0, 100.0, 160.0), (1, "v", 200.4, 121.0, 160.0), (1, "v", 199.6, 121.0, 150.0), (1, "v", 300.0, 100.0, 160.0),
        # a second table below, and lines that make none: an underline, a stray rule, two that don't meet
        *[(1, "h", y, 50.0, 250.0) for y in (300.0, 330.0, 360.0)], *[(1, "v", x, 300.0, 360.0) for x in (50.0, 150.0, 250.0)],
        (1, "h", 500.0, 50.0, 250.0), (1, "v", 400.0, 10.0, 90.0), (2, "h", 100.0, 50.0, 100.0), (2, "v", 50.0, 110.0, 160.0),
    ]
    said = [(1, 60, 105, "Name"), (1, 130, 105, "Both"), (1, 160, 105, "values"), (1, 60, 125, "a"), (1, 130, 125, "1"), (1, 210, 125, "2"), (1, 60, 145, "b"), (1, 210, 145, "4"), (1, 60, 305, "x"), (1, 60, 317, "y"), (1, 160, 305, "z"), (1, 60, 340, "w"), (1, 10, 10, "loose")]
    got = {(r.page_num, r.pos): r.cells for r in tables.found(rules(spark, edges), words(spark, said)).collect()}
    assert got == {(1, 0): [["Name", "Both values", None], ["a", "1", "2"], ["b", "", "4"]], (1, 1): [["x\ny", "z"], ["w", ""]]}
    chunks = pages.tables(tables.found(rules(spark, edges), words(spark, said))).orderBy("section").collect()
    assert [c.section for c in chunks] == ["Table 1 (page 1)", "Table 2 (page 1)"]
    assert chunks[0].text.split("\n")[:3] == ["| Name | Both values |  |", "| --- | --- | --- |", "| a | 1 | 2 |"]
    assert tables.found(rules(spark, edges).limit(0), words(spark, said)).count() == 0


def test_rectangles_are_edges(spark):
    box = spark.createDataFrame([("p", 1, 10.0, 60.0, 20.0, 40.0), ("p", 1, 10.0, 60.0, 40.2, 60.0), ("p", 1, 60.3, 110.0, 20.0, 40.0), ("p", 1, 60.0, 110.0, 40.0, 60.0), ("p", 1, 5.0, 5.0, 1.0, 9.0)], "paper_id string, page_num int, x0 double, x1 double, top double, bottom double")
    lines = tables.joined(tables.snapped(tables.edges(box)))
    assert sorted((r.orientation, r.lo, r.hi) for r in lines.collect() if r.pos > 6) == [("h", 10.0, 110.0)] * 3 + [("v", 20.0, 60.0)] * 3
    assert tables.cells(tables.crossings(lines)).count() == 4


def most_rows(df):
    """The most rows that a node of the plan gave when ``df`` was collected."""

    def below(node):
        kind = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        rows = node.metrics().get("numOutputRows")
        return max([rows.get().value() if rows.isDefined() else 0, *map(below, inner)])

    return below(df._jdf.queryExecution().executedPlan())


def test_cells_of_a_long_table_grow_with_its_rows(spark):
    """Each two crossings of a vertical line were a row, so that twice the rows of a table took four times the work."""
    n = 300
    edges = [(1, "h", 10.0 * i, 50.0, 250.0 if i % 7 else 150.0) for i in range(n)] + [(1, "v", x, 0.0, 10.0 * n) for x in (50.0, 150.0, 250.0)]
    df = tables.cells(tables.crossings(rules(spark, edges)))
    right = [i for i in range(n) if i % 7]
    expected = {(50.0, 10.0 * i, 150.0, 10.0 * i + 10) for i in range(n - 1)} | {(150.0, 10.0 * i, 250.0, 10.0 * j) for i, j in zip(right, right[1:])}
    assert {(r.x0, r.top, r.x1, r.bottom) for r in df.collect()} == expected
    assert most_rows(df) < 20 * n


def test_sections_end_at_references(spark):
    rows = [(1, 0, "Title"), (1, 1, " Methods "), (1, 2, "  we do "), (2, 0, "it"), (2, 1, "Results"), (2, 2, ""), (3, 0, "References [1]"), (3, 1, "Appendix"), (3, 2, "more")]
    lines = spark.createDataFrame([("p", *r) for r in rows] + [("q", 1, 0, "none")], "paper_id string, page_num int, line_index int, text string")
    heads = spark.createDataFrame([("p", 1, 1, "SECTION"), ("p", 2, 1, "SUBSECTION"), ("p", 3, 1, "SECTION")], "paper_id string, page_num int, line_index int, verdict string")
    got = sorted((r.section_no, r.heading, r.type, r.page_num, r.body) for r in papers.assemble(lines, heads).collect())
    assert got == [(1, "Methods", "SECTION", 1, "we do\nit"), (2, "Results", "SUBSECTION", 2, "")]


def stored(spark, rows):
    df = spark.createDataFrame(rows, "paper_id string, document string")
    return df.select("paper_id", F.md5("document").alias("id"), F.array(F.lit(1.0)).alias("embedding"), "document", F.struct(F.lit("s").alias("section"), F.lit(1).alias("page_num")).alias("metadata"))


def test_a_reader_that_began_before_a_delete_ends_with_the_old_rows(spark, tmp_path):
    held = papers.Collection(spark, f"{tmp_path}/c")
    held.put(stored(spark, [("a", "one"), ("a", "two"), ("b", "three")]))
    before = held.scan()
    held.put(stored(spark, [("a", "new")]))
    held.drop(spark.createDataFrame([("b",), ("zzz",)], "paper_id string"))
    says = lambda df: sorted((r.paper_id, r.document) for r in df.collect())
    assert says(held.scan()) == [("a", "new")] and says(before) == [("a", "one"), ("a", "two"), ("b", "three")]
    some = held.scan(spark.createDataFrame([("a",)], "paper_id string"))
    assert says(some) == [("a", "new")] and some.columns == ["paper_id", "id", "embedding", "document", "section", "page_num"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [(r.paper_id, r.n_chunks) for r in held.papers().collect()] == [("a", 1)]


def ingest(rows):
    """Texts as they are; a paper whose text is 'broken' cannot be read."""
    good = rows.where("text <> 'broken' and trim(text) <> ''")
    chunks = good.select("paper_id", F.md5("text").alias("id"), F.array(F.lit(1.0)).alias("embedding"), F.col("text").alias("document"), F.struct(F.lit("s").alias("section")).alias("metadata"))
    return chunks, rows.where("text = 'broken'").select("paper_id", F.lit("unreadable").alias("error"))


def test_papers_that_land_are_ingested_once(spark, tmp_path):
    def land(n, rows):
        spark.createDataFrame(rows, "paper_id string, text string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    stream = lambda: spark.readStream.schema("paper_id string, text string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    held = papers.Collection(spark, f"{tmp_path}/c")
    land(1, [("a", "alpha"), ("a", "beta"), ("b", "broken"), ("c", " ")])
    ingestion.run(stream(), held, ingest, f"{tmp_path}/cp").awaitTermination()
    state = lambda: sorted((r.paper_id, r.status, r.error, r.n_chunks) for r in held.papers().collect())
    first = [("a", "ready", None, 2), ("b", "failed", "unreadable", 0), ("c", "failed", "no text", 0)]
    assert state() == first
    assert [r.status for r in ingestion.history(held).where("paper_id = 'a'").orderBy("generation").collect()] == ["processing", "ready"]

    # the next batch dies after its first commit, before its second
    land(2, [("b", "mended"), ("d", "delta")])

    def dies(rows):
        ingest(rows)[0].count()
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        ingestion.run(stream(), held, dies, f"{tmp_path}/cp").awaitTermination()
    assert {r.paper_id: r.status for r in held.papers().collect()} == {"a": "ready", "b": "processing", "c": "failed", "d": "processing"}
    ingestion.run(stream(), held, ingest, f"{tmp_path}/cp").awaitTermination()
    after = sorted([("a", "ready", None, 2), ("b", "ready", None, 1), ("c", "failed", "no text", 0), ("d", "ready", None, 1)])
    assert state() == after and sorted(r.document for r in held.scan().collect()) == ["alpha", "beta", "delta", "mended"]

    # a batch that is handed over again, as after a crash between the second commit and Spark's own, changes nothing
    g = held.store.generation()
    again = spark.createDataFrame([("b", "mended"), ("d", "delta")], "paper_id string, text string")
    assert ingestion.apply_batch(held, again, 1, ingest) is False and held.store.generation() == g and state() == after
    assert ingestion.apply_batch(held, again, 2, ingest) is True and state() == after


def test_column_boundary_makes_no_rows_of_bins(spark):
    """Each point of a page's width was a row: 613 for a page with 20 glyphs, all in few tasks, as their input is small."""
    names = "paper_id string, page_num int, page_width double, top double, x0 double, x1 double"
    rows = [("p", n, 612.0, 10.0 * i, x + i % 7, x + 200.0) for n in range(40) for i in range(40) for x in (50.0, 350.0)]
    df = pages.column_boundary(spark.createDataFrame([*rows, ("p", 99, 612.0, 1.0, 1.0, 5.0), ("p", 40, None, None, None, None)], names))
    assert {(r.page_num, r.boundary) for r in df.collect()} == {(n, 300.5) for n in range(40)}
    assert most_rows(df) <= len(rows) + 2


def test_lines_of_a_page_stay_where_the_page_is(spark):
    """The glyphs were placed four times, once for each side of a join with themselves. The plan's two shuffles are by page."""
    glyphs = spark.createDataFrame([("p", 1, 612.0, "a", 50.0, 55.0, 10.0, 1.0, 2.0, 9.0, True)], pages.GLYPHS)
    lines = pages.page_lines(glyphs)
    assert [tuple(r) for r in lines.collect()] == [("p", 1, 0, "a", 9.0, 1.0, 2.0)]
    assert lines._jdf.queryExecution().sparkPlan().toString().count("Scan") == 2


def test_a_batch_opens_only_the_commits_since_the_last_one(spark, tmp_path, monkeypatch):
    """Each batch read all manifests in Spark jobs and opened every commit many times, so its cost grew with the batches before it."""
    from sparrowdoc.sources import versions

    opened, commit = [], versions.Versioned._commit
    monkeypatch.setattr(versions.Versioned, "_commit", lambda self, n: (found := commit(self, n)) and (opened.append(n) or found))
    held = papers.Collection(spark, f"{tmp_path}/c")
    for n in range(4):
        assert ingestion.apply_batch(held, spark.createDataFrame([(f"p{n}", "text")], "paper_id string, text string"), n, ingest)
    assert held.store.commits() == list(range(1, 9)) == opened
    spark.sparkContext.setJobGroup("ledger", "")
    assert [ingestion.applied(held, "landing", n) for n in range(6)] == [True] * 4 + [False] * 2 and not ingestion.applied(held, "other", 1)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("ledger")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    # commits of before there were notes: the ledger is in their manifests
    bare = papers.Collection(spark, f"{tmp_path}/c")
    for n in (5, 6):
        fs, p = bare.store._fs(f"{bare.store.path}/commits/{n}")
        out = fs.create(p, True)
        out.writeInt(n)
        out.close()
    assert [ingestion.applied(bare, "landing", n) for n in range(6)] == [True] * 4 + [False] * 2
    assert {(r.paper_id, r.status) for r in bare.papers().collect()} == {(f"p{n}", "ready") for n in range(4)}
