"""Fuzzy line dedup in DataFrame operations alone: MinHash over character shingles, bands, Jaccard, union-find.

A line (a text is cut at newlines) is compared in lower case with its spaces collapsed. Its set is the distinct
``SHINGLE``-character shingles that start at any of its characters; a shorter line is one shingle. Equal lines are one
node. A signature is ``VALUES`` minima of independent hashes, of which each band takes three; lines that agree in a band
are compared with the band's first and last line by the exact Jaccard similarity of their sets, and the links are joined
by distributed union-find. Lines outside a band's main component are tried on some lines of it and on some others; those
that are still outside are then compared with all lines of their band that are in other components, in blocks, so that no
pair that meets in a band is left untested. Of each component the first line stays, by id and line number; all its other
occurrences go.

Before two sets are compared their sketches are: each shingle flips one of ``WORDS`` * 64 bits, so two sketches differ in
no more bits than there are shingles in one set alone. A pair whose sketches differ in more bits than its similarity
allows is surely not similar, and no text is read for it; no similar pair is lost.

Defined cases: null texts stay null; blank lines always stay; rows that agree in id and text lose the same lines; an
empty table gives an empty one; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize
from .components import components, edges

SHINGLE = 12
#: Values of a signature, and which values after the first make a band: two lines at exactly 0.75 meet in none of the
#: bands with probability 0.0037, as summed over all sets of agreeing values.
VALUES, BAND = 16, (0, 2, 6)
#: Agreeing values from which two lines that met are compared; a pair at exactly 0.75 has fewer with probability 0.0003.
LEAST_AGREEING = 6
#: Lines under SHORT characters are signed by all their shingles, longer ones by those that begin with one of PICKS. Two
#: lines that are 0.75 alike and stand on both sides of SHORT are under SHORT / 0.75, so lines of such a length are signed
#: both ways, and so are lines of which fewer than FEW characters are picks.
SHORT, FEW = 64, 8
#: First characters of picked shingles: about a quarter of those of prose, of hexadecimal digits and of numbers, an eighth
#: to a sixth of base-64 digits. Of other scripts with many texts (Greek, Cyrillic, Hebrew, Arabic, kana, Chinese, Korean)
#: the first few letters, or ranges of signs, are a similar share; of any other script all are. So picks are a sample of a
#: line wherever it is prose or not.
PICKS = "ento147" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in (
    (0x80, 0x3B5), (0x430, 0x437), (0x450, 0x5D5), (0x5EB, 0x628), (0x700, 0x304F), (0x3097, 0x30B0), (0x3100, 0x5FFF), (0xA000, 0xB7FF), (0xD7B0, 0x10FFFF),
))
#: Words of 64 bits in a sketch of a line's set.
WORDS = 16
#: Lines of a band that are compared with as many others in one go; turns of tries before that, and how many lines of the
#: main component, and of the others, a line is tried on in a turn.
BLOCK, TURNS, TRIES = 512, 1, 16
SIMILARITY = 0.75


def normal(line: Column) -> Column:
    low = F.trim(F.lower(line))
    return F.when(F.contains(low, F.lit("  ")), F.regexp_replace(low, " +", " ")).otherwise(low)


def _everywhere(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))."), F.lit(1))


def _picked(line: Column) -> Column:
    """Shingles that begin with a pick, which is looked at before the rest."""
    return F.regexp_extract_all(line, F.lit(f"(?s)(?=([{PICKS}].{{{SHINGLE - 1}}}))."), F.lit(1))


def _few(line: Column) -> Column:
    return F.regexp_count(line, F.lit(f"[{PICKS}]")) < FEW


def signatures(lines: DataFrame, *by: str) -> DataFrame:
    """(by, all, copies, m0, m1, ...): the shingles of the rows (by, line), folded before anything is dealt out.

    ``all`` tells a signature of all shingles from one of picked ones; a line may have both. The minimum is the same
    however often a line stands, so rows that agree in ``by`` are one; copies tells how many. Each 64-bit hash of a
    shingle gives two values, its halves.
    """
    long_ = F.length("line")
    both = (long_ < int(SHORT / SIMILARITY) + 1) | _few(F.col("line"))
    ways = F.when(long_ < SHORT, F.array(F.lit(True))).when(both, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    parts = lines.select(*by, "line", F.explode(ways).alias("all"))
    cut = F.when(long_ < SHINGLE, F.array("line")).when(F.col("all"), _everywhere(F.col("line"))).otherwise(_picked(F.col("line")))
    parts = parts.select(*by, "all", F.posexplode(cut).alias("at", "shingle")).select(*by, "all", (F.col("at") == 0).alias("first"), F.xxhash64("shingle").alias("h"))
    hashed = parts.select(*by, "all", "first", *[F.xxhash64(F.col("h").bitwiseXOR(F.lit(_key(i)))).alias(f"g{i}") for i in range(VALUES // 2)])
    halves = [half for i in range(VALUES // 2) for half in (F.shiftright(f"g{i}", 32), F.shiftright(F.shiftleft(f"g{i}", 32), 32))]
    return hashed.groupBy(*by, "all").agg(F.count_if("first").alias("copies"), *[F.min(half.cast("int")).alias(f"m{i}") for i, half in enumerate(halves)])


MINIMA = [f"m{i}" for i in range(VALUES)]


def bands(signed: DataFrame) -> Column:
    """Value i, i + 2 and i + 6 make band i."""
    return F.array(*[F.xxhash64(F.lit(b), *[f"m{(b + r) % VALUES}" for r in BAND]) for b in range(VALUES)])


def _agree(a: str, b: str) -> Column:
    """Whether two signatures (prefixes of columns) agree often enough to compare their lines."""
    return sum((F.col(f"{a}{m}") == F.col(f"{b}{m}")).cast("int") for m in MINIMA) >= LEAST_AGREEING


def _agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b): the nodes of those pairs of signatures (a, b) that agree often enough."""
    side = lambda key, node, prefix: signed.select(F.col("sign").alias(key), F.col("node").alias(node), *_filled(MINIMA, prefix))
    near = pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b").where(_agree("x", "y") & (F.col("na") != F.col("nb")))
    return near.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(uid, removed): the line numbers (from 0) that go, for documents that lose any."""
    lines = _lines(docs, text_col).select(normal(F.col("line")).alias("line")).where("line <> ''").select(_hash("line").alias("hash"), "line")
    signed = signatures(lines.select("hash.x", "hash.y", "line"), "x", "y")
    signed = materialize(signed.select(F.monotonically_increasing_id().alias("sign"), F.struct("x", "y").alias("hash"), "copies", *MINIMA), "signed")
    # a line is a node, named by the least of its signatures
    nodes = materialize(signed.groupBy("hash").agg(F.min("sign").alias("node"), F.max("sign").alias("twin"), F.min("copies").alias("copies")), "nodes")
    twins = nodes.where("node < twin").select(F.col("twin").alias("sign"), "node")
    signed = signed.drop("hash", "copies").join(twins, "sign", "left").withColumn("node", F.coalesce("node", "sign"))

    # dealt out by band once; the greatest and the least signature of a band are an aggregate of the same partitions. Both
    # sides need all columns: if one has more, Spark deals the rows out twice
    banded = signed.select("sign", F.explode(bands(signed)).alias("band")).repartition("band")
    ends = banded.groupBy("band").agg(F.min("sign").alias("lo"), F.max("sign").alias("hi")).where("lo < hi")
    met = materialize(banded.join(ends.hint("merge"), "band"), "met")
    signed = materialize(signed.join(met.select("sign").distinct(), "sign", "left_semi"), "signed")
    text = materialize(lines.join(nodes.join(signed.select("node").distinct(), "node", "left_semi").select("node", "hash"), "hash").groupBy("node").agg(F.first("line").alias("line")), "text")

    sketched = materialize(sketches(text), "sketches")

    def alike(near: DataFrame, sketch: bool = True) -> DataFrame:
        """The pairs (a, b) of nodes whose sets are similar enough; unless their sketches have been compared."""
        if sketch:
            near = near.join(_side(sketched, "a", "x"), "a").join(_side(sketched, "b", "y"), "b").where(_within("x", "y", similarity)).select("a", "b")
        near = materialize(near, "pairs")
        sided = near.join(text.select(F.col("node").alias("a"), F.col("line").alias("la")), "a").join(text.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b")
        links = materialize(sided.where(_similar("la", "lb", similarity)).select("a", "b"), "links")
        drop(near)
        return links

    forest = None

    def joined(more: DataFrame) -> DataFrame:
        """(node, root) of all links so far: what was joined before is a forest, and only ``more`` is new to it."""
        nonlocal forest
        forest = materialize(components(more if forest is None else edges(forest).unionByName(more)), "roots")
        return forest

    pairs = met.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("sign").alias("b")), F.struct(F.col("sign").alias("a"), F.col("hi").alias("b")))).alias("p")).select("p.*").where("a < b").distinct()
    links = alike(_agreeing(pairs, signed))
    for turn in range(TURNS):
        open_ = _open(met, signed, joined(links))
        links = alike(_agreeing(_tries(open_, turn), signed))
        drop(open_)
    links = alike(_rest(_open(met, signed, joined(links)), signed, sketched, similarity), sketch=False)
    drop(met, text, sketched, signed)
    roots = joined(links)

    # the places of lines that stand more than once or are in a component; all go but its first
    grouped = nodes.join(roots, "node", "left").where("copies > 1 or root is not null").select("hash", F.coalesce("root", "node").alias("root"))
    places = _lines(with_key(docs, id_col, text_col), text_col, "uid", F.col(id_col).alias("id")).withColumn("line", normal(F.col("line")))
    places = materialize(places.select(_hash("line").alias("hash"), "uid", "id", "no").join(grouped, "hash").select("root", "uid", "id", "no"), "places")
    first = places.groupBy("root").agg(F.min(F.struct("id", "uid", "no")).alias("stays"))
    gone = places.join(first, "root").where(F.struct("id", "uid", "no") != F.col("stays")).groupBy("uid").agg(F.collect_set("no").alias("removed"))
    return materialize(gone, "removed")


def _open(met: DataFrame, signed: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of the bands that hold several components, with the band's size, its main component and that one's size.

    Of up to three nodes the first and the last were compared with all, so such bands have no untested pair.
    """
    rooted = signed.select("sign", "node").join(roots, "node", "left").select("sign", F.coalesce("root", "node").alias("root"))
    placed = met.select("band", "sign").join(rooted, "sign")
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("band").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("all")).where("most < all and all > 3")
    return materialize(placed.join(main, "band"), "open")


def _tries(open_: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of signatures: each outside its band's main component with up to TRIES of it and TRIES others."""
    rows = open_.select("band", "sign", (F.col("root") != F.col("main")).alias("outside"))
    order = F.xxhash64(F.lit(turn), "sign")
    picked = rows.groupBy("band", "outside", F.pmod(order, F.lit(TRIES)).alias("slot")).agg(F.min_by("sign", F.struct(order, "sign")).alias("pick"))
    tries = rows.where("outside").select("band", "sign").join(picked.select("band", "pick"), "band").where("sign <> pick")
    return tries.select(F.least("sign", "pick").alias("a"), F.greatest("sign", "pick").alias("b")).distinct()


def _rest(open_: DataFrame, signed: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes outside a band's main component and the band's nodes of other components that agree, in values and in sketches.

    The asking signatures are dealt into blocks, and so are all of the band; every block of the one meets every block of
    the other in a place of its own, and a pair that does not agree never leaves the join.
    """
    rows = open_.withColumns({"asking": F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"), "asked": F.ceil(F.col("all") / BLOCK).cast("int"), "outside": F.col("root") != F.col("main")})
    rows = rows.join(signed, "sign").join(sketched, "node")
    spread = lambda n: F.pmod(F.xxhash64("sign"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda prefix: _filled((*MINIMA, *SKETCH), prefix)
    asks = rows.where("outside").select("band", F.col("node").alias("na"), F.col("root").alias("ra"), spread("asking").alias("q"), every("asked").alias("m"), *side("x"))
    asked = rows.select("band", F.col("node").alias("nb"), F.col("root").alias("rb"), "outside", every("asking").alias("q"), spread("asked").alias("m"), *side("y"))
    apart = (F.col("ra") != F.col("rb")) & (~F.col("outside") | (F.col("na") < F.col("nb")))
    return asks.join(asked, ["band", "q", "m"]).where(apart & _within("x", "y", similarity) & _agree("x", "y")).select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()


#: A sketch: the size of a line's set, and the words of its bits.
SKETCH = ["size", *[f"s{i}" for i in range(WORDS)]]


def sketches(text: DataFrame) -> DataFrame:
    """(node, *SKETCH) of the rows (node, line): every shingle of the line's set flips the bit that its hash names."""
    hashed = text.select("node", F.explode(_set("line")).alias("shingle")).select("node", F.xxhash64("shingle").alias("h"))
    bits = hashed.select("node", F.col("h").bitwiseAND(F.lit(WORDS - 1)).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))").alias("bit"))
    return bits.groupBy("node").agg(F.count("*").cast("int").alias("size"), *[F.bit_xor(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"s{i}") for i in range(WORDS)])


def _side(sketched: DataFrame, key: str, prefix: str) -> DataFrame:
    return sketched.select(F.col("node").alias(key), *_filled(SKETCH, prefix))


def _filled(columns, prefix: str) -> list[Column]:
    """The columns under names with a prefix, as never null: a condition on many nullable ones is a method too large for the JVM to compile."""
    return [F.coalesce(c, F.lit(0)).alias(prefix + c) for c in columns]


def _within(a: str, b: str, similarity: float) -> Column:
    """Whether the sets of two sketches (prefixes of columns) may be similar enough.

    Of two sets of n and m elements that are similar by j, at most (n + m) * (1 - j) / (1 + j) elements are in one alone,
    and the smaller is at least j times the larger.
    """
    n, m = F.col(f"{a}size"), F.col(f"{b}size")
    apart = sum(F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(WORDS))
    return (F.least(n, m) >= similarity * F.greatest(n, m)) & (apart * (1 + similarity) <= (n + m) * (1 - similarity) + 1e-6)


def _similar(a: str, b: str, similarity: float) -> Column:
    """Whether the sets of two lines are alike; the sets are bound, so that they are cut once, and compared by size first."""

    def enough(both: Column) -> Column:
        n, m = F.size(both["x"]), F.size(both["y"])
        shared = F.exists(F.array(F.size(F.array_intersect(both["x"], both["y"]))), lambda k: k >= similarity * (n + m - k))
        return (F.least(n, m) >= similarity * F.greatest(n, m)) & shared

    return F.exists(F.array(F.struct(_set(a).alias("x"), _set(b).alias("y"))), enough)


def _lines(docs: DataFrame, text_col: str, *others) -> DataFrame:
    return docs.select(*others, F.posexplode(F.split(text_col, "\n")).alias("no", "line"))


def _hash(*columns: str) -> Column:
    """128 bits."""
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("x"), F.xxhash64(F.lit(2), *columns).alias("y"))


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``uid`` of a row: 128 bits of its id and text."""
    return docs.withColumn("uid", _hash(id_col, text_col))


def _set(line: str) -> Column:
    """A line's distinct shingles."""
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(F.array_distinct(_everywhere(F.col(line))))


def _key(i: int) -> int:
    """The constant of hash function i, of 64 bits (as Spark's signed long)."""
    x = (i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x ^= x >> 27
    return x - (1 << 64) if x >> 63 else x


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with ``text`` less its duplicate lines, and n_lines and n_removed (clashing input columns give way)."""
    docs = docs.drop("n_lines", "n_removed", "uid", "_removed")
    gone = removals(docs, id_col=id_col, text_col=text_col, similarity=similarity)
    joined = with_key(docs, id_col, text_col).join(gone.withColumnRenamed("removed", "_removed"), "uid", "left")
    cut = F.split(text_col, "\n")
    kept = F.array_join(F.filter(cut, lambda x, i: ~F.array_contains("_removed", i)), "\n")
    return joined.withColumns({"n_lines": F.coalesce(F.size(cut), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("_removed"), F.lit(0)).cast("long")}).withColumn(text_col, F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(kept)).drop("uid", "_removed")


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (same columns, whatever their names) with ``text`` less its duplicate lines."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_rest"))
    out = dedup(packed, similarity=similarity)
    return out.select(*[F.col("doc_id").alias(c) if c == id_col else F.col("text").alias(c) if c == text_col else F.col(f"_rest.`{c}`") for c in docs.columns])
