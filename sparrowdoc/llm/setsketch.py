"""Near-duplicate documents: SetSketch registers, banded, compared by likelihood, verified on full sets.

A document's set is its distinct five-word shingles (A-Z lower-cased; with fewer words, the whole sequence). A register
keeps the least of exponentially distributed hashes on an exponential scale, truncated to 16 bits: registers of a union
are the larger of two, and equal registers tell of shared elements. Documents with one set are one node. Nodes meet in
bands of neighbouring registers. In each band every node is compared with the band's least node first, by the joint
maximum-likelihood estimate of the Jaccard similarity; then nodes outside a band's main component with a few nodes of
it. Only nodes that are still outside are compared with all nodes of their band, in blocks. Every link is confirmed on
the full sets; distributed union-find joins the links.

Defined cases: null, empty and wordless texts have an empty set, link with nothing and stay; rows with equal sets form
one group, also where ids repeat; null ids take part, but never name a component.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as H
from .common import drop, materialize, slices
from .components import components, edges
from .rlz import with_uid

SHINGLE, REGISTERS, BAND = 5, 128, 4
SCALE, RATE = 1.001, 20.0
#: Similarity in hundredths, and the estimate from which a pair is verified: about four standard errors below.
PERCENT, LEAST_ESTIMATE = 75, 0.6
#: Nodes of a band that one task compares with as many others.
BLOCK = 2048
#: Turns in which nodes outside a band's main component are tried on so many of its nodes.
TURNS, CENTRES = 2, 3

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KEYS = H.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_FACTORS = H.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [t.encode().translate(_LOWER) if t else b"" for t in texts]
    data, offsets = H.joined(raw)
    starts, ends = H.words(data)
    units = H.ranges(H.prefix(H.BYTES[data]), starts, ends)
    sums = H.prefix(units)
    grams = H.windows(sums, size)
    first = np.searchsorted(starts, offsets)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        elif hi > lo:
            out.append(H.ranges(sums, np.array([lo]), np.array([hi])) ^ np.uint64(hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit registers for each set that isn't empty."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, REGISTERS), np.uint16)
    flat = np.concatenate(full)
    at = np.zeros(len(full), np.int64)
    np.cumsum([len(s) for s in full[:-1]], out=at[1:])
    least = np.empty((len(full), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat((flat ^ _KEYS[i]) * _FACTORS[i], at)
    u = ((least >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    x = -np.log1p(-u) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(SCALE)), 0, 65535).astype(np.uint16)


def joint_estimate(more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, given how many registers are larger, how many smaller, and both sizes."""
    n1, n2 = np.asarray(n1, float), np.asarray(n2, float)
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    equal = REGISTERS - more - less

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE), 1e-12, 1)

    def likelihood(j):
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + equal * np.log(np.clip(1 - a - b, 1e-12, 1))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(30):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(a) < likelihood(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


SKETCH = "uid binary, node binary, n int, registers binary"


def _sketch(text_col: str):
    def run(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                sets = shingle_sets(b.column(text_col).to_pylist())
                full = iter(registers(sets))
                nodes, regs = [], []
                for s in sets:
                    nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    regs.append(next(full).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(regs, pa.binary())], names=["uid", "node", "n", "registers"])

    return run


def _bands(batches):
    bands = REGISTERS // BAND
    salt = H.mix(np.arange(1, bands + 1, dtype=np.uint64))
    for b in batches:
        if not b.num_rows:
            continue
        r = np.frombuffer(b"".join(b.column("registers").to_pylist()), np.uint16).reshape(-1, bands, BAND)
        packed = np.ascontiguousarray(r).view(np.uint64)[:, :, 0]
        keys = H.mix(packed ^ salt).view(np.int64).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(keys), b.column("node").take(pa.array(np.repeat(np.arange(b.num_rows), bands)))], names=["band", "node"])


def _meet(batches):
    """Rows sorted by band and node: (band, node, centre) of the bands with several nodes; the centre has itself."""
    band = centre = first = None
    for b in batches:
        out = []
        for k, node in zip(b.column("band").to_pylist(), b.column("node").to_pylist(), strict=True):
            if k != band:
                band, centre, first = k, node, True
                continue
            if first:
                out.append((k, centre, centre))
                first = False
            out.append((k, node, centre))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["band", "node", "centre"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(batches):
    """Pairs whose estimate is high enough."""
    for b in batches:
        if not b.num_rows:
            continue
        x, y = _matrix(b.column("ra")), _matrix(b.column("rb"))
        j = joint_estimate((x > y).sum(1), (x < y).sum(1), b.column("na").to_numpy(), b.column("nb").to_numpy())
        keep = pa.array(np.flatnonzero(j >= LEAST_ESTIMATE))
        yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], names=["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _compare(percent: int):
    """Links between a block of a band's open nodes and a block of all its nodes.

    A pair is looked at in the first band that it shares, and only while its nodes are in different components; what
    passes the estimate is verified here, so that no pair leaves the task but links that join two components.
    """

    def run(key, table):
        table = table.combine_chunks()
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        packed = np.ascontiguousarray(regs).view(np.uint64)
        here = H.mix(packed ^ H.mix(np.arange(1, packed.shape[1] + 1, dtype=np.uint64)))[0].view(np.int64).tolist().index(key[0].as_py())
        node, n = table.column("node").to_pylist(), table.column("n").to_numpy()
        root = table.column("root").to_pylist()
        parent = {r: r for r in root}

        def find(r):
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        unpack = zstandard.ZstdDecompressor()
        sets = shingle_sets([unpack.decompress(t).decode() for t in table.column("text").to_pylist()])
        asks, is_asked = table.column("asks").to_numpy(zero_copy_only=False), table.column("is_asked").to_numpy(zero_copy_only=False)
        others = np.flatnonzero(is_asked)
        found = []
        for i in np.flatnonzero(asks).tolist():
            mine = find(root[i])
            some = others[(n[others] * 100 >= percent * n[i]) & (n[i] * 100 >= percent * n[others])]
            if here:
                some = some[~(packed[some, :here] == packed[i, :here]).any(1)]
            some = some[(regs[some] == regs[i]).sum(1) >= REGISTERS * (LEAST_ESTIMATE - 0.2)]
            some = np.array([o for o in some.tolist() if find(root[o]) != mine], np.int64)
            if not len(some):
                continue
            j = joint_estimate((regs[some] < regs[i]).sum(1), (regs[some] > regs[i]).sum(1), np.full(len(some), n[i]), n[some])
            for o in some[np.argsort(-j)][: int((j >= LEAST_ESTIMATE).sum())].tolist():
                if find(root[o]) != find(root[i]) and _linked(sets[i], sets[o], percent):
                    found.append((min(node[i], node[o]), max(node[i], node[o])))
                    parent[find(root[o])] = find(root[i])
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return lambda key, table: run(key, table)


def _pack(text_col: str):
    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array([press.compress(t.encode()) if t else None for t in b.column(text_col).to_pylist()], pa.binary())], names=["uid", "text"])

    return run


def _verify(percent: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for whole in batches:
            for b in slices(whole, "tb"):
                rows = [*zip(*(b.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True)]
                names = list(dict.fromkeys(x for r in rows for x in r[:2]))
                texts = {}
                for a, o, ta, tb in rows:
                    texts[a], texts[o] = ta, tb
                sets = dict(zip(names, shingle_sets([unpack.decompress(texts[k]).decode() for k in names]), strict=True))
                keep = []
                for a, o, _, _ in rows:
                    keep.append(_linked(sets[a], sets[o], percent))
                at = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], names=["a", "b"])

    return run


PAIR = "a binary, b binary"


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """uid, id, n_shingles, component_id (the least id of the component), kept and leader, one row for each document.

    ``leader`` is the uid of the component's first row, by id (null ids last) and uid: it is one text also where ids repeat.
    """
    keyed = with_uid(docs.select(id_col, text_col), id_col, text_col)
    sketch = materialize(keyed.select("uid", text_col).mapInArrow(_sketch(text_col), SKETCH), "sketch")
    full = sketch.where("node is not null")
    nodes = materialize(full.groupBy("node").agg(F.min("uid").alias("uid"), F.first("n").alias("n"), F.first("registers").alias("registers")), "nodes")
    bands = nodes.select("node", "registers").mapInArrow(_bands, "band long, node binary")
    members = materialize(bands.repartition("band").sortWithinPartitions("band", "node").mapInArrow(_meet, "band long, node binary, centre binary"), "members")

    met = members.select("node").distinct()
    wanted = nodes.join(met, "node", "left_semi").select("uid", "node")
    packed = keyed.select("uid", text_col).mapInArrow(_pack(text_col), "uid binary, text binary")
    texts = materialize(packed.dropDuplicates(["uid"]).join(wanted, "uid").select("node", "text"), "texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough; texts are dealt by b first, then meet a's."""
        sided = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        return materialize(sided.mapInArrow(_verify(percent), PAIR), name)

    one, other = nodes.select(F.col("node").alias("a"), F.col("registers").alias("ra"), F.col("n").alias("na")), nodes.select(F.col("node").alias("b"), F.col("registers").alias("rb"), F.col("n").alias("nb"))
    stars = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tested = materialize(stars.join(one, "a").join(other, "b").mapInArrow(_likely, PAIR), "stars")
    links = verified(tested, "links")

    def open_nodes(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes of the bands that hold several components, and for each such band its size and main component."""
        placed = members.select("band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = placed.groupBy("band", "root").agg(F.count("*").alias("size"))
        main = sizes.groupBy("band").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("all"), F.count("*").alias("roots"), F.max("size").alias("most")).where("roots > 1")
        return placed.join(main, "band"), main

    forest = None

    def joined(more: DataFrame) -> DataFrame:
        """(node, root) of all links so far: what was joined before is a forest, and only ``more`` is new to it."""
        nonlocal forest
        forest = materialize(components(more if forest is None else edges(forest).unionByName(more)), "roots")
        return forest

    for turn in range(TURNS):
        # each node outside its band's main component is tried on a few of that component, the same ones in all bands
        placed, _ = open_nodes(joined(links))
        order = Window.partitionBy("band").orderBy(F.xxhash64(F.lit(turn), "node"), "node")
        centres = placed.where("root = main").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CENTRES).select("band", F.col("node").alias("centre"))
        tries = placed.where("root <> main").select("band", "node").join(centres, "band").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        tries = materialize(tries.join(tested, ["a", "b"], "left_anti").join(one, "a").join(other, "b").mapInArrow(_likely, PAIR), "tries")
        links, tested = verified(tries, "links"), tested.unionByName(tries)

    placed, _ = open_nodes(joined(links))
    outside = F.col("root") != F.col("main")
    rows = placed.withColumns({"asked": F.ceil(F.col("all") / BLOCK).cast("int"), "asking": F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")})
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    pair = lambda q, m, asks, asked: F.struct(q.alias("q"), m.alias("m"), F.lit(asks).alias("asks"), F.lit(asked).alias("is_asked"))
    as_asked = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda q: pair(q, spread(F.col("asked")), False, True))
    as_asking = F.transform(F.sequence(F.lit(0), F.col("asked") - 1), lambda m: pair(spread(F.col("asking")), m, True, False))
    rows = rows.select("band", "node", "root", F.explode(F.when(outside, F.concat(as_asked, as_asking)).otherwise(as_asked)).alias("p")).select("band", "node", "root", "p.*")
    rows = rows.groupBy("band", "node", "root", "q", "m").agg(F.max("asks").alias("asks"), F.max("is_asked").alias("is_asked"))
    rows = rows.join(nodes.select("node", "n", "registers"), "node").join(texts, "node")
    roots = joined(materialize(rows.groupBy("band", "q", "m").applyInArrow(_compare(percent), PAIR), "links"))

    rows = keyed.select("uid", id_col).join(sketch.select("uid", "node", F.col("n").cast("long").alias("n_shingles")).dropDuplicates(["uid"]), "uid")
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "uid"))
    least = rows.where("root is not null").groupBy("root").agg(first.alias("_first"))
    out = rows.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col(id_col)).otherwise(F.col("_first.id")))
    return out.select("uid", id_col, "n_shingles", "component_id", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)).alias("kept"), F.coalesce("_first.uid", "uid").alias("leader"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` (same columns) with one row of each component, its leader's; texts without words stay.

    Of rows that agree in id and text one stays, whichever it is where they differ in other columns.
    """
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent)
    marks = groups.where(F.col("n_shingles") > 0).select(F.col("uid").alias("_uid"), (F.col("uid") == F.col("leader")).alias("_leads")).distinct()
    keyed = with_uid(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    rows = keyed.join(marks, F.col("uid") == F.col("_uid"), "left").where(F.coalesce("_leads", F.lit(True)))
    blank, words = rows.where("_leads is null"), rows.where("_leads")
    return blank.select("_row.*").unionByName(words.dropDuplicates(["uid"]).select("_row.*"))
