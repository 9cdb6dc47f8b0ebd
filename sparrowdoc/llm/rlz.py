"""Substring dedup by relative Lempel-Ziv parsing: documents are factored greedily against indexed reference blocks.

Every window of ``window`` words belongs to the block of its core, the words that stand at its sampled place (of its first
``width`` grams the least by hash), so equal windows meet in one block wherever they stand. Cores that occur once hold no
repeat and are left out by a count. The others are dealt out with their contexts, the words of all windows of a place;
contexts that are equal travel once from a task. A block's task parses its contexts one after the other: the window at
hand is looked up in the index of the block's reference; a hit is extended word by word to the longest match, a factor
(source, length), and parsing goes on at the first window beyond the factor's end, so that windows across two factors
are looked up on their own; windows that the reference does not hold are added to it. Words are compared throughout.
Factors of ``window`` words or more are duplicate spans of document and source alike.

A core with ``HOT`` places or more is dealt out by window instead of by core: its contexts are cut into single windows,
which meet by their words' hash, so no task gets such a core whole; a window's occurrences stream through, one is held.

Defined cases: a null or empty text has no words; texts under ``window`` words lose nothing; rows that repeat are
documents of their own, so each is a duplicate of the other; null ids are ids; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as H
from .common import drop, materialize, slices

WINDOW, GRAM, WIDTH = 35, 6, 24
#: Places from which a core is dealt out by window.
HOT = 20_000
#: Bytes of contexts that a task holds to join equal ones.
HELD_BYTES = 16 << 20
PLACES = "core long, uid binary, lo int, n int"
CONTEXTS = "block long, context binary, uids binary, at binary"
SPANS = "uid binary, lo int, hi int, source binary, source_at int"


def with_uid(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row's key: 128 bits of its id and text. Rows that agree in both get the same spans, so they may share it."""
    return docs.withColumn("uid", F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("\x1e")), F.col(text_col)).cast("binary"))))


def _places(text_col: str, window: int, gram: int, width: int):
    """The windows of a slice, by the core at their sampled place: first window ``lo`` (in words) and how many follow."""
    core = window - width + 1

    def run(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                texts = [t.encode() if t else b"" for t in b.column(text_col).to_pylist()]
                data, offsets = H.joined(texts)
                starts, ends = H.words(data)
                n = len(starts) - window + 1
                if n <= 0:
                    continue
                sums = H.prefix(H.ranges(H.prefix(H.BYTES[data]), starts, ends))
                owner = H.owners(H.windows(sums, gram), width)[:n]
                doc = np.searchsorted(offsets, starts, "right") - 1
                first = np.searchsorted(starts, offsets[:-1], "left")
                valid = doc[:n] == doc[window - 1 :]
                change = np.ones(n, bool)
                change[1:] = (owner[1:] != owner[:-1]) | (doc[1:n] != doc[: n - 1]) | (valid[1:] != valid[:-1])
                lo = np.flatnonzero(change)
                hi = np.append(lo[1:], n)
                lo, hi = lo[valid[lo]], hi[valid[lo]]
                at = owner[lo]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(H.ranges(sums, at, at + core).view(np.int64)), b.column("uid").take(pa.array(doc[lo])), pa.array((lo - first[doc[lo]]).astype(np.int32)), pa.array((hi - lo).astype(np.int32))],
                    names=["core", "uid", "lo", "n"],
                )

    return run


def _contexts(text_col: str, window: int):
    """Contexts of the listed places, equal ones of a core joined; those of hot cores window by window."""

    def flush(held: dict):
        keys = list(held)
        members = [held[k] for k in keys]
        uids = [b"".join(u for u, _ in m) for m in members]
        at = [np.array([p for _, p in m], "<i4").tobytes() for m in members]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), pa.array(uids, pa.binary()), pa.array(at, pa.binary())], names=["block", "context", "uids", "at"])

    def run(batches):
        held: dict[tuple[int, bytes], list] = {}
        size = 0
        for b in batches:
            for text, uid, places in zip(b.column(text_col).to_pylist(), b.column("uid").to_pylist(), b.column("places").to_pylist(), strict=True):
                ws = text.encode().split()
                for p in places:
                    lo, n = p["lo"], p["n"]
                    for start, many in ((k, 1) for k in range(lo, lo + n)) if p["hot"] else ((lo, n),):
                        context = b" ".join(ws[start : start + many - 1 + window])
                        block = xxhash.xxh3_64_intdigest(context) - (1 << 63) if p["hot"] else p["core"]
                        members = held.get((block, context))
                        if members is None:
                            members = held[block, context] = []
                            size += len(context) + 200
                        members.append((uid, start))
                        size += 60
                if size >= HELD_BYTES:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return run


class Reference:
    """A block's reference: contexts so far, and where each of their distinct windows stands."""

    def __init__(self, window: int):
        self.window = window
        self.index: dict[bytes, tuple[int, int]] = {}
        self.words: list[list[bytes]] = []
        self.places: list[tuple[bytes, int]] = []

    def parse(self, context: bytes, place: tuple[bytes, int]) -> list[tuple[int, int, int, int]]:
        """Factors (start, end, source number, source start) of a context, whose other windows become reference."""
        window, index = self.window, self.index
        words = context.split(b" ")
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        number = len(self.words)
        self.words.append(words)
        self.places.append(place)
        out, i, last = [], 0, len(words) - window
        while i <= last:
            key = context[ends[i - 1] if i else 0 : ends[i + window - 1] - 1]
            source, at = index.setdefault(key, (number, i))
            if source == number and at == i:
                i += 1
                continue
            theirs, length = self.words[source], window
            most = min(len(words) - i, len(theirs) - at)
            while length < most and words[i + length] == theirs[at + length]:
                length += 1
            out.append((i, i + length, source, at))
            i += length - window + 1
        return out


def _parse(window: int):
    """Rows sorted by block to spans, each with the place of another occurrence."""

    def run(batches):
        block, reference, rows = None, Reference(window), []

        def batch():
            uid, lo, hi, source, at = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(uid, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(source, pa.binary()), pa.array(at, pa.int32())], names=["uid", "lo", "hi", "source", "source_at"])

        for b in batches:
            for key, context, uids, at in zip(*(b.column(c).to_pylist() for c in ("block", "context", "uids", "at")), strict=True):
                if key != block:
                    block, reference = key, Reference(window)
                places = [*zip((uids[i : i + 16] for i in range(0, len(uids), 16)), np.frombuffer(at, "<i4").tolist(), strict=True)]
                factors_ = reference.parse(context, places[0])
                if len(places) > 1:  # all windows of a context that stands twice are repeats
                    n = context.count(b" ") + 1
                    for (uid, p), (other, q) in zip(places, [*places[1:], places[0]], strict=True):
                        rows.append((uid, p, p + n, other, q))
                uid, p = places[0]
                for lo, hi, source, start in factors_:
                    other, q = reference.places[source]
                    if len(places) == 1:
                        rows.append((uid, p + lo, p + hi, other, q + start))
                    rows.append((other, q + start, q + start + hi - lo, uid, p + lo))
                if len(rows) >= 20_000:
                    yield batch()
        if rows:
            yield batch()

    return run


def factors(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, each taken as far as it and those that overlap or touch it reach."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def parse(docs: DataFrame, *, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """Factors of documents (uid, text): (uid, lo, hi, source, source_at), spans of words and where they stand too."""
    places = docs.select("uid", text_col).mapInArrow(_places(text_col, window, gram, width), PLACES)
    counts = places.groupBy("core").agg(F.count("*").alias("many")).where("many > 1")
    shared = materialize(places.join(counts, "core").select("core", "uid", "lo", "n", (F.col("many") >= hot).alias("hot")), "places")
    lists = shared.groupBy("uid").agg(F.collect_set(F.struct("core", "lo", "n", "hot")).alias("places"))
    contexts = docs.select("uid", text_col).join(lists, "uid").mapInArrow(_contexts(text_col, window), CONTEXTS)
    found = materialize(contexts.repartition("block").sortWithinPartitions("block").mapInArrow(_parse(window), SPANS), "factors")
    drop(shared)
    return found


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` (with ``uid``) and ``spans``: (lo, hi) word spans of repeated windows, unordered; null for none."""
    keyed = with_uid(docs, id_col, text_col)
    spans = parse(keyed, text_col=text_col, **options)
    return keyed.join(spans.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "uid", "left")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_words, n_removed, kept (remaining words joined by one space) and factors (flat word spans)."""
    found = find(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options)
    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("factors", T.ArrayType(T.LongType()))])

    def run(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                total, removed, kept, flat = [], [], [], []
                for text, spans in zip(b.column(text_col).to_pylist(), b.column("spans").to_pylist(), strict=True):
                    ws = text.encode().split() if text else []
                    total.append(len(ws))
                    own = factors([(s["lo"], s["hi"]) for s in spans]) if spans else []
                    for lo, hi in reversed(own):
                        del ws[lo:hi]
                    removed.append(total[-1] - len(ws))
                    kept.append(b" ".join(ws).decode())
                    flat.append([x for f in own for x in f])
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(flat, pa.list_(pa.int64()))], names=schema.names)

    return found.select(id_col, text_col, "spans").mapInArrow(run, schema)
