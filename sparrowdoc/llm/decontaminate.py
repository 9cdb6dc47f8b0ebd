"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

The automaton holds every word sequence of the items of one chunk; a document's words stream through it and the
state tells the longest item sequence that ends at each word. A window is ``window`` consecutive item words, or a whole
item that has fewer. Document words inside an occurrence of a window are hit.

Defined cases: a null or empty text has no words; null or wordless items have no window; items with one text
all count, each by its own id (a null id reads ``null``); an id that repeats counts once; empty tables give no hits.
``clean`` drops documents whose hit words exceed ``max_coverage`` of all words; others lose the hit spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, long, materialize

WINDOW = 10
#: Bytes of item text in one automaton; further items get automata of their own, one pass each.
CHUNK_BYTES = 8 << 20
#: Share of hit words beyond which ``clean`` drops a document.
MAX_COVERAGE = 0.5

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A-Z to lower case, every byte that ends a word to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.items = [(k, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for k, ws in items if ws]
        self.least = min((min(window, len(ws)) for _, ws in self.items), default=window)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ws in self.items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self._outputs()

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state of p's sequence with w alone: q itself, or q's shorter part as a state of its own."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    def _outputs(self) -> None:
        """ends[state]: (window length, item ids) for the windows that end where the state's sequences end."""
        own: dict[int, dict[int, set[str]]] = {}
        for key, ws in self.items:
            n, state, length = min(self.window, len(ws)), 0, 0
            for w in ws:
                state, length = self.next[state][w], length + 1
                if length >= n:
                    at = state
                    while self.length[self.link[at]] >= n:
                        at = self.link[at]
                    own.setdefault(at, {}).setdefault(n, set()).add(key)
        self.ends: list[list[tuple[int, frozenset]]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            mine = [(n, frozenset(ids)) for n, ids in own.get(s, {}).items()]
            self.ends[s] = mine + self.ends[self.link[s]] if mine else self.ends[self.link[s]]

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans [start, end) of occurring windows, joined where they touch or overlap, and the items."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if len(ws) < self.least or not self.items:
            return spans, found
        ids = list(map(self.vocabulary.get, ws))
        run = 0
        edges, link, length, ends = self.next, self.link, self.length, self.ends
        for at, w in enumerate(ids):
            if w is not None:
                run += 1
                continue
            if run >= self.least:
                self._stream(ids, at - run, at, spans, found, edges, link, length, ends)
            run = 0
        if run >= self.least:
            self._stream(ids, len(ids) - run, len(ids), spans, found, edges, link, length, ends)
        return spans, found

    def _stream(self, ids, start, end, spans, found, edges, link, length, ends) -> None:
        state = matched = 0
        for i in range(start, end):
            w = ids[i]
            while state and w not in edges[state]:
                state = link[state]
                matched = length[state]
            if w in edges[state]:
                state = edges[state][w]
                matched += 1
            longest = 0
            for n, keys in ends[state]:
                if n <= matched:
                    found |= keys
                    longest = max(longest, n)
            if longest:
                lo = i + 1 - longest
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append((lo, i + 1))


def chunks(items: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in parts of about ``chunk_bytes`` of text, dealt by hash; the driver holds one part at a time."""
    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("key"), F.col(text_col).alias("text"))
    total, n = named.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = max(1, min(n, -(-(total or 0) // chunk_bytes)))
    for part in range(parts):
        mine = named if parts == 1 else named.where(F.pmod(F.xxhash64("key", "text"), F.lit(parts)) == part)
        yield [(key, words(text)) for key, text in mine.collect()]


def find(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (word spans, flat start, end pairs) and hit_items (sorted ids).

    One pass for each part of the items; what a pass finds is written to the shared folder before the next part is read,
    so neither the driver nor a task holds two.
    """
    spark = docs.sparkSession
    fields = [long("n_words"), T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    out = shared = None
    for part in chunks(items, item_id, item_text, chunk_bytes):
        first = out is None
        if not first:
            done = materialize(out, "hits")
            shared.unpersist()
            out = done.withColumnRenamed("hit_spans", "_spans").withColumnRenamed("hit_items", "_items")
        shared = spark.sparkContext.broadcast(part)

        def factory(shared=shared):
            automaton = getattr(shared, "automaton", None)  # a worker builds it once, not once a task
            if automaton is None:
                automaton = shared.automaton = Automaton(shared.value, window)

            def kernel(texts):
                counts, spans, keys = [], [], []
                for t in texts:
                    ws = words(t)
                    s, k = automaton.hits(ws)
                    counts.append(len(ws))
                    spans.append([x for p in s for x in p])
                    keys.append(sorted(k))
                return [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.string()))]

            return kernel

        out = annotate(docs if first else out, text_col, factory, fields)
        if not first:
            # pairs of both passes, joined where they touch
            pairs = F.concat(_pairs("_spans"), _pairs("hit_spans"))
            joined = F.aggregate(F.array_sort(pairs), F.expr("cast(array() as array<bigint>)"), _join)
            out = out.withColumn("hit_spans", joined).withColumn("hit_items", F.array_sort(F.array_union("_items", "hit_items"))).drop("_spans", "_items")
    return out


def _pairs(c: str):
    """Flat start, end pairs as an array of structs."""
    halves = F.filter(F.transform(c, lambda x, i: F.struct(x.alias("lo"), F.get(F.col(c), i + 1).alias("hi"), (i % 2).alias("odd"))), lambda s: s["odd"] == 0)
    return F.transform(halves, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))


def _join(acc, s):
    n = F.size(acc)
    touching = (n > 0) & (F.get(acc, n - 1) >= s["lo"])
    merged = F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.array(F.greatest(F.get(acc, n - 1), s["hi"])))
    return F.when(touching, merged).otherwise(F.concat(acc, F.array(s["lo"], s["hi"])))


def hit_words():
    """Hit words, from hit_spans."""
    return F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    hit = hit_words()
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[int]) -> str:
    """``text`` without the words of flat ``spans`` and what stands between them; one space joins the rest."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for lo, hi in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : at[lo][0]].rstrip(" "))
        last = at[hi - 1][1]
    out.append(text[last:].lstrip(" ") if out[-1] else text[last:])
    return " ".join(x for x in out if x)


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", max_coverage: float = MAX_COVERAGE, **options) -> DataFrame:
    """``docs`` (same columns) without hit spans; documents beyond ``max_coverage`` go."""
    columns = docs.columns
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col]).alias("_rest"), text_col)
    found = find(docs, items, text_col=text_col, **options)
    ok = (F.size("hit_spans") == 0) | (hit_words() <= F.col("n_words") * max_coverage)
    found = found.where(ok)
    schema = docs.schema

    def run(batches):
        for b in batches:
            texts = b.column(text_col).to_pylist()
            spans = b.column("hit_spans").to_pylist()
            new = [cut(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            own = {"_rest": b.column("_rest"), text_col: pa.array(new, b.schema.field(text_col).type)}
            yield pa.RecordBatch.from_arrays([own[n] for n in schema.names], names=schema.names)

    out = found.select("_rest", text_col, "hit_spans").mapInArrow(run, schema)
    return out.select(*[F.col(text_col) if c == text_col else F.col(f"_rest.`{c}`") for c in columns])
