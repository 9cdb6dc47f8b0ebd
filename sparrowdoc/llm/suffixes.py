"""Suffix-array dedup: a distributed merge sort of sampled suffixes that knows common prefixes.

A window of ``window`` bytes is represented by the suffix at its sampled place: of the first ``width`` grams the least by
hash, so equal windows have it at the same distance. Places whose first ``window - width + 1`` bytes (the core, which
every window of the place covers) stand nowhere else cannot hold a repeat and are left out by a count of hashes.

Tasks sort the other suffixes into runs and exchange them front-coded: each holds the length of the prefix it shares
with the one before, and the rest. A range's task combines the runs with a loser tree that compares two suffixes only
beyond what both are known to share with the last one out. The merged order gives the prefix lengths for free;
neighbours that share the core form a group, in which the bytes on both sides of the place tell which windows repeat.

Bytes are compared; hashes only preselect places, and windows in groups of three or more texts. Copies within a run travel once, with the list of places they stand at. Defined cases: a null or empty text
has no bytes; texts under ``window`` bytes lose nothing; rows that repeat are documents of their own.
"""

from __future__ import annotations

import bisect
import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as H
from .common import drop, materialize, slices
from .rlz import factors, with_uid

WINDOW, GRAM, WIDTH = 400, 16, 256
#: Bytes of suffixes in one sorted run.
RUN_BYTES = 24 << 20
PLACES = "core long, head long, uid binary, at int, lo int, n int"


def _sample(text_col: str, window: int, gram: int, width: int):
    core = window - width + 1

    def run(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                texts = [t.encode() if t else b"" for t in b.column(text_col).to_pylist()]
                data, offsets = H.joined(texts)
                n = len(data) - window + 1
                if n <= 0:
                    continue
                sums = H.prefix(H.BYTES[data])
                owner = H.owners(H.windows(sums, gram), width)[:n]
                doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
                ends = offsets[1:] - 1  # without the newline
                at = np.arange(n)
                valid = at + window <= ends[doc[:n]]
                change = np.ones(n, bool)
                change[1:] = (owner[1:] != owner[:-1]) | (doc[1:n] != doc[: n - 1]) | (valid[1:] != valid[:-1])
                lo = np.flatnonzero(change)
                hi = np.append(lo[1:], n)
                keep = valid[lo]
                lo, hi = lo[keep], hi[keep]
                x = owner[lo]
                start = offsets[doc[lo]]
                heads = np.zeros(len(x), np.uint64)
                for k in range(8):
                    heads = (heads << np.uint64(8)) | data[x + k].astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(H.ranges(sums, x, x + core).view(np.int64)), pa.array((heads >> np.uint64(1)).astype(np.int64)), b.column("uid").take(pa.array(doc[lo])),
                        pa.array((x - start).astype(np.int32)), pa.array((lo - start).astype(np.int32)), pa.array((hi - lo).astype(np.int32)),
                    ],
                    names=["core", "head", "uid", "at", "lo", "n"],
                )

    return run


def _shared(batches):
    """Rows, sorted by core, whose core stands in another row too."""
    held = None  # the last row, while it is alone
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        core = b.column("core").to_numpy()
        same = np.zeros(len(core) + 1, bool)
        same[1:-1] = core[1:] == core[:-1]
        same[0] = last is not None and last == core[0]
        if held is not None and same[0]:
            yield held
        keep = same[:-1] | same[1:]
        if keep.any():
            yield b.take(pa.array(np.flatnonzero(keep)))
        held = None if keep[-1] else b.slice(len(core) - 1)
        last = core[-1]


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    shared, rests, before = [], [], b""
    for s in suffixes:
        k = common(before, s, 0)
        shared.append(k)
        rests.append(s[k:])
        before = s
    return shared, rests


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    while at < n:
        end = min(at + 32, n)
        if a[at:end] == b[at:end]:
            at = end
            continue
        while a[at] == b[at]:
            at += 1
        return at
    return n


def _runs(text_col: str, window: int, splits: list[int]):
    """Sorted, front-coded runs, cut at ``splits`` of the suffixes' first eight bytes."""

    def flush(held: dict) -> Iterator[tuple[int, bytes]]:
        press = zstandard.ZstdCompressor(level=3)
        by_range: dict[int, list] = {}
        for (right, left), members in sorted(held.items()):
            by_range.setdefault(bisect.bisect_right(splits, int.from_bytes(right[:8], "big") >> 1), []).append((right, left, members))
        for k, rows in by_range.items():
            shared, rests = front_code([r[0] for r in rows])
            counts = [len(r[2]) for r in rows]
            uids = b"".join(u for r in rows for u, _ in r[2])
            places = np.array([p for r in rows for _, p in r[2]], np.int32).tobytes()
            yield k, press.compress(pickle.dumps((shared, rests, [r[1] for r in rows], counts, uids, places), 5))

    def run(batches):
        held: dict[tuple[bytes, bytes], list] = {}
        size = 0
        for b in batches:
            uids = b.column("uid").to_pylist()
            for i, places in enumerate(b.column("places").to_pylist()):
                text = b.column(text_col)[i].as_py().encode()
                for p in places:
                    x, lo, n = p["at"], p["lo"], p["n"]
                    key = (text[x : lo + n - 1 + window], text[lo:x])
                    members = held.get(key)
                    if members is None:
                        members = held[key] = []
                        size += window + n + 200
                    members.append((uids[i], lo))
                    size += 40
                if size >= RUN_BYTES:
                    out = [*flush(held)]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], names=["part", "run"])
                    held, size = {}, 0
        if held:
            out = [*flush(held)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], names=["part", "run"])

    return run


def _read(run: bytes) -> Iterator[tuple[int, bytes, bytes, list]]:
    """(prefix shared with the one before, suffix, left bytes, members) of a run."""
    shared, rests, lefts, counts, uids, places = pickle.loads(zstandard.ZstdDecompressor().decompress(run))
    where = np.frombuffer(places, np.int32).tolist()
    suffix, m = b"", 0
    for k, rest, left, count in zip(shared, rests, lefts, counts, strict=True):
        suffix = suffix[:k] + rest
        yield k, suffix, left, [(uids[16 * j : 16 * j + 16], where[j]) for j in range(m, m + count)]
        m += count


class LoserTree:
    """Merges sorted runs; yields (prefix shared with the one before, suffix, left, members).

    ``known[r]``: the prefix that run r's head is known to share with the last suffix out. Of two heads, the one that
    shares more with it comes first; only equals are compared, from there on.
    """

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads: list = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.known = [0] * self.size
        self.losers = [-1] * self.size

    def _duel(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes the one it shares with the winner."""
        if self.heads[b] is None:
            return a, b
        if self.heads[a] is None:
            return b, a
        ka, kb = self.known[a], self.known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        x, y = self.heads[a][1], self.heads[b][1]
        k = common(x, y, ka)
        if k == len(x) or k < len(y) and x[k] < y[k]:
            self.known[b] = k
            return a, b
        self.known[a] = k
        return b, a

    def __iter__(self):
        if not self.runs:
            return
        level = list(range(self.size))
        node = self.size
        while len(level) > 1:
            node //= 2
            nxt = []
            for i in range(0, len(level), 2):
                win, lose = self._duel(level[i], level[i + 1])
                self.losers[node + i // 2] = lose
                nxt.append(win)
            level = nxt
        winner = level[0]
        while self.heads[winner] is not None:
            _, suffix, left, members = self.heads[winner]
            yield self.known[winner], suffix, left, members
            head = self.heads[winner] = next(self.runs[winner], None)
            self.known[winner] = head[0] if head else 0
            at = (winner + self.size) // 2
            while at:
                winner, self.losers[at] = self._duel(winner, self.losers[at])
                at //= 2


def _repeated(group: list[tuple[bytes, bytes, list]], window: int) -> Iterator[tuple[bytes, int, int]]:
    """(uid, lo, hi) of the repeated windows of a group of suffixes that share the core."""
    texts: dict[tuple[bytes, bytes], list] = {}
    for right, left, members in group:
        texts.setdefault((right, left), []).extend(members)
    if len(texts) == 1:
        ((right, left), members), = texts.items()
        if len(members) > 1:
            n = len(left) + len(right)
            for uid, lo in members:
                yield uid, lo, lo + n
        return
    if len(texts) == 2:
        (r1, l1), (r2, l2) = texts
        ahead = common(r1, r2, 0)
        behind = common(l1[::-1], l2[::-1], 0)
        for (right, left), members in texts.items():
            many = len(members) > 1
            lo, hi = (0, len(left) + len(right)) if many else (len(left) - behind, len(left) + ahead)
            if hi - lo >= window:
                for uid, place in members:
                    yield uid, place + lo, place + hi
        return
    keys = list(texts)
    joined = [left + right for right, left in keys]
    counts = np.array([len(t) - window + 1 for t in joined])
    offsets = [len(left) for _, left in keys]  # where the place stands
    hashes = []
    for t, (_, left) in zip(joined, keys, strict=True):
        # the distance to the place belongs to the window
        h = H.windows(H.prefix(H.BYTES[np.frombuffer(t, np.uint8)]), window)
        hashes.append(H.mix(h + (len(left) - np.arange(len(h))).astype(np.uint64)))
    weight = np.repeat([min(2, len(texts[k])) for k in keys], counts)
    _, number = np.unique(np.concatenate(hashes), return_inverse=True)
    hit = np.bincount(number, weights=weight)[number] > 1
    # equal hashes are confirmed on the windows' bytes; if any two differ, the group is counted by bytes
    first: dict[int, bytes] = {}
    starts = np.append(0, np.cumsum(counts))
    owner = np.searchsorted(starts, np.flatnonzero(hit), "right") - 1
    for at, i, n in zip(np.flatnonzero(hit).tolist(), owner.tolist(), number[hit].tolist(), strict=True):
        w = joined[i][at - int(starts[i]) : at - int(starts[i]) + window]
        if first.setdefault(n, w) != w:
            exact: dict[tuple[int, bytes], int] = {}
            spelled = [(int(offsets[i]) - k, t[k : k + window]) for i, t in enumerate(joined) for k in range(len(t) - window + 1)]
            for key, times in zip(spelled, weight.tolist(), strict=True):
                exact[key] = exact.get(key, 0) + times
            hit = np.array([exact[key] > 1 for key in spelled])
            break
    for k, part in zip(keys, np.split(hit, np.cumsum(counts)[:-1]), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], part.astype(np.int8), [0]])))
        for lo, hi in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            for uid, place in texts[k]:
                yield uid, place + lo, place + hi - 1 + window


def _merge(window: int, core: int):
    def spans(runs: list[bytes]) -> Iterator[tuple[bytes, int, int]]:
        group: list[tuple[bytes, bytes, list]] = []
        for k, suffix, left, members in LoserTree([_read(r) for r in runs]):
            if group and k < core:
                yield from _repeated(group, window)
                group = []
            group.append((suffix, left, members))
        if group:
            yield from _repeated(group, window)

    def out(rows: list) -> pa.RecordBatch:
        uid, lo, hi = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(uid, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["uid", "lo", "hi"])

    def one(runs):
        rows = []
        for s in spans(runs):
            rows.append(s)
            if len(rows) >= 20_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    def run(batches):
        part, runs = None, []
        for b in batches:
            for k, blob in zip(b.column("part").to_pylist(), b.column("run").to_pylist(), strict=True):
                if k != part:
                    yield from one(runs)
                    part, runs = k, []
                runs.append(blob)
        yield from one(runs)

    return run


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, width: int = WIDTH, ranges: int | None = None, digests: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the remaining bytes ``kept``, or with ``digests`` their SHA-256."""
    spark = docs.sparkSession
    core = window - width + 1
    # one column list for both joins, so that Spark deals the texts out once
    keyed = with_uid(docs.select(id_col, text_col), id_col, text_col).select("uid", id_col, text_col)
    places = keyed.select("uid", text_col).mapInArrow(_sample(text_col, window, gram, width), PLACES)
    shared = materialize(places.repartition("core").sortWithinPartitions("core").mapInArrow(_shared, PLACES), "places")
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    splits = sorted({int(x) for x in shared.approxQuantile("head", [k / ranges for k in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else []
    lists = shared.groupBy("uid").agg(F.collect_set(F.struct("at", "lo", "n")).alias("places"))
    marked = keyed.join(lists, "uid")
    runs = marked.select("uid", text_col, "places").mapInArrow(_runs(text_col, window, splits), "part int, run binary")
    spans = runs.repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(_merge(window, core), "uid binary, lo int, hi int")
    found = keyed.join(spans.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "uid", "left")
    kept = T.StructField("kept_sha256", T.StringType()) if digests else T.StructField("kept", T.BinaryType())
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), kept])

    def cut(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                rows = []
                for text, own in zip(b.column(text_col).to_pylist(), b.column("spans").to_pylist(), strict=True):
                    data = text.encode() if text else b""
                    own = factors([(s["lo"], s["hi"]) for s in own]) if own else []
                    parts, last = [], 0
                    for lo, hi in own:
                        parts.append(data[last:lo])
                        last = hi
                    left = b"".join([*parts, data[last:]])
                    rows.append((len(data), len(data) - len(left), len(own), hashlib.sha256(left).hexdigest() if digests else left))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string() if digests else pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(id_col), *cols], names=schema.names)

    return found.select(id_col, text_col, "spans").mapInArrow(cut, schema)
