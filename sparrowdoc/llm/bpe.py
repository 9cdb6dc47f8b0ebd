"""Byte-level BPE: ranked merges folded by Spark higher-order functions over the byte arrays of distinct words.

A first pass counts the pieces that the pattern cuts texts into. The commonest ones, at most ``MAX_KNOWN``, are folded
once for the whole corpus and broadcast with their ids, ``MAX_HOT`` of them as a dictionary and the others as sorted
arrays; that bounds what a task holds, and no piece is left out. A second pass gives one row for each block of documents: known ids and numbers of other pieces. The block's other distinct
pieces are folded there; a kernel puts their ids in place and decodes by concatenating the vocabulary's binary pieces.
Neither pass deals documents out. The ranks are a constant table of perfect hashing, bounded by the vocabulary.

Pieces longer than ``FOLD_BYTES`` (a fold takes time in the square of the length) are merged with a heap in the kernel.

Defined cases: null and empty texts give no ids and decode to nothing; equal texts give equal ids; null ids, repeated
rows and other columns stay as they are; an empty table gives an empty one; input columns named as a new one give way to
it. A text of any length is encoded whole; one longer than ``BLOCK_BYTES`` is a block of its own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, materialize, small_batches

#: White space as the public encoder's pattern means it (Unicode White_Space).
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A blank before a character that is no white space always begins a piece, so texts may be cut there.
_CUT = re.compile(r" (?=\S)")
#: A blank before white space, as Arrow's pattern: such texts are not cut at every blank.
_GLUED = r" [\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLOCK_BYTES, CHUNK = 2 << 20, 2048
FOLD_BYTES = 384
#: Pieces whose ids are broadcast, those of them in a dictionary, and a quarter of the distinct parts a task counts at once.
MAX_KNOWN, MAX_HOT, MAX_PARTS = 1_500_000, 120_000, 100_000
#: Bits of an id, a rank or a place within a piece, and the one that is none of them.
BITS = 20
NONE = (1 << BITS) - 1
#: Stands where the table has no pair.
EMPTY = 1 << 62


def splitter(pattern: str) -> regex.Pattern:
    p = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    return regex.compile(p)


def parse_ranks(lines) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file of the driver's tokenizer package; the path is a parameter."""
    with open(path, "rb") as f:
        return parse_ranks(f)


class RankTable:
    """The ranked merges (left id, right id) to the merged id, which is its rank too, by hash and displace.

    A pair's bucket gives a shift, its own hash plus the shift its place; what stands there, pair and rank in one long,
    tells whether the pair is a merge. Buckets are placed by size, each at the first place of a fixed permutation that
    fits all its pairs.
    """

    SEEDS = 64

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[token[:at]], ranks[token[at:]], rank) for token, rank in ranks.items() for at in range(1, len(token)) if token[:at] in ranks and token[at:] in ranks]
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        if len(left) and max(left.max(), right.max(), rank.max()) >= NONE:
            raise ValueError(f"ids from {NONE} on are not supported")
        n = len(left)
        self.places, self.buckets = n * 3 // 2 + 1, n // 2 + 1
        for seed in range(self.SEEDS):
            self.p, self.q = 1_000_003 + 15_838 * seed, 26_544_357 + 209_458 * seed
            place, bucket = (left * self.p + right * self.q) % self.places, (left * self.q + right * self.p) % self.buckets
            order = np.lexsort((place, bucket))
            b, s = bucket[order], place[order]
            if not ((b[1:] == b[:-1]) & (s[1:] == s[:-1])).any():
                break
        else:
            raise ValueError("no hash keeps the pairs of a bucket apart")
        starts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, n))
        shift, merge = np.zeros(self.buckets, np.int64), np.full(self.places, -1, np.int64)
        spots, at = np.random.default_rng(0).permutation(self.places).tolist(), 0
        for i in np.argsort(-sizes, kind="stable").tolist():
            mine = slice(starts[i], starts[i] + sizes[i])
            for _ in range(self.places):
                move = (spots[at] - s[mine][0]) % self.places
                at = (at + 1) % self.places
                put = (s[mine] + move) % self.places
                if (merge[put] < 0).all():
                    break
            else:
                raise ValueError("a bucket fits nowhere")
            o = order[mine]
            shift[b[starts[i]]], merge[put] = move, (left[o] << BITS | right[o]) << BITS | rank[o]
        merge[merge < 0] = EMPTY
        self.lists = {"shift": shift.tolist(), "merge": merge.tolist(), "byte": [ranks[bytes([b])] for b in range(256)]}

    def to_each(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the lists as a constant struct ``table``, one broadcast row that the vocabulary bounds.

        A literal of this size would be copied into every plan text that the driver keeps.
        """
        kind = ",".join(f"{k}:array<bigint>" for k in self.lists)
        return rows.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(tuple(self.lists.values()),)], f"table struct<{kind}>")))

    def rank(self, t: Column, left: Column, right: Column) -> Column:
        """The pair's rank, NONE if it is no merge; ``t`` holds the lists. What stands for another pair is over NONE."""
        shift = F.get(t["shift"], ((left * self.q + right * self.p) % self.buckets).cast("int"))
        found = F.get(t["merge"], ((left * self.p + right * self.q + shift) % self.places).cast("int"))
        pair = F.shiftleft(F.shiftleft(left, BITS) + right, BITS)
        return F.least(found.bitwiseXOR(pair), _long(NONE))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def fold(word: Column, t: Column, table: RankTable) -> Column:
    """Ids of one piece, a byte array: its bytes' ids, with the lowest-ranked neighbours merged again and again.

    The state is a cell for each id between two edges: the rank of the id with its right neighbour, the place where the
    id begins, and the id, ``BITS`` bits each. So the least cell is the leftmost of the lowest rank; a step merges it
    and looks up the two pairs that arise.
    """
    ident = lambda cell: cell.bitwiseAND(_long(NONE))
    place = _long(NONE << BITS)

    def step(cells: Column, _: Column) -> Column:
        def merge(at: Column) -> Column:
            low, left = F.get(cells, at - 1), F.get(cells, at - 2)
            new = F.shiftright(low, 2 * BITS)
            before = F.shiftleft(table.rank(t, ident(left), new), 2 * BITS).bitwiseOR(left.bitwiseAND(_long((1 << 2 * BITS) - 1)))
            after = F.shiftleft(table.rank(t, new, ident(F.get(cells, at + 1))), 2 * BITS).bitwiseOR(low.bitwiseAND(place)).bitwiseOR(new)
            return F.concat(F.slice(cells, 1, at - 2), F.array(before, after), F.slice(cells, at + 2, NONE))

        # places grow along the array, so a count gives the position (array_position throws an exception for each hit)
        upto = lambda low: F.size(F.filter(cells, lambda c: c.bitwiseAND(place) <= low.bitwiseAND(place)))
        return bind(F.array_min(cells), lambda low: F.when(low >= _long(NONE << 2 * BITS), cells).otherwise(bind(upto(low), merge)))

    def start(ids: Column) -> Column:
        return F.transform(ids, lambda x, i: F.shiftleft(table.rank(t, x, F.coalesce(F.get(ids, i + 1), _long(NONE))), 2 * BITS) + F.shiftleft(i.cast("long"), BITS) + x)

    edge = F.array(_long(NONE))
    letters = F.concat(edge, F.transform(word, lambda b: F.get(t["byte"], b)), edge)
    steps = F.slice(word, 2, NONE)  # one for each merge that is possible
    return F.aggregate(steps, bind(letters, start), step, lambda s: F.transform(F.slice(s, 2, F.size(s) - 2), lambda c: ident(c).cast("int")))


def fold_all(words: str, table: RankTable) -> Column:
    """Ids of every piece of an array; the lists are in the column ``table``."""
    return bind(F.col("table"), lambda t: F.transform(words, lambda w: fold(w, t, table)))


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and links, for pieces of any length."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, after, before = [i + 1 for i in range(n)], [i + 1 for i in range(n)], [i - 1 for i in range(n)]
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


def _check(pattern: str) -> None:
    if r"| ?\p{L}+|" not in pattern or r"| ?[^\s\p{L}\p{N}]+|" not in pattern:
        raise ValueError("the pattern has to join one blank to a run of letters or of signs")


def _pieces(part: str, spaced: bool, split) -> list[str]:
    """Pieces of a cut part, after a blank where ``spaced``; a word, and one with a stop or comma, need no pattern."""
    blank = " " if spaced else ""
    if part.isalpha():
        return [blank + part]
    if part[-1:] in (".", ",") and part[:-1].isalpha():
        return [blank + part[:-1], part[-1]]
    return split.findall(blank + part)


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All parts of the texts in one array, each but a text's first without the blank before it, and where texts start."""
    texts = texts.fill_null("")
    glued = pc.match_substring_regex(texts, _GLUED).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    if glued.any():
        whole = pa.array([_CUT.split(t) for t in texts.filter(pa.array(glued)).to_pylist()], lists.type)
        order = np.empty(len(texts), np.int64)
        order[~glued], order[glued] = np.arange((~glued).sum()), np.arange(glued.sum()) + (~glued).sum()
        lists = pa.concat_arrays([lists.filter(pa.array(~glued)), whole]).take(pa.array(order))
    starts = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
    return lists.flatten(), starts.astype(np.int64)


def _block(batches, text_col: str):
    """Tables of documents with ``BLOCK_BYTES`` of text, or one longer text."""
    held, size = [], 0
    for whole in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(whole.column(text_col)).fill_null(0).to_pylist()):
            size += n
            if size >= BLOCK_BYTES:
                yield pa.Table.from_batches([*held, whole.slice(start, i + 1 - start)])
                held, start, size = [], i + 1, 0
        if start < whole.num_rows:
            held.append(whole.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks)


def _count(text_col: str, pattern: str):
    """(piece, n) of a task's texts, counted by cut parts in between; words count without a stop or comma behind them."""

    def summed(parts: list[pa.StructArray]) -> pa.Table:
        table = pa.table({"part": pa.concat_arrays([p.field(0) for p in parts]), "n": pa.concat_arrays([p.field(1) for p in parts])})
        return table.group_by("part", use_threads=False).aggregate([("n", "sum")])  # threads hold memory of their own

    def run(batches):
        split = splitter(pattern)
        held: list[pa.StructArray] = []

        def flush():
            table = summed(held)
            held.clear()
            words = pc.utf8_is_alpha(table["part"])
            plain = table.filter(words)
            yield pc.binary_join_element_wise(" ", plain["part"], "").combine_chunks(), plain["n_sum"].combine_chunks()
            others = table.filter(pc.invert(words))
            pieces: dict[str, int] = {}
            for part, n in zip(others["part"].to_numpy().tolist(), others["n_sum"].to_numpy().tolist(), strict=True):
                for p in _pieces(part, True, split):
                    if len(p) <= FOLD_BYTES:
                        pieces[p] = pieces.get(p, 0) + n
            yield pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())

        for block in _block(batches, text_col):
            held.append(pc.utf8_rtrim(_cut(_column(block, text_col))[0], ".,").value_counts())
            if sum(map(len, held)) > 4 * MAX_PARTS:
                for piece, n in flush():
                    yield pa.RecordBatch.from_arrays([piece.cast(pa.string()), n], names=["piece", "n"])
                pa.default_memory_pool().release_unused()
        if held:
            for piece, n in flush():
                yield pa.RecordBatch.from_arrays([piece.cast(pa.string()), n], names=["piece", "n"])

    return run


def _spell(hot: int):
    """Rows (piece, level) as rows of up to CHUNK pieces: ``hot`` for those of a level or more, pieces, and their bytes."""

    def run(batches):
        for b in batches:
            above = pc.greater_equal(b.column("level"), hot)
            for flag, part in ((True, b.filter(above)), (False, b.filter(pc.invert(above)))):
                for at in range(0, part.num_rows, CHUNK):
                    pieces = part.slice(at, CHUNK).column("piece")
                    raw = [p.encode() for p in pieces.to_pylist()]
                    words = _lists(pa.array(np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)), [len(p) for p in raw])
                    yield pa.RecordBatch.from_arrays([pa.array([flag]), _lists(pieces, [len(raw)]), _lists(words, [len(raw)])], names=["hot", "pieces", "words"])

    return run


def _pack(batches):
    """Rows (pieces, words) as blobs: hashes, lengths of pieces and of ids, the pieces' bytes and the ids."""
    for b in batches:
        for row in range(b.num_rows):
            raw, ids = [p.encode() for p in b.column("pieces")[row].as_py()], b.column("words")[row].values
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
            lengths = np.array([len(p) for p in raw], np.int32)
            many = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            blob = [hashes.tobytes(), lengths.tobytes(), many.tobytes(), b"".join(raw), ids.flatten().to_numpy().astype("<i4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blob], names=["hashes", "lengths", "many", "spelled", "ids"])


def _joined(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    blobs = rows.mapInArrow(_pack, "hashes binary, lengths binary, many binary, spelled binary, ids binary").collect()
    parts = [b"".join(r[c] for r in blobs) for c in ("hashes", "lengths", "many", "spelled", "ids")]
    return np.frombuffer(parts[0], np.uint64), np.frombuffer(parts[1], np.int32), np.frombuffer(parts[2], np.int32), parts[3], np.frombuffer(parts[4], "<i4")


class Known:
    """Ids of pieces: the commonest in dictionaries, the others in arrays that are found by sorted hashes."""

    def __init__(self, hot: DataFrame, others: DataFrame):
        _, lengths, many, spelled, ids = _joined(hot)
        stops, ends = np.cumsum(lengths), np.cumsum(many)
        bounds = zip((stops - lengths).tolist(), stops.tolist(), (ends - many).tolist(), ends.tolist(), strict=True)
        #: Pieces with a blank in front, without it, and all others.
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        for lo, hi, x, y in bounds:
            piece = spelled[lo:hi].decode()
            if piece[0] == " ":
                self.words[piece[1:]] = ids[x:y].tobytes()
            else:
                self.others[piece] = ids[x:y].tobytes()
        hashes, lengths, many, self.spelled, self.ids = _joined(others)
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]
        self.stops, self.ends = np.append(0, np.cumsum(lengths)).astype(np.int32), np.append(0, np.cumsum(many)).astype(np.int32)
        if len(self.ids) and self.ids.max() < 1 << 16:
            self.ids = self.ids.astype(np.uint16)

    def find(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces the arrays hold, compared byte by byte, and where the ids of each begin and end."""
        if not len(self.hashes):
            return np.zeros(len(pieces), bool), np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hits = self.hashes[place] == hashes
        at = self.order[place]
        spelled = self.spelled
        hits &= np.array([spelled[lo:hi] == p for p, lo, hi in zip(pieces, self.stops[at].tolist(), self.stops[at + 1].tolist(), strict=True)], bool)
        return hits, self.ends[at], self.ends[at + 1]


def known_pieces(docs: DataFrame, table: RankTable, pattern: str, *, text_col: str = "text", most: int = MAX_KNOWN, hot: int = MAX_HOT) -> Known:
    """The commonest pieces that stand twice or more, at most ``most``, with their ids; the driver holds these alone."""
    counts = docs.select(text_col).mapInArrow(_count(text_col, pattern), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where("n > 1").withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "pieces")
    levels, total = {most: 1 << 30, hot: 1 << 30}, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):  # some hundred levels
        total += r["count"]
        levels |= {bound: r["level"] for bound in levels if total <= bound}
    chosen = counts.where(F.col("level") >= levels[most]).select("piece", "level").mapInArrow(_spell(levels[hot]), "hot boolean, pieces array<string>, words array<array<int>>")
    chosen = table.to_each(chosen.repartition(max(1, min(total, most) >> 14)))
    folded = materialize(chosen.select("hot", "pieces", fold_all("words", table).alias("words")), "known")
    drop(counts)
    known = Known(folded.where("hot"), folded.where("not hot"))
    drop(folded)
    return known


def _codes(parts: list[str], spaced: bool, known: Known, ranks: dict[bytes, int], numbers: dict[str, int], split) -> list[bytes]:
    """Each part's pieces as 32-bit words: ids, and -1 - number for a piece that the dictionaries don't hold."""
    words, others = known.words, known.others
    out = list(map(words.get, parts)) if spaced else [None] * len(parts)

    def code(piece: str) -> bytes:
        found = words.get(piece[1:]) if piece[:1] == " " else others.get(piece)
        if found is not None:
            return found
        if len(piece) * 4 > FOLD_BYTES and len(raw := piece.encode()) > FOLD_BYTES:
            return np.array(merge_long(raw, ranks), "<i4").tobytes()
        return (-1 - numbers.setdefault(piece, len(numbers))).to_bytes(4, "little", signed=True)

    stops = {c: others[c] for c in ".," if c in others}
    for i, found in enumerate(out):
        if found is None:
            part = parts[i]
            if spaced and part[-1:] in stops and (body := part[:-1]).isalpha() and body in words:
                out[i] = words[body] + stops[part[-1]]
            else:
                out[i] = b"".join(map(code, _pieces(part, spaced, split)))
    return out


def _lists(values: pa.Array, counts) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


def _blocks(text_col: str, pattern: str, shared, names: list[str]):
    """One row for each block: ``words``, its pieces to fold as byte arrays, and ``docs``, their fields and codes as an
    Arrow stream, which the JVM only hands on."""

    def run(batches):
        split, (ranks, known) = splitter(pattern), shared.value
        numbers: dict[str, int] = {}
        for block in _block(batches, text_col):
            flat, starts = _cut(_column(block, text_col))
            leads = np.zeros(len(flat), bool)
            leads[starts[:-1]] = True
            coded = flat.filter(pa.array(~leads)).dictionary_encode()
            first = flat.filter(pa.array(leads)).to_pylist()
            codes = _codes(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), True, known, ranks, numbers, split) + _codes(first, False, known, ranks, numbers, split)
            which = np.empty(len(flat), np.int64)
            which[~leads], which[leads] = coded.indices.to_numpy(), np.arange(len(first)) + len(coded.dictionary)
            bounds = np.append(0, np.cumsum([len(c) >> 2 for c in codes]))
            own, many = gather(np.frombuffer(b"".join(codes), "<i4"), bounds[which], bounds[which + 1])
            stops = np.append(0, np.cumsum(many))[starts]

            # numbered pieces: the arrays know some of them, the others get new numbers
            pieces = [w.encode() for w in numbers]
            hits, lo, hi = known.find(pieces)
            held, lengths = gather(known.ids, lo[hits], hi[hits])
            ids = np.concatenate([held.astype(np.int32), -1 - np.arange(len(pieces) - hits.sum(), dtype=np.int32)])
            lengths = np.concatenate([lengths, np.ones(len(pieces) - hits.sum(), np.int64)])
            place = np.empty(len(pieces), np.int64)
            place[hits], place[~hits] = np.arange(hits.sum()), np.arange(hits.sum(), len(pieces))
            bounds = np.append(0, np.cumsum(lengths))
            own, many = put(own, ids, bounds[place], bounds[place + 1])
            stops = np.append(0, np.cumsum(many))[stops]
            pieces = [p for p, hit in zip(pieces, hits.tolist(), strict=True) if not hit]
            words = _lists(pa.array(np.frombuffer(b"".join(pieces), np.uint8).astype(np.int32)), [len(p) for p in pieces])
            docs = pa.RecordBatch.from_arrays([*[_column(block, n) for n in names], _lists(pa.array(own), np.diff(stops))], names=[*[f"c{i}" for i in range(len(names))], "codes"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_batch(docs)
            yield pa.RecordBatch.from_arrays([_lists(words, [len(words)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["words", "docs"])
            numbers.clear()
            pa.default_memory_pool().release_unused()

    return run


def gather(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges [lo, hi) of ``flat`` one after the other, and their lengths."""
    many = hi - lo
    ends = np.cumsum(many)
    return flat[np.repeat(lo - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)], many


def put(codes: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes with the ids [lo, hi) of numbered words in their places, and how many ids each code gives."""
    at = np.flatnonzero(codes < 0)
    number = -1 - codes[at]
    many = np.ones(len(codes), np.int64)
    many[at] = (hi - lo)[number]
    out = np.repeat(codes, many)
    ids, own = gather(words, lo[number], hi[number])
    first = np.cumsum(many)[at] - own
    out[np.repeat(first, own) + np.arange(len(ids)) - np.repeat(np.cumsum(own) - own, own)] = ids
    return out, many


def _documents(spelled: list[bytes], digests: bool, names: list[str]):
    """Documents of folded blocks with their ids, decoded again by concatenating binary pieces."""

    def run(batches):
        vocabulary = pa.array(spelled, pa.binary())
        for b in batches:
            for row in range(b.num_rows):
                words = b.column("words")[row].values
                docs = pa.ipc.open_stream(b.column("docs")[row].as_buffer()).read_next_batch()
                ends = np.append(0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False)))
                own = docs.column("codes")
                ids, many = put(own.flatten().to_numpy(), words.flatten().to_numpy(), ends[:-1], ends[1:])
                stops = np.append(0, np.cumsum(many))[np.append(0, np.cumsum(own.value_lengths().to_numpy()))]
                fields = docs.columns[:-1]
                ids, counts = pa.array(ids.astype(np.int32)), np.diff(stops)
                decoded = pc.binary_join(_lists(vocabulary.take(ids), counts), b"")
                shown = pc.binary_join(_lists(ids.cast(pa.string()), counts), " ") if digests else _lists(ids, counts)
                if digests:
                    shown, decoded = (pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column]) for column in (shown, decoded))
                yield pa.RecordBatch.from_arrays([*fields, pa.array(counts), shown, decoded], names=names)
            pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text_col: str = "text", digests: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with its ids, decoded again: ``n_tokens``, ``ids`` and ``decoded``.

    With ``digests``, two SHA-256 instead of ids and bytes, and no text. Input columns named as a new one give way to it.
    """
    _check(pattern)
    spark = docs.sparkSession
    small_batches(spark)
    ints, table = T.ArrayType(T.IntegerType()), RankTable(ranks)
    if digests:
        added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", ints), T.StructField("decoded", T.BinaryType())]
    names = [f.name for f in added]
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    kept = [f for f in base.schema.fields if f.name != text_col or keep_text and not digests]
    shared = spark.sparkContext.broadcast((ranks, known_pieces(base, table, pattern, text_col=text_col)))

    block = T.StructType([T.StructField("words", T.ArrayType(ints)), T.StructField("docs", T.BinaryType())])
    blocks = base.mapInArrow(_blocks(text_col, pattern, shared, [f.name for f in kept]), block)
    folded = table.to_each(blocks).select(fold_all("words", table).alias("words"), "docs")
    out = T.StructType([*kept, *added])
    spelled = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        spelled[i] = token
    return folded.mapInArrow(_documents(spelled, digests, out.names), out)
