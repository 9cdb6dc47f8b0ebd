"""Token ids in shards that a Re-Pair grammar compresses, with random access.

Texts are dealt out by ranges of their ids and sorted; each task encodes its documents in that order and closes a shard
when ``SHARD`` ids have come together (a shard holds whole documents; a longer one is a shard of its own). In a shard the
frequent pairs of neighbouring ids are replaced by new symbols, round after round, until no pair stands ``LEAST`` times
or a round shortens the shard by less than ``GAIN``. A round replaces many pairs at once: taken by descending count, as
long as no id would end one pair and begin another, so that no two replacements overlap. The end id takes part in no
pair, hence documents begin at symbols.

A shard is one file's content (``pack``), a row of a Parquet table in the shared folder: for each document its ids and
its symbols, the rules as pairs of symbols, each rule's length in ids, and the symbols left. ``Shard.read`` decodes any
range of ids from those symbols alone that cover it; ``ids_of`` reads a table of shards back.

Defined cases: null and empty texts are the end id alone; rows that agree in id are in the order of their texts' hashes,
then of the texts, and rows that repeat stay; null ids come first; an empty table gives an empty one; columns other than
id and text are not stored. A special token's string in a text is the special token, as the tokenizer file says.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import shared_folder
from . import pieces
from .common import long, small_batches

SHARD = 1 << 19
#: How often a pair stands to become a rule, candidates of a round, and the share of symbols that a round must save.
LEAST, ROUND, GAIN = 8, 4096, 0.02
MAGIC = b"RPG1"
_HEAD = "<4sBIQQQQ"


def _chosen(keys: np.ndarray, counts: np.ndarray) -> list[int]:
    """Pairs (left << 32 | right) by descending count, such that none ends where another begins."""
    order = np.lexsort((keys, -counts))[:ROUND]
    out, begins, ends, twice = [], set(), set(), set()
    for key in keys[order].tolist():
        a, b = key >> 32, key & 0xFFFFFFFF
        if a == b:
            if a in begins or a in ends:
                continue
            twice.add(a)
        elif a in ends or b in begins or a in twice or b in twice:
            continue
        else:
            begins.add(a)
            ends.add(b)
        out.append(key)
    return out


def compress(ids: np.ndarray, first: int, end: int, *, least: int = LEAST, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray]:
    """Rules (left, right), of which rule i makes the symbol ``first + i``, and the symbols left."""
    seq, rules = ids.astype(np.int32), []
    while len(seq) > 1:
        key = seq[:-1].astype(np.int64) << 32 | seq[1:]
        ordered = np.sort(key)
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        counts = np.diff(np.append(starts, len(ordered)))
        starts, counts = starts[counts >= least], counts[counts >= least]
        found = ordered[starts]
        free = (found >> 32 != end) & (found & 0xFFFFFFFF != end)
        made = np.sort(np.array(_chosen(found[free], counts[free]), np.int64))
        if not len(made):
            break
        begins, ends = np.zeros(first + len(rules), bool), np.zeros(first + len(rules), bool)
        begins[made >> 32] = ends[made & 0xFFFFFFFF] = True
        at = np.flatnonzero(begins[seq[:-1]] & ends[seq[1:]])
        place = np.minimum(np.searchsorted(made, key[at]), len(made) - 1)
        hit = made[place] == key[at]
        at, place = at[hit], place[hit]
        # of a run of one id every second place begins a pair
        run = np.flatnonzero(seq[at] == seq[at + 1])
        if len(run):
            new = np.append(True, (np.diff(at[run]) != 1) | (seq[at[run]][1:] != seq[at[run]][:-1]))
            odd = (at[run] - at[run][np.flatnonzero(new)][np.cumsum(new) - 1]) % 2 == 1
            keep = np.ones(len(at), bool)
            keep[run[odd]] = False
            at, place = at[keep], place[keep]
        short = len(at) < gain * len(seq)
        seq[at] = first + len(rules) + place
        rules += made.tolist()
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq = seq[stays]
        if short:
            break
    pairs = np.array(rules, np.int64)
    return np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1).reshape(-1, 2), seq


def spans(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for. A rule is made of ids and earlier rules."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((1 if a < first else out[a - first]) + (1 if b < first else out[b - first]))
    return np.array(out, np.int64)


class Expansion:
    """The ids of every rule, one after the other."""

    def __init__(self, rules: np.ndarray, own: np.ndarray, first: int):
        self.first, self.sizes = first, np.concatenate([np.ones(first, np.int64), own])
        self.starts = np.concatenate([np.arange(first), first + np.cumsum(own) - own])
        self.ids = np.empty(first + int(own.sum()), np.int32)
        self.ids[:first] = np.arange(first)
        starts, sizes, ids = self.starts.tolist(), self.sizes.tolist(), self.ids
        for i, (a, b) in enumerate(rules.tolist(), first):  # of ids and earlier rules
            at, middle = starts[i], starts[i] + sizes[a]
            ids[at:middle] = ids[starts[a] : starts[a] + sizes[a]]
            ids[middle : at + sizes[i]] = ids[starts[b] : starts[b] + sizes[b]]

    def of(self, symbols: np.ndarray) -> np.ndarray:
        return self.ids[pieces.ragged(self.starts[symbols], self.sizes[symbols])]


class Shard:
    """A packed shard: ``sizes`` ids and ``widths`` symbols of each document, ``rules``, their ``spans``, ``body``."""

    def __init__(self, blob: bytes):
        magic, width, self.first, *counts = struct.unpack_from(_HEAD, blob)
        if magic != MAGIC:
            raise ValueError("not a shard")
        docs, rules, body, self.total = counts
        kind, at, parts = np.dtype(f"<u{width}"), struct.calcsize(_HEAD), []
        for count, dtype in ((docs, "<u4"), (docs, "<u4"), (rules * 2, kind), (rules, "<u4"), (body, kind)):
            parts.append(np.frombuffer(blob, dtype, count, at).astype(np.int64))
            at += count * np.dtype(dtype).itemsize
        self.sizes, self.widths, pairs, self.spans, self.body = parts
        self.rules = pairs.reshape(-1, 2)
        self.expansion = Expansion(self.rules, self.spans, self.first)

    def ids(self) -> np.ndarray:
        return self.expansion.of(self.body)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, from the documents and symbols that cover them."""
        start, stop = max(0, start), min(stop, self.total)
        if start >= stop:
            return np.zeros(0, np.int64)
        ends = np.cumsum(self.sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop)
        places = np.concatenate([[0], np.cumsum(self.widths)])
        begin = ends[a] - self.sizes[a]
        symbols = self.body[places[a] : places[b + 1]]
        covers = np.cumsum(self.expansion.sizes[symbols]) + begin
        lo, hi = np.searchsorted(covers, start, "right"), np.searchsorted(covers, stop)
        skipped = covers[lo - 1] if lo else begin
        return self.expansion.of(symbols[lo : hi + 1])[start - skipped : stop - skipped]


def pack(ids: np.ndarray, sizes: np.ndarray, first: int, end: int) -> bytes:
    """A shard's content. ``sizes``: ids of each document, of which ``end`` is the last."""
    rules, body = compress(ids, first, end)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    own = spans(rules, first)
    covers = np.concatenate([np.ones(first, np.int64), own])[body]
    widths = np.diff(np.concatenate([[0], np.searchsorted(np.cumsum(covers), np.cumsum(sizes)) + 1])) if len(sizes) else sizes
    head = struct.pack(_HEAD, MAGIC, width, first, len(sizes), len(rules), len(body), len(ids))
    return head + b"".join(x.astype(f"<u{w}").tobytes() for x, w in ((sizes, 4), (widths, 4), (rules, width), (own, 4), (body, width)))


def _writer(tokenizer_path: str, end: int, shard: int, id_type: pa.DataType, names: list[str]):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        first = 1 + max(end, *tokenizer.get_vocab(with_added_tokens=True).values())
        words = pieces.remembered(("byte-level", tokenizer_path), lambda: pieces.Words(pieces.byte_encoder(tokenizer)))
        part, total, number = TaskContext.get().partitionId(), 0, 0
        keys, ids, sizes = [], [], []

        def encoded(texts: pa.Array):
            """Ids and sizes of a batch of texts, the end id included."""
            data, rows = pieces.flat(texts)
            places = pieces.cut(data, rows, signs=True)
            known, at = pieces.distinct(data, places)
            got, each = words.spell(known, at)
            size = np.diff(np.concatenate([[0], np.cumsum(each)])[np.searchsorted(places, rows)])
            ends = np.cumsum(size + 1) - 1
            out = np.empty(len(got) + len(size), np.int32)
            out[ends] = end
            mask = np.ones(len(out), bool)
            mask[ends] = False
            out[mask] = got
            return out, size + 1

        def whole(texts: pa.Array):
            """As ``encoded``, text by text: for texts that hold special tokens, before which white space is cut otherwise."""
            got = [[*e.ids, end] for e in tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64)

        def close():
            nonlocal total, number
            flat, size = np.concatenate(ids), np.concatenate(sizes)
            row = [pa.array([v], pa.int64()) for v in (part, number, total, len(flat))]
            total, number = total + len(flat), number + 1
            row += [pa.array([pa.concat_arrays(keys)], pa.list_(id_type)) if id_type != pa.null() else pa.nulls(1, pa.list_(id_type)), pa.array([pack(flat, size, first, end)], pa.binary())]
            keys.clear(), ids.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays(row, names=names)

        for batch in batches:
            key, texts = batch.column(0).cast(id_type), batch.column(1)
            odd = np.zeros(len(texts), bool)
            for token in special:
                odd |= pa.compute.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.append(True, odd[1:] != odd[:-1])) if len(odd) else []
            for a, b in zip(begins, [*begins[1:], len(odd)], strict=True):
                got, size = (whole if odd[a] else encoded)(texts.slice(a, b - a))
                ends, at = np.cumsum(size), 0
                while at < len(size):  # documents until the shard is full
                    before = ends[at] - size[at]
                    n = max(1, int(np.searchsorted(ends[at:], before + shard - sum(map(len, ids)), "right")))
                    if ids and ends[at] - before + sum(map(len, ids)) > shard:
                        yield close()
                        continue
                    keys.append(key.slice(a + at, n)), ids.append(got[before : ends[at + n - 1]]), sizes.append(size[at : at + n])
                    at += n
        if ids:
            yield close()

    return run


def write(docs: DataFrame, tokenizer_path: str, end: int, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """A table of shards: (part, shard, start, n_ids, ids, content), with the documents in ascending order of their ids.

    ``start``: ids of the part before the shard; parts and, within them, shards are in order. ``path`` is where the table
    is written; if None, it is scratch in the shared folder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"))
    order = ["doc_id", "hash", "text"]
    dealt = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions(*order).select("doc_id", "text")
    fields = [long("part"), long("shard"), long("start"), long("n_ids"), T.StructField("ids", T.ArrayType(rows.schema["doc_id"].dataType)), T.StructField("content", T.BinaryType())]
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    path = path or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    shards = dealt.mapInArrow(_writer(tokenizer_path, end, shard, kind, [f.name for f in fields]), T.StructType(fields))
    shards.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _reader(id_type: pa.DataType, with_ids: bool, names: list[str]):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, keys, content = (batch.column(c).slice(row, 1) for c in ("part", "start", "ids", "content"))
                shard = Shard(content[0].as_py())
                ids = shard.ids()
                ends = np.cumsum(shard.sizes)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - shard.sizes, ends, strict=True)]
                columns = [keys.flatten().cast(id_type), pa.array(np.full(len(ends), part[0].as_py())), pa.array(start[0].as_py() + ends - shard.sizes), pa.array(shard.sizes), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def documents(shards: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in a table of shards, decoded from its content.

    ``start`` counts the ids of all documents before it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = shards.schema["ids"].dataType.elementType
    fields = [T.StructField("doc_id", id_type), long("part"), long("start"), long("n_tokens"), long("ids_crc32")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    read = shards.select("part", "start", "ids", "content").mapInArrow(_reader(to_arrow_type(id_type), with_ids, [f.name for f in fields]), T.StructType(fields))
    # a row for each task that wrote, whatever the documents
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    out = read.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("start"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
