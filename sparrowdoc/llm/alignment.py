"""Alignment of two tokenizers' ids over the same bytes, by DuckDB in each Arrow batch and sums merged in Spark.

Tokenizer A is byte-level and reads blank + text; B is SentencePiece BPE and puts the blank there itself. A task cuts the
bytes of its documents into words at which neither merges. Words that its worker has not met yet go to DuckDB as interval
tables of their tokens (word, number, end, id): it finds the ends that both sides share, numbers groups by a window sum,
gives each token its group by an ASOF join and joins the sides by group; the words' linked pairs stay in a DuckDB table.
That table and the batch's (document, word) counts give the documents' links, with a count of documents for each pair of
ids in the batch. Spark adds those counts up, finds each A id's best, and joins them back onto the documents' links.

A word boundary is a shared end, so groups never reach over it. Texts whose joined bytes differ from blank + text on
either side (B reads U+2581 as a blank) have no tokens, and so have null and empty ones: all counts are 0.

Defined cases: rows that repeat count as documents of their own; ties for an A id's best all count; null ids stay; an
empty table gives an empty one; a long text is a slice of its own, in which only its distinct words are aligned; columns
other than id and text are left out.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces
from .common import long, materialize, small_batches, string

#: Text bytes that are aligned in one go, and words that a worker remembers.
SLICE_BYTES, MOST = 2 << 20, 400_000
#: Room for an id of B in a pair.
SHIFT = 20

_LINKS = T.ArrayType(T.StructType([long("pair"), long("n")]))
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]

#: a and b: tokens of words (word, i, stop, id).
_GROUPS = """
create or replace temp table cuts as select word, stop, sum(1) over (partition by word order by stop) as g from a semi join b using (word, stop);
create or replace temp table ga as select a.word, g, i, id from a asof join cuts c on a.word = c.word and c.stop >= a.stop;
create or replace temp table gb as select b.word, g, i, id from b asof join cuts c on b.word = c.word and c.stop >= b.stop
"""
_TOKENS = "select word, g, side, id from (select word, g, 0 as side, i, id from ga union all select word, g, 1, i, id from gb) order by word, g, side, i"
_PAIRS = f"insert into pairs select ga.word, (ga.id << {SHIFT}) | gb.id, count(*) from ga join gb using (word, g) group by all"
#: occ: words by document (doc, word).
_LINKED = """
create or replace temp table linked as
  select doc, pair, sum(n * times)::bigint as n from (select doc, word, count(*) as times from occ group by all) join pairs using (word) group by all
"""


class Side:
    """One tokenizer: its encoder of words, and the bytes of each id."""

    def __init__(self, encode, vocabulary: list[bytes]):
        self.encode, self.vocabulary, self.sizes = encode, vocabulary, np.array([len(x) for x in vocabulary], np.int64)

    def tokens(self, words: list[bytes], base: int) -> tuple[pa.Table, np.ndarray]:
        """The interval table of words, numbered from ``base``, and whether the ids spell each."""
        got = self.encode(words)
        each = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((i for x in got for i in x), np.int64, int(each.sum()))
        first = np.cumsum(each) - each
        ends = np.cumsum(self.sizes[ids])
        before = np.append(0, ends)[first]
        table = pa.table({"word": base + np.repeat(np.arange(len(words)), each), "i": np.arange(len(ids)) - np.repeat(first, each), "stop": ends - np.repeat(before, each), "id": ids})
        return table, np.array([b"".join([self.vocabulary[i] for i in x]) == w for x, w in zip(got, words, strict=True)], bool)


class Aligner:
    """Aligned words of a worker."""

    def __init__(self, path_a: str, path_b: str, most: int = MOST):
        import duckdb

        self.a, self.b, self.most = side_a(path_a), side_b(path_b), most
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": "", "preserve_insertion_order": False})
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.good, self.counts, self.groups = np.zeros(0, bool), np.zeros((0, len(_COUNTS)), np.int64), pa.array([], pa.string())
        self.db.execute("create or replace table pairs (word bigint, pair bigint, n bigint)")

    def _tables(self, **tables: pa.Table) -> None:
        for name, table in tables.items():
            self.db.register(name, table)

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Numbers of distinct words, of which new ones are aligned. Older numbers hold no longer after this."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self._clear()
            new = words
        if new:
            self._align(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _align(self, new: list[bytes]) -> None:
        base = len(self.known)
        (ta, spelt_a), (tb, spelt_b) = self.a.tokens(new, base), self.b.tokens(new, base)
        self._tables(a=ta, b=tb)
        self.db.execute(_GROUPS)
        self.db.execute(_PAIRS)
        word, g, side, ids = (c.to_numpy() for c in self.db.execute(_TOKENS).to_arrow_table().columns)
        word = word - base
        g = g.astype(np.int64)
        count = lambda rows: np.bincount(word[rows], minlength=len(new))
        # a group ends where the next token's word or number differs, a side of it also where the side does
        last = np.append((word[1:] != word[:-1]) | (g[1:] != g[:-1]), True)
        turn = last | np.append(side[1:] != side[:-1], True)
        group = np.cumsum(last) - last
        links = np.bincount(group[side == 0]) * np.bincount(group[side == 1])
        self.counts = np.concatenate([self.counts, np.stack([count(side == 0), count(side == 1), count(last), np.bincount(word[last], links, len(new)).astype(np.int64)], axis=1)])
        mark = pa.array([",", "|", ";", ""]).take(pa.array(np.where(~turn, 0, np.where(side == 0, 1, np.where(np.append(word[1:] == word[:-1], False), 2, 3)))))
        told = pc.binary_join_element_wise(pc.cast(pa.array(ids), pa.string()), mark, "")
        own = pa.ListArray.from_arrays(pa.array(np.searchsorted(word, np.arange(len(new) + 1)), pa.int32()), told)
        self.groups = pa.concat_arrays([self.groups, pc.binary_join(own, "")])
        self.good = np.concatenate([self.good, spelt_a & spelt_b])
        self.known.update(zip(new, range(base, base + len(new)), strict=True))

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, list[str], pa.Array, pa.Array]:
        """Counts, digests and links of texts, and for each pair of them in how many it is linked."""
        n = len(texts)
        full = np.flatnonzero(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False) > 0)
        data, ends = pieces.flat(pc.binary_join_element_wise(pa.scalar(" "), texts.take(pa.array(full)), ""))
        places = pieces.cut(data, ends, single=True)
        known, at = pieces.distinct(data, places)
        word = self.slots(known)[at] if known else at
        doc = np.searchsorted(ends, places[:-1], "right") - 1
        spoilt = np.zeros(len(full), bool)
        spoilt[doc[~self.good[word]]] = True
        word, doc = word[~spoilt[doc]], doc[~spoilt[doc]]
        counts = np.zeros((n, len(_COUNTS)), np.int64)
        for k in range(len(_COUNTS)):
            counts[full, k] = np.bincount(doc, self.counts[word, k], len(full))
        told = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(full) + 1)), pa.int32()), self.groups.take(pa.array(word)))
        digests = [""] * n
        for d, text in zip(full.tolist(), pc.binary_join(told, ";").to_pylist(), strict=True):
            digests[d] = hashlib.sha256(text.encode()).hexdigest() if text else ""
        self._tables(occ=pa.table({"doc": full[doc], "word": word}))
        self.db.execute(_LINKED)
        linked = self.db.execute("select doc, pair, n from linked order by doc").to_arrow_table().combine_chunks()
        sums = self.db.execute("select pair, count(*)::bigint as n from linked group by pair").to_arrow_table().combine_chunks()
        pairs = lambda t: pa.StructArray.from_arrays([pa.concat_arrays(t.column(c).chunks or [pa.array([], pa.int64())]) for c in ("pair", "n")], names=["pair", "n"])
        bounds = np.searchsorted(linked.column("doc").to_numpy(), np.arange(n + 1))
        return counts, digests, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs(linked)), pa.ListArray.from_arrays(pa.array([0, len(sums)], pa.int32()), pairs(sums))


def side_a(path: str) -> Side:
    """A byte-level tokenizer file; special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    back = {x: b for b, x in enumerate(pieces.byte_letters())}
    vocabulary = [b""] * (1 + max(tokenizer.get_vocab().values()))
    for token, i in tokenizer.get_vocab().items():
        vocabulary[i] = bytes(back[x] for x in token) if all(x in back for x in token) else token.encode()
    return Side(pieces.byte_encoder(tokenizer), vocabulary)


def side_b(path: str) -> Side:
    """A SentencePiece model with byte fallback that puts a blank before a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    blank, line = model.piece_to_id("▁"), model.piece_to_id("<0x0A>")
    vocabulary = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        vocabulary.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(words: list[bytes]) -> list[list[int]]:
        # the model's own blank is the word's first; other words follow a newline, which nothing merges with
        begun = [w[:1] == b" " for w in words]
        got = model.encode([w[1:].decode() if own else "\n" + w.decode() for w, own in zip(words, begun, strict=True)], num_threads=1)
        out = []
        for word, ids, own in zip(words, got, begun, strict=True):
            if word == b" ":  # to the model an empty text
                ids = [blank]
            if not own and ids[:2] != [blank, line]:
                raise ValueError("the model is not one with a blank before a text and bytes for newlines")
            out.append(ids if own else ids[2:])
        return out

    return Side(encode, vocabulary)


def _kernel(path_a: str, path_b: str, names: list[str], id_type: pa.DataType, list_type: pa.DataType):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = pieces.remembered(("alignment", path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(sizes):
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_BYTES, "right")))
                part = batch.slice(at, n)
                counts, digests, links, sums = aligner.rows(part.column("text"))
                own = [part.column("doc_id").cast(id_type), part.column("uid")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in counts.T), pa.array(digests, pa.string()), links.cast(list_type)], names=names)
                # the slice's counts are a row without a document
                none = [pa.nulls(1, t) for t in (id_type, *[pa.int64()] * 5, pa.string())]
                yield pa.RecordBatch.from_arrays([*none, sums.cast(list_type)], names=names)
                at += n

    return run


def links(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table: for each document (uid not null) its counts, digest of groups and links; else pairs' partial counts."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(f"`{text_col}`").alias("text"))
    fields = [rows.schema["doc_id"], long("uid"), *[long(c) for c in _COUNTS], string("groups_sha256"), T.StructField("links", _LINKS)]
    fields[0] = T.StructField("doc_id", rows.schema["doc_id"].dataType)
    kinds = [to_arrow_type(rows.schema["doc_id"].dataType), to_arrow_type(_LINKS)]
    return materialize(rows.mapInArrow(_kernel(path_a, path_b, [f.name for f in fields], *kinds), T.StructType(fields)), "links")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, documents, best): in how many documents a pair is linked, and whether that is its A id's highest."""
    parts = linked.where("uid is null").select(F.explode("links").alias("x"))
    counts = materialize(parts.groupBy("x.pair").agg(F.sum("x.n").alias("documents")), "pairs")
    a = F.shiftright("pair", SHIFT)
    best = counts.groupBy(a.alias("a")).agg(F.max("documents").alias("most"))
    return materialize(counts.withColumn("a", a).join(best, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best")), "counts")


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    linked = links(docs, path_a, path_b, id_col=id_col, text_col=text_col)
    counts = pair_counts(linked)
    rows = linked.where("uid is not null").select("uid", F.explode("links").alias("x")).select("uid", "x.pair", "x.n")
    sums = rows.join(counts, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("documents")).alias("count_sum"))
    out = linked.where("uid is not null").drop("links").join(sums, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *_COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256")
