"""Texts cut where no encoder merges, so that each distinct word is encoded once in a task.

``cut`` finds places in the bytes of many texts where a token ends for certain: before a blank that precedes a character
which is no white space, and around a newline that does so. ``Words`` remembers the ids of distinct words, at most
``MOST`` of them, and spells whole slices with them.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers.
MOST = 800_000

#: First bytes of characters that are no white space for certain: printable ASCII, and lead bytes but those of the blocks
#: that hold Unicode's other white space (C2, E1, E2, E3).
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0xC3:0xE1] = _SOLID[0xE4:0xF5] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = True
_SIGN[0x30:0x3A] = _SIGN[_LETTER] = False

#: One piece of the public pattern, in UTF-8: a blank, if any, and letters of the Latin blocks up to U+024F.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and where its rows begin and end."""
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    rows = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[rows[0] : rows[-1]], rows - rows[0]


def cut(data: np.ndarray, rows: np.ndarray, *, single: bool = False, signs: bool = False) -> np.ndarray:
    """Ascending places from 0 to the end at which ``data`` falls apart, all beginnings of rows included.

    ``single``: at a blank only if no other blank precedes it. ``signs``: also between an ASCII letter and a sign.
    """
    at = np.zeros(len(data) + 1, bool)
    at[rows] = True
    if len(data) > 1:
        solid = _SOLID[data[1:]]
        solid[rows[(rows > 0) & (rows < len(data))] - 1] = False  # the next byte is another text's
        here = data[:-1]
        blank = (here == 0x20) & solid
        if single:
            blank[1:] &= here[:-1] != 0x20
        line = (here == 0x0A) & solid
        at[:-2] |= blank | line
        at[1:-1] |= line
        if signs:
            at[1:-1] |= _LETTER[here] & _SIGN[data[1:]]
    return np.flatnonzero(at)


def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The words of up to 8 bytes as numbers; ``data`` has 8 bytes to spare. Without NUL bytes no two words share one."""
    rows = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))[starts]
    return rows.view(np.uint64).ravel() & (np.uint64(2**64 - 1) >> (np.uint64(64) - sizes.astype(np.uint64) * np.uint64(8)))


def distinct(data: np.ndarray, places: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words between ``places``, and which of them stands at each.

    Words of up to 16 bytes are numbered as one or two 64-bit numbers, longer ones, and all of a batch with NUL bytes, as
    byte strings.
    """
    starts, sizes = places[:-1], np.diff(places)
    codes, known = np.zeros(len(starts), np.int64), 0
    plain = bool(len(data)) and bool(data.min())
    wide = np.append(data, np.zeros(16, np.uint8))
    for low, high in ((0, 8), (8, 16), (16, None)) if plain else ((0, None),):
        at = np.flatnonzero((sizes > low) & (sizes <= high) if high else sizes > low)
        if not len(at):
            continue
        if high == 8:
            code, found = pd.factorize(_keys(wide, starts[at], sizes[at]))
        elif high:
            head, heads = pd.factorize(_keys(wide, starts[at], np.full(len(at), 8)))
            tail, tails = pd.factorize(_keys(wide, starts[at] + 8, sizes[at] - 8))
            code, found = pd.factorize(head * len(tails) + tail)
        else:
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            coded = whole.take(pa.array(at)).dictionary_encode()
            code, found = coded.indices.to_numpy(), coded.dictionary
        codes[at] = known + code
        known += len(found)
    first = np.empty(known, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts[first].tolist(), places[1:][first].tolist(), strict=True)], codes


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Words:
    """Ids of words, by ``encode`` from a list of words to a list of lists of ids."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = MOST):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Where each word's ids stand; the words are distinct. Older answers hold no longer after this."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self._clear()
            new = words
        if new:
            got = self.encode(new)
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            ids = np.fromiter((i for x in got for i in x), np.int32, int(sizes.sum()))
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def spell(self, words: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words[at[0]]``, ``words[at[1]]``, ... in a row, and how many each has."""
        slots = self.slots(words)[at] if words else np.zeros(0, np.int64)
        sizes = self.starts[slots + 1] - self.starts[slots]
        return self.ids[ragged(self.starts[slots], sizes)], sizes


def remembered(key: tuple, make: Callable[[], object]):
    """What ``make`` gives, once for each Python worker, which Spark uses for many tasks."""
    kept = vars(sys).setdefault("_sparrowdoc_pieces", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself where it prints, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + others.index(b)) for b in range(256)]


def byte_encoder(tokenizer) -> Callable[[list[bytes]], list[list[int]]]:
    """Encodes words by a byte-level tokenizer of the tokenizers library, without special tokens being added.

    A word that is one piece for certain goes to its merges at once; for any other the whole encoder is asked.
    """
    letters = {b: x for b, x in enumerate(byte_letters()) if b != 0x0A}
    tokenize = tokenizer.model.tokenize

    def encode(words: list[bytes]) -> list[list[int]]:
        plain = [_WORD.fullmatch(w) is not None for w in words]
        rest = [w.decode() for w, p in zip(words, plain, strict=True) if not p]
        others = (e.ids for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        spelt = iter(b"\n".join(w for w, p in zip(words, plain, strict=True) if p).decode("latin-1").translate(letters).split("\n"))
        return [[t.id for t in tokenize(next(spelt))] if p else next(others) for p in plain]

    return encode
