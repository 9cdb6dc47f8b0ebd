"""Telephony audio in a media column: mu-law WAV storage, G.711 expansion, IMA ADPCM blocks, resampling.

``store`` writes a text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as the 8-bit mu-law samples
of a WAV file at 8 kHz, a column of its own. ``expand`` reads that column back: the payload, and 16 kHz PCM of it by
mu-law and A-law expansion (256-entry tables) and by IMA ADPCM in 64-byte blocks (numpy works across all blocks of a
slice, one sample step at a time). ``digest`` sums these columns up.

Defined cases: null and empty texts hold 64 zero bytes; equal texts give equal values, rows that repeat stay; an empty
table gives an empty one; input columns named as a new one give way to it. A long text is a slice of its own, and its
PCM takes 12 bytes for each of its bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, binary, long

BLOCK, RATE, MULAW = 64, 8000, 7

# Fixed values of the IMA ADPCM format: change of the step number for each code.
_INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
# Fixed values of the IMA ADPCM format: the 89 step sizes.
_STEPS = np.array(
    """7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209
    230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499
    2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500
    20350 22385 24623 27086 29794 32767""".split(),
    np.int32,
)


def mulaw_table() -> np.ndarray:
    b = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((b & 0x0F) << 3) + 0x84 << ((b >> 4) & 7)) - 0x84
    return np.where(b & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    b = np.arange(256, dtype=np.int32) ^ 0x55
    exponent = (b >> 4) & 7
    size = ((b & 0x0F) << 4) + 8
    size = np.where(exponent > 0, size + 0x100 << np.maximum(exponent - 1, 0), size)
    return np.where(b & 0x80, size, -size).astype(np.int16)


def adpcm(data: np.ndarray) -> np.ndarray:
    """PCM of whole 64-byte IMA blocks: predictor (int16), step number, a spare byte, then two codes a byte."""
    blocks = data.reshape(-1, BLOCK)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.empty((BLOCK * 2 - 8, len(blocks)), np.uint8)
    codes[0::2] = blocks[:, 4:].T & 15
    codes[1::2] = blocks[:, 4:].T >> 4
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(codes, 1):
        step = _STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0)
        change += np.where(code & 2, step >> 1, 0)
        change += np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + _INDEX_MOVES[code], 0, 88)
        out[k] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the mean of it and the next (the last repeats)."""
    out = np.empty(len(pcm) * 2, np.int16)
    out[0::2] = pcm
    wide = pcm.astype(np.int32)
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1] = pcm[-1]
    return out


def payload(text: str | None) -> tuple[int, bytes]:
    raw = text.encode() if text else b""
    return len(raw), raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit mu-law samples."""
    form = struct.pack("<HHIIHHH", MULAW, 1, rate, rate, 1, 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, len(samples)) + b"data" + struct.pack("<I", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(body)) + body


def load(wav: bytes) -> bytes:
    """The samples of a mu-law WAV file, found by walking its chunks."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind = 12, None
    while at + 8 <= len(wav):
        name, size = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)[0]
        if name == b"fmt ":
            kind = struct.unpack_from("<H", wav, at + 8)[0]
        if name == b"data":
            if kind != MULAW:
                raise ValueError(f"format {kind} is not mu-law")
            return wav[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def _store(texts):
    rows = [payload(t) for t in texts]
    return [pa.array([n for n, _ in rows], pa.int64()), pa.array([wav(raw) for _, raw in rows], pa.binary())]


def _expand():
    mulaw, alaw = mulaw_table(), alaw_table()

    def kernel(media):
        back = [load(m) if m is not None else None for m in media]
        whole = b"".join(x for x in back if x)
        ima = adpcm(np.frombuffer(whole, np.uint8)) if whole else np.zeros((0, BLOCK * 2 - 7), np.int16)
        columns: list[list] = [[] for _ in range(5)]
        at = 0
        for raw in back:
            if not raw:
                row = (raw, None, None, None, None)
            else:
                data = np.frombuffer(raw, np.uint8)
                samples = (mulaw[data], alaw[data], ima[at : at + len(raw) // BLOCK].reshape(-1))
                at += len(raw) // BLOCK
                power = [int(np.dot(x.astype(np.float64), x)) // len(x) for x in samples]
                row = (raw, *(resample(x).tobytes() for x in samples), power)
            for c, v in zip(columns, row, strict=True):
                c.append(v)
        return [*(pa.array(c, pa.binary()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.int64()))]

    return kernel


CODECS = ("mulaw", "alaw", "ima")


def store(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes and ``media``, a WAV file."""
    return annotate(docs, text_col, lambda: _store, [long("n_bytes"), binary("media")])


def expand(stored: DataFrame, *, media_col: str = "media") -> DataFrame:
    """``stored`` with the ``payload`` of its files, 16 kHz PCM by each codec, and ``power``, the mean squares before resampling.

    A null file gives nulls; a file that is no mu-law WAV is an error.
    """
    return annotate(stored, media_col, _expand, [binary("payload"), *[binary(c) for c in CODECS], T.StructField("power", T.ArrayType(T.LongType()))])


def telephony(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with its media and what is read back from it."""
    return expand(store(docs, text_col=text_col))


def digest(audio: DataFrame) -> DataFrame:
    """The media, payload and PCM columns as lengths and checksums."""
    part = lambda i, c: F.concat_ws(":", F.lit(c), (F.length(c) / 2).cast("long").cast("string"), F.get("power", F.lit(i)).cast("string"), F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0"))
    sums = {
        "payload_bytes": F.length("payload").cast("long"), "payload_sha256": F.sha2("payload", 256), "tail_crc32": F.crc32(F.substring("payload", -BLOCK, BLOCK)),
        "media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256), "feature": F.concat_ws(";", *[part(i, c) for i, c in enumerate(CODECS)]),
    }
    return audio.select(*[c for c in audio.columns if c not in ("media", "payload", "power", *CODECS, *sums)], *[v.alias(k) for k, v in sums.items()])
