"""Telephony audio columns (operator 5).

Mu-law and A-law bytes expand through 256-entry tables; IMA ADPCM decodes all
blocks of a file in lockstep, one numpy step for each nibble position. Audio is
stored as RIFF/WAVE and resampled to 16-bit PCM.

Any byte string is a valid mu-law stream, so a payload is stored losslessly as
the samples of a mu-law file and read back from the file's data chunk.

Results for odd input: null text counts as empty; the payload of an empty text
is one block of spaces; a file that is not RIFF/WAVE, has no data chunk, has more
than one channel or ends inside the header of an ADPCM block raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32, map_rows, read

RATE, BLOCK = 8000, 192
PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11
#: Fixed values of IMA ADPCM: index moves by nibble.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def ima_steps() -> np.ndarray:
    """The 89 step sizes: each about a tenth above the one before, from 7 to 32767, as the format fixes them."""
    return np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    low, seg = (a & 15) << 4, (a >> 4) & 7
    size = np.where(seg == 0, low + 8, low + 0x108 << np.maximum(seg - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()


def ima_decode(data: bytes, align: int) -> np.ndarray:
    """Mono IMA ADPCM: all whole blocks advance together, a trailing part of a block is left out."""
    steps = ima_steps()
    blocks = np.frombuffer(data[: len(data) // align * align], np.uint8).reshape(-1, align)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((len(blocks), 1 + 2 * (align - 4)), np.int16)
    out[:, 0] = value
    for i in range(2 * (align - 4)):
        nibble = (blocks[:, 4 + i // 2] >> (4 * (i % 2))) & 15
        nibble = nibble.astype(np.int32)
        step = steps[index]
        diff = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + MOVES[nibble], 0, 88)
        out[:, i + 1] = value
    return out.reshape(-1)


def wave(data: bytes, kind: int = MULAW, rate: int = RATE, align: int = 1, bits: int = 8) -> bytes:
    extra = struct.pack("<HH", 2, 1 + 2 * (align - 4)) if kind == IMA else b"" if kind == PCM else struct.pack("<H", 0)
    speed = rate * align // (1 + 2 * (align - 4)) if kind == IMA else rate * align
    fmt = struct.pack("<HHIIHH", kind, 1, rate, speed, align, bits) + extra
    tail = len(data) % align
    count = len(data) // align * (1 + 2 * (align - 4)) + (1 + 2 * (tail - 4) if tail >= 4 else 0) if kind == IMA else len(data) // align
    fact = b"" if kind == PCM else b"fact" + struct.pack("<II", 4, count)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[int, int, int, bytes]:
    """Format, rate, block size and data of a RIFF/WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, head = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(media):
            head = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data" and head:
            if head[1] != 1:
                raise ValueError(f"{head[1]} channels")
            return head[0], head[2], head[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def samples(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and their rate."""
    kind, rate, align, data = parse(media)
    if kind == MULAW:
        return MULAW_TABLE[np.frombuffer(data, np.uint8)], rate
    if kind == ALAW:
        return ALAW_TABLE[np.frombuffer(data, np.uint8)], rate
    if kind == IMA:
        tail = data[len(data) // align * align :]
        if 0 < len(tail) < 4:
            raise ValueError("a block without its header")
        return np.concatenate([ima_decode(data, align), *([ima_decode(tail, len(tail))] if tail else [])]), rate
    if kind == PCM:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2"), rate
    raise ValueError(f"format {kind}")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear, in integers: sample k lies at k * rate / to, rounded down between its neighbours."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    left, part = at // to, at % to
    right = np.minimum(left + 1, len(pcm) - 1)
    a, b = pcm[left].astype(np.int64), pcm[right].astype(np.int64)
    return (a + ((b - a) * part) // to).astype(np.int16)


def feature(pcm: np.ndarray, rate: int) -> str:
    """Samples, peak, mean square and crossings of zero, all in integers."""
    wide = pcm.astype(np.int32)
    square = int(np.dot(wide.astype(np.float64), wide)) if len(wide) < 1 << 22 else sum(int(np.dot(c.astype(np.float64), c)) for c in np.array_split(wide, len(wide) >> 21))
    cross = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"rate={rate};n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};ms={square // max(1, len(pcm))};zc={cross}"


def store(payload: bytes, kind: int = MULAW) -> bytes:
    return wave(payload, kind)


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b" " * ((-len(data)) % BLOCK if data else BLOCK)


def stored(text: str | None, rate: int = 2 * RATE) -> tuple[bytes, bytes]:
    """Media (mu-law WAVE) of a text's payload, and its PCM (WAVE) at ``rate``."""
    media = store(payload_of(text)[1])
    s, had = samples(media)
    return media, wave(resample(s, had, rate).tobytes(), PCM, rate, 2, 16)


def media_column(docs: DataFrame, text: str = "text", key: str = "doc_id", rate: int = 2 * RATE) -> DataFrame:
    """One row per row: key, media (mu-law WAVE) and pcm (WAVE of 16-bit PCM at ``rate``)."""

    def make():
        def run(columns):
            both = [stored(t, rate) for t in columns[1]]
            return [columns[0], [m for m, _ in both], [p for _, p in both]]

        return run

    return map_rows(docs.select(key, text), make, f"{key} {docs.schema[key].dataType.simpleString()}, media binary, pcm binary")


def digest(size: int, media: bytes, pcm: bytes) -> tuple:
    """Digest of a stored row, whose text has ``size`` bytes."""
    back = parse(media)[3]
    return (size, len(back), hashlib.sha256(back).hexdigest(), crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(*samples(pcm)))


def digest_row(text: str | None) -> tuple:
    return digest(payload_of(text)[0], *stored(text))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = media_column(docs.select(F.struct("doc_id", size.alias("size")).alias("doc"), "text"), key="doc")

    def make():
        return lambda columns: [columns[0], *([list(c) for c in zip(*map(digest, *columns[1:]))])]

    return map_rows(rows.select("doc.doc_id", "doc.size", "media", "pcm"), make, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
