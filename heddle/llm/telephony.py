"""Telephony audio columns: mu-law, A-law and ADPCM payloads, decoded to resampled PCM.

Companded samples are expanded by lookup tables; ADPCM blocks are decoded by numpy across blocks, one
step of all blocks at a time. `store` keeps payload bytes as 8-bit samples of a WAVE file and
`stored_payload` reads them back without loss. A payload's checksum chooses its law.

Defined results: null is an empty payload, which `padded` turns into one unit of zeros; a media value
that is no WAVE file raises an error; an empty table gives an empty result; equal payloads give equal
values, whatever rows share their batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import small_batches

UNIT = 64
RATE, RESAMPLED = 8000, 16000
MULAW, ALAW = 7, 6  # format tags of WAVE
#: Bytes that a worker decodes at once.
CHUNK = 1 << 20

#: Fixed values of the IMA ADPCM format: step sizes, and how a code moves the step index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    magnitude = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    magnitude = np.where(segment == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


LAWS = {MULAW: "mulaw", ALAW: "alaw"}
TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def expand(codes: np.ndarray, tag: int = MULAW) -> np.ndarray:
    return TABLES[tag][codes]


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM: uint8 blocks (n, bytes) to int16 samples (n, 1 + 2 * (bytes - 4)).

    A block begins with its first sample (little-endian), the step index and an unused byte; an index
    outside the table is clamped.
    """
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), dtype=np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 0x0F).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = value
    for at, code in enumerate(codes, 1):
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code & 7], 0, len(STEPS) - 1)
        out[at] = value
    return out.T


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate by a half-band filter; the edges repeat their sample."""
    if not len(pcm):
        return np.empty(0, np.int16)
    x = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
    middle = (9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2], out[1::2] = pcm, np.clip(middle, -32768, 32767)
    return out


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    return payload + bytes(-len(payload) % unit if payload else unit)


def store(payload: bytes, tag: int = MULAW) -> bytes:
    """A mono WAVE file of 8-bit companded samples, which are the payload's bytes."""
    form = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload + bytes(len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def law_of(payload: bytes) -> int:
    """The law that a payload is stored under: even checksums take mu-law, odd ones A-law."""
    return ALAW if zlib.crc32(payload) & 1 else MULAW


def stored_payload(media: bytes) -> tuple[bytes, int]:
    """The samples of a WAVE file and its format tag, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size], tag
        at += 8 + size + size % 2
    raise ValueError("no samples in the WAVE file")


def pcm_file(pcm: np.ndarray, rate: int = RESAMPLED) -> bytes:
    data = pcm.astype("<i2").tobytes()
    form = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data)) + data


def level(pcm: np.ndarray) -> tuple[int, int]:
    """Root mean square, and sign changes."""
    if not len(pcm):
        return 0, 0
    x = pcm.astype(np.int64)
    return int(round(float(np.sqrt(np.mean(x * x))))), int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))


def _adpcm_levels(payloads: list[bytes], unit: int) -> list[tuple[int, int]]:
    """Levels of each payload as ADPCM blocks of `unit` bytes; blocks of many payloads are decoded at once."""
    counts = np.array([len(p) // unit for p in payloads])
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, unit)
    step, squares, turns = max(1, CHUNK // unit), [], []
    for at in range(0, len(blocks), step):
        pcm = decode_adpcm(blocks[at : at + step]).astype(np.float32)
        squares.append(np.square(pcm, dtype=np.float64).sum(axis=1))
        turns.append(np.count_nonzero((pcm[:, 1:] < 0) != (pcm[:, :-1] < 0), axis=1))
    owner = np.repeat(np.arange(len(payloads)), counts)
    energy, changes = np.bincount(owner, np.concatenate(squares), len(payloads)), np.bincount(owner, np.concatenate(turns), len(payloads))
    samples = counts * (1 + 2 * (unit - 4))
    return [(int(round(float(np.sqrt(e / n)))), int(c)) for e, n, c in zip(energy, samples, changes, strict=True)]


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, with_media: bool = True) -> DataFrame:
    """Each text as telephony audio: its id, n_bytes, media (the WAVE file of companded samples), pcm (the WAVE file of
    resampled PCM), and sizes, digests and features of both as read back. `with_media=False` leaves the two
    files themselves out."""

    small_batches(docs.sparkSession)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            part, size = [], 0
            for row in zip(frame["id"], frame["text"], strict=True):
                part.append(row)
                size += len(row[1])
                if size >= CHUNK:
                    yield made(part)
                    part, size = [], 0
            if part:
                yield made(part)

    def made(part: list[tuple[object, str]]) -> pd.DataFrame:
        raw = [text.encode("utf-8") for _, text in part]
        payloads = [padded(x, unit) for x in raw]
        media = [store(x, law_of(x)) for x in payloads]
        back = [stored_payload(m) for m in media]
        rows = []
        for (key, _), text, m, (payload, tag), (a_rms, a_turns) in zip(part, raw, media, back, _adpcm_levels([p for p, _ in back], unit), strict=True):
            pcm = resample_double(expand(np.frombuffer(payload, np.uint8), tag))
            rms, turns = level(pcm)
            file = pcm_file(pcm)
            feature = f"{LAWS[tag]}>pcm{RESAMPLED}:n={len(pcm)};rms={rms};turns={turns};adpcm:rms={a_rms};turns={a_turns}"
            row = [key, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-unit:]), len(m), hashlib.sha256(m).hexdigest(), len(file), hashlib.sha256(file).hexdigest(), feature]
            rows.append([*row, m, file] if with_media else row)
        return pd.DataFrame(rows, columns=names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pcm_bytes", "pcm_sha256", "feature", *(["media", "pcm"] if with_media else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pcm_bytes long, pcm_sha256 string, feature string" + ", media binary, pcm binary" * with_media
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(batches, schema).withColumnRenamed("id", id_col)
