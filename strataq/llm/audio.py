"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM, resampled PCM.

``store`` wraps samples in a WAVE file of one of three codecs; ``load`` parses
it again.  Decoding is vectorised: the two G.711 laws are 256-entry tables made
from their formulas and applied by one index operation over all texts of a
batch; ADPCM has a recurrence inside a block, so the loop runs over the sample
positions while each step works on *all blocks* of the batch at once.  Decoded
PCM is resampled from 8 to 16 kHz by interpolation and stored as 16-bit WAVE.

``media_columns`` gives both stored forms as binary columns, ``media`` and ``pcm``;
``describe`` reads them back: payload and its digests come from ``media``, the feature
from ``pcm``.  The query is the second on the first; what is between them are streamed
rows, so the four to eight times larger PCM takes no disk.

Cases: null is the empty text; the payload is the UTF-8 text padded with zero
bytes to a positive multiple of 64, so an empty text has one block of zeros;
equal texts give equal bytes and equal features, whatever their batch; repeated rows come
out as often; an empty table gives no rows; columns other than doc_id and text are not
read, whatever their names.  Batches are cut into runs of about ``RUN_BYTES`` payload,
which bounds memory; a single longer text is a run of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import encode, table

UNIT = 64
RATE, RATE_OUT = 8000, 16000
RUN_BYTES = 1 << 19
CODECS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
NAMES = {v: k for k, v in CODECS.items()}
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, pcm_bytes long"


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
# The 89 step sizes and 8 index moves of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference and next index for each (index, nibble): 89 x 16 of both."""
    nib = np.arange(16)
    step = STEPS[:, None]
    diff = (step >> 3) + np.where(nib & 4, step, 0) + np.where(nib & 2, step >> 1, 0) + np.where(nib & 1, step >> 2, 0)
    return np.where(nib & 8, -diff, diff).astype(np.int32).ravel(), (np.clip(np.arange(89)[:, None] + MOVES[nib & 7], 0, 88) * 16).astype(np.int32).ravel()


DIFF, NEXT = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of all blocks (n, 4 + 64 bytes): header sample, then 128 nibbles each."""
    n = len(blocks)
    out = np.empty((2 * (blocks.shape[1] - 4) + 1, n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(body.shape[0]):
        for half, nib in enumerate((body[k] & 15, body[k] >> 4)):
            at = index + nib
            value += DIFF[at]
            np.clip(value, -32768, 32767, out=value)
            index = NEXT[at]
            out[2 * k + 1 + half] = value
    return out.T


def payload(text: str | None) -> tuple[int, bytes]:
    raw = encode(text)
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _wave(tag: int, data: bytes, rate: int, bits: int, align: int, extra: bytes = b"") -> bytes:
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * align // (1 if tag != 17 else 129), align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def pick_codec(data: bytes) -> str:
    """By the data alone, so equal texts are stored alike."""
    return ("mulaw", "alaw", "ima_adpcm")[zlib.crc32(data) % 3]


def store(data: bytes, codec: str) -> bytes:
    """The payload as a WAVE file; every payload byte is kept as it is."""
    if codec != "ima_adpcm":
        return _wave(CODECS[codec], data, RATE, 8, 1)
    blocks = np.zeros((len(data) // UNIT, UNIT + 4), np.uint8)
    blocks[:, 4:] = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    blocks[:, 2] = 40  # a middle step size in each block's header
    return _wave(17, blocks.tobytes(), RATE, 4, UNIT + 4, struct.pack("<HH", 2, 2 * UNIT + 1))


def load(media: bytes) -> tuple[str, bytes]:
    """Codec and data chunk of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec = 12, ""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec = NAMES[struct.unpack_from("<H", media, at + 8)[0]]
        elif name == b"data":
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def samples_of(codec: str, data: bytes) -> bytes:
    """Payload bytes of a data chunk: ADPCM without the block headers."""
    if codec != "ima_adpcm":
        return data
    return np.frombuffer(data, np.uint8).reshape(-1, UNIT + 4)[:, 4:].tobytes()


def decode_all(chunks: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """PCM of many chunks; each codec is decoded once over all its chunks."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(chunks)
    for codec in CODECS:
        mine = [i for i, (c, _) in enumerate(chunks) if c == codec]
        if not mine:
            continue
        raw = np.frombuffer(b"".join(chunks[i][1] for i in mine), np.uint8)
        if codec == "ima_adpcm":
            pcm, per = decode_adpcm(raw.reshape(-1, UNIT + 4)).reshape(-1), lambda d: len(d) // (UNIT + 4) * (2 * UNIT + 1)
        else:
            pcm, per = (MULAW if codec == "mulaw" else ALAW)[raw], len
        ends = np.cumsum([per(chunks[i][1]) for i in mine])
        for i, part in zip(mine, np.split(pcm, ends[:-1])):
            out[i] = part
    return out


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples and the rounded middles between neighbours."""
    wide = pcm.astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = (wide + np.append(wide[1:], wide[-1:])) >> 1
    return out


def store_pcm(pcm: np.ndarray) -> bytes:
    return _wave(1, pcm.astype("<i2").tobytes(), RATE_OUT, 16, 2)


def feature(pcm: np.ndarray) -> str:
    """Samples, peak, root mean square, crossings of zero and a digest."""
    x = pcm.astype(np.float64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{len(pcm)}|{int(np.abs(x).max(initial=0))}|{np.sqrt((x * x).mean()) if len(x) else 0:.3f}|{crossings}|{zlib.crc32(pcm.tobytes()):08x}"


def runs(texts, most: int = RUN_BYTES):
    """Consecutive (position, length, payload) in runs of bounded size."""
    run, size = [], 0
    for i, text in enumerate(texts):
        n, data = payload(text)
        if run and size + len(data) > most:
            yield run
            run, size = [], 0
        run.append((i, n, data))
        size += len(data)
    if run:
        yield run


def _stored(batches):
    for pdf in batches:
        for run in runs(pdf.text):
            media = [store(d, pick_codec(d)) for _, _, d in run]
            chunks = [load(m) for m in media]
            rows = [(pdf.doc_id.iloc[i], n, codec, m, store_pcm(resample(pcm))) for (i, n, _), m, (codec, _), pcm in zip(run, media, chunks, decode_all(chunks))]
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "codec", "media", "pcm"]).astype({"doc_id": "Int64"})


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, codec, media (the text as a telephony WAVE), pcm (16 kHz, 16 bit)."""
    return docs.select("doc_id", "text").mapInPandas(_stored, "doc_id long, n_bytes long, codec string, media binary, pcm binary")


def read_pcm(pcm: bytes) -> np.ndarray:
    """Samples of a stored 16-bit WAVE."""
    rate, align = struct.unpack_from("<I", pcm, 24)[0], struct.unpack_from("<H", pcm, 32)[0]
    if pcm[:4] != b"RIFF" or (rate, align) != (RATE_OUT, 2):
        raise ValueError("not PCM of 16 kHz and 16 bit")
    return np.frombuffer(pcm, "<i2", struct.unpack_from("<I", pcm, 40)[0] // 2, 44)


def _described(batches):
    for pdf in batches:
        rows = []
        for doc, n, media, pcm in zip(pdf.doc_id, pdf.n_bytes, pdf.media, pdf.pcm):
            codec, data = load(media)
            back = samples_of(codec, data)
            rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(read_pcm(pcm)), codec, len(pcm)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})


def describe(stored: DataFrame) -> DataFrame:
    """What is read back from the media columns of ``media_columns``."""
    return stored.select("doc_id", "n_bytes", "media", "pcm").mapInPandas(_described, SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    """Stores each text as telephony audio and PCM, reads both back and describes them."""
    return describe(media_columns(docs))


def resampled(media: DataFrame) -> DataFrame:
    """(doc_id, media binary) to (doc_id, codec, pcm binary): 16 kHz 16-bit WAVE."""

    def step(batches):
        for pdf in batches:
            chunks = [("", b"") if m is None else load(bytes(m)) for m in pdf.media]
            pcm = [None if not c else store_pcm(resample(x)) for (c, _), x in zip(chunks, decode_all(chunks))]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "codec": [c or None for c, _ in chunks], "pcm": pcm})

    return media.select("doc_id", "media").mapInPandas(step, "doc_id long, codec string, pcm binary")


def op2_audio(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
