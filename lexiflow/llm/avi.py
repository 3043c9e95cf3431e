"""AVI motion-JPEG files of 8-bit grey frames, and their shots.

A frame is an intra-coded lossless JPEG image (process SOF3, one 8-bit component, predictor 1), so
that stored samples come back exactly. Frames of a batch are coded and decoded side by side: one
array operation handles the same step of all frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.store import slices

SIDE = 24
FRAME_BYTES = SIDE * SIDE
FPS = 25
PAD = 255
#: A cut: the change of histogram exceeds the mean of the last changes by so many deviations, and this least share of samples.
SHOT_WINDOW, SHOT_SIGMAS, SHOT_LEAST, BINS = 8, 3.0, 0.25, 16

#: Lengths of the Huffman codes of difference categories 0 to 8; the code of ones alone stays free.
CODE_LENGTHS = (3, 4, 4, 3, 2, 4, 5, 2, 6)


def _codes() -> tuple[dict[int, tuple[int, int]], bytes]:
    """Canonical codes by category, and the DHT segment that describes them."""
    by_length = sorted(range(len(CODE_LENGTHS)), key=lambda c: (CODE_LENGTHS[c], c))
    codes, code, last = {}, 0, CODE_LENGTHS[by_length[0]]
    for c in by_length:
        code <<= CODE_LENGTHS[c] - last
        last = CODE_LENGTHS[c]
        codes[c] = (code, last)
        code += 1
    counts = bytes(sum(n == k for n in CODE_LENGTHS) for k in range(1, 17))
    body = b"\0" + counts + bytes(by_length)
    return codes, b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body


_CODE, _DHT = _codes()
_SOF = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
HEAD = b"\xff\xd8" + _DHT + _SOF + _SOS
TAIL = b"\xff\xd9"


def _encode_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference from -255 to 255."""
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code, n = _CODE[c]
        bits[d + 255], sizes[d + 255] = (code << c) | (d if d >= 0 else d + (1 << c) - 1), n + c
    return bits, sizes


_BITS, _SIZES = _encode_table()


def decode_table(dht: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For any 16 bits ahead: the difference that they begin with, and how many bits it takes (0: not a code)."""
    counts, kinds = dht[1:17], dht[17:]
    value, size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
    code = k = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            c = kinds[k]
            k += 1
            if n + c > 16:
                raise ValueError("codes with their bits of over 16 are not read")
            low = code << (16 - n)
            extra = (np.arange(1 << (16 - n)) >> (16 - n - c)) if c else np.zeros(1 << (16 - n), np.int64)
            value[low : low + (1 << (16 - n))] = np.where(extra >= (1 << c >> 1), extra, extra - (1 << c) + 1) if c else 0
            size[low : low + (1 << (16 - n))] = n + c
            code += 1
        code <<= 1
    return value, size


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """JPEG images of ``frames`` (n, SIDE, SIDE) of uint8."""
    x = frames.astype(np.int32)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    index = diff.reshape(len(x), -1) + 255
    bits, sizes = _BITS[index], _SIZES[index]
    ends = np.cumsum(sizes, axis=1)
    n_bytes = (ends[:, -1] + 7) >> 3
    base = (np.cumsum(n_bytes) - n_bytes) << 3
    start = (base[:, None] + ends - sizes).ravel()
    byte = start >> 3
    room = (bits.ravel().astype(np.int64)) << (24 - (start & 7) - sizes.ravel())
    total = int(n_bytes.sum())
    out = np.zeros(total + 3, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        out[k : k + total] += np.bincount(byte, (room >> shift) & 255, minlength=total)[:total].astype(np.int64)
    last = np.cumsum(n_bytes) - 1
    out[last] |= (1 << ((-ends[:, -1]) & 7)) - 1  # ones up to the byte's end
    data = out[:total].astype(np.uint8)
    stuffed = np.repeat(data, 1 + (data == 255))
    after = np.cumsum(data == 255)
    where = np.arange(total) + after
    stuffed[where[data == 255]] = 0
    edges = np.concatenate(([0], where[last] + 1)).tolist()
    raw = stuffed.tobytes()
    return [HEAD + raw[a:b] + TAIL for a, b in zip(edges, edges[1:], strict=False)]


def _segments(image: bytes) -> tuple[bytes, int]:
    """The Huffman table of an image, and where its entropy-coded data begin."""
    at, dht = 2, b""
    while True:
        mark, n = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + n]
        if mark == 0xC4:
            dht = body
        elif mark == 0xC3 and (body[0], body[1:3], body[3:5]) != (8, SIDE.to_bytes(2, "big"), SIDE.to_bytes(2, "big")):
            raise ValueError("only 8-bit grey frames of the fixed size are read")
        elif mark == 0xDA:
            if body[3] != 1:
                raise ValueError("only predictor 1 is read")
            return dht, at + 2 + n
        elif 0xC0 <= mark <= 0xCF and mark != 0xC3:
            raise ValueError("only lossless Huffman frames are read")
        at += 2 + n


def decode_frames(images: Sequence[bytes]) -> np.ndarray:
    """Samples (n, SIDE, SIDE) of JPEG images that share their headers."""
    if not images:
        return np.empty((0, SIDE, SIDE), np.uint8)
    dht, begin = _segments(images[0])
    head = images[0][:begin]
    if any(i[:begin] != head for i in images):
        return np.concatenate([decode_frames([i]) for i in images])
    value, size = decode_table(dht)
    body = np.frombuffer(b"".join([i[begin:-2] for i in images]) + b"\0\0\0\0", np.uint8)
    lengths = np.array([len(i) - begin - 2 for i in images], np.int64)
    stuffing = np.zeros(len(body), bool)
    stuffing[1:] = (body[:-1] == 255) & (body[1:] == 0)
    stuffing[-4:] = False
    gone = np.concatenate(([0], np.cumsum(stuffing)))
    start = np.cumsum(lengths) - lengths
    pos = (start - gone[start]) << 3
    clean = body[~stuffing].astype(np.uint32)
    ahead = (clean[:-2] << 16) | (clean[1:-1] << 8) | clean[2:]
    diffs = np.empty((FRAME_BYTES, len(images)), np.int32)
    for k in range(FRAME_BYTES):
        peek = (ahead[pos >> 3] >> (8 - (pos & 7)).astype(np.uint32)) & 0xFFFF
        diffs[k] = value[peek]
        pos = pos + size[peek]
    x = diffs.T.reshape(len(images), SIDE, SIDE)
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
    return (np.cumsum(x, axis=2) & 255).astype(np.uint8)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(images: Sequence[bytes], fps: int = FPS) -> bytes:
    """A RIFF AVI file with one MJPG stream and an ``idx1`` index."""
    most = max(map(len, images), default=0)
    n = len(images)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    lengths = np.array([len(i) for i in images], np.int64)
    index = np.empty((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.cumsum(8 + lengths + (lengths & 1)) - (8 + lengths + (lengths & 1))
    index[:, 3] = lengths
    movi = _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", i) for i in images]))
    return _chunk(b"RIFF", b"AVI " + header + movi + _chunk(b"idx1", index.tobytes()))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """Frame images in the order of the index, and frames per second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index, fps = 12, 8 + int.from_bytes(data[4:8], "little"), -1, None, float(FPS)
    while at + 8 <= end:
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            fps = 1e6 / int.from_bytes(data[at + 20 : at + 24], "little")
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", count=n // 16 * 4, offset=at + 8).reshape(-1, 4)
        at += 8 + n + (n & 1)
    if movi < 0 or index is None:
        raise ValueError("an AVI file without frames or index")
    rows = index[index[:, 0] == int.from_bytes(b"00dc", "little")]
    return [data[movi + o + 8 : movi + o + 8 + n] for o, n in rows[:, 2:].astype(np.int64).tolist()], fps


@dataclass(frozen=True)
class Clip:
    """Frames from ``first`` up to but not including ``last``, and when they are shown."""

    first: int
    last: int
    start_s: float
    end_s: float


def histogram_changes(frames: np.ndarray) -> np.ndarray:
    """Share of samples that change their bin from each frame to the next."""
    n = len(frames)
    if n < 2:
        return np.zeros(0)
    flat = (frames.reshape(n, -1) >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    counts = np.bincount(flat.ravel(), minlength=n * BINS).reshape(n, BINS)
    return np.abs(np.diff(counts, axis=0)).sum(axis=1) / (2.0 * FRAME_BYTES)


def shots(changes: np.ndarray, n_frames: int, fps: float = FPS) -> list[Clip]:
    """Clips between cuts: a change above the mean plus ``SHOT_SIGMAS`` deviations of the window before it, and above ``SHOT_LEAST``."""
    cuts = []
    if len(changes):
        total = np.concatenate(([0.0], np.cumsum(changes)))
        square = np.concatenate(([0.0], np.cumsum(changes * changes)))
        at = np.arange(len(changes))
        low = np.maximum(0, at - SHOT_WINDOW)
        seen = np.maximum(1, at - low)
        mean = (total[at] - total[low]) / seen
        spread = np.sqrt(np.maximum(0.0, (square[at] - square[low]) / seen - mean * mean))
        cuts = (np.flatnonzero((changes > mean + SHOT_SIGMAS * spread) & (changes >= SHOT_LEAST)) + 1).tolist()
    edges = [0, *cuts, n_frames]
    return [Clip(a, b, a / fps, b / fps) for a, b in zip(edges, edges[1:], strict=False)]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of a text in UTF-8, and those bytes filled up with ``PAD`` to whole frames, one at least."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes([PAD]) * (max(FRAME_BYTES, -(-len(data) // FRAME_BYTES) * FRAME_BYTES) - len(data))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Store each text as an AVI file and read it back. One row per input row.

    ``id_col``, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    clips (array of first, last, start_s, end_s), and media (the file) if asked for. Payload
    figures come from the samples that were decoded from the file. A null text counts as empty:
    one frame of padding. Texts of any length are stored whole, in as many frames as they need;
    equal texts give equal files; repeated rows stay; an empty table gives no rows; other columns
    are not looked at.
    """
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<first:int,last:int,start_s:double,end_s:double>>" + ", media binary" * keep_media
    clip_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), clip_type, *[pa.binary()] * keep_media]
    names = ["id", *(x.split()[0] for x in schema.split(", ")[1:8]), *["media"] * keep_media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sources = [payload_of(t) for t in batch.column("text").to_pylist()]
            counts = [len(p) // FRAME_BYTES for _, p in sources]
            edges = np.concatenate(([0], np.cumsum(counts))).tolist()
            coded = encode_frames(np.frombuffer(b"".join([p for _, p in sources]), np.uint8).reshape(-1, SIDE, SIDE))
            files = [write_avi(coded[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            del coded
            read = [read_avi(f) for f in files]
            frames = decode_frames([i for images, _ in read for i in images])
            changes = histogram_changes(frames)
            rows = []
            for (n, _), file, (images, fps), a, b in zip(sources, files, read, edges, edges[1:], strict=False):
                payload = frames[a:b].tobytes()
                clips = [c.__dict__ for c in shots(changes[a : b - 1], len(images), fps)]
                row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), clips)
                rows.append((*row, file) if keep_media else row)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`media_columns` with the clips as a ``feature`` string, ``start-end`` in seconds joined by commas."""
    clip = F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"]))
    return media_columns(docs, id_col, text_col, keep_media=False).withColumn("feature", F.array_join(clip, ",")).withColumn("n_clips", F.size("clips").cast("long")).drop("clips")
