"""AVI motion-JPEG columns: writing, RIFF index parsing, intra-frame decoding and shot detection.

Payload bytes are stored as one flat 8x8 block each: a baseline JPEG whose DC quantiser is 8 and whose blocks have no AC
terms gives every 8-bit sample back exactly, in any decoder. Its DC Huffman code has lengths 1 to 9 for categories 8 to
0, so that each block takes ten bits and frames of a file are packed and unpacked as arrays. Other baseline JPEG frames
(any Huffman tables, AC terms, sampling factors, restart intervals) are decoded block by block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, bounded_batches, extended

#: Blocks along a side of a frame that carries a payload, and the frame's payload bytes.
SIDE, FRAME = 24, 576
FRAMES_A_SECOND = 25


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Everything of a payload frame before its scan data.
HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00\x08" + b"\x01" * 63)
    + _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Ten-bit codes of the differences -255..255 (index 255 + difference), and the differences of all codes."""
    codes, back = np.zeros(511, np.uint16), np.zeros(1024, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1
        extra = d if d >= 0 else d + (1 << s) - 1
        codes[255 + d] = (prefix << s | extra) << 1
        back[codes[255 + d]] = d
    return codes, back


CODES, DIFFERENCES = _codes()


def padded(data: bytes) -> bytes:
    """data and bytes 255, up to a positive multiple of FRAME."""
    return data + b"\xff" * (-len(data) % FRAME or FRAME * (not data))


def write_avi(payload: bytes) -> bytes:
    """A motion-JPEG AVI file of payload, whose length is a positive multiple of FRAME."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int16) - 128
    t = CODES[255 + np.diff(samples, axis=1, prepend=0)].reshape(len(samples), -1, 4)
    packed = np.stack([t[..., 0] >> 2, (t[..., 0] & 3) << 6 | t[..., 1] >> 4, (t[..., 1] & 15) << 4 | t[..., 2] >> 6, (t[..., 2] & 63) << 2 | t[..., 3] >> 8, t[..., 3] & 255], axis=-1).astype(np.uint8)
    movi, index, at = [b"movi"], [], 4
    for row in packed.reshape(len(samples), -1):
        frame = HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movi.append(struct.pack("<4sI", b"00dc", len(frame)) + frame + b"\x00" * (len(frame) & 1))
        at += len(movi[-1])
    n, side = len(samples), SIDE * 8

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)

    avih = struct.pack("<14I", 1_000_000 // FRAMES_A_SECOND, 0, 0, 0x10, n, 0, 1, 0, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FRAMES_A_SECOND, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def read_index(media: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Seconds a frame, and (place, size) of every video frame: by the idx1 index, or else by walking the movi list.

    Bytes that are no AVI file, or a file cut short, give the frames that are whole.
    """
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        return 1 / FRAMES_A_SECOND, []
    seconds, movi, index, walked = 1 / FRAMES_A_SECOND, 0, b"", []

    def walk(at: int, end: int) -> None:
        nonlocal seconds, movi, index
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", media, at)
            body = at + 8
            if name == b"LIST":
                if media[body : body + 4] == b"movi":
                    movi = body
                walk(body + 4, min(body + size, end))
            elif name == b"avih" and size >= 4:
                seconds = (struct.unpack_from("<I", media, body)[0] or 1_000_000 // FRAMES_A_SECOND) / 1e6
            elif name == b"idx1":
                index = media[body : body + size]
            elif name[2:] in (b"dc", b"db") and name[:2].isdigit() and body + size <= end:
                walked.append((body, size))
            at = body + size + (size & 1)

    walk(12, len(media))
    entries = [e for e in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if e[0][2:] in (b"dc", b"db")]
    if not entries:
        return seconds, walked
    base = movi if media[movi + entries[0][2] : movi + entries[0][2] + 4] == entries[0][0] else 0  # offsets count from movi, or from the file's start
    return seconds, [(base + e[2] + 8, e[3]) for e in entries if base + e[2] + 8 + e[3] <= len(media)]


_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_COSINES = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def decode_jpeg(data: bytes) -> list[np.ndarray]:
    """The component planes of a baseline JPEG, at their own sampling; an error if it is of another kind."""
    quant, tables, parts, restart, at = {}, {}, [], 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while True:
        marker, size = struct.unpack_from(">xBH", data, at)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts, code, table = body[1:17], 0, {}
                values = iter(body[17 : 17 + sum(counts)])
                for n, count in enumerate(counts, 1):
                    for _ in range(count):
                        table[n, code] = next(values)
                        code += 1
                    code <<= 1
                tables[body[0]] = table
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(n)]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("no baseline JPEG")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    scan = data[at : data.rfind(b"\xff\xd9")]
    pieces, first = [], 0
    for i in range(len(scan) - 1):
        if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
            pieces.append(scan[first:i])
            first = i + 2
    pieces.append(scan[first:])
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    planes = [np.zeros((down * p[2] * 8, across * p[1] * 8)) for p in parts]
    mcu, per_piece = 0, restart or across * down
    for piece in pieces:
        bits = np.unpackbits(np.frombuffer(piece.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist() + [1] * 64
        pos, before = 0, [0] * len(parts)

        def symbol(table: dict) -> int:
            nonlocal pos
            code = 0
            for n in range(1, 17):
                code = code << 1 | bits[pos]
                pos += 1
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("a Huffman code that is not in the table")

        def extra(n: int) -> int:
            nonlocal pos
            value = 0
            for bit in bits[pos : pos + n]:
                value = value << 1 | bit
            pos += n
            return value if not n or value >> (n - 1) else value - (1 << n) + 1

        for mcu in range(mcu, min(mcu + per_piece, across * down)):
            row, col = divmod(mcu, across)
            for c, (ident, h, v, q) in enumerate(parts):
                dc, ac = tables[chosen[ident] >> 4], tables[16 | chosen[ident] & 15]
                for b in range(h * v):
                    block = np.zeros(64)
                    before[c] += extra(symbol(dc))
                    block[0] = before[c] * quant[q][0]
                    k = 1
                    while k < 64:
                        s = symbol(ac)
                        if not s & 15 and s != 0xF0:
                            break
                        k += s >> 4
                        if s & 15:
                            block[_ZIGZAG[k]] = extra(s & 15) * quant[q][k]
                        k += 1
                    y, x = (row * v + b // h) * 8, (col * h + b % h) * 8
                    planes[c][y : y + 8, x : x + 8] = _COSINES @ block.reshape(8, 8) @ _COSINES.T
        mcu += 1
    return [np.clip(np.round(p[: -(-height * part[2] // most_v), : -(-width * part[1] // most_h)] + 128), 0, 255).astype(np.uint8) for p, part in zip(planes, parts)]


def decode_frames(media: bytes, places: list[tuple[int, int]]) -> list[np.ndarray]:
    """The luma samples of every frame; of payload frames one per block, all at once."""
    out: list = [None] * len(places)
    scans, plain = [], []
    for i, (at, size) in enumerate(places):
        if media.startswith(HEAD, at) and len(scan := media[at + len(HEAD) : at + size - 2].replace(b"\xff\x00", b"\xff")) == FRAME * 10 // 8:
            scans.append(scan)
            plain.append(i)
        else:
            out[i] = decode_jpeg(media[at : at + size])[0].ravel()
    if scans:
        b = np.frombuffer(b"".join(scans), np.uint8).reshape(len(scans), -1, 5).astype(np.uint16)
        codes = np.stack([b[..., 0] << 2 | b[..., 1] >> 6, (b[..., 1] & 63) << 4 | b[..., 2] >> 4, (b[..., 2] & 15) << 6 | b[..., 3] >> 2, (b[..., 3] & 3) << 8 | b[..., 4]], axis=-1)
        samples = (np.cumsum(DIFFERENCES[codes.reshape(len(scans), -1)], axis=1, dtype=np.int16) + 128).astype(np.uint8)
        for i, row in zip(plain, samples):
            out[i] = row
    return out


def shots(frames: list[np.ndarray], bins: int = 16, window: int = 6, factor: float = 2.0, least: float = 0.08) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(first, end) of every shot, and the histogram differences between neighbours.

    A cut is where the difference, half the L1 distance of two frames' histograms, is above `least` and above the mean of
    the differences around it by `factor` of their standard deviations.
    """
    if not frames:
        return [], np.zeros(0)
    tall = np.stack([np.bincount(f >> 4 if bins == 16 else f.astype(np.int64) * bins // 256, minlength=bins) / max(1, len(f)) for f in frames])
    d = np.abs(np.diff(tall, axis=0)).sum(axis=1) / 2
    n = len(d)
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
    a, b = np.maximum(np.arange(n) - window, 0), np.minimum(np.arange(n) + window + 1, n)
    count = np.maximum(b - a - 1, 1)
    mean = (sums[b] - sums[a] - d) / count
    spread = np.sqrt(np.maximum((squares[b] - squares[a] - d * d) / count - mean * mean, 0))
    cuts = [0, *(np.flatnonzero((d > least) & (d > mean + factor * spread)) + 1).tolist(), len(frames)]
    return list(zip(cuts, cuts[1:])), d


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): every whole text, padded (see padded()), as an AVI file. Null and empty: one frame of bytes 255.

    A file is smaller than 2 GB, which is the bound of a binary value in Spark and Arrow: a text of over about 1.2 GB is an
    error, never a file that is cut.
    """
    bounded_batches(df.sparkSession)
    schema = extended(df.select(key).schema, "n_bytes bigint, media binary")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches(frames):
            texts = [t or b"" for t in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_avi(padded(t)) for t in texts], pa.binary())], schema.names)

    return df.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def clips(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per shot of every file: keep, clip, first_frame, n_frames, start_s, end_s.

    A file that is null, empty, no AVI or without whole frames has no clips. Files are decoded where they are: no shuffle.
    """
    bounded_batches(df.sparkSession)
    schema = extended(df.select(*keep).schema, "clip int, first_frame bigint, n_frames bigint, start_s double, end_s double")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches(frames):
            rows = []
            for i, data in enumerate(x.column(len(keep)).to_pylist()):
                seconds, places = read_index(data or b"")
                for k, (a, b) in enumerate(shots(decode_frames(data, places))[0] if places else []):
                    rows.append((i, k, a, b - a, a * seconds, b * seconds))
            own = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own[0], pa.int64())) for c in x.columns[: len(keep)]), *(pa.array(v, t) for v, t in zip(own[1:], (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())))], schema.names)

    return df.select(*keep, media).mapInArrow(run, schema)


def digests(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per file that store() made: what its frames hold, read back from the stored bytes, and its shots.

    payload_bytes, payload_sha256, tail_crc32 (of the last 32 of them), media_bytes, media_sha256, and feature: frames and
    seconds, then each shot as start-end in seconds.
    """
    bounded_batches(df.sparkSession)
    schema = extended(df.select(key, "n_bytes").schema, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_clips int")

    def one(data: bytes) -> tuple:
        seconds, places = read_index(data)
        frames = decode_frames(data, places)
        found, _ = shots(frames)
        payload = b"".join(f.tobytes() for f in frames)
        feature = f"{len(frames)} frames, {len(frames) * seconds:.2f} s: " + " ".join(f"{a * seconds:.2f}-{b * seconds:.2f}" for a, b in found)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(found)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
        for x in batches(frames):
            own = zip(*(one(data or b"") for data in x.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *(pa.array(v, t) for v, t in zip(own, types))], schema.names)

    return df.select(key, "n_bytes", media).mapInArrow(run, schema)
