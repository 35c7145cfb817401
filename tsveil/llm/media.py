"""Operator 1, media columns: payloads as PNG in binary columns, read back through checked chunks, with a perceptual hash.

A PNG is its signature, IHDR, IDAT chunks (one zlib stream of filtered rows) and IEND; every chunk ends in a CRC-32,
and zlib's own Adler-32 guards the pixels. Decoding tests all of them and undoes the row filters with numpy. The hash
is the signs, against their median, of the low frequencies of a two-dimensional cosine transform of the image
shrunk to 32 x 32 (area means), the constant term left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tsveil.llm.base import map_batches, utf8

WIDTH = 64
SIDE = 32
LOW = 8
#: PNG, fixed values: signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Bytes of an IDAT chunk at most, and of rows that are filtered at once.
CHUNK, BLOCK = 1 << 16, 1 << 20


class MediaError(ValueError):
    """The bytes aren't a whole PNG of a supported kind: a bad signature, order, checksum, length or filter."""


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def guesses(pixels: np.ndarray, bpp: int, above: np.ndarray) -> Iterator[np.ndarray]:
    """What each filter from 1 to 4 takes off the rows (height, row bytes) that follow the row `above`."""
    up = np.concatenate([above[None], pixels[:-1]])
    left, corner = np.zeros_like(pixels), np.zeros_like(pixels)
    left[:, bpp:], corner[:, bpp:] = pixels[:, :-bpp], up[:, :-bpp]
    yield left
    yield up
    yield ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    yield paeth(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)


def filter_rows(pixels: np.ndarray, bpp: int, above: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """Rows with their filter byte in front. kinds: the filter of each row; None: of none, left and up (which whole arrays undo) the one of least sum of differences."""
    out = np.empty((pixels.shape[0], pixels.shape[1] + 1), np.uint8)
    body = out[:, 1:]
    body[:] = pixels
    if kinds is not None:
        out[:, 0] = kinds
        for kind, guess in enumerate(guesses(pixels, bpp, above), 1) if kinds.any() else ():
            body[kinds == kind] -= guess[kinds == kind]
        return out
    least, best = np.abs(pixels.view(np.int8)).sum(axis=1, dtype=np.int64), np.zeros(len(pixels), np.uint8)
    for kind, guess in zip((1, 2), guesses(pixels, bpp, above), strict=False):
        rest = pixels - guess
        size = np.abs(rest.view(np.int8)).sum(axis=1, dtype=np.int64)
        better = size < least
        body[better] = rest[better]
        best[better] = kind
        least = np.minimum(least, size)
    out[:, 0] = best
    return out


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, up and corner the nearest to left + up - corner; ties in that order."""
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def unfilter(raw: np.ndarray, bpp: int, above: np.ndarray) -> np.ndarray:
    """The pixels (height, row bytes) of filtered rows that follow the row `above`, all rows at once."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise MediaError("unknown row filter")
    if kinds.max(initial=0) > 2:
        return unfilter_diagonals(rows, kinds, bpp, above)
    left = kinds == 1
    if left.any():
        rows[left] = np.cumsum(rows[left].reshape(-1, rows.shape[1] // bpp, bpp), axis=1, dtype=np.uint8).reshape(-1, rows.shape[1])
    if (kinds == 2).any():
        # sums down the columns, less those up to the last row that isn't filtered by the one above
        base = np.maximum.accumulate(np.where(kinds == 2, 0, np.arange(1, len(rows) + 1)))
        rows = np.concatenate([above[None], rows])
        sums = np.cumsum(rows, axis=0, dtype=np.uint8)
        rows = sums[1:] - sums[base] + rows[base]
    return rows


def unfilter_diagonals(rows: np.ndarray, kinds: np.ndarray, bpp: int, above: np.ndarray) -> np.ndarray:
    """unfilter() for rows of any kinds: pixels of one diagonal need those of earlier diagonals only, and are undone together."""
    height, width = rows.shape[0], rows.shape[1] // bpp
    out = np.zeros((height + 1, width + 1, bpp), np.int16)
    out[0, 1:] = above.reshape(width, bpp)
    body = rows.reshape(height, width, bpp)
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        a, b, c, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) >> 1, paeth(a, b, c)], 0)
        out[y + 1, x + 1] = (body[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)


def encode_png(pixels: np.ndarray, kind: int | np.ndarray | None = None, level: int = 1) -> bytes:
    """A PNG of 8-bit samples: (height, width) grey, or (height, width, 1 to 4) grey, grey-alpha, RGB or RGBA.

    kind: the filter of all rows or of each; None: chosen row by row. Rows are filtered and packed BLOCK bytes at a time.
    """
    height, width = pixels.shape[:2]
    bands = 1 if pixels.ndim == 2 else pixels.shape[2]
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[bands]
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(height, width * bands)
    kinds = None if kind is None else np.broadcast_to(np.asarray(kind, np.uint8), (height,))
    pack, step, above = zlib.compressobj(level), max(1, BLOCK // (width * bands)), np.zeros(width * bands, np.uint8)
    parts, held = [SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0))], bytearray()
    for y in range(0, height, step):
        block = rows[y : y + step]
        held += pack.compress(filter_rows(block, bands, above, None if kinds is None else kinds[y : y + step]))
        above = block[-1]
        while len(held) >= CHUNK:
            parts.append(chunk(b"IDAT", bytes(held[:CHUNK])))
            del held[:CHUNK]
    held += pack.flush()
    parts += [chunk(b"IDAT", bytes(held[i : i + CHUNK])) for i in range(0, len(held), CHUNK)]
    return b"".join([*parts, chunk(b"IEND", b"")])


def inflate(bodies: list[memoryview], row: int) -> Iterator[np.ndarray]:
    """Whole rows of `row` bytes of a zlib stream in parts, about BLOCK bytes at a time. MediaError if the stream is broken, or ends early or late."""
    stream, held = zlib.decompressobj(), b""
    try:
        for body in bodies:
            while len(body):
                held += stream.decompress(body, BLOCK)
                body = stream.unconsumed_tail if not stream.eof else stream.unused_data
                if stream.eof and len(body):
                    raise MediaError("bytes after the stream")
                whole = len(held) // row * row
                if whole >= BLOCK or stream.eof:
                    yield np.frombuffer(held[:whole], np.uint8).reshape(-1, row)
                    held = held[whole:]
        held += stream.flush()
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if not stream.eof or len(held) % row:
        raise MediaError("wrong number of samples")
    if held:
        yield np.frombuffer(held, np.uint8).reshape(-1, row)


def decode_png(data: bytes) -> np.ndarray:
    """Samples (height, width, bands) of an 8-bit, not interlaced PNG; a palette image gives RGB. MediaError for all else."""
    if data[:8] != SIGNATURE:
        raise MediaError("not a PNG")
    data = memoryview(data)
    at, head, packed, palette, ended = 8, None, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise MediaError("cut off")
        (size,), kind = struct.unpack_from(">I", data, at), bytes(data[at + 4 : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(data):
            raise MediaError("cut off")
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise MediaError(f"bad checksum of {kind!r}")
        at += 12 + size
        if (head is None) != (kind == b"IHDR"):
            raise MediaError("IHDR isn't the first chunk, or comes again")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise MediaError(f"unknown critical chunk {kind!r}")
    if head is None or not ended or at != len(data):
        raise MediaError("no IHDR, no IEND, or bytes after it")
    width, height, depth, colour, compression, filtering, interlace = head
    if depth != 8 or colour not in CHANNELS or compression or filtering or interlace or not width or not height or (colour == 3) > (palette is not None):
        raise MediaError("only 8-bit images without interlace are supported")
    bands = CHANNELS[colour]
    pixels, y, above = np.empty((height, width * bands), np.uint8), 0, np.zeros(width * bands, np.uint8)
    for raw in inflate(packed, width * bands + 1):
        if y + len(raw) > height:
            raise MediaError("wrong number of samples")
        pixels[y : y + len(raw)] = unfilter(raw, bands, above)
        y += len(raw)
        above = pixels[y - 1]
    if y != height:
        raise MediaError("wrong number of samples")
    pixels = pixels.reshape(height, width, bands)
    if colour == 3:
        if pixels.max() >= len(palette):
            raise MediaError("a sample outside the palette")
        pixels = palette[pixels[..., 0]]
    return pixels


def cosine_basis(side: int = SIDE, low: int = LOW) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(side)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * side)) * np.where(k, np.sqrt(2 / side), np.sqrt(1 / side))


BASIS = cosine_basis()


def shrink(grey: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Area means over side x side cells; a side of fewer pixels repeats them. Only sums up to the cells' edges are made."""
    for axis in (0, 1):
        n = grey.shape[axis]
        if n == side:
            continue
        edges = np.arange(side + 1) * n / side
        whole = np.minimum(edges.astype(np.int64), n - 1)
        part = (edges - whole).reshape((-1, 1) if axis == 0 else (1, -1))
        sums = np.stack(
            [(grey[a:b] if axis == 0 else grey[:, a:b]).sum(axis=axis, dtype=np.float64) for a, b in pairwise(whole)],
            axis=axis,
        )
        total = np.concatenate([np.zeros_like(sums.take([0], axis)), np.cumsum(sums, axis=axis)], axis=axis)
        grey = np.diff(total + part * grey.take(whole, axis), axis=axis) * side / n
    return np.asarray(grey, np.float64)


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hexadecimal digits: which low frequencies exceed their median; the constant term's bit is 0."""
    bands = 3 if pixels.shape[-1] > 2 else 1
    grey = sum(shrink(pixels[..., k]) for k in range(bands)) / bands
    low = np.round(BASIS @ grey @ BASIS.T, 6).reshape(-1)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload_image(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The bytes and zeros up to a positive multiple of width, as rows of grey samples."""
    size = max(1, -(-len(text) // width)) * width
    return np.frombuffer(text.ljust(size, b"\0"), np.uint8).reshape(-1, width)


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(stored: bytes) -> tuple:
    """The columns of SCHEMA but the first, read back from a stored payload."""
    pixels = decode_png(stored)
    payload = pixels.reshape(-1)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(pixels)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col and the columns of SCHEMA. The text is stored as PNG in a binary column, which a second step reads.

    A null text counts as empty: one row of 64 zeros. Texts of any length are stored whole, 64 samples a row, in blocks: a
    step holds some four bytes for a byte of its longest text. Repeated rows give repeated rows, equal texts equal
    values, an empty table an empty result. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(features(media.as_py()) for media in b.column(2)), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(rows, types, strict=True))],
                names=names,
            )

    names = [id_col, *(x.split()[0] for x in SCHEMA.split(", "))]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in SCHEMA.split(", ")[1:]]
    return map_batches(store_text(df, id_col, text_col), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, {SCHEMA}")


def image_features(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """id_col, width, height, bands, feature, error of PNG bytes in a column; a null or damaged image has an error text and no features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(1).to_pylist():
                try:
                    pixels = decode_png(data or b"")
                    out.append((pixels.shape[1], pixels.shape[0], pixels.shape[2], cosine_hash(pixels), None))
                except MediaError as e:
                    out.append((None, None, None, None, str(e)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 3 + [pa.string()] * 2, strict=True))],
                names=[id_col, "width", "height", "bands", "feature", "error"],
            )

    return map_batches(
        df.select(id_col, media_col),
        run,
        f"`{id_col}` {dict(df.dtypes)[id_col]}, width int, height int, bands int, feature string, error string",
    )


def store_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (of the text alone) and media: the text's payload as PNG bytes (null: as an empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in utf8(b.column(1))]
            media = pa.array([encode_png(payload_image(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(len, texts)), pa.int64()), media],
                names=[id_col, "n_bytes", "media"],
            )

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_bytes long, media binary")
