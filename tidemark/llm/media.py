"""Media columns: lossless PNG payloads in binary columns, verified on reading, with DCT hashes.

Stored form: an 8-bit greyscale PNG, 64 samples wide. The writer lays out signature, IHDR, IDAT
and IEND with their CRC-32s; the reader walks the chunks, tests every checksum, inflates the
zlib stream and undoes the scanline filters with numpy. The perceptual hash keeps the 8 x 8 lowest
frequencies of a 32 x 32 cosine transform, one bit each against their median.

Defined cases: null text is the empty text, whose payload is 64 zero bytes; a null or broken media
cell gives null features and a message in `error`, never an exception; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import plus

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
GRID, KEPT = 32, 8
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: A zlib stream never inflates to more than so many times its length.
EXPANSION = 1032


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """An 8-bit greyscale PNG of the payload, whose length must be a positive multiple of width.

    One filter for the image, the one of None, Sub and Up with the least absolute residual.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    cost = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in (rows, sub, up)]
    kind = int(np.argmin(cost))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = (rows, sub, up)[kind]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unpredict(out: np.ndarray, a: int, b: int, kind: int, bpp: int) -> None:
    """Undoes Average (3) or Paeth (4) in rows a to b, whose samples need those to the left and above: a diagonal at a time."""
    h, w = b - a, out.shape[1] // bpp
    grid = np.zeros((h + 1, w + 1, bpp), np.int32)  # a row above, a column to the left
    grid[1:, 1:] = out[a:b].reshape(h, w, bpp)
    if a:
        grid[0, 1:] = out[a - 1].reshape(w, bpp)
    for t in range(h + w - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1)) + 1
        x = t + 2 - y
        left, above, corner = grid[y, x - 1], grid[y - 1, x], grid[y - 1, x - 1]
        if kind == 3:
            guess = (left + above) >> 1
        else:
            p = left + above - corner
            to_left, to_above, to_corner = np.abs(p - left), np.abs(p - above), np.abs(p - corner)
            guess = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        grid[y, x] = (grid[y, x] + guess) & 255
    out[a:b] = grid[1:, 1:].reshape(h, -1)


def _unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Samples of filtered scanlines (first byte of each: its filter); runs of one filter go at once."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown scanline filter")
    n, stride = out.shape
    starts = np.flatnonzero(np.diff(kinds, prepend=255))
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        kind = int(kinds[a])
        if kind == 1:
            block = out[a:b].reshape(b - a, -1, bpp)
            np.cumsum(block, axis=1, dtype=np.uint8, out=block)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind > 2:
            _unpredict(out, a, b, kind, bpp)
    return out


def decode_png(media: bytes) -> tuple[np.ndarray, int, int]:
    """(samples as rows x stride, width, channels). Raises ValueError on any damage."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("chunk is cut off")
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if len(body) != size or media[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of chunk {kind!r} fails")
        at += 12 + size
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("IHDR has a wrong length")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
    if head is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only 8-bit, not interlaced, without palette")
    stride = width * CHANNELS[colour]
    whole = height * (stride + 1)
    if not width or not height or whole > EXPANSION * sum(map(len, data)):
        raise ValueError(f"{width} x {height} samples are none, or more than the data can hold")
    try:  # no more than IHDR promises is ever inflated
        inflate = zlib.decompressobj()
        raw = inflate.decompress(b"".join(data), whole)
        more = b"" if inflate.eof else inflate.decompress(inflate.unconsumed_tail, 1)
    except zlib.error as err:
        raise ValueError(str(err)) from None
    if len(raw) != whole or more or not inflate.eof:
        raise ValueError("wrong amount of data")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, stride + 1), CHANNELS[colour]), width, CHANNELS[colour]


def _basis() -> np.ndarray:
    k, x = np.arange(KEPT)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * GRID))


_BASIS = _basis()


def _bins(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each of GRID cells over n samples, and the number of samples in each."""
    lo = np.arange(GRID) * n // GRID
    hi = np.maximum(np.append(lo[1:], n), lo + 1)
    return lo, hi - lo


def _cells(total: np.ndarray, axis: int) -> np.ndarray:
    n = total.shape[axis]
    lo, size = _bins(n)
    if n < GRID:
        return np.take(total, lo, axis)
    shape = [1, 1]
    shape[axis] = GRID
    return np.add.reduceat(total, lo, axis) / size.reshape(shape)


def perceptual_hash(samples: np.ndarray, width: int, channels: int = 1) -> bytes:
    """64 bits: the low frequencies of the cosine transform of the brightness, against their median."""
    grey = samples.reshape(len(samples), width, channels).mean(2) if channels > 1 else samples
    small = _cells(_cells(grey.astype(np.float64), 0), 1)
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def pad_text(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def text_media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text as PNG, reads the stored bytes back and describes both. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema if f.name != "doc_id"}
            for text in batch.column(1):
                n, payload = pad_text(text.as_py())
                media = encode_png(payload)
                samples, width, channels = decode_png(media)
                stored = samples.tobytes()
                mark = perceptual_hash(samples, width, channels)
                row = (n, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]), len(media), hashlib.sha256(media).hexdigest(), mark.hex(), mark)
                for key, value in zip(out, (*row, media) if keep_media else row, strict=True):
                    out[key].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[f.name], f.type) for f in schema if f.name != "doc_id")], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("phash", pa.binary())])
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, phash binary"
    if keep_media:
        schema, ddl = schema.append(pa.field("media", pa.binary())), ddl + ", media binary"
    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, ddl)


def media_features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds width, height, channels, sha256, phash and error of the PNG in a binary column."""

    def read(media: bytes | None) -> tuple:
        if media is None:
            return None, None, None, None, None, None
        try:
            samples, width, channels = decode_png(media)
        except ValueError as err:
            return None, None, None, None, None, str(err)
        return width, len(samples), channels, hashlib.sha256(samples.tobytes()).hexdigest(), perceptual_hash(samples, width, channels), None

    names = ("png_width", "png_height", "png_channels", "png_sha256", "png_phash", "png_error")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(x.as_py()) for x in batch.column(media_col)]
            extra = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    df = df.drop(*names)
    kinds = ("long", "long", "long", "string", "binary", "string")
    return df.mapInArrow(run, plus(df, **dict(zip(names, kinds, strict=True))))
