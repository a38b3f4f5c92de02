import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import media

from .util import SF, crowded, empty_docs, odd_docs, odd_rows, rows_of


def hold(rows, docs):
    want = sorted((i if i is not None else -99, *expected(t)) for i, t in docs)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows)
    assert got == want


def expected(text):
    raw = (text or "").encode()
    payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]) & 0xFFFFFFFF


def test_payloads(spark):
    rows = rows_of(media.text_media_columns(odd_docs(spark)))
    hold(rows, [(r[0], r[1]) for r in odd_rows()])
    same = [r for r in rows if r["doc_id"] in (7, -3) and r["n_bytes"] == 150]
    assert len(same) == 3 and len({(r["media_sha256"], r["feature"], r["media_bytes"]) for r in same}) == 1
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hold(rows_of(media.text_media_columns(docs)), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert media.text_media_columns(empty_docs(spark)).count() == 0


def filtered(samples: np.ndarray, kinds: list[int], bpp: int) -> bytes:
    """A plain scanline filter, byte by byte."""
    out = bytearray()
    for y, row in enumerate(samples):
        kind = kinds[y % len(kinds)]
        out.append(kind)
        for x in range(len(row)):
            a = int(row[x - bpp]) if x >= bpp else 0
            b = int(samples[y - 1][x]) if y else 0
            c = int(samples[y - 1][x - bpp]) if y and x >= bpp else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((int(row[x]) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
    return bytes(out)


def png(samples: np.ndarray, colour: int, width: int, kinds: list[int], cuts: int = 1) -> bytes:
    body = zlib.compress(filtered(samples, kinds, media.CHANNELS[colour]))
    step = -(-len(body) // cuts)
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(samples), 8, colour, 0, 0, 0)) + b"".join(chunk(b"IDAT", body[k : k + step]) for k in range(0, len(body), step)) + chunk(b"tEXt", b"note") + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_reader_undoes_every_filter(colour):
    rng = np.random.default_rng(colour)
    samples = rng.integers(0, 256, (19, 13 * media.CHANNELS[colour])).astype(np.uint8)
    for kinds in ([0], [1], [2], [3], [4], [1, 1, 2, 2, 4, 3, 0], [2], [4, 2, 2, 1]):
        got, width, channels = media.decode_png(png(samples, colour, 13, kinds, cuts=3))
        assert (got == samples).all() and (width, channels) == (13, media.CHANNELS[colour])


def test_damage_is_reported(spark):
    good = media.encode_png(bytes(range(128)))
    flipped = bytearray(good)
    flipped[50] ^= 1
    cells = [(1, bytearray(good)), (2, flipped), (3, None), (4, bytearray(good[:-5])), (5, bytearray(b"GIF89a")), (6, bytearray())]
    rows = {r["png_id"]: r for r in rows_of(media.media_features(spark.createDataFrame(cells, "png_id long, media binary")))}
    assert rows[1]["png_error"] is None and rows[1]["png_sha256"] == hashlib.sha256(bytes(range(128))).hexdigest()
    assert all(rows[k]["png_error"] and rows[k]["png_phash"] is None for k in (2, 4, 5, 6)) and "checksum" in rows[2]["png_error"]
    assert rows[3]["png_error"] is None and rows[3]["png_width"] is None


def test_no_media_cell_raises(spark):
    """Heads of wrong lengths and sizes, streams that hold less or more than the head says, and random damage."""
    samples = np.arange(128, dtype=np.uint8).reshape(2, 64)
    good, body = media.encode_png(samples.tobytes()), zlib.compress(filtered(samples, [0], 1))
    head = lambda w, h, *more: struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)[: more[0] if more else 13]
    made = lambda h, b: media.SIGNATURE + media._chunk(b"IHDR", h) + media._chunk(b"IDAT", b) + media._chunk(b"IEND", b"")
    bomb = zlib.compress(bytes(50_000_000))
    cells = [made(head(64, 2, 12), body), made(head(64, 2) + b"\0", body), made(head(0, 2), body), made(head(64, 0), body), made(head(1 << 31, 1 << 31), body), made(head(64, 3), body), made(head(64, 1), body), made(head(64, 2), bomb), made(head(64, 2), body[:-3]), made(head(64, 2), b"")]
    rng = np.random.default_rng(4)
    for _ in range(200):
        junk = bytearray(good)
        for _ in range(3):
            junk[int(rng.integers(len(junk)))] = int(rng.integers(256))
        cells.append(bytes(junk))
    cells = [c for c in cells if c != good]
    rows = rows_of(media.media_features(spark.createDataFrame([(bytearray(c),) for c in cells], "media binary")))
    assert len(rows) == len(cells) and all(r["png_error"] and r["png_sha256"] is None for r in rows)
    assert media.decode_png(made(head(64, 2), body))[0].tobytes() == samples.tobytes()


def test_clashing_columns_stay(spark):
    docs = crowded(odd_docs(spark)).withColumn("png_width", F.lit("mine"))
    assert len(rows_of(media.text_media_columns(docs))) == len(odd_rows())
    out = media.media_features(docs.withColumn("media", F.lit(b"x")))
    assert out.filter("key = 'mine'").count() == len(odd_rows()) and dict(out.dtypes)["png_width"] == "bigint"


def test_hash_follows_low_frequencies():
    y, x = np.mgrid[0:96, 0:128]
    rng = np.random.default_rng(1)

    def picture():
        waves = [rng.normal(0, 60 / (1 + i + j)) * np.cos(np.pi * i * (2 * x + 1) / 256) * np.cos(np.pi * j * (2 * y + 1) / 192) for i in range(8) for j in range(8)]
        return 128 + sum(waves)

    base, other = picture(), picture()
    noisy = base + rng.normal(0, 3, base.shape)
    h = [int.from_bytes(media.perceptual_hash(np.clip(z, 0, 255).astype(np.uint8), 128), "big") for z in (base, noisy, other)]
    assert (h[0] ^ h[1]).bit_count() <= 6 and (h[0] ^ h[2]).bit_count() >= 18
