"""Frames of other writers: colour with sampled chroma (Java's encoder), without Huffman tables, with restart markers."""

import random
import re
import struct

import numpy as np
import pytest

from tilewright.llm import avi


def segments(jpeg):
    """(marker, bytes) up to the scan, and the rest."""
    at, out = 2, []
    while jpeg[at + 1] != 0xDA:
        n = struct.unpack_from(">H", jpeg, at + 2)[0]
        out.append((jpeg[at + 1], jpeg[at : at + 2 + n]))
        at += 2 + n
    return out, jpeg[at:]


@pytest.mark.parametrize("width,height", [(64, 48), (40, 24), (37, 21)])
def test_colour(spark, width, height):
    jvm, rng = spark.sparkContext._jvm, random.Random(width)
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    down, across = -(-height // 8), -(-width // 8)
    grey = [[rng.randrange(20, 236) for _ in range(across)] for _ in range(down)]
    for y in range(height):
        for x in range(width):
            image.setRGB(x, y, grey[y // 8][x // 8] * 0x010101)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    jpeg = bytes(out.toByteArray())
    parts, rest = segments(jpeg)
    frame = next(b for m, b in parts if m == 0xC0)
    assert frame[9] == 3 and frame[11] == 0x22  # three components, luma two by two
    bare = b"\xff\xd8" + b"".join(b for m, b in parts if m != 0xC4) + rest
    for data in (jpeg, bare):
        got = avi.levels(data, [(0, len(data))])[0].astype(int)
        full = got.reshape(down, across)[: height // 8, : width // 8]
        assert np.abs(full - np.array(grey)[: height // 8, : width // 8]).max() <= 6


def test_restart_markers():
    payload = random.Random(7).randbytes(2 * 576)
    media = avi.write(payload)
    (a, n), (b, k) = avi.frames(media)[1]
    parts, rest = segments(media[a : a + n])
    scan = lambda at, size: media[at + avi._Head(media[at : at + size]).scan_at : at + size].split(b"\xff\xd9")[0]
    head = b"\xff\xd8"
    for marker, data in parts:
        if marker == 0xC0:
            data = data[:5] + struct.pack(">H", 2 * struct.unpack_from(">H", data, 5)[0]) + data[7:]
        head += data
    begin = rest[: 2 + struct.unpack_from(">H", rest, 2)[0]]
    jpeg = head + b"\xff\xdd\x00\x04" + struct.pack(">H", 576) + begin + scan(a, n) + b"\xff\xd0" + scan(b, k) + b"\xff\xd9"
    assert re.search(b"\xff\xd0", jpeg) and avi.levels(jpeg, [(0, len(jpeg))])[0].tobytes() == payload


def test_pixels_of_another_encoder(spark):
    """Pixels as another decoder has them, within its rounding; AC coefficients count."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(33, 26, 10)
    for y in range(26):
        for x in range(33):
            image.getRaster().setSample(x, y, 0, (x * 7 + y * y) % 200 + 20)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    jpeg = bytes(out.toByteArray())
    again = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(out.toByteArray())).getRaster()
    want = np.array([[again.getSample(x, y, 0) for x in range(33)] for y in range(26)])
    (got,), bad = avi.decoded(jpeg, [(0, len(jpeg))])
    assert not bad and np.abs(got.reshape(26, 33).astype(int) - want).max() <= 1 and want.std() > 40


def test_unreadable_frames(spark):
    media = bytearray(avi.write(np.concatenate([np.full(576 * 20, 30, np.uint8), np.full(576 * 20, 200, np.uint8)]).tobytes()))
    where = avi.frames(bytes(media))[1]
    at, n = where[5]
    media[at : at + n] = b"\x00" * n
    df = spark.createDataFrame([(1, bytes(media), 7)], "id long, media binary, clip int")
    out = avi.detect_clips(df, "id", "media").collect()
    assert [(r.clip, r.start_s, r.end_s, r.bad_frames, r.error) for r in out] == [(0, 0.0, 0.8, 1, None), (1, 0.8, 1.6, 1, None)]
    for at, n in where:
        media[at : at + n] = b"\x00" * n
    out = avi.detect_clips(spark.createDataFrame([(1, bytes(media))], "id long, media binary"), "id", "media").collect()
    assert len(out) == 1 and out[0].error and out[0].clip is None


def test_digest_columns(spark):
    import hashlib
    import zlib

    texts = ["", None, "a" * 1000, "é" * 700, "a" * 1000, "".join(chr(32 + i % 90) for i in range(40_000))]
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    out = avi.digest(spark.createDataFrame(rows, "doc_id long, text string, feature string, clips int")).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for i, t, *_ in rows:
        payload = avi.payload_of((t or "").encode())
        media = avi.write(payload)
        r = got[i]
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        hist = avi.histograms(avi.levels(media, avi.frames(media)[1]))
        assert r.feature.startswith(",".join(map(str, avi.shots(hist))) + "|") and r.clips.count("-") == r.n_clips and r.clips.endswith(f"{len(hist) / 25:.2f}")
    assert got[2][1:] == got[4][1:] and got[0][1:] == got[1][1:]
