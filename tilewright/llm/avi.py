"""AVI motion JPEG: RIFF indexes, intra frames, shots by adaptive histogram differences.

Frames are baseline greyscale JPEG. write() stores payload bytes as samples: each byte is
the level of one 8x8 block of a frame of 24x24 blocks (192x192 pixels), whose only
coefficient is the DC at quantiser 8, so that a decoder's flat block is that byte exactly.
The Huffman table gives category s a code of 9 - s bits; code and magnitude together
always take 9 bits and the end-of-block code 1, so a block takes 10 bits and both
directions run on whole arrays. frames() follows the RIFF index; decoded() gives the luma of any
baseline frame, coefficients transformed back to pixels. Tables such as ours take the array
path, others the bitwise one."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
FRAME_BYTES = SIDE * SIDE
FPS = 25
BINS = 16

#: Zigzag scan of 8x8 coefficients.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else i % 8))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _codes() -> np.ndarray:
    """By DC difference + 255: the 10 bits of a block. Category s has the code of 8 - s ones and a zero; 0 has eight ones and a zero."""
    d = np.arange(-255, 256)
    s = np.zeros(511, np.int64)
    for i in range(8):
        s[np.abs(d) >= 1 << i] = i + 1
    prefix = np.where(s > 0, (1 << (9 - s)) - 2, 0b111111110)
    low = np.where(d < 0, d + (1 << s) - 1, d)
    return np.where(s > 0, ((prefix << s) | low) << 1, prefix << 1).astype(np.uint64)


_CODE = _codes()
_DIFF = np.full(1024, 999, np.int64)
_DIFF[_CODE.astype(np.int64)] = np.arange(-255, 256)
#: Category 8 has one bit, 7 two, ... 1 eight, 0 nine.
_DC_COUNTS = bytes([1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
_DC_VALUES = bytes([8, 7, 6, 5, 4, 3, 2, 1, 0])
_AC_COUNTS = bytes([1] + [0] * 15)
_AC_VALUES = bytes([0])
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([8]) + bytes([1] * 63))
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, bytes([0x00]) + _DC_COUNTS + _DC_VALUES)
    + _segment(0xC4, bytes([0x10]) + _AC_COUNTS + _AC_VALUES)
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)
_TAIL = b"\xff\xd9"


def payload_of(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of a frame's bytes."""
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME_BYTES)) * FRAME_BYTES - len(raw))


def _scans(samples: np.ndarray) -> Iterator[bytes]:
    """The entropy-coded data of each row of samples."""
    n = len(samples)
    d = np.empty(samples.shape, np.int64)
    d[:, 0] = samples[:, 0].astype(np.int64) - 128
    d[:, 1:] = np.diff(samples.astype(np.int64), axis=1)
    c = _CODE[d + 255].reshape(n, -1, 4)
    word = (c[:, :, 0] << np.uint64(30)) | (c[:, :, 1] << np.uint64(20)) | (c[:, :, 2] << np.uint64(10)) | c[:, :, 3]
    five = word.astype(">u8").view(np.uint8).reshape(n, -1, 8)[:, :, 3:]
    flat = np.ascontiguousarray(five).reshape(n, -1)
    for row in flat:
        yield row.tobytes().replace(b"\xff", b"\xff\x00")


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write(payload: bytes) -> bytes:
    """An AVI file with an idx1 index whose decoded block levels are the payload, of a multiple of 576 bytes."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME_BYTES)
    movi, index, at = [b"movi"], [], 4
    for at0 in range(0, len(samples), 1024):
        for scan in _scans(samples[at0 : at0 + 1024]):
            c = _chunk(b"00dc", _HEAD + scan + _TAIL)
            index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(_HEAD) + len(scan) + 2))
            movi.append(c)
            at += len(c)
    n = len(index)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, SIDE * 8, SIDE * 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, SIDE * 8, SIDE * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE * 8, SIDE * 8, 1, 24, b"MJPG", 0, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start of the body, its length) of the chunks in data[at:end]; a body that runs over is cut."""
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        n = min(n, end - at - 8)
        yield name, at + 8, n
        at += 8 + n + n % 2


def frames(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """(frames a second, (offset, length) of each video frame), by the index idx1, else by OpenDML indexes, else by the movi list.

    Raises ValueError for what isn't an AVI file."""
    if data[:4] != b"RIFF" or data[8:12] not in (b"AVI ", b"AVIX"):
        raise ValueError("not a RIFF AVI file")
    fps, stream, streams, movi, found, super_index = float(FPS), None, 0, [], [], []
    for top, start, n in _chunks(data, 0, len(data)):
        if top != b"RIFF":
            continue
        for name, at, size in _chunks(data, start + 4, start + n):
            kind = data[at : at + 4]
            if name == b"LIST" and kind == b"hdrl":
                for sub, a, m in _chunks(data, at + 4, at + size):
                    if sub == b"avih" and m >= 4 and (us := struct.unpack_from("<I", data, a)[0]):
                        fps = 1e6 / us
                    if sub == b"LIST" and data[a : a + 4] == b"strl":
                        for x, b, k in _chunks(data, a + 4, a + m):
                            if x == b"strh" and k >= 28 and data[b : b + 4] == b"vids" and stream is None:
                                stream = b"%02d" % streams
                                scale, rate = struct.unpack_from("<II", data, b + 20)
                                fps = rate / scale if scale and rate else fps
                            elif x == b"indx" and k >= 24 and stream == b"%02d" % streams:
                                used = struct.unpack_from("<I", data, b + 4)[0]
                                super_index += [struct.unpack_from("<QI", data, b + 24 + 16 * i)[0] for i in range(min(used, (k - 24) // 16))]
                        streams += 1
            elif name == b"LIST" and kind == b"movi":
                movi.append((at, size))
            elif name == b"idx1" and movi:
                own = stream or b"00"
                entries = [(c, o, s) for c, _, o, s in struct.iter_unpack("<4sIII", data[at : at + size - size % 16])]
                base = movi[0][0]
                if entries and data[base + entries[0][1] : base + entries[0][1] + 4] != entries[0][0]:
                    base = 0  # offsets from the file's start
                found += [(base + o + 8, s) for c, o, s in entries if c[:2] == own and c[2:] in (b"dc", b"db")]
    if super_index and not found:
        for at in super_index:
            used, base = struct.unpack_from("<I", data, at + 12)[0], struct.unpack_from("<Q", data, at + 20)[0]
            found += [(base + o, s & 0x7FFFFFFF) for o, s in (struct.unpack_from("<II", data, at + 32 + 8 * i) for i in range(used))]
    if not found:
        for at, size in movi:
            todo = [(at + 4, at + size)]
            for a, b in todo:
                for name, x, k in _chunks(data, a, b):
                    if name == b"LIST":
                        todo.append((x + 4, x + k))
                    elif name[:2] == (stream or b"00") and name[2:] in (b"dc", b"db"):
                        found.append((x, k))
    return fps, found


def _huffman(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    table, code, j = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            table[length, code] = values[j]
            code, j = code + 1, j + 1
        code <<= 1
    return table


#: The tables of frames that have none, by class and number: those of the JPEG standard, K.3.
_USUAL = {
    which: _huffman(bytes.fromhex(counts), bytes.fromhex(values))
    for which, counts, values in (
        (0x00, "00010501010101010100000000000000", "000102030405060708090a0b"),
        (0x01, "00030101010101010101010000000000", "000102030405060708090a0b"),
        (0x10, "0002010303020403050504040000017d", "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
        (0x11, "00020102040403040705040400010277", "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")),
    )
}


class _Head:
    """What the markers before the scan say. The first component is the luma."""

    def __init__(self, jpeg: bytes) -> None:
        if jpeg[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        self.tables = dict(_USUAL)
        quant, at = {0: [1] * 64}, 2
        self.quantiser, self.restart = 1, 0
        while True:
            while jpeg[at + 1] == 0xFF:  # fill bytes
                at += 1
            marker, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
            body = jpeg[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide, which = body[i] >> 4, body[i] & 15
                    quant[which] = list(struct.unpack_from(">64H" if wide else ">64B", body, i + 1))
                    i += 129 if wide else 65
            elif marker in (0xC0, 0xC1):
                bits, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError("only 8-bit frames")
                self.parts = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15) for i in range(6, 6 + 3 * parts, 3)}
                self.luma, self.quantiser = body[6], body[8]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline JPEG")
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    which, counts = body[i], body[i + 1 : i + 17]
                    self.tables[which] = _huffman(counts, body[i + 17 :])
                    i += 17 + sum(counts)
            elif marker == 0xDD:
                self.restart = struct.unpack_from(">H", body)[0]
            elif marker == 0xDA:
                scanned = [(body[i], self.tables[body[i + 1] >> 4], self.tables[0x10 | body[i + 1] & 15]) for i in range(1, 1 + 2 * body[0], 2)]
                break
        self.step = quant[self.quantiser]
        self.scan_at = at
        if scanned[0][0] != self.luma:
            raise ValueError("the first scan has no luma")
        self.dc, self.ac = scanned[0][1:]
        most_h, most_v = (max(p[i] for p in self.parts.values()) for i in (0, 1))
        h, v = self.parts[self.luma]
        self.across, self.down = -(-self.width * h // (8 * most_h)), -(-self.height * v // (8 * most_v))
        self.blocks = self.across * self.down
        self.luma_height, self.luma_width = -(-self.height * v // most_v), -(-self.width * h // most_h)
        #: Of a unit of the scan, each block's component and tables; and the luma's blocks in it, across and down.
        alone = len(scanned) == 1
        self.unit = [(c, dc, ac) for c, dc, ac in scanned for _ in range(1 if alone else self.parts[c][0] * self.parts[c][1])]
        self.h, self.v = (1, 1) if alone else (h, v)
        self.units = (self.across, self.down) if alone else (-(-self.width // (8 * most_h)), -(-self.height // (8 * most_v)))
        self.fixed = len(self.parts) == 1 and not self.restart and self.dc == _OUR_DC and self.ac == {(1, 0): 0} and self.step[0] == 8 and self.blocks % 4 == 0


_OUR_DC = {(n, (1 << n) - 2): 9 - n for n in range(1, 10)}


def _coefficients(head: _Head, *scans: bytes) -> np.ndarray:
    """(blocks, 64): the luma's coefficients in the order of the scan, by rows of blocks, for any Huffman tables. The
    scans are what lies between the restart markers."""
    scan, at, left = b"", 0, list(scans[::-1])

    def take(n: int) -> int:
        nonlocal at
        a = at
        at += n
        if at > 8 * len(scan):
            raise ValueError("the scan ends early")
        return (int.from_bytes(scan[a >> 3 : (at + 7) >> 3], "big") >> (-at & 7)) & ((1 << n) - 1)

    def symbol(table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def value(s: int) -> int:
        v = take(s)
        return v if v >> (s - 1) else v - (1 << s) + 1

    across, down = head.units
    out, level = np.zeros((down * head.v, across * head.h, 64), np.int64), {}
    for u in range(across * down):
        if u == 0 or head.restart and u % head.restart == 0:
            if not left:
                raise ValueError("the scan ends early")
            scan, at, level = left.pop(), 0, dict.fromkeys(head.parts, 0)
        y, x = divmod(u, across)
        for b, (part, dc, ac) in enumerate(head.unit):
            own = out[y * head.v + b // head.h, x * head.h + b % head.h] if part == head.luma else None
            s = symbol(dc)
            if s:
                level[part] += value(s)
            if own is not None:
                own[0] = level[part]
            k = 1
            while k < 64:
                r = symbol(ac)
                if r == 0:
                    break
                k += r >> 4
                if r & 15:
                    v = value(r & 15)
                    if own is not None and k < 64:
                        own[k] = v
                k += 1
    return out[: head.down, : head.across].reshape(-1, 64)


def _levels_bitwise(head: _Head, *scans: bytes) -> np.ndarray:
    """Mean level of each luma block, which its DC coefficient is."""
    mean = _coefficients(head, *scans)[:, 0] * head.step[0] / 8 + 128
    return np.clip(np.floor(mean + 0.5), 0, 255).astype(np.uint8)


#: The cosines of the transform: row u has those of frequency u at the eight places.
_COSINES = np.array([[(0.5**0.5 if u == 0 else 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _pixels(head: _Head, *scans: bytes) -> np.ndarray:
    """The luma as (height, width) levels: coefficients times their steps, transformed back."""
    flat = np.zeros((head.blocks, 64))
    flat[:, ZIGZAG] = _coefficients(head, *scans) * np.array(head.step)
    blocks = _COSINES.T @ flat.reshape(-1, 8, 8) @ _COSINES + 128
    whole = blocks.reshape(head.down, head.across, 8, 8).swapaxes(1, 2).reshape(head.down * 8, head.across * 8)
    return np.clip(np.floor(whole[: head.luma_height, : head.luma_width] + 0.5), 0, 255).astype(np.uint8)


#: What a file or frame that can't be read raises.
UNREADABLE = (ValueError, IndexError, KeyError, struct.error)
#: A marker that ends a scan; in a scan 0xFF is followed by 0 or by a restart marker.
_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


def levels(data: bytes, where: list[tuple[int, int]]) -> list[np.ndarray]:
    """Block levels of the frames; frames with the tables of write() are decoded together."""
    return _frames_of(data, where, _levels_bitwise, None)


def decoded(data: bytes, where: list[tuple[int, int]]) -> tuple[list[np.ndarray], list[int]]:
    """(levels of the frames' luma, frames that can't be decoded): each frame's pixels, or of frames of write(), whose
    blocks are flat, a level a block. What can't be decoded repeats the frame before; a ValueError if that is all."""
    bad: list[int] = []
    out = _frames_of(data, where, lambda head, *scans: _pixels(head, *scans).ravel(), bad)
    return out, bad


def _frames_of(data: bytes, where: list[tuple[int, int]], decode, bad: list[int] | None) -> list[np.ndarray]:
    """decode(head, scans) of each frame; the numbers of those that fail go into bad, without which a failure is an error."""
    heads: dict[bytes, _Head] = {}
    out: list[np.ndarray | None] = [None] * len(where)
    packed, rows = [], []
    for i, (at, n) in enumerate(where):
        if n == 0 and i:  # a dropped frame repeats the last
            continue
        jpeg = data[at : at + n]
        try:
            begin = jpeg.index(b"\xff\xda")
            key = jpeg[: begin + 2 + struct.unpack_from(">H", jpeg, begin + 2)[0]]
            head = heads.get(key) or heads.setdefault(key, _Head(jpeg))
            end = _SCAN_END.search(jpeg, head.scan_at)
            scans = [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(jpeg[head.scan_at : end.start() if end else n])]
            if head.fixed and len(scans[0]) == head.blocks * 10 // 8:
                packed.append(scans[0])
                rows.append(i)
            else:
                out[i] = decode(head, *scans)
        except UNREADABLE:
            if bad is None:
                raise
            bad.append(i)
    for at in range(0, len(rows), 1024):
        own = packed[at : at + 1024]
        if len({len(x) for x in own}) > 1:
            for i, x in zip(rows[at : at + 1024], own, strict=True):
                out[i] = _unpack([x])[0]
        else:
            for i, x in zip(rows[at : at + 1024], _unpack(own), strict=True):
                out[i] = x
    if bad and len(bad) == len(where):
        raise ValueError("no frame can be decoded")
    last = next((x for x in out if x is not None), None)
    for i, x in enumerate(out):
        out[i] = last = last if x is None else x
    return out


def _unpack(scans: list[bytes]) -> np.ndarray:
    n = len(scans)
    five = np.frombuffer(b"".join(scans), np.uint8).reshape(n, -1, 5).astype(np.uint64)
    word = np.zeros(five.shape[:2], np.uint64)
    for i in range(5):
        word = (word << np.uint64(8)) | five[:, :, i]
    codes = np.stack([(word >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=2).reshape(n, -1)
    return (np.cumsum(_DIFF[codes.astype(np.int64)], axis=1) + 128).astype(np.uint8)


def histograms(frames_: list[np.ndarray]) -> np.ndarray:
    """Share of each of BINS level ranges by frame."""
    out = np.empty((len(frames_), BINS))
    for at in range(0, len(frames_), 1024):
        own = frames_[at : at + 1024]
        sizes = np.array([len(x) for x in own])
        key = np.repeat(np.arange(len(own)), sizes) * BINS + (np.concatenate(own) >> (8 - BINS.bit_length() + 1))
        out[at : at + 1024] = np.bincount(key, minlength=len(own) * BINS).reshape(-1, BINS) / sizes[:, None]
    return out


def shots(hist: np.ndarray, window: int = 12, factor: float = 3.0, floor: float = 0.15) -> list[int]:
    """First frames of shots. A cut stands where the histogram difference to the frame before is the
    largest within `window` frames around (the first of equals), over `floor`, and over mean + factor *
    standard deviation of the other differences in that window."""
    n = len(hist)
    cuts = [0] if n else []
    if n < 2:
        return cuts
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    s1, s2 = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    for i in np.flatnonzero(d > floor):
        a, b = max(0, i - window), min(n - 1, i + window + 1)
        k = b - a - 1
        if i != a + int(np.argmax(d[a:b])):
            continue
        mean = (s1[b] - s1[a] - d[i]) / k if k else 0.0
        var = max(0.0, (s2[b] - s2[a] - d[i] ** 2) / k - mean**2) if k else 0.0
        if d[i] > mean + factor * var**0.5:
            cuts.append(int(i) + 1)
    return cuts


def clips_of(data: bytes) -> list[tuple[int, float, float, int, int]]:
    """(number, start s, end s, first frame, frames) of each shot of an AVI file."""
    return _clips(data)[0]


def _clips(data: bytes) -> tuple[list[tuple[int, float, float, int, int]], int]:
    """clips_of(), and how many frames are unreadable."""
    fps, where = frames(data)
    shown, bad = decoded(data, where)
    return timed(shots(histograms(shown)), len(where), fps), len(bad)


def timed(cuts: list[int], n: int, fps: float) -> list[tuple[int, float, float, int, int]]:
    """(number, start s, end s, first frame, frames) of the shots that begin at cuts of n frames."""
    return [(i, a / fps, b / fps, a, b - a) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], n], strict=False))]


CLIP = "array<struct<clip:int,start_s:double,end_s:double,first_frame:int,n_frames:int>>"


def detect_clips(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each shot: id, clip, start_s, end_s, first_frame, n_frames, error, bad_frames.

    A null or unreadable file, or one of unreadable frames only, gives one row with error set and null clip columns; a
    file without frames gives none. An unreadable frame among others counts as the one before it again, and into
    bad_frames. Repeated rows are each detected; other columns are not read."""
    schema = pa.schema([("k", pa.string()), ("clips", pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("first_frame", pa.int32()), ("n_frames", pa.int32())]))), ("error", pa.string()), ("bad_frames", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("clip", "start_s", "end_s", "first_frame", "n_frames")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, got, errors, bads = batch.slice(at, 64), [], [], []
                for data in part.column(1).to_pylist():
                    try:
                        found, bad = _clips(data or b"")
                        got.append([dict(zip(names, c, strict=True)) for c in found])
                        errors.append(None)
                        bads.append(bad)
                    except UNREADABLE as e:
                        got.append([dict.fromkeys(names)])
                        errors.append(str(e) or type(e).__name__)
                        bads.append(None)
                yield pa.RecordBatch.from_pydict({"k": part.column(0), "clips": got, "error": errors, "bad_frames": bads}, schema=schema)

    rows = df.select(df[id_col].cast("string").alias("k"), df[media_col]).mapInArrow(run, f"k string, clips {CLIP}, error string, bad_frames int")
    return rows.select(F.col("k").cast(df.schema[id_col].dataType).alias(id_col), F.inline("clips"), "error", "bad_frames")


def digest(df: DataFrame) -> DataFrame:
    """Stores every text as a file, reads it back and returns what was read, with the features of its shots and the shots
    themselves, start and end in seconds. One row for each row of df: null texts are empty, null ids and repeated rows
    get their own rows, and other columns are not read."""
    types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_clips", pa.int64()), ("clips", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, rows = batch.slice(at, 128), []
                for text in part.column(1).to_pylist():
                    raw = (text or "").encode()
                    media = write(payload_of(raw))
                    fps, where = frames(media)
                    got = levels(media, where)
                    back = b"".join([x.tobytes() for x in got])
                    hist = histograms(got)
                    cuts = shots(hist)
                    feature = ",".join(str(c) for c in cuts) + "|" + ",".join(f"{x:.4f}" for x in hist.mean(axis=0))
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(cuts), ",".join(f"{a:.2f}-{b:.2f}" for _, a, b, _, _ in timed(cuts, len(got), fps))))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(cols, types[1:], strict=True))], names=[n for n, _ in types])

    return df.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in types))
