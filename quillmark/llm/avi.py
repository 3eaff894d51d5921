"""AVI motion-JPEG columns: write, index, decode intra frames, and cut shots."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a stored frame: each is one flat 8x8 block, which baseline coding keeps exactly.
COLS, ROWS = 16, 12
SAMPLES = COLS * ROWS
UNIT = 192
FPS = 25
BINS = 16
WINDOW = 8

# Fixed values of baseline JPEG: zigzag order and the usual luminance Huffman tables.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
     35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = tuple(range(12))
#: The AC table needs only the end of block: '00', beside one unused code.
AC_COUNTS = (0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
AC_VALUES = (0x00, 0x01)
QUANT_DC = 8
# The standard's own Huffman tables, which motion-JPEG frames leave out: (kind, id) -> counts, values.
_RUNS = lambda first, *rows: [r << 4 | s for r, a in zip(range(first, 16), rows, strict=False) for s in range(a, 11)]
STANDARD = {
    (0, 0): ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), list(range(12))),
    (0, 1): ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), list(range(12))),
    (1, 0): (
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        [0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1,
         0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0A, *_RUNS(1, 6, 5, 4, 3, 3, 3, 3, 3, 2, 2, 2, 2, 2, 1, 1)],
    ),
    (1, 1): (
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        [0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09,
         0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1, *_RUNS(1, 7, 6, 5, 3, 3, 3, 3, 2, 2, 2, 2, 2, 2, 2, 2)],
    ),
}
#: Coefficients of frames that are decoded at a time, and lists within lists of a file, at most.
MOST_COEFFICIENTS, MOST_DEPTH = 8_000_000, 16


def huffman(counts, values) -> dict[int, tuple[int, int]]:
    """value -> (code, length)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head() -> bytes:
    quant = bytes([0, QUANT_DC]) + bytes([1]) * 63
    sof = struct.pack(">BHHB", 8, ROWS * 8, COLS * 8, 1) + bytes([1, 0x11, 0])
    tables = bytes([0x00, *DC_COUNTS, *DC_VALUES, 0x10, *AC_COUNTS, *AC_VALUES])
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, sof) + _segment(0xC4, tables) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of a whole flat block, by difference + 255."""
    dc, eob = huffman(DC_COUNTS, DC_VALUES), huffman(AC_COUNTS, AC_VALUES)[0]
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, length = dc[cat]
        code = (code << cat) | (d if d >= 0 else d + (1 << cat) - 1)
        bits[d + 255], sizes[d + 255] = (code << eob[1]) | eob[0], length + cat + eob[1]
    return bits, sizes


HEAD = _head()
BITS, SIZES = _block_codes()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A baseline JPEG for each row of SAMPLES bytes; all rows are coded at once."""
    n = len(samples)
    if not n:
        return []
    diff = np.diff(samples.astype(np.int64), axis=1, prepend=128)
    size = SIZES[diff + 255]
    total = size.sum(axis=1)
    room = -(-total // 8) + 1
    base = np.cumsum(room) - room
    at = np.cumsum(size, axis=1) - size + 8 * base[:, None]
    word = (BITS[diff + 255] << (32 - size - (at & 7))).ravel()
    byte = (at >> 3).ravel()
    end = int(base[-1] + room[-1]) + 4
    out = np.zeros(end, np.float64)
    for k in range(4):
        out += np.bincount(byte + k, weights=(word >> (24 - 8 * k)) & 255, minlength=end)
    used = -(-total // 8)
    out = out.astype(np.int64)
    out[base + used - 1] |= (1 << (8 * used - total)) - 1  # the last byte is filled up by ones
    out = out.astype(np.uint8)
    frames = []
    for b, u in zip(base.tolist(), used.tolist(), strict=True):
        frames.append(HEAD + out[b : b + u].tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return frames


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI file whose frames store the payload, a multiple of UNIT bytes, one byte a flat block."""
    return mux(encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)), fps)


def mux(frames: list[bytes], fps: int = FPS) -> bytes:
    """RIFF/AVI of JPEG frames, with its idx1 index."""
    n, largest = len(frames), max(map(len, frames), default=0)
    width, height = COLS * 8, ROWS * 8
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH", 40, width, height, 1, 24) + b"MJPG" + struct.pack("<IiiII", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    index, at, parts = [], 4, []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        parts.append(_chunk(b"00dc", f))
        at += len(parts[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


class Chunks:
    """What a file's RIFF chunks hold: microseconds a frame, movi lists, the old index, and the entries of OpenDML ones."""

    def __init__(self, avi: bytes):
        self.avi, self.micros, self.movi, self.idx1, self.super = avi, 0, [], None, []
        if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
            raise ValueError("not a RIFF/AVI file")
        at = 0
        # Files of over a gigabyte go on in further RIFF chunks.
        while at + 12 <= len(avi) and avi[at : at + 4] == b"RIFF":
            if at and avi[at + 8 : at + 12] != b"AVIX":
                raise ValueError("a RIFF chunk after the first is no AVIX one")
            size = int.from_bytes(avi[at + 4 : at + 8], "little")
            if at and at + 8 + size > len(avi):
                raise ValueError("an AVIX chunk runs beyond the file")
            self._walk(at + 12, min(len(avi), at + 8 + size))
            at += 8 + size + (size & 1)
        if avi[at:].strip(b"\0"):
            raise ValueError("bytes after the last RIFF chunk belong to none")

    def _parts(self, at: int, end: int):
        """(kind, beginning, end) of the chunks between two places."""
        avi = self.avi
        while at + 8 <= end:
            body = at + 8
            size = int.from_bytes(avi[at + 4 : body], "little")
            if body + size > end:
                raise ValueError("a chunk runs beyond its list")
            yield avi[at : at + 4], body, body + size
            at = body + size + (size & 1)

    def _walk(self, at: int, end: int, depth: int = 0) -> None:
        if depth > MOST_DEPTH:
            raise ValueError("lists are nested too deep")
        for kind, body, stop in self._parts(at, end):
            if kind == b"LIST":
                if self.avi[body : body + 4] == b"movi":
                    self.movi.append((body, stop))
                else:
                    self._walk(body + 4, stop, depth + 1)
            elif kind == b"avih":
                self.micros = int.from_bytes(self.avi[body : body + 4], "little")
            elif kind == b"idx1":
                self.idx1 = self.idx1 or (body, stop)
            elif kind == b"indx" and self.avi[body + 8 : body + 12][2:] in VIDEO:
                self.super.append((body, stop))

    def frames(self, at: int, end: int, depth: int = 0):
        """(stream, offset, size) of the video frames between two places of a movi list, those in its rec lists included."""
        if depth > MOST_DEPTH:
            raise ValueError("lists are nested too deep")
        for kind, body, stop in self._parts(at, end):
            if kind == b"LIST":
                yield from self.frames(body + 4, stop, depth + 1)
            elif kind[2:] in VIDEO:
                yield kind[:2], body, stop - body

    def old_index(self):
        """Frames of idx1, which counts from the first movi list's name, or from the file's start where they lie beyond that."""
        avi, first = self.avi, self.movi[0][0]
        body, stop = self.idx1
        for kind, _, offset, size in struct.iter_unpack("<4sIII", avi[body : body + (stop - body) // 16 * 16]):
            if kind[2:] in VIDEO:
                at = first + offset if avi[first + offset : first + offset + 4] == kind else offset
                if avi[at : at + 4] != kind or at + 8 + size > len(avi):
                    raise ValueError("an index entry points at no frame")
                yield kind[:2], at + 8, size

    def chunk_index(self, body: int, stop: int):
        """Frames of an OpenDML index of chunks; a size's highest bit only says that a frame is no key frame."""
        avi = self.avi
        words, _, kind, n, name, base = struct.unpack("<HBBI4sQ", avi[body : body + 20])
        if kind != 1 or words != 2 or body + 24 + 8 * n > stop:
            raise ValueError("an index of chunks is of no known kind")
        for offset, size in struct.iter_unpack("<II", avi[body + 24 : body + 24 + 8 * n]):
            at, size = base + offset, size & 0x7FFFFFFF
            if at < 8 or at + size > len(avi) or avi[at - 8 : at - 4] != name:
                raise ValueError("an index entry points at no frame")
            yield name[:2], at, size

    def open_index(self):
        """Frames of the OpenDML indexes: of chunks, or of such indexes, anywhere in the file."""
        avi = self.avi
        for body, stop in self.super:
            if stop - body < 24:
                raise ValueError("an index breaks off")
            words, _, kind, n = struct.unpack("<HBBI", avi[body : body + 8])
            if kind == 1:
                yield from self.chunk_index(body, stop)
                continue
            if kind or words != 4 or body + 24 + 16 * n > stop:
                raise ValueError("an index of indexes is of no known kind")
            for offset, size, _ in struct.iter_unpack("<QII", avi[body + 24 : body + 24 + 16 * n]):
                if offset + 32 > len(avi) or avi[offset : offset + 2] != b"ix":
                    raise ValueError("an index entry points at no index")
                yield from self.chunk_index(offset + 8, min(len(avi), offset + 8 + int.from_bytes(avi[offset + 4 : offset + 8], "little")))


#: Last letters of a video chunk's name.
VIDEO = (b"dc", b"db")


def read_index(avi: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(microseconds a frame, [(offset, size) of each video frame]) by the file's indexes, else by its movi lists.

    OpenDML indexes hold for the whole file, the old one for the first movi list; lists that no index speaks of are
    read themselves, rec lists included.  An index that speaks of other frames than the lists have is an error, and
    so is a file with two video streams.
    """
    file = Chunks(avi)
    listed = [f for at, end in file.movi for f in file.frames(at + 4, end)]
    if file.super:
        found = list(file.open_index())
    elif file.idx1 is not None and file.movi:
        found = [*file.old_index(), *(f for at, end in file.movi[1:] for f in file.frames(at + 4, end))]
    else:
        found = listed
    if found is not listed and sorted(found) != sorted(listed):
        raise ValueError("the index and the lists have different frames")
    if len({stream for stream, _, _ in found}) > 1:
        raise ValueError("only files of one video stream are read")
    return file.micros, [(at, size) for _, at, size in found]


class FrameInfo:
    """Tables, size and components of a baseline JPEG of one or three components, up to its scan.

    plan lists the blocks of a unit of the scan as (component, DC table, AC table, quantisation table); a frame
    has units of them.  Tables that the frame leaves out are the standard's.
    """

    def __init__(self, frame: bytes):
        self.quant: dict[int, np.ndarray] = {}
        tables = {}
        at, found = 2, None
        if frame[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        while True:
            while frame[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(frame) or frame[at] != 0xFF:
                raise ValueError("a frame's header breaks off")
            marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
            body = frame[at + 4 : at + 2 + size]
            if size < 2 or len(body) != size - 2:
                raise ValueError("a frame's header breaks off")
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    table = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                    if len(table) != 64:
                        raise ValueError("a quantisation table breaks off")
                    self.quant[body[0] & 15], body = table, body[65 + 64 * wide :]
            elif marker == 0xC0:
                self.height, self.width = struct.unpack(">HH", body[1:5])
                if body[0] != 8 or body[5] not in (1, 3) or len(body) != 6 + 3 * body[5]:
                    raise ValueError("only 8-bit frames of one or three components are decoded")
                if not self.height or not self.width:
                    raise ValueError("a frame has no size")
                found = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, len(body), 3)]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                    if len(body) < 17 + n:
                        raise ValueError("a Huffman table breaks off")
                    body = body[17 + n :]
            elif marker == 0xDD:
                if body[:2] != b"\0\0":
                    raise ValueError("frames with restarts aren't decoded")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("only baseline frames are decoded")
            at += 2 + size
            if marker == 0xDA:
                break
        if found is None or body[0] != len(found):
            raise ValueError("a frame has no size before its scan" if found is None else "only frames of one scan are decoded")
        self.scan = at
        lookups = {}

        def lookup(kind: int, name: int) -> np.ndarray:
            if (kind, name) not in lookups:
                lookups[kind, name] = self._lookup(*(tables.get((kind, name)) or STANDARD[kind, name]))
            return lookups[kind, name]

        if len(found) == 1:
            found = [(found[0][0], 1, 1, found[0][3])]
        wide, high = 8 * max(c[1] for c in found), 8 * max(c[2] for c in found)
        if not wide or not high:
            raise ValueError("a component has no samples")
        self.units = -(-self.width // wide) * -(-self.height // high)
        self.plan = []
        for k, (name, across, down, quant) in enumerate(found):
            if body[1 + 2 * k] != name or not across or not down:
                raise ValueError("a scan's components aren't those of its frame")
            chosen = body[2 + 2 * k]
            self.plan += [(k, lookup(0, chosen >> 4), lookup(1, chosen & 15), self.quant[quant])] * (across * down)

    @property
    def blocks(self) -> int:
        """Blocks of the first component, which shows brightness."""
        return self.units * sum(p[0] == 0 for p in self.plan)

    @staticmethod
    def _lookup(counts, values) -> np.ndarray:
        """By the next 16 bits: value << 5 | code length; 0 where no code fits."""
        out = np.zeros(65_536, np.int64)
        for value, (code, length) in huffman(counts, values).items():
            out[code << (16 - length) : (code + 1) << (16 - length)] = value << 5 | length
        return out


class NotFlat(ValueError):
    """A block has more than its level."""


def decode_blocks(frames: list[bytes], info: FrameInfo, flat: bool = False) -> np.ndarray:
    """Coefficients (frame, block, 64) of the first component in zigzag order, undone of quantisation.

    All frames share info's tables and go in step: each pass decodes one symbol of every frame that still has
    some, so Python's work is by symbols of one frame and not of all.  flat: only levels are wanted, one a
    block; NotFlat is raised where a block has more.
    """
    parts = [f[info.scan : len(f) if (e := f.rfind(b"\xff\xd9")) < info.scan else e].replace(b"\xff\x00", b"\xff") for f in frames]
    total = info.units * len(info.plan)
    if any(4 * len(p) < total for p in parts):
        raise ValueError("a frame is too short for its size")  # a block has two bits at least
    sizes = np.array([len(p) + 8 for p in parts], dtype=np.int64)
    data = np.frombuffer(b"".join(p + b"\xff" * 8 for p in parts), np.uint8).astype(np.int64)
    base = np.cumsum(sizes) - sizes
    window = (data << 24) | (np.append(data[1:], 255) << 16) | (np.append(data[2:], (255, 255)) << 8) | np.append(data[3:], (255,) * 3)
    pos, end = 8 * base, 8 * (base + sizes - 8)
    n = len(frames)
    out = None if flat else np.zeros((n, info.blocks, 64), np.int32)
    level, levels, done = {k: np.zeros(n, np.int64) for k, *_ in info.plan}, np.empty((n, info.blocks), np.int64), 0

    def amplitude(at, size):
        bits = (window[at >> 3] << (at & 7) & 0xFFFFFFFF) >> (32 - size)
        return np.where((size > 0) & (bits < 1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)

    def symbol(table, at):
        s = table[(window[at >> 3] << (at & 7) & 0xFFFFFFFF) >> 16]
        if not (s & 31).all():
            raise ValueError("a frame has no such code")
        return s

    for b in range(total):
        component, dc, ac, quant = info.plan[b % len(info.plan)]
        if (pos > end).any():
            raise ValueError("a frame ends early")
        s = symbol(dc, pos)
        pos = pos + (s & 31)
        level[component] = level[component] + amplitude(pos, s >> 5)
        pos = pos + (s >> 5)
        own = component == 0
        if own:
            levels[:, done] = level[0] * quant[0]
        if out is None:
            s = symbol(ac, pos)
            if ((s >> 5) != 0).any():
                raise NotFlat("a block isn't flat")
            pos = pos + (s & 31)
            done += own
            continue
        k, live = np.ones(n, np.int64), np.arange(n)
        while len(live):
            s = symbol(ac, pos[live])
            run, size = s >> 9, s >> 5 & 15
            p = pos[live] + (s & 31)
            value = amplitude(p, size)
            pos[live] = np.minimum(p + size, end[live] + 32)
            last = (size == 0) & (run < 15)
            k[live] += run
            put = size > 0
            if (k[live[put]] > 63).any():
                raise ValueError("a block has too many coefficients")
            if own:
                out[live[put], done, k[live[put]]] = value[put] * quant[k[live[put]]]
            k[live] += 1
            live = live[~last & (k[live] < 64)]
        done += own
    if (pos > end).any():
        raise ValueError("a frame ends early")
    if out is None:
        return levels[:, :, None]
    out[:, :, 0] = levels
    return out


_K = np.arange(8)
DCT = np.sqrt(np.where(_K[:, None] == 0, 1, 2) / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """(frame, block, samples) brightness 0..255 of frames with one header: 64 a block, or 1 where all are flat."""
    info = FrameInfo(frames[0])
    head = frames[0][: info.scan]
    if any(f[: info.scan] != head for f in frames):
        raise ValueError("frames with different headers are decoded apart")
    try:
        if len(info.plan) > 1:
            raise NotFlat("frames of colour are decoded whole")
        coef = decode_blocks(frames, info, flat=True)
    except NotFlat:
        coef = decode_blocks(frames, info)
    if coef.shape[2] == 1:
        return np.clip((coef + 1024 + 4) >> 3, 0, 255).astype(np.uint8)
    grid = np.zeros(coef.shape, np.float64)
    grid[:, :, ZIGZAG] = coef
    pixels = np.einsum("ux,nbuv,vy->nbxy", DCT, grid.reshape(*coef.shape[:2], 8, 8), DCT, optimize=True)
    return np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).reshape(*coef.shape[:2], 64)


def file_histograms(avi: bytes) -> tuple[int, np.ndarray]:
    """(microseconds a frame, histogram of each frame) of one file.

    Frames with one header go together, at most MOST_COEFFICIENTS at a time.  A frame without bytes repeats
    the one before; the first may not be such a one.
    """
    micros, index = read_index(avi)
    groups: dict[bytes, list[int]] = {}
    blocks = {}
    for k, (a, n) in enumerate(index):
        if n:
            info = FrameInfo(avi[a : a + n])
            head = avi[a : a + info.scan]
            if 4 * (n - info.scan) < info.units * len(info.plan):
                raise ValueError("a frame is too short for its size")
            blocks[head] = info.blocks
            groups.setdefault(head, []).append(k)
    hist, from_ = np.zeros((len(index), BINS)), np.zeros(len(index), np.int64)
    for head, own in groups.items():
        step = max(1, MOST_COEFFICIENTS // (64 * blocks[head]))
        for a in range(0, len(own), step):
            part = own[a : a + step]
            hist[part] = histograms(decode_frames([avi[index[k][0] : index[k][0] + index[k][1]] for k in part]))
    if index:
        from_ = np.maximum.accumulate(np.where([n > 0 for _, n in index], np.arange(len(index)), -1))
        if from_[0] < 0:
            raise ValueError("the first frame has no bytes")
    return micros, hist[from_]


def histograms(pixels: np.ndarray) -> np.ndarray:
    """Shares of BINS grey levels by frame."""
    n = len(pixels)
    level = pixels.reshape(n, -1) // (256 // BINS)
    flat = np.bincount((np.arange(n)[:, None] * BINS + level).ravel(), minlength=n * BINS)
    return flat.reshape(n, BINS) / max(1, level.shape[1])


def differences(hist: np.ndarray) -> np.ndarray:
    """Half the L1 distance of each frame's histogram and the one before; 0 for the first."""
    out = np.zeros(len(hist))
    if len(hist) > 1:
        out[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    return out


def shot_starts(diff: np.ndarray, window: int = WINDOW, factor: float = 2.0, floor: float = 0.2) -> np.ndarray:
    """First frames of shots: frame 0, and where the difference tops `floor` and an adaptive threshold.

    The threshold is mean + factor * deviation of the up to `window` differences before it.
    """
    n = len(diff)
    if not n:
        return np.zeros(0, np.int64)
    s1, s2 = np.concatenate(([0.0], np.cumsum(diff))), np.concatenate(([0.0], np.cumsum(diff * diff)))
    i = np.arange(n)
    low = np.maximum(i - window, np.minimum(1, i))
    count = np.maximum(i - low, 1)
    mean = (s1[i] - s1[low]) / count
    var = np.maximum((s2[i] - s2[low]) / count - mean * mean, 0)
    cut = (diff > floor) & (diff > mean + factor * np.sqrt(var) + 1e-9)
    cut[0] = True
    return np.flatnonzero(cut)


def clips(micros: int, diff: np.ndarray) -> list[dict]:
    """Timed clip rows of a file: clip, first and last frame, start and end in microseconds."""
    starts = shot_starts(diff).tolist()
    ends = [*starts[1:], len(diff)]
    return [{"clip": k, "first_frame": a, "last_frame": b - 1, "start_us": a * micros, "end_us": b * micros} for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if b > a]


def read_avi(avi: bytes) -> tuple[int, np.ndarray]:
    """(microseconds a frame, pixels) of one file."""
    micros, index = read_index(avi)
    if not index:
        return micros, np.zeros((0, 0, 1), np.uint8)
    return micros, decode_frames([avi[a : a + n] for a, n in index])


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its payload): UTF-8, filled up by spaces to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def store_texts(texts: list[str | None]) -> list[tuple[int, bytes]]:
    """(bytes of the text, AVI file) of each; frames of all texts are coded together."""
    made = [padded(t) for t in texts]
    payload = b"".join(p for _, p in made)
    frames = encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES))
    out, at = [], 0
    for n, p in made:
        k = len(p) // SAMPLES
        out.append((n, mux(frames[at : at + k])))
        at += k
    return out


def digest_files(files: list[bytes]) -> list[dict]:
    """Payload digests and features of stored files, read back from their bytes; frames go in step."""
    indexes = [read_index(f) for f in files]
    frames = [f[a : a + n] for f, (_, index) in zip(files, indexes, strict=True) for a, n in index]
    pixels = decode_frames(frames)
    diff_all = histograms(pixels)
    out, at = [], 0
    for f, (micros, index) in zip(files, indexes, strict=True):
        own = pixels[at : at + len(index), :, 0]
        payload = own.tobytes()
        cut = clips(micros, differences(diff_all[at : at + len(index)]))
        at += len(index)
        out.append(
            {
                "payload_bytes": len(payload),
                "payload_sha256": hashlib.sha256(payload).hexdigest(),
                "tail_crc32": zlib.crc32(payload[-16:]),
                "media_bytes": len(f),
                "media_sha256": hashlib.sha256(f).hexdigest(),
                "feature": f"frames={len(index)};clips={len(cut)};starts={','.join(str(c['start_us']) for c in cut)}",
            }
        )
    return out


def avi_clips(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of a column of AVI files: id, clip, first_frame, last_frame, start_us, end_us, error.

    Grey and colour baseline frames are read, with their own or the standard's Huffman tables; shots show in the
    brightness.  A null, empty or broken file, whatever is wrong with it, gives one row with nulls and its
    error, and the others go on; a file without frames gives none; null ids and repeated rows stay, other columns
    are not looked at, and an empty table gives no rows.  Files in several RIFF segments, with rec lists, and with
    old or OpenDML indexes are read whole.  A file is one value, and of its frames so many are decoded at a time as
    MOST_COEFFICIENTS allow.
    """
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches):
        names = ["clip", "first_frame", "last_frame", "start_us", "end_us", "error"]
        for b in batches:
            rows = []
            for i, media in zip(b["id"], b["media"], strict=True):
                try:
                    micros, hist = file_histograms(bytes(media if media is not None else b""))
                    rows += [{"id": i, **c, "error": None} for c in clips(micros, differences(hist))]
                except Exception as e:  # noqa: BLE001  whatever a file's bytes bring about is that file's
                    rows.append({"id": i, "error": f"{type(e).__name__}: {e}"})
            out = pd.DataFrame(rows, columns=["id", *names])
            yield out.astype({c: "Int64" for c in names[:-1]})

    return files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInPandas(run, f"id {kind}, clip int, first_frame int, last_frame int, start_us long, end_us long, error string").withColumnRenamed("id", id_col)


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text as an AVI file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "media": [m for _, m in store_texts(list(b["text"]))]})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, media binary")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Each text is stored as an AVI file and the row comes from reading that file's bytes back.  Null texts
    count as empty and store UNIT spaces; null ids and repeated rows stay; other columns are ignored; a very long
    text is one row's file; an empty table gives no rows.  Work is per row, in groups of about group_bytes, without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            texts, start, size = list(b["text"]), 0, 0
            for i, t in enumerate([*texts, None]):
                if start < i and (i == len(texts) or size + len(t or "") > group_bytes):
                    stored = store_texts(texts[start:i])
                    rows = pd.DataFrame(digest_files([m for _, m in stored]), columns=names)
                    rows.insert(0, "n_bytes", [n for n, _ in stored])
                    rows.insert(0, "doc_id", b["doc_id"].iloc[start:i].to_numpy())
                    yield rows
                    start, size = i, 0
                size += len(t or "")

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
