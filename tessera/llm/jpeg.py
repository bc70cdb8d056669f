"""Progressive JPEG: bytes stored losslessly as DCT coefficients, and a decoder to full-resolution RGB tensors."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, table, utf8


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order: along diagonals, turning at each end."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_U = np.arange(8)
_COS = np.where(_U[:, None] == 0, np.sqrt(1 / 8), np.sqrt(1 / 4)) * np.cos((2 * _U[None, :] + 1) * _U[:, None] * np.pi / 16)
#: (coefficient in scan order, sample): whole numbers, so sums in float64 are exact in any order.
FRACTION = 13
BASIS = np.rint(np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG] * (1 << FRACTION))
#: The same divided by a power of two, so sums stay exact.
_INVERSE = BASIS / (1 << FRACTION)
CHUNK = 1 << 13
#: FF is followed by 0 inside a segment and may be repeated before a marker.
_MARKER = re.compile(rb"\xff[\x01-\xfe]")
#: Frames that are not progressive with Huffman codes.
_OTHER_FRAMES = frozenset((0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)))
#: Pixels of the largest image: its RGB bytes must fit into one Arrow value.
MOST_PIXELS = (2**31 - 1024) // 3


@lru_cache(maxsize=256)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits ahead: code length << 8 | symbol."""
    out, code = [0] * 65536, 0
    at = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = [length << 8 | symbols[at]] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def _bytes_read(size: int, low: int) -> np.ndarray:
    """The coefficient that each byte stands for whose last `size` bits are its value, shifted by low."""
    values = np.arange(256, dtype=np.int32) & ((1 << size) - 1)
    return np.where(values >> (size - 1), values, values - (1 << size) + 1) * np.int32(1 << low)


def _rows(blocks: np.ndarray) -> slice | np.ndarray:
    """Rising numbers of blocks as a slice if none is left out."""
    first, last = int(blocks[0]), int(blocks[-1])
    return slice(first, last + 1) if last - first + 1 == len(blocks) else blocks


@dataclass
class Component:
    h: int
    v: int
    quant: int
    rows: int = 0  # blocks that the component itself has
    cols: int = 0
    shape: tuple[int, ...] = ()
    grid: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))  # with the blocks that fill the last MCUs


class Units:
    """The data units of a scan in coding order."""

    def __init__(self, number: np.ndarray, blocks: np.ndarray, per_mcu: int, components: int):
        self.blocks, self.per_mcu, self.components = blocks, per_mcu, components
        self.number = number.tolist()  # of the component in the scan
        #: For each component its places in that order and its blocks' numbers.
        self.own = [(at, blocks[at]) for at in (np.flatnonzero(number == n) for n in range(components))] if components > 1 else [(slice(None), blocks)]

    def part(self, first: int, last: int) -> Units:
        """Those between two restarts."""
        if first == 0 and last >= len(self.blocks):
            return self
        return Units(np.array(self.number[first:last], np.int64), self.blocks[first:last], self.per_mcu, self.components)


def _units(scan: tuple[tuple[int, int, int, int, int], ...], mcu_rows: int, mcu_cols: int) -> Units:
    """Units of components of (h, v, rows, columns, columns of the grid)."""
    if len(scan) == 1:
        _, _, rows, cols, width = scan[0]
        blocks = (np.arange(rows)[:, None] * width + np.arange(cols)).ravel()
        return Units(np.zeros(len(blocks), np.int64), blocks, 1, 1)
    number, blocks = [], []
    for n, (h, v, _, _, width) in enumerate(scan):
        r = (np.arange(mcu_rows) * v)[:, None, None, None] + np.arange(v)[None, None, :, None]
        k = (np.arange(mcu_cols) * h)[None, :, None, None] + np.arange(h)[None, None, None, :]
        own = (r * width + k).reshape(-1, v * h)
        blocks.append(own)
        number.append(np.full(own.shape, n))
    return Units(np.concatenate(number, 1).ravel(), np.concatenate(blocks, 1).ravel(), sum(h * v for h, v, *_ in scan), len(scan))


#: Units of small images, of which many have one shape.
_units_again = lru_cache(maxsize=512)(_units)
#: Blocks of the largest of them.
SMALL = 1536


class Bits:
    """One entropy-coded segment without stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0

    def code(self, lookup: list[int]) -> int:
        p = self.at >> 3
        got = lookup[(int.from_bytes(self.data[p : p + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF]
        if not got:
            raise ValueError("no such Huffman code")
        self.at += got >> 8
        return got & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        p = self.at >> 3
        out = (int.from_bytes(self.data[p : p + 4], "big") >> (32 - n - (self.at & 7))) & ((1 << n) - 1)
        self.at += n
        return out

    def many(self, n: int) -> np.ndarray:
        """The next n bits, one a byte."""
        first = self.at >> 3
        out = np.unpackbits(np.frombuffer(self.data, np.uint8)[first : (self.at + n + 7) >> 3])[self.at & 7 :][:n]
        self.at += n
        return out


def _extended(bits: int, size: int) -> int:
    return bits if bits >> (size - 1) else bits - (1 << size) + 1


class Decoder:
    """Progressive JPEG (SOF2, 8 bits, Huffman codes, any sampling factors, restart intervals) to coefficient arrays and RGB."""

    def __init__(self, data: bytes):
        self.components: dict[int, Component] = {}
        self.order: list[int] = []
        self.quants: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        self.comments: list[bytes] = []
        self.restart = self.width = self.height = 0
        self.ended = False
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        at = 2
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("no marker where one must be")
            while data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            if marker == 0xD9:
                self.ended = True
                break
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC2:
                self._frame(body)
            elif marker in _OTHER_FRAMES:
                raise ValueError("not progressive with Huffman codes")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDA:
                at = self._scan(body, data, at)
        if not self.components or not self.ended:
            raise ValueError("the image has no frame or no end")

    def _frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if precision != 8 or not self.width or not self.height or n not in (1, 3) or self.width * self.height > MOST_PIXELS:
            raise ValueError("only 8-bit samples in one or three components, some, and no more than a tensor holds")
        for i in range(n):
            c, hv, q = body[6 + 3 * i : 9 + 3 * i]
            self.components[c] = Component(hv >> 4, hv & 15, q)
            self.order.append(c)
        self.hmax, self.vmax = max(c.h for c in self.components.values()), max(c.v for c in self.components.values())
        self.mcu_cols, self.mcu_rows = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.components.values():
            c.cols, c.rows = -(-(-(-self.width * c.h // self.hmax)) // 8), -(-(-(-self.height * c.v // self.vmax)) // 8)
            c.grid = np.zeros((self.mcu_rows * c.v, self.mcu_cols * c.h, 64), np.int32)
            c.shape = c.h, c.v, c.rows, c.cols, self.mcu_cols * c.h
        self.units = _units_again if self.mcu_rows * self.mcu_cols * sum(c.h * c.v for c in self.components.values()) <= SMALL else _units

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        n = body[0]
        scan = [(self.components[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        segments, start, after = [], at, 0xD0
        while 0xD0 <= after <= 0xD7:
            found = _MARKER.search(data, start)
            if not found:
                raise ValueError("the scan has no end")
            at, after = found.start(), data[found.end() - 1]
            segments.append(data[start:at])
            start = at + 2
        if first and n != 1:
            raise ValueError("a scan of AC values has one component")
        units = self.units(tuple([c.shape for c, _, _ in scan]), self.mcu_rows, self.mcu_cols)
        step = self.restart * units.per_mcu or len(units.blocks)
        for i, segment in enumerate(segments):
            bits = Bits(segment.replace(b"\xff\x00", b"\xff"))
            part = units.part(i * step, (i + 1) * step)
            if first == 0:
                self._dc(bits, scan, part, high, low)
            else:
                c, _, t = scan[0]
                flat = c.grid.reshape(-1, 64)
                if high == 0:
                    self._ac_first(bits, flat, part.blocks, self.tables[1, t], first, last, low)
                else:
                    self._ac_refine(bits, flat, part.blocks, self.tables[1, t], first, last, low)
        return at

    def _dc(self, bits: Bits, scan: list, units: Units, high: int, low: int) -> None:
        flats = [c.grid.reshape(-1, 64) for c, _, _ in scan]
        if high:
            got = bits.many(len(units.blocks)).astype(np.int32) << low
            for flat, (at, blocks) in zip(flats, units.own, strict=True):
                flat[blocks, 0] |= got[at]
            return
        lookups = [_lookup(*self.tables[0, t]) for _, t, _ in scan]
        last, values = [0] * len(scan), []
        data, at = bits.data + bytes(5 * len(units.number)), bits.at
        for n in units.number:
            # 40 bits ahead hold a code and a value of up to 17 bits, wherever in a byte they begin
            p, skip = at >> 3, at & 7
            ahead = int.from_bytes(data[p : p + 5], "big")
            got = lookups[n][ahead >> (24 - skip) & 0xFFFF]
            if not got:
                raise ValueError("no such Huffman code")
            at += got >> 8
            size = got & 255
            if size:
                if size > 17:
                    raise ValueError("a DC difference of more bits than there are")
                at += size
                value = ahead >> (40 - skip - (got >> 8) - size) & ((1 << size) - 1)
                last[n] += value if value >> (size - 1) else value - (1 << size) + 1
            values.append(last[n])
        bits.at = at
        values = np.array(values, np.int32) << low
        for flat, (at, blocks) in zip(flats, units.own, strict=True):
            flat[blocks, 0] = values[at]

    def _ac_first(self, bits: Bits, flat: np.ndarray, blocks: np.ndarray, code: tuple[bytes, bytes], first: int, last: int, low: int) -> None:
        counts, symbols = code
        width = last - first + 1
        if len(symbols) == 1 and 0 < symbols[0] < 16:
            # one code only, without a run: all coefficients have one width and are read as columns
            length, size = next(i for i, c in enumerate(counts, 1) if c), symbols[0]
            for a in range(0, len(blocks), CHUNK):
                own = blocks[a : a + CHUNK]
                n = len(own) * width
                if length + size == 8 and not bits.at & 7:
                    raw = np.frombuffer(bits.data, np.uint8, n, bits.at >> 3)
                    bits.at += 8 * n
                    values = _bytes_read(size, low)[raw]
                else:
                    columns = bits.many(n * (length + size)).reshape(n, length + size)[:, length:]
                    values = columns.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
                    values = np.where(values >> (size - 1), values, values - (1 << size) + 1) * (1 << low)
                flat[_rows(own), first : last + 1] = values.reshape(len(own), width)
            return
        lookup, run = _lookup(counts, symbols), 0
        for block in blocks.tolist():
            if run:
                run -= 1
                continue
            k = first
            while k <= last:
                symbol = bits.code(lookup)
                zeros, size = symbol >> 4, symbol & 15
                if size:
                    k += zeros
                    flat[block, k] = _extended(bits.take(size), size) * (1 << low)
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) + bits.take(zeros) - 1
                    break

    def _ac_refine(self, bits: Bits, flat: np.ndarray, blocks: np.ndarray, code: tuple[bytes, bytes], first: int, last: int, low: int) -> None:
        lookup, i = _lookup(*code), 0
        one = 1 << low

        def correct(own: np.ndarray, low_k: int, high_k: int) -> None:
            """A bit for each coefficient of these blocks that has a history."""
            for a in range(0, len(own), CHUNK):
                some = _rows(own[a : a + CHUNK])
                band = flat[some, low_k:high_k]
                old = band != 0
                n = int(np.count_nonzero(old))
                got = bits.many(n).astype(np.int32)
                if n == band.size:
                    # the sign without its bit is 0 or -1; with the last bit set it is 1 or -1
                    band += (band >> 31 | 1) * got.reshape(band.shape) * one
                else:
                    band[old] += np.where(band[old] > 0, got, -got) * one
                if not isinstance(some, slice):
                    flat[some, low_k:high_k] = band

        while i < len(blocks):
            block, k, run = int(blocks[i]), first, 0
            while k <= last:
                symbol = bits.code(lookup)
                zeros, size = symbol >> 4, symbol & 15
                if not size and zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                value = (one if bits.take(1) else -one) if size else 0
                begin = k
                while k <= last:
                    if not flat[block, k]:
                        if not zeros:
                            break
                        zeros -= 1
                    k += 1
                correct(blocks[i : i + 1], begin, min(k, last + 1))
                if size and k <= last:
                    flat[block, k] = value
                k += 1
            if run:
                whole = i if k == first else i + 1
                if whole > i:
                    correct(blocks[i : i + 1], k, last + 1)
                correct(blocks[whole : i + run], first, last + 1)
                i += run
            else:
                i += 1

    def planes(self) -> list[np.ndarray]:
        """Samples of each component, upsampled to the image's size."""
        out = []
        for c in (self.components[k] for k in self.order):
            rows, cols, _ = c.grid.shape
            flat, quant = c.grid.reshape(-1, 64), self.quants[c.quant].astype(np.float64)
            samples = np.empty((len(flat), 64), np.uint8)
            for a in range(0, len(flat), CHUNK):
                whole = (flat[a : a + CHUNK] * quant) @ _INVERSE
                whole += 128.5
                np.maximum(whole, 0, out=whole)
                samples[a : a + CHUNK] = np.minimum(whole, 255, out=whole)  # cut to whole numbers from below
            plane = samples.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(8 * rows, 8 * cols)
            down, across = self.vmax // c.v, self.hmax // c.h
            if (down, across) != (1, 1):
                plane = plane.repeat(down, 0).repeat(across, 1)
            out.append(plane[: self.height, : self.width])
        return out

    def rgb(self) -> np.ndarray:
        """(height, width, 3) unsigned bytes; grey images have three equal channels."""
        planes = self.planes()
        if len(planes) < 3:
            return np.repeat(planes[0][:, :, None], 3, 2)
        y, cb, cr = planes[0].astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
        half = 1 << 15
        out = np.empty((*y.shape, 3), np.uint8)

        def put(channel: int, value: np.ndarray) -> None:
            np.maximum(value, 0, out=value)
            out[:, :, channel] = np.minimum(value, 255, out=value)

        # fixed values: 1.402, 0.344136, 0.714136 and 1.772, times 65536
        put(0, y + ((91881 * cr + half) >> 16))
        put(1, y + ((-22554 * cb - 46802 * cr + half) >> 16))
        put(2, y + ((116130 * cb + half) >> 16))
        return out


def _segment(marker: int, body: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def _huffman(kind: int, n: int, symbols: dict[int, list[int]]) -> bytes:
    """symbols by code length."""
    return _segment(0xC4, bytes([kind << 4 | n]) + bytes(len(symbols.get(i, [])) for i in range(1, 17)) + bytes(s for i in range(1, 17) for s in symbols.get(i, [])))


def geometry(blocks: int) -> tuple[int, int]:
    """MCUs across and down of an image of four luma and two chroma blocks an MCU that has room for `blocks`."""
    mcus = -(-blocks // 6)
    if mcus <= 64:
        return mcus, 1
    across = min(range(48, 65), key=lambda n: (-(-mcus // n) * n, n)) if mcus <= 64 * 4095 else -(-mcus // 4095)
    return across, -(-mcus // across)


_BYTES = np.arange(256, dtype=np.int32)
#: The coefficient that a byte is, the seven bits of its value without the lowest one (those of b from 128 on, else of b - 255), and the lowest bit of its magnitude.
_COEFFICIENT = np.where(_BYTES < 128, _BYTES - 255, _BYTES)
_SEVEN = np.where(_BYTES < 128, 127 - (255 - _BYTES >> 1), _BYTES >> 1).astype(np.uint8)
_LOWEST = (np.abs(_COEFFICIENT) & 1).astype(np.uint8)


def _dc_table() -> tuple[np.ndarray, np.ndarray]:
    """For differences from -255 on 13 bits, and how many of them are used: four bits name the size, then the size's bits."""
    values = np.arange(-255, 256)
    size = np.array([int(x).bit_length() for x in np.abs(values)])
    extra = np.where(values < 0, values + (1 << size) - 1, values)
    word = size << 9 | extra << (9 - size)
    return ((word[:, None] >> np.arange(12, -1, -1)) & 1).astype(np.uint8), np.arange(13)[None, :] < (4 + size)[:, None]


_DC_BITS, _DC_USED = _dc_table()


def _stuffed(bits: np.ndarray) -> bytes:
    packed = np.packbits(bits)
    pad = -len(bits) % 8
    if pad:
        packed[-1] |= (1 << pad) - 1
    return packed.tobytes().replace(b"\xff", b"\xff\x00")


_START = b"\xff\xd8"
_QUANT = _segment(0xDB, b"\0" + b"\x01" * 64)
_FIRST_TABLES = _huffman(0, 0, {4: list(range(10))}) + _huffman(1, 0, {1: [0x07]})
_DC_FIRST, _DC_REFINED = (_segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, x])) for x in (0x01, 0x10))
_BANDS = ((1, 5), (6, 63))
_AC_FIRST = {(n, first): _segment(0xDA, bytes([1, n, 0, first, last, 0x01])) for n in (1, 2, 3) for first, last in _BANDS}
_AC_REFINED = {n: _segment(0xDA, bytes([1, n, 1, 1, 63, 0x10])) for n in (1, 2, 3)}


@lru_cache(maxsize=256)
def _runs_table(width: int, sizes: tuple[int, ...]) -> bytes:
    return _huffman(1, 1, {width: [x << 4 for x in sizes]})


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose quantised coefficients are the payload's bytes; its length must be a multiple of 64.

    Byte b is the coefficient of size 8 whose bits are b: b itself from 128 on, else b - 255. Blocks fill the
    luma plane, then the two chroma planes at half resolution; blocks that fill up the last planes hold bytes 0. DC values come in one
    interleaved scan and a refinement, AC values in two bands without their lowest bit and a
    refinement. The payload's length is in a comment.
    """
    across, down = geometry(len(payload) // 64)
    mcus = across * down
    data = np.frombuffer(payload.ljust(6 * 64 * mcus, b"\0"), np.uint8).reshape(-1, 64)
    parts = {1: slice(4 * mcus), 2: slice(4 * mcus, 5 * mcus), 3: slice(5 * mcus, None)}

    def mcu_order(values: np.ndarray) -> np.ndarray:
        """A value of each block as rows of four luma and two chroma blocks."""
        out = np.empty((mcus, 6), values.dtype)
        out[:, :4] = values[parts[1]].reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(mcus, 4)
        out[:, 4], out[:, 5] = values[parts[2]], values[parts[3]]
        return out

    out = [_START, _segment(0xFE, b"payload %d" % len(payload)), _QUANT]
    out += [_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _FIRST_TABLES]
    dc = mcu_order(data[:, 0])
    half = _COEFFICIENT[dc] >> 1
    steps = half.copy()
    steps[:, 1:4] -= half[:, :3]
    steps[1:, 0] -= half[:-1, 3]
    steps[1:, 4:] -= half[:-1, 4:]
    steps = steps.ravel() + 255
    out += [_DC_FIRST, _stuffed(_DC_BITS[steps][_DC_USED[steps]])]
    # code 0 and seven bits: a byte below 128 each, so nothing needs stuffing
    seven = _SEVEN[data]
    for n, part in parts.items():
        for first, last in _BANDS:
            out += [_AC_FIRST[n, first], seven[part, first : last + 1].tobytes()]
    out += [_DC_REFINED, _stuffed(_LOWEST[dc].ravel())]
    lowest = _LOWEST[data]
    for n, part in parts.items():
        bits = lowest[part, 1:]
        runs = [bits[a : a + 32767] for a in range(0, len(bits), 32767)]
        sizes = [len(own).bit_length() - 1 for own in runs]
        codes = tuple(sorted(set(sizes)))
        width = 1 if len(codes) == 1 else 4
        flow = []
        for size, own in zip(sizes, runs, strict=True):
            head = codes.index(size) << size | len(own) - (1 << size)
            flow += [np.array([head >> i & 1 for i in range(width + size - 1, -1, -1)], np.uint8), own.ravel()]
        out += [_runs_table(width, codes), _AC_REFINED[n], _stuffed(np.concatenate(flow))]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(image: Decoder) -> bytes:
    """The bytes that encode() stored, from the coefficients."""
    size = next(int(c.split()[1]) for c in image.comments if c.startswith(b"payload "))
    values = np.concatenate([image.components[k].grid.reshape(-1, 64) for k in image.order])
    return (values + (values >> 31 & 255)).astype(np.uint8).tobytes()[:size]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the columns named in keep (NAME_kept if they bear the name of another column of the result), n_bytes, media (a progressive JPEG that holds the text's bytes).

    The text's UTF-8 bytes are padded with bytes 0 to a positive multiple of 64. A null text is empty.
    Equal texts have equal media; repeated rows each get their row; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), *kept(keep, ("doc_id", "n_bytes", "media", "__text")), utf8(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                texts = [t.as_py() for t in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(map(len, texts), pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], names=[*part.schema.names[:-1], "n_bytes", "media"])

    return slim.mapInArrow(run, slim.drop("__text").withColumns({"n_bytes": F.lit(0).cast("long"), "media": F.lit(None).cast("binary")}).schema)


#: Bytes of tensors that leave a worker together, apart from a larger single one.
TOGETHER = 32 << 20
_TENSOR = {"height": "int", "width": "int", "rgb": "binary", "feature": "string", "error": "string"}
_DIGESTS = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string"}


def decode(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = (), digests: bool = False) -> DataFrame:
    """Decode progressive JPEGs to full-resolution RGB tensors: the columns named in keep (NAME_kept if they bear the name of another column of the result), height, width, rgb (height x width x 3 bytes, row by row), feature, error and, if asked, the digests of a payload.

    Scans are accumulated into coefficient arrays (spectral selection and successive approximation, first
    passes and refinements), blocks are inverse-transformed in numpy, chroma is upsampled to the image's size. feature
    sums up the tensor: its shape, each channel's mean, and the CRC of all samples. A null medium gives nulls.
    A medium that is broken, cut off, too large for a tensor or no progressive JPEG gives nulls and the reason in error; other rows are not
    touched by it. Images are decoded one by one; repeated rows each get their row; an empty table gives an empty result.
    """
    extra = _TENSOR | (_DIGESTS if digests else {})
    slim = media.select(*kept(keep, (*extra, "__media")), F.col(media_col).alias("__media"))
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "long": pa.int64()}

    def one(data: bytes | None) -> dict:
        if data is None:
            return {}
        try:
            image = Decoder(data)
            rgb = image.rgb()
            payload = payload_of(image) if digests else b""
        except (ValueError, IndexError, KeyError, StopIteration, struct.error, MemoryError, OverflowError, ZeroDivisionError, AttributeError) as e:
            return {"error": f"{type(e).__name__}: {e}"}
        raw = rgb.tobytes()
        means = ",".join(f"{int(rgb[:, :, k].sum(dtype=np.int64)) / rgb[:, :, k].size:.4f}" for k in range(3))
        out = {"height": rgb.shape[0], "width": rgb.shape[1], "feature": f"{rgb.shape[0]}x{rgb.shape[1]}x3;mean={means};crc32={zlib.crc32(raw):08x}", "rgb": raw}
        if digests:
            out |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, rows, size = 0, [], 0
            for n in range(b.num_rows):
                rows.append(one(b.column(b.num_columns - 1)[n].as_py()))
                size += len(rows[-1].get("rgb") or b"")
                if size >= TOGETHER or n + 1 == b.num_rows:
                    part = b.slice(first, len(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array([r.get(k) for r in rows], kinds[t]) for k, t in extra.items()]], names=[*part.schema.names[:-1], *extra])
                    first, rows, size = n + 1, [], 0

    return slim.mapInArrow(run, slim.drop("__media").withColumns({k: F.lit(None).cast(t) for k, t in extra.items()}).schema)


def store_tensors(media: DataFrame, path: str, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Write decode()'s tensors as Parquet below path, which the cluster shares, and read them back; tensor() gives the array of a row."""
    decode(media, media_col, keep).write.parquet(path)
    return media.sparkSession.read.parquet(path)


def tensor(row) -> np.ndarray:
    """(height, width, 3) unsigned bytes of a stored row."""
    return np.frombuffer(row["rgb"], np.uint8).reshape(row["height"], row["width"], 3)


def op10_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    media = to_media(table(spark, sf_dir, "documents"))
    found = decode(media, keep=("doc_id", "n_bytes"), digests=True)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
