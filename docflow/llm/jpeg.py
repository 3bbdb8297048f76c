"""Baseline JPEG frames: a decoder, and a lossless store of bytes in their coefficients.

The decoder reads sequential 8-bit Huffman frames (ITU-T T.81, SOF0) of one or three components
with any sampling factors and restart intervals. The store writes frames of 4:4:4 blocks in which
each quantised coefficient holds one byte: category 8 has exactly 256 values (128 to 255 and their
negatives), and its eight extra bits are the byte. The Huffman code of that category is one bit,
so a unit of 192 bytes (three blocks) is 216 bytes of scan, and a restart marker after each unit
keeps the DC differences equal to the values. Such intervals are recognised by their tables and
bits and decoded by array operations; all others go symbol by symbol.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np

UNIT = 192
_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
_DATA_BYTES = UNIT * 9 // 8


def _basis() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


#: Maps 64 coefficients in zigzag order to 64 samples in row order.
_IDCT = np.kron(_basis(), _basis())[_ZIGZAG].astype(np.float32)


class JpegError(ValueError):
    """The bytes are not a baseline JPEG frame that can be decoded."""


# Store


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: bytes) -> bytes:
    """A Huffman table of two symbols with codes 0 and 10."""
    return bytes([kind, 1, 1, *[0] * 14]) + symbols


_FILL = b"\xaa\xaf"  # three blocks of zero: codes 10 10 three times, closed with ones


def frame_header(width: int, height: int) -> bytes:
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x11\x00\x02\x11\x00\x03\x11\x00"),
            _segment(0xC4, _table(0x00, b"\x08\x00") + _table(0x10, b"\x08\x00")),
            _segment(0xDD, b"\x00\x01"),
            _segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"),
        )
    )


def store(payload: bytes, columns: int, rows: int) -> bytes:
    """A frame of ``columns`` x ``rows`` units; the payload fills the first, zero blocks the rest."""
    units, extra = divmod(len(payload), UNIT)
    if extra or units > columns * rows:
        raise JpegError("the payload is not a number of units that the frame holds")
    bits = np.zeros((units * UNIT, 9), dtype=np.uint8)
    bits[:, 1:] = np.unpackbits(np.frombuffer(payload, dtype=np.uint8)).reshape(-1, 8)
    data = np.packbits(bits).tobytes()
    parts = [data[i : i + _DATA_BYTES].replace(b"\xff", b"\xff\x00") for i in range(0, len(data), _DATA_BYTES)]
    parts += [_FILL] * (columns * rows - units)
    scan = [parts[0]]
    for k, part in enumerate(parts[1:]):
        scan += (_RESTARTS[k % 8], part)
    return frame_header(8 * columns, 8 * rows) + b"".join(scan) + b"\xff\xd9"


_RESTARTS = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


# Decoder


@dataclass
class Frame:
    """width, height; coefficients of each component: (blocks down, blocks across, 64) in zigzag order."""

    width: int
    height: int
    coefficients: list[np.ndarray]
    quantisation: list[np.ndarray]
    sampling: list[tuple[int, int]]

    def samples(self, component: int = 0) -> np.ndarray:
        """Samples of a component, rows x columns of whole blocks, 0 to 255."""
        blocks = self.coefficients[component] * self.quantisation[component]
        down, across, _ = blocks.shape
        flat = blocks.reshape(-1, 64).astype(np.float32) @ _IDCT + 128.0
        return np.clip(np.rint(flat), 0, 255).astype(np.uint8).reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8)

    def luma(self) -> np.ndarray:
        """The first component's samples inside the picture."""
        most = (max(v for v, _ in self.sampling), max(h for _, h in self.sampling))
        v, h = self.sampling[0]
        return self.samples(0)[: -(-self.height * v // most[0]), : -(-self.width * h // most[1])]

    def payload(self) -> bytes:
        """The bytes in the coefficients, unit by unit; zero coefficients hold none."""
        values = np.stack([c.reshape(-1, 64) for c in self.coefficients], axis=1).reshape(-1)
        held = values[values != 0]
        return np.where(held > 0, held, held + 255).astype(np.uint8).tobytes()


def _huffman(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, codes in canonical order."""
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(lengths[length - 1]):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise JpegError("the scan ends early")
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := table.get((length, code))) is not None:
                return found
        raise JpegError("a code is in no table")

    def signed(self, size: int) -> int:
        bits = self.take(size)
        return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


def _block(bits: _Bits, dc: dict, ac: dict, before: int) -> tuple[np.ndarray, int]:
    out = np.zeros(64, dtype=np.int32)
    before += bits.signed(bits.symbol(dc))
    out[0] = before
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if size == 0:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise JpegError("a block has too many coefficients")
        out[k] = bits.signed(size)
        k += 1
    return out, before


_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def decode(data: bytes) -> Frame:
    """Decode a baseline frame. Raises JpegError for anything else and for damaged data."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    place, quantisation, huffman, interval, frame = 2, {}, {}, 0, None
    while place + 4 <= len(data):
        if data[place] != 0xFF:
            raise JpegError("no marker where one is due")
        marker = data[place + 1]
        if marker == 0xFF:
            place += 1
            continue
        size = struct.unpack_from(">H", data, place + 2)[0]
        body = data[place + 4 : place + 2 + size]
        place += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisation[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xC0:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not height or not width:
                raise JpegError("only 8-bit frames of one or three components and a known size are read")
            frame = (width, height, [(body[6 + 3 * i], body[7 + 3 * i] & 15, body[7 + 3 * i] >> 4, body[8 + 3 * i]) for i in range(n)])
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise JpegError("only baseline frames are read")
        elif marker == 0xDA:
            if frame is None:
                raise JpegError("a scan without a frame")
            return _scan(data, place, body, frame, quantisation, huffman, interval)
    raise JpegError("no scan")


def _scan(data: bytes, place: int, body: bytes, frame: tuple, quantisation: dict, huffman: dict, interval: int) -> Frame:
    width, height, components = frame
    by_id = {body[1 + 2 * i]: divmod(body[2 + 2 * i], 16) for i in range(body[0])}
    if set(by_id) != {c[0] for c in components}:
        raise JpegError("only frames of one scan are read")
    if len(components) == 1:
        components = [(components[0][0], 1, 1, components[0][3])]
    most_v, most_h = max(c[1] for c in components), max(c[2] for c in components)
    down, across = -(-height // (8 * most_v)), -(-width // (8 * most_h))
    units = down * across
    end = data.rfind(b"\xff\xd9", place)
    parts = _RESTART.split(data[place : end if end >= 0 else len(data)])
    step = interval or units
    if len(parts) < -(-units // step):
        raise JpegError("restart intervals are missing")
    try:
        tables = [(huffman[by_id[c[0]][0]], huffman[16 + by_id[c[0]][1]]) for c in components]
        steps = [quantisation[c[3]] for c in components]
    except KeyError as error:
        raise JpegError("a table is missing") from error
    per_unit = [c[1] * c[2] for c in components]
    blocks = np.zeros((units, sum(per_unit), 64), dtype=np.int32)
    # Intervals of one unit whose 192 coefficients all have category 8 in one-bit codes.
    quick = step == 1 and sum(per_unit) == 3 and all(t.get((1, 0)) == 8 for pair in tables for t in pair)
    wholes: list[tuple[int, bytes]] = []
    known: dict[bytes, np.ndarray] = {}
    for k in range(-(-units // step)):
        part = parts[k].replace(b"\xff\x00", b"\xff")
        if quick and len(part) == _DATA_BYTES:
            wholes.append((k, part))
            continue
        if part in known:
            blocks[k] = known[part]
            continue
        _interval(part, blocks[k * step : (k + 1) * step], components, tables)
        if step == 1 and len(part) <= 8:
            known[part] = blocks[k]
    if wholes:
        bits = np.unpackbits(np.frombuffer(b"".join(p for _, p in wholes), dtype=np.uint8)).reshape(-1, UNIT, 9)
        plain = ~bits[:, :, 0].any(1)
        values = np.packbits(bits[:, :, 1:]).reshape(-1, 3, 64).astype(np.int32)
        values -= 255 * (values < 128)
        at = np.array([k for k, _ in wholes])
        blocks[at[plain]] = values[plain]
        for i in np.flatnonzero(~plain):
            _interval(wholes[i][1], blocks[at[i] : at[i] + 1], components, tables)
    out, first = [], 0
    for (_, v, h, _), n in zip(components, per_unit, strict=True):
        own = blocks[:, first : first + n].reshape(down, across, v, h, 64)
        out.append(own.swapaxes(1, 2).reshape(down * v, across * h, 64))
        first += n
    return Frame(width, height, out, steps, [(c[1], c[2]) for c in components])


def _interval(part: bytes, blocks: np.ndarray, components: list, tables: list) -> None:
    bits, before = _Bits(part), [0] * len(components)
    for unit in blocks:
        k = 0
        for i, (_, v, h, _) in enumerate(components):
            for _ in range(v * h):
                unit[k], before[i] = _block(bits, *tables[i], before[i])
                k += 1
