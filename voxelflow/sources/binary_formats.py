"""XTC and TRR trajectories: frame offsets without decoding, and decoding of single frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

from voxelflow.sources.text_formats import FormatError, Frame

XTC_MAGIC, TRR_MAGIC = 1995, 1993
RAW_ATOMS = 9
# Fixed values of the format: range of small differences by size index.
SMALL_SIZES = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64,
    80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290,
    1625, 2048, 2580, 3250, 4096, 5060, 6501, 8192, 10321, 13003,
    16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031,
    131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561,
    832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021,
    4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216,
)


class Bits:
    """Big-endian bit reader over a byte string."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        end = self.at + n
        first, last = self.at >> 3, (end + 7) >> 3
        self.at = end
        return (int.from_bytes(self.data[first:last], "big") >> (8 * last - end)) & ((1 << n) - 1)

    def mixed(self, n: int, sizes: list[int]) -> list[int]:
        """Three numbers packed as one of mixed radix, in ``n`` bits whose bytes come lowest first."""
        count = (n + 7) // 8
        rest = n - 8 * (count - 1)
        raw = self.take(n)
        value = int.from_bytes((raw >> rest).to_bytes(count - 1, "big"), "little") | ((raw & ((1 << rest) - 1)) << (8 * (count - 1)))
        value, third = divmod(value, sizes[2])
        first, second = divmod(value, sizes[1])
        return [first, second, third]


def unpack_coordinates(data: bytes, count: int, low: list[int], high: list[int], small: int) -> np.ndarray:
    """Integer coordinates: full ones, each followed by an optional run of differences in a range that adapts."""
    sizes = [h - l + 1 for l, h in zip(low, high, strict=True)]
    wide = max(sizes) > 0xFFFFFF
    width = (sizes[0] * sizes[1] * sizes[2]).bit_length()
    bits, out, run = Bits(data), [], 0
    while len(out) < count:
        whole = [bits.take(s.bit_length()) for s in sizes] if wide else bits.mixed(width, sizes)
        here = [c + l for c, l in zip(whole, low, strict=True)]
        change = 0
        if bits.take(1):
            code = bits.take(5)
            change = code % 3 - 1
            run = code - code % 3
        if not 0 <= small < len(SMALL_SIZES):
            raise FormatError("an XTC frame has a size index that the format does not know")
        radix = SMALL_SIZES[small]
        half, before = radix // 2, here
        for step in range(run // 3):
            moved = [d + b - half for d, b in zip(bits.mixed(small, [radix] * 3), before, strict=True)]
            if step == 0:  # the first of a run stands before the full one, and the next differ from that
                out += [moved, here]
                continue
            out.append(moved)
            before = moved
        if run == 0:
            out.append(here)
        small += change
    return np.array(out[:count], dtype=np.int64)


def _cell(box: np.ndarray) -> tuple[float, ...]:
    return tuple(float(x) for x in box.ravel())


def xtc_offsets(f: BinaryIO) -> list[int]:
    """Byte offset of every frame, from headers alone."""
    found, at = [], 0
    while True:
        f.seek(at)
        head = f.read(56)
        if len(head) < 56:
            return found
        magic, atoms = struct.unpack(">ii", head[:8])
        if magic != XTC_MAGIC:
            raise FormatError("not an XTC frame")
        found.append(at)
        if atoms <= RAW_ATOMS:
            at += 56 + 12 * atoms
        else:
            f.seek(at + 88)
            size = struct.unpack(">i", f.read(4))[0]
            at += 92 + (size + 3) // 4 * 4


def xtc_frame(f: BinaryIO, at: int) -> Frame:
    f.seek(at)
    magic, _, _, time = struct.unpack(">iiif", f.read(16))
    if magic != XTC_MAGIC:
        raise FormatError("not an XTC frame")
    box = np.frombuffer(f.read(36), ">f4")
    atoms = struct.unpack(">i", f.read(4))[0]
    if atoms <= RAW_ATOMS:
        return Frame(np.frombuffer(f.read(12 * atoms), ">f4").astype(np.float64).reshape(-1, 3), _cell(box), time)
    precision, *numbers = struct.unpack(">f8i", f.read(36))
    low, high, small, size = numbers[:3], numbers[3:6], numbers[6], numbers[7]
    whole = unpack_coordinates(f.read(size), atoms, low, high, small)
    # Single precision, as the format's own reader yields.
    return Frame((whole.astype(np.float32) * np.float32(1.0 / precision)).astype(np.float64), _cell(box), time)


def _trr_header(f: BinaryIO, at: int) -> dict | None:
    f.seek(at)
    head = f.read(12)
    if len(head) < 12:
        return None
    magic, _, length = struct.unpack(">iii", head)
    if magic != TRR_MAGIC:
        raise FormatError("not a TRR frame")
    f.read((length + 3) // 4 * 4)
    names = ("ir", "e", "box", "vir", "pres", "top", "sym", "x", "v", "f", "atoms", "step", "nre")
    h = dict(zip(names, struct.unpack(">13i", f.read(52)), strict=True))
    wide = h["box"] == 72 if h["box"] else h["x"] == 24 * h["atoms"] and h["x"] > 0
    h["kind"] = ">f8" if wide else ">f4"
    h["time"] = float(np.frombuffer(f.read(16 if wide else 8), h["kind"])[0])
    h["body"] = f.tell()
    h["next"] = h["body"] + sum(h[k] for k in ("ir", "e", "box", "vir", "pres", "top", "sym", "x", "v", "f"))
    return h


def trr_offsets(f: BinaryIO) -> list[int]:
    found, at = [], 0
    while (h := _trr_header(f, at)) is not None:
        found.append(at)
        at = h["next"]
    return found


def trr_frame(f: BinaryIO, at: int) -> Frame:
    h = _trr_header(f, at)
    f.seek(h["body"] + h["ir"] + h["e"])
    box = np.frombuffer(f.read(h["box"]), h["kind"]) if h["box"] else np.zeros(9)
    f.seek(h["body"] + sum(h[k] for k in ("ir", "e", "box", "vir", "pres", "top", "sym")))
    return Frame(np.frombuffer(f.read(h["x"]), h["kind"]).astype(np.float64).reshape(-1, 3), _cell(box), h["time"])


READERS = {"xtc": (xtc_offsets, xtc_frame), "trr": (trr_offsets, trr_frame)}


def frames(f: BinaryIO, kind: str) -> Iterator[Frame]:
    offsets, frame = READERS[kind]
    for at in offsets(f):
        yield frame(f, at)
