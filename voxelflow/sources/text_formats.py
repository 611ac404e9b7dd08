"""Text trajectory and structure formats: generators of frames from lines."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from voxelflow.functions.geometry import cell_vectors

NO_CELL = (0.0,) * 9


@dataclass(frozen=True)
class Frame:
    """Positions, cell (the three vectors one after another, zeros for none) and time of one frame."""

    positions: np.ndarray
    cell: tuple[float, ...] = NO_CELL
    time_ps: float = 0.0


class FormatError(ValueError):
    """A file that does not keep to its format."""


def _frame(rows: list, cell: tuple, time: float) -> Frame:
    return Frame(np.array(rows, dtype=float).reshape(-1, 3), cell, time)


def _flat(vectors) -> tuple[float, ...]:
    return tuple(x for v in vectors for x in v)


def _after(pattern: str, text: str) -> float | None:
    found = re.search(pattern + r"\s*([-+0-9.eE]+)", text)
    try:
        return float(found[1]) if found else None
    except ValueError:
        return None


def pdb(lines: Iterable[str]) -> Iterator[Frame]:
    """Models of a PDB file. A cell record holds from there on; a MODEL record also ends a model without ENDMDL; empty models are passed over."""
    rows: list = []
    cell, time = NO_CELL, 0.0
    for line in lines:
        line = line.rstrip("\n")
        record = line[:6]
        if record in ("ATOM  ", "HETATM"):
            if len(line) >= 54:
                rows.append([float(line[c : c + 8]) for c in (30, 38, 46)])
        elif record == "CRYST1" and len(line) >= 66:
            cuts = ((6, 15), (15, 24), (24, 33), (33, 40), (40, 47), (47, 54))
            cell = _flat(cell_vectors(*[float(line[a:b]) for a, b in cuts]))
        elif record.startswith("MODEL"):
            if rows:
                yield _frame(rows, cell, time)
                rows = []
            time = _after(r"TIME=", line) or 0.0
        elif record == "ENDMDL":
            if rows:
                yield _frame(rows, cell, time)
                rows = []
    if rows:
        yield _frame(rows, cell, time)


def gro(lines: Iterable[str]) -> Iterator[Frame]:
    """Frames of a GRO file; of the box line the first three numbers count."""
    it = iter(lines)
    for title in it:
        count = next(it, "").strip()
        if not count:
            return
        rows = []
        for _ in range(int(count)):
            line = next(it, "").rstrip("\n")
            if len(line) < 44:
                raise FormatError("a GRO atom line is too short")
            rows.append([float(line[c : c + 8]) for c in (20, 28, 36)])
        box = [float(x) for x in next(it, "").split()[:3]]
        cell = (box[0], 0.0, 0.0, 0.0, box[1], 0.0, 0.0, 0.0, box[2]) if len(box) == 3 else NO_CELL
        yield _frame(rows, cell, _after(r"\bt=", title) or 0.0)


def _xyz_cell(comment: str) -> tuple[float, ...]:
    if found := re.search(r'Lattice="([^"]*)"', comment, re.IGNORECASE):
        nine = [float(x) for x in found[1].split()]
        if len(nine) == 9:
            return tuple(nine)
    numbers = []
    for token in comment.split():
        try:
            numbers.append(float(token))
        except ValueError:
            continue
    if len(numbers) >= 6:
        return _flat(cell_vectors(*numbers[:6]))
    if len(numbers) >= 3:
        return (numbers[0], 0.0, 0.0, 0.0, numbers[1], 0.0, 0.0, 0.0, numbers[2])
    return NO_CELL


def xyz(lines: Iterable[str]) -> Iterator[Frame]:
    """Frames of an XYZ file; the comment may hold a lattice, cell parameters and a time."""
    it = iter(lines)
    for line in it:
        if not line.strip():
            continue
        comment = next(it, "")
        rows = []
        for _ in range(int(line.split()[0])):
            fields = next(it, "").split()
            if len(fields) < 4:
                raise FormatError("an XYZ atom line needs an element and three numbers")
            rows.append([float(x) for x in fields[1:4]])
        time = next((t for t in (_after(p, comment) for p in (r"\btime=", r"\bt=", r"\btime:", r"\bt:")) if t is not None), 0.0)
        yield _frame(rows, _xyz_cell(comment), time)


def _v2000_point(line: str) -> list[float]:
    try:
        return [float(line[c : c + 10]) for c in (0, 10, 20)]
    except ValueError:
        return [float(x) for x in line.split()[:3]]


def mol(lines: Iterable[str]) -> Iterator[Frame]:
    """Records of a MOL or SD file, V2000 or V3000; the time is the record's ordinal."""
    it, ordinal = iter(lines), 0
    while True:
        header = [next(it, None) for _ in range(4)]
        if header[3] is None:
            return
        rows: list = []
        if "V3000" in header[3]:
            inside = False
            for line in it:
                fields = line.split()
                if fields[:3] == ["M", "V30", "BEGIN"]:
                    inside = fields[3:4] == ["ATOM"]
                elif fields[:3] == ["M", "V30", "END"]:
                    inside = False
                elif inside and fields[:2] == ["M", "V30"]:
                    rows.append([float(x) for x in fields[4:7]])
                elif fields[:2] == ["M", "END"] or line.startswith("$$$$"):
                    break
        else:
            rows = [_v2000_point(next(it, "")) for _ in range(int(header[3][:3]))]
            for line in it:
                if line.startswith("M  END") or line.startswith("$$$$"):
                    break
        yield _frame(rows, NO_CELL, float(ordinal))
        ordinal += 1
        if not line.startswith("$$$$"):
            for line in it:
                if line.startswith("$$$$"):
                    break


READERS = {"pdb": pdb, "gro": gro, "xyz": xyz, "mol": mol, "sdf": mol}
