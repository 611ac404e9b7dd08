"""Run configuration: frozen dataclasses, the deck parser, and what is derived from them on the driver."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field, replace

log = logging.getLogger("voxelflow")


class ConfigError(ValueError):
    """A deck or option that contradicts itself or lacks what is mandatory."""


@dataclass(frozen=True)
class Selection:
    """Which atoms take part: all, 1-based inclusive index ranges, or exact names."""

    ranges: tuple[tuple[int, int], ...] = ()
    names: tuple[str, ...] = ()

    @property
    def kind(self) -> str:
        return "index" if self.ranges else "name" if self.names else "all"


@dataclass(frozen=True)
class Lattice:
    kind: str = "cubic"
    centering: str = "F"
    hex_c_over_a: float = 1.633
    lengths: tuple[float, float, float] = (1.0, 1.0, 1.0)
    angles: tuple[float, float, float] = (90.0, 90.0, 90.0)


@dataclass(frozen=True)
class Config:
    selection: Selection = Selection()
    box: str = "auto"
    bounds: tuple[float, float, float, float, float, float] | None = None  # xlo, xhi, ylo, yhi, zlo, zhi
    periodic: bool = False
    lattice_origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    spacing: float = 1.0
    connectivity: int = 6
    skip: int = 1
    refinement: str = "skip_dfs"
    alpha: float = 1.0
    dnn: float = 0.0
    radii: tuple[float, ...] = ()
    cutoff: float = 0.0
    occupancy: str = "any"
    lattice: Lattice = Lattice()
    stride: int = 1

    @property
    def dnn_voxels(self) -> float:
        """Nearest-neighbour distance of lattice sites in voxels: explicit, from the radii, or the inverse spacing."""
        if self.dnn > 0:
            return self.dnn
        if self.radii:
            return self.alpha * 2 * min(self.radii) / self.spacing
        return math.ceil(1 / self.spacing)


@dataclass(frozen=True)
class ClusterParams:
    skip: int = 3
    eps: float = 3.0
    min_pts: int = 10
    k: int = 20
    threshold: float = 4.0
    connectivity: int = 6
    min_cluster_size: int = 5
    min_samples: int = 5


_BOUNDS = ("XLO", "XHI", "YLO", "YHI", "ZLO", "ZHI")
_NUMBERS = {"GRID_SPACING": "spacing", "ALPHA": "alpha", "DNN": "dnn", "CUTOFF": "cutoff"}
_WHOLE = {"CONNECTIVITY": "connectivity", "SKIP": "skip", "STRIDE": "stride"}
_CHOICES = {
    "REFINEMENT": ("refinement", ("skip_dfs", "dfs")),
    "OCCUPANCY": ("occupancy", ("any", "all")),
}
_CELL = {"A": ("lengths", 0), "B": ("lengths", 1), "C": ("lengths", 2), "ALPHA": ("angles", 0), "BETA": ("angles", 1), "GAMMA": ("angles", 2)}


def _range(token: str) -> tuple[int, int]:
    first, dash, last = token.strip().partition("-")
    a = int(first)
    b = int(last) if dash else a
    return (min(a, b), max(a, b))


def _selection(rest: str, before: Selection) -> Selection:
    for part in rest.split("|"):
        key, eq, value = part.partition("=")
        if not eq or key.strip().upper() != "ATOMS":
            continue
        value = value.strip()
        if value.upper() == "ALL":
            return Selection()
        if value.upper().startswith("INDEX:"):
            return Selection(ranges=tuple(_range(t) for t in value[6:].split(",") if t.strip()))
        if value.upper().startswith("NAME:"):
            return Selection(names=tuple(t.strip() for t in value[5:].split(",") if t.strip()))
    return before


def _box(rest: str) -> dict:
    tokens = rest.split()
    head = tokens[0].upper() if tokens else ""
    if head in ("AUTO", "CELL") and len(tokens) == 1:
        return {"box": head.lower(), "bounds": None}
    tokens = tokens[1:] if head == "MANUAL" else tokens
    keys = [t.upper() for t in tokens[::2]]
    if len(tokens) != 12 or sorted(keys) != sorted(_BOUNDS):
        raise ConfigError("BOX takes AUTO, CELL or each of " + " ".join(_BOUNDS) + " once with a value")
    given = dict(zip(keys, map(float, tokens[1::2]), strict=True))
    return {"box": "manual", "bounds": tuple(given[k] for k in _BOUNDS)}


def parse_deck(text: str) -> Config:
    """The run block of a deck, from ``BLS ...`` to ``... BLS``; ``#`` starts a comment, keywords ignore case."""
    values: dict = {}
    lattice: dict = {}
    open_block = closed = False
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        words = line.upper().split()
        if not open_block:
            open_block = words[:2] == ["BLS", "..."]
            continue
        if words[:2] == ["...", "BLS"]:
            closed = True
            break
        keyword, _, rest = line.partition(" ") if " " in line else line.partition("\t")
        keyword, rest = keyword.upper(), rest.strip()
        try:
            if keyword == "GROUP":
                values["selection"] = _selection(rest, values.get("selection", Selection()))
            elif keyword == "BOX":
                values |= _box(rest)
            elif keyword == "PBC":
                if rest.lower() not in ("none", "xyz"):
                    raise ConfigError("PBC takes none or xyz")
                values["periodic"] = rest.lower() == "xyz"
            elif keyword == "LATTICE_ORIGIN":
                values["lattice_origin"] = tuple(map(float, rest.split()[:3]))
                if len(values["lattice_origin"]) != 3:
                    raise ConfigError("LATTICE_ORIGIN takes three numbers of voxels")
            elif keyword in _NUMBERS:
                values[_NUMBERS[keyword]] = float(rest)
            elif keyword in _WHOLE:
                values[_WHOLE[keyword]] = int(rest)
            elif keyword in _CHOICES:
                name, allowed = _CHOICES[keyword]
                if rest.lower() not in allowed:
                    raise ConfigError(f"{keyword} takes {' or '.join(allowed)}")
                values[name] = rest.lower()
            elif keyword == "RADII":
                values["radii"] = tuple(float(x) for x in rest.replace(",", " ").split())
            elif keyword == "LATTICE":
                if rest.lower() not in ("cubic", "hexagonal", "triclinic"):
                    raise ConfigError("LATTICE takes cubic, hexagonal or triclinic")
                lattice["kind"] = rest.lower()
            elif keyword == "CENTERING":
                if rest.upper() not in ("P", "F", "I"):
                    raise ConfigError("CENTERING takes P, F or I")
                lattice["centering"] = rest.upper()
            elif keyword == "HEX_C_OVER_A":
                lattice["hex_c_over_a"] = float(rest)
            elif keyword.startswith("TRICLINIC_") and keyword[10:] in _CELL:
                name, at = _CELL[keyword[10:]]
                three = list(lattice.get(name, getattr(Lattice(), name)))
                three[at] = float(rest)
                lattice[name] = tuple(three)
            else:
                log.warning("line %d: unknown keyword %s", number, keyword)
        except ValueError as error:
            raise ConfigError(f"line {number}: {error}") from error
    if not open_block or not closed:
        raise ConfigError("the deck needs a block from 'BLS ...' to '... BLS'")
    if missing := [k.upper() for k in ("kind", "centering") if k not in lattice]:
        raise ConfigError("LATTICE and CENTERING are both mandatory; missing: " + ", ".join({"KIND": "LATTICE"}.get(m, m) for m in missing))
    config = Config(lattice=Lattice(**lattice), **values)
    if config.periodic and config.box == "auto":
        raise ConfigError("PBC xyz needs BOX CELL or BOX MANUAL")
    return config


def effective_stride(config: Config, override: int | None = None) -> int:
    return max(1, override if override is not None else config.stride)


def with_lattice(config: Config, kind: str, centering: str) -> Config:
    return replace(config, lattice=replace(config.lattice, kind=kind, centering=centering))


@dataclass(frozen=True)
class FrameWindow:
    """Frames start..stop (inclusive, open if None), every ``stride``-th counted from ``start``."""

    start: int = 0
    stop: int | None = None
    stride: int = 1
    extra: dict = field(default_factory=dict)
