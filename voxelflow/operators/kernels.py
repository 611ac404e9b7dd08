"""Clustering rules that are sequential or need a whole frame at once; each takes ``Cells`` and returns labels, -1 for noise.

Distances between voxels are squared integers throughout, so ties are exact; periodic frames use minimum images.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np

from voxelflow.functions.geometry import round_half_away
from voxelflow.operators.components import Cells, component_labels, dense, half_offsets, minimum_labels

AXIS_STEPS = ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))
KMEANS_ROUNDS = 1_000_000
FLOW_ROUNDS = 5
PAIRS_AT_ONCE = 2_000_000


def ball(radius: float) -> list[tuple[int, int, int]]:
    """Offsets within a Euclidean distance, one of each opposite pair, without the zero offset."""
    r = int(math.floor(radius))
    return [o for o in itertools.product(range(-r, r + 1), repeat=3) if o > (0, 0, 0) and sum(x * x for x in o) <= radius * radius]


def _edges_once(cells: Cells, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Edges without loops or repeats, which short periodic axes give rise to."""
    a, b = cells.edges(offsets)
    if cells.dims is None:
        return a, b
    low, high = np.minimum(a, b), np.maximum(a, b)
    both = np.unique(np.stack([low, high], axis=1)[low < high], axis=0)
    return both[:, 0], both[:, 1]


def single_linkage(cells: Cells, threshold: float) -> np.ndarray:
    return dense(minimum_labels(len(cells), *_edges_once(cells, ball(threshold))))


def dbscan(cells: Cells, eps: float, min_pts: int) -> np.ndarray:
    """Clusters in order of their first core voxel; a border voxel goes to the first of its neighbours' clusters."""
    n = len(cells)
    a, b = _edges_once(cells, ball(eps))
    degree = 1 + np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    core = degree >= min_pts
    linked = core[a] & core[b]
    first = minimum_labels(n, a[linked], b[linked])
    out = np.where(core, first, n)
    for x, y in ((a, b), (b, a)):
        border = core[x] & ~core[y]
        np.minimum.at(out, y[border], first[x[border]])
    return dense(np.where(out < n, out, -1))


def kmeans(cells: Cells, k: int) -> np.ndarray:
    """Lloyd's iteration from evenly spaced voxels in raster order to a fixed point; lower ids win ties."""
    n = len(cells)
    if not n:
        return np.zeros(0, np.int64)
    if k < 1:
        raise ValueError("k must be at least 1")
    k = min(k, n)
    points = cells.ijk.astype(float)
    centre = points[[i * n // k for i in range(k)]]
    label = np.full(n, -1)
    for _ in range(KMEANS_ROUNDS):
        apart = np.sqrt(((points[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2))
        new = apart.argmin(axis=1)
        if (new == label).all():
            return dense(label)
        label = new
        count = np.bincount(label, minlength=k)
        for axis in range(3):
            total = np.bincount(label, weights=points[:, axis], minlength=k)
            centre[:, axis] = np.where(count > 0, total / np.maximum(count, 1), centre[:, axis])
    raise RuntimeError("k-means did not settle")


def skip_dfs(cells: Cells, stride: int) -> np.ndarray:
    """Depth-first walk that leaps up to ``stride`` voxels along the axes without minding gaps; a stride of 1 is 6-adjacency.

    The order of the stack is part of the rule, so this walks one voxel at a time.
    """
    if stride < 1:
        raise ValueError("the stride must be at least 1")
    at = {tuple(v): i for i, v in enumerate(cells.ijk.tolist())}
    dims = None if cells.dims is None else tuple(int(d) for d in cells.dims)
    top = tuple(int(x) for x in cells.ijk.max(axis=0)) if len(cells) else (0, 0, 0)

    def move(v, step, distance):
        w = tuple(x + s * distance for x, s in zip(v, step, strict=True))
        if dims is not None:
            return tuple(x % d for x, d in zip(w, dims, strict=True))
        return w if all(0 <= x <= t for x, t in zip(w, top, strict=True)) else None

    label = np.full(len(cells), -1)
    found = 0
    for start in map(tuple, cells.ijk.tolist()):
        if label[at[start]] >= 0:
            continue
        stack = [(start, True)]
        while stack:
            v, leaping = stack.pop()
            here = at.get(v)
            if here is None or label[here] >= 0:
                continue
            label[here] = found
            for step in AXIS_STEPS:
                if leaping:
                    for d in range(1, stride):
                        if (w := move(v, step, d)) is not None:
                            stack.append((w, False))
                    if (w := move(v, step, stride)) is not None:
                        stack.append((w, w in at))
                elif (w := move(v, step, 1)) is not None:
                    stack.append((w, w in at))
        found += 1
    return label


def squared(cells: Cells, of: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances between voxels, under minimum images where axes are periodic."""
    d = np.abs(of - to)
    if cells.dims is not None:
        d = np.minimum(d, cells.dims - d)
    return (d * d).sum(axis=-1)


def _whole_ball(cells: Cells, radius: int) -> np.ndarray:
    """Offsets within a distance, the zero offset too, nearest first; on a periodic axis one of each voxel's images, on an open one no farther than the voxels reach."""
    axes = []
    for axis in range(3):
        if cells.dims is None:
            reach = min(radius, int(cells.span[axis]) - 3)
            axes.append(np.arange(-reach, reach + 1))
        else:
            d = int(cells.dims[axis])
            axes.append(np.arange(max(-radius, -((d - 1) // 2)), min(radius, d // 2) + 1))
    o = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, 3)
    apart = (o * o).sum(axis=1)
    kept = apart <= radius * radius
    return o[kept][np.argsort(apart[kept], kind="stable")]


def _pairs_within(cells: Cells, of: np.ndarray, radius: int):
    """Blocks (a, b, squared distance) of the pairs of the voxels ``of`` with all voxels within a distance, a voxel with itself too.

    Either every offset is looked up or, where the ball holds more offsets than there are voxels around, those voxels are tried.
    """
    n = len(cells)
    if cells.dims is None:
        first, last = (np.searchsorted(cells.ijk[:, 0], cells.ijk[of, 0] + r, side) for r, side in ((-radius, "left"), (radius, "right")))
    else:
        first, last = np.zeros(len(of), np.int64), np.full(len(of), n)
    around = last - first
    reach = cells.span - 3 if cells.dims is None else cells.dims // 2
    if around.sum() > len(of) * min(4.2 * (radius + 0.5) ** 3, math.prod((2 * np.minimum(reach, radius) + 1).tolist())):
        offsets = _whole_ball(cells, radius)
        step = max(1, PAIRS_AT_ONCE // len(offsets))
        for at in range(0, len(of), step):
            own = of[at : at + step]
            there = cells.find(cells.ijk[own][:, None, :] + offsets)
            row, column = np.nonzero(there >= 0)
            yield own[row], there[row, column], (offsets[column] ** 2).sum(axis=1)
        return
    ends = np.concatenate([[0], np.cumsum(around)])
    at = 0
    while at < len(of):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS_AT_ONCE, "right")) - 1)
        size = around[at:stop]
        a = np.repeat(of[at:stop], size)
        b = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[at:stop], size)
        apart = squared(cells, cells.ijk[a], cells.ijk[b])
        near = apart <= radius * radius
        yield a[near], b[near], apart[near]
        at = stop


def _core_distances(cells: Cells, count: int) -> np.ndarray:
    """Squared distance of each voxel to the ``count``-th nearest, itself counted; balls grow until they hold that many."""
    core, left, radius = np.zeros(len(cells), np.int64), np.arange(len(cells)), 2
    while len(left):
        open_after = []
        for a, _, apart in _pairs_within(cells, left, radius):
            order = np.lexsort((apart, a))
            a, apart = a[order], apart[order]
            start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            enough = np.diff(np.r_[start, len(a)]) >= count
            core[a[start[enough]]] = apart[start[enough] + count - 1]
            open_after.append(a[start[~enough]])
        left = np.concatenate(open_after)
        radius = max(radius + 1, radius * 3 // 2)
    return core


class _Merges:
    """The hierarchy of mutual reachability: node x < n is a voxel, others are components as they come together at a squared distance.

    Children come before their parents, all that meet at one distance under one parent. Distances are worked off in rising order: an edge between
    components weighs at least as much as the voxels are apart, so a radius settles all weights up to its square, and larger ones are only
    looked for around the voxels outside the largest component.
    """

    def __init__(self, cells: Cells, core: np.ndarray):
        n = len(cells)
        self.node, left, radius = np.arange(n), np.arange(n), 2
        self.parent, self.level, self.size, self.first = np.full(n, -1), core, np.ones(n, np.int64), np.arange(n)
        while True:
            found, asked = [np.zeros((3, 0), np.int64)], np.zeros(n, bool)
            asked[left] = True
            for a, b, apart in _pairs_within(cells, left, radius):
                weight = np.maximum(np.maximum(core[a], core[b]), apart)
                kept = (self.node[a] != self.node[b]) & (weight <= radius * radius) & ((a < b) | ~asked[b])
                found.append(np.stack([weight[kept], a[kept], b[kept]]))
            weight, a, b = np.concatenate(found, axis=1)
            order = np.argsort(weight, kind="stable")
            weight, a, b = weight[order], a[order], b[order]
            bounds = [*np.flatnonzero(np.diff(weight, prepend=-1)).tolist(), len(weight)]
            for at, stop in itertools.pairwise(bounds):
                self._merge(int(weight[at]), a[at:stop], b[at:stop])
            nodes, inverse, sizes = np.unique(self.node, return_inverse=True, return_counts=True)
            if len(nodes) == 1:
                return
            left = np.flatnonzero(inverse != sizes.argmax())
            radius = max(radius + 1, radius * 3 // 2)

    def _merge(self, weight: int, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.node[a], self.node[b]
        apart = x != y
        if not apart.any():
            return
        old, ends = np.unique(np.concatenate([x[apart], y[apart]]), return_inverse=True)
        half = len(ends) // 2
        groups, into = np.unique(minimum_labels(len(old), ends[:half], ends[half:]), return_inverse=True)
        into, made = into + len(self), np.full(len(groups), -1)
        self.parent[old] = into
        self.parent, self.level = np.append(self.parent, made), np.append(self.level, np.full(len(groups), weight))
        self.size, self.first = np.append(self.size, 0 * made), np.append(self.first, len(self.node) + 0 * made)
        np.add.at(self.size, into, self.size[old])
        np.minimum.at(self.first, into, self.first[old])
        moved = np.arange(len(self))
        moved[old] = into
        self.node = moved[self.node]

    def __len__(self) -> int:
        return len(self.parent)


def hdbscan(cells: Cells, min_samples: int, min_cluster_size: int) -> np.ndarray:
    """HDBSCAN* with excess of mass; the root is never chosen, a cluster's members are those at its birth."""
    if min_samples < 2 or min_cluster_size < 1:
        raise ValueError("min_samples must be at least 2 and min_cluster_size at least 1")
    n = len(cells)
    if n < min_samples:
        return np.full(n, -1)
    merges = _Merges(cells, _core_distances(cells, min_samples))
    level, size, parent = merges.level, merges.size, merges.parent
    # Children that may go on as clusters, in order of their first voxel; a voxel alone, only if it is denser than where it parts.
    inner = np.flatnonzero(parent >= 0)
    inner = inner[(size[inner] >= min_cluster_size) & ((size[inner] > 1) | (level[inner] < level[parent[inner]]))]
    inner = inner[np.lexsort((merges.first[inner], parent[inner]))]
    ends = np.searchsorted(parent[inner], np.arange(len(merges) + 1)).tolist()
    inner, level, size = inner.tolist(), level.tolist(), size.tolist()
    top = len(merges) - 1
    birth, mass, children, born, at = [0.0], [0.0], [[]], [top], 0
    while at < len(born):
        x = born[at]
        while True:
            kept = inner[ends[x] : ends[x + 1]]
            gain = 1 / math.sqrt(level[x]) - birth[at]
            if len(kept) != 1:
                break
            mass[at] += gain * (size[x] - size[kept[0]])
            x = kept[0]
        mass[at] += gain * size[x]
        for part in kept:
            children[at].append(len(born))
            birth.append(1 / math.sqrt(level[x]))
            mass.append(0.0)
            children.append([])
            born.append(part)
        at += 1
    worth, chosen = [0.0] * len(born), [False] * len(born)
    for c in range(len(born) - 1, -1, -1):
        below = sum(worth[x] for x in children[c])
        chosen[c] = c > 0 and (not children[c] or mass[c] >= below)
        worth[c] = mass[c] if chosen[c] else below
    named, waiting = np.full(len(merges), -1), list(children[0])
    while waiting:
        c = waiting.pop()
        if chosen[c]:
            named[born[c]] = c
        else:
            waiting += children[c]
    # Names go down to the voxels, parents first.
    up, named = parent.tolist(), named.tolist()
    for x in range(len(merges) - 2, -1, -1):
        if named[x] < 0:
            named[x] = named[up[x]]
    return canonical(np.array(named[:n], dtype=np.int64))


def canonical(label: np.ndarray) -> np.ndarray:
    """Labels numbered by their first voxel in raster order."""
    first: dict[int, int] = {}
    for at, x in enumerate(label.tolist()):
        if x >= 0:
            first.setdefault(x, len(first))
    return np.array([first.get(x, -1) for x in label.tolist()], dtype=np.int64)


def _with_leftovers(cells: Cells, label: np.ndarray, connectivity: int) -> np.ndarray:
    """Unlabelled voxels become one cluster per component among themselves."""
    left = np.flatnonzero(label < 0)
    if len(left):
        rest = Cells(cells.ijk[left], None if cells.dims is None else tuple(cells.dims))
        label = label.copy()
        label[left] = component_labels(rest, connectivity) + label.max(initial=-1) + 1
    return canonical(label)


def resolution(eps: float) -> int:
    return max(1, round_half_away(eps))


def vccs(cells: Cells, eps: float) -> np.ndarray:
    """Textbook supervoxels: growth from occupied grid points over 6-adjacency, nearest to its seed first; ties by seed, then raster order."""
    s = resolution(eps)
    label = np.full(len(cells), -1)
    seeds = [i for i, v in enumerate(cells.ijk.tolist()) if all(x >= s // 2 and (x - s // 2) % s == 0 for x in v)]
    heap = [(0, number, v) for number, v in enumerate(seeds)]
    heapq.heapify(heap)
    near = [cells.find(cells.ijk + np.array(o)) for o in AXIS_STEPS] if len(cells) else []
    while heap:
        _, number, v = heapq.heappop(heap)
        if label[v] >= 0:
            continue
        label[v] = number
        for there in near:
            w = int(there[v])
            if w >= 0 and label[w] < 0:
                heapq.heappush(heap, (int(squared(cells, cells.ijk[w], cells.ijk[seeds[number]])), number, w))
    return _with_leftovers(cells, label, 6)


def supervoxel_seeds(cells: Cells, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (nearest occupied voxel to each occupied cell's centre) and those that are dense enough to start from."""
    n, corners = len(cells), np.unique(cells.ijk // s, axis=0) * s
    # Doubled, to stay in integers. A cell holds a voxel, so the nearest is no farther than a corner of the cell.
    offsets = np.array([o for o in itertools.product(range(-s, 2 * s), repeat=3) if sum((2 * x - s + 1) ** 2 for x in o) <= 3 * (s - 1) ** 2])
    dims = None if cells.dims is None else cells.dims * 2
    found = [np.zeros(0, np.int64)]
    step = max(1, PAIRS_AT_ONCE // len(offsets))
    for at in range(0, len(corners), step):
        own = corners[at : at + step]
        there = cells.find(own[:, None, :] + offsets)
        d = np.abs(cells.ijk[there] * 2 - (own * 2 + (s - 1))[:, None, :])
        if dims is not None:
            d = np.minimum(d, np.abs(dims - d))
        apart = np.where(there >= 0, (d * d).sum(axis=2), np.iinfo(np.int64).max)
        # Of the nearest the first in raster order.
        found.append(np.where(apart == apart.min(axis=1)[:, None], there, n).min(axis=1))
    candidates = np.unique(np.concatenate(found))
    around = _whole_ball(cells, s)
    around = around[4 * (around**2).sum(axis=1) <= s * s]
    step = max(1, PAIRS_AT_ONCE // len(around))
    held = [np.count_nonzero(cells.find(cells.ijk[candidates[at : at + step]][:, None, :] + around) >= 0, axis=1) for at in range(0, len(candidates), step)]
    return candidates, candidates[np.concatenate([np.zeros(0, np.int64), *held]) >= math.pi * (s / 2) ** 2]


class _Nearest:
    """The voxel nearest to a point, the first of equally near ones; cubes around the point grow until they must hold it."""

    def __init__(self, cells: Cells, towards):
        self.cells, self.towards = cells, towards

    def __call__(self, centre: np.ndarray) -> int:
        cells, r = self.cells, 2
        middle = np.rint(centre).astype(np.int64)
        while (2 * r + 1) ** 3 <= len(cells):
            there = cells.find(middle + np.array(list(itertools.product(range(-r, r + 1), repeat=3))))
            there = np.unique(there[there >= 0])
            if len(there):
                apart = (self.towards(there, centre) ** 2).sum(axis=1)
                # Voxels outside the cube are farther than r from the point on some axis.
                if apart.min() < r * r:
                    return int(there[apart.argmin()])
            r *= 2
        return int((self.towards(np.arange(len(cells)), centre) ** 2).sum(axis=1).argmin())


def vccs_optimized(cells: Cells, eps: float) -> np.ndarray:
    """Published supervoxels over 26-adjacency: dense seeds, then rounds of flow that all supervoxels take level by level."""
    n, s = len(cells), resolution(eps)
    if not n:
        return np.zeros(0, np.int64)
    _, seeds = supervoxel_seeds(cells, s)
    offsets = np.array(sorted(o for h in half_offsets(26) for o in (h, tuple(-x for x in h))))
    points, dims = cells.ijk.astype(float), None if cells.dims is None else cells.dims.astype(float)
    met: dict[int, list[int]] = {}

    def neighbours(v: int) -> list[int]:
        if v not in met:
            row = cells.find(cells.ijk[v] + offsets)
            met[v] = np.unique(row[(row >= 0) & (row != v)]).tolist()
        return met[v]

    def towards(v, centre):
        d = points[v] - centre
        return d if dims is None else d - dims * np.trunc(d / dims + np.copysign(0.5, d))

    places: dict[int, list[float]] = {}
    lengths = None if dims is None else dims.tolist()

    def apart(v: int, centre: list[float]) -> tuple[float, bool]:
        """Squared distance of one voxel, and whether it lies within the resolution on each axis: as ``towards`` has it, for a few at a time."""
        if v not in places:
            places[v] = points[v].tolist()
        x, y, z = (a - b for a, b in zip(places[v], centre, strict=True))
        if lengths is not None:
            x, y, z = (d - m * math.trunc(d / m + math.copysign(0.5, d)) for d, m in zip((x, y, z), lengths, strict=True))
        return (x * x + y * y) + z * z, -s <= x <= s and -s <= y <= s and -s <= z <= s

    def mean(members, about):
        return about + towards(np.asarray(members), about).sum(axis=0) / len(members)

    nearest = _Nearest(cells, towards)
    centre = []
    for v in seeds.tolist():
        ring = {v, *neighbours(v)}
        ring |= {x for w in neighbours(v) for x in neighbours(w)}
        centre.append(mean(sorted(ring), points[v]))
    alive = [True] * len(seeds)
    label = np.full(n, -1)
    for _ in range(FLOW_ROUNDS):
        best: dict[int, float] = {}
        owner: dict[int, int] = {}
        at = [c.tolist() for c in centre]
        frontier = [[nearest(centre[c])] if alive[c] else [] for c in range(len(seeds))]
        queued = [set(level) for level in frontier]
        open_ones = [c for c, level in enumerate(frontier) if level]
        while open_ones:
            for c in open_ones:
                following, took = [], False
                for v in frontier[c]:
                    d, _ = apart(v, at[c])
                    if not d < best.get(v, math.inf):
                        continue
                    best[v], owner[v], took = d, c, True
                    for w in neighbours(v):
                        if w in queued[c]:
                            continue
                        far, inside = apart(w, at[c])
                        if inside and far > d:
                            queued[c].add(w)
                            following.append(w)
                frontier[c] = following if took else []
            open_ones = [c for c in open_ones if frontier[c]]
        label = np.full(n, -1)
        taken: dict[int, list[int]] = {}
        for v in sorted(owner):
            label[v] = owner[v]
            taken.setdefault(owner[v], []).append(v)
        moved = False
        for c in range(len(seeds)):
            if not alive[c]:
                continue
            if c not in taken:
                alive[c], moved = False, True
                continue
            new = mean(taken[c], centre[c])
            moved |= not np.array_equal(new, centre[c])
            centre[c] = new
        if not moved:
            break
    return _with_leftovers(cells, label, 26)
