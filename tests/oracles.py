"""Independent, slow versions of what the engine computes, and builders of test input."""

from __future__ import annotations

import itertools
import math
from collections import deque


def near(v, w, dims=None):
    d = [abs(a - b) for a, b in zip(v, w, strict=True)]
    return [min(x, n - x) for x, n in zip(d, dims, strict=True)] if dims else d


def canonical(groups, order=None):
    """Partition as voxel -> first voxel of its group."""
    return {v: min(g) for g in groups for v in g}


def flood(cells, linked):
    """Groups of cells that ``linked`` pairs connect, by breadth-first search."""
    left, groups = set(cells), []
    while left:
        start = min(left)
        left.discard(start)
        group, queue = [start], deque([start])
        while queue:
            v = queue.popleft()
            found = [w for w in left if linked(v, w)]
            left.difference_update(found)
            group += found
            queue.extend(found)
        groups.append(group)
    return groups


def adjacency(connectivity, dims=None):
    reach = {6: 1, 18: 2, 26: 3}[connectivity]

    def linked(v, w):
        d = near(v, w, dims)
        return max(d) <= 1 and sum(d) <= reach

    return linked


def components(cells, connectivity, dims=None):
    return canonical(flood(cells, adjacency(connectivity, dims)))


def from_labels(rows):
    """(i, j, k, label) rows as voxel -> first voxel of its label."""
    groups = {}
    for *v, label in rows:
        groups.setdefault(label, []).append(tuple(v))
    return canonical(groups.values())


def dbscan(cells, eps, min_pts, dims=None):
    """The textbook procedure, one point at a time in raster order."""
    cells = sorted(cells)
    around = {v: [w for w in cells if sum(x * x for x in near(v, w, dims)) <= eps * eps] for v in cells}
    label, count = {}, 0
    for v in cells:
        if v in label or len(around[v]) < min_pts:
            continue
        queue = deque([v])
        label[v] = count
        while queue:
            p = queue.popleft()
            if len(around[p]) < min_pts:
                continue
            for w in around[p]:
                if w not in label:
                    label[w] = count
                    queue.append(w)
        count += 1
    groups = {}
    for v, c in label.items():
        groups.setdefault(c, []).append(v)
    return canonical(groups.values())


def hdbscan_levels(cells, min_samples, min_size, dims=None):
    """HDBSCAN* from the complete reachability graph, without a spanning tree: sets of chosen clusters."""
    cells = sorted(cells)
    if len(cells) < min_samples:
        return set()
    d2 = {(v, w): sum(x * x for x in near(v, w, dims)) for v in cells for w in cells}
    core = {v: sorted(d2[v, w] for w in cells)[min_samples - 1] for v in cells}
    weight = {p: max(core[p[0]], core[p[1]], d) for p, d in d2.items()}
    levels = sorted({w for p, w in weight.items() if p[0] < p[1]} | set(core.values()), reverse=True)
    root = {"members": set(cells), "born": frozenset(cells), "birth": 0.0, "mass": 0.0, "children": []}
    live = [root]
    for level in levels:
        following = []
        for c in live:
            parts = [set(g) for g in flood(c["members"], lambda v, w, level=level: weight[v, w] < level)]
            bare = {v for v in c["members"] if core[v] >= level}
            if len(parts) == 1 and not bare:
                following.append(c)
                continue
            kept = [p for p in parts if len(p) >= min_size and not (min_size == 1 and len(p) == 1 and p <= bare)]
            gain = 1 / math.sqrt(level) - c["birth"]
            if len(kept) == 1:
                c["mass"] += gain * (len(c["members"]) - len(kept[0]))
                c["members"] = kept[0]
                following.append(c)
                continue
            c["mass"] += gain * len(c["members"])
            for p in kept:
                child = {"members": p, "born": frozenset(p), "birth": 1 / math.sqrt(level), "mass": 0.0, "children": []}
                c["children"].append(child)
                following.append(child)
        live = following

    def best(c):
        below = [best(x) for x in c["children"]]
        total, chosen = sum(b[0] for b in below), set().union(*[b[1] for b in below]) if below else set()
        if c is not root and (not below or c["mass"] >= total):
            return c["mass"], {c["born"]}
        return total, chosen

    return best(root)[1]


def boxes(*corners):
    """Voxels of several axis-parallel boxes given by their low and high corners."""
    return sorted({v for low, high in corners for v in itertools.product(*[range(a, b + 1) for a, b in zip(low, high, strict=True)])})


def pdb_text(frames, cells=None):
    out = []
    for n, atoms in enumerate(frames):
        out.append(f"MODEL     {n + 1:4d}  TIME= {n * 2.5}")
        if cells and cells[n]:
            a, b, c, al, be, ga = cells[n]
            out.append(f"CRYST1{a:9.3f}{b:9.3f}{c:9.3f}{al:7.2f}{be:7.2f}{ga:7.2f} {'P 1':<11s}{1:4d}")
        for i, (name, x, y, z) in enumerate(atoms):
            out.append(f"ATOM  {i + 1:5d} {name:^4s} HOH A{1:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           O")
        out.append("ENDMDL")
    return "\n".join([*out, "END", ""])
