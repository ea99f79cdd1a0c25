"""Density-based clusters of vectors; what is in none is noise, -1.

Core distances, the minimum spanning tree of mutual reachability, and the
condensed tree of clusters of at least ``least`` members, of which the most
stable are taken.  What joins at one distance joins at once, so the result
doesn't depend on which of several spanning trees was found.  A group of up to
``KERNEL_POINTS`` vectors is one task, quadratic in time and linear in memory;
larger groups go through ``reach``, with the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE = -1

#: Vectors of a group that one task takes.
KERNEL_POINTS = 8192


def _spanning_tree(points: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Prim over mutual reachability, a row of distances at a time."""
    n = len(points)
    best, source = np.full(n, np.inf), np.zeros(n, int)
    out, at = [], 0
    waiting = np.ones(n, bool)
    waiting[0] = False
    for _ in range(n - 1):
        reach = np.maximum(np.maximum(np.linalg.norm(points - points[at], axis=1), core), core[at])
        closer = waiting & (reach < best)
        best[closer], source[closer] = reach[closer], at
        at = int(np.argmin(np.where(waiting, best, np.inf)))
        waiting[at] = False
        out.append((float(best[at]), int(source[at]), at))
    return sorted(out)


def _merged(core: np.ndarray, weights: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[list[tuple[float, list[int]]], list[int]]:
    """Inner nodes of the tree of merges, as distance and what met there, and the size of every node; points come first."""
    n = len(core)
    parent, top, size, inner = list(range(n)), list(range(n)), [int(x) for x in weights], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.argsort(w, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(w[order]) > 0])
    for at, end in zip(starts, np.r_[starts[1:], len(order)]):
        met: dict[int, list[int]] = {}
        for i in order[at:end]:
            x, y = root(int(a[i])), root(int(b[i]))
            if x == y:
                continue
            one, other = met.pop(x, [top[x]]), met.pop(y, [top[y]])
            if len(one) < len(other):
                x, y, one, other = y, x, other, one
            parent[y] = x
            one.extend(other)
            met[x] = one
        for x, nodes in met.items():
            top[x] = n + len(inner)
            inner.append((float(w[order[at]]), nodes))
            size.append(sum(size[y] for y in nodes))
    return inner, size


def condensed(weights: np.ndarray, core: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> np.ndarray:
    """A cluster for each point from the edges of a spanning tree; a point of weight n is n equal points.

    Edges that close a ring are ignored.  Clusters are numbered by weight,
    largest first, then by their first point.
    """
    n = len(weights)
    if n < 2 or int(weights.sum()) < max(2, least):
        return np.full(n, NOISE)
    inner, size = _merged(core, weights, a, b, w)
    born, stability, splits, points_of = {0: 0.0}, {0: 0.0}, {}, {0: []}
    todo, count = [(len(size) - 1, 0)], 1

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            out.append(x) if x < n else stack.extend(inner[x - n][1])
        return out

    while todo:
        node, cluster = todo.pop()
        if node < n:  # copies that fall apart at their core distance
            stability[cluster] += (1 / max(float(core[node]), 1e-12) - born[cluster]) * size[node]
            points_of[cluster].append(node)
            continue
        d, nodes = inner[node - n]
        density = 1 / max(d, 1e-12)
        big = [x for x in nodes if size[x] >= least and not (x < n and (size[x] == 1 or core[x] >= d))]
        stays = set(big) if len(big) == 1 else set()
        for x in nodes:
            if x in stays:
                todo.append((x, cluster))
                continue
            stability[cluster] += (density - born[cluster]) * size[x]
            if x not in big:
                points_of[cluster].extend(leaves(x))
        if len(big) > 1:
            splits[cluster] = list(range(count, count + len(big)))
            for x in big:
                born[count], stability[count], points_of[count] = density, 0.0, []
                todo.append((x, count))
                count += 1
    chosen, value = set(), {}
    for c in sorted(stability, reverse=True):  # children have larger numbers
        below = sum(value[x] for x in splits.get(c, []))
        if c and stability[c] >= below:
            value[c] = stability[c]
            gone = list(splits.get(c, []))
            while gone:
                x = gone.pop()
                chosen.discard(x)
                gone.extend(splits.get(x, []))
            chosen.add(c)
        else:
            value[c] = below
    label = np.full(n, NOISE)
    rank = []
    for c in chosen:
        stack, members = [c], []
        while stack:
            x = stack.pop()
            members.extend(points_of[x])
            stack.extend(splits.get(x, []))
        label[members] = c
        rank.append((-int(weights[members].sum()), min(members), c))
    order = {c: r for r, (_, _, c) in enumerate(sorted(rank))}
    return np.array([order.get(c, NOISE) for c in label])


def clusters(points: np.ndarray, least: int = 50, neighbours: int = 10) -> np.ndarray:
    """A cluster for each point, numbered by size, largest first, or -1."""
    n = len(points)
    if n < max(2, least):
        return np.full(n, NOISE)
    k = min(neighbours, n - 1)
    core = np.array([np.partition(np.linalg.norm(points - p, axis=1), k)[k] for p in points])
    w, a, b = (np.array(x) for x in zip(*_spanning_tree(points, core)))
    return condensed(np.ones(n, int), core, a, b, w, least)


def detect(df: DataFrame, group: str, key: str = "id", vector: str = "v", least: int = 50, neighbours: int = 10, cosine: bool = True) -> DataFrame:
    """group, id, cluster. With ``cosine`` vectors are put on the unit sphere first.

    Rows whose vector is null, empty, or holds a null or non-finite number are
    noise and count as nobody's neighbours; rows of one key are rows apart;
    vectors of a group have one length, else the job fails.
    """
    from . import reach

    sizes = df.groupBy(F.col(group).alias("_g")).count()
    large = sizes.filter(F.col("count") > KERNEL_POINTS).select("_g")
    if large.isEmpty():
        return _by_kernel(df, group, key, vector, least, neighbours, cosine)
    same = df[group].eqNullSafe(large["_g"])
    small = _by_kernel(df.join(large, same, "left_anti"), group, key, vector, least, neighbours, cosine)
    return small.unionByName(reach.detect(df.join(large, same, "left_semi"), group, key, vector, least, neighbours, cosine))


def _by_kernel(df: DataFrame, group: str, key: str, vector: str, least: int, neighbours: int, cosine: bool) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        fit = np.array([x is not None and len(x) > 0 and bool(np.isfinite(np.array(x, np.float64)).all()) for x in pdf[vector]], bool)
        label = np.full(len(pdf), NOISE)
        if fit.any():
            points = np.array(pdf[vector][fit].tolist(), np.float64)
            if cosine:
                points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
            label[fit] = clusters(points, least, neighbours)
        return pd.DataFrame({group: pdf[group], "id": pdf[key], "cluster": label})

    return df.select(group, key, vector).groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, id {kinds[key]}, cluster int")
