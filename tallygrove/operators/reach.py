"""Density clusters of groups of any size, as rounds of tables.

Equal vectors are one point with a weight.  Points are dealt to cells about
pivots; a search visits only cells that the triangle inequality doesn't rule
out, in pairs of blocks of bounded size, so neighbours are exact.  Each point
lists its nearest; the spanning tree of mutual reachability grows by rounds in
which every component takes its lightest edge to another.  An edge that no list
holds is at least as long as the list's last, so only points whose list is
shorter than the lightest edge known are searched again, among other components
and within that edge.  The tree, three numbers for each point, is condensed by
one task for each group: linear memory, and the limit of this design.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import Work
from . import density
from .labels import parts

#: Points of a block, and the pivots of all groups together beside one for each group; a cell has as many blocks as it needs.
BLOCK, PIVOTS = 1024, 8192

#: Cells that are searched together, one bit each, and vectors of a side that a task takes: a vector is shuffled once for
#: each ``WIDE`` of the other side, not once for each cell.
CELLS, WIDE = 32, 1 << 15

#: What rounding may add to a distance, and to one from a product of matrices.
_SLACK, _NEAR = 1e-9, 1e-6


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _packed(work: Work, df: DataFrame, group: str, key: str, vector: str, cosine: bool) -> DataFrame:
    """g, a number for each group (null is one too), its name, id, and v: the vector's doubles, null where it is no point."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def pack(batches):
        for pdf in batches:
            out = []
            for x in pdf["x"]:
                v = np.array(x if x is not None else [], np.float64)
                if cosine and len(v):
                    v = v / max(np.linalg.norm(v[None], axis=1)[0], 1e-12)
                out.append((v + 0.0).tobytes() if len(v) and np.isfinite(v).all() else None)
            yield pdf.drop(columns="x").assign(v=out)

    groups = work.keep(df.select(F.col(group).alias("is")).distinct().withColumn("g", F.monotonically_increasing_id()), "groups")
    rows = df.select(F.col(group).alias("named"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.join(groups, rows["named"].eqNullSafe(groups["is"])).select("g", "named", "id", "x")
    return rows.mapInPandas(pack, f"g long, named {kinds[group]}, id {kinds[key]}, v binary")


class _Cells:
    """Points dealt to the nearest pivot of their group, and what is known of each cell."""

    def __init__(self, work: Work, points: DataFrame):
        self.work = work
        every = max(BLOCK, -(-points.count() // PIVOTS))
        chosen = points.filter(F.pmod(F.xxhash64("p"), F.lit(every)) == 0).select("g", "p", "v")
        first = points.groupBy("g").agg(F.min_by("v", "p").alias("v"), F.min("p").alias("p")).select("g", "p", "v")
        rows = chosen.union(first).distinct().orderBy("g", "p").collect()
        names: dict[int, list[bytes]] = {}
        for r in rows:
            names.setdefault(r.g, []).append(bytes(r.v))
        self.pivots = pivots = {g: _matrix(v) for g, v in names.items()}

        def deal(batches):
            for pdf in batches:
                cell, far = [], []
                for g, v in zip(pdf["g"], pdf["v"]):
                    d = np.linalg.norm(pivots[int(g)] - np.frombuffer(v), axis=1)
                    cell.append(int(d.argmin()))
                    far.append(float(d.min()))
                yield pdf.assign(cell=cell, far=far)

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
        self.points = work.keep(points.mapInPandas(deal, kinds + ", cell int, far double"), "dealt")
        self.cells = work.keep(self.points.groupBy("g", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")), "cells")
        part = F.expr(f"cell div {CELLS}").cast("int").alias("part")
        self.parts = self.cells.groupBy("g", part).agg(F.ceil(F.sum("n") / WIDE).cast("int").alias("chunks"))
        self.radius = {g: np.zeros(len(m)) for g, m in pivots.items()}
        for r in self.cells.collect():
            self.radius[r.g][r.cell] = r.radius

    def search(self, queries: DataFrame, points: DataFrame, k: int, home: bool | None = None) -> DataFrame:
        """Of each query the k points of other components that are reached within its bound: g, p, x, reach.

        queries: g, p, v, core, comp, bound; points: g, p, v, cell, core, comp.
        ``home`` asks the nearest cell only, or (False) all others that the bound leaves.
        """
        pivots, radius = self.pivots, self.radius
        only: dict[int, dict[int, int]] = {}
        if home is None:  # cells of one component have nothing for that one
            for r in points.groupBy("g", "cell").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least = most").collect():
                only.setdefault(r.g, {})[r.cell] = r.least

        def aim(batches):
            for pdf in batches:
                found = []
                for g, v, comp, core, bound in zip(pdf["g"], pdf["v"], pdf["comp"], pdf["core"], pdf["bound"]):
                    d = np.linalg.norm(pivots[int(g)] - np.frombuffer(v), axis=1)
                    if home:
                        found.append([int(d.argmin())])
                        continue
                    open_ = np.maximum(d - radius[int(g)], core) <= bound + _SLACK
                    if home is False:
                        open_[d.argmin()] = False
                    closed = only.get(int(g), {})
                    found.append([int(c) for c in np.flatnonzero(open_) if closed.get(int(c)) != comp])
                masks: list[dict[int, int]] = []
                for cells in found:
                    masks.append({})
                    for c in cells:
                        masks[-1][c // CELLS] = masks[-1].get(c // CELLS, 0) | 1 << c % CELLS
                times = [len(m) for m in masks]
                yield pd.DataFrame({c: np.repeat(pdf[c].to_numpy(object), times) for c in pdf} | {"part": [c for m in masks for c in m], "mask": [x for m in masks for x in m.values()]})

        columns = "g long, p long, v binary, core double, comp long, bound double"
        aimed = self.work.keep(queries.select("g", "p", "v", "core", "comp", "bound").mapInPandas(aim, columns + ", part int, mask long"), "aimed", rolling=True)
        some = aimed.groupBy("g", "part").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("salts"))
        asked = self.work.keep(some.join(self.parts, ["g", "part"]), "asked", rolling=True)
        dealt = lambda n: F.pmod(F.xxhash64("p"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        block = ["g", "part", "chunk", "salt"]
        left = aimed.join(asked, ["g", "part"]).withColumn("salt", dealt("salts")).withColumn("chunk", each("chunks"))
        right = points.withColumn("part", F.expr(f"cell div {CELLS}").cast("int")).join(asked, ["g", "part"]).withColumn("chunk", dealt("chunks")).withColumn("salt", each("salts"))
        left, right = left.select(*block, "p", "v", "core", "comp", "bound", "mask"), right.select(*block, "p", "v", "core", "comp", "cell")

        def first(i: np.ndarray, name: np.ndarray, reach: np.ndarray) -> np.ndarray:
            """Places of the k nearest of each query, by query."""
            order = np.lexsort((name, reach, i))
            at = i[order]
            return order[np.arange(len(at)) - np.searchsorted(at, at) < k]

        def near(here, own, limit, mine, there, core, theirs, name):
            """Query, point and reach of what two blocks have within limits."""
            # a product of matrices says who may be near, the difference of vectors decides
            a, b = (here**2).sum(axis=1), (there**2).sum(axis=1)
            about = here @ there.T
            about *= -2
            about += b
            if np.isin(mine, theirs).any():
                about[mine[:, None] == theirs] = np.inf
            free = np.flatnonzero(np.isinf(limit))
            if len(free):  # of queries that have no limit yet the k-th here is one
                some = np.maximum(np.maximum(np.sqrt(np.maximum(about[free] + a[free, None], 0)), core), own[free, None])
                limit = limit.copy()
                limit[free] = np.partition(some, k - 1, axis=1)[:, k - 1] if k < len(name) else some.max(axis=1)
            limit = limit + _NEAR * (1 + np.sqrt(a + b.max()))
            i, j = np.nonzero(about <= (limit**2 - a)[:, None])
            fit = (np.maximum(core[j], own[i]) <= limit[i]) & np.isfinite(about[i, j])
            i, j = i[fit], j[fit]
            reach = np.maximum(np.maximum(np.linalg.norm(there[j] - here[i], axis=1), core[j]), own[i])
            return i, name[j], reach

        def pairs(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({"g": [], "p": [], "x": [], "reach": []})
            x = x.sort_values("cell", kind="stable")
            here, there = _matrix(list(q["v"])), _matrix(list(x["v"]))
            own, bound, mine, mask = (q[c].to_numpy() for c in ("core", "bound", "comp", "mask"))
            core, theirs, name, cell = (x[c].to_numpy() for c in ("core", "comp", "p", "cell"))
            # the k nearest so far, and the limit that they are for the next block
            best_name, best = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf)
            for c in np.unique(cell):
                asks = np.flatnonzero(mask >> (c % CELLS) & 1)
                s, e = np.searchsorted(cell, [c, c + 1])
                for y in range(s, e, BLOCK):
                    to = slice(y, min(e, y + BLOCK))
                    for z in range(0, len(asks), BLOCK):
                        at = asks[z : z + BLOCK]
                        limit = np.minimum(bound[at], best[at, k - 1])
                        i, found, reach = near(here[at], own[at], limit, mine[at], there[to], core[to], theirs[to], name[to])
                        i = at[i]
                        fit = reach <= np.minimum(bound[i], best[i, k - 1])
                        if not fit.any():
                            continue
                        rows = np.unique(i[fit])
                        old, place = np.nonzero(np.isfinite(best[rows]))
                        i, found, reach = np.r_[i[fit], rows[old]], np.r_[found[fit], best_name[rows[old], place]], np.r_[reach[fit], best[rows[old], place]]
                        top = first(i, found, reach)
                        i, found, reach = i[top], found[top], reach[top]
                        turn = np.arange(len(i)) - np.searchsorted(i, i)
                        best[i, turn], best_name[i, turn] = reach, found
            i, turn = np.nonzero(np.isfinite(best))
            return pd.DataFrame({"g": q["g"].to_numpy()[i], "p": q["p"].to_numpy()[i], "x": best_name[i, turn], "reach": best[i, turn]})

        found = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(pairs, "g long, p long, x long, reach double")
        line = Window.partitionBy("g", "p").orderBy("reach", "x")
        return found.withColumn("n", F.row_number().over(line)).filter(F.col("n") <= k).drop("n")


def _lists(cells: _Cells, k: int) -> DataFrame:
    """Of each point its k nearest: g, p, x, reach. The home cell gives the bound for the others."""
    rows = cells.points.withColumn("core", F.lit(0.0)).withColumn("comp", F.col("p"))
    near = cells.work.keep(cells.search(rows.withColumn("bound", F.lit(float("inf"))), rows, k, True), "home")
    full = near.groupBy("g", "p").agg(F.max("reach").alias("far"), F.count("*").alias("n")).select("g", "p", F.when(F.col("n") == k, F.col("far")).alias("bound"))
    bounded = rows.join(full, ["g", "p"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    line = Window.partitionBy("g", "p").orderBy("reach", "x")
    both = near.union(cells.search(bounded, rows, k, False))
    return cells.work.keep(both.withColumn("n", F.row_number().over(line)).filter(F.col("n") <= k).drop("n"), "lists")


def _cores(points: DataFrame, lists: DataFrame, k: int, neighbours: int) -> DataFrame:
    """points with core, the distance of the last of so many neighbours, copies counted, and r, that no unlisted point is nearer than."""
    total = points.groupBy("g").agg(F.least(F.sum("w") - 1, F.lit(neighbours)).alias("want"))
    upto = Window.partitionBy("g", "p").orderBy("reach", "x")
    listed = lists.join(points.select("g", F.col("p").alias("x"), F.col("w").alias("xw")), ["g", "x"]).withColumn("cum", F.sum("xw").over(upto))
    own = listed.join(points.select("g", "p", "w"), ["g", "p"]).join(total, "g")
    found = own.groupBy("g", "p").agg(
        F.min(F.when(F.col("w") - 1 + F.col("cum") >= F.col("want"), F.col("reach"))).alias("core"), F.when(F.count("*") == k, F.max("reach")).otherwise(float("inf")).alias("r")
    )
    rows = points.join(found, ["g", "p"], "left").join(total, "g")
    return rows.withColumn("core", F.when(F.col("w") - 1 >= F.col("want"), 0.0).otherwise(F.coalesce("core", F.lit(0.0)))).withColumn("r", F.coalesce("r", F.lit(float("inf")))).drop("want")


def _tree(cells: _Cells, state: DataFrame, lists: DataFrame) -> DataFrame | None:
    """g, a, b, w: a spanning tree of every group, perhaps with edges more that are as long as those they close a ring with."""
    work = cells.work
    core = lambda side: state.select("g", F.col("p").alias(side), F.col("core").alias(f"core_{side}"))
    ends = lists.select("g", F.least("p", "x").alias("a"), F.greatest("p", "x").alias("b"), "reach").distinct()
    edges = work.keep(ends.join(core("a"), ["g", "a"]).join(core("b"), ["g", "b"]).select("g", "a", "b", F.greatest("reach", "core_a", "core_b").alias("w")), "edges", rolling=True)
    labels = state.select("g", "p", F.col("p").alias("comp"))
    tree = None
    while True:
        nodes = work.keep(labels.select("g", F.col("comp").alias("node")).distinct(), "nodes", rolling=True)
        alive = nodes.groupBy("g").count().filter("count > 1").select("g")
        if alive.isEmpty():
            return tree
        name = lambda side: labels.select("g", F.col("p").alias(side), F.col("comp").alias(f"c_{side}"))
        across = edges.join(name("a"), ["g", "a"]).join(name("b"), ["g", "b"]).filter("c_a <> c_b")
        edges = work.keep(across.select("g", "a", "b", "w"), "edges", rolling=True)
        pick = lambda c: F.struct("w", "c_a", "c_b", "a", "b").alias("pick")
        sides = across.select("g", F.col("c_a").alias("comp"), pick("a")).union(across.select("g", F.col("c_b").alias("comp"), pick("b")))
        known = work.keep(sides.groupBy("g", "comp").agg(F.min("pick").alias("pick")), "known", rolling=True)
        at = work.keep(state.drop("comp").join(labels, ["g", "p"]).join(alive, "g", "left_semi"), "at", rolling=True)
        bound = at.join(known.select("g", "comp", F.col("pick.w").alias("bound")), ["g", "comp"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        farther = cells.search(bound.filter("r < bound"), at, 1).select("g", F.col("p").alias("a"), F.col("x").alias("b"), F.col("reach").alias("w"))
        farther = farther.join(name("a"), ["g", "a"]).join(name("b"), ["g", "b"]).select("g", F.col("c_a").alias("comp"), pick("a"))
        picks = work.keep(known.union(farther).groupBy("g", "comp").agg(F.min("pick").alias("pick")).select("g", "pick.*"), "picks")
        tree = picks.select("g", "a", "b", "w") if tree is None else tree.union(picks.select("g", "a", "b", "w"))
        links = picks.select("g", F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        links = links.union(links.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        joined = parts(work, links, nodes.withColumn("c", F.lit(0)))
        labels = work.keep(labels.join(joined.select("g", F.col("node").alias("comp"), "part"), ["g", "comp"]).select("g", "p", F.col("part").alias("comp")), "comps", rolling=True)


def detect(df: DataFrame, group: str, key: str, vector: str, least: int, neighbours: int, cosine: bool) -> DataFrame:
    """group, id, cluster, as ``density.detect`` gives them, by rounds."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    work = Work(df.sparkSession, "density")
    rows = work.keep(_packed(work, df, group, key, vector, cosine), "rows")
    points = rows.filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("w"), F.min("id").alias("first"))
    points = work.keep(points.withColumn("p", F.monotonically_increasing_id()), "points")
    out = [F.col("named").alias(group), "id"]
    noise = F.lit(density.NOISE).alias("cluster")
    if points.isEmpty():
        return rows.select(*out, noise)
    cells = _Cells(work, points)
    k = max(1, neighbours)
    lists = _lists(cells, k)
    state = work.keep(_cores(cells.points, lists, k, neighbours), "state")
    tree = _tree(cells, state, lists)
    if tree is None:  # no group has two points
        return rows.select(*out, noise)

    def condense(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("first")
        place = pd.Series(np.arange(len(nodes)), nodes["p"])
        found = density.condensed(nodes["w"].to_numpy(), nodes["core"].to_numpy(), place[links["a"]].to_numpy(), place[links["b"]].to_numpy(), links["w"].to_numpy(), least)
        return pd.DataFrame({"g": nodes["g"].to_numpy(), "p": nodes["p"].to_numpy(), "cluster": found})

    found = state.select("g", "p", "w", "core", "first").groupBy("g").cogroup(tree.groupBy("g")).applyInPandas(condense, "g long, p long, cluster int")
    named = points.select("g", "v", "p").join(found, ["g", "p"]).drop("p")
    return rows.join(named, ["g", "v"], "left").select(*out, F.coalesce("cluster", F.lit(density.NOISE)).cast("int").alias("cluster"))
