"""Searches of many small graphs, one task for each, and fills in a drawn order. For one large network see routing and sections."""

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def k_shortest_simple(edges: DataFrame, pairs: DataFrame, k: int = 2) -> DataFrame:
    """(graph_id, o, d, nth, length, path): the k shortest paths without repeats of each pair, by best-first search.

    edges: graph_id, u, v, w; pairs: graph_id, o, d. Ties go in order of the node lists.
    """

    def run(key: tuple, links: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for u, v, w in zip(links.u.tolist(), links.v.tolist(), links.w.tolist()):
            out.setdefault(u, {})[v] = min(w, out.get(u, {}).get(v, float("inf")))
        into: dict = {}
        for u, vs in out.items():
            for v, w in vs.items():
                into.setdefault(v, []).append((u, w))
        rows = []
        for o, d in zip(wanted.o.tolist(), wanted.d.tolist()):
            left, heap = {}, [(0.0, d)]  # exact distance to d: no path is extended in vain
            while heap:
                x, n = heapq.heappop(heap)
                if n in left:
                    continue
                left[n] = x
                for m, w in into.get(n, ()):
                    heapq.heappush(heap, (x + w, m))
            found, heap = 0, [(left[o], 0.0, [o])] if o in left else []
            while heap and found < k:
                _, x, path = heapq.heappop(heap)
                if path[-1] == d:
                    found += 1
                    rows.append((key[0], o, d, found, x, path))
                    continue
                for m, w in out.get(path[-1], {}).items():
                    if m not in path and m in left:
                        heapq.heappush(heap, (x + w + left[m], x + w, path + [m]))
        return pd.DataFrame(rows, columns=["graph_id", "o", "d", "nth", "length", "path"])

    return edges.groupBy("graph_id").cogroup(pairs.groupBy("graph_id")).applyInPandas(run, "graph_id int, o int, d int, nth int, length double, path array<int>")


def paths_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, o, d, cost, path) of the shortest path of each pair (graph_id, o, d) over edges (graph_id, u, v, w > 0).

    A search begins at each o and ends when its wanted nodes are reached. Of equally short paths the first in order of their nodes
    is taken. Pairs without a path, or with a node that the graph lacks, give no row.
    """
    kind, name = (dict(edges.dtypes)[c] for c in ("u", "graph_id"))

    def run(key: tuple, links: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for u, v, w in zip(links.u.tolist(), links.v.tolist(), links.w.tolist()):
            out.setdefault(u, {})[v] = min(w, out.get(u, {}).get(v, float("inf")))
        ends: dict = {}
        for o, d in zip(wanted.o.tolist(), wanted.d.tolist()):
            ends.setdefault(o, set()).add(d)
        rows = []
        for o, left in ends.items():
            done, heap = set(), [(0.0, (o,))]
            while heap and left:
                x, path = heapq.heappop(heap)
                u = path[-1]
                if u in done:
                    continue
                done.add(u)
                if u in left and (u in out or len(path) > 1):
                    left.discard(u)
                    rows.append((key[0], o, u, x, list(path)))
                for v, w in out.get(u, {}).items():
                    if v not in done:
                        heapq.heappush(heap, (round(x + w, 9), (*path, v)))
        return pd.DataFrame(rows, columns=["graph_id", "o", "d", "cost", "path"])

    pairs = pairs.select("graph_id", "o", "d").toDF("of", "o", "d")  # pairs may come from the edges themselves
    return edges.groupBy("graph_id").cogroup(pairs.groupBy("of")).applyInPandas(run, f"graph_id {name}, o {kind}, d {kind}, cost double, path array<{kind}>")


def inward_development(zones: DataFrame) -> DataFrame:
    """(scenario, zone, filled): each scenario's target fills zones in a drawn order, none beyond its potential.

    zones: scenario, zone, potential, target, draw.
    """
    order = Window.partitionBy("scenario").orderBy("draw", "zone").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("target") - F.sum("potential").over(order) + F.col("potential")
    return zones.select("scenario", "zone", F.least(F.greatest(left, F.lit(0.0)), "potential").alias("filled"))
