"""Profiles of links: the fewest points to move so that no slope is too steep."""

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def longest_chain(at: list[int], z: list[float], slope: float) -> list[int]:
    """Positions of a longest chain from the first point to the last whose slopes are feasible; empty if the ends are too far apart.

    In coordinates turned so that both bounds of the slope are axes, a point may follow another if neither coordinate falls. In order of the one a
    Fenwick tree over the other finds the best chain so far: n log n steps. Of equal chains the one with the earlier points is taken.
    """
    n = len(z)
    up, down = [round(slope * a + h, 9) for a, h in zip(at, z)], [round(slope * a - h, 9) for a, h in zip(at, z)]
    if n and (up[0] > up[-1] or down[0] > down[-1]):
        return []
    rank = {x: i + 1 for i, x in enumerate(sorted(set(up)))}
    tree: list[tuple[int, int]] = [(0, 0)] * (len(rank) + 1)  # best length, and the earliest end of such a chain with its sign turned
    best, before = [0] * n, [-1] * n
    for j in sorted(range(n), key=lambda i: (down[i], up[i])):
        if up[j] < up[0] or down[j] < down[0]:
            continue  # nothing leads here from the first point
        top, i = (0, 0), rank[up[j]]
        while i:
            top, i = max(top, tree[i]), i & (i - 1)
        best[j], before[j] = top[0] + 1, -top[1] if top[0] else -1
        i = rank[up[j]]
        while i < len(tree):
            tree[i], i = max(tree[i], (best[j], -j)), i + (i & -i)
    kept, k = [], n - 1
    while k >= 0:
        kept.append(k)
        k = before[k]
    return kept[::-1]


def fewest_changes(profiles: DataFrame, slope: float) -> DataFrame:
    """(link, n, changes, kept): how many points between the ends must move, and which stay, at most slope a step.

    profiles: link long, at int (0, 1, ...), z double; a link's points are one group. Points can stay together if each follows the one before
    within slope times their distance; so what stays is a longest chain from end to end. If the ends themselves are
    too far apart, changes is null. Of equal chains the one with the earlier points stays.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        at, z = pdf["at"].tolist(), pdf["z"].tolist()
        kept = [at[i] for i in longest_chain(at, z, slope)]
        return pd.DataFrame({"link": [key[0]], "n": [len(z)], "changes": pd.array([len(z) - len(kept) if kept else None], dtype="Int64"), "kept": [kept]})

    return profiles.groupBy("link").applyInPandas(run, "link long, n int, changes long, kept array<int>")


def feasible_heights(profiles: DataFrame, slope: float) -> DataFrame:
    """(link, at, z, height, moved) of every point of profiles (link, at, z): heights at which no slope is too steep, and fewest points move.

    What stays is fewest_changes()'s; points between two that stay are set on the line between them, which is no steeper than
    the slope. Heights are null on links whose ends are too far apart.
    """
    kept = fewest_changes(profiles, slope).select("link", "kept")
    x = profiles.join(kept, "link").withColumn("moved", ~F.array_contains("kept", F.col("at")))
    by = Window.partitionBy("link").orderBy("at")
    stays = F.when(~F.col("moved"), F.struct("at", "z"))
    x = x.withColumns({"a": F.last(stays, ignorenulls=True).over(by), "b": F.first(stays, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))})
    between = F.col("a.z") + (F.col("b.z") - F.col("a.z")) * (F.col("at") - F.col("a.at")) / F.nullif(F.col("b.at") - F.col("a.at"), F.lit(0))
    height = F.when(F.size("kept") == 0, None).when(F.col("moved"), between).otherwise(F.col("z"))
    return x.select("link", "at", "z", height.alias("height"), "moved")
