"""Sections by list ranking against union-find and a walk."""

import random

import pytest

from viatrix.operators import sections as L


def plain(segments):
    """{(network, section): path} of (network, u, v, tracks, tokens)."""
    out = {}
    for network in {x[0] for x in segments}:
        kind = {(u, v): (t, k) for n, u, v, t, k in segments if n == network}
        beside = {}
        for u, v in kind:
            beside.setdefault(u, []).append(v)
            beside.setdefault(v, []).append(u)
        up = {e: e for e in kind}

        def root(e):
            while up[e] != e:
                e = up[e]
            return e

        for n, ends in beside.items():
            if len(ends) == 2:
                a, b = (tuple(sorted((n, m))) for m in ends)
                if kind[a] == kind[b]:
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
        groups = {}
        for e in kind:
            groups.setdefault(root(e), set()).add(e)
        for first, own in groups.items():
            near = {}
            for u, v in own:
                near.setdefault(u, set()).add(v)
                near.setdefault(v, set()).add(u)
            left = set(own)
            path = [min([n for n in near if len(near[n]) == 1] or near)]
            while left and (on := sorted(n for n in near[path[-1]] if tuple(sorted((path[-1], n))) in left)):
                left.discard(tuple(sorted((path[-1], on[0]))))
                path.append(on[0])
            out[network, f"{kind[first][0]:g}-{first[0]}-{first[1]}"] = path
    return out


def check(spark, segments):
    df = spark.createDataFrame(segments, "network int, u int, v int, tracks double, tokens string")
    chained = L.chains(df)
    got = {(x.network, x.section): x.path for x in L.section_paths(chained).collect()}
    assert got == plain(segments)
    assert sorted((x.network, x.u, x.v) for x in chained.collect()) == sorted(x[:3] for x in segments)


@pytest.mark.parametrize("seed", [4])
def test_sections(spark, seed):
    """Chains, rings, rings that hang on a node, and changes of kind, in many networks."""
    r, segments = random.Random(seed), []
    for network in range(12):
        names = r.sample(range(100), 60)
        edges = {tuple(sorted(names[i : i + 2])) for i in range(14)} | {tuple(sorted((names[20 + i], names[20 + (i + 1) % 9]))) for i in range(9)}
        edges |= {tuple(sorted((names[30 + i], names[30 + (i + 1) % 6]))) for i in range(6)} | {tuple(sorted((names[30], names[5])))}
        edges |= {tuple(sorted(r.sample(names[:15], 2))) for _ in range(r.randrange(4))}
        kinds = r.choice([[(1.0, "")], [(1.0, ""), (2.5, "")], [(2.0, "S1"), (2.0, "S2")]])
        segments += [(network, u, v, *(kinds[0] if r.random() < 0.8 else r.choice(kinds))) for u, v in sorted(edges)]
    check(spark, segments)


def test_a_long_chain_and_a_ring(spark):
    names = random.Random(1).sample(range(10_000), 900)
    line = [(0, *sorted(p), 1.0, "") for p in zip(names[:500], names[1:500])]
    ring = [(0, *sorted(p), 1.0, "") for p in zip(names[500:], names[501:] + names[500:501])]
    check(spark, line + ring)


def test_merged_lines(spark):
    """Pieces in any direction, repeated, branching, closed, of two keys; a piece without length."""
    xy = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [("a", xy((0, 0), (1, 0))), ("a", xy((2, 5), (1, 0))), ("a", xy((2, 5), (3, 5), (4, 5))), ("a", xy((1, 0), (0, 0))), ("b", xy((1, 0), (0, 0))), ("b", xy((1, 0), (2, 0))), ("b", xy((1, 0), (1, 7))),
            ("c", xy((0, 0), (1, 1), (2, 0))), ("c", xy((2, 0), (-0.0, 0))), ("d", xy((3, 3))), ("d", xy((3, 3), (3, 3))), ("d", []), ("d", None)]
    got = L.merged_lines(spark.createDataFrame(rows, "k string, points array<struct<x: double, y: double>>"), "k").collect()
    found = sorted((r.k, [tuple(p) for p in r.points]) for r in got)
    assert [(k, len(p)) for k, p in found] == [("a", 5), ("b", 2), ("b", 2), ("b", 2), ("c", 4)]
    assert found[0][1] in ([(0, 0), (1, 0), (2, 5), (3, 5), (4, 5)], [(4, 5), (3, 5), (2, 5), (1, 0), (0, 0)])
    assert found[4][1][0] == found[4][1][-1] and {*found[4][1]} == {(0, 0), (1, 1), (2, 0)}
