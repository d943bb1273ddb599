"""Longest chains against all pairs of points, and heights that keep every slope."""

import random

import pytest

from viatrix.operators import elevation as E


def plain(at, z, slope):
    """The chain by looking at all points before each."""
    best, before = [0] + [-1] * (len(z) - 1), [-1] * len(z)
    for j in range(1, len(z)):
        for i in range(j):
            if best[i] >= 0 and abs(z[j] - z[i]) <= slope * (at[j] - at[i]) + 1e-9 and best[i] + 1 > best[j]:
                best[j], before[j] = best[i] + 1, i
    kept, k = [], len(z) - 1
    while k >= 0 and best[-1] >= 0:
        kept.append(k)
        k = before[k]
    return kept[::-1]


@pytest.mark.parametrize("seed", range(40))
def test_chain(seed):
    r = random.Random(seed)
    n = r.choice([1, 2, 3, 30, 120])
    at = sorted(r.sample(range(3 * n), n))
    z = [r.choice([0.0, 3.5, 7.0, r.uniform(0, 20)]) for _ in range(n)]
    assert E.longest_chain(at, z, 3.5) == plain(at, z, 3.5)


def test_heights(spark):
    r, profiles = random.Random(3), {}
    for link in range(30):
        profiles[link] = [(i, r.uniform(0, 30) if r.random() < 0.7 else 10.0) for i in range(r.choice([1, 2, 40]))]
    profiles[99] = [(0, 0.0), (1, 50.0)]
    df = spark.createDataFrame([(k, *p) for k, x in profiles.items() for p in x], "link long, at int, z double")
    got = {}
    for x in E.feasible_heights(df, 3.5).collect():
        got.setdefault(x.link, []).append((x.at, x.z, x.height, x.moved))
    changes = {x.link: x.changes for x in E.fewest_changes(df, 3.5).collect()}
    for link, rows in got.items():
        rows.sort()
        assert [x[:2] for x in rows] == profiles[link]
        if changes[link] is None:
            assert all(x[2] is None for x in rows)
            continue
        assert sum(x[3] for x in rows) == changes[link] and all(x[2] == x[1] for x in rows if not x[3])
        assert all(abs(b[2] - a[2]) <= 3.5 * (b[0] - a[0]) + 1e-6 for a, b in zip(rows, rows[1:]))
    assert set(got) == set(profiles)
