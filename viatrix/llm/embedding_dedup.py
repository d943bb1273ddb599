"""Near-duplicate vectors by an inverted multi-index (operator 2).

Unit vectors are halved and each half has its own codebook, so pairs of codewords form a grid of
cells. Every vector lies in one cell and visits others in the order of the sum of both halves' squared
distances (multi-sequence traversal of the two sorted lists), until the sum has grown so far beyond the
home cell's that the target recall is reached. How far is learned from a bounded set of queries whose links are sought
among all vectors: the recall-quantile of that excess over their true links, each query weighing the same in each band
of cosine, and at least the FLOOR-quantile over made ones at the very least cosine. Other queries measure the recall, again among all
vectors, and the reach is widened if it falls short. Vectors that meet in a cell are compared exactly, in double precision.

Equal vectors are one class and are compared once. Vectors of unlike widths have no cosine; each width that the sample
shows has its own codebooks, and the few of any other width are all compared, in blocks like those of one cell.
Cells with one first codeword go together, in as many groups as keep a group about as large as a block, so a vector is sent
once to a group with the list of the cells that it visits there. Groups are dealt in blocks on both sides, so a task never
holds more than two blocks, and a block sends on link counts and a spanning forest, never its pairs.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from viatrix.llm.components import components
from viatrix.llm.store import Cuts
from viatrix.llm.words import Hasher

#: bounds of what is fitted on: vectors for the codebooks, queries for the traversal's reach and as many to measure the recall
SAMPLE, QUERIES = 20_000, 400
#: a width of which the sample has fewer vectors has no codebooks; recall that must be measured
FEW, FLOOR = 64, 0.95
WORDS, BLOCK = 24, 2048


VISITS = pa.list_(pa.struct([("home", pa.int32()), ("cells", pa.list_(pa.int32()))]))


def codewords(n: int, least: int = WORDS, sample: int = SAMPLE) -> int:
    """Words of each codebook for n vectors: cells grow with the root of n beyond a million, as long as the sample gives 32 vectors a word."""
    return max(least, min(int(least * (n / 2**20) ** 0.25), sample // 32))


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows of a list column, and their vectors at length one."""
    rows, out = [], []
    for i, x in enumerate(column.to_pylist()):
        if not x or any(v is None for v in x):
            continue
        v = np.asarray(x, np.float64)
        size = np.abs(v).max()
        if np.isfinite(size) and np.isfinite(v).all() and size > 0:
            v = v / size  # no overflow nor underflow in the squares
            rows.append(i)
            out.append(v / np.sqrt((v * v).sum()))
    return np.array(rows, np.int64), out


def fit_codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 2) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
        n = np.bincount(at, minlength=len(c))
        for j in range(x.shape[1]):
            s = np.bincount(at, weights=x[:, j], minlength=len(c))
            c[:, j] = np.where(n > 0, s / np.maximum(n, 1), c[:, j])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def traverse(a: np.ndarray, b: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Cells in ascending order of a[i] + b[j], as long as the sum exceeds the least one by no more than reach."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    top = a[oa[0]] + b[ob[0]] + reach
    heap, seen, out = [(a[oa[0]] + b[ob[0]], 0, 0)], {(0, 0)}, []
    while heap:
        s, i, j = heapq.heappop(heap)
        if s > top:
            break
        out.append((int(oa[i]), int(ob[j])))
        for m, n in ((i + 1, j), (i, j + 1)):
            if m < len(oa) and n < len(ob) and (m, n) not in seen:
                seen.add((m, n))
                heapq.heappush(heap, (a[oa[m]] + b[ob[n]], m, n))
    return out


def quantile(excess: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The least excess that holds a share of the weights."""
    order = excess.argsort()
    total = weight[order].cumsum()
    return float(excess[order][min(np.searchsorted(total, share * total[-1]), len(excess) - 1)])


def cost(v: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of both halves to their codewords."""
    half, books = model["half"], model["books"]
    return distances(v[:, :half], books[0]), distances(v[:, half:], books[1])


def made_reach(u: np.ndarray, model: dict, cosine: float, recall: float, trials: int = 8, seed: int = 3) -> float:
    """The recall-quantile of the excess, both ways, over vectors turned at random from u to the least cosine: these are there however few links there are."""
    own = np.repeat(np.arange(len(u)), trials)
    turn = np.random.default_rng(seed).normal(size=(len(own), u.shape[1]))
    turn -= (turn * u[own]).sum(1)[:, None] * u[own]
    size = np.sqrt((turn * turn).sum(1))[:, None]
    v = cosine * u[own] + np.sqrt(max(1 - cosine * cosine, 0)) * turn / np.maximum(size, 1e-9)
    (da, db), (ta, tb), i = cost(u, model), cost(v, model), np.arange(len(own))
    there, home = (ta.argmin(1), tb.argmin(1)), (da.argmin(1), db.argmin(1))
    least = (da.min(1) + db.min(1))[own]
    excess = [da[own, there[0]] + db[own, there[1]] - least, ta[i, home[0][own]] + tb[i, home[1][own]] - ta.min(1) - tb.min(1)]
    return float(np.quantile(np.concatenate(excess), recall))


def needed(vectors: DataFrame, models: dict[int, dict], cosine: float) -> dict[int, np.ndarray]:
    """For each width (query, band of cosine, excess in steps of 1/256, how many) of the queries' links among all vectors.

    Equal vectors share their cell and do not count. Sums by query, band and step come to the driver, as many
    at most as the queries have bands and steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = unit(batch.column(0))
            widths = np.array([len(v) for v in out])
            for width, model in models.items():
                own = np.flatnonzero(widths == width)
                for lo in range(0, len(own), 2048):
                    x = np.stack([out[i] for i in own[lo : lo + 2048]])
                    q = model["queries"]
                    c = q @ x.T
                    i, j = np.nonzero(c >= cosine)
                    other = (q[i] != x[j]).any(1)
                    i, j = i[other], j[other]
                    da, db = cost(x, model)
                    qa, qb = model["costs"]
                    excess = qa[i, da.argmin(1)[j]] + qb[i, db.argmin(1)[j]] - qa.min(1)[i] - qb.min(1)[i]
                    band = np.minimum((c[i, j] - cosine) / max(1 - cosine, 1e-9) * 4, 3).astype(int)
                    key, many = np.unique(np.stack([i, band, np.ceil(excess * 256).astype(int)]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(many), width)), *[pa.array(k.astype(np.int64)) for k in key], pa.array(many.astype(np.int64))], names=["width", "q", "band", "step", "n"])

    found = vectors.select("embedding").mapInArrow(run, "width long, q long, band long, step long, n long")
    rows = found.groupBy("width", "q", "band", "step").agg(F.sum("n").alias("n")).collect()  # bounded by the queries
    return {w: np.array([r[1:] for r in rows if r["width"] == w], np.int64).reshape(-1, 4) for w in models}


def fit(vectors: DataFrame, cosine: float, recall: float, sample: int, words: int) -> dict[int, dict]:
    """For each width codebooks from a bounded sample in the order of a hash, and reach and measured recall from queries against all vectors."""

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = unit(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist() for v in out], pa.list_(pa.float64()))], names=["v"])

    rows = vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").mapInArrow(normal, "v array<double>").toPandas()["v"]  # bounded by sample
    widths, models = np.array([len(v) for v in rows], np.int64), {}
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        if len(own) < FEW:
            continue
        x = np.stack([rows[i] for i in own])
        half = max(width // 2, 1)
        model = {"books": [fit_codebook(h, words) if h.shape[1] else np.zeros((1, 0)) for h in (x[:, :half], x[:, half:])], "half": half}
        model["queries"] = x[np.sort(np.unique(x, axis=0, return_index=True)[1])][: 2 * QUERIES]
        models[width] = model | {"costs": cost(model["queries"], model)}
    links = needed(vectors, models, cosine) if models else {}
    for width, model in models.items():
        q, band, step, n = links[width].T
        # the first half of the queries sets the reach, the second measures it
        half = -(-len(model["queries"]) // 2)
        reach = [0.0]
        for k in np.unique(band[q < half]):
            some = (band == k) & (q < half)
            each = np.bincount(q[some], weights=n[some], minlength=half)
            reach.append(quantile(step[some] / 256, n[some] / each[q[some]], recall))
        # a quarter more than these need
        model["reach"] = max(1.25 * max(reach), made_reach(model["queries"][:half], model, cosine, FLOOR), 0.02)
        rest = q >= half
        if rest.any():
            model["reach"] = max(model["reach"], quantile(step[rest] / 256, n[rest].astype(float), FLOOR))
            model["recall"] = float(n[rest & (step / 256 <= model["reach"] + 1e-9)].sum() / n[rest].sum())
        del model["queries"], model["costs"]
    return models


def links(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.999, sample: int = SAMPLE, words: int | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding; other columns are not read).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do those of
    unlike widths. Equal vectors are links like any. vec_id must be a key: of rows repeated altogether each counts as
    a vector of its own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    cuts = Cuts(spark, "imi")
    vectors = vectors.select("vec_id", "embedding")
    n = vectors.count()
    words = words or codewords(n, sample=sample)
    models = fit(vectors, cosine, recall, sample, words)
    parts = max(1, min(words, -(-n // (words * block))))  # groups of the cells of one first codeword

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, again = Hasher(seed=20, lower=False), Hasher(seed=21, lower=False)
        for batch in batches:
            rows, out = unit(batch.column(1))
            widths = np.array([len(v) for v in out], np.int64)
            for width in np.unique(widths).tolist():
                some = np.flatnonzero(widths == width)
                x, ids = np.stack([out[i] for i in some]) + 0.0, batch.column(0).to_numpy()[rows[some]]  # no negative zeros
                home, cell, visits = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32), [[(0, [0])]] * len(x)
                if width in models:
                    da, db = cost(x, models[width])
                    cell = db.argmin(1).astype(np.int32)
                    home = (da.argmin(1) * parts + cell % parts).astype(np.int32)
                    visits = []
                    for a, b in zip(da, db):
                        own: dict[int, list[int]] = {}
                        for i, j in traverse(a, b, models[width]["reach"]):
                            own.setdefault(i * parts + j % parts, []).append(j)
                        visits.append(list(own.items()))
                data, at = x.view(np.uint8).ravel(), np.arange(len(x) + 1) * width * 8
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(x), width, np.int32)), pa.array(home), pa.array(cell), pa.array([[{"home": g, "cells": js} for g, js in v] for v in visits], VISITS), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(hasher.spans(data, at[:-1], at[1:]).view(np.int64)), pa.array(again.spans(data, at[:-1], at[1:]).view(np.int64))], names=["id", "width", "home", "cell", "visits", "v", "d1", "d2"])

    known = cuts.cut(vectors.mapInArrow(assign, "id long, width int, home int, cell int, visits array<struct<home:int,cells:array<int>>>, v binary, d1 long, d2 long"))
    same = ["width", "d1", "d2"]
    classes = cuts.cut(known.groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    member = cuts.cut(known.select("id", *same).join(classes, same).select("id", "rep", "copies"))
    one = known.join(classes, same).where("id = rep").dropDuplicates(["id", *same]).select("id", "width", "home", "cell", "visits", "v", "copies")
    one = cuts.cut(one)
    cuts.drop(known, classes)
    group = ["width", "home"]
    seekers = one.select("id", "width", F.explode("visits").alias("e"), "v", "copies").select("id", "width", "e.home", "e.cells", "v", "copies")
    sizes = one.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(seekers.groupBy(*group).agg(F.count(F.lit(1)).alias("m")), group)
    sizes = cuts.cut(sizes.select(*group, F.ceil(F.col("n") / block).cast("int").alias("rows"), F.ceil(F.col("m") / block).cast("int").alias("cols")))
    own = one.join(sizes, group).select(*group, F.pmod(F.xxhash64("id"), "rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), "id", "v", "copies", F.array("cell").alias("cells"), F.lit(True).alias("own"))
    seek = seekers.join(sizes, group).select(*group, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(F.xxhash64("id", F.lit(7)), "cols").cast("int").alias("j"), "id", "v", "copies", "cells", F.lit(False).alias("own"))

    def compare(table: pa.Table) -> pa.Table:
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        here = table.column("own").to_numpy(zero_copy_only=False)
        x = np.stack([np.frombuffer(v, np.float64) for v in table.column("v").to_pylist()])
        a, b = np.flatnonzero(~here), np.flatnonzero(here)
        if not len(a) or not len(b):
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        cells = table.column("cells").combine_chunks()
        at, many = cells.flatten().to_numpy(), cells.value_lengths().to_numpy()
        seeks = np.repeat(np.arange(len(ids)), many)
        place = np.full(len(ids), -1)
        place[a] = np.arange(len(a))
        hit = np.zeros((len(a), len(b)), bool)
        for cell in np.unique(at[np.repeat(here, many)]).tolist():  # cells of this block's own vectors
            told = seeks[at == cell]
            i, j = place[told[~here[told]]], np.flatnonzero(np.isin(b, told[here[told]]))
            hit[np.ix_(i, j)] = x[a[i]] @ x[b[j]].T >= cosine
        hit &= ids[a][:, None] != ids[b]
        n = hit @ copies[b]
        # smallest ids spread over the links until none changes: a forest of this block
        big = np.iinfo(np.int64).max
        la, lb = ids[a].copy(), ids[b].copy()
        while True:
            ma = np.minimum(la, np.where(hit, lb, big).min(1))
            mb = np.minimum(lb, np.where(hit, ma[:, None], big).min(0))
            if (ma == la).all() and (mb == lb).all():
                break
            la, lb = ma, mb
        one = np.flatnonzero((n > 0) | (la != ids[a]))
        two = np.flatnonzero(lb != ids[b])
        return pa.table({"id": np.concatenate([ids[a][one], ids[b][two]]), "n": np.concatenate([n[one], np.zeros(len(two), np.int64)]).astype(np.int64), "to": np.concatenate([la[one], lb[two]])})

    found = cuts.cut(own.unionByName(seek).groupBy(*group, "i", "j").applyInArrow(compare, "id long, n long, to long"))
    cuts.drop(one)
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), cuts)
    told = member.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    # copies of one vector link with each other
    told = told.select(F.col("id").alias("vec_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component")).dropDuplicates(["vec_id"])
    out = cuts.cut(vectors.select("vec_id").join(told, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    cuts.drop_but(out)
    return out.withColumn("kept", F.col("component_id") == F.col("vec_id"))
