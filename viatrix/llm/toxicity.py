"""Toxicity by weak supervision (operator 4).

Features of a text are its words (runs of bytes other than ASCII white space and punctuation, A-Z in lower
case) and the words' beginnings of 4, 5 and 6 bytes, each once, twice, four and eight times or oftener. On a bounded sample
of labelled rows, features that stand out in toxic ones become voters: lexicon voters (words)
and pattern voters (beginnings, and what comes again and again). A generative model estimates their accuracies and correlations. The given labels are
its first guess only: the posterior labels come from the votes, and they train a linear classifier, which scores every
whole text. How strongly the classifier is held back is chosen by cross-validation among the rows that may be learned
from, voters and all being found anew without each fold.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from viatrix.llm.label_model import fit_linear, fit_votes
from viatrix.llm.store import Cuts, one_each
from viatrix.llm.words import Hasher, mix, shingle_hashes, slices, split, strings

#: at most so many labelled rows are learned from
SAMPLE = 20_000
VOTERS, FEATURES = 256, 4096
#: how right the given labels are thought to be in the first guess
TRUST, STRENGTH = 0.95, 0.002
#: folds, and penalties tried: of the classifier's squared weights against the sum of losses, of equal strength at every number of rows
FOLDS, PENALTIES = 3, (0.03, 0.1, 0.3, 1.0, 3.0)
#: a feature's lowest bits are its level: it stands there 2**level times or oftener
LEVEL = np.uint64(3)
APART = np.zeros(256, bool)
APART[:128] = ~np.array([chr(i).isalnum() for i in range(128)])


def features(column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and beginnings, the text of each, and the words alone with where each text's begin."""
    data, offsets = strings(column)
    starts, ends, first = split(data, offsets, APART)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    words = hasher.spans(data, starts, ends)
    found, of = [words], [doc]
    for k in (4, 5, 6):
        longer = ends - starts > k
        s = starts[longer]
        found.append(mix(hasher.spans(data, s, s + k) + np.uint64(k)))
        of.append(doc[longer])
    return np.concatenate(found) & ~LEVEL, np.concatenate(of), words, first


def levelled(found: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text with their levels, and the text of each, in order of texts."""
    order = np.lexsort((found, of))
    h, d = found[order], of[order]
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    many = np.diff(np.append(begin, len(h)))
    parts = [(h[begin[many >= 1 << k]] | np.uint64(k), d[begin[many >= 1 << k]]) for k in range(int(LEVEL) + 1)]
    h, d = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((h, d))
    return h[order], d[order]


def learned_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of the labelled rows that may be learned from."""
    may = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    known = labels.where("doc_id is not null and toxic is not null").where(may).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return one_each(docs, chosen)  # bounded by sample


def chosen(toxic: np.ndarray, n: np.ndarray, rows: int, of_toxic: int) -> np.ndarray:
    """Standing of features by how far toxic rows have them oftener, 0 for those that don't stand out."""
    t, c = of_toxic, rows - of_toxic
    if not t or not c:
        return np.zeros(len(n))
    rate, other, both = (toxic + 0.5) / (t + 1.0), (n - toxic + 0.5) / (c + 1.0), (n + 1.0) / (rows + 2.0)
    z = (rate - other) / np.sqrt(both * (1 - both) * (1.0 / t + 1.0 / c))
    return np.where((toxic >= 3) & (z > 4) & (rate > 4 * other), z, 0.0)


class Votes:
    """Learned rows with the features that they have, and each feature's counts by fold."""

    def __init__(self, hits: list, told: np.ndarray, fold: np.ndarray, width: int):
        self.row = np.repeat(np.arange(len(hits)), [len(x) for x in hits])
        self.column = np.array([x for s in hits for x in s], np.int64)
        self.told, self.fold, self.width = told, fold, width

    def fit(self, rows: np.ndarray, z: np.ndarray, right: np.ndarray, penalties: tuple) -> Iterator[tuple[np.ndarray, float]]:
        """Weights of all features and bias, learned from rows, for each penalty in turn.

        z is the features' standing; those that are right more often than wrong may be voters.
        """
        order = np.lexsort((np.arange(self.width), -z))
        some = order[: int((z[order[:FEATURES]] > 0).sum())]
        voters = some[right[some] > 0.5][:VOTERS]
        place, number = np.full(self.width, -1), np.full(len(self.told), -1)
        place[some] = np.arange(len(some))
        number[rows] = np.arange(len(rows))
        own = (place[self.column] >= 0) & (number[self.row] >= 0)
        row, column = number[self.row[own]], place[self.column[own]]
        matrix = np.zeros((len(rows), len(some)), bool)
        matrix[row, column] = True
        silent = ~matrix.any(axis=1)
        votes = np.concatenate([matrix[:, place[voters]].astype(np.int8), np.where(silent, -1, 0)[:, None].astype(np.int8)], axis=1)  # the last is the voter for clean texts
        posterior, _, _ = fit_votes(votes, np.where(self.told[rows] > 0, TRUST, 1 - TRUST), strength=STRENGTH)
        for penalty in penalties:
            w, bias = fit_linear(row, column, len(some), posterior, decay=penalty / len(rows))
            weights = np.zeros(self.width)
            weights[some] = w
            yield weights, bias

    def loss(self, rows: np.ndarray, weights: np.ndarray, bias: float) -> float:
        """Mean logarithmic loss against the given labels."""
        z = bias + np.bincount(self.row, weights=weights[self.column], minlength=len(self.told))[rows]
        return float(np.mean(np.logaddexp(0, np.where(self.told[rows] > 0, -z, z)))) if len(rows) else 0.0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Feature hashes in order, their weights, the bias, and the penalty chosen."""
    cuts = Cuts(docs.sparkSession, "toxic")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed=4)
        for batch in slices(batches, 1):
            found, of, words, first = features(batch.column(1), hasher)
            runs, at = shingle_hashes(words, first, 5)
            found, of = levelled(found, of)
            bounds = np.searchsorted(of, np.arange(len(batch) + 1))
            own = [found[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            least = [int(runs[a:b].min() >> np.uint64(1)) if b > a else 0 for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(least, pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "toxic", "least", "own"])

    rows = cuts.cut(learned_rows(docs, labels, sample).mapInArrow(read, "doc_id long, toxic int, least long, own binary"))
    # copies and most near copies have the same smallest shingle: one of each is learned from
    single = rows.groupBy("least").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    used = rows.join(F.broadcast(single), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(FOLDS)).cast("int"))  # bounded by sample
    size = {r["fold"]: (r["n"], r["t"]) for r in used.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).collect()}  # a row a fold
    n, t = (sum(x[i] for x in size.values()) for i in (0, 1))
    none = {"hashes": np.zeros(0, np.uint64), "weights": np.zeros(0), "penalty": None}
    if not t or t == n:
        cuts.drop(rows)
        return none | {"bias": -4.0 if not t else 4.0}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            if not own:
                continue
            many = [len(x) for x in own]
            h, at = np.unique(np.concatenate(own), return_inverse=True)
            y, fold = np.repeat(batch.column(0).to_numpy(), many), np.repeat(batch.column(1).to_numpy(), many)
            cell, back = np.unique(at * FOLDS + fold, return_inverse=True)
            toxic = np.bincount(back, weights=y, minlength=len(cell)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[cell // FOLDS].view(np.int64)), pa.array((cell % FOLDS).astype(np.int32)), pa.array(toxic), pa.array(np.bincount(back, minlength=len(cell)).astype(np.int64))], names=["h", "fold", "toxic", "n"])

    counts = used.select("toxic", "fold", "own").mapInArrow(count, "h long, fold int, toxic long, n long").groupBy("h").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("toxic", "n")],
    )
    # those that may stand out in all rows or without a fold; the rarer among clean rows come first
    counts = counts.where((F.col("toxic") >= 3) & (F.col("toxic") * (n - t) > 2 * t * (F.col("n") - F.col("toxic")))).orderBy(F.desc(F.col("toxic") - F.col("n") * (t / n)), "h").limit(2 * FEATURES)
    best = counts.collect()  # bounded by FEATURES
    if not best:
        cuts.drop(rows)
        return none | {"bias": float(np.log(t / (n - t)))}
    best.sort(key=lambda r: r["h"] % 2**64)
    hashes = np.array([r["h"] for r in best], np.int64).view(np.uint64)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                own = np.frombuffer(x, np.uint64)
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                out.append(at[hashes[at] == own].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), *batch.columns[1:]], names=["hit", "toxic", "fold", "doc_id"])

    learned = used.select("own", "toxic", "fold", "doc_id").mapInArrow(hits, "hit array<int>, toxic int, fold int, doc_id long").collect()  # bounded by sample and FEATURES
    cuts.drop(rows)
    learned.sort(key=lambda r: (r["doc_id"], r["hit"]))
    fold = np.array([r["fold"] for r in learned])
    told = Votes([r["hit"] for r in learned], np.array([r["toxic"] for r in learned]), fold, len(hashes))
    toxic, all_ = np.array([r["toxic"] for r in best]), np.array([r["n"] for r in best])
    losses = np.zeros(len(PENALTIES))
    for f in range(FOLDS):
        own = size.get(f, (0, 0))
        rest, left = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        some, many = toxic - np.array([r[f"toxic{f}"] for r in best]), all_ - np.array([r[f"n{f}"] for r in best])
        if len(rest):
            models = told.fit(rest, chosen(some, many, n - own[0], t - own[1]), (some + 0.5) / (many + 1), PENALTIES)
            losses += [len(left) * told.loss(left, *model) for model in models]
    penalty = PENALTIES[int(losses.argmin())]
    weights, bias = next(told.fit(np.arange(len(learned)), chosen(toxic, all_, n, t), (toxic + 0.5) / (all_ + 1), (penalty,)))
    keep = weights != 0
    return {"hashes": hashes[keep], "weights": weights[keep], "bias": bias, "penalty": penalty, "losses": losses / max(n, 1)}


def scorer(model: dict):
    """Scores of a string column; an empty or null text gets the model's bias alone."""
    hashes, weights, bias = model["hashes"], model["weights"], model["bias"]

    low, bases = np.uint64(2**20 - 1), np.unique(hashes & ~LEVEL)
    maybe = np.zeros(2**20, bool)
    maybe[(bases >> np.uint64(2)) & low] = True

    def known(found: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(among, found), len(among) - 1)
        return at, among[at] == found

    def scores(column: pa.Array, hasher: Hasher) -> np.ndarray:
        z = np.full(len(column), bias)
        if len(hashes):
            found, of, _, _ = features(column, hasher)
            some = maybe[(found >> np.uint64(2)) & low]
            found, of = found[some], of[some]
            _, true = known(found, bases)
            found, of = levelled(found[true], of[true])
            at, true = known(found, hashes)
            z += np.bincount(of[true], weights=weights[at[true]], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return scores


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row."""
    scores = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed=4)
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), hasher))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs, all columns, without the rows that score 0.5 or more; no row moves between partitions."""
    scores, at = scorer(learn(docs, labels, sample)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed=4)
        for batch in slices(batches, at):
            yield batch.filter(pa.array(scores(batch.column(at), hasher) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text; other columns are not read).

    Labels (doc_id, toxic) that are null are left out and the largest of several for one document
    counts. Without labels of both kinds every text gets one score. Repeated rows are scored each.
    """
    scored = score(docs, learn(docs, labels, sample))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
