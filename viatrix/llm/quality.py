"""Quality classifier from weak labels (operator 1).

Overlapping heuristic labellers look at shares and counts that describe a text: each votes bad, or each good, or nothing.
Expectation-maximisation estimates the labellers' accuracies on a bounded sample, without any given
label; the posterior labels train a linear scorer on hashed features (word shapes with how often they
occur, and graded shares), which scores every whole text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from viatrix.llm.label_model import fit_linear, fit_votes
from viatrix.llm.store import one_each
from viatrix.llm.words import Hasher, mix, slices, split, strings

#: rows that the label model and the scorer are fitted on; width of the hashed features
SAMPLE, WIDTH = 20_000, 1 << 14
UPPER, LOWER_, DIGIT, SYMBOL, SHOUT, BAR, STOP = (np.zeros(256, bool) for _ in range(7))
UPPER[65:91] = LOWER_[97:123] = DIGIT[48:58] = True
LOWER_[128:] = True
SYMBOL[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = True
SHOUT[ord("!")] = BAR[ord("|")] = True
STOP[[*b".!?"]] = True
#: against a text: name, share or count it looks at, sign of the order, and the bound beyond which it votes
AGAINST = [
    ("capitals", "upper", 1, 0.4), ("symbols", "symbol", 1, 0.06), ("shouting", "shout", 1, 0.02), ("tables", "bar", 1, 0.01),
    ("stutter", "stutter", 1, 0.04), ("variety", "distinct", -1, 0.12), ("long words", "length", 1, 14.0), ("digits", "digit", 1, 0.4),
    ("sentences", "stop", -1, 0.005), ("letters", "letter", -1, 0.5), ("brevity", "words", -1, 1.0),
]
#: for a text: name, and what must all lie within bounds
FOR = [
    ("prose", [("stop", -1, 0.03), ("letter", -1, 0.75), ("length", 1, 9.0)]),
    ("plain", [("upper", 1, 0.2), ("symbol", 1, 0.01), ("shout", 1, 0.005), ("bar", 1, 0.001)]),
    ("varied", [("distinct", -1, 0.3), ("stutter", 1, 0.02), ("words", -1, 8.0)]),
    ("wordy", [("digit", 1, 0.05), ("symbol", 1, 0.01), ("words", -1, 8.0)]),
]
NAMES = ["upper", "symbol", "shout", "bar", "stutter", "distinct", "length", "digit", "stop", "letter", "words"]


def within(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of flags[start:end] are set; spans ascend and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.int64)
    found = np.add.reduceat(flags, np.stack([starts, ends], axis=1).ravel(), dtype=np.int64)[::2]
    return np.where(ends > starts, found, 0)


def described(column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares [text, name], and hashed features as pairs (text, feature), each once."""
    data, offsets = strings(column)
    starts, ends, first = split(data, offsets)
    n = len(offsets) - 1
    counts = np.diff(first)
    doc = np.repeat(np.arange(n), counts)
    size = np.maximum(np.diff(offsets), 1)

    kinds = {"upper": UPPER, "lower": LOWER_, "digit": DIGIT, "symbol": SYMBOL, "shout": SHOUT, "bar": BAR, "stop": STOP}
    per, inside = {}, {}
    for k, flags in kinds.items():
        own = np.append(flags[data], False)
        per[k], inside[k] = within(own, offsets[:-1], offsets[1:]), within(own, starts, ends)
    letters = per["upper"] + per["lower"]
    words = hasher.spans(data, starts, ends)
    many = np.maximum(counts, 1)
    same = np.concatenate([[False], (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]) if len(words) else np.zeros(0, bool)
    order = np.lexsort((words, doc))
    w, d = words[order], doc[order]
    fresh = np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])]) if len(w) else np.zeros(0, bool)
    distinct = np.bincount(d[fresh], minlength=n)
    shares = np.stack([
        per["upper"] / np.maximum(letters, 1), per["symbol"] / size, per["shout"] / size, per["bar"] / size,
        np.bincount(doc[same], minlength=n) / many,
        np.where(counts >= 20, np.minimum(distinct / np.sqrt(many * np.minimum(many, 400)), 1.0), 1.0),  # longer texts repeat more words
        np.bincount(doc, weights=ends - starts, minlength=n) / many,
        per["digit"] / size, per["stop"] / size * 6, (letters + per["digit"]) / np.maximum(np.bincount(doc, weights=ends - starts, minlength=n), 1), counts,
    ], axis=1)
    shape = (inside["upper"] > 0) + 2 * (inside["lower"] > 0) + 4 * (inside["upper"] > 1) + 8 * (inside["digit"] > 0) + 16 * (inside["symbol"] > 0) + 32 * (inside["shout"] > 0) + 64 * (inside["bar"] > 0) + 128 * same + 256 * np.minimum((ends - starts) // 6, 3)
    cell, often = np.unique(doc * 1024 + shape, return_counts=True)
    of = cell // 1024
    graded = np.floor(-np.log2(often / many[of])).astype(np.int64).clip(0, 12)
    feature = [(cell % 1024) * 16 + graded]
    row = [of]
    for j in range(shares.shape[1]):
        feature.append(2**20 + 64 * j + np.floor(np.log2(np.maximum(shares[:, j], 2.0**-14)) * 2 + 28).astype(np.int64).clip(0, 63))
        row.append(np.arange(n))
    hashed = (mix(np.concatenate(feature).astype(np.uint64) + np.uint64(11)) & np.uint64(WIDTH - 1)).astype(np.int64)
    pairs = np.unique(np.concatenate(row) * WIDTH + hashed)
    return shares, pairs // WIDTH, pairs % WIDTH


def votes_of(shares: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 nothing, by text and labeller: those against before those for."""

    def beyond(name: str, sign: int, bound: float) -> np.ndarray:
        return sign * shares[:, NAMES.index(name)] > sign * bound

    against = [-beyond(*rule).astype(np.float32) for _, *rule in AGAINST]
    return np.stack([*against, *[~np.logical_or.reduce([beyond(*rule) for rule in rules]) for _, rules in FOR]], axis=1).astype(np.float32)


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, dict[str, float]]:
    """Weights, bias, and the labellers' accuracies."""
    chosen = docs.where("text is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed=10)
        for batch in slices(batches, 1):
            shares, row, feature = described(batch.column(1), hasher)
            at = np.searchsorted(row, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype(np.int8).tobytes() for v in votes_of(shares)], pa.binary()), pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["doc_id", "votes", "own"])

    rows = one_each(docs, chosen).mapInArrow(read, "doc_id long, votes binary, own binary").collect()  # bounded by sample
    if not rows:
        return np.zeros(WIDTH), 0.0, {}
    rows.sort(key=lambda r: r["doc_id"])
    votes = np.stack([np.frombuffer(bytes(r["votes"]), np.int8) for r in rows]).astype(np.float32)
    # a first guess by a show of hands; from then on the votes' own accuracies decide
    p, accuracy, _ = fit_votes(votes, np.where((votes == -1).any(1), 0.1, 0.9))
    own = [np.frombuffer(bytes(r["own"]), np.int32) for r in rows]
    w, b = fit_linear(np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own).astype(np.int64), WIDTH, p)
    return w, b, {name: float(a) for (name, *_), a in zip([*AGAINST, *FOR], accuracy)}


def quality(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, keep) of every row of docs (doc_id, text; other columns are not read).

    score is 0 to 1, higher for better; keep is score >= 0.5. Null and empty texts are described by no
    words and scored alike; repeated rows are scored each. Without any text the score is 0.5.
    """
    weights, bias, _ = learn(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed=10)
        for batch in slices(batches, 1):
            _, row, feature = described(batch.column(1), hasher)
            z = bias + np.bincount(row, weights=weights[feature], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double").withColumn("keep", F.col("score") >= 0.5)
