"""Language identification by a bidirectional gated recurrent network over bytes (operator 3).

The network reads a text in windows of WINDOW bytes, in both directions, its state running on over spaces and
words; it gives every byte a distribution over languages, and a document's probabilities are the mean over all
its positions. Training is backpropagation through time in numpy, on a bounded sample. Arrays hold one
row a feature and one column a window, so that every step is a few operations on whole rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from viatrix.llm.store import one_each
from viatrix.llm.words import mix, slices, strings

#: documents learned from, and windows of each
SAMPLE, EACH = 6_000, 4
WINDOW, HIDDEN = 128, 12
#: the code behind a window's end, which leaves the state as it is
PAD = 256


def windows(offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all windows of all texts, and the text of each."""
    many = -(-np.diff(offsets) // size)
    of = np.repeat(np.arange(len(many)), many)
    starts = offsets[of] + size * (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
    return starts, np.minimum(size, offsets[of + 1] - starts), of


def codes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: int) -> np.ndarray:
    """Bytes [time, window], with PAD behind a window's end."""
    t = np.arange(steps)[:, None]
    return np.where(t < lengths, data[np.minimum(starts + t, len(data) - 1)].astype(np.intp), PAD)


class Network:
    """One gated recurrent layer each way and a softmax on both states."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 3):
        r = np.random.default_rng(seed)
        self.h, self.c = hidden, classes
        self.w = {}
        for d in "fb":
            x = r.normal(0, 0.3, (3 * hidden, PAD + 1))  # input bias included: one column a byte
            x[:hidden, PAD] = -1e4  # the gate stays shut
            self.w[f"x{d}"] = x
            self.w[f"u{d}"] = r.normal(0, hidden**-0.5, (3 * hidden, hidden))
            self.w[f"o{d}"] = r.normal(0, hidden**-0.5, (classes, hidden))
        self.w["b"] = np.zeros((classes, 1))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def positions(self, seq: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Probabilities [time, class, window] at every byte of seq [time, window]; kept gets what a gradient needs."""
        h, kind = self.h, self.w["uf"].dtype
        steps, n = seq.shape
        z = np.zeros((steps, self.c, n), kind)
        z += self.w["b"]
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            x, u, o = self.w[f"x{d}"], self.w[f"u{d}"], self.w[f"o{d}"]
            state = np.zeros((h, n), kind)
            a, b = np.empty((3 * h, n), kind), np.empty((3 * h, n), kind)
            for t in order:
                np.take(x, seq[t], axis=1, out=a, mode="clip")
                np.matmul(u, state, out=b)
                gates, c = a[: 2 * h], b[2 * h :]
                gates += b[: 2 * h]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                if kept is not None:
                    kept.setdefault(d, {})[t] = [state.copy(), gates.copy(), c.copy()]
                c *= gates[h:]
                c += a[2 * h :]
                np.tanh(c, out=c)
                if kept is not None:
                    kept[d][t].append(c.copy())
                c -= state
                c *= gates[:h]
                state += c
                if kept is not None:
                    kept[d][t].append(state.copy())
                z[t] += o @ state
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def gradient(self, seq: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over positions against target [class, window], and its gradient by backpropagation through time."""
        kept: dict = {}
        p = self.positions(seq, kept)
        own = (seq != PAD)[:, None, :]
        total = max(int(own.sum()), 1)
        loss = -float((own * target * np.log(p + 1e-9)).sum()) / total
        e = ((p - target) * own / total).astype(p.dtype)
        g = {"b": e.sum((0, 2))[:, None]}
        h = self.h
        for d, order in (("f", range(len(seq) - 1, -1, -1)), ("b", range(len(seq)))):
            u, o = self.w[f"u{d}"], self.w[f"o{d}"]
            gx, gu, go = (np.zeros_like(self.w[f"{k}{d}"]) for k in "xuo")
            flow = np.zeros((h, seq.shape[1]), p.dtype)
            into = np.empty((len(seq), 3 * h, seq.shape[1]), p.dtype)
            for t in order:
                old, gates, uc, c, state = kept[d][t]
                z, r = gates[:h], gates[h:]
                go += e[t] @ state.T
                dh = flow + o.T @ e[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - old) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                into[t] = np.concatenate([dz, dr, dc])
                db = np.concatenate([dz, dr, dc * r])
                gu += db @ old.T
                flow = dh * (1 - z) + u.T @ db
            at = seq.ravel()
            for k in range(3 * h):
                gx[k] = np.bincount(at, weights=into[:, k].ravel(), minlength=PAD + 1)
            g |= {f"x{d}": gx, f"u{d}": gu, f"o{d}": go}
        return loss, g

    def fit(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, target: np.ndarray, batch: int = 192, steps: int = 260, rate: float = 0.02) -> list[float]:
        """Adam over batches of windows in random order, with two passes over few windows' worth of steps at least; target is a class each."""
        r = np.random.default_rng(5)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        each = -(-len(starts) // batch)
        epochs = max(2, min(20, steps // each))
        t, losses = 0, []
        for _ in range(epochs):
            order = r.permutation(len(starts))
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                loss, g = self.gradient(codes(data, starts[at], lengths[at], int(lengths[at].max())), np.eye(self.c, dtype=np.float32)[target[at]].T)
                t += 1
                for k in self.w:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] ** 2 - v[k])
                    self.w[k] -= (rate * (1 - t / (epochs * each + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(self.w[k].dtype)
                losses.append(loss)
        return losses

    def sums(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = 2048) -> np.ndarray:
        """Probabilities [window, class] summed over each window's positions."""
        out = np.zeros((len(starts), self.c))
        steps = np.maximum(1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64), 16)
        for size in np.unique(steps).tolist():
            own = np.flatnonzero(steps == size)
            for lo in range(0, len(own), most):
                at = own[lo : lo + most]
                seq = codes(data, starts[at], lengths[at], size)
                p = self.positions(seq)
                p *= (seq != PAD)[:, None, :]
                out[at] = p.sum(0).T
        return out


def learn(docs: DataFrame, sample: int = SAMPLE, each: int = EACH) -> tuple[list[str], Network | None]:
    """Languages in order, and the network, from rows with text and lang whose crc32(doc_id) mod 4 is not 2."""
    may = docs.where("text is not null and lang is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2).select("doc_id", "lang")
    counts = {r["lang"]: r["n"] for r in may.groupBy("lang").agg(F.count_distinct("doc_id").alias("n")).collect()}  # one row a language
    langs = sorted(counts)
    if not langs:
        return [], None
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2**30))
    share = F.lit(0.0)
    for lang, n in counts.items():  # as many of each language
        share = F.when(F.col("lang") == lang, F.lit(1.2 * sample / len(langs) / n)).otherwise(share)
    chosen = may.where(part < share * 2**30).groupBy("doc_id").agg(F.min("lang").alias("lang")).orderBy(part, "doc_id").limit(sample)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, offsets = strings(batch.column(1))
            starts, lengths, of = windows(offsets)
            # each text's windows in the order of a hash, the first few of which are learned from
            number = np.arange(len(of)) - np.searchsorted(of, of)
            order = np.lexsort((mix(number.astype(np.uint64) + np.uint64(3)), of))
            at = order[np.arange(len(of)) - np.searchsorted(of, of) < each]
            yield pa.RecordBatch.from_arrays([pa.array([data[a : a + n].tobytes() for a, n in zip(starts[at], lengths[at])], pa.binary()), pa.array([langs.index(x) for x in batch.column(2).take(pa.array(of[at])).to_pylist()], pa.int32()), batch.column(0).take(pa.array(of[at])), pa.array(number[at])], names=["bytes", "lang", "doc_id", "number"])

    rows = one_each(docs, chosen, "lang").mapInArrow(read, "bytes binary, lang int, doc_id long, number long").collect()  # bounded by sample and each
    if not rows:
        return langs, None
    rows.sort(key=lambda r: (r["doc_id"], r["number"], r["bytes"]))
    data = np.frombuffer(b"".join(bytes(r["bytes"]) for r in rows), np.uint8)
    lengths = np.array([len(r["bytes"]) for r in rows], np.int64)
    net = Network(len(langs))
    net.fit(data, np.cumsum(lengths) - lengths, lengths, np.array([r["lang"] for r in rows]))
    return langs, net


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang; other columns are not read).

    A text that is null or has no letter is und with score 0. Without any labelled text all are und.
    Repeated rows are predicted each; a tie goes to the first language in order. An empty table gives an empty result.
    """
    langs, net = learn(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, offsets = strings(batch.column(1))
            starts, lengths, of = windows(offsets)
            sums = net.sums(data, starts, lengths)
            p = np.stack([np.bincount(of, weights=sums[:, c], minlength=len(batch)) for c in range(len(langs))], axis=1)
            p = p / np.maximum(np.diff(offsets), 1)[:, None]
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([langs[i] for i in best], pa.string()), pa.array(p.max(1))], names=["doc_id", "letters", "lang_pred", "score"])

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    told = docs.select("doc_id", "text", letters.alias("letters"))
    if net is None:
        return told.select("doc_id", held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    found = told.mapInArrow(run, "doc_id long, letters boolean, lang_pred string, score double")
    return found.select("doc_id", held.alias("held_out"), F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.least("score", F.lit(1.0))).otherwise(0.0).alias("score"))
