"""Operators against plain, slow versions written from their descriptions."""

import math
import random

import numpy as np
import pyarrow as pa

from test_llm import frame, sentence
from viatrix.llm import chunk_dedup, langid, toxicity


def plain_spans(texts, least=100):
    """Gear hash by the byte, chunks as strings, first places in a dictionary, neighbouring repeats joined."""
    gear = [int(x) for x in np.random.default_rng(50).integers(0, 2**32, 256, dtype=np.uint32)]
    cut = {}
    for d, text in enumerate(texts):
        data, start = (text or "").encode(), 0
        for i in range(1, len(data) + 1):
            h = sum(gear[data[i - 1 - k]] << k for k in range(min(16, i))) % 2**32
            if i - start >= 16 and h >> 11 & 31 == 0 or i - start == 96 or i == len(data):
                cut.setdefault(d, []).append((start, i, data[start:i]))
                start = i
    first, out = {}, []
    for d, parts in cut.items():
        for a, _, chunk in parts:
            first.setdefault(chunk, (d, a))
    for d, parts in cut.items():
        run = None
        for a, b, chunk in [*parts, (-1, -1, None)]:
            if chunk is not None and first[chunk] != (d, a):
                run = (run[0], b, run[2], run[3] + 1) if run else (a, b, first[chunk][0], 1)
            elif run:
                out += [(d, *run)] if run[1] - run[0] >= least else []
                run = None
    return sorted(out)


def test_spans(spark):
    r = random.Random(31)
    shared = [sentence(r, n) for n in (12, 30, 60, 200)] + ["é" * 90, "ab" * 300]
    texts = [" ".join(r.choice([r.choice(shared), sentence(r, r.randint(1, 40))]) for _ in range(r.randint(0, 6))) for _ in range(70)] + [None, ""]
    got = sorted((x.doc_id, x.start, x.end, x.first_doc_id, x.n_chunks) for x in chunk_dedup.repeats(frame(spark, texts)).collect())
    want = plain_spans(texts)
    assert got == want and len(want) > 30


def plain_probabilities(net, data):
    """Every step of both directions by itself, with ordinary floats."""
    h, w = net.h, {k: v.astype(float) for k, v in net.w.items()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    states = {}
    for d, order in (("f", range(len(data))), ("b", range(len(data) - 1, -1, -1))):
        s = [0.0] * h
        for t in order:
            x, u = w[f"x{d}"][:, data[t]], w[f"u{d}"]
            b = [sum(u[i, j] * s[j] for j in range(h)) for i in range(3 * h)]
            z, r = [sig(x[i] + b[i]) for i in range(h)], [sig(x[h + i] + b[h + i]) for i in range(h)]
            c = [math.tanh(x[2 * h + i] + r[i] * b[2 * h + i]) for i in range(h)]
            s = [s[i] + z[i] * (c[i] - s[i]) for i in range(h)]
            states[d, t] = s
    out = []
    for t in range(len(data)):
        e = [math.exp(w["b"][c, 0] + sum(w["of"][c, i] * states["f", t][i] + w["ob"][c, i] * states["b", t][i] for i in range(h))) for c in range(net.c)]
        out.append([x / sum(e) for x in e])
    return out


def test_language_scores(spark):
    """A document's score is the mean over all its bytes, window by window."""
    r = random.Random(32)
    net = langid.Network(3, hidden=5, seed=9)
    texts = [sentence(r, n) for n in (1, 4, 60, 19, 20)] + ["é ü ß " * 50]
    learn, langid.learn = langid.learn, lambda *_: (["a", "b", "c"], net)
    try:
        got = {x.doc_id: (x.lang_pred, x.score) for x in langid.languages(frame(spark, texts)).collect()}
    finally:
        langid.learn = learn
    for i, text in enumerate(texts):
        data = text.encode()
        p = np.mean([q for lo in range(0, len(data), langid.WINDOW) for q in plain_probabilities(net, data[lo : lo + langid.WINDOW])], axis=0)
        assert got[i][0] == "abc"[int(p.argmax())] and abs(got[i][1] - p.max()) < 1e-4


def test_toxicity_scores(spark):
    """A score is the logistic of the bias and the weights of the features that a text has, each once."""
    r = random.Random(33)
    texts = [sentence(r, 30) for _ in range(20)] + ["grubbik " * n for n in range(1, 10)] + ["", None, "Grubbiks, grub! grubb"]
    hasher = toxicity.Hasher(seed=4)
    own = [set(toxicity.levelled(*toxicity.features(pa.array([t], pa.string()), hasher)[:2])[0].tolist()) for t in texts]
    hashes = sorted(set.union(*own))[::3]
    weights = np.array([math.sin(i) for i in range(len(hashes))])
    model = {"hashes": np.array(hashes, np.uint64), "weights": weights, "bias": -0.3}
    got = {x.doc_id: x.score for x in toxicity.score(frame(spark, texts), model).collect()}
    for i, found in enumerate(own):
        z = -0.3 + sum(w for h, w in zip(hashes, weights) if h in found)
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9
