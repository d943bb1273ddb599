"""Many copies of one row in what models learn from, and repeated words in leaks."""

import random

import numpy as np
import pytest

from test_llm import sentence
from viatrix.llm import decontaminate, langid, quality, toxicity


@pytest.fixture
def collected(spark, monkeypatch):
    """How many rows each collect brought to the driver."""
    kind, sizes = type(spark.range(1)), []
    own = kind.collect

    def counted(self):
        rows = own(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(kind, "collect", counted)
    return sizes


def test_copies_are_folded(spark, collected):
    """5,000 copies of a row, and 50 texts of one id: no more rows than the sample are collected."""
    r = random.Random(8)
    docs = [(1, "the same words over and over, once more.", "en")] * 5_000 + [(2, sentence(r, 40), "de") for _ in range(50)] + [(i, sentence(r, 30) + (" awful swine" if i % 3 == 0 else ""), ["en", "de"][i % 2]) for i in range(3, 90)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(7).cache()
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 90)], "doc_id long, toxic int")
    quality.learn(df, 40)
    assert collected and max(collected) <= 40
    collected.clear()
    langid.learn(df, 40, 4)
    assert collected and max(collected) <= 160
    collected.clear()
    toxicity.learn(df, labels, 40)
    assert collected and max(collected) <= max(40, 2 * toxicity.FEATURES)
    assert toxicity.learned_rows(df, labels, 40).count() <= 40
    assert quality.quality(df, 40).count() == len(docs)


def leaked(spark, items, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    return {(x.doc_id, x.item_id): x.similarity for x in decontaminate.leaks(docs, bench).collect()}


def test_a_repeated_word_tilts_nothing(spark):
    """50 words and seven times one word; in the texts seven other words follow the 50: 46 of 60 shingles are common."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    items, texts = [], []
    for _ in range(120):
        fifty = [word() for _ in range(50)]
        items.append(" ".join(fifty + [word()] * 7))
        texts.append(" ".join([word() for _ in range(30)] + fifty + [word() for _ in range(7)] + [word() for _ in range(30)]))
    found = leaked(spark, items, texts)
    assert sorted(found) == [(i, i) for i in range(120)] and all(abs(x - 46 / 60) < 1e-9 for x in found.values())


def test_windows_at_the_threshold(spark):
    """Windows of similarity 0.75 to 0.8 with words drawn from few: hardly any is lost."""
    r, items, texts, want = random.Random(13), [], [], set()
    while len(items) < 300:
        few = [f"{r.randrange(10**6)}w" for _ in range(r.choice([2, 4, 12, 60]))]
        own = [r.choice(few) for _ in range(r.choice([30, 60, 90]))]
        other = list(own)
        for _ in range(len(own)):
            at = r.randrange(len(own))
            other[at : at + 1] = [r.choice([*few, "z"])]
            a, b = ([" ".join(x[i : i + 5]) for i in range(len(x) - 4)] for x in (own, other))
            common = sum(min(a.count(s), b.count(s)) for s in set(a))
            near = common / (2 * len(a) - common)
            if near < 0.8:
                break
        if near >= 0.75:
            want.add((len(items), len(items)))
            items.append(" ".join(own))
            texts.append("p q r s t u v " + " ".join(other) + " l m n o p q")
    assert want and len(want - set(leaked(spark, items, texts))) <= 0.01 * len(want)


def test_prints_are_those_of_each_window(spark):
    """Running sums against fingerprints that are made window by window."""
    r = random.Random(14)
    texts = [" ".join(r.choice("abcde") for _ in range(60)), " ".join(["x"] * 40 + ["y"] * 5), " ".join(f"w{i}" for i in range(30))]
    docs = spark.createDataFrame([(i, 7, t) for i, t in enumerate(texts)], "doc_id long, v long, text string")
    spans = [(0, 7, 12, 12, 3, 40), (0, 7, 5, 5, 0, 55), (1, 7, 20, 20, 0, 25), (2, 7, 30, 30, 0, 0), (2, 7, 9, 9, 4, 9)]
    from viatrix.llm.store import Cuts

    stretches = spark.createDataFrame(spans, "doc_id long, v long, size int, many int, lo int, hi int")
    got = {(x.doc_id, x.size, x.start): x.fingerprint for x in decontaminate.window_prints(docs, stretches, 30, Cuts(spark, "test")).collect()}
    cut = [(i, size, at, texts[i].split()[at : at + many]) for i, _, size, many, lo, hi in spans for at in range(lo, hi + 1)]
    each = spark.createDataFrame(cut, "doc_id long, size int, start int, words array<string>")
    want = {(x.doc_id, x.size, x.start): x.fingerprint for x in decontaminate.simhashes(each, ["doc_id", "size", "start"]).collect()}
    assert got == want and len(np.unique(list(got.values()))) > 50
