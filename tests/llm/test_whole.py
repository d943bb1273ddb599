"""Cases in which operators once left part of the job out."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_llm import alike, frame, sentence
from viatrix.llm import chunk_dedup, decontaminate, embedding_dedup, html_extract, ngram_join


def linked_groups(seed):
    """Two groups of variants, whose originals are both near one shorter document, in random order."""
    r = random.Random(seed)

    def edited(words, times):
        w = list(words)
        for i in [r.randrange(len(w)) for _ in range(times)]:
            w[i] = f"new{r.randrange(10**9)}"
        return w

    n = r.choice((20, 40, 60, 100, 150, 250))
    base, e = sentence(r, n).split(), r.randint(0, 2)
    tail = max(1, int((n - 4) * (0.333, 0.2, 0.1)[e] * r.uniform(0.5, 1)))
    many, times, kind = r.randint(2, 30), r.randint(1, max(1, n // 25)), r.randrange(3)
    originals = [edited(base, e) + sentence(r, tail).split() for _ in range(2)]
    out = [base, *originals]
    for o in originals:
        for _ in range(many):
            v = o if kind == 0 else edited(o, times)
            out.append(v if kind == 1 else v + sentence(r, r.randint(1, max(1, len(o) // 4))).split())
    r.shuffle(out)
    return [" ".join(w) for w in out]


def test_ngram_join_links_hubs(spark):
    """A document near two hubs joins both groups."""
    texts, want = [], []
    for seed in range(240):
        group = linked_groups(seed)
        want += [len(texts) + i for i in alike(group)[1]]
        texts += group
    got = {r.doc_id: r.component_id for r in ngram_join.near_groups(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("block", [5, 1024])
def test_ngram_join_families(spark, block):
    """Variants of one text that are mostly too far apart, in blocks of few: every link counts, and no other."""
    texts = []
    for seed, n in ((1, 60), (2, 200)):
        r = random.Random(seed)
        base = sentence(r, n).split()
        for _ in range(70):
            w = list(base)
            for i in r.sample(range(n), r.randint(n // 40, n // 14)):
                w[i] = f"new{r.randrange(40)}"
            texts.append(" ".join(w))
        chain = list(base)
        for i in range(0, n, 2):  # each near the one before
            chain[i] = f"step{i}"
            texts.append(" ".join(chain))
    got = {r.doc_id: r.component_id for r in ngram_join.near_groups(frame(spark, texts), block=block).collect()}
    want = alike(texts)[1]
    assert [got[i] for i in range(len(texts))] == want and 20 < len(set(want)) < len(texts)


@pytest.mark.parametrize("seed, n, m", [(17003, 3, 4), (48006, 6, 8), (156009, 9, 12)])
def test_ngram_join_short_pairs(spark, seed, n, m):
    """Sets of n and m shingles, alone in their table: the smaller names empty parts, the larger none."""
    w = sentence(random.Random(seed), m + 4).split()
    got = ngram_join.near_groups(frame(spark, [" ".join(w[: n + 4]), " ".join(w)])).collect()
    assert [r.component_id for r in got] == [0, 0]


def test_reach_beside_a_large_group(spark):
    """Links of pairs are reached though a third of the vectors are copies of one."""
    r = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(r.normal(size=(1500, 16)))
    turn = r.normal(size=a.shape)
    turn = unit(turn - (turn * a).sum(1)[:, None] * a)
    c = r.uniform(0.9, 0.97, (1500, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * turn, np.repeat(a[:1], 1500, 0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    model = embedding_dedup.fit(df, 0.9, 0.999, 2000, 24)[16]
    da, db = embedding_dedup.cost(x, model)
    i, j = np.arange(3000), np.concatenate([np.arange(1500, 3000), np.arange(1500)])
    excess = da[i, da.argmin(1)[j]] + db[i, db.argmin(1)[j]] - (da.min(1) + db.min(1))[i]
    assert (excess <= model["reach"]).mean() > 0.998 and model["recall"] > 0.99


def test_links_few_in_the_sample(spark):
    """A sample of a thirtieth of the vectors holds next to no link; the reach comes from all of them."""
    r = np.random.default_rng(8)
    a = r.normal(size=(3000, 24))
    x = np.concatenate([a, a + 0.42 * np.abs(a).mean() * r.normal(size=a.shape)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {g.vec_id: g.n_links for g in embedding_dedup.links(df, 0.9, sample=200).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert want.sum() > 1000 and sum(got.values()) >= 0.98 * want.sum() and all(got[i] <= w for i, w in enumerate(want))


def test_links_of_widths_and_copies(spark):
    """Every width is compared within itself; copies count each but are compared once; rows of one id count each."""
    r = np.random.default_rng(9)
    rows = []
    for width, n in ((8, 200), (5, 30), (1, 4)):
        a = r.normal(size=(n, width))
        rows += [v.tolist() for v in a] + [(v + 0.02 * r.normal(size=width)).tolist() for v in a[: n // 2]] + [a[0].tolist()] * 5 + [(2 * a[0]).tolist()]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {g.vec_id: (g.n_links, g.component_id) for g in embedding_dedup.links(df, 0.9, block=16).collect()}
    u = [np.array(v) / np.linalg.norm(v) for v in rows]
    hit = [[j for j in range(len(u)) if j != i and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.9] for i in range(len(u))]
    assert [got[i][0] for i in range(len(u))] == [len(h) for h in hit]
    assert got[200][1] == want_least(hit, 200) and all(got[i][1] == want_least(hit, i) for i in range(0, len(u), 7))
    again = embedding_dedup.links(df.limit(3).union(df.limit(3)), 0.9).collect()
    assert len(again) == 6 and all(g.n_links >= 1 for g in again)


def want_least(hit, i):
    """The smallest number reachable."""
    seen, todo = {i}, [i]
    while todo:
        for j in hit[todo.pop()]:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    return min(seen)


@pytest.mark.parametrize("wrapper", ["article", "main", "div"])
@pytest.mark.parametrize("many", [2, 30])
def test_html_keeps_title_and_lead(wrapper, many):
    """However long the part with most points is, the title and lead beside it stay."""
    text = "one, two, three, four " * 14
    body = "".join(f"<p>{i} {text}</p>" for i in range(many))
    page = f"<body><{wrapper}><h1>Title</h1><p>A lead</p><div class=body>{body}</div></{wrapper}><p><a href=x>elsewhere</a></p></body>"
    assert html_extract.main_text(page).split("\n") == ["Title", "A lead", *[f"{i} {text}".strip() for i in range(many)]]


def test_html_keeps_short_sections():
    body = "".join(f"<p>{'one, two, three, ' * 20}</p>" for _ in range(30))
    page = f"<article><h1>Title</h1><div class=body>{body}</div><section><h2>More</h2><p>short</p></section></article>"
    got = html_extract.main_text(page).split("\n")
    assert got[0] == "Title" and got[-2:] == ["More", "short"] and len(got) == 33


def test_chunks_inside_one_document(spark):
    """Every occurrence but the first is reported, also in the smallest or only document."""
    r = random.Random(8)
    passage = sentence(r, 100)
    texts = [f"{sentence(r, 40)} {passage} {sentence(r, 40)} {passage} {sentence(r, 9)}", sentence(r, 90), f"{sentence(r, 20)} {passage}"]
    spans = chunk_dedup.repeats(frame(spark, texts))
    assert sorted((x.doc_id, x.first_doc_id) for x in spans.collect()) == [(0, 0), (2, 0)]
    cut = {x.doc_id: x.text for x in chunk_dedup.without(frame(spark, texts), spans).collect()}
    assert cut[0].count(passage) == 1 and len(cut[0]) < len(texts[0]) - 300 and cut[1] == texts[1] and passage not in cut[2]


def best_windows(texts, items):
    """(document, item): similarity of the best of all windows, by counting each one's shingles."""
    out = {}
    for d, text in enumerate(texts):
        words = (text or "").lower().split()
        for i, item in enumerate(items):
            own = (item or "").lower().split()
            if not own or not words:
                continue
            k, many = min(5, len(own)), min(len(own), len(words))
            runs = lambda w: Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))  # noqa: E731, B023
            theirs = runs(own)
            for start in range(len(words) - many + 1):
                ours = runs(words[start : start + many])
                x = (ours & theirs).total() / max((ours | theirs).total(), 1)
                if x >= 0.75:
                    out[d, i] = max(out.get((d, i), (0, 0)), (x, -start))
    return {k: (round(x, 9), -s) for k, (x, s) in out.items()}


def test_decontamination_all_windows(spark):
    """Halves that change places, cut ends, edits, repeated words and items that are alike, against every window."""
    r = random.Random(11)
    items = [sentence(r, n) for n in (40, 40, 14, 60, 33, 3, 1)]
    items += [items[1][:-9] + " other", "la la la la la la la la " + sentence(r, 30)]
    w = [x.split() for x in items]
    pad = lambda n: sentence(r, n).split()
    docs = [pad(20) + w[0][20:] + w[0][:20] + pad(20), pad(20) + w[0][30:] + w[0][:30] + pad(20), w[3][:46], w[3][:45], pad(3) + w[3][6:] + pad(30), w[8] + pad(50) + w[8][4:] + w[8][:4], w[5] + pad(9) + w[6]]
    for _ in range(60):
        x = list(r.choice(w[:5]))
        for _ in range(r.randint(0, 2)):
            x[r.choice((0, 1, -1, -2, r.randrange(len(x))))] = "edit"
        if r.random() < 0.5:
            cut = r.randint(0, len(x) // 5)
            x = x[cut:] if r.random() < 0.5 else x[: len(x) - cut]
        docs.append(pad(r.randint(0, 30)) + x + pad(r.choice((0, 0, 5, 40))))
    texts = [" ".join(x) for x in docs] + ["la " * 70_000, None, ""]
    bench = spark.createDataFrame([(i, x, 0, "") for i, x in enumerate(items)], "item_id long, text string, v long, size string")
    got = {(x.doc_id, x.item_id): (round(x.similarity, 9), x.start) for x in decontaminate.leaks(frame(spark, texts), bench).collect()}
    want = best_windows(texts[:-3], items)
    assert got == want and (0, 0) in got and (2, 3) in got


def test_decontamination_repeated_rows(spark):
    """Rows that repeat count once; unlike texts of one id are versions of one document."""
    r = random.Random(12)
    a, b = sentence(r, 30), sentence(r, 30)
    docs = spark.createDataFrame([(1, a), (1, a), (1, b), (2, sentence(r, 50))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, a), (7, a), (7, b), (8, b)], "item_id long, text string")
    assert sorted((x.doc_id, x.item_id, x.start, x.similarity) for x in decontaminate.leaks(docs, bench).collect()) == [(1, 7, 0, 1.0), (1, 8, 0, 1.0)]


def test_fingerprints_within_the_radius_share_a_block(spark):
    """The multi-index finds all within RADIUS bits."""
    r = random.Random(13)
    rows = []
    for i in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, decontaminate.RADIUS)):
            y ^= 1 << b
        rows.append((i, *[v - (v >> 63 << 64) for v in (x, y)]))
    df = spark.createDataFrame(rows, "i long, x long, y long")
    one = df.select("i", F.explode(decontaminate.blocks(F.col("x"), decontaminate.NEAR)).alias("b")).select("i", "b.*")
    two = df.select("i", F.explode(decontaminate.blocks(F.col("y"))).alias("b")).select("i", "b.*")
    assert one.join(two, ["i", "number", "bits"]).select("i").distinct().count() == 300
