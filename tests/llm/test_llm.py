"""Operators on small cases against brute force."""

import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from viatrix.llm import chunk_dedup, decontaminate, embedding_dedup, html_extract, label_model, langid, line_dedup, ngram_join, packing, quality, toxicity
from viatrix.llm.store import Cuts
from viatrix.session import table

PATH = __import__("public_tokenizers").path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, hub long"


def frame(spark, texts, langs=None):
    """Extra columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, langs[i] if langs else None, None, None, 1.0, 2) for i, t in enumerate(texts)], DOCS)


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    out = [None, "", "   \n ", "one", "one two three four", "ONE two three four", "one two three four five", "é ü ß"]
    base = [sentence(r, n) for n in (8, 30, 60, 120, 400, 3000)]
    for b in base:
        words = b.split()
        out += [b, b, b.upper()]
        for edits in (1, 2, 3, 6, 12, 30):
            w = list(words)
            for _ in range(min(edits, len(w) // 8 + 1)):
                w[r.randrange(len(w))] = "new" + str(r.randrange(1000))
            out.append(" ".join(w))
    passage = sentence(r, 20)
    out += [passage + "\n" + sentence(r, n) for n in range(5, 45)]
    return out


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(n, edges):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


def alike(texts):
    sets = [shingle_set(t) for t in texts]
    return sets, components_of(len(sets), [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])


def test_ngram_join(spark, texts):
    sets, want = alike(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(frame(spark, texts)).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want))}


def test_ngram_join_empty(spark):
    assert ngram_join.near_groups(frame(spark, [])).count() == 0


def test_sketch_parts_keep_every_link():
    """No pair within the bound lacks a common part."""
    r = np.random.default_rng(1)
    edges = ngram_join.band_edges()
    for n in [3, 4, 5, 7, 10, 17, 30, 100, 500] * 6:
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        gone = r.integers(0, n // 7 + 1)
        b = np.unique(np.concatenate([a[gone:], r.integers(0, 2**64, int(r.integers(0, max(n // 8, 1) + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 75 * (len(a) + len(b) - common) or (len(a) == len(b) == common):
            continue
        keys = [{(band, int(x), int(y)) for band, _, name, xors in ngram_join.sketch_parts(s, 75, 100, edges) for x, y in zip(name, xors)} for s in (a, b)]
        assert keys[0] & keys[1]


def plain_lines(texts, run):
    """Texts without the later ones of equal runs, by looking at every run of that length."""
    seen, want = set(), {}
    for i, t in enumerate(texts):
        lines = t.split("\n") if t is not None else []
        full = [(k, x.strip(" ")) for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for k in range(len(full) - run + 1):
            x = tuple(y for _, y in full[k : k + run])
            if x in seen:
                gone |= {j for j, _ in full[k : k + run]}
            seen.add(x)
        want[i] = (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return want


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_lines(spark, run):
    texts = ["a\nb\nc", "x\na\nb\nc\ny", "a\nb", "b\nc\nd", "a\n\n b \nq", "a", None, "", "r\nr\nr\nr", "z\nz\nz"]
    r = random.Random(run)
    shared = ["\n".join(r.choice("abcdef") for _ in range(r.randint(2, 12))) for _ in range(6)]
    texts += ["\n".join(r.choice([*shared, r.choice("abc"), "own " + str(r.random())]) for _ in range(r.randint(1, 6))) for _ in range(60)]
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in line_dedup.dedup_lines(frame(spark, texts), run).collect()}
    assert got == plain_lines(texts, run)


def test_lines_rows(spark):
    """Extra columns of any name, an empty table, repeated rows."""
    names = ["doc_id", "text", "gone", "flags", "key", "_gone", "Gone_", "n_lines"]
    docs = spark.createDataFrame([(1, "a\nb", 1, 2, 3, 4, 5, 6), (2, "a\nb\nc", 1, 2, 3, 4, 5, 6), (2, "a\nb\nc", 1, 2, 3, 4, 5, 6)], names)
    got = line_dedup.dedup_lines(docs, 2)
    assert sorted(map(tuple, got.select("doc_id", "text", "Gone_", "n_removed").collect())) == [(1, "a\nb", 5, 0), (2, "c", 5, 2), (2, "c", 5, 2)]
    assert line_dedup.dedup_lines(docs.limit(0), 2).count() == 0


def test_runs(spark):
    """A match goes on both ways along its first occurrence."""
    runs = line_dedup.repeated_runs(frame(spark, ["q\na\nb\nc\nd", "a\nb\n\nc\ne", "x\nb\nc\nd"]).select("doc_id", "text"), 2, Cuts(spark, "t"))
    assert sorted(map(tuple, runs.collect())) == [(1, 0, 3, [0, 1, 3], 0, 1), (2, 1, 3, [1, 2, 3], 0, 2)]


def test_decontamination(spark):
    r = random.Random(9)
    items = [sentence(r, n) for n in (15, 30, 59, 3)] + [None, ""]
    edited = items[2].split()
    edited[20] = "other"
    docs = [sentence(r, 50) + " " + items[0].upper() + " " + sentence(r, 9), items[1], " ".join(edited) + " tail", "start " + items[3] + " end", items[1][: len(items[1]) // 2], sentence(r, 200), None, "", items[0] + "\n" + items[1]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (8, 0), (8, 1)}
    assert {x.doc_id for x in decontaminate.contamination(frame(spark, docs), bench).where("leaked").collect()} == {0, 1, 2, 3, 8}
    assert decontaminate.leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    odd = ["a\n b", "  lead", "trail  ", "a   b", "x   y", "<|endoftext|> hi", "tab\t b", "\r\n \r\nz"]
    rows = packing.pack(frame(spark, texts + odd), PATH, 256, 2).toPandas()
    t = Tokenizer.from_file(PATH)
    for i, text in enumerate(texts + odd):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 256).all()
        assert list(own.start) == [0, *np.cumsum(own.length)[:-1]] and list(own.piece) == list(range(len(own)))
        assert list(own.ids_crc32) == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 256 and list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
    assert rows.sequence_id.nunique() <= 1.1 * rows.length.sum() / 256 + 2
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_plan_bins():
    r = random.Random(1)
    for _ in range(50):
        counts = {r.randint(1, 64): r.randint(1, 30) for _ in range(r.randint(1, 40))}
        used: dict = {}
        for many, lengths in packing.plan_bins(dict(counts), 64):
            assert many > 0 and sum(lengths) <= 64
            for n in lengths:
                used[n] = used.get(n, 0) + many
        assert used == counts


def test_codewords():
    assert [embedding_dedup.codewords(n) for n in (0, 500, 2**20, 2**24, 2**60)] == [24, 24, 24, 48, 625]


@pytest.mark.parametrize("words", [None, 64])
def test_embeddings(spark, words):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 16))
    x[100:200] = x[:100] + 0.05 * r.normal(size=(100, 16))
    x[200:240] = x[7] + 0.1 * r.normal(size=(40, 16))
    rows = [v.tolist() for v in x] + [x[3].tolist(), None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int, home int")
    got = {g.vec_id: g for g in embedding_dedup.links(df, 0.9, words=words, block=32).collect()}
    ok = np.array(rows[:301])
    u = ok / np.linalg.norm(ok, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    found = sum(got[i].n_links for i in range(301))
    assert found >= 0.9 * hit.sum() and all(got[i].n_links <= hit[i].sum() for i in range(301))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(301, len(rows)))
    want = components_of(301, [tuple(e) for e in np.argwhere(hit)])
    assert np.mean([got[i].component_id == want[i] for i in range(301)]) >= 0.95
    assert embedding_dedup.links(df.limit(0)).count() == 0


def test_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(10**9, None), (10**9 + 1, "123 !!"), (10**9 + 2, "")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    got = langid.languages(docs.select("doc_id", "text", "lang").unionByName(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left").toPandas()
    assert set(got[got.doc_id >= 10**9].lang_pred) == {"und"}
    own = got[(got.doc_id < 10**9) & got.held_out]
    assert (own.lang == own.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    assert langid.languages(frame(spark, ["abc", None])).select("lang_pred").distinct().count() == 1


def test_gradient():
    """Backpropagation through time against finite differences, with windows of unlike lengths."""
    net = langid.Network(3, hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data, lengths = np.frombuffer(b"abcdexyzq", np.uint8), np.array([5, 3, 1])
    seq, target = langid.codes(data, np.array([0, 5, 8]), lengths, 5), np.eye(3)
    _, g = net.gradient(seq, target)
    for k, at in (("uf", (1, 1)), ("ub", (9, 2)), ("of", (1, 1)), ("ob", (2, 3)), ("xf", (5, 98)), ("xb", (10, 99)), ("b", (1, 0))):
        w = net.w[k]
        w[at] += 1e-4
        up, _ = net.gradient(seq, target)
        w[at] -= 2e-4
        down, _ = net.gradient(seq, target)
        w[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-6


def test_windows():
    """All bytes of all texts are in one window each, and what stands behind a window's end changes nothing."""
    offsets = np.array([0, 0, 300, 301, 557])
    starts, lengths, of = langid.windows(offsets, 128)
    assert sorted(i for a, n in zip(starts, lengths) for i in range(a, a + n)) == list(range(557)) and list(of) == [1, 1, 1, 2, 3, 3]
    data = np.random.default_rng(1).integers(0, 256, 557).astype(np.uint8)
    net = langid.Network(3)
    p = net.positions(langid.codes(data, starts[:1], np.array([20]), 64))
    assert np.allclose(p[:20], net.positions(langid.codes(data, starts[:1], np.array([20]), 20)), atol=1e-6)
    assert np.allclose(net.sums(data, starts, lengths).sum(1), lengths, atol=1e-3)


def test_toxicity(spark):
    r = random.Random(3)
    bad = ["vilest", "grubbik", "snarfol"]
    texts, y = [], []
    for i in range(600):
        w = sentence(r, r.randint(5, 60)).split()
        if i % 5 == 0:
            w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "en", "ly"])
        texts.append(" ".join(w))
        y.append(int(i % 5 == 0))
    docs = frame(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas().set_index("doc_id")
    held = [i for i in range(600) if got.held_out[i]]
    assert np.mean([got.predicted[i] == y[i] for i in held]) > 0.95 and got.predicted[600] == got.predicted[601] == 0
    assert toxicity.drop_toxic(docs, labels).count() == int((got.predicted == 0).sum())
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(frame(spark, []), labels).count() == 0


def test_toxicity_levels():
    """Features with their levels against plain counts."""
    import collections

    import pyarrow as pa

    texts = ["aa aa aa bb aa", "", "bb cc dddddddd dddddddd", "aa " * 9]
    found, of, words, first = toxicity.features(pa.array(texts), toxicity.Hasher(seed=4))
    got = collections.Counter((int(d), int(h & ~toxicity.LEVEL), int(h & toxicity.LEVEL)) for h, d in zip(*toxicity.levelled(found, of)))
    plain = collections.Counter((int(d), int(h)) for h, d in zip(found, of))
    assert got == collections.Counter((d, h, k) for (d, h), n in plain.items() for k in range(4) if n >= 1 << k)
    assert sorted(plain.values()) == [1, 1, 1, 2, 2, 2, 2, 4, 9]


def test_chunks(spark):
    r = random.Random(4)
    passage = sentence(r, 60)
    texts = [sentence(r, 80) + " " + passage + " " + sentence(r, 30), sentence(r, 11) + "\n" + passage, sentence(r, 200), None, "", passage[:50]]
    texts.append(texts[2])
    df = frame(spark, texts)
    spans = chunk_dedup.repeats(df)
    got = {(x.doc_id, x.first_doc_id) for x in spans.collect()}
    assert got == {(1, 0), (6, 2)}
    cut = {x.doc_id: x.text for x in chunk_dedup.without(df, spans).collect()}
    assert cut[6] == "" and cut[0] == texts[0] and len(cut[1]) < len(texts[1]) - 150 and cut[3] is None
    data, offsets = np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0])])
    s, e, _ = chunk_dedup.chunk_bounds(data, offsets)
    assert s[0] == 0 and e[-1] == len(data) and (s[1:] == e[:-1]).all() and (e - s <= chunk_dedup.MOST).all()
    assert chunk_dedup.repeats(frame(spark, [])).count() == 0


def voted(r, right, balance, cast, n=6000):
    """A class a row, and votes of voters that are right in given shares of the votes they cast."""
    y = r.random(n) < balance
    votes = np.where(r.random((n, len(right))) < right, 1, -1) * np.where(y, 1, -1)[:, None]
    return y, (votes * (r.random(votes.shape) < cast)).astype(np.int8)


@pytest.mark.parametrize("balance", [0.3, 0.5, 0.8])
def test_votes(balance):
    """The accuracies of the voters come back, and the posterior is better than a show of hands."""
    r = np.random.default_rng(int(100 * balance))
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6])
    y, votes = voted(r, right, balance, 0.7)
    hands = votes.sum(1)
    p, found, weight = label_model.fit_votes(votes, 1 / (1 + np.exp(-hands)), strength=0.01)
    assert np.abs(found - right).max() < 0.04 and (weight == 1).all()
    assert ((p > 0.5) == y).mean() > ((hands > 0) == y).mean() and np.argsort(label_model.fit_votes(votes, np.where(hands > 0, 0.9, 0.1))[1])[-1] == 0


def test_votes_of_copies_share_their_weight():
    y, votes = voted(np.random.default_rng(7), np.array([0.9, 0.8, 0.75, 0.7]), 0.5, 0.9)
    same = np.concatenate([votes, np.repeat(votes[:, 3:], 6, axis=1)], axis=1)
    p, _, weight = label_model.fit_votes(same, 1 / (1 + np.exp(-votes.sum(1))), strength=0.01)
    assert (weight[:3] > 0.9).all() and (weight[3:] < 0.3).all() and ((p > 0.5) == y).mean() > 0.88


def test_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = quality.quality(docs).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.95 and got[got.quality == 0].keep.mean() < 0.1
    assert quality.quality(frame(spark, [None, "", "x"])).count() == 3 and quality.quality(frame(spark, [])).count() == 0


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""),
    ("<body><nav><a href=/>x, y</a></nav><article><h1>T</h1><p><b>a,&nbsp;b\n c<br><p>d &amp;lt; e</article><footer>f, g</footer>", "T\na, b c\nd &lt; e"),
    ("<div id=sidebar><p>no, no</p></div><div class=content><p>One, two<ul><li>a<li><a href=x>b</a></ul><div class='comments'><p>c, d, e, f</p></div></div>", "One, two\na"),
    ("<script>var a='</p><p>no';</script><style>p{}</style><main><p>yes, it is</p></main><form><p>x, y, z</p></form>", "yes, it is"),
    ("<div class='page has-sidebar'><div class=post><div class=post-header><h1>H</h1></div><p>one, two</div><div class=post-comments><p>c, d, e</div></div>", "H\none, two"),
    ("<body><div class='cookie-notice'><p>we, use, cookies</p></div><section><p>text, of, page</p></section>", "text, of, page"),
    # wrappers of the page
    ("<body><form id=f action=x><h1>T</h1><p>one, two</p><input></form></body>", "T\none, two"),
    ("<body class=x><div class='nav-open'><nav><a href=/>x</a></nav><p>one, two, three</p></div>", "one, two, three"),
    ("<div class='social-page'><main><p>one, two</p></main><form class=search><label>find</label></form></div>", "one, two"),
    ("<div id=tags-page><h1>T</h1><p>one, two</p></div>", "T\none, two"),
    ("<div class='comments'><p>first, I, say, that, it, is, long, and, longer, than, all</p></div><div><p>short, text</p></div>", "short, text"),
    ("<div class='cookie-consent'><p>we, use, them</p></div>", ""),
    ("<main><p>yes, it is</p><article class=comment><p>I, think, so, too, and, more</p></article></main>", "yes, it is"),
    # inside a line, hidden, of the page's own making
    ("<article><p>a, b <ins class='adsbygoogle'>buy, it</ins> c<span class=advert>no <span>never</span> no</span> d</p></article>", "a, b c d"),
    ("<article><p>a, b<span hidden> x</span><b style='display: none'> y</b>, c<amp-ad width=1>z</amp-ad></p><p>d</p></article>", "a, b, c\nd"),
    ("<article><p>a, b<span class=advert>no</p><p>c</p></article>", "a, b\nc"),
    ("<article><p>a<svg/>, b <svg viewBox='0 0'><text>no</text></svg>c</p><svg><p>d</p></article>", "a, b c\nd"),
    # lists of links
    ("<article><h1>T</h1><ul><li><a href=x>one</a><li>two, <a href=y>three</a></ul></article>", "T\none\ntwo, three"),
    ("<article><p><a href=x>only, a, link</a></p></article>", "only, a, link"),
    # tags that nothing ends, values with signs in them
    ("<article><p title='a > b' class=\"x<y\">one, two</p></article>", "one, two"),
    ("<article><p>one, two</p><p class=\"x>three</p></article>", "one, two\nthree"),
    ("<p>one, two < three</p><!-- <p>no", "one, two < three"),
    ("<article><p>İİ one<script>if (a</b) '</p>';</SCRIPT >, two</article>", "İİ one, two"),
])
def test_html(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("page", ['<a title="x ' * 60_000, '<a title="x ' * 60_000 + ">", "<div>" * 60_000 + "text, here", "<div>x" * 30_000, "</b></div>" * 60_000, "<span class=ad>" * 40_000, "<li><p>" * 40_000, "<svg>" * 60_000, "<!--" * 60_000, "<p '" * 60_000 + ">" * 60_000])
def test_html_in_proportion(page):
    """Time grows with the page, not with its square."""
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 4


@pytest.mark.parametrize("seed", range(40))
def test_html_made_pages(seed):
    """Articles put together from known blocks, with all kinds of things around and between them."""
    r = random.Random(seed)
    want = [sentence(r, 3).title()] + [", ".join(sentence(r, r.randint(3, 30)) for _ in range(r.randint(1, 5))) for _ in range(r.randint(3, 12))]
    inside = ["<script>x('<p>no, no</p>')</script>", "<aside><p>by, the, way</p></aside>", "<div class=ad><p>buy, this</p></div>", "<form><p>your, name</p><input></form>", "<!-- <p>no</p> -->", "<div hidden><p>no, no</p></div>", ""]
    around = ["<nav><ul><li><a href=/>home</a><li><a href=/b>b, c</a></ul></nav>", "<header><p>site, name</p></header>", "<footer><p>all, rights</p></footer>", "<div id=comments>" + "<p>I, say, so, too, very, long</p>" * r.randint(1, 30) + "</div>", "<div class='cookie-notice'><p>we, use</p></div>", "<style>p{}</style>", "<div class=sidebar><p>more, here</p><p>and, there</p></div>"]
    body = f"<h1>{want[0]}</h1>" + "".join(f"<p>{x.replace(' ', r.choice([' ', chr(10), '<b> </b>']), 1)}{r.choice(['</p>', ''])}{r.choice(inside)}" for x in want[1:])
    wrap = r.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div class=content>{}</div>", "<form><div>{}</div></form>", "<div class='page nav-open'><section>{}</section></div>"])
    page = "<html><body>" + "".join(r.sample(around, 3)) + wrap.format(body) + "".join(r.sample(around, 3)) + "</body></html>"
    assert html_extract.main_text(page).split("\n") == want


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (1, "u", "<p>é</p>", 5)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in html_extract.extract(df).collect()) == [("", 0), ("é", 1)]
    assert html_extract.extract(df.limit(0)).count() == 0
