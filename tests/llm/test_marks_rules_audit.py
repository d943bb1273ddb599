"""Operators 11 to 13 against plain versions, and odd rows."""

import hashlib
import itertools
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from test_edges import NAMES, rows
from test_llm import sentence
from viatrix.llm import filter_audit, fill_in_middle, url_rules

MARKED = re.compile(r"<P>|<S>|<M>")


def plain_cut(doc_id, text, unit, rate=100, spm=50, seed=7):
    """(n, form, prefix, middle, suffix) by regular expressions."""
    text = text or ""
    units = re.findall({"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "char": r"(?s)."}[unit], text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if not text or MARKED.search(text) or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"
    return n, form, "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    own = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "x<P>y\nz", "<S>", "<<\n<S\n<\n<M", "<S\nP>\n>", "é\U0001f600\n\x00\r\n b", "  lead\nand  trail \n"]
    own += ["".join(r.choice("ab \n<>PSM\t\u00e9\U0001f600") for _ in range(r.randrange(60))) for _ in range(300)]
    own += ["\n".join(sentence(r, 30) for _ in range(6_000)), "y" * 1_000_000]
    return spark.createDataFrame(rows(list(enumerate(own))) + rows([(3, "\n\n\n")]) + [(None, "a\nb\nc", *[None] * 13)], NAMES).cache()


@pytest.mark.parametrize("unit, rate, spm", [("line", 100, 50), ("word", 60, 20), ("char", 90, 80)])
def test_fill_in_middle(texts, unit, rate, spm):
    made = fill_in_middle.fill_in_middle(texts, 7, rate, spm, unit)
    got = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    given = {}
    for x in texts.select("doc_id", "text").collect():
        given.setdefault(x.doc_id, []).append(x.text)
    assert len(got) == sum(map(len, given.values())) and {x.form for x in got} == {"plain", "psm", "spm"}
    for x in got:
        text = given[x.doc_id][0] or ""
        n, form, p, m, s = plain_cut(x.doc_id, text, unit, rate, spm)
        assert (x.n, x.form, x.back) == (n, form, text)
        if form == "plain":
            assert x.prefix_chars is None and x.middle_chars is None and x.output == text
        else:
            assert (x.prefix_chars, x.middle_chars) == (len(p), len(m))
            assert x.output == (f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_empty(texts):
    assert fill_in_middle.fill_in_middle(texts.limit(0)).count() == 0
    with pytest.raises(Exception, match="units are"):
        fill_in_middle.fill_in_middle(texts, unit="page").count()


def plain_judge(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if v is not None and h is not None and p is not None for h in [h.lower()] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    top = max(fit, key=lambda x: (x[:3], x[3] == "block"), default=None)
    return host, path, *(top[2:] if top else (None, default))


PAGE = "page_id long, url string, html string, row long, digest string, best string, host string, suffix int, salt int"


@pytest.mark.parametrize("small", [100_000, 3])
def test_urls(spark, small):
    r = random.Random(9)
    labels, parts = ["a", "b", "com", "net", "A", ""], ["en", "de", "", "x" * 40]
    urls = [None, "", "no scheme/en/", "://", "http://", "http://net", "http://net/", "http://xnet/", "http://net./", "HTTP://Example.NET/en/x?q=http://b.com/", "http://\u00c4.net/\u00e9/", "http://a.net#/en/", "a\n://b\n.com/\n/x"]
    urls += ["s://" + ".".join(r.choice(labels) for _ in range(r.randrange(1, 6))) + "".join("/" + r.choice(parts) for _ in range(r.randrange(0, 5))) + r.choice(["", "?a/b", "#c"]) for _ in range(400)]
    urls += ["s://" + "q." * 3_000 + "com/en/", "s://a.net/" + "en/" * 20_000, "s://b.net/" + "x" * 1_000_000]
    rules = [(r.choice(["allow", "block"]), ".".join(r.choice(labels[:5]) for _ in range(r.randrange(1, 4))), "".join("/" + r.choice(parts) for _ in range(r.randrange(0, 3))) + r.choice(["", "/", "e"])) for _ in range(60)]
    rules += [("block", "net", "/"), ("allow", "net", "/"), ("allow", "com", ""), ("allow", None, "/"), (None, "com", "/"), ("block", "com", None), ("block", "a.b", "/"), ("allow", "b", "/de/x")]
    pages = spark.createDataFrame([(i // 2 if i % 7 else None, u, "h", *[None] * 6) for i, u in enumerate(urls + urls[:20])], PAGE)
    got = sorted(map(repr, (tuple(x) for x in url_rules.judged(pages, url_rules.table_of(rules, pages), small=small).collect())))
    assert got == sorted(repr((x.page_id, *plain_judge(x.url, rules))) for x in pages.collect())


def test_urls_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", None)], "page_id long, url string, html string")
    none = url_rules.table_of([], pages)
    assert [tuple(x) for x in url_rules.judged(pages, none, "block").collect()] == [(1, "a.net", "/", None, "block")]
    assert url_rules.judged(pages.limit(0), url_rules.table_of([("block", "net", "/")], pages)).count() == 0


def failing(doc_id, text, first):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    found = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]
    return [*found, doc_id is not None and first.get(text, doc_id) < doc_id]


def test_audit(spark):
    """Against orders that are applied one filter after the other to the documents themselves."""
    r = random.Random(2)
    pool = [None, "", "A" * 9 + "b" * 81, "A" * 10 + "b" * 80, "\u00e9#", "x | y", " \u00a0 \x1c "]
    pool += [" ".join(r.choice(["w%d" % r.randrange(150), "same", "LOUD", "#"][: r.randrange(1, 5)]) for _ in range(r.choice([99, 100, 101, 180]))) for _ in range(40)]
    pool += [" ".join(f"u{i}" for i in range(80)) + " u0" * 20, " ".join(f"u{i}" for i in range(79)) + " u0" * 21, sentence(r, 300) + " $" * 200_000]
    docs = [(i if i % 19 else None, r.choice(pool), r.choice(["en", "de", None, ""])) for i in range(150)]
    docs += docs[:10]
    labels = [(r.randrange(160), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(90)] + [(None, 1, 1)]
    df = spark.createDataFrame([(*d, None, None) for d in docs], "doc_id long, text string, lang string, mask int, n long")
    marks = spark.createDataFrame([(*x, "?") for x in labels], "doc_id long, quality int, toxic int, part string")
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    want = {}
    for part in {p or "" for *_, p in docs}:
        own = [(d, failing(d, t or "", first)) for d, t, p in docs if (p or "") == part]
        for order in itertools.permutations(range(5)):
            left = own
            for step, f in enumerate(order):
                out, rest = [x for x in left if x[1][f]], [x for x in left if not x[1][f]]
                failed = [x for x in own if x[1][f]]
                share = 120 * sum(Fraction(1, sum(x[1])) for x in failed)
                want[part, "".join("ABCDE"[i] for i in order), step + 1] = (len(rest), len(out), len(failed) - len(out), sum(sum(x[1]) == 1 for x in failed), sum(x[0] in good for x in out), sum(x[0] in toxic for x in out), share)
                left = rest
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(x.part, x.filter_order, x.step): tuple(x[n] for n in names) for x in filter_audit.filter_audit(df, marks).collect()}
    assert got == want
    # the share in closed form is what the orders add up to
    for part, f in itertools.product({k[0] for k in got}, "ABCDE"):
        cells = [v for k, v in got.items() if k[0] == part and k[1][k[2] - 1] == f]
        assert {v[6] for v in cells} == {sum(v[1] for v in cells)}


def test_audit_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(df, marks).count() == 0
    one = spark.createDataFrame([(1, "a", "x")], df.schema)
    got = filter_audit.filter_audit(one, marks).collect()
    assert len(got) == 600 and sum(x.removed for x in got) == 120 and {x.shapley for x in got} == {0, 120}
