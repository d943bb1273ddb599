"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm import PATH, sentence
from viatrix.llm import chunk_dedup, decontaminate, embedding_dedup, html_extract, langid, line_dedup, ngram_join, packing, quality, toxicity, words

#: names that operators use inside, and the columns of documents
NAMES = "doc_id long, text string, lang string, source string, n_chars long, key long, gone string, flags string, rep long, d2 long, v long, size string, words string, fold int, hub long"


def test_words_in_blocks():
    """Hashes of long texts, made block by block, are those made at once."""
    r = random.Random(3)
    texts = [sentence(r, n) for n in (400, 0, 3, 1, 900)] + ["x" * 500 + " y"]
    data, offsets = words.strings(pa.array(texts))
    starts, ends, first = words.split(data, offsets)
    whole = words.Hasher().spans(data, starts, ends)
    for block in (1, 7, 64, 5000):
        assert (words.Hasher().spans(data, starts, ends, block) == whole).all()
        for a, b in zip(words.shingle_hashes(whole, first, 5, block), words.shingle_hashes(whole, first, 5)):
            assert (a == b).all()
    assert len(words.shingle_hashes(np.zeros(0, np.uint64), np.array([0, 0]), 5)[0]) == 0


def test_ends_in_blocks():
    data = np.random.default_rng(4).integers(97, 123, 5_000).astype(np.uint8)
    for block in (20, 100, 999):
        assert (chunk_dedup.ends_of(data, block) == chunk_dedup.ends_of(data)).all()


def rows(texts, langs=("en", None)):
    return [(i, t, langs[i % len(langs)], None, None, *[None] * 10) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of all kinds, one of them twice; the longest text has some 2 MB."""
    r = random.Random(21)
    base = sentence(r, 300)
    long_ = "\n".join(sentence(r, 40) for _ in range(9_000))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (5, base), (6, base + " more"), (7, "x" * 300_000), (8, long_), (9, "a\nb\nc"), (10, "a\nb\nc"), (11, "\x00� é \U0001f600"), (12, "!!! 123"), (13, base.upper())]
    return spark.createDataFrame(rows(texts), NAMES)


def counts(df, *columns):
    return sorted((x.doc_id, *[x[c] for c in columns]) for x in df.collect())


def empty(df):
    return df.limit(0)


def test_quality_rows(odd):
    got = counts(quality.quality(odd), "score", "keep")
    assert [x[0] for x in got] == sorted(x.doc_id for x in odd.select("doc_id").collect()) and got[0][1] == got[1][1] and got[4] == got[5]
    assert quality.quality(empty(odd)).count() == 0


def test_language_rows(odd):
    got = counts(langid.languages(odd), "lang_pred", "score", "held_out")
    assert len(got) == 14 and got[4] == got[5]
    assert all(x[1] == "und" and x[2] == 0 for x in got if x[0] in (1, 2, 3, 12)) and all(x[1] == "en" for x in got if x[0] not in (1, 2, 3, 12))
    assert langid.languages(empty(odd)).count() == 0


def test_language_ties(spark):
    """Two languages with the same texts: the first in order of name."""
    df = spark.createDataFrame([(i, "same words here", "ba"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    langs, net = langid.learn(df)
    assert langs == ["a", "b"]
    for k in net.w:
        net.w[k][:] = 0
    learn, langid.learn = langid.learn, lambda *_: (langs, net)
    try:
        assert {x.lang_pred for x in langid.languages(df).collect()} == {"a"}
    finally:
        langid.learn = learn


def test_toxicity_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, None), (4, 0, None), (None, 1, 3), (5, None, 3), (99, 1, 3)], "doc_id long, toxic int, text int")
    got = counts(toxicity.toxicity(odd, labels), "score", "predicted", "held_out")
    assert len(got) == 14 and got[4] == got[5] and got[0][1] == got[1][1]
    assert toxicity.toxicity(empty(odd), labels).count() == 0 and toxicity.toxicity(odd, labels.limit(0)).count() == 14
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns


def test_chunk_rows(odd):
    spans = chunk_dedup.repeats(odd)
    got = {(x.doc_id, x.first_doc_id) for x in spans.collect()}
    assert {(5, 4), (6, 4)} <= got and not {x[0] for x in got} & {1, 2, 3, 4, 8, 9, 10, 11, 12}
    cut = chunk_dedup.without(odd, spans)
    assert cut.columns == odd.columns and {x.doc_id: len(x.text or "") for x in cut.collect()}[5] == 0
    assert chunk_dedup.repeats(empty(odd)).count() == 0 and chunk_dedup.without(empty(odd), spans).count() == 0


def test_join_rows(odd):
    got = counts(ngram_join.near_groups(odd), "n_shingles", "component_id")
    assert [x[2] for x in got] == [1, 2, 3, 4, 4, 4, 4, 7, 8, 9, 9, 11, 12, 4] and got[0][1] == got[1][1] == got[2][1] == 0
    assert ngram_join.near_groups(empty(odd)).count() == 0


def test_leak_rows(spark, odd):
    bench = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b c", 1), (3, "a b c", 1), (3, "a b c", 2)], "item_id long, text string, v int")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(odd, bench).collect()}
    assert got == {(9, 3), (10, 3)}  # an item without an id is left out
    # ties: the first of equal windows
    twice = spark.createDataFrame([(1, "z a b c z a b c")], "doc_id long, text string")
    assert [x.start for x in decontaminate.leaks(twice, bench.where("item_id = 3")).collect()] == [1]
    assert decontaminate.leaks(odd, empty(bench)).count() == 0 and decontaminate.leaks(empty(odd), bench).count() == 0


def test_page_rows(spark):
    long_ = "<article>" + "<p>one, two, three</p>" * 60_000 + "</article>"
    df = spark.createDataFrame([(1, None, None, 5), (2, "u", "", 5), (3, "u", long_, 5), (3, "u", long_, 5), (None, "u", "<p>x, y</p>", 5)], "page_id long, url string, html string, n_chars int")
    got = sorted((x.page_id or 0, x.n_chars) for x in html_extract.extract(df).collect())
    assert got == [(0, 4), (1, 0), (2, 0), (3, 60_000 * 16 - 1), (3, 60_000 * 16 - 1)]
    # of two elements with equal points the first
    assert html_extract.main_text("<div><div><p>one, two</p></div></div><section><div><p>six, ten</p></div></section>").startswith("one")


def test_packing_rows(odd):
    out = packing.pack(odd, PATH, 64, 2).toPandas()
    assert set(out.doc_id) == set(range(1, 14)) and (out[out.doc_id == 1].length == 1).all()
    assert len(out[out.doc_id == 5]) == 2 * len(out[out.doc_id == 4])
    assert not out.duplicated(["sequence_id", "offset"]).any() and (out.groupby("sequence_id").length.sum() <= 64).all()
    assert packing.pack(empty(odd), PATH).count() == 0


def test_line_rows(odd):
    got = counts(line_dedup.dedup_lines(odd), "n_lines", "n_removed")
    assert (10, 3, 3) in got and (9, 3, 0) in got and (1, 0, 0) in got and (8, 9_000, 0) in got and len(got) == 14
    assert line_dedup.dedup_lines(empty(odd)).count() == 0


def test_vector_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, [1.0], 0), (2, [1.0], 0), (3, [2.0], 0), (4, [-1.0], 0), (5, [1e-300, 0.0], 0), (6, [1e300, 0.0], 0), (7, [None, 1.0], 0)], "vec_id long, embedding array<double>, home int")
    got = sorted(map(tuple, embedding_dedup.links(df).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == [(1, 0, 1, True), (2, 2, 2, True), (2, 2, 2, True), (3, 2, 2, False), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]
    assert embedding_dedup.links(df.limit(0)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_rows(spark, sf_dir, odd, name, stage):
    """Each stage takes rows of all kinds and extra columns, and returns the columns of documents."""
    out, none = stage(spark, odd, sf_dir), stage(spark, empty(odd), sf_dir)
    assert none.count() == 0
    left = {x.doc_id for x in out.select("doc_id").collect()}
    if name == "best-fit packing":
        assert left == set(range(1, 14))
        return
    assert out.columns == none.columns == corpus_pipeline.COLUMNS
    gone = {"line dedup": {10}, "n-gram Jaccard join": {5, 6, 10, 13}}.get(name, set())
    assert left == set(range(1, 14)) - gone


def test_run(spark, sf_dir, tmp_path):
    """run() gives what the stages give one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / str(i)))
        docs = spark.read.parquet(path)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select(keep).collect())) == sorted(map(tuple, docs.select(keep).collect()))
    assert whole.agg(F.countDistinct("sequence_id")).first()[0] == docs.agg(F.countDistinct("sequence_id")).first()[0]
