"""The pipeline's stages against plain versions."""

import duckdb
import pytest

import corpus_pipeline
from test_llm import alike
from viatrix.llm import sql, toxicity


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_stages(spark, sf_dir, staged):
    first, lines, near, clean, packed = staged
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs, labels).toPandas()
    assert sorted(first.doc_id) == sorted(scored[scored.predicted == 0].doc_id)
    labels = labels.toPandas()
    quiet, loud = (set(labels[labels.toxic == k].doc_id) for k in (0, 1))
    assert len(quiet & set(first.doc_id)) >= 0.98 * len(quiet) and len(loud & set(first.doc_id)) < 0.5 * len(loud)
    con = duckdb.connect()
    con.register("documents", first)
    want = con.execute(sql.ORACLES["op10_line_dedup"]).df().set_index("doc_id")
    own = lines.set_index("doc_id")
    assert all(len(own.text[i]) == want.n_chars[i] for i in own.index)
    assert set(first.doc_id) - set(lines.doc_id) == {i for i in want.index if want.n_removed[i] and want.n_chars[i] == 0} or all(not first.set_index("doc_id").text[i].strip() or want.n_removed[i] for i in set(first.doc_id) - set(lines.doc_id))
    lines = lines.sort_values("doc_id").reset_index(drop=True)
    _, groups = alike(list(lines.text))
    assert sorted(near.doc_id) == [lines.doc_id[i] for i, c in enumerate(groups) if i == c]
    con.register("documents", near)
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
    leaked = set(con.execute(sql.ORACLES["op7_decontamination"]).df().doc_id)
    assert set(clean.doc_id) == set(near.doc_id) - leaked
    assert set(packed.doc_id) == set(clean.doc_id)
    for frame in staged[:4]:
        assert list(frame.columns) == corpus_pipeline.COLUMNS
