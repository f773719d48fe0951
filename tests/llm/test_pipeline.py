"""The corpus pipeline, stage by stage, against plain Python on the smallest driver data."""

import duckdb
import pytest

import corpus_pipeline
from emberline.llm.queries import QUERIES
from test_lines import brute as brute_lines
from test_passages import brute as brute_passages
from test_resemblance import survivors

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from emberline.session import cut_lineage

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(spark, stages):
    like = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(s.dtypes == like.dtypes for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "passages", "packing"]
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_quality_stage(spark, stages):
    kept = set(texts(stages[0]))
    scored = QUERIES["op8_quality"](spark, SF).collect()
    assert kept == {r.doc_id for r in scored if r.predicted == 1}
    truth = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    assert sum(i in kept for i, q in truth.items() if q == 1) > 0.97 * sum(truth.values())


def test_line_stage(stages):
    rows = list(texts(stages[0]).items())
    assert texts(stages[1]) == {i: t for i, t, _, _ in brute_lines(rows)}


def test_near_duplicate_stage(stages):
    before = texts(stages[1])
    want, beyond = survivors(list(before.items()))
    assert beyond  # pairs that only their shingle sets link
    assert texts(stages[2]) == {i: before[i] for i in want}


def test_passage_stage(stages):
    rows = list(texts(stages[2]).items())
    want = {i: t.split() for i, t, _, _ in brute_passages(rows, 35)}
    assert {i: t.split(" ") if False else t.encode().split() for i, t in texts(stages[3]).items()} == {i: [w.encode() for w in t] for i, t in want.items()}


def test_packing_stage_and_run(spark, stages):
    pieces = stages[4].collect()
    assert {r.doc_id for r in pieces} == set(texts(stages[3]))
    again = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again.collect())) == sorted(map(key, pieces))


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "x y z", "en", "s", 5), (2, "", "en", None, 0), (3, "a b " * 40_000, "en", "s", 1), (3, "other", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "e", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, note string, score double")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, SF)
        assert out.count() > 0
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
