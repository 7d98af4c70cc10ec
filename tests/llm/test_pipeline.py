"""The pipeline's stages, each against a brute-force version on its own input, and the registered queries."""

from __future__ import annotations

import re

import pytest
from helpers import contamination, jaccard, repeats

import __spark_entry__
import corpus_pipeline
from quillmeter.llm import toxicity

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, input rows, output rows)] on the smallest tables, written and read again."""
    root = tmp_path_factory.mktemp("stages")
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        made.write.parquet(f"{root}/{name}")
        read = spark.read.parquet(f"{root}/{name}")
        if name != "packing":
            assert read.columns == docs.columns and [f.dataType for f in read.schema] == [f.dataType for f in docs.schema]
        out.append((name, docs.collect(), read.collect()))
        docs = read
    return out


def test_stages(spark, stages):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "decontamination", "packing"]
    before = {r["doc_id"]: r for r in stages[0][1]}
    scored = toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0")
    assert {r["doc_id"]: r for r in stages[0][2]} == {r["doc_id"]: before[r["doc_id"]] for r in scored.collect()}
    found = jaccard([(r["doc_id"], r["text"]) for r in stages[1][1]])
    assert {r["doc_id"] for r in stages[1][2]} == {c for _, c in found.values()}
    want = repeats([(r["doc_id"], r["text"]) for r in stages[2][1]])
    for r in stages[2][2]:
        n, removed, _, _ = want[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) and n - removed - 3 * 20 <= len(r["text"].encode()) <= n - removed
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    judged = contamination([(r["doc_id"], r["text"]) for r in stages[3][1]], items)
    assert {r["doc_id"]: r["text"] for r in stages[3][2]} == {r["doc_id"]: r["text"] for r in stages[3][1] if not judged[r["doc_id"]][3]}
    assert {r["doc_id"] for r in stages[4][2]} == {r["doc_id"] for r in stages[4][1]}


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in out.collect()) == sorted((r["doc_id"], r["start"], r["length"]) for r in stages[4][2])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, tmp_path, name, stage):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", None), (3, "same words here and there " * 20, "en", "s", 1), (3, "same words here and there " * 20, "en", "s", 1), (4, "y" * 300_000, "", "", 2)]
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], TABLE + ", score string, n_words string")
    spark.createDataFrame([(3, None, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert name == "packing" or out.columns == docs.columns
    assert name in ("packing", "near_duplicates") or out.count() == len(rows)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op4_decontaminate", "op5_multi_index", "op7_warc", "op9_repeats", "op10_jaccard"])
def test_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    want, got = (df.astype(object).where(df.notna(), None) for df in (want, got))
    as_text = lambda df: sorted(tuple("null" if v is None or v != v else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert as_text(got) == as_text(want)
