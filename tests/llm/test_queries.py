"""Registered queries: the SQL that checks them, their shape, and the pipeline's stages."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from offerloom.llm import clustering, collocations, decontaminate, exact_dedup, topk
from offerloom.llm.jaccard import Measure, join

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, sql", [
    ("op7_exact_dedup", exact_dedup.ORACLE), ("op9_exact_top_k", topk.ORACLE), ("op11_decontamination", decontaminate.ORACLE),
    ("op12_clustering", clustering.ORACLE), ("op13_collocations", collocations.ORACLE),
])
def test_sql(spark, name, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, FOLDER)
    want = con.sql(sql)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_names():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        docs = out.cache()
        seen.append(docs.count())
    assert seen[0] >= seen[1] > seen[2] >= seen[3] == seen[4] > 0
    left = join(docs, Measure()).where("component_id <> doc_id").count()
    assert left <= 2  # cutting passages may bring two texts closer
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).select("doc_id").distinct().count() == seen[-1]
