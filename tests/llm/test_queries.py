"""The registered queries and the pipeline on a given table."""

import corpus_pipeline
import pytest

from tests.llm import brute
from wiretide.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_queries_return_every_document(spark, rows):
    for name in ("op3_quality", "op4_sharding", "op7_mixing", "op10_exact_dedup"):
        assert sorted(r.doc_id for r in QUERIES[name](spark, SMALL).select("doc_id").collect()) == sorted(i for i, _ in rows)


def test_near_duplicates(spark, rows):
    wanted = brute.near_duplicates(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_near_dedup"](spark, SMALL).collect()} == wanted


def test_contamination(spark, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    wanted = brute.contamination(rows, items)
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_decontamination"](spark, SMALL).collect()} == wanted


def test_repeats(spark, rows):
    wanted = brute.repeats(rows)
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op2_suffix_dedup"](spark, SMALL).collect()} == wanted


def test_pipeline(spark, rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in brute.near_duplicates(rows, 5).values()})
    clean = corpus_pipeline.decontamination(spark, docs, SMALL)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, x in brute.contamination(rows, items).items() if not x[4])
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*docs.columns, "shard", "slot"] and 0 < out.count()
