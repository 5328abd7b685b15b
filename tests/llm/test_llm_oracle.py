"""Registered queries against their SQL, and the pipeline's stages against plain code."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from creatorlens.llm import catalog, common, decontaminate, quality

from ..compare import connect, diff
from .test_llm_operators import brute_contamination, brute_fingerprint, brute_roots


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.all_sql()))
def test_query_against_sql(spark, sf, duck, name):
    assert diff(catalog.all_queries()[name](spark, sf), duck, catalog.all_sql()[name]) is None


def test_every_operator_is_registered_once():
    assert [int(n[2:].split("_")[0]) for n in catalog.all_queries()] == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_secrets", "op5_quality", "op6_simhash", "op7_langid"])
def test_queries_without_sql_return_every_document(spark, sf, name):
    ids = [r.doc_id for r in common.table(spark, sf, "documents").select("doc_id").collect()]
    assert sorted(r.doc_id for r in catalog.all_queries()[name](spark, sf).collect()) == sorted(ids)


def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality_filter", "line_dedup", "near_dedup", "decontamination", "packing"]

    def staged(name, docs):
        path = str(tmp_path / name)
        stages[name](spark, docs, sf).write.parquet(path)
        return spark.read.parquet(path)

    good = staged("quality_filter", docs)
    assert good.columns == columns and good.exceptAll(docs).count() == 0
    labels = common.table(spark, sf, "labels").where(quality.fold("doc_id", 3) != 1)
    want = quality.scored(docs, quality.train(docs, labels)).where("score >= 0.5")
    assert sorted(r.doc_id for r in want.collect()) == sorted(r.doc_id for r in good.collect())

    lines = staged("line_dedup", good)
    assert lines.columns == columns and lines.count() == good.count()
    assert lines.where("n_chars <> length(text)").count() == 0

    apart = staged("near_dedup", lines)
    assert apart.columns == columns
    rows = {r.doc_id: r.text for r in lines.collect()}
    fps = {i: brute_fingerprint(t, corpus_pipeline.SHINGLE_WORDS) for i, t in rows.items()}
    roots = brute_roots(set(fps.values()), corpus_pipeline.NEAR_BITS)
    kept = {}
    for i, f in fps.items():
        kept[roots[f]] = min(i, kept.get(roots[f], i))
    assert sorted(r.doc_id for r in apart.collect()) == sorted(kept.values())

    clean = staged("decontamination", apart)
    items = [tuple(r) for r in common.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    want = [i for i in kept.values() if not brute_contamination(rows[i], items, decontaminate.WINDOW)[1]]
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == sorted(want)

    packed = staged("packing", clean)
    assert {r.doc_id for r in packed.collect()} == set(want)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_of_no_rows_and_of_null_columns(spark, sf):
    docs = common.table(spark, sf, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, "", None, None, 0)], docs.schema)
    for frame, most in ((docs.where("false"), 0), (odd, 3)):
        for _, stage in corpus_pipeline.STAGES:
            frame = common.stored(stage(spark, frame, sf), "test-stage")
        assert frame.count() <= most


def test_stages_with_clashing_columns_repeats_and_long_texts(spark, sf):
    """Every stage keeps the columns it was given; those named like an operator's output may be replaced."""
    docs = common.table(spark, sf, "documents")
    some = docs.limit(30)
    long = docs.limit(1).select(
        F.lit(10**6).cast("long").alias("doc_id"), F.repeat(F.concat("text", F.lit("\n")), 60).alias("text"), "lang", "source", "n_chars"
    )
    odd = some.union(some).union(long).withColumns(
        {c: F.lit("clash") for c in ("score", "predicted", "first", "fp", "component_id", "hits", "items", "n_lines", "_row", "extra")}
    )
    frame = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.stored(stage(spark, frame, sf), "test-clash")
        assert frame.columns == odd.columns, name
        assert {r.extra for r in frame.select("extra").distinct().collect()} == {"clash"}
    left = frame.groupBy("doc_id").count().collect()
    assert left and all(r["count"] == 1 for r in left)  # near-dedup leaves one of each repeated row
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in left}
