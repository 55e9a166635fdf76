"""The pipeline's stages against plain decisions, and on awkward tables."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from corpusloom.llm import toxicity
from tests.llm import brute
from tests.llm.test_operators import DOCS, awkward, check_packing


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), DOCS).withColumn("row", F.lit(1)).withColumn("toxicity", F.lit("x"))


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_toxic_documents_go(spark, sf_dir, docs):
    kept = pipeline.reject_toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = toxicity.score_toxicity(docs, model).where(F.col("toxicity") < toxicity.THRESHOLD).drop("toxicity")
    assert rows_of(kept) == rows_of(want) and 0 < kept.count() < docs.count()


def test_lines_go(spark, sf_dir, docs):
    kept = pipeline.drop_lines(spark, docs, sf_dir)
    want = {i: (n, h) for i, _, n, h in brute.lines([tuple(r) for r in docs.select("doc_id", "text").collect()])}
    got = kept.collect()
    assert kept.columns == docs.columns and len(got) == docs.count()
    for r in got:
        assert brute.sha(r.text) == want[r.doc_id][1] and r.n_chars == len(r.text)


def test_one_of_each_group_stays(spark, sf_dir, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = Counter(i for i, n, c in brute.jaccard(rows, 5, 80) if i == c or n == 0)
    assert Counter(r.doc_id for r in pipeline.keep_one_of_each(spark, docs, sf_dir).collect()) == want


def test_contaminated_documents_go(spark, sf_dir, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = Counter(r[0] for r in brute.overlaps(rows, items) if not r[-1])
    assert Counter(r.doc_id for r in pipeline.drop_contaminated(spark, docs, sf_dir).collect()) == want


def test_awkward_tables(spark, sf_dir, odd):
    rows = awkward()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns and out.count() <= len(rows), name
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    check_packing(pipeline.pack_sequences(spark, odd, sf_dir), [r[:2] for r in rows])
    assert pipeline.pack_sequences(spark, odd.limit(0), sf_dir).count() == 0
    assert pipeline.drop_lines(spark, odd, sf_dir).where("text IS NULL").count() == sum(r[1] is None for r in rows)
    kept = pipeline.keep_one_of_each(spark, odd, sf_dir).collect()
    groups = defaultdict(int)
    for r in kept:
        if brute.words_of(r.text):
            groups[" ".join(brute.words_of(r.text))] += 1
    assert set(groups.values()) == {1}  # no two equal texts are left
    assert sum(not brute.words_of(r.text) for r in kept) == sum(not brute.words_of(r[1]) for r in rows)


def test_whole_pipeline(spark, sf_dir, docs):
    out = pipeline.run(spark, sf_dir)
    left = docs
    for _, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, sf_dir).cache()
    check_packing(out, [tuple(r) for r in left.select("doc_id", "text").collect()])
    assert 0 < left.count() < docs.count()
