"""The pipeline against each stage's own rule, on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import decontaminate, ngram_join, quality
from tallyloom.llm.storage import stored

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), name))
    return out


def _ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_columns_and_order(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scans", "source_mix"]
    assert all(frame.columns == steps[0].columns for frame in steps[:-1])
    assert all(steps[0].count() >= 1 and a.count() >= b.count() > 0 for a, b in zip(steps, steps[1:], strict=False))


def test_stages(spark, steps):
    docs, good, single, clean, safe, mixed = steps
    judged = quality.judge(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert _ids(judged.filter("kept")) == _ids(good)
    groups = ngram_join.near_duplicates(good)
    assert _ids(groups.filter("doc_id = component_id")) == _ids(single)
    dirty = decontaminate.contamination(single, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert _ids(dirty.filter("not contaminated")) == _ids(clean)
    assert _ids(safe) == _ids(clean) == _ids(mixed)
    assert safe.filter(F.col("text").rlike("(?i)password[=:] ?[a-z0-9]{8,}|AKIA[A-Z0-9]{12,}")).count() == 0
    assert safe.filter(F.length("text") != F.col("n_chars")).count() == clean.filter(F.length("text") != F.col("n_chars")).count()


def test_run(spark, steps):
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(str, steps[-1].collect()))


def test_odd_rows_pass_every_stage(spark, table):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row string, findings int, w_id int"
    text = " ".join(f"q{i}" for i in range(80))
    docs = table(schema, (1, text, None, None, None, "r", 1, 1), (1, text, None, None, None, "r", 1, 1), (None, None, None, None, None, None, None, None),
                 (None, text + " x", "en", "s", 5, "r", 1, 1), (4, "", "en", "s", 0, "r", 1, 1), (5, text.upper() + " token=abcdefgh1", "en", "s", 9, "r", 1, 1))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, FOLDER)
            assert name == "source_mix" or out.columns == docs.columns
            assert (out.count() > 0) == (rows is docs)
