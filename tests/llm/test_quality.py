from __future__ import annotations

import re
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import quality

DOCS = "doc_id long, text string, score string, kept int, __row int"
LABELS = "doc_id long, quality int, toxic int"


def _brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@pytest.fixture(scope="module")
def odd():
    return [None, "", " \t\n", "a", "a b", "a b c a b c", "x\n\nx\n x\nx", "é ß # *$%", "w " * 120000, " ".join(f"w{i % 700}" for i in range(60000)),
            "\n".join(["same line here", "other"] * 60), " ".join(f"q{i}" for i in range(300))]


def test_counts_against_brute_force(table, odd):
    rows = table(DOCS, *((n, t, "s", 1, 2) for n, t in enumerate(odd)))
    judged = quality.judge(rows, table(LABELS)).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in NAMES) for r in judged] == [_brute(t) for t in odd]


def test_sample_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    judged = quality.judge(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).collect()
    assert all(tuple(r[n] for n in NAMES) == _brute(r["text"]) for r in judged)


def test_ratio_against_brute_force(spark, table):
    texts = ["good words here and there " * 12, "bad bad |||| junk " * 20, "good and there", "", None, "good words here and there " * 12]
    docs = table("doc_id long, text string", *enumerate(texts))
    labels = table(LABELS, (0, 1, 0), (0, 1, 0), (1, 0, 0), (2, 1, 1), (None, 1, 0))
    weights = quality.fit_weights(docs, labels, classes=64)

    def classes(text):
        words = (text or "").split()
        pairs = spark.createDataFrame([(w, v) for w, v in zip(words, [*words[1:], None], strict=False)], "a string, b string")
        rows = pairs.select(F.pmod(F.xxhash64("a"), F.lit(64)), F.pmod(F.xxhash64("b", "a"), F.lit(64))).collect()
        return Counter(c for r in rows for c in r)

    each = [classes(t) for t in texts]
    held = {r[0] for r in quality.good_documents(labels, 10, held_out=True).collect()}
    raw, good = sum(each, Counter()), sum((each[n] for n in (0, 2) if n not in held), Counter())
    usual = [(raw[c] + 1) / (raw.total() + 64) for c in range(64)]
    prior = quality.PRIOR * 64
    want = [1e6 * (log(good[c] + prior * u) - log(good.total() + prior) - log(u)) for c, u in enumerate(usual)]
    assert all(abs(w - x) <= 1 for w, x in zip(weights, want, strict=True))
    want = weights
    judged = quality.judge(docs, labels, classes=64).orderBy("doc_id").collect()
    assert [r["ratio_sum"] for r in judged] == [sum(want[c] * n for c, n in e.items()) for e in each]
    assert not judged[3]["kept"] and judged[3]["score"] is None


def test_kept_rows_are_unchanged(table):
    text = " ".join(f"q{i}" for i in range(60))
    docs = table(DOCS, (1, text, "a", 1, 2), (1, text, "a", 1, 2), (None, text, None, None, None), (3, "short", "b", 1, 2))
    kept = quality.kept_documents(docs, table(LABELS))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("doc_id is null or doc_id = 1").collect()))
    assert quality.kept_documents(docs.limit(0), table(LABELS)).count() == 0


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    fitted, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    judged = quality.judge(docs, fitted).join(held, "doc_id").filter("not base_failed")
    rates = {r["quality"]: r["rate"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] >= 0.99 and rates[0] <= 0.7


def test_every_good_document_counts(spark, monkeypatch):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (F.col("doc_id") % 97 + 1) * i)))
    docs = spark.range(12000).select(F.col("id").alias("doc_id")).withColumn("text", words)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    held = quality.good_documents(labels, None, held_out=True).count()
    assert 1000 < held < 5000 < 12000 - held
    counts = quality.class_counts(docs, labels, "doc_id", "text", 64, None).agg(F.sum("good"), F.sum("raw")).first()
    assert tuple(counts) == (120 * (12000 - held), 120 * 12000)
    seen = []
    monkeypatch.setattr(quality, "lowest_share", lambda ratios, share: seen.append((ratios.count(), share)))
    assert quality.fit_threshold(docs, labels, quality.fit_weights(docs, labels, classes=64)) == -100000
    assert seen == [(held, 0.01)]


def test_lowest_share(spark, monkeypatch):
    values = spark.range(5000).select(((F.col("id") * 7919) % 5003 - 3000).alias("ratio"))
    for rows in (values, values.limit(1), values.limit(2), values.withColumn("ratio", F.floor(F.col("ratio") / 700))):
        for share in (0.0, 0.01, 0.5, 1.0):
            want = rows.agg(F.percentile("ratio", F.lit(share))).first()[0]
            for step in (1, 50, 1000):
                monkeypatch.setattr(quality, "RATIO_STEP", step)
                assert quality.lowest_share(rows, share) == pytest.approx(want)
    assert quality.lowest_share(values.limit(0), 0.01) is None


def test_documents_shuffled_when_good_ones_are_many(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.union(docs.limit(5)).union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    sent = sorted(map(str, quality.judge(docs, labels).collect()))
    monkeypatch.setattr(quality, "SENT_IDS", -1)
    assert sorted(map(str, quality.judge(docs, labels).collect())) == sent
