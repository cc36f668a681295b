"""Benchmark decontamination: winnowed fingerprints of test items looked up in training texts, hits extended word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.storage import stored
from tallyloom.llm.words import bound, plain_words, text_key, whole

#: Words that count as a copy when they stand in a document in this order.
WINDOW_WORDS = 13
#: Words of a fingerprinted gram; each window keeps the smallest hash of its ``WINDOW_WORDS - GRAM_WORDS + 1`` grams.
GRAM_WORDS = 5
#: A document is contaminated from this share of hit words on: 1 in 20.
SHARE = 20
#: Most texts, named by 64 characters and a few numbers each, that are sent to all documents; for more the documents are shuffled to them.
SENT_TEXTS = 1 << 16


def _longs() -> Column:
    return F.array().cast("array<bigint>")


def grams(words: Column, length: int, family: str) -> Column:
    """Hash of every run of ``length`` words; ``words`` is a column or bound, not an expression to repeat."""
    starts = F.sequence(F.lit(0), F.size(words) - length)
    hashed = F.transform(starts, lambda i: F.xxhash64(F.lit(family), *(F.get(words, i + n) for n in range(length))))
    return F.when(F.size(words) >= length, hashed).otherwise(_longs())


def minima(hashes: Column, width: int) -> Column:
    """Smallest of every ``width`` neighbouring hashes: one per window, the same for neighbours more often than not.

    Minima of 1, 2, 4, ... neighbours are combined until the width is reached.
    """
    def combined(values: Column, shift: int) -> Column:
        n = F.greatest(F.size(values) - shift, F.lit(0))
        return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(shift + 1), n), lambda a, b: F.least(a, b))

    def reach(values: Column, have: int) -> Column:
        if have == width:
            return values
        shift = min(have, width - have)
        return bound(values, lambda v: reach(combined(v, shift), have + shift))

    return reach(hashes, 1)


def _window(words: Column, start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def item_windows(items: DataFrame, item_id: str, text: str, window: int, gram: int) -> tuple[DataFrame, list[int]]:
    """Windows (item_id, length, window, fingerprint) of the items, and the lengths of those shorter than a window.

    An item shorter than a window is one window. For all of those one gram length serves, that of the shortest;
    the lengths, fewer than ``window`` numbers, reach the driver.
    """
    rows = items.select(F.col(item_id).alias("item_id"), plain_words(whole(F.col(text))).alias("words"))
    short = sorted(r[0] for r in rows.select(F.size("words").alias("n")).filter(f"n between 1 and {window - 1}").distinct().collect())
    starts = F.sequence(F.lit(0), F.size("words") - window)
    prints = lambda words: minima(grams(words, gram, "long"), window - gram + 1)
    cut = lambda words, found: F.transform(starts, lambda i: F.struct(
        F.lit(window).alias("length"), _window(words, i, window).alias("window"), F.get(found, i).alias("fingerprint")))
    both = bound(F.col("words"), lambda words: bound(prints(words), lambda found: cut(words, found)))
    windows = rows.filter(F.size("words") >= window).select("item_id", F.explode(both).alias("w")).select("item_id", "w.*")
    if short:
        one = rows.filter(F.size("words").between(1, window - 1)).select(
            "item_id", F.size("words").alias("length"), F.array_join("words", " ").alias("window"),
            F.array_min(grams(F.col("words"), short[0], "short")).alias("fingerprint"))
        windows = windows.unionByName(one)
    return windows, short


def fingerprints(words: Column, window: int, gram: int, short: list[int]) -> Column:
    """Distinct fingerprints of a training text; the grams of short items are not winnowed, so that none is missed."""
    def kept(own: Column) -> Column:
        winnowed = F.array_distinct(minima(grams(own, gram, "long"), window - gram + 1))
        return F.array_union(winnowed, grams(own, short[0], "short")) if short else winnowed

    return bound(words, kept)


def _extended(words: Column, found: Column, window: int, gram: int, short: list[int]) -> Column:
    """Windows (start, length, window) of a text whose fingerprint is among the found ones."""
    def cut(own: Column, prints: Column, length: int) -> Column:
        kept = F.filter(F.transform(prints, lambda p, i: F.when(F.array_contains(found, p), i)), lambda i: i.isNotNull())
        return F.transform(kept, lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"),
                                                    _window(own, i, length).alias("window")))

    def parts(own: Column) -> Column:
        found_at = [cut(own, minima(grams(own, gram, "long"), window - gram + 1), window)]
        found_at += [cut(own, minima(grams(own, short[0], "short"), n - short[0] + 1), n) for n in short]
        return F.concat(*found_at)

    return bound(words, parts)


def _counted(texts: DataFrame, name: str) -> DataFrame:
    """The rows of texts, stored and counted: up to ``SENT_TEXTS`` go to the documents, so that those are not shuffled."""
    kept = stored(texts, name)
    return F.broadcast(kept) if kept.count() <= SENT_TEXTS else kept


def hits(documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """One row (text_key, spans, items) per distinct training text that shares a window with an item.

    ``spans`` are the (start, end) of the shared windows in words, ``items`` the ids of the items they are from.
    A run of ``window`` shared words has the same smallest gram on both sides, so no shared run is missed.
    Fingerprints are joined first, keys only; texts with a common one are read again, and the windows
    around their common grams are compared word by word. Copies of a text are one text after the first step.
    """
    windows, short = item_windows(items, item_id, item_text, window, gram)
    rows = documents.select(text_key(F.col(text)).alias("text_key"), whole(F.col(text)).alias("body"))
    words = rows.select("text_key", plain_words(F.col("body")).alias("words"))
    prints = words.select("text_key", F.explode(fingerprints(F.col("words"), window, gram, short)).alias("fingerprint"))
    common = (prints.join(windows.select("fingerprint").distinct(), "fingerprint", "left_semi")
              .groupBy("text_key").agg(F.collect_set("fingerprint").alias("found")))
    again = rows.join(_counted(common, "common"), "text_key").select("text_key", "found", plain_words(F.col("body")).alias("words"))
    shared = (again.select("text_key", F.explode(_extended(F.col("words"), F.col("found"), window, gram, short)).alias("w"))
              .select("text_key", "w.start", "w.length", "w.window").distinct())
    met = shared.join(windows.select("item_id", "window", "length").distinct(), ["window", "length"])
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    return met.groupBy("text_key").agg(F.collect_set(span).alias("spans"), F.collect_set("item_id").alias("items"))


def covered(spans: Column) -> Column:
    """Words inside any of the spans."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["upto"], s["end"]).alias("upto"),
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["upto"], s["start"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def contamination(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", share: int = SHARE,
                  window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """One row per document: words, hit words, ids of the items it holds windows of, and whether it is contaminated.

    A document is contaminated when at least one word, and one word in ``share``, is hit. Equal texts share a result
    and repeated documents keep their rows. NULL and empty texts have no words and are clean; items without
    words match nothing; without items all documents are clean. An item without an id hits words but is
    not listed; items with one id count once. Only the named columns are read.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"),
                            F.size(plain_words(whole(F.col(text)))).cast("long").alias("n_words"))
    found = hits(documents, items, text, item_id, item_text, window, gram).select(
        "text_key", covered(F.col("spans")).alias("n_hit"), "items")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("items", F.array().cast(dict(found.dtypes)["items"]))
    return rows.join(found, "text_key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "text_key")


def clean_documents(documents: DataFrame, items: DataFrame, text: str = "text", share: int = SHARE, **options) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, unchanged."""
    dirty = hits(documents, items, text, **options).select(F.col("text_key").alias("dirty_key"), covered(F.col("spans")).alias("n_hit"))
    names = documents.columns
    held = documents.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), text_key(F.col(text)).alias("key"),
                            F.size(plain_words(whole(F.col(text)))).alias("n_words"))
    joined = held.join(_counted(dirty, "dirty"), F.col("key") == F.col("dirty_key"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    left = joined.filter(~((n_hit > 0) & (n_hit * share >= F.col("n_words"))))
    return left.select(*(F.col("row").getField(n).alias(n) for n in names))
