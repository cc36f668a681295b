"""Quality rules: simple counts per text, then a log-likelihood ratio of hashed n-grams between good and raw text."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.storage import stored
from tallyloom.llm.words import blank_words, bound, whole

#: Classes that n-grams are hashed to. The weights, one number per class, are what reaches the driver.
CLASSES = 1 << 14
#: N-grams per class that the target is mixed with.
PRIOR = 2
#: Weights are whole millionths, so that sums do not depend on the order of addition.
UNIT = 1_000_000
#: One good document in this many, by a hash of the id, is not in the target; all of them set the threshold, which
#: lies a margin of the mean log-likelihood ratio per n-gram below the lowest hundredth of their ratios.
HELD_OUT, LOW_SHARE, MARGIN = 10, 0.01, 0.1
#: Ratios, in millionths, that are counted together before those around the lowest hundredth are told apart.
RATIO_STEP = 1000
#: Most ids of 8 bytes that are sent to the documents; with more the documents are shuffled to them.
SENT_IDS = 1 << 20
#: Base rules: fewest words, and most percent of words in repeated three-word windows.
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: Repeated hashes up to which a list is looked through; the result is the same either way.
SHORT_LIST = 32
_LINE_WITH_WORD = r"[^\x20\x09-\x0D]"


def _repeated(values: Column) -> Column:
    """Places of the values that occur more than once, from an array of (value, place)."""
    def twins(ranked: Column) -> Column:
        n = F.greatest(F.size(ranked) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(ranked, F.lit(1), n), F.slice(ranked, F.lit(2), n),
                           lambda a, b: F.when(a["value"] == b["value"], F.array(a["at"], b["at"])))
        return F.array_distinct(F.flatten(F.filter(pairs, lambda t: t.isNotNull())))

    return bound(F.array_sort(values), twins)


def _twice(ordered: Column) -> Column:
    """Values that follow themselves in an ordered array."""
    n = F.greatest(F.size(ordered) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(ordered, F.lit(1), n), F.slice(ordered, F.lit(2), n), lambda a, b: F.when(a == b, a))
    return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are hashed first, and only windows with a repeated hash are compared as words. Their places are looked
    up in the short list of repeated hashes; a text that repeats many orders hashes with places instead.
    """
    entry = lambda value, at: F.struct(value.alias("value"), at.alias("at"))

    def count(own: Column, hashes: Column) -> Column:
        def places(twice: Column) -> Column:
            met = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
            return F.when(F.size(twice) <= SHORT_LIST, met).otherwise(_repeated(F.transform(hashes, entry)))

        alike = bound(bound(F.sort_array(hashes), _twice), places)
        windows = F.transform(alike, lambda i: entry(F.concat_ws(" ", *(F.get(own, i + n) for n in range(3))), i))
        starts = _repeated(windows)
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(s, s + 1, s + 2)))))

    def of(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(own) - 3)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.get(own, i), F.get(own, i + 1), F.get(own, i + 2)))
        repeats = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), count(own, h)).otherwise(0)
        return F.when(F.size(own) >= 3, bound(hashes, repeats)).otherwise(0)

    return bound(words, of).cast("long")


def ngram_classes(words: Column, use: Callable[[Column, Column], Column], classes: int = CLASSES) -> Column:
    """``use`` of the class of each word and the class of it with the next word; the last word's pair ends in nothing."""
    cls = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(classes)).cast("int")
    pairs = lambda own: F.zip_with(own, F.slice(own, F.lit(2), F.size(own)), lambda a, b: use(cls(a), cls(b, a)))
    return bound(words, pairs)


def good_documents(labels: DataFrame, most: int | None, held_out: bool) -> DataFrame:
    """Ids of the documents with quality 1, either held out or not; with ``most``, the first so many by a hash of the id."""
    order = F.xxhash64("__good")
    ids = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__good")).distinct()
    ids = ids.filter((F.pmod(order, F.lit(HELD_OUT)) == 0) == held_out)
    return ids if most is None else ids.orderBy(order, "__good").limit(most)


def _counted(ids: DataFrame) -> DataFrame:
    """The ids, stored and counted: up to ``SENT_IDS`` go to the documents, for more the documents are shuffled to them."""
    kept = stored(ids, "good")
    return F.broadcast(kept) if kept.count() <= SENT_IDS else kept


def class_counts(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, classes: int, target: int | None) -> DataFrame:
    """Rows (class, raw, good): n-grams of the whole corpus and of the target documents in each class.

    Every document counts. Counts are combined in each task, so at most ``classes`` rows per task are shuffled.
    """
    good = _counted(good_documents(labels, target, held_out=False))
    rows = documents.select(F.col(doc_id).alias("__id"), whole(F.col(text)).alias("__body"))
    marked = rows.join(good, rows["__id"] == good["__good"], "left")
    both = ngram_classes(blank_words(F.col("__body")), F.array, classes)
    met = marked.select(F.when(F.col("__good").isNotNull(), 1).otherwise(0).alias("good"), F.explode(F.flatten(both)).alias("class"))
    return met.groupBy("class").agg(F.count("*").alias("raw"), F.sum("good").alias("good"))


def fit_weights(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                classes: int = CLASSES, target: int | None = None) -> list[int]:
    """Weight of every class in millionths: log of its share in the target over its share in the corpus.

    The target is every document with quality 1 that is not held out, or the first ``target`` of them.
    Its counts are joined by ``PRIOR`` n-grams per class that are dealt like the corpus, so a small target
    tells little and a weight without evidence is near zero. Without target documents all weights are zero.
    """
    counts = class_counts(documents, labels, doc_id, text, classes, target)
    found = {r["class"]: (r["raw"], r["good"]) for r in counts.collect()}  # at most ``classes`` rows
    raw, good = (sum(pair[i] for pair in found.values()) for i in (0, 1))
    if not good:
        return [0] * classes
    weights = []
    for c in range(classes):
        n_raw, n_good = found.get(c, (0, 0))
        usual = (n_raw + 1) / (raw + classes)
        weights.append(round(UNIT * log((n_good + PRIOR * classes * usual) / (good + PRIOR * classes) / usual)))
    return weights


def score_documents(documents: DataFrame, weights: list[int], text: str = "text") -> DataFrame:
    """``documents`` with the counts, ``ratio_sum`` and ``n_ngrams`` of each text."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folded to one literal
    body = whole(F.col(text))
    rows = documents.withColumn("__words", blank_words(body))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(_LINE_WITH_WORD))
    weight = lambda a, b: F.get(table, a) + F.get(table, b)
    ratio = F.aggregate(ngram_classes(F.col("__words"), weight, len(weights)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.withColumns({
        "n_words": F.size("__words").cast("long"), "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")), "ratio_sum": ratio,
        "n_ngrams": (2 * F.size("__words")).cast("long"),
    }).drop("__words")


def lowest_share(ratios: DataFrame, share: float) -> float | None:
    """The ratio, a column of whole numbers, that ``share`` of the rows lie below, as ``percentile`` interpolates it.

    The rows are counted by steps of ``RATIO_STEP``, then those of the step looked for by ratio: what reaches the
    driver is bounded by the spread of the ratios, not by their number. No row is left out.
    """
    step = F.floor(F.col("ratio") / RATIO_STEP)
    steps = sorted(ratios.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect())
    if not steps:
        return None

    def at(rank: int) -> int:
        before = 0
        for number, n in steps:
            if rank < before + n:
                break
            before += n
        inside = ratios.filter(step == number).groupBy("ratio").agg(F.count("*").alias("n"))
        for ratio, n in sorted(inside.collect()):  # at most ``RATIO_STEP`` rows
            before += n
            if rank < before:
                return ratio

    place = share * (sum(n for _, n in steps) - 1)
    low = at(floor(place))
    return low if place == floor(place) else low + (place - floor(place)) * (at(ceil(place)) - low)


def fit_threshold(documents: DataFrame, labels: DataFrame, weights: list[int], doc_id: str = "doc_id", text: str = "text") -> int:
    """Lowest ratio sum per n-gram, in millionths, with which a document stays.

    The margin below nothing, or below what held-out good documents of the base rules have when that is lower: with
    little text the target says less of good documents it has not seen. All that are held out count. They are stored
    first, so that the base rules are looked at for them only.
    """
    held = _counted(good_documents(labels, None, held_out=True))
    rows = documents.select(F.col(doc_id).alias("__id"), F.col(text).alias("text"))
    own = stored(rows.join(held, rows["__id"] == held["__good"], "left_semi").select("text"), "held-out")
    ratio = F.floor(F.col("ratio_sum") / F.col("n_ngrams")).alias("ratio")
    ratios = stored(score_documents(own, weights).filter(~_base_failed()).select(ratio), "ratios")
    return round(min(lowest_share(ratios, LOW_SHARE) or 0.0, 0.0) - MARGIN * UNIT)


def _base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float | None = None,
          classes: int = CLASSES, target: int | None = None) -> DataFrame:
    """``documents`` with their counts, ``base_failed``, ``score`` (mean ratio) and ``kept``.

    The target multinomial is fitted to all documents with quality 1 that are not held out, or to the first ``target``
    of them, the raw one to all documents.
    A document that fails no base rule is kept when its ratio sum reaches ``threshold`` per n-gram, compared in whole
    numbers; without a threshold all held-out good documents set it. NULL and empty texts have no words and
    fail; repeated rows are judged alike; without documents nothing is fitted; without good labels the ratio is zero
    everywhere and only the base rules decide. Added columns replace columns of the same names.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio_sum", "n_ngrams", "base_failed", "score", "kept")
    plain = documents.drop(*names)
    weights = fit_weights(plain, labels, doc_id, text, classes, target)
    least = fit_threshold(plain, labels, weights, doc_id, text) if threshold is None else round(threshold * UNIT)
    good = F.col("ratio_sum") >= F.lit(least) * F.col("n_ngrams")
    return score_documents(plain, weights, text).withColumns({
        "base_failed": _base_failed(), "kept": ~_base_failed() & good,
        "score": F.when(F.col("n_ngrams") > 0, F.col("ratio_sum") / F.col("n_ngrams") / UNIT)})


def kept_documents(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` that ``judge`` keeps, unchanged; columns named like counts are left alone."""
    names = documents.columns
    held = documents.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("__row"), F.col(doc_id).alias("__doc_id"),
                            F.col(text).alias("__text"))
    judged = judge(held, labels, "__doc_id", "__text", **options).filter("kept")
    return judged.select(*(F.col("__row").getField(n).alias(n) for n in names))
