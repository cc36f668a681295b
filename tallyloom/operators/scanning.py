"""Substring scan of texts against a table of phrases.

Written as one join on ``contains`` this is a nested loop over texts x phrases. Here it is one join by equality:
every phrase gets an anchor. That is an inner word few rules share, which a text that holds the phrase
has as a whole word; for other phrases a substring of 8, 4, 3, 2 or 1 letters, the longest size that
fits. A text is unfolded into its distinct words, and substrings of the sizes in use, joined to the
anchors and checked with ``contains``. Only keys travel through the join; the texts are joined once more by key
for the check. Spark broadcasts the anchors where their size in bytes allows it, and otherwise shuffles and splits
frequent anchors at run time. A caller with a handful of rules can have them tested in place (``in_place``): then
they become one constant of the plan and no text is shuffled. The results are the same.

A text is unfolded into each anchor once and a phrase has one anchor, so a (text, phrase) pair comes up once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallyloom.functions.text import grams, normalize_text

GRAM_SIZES = (8, 4, 3, 2, 1)
RULES_PER_WORD = 8
WORD_MARK = "\n"

_RULES = "array<struct<keyword_id: bigint, matched_phrase: string, label: string, norm_phrase: string>>"


def active_rules(keywords: DataFrame) -> DataFrame:
    """Active rules with their normalised phrase; a phrase that normalises to nothing matches nothing."""
    return (keywords.filter("is_active")
            .select(F.col("id").alias("keyword_id"), F.col("phrase").alias("matched_phrase"), "label",
                    normalize_text(F.col("phrase")).alias("norm_phrase"))
            .filter("norm_phrase <> ''"))


def _inline_hits(text: Column, rules: list[Row]) -> Column:
    """Array of the rules found in a text. The rules travel in the plan as one constant array."""
    constant = F.from_json(F.lit(json.dumps([rule.asDict() for rule in rules])), _RULES)
    found = F.filter(constant, lambda rule: F.contains(text, rule["norm_phrase"]))
    return F.transform(found, lambda rule: F.struct(
        rule["keyword_id"].alias("keyword_id"), rule["matched_phrase"].alias("matched_phrase"),
        rule["label"].alias("label")))


def _marked_words(words: Column) -> Column:
    """Distinct words with a mark that no substring of a normalised text can end with."""
    return F.array_distinct(F.transform(words, lambda word: F.concat(word, F.lit(WORD_MARK))))


def frequent_words(texts: DataFrame, text: str, words: int = 1000, tracked: int = 100_000) -> DataFrame:
    """``anchor`` and about how many texts hold it, of the most frequent words of normalised texts.

    A sketch of bounded size, combined in each task, in one pass over all texts. It says which anchors to avoid and decides no hit, so
    it may be made once for a corpus and kept.
    """
    held = texts.select(F.explode(_marked_words(F.split(normalize_text(F.col(text)), " "))).alias("word"))
    top = held.agg(F.expr(f"approx_top_k(word, {int(words)}, {int(tracked)})").alias("top"))
    return top.select(F.inline("top").alias("anchor", "n_texts")).select("anchor", F.col("n_texts").cast("bigint").alias("n_texts"))


def _anchored(rules: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """Rules with their anchor.

    An inner word that few rules hold comes first, the longest of them; it spares unfolding the texts into
    substrings. Where every inner word is common among the rules, the candidate fewest rules hold is
    taken, so phrases that differ in little still get different anchors. With ``frequent``, a word that is frequent in
    the texts is taken only where a rule has nothing else, the least frequent first.
    """
    phrase_words = F.split("norm_phrase", " ")
    inner = F.slice(phrase_words, 2, F.greatest(F.size(phrase_words) - 2, F.lit(0)))
    substrings = F.lit(None).cast("array<string>")
    for size in GRAM_SIZES:
        substrings = F.coalesce(
            substrings, F.when(F.length("norm_phrase") >= size, grams(F.col("norm_phrase"), size)))
    choices = rules.select("keyword_id", F.explode(F.concat(_marked_words(inner), substrings)).alias("anchor"))
    uses = choices.groupBy("anchor").agg(F.count("*").alias("uses"))
    good_word = F.endswith("anchor", F.lit(WORD_MARK)) & (F.col("uses") <= RULES_PER_WORD)
    shorter = -F.length("anchor").cast("bigint")
    if frequent is None:
        choices = choices.withColumn("n_texts", F.lit(0).cast("bigint"))
    else:
        # A substring of a frequent word is in at least as many texts.
        marked = choices.join(frequent.select("anchor", "n_texts"), "anchor", "left")
        words = F.filter(F.transform("known", lambda k: F.struct(F.rtrim(k["anchor"], F.lit(WORD_MARK)).alias("w"), k["n_texts"].alias("n"))),
                         lambda k: F.contains(k["w"], F.col("anchor")))
        known = marked.filter(F.col("n_texts").isNotNull()).groupBy("keyword_id").agg(F.collect_set(F.struct("anchor", "n_texts")).alias("known"))
        inside = F.coalesce(F.array_max(F.transform(words, lambda k: k["n"])), F.lit(0).cast("bigint"))
        choices = marked.join(known, "keyword_id", "left").select("keyword_id", "anchor", F.coalesce("n_texts", inside).alias("n_texts"))
    preferred = F.struct(
        "n_texts",
        F.when(good_word, 0).otherwise(1).alias("rank"), F.when(good_word, shorter).otherwise(F.col("uses")).alias("first"),
        F.when(good_word, F.col("uses")).otherwise(shorter).alias("second"), "anchor")
    chosen = (choices.join(uses, "anchor").groupBy("keyword_id")
              .agg(F.min(preferred)["anchor"].alias("anchor")))
    return rules.join(chosen, "keyword_id")


def _kinds_in_use(anchored: DataFrame) -> list[int]:
    """Substring sizes among the anchors, 0 for whole words; at most one value per kind."""
    kind = F.when(F.endswith("anchor", F.lit(WORD_MARK)), 0).otherwise(F.length("anchor"))
    return sorted(row[0] for row in anchored.select(kind).distinct().collect())


def _anchors_of(text: Column, kinds: list[int]) -> Column:
    """All distinct words or substrings of a text that can be an anchor."""
    closed = F.replace(F.concat(text, F.lit(" ")), F.lit(" "), F.lit(f"{WORD_MARK} "))
    return F.concat(*[grams(text, size) if size else F.array_distinct(F.split(closed, " ")) for size in kinds])


def _candidates(norm: DataFrame, key: str, anchored: DataFrame) -> DataFrame:
    """Texts (their key) and rules whose anchor they hold."""
    kinds = _kinds_in_use(anchored)
    found = _anchors_of(F.col("norm_text"), kinds) if kinds else F.array().cast("array<string>")
    return norm.select(key, F.explode(found).alias("anchor")).join(anchored, "anchor").drop("anchor")


def find_phrases(texts: DataFrame, key: str, text: str, keywords: DataFrame, *, keep: tuple[str, ...] = (),
                 in_place: bool = False, frequent: DataFrame | None = None) -> DataFrame:
    """All (text, rule) hits: ``key``, the columns to ``keep``, keyword_id, matched_phrase, label.

    ``key`` is unique per text. With ``in_place`` all active rules are brought into the plan. ``frequent`` is a result of
    ``frequent_words``; it changes which texts are looked at, not what is found.
    """
    rules = active_rules(keywords)
    norm = texts.select(key, *keep, normalize_text(F.col(text)).alias("norm_text"))
    if in_place:
        return norm.select(key, *keep, F.inline(_inline_hits(F.col("norm_text"), rules.collect())))
    candidates = _candidates(norm, key, _anchored(rules, frequent)).join(norm, key)
    return (candidates.filter(F.contains("norm_text", "norm_phrase"))
            .select(key, *keep, "keyword_id", "matched_phrase", "label"))


def count_phrases(texts: DataFrame, key: str, text: str, keywords: DataFrame, *, in_place: bool = False) -> DataFrame:
    """Number of hits of every text, zero included."""
    if in_place:
        norm = texts.select(key, normalize_text(F.col(text)).alias("norm_text"))
        hits = F.size(_inline_hits(F.col("norm_text"), active_rules(keywords).collect()))
        return norm.select(key, hits.cast("bigint").alias("n_notes"))
    counts = find_phrases(texts, key, text, keywords).groupBy(key).agg(F.count("*").alias("n_notes"))
    return texts.select(key).join(counts, key, "left").select(
        key, F.coalesce("n_notes", F.lit(0).cast("bigint")).alias("n_notes"))
