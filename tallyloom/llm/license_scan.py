"""License scan: an exact containment join between blocks of text and license templates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.words import plain_words, text_key, whole

# Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening words of common license notices, by label.
TEMPLATES = {
    "agpl": "this program is licensed under the gnu affero general public license",
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl": "this work is licensed under the gnu general public license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
}
#: The templates with short notices of the same licenses; what follows a slash only tells templates of one label apart.
NOTICES = TEMPLATES | {
    "agpl/short": "affero general public license", "apache/short": "apache license", "bsd/short": "bsd license",
    "bsd/2": "bsd 2 clause", "bsd/3": "bsd 3 clause", "cc-by": "licensed under cc by 4 0", "gpl/short": "gnu general public license",
    "mit/short": "mit license", "mpl/short": "mozilla public license",
}
#: Words that must stand consecutively in a block, by template: what tells it from the notices of its siblings.
TELLING = {
    "agpl": "affero general public license", "agpl/short": "affero general public license", "apache/short": "apache license",
    "bsd/short": "bsd license", "bsd/2": "bsd 2 clause", "bsd/3": "bsd 3 clause", "cc-by": "cc by", "cc-by-nc": "cc by nc",
    "cc-by-sa": "cc by sa", "gpl": "gnu general public license", "gpl/short": "gnu general public license",
    "mit/short": "mit license", "mpl/short": "mozilla public license",
}
#: A block matches from this share of a template's distinct words on.
PERCENT = 80
#: Blocks are at least this many words, and twice the longest template; they start at every half of it, so each run of half a
#: block and one word lies in one whole.
BLOCK_WORDS = 48


def _texts(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def phrase_starts(words: Column, phrase: str) -> Column:
    """Positions, from 0, where the phrase's words stand consecutively."""
    first, *rest = phrase.split()

    def stands(word: Column, at: Column) -> Column:
        found = word == first
        for n, other in enumerate(rest, 1):
            found = found & F.coalesce(F.get(words, at + n) == other, F.lit(False))
        return F.when(found, at)

    starts = F.filter(F.transform(words, stands), lambda at: at.isNotNull())
    return F.when(F.array_contains(words, first), starts).otherwise(F.array().cast("array<int>"))


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda at: F.struct(at.alias("at"), F.lit(label).alias("label")))


def _order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, the one in the fewest documents first; one row per template word reaches the driver."""
    met = words.select(F.explode(F.array_intersect("words", _texts(vocabulary))).alias("word"))
    counts = dict(met.groupBy("word").count().collect())
    return sorted(vocabulary, key=lambda word: (counts.get(word, 0), word))


def matching_blocks(documents: DataFrame, text: str = "text", templates: Mapping[str, str] = TEMPLATES,
                    percent: int = PERCENT, block_words: int | None = None, telling: Mapping[str, str] | None = None) -> DataFrame:
    """Rows (text_key, block, label, containment) for every block that holds ``percent`` of a template's distinct words.

    Words of the templates are ordered by the number of documents that hold them. With ``o`` words needed
    of ``n``, a matching block holds one of the template's ``n - o + 1`` rarest words (prefix), at least ``o`` template
    words (length), and ``o`` words from the rarest shared one on (position). What is left is counted exactly.
    Of a template in ``telling`` the block also holds those words consecutively; a label is a template's name up to a slash.
    Words of no template are never needed, so a block is reduced to its template words before it is
    shuffled. Templates are a parameter of bounded size; their words are literals.
    """
    block_words = block_words or max(BLOCK_WORDS, 2 * max((len(t.split()) for t in templates.values()), default=0))
    if block_words < 2:
        raise ValueError("a block has at least two words")
    spark = documents.sparkSession
    sets = {label: set(words.split()) for label, words in templates.items() if words.split()}
    schema = "text_key string, block long, label string, containment double"
    if not sets:
        return spark.createDataFrame([], schema)
    vocabulary = sorted(set().union(*sets.values()))
    words = documents.select(text_key(F.col(text)).alias("text_key"), plain_words(whole(F.col(text))).alias("words"))
    order = _order(words, vocabulary)
    place = {word: n for n, word in enumerate(order)}
    needed = {label: -(-percent * len(own) // 100) for label, own in sets.items()}
    index = []
    for label, own in sets.items():
        ranked = sorted(own, key=place.get)
        index += [(word, label, at, ranked, needed[label]) for at, word in enumerate(ranked[:len(own) - needed[label] + 1])]
    rare = _texts(sorted({row[0] for row in index}))
    step = block_words // 2
    hits = F.filter(F.transform("words", lambda w, at: F.when(F.array_contains(rare, w), F.floor(at / step))),
                    lambda at: at.isNotNull())
    blocks = F.array_distinct(F.flatten(F.transform(hits, lambda b: F.array(b, F.greatest(b - 1, F.lit(0))))))
    # Whole words between blanks: what is told is looked up before the block is reduced.
    spaced = F.concat(F.lit(" "), F.array_join("part", " "), F.lit(" "))
    phrases = {label: f" {words} " for label, words in (telling or {}).items() if label in sets}
    told = F.filter(F.array(*(F.when(spaced.contains(phrase), F.lit(label)) for label, phrase in phrases.items())).cast("array<string>"),
                    lambda label: label.isNotNull())
    found = (words.filter(F.arrays_overlap("words", rare))
             .select("text_key", "words", F.explode(blocks).alias("block"))
             .select("text_key", "block", F.slice("words", (F.col("block") * step + 1).cast("int"), block_words).alias("part"))
             .select("text_key", "block", F.array_intersect(_texts(order), "part").alias("ranked"), told.alias("told"))
             .filter(F.size("ranked") >= min(needed.values())))
    probes = found.select("*", F.posexplode("ranked").alias("at", "word")).filter(F.array_contains(rare, F.col("word")))
    fields = T.StructType([T.StructField("word", T.StringType()), T.StructField("label", T.StringType()),
                           T.StructField("template_at", T.IntegerType()),
                           T.StructField("template", T.ArrayType(T.StringType())), T.StructField("needed", T.IntegerType())])
    joined = probes.join(spark.createDataFrame(index, fields), "word")
    left = F.least(F.size("template") - F.col("template_at"), F.size("ranked") - F.col("at"))
    shared = F.size(F.array_intersect("template", "ranked"))
    return (joined.filter((F.size("ranked") >= F.col("needed")) & (left >= F.col("needed")))
            .withColumn("shared", shared).filter(F.col("shared") >= F.col("needed"))
            .filter(~F.col("label").isin(list(phrases)) | F.array_contains("told", F.col("label")))
            .select("text_key", "block", F.substring_index("label", "/", 1).alias("label"), (F.col("shared") / F.size("template")).alias("containment")).distinct())


def scan_licenses(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES,
                  phrases: Mapping[str, str] = PHRASES, percent: int = PERCENT, block_words: int | None = None,
                  telling: Mapping[str, str] | None = None) -> DataFrame:
    """One row per document: places of the phrases, their labels, the labels of matching templates too, and a score.

    The score is 1 where a phrase stands, else the largest containment of a matching template, else 0. Blocks are
    joined back by a key of the text: equal texts have equal results, and repeated documents keep
    their rows. NULL and empty texts have no words and no labels. Only the named columns are read, so other names
    cannot clash.
    """
    words = plain_words(whole(F.col(text)))
    rows = documents.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"), words.alias("words"))
    places = F.concat(*(_labelled(phrase_starts(F.col("words"), phrase), label) for phrase, label in phrases.items()))
    base = rows.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), places.alias("places"))
    blocks = matching_blocks(documents, text, templates, percent, block_words, telling)
    method = blocks.groupBy("text_key").agg(F.collect_set("label").alias("method"), F.max("containment").alias("containment"))
    own = F.transform("places", lambda p: p["label"])
    joined = F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.coalesce("method", F.array().cast("array<string>"))))), ",")
    return base.join(method, "text_key", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"), joined.alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))
