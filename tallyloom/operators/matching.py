"""Match employees by name: the first and the last word of the name both occur as words of a text.

The lowest employee id wins. Names are reduced to distinct (first, last) pairs before anything is
joined, and joined by the rarer of the two words, so thousands of people who share a first name do not all
meet every text that holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import match_name, normalize_text, words


def employee_names(employees: DataFrame) -> DataFrame:
    """Active employees with the words they are matched by."""
    name = match_name(F.col("external_ref"), F.col("full_name"))

    def ends(tokens):
        return F.struct(F.get(tokens, F.lit(0)).alias("first_word"), F.get(tokens, F.size(tokens) - 1).alias("last_word"))

    # The words are bound in a lambda, so the name is cleaned once for both.
    both = F.transform(F.array(words(normalize_text(F.col("name")))), ends)
    return (employees.filter("is_active").select("id", name.alias("name")).filter(F.col("name").isNotNull())
            .select("id", "name", F.inline(both)).filter(F.col("first_word").isNotNull()))


def _name_pairs(names: DataFrame) -> DataFrame:
    """Distinct word pairs with their lowest id, keyed by the word fewer pairs share."""
    pairs = names.groupBy("first_word", "last_word").agg(F.min("id").alias("employee_id"))
    # The id is counted so that this reads the same exchange as the joins below.
    uses = (pairs.select("employee_id", F.explode(F.array_distinct(F.array("first_word", "last_word"))).alias("word"))
            .groupBy("word").agg(F.count("*").alias("uses")))
    first_uses = uses.select(F.col("word").alias("first_word"), F.col("uses").alias("first_uses"))
    last_uses = uses.select(F.col("word").alias("last_word"), F.col("uses").alias("last_uses"))
    rarer_first = F.col("first_uses") <= F.col("last_uses")
    return (pairs.join(first_uses, "first_word").join(last_uses, "last_word")
            .select("employee_id",
                    F.when(rarer_first, F.col("first_word")).otherwise(F.col("last_word")).alias("word"),
                    F.when(rarer_first, F.col("last_word")).otherwise(F.col("first_word")).alias("other")))


def match_employees(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """``key`` and ``employee_id`` of every text that names someone. ``key`` is unique per text.

    A text is read once: its words are cut down to words of names, gathered again per text, and only then
    joined to the pairs by their rarer word.
    """
    pairs = _name_pairs(names)
    name_words = names.select(F.explode(F.array("first_word", "last_word")).alias("word")).distinct()
    word = F.explode(F.array_distinct(words(normalize_text(F.col(text))))).alias("word")
    known = texts.select(key, word).join(name_words, "word").groupBy(key).agg(F.collect_list("word").alias("known"))
    candidates = known.select(key, "known", F.explode(F.concat("known")).alias("word")).join(pairs, "word")
    found = candidates.filter(F.array_contains("known", F.col("other")))
    return found.groupBy(key).agg(F.min("employee_id").alias("employee_id"))


def assign_employees(messages: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """Messages with a missing employee filled in from their text."""
    open_messages = messages.filter(F.col("employee_id").isNull())
    found = match_employees(open_messages, key, text, names).withColumnRenamed("employee_id", "_found")
    return (messages.join(found, key, "left")
            .withColumn("employee_id", F.coalesce("employee_id", "_found")).drop("_found"))
