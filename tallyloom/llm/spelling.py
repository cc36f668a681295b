"""Spelling variants: words one edit apart, each with the much commoner word that it is likely a variant of.

Reduced alphabet. Letters are hashed to four symbols. Of every word the reduced word, all its one-symbol replacements and
all its one-symbol deletions are generated; those are joined to the reduced words of the vocabulary, and a pair
counts only if the original strings are one insertion, deletion or replacement apart. Insertions need no rows of their own:
they are the deletions of the longer word, and every pair found is taken in both directions.

Few symbols alone would let many words meet. An edit leaves the letters before or after it as they are, so a key
also holds the half of the word that the generated edit did not touch, in its own letters. A group of equal keys
holds words that agree in that half letter by letter and in the other half by symbol, whatever the size of the corpus.

NULL and empty texts have no words; a NULL id counts as empty in the damage rule; repeated rows count each time;
no rows give no words; further columns of the documents are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.storage import stored
from tallyloom.llm.words import ascii_lower

LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
SYMBOLS = "0123"
SHORTEST = 7
LEAST_COUNT = 2
FORM_RATIO = 10
SPOILT_ONE_IN = 31
# A run shorter than the shortest word can't become one, so it is not even taken out of the text.
RUN = rf"[A-Za-z\x{{C0}}-\x{{FF}}]{{{SHORTEST},}}"


def reduced(word: Column) -> Column:
    """The word in symbols; neighbours in the alphabet differ."""
    return F.translate(word, LETTERS, "".join(SYMBOLS[n % len(SYMBOLS)] for n in range(len(LETTERS))))


def _without(text: Column, at: Column) -> Column:
    """The text without its letter ``at``, counted from 0."""
    return F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + 2, F.length(text)))


def spoilt_runs(documents: DataFrame) -> DataFrame:
    """Words of all texts as rows; one of 31 (document, run) loses a letter."""
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    lowered = runs.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    hashed = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    marked = lowered.select("run", hashed.alias("h"))
    shorter = _without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))
    return marked.select(F.when(F.col("h") % SPOILT_ONE_IN == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """Words of at least seven letters that occur at least twice, with their counts."""
    return (words.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= LEAST_COUNT))


def _key(symbols: Column, side: str, letters: Column) -> Column:
    return F.xxhash64(F.concat(symbols, F.lit(side), letters))


def _own_keys() -> Column:
    """The reduced word with its first and with its second half in letters."""
    word, symbols, half = F.col("word"), F.col("symbols"), F.floor(F.length("word") / 2).cast("int")
    return F.array(_key(symbols, "<", F.substring(word, F.lit(1), half)),
                   _key(symbols, ">", F.substring(word, half + 1, F.length(word))))


def _edited_keys() -> Column:
    """Every replacement by a higher symbol and every deletion, with the half of the letters that the edit leaves alone.

    Of two words that differ in one symbol, the one with the lower symbol generates the other.
    """
    word, symbols, size = F.col("word"), F.col("symbols"), F.length("word")

    def untouched(at: Column, kept: Column, edited: Column) -> Column:
        """``kept`` letters of the result stand in its first half."""
        return F.when(at >= kept, _key(edited, "<", F.substring(word, F.lit(1), kept))).otherwise(
            _key(edited, ">", F.substring(word, kept + 1 + size - F.length(edited), size)))

    positions = F.sequence(F.lit(0), size - 1)
    half, shorter_half = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")

    def replaced(symbol: str) -> Column:
        def at_each(at: Column) -> Column:
            own = F.substring(symbols, at + 1, F.lit(1))
            other = F.concat(F.substring(symbols, F.lit(1), at), F.lit(symbol), F.substring(symbols, at + 2, size))
            return F.when(own < symbol, untouched(at, half, other))

        return F.transform(positions, at_each)

    deleted = F.transform(positions, lambda at: untouched(at, shorter_half, _without(symbols, at)))
    return F.array_distinct(F.array_compact(F.concat(*[replaced(s) for s in SYMBOLS[1:]], deleted)))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (word, n, other, other_n) of different words exactly one edit apart, in both directions, each once."""
    coded = words.withColumn("symbols", reduced(F.col("word")))
    known = coded.select(F.explode(_own_keys()).alias("key"), "word", "n")
    edited = coded.select(F.explode(_edited_keys()).alias("key"), "word", "n")
    # Words with equal symbols meet here too, each pair from its smaller word.
    asking = edited.withColumn("same", F.lit(False)).unionByName(known.withColumn("same", F.lit(True)))
    other = known.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = asking.join(other, "key").filter(~F.col("same") | (F.col("word") < F.col("other")))
    found = met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")
    back = found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"),
                        F.col("n").alias("other_n"))
    return found.unionByName(back).distinct()


def followed(forms: DataFrame) -> DataFrame:
    """``word`` and the ``root`` its forms lead to, for words that have a form.

    A form is at least ten times as common, so a chain of counts has few steps, and each round doubles the steps taken.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_step = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = stored(roots.join(next_step, "root", "left").select("word", "root", "further"), "roots")
        if jumped.filter(F.col("further").isNotNull()).isEmpty():
            return roots
        roots = jumped.select("word", F.coalesce("further", "root").alias("root"))


def spelling_variants(documents: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the documents (doc_id, text)."""
    words = stored(vocabulary(spoilt_runs(documents)), "vocabulary")
    pairs = near_pairs(words)
    # Counts descend, ties ascend in code-point order, so the first struct is the form.
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"),
                                     F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    likely = -F.col("best.m") >= FORM_RATIO * F.col("n")
    judged = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(likely, F.col("best.other")).alias("form"), F.when(likely, -F.col("best.m")).alias("form_n")), "judged")
    roots = followed(judged.filter(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
