"""Words that are one slip apart: a letter put in, left out or replaced, found by a join instead of a comparison of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import hangul

#: Words of more letters are only found as they are: every word has as many variants as letters.
LONGEST = 64


def letters(word: Column) -> Column:
    """A word as it is compared: in lower case, Hangul syllables taken apart."""
    return hangul.jamo(F.lower(word))


def variants(spelled: Column) -> Column:
    """The word and the word without each one of its letters, each once."""
    without = F.transform(F.sequence(F.lit(1), F.length(spelled)), lambda i: F.concat(F.substring(spelled, F.lit(1), i - 1), F.substring(spelled, i + 1, F.length(spelled))))
    return F.when(F.length(spelled).between(1, LONGEST), F.array_distinct(F.concat(F.array(spelled), without))).otherwise(F.array(spelled))


def slip_index(words: DataFrame, word: str) -> DataFrame:
    """(word, spelled, variant) of every distinct word: written once, it serves all searches. Null words are left out."""
    rows = words.select(F.col(word).alias("word")).filter("word IS NOT NULL").distinct().withColumn("spelled", letters(F.col("word")))
    return rows.select("word", "spelled", F.explode(variants(F.col("spelled"))).alias("variant"))


def near_words(typed: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """(typed, word, slips) of all words of the index at most one slip from a typed one; slips is 0 or 1.

    Two words one slip apart have a variant in common, so they meet in a join over
    variants, and only those that meet are compared. A variant is shared by few words of a
    language; a frequent one is split by Spark's skew join.
    """
    asked = slip_index(typed, column).select(F.col("word").alias("typed"), F.col("spelled").alias("_typed"), "variant")
    met = asked.join(index, "variant").select("typed", "_typed", "word", "spelled").distinct()
    return met.withColumn("slips", F.levenshtein("_typed", "spelled")).filter("slips <= 1").select("typed", "word", "slips")
