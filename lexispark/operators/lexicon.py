"""Joins of words with a dictionary: exact, without marks, by longest prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(entries: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return entries.groupBy(key).agg(F.min_by(value, order).alias(value))


def last_wins(entries: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return entries.groupBy(key).agg(F.max_by(value, order).alias(value))


def join_glosses(glosses: Column) -> Column:
    """Distinct glosses whatever the case, in order, joined by commas."""
    seen = lambda acc, x: F.exists(acc, lambda y: F.lower(y) == F.lower(x))
    return F.array_join(F.aggregate(glosses, F.slice(glosses, 1, 0), lambda acc, x: F.when(seen(acc, x), acc).otherwise(F.concat(acc, F.array(x)))), ", ")


def exact(words: DataFrame, lexicon: DataFrame, lemma: str = "lemma") -> DataFrame:
    """words with the definition of their own headword, if any."""
    return words.join(lexicon.select(F.col("headword").alias(lemma), "definition"), lemma, "left")


def _prefixes(c: Column, least: int) -> Column:
    return F.transform(F.sequence(F.lit(least), F.greatest(F.length(c), F.lit(least))), lambda n: F.substr(c, F.lit(1), n))


def longest_prefix(words: DataFrame, lexicon: DataFrame, lemma: str = "lemma", least: int = 4) -> DataFrame:
    """lemma, headword: the first headword, in order, that begins with the longest prefix
    of the lemma that any headword begins with; prefixes of ``least`` characters or more.

    Headwords are reduced to one for each prefix before the join, and lemmas are distinct."""
    heads = lexicon.where(F.length("headword") >= least).select("headword", F.explode(_prefixes(F.col("headword"), least)).alias("prefix"))
    heads = heads.groupBy("prefix").agg(F.min("headword").alias("headword"))
    own = words.select(lemma).distinct().where(F.length(lemma) >= least).select(lemma, F.explode(_prefixes(F.col(lemma), least)).alias("prefix"))
    return own.join(heads, "prefix").groupBy(lemma).agg(F.max_by("headword", F.length("prefix")).alias("headword"))


def lookup(words: DataFrame, lexicon: DataFrame, stripped: DataFrame, strip, lemma: str = "lemma", least: int = 4) -> DataFrame:
    """lemma, definition by the first stage that finds one: exact, without marks, prefix.
    Each later stage sees only what the one before missed."""
    heads = lexicon.select("headword", "definition")
    own = words.select(lemma).distinct()
    one = own.join(heads.withColumnRenamed("headword", lemma), lemma)
    miss = own.join(one.select(lemma), lemma, "left_anti")
    two = miss.withColumn("stripped", strip(F.col(lemma))).join(stripped, "stripped").join(heads, "headword").select(lemma, "definition")
    miss = miss.join(two.select(lemma), lemma, "left_anti")
    three = longest_prefix(miss, lexicon, lemma, least).join(heads, "headword").select(lemma, "definition")
    return one.unionByName(two).unionByName(three)


def by_form(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """lemma, form, occurrences: tokens (form) under every lemma that has the form. Tokens
    are counted before the join. forms: form, lemma."""
    counted = tokens.groupBy("form").agg(F.count("*").alias("occurrences"))
    return forms.select("form", "lemma").distinct().join(counted, "form").select("lemma", "form", "occurrences")
