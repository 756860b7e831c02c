"""Words near the words of a list, by the strings that both become when letters are left out.

Two words within k edits have a string in common that each becomes by leaving
out k letters at most. So each word of the list and each distinct word of the
text is written with all of its shorter forms, equal forms meet in a join, and
the edit distance is computed only for pairs that meet. The list is a table
like any other: the plan is the same for eight words and for a hundred thousand.
A word of n letters has n forms with one letter less and at most n(n-1)/2 with
two; words longer than any of the list by more than its edits cannot be near
and are left out first.

Defined results: equal words are at distance 0; null words are left out, the
empty one is a word; repeated words count once on both sides, a word that the
list has with several budgets with the largest; letters are code points, and
case counts; an empty list or table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import tokens

MOST = 2


def shorter(word: Column) -> Column:
    """The word without each of its letters in turn; none for the empty word."""
    places = F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def forms(word: Column, most: int = MOST) -> Column:
    """The word and what is left of it without up to ``most`` letters."""
    level, out = F.array(word), F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.array_union(out, level)
    return out


def distinct_words(rows: DataFrame, column: str) -> DataFrame:
    """The distinct words between white space."""
    return rows.select(F.explode(tokens(F.col(column))).alias("word")).distinct()


def near_words(words: DataFrame, listed: DataFrame, most: int = MOST) -> DataFrame:
    """word, near and distance: each of ``words`` (word) beside those of ``listed`` (word, edits) within their edits, ``most`` at most."""
    known = listed.where("word IS NOT NULL").groupBy("word").agg(F.least(F.max("edits"), F.lit(most)).alias("edits"))
    longest = known.agg(F.max(F.length("word") + F.col("edits"))).first()[0]
    asked = words.select("word").where(F.length("word") <= F.lit(-1 if longest is None else longest)).distinct()
    form = lambda df: df.withColumn("form", F.explode(forms(F.col("word"), most)))
    wanted = form(known.withColumnRenamed("word", "near").withColumn("word", F.col("near"))).select("near", "edits", "form")
    met = form(asked).join(wanted, "form").select("word", "near", "edits").distinct()
    apart = met.withColumn("distance", F.levenshtein("word", "near", most))
    return apart.where((F.col("distance") >= 0) & (F.col("distance") <= F.col("edits"))).select("word", "near", "distance")
