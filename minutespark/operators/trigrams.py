"""Similar words by trigrams: a set-similarity join, then bounded edits.

A word's trigrams are those of its parts of letters and digits, with two spaces before and one after. Similarity is shared trigrams over all
of both. Terms are joined to words on their trigrams, and what a pair shares is counted; only pairs whose numbers of trigrams differ by a factor of
1 / t at most can have a similarity of t. Rows are narrow (no sets move), and words are not shuffled where the terms' trigrams are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutespark.operators.containment import texts_containing

#: Least similarity of a candidate, and candidates of a term.
LEAST, BEST = 0.3, 50
#: Trigrams of terms that are sent to all tasks; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def trigrams(word: Column) -> Column:
    parts = F.filter(F.split(F.lower(word), r"[^\p{L}\p{N}]+"), lambda p: p != "")

    def of(part: Column) -> Column:
        padded = F.concat(F.lit("  "), part, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(part) + 1), lambda i: F.substring(padded, i, 3))

    return F.array_distinct(F.flatten(F.transform(parts, of)))


def candidates(words: DataFrame, terms: DataFrame, least: float = LEAST, best: int | None = BEST) -> DataFrame:
    """(term, word, similarity): the ``best`` most similar of ``words`` (word) for each of ``terms`` (term), those of at least ``least``; equal ones by word."""
    grams = trigrams(F.col("word"))
    held = words.select("word").distinct().select("word", grams.alias("grams")).select("word", F.size("grams").alias("word_n"), F.explode("grams").alias("gram"))
    asked = terms.select("term").distinct().select("term", trigrams(F.col("term")).alias("grams")).select("term", F.size("grams").alias("term_n"), F.explode("grams").alias("gram"))
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    # By word first: where words come dealt out, as a distinct vocabulary does, shared trigrams are counted where they are found.
    fits = (F.col("word_n") >= F.col("term_n") * least) & (F.col("word_n") * least <= F.col("term_n"))
    pairs = held.join(asked, "gram").where(fits).groupBy("word", "term", "word_n", "term_n").agg(F.count("*").alias("common"))
    pairs = pairs.select("term", "word", (F.col("common") / (F.col("term_n") + F.col("word_n") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= least)
    if best is None:
        return pairs
    line = Window.partitionBy("term").orderBy(F.desc("similarity"), "word")
    return pairs.withColumn("at", F.row_number().over(line)).where(F.col("at") <= best).drop("at")


def edits(word: Column, term: Column) -> Column:
    """The distance if it is within what a term of its length tolerates, else null."""
    one, two = F.levenshtein(word, term, 1), F.levenshtein(word, term, 2)
    n = F.length(term)
    return F.nullif(F.when(n <= 4, F.when(word == term, 0).otherwise(-1)).when(n <= 7, one).otherwise(two), F.lit(-1))


def near_terms(words: DataFrame, terms: DataFrame, least: float = LEAST, best: int | None = BEST) -> DataFrame:
    """(term, word, similarity, distance): candidates within the tolerated edits."""
    return candidates(words, terms, least, best).withColumn("distance", edits(F.col("word"), F.col("term"))).where("distance is not null")


def texts_near(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame, words: DataFrame) -> DataFrame:
    """(id, term): texts that contain a term of at most four characters, or one of a longer term's near words; without any, none do."""
    short = terms.where(F.length("term") <= 4).select(F.col("term").alias("term_id"), "term")
    longer = near_terms(words, terms.where(F.length("term") > 4)).select(F.col("term").alias("term_id"), F.col("word").alias("term"))
    return texts_containing(texts, id_col, text_col, short.unionByName(longer)).withColumnRenamed("term_id", "term")
