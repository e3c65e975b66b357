"""Spellings of the learner tables: corpora, file names, text types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paarwerk.session import strip


def corpus_key(c: Column | str) -> Column:
    """Spelling-free key of a corpus: case, blanks at the ends, and `-`, blank or `_` between parts are alike."""
    return F.regexp_replace(F.lower(strip(c)), r"(?U)[-\s_]+", "_")


def file_key(c: Column | str) -> Column:
    """Last step of a path without regard to case and blanks at the ends; null if nothing is left."""
    last = F.lower(strip(F.regexp_extract(strip(c), r"[^/\\]*$", 0)))
    return F.when(last != "", last)


def text_type_key(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)[\s_]+", ""))


def with_registry(df: DataFrame, corpora: DataFrame, column: str = "corpus") -> DataFrame:
    """Give `column` its registry spelling; a corpus that isn't registered keeps its key, null stays null."""
    names = corpora.where(F.col("corpus").isNotNull()).groupBy(corpus_key("corpus").alias("_key")).agg(F.min("corpus").alias("_name"))
    keyed = df.withColumn("_key", corpus_key(column))
    return keyed.join(names, "_key", "left").withColumn(column, F.coalesce("_name", "_key")).drop("_key", "_name")
