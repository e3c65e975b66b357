"""Cleaning, filtering, first-of-each dedup and dense numbering of sentence pairs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paarwerk.session import once, strip

# The patterns of the cleaning, in Java's spelling.
INTERJECTION = r'(?iu)(?<![\p{L}\p{N}_])(h[aeo]+|e+|o+|y+e+|gahahaha|hahaha+|noo+)(?:([.!?,"])|[\s\x0B\x85\p{Z}]|$)'
HYPHEN = r'(?U)^-\s+(?=["„A-ZÄÖÜ])'
LIST_MARK = r"(?U)^\s*\d+\s*[.\)]\s*"
WORD = r"[\p{L}\p{N}_]+"
CENSORED = ["*", "@"]
REMARKS = ["fortsetzung der aufgabe 2 fehlt", "text nicht beendet", "der text abgebrochen"]
BROKEN_OFF = r"(?U:die aufgabe\s*\d?\s*abgebrochen)"
LEAST_WORDS = 3
SIDES = ("src", "tgt")


def without_interjections(c: Column | str) -> Column:
    return F.regexp_replace(c, INTERJECTION, "$2")


def tidied(c: Column | str) -> Column:
    """One line without interjections, spare blanks and a leading hyphen."""
    c = strip(F.regexp_replace(c, r"(?U)\s*\n\s*", " "))
    c = strip(F.regexp_replace(without_interjections(c), r"(?U)\s+", " "))
    return F.regexp_replace(c, HYPHEN, "")


def without_list_mark(c: Column | str) -> Column:
    return strip(F.regexp_replace(c, LIST_MARK, ""))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def is_remark(*sides: str) -> Column:
    """A transcriber's remark that the text breaks off, or a censored or addressed text, on any side. The sides are read as one text, once."""
    text = F.lower(F.concat_ws("\n", *sides))
    signs = "|".join(re.escape(x) for x in [*CENSORED, *REMARKS])
    return text.rlike(rf"{signs}|{BROKEN_OFF}|(?s)^(?=.*abgebrochen).*(?:text|aufgabe)")


def filtered(pairs: DataFrame) -> DataFrame:
    """The pairs that stay, cleaned. Null sides count as empty; has_foreign, if there is such a column, drops a pair."""
    kept = pairs.where(~F.coalesce("has_foreign", F.lit(False))) if "has_foreign" in pairs.columns else pairs
    kept = once(kept, {s: tidied(F.coalesce(s, F.lit(""))) for s in SIDES}).where(~is_remark(*SIDES))
    kept = once(kept, {s: without_list_mark(s) for s in SIDES}).where("src <> '' and tgt <> ''")
    return kept.where((word_count("src") >= LEAST_WORDS) & (word_count("tgt") >= LEAST_WORDS)).select(*pairs.columns)


def first_of_each(pairs: DataFrame, document: list[str], order: list[str]) -> DataFrame:
    """Of equal pairs (case ignored) of a document the first in order.

    An aggregation, not a window: it combines before the shuffle, and a document that holds a third of all rows is
    spread over its texts. Rows that are equal in `order` too are one.
    """
    by = [*document, *(F.lower(s).alias(f"_{s}") for s in SIDES)]
    rest = [c for c in pairs.columns if c not in document]
    first = pairs.groupBy(*by).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return first.select(*document, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*pairs.columns)


def numbered(df: DataFrame, document: list[str], order: str | list[str], number: str, block: int = 4096) -> DataFrame:
    """Dense numbers from 1 within each document in the order of the whole-number columns `order`, unique together.

    Documents are numbered in blocks of the last of them, so a large one is spread over many tasks; the blocks' sizes, added up
    over each document's earlier blocks, are put before.
    """
    *outer, last = [order] if isinstance(order, str) else order
    cut = df.withColumn("_block", F.floor(F.col(last) / block))
    sizes = cut.groupBy(*document, *outer, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*document).orderBy(*outer, "_block")) - F.col("_n")).drop("_n")
    place = F.row_number().over(W.partitionBy(*document, *outer, "_block").orderBy(last))
    condition = F.lit(True)
    for c in (*document, *outer, "_block"):
        condition = condition & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = cut.withColumn("_place", place).alias("l").join(before.alias("r"), condition)
    return joined.select("l.*", "_before").withColumn(number, (F.col("_before") + F.col("_place")).cast("int")).drop("_before", "_place", "_block")
