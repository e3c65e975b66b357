"""Alignment of the two sides: chunks, sentences and tokens by position, the shorter side padded with ''."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paarwerk.operators.linearize import BREAK, DELETED, FOREIGN
from paarwerk.operators.segment import sentences
from paarwerk.session import strip


def zip_longest(a: Column, b: Column) -> Column:
    """array<struct<src, tgt>>; what is missing on a side is ''."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.struct(F.coalesce(x["a"], F.lit("")).alias("src"), F.coalesce(x["b"], F.lit("")).alias("tgt")))


def bag(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(text): the texts of several columns as one bag, nulls included, nothing made distinct."""
    out = None
    for c in columns:
        one = rows.select(F.col(c).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def chunks(c: Column) -> Column:
    """The parts between sentence breaks that aren't blank."""
    return F.filter(F.transform(F.split(c, BREAK), strip), lambda x: x != "")


def breaks(c: Column) -> Column:
    return F.size(F.split(c, BREAK)) - 1


def without_foreign_marks(c: Column) -> Column:
    return F.regexp_replace(c, f"{FOREIGN[0]}(.*?){FOREIGN[1]}", "$1")


def has_foreign(*sides: Column) -> Column:
    found = F.lit(False)
    for s in sides:
        found = found | F.contains(s, F.lit(FOREIGN[0]))
    return found


def one_line(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def _struct(x: Column, foreign: Column) -> Column:
    return F.struct(x["src"].alias("src"), x["tgt"].alias("tgt"), (strip(x["src"]) != strip(x["tgt"])).alias("corrected"), foreign.alias("has_foreign"))


def pairs_by_chunk(src: Column, tgt: Column) -> Column:
    """Dialect X: chunks are paired by position and each is segmented; a foreign word marks its chunk only."""

    def segmented(x: Column) -> Column:
        foreign = has_foreign(x["src"], x["tgt"])
        sides = [sentences(one_line(without_foreign_marks(x[s]))) for s in ("src", "tgt")]
        return F.transform(zip_longest(*sides), lambda p: _struct(p, foreign))

    return F.flatten(F.transform(zip_longest(chunks(src), chunks(tgt)), segmented))


def pairs_by_paragraph(src: Column, tgt: Column) -> Column:
    """Dialect P: where both sides have as many breaks and as many chunks, a chunk is a sentence; else both are segmented whole.
    A foreign word marks the whole paragraph."""
    foreign = has_foreign(src, tgt)
    agree = (breaks(src) > 0) & (breaks(src) == breaks(tgt)) & (F.size(chunks(src)) == F.size(chunks(tgt)))
    explicit = zip_longest(*(F.transform(chunks(s), without_foreign_marks) for s in (src, tgt)))
    whole = zip_longest(*(sentences(one_line(without_foreign_marks(F.replace(s, F.lit(BREAK), F.lit(" "))))) for s in (src, tgt)))
    return F.transform(F.when(agree, explicit).otherwise(whole), lambda p: _struct(p, foreign))


def sentence_pairs(sections: DataFrame) -> DataFrame:
    """(doc, section, src, tgt, dialect) -> (doc, section, pos, src, tgt, corrected, has_foreign), one row per pair; both-empty pairs go."""
    src, tgt = F.col("src"), F.col("tgt")
    pairs = F.when(F.col("dialect") == "P", pairs_by_paragraph(src, tgt)).otherwise(pairs_by_chunk(src, tgt))
    cut = sections.where("src <> '' or tgt <> ''").select("doc", "section", F.posexplode(pairs).alias("pos", "p"))
    return cut.select("doc", "section", "pos", "p.*").where("src <> '' or tgt <> ''")


def tokens(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def token_pairs(src: Column, tgt: Column) -> Column:
    """array<struct<src, tgt>> of the tokens by position; a null side counts as empty, a deleted word has no target, pairs of nothing go."""
    src, tgt = (F.coalesce(c, F.lit("")) for c in (src, tgt))
    plain = F.transform(zip_longest(tokens(src), tokens(tgt)), lambda x: F.struct(x["src"].alias("src"), F.when(x["tgt"] == DELETED, "").otherwise(x["tgt"]).alias("tgt")))
    return F.filter(plain, lambda x: (x["src"] != "") | (x["tgt"] != ""))


def norm_block(src: Column, tgt: Column) -> Column:
    """The verticalised text of one pair: a line `src<TAB>tgt` per token pair, each with its line end; the sink adds the blank line."""
    lines = F.transform(token_pairs(src, tgt), lambda x: F.concat(x["src"], F.lit("\t"), x["tgt"], F.lit("\n")))
    return F.array_join(lines, "")
