"""Extraction from end to end: files -> sections -> sentence pairs -> cleaned, numbered pair table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paarwerk.operators.align import sentence_pairs
from paarwerk.operators.clean import filtered, first_of_each, numbered
from paarwerk.operators.linearize import linearise
from paarwerk.session import materialise

NUMBERED_CORPORA = ["Kolipsi_1_L1", "Kolipsi_1_L2", "Kolipsi_2"]


def text_type(corpus: Column | str, xml_file: Column | str) -> Column:
    """The text type that a file name tells: by its number in the numbered corpora, else by a part of it; else `unknown`."""
    corpus, name = (F.col(c) if isinstance(c, str) else c for c in (corpus, xml_file))
    first = F.when(name.endswith("_1.xml"), "picture story").when(name.endswith("_2.xml"), "opinion")
    part = F.when(F.contains(name, F.lit("_pic_")), "picture story").when(F.contains(name, F.lit("_op_")), "opinion")
    return F.coalesce(F.when(corpus.isin(NUMBERED_CORPORA), first).otherwise(part), F.lit("unknown"))


def raw_pairs(files: DataFrame, strict: bool = False) -> DataFrame:
    """(doc, section, pos, src, tgt, corrected, has_foreign) of files (doc, content, dialect); section and pos are the order within a document."""
    return sentence_pairs(linearise(files, strict).where("error is null"))


def extract(files: DataFrame, strict: bool = False) -> DataFrame:
    """(doc, sent_num, src, tgt, corrected) of files (doc, content, dialect): cleaned, the first of equal pairs of a document, numbered from 1."""
    kept = materialise(first_of_each(filtered(raw_pairs(files, strict)), ["doc"], ["section", "pos"]), "pairs")
    return numbered(kept, ["doc"], ["section", "pos"], "sent_num").select("doc", "sent_num", "src", "tgt", "corrected")


def pair_table(files: DataFrame, strict: bool = False) -> DataFrame:
    """The pair table of files (path, content, corpus, lang_prof, dialect, xml_file)."""
    found = extract(files.select(F.col("path").alias("doc"), "content", "dialect"), strict)
    about = files.select(F.col("path").alias("doc"), "corpus", "lang_prof", "xml_file")
    joined = found.join(about, "doc")
    return joined.select("corpus", "lang_prof", "xml_file", "sent_num", "src", "tgt", "corrected", text_type("corpus", "xml_file").alias("text_type"))


def problems(files: DataFrame, strict: bool = False) -> DataFrame:
    """(doc, error) of the documents that could not be read."""
    return linearise(files, strict).where("error is not null").select("doc", "error")


def hash_split(files: DataFrame, name: str = "xml_file") -> DataFrame:
    """(name, split) of each file: train, dev and test in the declared shares 80 / 10 / 10, by a hash of the name. Rows without a name have no split."""
    bucket = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % 100
    return files.where(F.col(name).isNotNull()).select(name).distinct().withColumn("split", F.when(bucket < 80, "train").when(bucket < 90, "dev").otherwise("test"))
