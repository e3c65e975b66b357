"""The queries of the training-data operators: each is (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paarwerk.llm import leaks, overlap, repetition, sampling, sentences, splits, textform, tokenize
from paarwerk.llm.oracles import ORACLES
from paarwerk.session import new_path, spread, table

__all__ = ["ORACLES", "QUERIES"]

#: Where the public vocabularies lie on every machine; spark.paarwerk.tokenizers overrides it.
TOKENIZERS = "/opt/tokenizers"


def _vocabulary(spark: SparkSession) -> str:
    return f"{spark.conf.get('spark.paarwerk.tokenizers', TOKENIZERS)}/{tokenize.VOCABULARY}"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "all_corpora"), "pair_id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "sentencepair"), "chunk_id")


def _group_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("all_corpora", "text_meta", "author_alias", "corpora")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.found(*_group_tables(spark, d))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.splits(*_group_tables(spark, d), path=new_path(spark, "components"))


def p1_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, cut at the middle of the loading times: the components whose merge the second batch puts in quarantine."""
    tables = _group_tables(spark, d)
    middle = tables[0].agg(F.expr("percentile_approx(loaded_at, 0.5)")).first()[0]
    out = splits.two_batches(*tables, paths=(new_path(spark, "components"), new_path(spark, "components")), until=str(middle))
    return out.groupBy("component", "split").agg(F.count(F.lit(1)).alias("writers"), F.sum("n").alias("n_rows"), F.max("merged").alias("merged_splits")).where(F.col("split") == splits.QUARANTINE)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return textform.changed_texts(_pairs(spark, d), "pair_id", ["src", "tgt"])


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    return textform.consistent_columns(_pairs(spark, d).select("pair_id", "src", "tgt"), "pair_id", ["src", "tgt"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.row_pairs(_pairs(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(_pairs(spark, d), table(spark, d, "corpora"))


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sampling.sample(table(spark, d, "all_corpora"), table(spark, d, "sample_targets"), table(spark, d, "corpora"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1].where("missing > 0").select("target_id")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[0]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.boundaries(_chunks(spark, d)).select("chunk_id", "side", "end_pos")


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    """By a model that is trained first and kept."""
    model = new_path(spark, "sentence-model")
    sentences.train(_chunks(spark, d), model)
    return sentences.boundaries(_chunks(spark, d), model=model).select("chunk_id", "side", "sent_no", "end_pos", "sentence")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(_documents(spark, d), _vocabulary(spark))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each document decoded from its ids again."""
    return tokenize.decode(p7_ids(spark, d), _vocabulary(spark))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_documents(spark, d), table(spark, d, "eval_items"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without_leaks(_documents(spark, d), table(spark, d, "eval_items"))


def p8_removed(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document with a leak is one, without the text that is left."""
    return p8_cleaned(spark, d).drop("text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.judged(_documents(spark, d)).where("suspect and fails_runs").select("doc_id")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return repetition.judged(_documents(spark, d))


def p9_hosts(spark: SparkSession, d: str) -> DataFrame:
    return repetition.host_rates(repetition.failures(repetition.measured(_documents(spark, d))))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_splits, p1_quarantine, p3_found, p3_texts, p4_found, p4_report, p5_found, p5_sample, p5_report,
    p6_found, p6_sentences, p7_ids, p7_round_trip, p8_found, p8_cleaned, p8_removed, p9_found, p9_documents, p9_hosts,
)}
