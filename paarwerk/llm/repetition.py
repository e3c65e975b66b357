"""Repetition inside a single document (problem 9), judged by document and by host.

Each document is measured once (share of words in a run that stood earlier, repeated lines and sentences); its rule
failures are added up by host (the source of the text), the hosts' failure rates are shrunk with a beta prior that is
fitted to all hosts by moments, and the verdict is joined back to the documents: a document's own share is shrunk to its
host's rate, with the weight of one word, and documents above the bound are suspects. The bound is so low that every document
with a high share is a suspect whatever its host; of the suspects the exact share decides. The measures, a few numbers a
document, are written once; the text itself is never shuffled.

Null and empty texts have 0 words, share 0 and fail no rule. A null source is a host of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paarwerk.llm.textform import words
from paarwerk.session import join_hot, materialise

RUN_WORDS = 4
LEAST_WORDS = 8
HIGH_SHARE = 0.3
HIGH_LINES = 0.3
HIGH_RATE = 0.2
#: Of a share that is shrunk with the weight of one word: no document of LEAST_WORDS words or more with a share of HIGH_SHARE is below.
SUSPECT_SHARE = HIGH_SHARE * LEAST_WORDS / (LEAST_WORDS + 1)
_PIECES = re.compile(r"[^.!?。！？।\n]+")


def repeated_words(seq: list[str], run: int = RUN_WORDS) -> int:
    """Words in a run of at least `run` words that stood, word for word, earlier; the earlier run may overlap."""
    seen, covered, to = set(), 0, 0
    for i, gram in enumerate(zip(*(seq[k:] for k in range(run)))):
        if gram in seen:
            covered += i + run - max(i, to)
            to = i + run
        else:
            seen.add(gram)
    return covered


def repeated_pieces(text: str) -> float:
    """Share of the characters of sentences and lines that are in copies of an earlier one."""
    seen, all_, twice = set(), 0, 0
    for m in _PIECES.finditer(text):
        p = " ".join(m[0].split()).casefold()
        if p:
            all_ += len(p)
            twice += len(p) if p in seen else 0
            seen.add(p)
    return twice / all_ if all_ else 0.0


def measured(documents: DataFrame, run: int = RUN_WORDS, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, source, n_words, repeated_words, piece_share) of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rep, pieces = [], [], []
            for t in b[2].to_pylist():
                seq = words(t)
                n.append(len(seq))
                rep.append(repeated_words(seq, run))
                pieces.append(repeated_pieces(t) if t else 0.0)
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(n, pa.int32()), pa.array(rep, pa.int32()), pa.array(pieces, pa.float64())], names=["doc_id", "source", "n_words", "repeated_words", "piece_share"])

    schema = "doc_id bigint, source string, n_words int, repeated_words int, piece_share double"
    return materialise(documents.select(key, host, text).mapInArrow(scan, schema), "measures").withColumn("share", F.when(F.col("n_words") > 0, F.col("repeated_words") / F.col("n_words")).otherwise(F.lit(0.0)))


def failures(m: DataFrame) -> DataFrame:
    """The rules, each true where a document breaks it."""
    long = F.col("n_words") >= LEAST_WORDS
    return m.withColumns({"fails_runs": long & (F.col("share") >= HIGH_SHARE), "fails_pieces": long & (F.col("piece_share") >= HIGH_LINES)})


def host_rates(m: DataFrame) -> DataFrame:
    """(source, docs, failed, rate, host_high): rate is (failed + a) / (docs + a + b) of a beta prior fitted to all hosts by moments, at nine places, since sums of fractions depend on their order."""
    hosts = m.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum((F.col("fails_runs") | F.col("fails_pieces")).cast("long")).alias("failed"))
    raw = F.col("failed") / F.col("docs")
    # One row: mean and variance of the hosts' rates. Without spread the prior is that of two documents.
    prior = hosts.agg((F.sum("failed") / F.sum("docs")).alias("mu"), F.var_pop(raw).alias("v"))
    strength = F.when((F.col("v") > 0) & (F.col("mu") * (1 - F.col("mu")) > F.col("v")), F.col("mu") * (1 - F.col("mu")) / F.col("v") - 1).otherwise(F.lit(2.0))
    prior = prior.select("mu", F.greatest(strength, F.lit(2.0)).alias("k"))
    return hosts.join(F.broadcast(prior)).withColumn("rate", F.round((F.col("failed") + F.col("mu") * F.col("k")) / (F.col("docs") + F.col("k")), 9)).select("source", "docs", "failed", "rate", (F.col("rate") >= HIGH_RATE).alias("host_high"))


def judged(documents: DataFrame, run: int = RUN_WORDS) -> DataFrame:
    """Every document with its measures, its rule failures, the verdict on its host, and whether it is a suspect after that. A host may hold a third of all documents."""
    m = failures(measured(documents, run))
    hosts = materialise(host_rates(m), "hosts").select(F.coalesce("source", F.lit("")).alias("_host"), F.col("source").isNull().alias("_none"), "docs", "rate", "host_high")
    keyed = m.withColumns({"_host": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()})
    joined = join_hot(keyed, hosts, ["_host", "_none"], "docs", "doc_id").drop("_host", "_none", "docs")
    shrunk = (F.col("repeated_words") + F.col("rate")) / (F.col("n_words") + 1)
    return joined.withColumn("suspect", (F.col("n_words") >= LEAST_WORDS) & (shrunk >= SUSPECT_SHARE))
