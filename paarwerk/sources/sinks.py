"""Sinks: the pair table as CSV, verticalised token pairs, and a summary for the console."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paarwerk.operators.align import norm_block
from paarwerk.operators.stats import profile_counts
from paarwerk.sources.files import CSV_OPTIONS, PAIRS, with_slashes


def write_pairs_csv(pairs: DataFrame, path: str, one_file: bool = False) -> None:
    """The pair table with header, in the order of corpus, file and sentence; `corrected` is written True or False."""
    rows = pairs.select(*[f.name for f in PAIRS]).withColumn("corrected", F.initcap(F.col("corrected").cast("string")))
    rows = rows.orderBy("corpus", "xml_file", "sent_num")
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").options(**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_norm(pairs: DataFrame, path: str, one_file: bool = False) -> None:
    """One folder per corpus with its verticalised text: a line per token pair, a blank line behind each sentence pair."""
    rows = pairs.orderBy("corpus", "xml_file", "sent_num").select("corpus", norm_block(F.col("src"), F.col("tgt")).alias("value"))
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").partitionBy("corpus").option("lineSep", "\n").text(path)


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row's `content` (binary) to its `path` below the folder; null content writes nothing. Returns how many files were written.

    The tasks write by themselves, so the folder must be one that all machines see; a task that runs again writes the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(with_slashes(folder))
        for b in batches:
            n = 0
            for path, content in zip(b[0].to_pylist(), b[1].to_pylist()):
                if content is None:
                    continue
                system.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}") as f:
                    f.write(content)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def summary(pairs: DataFrame) -> str:
    """Rows in all, and per corpus and language profile."""
    counts = profile_counts(pairs).orderBy("corpus", "lang_prof").collect()  # one row per corpus and profile
    return "\n".join([f"{pairs.count()} pairs", *(f"{r.corpus} {r.lang_prof}: {r.pair_count}" for r in counts)])
