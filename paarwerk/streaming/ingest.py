"""A drop folder of annotated XML as a stream: files that arrive are linearised and appended, each once.

Extraction looks at one file at a time, so no state is kept over files beyond the source's list of files seen, and no
watermark is needed; dedup and numbering are per file and run inside each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from paarwerk.operators.extract import pair_table
from paarwerk.session import passing

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def drop_folder(spark: SparkSession, folder: str, corpus: str, lang_prof: str, dialect: str, files_per_batch: int = 10_000) -> DataFrame:
    """The stream of XML files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.[xX][mM][lL]").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select("path", "content", F.lit(corpus).alias("corpus"), F.lit(lang_prof).alias("lang_prof"), F.lit(dialect).alias("dialect"), F.element_at(F.split("path", "/"), -1).alias("xml_file"))


def ingest(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the pair table of each micro-batch to Parquet under `out`, in a folder per batch, so that a batch that runs again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        with passing(df.sparkSession):
            pair_table(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
