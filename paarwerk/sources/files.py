"""Sources: annotated XML files, pair tables as CSV, whole texts, sidecar metadata."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

PAIRS = T.StructType(
    [
        T.StructField("corpus", T.StringType()),
        T.StructField("lang_prof", T.StringType()),
        T.StructField("xml_file", T.StringType()),
        T.StructField("sent_num", T.IntegerType()),
        T.StructField("src", T.StringType()),
        T.StructField("tgt", T.StringType()),
        T.StructField("corrected", T.BooleanType()),
        T.StructField("text_type", T.StringType()),
    ]
)
FILES = "path string, content binary, length bigint, corpus string, lang_prof string, dialect string, xml_file string"
CSV_OPTIONS = {"header": True, "escape": '"', "quote": '"', "multiLine": True, "encoding": "UTF-8"}


def with_slashes(path: str) -> str:
    """`file:/x` as `file:///x`, which is how Arrow spells it."""
    return re.sub("^file:/(?!/)", "file:///", path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def skipped_by_spark(spark: SparkSession, base: str) -> list[str]:
    """Files and folders below base whose names begin with `_`, which Spark's own listing leaves out; none inside a hidden folder.

    The file system is asked level by level for such names only, so what comes to the driver is what was found.
    """
    jvm, found, level = spark.sparkContext._jvm, [], base.rstrip("/")
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{level}/[^.]*")):
        found += [f.getPath().toString() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{level}/_*"))]
        level += "/[^.]*"
    return found


def _xml_below(spark: SparkSession, base: str) -> DataFrame:
    """(path, content, length) of the XML files below base; hidden folders below it are skipped, whatever the folders above are called."""
    jvm = spark.sparkContext._jvm
    read = lambda *paths: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][mM][lL]").load(list(paths)).select("path", "content", "length")
    odd = skipped_by_spark(spark, base)
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    inside = [p for p in odd if fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(p)).isDirectory()]
    files = read(base, *inside)
    alone = [p for p in odd if p not in inside and p.lower().endswith(".xml")]
    if alone:
        files = files.unionByName(read_named(spark, alone))
    at = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(base)).toUri().getPath().rstrip("/")
    return files.where(~F.regexp_replace("path", rf"^(\w+:(//[^/]*)?)?\Q{at}\E", "").rlike(r"/\.[^/]*/"))


def read_named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content, length) of files by their names, read where the tasks run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            held = []
            for p in b[0].to_pylist():
                system, inner = fs.FileSystem.from_uri(with_slashes(p))
                with system.open_input_stream(inner) as f:
                    held.append(f.read())
            yield pa.RecordBatch.from_arrays([b[0], pa.array(held, pa.binary()), pa.array([len(c) for c in held], pa.int64())], names=["path", "content", "length"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(read, "path string, content binary, length bigint")


def scan_corpora(spark: SparkSession, registry: list[dict], exclude: list[str] | DataFrame = (), limit: int | None = None) -> DataFrame:
    """The XML files below the folders of a registry of (corpus, base_dir, lang_prof, dialect) entries.

    Files of at least one byte whose names end in `.xml` in any case; hidden folders are skipped, and so is a corpus whose folder is missing. `limit` keeps
    the first files of each corpus by path, before `exclude` takes names out; negative limits are refused, 0 and None mean
    all. The limit is found from the listing alone: contents are read afterwards.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    found = None
    for entry in registry:
        if not exists(spark, entry["base_dir"]):
            continue
        named = _xml_below(spark, entry["base_dir"]).select("path", "content", "length", *[F.lit(entry.get(k, d)).alias(k) for k, d in (("corpus", None), ("lang_prof", "L2"), ("dialect", "X"))])
        found = named if found is None else found.unionByName(named)
    if found is None:
        return spark.createDataFrame([], FILES)
    found = found.withColumn("xml_file", F.element_at(F.split("path", "/"), -1))
    if limit:
        found = found.join(first_files(found.select("corpus", "path"), limit), ["corpus", "path"], "left_semi")
    return excluded(found, exclude)


def excluded(files: DataFrame, names: list[str] | DataFrame, column: str = "xml_file") -> DataFrame:
    """The files whose name is none of `names`: a list (blanks around a name ignored), or a table with that column. A null name is never excluded."""
    if isinstance(names, DataFrame):
        return files.join(names.select(column).distinct(), column, "left_anti")
    held = [n.strip() for n in names]
    return files.where(F.col(column).isNull() | ~F.col(column).isin(held)) if held else files


def first_files(files: DataFrame, limit: int) -> DataFrame:
    """(corpus, path) of the first `limit` paths of each corpus."""
    place = F.row_number().over(W.partitionBy("corpus").orderBy("path"))
    return files.select("corpus", "path").withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """The pair table from CSV with its fixed schema; a missing file is an empty table. CSV has one spelling for empty and null text: null is read."""
    if not exists(spark, path):
        return spark.createDataFrame([], PAIRS)
    return spark.read.schema(PAIRS).options(**CSV_OPTIONS).csv(path)


def _whole_files(spark: SparkSession, path: str, suffix: str, schema: str, read: Callable[[str], object]) -> DataFrame:
    """One row per file of (path, what `read` makes of its text); bytes that are not UTF-8 are dropped."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string()) if "map" in schema else pa.string()
        for b in batches:
            made = [read(bytes(c).decode("utf-8", "ignore")) for c in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(made, kind)], names=["path", schema.split(" ")[0]])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(path)
    return files.select("path", "content").mapInArrow(decode, f"path string, {schema}")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files, stripped. Files of no bytes give no row."""
    return _whole_files(spark, path, "*", "text string", str.strip)


def _key_values(text: str) -> list[tuple[str, str | None]]:
    held: dict[str, str | None] = {}
    for line in text.splitlines():
        k, sign, v = line.partition("=")
        if sign and k.strip():
            held[k.strip()] = None if v.strip() == "NA" else v.strip()
    return list(held.items())


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta): `key=value` lines of `.meta` files as a map; of a key that comes twice the last counts, lines without `=` are ignored, NA is null."""
    return _whole_files(spark, path, "*.meta", "meta map<string,string>", _key_values)
