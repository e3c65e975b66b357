"""Session helpers: the shared folder, tables cut from their lineage, joins of tables of unknown size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table for work that costs much a row: where it has fewer partitions than there are cores (one small file), its rows are
    dealt out by `keys`. A large table has its partitions and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, *keys)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        made = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="paarwerk-ship-")) / root.name), "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share. Where it is unset, a local session (tests) gets a temporary
    one; on a cluster a folder of one machine would lose tables, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        found = held.rsplit("/", 1)[0] if held else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="paarwerk-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget_all() -> None:
    for spark, path in _made:
        try:
            delete_path(spark, path)
        except Exception:  # the session has ended; the folder belongs to the cluster then
            return


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/paarwerk/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written to the shared folder inside this block are deleted at its end, as a long stream needs it."""
    before = len(_made)
    try:
        yield
    finally:
        for _, path in _made[before:]:
            delete_path(spark, path)
        del _made[before:]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, a lost executor costs nothing, and Catalyst knows the table's size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Catalyst expects df to fit the session's broadcast bound (spark.sql.autoBroadcastJoinThreshold), so a plain join broadcasts it. No job runs for this."""
    bound = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= bound


def join_salted(rows: DataFrame, held: DataFrame, on: list[str], weight: str, salt: str, how: str = "inner", pieces: int = 200) -> DataFrame:
    """Join rows to a table with one row per key. Keys with more than 1 / `pieces` of all rows (by `weight`, the rows of each key) are salted by the column `salt` of rows."""
    total = held.agg(F.sum(weight)).first()[0]
    salts = F.greatest(F.lit(1), F.ceil(F.col(weight) * pieces / F.lit(max(total or 0, 1))).cast("int"))
    large = F.broadcast(held.withColumn("_salts", salts).where("_salts > 1").select(*on, "_salts"))  # fewer than `pieces` keys can be so large
    cut = rows.join(large, on, "left").withColumn("_salt", F.pmod(F.xxhash64(salt), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return cut.join(copies, [*on, "_salt"], how).drop("_salt")


def join_hot(rows: DataFrame, held: DataFrame, on: list[str], weight: str, salt: str, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key, of which one may belong to a third of all rows: a small table is broadcast by Catalyst, beyond that large keys are salted."""
    return rows.join(held, on, how) if is_small(held) else join_salted(rows, held, on, weight, salt, how)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with `columns` set, each computed once a row: filters above are not merged with costly expressions, as they would be through a projection."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def strip(c: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
