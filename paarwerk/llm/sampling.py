"""A sample that matches target category proportions (problem 5), by the cube method.

Every row of a target's category has the inclusion probability wanted / available. Flight phases move the probabilities
of two undecided rows of one category against each other until one is decided, which keeps each category's sum; they
run on the rows of every partition, what is left (at most one row of a category) merges upward, FAN partitions at a
time, and flies again. Partitions are those of a hash of the rows' ids, so the draw doesn't depend on how the rows are stored. The landing decides what is left at the top. Probabilities are kept as whole numbers over a
common denominator, so sums are exact. Coins are hashes of the rows' ids: a task that runs again decides alike.

Rows with a null in a category field, or of a category without a target, are never drawn. A category with fewer rows
than wanted is drawn whole and reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from paarwerk.functions.tables import text_type_key, with_registry
from paarwerk.session import materialise

FAN = 32
#: Rows of a partition of the first flight, on average.
FLIGHT_ROWS = 50_000
FIELDS = ["corpus", "text_type", "corrected"]


def categories(pairs: DataFrame, targets: DataFrame, corpora: DataFrame) -> DataFrame:
    """(pair_id, target_id) of the rows that belong to a target. The targets are a fixed small table."""
    keyed = targets.select("target_id", F.col("corpus").alias("_c"), text_type_key("text_type").alias("_t"), F.col("corrected").alias("_k"))
    rows = with_registry(pairs.select("pair_id", *FIELDS), corpora)
    return rows.join(F.broadcast(keyed), (F.col("corpus") == F.col("_c")) & (text_type_key("text_type") == F.col("_t")) & (F.col("corrected") == F.col("_k"))).select("pair_id", "target_id")


def plan(pairs: DataFrame, members: DataFrame, targets: DataFrame, one_in: int = 5) -> DataFrame:
    """(target_id, wanted, available, drawing): wanted is max(min_rows, permille of n rounded up), n the rows // one_in."""
    n = F.floor(F.lit(pairs.count()) / one_in)
    have = members.groupBy("target_id").agg(F.count(F.lit(1)).alias("available"))
    wanted = F.greatest(F.col("min_rows").cast("long"), F.floor((F.col("target_permille") * n + 999) / 1000).cast("long"))
    return targets.select("target_id", wanted.alias("wanted")).join(have, "target_id", "left").select("target_id", "wanted", F.coalesce("available", F.lit(0)).alias("available")).withColumn("drawing", F.least("wanted", "available"))


def flight(rows: pd.DataFrame, level: int) -> pd.DataFrame:
    """Flight of (pair_id, target_id, num, den) rows: num becomes 0 or den but for one row of each category.

    Rows fly in the order of a hash of pair_id, so the outcome depends on the rows alone.
    """
    out = []
    for _, part in rows.groupby("target_id", sort=True):
        ids = part["pair_id"].to_numpy(np.uint64)
        with np.errstate(over="ignore"):
            x = ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1) * np.uint64(0xD1B54A32D192ED03)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        order = np.lexsort((ids, x))
        part, coin = part.iloc[order], (x[order] >> np.uint64(11)).astype(float) / 2.0**53
        num, den = part["num"].to_numpy(np.int64).tolist(), int(part["den"].iloc[0])
        held = None
        for i, p in enumerate(num):
            if p == 0 or p == den:
                continue
            if held is None:
                held = i
                continue
            q, c = num[held], coin[i]
            if p + q <= den:  # one of the two is left out; the other takes its probability
                num[i], num[held] = (p + q, 0) if c * (p + q) < p else (0, p + q)
            else:  # one of the two is drawn
                num[i], num[held] = (den, p + q - den) if c * (2 * den - p - q) < den - q else (p + q - den, den)
            held = i if 0 < num[i] < den else held if 0 < num[held] < den else None
        out.append(part.assign(num=num))
    return pd.concat(out) if out else rows


def _flight_at(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: flight(rows, level)


def cube(members: DataFrame, planned: DataFrame) -> DataFrame:
    """(pair_id, target_id) of the drawn rows."""
    probabilities = planned.select("target_id", F.col("drawing").alias("num"), F.col("available").alias("den"))
    schema = "pair_id bigint, target_id int, num bigint, den bigint, part int"

    def fly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = []
        for b in batches:  # undecided rows go on to the next batch, so a partition is never held whole
            done = flight(pd.concat([*left, b]), 0)
            open_ = (done["num"] > 0) & (done["num"] < done["den"])
            yield done[~open_ & (done["num"] > 0)]
            left = [done[open_]]
        yield from left

    parts = -(-(planned.agg(F.sum("available")).first()[0] or 1) // FLIGHT_ROWS)
    part = F.pmod(F.xxhash64("pair_id"), F.lit(parts)).cast("int").alias("part")
    start = members.join(F.broadcast(probabilities), "target_id").select("pair_id", "target_id", "num", "den", part)
    # In one order, so that a task that runs again cuts the same batches.
    flown = materialise(start.repartition(parts, "part").sortWithinPartitions("part", "pair_id").mapInPandas(fly, schema), "flight")
    decided = flown.where("num = den").select("pair_id", "target_id")
    open_, level = flown.where("num < den"), 0
    while True:
        level, parts = level + 1, -(-parts // FAN)
        merged = open_.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        up = materialise(merged.groupBy("part").applyInPandas(_flight_at(level), schema), f"flight-{level}")
        decided = decided.unionByName(up.where("num = den").select("pair_id", "target_id"))
        open_ = up.where("num > 0 and num < den")
        if parts <= 1:
            break
    # Landing: at most one row of each category is left. Whole numbers of wanted rows leave none; else the likelier half is drawn.
    landed = open_.where("2 * num >= den").select("pair_id", "target_id")
    return decided.unionByName(landed)


def sample(pairs: DataFrame, targets: DataFrame, corpora: DataFrame, one_in: int = 5) -> tuple[DataFrame, DataFrame]:
    """The drawn rows (pair_id, target_id), and the report (target_id, wanted, available, drawn, missing, share_off)."""
    members = categories(pairs, targets, corpora)
    planned = materialise(plan(pairs, members, targets, one_in), "plan")
    drawn = materialise(cube(members, planned), "sample")
    got = drawn.groupBy("target_id").agg(F.count(F.lit(1)).alias("drawn"))
    rows = planned.join(F.broadcast(got), "target_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    totals = rows.agg(F.sum("drawn").alias("_all"))
    report = rows.join(targets.select("target_id", "target_permille"), "target_id").join(F.broadcast(totals))
    return drawn, report.select("target_id", "wanted", "available", "drawn", (F.col("wanted") - F.col("drawn")).alias("missing"), (F.when(F.col("_all") > 0, F.col("drawn") / F.col("_all")).otherwise(0.0) - F.col("target_permille") / 1000).alias("share_off"))
