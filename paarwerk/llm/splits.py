"""Splits that keep related records together (problem 1): an incremental, persisted component table.

Nodes are writers, links say that two writers are one. A folder holds the state: the texts with their writers, and the component
table (node, component, split, had). A batch brings new rows, metadata and links and reads nothing else but that state: its
links are taken to the components of their ends and contracted round by round (every component points to the least one
beside it, and the pointers are jumped, each replaced by its pointer's pointer, until they rest), and the components that
were merged are renamed in the table. Components that exist keep their split, new ones fill the deficits of the splits,
and a merge of components with different splits is quarantined, with all splits that its parts ever had.

Rows whose corpus or file is null belong to no text; each is a group of its own and gets its split by a hash of its id.
Empty tables give empty results. Repeated or reversed links, links of a writer to itself and of null codes add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from paarwerk.functions.tables import corpus_key, file_key, with_registry
from paarwerk.session import is_small, join_salted, materialise, new_path, strip

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: A component with more than this share of the rows is placed one by one; there are at most 1 / GIANT of them.
GIANT = 0.002
#: Components in a bucket of the distributed running sum that places all others.
BUCKET = 10_000
QUARANTINE = "quarantine"
SAID = "struct<at: timestamp, id: bigint>"


def _code(c: Column | str) -> Column:
    """A writer's code without regard to case and blanks at the ends; null if nothing or `NA` is given."""
    code = F.lower(strip(c))
    return F.when((code != "") & (code != "na"), code)


def code_in_name(corpus: str, file: str) -> Column:
    """The writer's code that a (folded) file name carries; a name without enough parts is its own code."""
    stem = F.regexp_replace(file, r"\.xml$", "")
    parts = F.split(file, "_")
    other = F.when(F.instr(file, "_") > 0, F.regexp_extract(file, "^(.*)_", 1)).otherwise(stem)
    return F.when(F.col(corpus) == "LEONIDE", F.when(F.size(parts) >= 4, F.regexp_replace(F.get(parts, F.lit(3)), r"\.xml$", "")).otherwise(stem)).otherwise(other)


def node(corpus: Column | str, code: Column | str) -> Column:
    return F.concat_ws("/", corpus, code)


def row_texts(pairs: DataFrame, corpora: DataFrame) -> DataFrame:
    """(pair_id, corpus, file) with registry spelling and folded file name; null where there is none."""
    return with_registry(pairs.select("pair_id", "corpus", F.col("xml_file")), corpora).select("pair_id", "corpus", file_key("xml_file").alias("file"))


def text_table(rows: DataFrame, meta: DataFrame, corpora: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(corpus, file, author, said, node, first_id, n): one row per text with its writer, those of `before` included. A given author id outranks
    the file name; of several the last delivered counts. A text of which only metadata came has n 0."""
    texts = rows.where("corpus is not null and file is not null").select("corpus", "file", "pair_id", F.lit(1).alias("n"), F.lit(None).cast("string").alias("author"), F.lit(None).cast(SAID).alias("said"))
    given = with_registry(meta.select("corpus", "xml_file", "author_id", "delivered_at", "meta_id"), corpora)
    given = given.select("corpus", file_key("xml_file").alias("file"), F.lit(None).cast("long").alias("pair_id"), F.lit(0).alias("n"), _code("author_id").alias("author"), F.struct(F.col("delivered_at").alias("at"), F.col("meta_id").alias("id")).alias("said"))
    all_ = texts.unionByName(given.where("author is not null and corpus is not null and file is not null"))
    if before is not None:
        all_ = all_.unionByName(before.select("corpus", "file", F.col("first_id").alias("pair_id"), "n", "author", "said"))
    # max_by leaves out rows without a `said`; of those with one, an undated delivery is the earliest.
    merged = all_.groupBy("corpus", "file").agg(F.max_by("author", "said").alias("author"), F.max("said").alias("said"), F.min("pair_id").alias("first_id"), F.sum("n").alias("n"))
    return merged.withColumn("node", node(F.col("corpus"), F.coalesce(F.col("author"), code_in_name("corpus", F.col("file")))))


def writer_links(alias: DataFrame, corpora: DataFrame) -> DataFrame:
    """(a, b), a < b, each link of two writers once."""
    known = with_registry(with_registry(alias, corpora, "corpus_a"), corpora, "corpus_b")
    a, b = _code("author_a"), _code("author_b")
    ends = known.select(node(F.col("corpus_a"), a), node(F.col("corpus_b"), b), F.col("corpus_a").isNotNull() & F.col("corpus_b").isNotNull() & a.isNotNull() & b.isNotNull())
    return ends.toDF("x", "y", "ok").where("ok and x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def contracted(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node that a link or `start` names. `start` (node, component) are the components so far."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if start is None:
        held, edges = nodes.withColumn("component", F.col("node")), links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    else:
        held = nodes.join(start, "node", "full").select("node", F.coalesce("component", "node").alias("component"))
        of = lambda end, name: start.select(F.col("node").alias(end), F.col("component").alias(name))
        edges = links.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    rounds = []
    while True:
        edges = materialise(edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
        if edges.isEmpty():
            break
        beside = edges.select(F.inline(F.array(F.struct(F.col("x").alias("c"), F.col("y").alias("d")), F.struct(F.col("y").alias("c"), F.col("x").alias("d")))))
        points = materialise(beside.groupBy("c").agg(F.least("c", F.min("d")).alias("p")), "pointers")
        while True:  # pointer jumping, two jumps at a time
            via = lambda at, to: points.select(F.col("c").alias(at), F.col("p").alias(to))
            twice = points.join(via("p", "q"), "p").join(via("q", "r"), "q").join(via("r", "s"), "r")
            jumped = materialise(twice.select("c", F.col("s").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "pointers")
            points = jumped.select("c", "p")
            if jumped.where("moved").isEmpty():
                break
        rounds.append(points)
        to = lambda end: points.select(F.col("c").alias(end), F.col("p").alias(f"_{end}"))
        edges = edges.join(to("x"), "x").join(to("y"), "y").select(F.col("_x").alias("x"), F.col("_y").alias("y"))
    for points in rounds:
        held = held.join(points.withColumnRenamed("c", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    return held


def advance(pairs: DataFrame, meta: DataFrame, alias: DataFrame, corpora: DataFrame, path: str, before: str | None = None, shares: dict[str, float] = SHARES) -> tuple[DataFrame, DataFrame]:
    """One batch: the rows with their text, and (corpus, file, node, component, split, group_id, texts, n) of every text known by now that has rows.

    The state goes to `path` (folders texts and components); `before` is the path of the state so far, if any, whose rows, metadata and links are not read again.
    """
    spark = pairs.sparkSession
    rows = row_texts(pairs, corpora)
    old = spark.read.parquet(f"{before}/texts") if before else None
    text_table(rows, meta, corpora, old).write.mode("overwrite").parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts").where("n > 0")
    moved = None
    if before:
        was = old.where("n > 0").select("corpus", "file", F.col("node").alias("was")).join(spark.read.parquet(f"{before}/components").select(F.col("node").alias("was"), "split", "had"), "was")
        moved = texts.select("corpus", "file", "node").join(was, ["corpus", "file"]).where("node <> was").select("node", "split", "had")
    table = update(texts.select("node", "n"), writer_links(alias, corpora), f"{path}/components", f"{before}/components" if before else None, shares, moved)
    placed = texts.join(table.select("node", "component", "split"), "node")
    by = placed.groupBy("component").agg(F.min("first_id").alias("group_id"), F.count(F.lit(1)).alias("texts"))
    return rows, materialise(placed.join(by, "component").select("corpus", "file", "node", "component", "split", "group_id", "texts", "n"), "texts")


def with_text(rows: DataFrame, texts: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows to their text. A text may hold a third of the rows: where the texts aren't broadcast, large ones are salted."""
    on = ["corpus", "file"]
    return rows.join(texts, on, how) if is_small(texts) else join_salted(rows, texts, on, "n", "pair_id", how)


def found(pairs: DataFrame, meta: DataFrame, alias: DataFrame, corpora: DataFrame, path: str | None = None, before: str | None = None) -> DataFrame:
    """(pair_id, group_id) of the rows in groups of two texts or more, by the component table that this batch writes to `path`."""
    rows, texts = advance(pairs, meta, alias, corpora, path or new_path(pairs.sparkSession, "components"), before)
    return with_text(rows, texts.where("texts > 1").select("corpus", "file", "group_id", "n")).select("pair_id", "group_id")


def assign(sizes: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """(component, split) for components of (component, n, split), split null where it is new.

    Large new components go one by one to the split with the most room; all others in the order of a hash along a
    running sum of their rows, cut where the room of each split ends.
    """
    spark = sizes.sparkSession
    totals = {r.split: r.n for r in sizes.groupBy("split").agg(F.sum("n").alias("n")).collect()}  # one row per split
    all_rows = sum(totals.values())
    room = {s: share * all_rows - totals.get(s, 0) for s, share in shares.items()}
    new = sizes.where("split is null").select("component", "n")
    big = []
    for r in new.where(F.col("n") > GIANT * all_rows).orderBy(F.desc("n"), "component").collect():  # at most 1 / GIANT rows
        best = max(room, key=lambda s: room[s])
        room[best] -= r.n
        big.append((r.component, best))
    rest = new.where(F.col("n") <= GIANT * all_rows)
    count, at = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rest = rest.withColumn("_b", F.pmod(F.xxhash64("component"), F.lit(-(-count // BUCKET) or 1)))
    sums = rest.groupBy("_b").agg(F.sum("n").alias("_s"))  # a row for each BUCKET components
    starts = sums.select("_b", (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_before"))
    open_ = {s: max(x, 0.0) for s, x in room.items()}
    scale = at / (sum(open_.values()) or 1.0)
    middle = F.sum("n").over(W.partitionBy("_b").orderBy(F.xxhash64("component", F.lit(1)), "component").rowsBetween(W.unboundedPreceding, 0)) - F.col("n") / 2 + F.col("_before")
    split, edge = F.lit(next(iter(shares))), 0.0
    for s in shares:
        split = F.when(F.col("_m") >= edge, F.lit(s)).otherwise(split) if open_[s] > 0 else split
        edge += open_[s] * scale
    placed = rest.join(starts, "_b").withColumn("_m", middle).select("component", split.alias("split"))
    kept = sizes.where("split is not null").select("component", "split")
    return kept.unionByName(placed).unionByName(spark.createDataFrame(big, "component string, split string"))


def update(texts: DataFrame, links: DataFrame, path: str, before: str | None = None, shares: dict[str, float] = SHARES, moved: DataFrame | None = None) -> DataFrame:
    """Bring the component table up to date and write it to `path`: (node, component, n, split, had, merged).

    texts: (node, n), all texts known by now. links: those that `before`, the path of the table so far, doesn't know yet.
    moved: (node, split, had) of texts that have another writer than before, the writer they have now and the split they had.
    `had`: the splits that the component's parts, or texts that came to it, ever had; `merged`, for a quarantined one, their number.
    """
    spark = texts.sparkSession
    nodes = texts.groupBy("node").agg(F.sum("n").alias("n"))
    old = spark.read.parquet(before) if before else None
    held = contracted(links, old.select("node", "component") if old is not None else None)
    all_ = nodes.join(held, "node", "full").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("n", F.lit(0)).alias("n"))
    if old is not None:
        # A node that no link of this batch names keeps its component's own history; every node brings its component's.
        known = old.select("node", "split", "had") if moved is None else old.select("node", "split", "had").unionByName(moved.select("node", "split", "had"))
        known = known.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set(F.when(F.size("had") > 0, F.col("had")).otherwise(F.array("split"))))).alias("_s"))
        all_ = all_.join(known, "node", "left")
    else:
        all_ = all_.withColumn("_s", F.lit(None).cast("array<string>"))
    all_ = materialise(all_, "nodes")
    # Of a component's nodes there may be many, of its different histories only as many as there are sets of splits.
    had = all_.groupBy("component").agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_s")))).alias("had"))
    split = F.when(F.size("had") > 1, F.lit(QUARANTINE)).otherwise(F.get("had", F.lit(0)))
    had = materialise(had.select("component", "n", split.alias("split"), "had"), "components")
    done = assign(had.select("component", "n", "split"), shares).join(had.select("component", "had"), "component")
    # A new component's history begins with the split that it has got.
    done = done.withColumn("had", F.when(F.size("had") > 0, F.col("had")).otherwise(F.array("split")))
    out = all_.join(done, "component").select("node", "component", "n", "split", "had", F.when(F.col("split") == QUARANTINE, F.size("had")).otherwise(F.lit(0)).alias("merged"))
    out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def splits(pairs: DataFrame, meta: DataFrame, alias: DataFrame, corpora: DataFrame, path: str, shares: dict[str, float] = SHARES, before: str | None = None) -> DataFrame:
    """(pair_id, split, group_id) of every row of a batch; the state stays at `path`, and a later batch starts from it."""
    rows, texts = advance(pairs, meta, alias, corpora, path, before, shares)
    alone = F.pmod(F.xxhash64("pair_id"), F.lit(1000)) / 1000
    by_hash, edge = F.lit(None), 1.0
    for s in reversed(list(shares)):
        by_hash = F.when(alone < edge, F.lit(s)).otherwise(by_hash)
        edge -= shares[s]
    known = texts.select("corpus", "file", "split", "group_id", "n")
    return with_text(rows, known, "left").select("pair_id", F.coalesce("split", by_hash).alias("split"), F.coalesce("group_id", "pair_id").alias("group_id"))


def two_batches(pairs: DataFrame, meta: DataFrame, alias: DataFrame, corpora: DataFrame, paths: tuple[str, str], until: str) -> DataFrame:
    """The component table after a first batch (loaded, delivered and noted before `until`) and a second with what came later or has no date.

    A text whose author_id is delivered later changes its writer; its split stays if its new writer has no other one, else
    the new writer's component is in quarantine.
    """
    early = lambda df, c: df.where(F.col(c) < F.lit(until).cast("timestamp"))
    late = lambda df, c: df.where(~F.coalesce(F.col(c) < F.lit(until).cast("timestamp"), F.lit(False)))
    dated = ((pairs, "loaded_at"), (meta, "delivered_at"), (alias, "noted_at"))
    advance(*(early(*x) for x in dated), corpora, paths[0])
    advance(*(late(*x) for x in dated), corpora, paths[1], paths[0])
    return pairs.sparkSession.read.parquet(f"{paths[1]}/components")
