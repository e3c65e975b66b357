"""Same or near-same pairs across splits (problem 4): Aho-Corasick automata over sharded evaluation passages scan the training texts.

Equal texts (by their words) are one class, so copies cost one comparison. Every evaluation record is cut into passages, so
many that any near-same text holds at least one of them whole. The passages lie in shards, each with an automaton of its own,
and every training text is routed to the shards in which it can have a near-same record; what a text's scan hits are the
candidates, the hits' intervals are merged into the coverage of the record, over all its near-same training texts, and the
exact longest common subsequence of src and of tgt decides.

Routing: a near-same pair shares at least four fifths of the longer text's words in order; so, of the words sorted by rarity,
both hold two common words among their first few (one for very short or very long texts). Such words are keys; a shard holds
the records of some keys, and a text goes to the shards of its own keys, if a record is there. Rarity is by the number of rows
of every word, counted over all rows into a table of fixed size (words that share a place in it share their number, which
moves work, never results). Keys with many records or texts are cut into blocks of both.

Null, empty and wordless src or tgt are no case. A train and an evaluation row of equal texts are a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from paarwerk.functions.tables import with_registry
from paarwerk.llm.textform import words
from paarwerk.session import materialise

SHARE = 0.8
#: Up to so many words a text's keys are pairs of rare words; from SINGLE words on they are single words. Texts between have both.
PAIRED, SINGLE = 40, 32
#: Places of the table of word frequencies: 4 MB, however many words there are.
PLACES = 1 << 20
#: Records in a shard, on average; a text is scanned by each of its shards, so they are small.
RECORDS = 32
#: Records and texts of one key in one place; beyond that, blocks of both are put together in all ways.
RECORD_BLOCK, TEXT_BLOCK = 64, 512


def least_shared(n: int) -> int:
    """Words that a near-same text shares with one of n words."""
    return -(-4 * n // 5)


def near_same(a: list[str], b: list[str]) -> bool:
    """At least four fifths of the longer text's words stand in the same order in the other: bit-parallel common subsequence."""
    need = least_shared(max(len(a), len(b)))
    if min(len(a), len(b)) < need:
        return False
    if a == b:
        return bool(a)
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count() >= need


def in_words(pairs: DataFrame) -> DataFrame:
    """(pair_id, train, src, tgt, h1, h2): the words of src and tgt, joined by blanks, and a hash of both in two halves; without the rows that are no case."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src = [" ".join(words(t)) for t in b[2].to_pylist()]
            tgt = [" ".join(words(t)) for t in b[3].to_pylist()]
            h = [xxhash.xxh3_128_digest(f"{s}\n{t}") for s, t in zip(src, tgt)]
            halves = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(src, pa.string()), pa.array(tgt, pa.string()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["pair_id", "train", "src", "tgt", "h1", "h2"])

    rows = pairs.select("pair_id", F.lower(F.trim("data_split")).alias("s"), "src", "tgt").where("s in ('train', 'dev', 'test') and src <> '' and tgt <> ''").select("pair_id", (F.col("s") == "train").alias("train"), "src", "tgt")
    return rows.mapInArrow(scan, "pair_id bigint, train boolean, src string, tgt string, h1 bigint, h2 bigint").where("src <> '' and tgt <> ''")


class Frequencies:
    """In how many rows a word stands, or all words of its place together."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.known: dict[str, int] = {}

    def get(self, word: str, _: int = 0) -> int:
        n = self.known.get(word)
        if n is None:
            if len(self.known) > 500_000:
                self.known.clear()
            n = self.known[word] = int(self.counts[xxhash.xxh64_intdigest(word.encode(), 42) % PLACES])
        return n


def frequencies(rows: DataFrame) -> np.ndarray:
    """Rows of every word of tgt, by the word's place. At most PLACES numbers come to the driver, whatever the data."""
    word = rows.select(F.explode(F.array_distinct(F.split("tgt", " "))).alias("w"))
    # PLACES is a power of two, so the sign of the hash doesn't matter.
    held = word.groupBy(F.expr(f"xxhash64(w) & {PLACES - 1}").cast("int").alias("place")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(PLACES, np.uint32)
    out[held["place"].to_numpy()] = np.minimum(held["n"].to_numpy(), 2**32 - 1)
    return out


def rare_first(ws: list[str], common: Frequencies | dict[str, int]) -> list[str]:
    """The words, each copy of a word its own, in one order for all texts: by the rows that hold them, long ones first among equals, copies last."""
    seen: dict[str, int] = {}
    out = []
    for w in ws:
        k = seen[w] = seen.get(w, 0) + 1
        out.append((common.get(w, 0) if k == 1 else 1 << 40, -len(w), w, k))
    return [f"{w}#{k}" if k > 1 else w for _, _, w, k in sorted(out)]


def keys_of(ws: list[str], common: Frequencies | dict[str, int]) -> list[str]:
    """Keys such that two near-same texts have one in common."""
    n = len(ws)
    order, need = rare_first(ws, common), least_shared(n)
    out = []
    if n == 1 or n >= SINGLE:
        out += order[: n - need + 1]
    if 1 < n <= PAIRED:
        head = order[: n - need + 2]
        out += [f"{a} {b}" for i, a in enumerate(head) for b in head[i + 1 :]]
    return out


def passages(record: list[str]) -> list[tuple[int, int]]:
    """Cut a record into (start, end) passages such that every near-same text holds one of them whole."""
    n = len(record)
    lost = n - least_shared(n)
    breaks = lost + (n - lost) // 4
    return [(n * i // (breaks + 1), n * (i + 1) // (breaks + 1)) for i in range(breaks + 1)]


def scanned(records: dict[int, str], texts: dict[int, str]) -> dict[tuple[int, int], set[tuple[int, int]]]:
    """(record, text) -> the passages of the record that the text holds: one automaton over the passages of all records scans every text once."""
    automaton = ahocorasick.Automaton()
    owners: dict[str, list[tuple[int, int, int]]] = {}
    for r, text in records.items():
        ws = text.split(" ")
        for x, y in passages(ws):
            owners.setdefault(f" {' '.join(ws[x:y])} ", []).append((r, x, y))
    for p, who in owners.items():
        automaton.add_word(p, who)
    met: dict[tuple[int, int], set[tuple[int, int]]] = {}
    if owners:
        automaton.make_automaton()
        for t, text in texts.items():
            for _, who in automaton.iter(f" {text} "):
                for r, x, y in who:
                    met.setdefault((r, t), set()).add((x, y))
    return met


def keyed(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(h1, h2, pair_id, train, keys) of every row."""
    held = rows.sparkSession.sparkContext.broadcast(counts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = Frequencies(held.value)
        for b in batches:
            keys = [[xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in keys_of(t.split(" "), rare)] for t in b[4].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], b[1], b[2], b[3], pa.array(keys, pa.list_(pa.int64()))], names=["h1", "h2", "pair_id", "train", "keys"])

    return rows.select("h1", "h2", "pair_id", "train", "tgt").mapInArrow(scan, "h1 bigint, h2 bigint, pair_id bigint, train boolean, keys array<bigint>")


def routes(classes: DataFrame) -> DataFrame:
    """(shard, cls, train, held): the classes in the shards in which their keys meet a class of the other side, each once."""
    exploded = classes.select("cls", "train", "held", F.explode("keys").alias("key"))
    met = exploded.groupBy("key").agg(F.count_if("train").alias("texts"), F.count_if("held").alias("records"), F.count(F.lit(1)).alias("n"))
    blocks = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    met = met.where("texts > 0 and records > 0 and n > 1").select("key", "records", blocks("records", RECORD_BLOCK).alias("rows_"), blocks("texts", TEXT_BLOCK).alias("columns_"))
    met = materialise(met, "keys")
    shards = -(-(met.agg(F.sum(F.col("records") * F.col("columns_"))).first()[0] or 1) // RECORDS)
    here = exploded.join(met.drop("records"), "key")
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # A record stands in its row of blocks, a text in its column; a class that is both, in both.
    records = here.where("held").select("key", "cls", "train", "held", block("rows_").alias("i"), F.explode(all_("columns_")).alias("j"))
    texts = here.where("train").select("key", "cls", "train", "held", F.col("rows_"), block("columns_").alias("j")).select("key", "cls", "train", "held", F.explode(all_("rows_")).alias("i"), "j")
    cells = records.select("key", "i", "j", "cls", F.lit(False).alias("train"), "held").unionByName(texts.select("key", "i", "j", "cls", "train", F.lit(False).alias("held")))
    return cells.select(F.pmod(F.xxhash64("key", "i", "j"), F.lit(shards)).alias("shard"), "cls", "train", "held").groupBy("shard", "cls").agg(F.max("train").alias("train"), F.max("held").alias("held"))


NEAR = "held bigint, train bigint, n int, hits array<struct<x: int, y: int>>"
_NEAR = pa.schema([("held", pa.int64()), ("train", pa.int64()), ("n", pa.int32()), ("hits", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))])


def scan_shard(shard: pa.Table) -> pa.Table:
    """The near-same (record, text) of one shard (cls, train, held, src, tgt), with the words of the record and its passages in the text."""
    rows = list(zip(*(shard[c].to_pylist() for c in ("cls", "train", "held", "src", "tgt"))))
    both = {r[0]: (r[3].split(" "), r[4].split(" ")) for r in rows}
    out = []
    for (r, t), hits in scanned({r[0]: r[4] for r in rows if r[2]}, {r[0]: r[4] for r in rows if r[1]}).items():
        if r != t and near_same(both[r][1], both[t][1]) and near_same(both[r][0], both[t][0]):
            out.append({"held": r, "train": t, "n": len(both[r][1]), "hits": [{"x": x, "y": y} for x, y in sorted(hits)]})
    return pa.Table.from_pylist(out, _NEAR)


def overlaps(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, train, n, hits) of the near-same classes, each by its least pair_id, hits null where both are one class; and (cls, pair_id, train) of every row."""
    rows = materialise(in_words(pairs), "words")
    classes = keyed(rows, frequencies(rows)).groupBy("h1", "h2").agg(F.min("pair_id").alias("cls"), F.max("train").alias("train"), F.max(~F.col("train")).alias("held"), F.first("keys").alias("keys"))
    classes = materialise(classes, "classes")
    texts = rows.select(F.col("pair_id").alias("cls"), "src", "tgt")
    near = routes(classes).join(texts, "cls").groupBy("shard").applyInArrow(scan_shard, NEAR).dropDuplicates(["held", "train"])
    same = classes.where("held and train").select(F.col("cls").alias("held"), F.col("cls").alias("train"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<struct<x: int, y: int>>").alias("hits"))
    members = rows.select("h1", "h2", "pair_id", "train").join(classes.select("h1", "h2", "cls"), ["h1", "h2"]).select("cls", "pair_id", "train")
    return materialise(near.unionByName(same), "near"), members


def row_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id_a, pair_id_b), a < b: every train row with every dev or test row that is the same or near-same."""
    near, members = overlaps(pairs)
    held = members.where("not train").select(F.col("cls").alias("held"), F.col("pair_id").alias("x"))
    train = members.where("train").select(F.col("cls").alias("train"), F.col("pair_id").alias("y"))
    return near.select("held", "train").join(held, "held").join(train, "train").select(F.least("x", "y").alias("pair_id_a"), F.greatest("x", "y").alias("pair_id_b"))


def coverage(near: DataFrame) -> DataFrame:
    """(held, coverage): the share of a record's words in passages that stand in any of its near-same training texts. A record's passages don't overlap and are few."""
    each = near.select("held", "n", F.explode_outer("hits").alias("h")).select("held", "n", "h.x", "h.y").distinct()
    by_record = each.groupBy("held").agg(F.max(F.col("x").isNull()).alias("same"), F.max("n").alias("n"), F.sum(F.col("y") - F.col("x")).alias("words"))
    return by_record.select("held", F.when(F.col("same"), F.lit(1.0)).otherwise(F.col("words") / F.col("n")).alias("coverage"))


def report(pairs: DataFrame, corpora: DataFrame) -> DataFrame:
    """(data_split, corpus, row_pairs, held_rows, coverage) per evaluation split and corpus (registry spelling): row pairs are counted, not listed."""
    near, members = overlaps(pairs)
    in_train = members.where("train").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    by_class = near.select("held", "train").join(in_train.withColumnRenamed("cls", "train"), "train").groupBy("held").agg(F.sum("n").alias("n"))
    by_class = by_class.join(coverage(near), "held")
    rows = with_registry(pairs.select("pair_id", "data_split", "corpus"), corpora)
    held = members.where("not train").select(F.col("cls").alias("held"), "pair_id").join(by_class, "held").join(rows, "pair_id")
    return held.groupBy(F.lower(F.trim("data_split")).alias("data_split"), "corpus").agg(F.sum("n").alias("row_pairs"), F.count(F.lit(1)).alias("held_rows"), F.round(F.avg("coverage"), 4).alias("coverage"))
