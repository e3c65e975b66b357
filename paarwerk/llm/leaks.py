"""Evaluation texts leaking into training text (problem 8): a generalised suffix automaton over the words of all items.

The automaton holds the items. Every document streams its words through it; the length of the longest match ending at each
word is tracked, and a match of at least `least` words names the items that hold its last `least` words.

The items' words are counted first. Up to BROADCAST_WORDS they are broadcast, in shards of at most SHARD_WORDS words with an
automaton each, and the documents are read once and not shuffled. Beyond that both sides are cut into stretches of windows of
`least` words that have the same least three-word hash; equal windows have the same one, so stretches meet by it, in shards of a
table, each with an automaton over its items' stretches. Both ways find the same.

Null and empty texts hold nothing. An item shorter than `least` words can't be found. Copies of an item are all named.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from paarwerk.llm.textform import word_spans, words
from paarwerk.session import materialise

LEAST_WORDS = 10
#: Words of items in one automaton; about 400 bytes a word in each Python worker.
SHARD_WORDS = 250_000
#: Words of items that are broadcast; more are met by shuffle.
BROADCAST_WORDS = 500_000
#: Words of documents that a shard's automaton scans in one place.
BLOCK_WORDS = 2_000_000
#: Words of the sequences whose least hash decides where a window goes.
SEED_WORDS = 3


class SuffixAutomaton:
    """States of all word sequences of some items. `items(state)` are those that hold the state's sequences."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int = LEAST_WORDS):
        self.least = least
        self.code: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[int]] = [set()]
        for item, seq in items:
            last = 0
            for w in seq:
                last = self._add(last, self.code.setdefault(w, len(self.code)), own)
                own[last].add(item)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            own[self.link[s]] |= own[s] if self.link[s] else set()
        # Only states with a sequence of `least` words and none shorter in their place are asked.
        self.names = {s: tuple(sorted(own[s])) for s in range(1, len(self.link)) if self.length[s] >= least > self.length[self.link[s]]}

    def _new(self, own: list[set[int]], length: int, link: int, following: dict[int, int], items: set[int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        own.append(items)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int, own: list[set[int]]) -> int:
        clone = self._new(own, self.length[p] + 1, self.link[q], dict(self.next[q]), set())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, c: int, own: list[set[int]]) -> int:
        if (q := self.next[last].get(c)) is not None:  # another item had this sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c, own)
        state, p = self._new(own, self.length[last] + 1, 0, {}, set()), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c, own)
        return state

    def matches(self, seq: list[str]) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) wherever a match of at least `least` words ends."""
        code, following, link, length, least = self.code.get, self.next, self.link, self.length, self.least
        s = n = 0
        for i, w in enumerate(seq):
            c = code(w)
            if c is None:
                s = n = 0
                continue
            while s and c not in following[s]:
                s = link[s]
                n = length[s]
            t = following[s].get(c)
            if t is None:
                s = n = 0
                continue
            s, n = t, n + 1
            if n >= least:
                u = s
                while length[link[u]] >= least:
                    u = link[u]
                yield i, n, u

    def found(self, seq: list[str]) -> set[int]:
        return {x for _, _, u in self.matches(seq) for x in self.names[u]}


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words) of the items that have an id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[0], pa.array([words(t) for t in b[1].to_pylist()], pa.list_(pa.string()))], names=["item_id", "words"])

    return items.select("item_id", "text").where("item_id is not null").mapInArrow(cut, "item_id bigint, words array<string>")


def item_shards(items: DataFrame, shard_words: int = SHARD_WORDS) -> list[list[tuple[int, list[str]]]]:
    """The items' words in shards of bounded size, for items whose number of words has been checked."""
    held = items if "words" in items.columns else item_words(items)
    shards, n = [[]], 0
    for r in held.collect():
        if n + len(r.words) > shard_words and shards[-1]:
            shards.append([])
            n = 0
        shards[-1].append((r.item_id, r.words))
        n += len(r.words)
    return shards


def _are_few(held: DataFrame) -> bool:
    return (held.agg(F.sum(F.size("words"))).first()[0] or 0) <= BROADCAST_WORDS


_built: dict[str, list[SuffixAutomaton]] = {}


def _automata(name: str, shards: list, least: int) -> list[SuffixAutomaton]:
    """The automata of a broadcast, built once in each Python worker; those of another are forgotten."""
    if name not in _built:
        _built.clear()
        _built[name] = [SuffixAutomaton(x, least) for x in shards]
    return _built[name]


def stretches(seq: list[str], least: int) -> list[tuple[int, int, int]]:
    """(hash, start, end): the windows of `least` words, put together where neighbours have the same least hash of SEED_WORDS words."""
    n, width = len(seq), min(SEED_WORDS, least)
    if n < least:
        return []
    seeds = [xxhash.xxh64_intdigest(" ".join(seq[i : i + width])) - (1 << 63) for i in range(n - width + 1)]
    out: list[list[int]] = []
    span = least - width + 1
    for i in range(n - least + 1):
        low = min(seeds[i : i + span])
        if out and out[-1][0] == low and out[-1][2] == i + least - 1:
            out[-1][2] = i + least
        else:
            out.append([low, i, i + least])
    return [tuple(x) for x in out]


PIECES = "hash bigint, id bigint, at int, words array<string>"


def _pieces(table: DataFrame, least: int, as_text: bool) -> DataFrame:
    """(hash, id, at, words): the stretches of (id, text or words)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, x in zip(b[0].to_pylist(), b[1].to_pylist()):
                seq = words(x) if as_text else x
                rows += [(h, i, s, seq[s:e]) for h, s, e in stretches(seq or [], least)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["hash", "id", "at", "words"])

    return table.mapInArrow(cut, PIECES)


FOUND = "doc_id bigint, items array<bigint>, spans array<struct<x: int, y: int>>"
_FOUND = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))])


def _spans(ends: list[tuple[int, int]], at: int = 0) -> list[dict]:
    """Matches (last word, length) as disjoint stretches [x, y)."""
    out: list[dict] = []
    for x, y in sorted((at + i - n + 1, at + i + 1) for i, n in ends):
        if out and x <= out[-1]["y"]:
            out[-1]["y"] = max(y, out[-1]["y"])
        else:
            out.append({"x": x, "y": y})
    return out


def _met(documents: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """(doc_id, items, spans) of the documents' stretches that hold an item's words; a document may have several rows, with ids that repeat."""
    theirs = materialise(_pieces(held, least, False), "item-stretches")
    seeds = theirs.select("hash").distinct()
    own = materialise(_pieces(documents, least, True).join(seeds, "hash", "left_semi"), "stretches")
    shards = -(-(theirs.agg(F.sum(F.size("words"))).first()[0] or 1) // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("hash"), F.lit(shards)).alias("shard")
    sizes = own.groupBy(shard).agg(F.ceil(F.sum(F.size("words")) / BLOCK_WORDS).cast("int").alias("blocks"))
    cells = own.select(shard, "*").join(sizes, "shard").select("shard", F.pmod(F.xxhash64("id", "at"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("item"), "id", "at", "words")
    items = theirs.select(shard, "*").join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("item"), "id", "at", "words")

    def scan(cell: pa.Table) -> pa.Table:
        rows = list(zip(*(cell[c].to_pylist() for c in ("item", "id", "at", "words"))))
        automaton, out = SuffixAutomaton([(i, w) for item, i, _, w in rows if item], least), []
        for item, i, at, w in rows:
            if not item and (ends := list(automaton.matches(w))):
                out.append({"doc_id": i, "items": sorted({x for _, _, u in ends for x in automaton.names[u]}), "spans": _spans([(k, n) for k, n, _ in ends], at)})
        return pa.Table.from_pylist(out, _FOUND)

    return cells.unionByName(items).groupBy("shard", "block").applyInArrow(scan, FOUND)


def leaked_items(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id) of every document that holds at least `least` consecutive words of the item."""
    held = materialise(item_words(items), "items")
    if not _are_few(held):
        return _met(documents.select(key, text), held, least).select("doc_id", F.explode("items").alias("item_id")).distinct()
    shards, name = documents.sparkSession.sparkContext.broadcast(item_shards(held)), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(name, shards.value, least)
        for b in batches:
            pairs = []
            for d, t in zip(b[0].to_pylist(), b[1].to_pylist()):
                seq = words(t)
                pairs += [(d, x) for a in automata for x in a.found(seq)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["doc_id", "item_id"])

    return documents.select(key, text).mapInArrow(scan, "doc_id bigint, item_id bigint")


CLEANED = "doc_id bigint, words int, removed_words int, dropped boolean, text string"


def _cleaned(rows: list[tuple], most_coverage: float) -> pa.RecordBatch:
    """Rows of CLEANED from (doc_id, text, words, spans)."""
    out = []
    for d, t, seq, spans in rows:
        gone = {i for s in spans for i in range(s["x"], s["y"])}
        drop = len(gone) > most_coverage * len(seq)
        out.append((d, len(seq), len(gone), drop, None if drop else _rest(t, seq, gone)))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "words", "removed_words", "dropped", "text"])


def without_leaks(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, most_coverage: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, removed_words, dropped, text): spans of at least `least` words that stand in an item are cut out;
    a document of which more than `most_coverage` is such text is dropped (text null). Only documents with a span come out.
    """
    held = materialise(item_words(items), "items")
    texts = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    if not _are_few(held):
        met = _met(texts, held, least).select("doc_id", F.explode("spans").alias("s")).distinct().groupBy("doc_id").agg(F.collect_list("s").alias("spans"))

        def cut_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _cleaned([(d, t, words(t), spans) for d, t, spans in zip(*(c.to_pylist() for c in b.columns))], most_coverage)

        return texts.join(met, "doc_id").mapInArrow(cut_met, CLEANED)
    shards, name = documents.sparkSession.sparkContext.broadcast(item_shards(held)), uuid.uuid4().hex

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(name, shards.value, least)
        for b in batches:
            rows = []
            for d, t in zip(b[0].to_pylist(), b[1].to_pylist()):
                seq = words(t)
                if ends := [(i, n) for a in automata for i, n, _ in a.matches(seq)]:
                    rows.append((d, t, seq, _spans(ends)))
            yield _cleaned(rows, most_coverage)

    return texts.mapInArrow(cut, CLEANED)


def _rest(text: str, seq: list[str], gone: set[int]) -> str:
    spans = word_spans(text)
    if len(spans) != len(seq):  # a form that changes the number of words: keep the comparable words themselves
        return " ".join(w for i, w in enumerate(seq) if i not in gone)
    out, at, i = [], 0, 0
    while i < len(seq):
        if i not in gone:
            i += 1
            continue
        j = i
        while j + 1 < len(seq) and j + 1 in gone:
            j += 1
        out.append(text[at : spans[i][1]])
        at, i = spans[j][2], j + 1
    return "".join([*out, text[at:]])
