"""Token ids of a public byte-level BPE vocabulary (problem 7), by recursive DuckDB queries inside each partition.

Each Arrow batch is cut into the tokenizer's own words; words that the partition hasn't met go, as (word, position, id)
rows of their bytes, to a recursive query that joins adjacent rows with the merge table and contracts each word's pair of
least rank, leftmost first, until none is left; an ordered aggregation gives the ids. Nothing is shuffled. All places of one
pair are contracted in one step, from the left: a contraction makes no pair of a lower rank, so that is what contracting the
leftmost one again and again comes to.

Empty and null texts give the empty list. Strings that look like special tokens are plain text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.json"
#: Words that a partition keeps; beyond it the memory starts anew, which costs time only.
KEPT_WORDS = 400_000

#: Bytes that go through one recursive query, words of like length together, so that short ones don't wait for a long one's steps.
STEP_BYTES = 200_000

#: One table that is updated, -1 for what was contracted away; only words that the last step changed are looked at again.
#: Of places of the best pair that stand side by side, as in `aaa`, every second one is taken, from the left.
CONTRACT = """
WITH RECURSIVE parts(word, pos, id) USING KEY (word, pos) AS (
    SELECT word, pos, id FROM pieces
  UNION (
    WITH held AS (SELECT r.word, r.pos, r.id, lead(r.id) OVER w AS right_id, lead(r.pos) OVER w AS next_pos, row_number() OVER w AS n
      FROM recurring.parts r WHERE r.id >= 0 AND r.word IN (SELECT word FROM parts) WINDOW w AS (PARTITION BY r.word ORDER BY r.pos)),
    pairs AS (SELECT held.word, held.pos, held.next_pos, held.n, m.made, m.rank FROM held JOIN merges m ON m.left_id = held.id AND m.right_id = held.right_id),
    best AS (SELECT * FROM pairs QUALIFY rank = min(rank) OVER (PARTITION BY word)),
    islands AS (SELECT *, n - row_number() OVER (PARTITION BY word ORDER BY n) AS island FROM best),
    taken AS (SELECT * FROM islands QUALIFY row_number() OVER (PARTITION BY word, island ORDER BY n) % 2 = 1)
    SELECT word, pos, made FROM taken UNION ALL SELECT word, next_pos, -1 FROM taken)
)
SELECT word, list(id ORDER BY pos) AS ids FROM parts WHERE id >= 0 GROUP BY word
"""


@lru_cache(4)
def _vocabulary(path: str):
    import regex

    held = json.load(open(path, encoding="utf-8"))["model"]
    ids = held["vocab"]
    merges = []
    for rank, m in enumerate(held["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((ids[a], ids[b], rank, ids[a + b]))
    # The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown}
    letter |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letter)}
    pattern = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    return merges, np.array([ids[letter[b]] for b in range(256)], np.int32), pattern


@lru_cache(4)
def _spelled(path: str) -> dict[int, bytes]:
    """Token id -> its bytes."""
    merges, byte_ids, _ = _vocabulary(path)
    out = {int(i): bytes([b]) for b, i in enumerate(byte_ids)}
    for a, b, _, made in merges:
        out[made] = out[a] + out[b]
    return out


@lru_cache(4)
def _together(path: str) -> np.ndarray:
    """Which two bytes stand side by side inside some token."""
    out = np.zeros((256, 256), bool)
    for b in _spelled(path).values():
        x = np.frombuffer(b, np.uint8)
        out[x[:-1], x[1:]] = True
    return out


class PartitionEncoder:
    """One partition's DuckDB, with the merge table and the words met so far."""

    def __init__(self, path: str):
        import duckdb

        merges, self.byte_ids, self.pattern = _vocabulary(path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        left, right, rank, made = (pa.array(x, pa.int32()) for x in zip(*merges))
        given = pa.table({"left_id": left, "right_id": right, "rank": rank, "made": made})
        self.db.register("given", given)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.together = _together(path)
        self.known: dict[str, list[int]] = {}

    def learn(self, new: list[str]) -> None:
        """Contract words that are new here, cut first where no token of the vocabulary can lie across."""
        coded = [w.encode() for w in new]
        joined, ends = b"".join(coded), np.cumsum([len(b) for b in coded])
        x = np.frombuffer(joined, np.uint8)
        cuts = np.union1d(np.flatnonzero(~self.together[x[:-1], x[1:]]) + 1, ends)
        held = [joined[i:j] for i, j in zip([0, *cuts.tolist()], cuts.tolist())]
        pieces, ids, at, size = sorted(set(held), key=lambda b: (len(b), b)), {}, 0, 0
        for i, p in enumerate(pieces):
            size += len(p)
            if size >= STEP_BYTES or i + 1 == len(pieces):
                self._contract(pieces[at : i + 1], ids)
                at, size = i + 1, 0
        first = 0
        for w, to in zip(new, np.searchsorted(cuts, ends, side="right").tolist()):
            self.known[w] = ids[held[first]] if to == first + 1 else list(chain.from_iterable([ids[p] for p in held[first:to]]))
            first = to

    def _contract(self, pieces: list[bytes], out: dict[bytes, list[int]]) -> None:
        sizes = np.array([len(b) for b in pieces])
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        pos = np.arange(len(word), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        self.db.register("pieces", pa.table({"word": word, "pos": pos, "id": ids}))
        for i, x in self.db.execute(CONTRACT).fetchall():
            out[pieces[i]] = x
        self.db.unregister("pieces")

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        known, find = self.known, self.pattern.findall
        cut = [find(t) if t else () for t in texts]
        new = {w for ws in cut for w in ws if w not in known}
        if new:
            held = known if len(known) + len(new) <= KEPT_WORDS else {w: known[w] for ws in cut for w in ws if w in known}
            self.known = held
            self.learn(sorted(new))
            known = self.known
        return [list(chain.from_iterable([known[w] for w in ws])) for ws in cut]


def encode(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every document by the vocabulary file at `vocabulary`, which each executor reads at that path."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PartitionEncoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[0], pa.array(encoder.encode(b[1].to_pylist()), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select(key, text).mapInArrow(scan, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of token ids; bytes that are no UTF-8 become replacement characters."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = _spelled(vocabulary)
        for b in batches:
            texts = [b"".join(spelled[x] for x in ids or ()).decode("utf-8", "replace") for ids in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(scan, "doc_id bigint, text string")
