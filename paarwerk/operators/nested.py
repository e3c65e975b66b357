"""Deeply nested annotated XML as related flat tables (problem 2), by Merkle identities of subtrees.

Every element is canonicalised (local name in lower case, attributes by name, text and children in order) and hashed
bottom-up, so equal subtrees have one identity. The object table holds each once; bridge rows (parent, ordinal, child)
hold its make-up; occurrence rows hold every place in every file with its parent and its nearest annotation around.

Nesting of any depth is read without recursion. Bytes that are not UTF-8 and byte-order marks before the first tag are
dropped. Null content and files that are not well-formed give no rows; a file that came twice gives its rows twice.
Equal attributes in different case: the first that isn't blank counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paarwerk.session import materialise

# Names of annotations and of their fields.
ANNOTATIONS = frozenset(("error", "over_capitalisation"))
ANNOTATION_START = "orth_error"
CHILD_FIELDS = ("originalform", "targetform")
ATTRIBUTE_FIELD = "orth_error_target"
#: Identities that a task remembers so as not to send an object again; beyond it the memory starts anew.
REMEMBERED = 500_000

CHILD = pa.struct([("name", pa.string()), ("seq", pa.int32()), ("hash", pa.binary())])
OBJECT = pa.struct([("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("blank", pa.bool_()), ("children", pa.list_(CHILD))])
ROWS = "file_id bigint, node_no int, parent_no int, ordinal int, ann_no int, annotation boolean, hash binary, object struct<name:string,attributes:map<string,string>,text:string,blank:boolean,children:array<struct<name:string,seq:int,hash:binary>>>"


def is_annotation(name: str) -> bool:
    return name in ANNOTATIONS or name.startswith(ANNOTATION_START)


class Reader:
    """Reads one document into occurrence rows and objects."""

    def __init__(self, seen: set[bytes]):
        self.seen = seen
        self.rows: list[tuple] = []
        self.stack: list[dict] = []
        self.count = 0

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        name = tag.rpartition("}")[2].lower()
        self.count += 1
        own: dict[str, str] = {}
        for k, v in attributes.items():
            k = k.rpartition("}")[2].lower()
            if not own.get(k, "").strip():
                own[k] = v
        around = self.stack[-1] if self.stack else None
        ann = 0 if around is None else around["no"] if around["ann"] else around["in"]
        ordinal = 0 if around is None else len(around["children"]) + 1
        field = name in CHILD_FIELDS
        digest = blake2b(name.encode(), digest_size=16)
        for k in sorted(own):
            digest.update(f"\0@{k}\0{own[k]}".encode())
        self.stack.append({"no": self.count, "up": around["no"] if around else 0, "in": ann, "ordinal": ordinal, "name": name, "ann": is_annotation(name), "attributes": own, "digest": digest, "children": [], "text": [] if field or around and around["text"] is not None else None, "own": field, "blank": True, "seqs": {}})

    def text(self, s: str) -> None:
        if not self.stack:
            return
        top = self.stack[-1]
        top["digest"].update(b"\0t" + s.encode())
        if top["text"] is not None:
            top["text"].append(s)
        if top["blank"] and s.strip():
            top["blank"] = False

    def end(self, tag: str) -> None:
        top = self.stack.pop()
        h = top["digest"].digest()
        if self.stack:
            up = self.stack[-1]
            seq = up["seqs"][top["name"]] = up["seqs"].get(top["name"], 0) + 1
            up["children"].append({"name": top["name"], "seq": seq, "hash": h})
            up["digest"].update(b"\0c" + h)
            up["blank"] = up["blank"] and top["blank"]
            if up["text"] is not None:
                up["text"].append(s) if (s := "".join(top["text"])) else None
        payload = None
        if h not in self.seen:
            self.seen.add(h)
            payload = {"name": top["name"], "attributes": list(top["attributes"].items()), "text": "".join(top["text"]) if top["own"] else None, "blank": top["blank"], "children": top["children"]}
        self.rows.append((top["no"], top["up"], top["ordinal"], top["in"], top["ann"], h, payload))


def read_document(content: bytes, seen: set[bytes]) -> list[tuple]:
    """(node_no, parent_no, ordinal, ann_no, annotation, hash, object or None if seen) of each element; [] if it doesn't parse."""
    data = content.decode("utf-8", "ignore").lstrip("﻿").encode()
    before, reader = set(), Reader(seen)
    parser = expat.ParserCreate("utf-8", "}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.text
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        before = {r[5] for r in reader.rows if r[6] is not None}
        seen -= before  # what a broken file taught isn't sent
        return []
    return reader.rows


def read(files: DataFrame) -> DataFrame:
    """Occurrences of (file_id, content), each object with its first occurrence in a task. Written to the shared folder."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            rows = []
            for file_id, content in zip(b[0].to_pylist(), b[1].to_pylist()):
                if content is not None:
                    rows += [(file_id, *r) for r in read_document(content, seen)]
                if len(seen) > REMEMBERED:
                    seen.clear()
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), OBJECT)
            names = ["file_id", "node_no", "parent_no", "ordinal", "ann_no", "annotation", "hash", "object"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return materialise(files.select("file_id", "content").mapInArrow(scan, ROWS), "nodes")


def occurrences(rows: DataFrame) -> DataFrame:
    """(file_id, node_no, parent_no, ordinal, ann_no, annotation, hash): every place; parent_no and ann_no are 0 at the top."""
    return rows.drop("object")


def objects(rows: DataFrame) -> DataFrame:
    """(hash, name, attributes, text, blank, children): each different subtree once. text is given for field elements."""
    once = rows.where("object is not null").groupBy("hash").agg(F.first("object").alias("o"))
    return once.select("hash", "o.*")


def bridge(things: DataFrame) -> DataFrame:
    """(parent_hash, ordinal, name, seq, child_hash): the children of each object; seq counts those of one name."""
    cut = things.select(F.col("hash").alias("parent_hash"), F.posexplode("children").alias("ordinal", "c"))
    return cut.select("parent_hash", (F.col("ordinal") + 1).alias("ordinal"), "c.name", "c.seq", F.col("c.hash").alias("child_hash"))


def annotation_fields(things: DataFrame) -> DataFrame:
    """(hash, field, field_seq, value) of each annotation object: its field children and its attribute, blank ones left out."""
    name = F.col("name")
    annotations = things.where(name.isin(*ANNOTATIONS) | name.startswith(ANNOTATION_START))
    children = bridge(annotations).where(F.col("name").isin(*CHILD_FIELDS))
    content = things.where(name.isin(*CHILD_FIELDS) & ~F.col("blank")).select(F.col("hash").alias("child_hash"), F.col("text").alias("value"))
    of_children = children.join(content, "child_hash").select(F.col("parent_hash").alias("hash"), F.col("name").alias("field"), F.col("seq").alias("field_seq"), "value")
    value = F.col("attributes")[ATTRIBUTE_FIELD]
    of_attributes = annotations.where(value.rlike(r"(?U)\S")).select("hash", F.lit(ATTRIBUTE_FIELD).alias("field"), F.lit(1).alias("field_seq"), value.alias("value"))
    return of_children.unionByName(of_attributes)


def field_rows(files: DataFrame) -> DataFrame:
    """(file_id, ann_no, parent_ann_no, field, field_seq, value) of every field in every place."""
    rows = read(files)
    fields = materialise(annotation_fields(materialise(objects(rows), "objects")), "fields")
    places = occurrences(rows).where("annotation").select("file_id", F.col("node_no").alias("ann_no"), F.col("ann_no").alias("parent_ann_no"), "hash")
    return places.join(fields, "hash").drop("hash")
