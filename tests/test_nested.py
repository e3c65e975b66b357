"""Flat tables of nested XML against a plain walk of the tree."""

import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from paarwerk.operators import nested

SCHEMA = "file_id long, content binary, path string, hash string"


def local(t):
    return t.rpartition("}")[2].lower()


def plain(fid, content):
    try:
        root = ET.fromstring(content.decode("utf-8", "ignore").lstrip("﻿"))
    except ET.ParseError:
        return []
    out, n, stack = [], 0, [(root, 0)]
    while stack:
        e, ann = stack.pop()
        n += 1
        me, name = n, local(e.tag)
        own = name in ("error", "over_capitalisation") or name.startswith("orth_error")
        if own:
            k = {}
            for c in e:
                f = local(c.tag)
                if f in ("originalform", "targetform"):
                    k[f] = k.get(f, 0) + 1
                    text = "".join(c.itertext())
                    if text.strip():
                        out.append((fid, me, ann, f, k[f], text))
            v = e.attrib.get("orth_error_target", "")
            if v.strip():
                out.append((fid, me, ann, "orth_error_target", 1, v))
        stack += [(c, me if own else ann) for c in reversed(list(e))]
    return out


def grown(rng, depth=0):
    tag = rng.choice(["error", "Error", "orth_error_id12", "over_capitalisation", "originalForm", "targetForm", "div", "ORIGINALFORM"])
    attr = rng.choice(["", ' orth_error_target="x"', ' orth_error_target=" "', ' note="a &gt; b"'])
    inner = "".join(rng.choice(["", "wort", " ", "<!-- <error/> -->", "<![CDATA[<targetForm>]]>"]) + (grown(rng, depth + 1) if depth < 6 and rng.random() < 0.7 else "") for _ in range(rng.randint(0, 3)))
    return f"<{tag}{attr}>{inner}</{tag}>"


def test_against_plain_walk(spark):
    rng = random.Random(3)
    docs = [(i, bytearray(f"<root>{grown(rng)}{grown(rng)}</root>".encode()), None, None) for i in range(200)]
    docs += [(900, None, None, None), (901, bytearray(b""), "x", "y"), (902, bytearray(b"<a><error>"), None, None), (903, bytearray("﻿<error orth_error_target='z'/>".encode()), None, None), (904, bytearray(b"<a>\xff\xfe<error><targetForm>\xffok</targetForm></error></a>"), None, None), (905, docs[0][1], None, None), (906, docs[0][1], None, None)]
    deep = "<error>" * 3000 + "<originalForm>tief</originalForm>" + "</error>" * 3000
    docs.append((907, bytearray(deep.encode()), None, None))
    got = sorted(tuple(r[c] for c in ("file_id", "ann_no", "parent_ann_no", "field", "field_seq", "value")) for r in nested.field_rows(spark.createDataFrame(docs, SCHEMA)).collect())
    assert got == sorted(x for d in docs if d[1] is not None for x in plain(d[0], bytes(d[1])))


def test_identities(spark):
    docs = [(1, bytearray(b"<a><error><originalForm>x</originalForm></error><error><originalForm>x</originalForm></error></a>"), None, None)]
    rows = nested.read(spark.createDataFrame(docs, SCHEMA))
    things, places = nested.objects(rows), nested.occurrences(rows)
    assert (things.count(), places.count()) == (3, 5)
    links = nested.bridge(things)
    # Every place below the root is a bridge row of its parent's object at its ordinal.
    up = places.select(F.col("file_id"), F.col("node_no").alias("parent_no"), F.col("hash").alias("parent_hash"))
    joined = places.where("parent_no > 0").join(up, ["file_id", "parent_no"]).join(links, ["parent_hash", "ordinal"]).where(F.col("child_hash") == F.col("hash"))
    assert joined.count() == 4


def test_nothing(spark):
    assert nested.field_rows(spark.createDataFrame([], SCHEMA)).collect() == []
