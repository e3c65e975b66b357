import random

import pytest
from pyspark.sql import functions as F

from paarwerk.llm import overlap as O, splits as S
from paarwerk.llm.textform import words
from paarwerk.session import new_path

PAIRS = "pair_id long, corpus string, lang_prof string, xml_file string, src string, tgt string, data_split string, loaded_at timestamp, node string, n int"
META = "meta_id long, corpus string, xml_file string, author_id string, delivered_at timestamp"
ALIAS = "alias_id long, corpus_a string, author_a string, corpus_b string, author_b string, noted_at timestamp"


def world(spark, rng, n=400):
    names = ["LEONIDE", "leonide ", "Kolipsi-2", "Kolipsi_2", "kolipsi_1_l2", None]
    codes = [f"{i}X{i}A{i}" for i in range(30)]
    files = [f"DE_pic_1_{c}_{i}.xml" for i, c in enumerate(codes)] + [f"{c}_{i % 3}.xml" for i, c in enumerate(codes)] + ["odd.xml", "a_b.xml", "  ", None]
    spell = [lambda f: f, lambda f: f and f.upper(), lambda f: f and f"data/{f} ", lambda f: f and f"x\\y\\{f}"]
    pairs = [(i, rng.choice(names), None, rng.choice(spell)(rng.choice(files)), "s", "t", "train", None, "clash", 7) for i in range(n)]
    meta = [(i, rng.choice(names), rng.choice(files), rng.choice([None, "NA", " ", *codes, codes[0].lower() + " "]), None) for i in range(40)]
    alias = [(i, rng.choice(names), rng.choice(codes) + rng.choice(["", " "]), rng.choice(names), rng.choice([*codes, None])) + (None,) for i in range(12)]
    corpora = [("LEONIDE", "L2", "P"), ("Kolipsi_1_L2", "L2", "X"), ("Kolipsi_2", "L2", "X")]
    frames = [spark.createDataFrame(r, s) for r, s in ((pairs, PAIRS), (meta, META), (alias, ALIAS), (corpora, "corpus string, lang_prof string, dialect string"))]
    return frames, pairs, meta, alias, corpora


def plain_groups(pairs, meta, alias, corpora):
    import re

    key = lambda c: re.sub(r"[-\s_]+", "_", c.strip().lower())
    names = {key(c): c for c, *_ in corpora}
    corpus = lambda c: None if c is None else names.get(key(c), key(c))
    file = lambda f: None if f is None else re.split(r"[/\\]", f.strip())[-1].strip().lower() or None
    code = lambda a: None if a is None or a.strip().lower() in ("", "na") else a.strip().lower()
    given = {}
    for m, c, f, a, _ in sorted(meta):
        if code(a) and corpus(c) and file(f):
            given[corpus(c), file(f)] = code(a)

    def own(c, f):
        stem = re.sub(r"\.xml$", "", f)
        if c == "LEONIDE":
            return stem.split("_")[3] if f.count("_") >= 3 else stem
        return f.rpartition("_")[0] if "_" in f else stem

    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, ca, a, cb, b, _ in alias:
        if ca and cb and code(a) and code(b):
            up[root((corpus(ca), code(a)))] = root((corpus(cb), code(b)))
    groups = {}
    for i, c, _, f, *_ in pairs:
        if corpus(c) and file(f):
            t = (corpus(c), file(f))
            groups.setdefault(root((t[0], given.get(t) or own(*t))), {}).setdefault(t, []).append(i)
    return {(i, min(j for t in g.values() for j in t)) for g in groups.values() if len(g) > 1 for t in g.values() for i in t}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    frames, *rows = world(spark, random.Random(seed))
    assert {tuple(r) for r in S.found(*frames).collect()} == plain_groups(*rows)


def test_splits_keep_groups_and_shares(spark):
    frames, *rows = world(spark, random.Random(3), 1500)
    got = S.splits(*frames, path=new_path(spark, "components")).collect()
    assert len(got) == 1500 and all(r.split in S.SHARES for r in got)
    by = {}
    for r in got:
        by.setdefault(r.group_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    assert abs(sum(r.split == "train" for r in got) / 1500 - 0.8) < 0.05


def test_later_batch_keeps_splits_and_quarantines(spark):
    nodes = [(f"w{i}", 10) for i in range(60)]
    texts = spark.createDataFrame(nodes, "node string, n long")
    none = spark.createDataFrame([], "a string, b string")
    first = S.update(texts, none, new_path(spark, "c"))
    split = {r.node: r.split for r in first.collect()}
    assert {s: sum(v == s for v in split.values()) for s in S.SHARES} == {"train": 48, "validation": 6, "test": 6}
    a = next(n for n, s in split.items() if s == "train")
    b = next(n for n, s in split.items() if s == "test")
    c, d = [n for n, s in split.items() if s == "train"][1:3]
    links = spark.createDataFrame([tuple(sorted(x)) for x in ((a, b), (c, d), (c, "new"))], "a string, b string")
    path = new_path(spark, "c")
    first.write.parquet(path)
    second = {r.node: r for r in S.update(spark.createDataFrame([*nodes, ("new", 5), ("fresh", 5)], "node string, n long"), links, new_path(spark, "c"), before=path).collect()}
    assert second[a].split == second[b].split == S.QUARANTINE and second[a].merged == 2
    assert second[c].split == second[d].split == second["new"].split == "train"
    assert second["fresh"].split in S.SHARES
    assert all(second[n].split == s for n, s in split.items() if n not in (a, b))


def test_quarantine_keeps_its_history(spark):
    """Three batches: what the second put in quarantine keeps the number of its splits in a third that has no link, and grows by one that has."""
    nodes = spark.createDataFrame([(f"w{i}", 10) for i in range(60)], "node string, n long")
    none = spark.createDataFrame([], "a string, b string")
    paths = [new_path(spark, "c") for _ in range(4)]
    split = {r.node: r.split for r in S.update(nodes, none, paths[0]).collect()}
    a, b, c = (next(n for n, s in sorted(split.items()) if s == x) for x in S.SHARES)
    link = lambda *x: spark.createDataFrame([tuple(sorted(x))], "a string, b string")
    S.update(nodes, link(a, b), paths[1], before=paths[0])
    third = {r.node: r for r in S.update(nodes, none, paths[2], before=paths[1]).collect()}
    assert {third[x].split for x in (a, b)} == {S.QUARANTINE} and third[a].merged == third[b].merged == 2 and sorted(third[a].had) == sorted([split[a], split[b]])
    fourth = {r.node: r for r in S.update(nodes, link(b, c), paths[3], before=paths[2]).collect()}
    assert {fourth[x].merged for x in (a, b, c)} == {3} and all(fourth[n].split == s for n, s in split.items() if n not in (a, b, c))


def test_batches_give_the_groups_of_one(spark):
    """Rows, metadata and links in three batches, each read once: the texts' groups at the end are those of all at once."""
    frames, *rows = world(spark, random.Random(9), 600)
    part = lambda df, key, i: df.where(F.pmod(F.col(key), F.lit(3)) == i)
    before = None
    for i in range(3):
        path = new_path(spark, "state")
        batch, texts = S.advance(part(frames[0], "pair_id", i), part(frames[1], "meta_id", i), part(frames[2], "alias_id", i), frames[3], path, before)
        before = path
    all_rows = S.row_texts(frames[0], frames[3])
    got = {tuple(r) for r in S.with_text(all_rows, texts.where("texts > 1").select("corpus", "file", "group_id", "n")).select("pair_id", "group_id").collect()}
    assert got == plain_groups(*rows) and batch.count() == 200


def test_long_chain(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(200)], "a string, b string")
    assert {r.component for r in S.contracted(links).collect()} == {"n000"}


def test_no_rows(spark):
    frames, *_ = world(spark, random.Random(1))
    assert S.found(*(f.limit(0) for f in frames)).collect() == []


def common(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], p + 1 if x == y else max(d[j + 1], d[j])
    return d[-1]


def near(a, b):
    return bool(a) and 5 * common(a, b) >= 4 * max(len(a), len(b))


def varied(rng, ws):
    ws = list(ws)
    for _ in range(rng.choice([0, 0, 1, 2, 3, len(ws) // 5, len(ws) // 4])):
        i = rng.randrange(len(ws) + 1)
        k = rng.random()
        if k < 0.4 and ws:
            ws[min(i, len(ws) - 1)] = f"neu{rng.randrange(99)}"
        elif k < 0.7 and len(ws) > 1:
            del ws[min(i, len(ws) - 1)]
        else:
            ws.insert(i, rng.choice(["und", "der", f"neu{rng.randrange(99)}"]))
    return ws


@pytest.mark.parametrize("seed", [1, 2])
def test_row_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["der", "die", "und", "ein", "ist"] * 6 + [f"wort{i}" for i in range(60)]
    rows, i = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 12, 20, 31, 36, 45, 70]))]
        for _ in range(rng.randint(1, 5)):
            src, tgt = " ".join(varied(rng, base)), " ".join(varied(rng, base))
            rows.append((i, rng.choice([src, src.upper(), src + "!", "ｗ".join(src.split("w")) if rng.random() < 0.2 else src]), tgt, rng.choice(["train", "train", "dev", "test", None])))
            i += 1
    rows += [(i, "", "x", "dev"), (i + 1, None, "x", "train"), (i + 2, "…", "x y", "dev"), (i + 3, "x " * 3000, "y " * 3000, "dev"), (i + 4, "x " * 2500, "y " * 3100, "train")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "pair_id long, src string, tgt string, data_split string, cls string, train int")
    got = [tuple(r) for r in O.row_pairs(df).collect()]
    cut = [(r[0], r[3], words(r[1]), words(r[2])) for r in rows]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in cut if a[1] == "train" for b in cut if b[1] in ("dev", "test") and near(a[2], b[2]) and near(a[3], b[3])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_every_near_text_holds_a_passage():
    rng = random.Random(4)
    for _ in range(2000):
        a = [str(rng.randrange(9)) for _ in range(rng.randint(1, 25))]
        b = varied(rng, a)
        if near(a, b):
            text = f" {' '.join(b)} "
            assert any(f" {' '.join(a[x:y])} " in text for x, y in O.passages(a))
            assert O.near_same(a, b) and set(O.keys_of(a, {})) & set(O.keys_of(b, {}))
        else:
            assert not O.near_same(a, b)


def test_report_counts_pairs(spark):
    corpora = spark.createDataFrame([("LEONIDE",)], "corpus string")
    rows = [(1, "leonide", "ein Hund bellt", "ein Hund bellt", "train"), (2, "LEONIDE ", "ein Hund bellt", "ein Hund bellt", "dev"), (3, None, "Ein Hund bellt!", "ein Hund bellt", "dev"), (4, None, "ein Hund bellt", "ein Hund bellt", "train")]
    got = {tuple(r) for r in O.report(spark.createDataFrame(rows, "pair_id long, corpus string, src string, tgt string, data_split string"), corpora).collect()}
    assert got == {("dev", "LEONIDE", 2, 1, 1.0), ("dev", None, 2, 1, 1.0)}


def test_large_texts_are_salted(spark, monkeypatch):
    frames, *rows = world(spark, random.Random(6), 600)
    hot = [(10_000 + i, "LEONIDE", None, "DE_pic_1_0X0A0_0.xml", "s", "t", "train", None, "clash", 7) for i in range(400)]
    frames[0] = frames[0].unionByName(spark.createDataFrame(hot, PAIRS))
    monkeypatch.setattr(S, "is_small", lambda df: False)
    assert {tuple(r) for r in S.found(*frames).collect()} == plain_groups(rows[0] + hot, *rows[1:])


def test_copies_are_one_class(spark):
    rows = [(i, "ein kleiner Hund bellt", "ein kleiner Hund bellt", "train" if i % 50 else "dev") for i in range(300)] + [(900, "ein kleiner Hund bellt sehr", "ein kleiner Hund bellt sehr", "test")]
    df = spark.createDataFrame(rows, "pair_id long, src string, tgt string, data_split string")
    near_classes, members = O.overlaps(df)
    assert near_classes.count() == 2 and members.count() == 301
    got = O.row_pairs(df).collect()
    assert len(got) == len(set(map(tuple, got))) == 6 * 294 + 294


def plain_pairs(rows):
    cut = [(r[0], r[3], words(r[1]), words(r[2])) for r in rows]
    return {(min(a[0], b[0]), max(a[0], b[0])) for a in cut if a[1] == "train" for b in cut if b[1] in ("dev", "test") and near(a[2], b[2]) and near(a[3], b[3])}


def test_hot_words_and_blocks(spark, monkeypatch):
    """One word in every tenth row, a small vocabulary, and keys with more records and texts than a block holds."""
    monkeypatch.setattr(O, "RECORD_BLOCK", 2)
    monkeypatch.setattr(O, "TEXT_BLOCK", 3)
    monkeypatch.setattr(O, "RECORDS", 4)
    rng = random.Random(8)
    rows = []
    for i in range(500):
        t = [rng.choice("abcd") for _ in range(rng.choice([2, 3, 4, 5, 6]))] + (["hot"] if i % 10 == 0 else [])
        rows.append((i, " ".join(t), " ".join(t), rng.choice(["train", "dev"])))
    df = spark.createDataFrame(rows, "pair_id long, src string, tgt string, data_split string")
    got = [tuple(r) for r in O.row_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(rows)


def test_coverage_is_of_all_texts(spark):
    """Passages that stand in different training texts add up; copies cover all."""
    corpora = spark.createDataFrame([("LEONIDE",)], "corpus string")
    a = [f"w{i}" for i in range(10)]
    one, two = a[:9] + ["x"], ["y"] + a[1:]
    rows = [(1, None, " ".join(a), " ".join(a), "dev"), (2, None, " ".join(one), " ".join(one), "train"), (3, None, " ".join(two), " ".join(two), "train")]
    schema = "pair_id long, corpus string, src string, tgt string, data_split string"
    got = [tuple(r) for r in O.report(spark.createDataFrame(rows, schema), corpora).collect()]
    assert got == [("dev", None, 2, 1, 1.0)]
    got = [tuple(r) for r in O.report(spark.createDataFrame(rows[:2], schema), corpora).collect()]
    assert got[0][4] == round(O.passages(a)[-1][0] / 10, 4)


def test_frequencies_count_every_row(spark):
    df = spark.createDataFrame([("a b a",), ("a c",), ("ü",)], "tgt string")
    n = O.Frequencies(O.frequencies(df))
    assert [n.get(w) for w in ("a", "b", "c", "ü", "none")] == [2, 1, 1, 1, 0]
