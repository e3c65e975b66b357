"""Goldens of segmentation, cleaning, numbering, statistics and alignment."""

import random

import pytest
from pyspark.sql import functions as F

from paarwerk.operators import align, clean, segment, stats

SENTENCES = {
    "Das ist gut. Danach gehen wir.": ["Das ist gut.", "Danach gehen wir."],
    "Wir warten... dann gehen wir.": ["Wir warten. dann gehen wir."],
    "1) Hunde sind toll.": ["Hunde sind toll."],
    "Erstens: 1) Hunde.": ["Erstens: 1) Hunde."],
    'Er sagt "Das ist sehr schön heute" und geht.': ["Er sagt Das ist sehr schön heute und geht."],
    "": [],
    " \n ": [],
    "?!": [],
    "Ohne Ende": ["Ohne Ende"],
}


def test_sentences(spark):
    df = spark.createDataFrame([(k,) for k in SENTENCES] + [(None,)], "t string")
    got = {r.t: r.s for r in df.select("t", segment.sentences("t").alias("s")).collect()}
    assert got == SENTENCES | {None: []}


def test_cleaned(spark):
    texts = {"3. Klasse ist sehr schön.": "Klasse ist sehr schön.", "He! Das ist gut.": "! Das ist gut.", "- Der Hund ist da.": "Der Hund ist da.", "Zu kurz.": None, "Das ist ein H*nd.": None, "Die Aufgabe 2 abgebrochen war lang": None, "Der Text ist hier abgebrochen worden": None, "": None}
    df = spark.createDataFrame([(k, k) for k in texts], "key string, src string").withColumn("tgt", F.col("src"))
    got = {r.key: r.src for r in clean.filtered(df).collect()}
    assert got == {k: v for k, v in texts.items() if v}


def test_first_and_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["X", "x", "y", None]), rng.choice(["1", "2"])) for i in rng.sample(range(60_000), 3000)]
    df = spark.createDataFrame(rows, "doc string, pos long, src string, tgt string")
    seen, want = set(), set()
    for r in sorted(rows, key=lambda r: r[1]):
        key = (r[0], r[2] and r[2].lower(), r[3].lower())
        if key not in seen:
            seen.add(key)
            want.add(r)
    assert {tuple(r) for r in clean.first_of_each(df, ["doc"], ["pos"]).collect()} == want
    by = {}
    for r in sorted(rows, key=lambda r: r[1]):
        by[r[1]] = sum(1 for q in rows if q[0] == r[0] and q[1] <= r[1])
    assert {r.pos: r.n for r in clean.numbered(df, ["doc"], "pos", "n", block=500).collect()} == by


def pairs(spark, rows):
    return spark.createDataFrame(rows, "corpus string, lang_prof string, xml_file string, src string, tgt string, corrected boolean, text_type string")


GOLDEN = [
    ("A", "L1", "f1", "ich sehe dich", "ich sehe Dich", True, "opinion"),
    ("A", "L1", "f1", "das ist gut", "das ist gut", False, "opinion"),
    ("B", "L2", "f2", "wir gehen heim", "wir gehen heim", False, "unknown"),
]


def test_overview(spark):
    got = {r.corpus: tuple(r)[1:9] for r in stats.corpus_overview(pairs(spark, GOLDEN)).collect()}
    assert got == {"A": (2, 4, 12, 7, 3.0, 1, 1, "50.0%"), "B": (1, 2, 6, 3, 3.0, 0, 1, "0.0%"), "WHOLE_CORPUS": (3, 6, 18, 10, 3.0, 1, 2, "33.33%")}


def test_null_groups_count_in_totals_only(spark):
    got = {r.corpus: r.n_sentence_pairs for r in stats.corpus_overview(pairs(spark, [*GOLDEN, (None, None, None, None, "", None, None)])).collect()}
    assert got == {"A": 2, "B": 1, "WHOLE_CORPUS": 4}


def test_statistics_of_nothing(spark):
    none = pairs(spark, [])
    assert [tuple(r)[:5] for r in stats.corpus_overview(none).collect()] == [("WHOLE_CORPUS", 0, 0, 0, 0)]
    assert stats.corrected_only(none).collect() == []
    assert stats.correction_breakdown(none).collect() == []
    assert len(stats.correction_summary(none).collect()) == 3
    assert stats.corpus_by_text_type(none).collect() == []


def test_additive_and_not(spark):
    rows = {r.corpus: r for r in stats.corpus_overview(pairs(spark, GOLDEN)).collect()}
    assert rows["A"].words + rows["B"].words == rows["WHOLE_CORPUS"].words


def test_types(spark):
    got = {(r.corpus, r.text_type): (r.sentence_count, r.percentage) for r in stats.corpus_by_text_type(pairs(spark, GOLDEN)).collect()}
    assert got == {("A", "opinion"): (2, "100.0%"), ("B", "unknown"): (1, "100.0%"), ("WHOLE_CORPUS", "opinion"): (2, "66.67%"), ("WHOLE_CORPUS", "unknown"): (1, "33.33%")}
    docs = {r.text_type: (r.document_count, r.total_sentences, r.avg_sentences_per_doc, r.percentage) for r in stats.documents_by_text_type(pairs(spark, GOLDEN)).collect()}
    assert docs == {"opinion": (1, 2, 2.0, "50.0%"), "unknown": (1, 1, 1.0, "50.0%"), "TOTAL": (2, 3, 1.5, "100.00%")}


@pytest.mark.parametrize(
    "src, tgt, want",
    [("Das ist ist", "Das ist", "Das\tDas\nist\tist\nist\t\n"), ("ist", "<DEL>", "ist\t\n"), ("", "", ""), ("", "<DEL>", ""), (" a b ", "c", "a\tc\nb\t\n")],
)
def test_norm(spark, src, tgt, want):
    assert spark.range(1).select(align.norm_block(F.lit(src), F.lit(tgt)).alias("b")).first().b == want


def test_full_stops_that_belong_to_a_word(spark):
    texts = {"Das kostet ca. 5 Euro. 6 Leute": ["Das kostet ca. 5 Euro.", "6 Leute"], "am 3. 5. war": ["am 3. 5. war"], "Plan B. 4 Tage": ["Plan B. 4 Tage"], "z.B. 7 und usw. 8": ["z.B. 7 und usw. 8"]}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r.t: r.s for r in df.select("t", segment.sentences("t").alias("s")).collect()} == texts


def test_many_sentences(spark):
    n = 100_000
    df = spark.createDataFrame([("„Das ist 1 Satz. " * n,)], "t string")
    assert df.select(F.size(segment.merged(F.split("t", segment.CUT))).alias("n")).first().n == n + 1


def test_fragments_go_on(spark):
    rows = [(["Ein Hund", "bellt.", "laut", "Er geht."], ["Ein Hund bellt. laut Er geht."]), (["a.", "b.", "C.", "D"], ["a. b.", "C.", "D"]), ([], []), (["x"], ["x"])]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, p array<string>")
    assert [r.m for r in df.orderBy("i").select(segment.merged(F.col("p")).alias("m")).collect()] == [r[1] for r in rows]


def test_documents_are_files_of_a_corpus(spark, tmp_path):
    from paarwerk.plans import queries

    rows = [(1, "A", "f", "x", "y"), (2, "a ", "f", "X", "y"), (3, "B", "f", "x", "y"), (4, "A", None, "x", "y"), (5, "A", None, "x", "y"), (6, None, "f", "x", None)]
    spark.createDataFrame(rows, "pair_id long, corpus string, xml_file string, src string, tgt string").write.parquet(f"{tmp_path}/all_corpora.parquet")
    assert sorted(r.pair_id for r in queries.dedup_first(spark, str(tmp_path)).collect()) == [1, 3, 4, 5, 6]
    assert {r.pair_id: r.new_num for r in queries.renumber(spark, str(tmp_path)).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
    assert {r.pair_id: r.block for r in queries.norm_lines(spark, str(tmp_path)).collect()}[6] == "x\t\n"
