from datetime import datetime

from paarwerk.llm import splits as S
from paarwerk.session import new_path

EARLY, UNTIL, LATE = datetime(2024, 1, 1), "2024-06-01", datetime(2024, 12, 1)


def test_a_text_that_changes_its_writer(spark):
    corpora = spark.createDataFrame([("Kolipsi_2",)], "corpus string")
    pairs = spark.createDataFrame([(i, "Kolipsi_2", f"w{i}_1.xml", EARLY) for i in range(60)], "pair_id long, corpus string, xml_file string, loaded_at timestamp")
    alias = spark.createDataFrame([], "corpus_a string, author_a string, corpus_b string, author_b string, noted_at timestamp")

    def run(meta):
        rows = spark.createDataFrame([(i, "Kolipsi_2", f, a, LATE) for i, (f, a) in enumerate(meta)], "meta_id long, corpus string, xml_file string, author_id string, delivered_at timestamp")
        out = S.two_batches(pairs, rows, alias, corpora, paths=(new_path(spark, "c"), new_path(spark, "c")), until=UNTIL)
        return {r.node: r for r in out.collect()}

    texts = spark.createDataFrame([(f"Kolipsi_2/w{i}", 1) for i in range(60)], "node string, n long")
    before = {r.node.partition("/")[2]: r.split for r in S.update(texts, spark.createDataFrame([], "a string, b string"), new_path(spark, "c")).collect()}
    a, c, d, *_ = [w for w, s in before.items() if s == "train"]
    b, e, *_ = [w for w, s in before.items() if s == "test"]
    # a's text is b's, who has another split; c's is d's, who has the same; e's is of a writer without a text so far.
    after = run([(f"{a}_1.xml", b), (f"{c}_1.xml", d), (f"{e}_1.xml", "fresh")])
    assert after[f"Kolipsi_2/{b}"].split == S.QUARANTINE and after[f"Kolipsi_2/{b}"].merged == 2
    assert after["Kolipsi_2/fresh"].split == "test" and after["Kolipsi_2/fresh"].n == 1
    assert sum(r.n for r in after.values()) == 60
    assert all(after[f"Kolipsi_2/{w}"].split == s for w, s in before.items() if w != b)
