"""Files in, files out."""

import time

import pytest

from paarwerk.operators.extract import pair_table
from paarwerk.sources import files, sinks
from paarwerk.streaming.ingest import drop_folder, ingest

DOC = '<root><body><page><paragraph><div>{}</div></paragraph></page></body></root>'


@pytest.fixture
def corpora(tmp_path):
    base = tmp_path / "data"
    for name, text in {"b/DE_pic_1_A_1.xml": "Das ist gut. Es ist warm heute.", "a/DE_op_1_B_2.XML": 'Er sagte "ja, komm" und ging.', "a/x.xml.pretty": "Nicht lesen bitte hier.", ".hidden/y.xml": "Nicht lesen bitte hier.", "c/bad.xml": "<"}.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(DOC.format(text))
    return [{"corpus": "LEONIDE", "base_dir": str(base), "lang_prof": "L2", "dialect": "P"}, {"corpus": "none", "base_dir": str(tmp_path / "missing")}]


def test_scan(spark, corpora):
    names = lambda **k: sorted(r.xml_file for r in files.scan_corpora(spark, corpora, **k).select("xml_file").collect())
    assert names() == ["DE_op_1_B_2.XML", "DE_pic_1_A_1.xml", "bad.xml"]
    assert names(limit=1) == ["DE_op_1_B_2.XML"]
    assert names(limit=0, exclude=[" bad.xml"]) == ["DE_op_1_B_2.XML", "DE_pic_1_A_1.xml"]
    with pytest.raises(ValueError):
        files.scan_corpora(spark, corpora, limit=-1)
    assert files.scan_corpora(spark, corpora[1:]).count() == 0


def test_csv_and_norm(spark, corpora, tmp_path):
    pairs = pair_table(files.scan_corpora(spark, corpora))
    out = str(tmp_path / "csv")
    sinks.write_pairs_csv(pairs, out, one_file=True)
    back = files.read_pairs_csv(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pairs.select(*back.columns).collect()))
    assert files.read_pairs_csv(spark, str(tmp_path / "no.csv")).count() == 0
    sinks.write_norm(pairs, str(tmp_path / "norm"), one_file=True)
    text = "".join(f.read_text() for f in (tmp_path / "norm" / "corpus=LEONIDE").glob("*.txt"))
    assert text.count("\n\n") == pairs.count() and "Das\tDas\n" in text
    assert sinks.summary(pairs).startswith(f"{pairs.count()} pairs\nLEONIDE L2")


def test_texts_and_sidecars(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"  ab\xff c \n")
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "t.txt")).collect()] == ["ab c"]
    (tmp_path / "t.meta").write_text("a=1\nb = NA\na=2\nnothing\nc=x=y\n")
    assert files.read_sidecars(spark, str(tmp_path)).first().meta == {"a": "2", "b": None, "c": "x=y"}


def test_stream(spark, corpora, tmp_path):
    stream = drop_folder(spark, corpora[0]["base_dir"], "LEONIDE", "L2", "P", files_per_batch=1)
    query = ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    end = time.time() + 120
    while query.isActive and time.time() < end:
        time.sleep(0.2)
    assert query.exception() is None
    assert spark.read.parquet(str(tmp_path / "out")).where("src is not null").count() == 3


def test_command_line(spark, corpora, tmp_path, capsys):
    import json

    from paarwerk.__main__ import main, run_stats

    (tmp_path / "r.json").write_text(json.dumps(corpora))
    main(["extract", "--registry", str(tmp_path / "r.json"), "--output-dir", str(tmp_path / "out"), "--format", "both", "--exclude", "bad.xml"])
    assert "LEONIDE L2: 3" in capsys.readouterr().out
    main(["stats", "--csv", str(tmp_path / "out" / "all_corpora.csv")])
    assert "WHOLE_CORPUS" in capsys.readouterr().out
    assert run_stats(spark, str(tmp_path / "none.csv"))["overview"].first().n_sentence_pairs == 0


def test_hidden_above_and_underscores(spark, tmp_path):
    base = tmp_path / ".hidden" / "base"
    for name in ("_a.xml", "n/_b.XML", "_d/e.xml", "_d/_f/g.xml", "n/.h/i.xml", "j.xml", "k.txt", "_l.txt"):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text("<a/>")
    found = files.scan_corpora(spark, [{"corpus": "A", "base_dir": str(base)}]).collect()
    assert sorted((r.xml_file, bytes(r.content), r.length) for r in found) == [(n, b"<a/>", 4) for n in ("_a.xml", "_b.XML", "e.xml", "g.xml", "j.xml")]


def test_excluded(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "xml_file string")
    names = lambda x: sorted(r.xml_file or "" for r in files.excluded(rows, x).collect())
    assert names([" a "]) == names(rows.where("xml_file = 'a'")) == names(spark.createDataFrame([("a",), (None,), ("a",)], "xml_file string")) == ["", "b"]
    assert names([]) == ["", "a", "b"]


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.txt", bytearray(b" 1\n")), ("b.txt", bytearray(b"")), ("none.txt", None)], "path string, content binary")
    assert sinks.write_files(rows, f"file:{tmp_path}/out") == 2
    assert sorted(r.text for r in files.read_texts(spark, f"{tmp_path}/out").collect()) == ["1"]  # a file of no bytes is no row
    assert sinks.write_files(rows.limit(0), f"{tmp_path}/out2") == 0


def test_stream_leaves_nothing_behind(spark, corpora, tmp_path):
    from paarwerk import session

    before = len(session._made)
    ingest(drop_folder(spark, corpora[0]["base_dir"], "LEONIDE", "L2", "P"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert len(session._made) == before


def test_total_row_is_last(spark, tmp_path):
    from paarwerk.__main__ import run_stats

    rows = [("Z", "L1", "f", 1, "a b c", "a b d", True, "zz"), ("a", "L1", "g", 1, "a b c", "a b d", True, "aa"), ("B", "L1", "g", 2, "a b c", "a b d", True, "U")]
    sinks.write_pairs_csv(spark.createDataFrame(rows, files.PAIRS), str(tmp_path / "c.csv"))
    tables = run_stats(spark, str(tmp_path / "c.csv"))
    firsts = {k: [r[0] for r in t.collect()] for k, t in tables.items()}
    assert firsts["overview"] == firsts["sentence count by corpus"] == ["B", "Z", "a", "WHOLE_CORPUS"]
    assert firsts["corrected pairs only"] == ["B", "Z", "a", "ALL_CORRECTED"]
    assert firsts["text types, sentences"] == firsts["text types, documents"] == ["U", "aa", "zz", "TOTAL"]
    assert firsts["corpus and text type"][-3:] == ["WHOLE_CORPUS"] * 3
