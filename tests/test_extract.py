"""Goldens of linearising, pairing and cleaning; all texts are invented."""

import pytest
from hypothesis import given, strategies as st

from paarwerk.operators.extract import extract, problems, text_type
from paarwerk.operators.linearize import Line, linearised, with_wrappers


def p(x):
    return f'<root><body><page page_number="1">{x}</page></body></root>'


def x(body):
    return f'<kolipsi_document xmlns="urn:test"><body><exercise number="1" xml:space="preserve">{body}</exercise></body></kolipsi_document>'


def oe(o, t):
    return f'<orth_error_id12 orth_error_target="{t}">{o}</orth_error_id12>'


def err(o, t):
    return f"<error><errorType/><originalForm>{o}</originalForm><targetForm>{t}</targetForm></error>"


def para(*divs):
    return "<paragraph>" + "".join(f"<div>{d}</div>" for d in divs) + "</paragraph>"


GOLDENS = {
    "fx1": (p(para(f"Ich gehe zur {oe('schule', 'Schule')}.")), [("Ich gehe zur schule.", "Ich gehe zur Schule.", True)]),
    "fx2": (p(para("Das ist gut.", "Ich mag es sehr.")), [("Das ist gut.", "Das ist gut.", False), ("Ich mag es sehr.", "Ich mag es sehr.", False)]),
    "fx3": (p(para(f"Er kommt nicht und {oe('ihc', 'ich')} gehe allein.")), [("Er kommt nicht und ihc gehe allein.", "Er kommt nicht und gehe allein.", True)]),
    "fx4": (p(para("Ich mag <tran_foreign_word_id13>music</tran_foreign_word_id13> sehr gern.") + para("Das ist alles heute.")), [("Das ist alles heute.", "Das ist alles heute.", False)]),
    "fx5": (p(para(f"Das ist {oe('ist', '')} ein Hund.")), [("Das ist ist ein Hund.", "Das ist ein Hund.", True)]),
    "fx5b": (p(para("Es ist gut.", f"Das ist {oe('ist', '')} ein Hund.")), [("Es ist gut.", "Es ist gut.", False), ("Das ist ist ein Hund.", "Das ist <DEL> ein Hund.", True)]),
    "fx6": (x(f"<greeting>Hallo <entity>Eva</entity></greeting>,<par/>ich habe {err('gesen', 'gesehen')} das neue Haus."), [("ich habe gesen das neue Haus.", "ich habe gesehen das neue Haus.", True)]),
    "fx7": (x("Das ist ein Bis<overwrite><under>c</under><over>s</over></overwrite>chen schwer."), [("Das ist ein Bisschen schwer.", "Das ist ein Bisschen schwer.", False)]),
    "fx8": (x("Ich gehe in <correction><deletion>die</deletion><insertion>den</insertion></correction> Wald."), [("Ich gehe in den Wald.", "Ich gehe in den Wald.", False)]),
    "fx8b": (x("Ich gehe <correction><deletion>nun</deletion></correction> in den Wald."), [("Ich gehe in den Wald.", "Ich gehe in den Wald.", False)]),
    "fx9": (x("Wie <reduction><reductionType/><reducedForm>gehts</reducedForm><unfoldedForm>geht es</unfoldedForm></reduction> dir heute?"), [("Wie geht es dir heute?", "Wie geht es dir heute?", False)]),
    "fx10": (x("Wir <strikeover><expansion>S</expansion><expansion>s</expansion></strikeover>ehen das Haus."), [("Wir Ssehen das Haus.", "Wir Ssehen das Haus.", False)]),
    "fx11": (x("<sic>Na<over>d</over>el</sic> im Heu liegt."), [("Na del im Heu liegt.", "Na del im Heu liegt.", False)]),
    "fx12": (x("Das war alles <comment>hier wird der Text abgebrochen</comment>"), []),
    "fx13": (x('Ich mag <foreign_word foreign_language="English">music</foreign_word> sehr.<par/>Das Wetter ist schön.'), [("Das Wetter ist schön.", "Das Wetter ist schön.", False)]),
    "fx14": ("<root><body>", []),
    "fx15": (x(f"Das ist {err('', 'sehr')}<palimpsest>schön</palimpsest> heute."), [("Das ist schön heute.", "Das ist sehr schön heute.", True)]),
    "fx16": (x(f"Das ist {err('<palimpsest>schon</palimpsest>', 'schön')} heute."), [("Das ist schonschon heute.", "Das ist schön heute.", True)]),
    "fx17": (x(f"Das ist {err('seh<correction><deletion>x</deletion><insertion>er</insertion></correction>', 'sehr')} gut."), [("Das ist sehxer gut.", "Das ist sehr gut.", True)]),
    "cl1": (p(para("3. Klasse ist sehr schön.")), [("Klasse ist sehr schön.", "Klasse ist sehr schön.", False)]),
    "cl3": (p(para("- Der Hund ist da.")), [("Der Hund ist da.", "Der Hund ist da.", False)]),
    "cl4": (p(para("Das ist gut.", "Zu kurz.", "Es ist sehr warm.")), [("Das ist gut.", "Das ist gut.", False), ("Es ist sehr warm.", "Es ist sehr warm.", False)]),
    "cl5": (p(para("Das ist ein H*nd.", "Schreib an a@b jetzt.")), []),
    "cl6": (p(para("Das ist gut.", "DAS IST GUT.")), [("Das ist gut.", "Das ist gut.", False)]),
    "empty": ("", []),
}
STRICT = {
    "fx3": [("Er kommt nicht und ihc gehe allein.", "Er kommt nicht und ich gehe allein.", True)],
    "fx16": [("Das ist schon heute.", "Das ist schön heute.", True)],
    "fx17": [("Das ist seher gut.", "Das ist sehr gut.", True)],
}


def rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc, r.sent_num)):
        out.setdefault(r.doc, []).append((r.sent_num, r.src, r.tgt, r.corrected))
    return out


def files(spark, names):
    data = [(k, bytearray(GOLDENS[k][0].encode()), "P" if GOLDENS[k][0].startswith("<root") else "X") for k in names] + [("null", None, "P"), ("bad bytes", bytearray(b"<root><body><paragraph><div>Das ist\xff gut.</div></paragraph></body></root>"), "P")]
    return spark.createDataFrame(data, "doc string, content binary, dialect string")


def test_goldens(spark):
    got = rows(extract(files(spark, GOLDENS)))
    want = {k: [(i, *r) for i, r in enumerate(v[1], 1)] for k, v in GOLDENS.items() if v[1]}
    assert got == want | {"bad bytes": [(1, "Das ist gut.", "Das ist gut.", False)]}
    assert {r.doc for r in problems(files(spark, GOLDENS)).collect()} == {"fx14", "empty"}


def test_strict(spark):
    assert rows(extract(files(spark, STRICT), strict=True)) == {k: [(i, *r) for i, r in enumerate(v, 1)] for k, v in STRICT.items()} | {"bad bytes": [(1, "Das ist gut.", "Das ist gut.", False)]}


def test_same_pair_in_two_documents_stays(spark):
    one = [(k, bytearray(GOLDENS["fx1"][0].encode()), "P") for k in ("a", "b")]
    assert len(rows(extract(spark.createDataFrame(one, "doc string, content binary, dialect string")))) == 2


def test_no_files(spark):
    assert extract(spark.createDataFrame([], "doc string, content binary, dialect string")).collect() == []


def test_wrappers_keep_line_breaks():
    wrapped = with_wrappers("<a>x <b/> <c/>\n <d/></a>")
    assert wrapped.endswith("<c/>\n <d/></a>") and "</SPACEWRAPPER><b/><SPACEWRAPPER> </SPACEWRAPPER><c/>" in wrapped
    assert with_wrappers("<a>x\n<b/></a>") == "<a>x\n<b/></a>"


@pytest.mark.parametrize("tag", ["symbol", "emoticon", "unreadable"])
def test_dropped_content_keeps_what_follows(tag):
    assert linearised(x(f"Ich <{tag}>weg</{tag}> bin da."), "X") == [("Ich bin da.", "Ich bin da.")]


def test_deep_and_long():
    assert linearised(p(para("wort " * 50_000)), "P")[0][0].count("wort") == 50_000


@given(st.lists(st.tuples(st.text(" ab.,!x\n", max_size=6), st.booleans()), max_size=8))
def test_line_has_no_double_blanks(parts):
    line = Line()
    for text, glued in parts:
        line.write(text, glued)
        line.gap()
    out = line.text()
    assert "  " not in out and out == out.strip() and " ." not in out


def test_text_type(spark):
    names = [("LEONIDE", "DE_pic_1_a_1.xml"), ("LEONIDE", "DE_op_1_a_2.xml"), ("Kolipsi_2", "a_1.xml"), ("Kolipsi_2", "a_2.xml"), ("Kolipsi_2", "a_3.xml"), (None, None)]
    got = spark.createDataFrame(names, "corpus string, xml_file string").select(text_type("corpus", "xml_file").alias("t")).collect()
    assert [r.t for r in got] == ["picture story", "opinion", "picture story", "opinion", "unknown", "unknown"]
