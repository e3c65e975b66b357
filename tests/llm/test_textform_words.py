import random
import unicodedata as U

import pytest
from hypothesis import given, settings, strategies as st

from paarwerk.llm import textform as T

ODD = {
    "": "", "plain": "plain", "ａｂＣ！": "abC!", "ﬁne": "fine", "über": "über", "q̣̇": "q̣̇", "Wаld": "Wald",
    "хляб ψωμί": "хляб ψωμί", "a\xa0b c": "a b c", "Wa­ld​": "Wald", "👩‍🏫": "👩‍🏫", "क्‍ष": "क्‍ष", "„ja“ – nein…": "„ja“ – nein…",
    "Ångström": "Ångström", "́x": "́x", "Ёlf": "Ëlf", "ﺍ": "ا", "ẍ̄": "ẍ̄", "a​̈": "ä", "½²№": "½²№",
}


@pytest.mark.parametrize("text", ODD)
def test_form(text):
    assert T.consistent(text) == ODD[text]
    assert T.consistent(T.consistent(text)) == T.consistent(text)


def test_operator_equals_function(spark):
    rng = random.Random(5)
    alphabet = "abü ÄßWalḍ̈́̄​‍\xad\xa0　ａＷ！ﬁаеοЖψ👩🏫क्ष하😀.\n"
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)), "wö" * 20_000, None]
    df = spark.createDataFrame([(i, t, "x" if t else None, 1) for i, t in enumerate(texts)], "pair_id long, src string, tgt string, form int")
    got = {r.pair_id: r.src for r in T.consistent_columns(df.drop("form"), "pair_id", ["src", "tgt"]).collect()}
    assert got == {i: T.consistent(t) for i, t in enumerate(texts)}
    changed = {(r.pair_id, r.side) for r in T.changed_texts(df, "pair_id", ["src", "tgt"]).collect()}
    assert changed == {(i, "src") for i, t in enumerate(texts) if T.consistent(t) != t}


def test_operator_on_nothing(spark):
    assert T.changed_texts(spark.createDataFrame([], "pair_id long, src string, tgt string"), "pair_id", ["src", "tgt"]).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_untouched_without_trigger(text):
    if not T.TRIGGER.search(text):
        assert U.normalize("NFC", text) == text


def test_words():
    assert T.words("Der Wald-\nweg, 3,50 „GRÖSSE“ Größe") == ["der", "waldweg", "3", "50", "grösse", "grösse"]
    assert T.words(None) == T.words("") == T.words("  …") == []
    assert T.words("Wald­\nweg é") == ["waldweg", "é"]


@settings(max_examples=200, deadline=None)
@given(st.text("abÄ-\n .,̈​ａ", max_size=30))
def test_spans_hold_the_words(text):
    spans = T.word_spans(text)
    assert [w for w, _, _ in spans] == T.words(text)


BEYOND = {
    "Wа̣ld": "Wạld", "Walе̣d": "Walẹd", "а" + "̖" * 5 + "́": "а" + "̖" * 5 + "́", "a" + "̖" * 5 + "́": "á" + "̖" * 5, "b" * 3 + "̧" * 9 + "̇": "bbḃ" + "̧" * 9,
    "한국": "한국", "한": "한", "ﾾￂﾤ": "하ᄂ", "ᅡᆨx": "ᅡᆨx", "কো কো": "কো কো", "ොා්": "ොා්",
    "ոice": "nice", "Ꭺpple": "Apple", "Жurnal": "Zheurnal", "журнaл": "журнaл", "kΩ": "komega".replace("o", "O", 1), "T恤 TV를 ไทยa": "T恤 TV를 ไทยa", "ёlёf": "ëlëf", "Haυs": "Haus",
}


def test_beyond_single_letters(spark):
    """Look-alikes with marks, any number of marks, Hangul in parts, second parts that are no marks, letters of any other script."""
    assert {t: T.consistent(t) for t in BEYOND} == BEYOND
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(BEYOND)], "pair_id long, src string, tgt string")
    assert [r.src for r in T.consistent_columns(df, "pair_id", ["src", "tgt"]).orderBy("pair_id").collect()] == list(BEYOND.values())


def test_operator_equals_function_on_all_kinds(spark):
    rng = random.Random(11)
    kinds = [list("abWäöạ̣̀̈̇̇"), list("аеоѕёйжψωάһ"), [p[1] for p in T.composition()][::37], [p[0] for p in T.composition()][::29], list(T.plain())[::41], list(T.decomposition())[::31], [chr(c) for c in range(0x1100, 0x1200, 5)], list(" \n.-क्ष‍‌👩​")]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "pair_id long, src string, tgt string")
    got = {r.pair_id: r.src for r in T.consistent_columns(df, "pair_id", ["src", "tgt"]).collect()}
    assert got == {i: T.consistent(t) for i, t in enumerate(texts)}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=20))
def test_form_is_of_unicode_where_nothing_else_is_asked(text):
    if not any(c in T.plain() for c in text) and not any(T._OTHER.match(c) for c in text):
        assert T.consistent(text) == U.normalize("NFC", text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=20))
def test_both_ways_to_ask_for_triggers(text):
    assert T._asked(text) == bool(T.TRIGGER.search(text))


def test_words_after_the_form():
    assert T.words("Größen-\nlehre und Wald－\xa0\nweg ạ-\nx") == ["grössenlehre", "und", "waldweg", "ạx"]
