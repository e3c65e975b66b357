import random

import pytest

from paarwerk.llm import leaks, repetition as R, sampling, sentences, tokenize
from paarwerk.llm.queries import TOKENIZERS
from paarwerk.llm.textform import words

VOCABULARY = f"{TOKENIZERS}/{tokenize.VOCABULARY}"
DOCS = "doc_id long, text string, source string, share double, item_id long"


def random_text(rng, n):
    return " ".join(rng.choice("a b c d e f g h und der".split()) for _ in range(n))


def test_leaks(spark):
    rng = random.Random(1)
    items = [(i, random_text(rng, rng.choice([0, 5, 12, 40]))) for i in range(40)] + [(90, None), (91, "kurz"), (92, random_text(random.Random(9), 30)), (93, random_text(random.Random(9), 30))]
    docs = [(i, random_text(rng, 30) + ", " + " ".join((rng.choice(items)[1] or "").upper().split()[3:18]) + "! " + random_text(rng, 20), None, None, None) for i in range(60)]
    docs += [(100, None, None, None, None), (101, "", None, None, None), (102, "x " * 100_000 + items[2][1], None, None, None)]
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = {(d, i) for d, t, *_ in docs for w in [words(t)] for k in range(len(w) - 9) for i in grams.get(tuple(w[k : k + 10]), ())}
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in leaks.leaked_items(*frames).collect()) == sorted(want) and want
    assert leaks.leaked_items(frames[0], frames[1].limit(0)).collect() == []
    cleaned = {r.doc_id: r for r in leaks.without_leaks(*frames).collect()}
    assert set(cleaned) == {d for d, _ in want}
    for r in cleaned.values():
        assert r.dropped == (r.text is None) and (r.dropped or len(words(r.text)) == r.words - r.removed_words)


def test_shards_of_items(spark):
    items = spark.createDataFrame([(i, "w " * 30) for i in range(10)], "item_id long, text string")
    assert [len(s) for s in leaks.item_shards(items, 100)] == [3, 3, 3, 1]


def test_many_items_meet_by_shuffle(spark, monkeypatch):
    """Both ways find the same: the broadcast one, and the one for more items than are broadcast, in several shards and blocks."""
    rng = random.Random(5)
    items = [(i, random_text(rng, rng.choice([0, 9, 10, 11, 30]))) for i in range(60)] + [(91, "a a a a " * 9), (92, None), (93, items_text := random_text(rng, 25)), (94, items_text)]
    docs = [(i, random_text(rng, 15) + " " + (rng.choice(items)[1] or "") + " " + random_text(rng, 15), None, None, None) for i in range(80)]
    docs += [(200, None, None, None, None), (201, "", None, None, None), (202, "a " * 500, None, None, None)]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    few = sorted(tuple(r) for r in leaks.leaked_items(*frames).collect()), sorted(tuple(r) for r in leaks.without_leaks(*frames).collect())
    monkeypatch.setattr(leaks, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(leaks, "SHARD_WORDS", 200)
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 100)
    many = sorted(tuple(r) for r in leaks.leaked_items(*frames).collect()), sorted(tuple(r) for r in leaks.without_leaks(*frames).collect())
    assert few == many and few[0] and few[1]


def test_every_window_goes_where_its_equal_goes():
    rng = random.Random(6)
    for _ in range(300):
        seq = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        cut = leaks.stretches(seq, 10)
        own = {}
        for h, x, y in cut:
            for i in range(x, y - 9):
                assert own.setdefault(tuple(seq[i : i + 10]), h) == h
        assert {i for _, x, y in cut for i in range(x, y - 9)} == set(range(max(0, len(seq) - 9)))


def test_repetition_against_definition():
    rng = random.Random(2)
    for _ in range(300):
        w = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        covered = {j for k in range(len(w) - 3) if any(w[m : m + 4] == w[k : k + 4] for m in range(k)) for j in range(k, k + 4)}
        assert R.repeated_words(w) == len(covered)


def test_repetition_operator(spark):
    docs = [(1, "ja das ist so " * 10, "s", None, None), (2, "eins zwei drei vier fünf sechs sieben acht neun", "s", None, None), (3, None, None, None, None), (4, "", None, None, None), (5, "a b c d a b c", "t", None, None)]
    got = {r.doc_id: r for r in R.judged(spark.createDataFrame(docs, DOCS)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1].fails_runs and not any(got[i].fails_runs for i in (2, 3, 4, 5))
    assert got[3].share == 0 and got[3].n_words == 0 and got[1].rate > got[5].rate > 0
    assert R.judged(spark.createDataFrame([], DOCS)).collect() == []


def test_every_high_share_is_a_suspect(spark):
    """Whatever the host's rate, no document that the exact rule finds is lost; the host decides about those just below it."""
    docs = [(n * 100 + k, " ".join(["a b c d"] * 2 + [f"x{i}" for i in range(n - 8)]) if k else " ".join(f"y{i}" for i in range(n)), f"s{k % 3}", None, None) for n in range(8, 40) for k in range(4)]
    got = R.judged(spark.createDataFrame(docs, DOCS)).collect()
    assert all(r.suspect for r in got if r.fails_runs) and any(r.fails_runs for r in got) and not all(r.suspect for r in got)


def test_tokens(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCABULARY)
    lib.encode_special_tokens = True
    texts = ["Der Wald.", "", None, "<|endoftext|>", " \n\n x", "a" * 500, "ab" * 300, "Waldaaa" * 100, "don't WE'LL 12 é é 👩‍🏫 日本", "\x00\x01", "ü" * 99] + [random_text(random.Random(i), 50) for i in range(30)]
    encoded = tokenize.encode(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int"), VOCABULARY)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in tokenize.decode(encoded, VOCABULARY).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_sample(spark):
    rng = random.Random(3)
    corpora = spark.createDataFrame([("LEONIDE",), ("Kolipsi_2",)], "corpus string")
    rows = [(i, rng.choice(["LEONIDE", "leonide", "Kolipsi-2", None]), rng.choice(["opinion", "Picture_Story", None, "letter"]), rng.choice([True, False, None]), 5) for i in range(6000)]
    targets = [(1, "LEONIDE", "opinion", True, 300, 10), (2, "LEONIDE", "picture story", False, 100, 10), (3, "Kolipsi_2", "opinion", False, 600, 5), (4, "Kolipsi_2", "unknown", True, 0, 20)]
    frames = spark.createDataFrame(rows, "pair_id long, corpus string, text_type string, corrected boolean, target_id int").repartition(70), spark.createDataFrame(targets, "target_id int, corpus string, text_type string, corrected boolean, target_permille int, min_rows int"), corpora
    drawn, report = sampling.sample(*frames)
    drawn, report = drawn.collect(), {r.target_id: r for r in report.collect()}
    n = 6000 // 5
    cell = lambda r: {("LEONIDE", "opinion", True): 1, ("LEONIDE", "picturestory", False): 2, ("Kolipsi_2", "opinion", False): 3}.get(({"l": "LEONIDE", "k": "Kolipsi_2"}.get((r[1] or "?")[0].lower()), (r[2] or "").lower().replace("_", "").replace(" ", ""), r[3]))
    have = {t: {r[0] for r in rows if cell(r) == t} for t in (1, 2, 3)}
    for t, wanted in ((1, 360), (2, 120), (3, 720), (4, 20)):
        got = [r.pair_id for r in drawn if r.target_id == t]
        assert len(got) == len(set(got)) == report[t].drawn == min(wanted, len(have.get(t, ()))) and set(got) <= have.get(t, set())
        assert (report[t].wanted, report[t].missing) == (wanted, wanted - len(got))
    assert {r.pair_id for r in sampling.sample(*frames)[0].collect()} == {r.pair_id for r in drawn}
    assert {r.pair_id for r in sampling.sample(frames[0].repartition(3, "text_type"), *frames[1:])[0].collect()} == {r.pair_id for r in drawn}
    empty = sampling.sample(frames[0].limit(0), *frames[1:])
    assert empty[0].collect() == [] and {r.target_id: r.wanted for r in empty[1].collect()} == {1: 10, 2: 10, 3: 5, 4: 20}


def test_every_row_is_as_likely(spark):
    import pandas as pd

    counts = [0] * 40
    for seed in range(400):
        rows = pd.DataFrame({"pair_id": range(seed * 40, seed * 40 + 40), "target_id": 1, "num": 10, "den": 40, "part": 0})
        out = sampling.flight(rows, 0)
        assert (out["num"] == 40).sum() == 10 and out["num"].isin([0, 40]).all()
        for i in out[out["num"] == 40]["pair_id"]:
            counts[i % 40] += 1
    assert 60 < min(counts) and max(counts) < 145


SENTENCES = [
    ("Das ist gut. Danach gehen wir!", ["Das ist gut.", "Danach gehen wir!"]),
    ("Dr. Mai wohnt in der Talstr. Nr. 5. Am 3. Mai kam er.", ["Dr. Mai wohnt in der Talstr. Nr. 5.", "Am 3. Mai kam er."]),
    ("Wir warteten ... und nichts kam.", ["Wir warteten ... und nichts kam."]),
    ('"Come here!" said Ann. Stop!', ['"Come here!" said Ann.', "Stop!"]),
    ("„Wo ist er? Keiner weiß es.“ und lachte.", ["„Wo ist er? Keiner weiß es.“ und lachte."]),
    ("太好了！！月月说：“我去。”（很好。）", ["太好了！！", "月月说：“我去。”", "（很好。）"]),
    ("“快来！”月月说。走吧！", ["“快来！”月月说。", "走吧！"]),
    ("けんは「行こう。」と言った。はい。", ["けんは「行こう。」と言った。", "はい。"]),
    ("रवि रहता है। डॉ. मीना गए।", ["रवि रहता है।", "डॉ. मीना गए।"]),
    ("هل رأى مدينة؟ قال د. سامر نعم.", ["هل رأى مدينة؟", "قال د. سامر نعم."]),
    ("แก้วไปตลาด ฟ้าซื้อแอปเปิล3.5กิโลกรัม", ["แก้วไปตลาด", "ฟ้าซื้อแอปเปิล3.5กิโลกรัม"]),
    ("Ohne Punkt\n\nUnd noch\neine Zeile", ["Ohne Punkt", "Und noch\neine Zeile"]),
    ("(Es war in Bach.) Ende\xa0", ["(Es war in Bach.)", "Ende"]),
    ("Es kostet 3,50 Euro bzw. 1.200 Kronen.", ["Es kostet 3,50 Euro bzw. 1.200 Kronen."]),
    ("", []), (" \n\n ", []), (None, []),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, t, t, "x", 1) for i, (t, _) in enumerate(SENTENCES)] + [(99, "Wort. " * 20_000, "", "x", 2)], "chunk_id long, src string, tgt string, side string, ends int")
    rows = sorted(sentences.boundaries(df).collect(), key=lambda r: (r.chunk_id, r.side, r.sent_no))
    for i, (t, want) in enumerate(SENTENCES):
        for side in ("src", "tgt"):
            own = [r for r in rows if r.chunk_id == i and r.side == side]
            assert [r.sentence for r in own] == want
            if own:
                assert own[-1].end_pos == len(t.rstrip()) and [r.sent_no for r in own] == list(range(1, len(own) + 1))
    assert sum(r.chunk_id == 99 for r in rows) == 20_000
    assert sentences.boundaries(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", [". . .", "((((", "»»»", "“”“”", "1) 2) 3)", "'''", "\x00.", "a.b.c.", "?!?!", "。。", "「「」」。"])
def test_odd_marks_do_not_break(text):
    ends, lefts, rights, lengths, inside = sentences.places(text)
    assert ends and ends[-1] == len(text.rstrip()) and ends == sorted(set(ends)) and len({len(x) for x in (ends, lefts, rights, lengths, inside)}) == 1
