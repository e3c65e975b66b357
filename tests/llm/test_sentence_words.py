from hashlib import sha1
from zlib import crc32

from paarwerk.llm import sentences


def names(n):
    """Made-up capitalised words, all different."""
    return ["N" + sha1(b"%d" % i).hexdigest()[:10].translate(str.maketrans("0123456789", "ghiklmnopq")) for i in range(n)]


def ends(spark, texts):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "chunk_id long, src string, tgt string")
    out = {}
    for r in sentences.boundaries(df).collect():
        out.setdefault(r.chunk_id, []).append(r.end_pos)
    return {i: sorted(e) for i, e in out.items()}


def test_words_do_not_share_counts(spark):
    """Two words of one bucket of crc32: one begins sentences, the other is a name behind a title."""
    seen = {}
    for word in names(5_000):
        other = seen.setdefault(crc32(word.encode()) % 65536, word)
        if other != word:
            break
    assert other != word
    asked = [f"Wir sahen am 15. {word} kam."] * 3 + [f"Ich sah Dr. {word} dort."] * 5
    both, apart = (ends(spark, asked + [f"Es ist schön! {begins} kam."] * 60) for begins in (other, "Nach"))
    assert [both[i] for i in range(8)] == [apart[i] for i in range(8)]
    assert all(len(both[i]) == 2 for i in range(8, 68))


def test_a_large_vocabulary(spark):
    """More words than are broadcast: each text is cut as by a model that holds all words by themselves."""
    words = names(24_000)
    texts = [" ".join(f"Wir sahen Dr. {a} und {b.lower()}. {c} kam am 5. {a} dort." for a, b, c in zip(words[i::3000], words[i + 1 :: 3000], words[i + 2 :: 3000])) for i in range(2998)]
    parsed = [sentences.places(t) for t in texts]
    assert len({k for _, lefts, rights, _, _ in parsed for k in sentences.word_keys(lefts, rights)}) > 20_000
    counts, met = {}, {}
    for _ in range(sentences.ROUNDS):
        model, counts, next_met = sentences.Model(counts), sentences.defaultdict(float), sentences.defaultdict(lambda: [0.0, 0.0])
        for _, lefts, rights, lengths, _ in parsed:
            sentences.expected(lefts, rights, model.posteriors(lefts, rights, lengths, met), counts, next_met)
        met = {k: tuple(n) for k, n in next_met.items()}
    model, got = sentences.Model(counts), ends(spark, texts)
    for i, (at, lefts, rights, lengths, _) in enumerate(parsed):
        post = model.posteriors(lefts, rights, lengths, met)
        assert got[i] == [e for e, p in zip(at, post) if p > 0.5]


UNMARKED = {
    "zh": (["我们去公园玩。", "他在学校学习。", "今天天气很好。", "老师喜欢苹果。"], "今天天气很好老师喜欢苹果", [6, 12]),
    "ja": (["今日は学校へ行きました。", "たろうは本を読みます。", "明日は雨です。"], "たろうは本を読みます明日は雨です", [10, 16]),
    "de, no capitals": (["Der Hund bellt laut.", "Wir gehen heute nach Hause.", "Das Wetter ist schön.", "Meine Oma kauft Brot."], "wir gehen heute nach hause das wetter ist schön meine oma kauft brot", [26, 47, 68]),
    "en": (["The dog is very old.", "We went home late.", "My sister likes cakes."], "We went home late The dog is very old", [17, 37]),
    "hi": (["राम घर गया।", "सीता ने खाना बनाया।", "बच्चे खेल रहे हैं।"], "बच्चे खेल रहे हैं राम घर गया", [17, 28]),
    "brackets": (["(Der Hund bellt laut.)", "Wir gehen nach Hause."], "(Der Hund bellt laut) Wir gehen nach Hause", [21, 42]),
}


def test_unpunctuated_texts(spark):
    """Texts without any mark are cut between words, or characters, by what was learnt from the texts that have marks; one sentence stays one."""
    texts = [" ".join(said[i % len(said)] for i in range(k, k + 3)).replace("。 ", "。") for said, _, _ in UNMARKED.values() for k in range(8)]
    whole = ["Wir gehen heute nach Hause", "今天天气很好", "明日は雨です", "Neue Wörter stehen hier ganz allein", "राम घर गया"]
    found = ends(spark, texts + whole + [t for _, t, _ in UNMARKED.values()])
    assert [found[len(texts) + i] for i in range(len(whole))] == [[len(t)] for t in whole]
    got = {k: found[len(texts) + len(whole) + i] for i, k in enumerate(UNMARKED)}
    assert got == {k: e for k, (_, _, e) in UNMARKED.items()}


def test_unmarked_paragraphs_have_places_between_all_words():
    at, lefts, rights, lengths, inside = sentences.places("Ja gut. Nein!\n\neins zwei, drei (vier) 我们 5")
    assert at == [7, 13, 19, 30, 37, 39, 40, 42]
    assert lefts == ["P:short:gut", "=X", "Ul:eins", "Ul:drei", "Ul:vier", "Ul:我", "Ul:们", "="] and len({len(x) for x in (at, lefts, rights, lengths, inside)}) == 1
    assert sentences.word_keys(["Ul:eins"], ["u:zwei"]) == ["Ul E eins", "Ul S zwei", "Ul G eins zwei"]


def test_a_kept_model(spark):
    """A model that was trained on other texts and kept cuts as one trained on the spot does; it also knows the words of unmarked texts."""
    from paarwerk.session import new_path

    said, text, want = UNMARKED["en"]
    schema = "chunk_id long, src string, tgt string"
    learnt = spark.createDataFrame([(i, " ".join(said[(i + k) % 3] for k in range(3)), None) for i in range(8)], schema)
    path = new_path(spark, "model")
    sentences.train(learnt, path)
    asked = spark.createDataFrame([(1, text, None), (2, None, "It is late. We go!"), (3, None, "")], schema)
    got = sorted((r.chunk_id, r.side, r.end_pos) for r in sentences.boundaries(asked, model=path).collect())
    assert got == [(1, "src", e) for e in want] + [(2, "tgt", 11), (2, "tgt", 18)]
    assert sorted(map(tuple, sentences.boundaries(learnt, model=path).collect())) == sorted(map(tuple, sentences.boundaries(learnt).collect()))


def test_abbreviations_are_learnt(spark):
    """A short word that never stands without its full stop, and whose full stop never ends a text, is an abbreviation, listed or not; one that ends texts isn't."""
    assert not sentences.is_known("qxr") and not sentences.is_known("bort")
    texts = [f"Wir sahen {'Qxr. Adam' if i % 2 else 'Qxr. Berta'} am Tor {i}." for i in range(60)]
    texts += [f"Da ging er bort. Dann kam {i} Hund" + (" bort." if i % 3 else " heim.") for i in range(60)]
    found = ends(spark, texts)
    assert all(len(found[i]) == 1 for i in range(60)) and all(len(found[i]) == 2 for i in range(60, 120))


def test_a_listed_word_is_judged_by_the_texts(spark):
    """`art` is listed, but here it is an ordinary word: it stands without a full stop, and its full stop ends texts."""
    assert sentences.is_known("art")
    texts = [f"Das ist eine Art von Baum {i} hier." for i in range(40)] + ["Es war seine Art. Er ging heim.", "Das ist keine Art."] * 20
    found = ends(spark, texts)
    assert all(len(found[i]) == 2 for i in range(40, 80, 2))
