"""One consistent form of text (problem 3), and the words that the other operators compare.

The Spark operator `consistent_columns` explodes the texts that hold any character in question to positioned
code points, joins the decomposition and look-alike mappings by broadcast (all are bounded by Unicode), orders
combining marks by class, recomposes, and rebuilds the strings. `consistent` is the same form for one string.

The form: wide, narrow and joined presentation forms are taken apart; letters with separate accents and Hangul in parts are
composed, as in Unicode's form C; invisible characters go, but for joiners between letters of scripts that need them and
inside emoji; every blank is the plain one; letters of another script in an otherwise Latin word are Latin: those of
LOOK_ALIKE and RESEMBLING by their looks, all others by the name that Unicode gives them (a Cyrillic zhe is `zhe`). A word is otherwise
Latin if at least half of its letters are, or if it has a Latin letter and all others are in LOOK_ALIKE. Letters of scripts that
part words without blanks, as Han or Thai, and Hangul are no part of a Latin word. Quotes, dashes and words wholly in another
script stay. Null stays null, empty stays empty.
"""

from __future__ import annotations

import re
import sys
import unicodedata as U
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Letters of other scripts and the Latin letters that they look like (Greek, Cyrillic, Armenian, Cherokee, Coptic, Lisu).
LOOK_ALIKE = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχγϲϳϹͿ" "АВЕЅІЈКМНОРСТУХҮҺԁԚԜӀҒаеѕіјорсухһԛԝӏү" "ԼՍՏՕազհյոռսցօ" "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ" "ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ" "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ",
        "ABEZHIKMNOPTYXaikvopuxycjCJ" "ABESIJKMHOPCTYXYhdQWIFaesijopcyxhqwly" "LUSOwqhjnnugo" "DRTiAJEWMHYGZbRWSVSLCPKdB" "HIKMNOoPpCcTYX" "BPdDTGKJCZFMNLSRVHWXYAEIOU",
    )
)
# Letters that resemble a Latin one, but not so much that a word of another script could be taken for Latin.
RESEMBLING = dict(zip("εηστω" "вгикмнптѵь", "enotw" "brukmhntvb"))
# Characters without a width of their own.
INVISIBLE = {0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF, *range(0x202A, 0x202F), *range(0x2066, 0x2070)}
JOINERS = {"\u200c", "\u200d"}
#: Tags of the compatibility mappings that are only another look of the same letters.
PRESENTATION = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>"}
# Scripts whose letters never are a part of a Latin word.
APART = ["Han", "Hiragana", "Katakana", "Hangul", "Bopomofo", "Yi", "Tangut", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"]
_NEUTRAL = ["Latin", "Common", "Inherited", *APART]
_OTHER = regex.compile(rf"[\p{{L}}--[{''.join(rf'\p{{{x}}}' for x in _NEUTRAL)}]]", regex.V1)
_WORD_OF = regex.compile(rf"[[\p{{L}}\p{{M}}]--[{''.join(rf'\p{{{x}}}' for x in APART)}]]+", regex.V1)
_LATIN = regex.compile(r"[\p{L}&&\p{Latin}]", regex.V1)


@lru_cache(1)
def _code_points() -> str:
    """All characters that a form or a script could be asked of: of planes 2 and up only the compatibility ideographs; ideographs and Hangul have one form.

    Every Python worker looks at these once, so the many that can't matter are left out.
    """
    ranges = ((0, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xE000, 0x17000), (0x18B00, 0x20000), (0x2F800, 0x2FA20))
    return "".join(chr(cp) for a, b in ranges for cp in range(a, b))


@lru_cache(1)
def _others() -> frozenset[str]:
    """Letters of other scripts."""
    return frozenset(_OTHER.findall(_code_points()))


@lru_cache(1)
def plain() -> dict[str, str]:
    """Character -> what stands for it whatever is around: plain forms, a blank, or nothing."""
    out = {}
    for c in _code_points():
        tag = U.decomposition(c).partition(" ")[0]
        if ord(c) in INVISIBLE:
            out[c] = ""
        elif U.category(c) == "Zs" and c != " ":
            out[c] = " "
        elif tag in PRESENTATION or 0xFB00 <= ord(c) < 0xFB50 and tag:
            out[c] = U.normalize("NFKD", c)
    return out


@lru_cache(1)
def decomposition() -> dict[str, str]:
    """Character -> what stands for it before marks are ordered: `plain`, and the full canonical decomposition. Hangul syllables stay: nothing but parts can follow them."""
    return {c: U.normalize("NFD", c) for c in _code_points() if not U.is_normalized("NFD", c)} | plain()


@lru_cache(1)
def composition() -> dict[str, str]:
    """Starter + mark -> composed character, by Unicode's own pairs without its exclusions, and Hangul by its arithmetic."""
    out = {}
    for c in _code_points():
        d = U.decomposition(c)
        if d and d[0] != "<" and len(p := d.split()) == 2 and U.normalize("NFC", c) == c:
            out["".join(chr(int(x, 16)) for x in p)] = c
    for i in range(19 * 21 * 28):
        first, last = divmod(i, 28)
        pair = chr(0xAC00 + i - last) + chr(0x11A7 + last) if last else chr(0x1100 + first // 21) + chr(0x1161 + first % 21)
        out[pair] = chr(0xAC00 + i)
    return out


@lru_cache(1)
def reachable() -> dict[str, dict[str, str]]:
    """Starter -> the pairs that it and what it has been composed to take part in."""
    pairs: dict[str, list[tuple[str, str]]] = {}
    for p, made in composition().items():
        pairs.setdefault(p[0], []).append((p, made))

    def from_(c: str) -> dict[str, str]:
        out = {}
        for p, made in pairs.get(c, ()):
            out |= {p: made} | from_(made)
        return out

    return {c: from_(c) for c in pairs}


@lru_cache(1)
def latin_letters() -> dict[str, str]:
    """Letter of another script -> Latin: its look-alike, else its name in Unicode."""
    out = {}
    for c in _code_points():
        if c in LOOK_ALIKE or c in RESEMBLING:
            out[c] = LOOK_ALIKE.get(c) or RESEMBLING[c]
        elif c in _others():
            name = re.sub("[^A-Z]", "", re.split("LETTER |SYLLABLE ", U.name(c, ""), maxsplit=1)[-1]).lower()
            if name:
                out[c] = name.title() if c.isupper() else name
    return out


def _ranges(cps: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for cp in sorted(cps):
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return [tuple(x) for x in out]


@lru_cache(1)
def triggers() -> list[tuple[int, int]]:
    """Ranges of characters without one of which a text has this form already."""
    kept = set(composition().values())
    return _ranges(list({ord(c) for c in _code_points() if c in decomposition() and c not in kept or U.combining(c)} | {ord(c) for c in _others()} | {ord(p[1]) for p in composition()}))


def _classes(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


@lru_cache(1)
def trigger_java() -> str:
    """Java class of the triggers. The intersection spares Latin-1 characters the long list."""
    low, high = [r for r in triggers() if r[1] < 256], [r for r in triggers() if r[1] >= 256]
    return f"[{_classes(low)}[[^\\x{{0}}-\\x{{FF}}]&&[{_classes(high)}]]]"


TRIGGER = re.compile("[" + "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in triggers()) + "]")

# The same, in two steps: a class that is soon asked, and the few characters that it finds.
_BEYOND_LATIN_1 = re.compile("[" + "".join(f"\\x{c:02x}" for a, b in triggers() for c in range(a, min(b, 255) + 1)) + "\u0100-\U0010ffff]")
_TRIGGERS = frozenset(chr(c) for a, b in triggers() for c in range(a, b + 1))


def _asked(text: str) -> bool:
    return not text.isascii() and not _TRIGGERS.isdisjoint(_BEYOND_LATIN_1.findall(text))


# Scripts whose spelling needs joiners, and characters that emoji are built of.
_NEEDS_JOINER = r"[\x{600}-\x{8FF}\x{900}-\x{DFF}\x{1000}-\x{109F}\x{1780}-\x{18AF}\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"
_NEEDED = re.compile("(?<=[\u0600-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u18af\U0001f000-\U0001faff\u2600-\u27bf\ufe0f])([\u200c\u200d])(?=[\u0600-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u18af\U0001f000-\U0001faff\u2600-\u27bf\ufe0f])")


@lru_cache(1)
def _translation() -> dict[int, str]:
    return {ord(c): to for c, to in plain().items()}


def _latin_word(m: regex.Match) -> str:
    """A word with its letters of other scripts in Latin, if it is Latin otherwise."""
    w = U.normalize("NFD", m[0])
    table = latin_letters()
    others = [c for c in w if c in table]
    if not others:
        return m[0]
    n = len(_LATIN.findall(w))
    if n < len(others) and not (n and all(c in LOOK_ALIKE for c in others)):
        return m[0]
    # A name is several letters: a mark behind it belongs to its last one.
    return U.normalize("NFC", "".join(table.get(c, c) for c in w))


def consistent(text: str | None) -> str | None:
    """The consistent form of one string."""
    if text is None or not _asked(text):
        return text
    out = "".join(x if x in JOINERS else U.normalize("NFC", x.translate(_translation())) for x in _NEEDED.split(text))
    return _WORD_OF.sub(_latin_word, out) if _OTHER.search(out) else out


_SOFT_END = re.compile("\u00ad(?=[^\\S\n]*\n)")
_LINE_END = re.compile("([^\\W_][\u0300-\u036f]*)[-\u2010\u2011][^\\S\n]*\n\\s*(?=[^\\W_])")
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in comparable form; of null and empty none. A soft hyphen at a line's end is a hyphen; elsewhere it is nothing."""
    if not text:
        return []
    if "\n" in text:
        return WORD.findall(_LINE_END.sub(r"\1", consistent(_SOFT_END.sub("-", text))).casefold())
    return WORD.findall(consistent(text).casefold())


_HIDDEN = "".join(re.escape(chr(c)) for c in sorted(INVISIBLE))
_RUN = re.compile(f"[^\\W_](?:[^\\W_]|[\u0300-\u036f{_HIDDEN}]|[-\u2010\u2011\uff0d](?:[^\\S\n]|[{_HIDDEN}])*\n(?:\\s|[{_HIDDEN}])*(?=[^\\W_])|\u00ad[^\\S\n]*\n(?:\\s|[{_HIDDEN}])*(?=[^\\W_]))*")


def word_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Words with their places in the stored text. A word in which the form changed lengths still has the place of its run."""
    if not text:
        return []
    out = []
    for m in _RUN.finditer(text):
        out += [(w, m.start(), m.end()) for w in words(m[0])]
    return out


def is_questionable(c: Column | str) -> Column:
    """The text holds a character that the form may change."""
    return (F.col(c) if isinstance(c, str) else c).rlike(trigger_java())


def _lookup(df: DataFrame, schema: str, rows: list[tuple]) -> DataFrame:
    """A mapping table; all of them are bounded by Unicode (some ten thousand short rows at most), so they are broadcast."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    held = pa.table({n: pa.array([list(r[i].items()) if isinstance(r[i], dict) else r[i] for r in rows], kinds[x.split(" ", 1)[1]]) for i, (n, x) in enumerate(zip(names, schema.split(", ")))})
    return F.broadcast(df.sparkSession.createDataFrame(held))


def _java(scripts: list[str]) -> str:
    return "".join(rf"\p{{Is{x}}}" for x in scripts)


def rebuilt(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys`, `text` and the column `form`, the consistent form of each text. keys must be unique, texts not null.

    The texts, not the code points, are shuffled by key; the windows and the last aggregation keep that partitioning. Before
    its first code point every text has a row that stands for nothing and brings the text itself along.
    """
    # A number of its own keeps the rows, few bytes but much work, from being put together in few tasks.
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    characters = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    # Each code point with its neighbours; a lambda's argument is computed once, a column in its body would be for every code point.
    held = F.array_insert(characters(F.col(text)), 1, F.lit(""))
    around_of = lambda x: F.transform(x, lambda c, i: F.struct(i.alias("_pos"), c.alias("_c"), F.get(x, i - 1).alias("_before"), F.get(x, i + 1).alias("_after"), F.when(i == 0, F.col(text)).alias("_text")))
    cps = df.select(*keys, text).repartition(parts, *keys).select(*keys, F.inline(F.transform(F.array(held), around_of)[0]))
    composed = set(composition().values())
    table = _lookup(df, "_c string, _to string, _stable boolean", [(c, to, c in composed and bool(_LATIN.match(c))) for c, to in decomposition().items()])
    around = cps.join(table, "_c", "left")
    keeps = F.col("_c").isin(*JOINERS) & F.col("_before").rlike(_NEEDS_JOINER) & F.col("_after").rlike(_NEEDS_JOINER)
    # A composed Latin letter is taken apart only where a mark may follow it; all others would come out as they went in.
    rests = F.col("_stable") & ~F.coalesce(F.col("_after").rlike(r"^[\p{M}\p{Cf}]"), F.lit(False))
    decomposed = around.select(*keys, "_pos", "_text", F.when(F.coalesce(keeps | rests, F.lit(False)), F.col("_c")).otherwise(F.coalesce("_to", "_c")).alias("_seq")).where("_seq <> '' or _pos = 0")
    single = F.length("_seq") <= 1
    pieces = decomposed.select(*keys, "_pos", "_text", F.posexplode(F.when(single, F.array("_seq")).otherwise(characters(F.col("_seq")))).alias("_sub", "_c"))
    seconds = {p[1] for p in composition()}
    elements = _lookup(df, "_c string, _ccc int, _joins boolean, _latin string, _odd boolean", [
        (c, U.combining(c), bool(U.combining(c)) or c in seconds, latin_letters().get(c), c in latin_letters() and c not in LOOK_ALIKE)
        for c in _code_points() if U.combining(c) or c in seconds or c in latin_letters()
    ])
    # Starters, clusters (a starter and all that may join it) and words are numbered along the text.
    order = W.partitionBy(*keys).orderBy("_pos", "_sub")
    counted = lambda c: F.sum(c.cast("int")).over(order)
    in_word = F.col("_c").rlike(rf"^[[\p{{L}}\p{{M}}]&&[^{_java(APART)}]]")
    placed = pieces.join(elements, "_c", "left").withColumns({"_ccc": F.coalesce("_ccc", F.lit(0)), "_joins": F.coalesce("_joins", F.lit(False))})
    placed = placed.withColumns({"_k": counted(F.col("_ccc") == 0), "_cluster": counted(~F.col("_joins")), "_w": counted(~in_word)})
    # A letter of another script changes where its word is Latin otherwise.
    word = W.partitionBy(*keys, "_w")
    of_word = lambda c: F.sum(c.cast("int")).over(word)
    judged = placed.withColumns({"_n": of_word(F.col("_c").rlike(r"^[\p{L}&&\p{IsLatin}]")), "_others": of_word(F.col("_latin").isNotNull()), "_odds": of_word(F.coalesce("_odd", F.lit(False)))})
    mixed = (F.col("_n") > 0) & ((F.col("_n") >= F.col("_others")) | (F.col("_odds") == 0))
    chosen = judged.select(*keys, "_text", "_cluster", "_k", "_ccc", "_pos", "_sub", F.when(F.col("_latin").isNotNull() & mixed, F.col("_latin")).otherwise(F.col("_c")).alias("_c"))
    clusters = chosen.groupBy(*keys, "_cluster").agg(F.max("_text").alias("_text"), F.array_sort(F.collect_list(F.struct("_k", "_ccc", "_pos", "_sub", "_c"))).alias("_m"))
    done = composed_clusters(clusters, "_m", "_c").select(*keys, "_text", "_cluster", "_c")
    return done.groupBy(*keys).agg(F.max("_text").alias("text"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_cluster", "_c"))), lambda x: x["_c"]), "").alias("form"))


def composed_clusters(clusters: DataFrame, m: str, out: str) -> DataFrame:
    """Compose each cluster, an array of (…, _ccc, …, _c) in canonical order: an element joins the starter before it unless one of its own class, or of a higher one, stands between.

    One broadcast join brings the pairs that a cluster's starter can take part in, directly or composed; a fold over the
    elements, however many there are, does the rest. What was written for a starter may be several letters; the last one counts.
    """
    starter = F.col(m)[0]["_c"]
    pairs = _lookup(clusters, "_base string, _pairs map<string,string>", list(reachable().items()))
    joined = clusters.withColumn("_base", F.when(F.size(m) > 1, F.right(starter, F.lit(1)))).join(pairs, "_base", "left")
    zero = F.struct(F.substr(starter, F.lit(1), F.length(starter) - 1).alias("done"), F.right(starter, F.lit(1)).alias("at"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(a: Column, x: Column) -> Column:
        made = F.when((a["rest"] == "") | (a["last"] < x["_ccc"]), F.try_element_at(F.col("_pairs"), F.concat(a["at"], x["_c"])))
        return F.when(made.isNotNull(), F.struct(a["done"].alias("done"), made.alias("at"), a["rest"].alias("rest"), a["last"].alias("last"))).when(
            x["_ccc"] == 0, F.struct(F.concat(a["done"], a["at"], a["rest"]).alias("done"), x["_c"].alias("at"), F.lit("").alias("rest"), F.lit(0).alias("last"))
        ).otherwise(F.struct(a["done"].alias("done"), a["at"].alias("at"), F.concat(a["rest"], x["_c"]).alias("rest"), x["_ccc"].alias("last")))

    folded = F.aggregate(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), zero, step, lambda a: F.concat(a["done"], a["at"], a["rest"]))
    return joined.withColumn(out, F.when(F.size(m) == 1, starter).otherwise(folded)).drop("_base", "_pairs")


def consistent_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with `columns` in consistent form. Rows without a character in question pass untouched; key must be unique."""
    asked = F.lit(False)
    for c in columns:
        asked = asked | F.coalesce(is_questionable(c), F.lit(False))
    tall = questionable_texts(df, key, columns)
    forms = rebuilt(tall, [key, "side"], "text").groupBy(key).agg(*[F.max(F.when(F.col("side") == c, F.col("form"))).alias(f"_form_{c}") for c in columns])
    clean, dirty = df.where(~asked), df.where(asked)
    return clean.unionByName(dirty.join(forms, key, "left").select(*[F.coalesce(f"_form_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns]))


def questionable_texts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, side, text) of the texts that hold a character in question."""
    tall = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("text")) for c in columns])).alias("_x"))
    return tall.select(key, "_x.side", "_x.text").where(is_questionable("text"))


def changed_texts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, side) of each text that isn't in consistent form."""
    return rebuilt(questionable_texts(df, key, columns), [key, "side"], "text").where("form <> text").select(key, "side")
