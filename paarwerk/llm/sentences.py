"""Sentence boundaries across languages and scripts (problem 6): a hidden-event n-gram language model.

A text is a stream of word and mark classes, between which a boundary token may be hidden. The model holds the chance of
a boundary after a history (the class of the word, its mark and closing signs; short words and abbreviations by
themselves), the chance of the next class after a boundary and after none, and that of very short sentences. It is
trained on the whole table by expectation-maximisation: the ends of texts and blank lines are known boundaries, the
posteriors of all others come from the forward-backward algorithm. The counts are added up by Spark. Those of classes
without a word are few and are broadcast; those of words are a table by the word itself, which is joined to the texts that
hold the word, so that no two words share their counts however many there are. The last posteriors decide.

Thai has no marks: there a boundary may be hidden at any blank. A paragraph of another script without any mark is written
without them: there a boundary may be hidden between any two words, in scripts without blanks between any two characters. What
decides is a bigram model of words (characters), counted over all texts as cut at their marks: how often a word ends sentences,
begins them, and follows the other inside one. Texts without capitals are judged by a model that knows none.

A blank line always ends a sentence, a line break alone does not. A mark inside a quotation or bracket ends no sentence if the sentence goes on behind it. Null, empty and blank
texts have no sentences; the last sentence ends with the text's last character that is no white space.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial
from math import exp, log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from paarwerk.session import materialise

ROUNDS = 3
#: Words whose counts a task holds before it hands them on; Spark adds up what several tasks or batches say of a word.
HELD_WORDS = 100_000
# Abbreviations that seldom end a sentence, in the languages at hand. They are first odds only: whether a short
# word is one is judged by all texts.
ABBREVIATIONS = frozenset(
    "dr prof fr hr frl st nr mr mrs ms jr sr z b d h u a o s v bzw evtl ca vgl ggf inkl sog str bd kap abb tel geb gest dipl ing "
    "a.m p.m dott dott.ssa sig sig.ra sigg prof.ssa pag pagg es ecc.ti art cap vol fig no vs cf e.g i.e approx dept fig gen col lt rev hon capt "
    "jan feb mär apr jun jul aug sep sept okt nov dez mt ft mme mlle डॉ श्री प्रो د أ م ق".split()
)
# What may follow the number of an ordinal; first chances only.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner klasse schuljahr stock platz jahrhundert".split())

_LETTER = r"[^\W\d_]"
_RUN = r"(?:[^\W\d_]|[̀-ͯؐ-ًؚ-ٟऀ-ःऺ-ॏॢॣัิ-ฺ็-๎­​-‍⁠])+"
_TOKEN = re.compile(
    rf"(?P<num>\d+(?:[.,:]\d+)*)|(?P<word>{_RUN}(?:(?:\.(?=[a-zà-ÿ])|(?<![^\W\d_].)\.(?={_LETTER})|['’\-])(?:{_RUN}))*)|(?P<mark>[.!?…。！？｡．।॥؟۔‽]+)|(?P<other>\S)"
)
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n|\r\n[^\S\n]*\r\n| ")
_CLOSES = {"„": "“”\"", "“": "”", "«": "»", "»": "«", '"': '"', "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "［": "］", "【": "】", "‘": "’", "‚": "‘’", "《": "》", "〈": "〉"}
_CLOSERS = set("“”\"«»」』）)]］】’》〉")
_BRACKETS = set("([（［【")


def _script(c: str) -> str:
    o = ord(c)
    if 0xE00 <= o < 0xE80:
        return "th"
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00:
        return "cjk"
    if 0x900 <= o < 0x980:
        return "hi"
    if 0x600 <= o < 0x700:
        return "ar"
    return "x"


def _mark_class(mark: str) -> str:
    if "!" in mark or "?" in mark or "؟" in mark or "‽" in mark:
        return "X"
    if any(c in mark for c in "。！？｡．।॥۔"):
        return "C"
    return "E" if "…" in mark or len(mark) > 1 else "P"


def _left_class(word: tuple[str, str, str] | None, mark: str, closed: str) -> str:
    """History class of a place behind a mark: word and mark (of a number also the word before), or what was closed behind them."""
    m = _mark_class(mark)
    if closed:
        return f"{m})" + closed
    if m == "E" and word and _script(word[1][-1]) == "cjk":
        return "Ek"
    if m != "P" or word is None:
        return m
    kind, w, before = word
    if kind == "num":
        return f"P:num:{before.lower()}" if len(w) <= 2 else "P:figure"
    low = w.lower()
    if is_short(low):
        return f"P:short:{low}"
    if len(w) == 1:
        return "P:initial" if w.isupper() else "P:letter"
    return f"P:dotted:{low}" if "." in w else "P:word"


def is_known(low: str) -> bool:
    """A word that is taken for an abbreviation until the texts say otherwise; also names of streets."""
    return low in ABBREVIATIONS or low.endswith("str")


def is_short(low: str) -> bool:
    """A word that could be an abbreviation: what the texts say of it is counted."""
    return len(low) > 1 and is_known(low) or 1 < len(low) <= 5 and "." not in low and _script(low[0]) in ("x", "hi", "ar")


#: Log odds that a known word, and any other short one, is an abbreviation, before any text is seen.
KNOWN, UNKNOWN = 5.0, -2.5


def _right_class(tokens: list[tuple[str, str, int, int]], i: int) -> str:
    if i >= len(tokens):
        return "end"
    kind, w = tokens[i][:2]
    if kind == "num":
        return "item" if i + 1 < len(tokens) and tokens[i + 1][1] in ")." and tokens[i + 1][2] == tokens[i][3] else "num"
    if kind == "mark":
        return "mark"
    if kind == "word":
        s = _script(w[0])
        if s == "cjk":
            return f"k:{w[0]}"
        if s == "th":
            return "th"
        if s != "x":
            return f"{s}:{w}"
        if not w[0].isupper():
            return "lower"
        if len(w) == 1:
            return "initial"
        return f"month:{w.lower()}" if w.lower() in MONTHS else f"cap:{w}"
    if w in _BRACKETS:
        return "open("
    if w in _CLOSES:
        return "open"
    return "punct"


def tokens_of(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, token, start, end) of every token."""
    return [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]


def places(text: str, tokens: list[tuple[str, str, int, int]] | None = None) -> tuple[list[int], list[str], list[str], list[int], list[int]]:
    """The places at which a boundary may be hidden, in order: end position, left class, right class, words since the
    place before, and the place where the enclosing quotation ends (-1: none). The left classes `end` and `blank line` are certain."""
    tokens = tokens_of(text) if tokens is None else tokens
    ends, lefts, rights, lengths, inside = [], [], [], [], []
    stack: list[list] = []  # opening sign, what came before it, its places
    word, mark, closed, mark_at = None, "", "", -1
    count = 0
    fresh = True  # nothing but marks and opening signs since the last place
    for i, (kind, w, start, end) in enumerate(tokens):
        gap = text[tokens[i - 1][3] : start] if i else ""
        if kind == "other" and w in _CLOSERS and any(w in _CLOSES.get(s[0], "") for s in stack):
            while w not in _CLOSES.get(stack[-1][0], ""):
                stack.pop()
            sign, before, held = stack.pop()
            if mark:
                closed, mark_at = ("b" if sign in _BRACKETS else "q") + before, i
            for k in held:
                inside[k] = -2 - len(ends)  # the next place, if it comes right behind this sign
            fresh = False
        elif kind == "other" and w in _CLOSERS and w not in _CLOSES and mark and not gap:
            closed, mark_at = closed or "stray", i
        elif kind == "other" and w in _CLOSES:
            before = "0" if fresh or not ends and not count else ":" if tokens[i - 1][1] in ":：,،、，" else "m"
            stack.append([w, before, []])
            mark, closed = "", ""
        elif kind == "mark":
            word_before = tokens[i - 1] if i and tokens[i - 1][0] in ("num", "word") and not gap else None
            word = (word_before[0], word_before[1], tokens[i - 2][1] if i > 1 else "") if word_before else None
            mark, closed, mark_at = w, "", i
        else:
            mark, closed = "", ""
            if kind in ("word", "num"):
                count += 1
                fresh = False
            elif kind == "other":
                fresh = False
        # Is a place behind this token?
        last = i + 1 == len(tokens)
        after = text[end : tokens[i + 1][2]] if not last else ""
        right = _right_class(tokens, i + 1)
        closes_next = not last and tokens[i + 1][0] == "other" and tokens[i + 1][1] in _CLOSERS and (any(tokens[i + 1][1] in _CLOSES.get(s[0], "") for s in stack) or tokens[i + 1][1] not in _CLOSES and not after)
        left = None
        if last:
            left = ("end", mark and _left_class(word, mark, closed))
        elif _PARAGRAPH.search(after):
            left = ("blank", mark and _left_class(word, mark, closed))
        elif mark and mark_at == i and not closes_next:
            wide = _mark_class(mark) == "C" or _mark_class(mark) == "X" or _script(tokens[i + 1][1][0]) == "cjk"
            glued = not after and not wide and not (right[:3] == "cap" and word and len(word[1]) > 2 and not closed and "…" not in mark)
            if not glued:
                left = ("", _left_class(word, mark, closed))
        elif kind in ("word", "num") and after and "\n" not in after and _script(w[-1]) == "th" and not closes_next and right not in ("punct", "mark"):
            left = ("", "th")
        if left is None:
            continue
        sure, cls = left
        ends.append(end)
        lefts.append(f"={cls or ''}" if sure else cls)
        rights.append("end" if sure == "end" else "blank" if sure else right)
        lengths.append(min(count, 9))
        inside.append(-1)
        for s in stack:
            s[2].append(len(ends) - 1)
        count, fresh = 0, True
        if sure:
            for s in stack:  # never closed: its places stand for themselves
                for k in s[2]:
                    inside[k] = -1
            stack = []
            mark = closed = ""
    for k, x in enumerate(inside):
        if x < -1:
            at = -2 - x
            # Behind the closing sign there is a place, or none: then the sentence goes on.
            inside[k] = at if at < len(ends) and _right_behind(text, tokens, ends, k, at) else -3
    return with_unmarked(text, tokens, ends, lefts, rights, lengths, inside)


def with_unmarked(text: str, tokens: list, ends: list[int], lefts: list[str], rights: list[str], lengths: list[int], inside: list[int]) -> tuple:
    """The places, and those between the words of paragraphs that have no mark: left class `Uc` or `Ul` with the word before, right class `u` with the word behind."""
    more = []
    for own in paragraphs(text, tokens):
        if not any(t[0] == "mark" for t in own) and not _is_thai(text, own):
            kind = "Uc" if _has_capitals(text, own) else "Ul"
            more += [(at, f"{kind}:{a}", f"u:{b}") for at, a, b in gaps(units(own))]
    if not more:
        return ends, lefts, rights, lengths, inside
    rows = sorted([(e, 1, k, x, r_, n) for k, (e, x, r_, n) in enumerate(zip(ends, lefts, rights, lengths))] + [(e, 0, -1, x, r_, 1) for e, x, r_ in more])
    at = {k: i for i, (_, _, k, *_) in enumerate(rows) if k >= 0}
    moved = [at.get(inside[k], inside[k]) if k >= 0 else -1 for _, _, k, *_ in rows]
    return [x[0] for x in rows], [x[3] for x in rows], [x[4] for x in rows], [x[5] for x in rows], moved


class Unit(NamedTuple):
    """A word, a character of a script without blanks, or another sign."""

    word: str
    end: int
    sign: bool


def gaps(units: list[Unit]) -> Iterator[tuple[int, str, str]]:
    """(end, word before, word behind) between two words with nothing but closing and opening signs between them: behind the closing, before the opening ones."""
    before = None
    for i, u in enumerate(units):
        if not u.sign:
            if before:
                yield before[0], before[1], u.word
            before, opened = (u.end, u.word), False
        elif before and u.word in _CLOSERS and not opened and (u.word not in _CLOSES or u.end - 1 == before[0]):
            before = (u.end, before[1])
        elif before and u.word in _CLOSES:
            opened = True
        else:
            before = None


def paragraphs(text: str, tokens: list[tuple[str, str, int, int]]) -> Iterator[list[tuple[str, str, int, int]]]:
    """The tokens of each paragraph."""
    at = 0
    if _PARAGRAPH.search(text):
        for i in range(1, len(tokens)):
            if tokens[i][2] - tokens[i - 1][3] > 1 and _PARAGRAPH.search(text, tokens[i - 1][3], tokens[i][2]):
                yield tokens[at:i]
                at = i
    if at < len(tokens):
        yield tokens[at:]


_THAI = re.compile("[\u0e00-\u0e7f]")


def _is_thai(text: str, own: list) -> bool:
    """A paragraph with Thai, whose blanks are places already."""
    return bool(_THAI.search(text, own[0][2], own[-1][3]))


def _has_capitals(text: str, own: list) -> bool:
    said = text[own[0][2] : own[-1][3]]
    return said != said.lower()


def units(own: list[tuple[str, str, int, int]]) -> list[Unit]:
    """The words, characters of scripts without blanks, and other signs of a paragraph; numbers are alike, marks left out."""
    out = []
    for k, w, start, _ in own:
        if k == "word" and _script(w[0]) == "cjk":
            out += [Unit(c, start + i + 1, False) for i, c in enumerate(w)]
        elif k != "mark":
            out.append(Unit("0" if k == "num" else w, start + len(w), k == "other"))
    return out


def _right_behind(text: str, tokens: list, ends: list[int], k: int, at: int) -> bool:
    """From the closing sign behind place k to place `at` there are only closing signs."""
    between = text[ends[k] : ends[at]]
    tail = re.search(r"[.!?…。！？｡．।॥؟۔‽]+[“”\"«»」』）)\]］】’》〉\s]*$", between)
    if not tail:
        return False
    closing = [i for i, c in enumerate(between) if c in _CLOSERS]
    return bool(closing) and closing[0] >= tail.start()


#: Chances of a boundary before any text is seen, by the longest prefix of the left class, with their weight in places.
PRIOR = {
    "P:num": (0.5, 4), "P:figure": (0.9, 4), "P:abbr": (0.01, 60), "P:initial": (0.05, 40), "P:letter": (0.1, 10), "P:dotted": (0.1, 10),
    "P:short": (0.97, 8), "P:word": (0.99, 50), "P": (0.9, 4), "E": (0.8, 10), "Ek": (0.2, 20), "X": (0.97, 30), "C": (0.999, 200), "th": (0.97, 30),
    "P)q0": (0.1, 6), "X)q0": (0.04, 20), "C)q0": (0.04, 20), "E)q0": (0.1, 6), "P)q:": (0.95, 20), "X)q:": (0.9, 20), "C)q:": (0.95, 20), "E)q:": (0.9, 10),
    "P)qm": (0.6, 4), "X)qm": (0.3, 4), "C)qm": (0.2, 6), "E)qm": (0.3, 4), "P)b0": (0.98, 20), "X)b0": (0.98, 20), "C)b0": (0.98, 20), "E)b0": (0.9, 10),
    "P)b": (0.3, 4), "X)b": (0.3, 4), "C)b": (0.3, 4), "E)b": (0.3, 4), "P)": (0.8, 4), "X)": (0.8, 4), "C)": (0.8, 4), "E)": (0.6, 4),
}
#: First chances of kinds of next classes: after a boundary, after none. Words and letters share their kind's chance.
NEXT = {
    "end": (0.22, 1e-6), "blank": (0.04, 1e-6), "cap": (0.42, 0.14), "lower": (0.01, 0.5), "num": (0.008, 0.12), "item": (0.01, 0.02), "month": (0.0005, 0.06), "initial": (0.01, 0.02),
    "open": (0.06, 0.01), "open(": (0.03, 0.01), "punct": (0.0005, 0.1), "mark": (0.0002, 0.01), **dict.fromkeys(("k", "th", "hi", "ar"), (0.05, 0.05)),
}
#: Scripts without case: that such a word follows says nothing, however many texts of other scripts there are; which word it is does.
CASELESS = frozenset(("k", "th", "hi", "ar"))
#: Weights of the first chances and of a word that is new, in places; what a capital or opening sign without a boundary loses behind an ellipsis and the like.
KIND_WEIGHT, WORD_WEIGHT, UNLIKELY = 30.0, 5.0, 0.3
#: Weights in the bigram model: of the rate of boundaries, of the words that may follow any word, and of the rate for the single word.
END_WEIGHT, FOLLOW_WEIGHT, WORD_SHARE = 4.0, 20.0, 4.0
#: Odds of a boundary that would make a sentence of one or two words out of a word with a full stop.
SHORT = {1: 0.3, 2: 0.6}


def _group(left: str) -> str:
    """What a next class without a boundary depends on."""
    if left[:2] == "P:":
        kind, _, low = left[2:].partition(":")
        kind = "abbr" if kind == "short" and is_known(low) else kind
        return kind if kind == "num" else "abbr" if kind in ("abbr", "initial", "letter", "dotted") else "word"
    return left[1:3] if ")" in left else left


def _worded(left: str) -> bool:
    """The history class names a word."""
    return left[:2] == "P:" and ":" in left[2:]


def _unmarked(left: str) -> bool:
    return left[:3] in ("Uc:", "Ul:")


def language_keys(left: str, right: str) -> tuple[str, str, str]:
    """Keys of the bigram model: the word before as the last of a sentence, the word behind as the first, and one after the other."""
    kind, a, b = left[:2], left[3:], right[2:]
    return f"{kind} E {a}", f"{kind} S {b}", f"{kind} G {a} {b}"


def word_keys(lefts: list[str], rights: list[str]) -> list[str]:
    """Keys of the words that a text's places are judged by, each once."""
    out: dict[str, None] = {}
    for left, right in zip(lefts, rights):
        if _unmarked(left):
            out |= dict.fromkeys(language_keys(left, right))
            continue
        if _worded(left):
            out[f"L {left}"] = None
            if left[:8] == "P:short:":
                out |= {f"T {left[8:]}": None, f"Z {left[8:]}": None}
        if ":" in right:
            out[f"R {right}"] = None
    return list(out)


#: (with a boundary, without) of a word that was never met.
UNMET = (0.0, 0.0)


class Model:
    """Chances from counts over the priors. The counts of words come with each text: key -> (with a boundary, without)."""

    def __init__(self, counts: dict[str, float] | None = None):
        self.n = defaultdict(float, counts or {})
        self.cache: dict[str, float] = {}

    def boundary(self, left: str, met: dict[str, tuple[float, float]]) -> float:
        p = self.cache.get(left)
        if p is None:
            base = left
            while base not in PRIOR:
                base = base.rpartition(":")[0] if ":" in base else base[:-1]
            mean, weight = PRIOR[base]
            if base == "P:short":  # between that of ordinary words and that of abbreviations
                share, (m, w) = self.abbreviated(left, met), PRIOR["P:abbr"]
                mean, weight = mean + share * (m - mean), weight + share * (w - weight)
                base = "P:abbr" if share > 0.5 else base
            yes, no = met.get(f"L {left}", UNMET) if _worded(left) else (self.n[f"L1 {left}"], self.n[f"L0 {left}"])
            if base in ("P:word", "P:short"):  # the first chance keeps a third: a word that one text repeats must not become an abbreviation
                weight += 0.5 * (yes + no)
            p = (yes + mean * weight) / (yes + no + weight)
            if not _worded(left):
                self.cache[left] = p
        return p

    def abbreviated(self, left: str, met: dict[str, tuple[float, float]]) -> float:
        """The chance that a short word is an abbreviation: it hardly ever stands without its full stop, and hardly ever with it at the end of a text or paragraph, where other words' full stops often are."""
        low = left[8:]
        (stops, without), (ends, _) = met.get(f"T {low}", UNMET), met.get(f"Z {low}", UNMET)
        rate = (self.n["T ends"] + 1) / (self.n["T stops"] + 8)
        odds = (KNOWN if is_known(low) else UNKNOWN) - (stops - ends) * log(1 - rate) + ends * log(1e-3 / rate) + without * log(0.05 / 0.9)
        return 1 / (1 + exp(-max(-30.0, min(30.0, odds))))

    def group(self, left: str, met: dict[str, tuple[float, float]]) -> str:
        """What a next class without a boundary depends on."""
        if left[:8] == "P:short:":
            return "abbr" if self.abbreviated(left, met) > 0.5 else "word"
        return _group(left)

    def next(self, right: str, b: str, met: dict[str, tuple[float, float]]) -> float:
        """Of a class after a boundary ("1") or after none ("0" and the group of what is before).

        The kind's chance, times what the word itself says for or against a boundary; a word that was never met says nothing.
        """
        kind, _, word = right.partition(":")
        key = f"R{b} {kind}"
        p = self.cache.get(key)
        if p is None:
            group, total = b[1:], self.n[f"K{b}"]
            prior = NEXT[kind][b != "1"] * (UNLIKELY if group in ("E", "q:") and kind in ("cap", "initial", "open", "open(", "item") else 1)
            # Half of the first chances stays: one kind of text must not set those of all others. Behind an ordinary word with a
            # full stop most of them stays, since places without a boundary are hardly ever sure there.
            weight = KIND_WEIGHT + total * (4 if group == "word" else 1)
            p = self.cache[key] = (self.n[f"K{b} {kind}"] + prior * weight) / (total + weight) if kind not in CASELESS else 1.0
        if word:
            yes, no = met.get(f"R {right}", UNMET)
            k1, k0 = self.n[f"K1 {kind}"] + 1, self.n[f"A0 {kind}"] + 1
            base = k1 / (k1 + k0) if b == "1" else k0 / (k1 + k0)
            p *= ((yes if b == "1" else no) + WORD_WEIGHT * base) / (yes + no + WORD_WEIGHT) / base
        return p

    def unmarked(self, left: str, right: str, met: dict[str, tuple[float, float]]) -> float:
        """Of a boundary between two words of a paragraph without marks, by the bigram model: the one ends a sentence and the other begins one, or the other follows the one."""
        kind = left[:2]
        starts, follows = self.n[f"{kind} starts"], self.n[f"{kind} follows"]
        if not starts or not follows:
            return 0.0
        end, start, pair = (met.get(k, UNMET) for k in language_keys(left, right))
        rate = self.n[f"{kind} shares"] / self.n[f"{kind} paragraphs"]
        e = (end[0] + END_WEIGHT * rate) / (end[0] + end[1] + END_WEIGHT)
        # Of a word that was met a few times only, whether it begins sentences is known as little.
        met_ = start[0] + start[1] + 0.5
        inside = (start[1] + WORD_SHARE * (1 - rate)) / (start[0] + start[1] + WORD_SHARE)
        s = met_ * (1 - inside) / starts
        g = (pair[1] + FOLLOW_WEIGHT * met_ * inside / follows) / (end[1] + FOLLOW_WEIGHT)
        return e * s / (e * s + (1 - e) * g)

    def posteriors(self, lefts: list[str], rights: list[str], lengths: list[int], met: dict[str, tuple[float, float]]) -> list[float]:
        """Forward-backward over the places; the state is whether the place holds a boundary."""
        n = len(lefts)
        if not n:
            return []
        steps = []
        for left, right, length in zip(lefts, rights, lengths):
            if left[:1] == "=":
                steps.append(((0.0, 1.0), (0.0, 1.0)))
                continue
            if _unmarked(left):
                p = self.unmarked(left, right, met)
                steps.append(((1 - p, p), (1 - p, p)))
                continue
            p = self.boundary(left, met)
            y, z = p * self.next(right, "1", met), (1 - p) * self.next(right, "0" + self.group(left, met), met)
            odds = SHORT.get(length, 1.0) if left[:2] == "P:" else 1.0
            steps.append(((z, y), (z, y * odds)))
        forward, f = [], (0.0, 1.0)
        for plain, after in steps:
            g = (f[0] * plain[0] + f[1] * after[0], f[0] * plain[1] + f[1] * after[1])
            s = g[0] + g[1] or 1.0
            f = (g[0] / s, g[1] / s)
            forward.append(f)
        out, back = [0.0] * n, (1.0, 1.0)
        for k in range(n - 1, -1, -1):
            a, b = forward[k][0] * back[0], forward[k][1] * back[1]
            out[k] = b / (a + b) if a + b else 0.0
            plain, after = steps[k]
            g = (plain[0] * back[0] + plain[1] * back[1], after[0] * back[0] + after[1] * back[1])
            s = g[0] + g[1] or 1.0
            back = (g[0] / s, g[1] / s)
        return out

    def decided(self, row) -> list[int]:
        """The places that are boundaries: those of a posterior over a half; none inside a quotation behind which the sentence goes on."""
        post = self.posteriors(row.lefts, row.rights, row.lengths, _met(row.met))
        yes = [p > 0.5 for p in post]
        for k, at in enumerate(row.inside):
            if yes[k] and (at == -3 or at >= 0 and not yes[at]) and row.lefts[k][:1] != "=":
                yes[k] = False
        return [k for k, y in enumerate(yes) if y]


def expected(lefts: list[str], rights: list[str], post: list[float], counts: dict[str, float], words: dict[str, list[float]], group: Callable[[str], str] = _group) -> None:
    """Add one text's expected counts: of classes without a word, and of words with a boundary and without."""
    for left, right, p in zip(lefts, rights, post):
        left = left.lstrip("=")
        if not left or _unmarked(left):
            continue
        kind = right.partition(":")[0]
        for b, x in (("1", p), ("0" + group(left), 1 - p)):
            if x > 1e-3:
                if _worded(left):
                    words[f"L {left}"][b != "1"] += x
                else:
                    counts[f"L{b[0]} {left}"] += x
                counts[f"K{b}"] += x
                counts[f"K{b} {kind}"] += x
                if b != "1":
                    counts[f"A0 {kind}"] += x
                if ":" in right:
                    words[f"R {right}"][b != "1"] += x


class Spoken:
    """Counts for the bigram model: words that begin and end sentences, and words that follow another inside one."""

    def __init__(self) -> None:
        self.begin: dict[tuple[str, str], int] = defaultdict(int)
        self.end: dict[tuple[str, str], int] = defaultdict(int)
        self.pairs: dict[tuple[str, str, str], int] = defaultdict(int)
        #: By kind, the sum of the paragraphs' shares of words that begin a sentence, and the paragraphs: one that repeats a word sets no rate for all others.
        self.shares: dict[tuple[str], list[float]] = defaultdict(lambda: [0.0, 0.0])

    def add(self, text: str, cuts: list[int]) -> None:
        """One text's words in paragraphs that have marks, as cut. Marks that end no sentence, and signs around words, are as if they weren't there."""
        tokens = tokens_of(text)
        for own in paragraphs(text, tokens):
            if not any(t[0] == "mark" for t in own) or _is_thai(text, own):
                continue
            kind = "Uc" if _has_capitals(text, own) else "Ul"
            before, k, begun, all_ = "", bisect_left(cuts, own[0][2]), 0, 0
            for word, end, sign in units(own):
                if sign:
                    continue
                cut = k < len(cuts) and cuts[k] < end
                all_, begun = all_ + 1, begun + (cut or not before)
                while k < len(cuts) and cuts[k] < end:
                    k += 1
                if before and not cut:
                    self.pairs[kind, before, word] += 1
                else:
                    self.begin[kind, word] += 1
                    if before:
                        self.end[kind, before] += 1
                before = word
            if before:
                self.end[kind, before] += 1
                self.shares[kind,][0] += begun / all_
                self.shares[kind,][1] += 1

    def rows(self) -> list[tuple]:
        """(key, word, yes, no) of all, and starts anew. What has capitals also counts in lower case, for texts without."""
        words: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        counts: dict[str, float] = defaultdict(float)

        def all_of(kind: str, *said: str) -> Iterator[tuple]:
            yield kind, *said
            if kind == "Uc":
                yield "Ul", *map(str.lower, said)

        for x, (share, n) in self.shares.items():
            for (kind,) in all_of(*x):
                counts[f"{kind} shares"] += share
                counts[f"{kind} paragraphs"] += n
        for x, n in self.begin.items():
            for kind, w in all_of(*x):
                counts[f"{kind} starts"] += n
                words[f"{kind} S {w}"][0] += n
        for x, n in self.end.items():
            for kind, w in all_of(*x):
                words[f"{kind} E {w}"][0] += n
        for x, n in self.pairs.items():
            for kind, a, b in all_of(*x):
                counts[f"{kind} follows"] += n
                words[f"{kind} S {b}"][1] += n
                words[f"{kind} E {a}"][1] += n
                words[f"{kind} G {a} {b}"][1] += n
        self.__init__()
        return [(k, True, *n) for k, n in words.items()] + [(k, False, n, 0.0) for k, n in counts.items()]


def _met(entries: list[dict] | None) -> dict[str, tuple[float, float]]:
    return {e["key"]: (e["yes"], e["no"]) for e in entries or ()}


class Row(NamedTuple):
    """One text and its places."""

    chunk_id: int
    side: str
    text: str
    ends: list[int]
    lefts: list[str]
    rights: list[str]
    lengths: list[int]
    inside: list[int]
    met: list[dict] | None


def _rows(batch: pa.RecordBatch) -> Iterator[Row]:
    return map(Row._make, zip(*(batch.column(c).to_pylist() for c in Row._fields)))


_SAID = (pa.string(), pa.bool_(), pa.float64(), pa.float64())


def _batch(rows: list[tuple], kinds: tuple, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def features(chunks: DataFrame) -> DataFrame:
    """(chunk_id, side, text, ends, lefts, rights, lengths, inside, words, stops) of every text that isn't blank."""
    tall = chunks.select("chunk_id", F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("text")) for c in ("src", "tgt")])).alias("x")).select("chunk_id", "x.side", "x.text").where("text <> ''")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), *map(pa.list_, (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())))
        for b in batches:
            rows = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                tokens = tokens_of(r[2])
                if (found := places(r[2], tokens))[0]:
                    rows.append((*r, *found, word_keys(found[1], found[2]), stop_keys(r[2], tokens)))
            yield _batch(rows, kinds, ("chunk_id", "side", "text", "ends", "lefts", "rights", "lengths", "inside", "words", "stops"))

    return tall.mapInArrow(scan, "chunk_id bigint, side string, text string, ends array<int>, lefts array<string>, rights array<string>, lengths array<int>, inside array<int>, words array<string>, stops array<string>")


def stop_keys(text: str, tokens: list[tuple[str, str, int, int]]) -> list[str]:
    """Of each short word of a text, once: whether it has a full stop here (`T1 word`), whether it has none (`T0 word`), whether such a stop ends the text or a paragraph (`Z1 word`)."""
    said = set()
    for i, (kind, w, _, end) in enumerate(tokens):
        if kind != "word" or not is_short(low := w.lower()):
            continue
        if i + 1 == len(tokens) or tokens[i + 1][1] != "." or tokens[i + 1][2] != end:
            said.add(f"T0 {low}")
            continue
        said.add(f"T1 {low}")
        if i + 2 == len(tokens) or _PARAGRAPH.search(text, end + 1, tokens[i + 2][2]):
            said.add(f"Z1 {low}")
    return sorted(said)


def full_stops(texts: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """In how many texts each short word has a full stop and in how many it has none (keys `T`), in how many such a stop ends the text or a
    paragraph (keys `Z`); and the sums of stops and ends. A text that repeats a word counts once."""
    each = texts.select(F.explode("stops").alias("s")).groupBy("s").agg(F.count(F.lit(1)).cast("double").alias("n"))
    yes = F.substring("s", 2, 1) == "1"
    said = each.groupBy(F.concat(F.left("s", F.lit(1)), F.expr("substring(s, 3)")).alias("key")).agg(F.sum(F.when(yes, F.col("n")).otherwise(0.0)).alias("yes"), F.sum(F.when(yes, 0.0).otherwise(F.col("n"))).alias("no"))
    said = materialise(said, "stops")
    stops, ends = said.agg(F.sum(F.when(F.col("key").startswith("T "), F.col("yes"))), F.sum(F.when(F.col("key").startswith("Z "), F.col("yes")))).first()
    return {"T stops": stops or 0.0, "T ends": ends or 0.0}, said


def with_met(texts: DataFrame, words: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of each text and `met`, the counts of its own words. Words and texts are joined by shuffle; a text gets no more than it holds."""
    spark = texts.sparkSession
    met = texts.select("text_no", F.explode("words").alias("key")).join(words, "key").groupBy("text_no").agg(F.collect_list(F.struct("key", "yes", "no")).alias("met"))
    # A number of its own keeps the texts, few bytes but much work, from being put together in few tasks.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return texts.select(*dict.fromkeys(["text_no", *columns])).repartition(parts, "text_no").join(met, "text_no", "left").select(*columns, "met")


def trained(texts: DataFrame, rounds: int = ROUNDS) -> tuple[dict[str, float], DataFrame]:
    """Counts after some rounds of expectation-maximisation over all texts: of classes without a word, which are few, and the table of words (key, yes, no)."""
    sums_of_stops, stops = full_stops(texts)
    counts, words = dict(sums_of_stops), stops
    for _ in range(rounds):
        held = texts.sparkSession.sparkContext.broadcast(counts)

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model, own, met = Model(held.value), defaultdict(float), defaultdict(lambda: [0.0, 0.0])

            def said() -> pa.RecordBatch:
                rows = [(k, True, *n) for k, n in met.items()] + [(k, False, n, 0.0) for k, n in own.items()]
                met.clear()
                own.clear()
                return _batch(rows, _SAID, ("key", "word", "yes", "no"))

            for b in batches:
                for lefts, rights, lengths, known in zip(*(c.to_pylist() for c in b.columns)):
                    here = _met(known)
                    expected(lefts, rights, model.posteriors(lefts, rights, lengths, here), own, met, partial(model.group, met=here))
                    if len(met) > HELD_WORDS:
                        yield said()
            yield said()

        sums = with_met(texts, words, ["lefts", "rights", "lengths"]).mapInArrow(expect, "key string, word boolean, yes double, no double")
        sums = materialise(sums.groupBy("key", "word").agg(F.round(F.sum("yes"), 3).alias("yes"), F.round(F.sum("no"), 3).alias("no")), "counts")
        counts = sums_of_stops | {r.key: r.yes for r in sums.where("not word").collect()}
        words = sums.where("word").drop("word").unionByName(stops)
    return counts, words


CUT = "text_no bigint, chunk_id bigint, side string, text string, cuts array<int>"


def cut(texts: DataFrame, counts: dict[str, float], words: DataFrame) -> DataFrame:
    """(text_no, chunk_id, side, text, cuts): the ends of every text's sentences."""
    held = texts.sparkSession.sparkContext.broadcast(counts)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(held.value)
        for b in batches:
            ends = [[row.ends[k] for k in model.decided(row)] for row in _rows(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("text_no", "chunk_id", "side", "text")), pa.array(ends, pa.list_(pa.int32()))], names=["text_no", "chunk_id", "side", "text", "cuts"])

    return with_met(texts, words, ["text_no", *(c for c in Row._fields if c != "met")]).mapInArrow(decide, CUT)


def language(cuts: DataFrame, asked: DataFrame | None = None) -> tuple[dict[str, float], DataFrame]:
    """Counts and words of the bigram model, over all texts as cut; of the words all, or those of `asked` (key)."""

    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spoken()
        for b in batches:
            for text, ends in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist()):
                own.add(text, ends)
                if len(own.pairs) > HELD_WORDS:
                    yield _batch(own.rows(), _SAID, ("key", "word", "yes", "no"))
        yield _batch(own.rows(), _SAID, ("key", "word", "yes", "no"))

    said = cuts.select("text", "cuts").mapInArrow(speak, "key string, word boolean, yes double, no double")
    kept = said if asked is None else said.join(asked.withColumn("asked", F.lit(True)), "key", "left").where("not word or asked")
    sums = materialise(kept.groupBy("key", "word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "language")
    return {r.key: r.yes for r in sums.where("not word").collect()}, sums.where("word").drop("word")


def _places(chunks: DataFrame) -> DataFrame:
    return materialise(features(chunks).withColumn("text_no", F.monotonically_increasing_id()), "places")


def train(chunks: DataFrame, path: str, rounds: int = ROUNDS) -> None:
    """Train a model on all texts and keep it at `path` (folders classes and words), for `boundaries` of these and of other texts."""
    texts = _places(chunks)
    counts, words = trained(texts, rounds)
    more, spoken = language(cut(texts, counts, words))
    chunks.sparkSession.createDataFrame(list((counts | more).items()), "key string, n double").write.mode("overwrite").parquet(f"{path}/classes")
    words.unionByName(spoken).groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).write.mode("overwrite").parquet(f"{path}/words")


def stored(spark: SparkSession, path: str) -> tuple[dict[str, float], DataFrame]:
    """A model that `train` has kept: counts of classes without a word, which are few, and the table of words."""
    return {r.key: r.n for r in spark.read.parquet(f"{path}/classes").collect()}, spark.read.parquet(f"{path}/words")


def boundaries(chunks: DataFrame, rounds: int = ROUNDS, model: str | None = None) -> DataFrame:
    """(chunk_id, side, sent_no, end_pos, sentence) of every sentence, sent_no from 1. By the model kept at `model`, or else by one that is trained on these texts."""
    texts = _places(chunks)
    if model:
        cuts = cut(texts, *stored(chunks.sparkSession, model))
    else:
        counts, words = trained(texts, rounds)
        cuts = materialise(cut(texts, counts, words), "cuts")
        # Texts with a paragraph without marks are cut again, by what the others said.
        unmarked = F.exists("words", lambda w: w.rlike("^U[cl] "))
        asked = texts.where(unmarked).select(F.explode("words").alias("key")).where("key rlike '^U[cl] '").distinct()
        if not asked.isEmpty():
            more, spoken = language(cuts, asked)
            again = materialise(cut(texts.where(unmarked), counts | more, words.unionByName(spoken)), "cut-again")
            cuts = cuts.join(again.select("text_no"), "text_no", "left_anti").unionByName(again)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
        for b in batches:
            out = []
            for chunk, side, text, ends in zip(*(b.column(c).to_pylist() for c in ("chunk_id", "side", "text", "cuts"))):
                out += [(chunk, side, no, end, text[at:end].strip()) for no, (at, end) in enumerate(zip([0, *ends], ends), 1)]
            yield _batch(out, kinds, ("chunk_id", "side", "sent_no", "end_pos", "sentence"))

    return cuts.mapInArrow(split, "chunk_id bigint, side string, sent_no int, end_pos int, sentence string")
