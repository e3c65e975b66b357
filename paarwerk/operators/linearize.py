"""Linearise annotated learner XML: every section becomes two marked strings, as written and as corrected.

The markup is mixed content whose order matters, so this is the one place where Python walks a tree; it runs inside
`mapInArrow`, one document at a time, and everything after it is Catalyst. Each dialect is a table from tags to the
few writing steps below; text behind an element is written by one rule for all tags.

`strict` mends the known defects (a target that stands inside recent text is kept, nested text is written once); the
default keeps the results of the established extraction. A document that doesn't parse gives one row with `error`;
null content gives none.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

# Marks that stand in the text between here and the cleaning.
BREAK = "<SENTBREAK>"
FOREIGN = ("FOREIGNWORDSTART", "FOREIGNWORDEND")
DELETED = "<DEL>"
WRAPPER = "<SPACEWRAPPER> </SPACEWRAPPER>"
ERRORS = frozenset(("error", "over_capitalisation", "e"))

_UNREADABLE = re.compile("unreadable", re.I)
_ENDS_SENTENCE = re.compile(r"[.!?]$")
_TEXT_BLANK_TAG = re.compile(r">([^<\n]*?\S[^<\n]*?)[ \t]+<")
_TAG_BLANK_TAG = re.compile(r">[ \t]+<")


def with_wrappers(xml: str) -> str:
    """Make blanks that stand before a tag into elements, so that they survive stripping. Line breaks are layout and don't count."""
    return _TAG_BLANK_TAG.sub(f">{WRAPPER}<", _TEXT_BLANK_TAG.sub(rf">\1{WRAPPER}<", xml))


def local(tag) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def leads(text: str | None) -> bool:
    """The text begins with white space."""
    return bool(text) and text[0].isspace()


def trails(text: str | None) -> bool:
    """The text ends in white space."""
    return bool(text) and text[-1].isspace()


class Line:
    """One side of the text, written piece by piece."""

    def __init__(self) -> None:
        self.pieces: list[str] = []

    @property
    def last(self) -> str:
        return self.pieces[-1] if self.pieces else ""

    def open_word(self) -> bool:
        """Something is written and no blank follows it."""
        return bool(self.last) and not self.last.endswith(" ")

    def gap(self) -> None:
        if self.pieces and not self.last.endswith(" "):
            self.pieces.append(" ")

    def write(self, text: str | None, glued: bool = False) -> None:
        text = _UNREADABLE.sub("", text or "").strip()
        if text:
            if not glued and self.open_word():
                self.pieces.append(" ")
            self.pieces.append(text)

    def text(self) -> str:
        return re.sub(r"\s+([.:;!?,])", r"\1", re.sub(" +", " ", "".join(self.pieces))).strip()

    def ends_sentence(self) -> bool:
        return bool(_ENDS_SENTENCE.search(self.text()))


class Page:
    """Both sides. What a step decides by what is written so far, it decides by the side as written, for both."""

    def __init__(self, strict: bool = False) -> None:
        self.src, self.tgt, self.strict = Line(), Line(), strict

    def both(self, text: str | None, glued: bool = False) -> None:
        self.src.write(text, glued)
        self.tgt.write(text, glued)

    def gap(self) -> None:
        self.src.gap()
        self.tgt.gap()

    def sentence_break(self) -> None:
        for line in (self.src, self.tgt):
            line.pieces.append(f" {BREAK} ")

    def behind(self, node: ET.Element, glued: bool) -> None:
        """The text behind an element: apart from it where white space parts them, else as the element has it."""
        if node.tail:
            if leads(node.tail):
                self.gap()
            self.both(node.tail, glued)

    def gap_after_word(self, is_letter: Callable[[str], bool]) -> None:
        """A blank if the piece before ends in a word of more than two letters."""
        last = self.src.last
        if last and is_letter(last[-1]) and len(last.split()[-1]) > 2:
            self.gap()

    def foreign(self, text: str) -> None:
        if text:
            self.both(f"{FOREIGN[0]}{text}{FOREIGN[1]}")


def all_text(node: ET.Element | None) -> str:
    return "" if node is None else "".join(node.itertext()).strip()


def child_of(node: ET.Element, name: str, last: bool = False) -> ET.Element | None:
    found = [c for c in node if local(c.tag) == name]
    return found[-1 if last else 0] if found else None


# Dialect X: annotation in child elements.


def _original(node: ET.Element | None, strict: bool) -> str:
    """Text of an original form, all pieces stripped and put together, the text behind the form included."""
    out: list[str] = []

    def piece(text: str | None) -> None:
        if text and text.strip():
            out.append(text.strip())

    def walk(n: ET.Element) -> None:
        tag = local(n.tag)
        if tag == "correction" and strict and (child_of(n, "insertion") is not None or child_of(n, "deletion") is not None):
            piece(all_text(child_of(n, "insertion")))
        elif tag == "palimpsest":
            if not strict:
                piece(n.text)
            piece("".join(n.itertext()))
            if n.tail and n.tail.strip() and leads(n.tail):
                out.append(" ")
        else:
            piece(n.text)
            if tag == "overwrite":
                over = child_of(n, "over")
                piece(None if over is None else over.text)
            else:
                for c in n:
                    walk(c)
        piece(n.tail)

    if node is not None:
        walk(node)
    return "".join(out)


def _forms(node: ET.Element, strict: bool) -> tuple[str, str]:
    return _original(child_of(node, "originalform", last=True), strict), all_text(child_of(node, "targetform", last=True))


def _x_error(page: Page, node: ET.Element) -> None:
    original, target = _forms(node, page.strict)
    if original and target and original[0].islower() != target[0].islower() and page.src.ends_sentence():
        page.sentence_break()
    page.src.write(original)
    page.tgt.write(target)


def _expansions(node: ET.Element) -> str:
    return "".join(c.text for c in node if local(c.tag) == "expansion" and c.text)


def _x_palimpsest(page: Page, node: ET.Element) -> None:
    inside = {local(c.tag) for c in node}
    over, wrong = "strikeover" in inside, bool(inside & ERRORS)
    page.both(node.text, glued=not over and not wrong and page.src.open_word())
    for c in node:
        tag = local(c.tag)
        if over and tag == "strikeover":
            page.both(_expansions(c), glued=True)
            page.behind(c, glued=True)
        elif wrong and not over and tag in ERRORS:
            original, target = _forms(c, page.strict)
            page.src.write(original)
            page.tgt.write(target)
            page.behind(c, glued=True)
        else:
            _x_node(page, c)


def _x_correction(page: Page, node: ET.Element) -> None:
    said = {"deletion": "", "insertion": ""}
    for c in node:
        tag = local(c.tag)
        if tag in said and c.text and c.text.strip():
            said[tag] = c.text.strip()
        if tag == "insertion":
            for inner in c:
                _x_node(page, inner)
    if said["insertion"]:
        if not said["deletion"]:
            page.gap_after_word(str.islower)
        page.both(said["insertion"], glued=True)


def _x_first_child(page: Page, node: ET.Element, name: str) -> None:
    chosen = child_of(node, name)
    if chosen is not None and chosen.text:
        page.gap_after_word(str.isalpha)
        page.both(chosen.text)


def _x_strikeover(page: Page, node: ET.Element) -> None:
    page.both(_expansions(node), glued=page.src.open_word() and not page.src.last.endswith("\n"))


def _x_overwrite(page: Page, node: ET.Element) -> None:
    over = child_of(node, "over")
    page.both(None if over is None else over.text, glued=True)


def _x_foreign(page: Page, node: ET.Element) -> None:
    page.foreign((node.text or "").strip())
    for c in node:
        _x_node(page, c)


def _x_name(page: Page, node: ET.Element) -> None:
    page.both(node.text)
    for c in node:
        _x_node(page, c)
    if not node.tail:
        page.gap()


def _x_plain(page: Page, node: ET.Element) -> None:
    page.both(node.text)
    if trails(node.text):
        page.gap()
    for c in node:
        _x_node(page, c)


def _nothing(page: Page, node: ET.Element) -> None:
    pass


# Tag -> step, and whether the text behind the element is glued to it.
X_STEPS: dict[str, tuple[Callable[[Page, ET.Element], None], bool]] = {
    **dict.fromkeys(ERRORS, (_x_error, True)),
    "palimpsest": (_x_palimpsest, True),
    "correction": (_x_correction, True),
    "reduction": (partial(_x_first_child, name="unfoldedform"), True),
    "ambiguous": (partial(_x_first_child, name="alternative"), True),
    "strikeover": (_x_strikeover, True),
    "overwrite": (_x_overwrite, True),
    "foreign_word": (_x_foreign, True),
    **dict.fromkeys(("symbol", "emoticon", "unreadable"), (_nothing, True)),
    "par": (lambda page, node: page.sentence_break(), False),
    "spacewrapper": (lambda page, node: page.gap(), True),
    **dict.fromkeys(("greeting", "closing", "entity"), (_x_name, False)),
}


def _x_node(page: Page, node: ET.Element) -> None:
    step, glued = X_STEPS.get(local(node.tag), (_x_plain, True))
    step(page, node)
    page.behind(node, glued)


# Dialect P: annotation in attributes; a tag is known by a part of its name, the first that fits.


def _p_children(page: Page, node: ET.Element) -> None:
    page.both(node.text)
    for c in node:
        tag = c.tag.lower() if isinstance(c.tag, str) else ""
        step = next((s for part, s in P_STEPS if part in tag), None) if tag != "div" else _p_div
        (step or _p_children)(page, c)
        page.behind(c, glued=False)
        if step is _p_div:
            page.gap()


def _p_div(page: Page, node: ET.Element) -> None:
    if page.src.ends_sentence():
        page.sentence_break()
    else:
        page.gap()
    _p_children(page, node)
    page.gap()


def _p_foreign(page: Page, node: ET.Element) -> None:
    page.foreign(all_text(node))


def _p_wrapped(page: Page, node: ET.Element) -> None:
    page.gap()
    page.both(node.text)
    for inner in node:
        if page.strict:
            holder = ET.Element("x")
            holder.append(inner)
            _p_children(page, holder)
        else:
            _p_children(page, inner)


def _p_error(page: Page, node: ET.Element) -> None:
    page.gap()
    target, original = node.get("orth_error_target"), (node.text or "").strip()
    if not original:
        inner = next((c for c in node if isinstance(c.tag, str) and "tran_word_correction" in c.tag.lower()), None)
        original = "" if inner is None else (inner.text or "").strip()
    if target and original and target[0].isupper() and (original[0].islower() or original[0].isupper()) and page.src.ends_sentence():
        page.sentence_break()
    if target and target.strip():
        page.src.write(original)
        if page.strict or target not in " ".join(page.tgt.pieces[-3:]):
            page.tgt.write(target)
    elif original:
        page.src.write(original)
        page.tgt.write(DELETED)


def _p_capital(page: Page, node: ET.Element) -> None:
    page.src.write(node.text)
    page.tgt.write(node.get("tran_capitalisation_target"))


P_STEPS: list[tuple[str, Callable[[Page, ET.Element], None]]] = [
    ("tran_foreign_word", _p_foreign),
    ("tran_symbol", _nothing),
    ("tran_emoticon", _nothing),
    ("tran_word_correction", _p_wrapped),
    ("tran_ambiguous", _p_wrapped),
    ("tran_word_deletion", _nothing),
    ("orth_error", _p_error),
    ("tran_capitalisation", _p_capital),
]


def sections(root: ET.Element, dialect: str) -> list[ET.Element]:
    """The parts of a document that are read on their own, in any namespace: paragraphs, or the exercises of the first
    body; exercises in a namespace are read together, as one body."""
    if dialect == "P":
        return [n for n in root.iter() if local(n.tag) == "paragraph" and n is not root]
    body = next((n for n in root.iter() if local(n.tag) == "body" and n is not root), None)
    return [] if body is None else body.findall(".//exercise") or [body]


def linearised(xml: str, dialect: str, strict: bool = False) -> list[tuple[str, str]]:
    """(src, tgt) of each section, with marks. Raises ParseError."""
    out = []
    for section in sections(ET.fromstring(with_wrappers(xml)), dialect):
        page = Page(strict)
        if dialect == "P":
            _p_children(page, section)
        else:
            _x_node(page, section)
        out.append((page.src.text(), page.tgt.text()))
    return out


SECTIONS = "doc string, dialect string, section int, src string, tgt string, error string"


def linearise(files: DataFrame, strict: bool = False) -> DataFrame:
    """files (doc string, content binary, dialect string) -> (doc, dialect, section, src, tgt, error), sections from 1.

    Bytes that are not UTF-8 are dropped. One bad document doesn't touch the others: it gives a row with `error` only.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, content, dialect in zip(*(c.to_pylist() for c in b.columns)):
                if content is None:
                    continue
                try:
                    found = linearised(content.decode("utf-8", "ignore"), dialect or "X", strict)
                    rows += [(doc, dialect, i, s, t, None) for i, (s, t) in enumerate(found, 1)]
                except Exception as e:  # a file of its own kind; the others go on
                    rows.append((doc, dialect, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc", "dialect", "section", "src", "tgt", "error"])

    return files.select("doc", "content", "dialect").mapInArrow(scan, SECTIONS)


def line_facts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, leads, trails, ends_sentence): a text as a line writes it, whether it began and ended with white space, and whether it ends a sentence. Null stays null."""
    kind = dict(texts.dtypes)[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b[1].to_pylist():
                line = Line()
                line.pieces = [t or ""]
                out.append((None,) * 4 if t is None else (line.text(), leads(t), trails(t), line.ends_sentence()))
            kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b[0], *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=[key, "text", "leads", "trails", "ends_sentence"])

    return texts.select(key, text).mapInArrow(scan, f"{key} {kind}, text string, leads boolean, trails boolean, ends_sentence boolean")
