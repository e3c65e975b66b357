"""Invented documents with their hand-traced results: what linearising, pairing and cleaning must give, whatever the tables hold.

DOCUMENTS: name -> (dialect, XML). SECTIONS, RAW, PAIRS and STRICT: (name, ...) rows of linearise, raw_pairs and extract.
"""

from __future__ import annotations


def _p(*paragraphs: list[str]) -> tuple[str, str]:
    inner = "".join("<paragraph>" + "".join(f"<div>{d}</div>" for d in divs) + "</paragraph>" for divs in paragraphs)
    return "P", f'<root><body><page page_number="1">{inner}</page></body></root>'


def _x(*exercises: str) -> tuple[str, str]:
    inner = "".join(f'<exercise number="{i}" xml:space="preserve">{e}</exercise>' for i, e in enumerate(exercises, 1))
    return "X", f'<doc xmlns="urn:test"><body>{inner}</body></doc>'


def _orth(original: str, target: str) -> str:
    return f'<orth_error_id12 orth_error_target="{target}">{original}</orth_error_id12>'


def _error(original: str, target: str) -> str:
    return f"<error><errorType/><originalForm>{original}</originalForm><targetForm>{target}</targetForm></error>"


DOCUMENTS = {
    "target": _p([f"Ich gehe zur {_orth('schule', 'Schule')}."]),
    "two divs": _p(["Das ist gut.", "Ich mag es sehr."]),
    "recent target": _p([f"Er kommt nicht und {_orth('ihc', 'ich')} gehe allein."]),
    "foreign word": _p(["Ich mag <tran_foreign_word_id13>music</tran_foreign_word_id13> sehr gern."], ["Das ist alles heute."]),
    "deleted word": _p([f"Das ist {_orth('ist', '')} ein Hund."]),
    "deleted behind a break": _p(["Es ist gut.", f"Das ist {_orth('ist', '')} ein Hund."]),
    "same twice": _p(["Das ist gut.", "DAS IST GUT.", "Zu kurz.", "Es ist sehr warm."]),
    "capital": _p(['Wir sehen die <tran_capitalisation_id85 tran_capitalisation_target="Katze">katze</tran_capitalisation_id85> heute.']),
    "greeting": _x(f"<greeting>Hallo <entity>Eva</entity></greeting>,<par/>ich habe {_error('gesen', 'gesehen')} das neue Haus."),
    "overwrite": _x("Das ist ein Bis<overwrite><under>c</under><over>s</over></overwrite>chen schwer."),
    "insertion": _x("Ich gehe in <correction><deletion>die</deletion><insertion>den</insertion></correction> Wald."),
    "deletion": _x("Ich gehe <correction><deletion>nun</deletion></correction> in den Wald."),
    "reduction": _x("Wie <reduction><reductionType/><reducedForm>gehts</reducedForm><unfoldedForm>geht es</unfoldedForm></reduction> dir heute?"),
    "strikeover": _x("Wir <strikeover><expansion>S</expansion><expansion>s</expansion></strikeover>ehen das Haus."),
    "unknown tag": _x("<sic>Na<over>d</over>el</sic> im Heu liegt."),
    "remark": _x("Das war alles <comment>hier wird der Text abgebrochen</comment>"),
    "foreign chunk": _x('Ich mag <foreign_word foreign_language="English">music</foreign_word> sehr.<par/>Das Wetter ist schön.'),
    "empty original": _x(f"Das ist {_error('', 'sehr')}<palimpsest>schön</palimpsest> heute."),
    "palimpsest inside": _x(f"Das ist {_error('<palimpsest>schon</palimpsest>', 'schön')} heute."),
    "correction inside": _x(f"Das ist {_error('seh<correction><deletion>x</deletion><insertion>er</insertion></correction>', 'sehr')} gut."),
    "symbol": _p(["Ich bin <tran_symbol_id32>x</tran_symbol_id32> heute müde."]),
    "correction around": _p(['Wir <tran_word_correction_id25 tran_correction_original="x">gehen <orth_error_id12 orth_error_target="heute">heut</orth_error_id12> ins</tran_word_correction_id25> Kino.']),
    "ambiguous": _p(['Es war <tran_ambiguous_id3 tran_alternative_1="kalt" tran_alternative_2="alt">kalt</tran_ambiguous_id3> in <tran_emphasis_id11>dem</tran_emphasis_id11> Haus.']),
    "left out": _p(['Das ist <tran_word_deletion_id8 tran_word_deletion_target="_#_">sehr</tran_word_deletion_id8> schön heute.']),
    "palimpsest and strikeover": _x("Das <palimpsest>Hau<strikeover><expansion>s</expansion></strikeover>es</palimpsest> steht hier."),
    "palimpsest and error": _x(f"Wir <palimpsest>sehen {_error('di', 'die')} Katze</palimpsest> gern."),
    "alternatives": _x("Das ist <ambiguous><alternative>gut</alternative><alternative>Gut</alternative></ambiguous> heute."),
    "signs": _x("Ich <symbol>:)</symbol> bin <emoticon>x</emoticon>heute <unreadable>abc</unreadable> müde."),
    "closing": _x("Das ist alles.<closing>Deine Eva</closing>"),
    "two exercises": _x("Der Hund ist da.", "Die Katze ist weg."),
    "not closed": ("P", "<root><body>"),
}

_FOREIGN = "FOREIGNWORDSTARTmusicFOREIGNWORDEND"
# (name, section, src, tgt), worked out by hand.
SECTIONS = [
    ("target", 1, "Ich gehe zur schule.", "Ich gehe zur Schule."),
    ("two divs", 1, "Das ist gut. <SENTBREAK> Ich mag es sehr.", "Das ist gut. <SENTBREAK> Ich mag es sehr."),
    ("recent target", 1, "Er kommt nicht und ihc gehe allein.", "Er kommt nicht und gehe allein."),
    ("foreign word", 1, f"Ich mag {_FOREIGN} sehr gern.", f"Ich mag {_FOREIGN} sehr gern."),
    ("foreign word", 2, "Das ist alles heute.", "Das ist alles heute."),
    ("deleted word", 1, "Das ist ist ein Hund.", "Das ist <DEL> ein Hund."),
    ("deleted behind a break", 1, "Es ist gut. <SENTBREAK> Das ist ist ein Hund.", "Es ist gut. <SENTBREAK> Das ist <DEL> ein Hund."),
    ("same twice", 1, "Das ist gut. <SENTBREAK> DAS IST GUT. <SENTBREAK> Zu kurz. <SENTBREAK> Es ist sehr warm.", "Das ist gut. <SENTBREAK> DAS IST GUT. <SENTBREAK> Zu kurz. <SENTBREAK> Es ist sehr warm."),
    ("capital", 1, "Wir sehen die katze heute.", "Wir sehen die Katze heute."),
    ("greeting", 1, "Hallo Eva, <SENTBREAK> ich habe gesen das neue Haus.", "Hallo Eva, <SENTBREAK> ich habe gesehen das neue Haus."),
    ("overwrite", 1, "Das ist ein Bisschen schwer.", "Das ist ein Bisschen schwer."),
    ("insertion", 1, "Ich gehe in den Wald.", "Ich gehe in den Wald."),
    ("deletion", 1, "Ich gehe in den Wald.", "Ich gehe in den Wald."),
    ("reduction", 1, "Wie geht es dir heute?", "Wie geht es dir heute?"),
    ("strikeover", 1, "Wir Ssehen das Haus.", "Wir Ssehen das Haus."),
    ("unknown tag", 1, "Na del im Heu liegt.", "Na del im Heu liegt."),
    ("remark", 1, "Das war alles hier wird der Text abgebrochen", "Das war alles hier wird der Text abgebrochen"),
    ("foreign chunk", 1, f"Ich mag {_FOREIGN} sehr. <SENTBREAK> Das Wetter ist schön.", f"Ich mag {_FOREIGN} sehr. <SENTBREAK> Das Wetter ist schön."),
    ("empty original", 1, "Das ist schön heute.", "Das ist sehr schön heute."),
    ("palimpsest inside", 1, "Das ist schonschon heute.", "Das ist schön heute."),
    ("correction inside", 1, "Das ist sehxer gut.", "Das ist sehr gut."),
    ("symbol", 1, "Ich bin heute müde.", "Ich bin heute müde."),
    ("correction around", 1, "Wir gehen heut Kino.", "Wir gehen heut Kino."),
    ("ambiguous", 1, "Es war kalt in dem Haus.", "Es war kalt in dem Haus."),
    ("left out", 1, "Das ist schön heute.", "Das ist schön heute."),
    ("palimpsest and strikeover", 1, "Das Hauses steht hier.", "Das Hauses steht hier."),
    ("palimpsest and error", 1, "Wir sehen di Katze gern.", "Wir sehen die Katze gern."),
    ("alternatives", 1, "Das ist gut heute.", "Das ist gut heute."),
    ("signs", 1, "Ich bin heute müde.", "Ich bin heute müde."),
    ("closing", 1, "Das ist alles. Deine Eva", "Das ist alles. Deine Eva"),
    ("two exercises", 1, "Der Hund ist da. Die Katze ist weg.", "Der Hund ist da. Die Katze ist weg."),
]
# (name, section, pos, src, tgt, corrected, has_foreign): pairs before cleaning.
RAW = [
    ("target", 1, 0, "Ich gehe zur schule.", "Ich gehe zur Schule.", True, False),
    ("two divs", 1, 0, "Das ist gut.", "Das ist gut.", False, False),
    ("two divs", 1, 1, "Ich mag es sehr.", "Ich mag es sehr.", False, False),
    ("recent target", 1, 0, "Er kommt nicht und ihc gehe allein.", "Er kommt nicht und gehe allein.", True, False),
    ("foreign word", 1, 0, "Ich mag music sehr gern.", "Ich mag music sehr gern.", False, True),
    ("foreign word", 2, 0, "Das ist alles heute.", "Das ist alles heute.", False, False),
    ("deleted word", 1, 0, "Das ist ist ein Hund.", "Das ist ein Hund.", True, False),
    ("deleted behind a break", 1, 0, "Es ist gut.", "Es ist gut.", False, False),
    ("deleted behind a break", 1, 1, "Das ist ist ein Hund.", "Das ist <DEL> ein Hund.", True, False),
    ("same twice", 1, 0, "Das ist gut.", "Das ist gut.", False, False),
    ("same twice", 1, 1, "DAS IST GUT.", "DAS IST GUT.", False, False),
    ("same twice", 1, 2, "Zu kurz.", "Zu kurz.", False, False),
    ("same twice", 1, 3, "Es ist sehr warm.", "Es ist sehr warm.", False, False),
    ("capital", 1, 0, "Wir sehen die katze heute.", "Wir sehen die Katze heute.", True, False),
    ("greeting", 1, 0, "Hallo Eva,", "Hallo Eva,", False, False),
    ("greeting", 1, 1, "ich habe gesen das neue Haus.", "ich habe gesehen das neue Haus.", True, False),
    ("overwrite", 1, 0, "Das ist ein Bisschen schwer.", "Das ist ein Bisschen schwer.", False, False),
    ("insertion", 1, 0, "Ich gehe in den Wald.", "Ich gehe in den Wald.", False, False),
    ("deletion", 1, 0, "Ich gehe in den Wald.", "Ich gehe in den Wald.", False, False),
    ("reduction", 1, 0, "Wie geht es dir heute?", "Wie geht es dir heute?", False, False),
    ("strikeover", 1, 0, "Wir Ssehen das Haus.", "Wir Ssehen das Haus.", False, False),
    ("unknown tag", 1, 0, "Na del im Heu liegt.", "Na del im Heu liegt.", False, False),
    ("remark", 1, 0, "Das war alles hier wird der Text abgebrochen", "Das war alles hier wird der Text abgebrochen", False, False),
    ("foreign chunk", 1, 0, "Ich mag music sehr.", "Ich mag music sehr.", False, True),
    ("foreign chunk", 1, 1, "Das Wetter ist schön.", "Das Wetter ist schön.", False, False),
    ("empty original", 1, 0, "Das ist schön heute.", "Das ist sehr schön heute.", True, False),
    ("palimpsest inside", 1, 0, "Das ist schonschon heute.", "Das ist schön heute.", True, False),
    ("correction inside", 1, 0, "Das ist sehxer gut.", "Das ist sehr gut.", True, False),
    ("symbol", 1, 0, "Ich bin heute müde.", "Ich bin heute müde.", False, False),
    ("correction around", 1, 0, "Wir gehen heut Kino.", "Wir gehen heut Kino.", False, False),
    ("ambiguous", 1, 0, "Es war kalt in dem Haus.", "Es war kalt in dem Haus.", False, False),
    ("left out", 1, 0, "Das ist schön heute.", "Das ist schön heute.", False, False),
    ("palimpsest and strikeover", 1, 0, "Das Hauses steht hier.", "Das Hauses steht hier.", False, False),
    ("palimpsest and error", 1, 0, "Wir sehen di Katze gern.", "Wir sehen die Katze gern.", True, False),
    ("alternatives", 1, 0, "Das ist gut heute.", "Das ist gut heute.", False, False),
    ("signs", 1, 0, "Ich bin heute müde.", "Ich bin heute müde.", False, False),
    ("closing", 1, 0, "Das ist alles.", "Das ist alles.", False, False),
    ("closing", 1, 1, "Deine Eva", "Deine Eva", False, False),
    ("two exercises", 1, 0, "Der Hund ist da.", "Der Hund ist da.", False, False),
    ("two exercises", 1, 1, "Die Katze ist weg.", "Die Katze ist weg.", False, False),
]
_DROPPED = {("foreign word", 1, 0), ("same twice", 1, 1), ("same twice", 1, 2), ("greeting", 1, 0), ("remark", 1, 0), ("foreign chunk", 1, 0), ("closing", 1, 1)}
_NUMBERS = {("foreign word", 2, 0): 1, ("two divs", 1, 1): 2, ("deleted behind a break", 1, 1): 2, ("same twice", 1, 3): 2, ("two exercises", 1, 1): 2}
# (name, sent_num, src, tgt, corrected): cleaned, first of equals, numbered.
PAIRS = [(r[0], _NUMBERS.get(r[:3], 1), *r[3:6]) for r in RAW if r[:3] not in _DROPPED]
_MENDED = {
    "recent target": ("Er kommt nicht und ihc gehe allein.", "Er kommt nicht und ich gehe allein."),
    "palimpsest inside": ("Das ist schon heute.", "Das ist schön heute."),
    "correction inside": ("Das ist seher gut.", "Das ist sehr gut."),
    "correction around": ("Wir gehen heut ins Kino.", "Wir gehen heute ins Kino."),
}
STRICT = [(name, no, *_MENDED[name], True) if name in _MENDED else (name, no, src, tgt, corrected) for name, no, src, tgt, corrected in PAIRS]
