"""Sentence segmentation of cleaned learner text, as Column expressions: string -> array of sentences.

Marks of known splits are put into the text, the text is cut at them and behind closing punctuation, and fragments are
joined again where the next one starts in lower case or the one before has no end. Null and blank give an empty array.
A full stop that belongs to its word ends no sentence: those of ABBREVIATIONS, of single letters and of numbers (ordinals), as
in a rule sentencizer over a German tokenizer; other exceptions of such a tokenizer are not known here.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paarwerk.session import strip

SPLIT = "<SPLIT>"
# Words whose full stop belongs to them, the exceptions of a German tokenizer.
ABBREVIATIONS = (
    "A.C a.D A.D A.G a.M a.Z Abs adv al allg Apr Art Aug b.G Bd betr Betr Bf Bhf Biol biol Bsp bspw bzgl bzw c.t ca Chr co Co d.h dgl Dez Di Dipl Do Dr "
    "e.V e.g E.h ebd Einh etc Eur evtl Ez f Fa Fam Feb Fr frz geb Gebr gem h.c Hbf Hg hg Hr Hrn hrsg i.A i.e i.G i.O i.Tr i.V Ing inkl insb Jan jr Jr jun Jun jur Jul "
    "K.O kath L.A lat Lat m.E M.Sc m.M Mag max Mi min Mio mind Mo Mrd mrd mtl n.Chr N.Y N.Y.C nat Nov Nr o.a o.ä o.g Okt orig österr p.a p.s Pkt Prof Pfd "
    "q.e.d R.I.P rk Sa sen Sep Sept sog sogen St std Std Str stv svw Tel Tsd u.a u.s.w u.v.m u.U unregelmäß usw uva v.a v.Chr v.l.n.r vgl Vgl vllt "
    "Wirtsch wiss wissenschaftl z.B z.b z.T z.Z z.Zt zw zzgl"
).split()
# The splits in their order, as (Java pattern, replacement).
SPLITS = [
    (r"\.{2,}", f".{SPLIT}"),
    (r"(?U):\s*(\d+\s*\))", f": {SPLIT}$1"),
    (r"(?U)(\d+\s*\))", f".{SPLIT}$1"),
    (r'(?U)(["„])([^"„]+[.!?]\s+[^"„]+)(")', "$2"),
    (r'"([A-ZÄÖÜ][^"]{10,})"', f"{SPLIT}$1{SPLIT}"),
    (r'„([A-ZÄÖÜ][^"]{10,})"', f"{SPLIT}$1{SPLIT}"),
    (r"(?U)([.!?])\s+([A-ZÄÖÜ])", f"$1{SPLIT}$2"),
]
#: A cut behind closing punctuation, but not behind an abbreviation.
CUT = r"(?U)(?<=[.?!])(?<!\b(?:\p{L}|\d{1,99}|" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.)\s+"
LIST_MARK = r"(?U)^\s*\d+\s*(?:\.?\s*\))\s*"


def with_splits(c: Column) -> Column:
    for pattern, to in SPLITS:
        c = F.regexp_replace(c, pattern, to)
    return c


def fragments(c: Column) -> Column:
    """The pieces between split marks, without markup, cut behind closing punctuation."""

    def cleaned(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), " +", " ")
        return F.split(strip(F.regexp_replace(x, r"\n{2,}", "\n<PAR>\n")), CUT)

    pieces = F.flatten(F.transform(F.split(with_splits(c), SPLIT), cleaned))
    kept = F.filter(F.transform(pieces, strip), lambda x: (x != "") & ~x.rlike(r"^[.?!]+$"))
    return F.filter(F.transform(kept, lambda x: strip(F.replace(x, F.lit("<PAR>"), F.lit("")))), lambda x: x != "")


def merged(pieces: Column) -> Column:
    """Join a fragment to the one before if it starts in lower case or the one before has no closing punctuation.

    Whether a fragment goes on depends on its neighbour alone, so the starts are found first and each run is sliced out: linear in the text.
    """

    def runs(p: Column) -> Column:
        goes_on = lambda i: (i > 0) & (F.get(p, i).rlike(r"^\p{javaLowerCase}") | ~F.get(p, i - 1).rlike("[.!?]$"))
        starts = F.when(F.size(p) > 0, F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: ~goes_on(i))).otherwise(F.array().cast("array<int>"))
        # A lambda's argument is computed once; a column in its body would be computed for each fragment.
        cut = lambda s: F.transform(s, lambda i, j: F.array_join(F.slice(p, i + 1, F.coalesce(F.get(s, j + 1), F.size(p)) - i), " "))
        return F.transform(F.array(starts), cut)[0]

    return F.transform(F.array(pieces), runs)[0]


def sentences(c: Column | str) -> Column:
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    out = F.filter(F.transform(merged(fragments(c)), lambda x: strip(F.regexp_replace(x, LIST_MARK, ""))), lambda x: x != "")
    return F.when(strip(c) == "", F.array().cast("array<string>")).otherwise(out)
