"""The core queries in SQL, for DuckDB. Built from small text pieces; the regular expressions are RE2's."""

from __future__ import annotations

from paarwerk.plans import goldens

# White space of any kind, as a class body and as a class.
_S = r"\s\x0b\x{85}\p{Z}"
_WS = f"[{_S}]"


def _re(c: str, pattern: str, to: str, flags: str = "g") -> str:
    quoted = [x.replace("'", "''") for x in (pattern, to)]
    return f"regexp_replace({c}, '{quoted[0]}', '{quoted[1]}', '{flags}')"


def strip(c: str) -> str:
    return _re(c, f"^{_WS}+|{_WS}+$", "")


def tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{_WS}+'), lambda x: x <> '')"


def alpha(c: str) -> str:
    return f"list_filter(regexp_extract_all(coalesce({c}, ''), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '\\p{{L}}+'))"


def rounded(x: str) -> str:
    return f"(round_even(({x}) * 100, 0) / 100)"


def percent(part: str, whole: str) -> str:
    return f"{rounded(f'CASE WHEN {whole} <> 0 THEN {part} / {whole} ELSE 0.0 END * 100')}::VARCHAR || '%'"


def with_total(source: str, key: str, aggregates: str, total: str) -> str:
    """Aggregates per key that isn't null, and over all rows."""
    return f"SELECT {key}, {aggregates} FROM {source} WHERE {key} IS NOT NULL GROUP BY {key} UNION ALL SELECT '{total}', {aggregates} FROM {source}"


def token_counts(source: str, key: str, columns: list[str], total: str) -> str:
    pool = " || ".join(alpha(c) for c in columns)
    return with_total(f"(SELECT {key}, unnest({pool}) AS token FROM {source})", key, "count(*) AS words, count(DISTINCT token) AS unique_tokens", total)


OVERVIEW = f"""
WITH p AS ({with_total('all_corpora', 'corpus', "count(*) AS n, count(*) FILTER (corrected) AS c", 'WHOLE_CORPUS')}),
t AS ({token_counts('all_corpora', 'corpus', ['src', 'tgt'], 'WHOLE_CORPUS')})
SELECT p.corpus, n AS n_sentence_pairs, n * 2 AS n_sentences, coalesce(words, 0) AS words, coalesce(unique_tokens, 0) AS unique_tokens,
  {rounded('coalesce(words, 0) / (n * 2)')} AS avg_words_per_sentence, c AS corrected_pairs, n - c AS left_as_is, {percent('c', 'n')} AS corrected_pairs_pct,
  c * 2 AS corrected_sentences, (n - c) * 2 AS uncorrected_sentences, {rounded('c / n * 100')} AS corrected_sentences_pct
FROM p LEFT JOIN t ON p.corpus = t.corpus"""

CORRECTED = f"""
WITH k AS (SELECT * FROM all_corpora WHERE corrected),
p AS ({with_total('k', 'corpus', 'count(*) AS n', 'ALL_CORRECTED')}),
t AS ({token_counts('k', 'corpus', ['src', 'tgt'], 'ALL_CORRECTED')})
SELECT p.corpus, n AS corrected_pairs, coalesce(words, 0) AS words, coalesce(unique_tokens, 0) AS unique_tokens, {rounded('coalesce(words, 0) / (n * 2)')} AS avg_words_per_sentence
FROM p LEFT JOIN t ON p.corpus = t.corpus WHERE n > 0"""


def count_share(key: str, total: str) -> str:
    return f"""
WITH p AS ({with_total('all_corpora', key, 'count(*) AS n', total)}), w AS (SELECT count(*) AS whole FROM all_corpora)
SELECT {key}, n AS sentence_count, CASE WHEN {key} = '{total}' THEN '100.00%' ELSE {percent('n', 'whole')} END AS percentage, {rounded('n / whole * 100')} AS percentage_value FROM p, w"""


BREAKDOWN = f"""SELECT corpus, count(corrected) AS total_pairs, count(*) FILTER (corrected) AS corrected_pairs, count(*) FILTER (NOT corrected) AS left_as_is,
{percent('(count(*) FILTER (corrected))', 'count(*)')} AS corrected_pct FROM all_corpora WHERE corpus IS NOT NULL GROUP BY corpus"""

SUMMARY = """WITH o AS (SELECT count(*) AS n, count(*) FILTER (corrected) AS c FROM all_corpora)
SELECT 'Total Sentence Pairs' AS metric, n AS pair_count, '100.00%' AS percentage FROM o
UNION ALL SELECT 'Corrected Pairs (True)', c, printf('%.2f%%', round_even(c / n * 100 * 100, 0) / 100) FROM o
UNION ALL SELECT 'Left-As-Is Pairs (False)', n - c, printf('%.2f%%', round_even((n - c) / n * 100 * 100, 0) / 100) FROM o"""

DOCUMENT_TYPES = f"""
WITH e AS (SELECT xml_file, text_type, count(*) AS k FROM all_corpora WHERE xml_file IS NOT NULL AND text_type IS NOT NULL GROUP BY ALL),
p AS ({with_total('e', 'text_type', 'count(*) AS n, sum(k)::BIGINT AS s', 'TOTAL')}), w AS (SELECT count(*) AS whole FROM e)
SELECT text_type, n AS document_count, s AS total_sentences, {rounded('s / n')} AS avg_sentences_per_doc,
  CASE WHEN text_type = 'TOTAL' THEN '100.00%' ELSE {percent('n', 'whole')} END AS percentage FROM p, w"""

BY_TYPE = f"""
WITH c AS (SELECT corpus, text_type, count(*) AS n FROM all_corpora WHERE corpus IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'WHOLE_CORPUS', text_type, count(*) FROM all_corpora GROUP BY ALL),
w AS (SELECT *, (sum(n) OVER (PARTITION BY corpus))::BIGINT AS whole FROM c)
SELECT corpus, text_type, n AS sentence_count, {percent('n', 'whole')} AS percentage FROM w WHERE text_type IS NOT NULL"""

# What a full stop belongs to: a number, a letter, and these words.
_ABBR = r"""[0-9]+|\p{L}|A\.C|a\.D|A\.D|A\.G|a\.M|a\.Z|Abs|adv|al|allg|Apr|Art|Aug|b\.G|Bd|betr|Betr|Bf|Bhf|Biol|biol|Bsp|bspw|bzgl|bzw|c\.t|ca|Chr|co|Co|d\.h|dgl|Dez|Di|Dipl|Do|Dr|
e\.V|e\.g|E\.h|ebd|Einh|etc|Eur|evtl|Ez|Fa|Fam|Feb|Fr|frz|geb|Gebr|gem|h\.c|Hbf|Hg|hg|Hr|Hrn|hrsg|i\.A|i\.e|i\.G|i\.O|i\.Tr|i\.V|Ing|inkl|insb|Jan|jr|Jr|jun|Jun|jur|Jul|
K\.O|kath|L\.A|lat|Lat|m\.E|M\.Sc|m\.M|Mag|max|Mi|min|Mio|mind|Mo|Mrd|mrd|mtl|n\.Chr|N\.Y|N\.Y\.C|nat|Nov|Nr|o\.a|o\.ä|o\.g|Okt|orig|österr|p\.a|p\.s|Pkt|Prof|Pfd|
q\.e\.d|R\.I\.P|rk|Sa|sen|Sep|Sept|sog|sogen|St|std|Std|Str|stv|svw|Tel|Tsd|u\.a|u\.s\.w|u\.v\.m|u\.U|unregelmäß|usw|uva|v\.a|v\.Chr|v\.l\.n\.r|vgl|Vgl|vllt|
Wirtsch|wiss|wissenschaftl|z\.B|z\.b|z\.T|z\.Z|z\.Zt|zw|zzgl""".replace("\n", "")
_CUT = "chr(2)"


def cut(c: str) -> str:
    """Text cut behind closing punctuation, as a list; the full stop of an abbreviation is hidden meanwhile."""
    hidden = _re(_re(c, rf"(^|[^\p{{L}}\p{{M}}\p{{N}}_])({_ABBR})\.({_WS})", "\\1\\2\x03\\3"), rf"(^|[^\p{{L}}\p{{M}}\p{{N}}_])({_ABBR})\.({_WS})", "\\1\\2\x03\\3")
    return f"string_split({_re(_re(hidden, f'([.?!]){_WS}+', chr(92) + '1' + chr(2)), chr(3), '.')}, {_CUT})"


def split_marked(c: str) -> str:
    for pattern, to in (
        (r"\.{2,}", ".<SPLIT>"), (rf":{_WS}*(\p{{Nd}}+{_WS}*\))", r": <SPLIT>\1"), (rf"(\p{{Nd}}+{_WS}*\))", r".<SPLIT>\1"),
        (rf'(["„])([^"„]+[.!?]{_WS}+[^"„]+)(")', r"\2"), (r'"([A-ZÄÖÜ][^"]{10,})"', r"<SPLIT>\1<SPLIT>"), (r'„([A-ZÄÖÜ][^"]{10,})"', r"<SPLIT>\1<SPLIT>"),
        (rf"([.!?]){_WS}+([A-ZÄÖÜ])", r"\1<SPLIT>\2"),
    ):
        c = _re(c, pattern, to)
    return c


_MERGE = """
{name}_g AS (SELECT *, CASE WHEN lag(s) OVER w IS NULL OR regexp_matches(s, '^\\p{{Ll}}') OR NOT regexp_matches(lag(s) OVER w, '[.!?]$') THEN 0 ELSE 1 END AS starts FROM {name} WINDOW w AS (PARTITION BY id ORDER BY i, j)),
{name}_n AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS g FROM {name}_g),
{name}_m AS (SELECT id, g, string_agg(s, ' ' ORDER BY i, j) AS s FROM {name}_n GROUP BY id, g)"""


def sentence_rows(name: str, source: str, key: str, column: str) -> str:
    """CTEs that end in `name`_s (id, pos, s): the sentences of a text column."""
    clean = strip(_re(_re(_re("c", "<[^>]+>", " "), " +", " "), r"\n{2,}", "\n<PAR>\n"))
    piece = strip(f"replace({strip('p')}, '<PAR>', '')")
    return f"""
{name}_c AS (SELECT {key} AS id, unnest(string_split({split_marked(column)}, '<SPLIT>')) AS c, generate_subscripts(string_split({split_marked(column)}, '<SPLIT>'), 1) AS i FROM {source} WHERE {column} IS NOT NULL),
{name}_l AS (SELECT id, i, {cut(clean)} AS l FROM {name}_c),
{name}_p AS (SELECT id, i, unnest(l) AS p, generate_subscripts(l, 1) AS j FROM {name}_l),
{name} AS (SELECT id, i, j, {piece} AS s FROM {name}_p WHERE {strip('p')} <> '' AND NOT regexp_full_match({strip('p')}, '[.?!]+') AND {piece} <> ''),
{_MERGE.format(name=name)},
{name}_x AS (SELECT id, g, {strip(_re('s', rf'^{_WS}*{chr(92)}p{{Nd}}+{_WS}*(?:{chr(92)}.?{_WS}*{chr(92)})){_WS}*', ''))} AS s FROM {name}_m),
{name}_s AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY g) - 1 AS pos, s FROM {name}_x WHERE s <> '')"""


SENTENCES = f"WITH {sentence_rows('d', 'documents', 'doc_id', 'text')} SELECT id AS doc_id, pos::INTEGER AS pos, s AS sentence FROM d_s"

FRAGMENTS = f"""
WITH f_l AS (SELECT chunk_id AS id, {cut('tgt')} AS l FROM sentencepair WHERE tgt IS NOT NULL),
f_p AS (SELECT id, 1 AS i, unnest(l) AS p, generate_subscripts(l, 1) AS j FROM f_l),
f AS (SELECT id, i, j, {strip('p')} AS s FROM f_p WHERE {strip('p')} <> ''),
{_MERGE.format(name='f')}
SELECT id AS chunk_id, (row_number() OVER (PARTITION BY id ORDER BY g) - 1)::INTEGER AS pos, s AS sentence FROM f_m"""

ZIPPED = f"""
WITH {sentence_rows('a', 'sentencepair', 'chunk_id', 'src')}, {sentence_rows('b', 'sentencepair', 'chunk_id', 'tgt')}
SELECT coalesce(a_s.id, b_s.id) AS chunk_id, coalesce(a_s.pos, b_s.pos)::INTEGER AS pos, coalesce(a_s.s, '') AS src, coalesce(b_s.s, '') AS tgt
FROM a_s FULL JOIN b_s ON a_s.id = b_s.id AND a_s.pos = b_s.pos"""

_TOKEN_PAIRS = f"list_filter(list_transform(list_zip({tokens("coalesce(src, '')")}, {tokens("coalesce(tgt, '')")}), lambda z: {{'s': coalesce(z[1], ''), 't': CASE WHEN z[2] = '<DEL>' THEN '' ELSE coalesce(z[2], '') END}}), lambda z: z.s <> '' OR z.t <> '')"

_H = r'(h[aeo]+|e+|o+|y+e+|gahahaha|hahaha+|noo+)'


def interjections(c: str) -> str:
    """A sign behind everything that may end a match gives the next match something to stand behind."""
    marked = _re(c, rf'([.!?,"]|{_WS})', "\\1\x01")
    gone = _re(marked, rf'(^|[^\p{{L}}\p{{N}}_]){_H}(?:([.!?,"])|{_WS}|$)', r"\1\3", "gi")
    return f"replace({gone}, chr(1), '')"


def list_mark(c: str) -> str:
    return strip(_re(c, rf"^{_WS}*\p{{Nd}}+{_WS}*[.\)]{_WS}*", ""))


def tidied(c: str) -> str:
    c = strip(_re(f"coalesce({c}, '')", rf"{_WS}*\n{_WS}*", " "))
    c = strip(_re(interjections(c), f"{_WS}+", " "))
    return _re(c, rf'^-{_WS}+(["„A-ZÄÖÜ])', r"\1")


def n_words(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+'))"


def remark(*sides: str) -> str:
    either = lambda t: "(" + " OR ".join(t(s) for s in sides) + ")"
    has = lambda w: either(lambda s: f"contains(lower({s}), '{w}')")
    plain = [has(w) for w in ("*", "@", "fortsetzung der aufgabe 2 fehlt", "text nicht beendet", "der text abgebrochen")]
    broken = either(lambda s: rf"regexp_matches(lower({s}), 'die aufgabe{_WS}*\p{{Nd}}?{_WS}*abgebrochen')")
    return " OR ".join([*plain, broken, f"({has('abgebrochen')} AND ({has('text')} OR {has('aufgabe')}))"])


CLEANED = f"""
WITH t AS (SELECT pair_id, {tidied('src')} AS src, {tidied('tgt')} AS tgt FROM all_corpora),
k AS (SELECT pair_id, {list_mark('src')} AS src, {list_mark('tgt')} AS tgt FROM t WHERE NOT ({remark('src', 'tgt')}))
SELECT * FROM k WHERE src <> '' AND tgt <> '' AND least({n_words('src')}, {n_words('tgt')}) >= 3"""

_CORPUS = f"lower({_re(strip('corpus'), rf'[-_{_S}]+', '_')})"

_MARKED = "string_split(replace(text, chr(10) || chr(10), '<SENTBREAK>'), '<SENTBREAK>')"
_CHUNKS = f"list_filter(list_transform({_MARKED}, lambda x: {strip('x')}), lambda x: x <> '')"



def _values(rows: list[tuple], names: str) -> str:
    one = lambda x: str(x).upper() if isinstance(x, bool) else f"{x}::INTEGER" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({', '.join(names.split())})"


ORACLES = {
    "corpus_overview": OVERVIEW,
    "corrected_only": CORRECTED,
    "sentence_count_pct": count_share("corpus", "WHOLE_CORPUS"),
    "correction_breakdown": BREAKDOWN,
    "correction_summary_long": SUMMARY,
    "text_type_sentence": count_share("text_type", "TOTAL"),
    "text_type_document": DOCUMENT_TYPES,
    "corpus_by_text_type": BY_TYPE,
    "lang_profile_count": "SELECT corpus, lang_prof, count(*) AS pair_count FROM all_corpora WHERE corpus IS NOT NULL AND lang_prof IS NOT NULL GROUP BY ALL",
    "language_tokens": token_counts("documents", "lang", ["text"], "WHOLE_CORPUS"),
    "single_text_stats": f"""
WITH x AS (SELECT doc_id, {alpha('text')} AS t, list_filter({cut(strip("coalesce(text, '')"))}, lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s) AS n_sentences, len(t) AS words, len(list_distinct(t)) AS unique_tokens, {rounded('CASE WHEN len(s) > 0 THEN len(t) / len(s) ELSE 0 END')} AS avg_words_per_sentence FROM x""",
    "alpha_tokens": f"WITH x AS (SELECT doc_id, {alpha('text')} AS t FROM documents) SELECT doc_id, (generate_subscripts(t, 1) - 1)::INTEGER AS pos, unnest(t) AS token FROM x",
    "whitespace_tokens": f"""SELECT pair_id, len({tokens("coalesce(src, '')")})::INTEGER AS src_tokens, len({tokens("coalesce(tgt, '')")})::INTEGER AS tgt_tokens FROM all_corpora""",
    "text_type_case": r"""SELECT pair_id, CASE WHEN corpus IN ('Kolipsi_1_L1', 'Kolipsi_1_L2', 'Kolipsi_2') THEN CASE WHEN suffix(xml_file, '_1.xml') THEN 'picture story' WHEN suffix(xml_file, '_2.xml') THEN 'opinion' ELSE 'unknown' END
WHEN contains(xml_file, '_pic_') THEN 'picture story' WHEN contains(xml_file, '_op_') THEN 'opinion' ELSE 'unknown' END AS derived_type FROM all_corpora""",
    "sorted_corpora": "SELECT DISTINCT corpus FROM all_corpora WHERE corpus IS NOT NULL ORDER BY corpus",
    "bag_union": "SELECT length(t)::INTEGER AS text_length, count(*) AS n FROM (SELECT src AS t FROM all_corpora UNION ALL SELECT tgt FROM all_corpora) GROUP BY 1",
    "clean_filters": CLEANED,
    "interjection_strip": f"SELECT doc_id, {interjections('text')} AS text FROM documents",
    "list_marker_strip": f"SELECT doc_id, {list_mark('text')} AS text FROM documents",
    "whitespace_normal": f"SELECT doc_id, {strip(_re('text', f'{_WS}+', ' '))} AS text, regexp_matches(text, '^{_WS}') AS leads, regexp_matches(text, '{_WS}$') AS trails FROM documents",
    "punctuation_spacing": f"SELECT doc_id, {strip(_re(_re('text', ' +', ' '), f'{_WS}+([.:;!?,])', chr(92) + '1'))} AS text, regexp_matches({strip('text')}, '[.!?]$') AS ends_sentence FROM documents",
    "word_count_filter": f"SELECT pair_id, least({n_words('src')}, {n_words('tgt')})::INTEGER AS n_words FROM all_corpora WHERE least({n_words('src')}, {n_words('tgt')}) >= 3",
    "remark_filter": f"SELECT doc_id FROM documents WHERE {remark('text')}",
    # A document is a file name in a corpus, whatever the corpus's spelling; a row without a file name is one by itself.
    "dedup_first": f"SELECT min(pair_id) AS pair_id FROM all_corpora GROUP BY {_CORPUS}, xml_file, CASE WHEN xml_file IS NULL THEN pair_id END, lower(src), lower(tgt)",
    "renumber": f"SELECT xml_file, pair_id, row_number() OVER (PARTITION BY {_CORPUS}, xml_file, CASE WHEN xml_file IS NULL THEN pair_id END ORDER BY pair_id)::INTEGER AS new_num FROM all_corpora",
    "limit_per_corpus": "SELECT corpus, path FROM (SELECT DISTINCT corpus, path FROM raw_files) QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY path) <= 5",
    "exclude_anti": "SELECT pair_id, xml_file FROM all_corpora a WHERE NOT EXISTS (SELECT 1 FROM text_meta m WHERE m.school_class_id = 'A' AND m.xml_file = a.xml_file)",
    "share_join": """WITH c AS (SELECT corpus, text_type, count(*) AS n FROM all_corpora WHERE corpus IS NOT NULL AND text_type IS NOT NULL GROUP BY ALL), t AS (SELECT corpus, sum(n)::BIGINT AS corpus_total FROM c GROUP BY corpus)
SELECT c.corpus, c.text_type, c.n, t.corpus_total FROM c JOIN t ON c.corpus = t.corpus""",
    "sentence_split": SENTENCES,
    "fragment_merge": FRAGMENTS,
    "zip_longest_sentences": ZIPPED,
    "zip_longest_tokens": f"WITH x AS (SELECT pair_id, {_TOKEN_PAIRS} AS l FROM all_corpora), y AS (SELECT pair_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS z FROM x) SELECT pair_id, pos, z.s AS src_token, z.t AS tgt_token FROM y",
    "norm_lines": f"SELECT pair_id, coalesce(array_to_string(list_transform({_TOKEN_PAIRS}, lambda z: z.s || chr(9) || z.t || chr(10)), ''), '') AS block FROM all_corpora",
    "sentbreak_chunks": f"WITH x AS (SELECT doc_id, len({_MARKED}) - 1 AS n, {_CHUNKS} AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, n::INTEGER AS n_breaks, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS chunk FROM x",
    "hash_split": "WITH b AS (SELECT DISTINCT xml_file, ('0x' || substr(md5(xml_file), 1, 8))::BIGINT % 100 AS b FROM all_corpora WHERE xml_file IS NOT NULL) SELECT xml_file, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS split FROM b",
    "scan_files": r"SELECT corpus, r.lang_prof, CASE WHEN corpus = 'LEONIDE' THEN 'P' ELSE 'X' END AS dialect, regexp_extract(path, '[^/]*$') AS xml_file, octet_length(content)::BIGINT AS n_bytes FROM raw_files f JOIN corpora r USING (corpus) WHERE content IS NOT NULL AND regexp_matches(path, '\.[xX][mM][lL]$')",
    "read_sidecars": "SELECT meta_id, " + ", ".join(f"nullif({strip(f'{c}::VARCHAR')}, 'NA') AS {c}" for c in ("corpus", "xml_file", "author_id", "task_type", "author_l1", "task_year")) + " FROM text_meta",
    "read_texts": f"SELECT item_id, {strip('text')} AS text FROM eval_items WHERE text IS NOT NULL",
    "norm_sink": f"SELECT corpus, count(*) AS blank_lines, sum(len({_TOKEN_PAIRS}))::BIGINT AS token_lines FROM all_corpora WHERE corpus IS NOT NULL GROUP BY corpus",
    "missing_csv": "SELECT corpus, lang_prof, xml_file, sent_num, src, tgt, corrected, text_type FROM all_corpora WHERE false",
    "golden_sections": _values(goldens.SECTIONS, "doc section src tgt"),
    "golden_raw_pairs": _values(goldens.RAW, "doc section pos src tgt corrected has_foreign"),
    "golden_pairs": _values(goldens.PAIRS, "doc sent_num src tgt corrected"),
    "golden_pairs_strict": _values(goldens.STRICT, "doc sent_num src tgt corrected"),
    "golden_problems": _values([("not closed",)], "doc"),
    "csv_round_trip": "SELECT nullif(corpus, '') AS corpus, nullif(lang_prof, '') AS lang_prof, nullif(xml_file, '') AS xml_file, sent_num, nullif(src, '') AS src, nullif(tgt, '') AS tgt, corrected, nullif(text_type, '') AS text_type FROM all_corpora",
}

# Nested annotations, from the tags alone. The bytes come as text in which all but plain ASCII is spelled `\xHH`; for what is
# asked here a letter stands for such bytes, a blank for white space, and nothing for bytes that are no UTF-8 and for the mark at the start.
_ASCII = "content::VARCHAR"
for _from, _to in (
    (r"^(\\xEF\\xBB\\xBF)+", ""), (r"\\x22", '"'), (r"\\x27", "''"), (r"\\x(0[9AD]|C2\\x[8A][50])", " "),
    (r"\\xC[2-9A-F]\\x[89AB].|\\xD.\\x[89AB].|\\xE.\\x[89AB].\\x[89AB].|\\xF[0-4]\\x[89AB].\\x[89AB].\\x[89AB].", "x"), (r"\\x[89A-F].", ""),
    (r"(?s)<!--.*?-->|<\?.*?\?>|(<!\[CDATA\[)\s*[^\s\]].*?\]\]>|<!\[CDATA\[\s*\]\]>", r"\1"),
):
    _ASCII = f"regexp_replace({_ASCII}, '{_from}', '{_to}', 'g')"
_FIELDS = ("originalform", "targetform")
_ELEMENTS = rf"""
WITH bare AS (SELECT file_id, trim(replace({_ASCII}, '<![CDATA[', 'x')) AS t FROM raw_files WHERE content IS NOT NULL),
cut AS (SELECT file_id, t, regexp_extract_all(t, '<(?:[^<>"'']|"[^"<]*"|''[^''<]*'')*>|[^<]+') AS l FROM bare),
whole AS (SELECT * FROM cut WHERE array_to_string(l, '') = t AND len(regexp_extract_all(t, '&')) = len(regexp_extract_all(t, '&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);'))),
tokens AS (SELECT file_id, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM whole),
kinds AS (SELECT *, tok LIKE '<%' AND tok NOT LIKE '</%' AND tok NOT LIKE '<!%' AS opens, tok LIKE '</%' AS closes, tok LIKE '<%/>' AS alone, lower(regexp_extract(tok, '^</?(?:[^\s/>:]+:)?([^\s/>]+)', 1)) AS name FROM tokens),
deep AS (SELECT *, sum(CASE WHEN closes THEN -1 WHEN opens AND NOT alone THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY i) AS d FROM kinds),
levels AS (SELECT *, CASE WHEN closes OR opens AND alone THEN d + 1 ELSE d END AS level FROM deep),
paired AS (SELECT *, lead(i) OVER w AS until, lead(name) OVER w AS next_name, lead(closes) OVER w AS next_closes, lag(opens) OVER w AS before_opens FROM levels WHERE (opens OR closes) AND NOT alone WINDOW w AS (PARTITION BY file_id, level ORDER BY i)),
broken AS (SELECT DISTINCT file_id FROM paired WHERE opens AND (next_closes IS NOT TRUE OR next_name <> name) OR closes AND before_opens IS NOT TRUE),
roots AS (SELECT file_id FROM levels WHERE opens AND level = 1 GROUP BY file_id HAVING count(*) = 1),
elements AS (SELECT l.file_id, l.i, l.tok, l.name, coalesce(p.until, l.i) AS until, row_number() OVER (PARTITION BY l.file_id ORDER BY l.i) AS no, l.name IN ('error', 'over_capitalisation') OR starts_with(l.name, 'orth_error') AS ann
  FROM levels l JOIN roots USING (file_id) LEFT JOIN paired p ON l.file_id = p.file_id AND l.i = p.i WHERE l.opens AND l.file_id NOT IN (SELECT file_id FROM broken))"""
ORACLES["problem_files"] = f"{_ELEMENTS} SELECT file_id::VARCHAR AS doc FROM bare WHERE file_id NOT IN (SELECT file_id FROM elements)"
ORACLES["p2_found"] = rf"""{_ELEMENTS},
around AS (SELECT e.file_id, e.i, max(a.i) FILTER (a.ann) AS ann_i, max(a.i) AS parent_i FROM elements e JOIN elements a ON e.file_id = a.file_id AND a.i < e.i AND e.i < a.until GROUP BY ALL),
placed AS (SELECT e.*, coalesce(a.no, 0) AS parent_ann, p.no AS parent_no, p.ann AS in_ann FROM elements e LEFT JOIN around r ON e.file_id = r.file_id AND e.i = r.i LEFT JOIN elements a ON a.file_id = r.file_id AND a.i = r.ann_i LEFT JOIN elements p ON p.file_id = r.file_id AND p.i = r.parent_i),
children AS (SELECT *, row_number() OVER (PARTITION BY file_id, parent_no, name ORDER BY i) AS seq FROM placed WHERE in_ann AND name IN {_FIELDS}),
said AS (SELECT c.file_id, c.parent_no, c.name, c.seq FROM children c WHERE EXISTS (SELECT 1 FROM levels t WHERE t.file_id = c.file_id AND t.i BETWEEN c.i AND c.until AND t.tok NOT LIKE '<%' AND regexp_matches(t.tok, '\S'))),
fields AS (SELECT file_id, parent_no AS no, name AS field, seq FROM said UNION ALL
  SELECT file_id, no, 'orth_error_target', 1 FROM placed WHERE ann AND len(list_filter(regexp_extract_all(tok, '(?i)[\s:]orth_error_target\s*=\s*("[^"]*"|''[^'']*'')', 1), lambda v: regexp_matches(v, '^.\s*[^\s"'']'))) > 0)
SELECT f.file_id, f.no::INTEGER AS ann_no, p.parent_ann::INTEGER AS parent_ann_no, field, seq::INTEGER AS field_seq FROM fields f JOIN placed p ON f.file_id = p.file_id AND f.no = p.no"""
