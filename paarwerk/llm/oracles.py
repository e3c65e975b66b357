"""SQL for those training-data queries that SQL can express over whole tables; the others are tested against brute force,
the tokenizer's own library or an exact round trip."""

_S = r"[\s\x0b\x{85}\p{Z}]"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"


def _key(c: str) -> str:
    return rf"regexp_replace(lower({_strip(c)}), '[-_\s\x0b\x{{85}}\p{{Z}}]+', '_', 'g')"


def _corpus(c: str) -> str:
    """Registry spelling of a corpus."""
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE coalesce((SELECT min(r.corpus) FROM corpora r WHERE {_key('r.corpus')} = {_key(c)}), {_key(c)}) END"


def _file(c: str) -> str:
    return rf"nullif(lower({_strip(rf'regexp_extract({_strip(c)}, {chr(39)}[^/\\]*${chr(39)})')}), '')"


def _code(c: str) -> str:
    return f"nullif(nullif(lower({_strip(c)}), ''), 'na')"


P1_FOUND = rf"""
WITH RECURSIVE rows_ AS (SELECT pair_id, {_corpus('a.corpus')} AS corpus, {_file('xml_file')} AS file FROM all_corpora a),
given AS (SELECT corpus, file, arg_max(author, (delivered_at, meta_id)) AS author FROM (
    SELECT {_corpus('m.corpus')} AS corpus, {_file('xml_file')} AS file, {_code('author_id')} AS author, delivered_at, meta_id FROM text_meta m)
  WHERE author IS NOT NULL AND file IS NOT NULL GROUP BY corpus, file),
texts AS (SELECT corpus, file, min(pair_id) AS first_id FROM rows_ WHERE corpus IS NOT NULL AND file IS NOT NULL GROUP BY corpus, file),
named AS (SELECT t.*, regexp_replace(file, '\.xml$', '') AS stem, string_split(file, '_') AS parts FROM texts t),
writers AS (SELECT n.corpus, n.file, first_id, n.corpus || '/' || coalesce(g.author,
    CASE WHEN n.corpus = 'LEONIDE' THEN CASE WHEN len(parts) >= 4 THEN regexp_replace(parts[4], '\.xml$', '') ELSE stem END
         WHEN contains(n.file, '_') THEN regexp_extract(n.file, '^(.*)_', 1) ELSE stem END) AS node
  FROM named n LEFT JOIN given g ON n.corpus = g.corpus AND n.file = g.file),
ends AS (SELECT {_corpus('x.corpus_a')} || '/' || {_code('author_a')} AS a, {_corpus('x.corpus_b')} || '/' || {_code('author_b')} AS b FROM author_alias x),
edges AS (SELECT a, b FROM ends WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM ends WHERE a IS NOT NULL AND b IS NOT NULL),
reach(node, other) AS (SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
component AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
placed AS (SELECT w.*, coalesce(c.component, w.node) AS component FROM writers w LEFT JOIN component c ON w.node = c.node),
groups AS (SELECT component, min(first_id) AS group_id FROM placed GROUP BY component HAVING count(*) > 1)
SELECT r.pair_id, g.group_id FROM rows_ r JOIN placed p ON r.corpus = p.corpus AND r.file = p.file JOIN groups g ON p.component = g.component"""

_TYPE = lambda c: rf"lower(regexp_replace({c}, '[_\s\x0b\x{{85}}\p{{Z}}]+', '', 'g'))"
_PLAN = f"""
n AS (SELECT count(*) // 5 AS n FROM all_corpora),
have AS (SELECT t.target_id, count(*) AS available FROM (SELECT {_corpus('a.corpus')} AS corpus, {_TYPE('text_type')} AS kind, corrected FROM all_corpora a) r
  JOIN sample_targets t ON r.corpus = t.corpus AND r.kind = {_TYPE('t.text_type')} AND r.corrected = t.corrected GROUP BY t.target_id),
plan AS (SELECT t.target_id, t.target_permille, greatest(min_rows, (target_permille * n.n + 999) // 1000)::BIGINT AS wanted, coalesce(available, 0) AS available FROM n, sample_targets t LEFT JOIN have h ON t.target_id = h.target_id)"""

ORACLES = {
    "p1_found": P1_FOUND,
    "p5_found": f"WITH {_PLAN} SELECT target_id FROM plan WHERE wanted > available",
    "p5_report": f"""WITH {_PLAN}, d AS (SELECT *, least(wanted, available) AS drawn FROM plan), s AS (SELECT sum(drawn)::BIGINT AS s FROM d)
SELECT target_id, wanted, available, drawn, wanted - drawn AS missing, CASE WHEN s > 0 THEN drawn / s ELSE 0.0 END - target_permille / 1000 AS share_off FROM d, s""",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}


# What must not stand in a text, by itself: invisible characters, blanks of other kinds, wide, narrow and joined presentation forms.
_INVISIBLE = r"\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}"
_BLANKS = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
_WIDE = r"\x{FF01}-\x{FFBE}\x{FFC2}-\x{FFC7}\x{FFCA}-\x{FFCF}\x{FFD2}-\x{FFD7}\x{FFDA}-\x{FFDC}\x{FFE0}-\x{FFE6}\x{FFE8}-\x{FFEE}"
_JOINED = r"\x{FB00}-\x{FB06}\x{FB13}-\x{FB17}\x{FB20}-\x{FB29}\x{FB4F}-\x{FBB1}\x{FBD3}-\x{FD3D}\x{FD50}-\x{FD8F}\x{FD92}-\x{FDC7}\x{FDF0}-\x{FDFC}\x{FE70}-\x{FE72}\x{FE74}\x{FE76}-\x{FEFC}"
# Between these a joiner is spelling.
_JOINS = r"\x{600}-\x{8FF}\x{900}-\x{DFF}\x{1000}-\x{109F}\x{1780}-\x{18AF}\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}"
_APART = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}\p{Yi}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}"
# Pairs that can't be told apart by eye; for words with more such letters than Latin ones.
_TWINS = ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ", "ABESIJKMHOPCTYXaesijopcyxhqwABEZHIKMNOPTYXaikvopux")


def _spelled_joiners(t: str, by: str) -> str:
    """Joiners that are spelling, replaced; twice, because what stands behind one may stand before the next."""
    for _ in range(2):
        t = rf"regexp_replace({t}, '([{_JOINS}]){by[0]}([{_JOINS}])', '\1{by[1]}\2', 'g')"
    return t


def _mixed(word: str) -> str:
    others = rf"list_filter(regexp_extract_all({word}, '\p{{L}}'), lambda c: NOT regexp_matches(c, '[\p{{Latin}}\p{{Common}}]'))"
    n = rf"len(list_filter(regexp_extract_all({word}, '\p{{L}}'), lambda c: regexp_matches(c, '\p{{Latin}}')))"
    return f"(len({others}) > 0 AND {n} > 0 AND ({n} >= len({others}) OR len(list_filter({others}, lambda c: NOT contains('{_TWINS[0]}', c))) = 0))"


def _words_of(t: str) -> str:
    return rf"regexp_extract_all(regexp_replace({t}, '[{_APART}]', ' ', 'g'), '[\p{{L}}\p{{M}}]+')"


_SIDES = "s AS (SELECT pair_id, 'src' AS side, src AS t FROM all_corpora UNION ALL SELECT pair_id, 'tgt', tgt FROM all_corpora)"
ORACLES["p3_found"] = rf"""WITH {_SIDES}
SELECT pair_id, side FROM s WHERE t IS NOT NULL AND (regexp_matches({_spelled_joiners('t', (r'[\x{200C}\x{200D}]', ''))}, '[{_INVISIBLE}]')
  OR regexp_matches(t, '[{_BLANKS}{_WIDE}{_JOINED}]') OR nfc_normalize(t) <> t OR len(list_filter({_words_of('t')}, lambda w: {_mixed('w')})) > 0)"""

_ASCII = "".join(chr(c) for c in range(33, 127)).replace("'", "''")
_WIDE_ASCII = "".join(chr(c + 65248) for c in range(33, 127))


def _form(t: str) -> str:
    """The consistent form, for the characters that the tables hold: no presentation forms beyond wide ASCII and Latin ligatures."""
    for a, b in ((r"\x{200C}", ""), (r"\x{200D}", "")):
        t = _spelled_joiners(t, (a, b))
    t = rf"regexp_replace(regexp_replace({t}, '[{_INVISIBLE}]', '', 'g'), '[{_BLANKS}]', ' ', 'g')"
    t = f"translate({t}, '{_WIDE_ASCII}', '{_ASCII}‌‍')"
    for a, b in zip("ﬀﬁﬂﬃﬄﬅﬆ", ("ff", "fi", "fl", "ffi", "ffl", "st", "st")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"nfc_normalize({t})"


def _latin(t: str) -> str:
    parts = rf"regexp_extract_all({t}, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+')"
    return f"array_to_string(list_transform({parts}, lambda w: CASE WHEN {_mixed('w')} THEN nfc_normalize(translate(w, '{_TWINS[0]}', '{_TWINS[1]}')) ELSE w END), '')"


ORACLES["p3_texts"] = f"WITH f AS (SELECT pair_id, {_form('src')} AS src, {_form('tgt')} AS tgt FROM all_corpora) SELECT pair_id, {_latin('src')} AS src, {_latin('tgt')} AS tgt FROM f"


def _words(t: str) -> str:
    """The words of a text that isn't null, as a list. A soft hyphen at a line's end is a hyphen."""
    form = _latin(_form(rf"regexp_replace({t}, '\x{{AD}}[ \t\r]*\n', '-' || chr(10), 'g')"))
    joined = rf"regexp_replace({form}, '([\p{{L}}\p{{N}}])[-‐‑][ \t\r]*\n\s*([\p{{L}}\p{{N}}])', '\1\2', 'g')"
    return rf"regexp_extract_all(replace(lower({joined}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"


# All pairs whose texts share enough words, then the longest common subsequence row by row.
_NEAR = f"""
texts AS MATERIALIZED (SELECT pair_id, lower(trim(data_split)) AS part, {_words('src')} AS s, {_words('tgt')} AS t FROM all_corpora WHERE lower(trim(data_split)) IN ('train', 'dev', 'test') AND src <> '' AND tgt <> ''),
lines AS (SELECT * FROM texts WHERE len(s) > 0 AND len(t) > 0),
singles AS (SELECT pair_id, part, len(t) AS n, unnest(t) AS w FROM lines),
copies AS (SELECT pair_id, part, n, w, row_number() OVER (PARTITION BY pair_id, w) AS k FROM singles),
sharing AS (SELECT a.pair_id AS x, b.pair_id AS y FROM copies a JOIN copies b ON a.w = b.w AND a.k = b.k WHERE a.part = 'train' AND b.part <> 'train' GROUP BY ALL HAVING 5 * count(*) >= 4 * greatest(any_value(a.n), any_value(b.n))),
sided AS (SELECT x, y, l.s AS a, r.s AS b FROM sharing JOIN lines l ON l.pair_id = x JOIN lines r ON r.pair_id = y UNION ALL SELECT x, y, l.t, r.t FROM sharing JOIN lines l ON l.pair_id = x JOIN lines r ON r.pair_id = y),
lcs(x, y, a, b, i, r) AS (
  SELECT x, y, a, b, 0, list_transform(range(len(b) + 1), lambda z: 0::BIGINT) FROM sided
  UNION ALL SELECT x, y, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: greatest(r[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: b[k] = a[i + 1]), lambda k: r[k] + 1)), 0))) FROM lcs WHERE i < len(a)),
near AS (SELECT x, y FROM lcs WHERE i = len(a) GROUP BY x, y HAVING bool_and(5 * r[len(b) + 1] >= 4 * greatest(len(a), len(b))))"""
ORACLES["p4_found"] = f"WITH RECURSIVE {_NEAR} SELECT least(x, y) AS pair_id_a, greatest(x, y) AS pair_id_b FROM near"
ORACLES["p4_report"] = f"""WITH RECURSIVE {_NEAR},
sized AS (SELECT pair_id, t, len(t) AS n, len(t) // 5 + (len(t) - len(t) // 5) // 4 + 1 AS parts FROM lines),
cut AS (SELECT pair_id, n, t, n * i // parts AS f, n * (i + 1) // parts AS u FROM (SELECT *, unnest(range(parts)) AS i FROM sized)),
held AS (SELECT DISTINCT y, f, u, n FROM near JOIN cut c ON c.pair_id = y JOIN lines l ON l.pair_id = x WHERE contains(' ' || array_to_string(l.t, ' ') || ' ', ' ' || array_to_string(c.t[f + 1:u], ' ') || ' ')),
covered AS (SELECT y, sum(u - f) / any_value(n) AS c FROM held GROUP BY y),
met AS (SELECT y, count(*) AS k FROM near GROUP BY y)
SELECT lower(trim(a.data_split)) AS data_split, {_corpus('a.corpus')} AS corpus, sum(k)::BIGINT AS row_pairs, count(*) AS held_rows, round(avg(c), 4) AS coverage
FROM met JOIN covered USING (y) JOIN all_corpora a ON a.pair_id = y GROUP BY ALL"""

_GRAMS = lambda of, key, n: f"SELECT DISTINCT {key}, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {of})"
ORACLES["p8_found"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL), e AS MATERIALIZED (SELECT item_id, {_words('text')} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS ({_GRAMS('d', 'doc_id', 10)}), eg AS ({_GRAMS('e', 'item_id', 10)}) SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)"""

ORACLES["p8_removed"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL), e AS MATERIALIZED (SELECT item_id, {_words('text')} AS w FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
eg AS ({_GRAMS('e', 'item_id', 10)}), places AS (SELECT doc_id, len(w) AS n, i, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM d)),
gone AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + 10)) AS p FROM places WHERE g IN (SELECT g FROM eg))
SELECT doc_id, n::INTEGER AS words, count(*)::INTEGER AS removed_words, count(*) > 0.5 * n AS dropped FROM gone GROUP BY doc_id, n"""

_MEASURED = rf"""
d AS MATERIALIZED (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN [] ELSE {_words("coalesce(text, '')")} END AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d)),
again AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS repeated FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3]) AS p FROM again) GROUP BY doc_id),
said AS (SELECT doc_id, n, {_strip(rf"regexp_replace(replace(lower(x), 'ß', 'ss'), '{_S}+', ' ', 'g')")} AS p
  FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?。！？।\n]+') AS l FROM d))),
pieces AS (SELECT doc_id, length(p) AS n, row_number() OVER (PARTITION BY doc_id, p ORDER BY n) AS k FROM said WHERE p <> ''),
shares AS (SELECT doc_id, coalesce(sum(n) FILTER (k > 1), 0) / sum(n) AS piece_share FROM pieces GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w)::INTEGER AS n_words, coalesce(repeated, 0)::INTEGER AS repeated_words, coalesce(piece_share, 0.0) AS piece_share,
  CASE WHEN len(w) > 0 THEN coalesce(repeated, 0) / len(w) ELSE 0.0 END AS share FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN shares USING (doc_id)),
rules AS (SELECT *, n_words >= 8 AND share >= 0.3 AS fails_runs, n_words >= 8 AND piece_share >= 0.3 AS fails_pieces FROM m),
counts AS (SELECT source, count(*) AS docs, count(*) FILTER (fails_runs OR fails_pieces) AS failed FROM rules GROUP BY source),
moments AS (SELECT sum(failed) / sum(docs) AS mu, var_pop(failed / docs) AS v FROM counts),
prior AS (SELECT mu, greatest(2.0, CASE WHEN v > 0 AND mu * (1 - mu) > v THEN mu * (1 - mu) / v - 1 ELSE 2.0 END) AS k FROM moments),
hosts AS (SELECT source, docs, failed, round((failed + mu * k) / (docs + k), 9) AS rate FROM counts, prior)"""
ORACLES["p9_found"] = f"WITH {_MEASURED} SELECT doc_id FROM rules WHERE fails_runs"
ORACLES["p9_hosts"] = f"WITH {_MEASURED} SELECT *, rate >= 0.2 AS host_high FROM hosts"
ORACLES["p9_documents"] = f"""WITH {_MEASURED}
SELECT r.*, rate, rate >= 0.2 AS host_high, n_words >= 8 AND (repeated_words + rate) / (n_words + 1) >= 0.3 * 8 / 9 AS suspect FROM rules r JOIN hosts h ON r.source IS NOT DISTINCT FROM h.source"""
