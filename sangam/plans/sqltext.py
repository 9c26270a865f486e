"""Fragments of SQL for the queries' equivalents, made from the same constants as the operators."""

import string

from sangam.functions import patterns as P
from sangam.functions.lexicon import BIGRAMS, CANON, CANONICAL, CLUES, DEFAULT, PROTECTED, SUFFIXES, THRESHOLD, VARIANTS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(words) -> str:
    return "(" + ", ".join(q(w) for w in sorted(words)) + ")"


def case_map(x: str, mapping: dict, default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in sorted(mapping.items())) + f" ELSE {default} END"


def full(x: str, pattern: str) -> str:
    return f"regexp_full_match({x}, {q(pattern.removeprefix('^').removesuffix('$'))})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


HI, EN = among(DEFAULT.hindi), among(DEFAULT.english)
#: Tokens between blanks of all documents, and their three-way label.
WORDS = f"""words AS (SELECT doc_id, source, generate_subscripts(l, 1) AS pos, unnest(l) AS tok FROM
  (SELECT doc_id, source, list_filter(string_split_regex(text, {q(P.SPLIT)}), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL))"""
LANG3 = f"CASE WHEN {has('tok', P.DEVANAGARI)} THEN 'HI' WHEN lower(tok) IN {HI} THEN 'HI' WHEN lower(tok) IN {EN} THEN 'EN' WHEN {full('lower(tok)', P.ALPHA)} AND {has('lower(tok)', '|'.join(CLUES))} THEN 'HI' ELSE 'UNK' END"
LABELLED3 = f"{WORDS}, lab3 AS (SELECT *, {LANG3} AS lang FROM words)"
FERTILITY = f"""{LABELLED3}, docs AS (SELECT doc_id, source FROM documents WHERE text IS NOT NULL),
 n AS (SELECT doc_id, count(*) FILTER (lang = 'EN') AS n_en, count(*) FILTER (lang = 'HI') AS n_hi FROM lab3 GROUP BY doc_id),
 fert AS (SELECT d.doc_id, d.source, coalesce(n_en, 0)::INT AS n_en, coalesce(n_hi, 0)::INT AS n_hi FROM docs d LEFT JOIN n USING (doc_id)),
 hf AS (SELECT *, CASE WHEN n_en + n_hi > 0 THEN
   (CASE WHEN n_en > 0 THEN -(n_en / (n_en + n_hi)) * log2(n_en / (n_en + n_hi)) ELSE 0 END) + (CASE WHEN n_hi > 0 THEN -(n_hi / (n_en + n_hi)) * log2(n_hi / (n_en + n_hi)) ELSE 0 END) END AS h_f FROM fert)"""
SCORE = f"""greatest(0.0, least(1.0, (CASE WHEN {has('lower(tok)', '|'.join(BIGRAMS))} THEN 0.30::DOUBLE ELSE 0 END) + (CASE WHEN {has('lower(tok)', '(?:' + '|'.join(SUFFIXES) + ')$')} THEN 0.25::DOUBLE ELSE 0 END)
 + (CASE WHEN length(regexp_replace(lower(tok), '[^aeiou]', '', 'g')) / length(tok) BETWEEN 0.25 AND 0.55 THEN 0.10::DOUBLE ELSE 0 END) - (CASE WHEN length(tok) <= 2 THEN 0.20::DOUBLE ELSE 0 END)))"""
LANG4 = f"CASE WHEN {has('tok', P.DEVANAGARI)} THEN 'HI_DEV' WHEN lower(tok) IN {HI} THEN 'HI_ROM' WHEN lower(tok) IN {EN} THEN 'EN' WHEN {full('lower(tok)', P.ALPHA)} AND {SCORE} >= {THRESHOLD} - 1e-9 THEN 'HI_ROM' ELSE 'UNK' END"
PUNCT = full("tok", P.PUNCTUATION)
DIGITS = full("tok", P.DIGITS)


def hier(text: str = "text", table: str = "documents", key: str = "doc_id") -> str:
    """Hierarchical tokens with content flag and four-way label. RE2 cannot look ahead, so e-mails end without a guard."""
    pattern = q(P.token_pattern(email_guard=False))
    return f"""toks AS (SELECT {key}, generate_subscripts(l, 1) AS pos, unnest(l) AS tok FROM (SELECT {key}, regexp_extract_all({text}, {pattern}) AS l FROM {table} WHERE text IS NOT NULL)),
 hier AS (SELECT *, NOT ({PUNCT}) AND NOT ({DIGITS}) AS content, {LANG4} AS lang4 FROM toks)"""


def rebuilt(source: str, order: str = "pos") -> str:
    """The text of tokens o of each doc_id of a relation, as rebuilt(doc_id, t)."""
    punct = full("o", P.PUNCTUATION)
    return f"""pieces AS (SELECT *, lag(o) OVER (PARTITION BY doc_id ORDER BY {order}) AS last FROM {source}),
 rebuilt AS (SELECT doc_id, trim(string_agg(CASE WHEN last IS NULL THEN o WHEN {punct} THEN (CASE WHEN o IN ('(', '[', '{{') THEN ' ' || o ELSE o END) WHEN last IN ('(', '[', '{{') THEN o ELSE ' ' || o END, '' ORDER BY {order})) AS t FROM pieces GROUP BY doc_id)"""


def each_letter(x: str, letters: str, least: int, to: int) -> str:
    for c in letters:
        x = f"regexp_replace({x}, '{c}{{{least},}}', '{c * to}', 'g')"
    return x


LETTERS = string.ascii_letters
VOWELS = "aeiouAEIOU"


def cap_runs(x: str) -> str:
    return each_letter(x, LETTERS, 3, 2)


def cap_all_runs(x: str) -> str:
    """Runs of any character cut to two, character by character."""
    return f"array_to_string(list_filter(string_split({x}, ''), lambda c, i: i < 3 OR c <> string_split({x}, '')[i - 1] OR c <> string_split({x}, '')[i - 2]), '')"


def spelled(done: str) -> str:
    """Every text with its tokens as in done (tok, canonical)."""
    return f"{done}, o AS (SELECT doc_id, pos, coalesce(canonical, tok) AS o FROM hier LEFT JOIN (SELECT DISTINCT tok, canonical FROM done) USING (tok)), {rebuilt('o')} SELECT d.doc_id, coalesce(t, '') AS processed_text FROM documents d LEFT JOIN rebuilt USING (doc_id) WHERE d.text IS NOT NULL"


DISTINCT = f"{hier()}, distinct_toks AS (SELECT DISTINCT tok, lang4 FROM hier WHERE content)"
PHONETIC = f"""{DISTINCT}, m AS (SELECT *, {case_map('lower(tok)', CANONICAL, 'tok')} AS m FROM distinct_toks), c AS (SELECT *, {cap_runs('m')} AS c FROM m),
 done AS (SELECT tok, CASE WHEN NOT (lang4 = 'HI_ROM' OR lower(tok) IN {among(CANONICAL)}) THEN tok WHEN lower(m) IN {among(PROTECTED)} THEN m WHEN lower(c) IN {among(PROTECTED)} THEN c
   ELSE regexp_replace(c, '([a-z]{{3}})aa$', '\\1a') END AS canonical FROM c)"""


def match_case(source: str, target: str) -> str:
    cased = f"lower({source}) <> upper({source})"
    return f"CASE WHEN {cased} AND {source} = upper({source}) THEN upper({target}) WHEN {cased} AND {source} = upper(left({source}, 1)) || lower(substr({source}, 2)) THEN upper(left({target}, 1)) || lower(substr({target}, 2)) ELSE {target} END"


def _repairs(x: str) -> str:
    for p, to in P.REPAIRS:
        x = f"regexp_replace({x}, {q(p)}, {q(to)}, 'g')"
    return x


LANGUAGE_AWARE = f"""{DISTINCT}, few AS (SELECT *, {cap_runs('tok')} AS few FROM distinct_toks), short AS (SELECT *, {each_letter('few', VOWELS, 2, 1)} AS short FROM few),
 known AS (SELECT *, coalesce({case_map('lower(few)', VARIANTS, 'NULL')}, {case_map('lower(short)', VARIANTS, 'NULL')}) AS known, {_repairs('short')} AS fixed FROM short),
 done AS (SELECT tok, CASE WHEN {has('tok', P.ARTIFACT)} THEN tok WHEN lang4 = 'HI_ROM' OR (lang4 = 'UNK' AND lower(few) IN {among(VARIANTS)}) THEN
   (CASE WHEN known IS NOT NULL THEN {match_case('tok', 'known')} WHEN lower(few) IN {HI} THEN few WHEN lower(short) IN {HI} THEN {match_case('tok', 'lower(short)')} ELSE fixed END)
   WHEN lang4 = 'EN' THEN few ELSE tok END AS canonical FROM known)"""
LEXICON = "lex AS (SELECT lower(trim(roman)) AS roman, arg_max(target, layer) AS target FROM lexicon WHERE trim(roman) <> '' AND target IS NOT NULL GROUP BY 1)"
BALANCED = f"""{DISTINCT}, {LEXICON}, s AS (SELECT tok, {each_letter('tok', LETTERS, 3, 2)} AS short FROM distinct_toks),
 k AS (SELECT *, {case_map('lower(short)', CANON, 'lower(short)')} AS k FROM s),
 done AS (SELECT tok, CASE WHEN lower(short) IN {EN} THEN short ELSE coalesce(a.target, b.target, short) END AS canonical FROM k LEFT JOIN lex a ON a.roman = k.k LEFT JOIN lex b ON b.roman = lower(short))"""
SKIP = f"({PUNCT} OR {DIGITS} OR {full('tok', '(?:' + P.PROTECTED + ')')} OR {full('tok', P.PROPER)})"
POSITIONS = f"""{hier()}, sk AS (SELECT doc_id, pos - 1 AS pos, tok, lang4, CASE WHEN {SKIP} THEN 'SKIP' ELSE lang4 END AS lang FROM hier),
 con AS (SELECT doc_id, pos, lang, lag(lang) OVER w AS last, lag(pos) OVER w AS before FROM sk WHERE lang <> 'SKIP' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 ch AS (SELECT doc_id, pos, before FROM con WHERE lang <> last),
 edges AS (SELECT doc_id, pos AS e FROM ch UNION SELECT doc_id, before FROM ch),
 totals AS (SELECT doc_id, count(*) AS content, count(*) FILTER (lang <> last) AS switches FROM con GROUP BY doc_id),
 isl AS (SELECT s.*, c.pos IS NOT NULL AS content, CASE WHEN c.pos IS NOT NULL AND (c.last IS NULL OR c.last <> c.lang) THEN 1 ELSE 0 END AS start FROM sk s LEFT JOIN con c USING (doc_id, pos)),
 isl2 AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM isl),
 pos_all AS (SELECT i.doc_id, i.pos, i.tok, i.lang, i.lang4, (count(*) FILTER (i.content) OVER (PARTITION BY i.doc_id, g ORDER BY i.pos))::INT AS run, coalesce(t.content, 0)::INT AS content, coalesce(t.switches, 0)::INT AS switches,
   EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = i.doc_id AND abs(e.e - i.pos) <= 3) AS near FROM isl2 i LEFT JOIN totals t USING (doc_id))"""
