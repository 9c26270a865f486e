"""The pN_ queries of the problems tagged llm."""

from pyspark.sql import functions as F

from sangam.session import table


def p6_found(spark, sf):
    from .formatting_duplicates import copies

    return copies(table(spark, sf, "uploads")).where("row_id <> first_row_id").select("first_row_id", "row_id")


def p6_collapsed(spark, sf):
    from .formatting_duplicates import collapse

    return collapse(table(spark, sf, "uploads"))


def p1_found(spark, sf):
    from .language import found

    return found(table(spark, sf, "uploads"))


def p1_languages(spark, sf):
    from .language import languages

    return languages(table(spark, sf, "uploads"))


def p3_found(spark, sf):
    from .near_duplicates import similar_rows

    return similar_rows(table(spark, sf, "uploads"))


def p3_links(spark, sf):
    from .near_duplicates import links

    return links(table(spark, sf, "uploads"))


def p4_found(spark, sf):
    from .toxicity import scores

    return scores(table(spark, sf, "uploads"), table(spark, sf, "review_labels")).where("toxic").select("row_id")


def p4_scores(spark, sf):
    from .toxicity import scores

    return scores(table(spark, sf, "uploads"), table(spark, sf, "review_labels"))


def p4_source_rates(spark, sf):
    from .toxicity import scores, source_rates

    return source_rates(scores(table(spark, sf, "uploads"), table(spark, sf, "review_labels")))


def p5_found(spark, sf):
    from .lookalikes import identical_pairs

    return identical_pairs(table(spark, sf, "uploads"))


def p5_forms(spark, sf):
    from .lookalikes import normalised

    return normalised(table(spark, sf, "uploads"))


def p7_pack(spark, sf):
    from .packing import pack

    return pack(table(spark, sf, "documents"), table(spark, sf, "pack_budgets"))


def p7_pack_joint(spark, sf):
    from .packing import pack

    return pack(table(spark, sf, "documents"), table(spark, sf, "pack_budgets"), joint=True)


def p7_summary(spark, sf):
    from .packing import pack, summary

    return summary(pack(table(spark, sf, "documents"), table(spark, sf, "pack_budgets")))


def p8_found(spark, sf):
    from .contamination import leaks

    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_scores(spark, sf):
    from .contamination import scores

    return scores(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_report(spark, sf):
    from .contamination import report

    return report(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark, sf):
    from .repetition import scores

    return scores(table(spark, sf, "documents")).where("repetitive").select("doc_id")


def p9_scores(spark, sf):
    from .repetition import scores

    return scores(table(spark, sf, "documents"))


def p9_unit_shares(spark, sf):
    from .repetition import unit_shares

    return unit_shares(table(spark, sf, "documents"))


def queries():
    return {f.__name__: f for f in (p1_found, p1_languages, p3_found, p3_links, p4_found, p4_scores, p4_source_rates, p5_found, p5_forms, p6_found, p6_collapsed, p7_pack, p7_pack_joint, p7_summary, p8_found, p8_scores, p8_report, p9_found, p9_scores, p9_unit_shares)}


def _words(x: str) -> str:
    """The words of x joined by a blank."""
    return f"trim(regexp_replace(regexp_replace(lower({x}), '\\p{{P}}+', '', 'g'), '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


FIELD = "'\\s*[^:;\\r\\n]+:\\s*\\S[^;\\r\\n]*'"
P6 = f"""WITH u AS (SELECT row_id, text, {_words('text')} AS flat, list_filter(regexp_split_to_array(text, '[;\\r\\n]+'), lambda p: length(trim(regexp_replace(p, '\\s+', ' ', 'g'))) > 0) AS parts
  FROM uploads WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
 l AS (SELECT row_id, flat, contains(text, ':') AND regexp_matches(text, '[;\\n\\r]') AND len(parts) >= 2 AND len(list_filter(parts, lambda p: NOT regexp_full_match(p, {FIELD}))) = 0 AS is_list,
  array_to_string(list_sort(list_transform(parts, lambda p: {_words('p')})), ' ') AS sorted FROM u),
 alias AS (SELECT flat, min(sorted) AS target FROM l WHERE is_list AND flat <> sorted GROUP BY flat),
 k AS (SELECT row_id, CASE WHEN is_list THEN sorted ELSE coalesce(target, l.flat) END AS k FROM l LEFT JOIN alias USING (flat)),
 g AS (SELECT row_id, min(row_id) OVER (PARTITION BY k) AS first_row_id FROM k)"""


def _grams(key: str, n: int, source: str) -> str:
    """(key, i, g): each run of n words of a text."""
    words = f"list_filter(string_split({_words('text')}, ' '), lambda x: x <> '')"
    return f"SELECT {key}, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {key}, {words} AS w FROM {source} WHERE text IS NOT NULL))"


# Look-alikes without a lattice: every letter that has a Latin twin takes it, whatever stands around it.
CYRILLIC, CYRILLIC_TWINS = "асԁеһіјӏорԛѕуүѵԝхАВСЕԌНІЈКМОРЅТѴԜХУҮӀктмнвпг", "acdehijlopqsyyvwxABCEGHIJKMOPSTVWXYYIktmhbnr"
GREEK, GREEK_TWINS = "οϲϳνΑΒϹΕΖΗΙΚΜΝΟΡΤΥΧͿαικρυχγητ", "ocjvABCEZHIKMNOPTYXJaikpuxynt"
VOWELS = [
    ("अॆ", "ऄ"), ("र्इ", "ई"), ("उु", "ऊ"), ("एॅ", "ऍ"), ("एॆ", "ऎ"), ("एे", "ऐ"), ("अॉ", "ऑ"), ("आॅ", "ऑ"), ("अॊ", "ऒ"), ("आॆ", "ऒ"), ("अो", "ओ"), ("आे", "ओ"), ("अौ", "औ"), ("आै", "औ"), ("अा", "आ"), ("अॅ", "ॲ"),
    ("ाॅ", "ॉ"), ("ाॆ", "ॊ"), ("ाे", "ो"), ("ाै", "ौ"), ("অা", "আ"), ("ঋৃ", "ৠ"), ("ত্\u200d", "ৎ"), ("அா", "ஆ"), ("ஒள", "ஔ"), ("ெள", "ௌ"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"),
]


def _form(x: str) -> str:
    """The one form of a text."""
    x = f"nfc_normalize({x})"
    for a, b in VOWELS:
        x = f"replace({x}, '{a}', '{b}')"
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    x = f"translate({x}, '{wide}', '{plain}')"
    x = f"regexp_replace({x}, '[\\x{{ad}}\\x{{34f}}\\x{{61c}}\\x{{180b}}-\\x{{180f}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{206f}}\\x{{fe00}}-\\x{{fe0f}}\\x{{feff}}]', '', 'g')"
    x = f"regexp_replace({x}, '[\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g')"
    return f"nfc_normalize(translate(translate({x}, '{CYRILLIC}', '{CYRILLIC_TWINS}'), '{GREEK}', '{GREEK_TWINS}'))"


P5 = f"form AS (SELECT row_id, text, {_form('text')} AS f FROM uploads WHERE text IS NOT NULL)"
# Sets by their rarest words: two sets over the threshold share one of the first n - ceil(3 n / 4) + 1.
P3 = f"""{P6}, {P5}, w AS (SELECT row_id, list_distinct(list_filter(string_split({_words('text')}, ' '), lambda x: x <> '')) AS w FROM uploads WHERE text IS NOT NULL),
 s AS (SELECT * FROM w WHERE len(w) >= 12), freq AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM s) GROUP BY x),
 o AS (SELECT row_id, x, row_number() OVER (PARTITION BY row_id ORDER BY n, x) AS r, count(*) OVER (PARTITION BY row_id) AS size FROM (SELECT row_id, unnest(w) AS x FROM s) JOIN freq USING (x)),
 pre AS (SELECT row_id, x FROM o WHERE r <= size - ceil(0.75 * size) + 1), cand AS (SELECT DISTINCT a.row_id AS a, b.row_id AS b FROM pre a JOIN pre b ON a.x = b.x AND a.row_id < b.row_id),
 near AS (SELECT a, b FROM (SELECT cand.a, cand.b, len(list_intersect(x.w, y.w)) AS common, len(x.w) + len(y.w) AS total FROM cand JOIN s x ON x.row_id = cand.a JOIN s y ON y.row_id = cand.b) WHERE common >= 0.75 * (total - common))
 SELECT a AS row_id_a, b AS row_id_b FROM near JOIN k ka ON ka.row_id = a JOIN k kb ON kb.row_id = b JOIN form fa ON fa.row_id = a JOIN form fb ON fb.row_id = b WHERE ka.k <> kb.k AND fa.f <> fb.f"""


def _units(pattern: str) -> str:
    u = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{pattern}'), lambda p: {_words('p')}), lambda p: p <> '')"
    return f"(CASE WHEN len({u}) > 0 THEN 1 - len(list_distinct({u})) / len({u}) ELSE 0 END)::DOUBLE"


def oracle_sql():
    eight = f"WITH d AS ({_grams('doc_id', 12, 'documents')}), e AS ({_grams('item_id', 12, 'eval_items')}), leak AS (SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g))"
    nine = f"WITH r AS ({_grams('doc_id', 4, 'documents')}), s AS (SELECT doc_id, count(*) AS n, count(DISTINCT g) AS d FROM r GROUP BY doc_id)"
    return {
        "p3_found": f"{P3}",
        "p5_found": f"WITH {P5} SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM form a JOIN form b ON a.f = b.f AND a.row_id < b.row_id AND a.text <> b.text",
        "p9_unit_shares": f"SELECT doc_id, {_units('[.!?।॥' + chr(92) + 'n' + chr(92) + 'r]+')} AS sentence_share, {_units('[' + chr(92) + 'n' + chr(92) + 'r]+')} AS line_share FROM documents",
        "p6_found": f"{P6} SELECT first_row_id, row_id FROM g WHERE row_id <> first_row_id",
        "p6_collapsed": f"{P6} SELECT first_row_id, count(*) AS copies FROM g GROUP BY first_row_id",
        "p8_found": f"{eight} SELECT doc_id, item_id FROM leak",
        "p8_report": f"{eight} SELECT item_id, benchmark, count(*) AS n_docs FROM leak JOIN eval_items USING (item_id) GROUP BY item_id, benchmark",
        "p9_found": f"{nine} SELECT doc_id FROM s WHERE n + 3 >= 20 AND 1 - d / n >= 0.35",
    }
