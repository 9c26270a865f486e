"""All queries of the core, by the name under which they are run, and their SQL. A dict entry is (query, SQL or none)."""

import uuid

from pyspark.sql import functions as F

from sangam.functions import patterns as P
from sangam.functions import tokens as T
from sangam.operators import augment as A
from sangam.operators import classify as C
from sangam.operators import convert as V
from sangam.operators import metrics as M
from sangam.operators import normalize as N
from sangam.operators import sanitize as Z
from sangam.operators import switches as S
from sangam.plans import pipeline as PL
from sangam.plans import problems
from sangam.plans import sqltext as Q
from sangam.plans.profile import profile  # noqa: F401  (part of the surface)
from sangam.session import shared_dir, shuffle_width, spread, table, written
from sangam.sources import cache, corpora, lexicons
from sangam.streaming import texts as ST

CATALOGUE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return keep


def docs(spark, sf):
    return spread(table(spark, sf, "documents"))


def paired(spark, sf):
    """Uploads beside the output of the modules for them: text is the original, processed_text the result."""
    # the join's own shuffle, in as many partitions as there are cores, since what follows it is work per row
    n = max(shuffle_width(spark), spark.sparkContext.defaultParallelism)
    out = table(spark, sf, "pipeline_output").select("out_id", "row_id", "processed_text").repartition(n, "row_id")
    return out.join(table(spark, sf, "uploads").select("row_id", "text").repartition(n, "row_id"), "row_id")


def r6(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


# --- language balance, entropy, vocabulary ---------------------------------------------------------------------------


@query(f"WITH {Q.FERTILITY} SELECT count(h_f) AS n, round(avg(h_f), 6) AS mean, round(median(h_f), 6) AS median, round(stddev_pop(h_f), 6) AS std, round(var_pop(h_f), 6) AS var, round(skewness(h_f), 6) AS skew, round(kurtosis(h_f), 6) AS kurtosis FROM hf")
def fertility_entropy_mean(spark, sf):
    d = M.describe(M.fertility(docs(spark, sf), "doc_id", "text"), "h_f")
    return d.select("n", *[r6(c) for c in d.columns[1:]])


@query(f"WITH {Q.FERTILITY} SELECT doc_id, n_en, n_hi, round(h_f, 6) AS h_f FROM hf")
def fertility_entropy_by_doc(spark, sf):
    return M.fertility(docs(spark, sf), "doc_id", "text").select("doc_id", "n_en", "n_hi", r6("h_f"))


@query(f"WITH {Q.FERTILITY} SELECT source, count(*) AS n_docs, round(avg(h_f), 6) AS mean_h_f FROM hf GROUP BY source")
def fertility_entropy_by_source(spark, sf):
    return M.fertility(docs(spark, sf), "doc_id", "text", M.DEFAULT, "source").groupBy("source").agg(F.count("*").alias("n_docs"), r6(F.avg("h_f"), "mean_h_f"))


@query(f"WITH {Q.FERTILITY}, b AS (SELECT range::INT AS bin FROM range(10)) SELECT bin, (SELECT count(*) FROM hf WHERE h_f BETWEEN 0 AND 1 AND least(floor(h_f * 10), 9)::INT = bin) AS n FROM b")
def fertility_histogram(spark, sf):
    return M.histogram(M.fertility(docs(spark, sf), "doc_id", "text"), "h_f", 0.0, 1.0, 10)


@query(f"WITH {Q.LABELLED3} SELECT lang, count(*) AS n FROM lab3 GROUP BY lang")
def token_lang_distribution(spark, sf):
    return docs(spark, sf).select(F.explode(T.split_words(F.col("text"), lower=False)).alias("tok")).groupBy(T.language3(F.col("tok")).alias("lang")).agg(F.count("*").alias("n"))


@query(f"WITH {Q.WORDS}, c AS (SELECT lower(tok) AS t, count(*) AS c FROM words GROUP BY 1), n AS (SELECT sum(c) AS n FROM c) SELECT round(coalesce(sum(-(c / n) * log2(c / n + 1e-12)), 0), 6) AS entropy FROM c, n")
def token_entropy(spark, sf):
    return M.token_entropy(docs(spark, sf), "text").select(r6("entropy"))


@query(f"WITH {Q.WORDS} SELECT count(DISTINCT tok) AS vocab_size FROM words")
def vocab_size(spark, sf):
    return M.vocabulary_size(docs(spark, sf), "text")


# --- switches --------------------------------------------------------------------------------------------------------


@query(f"WITH {Q.LABELLED3}, p AS (SELECT doc_id, lang, lag(lang) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM lab3), n AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (lang <> last AND lang <> 'UNK' AND last <> 'UNK') AS n_switches FROM p GROUP BY doc_id) SELECT d.doc_id, coalesce(n_tokens, 0)::INT AS n_tokens, coalesce(n_switches, 0)::INT AS n_switches FROM documents d LEFT JOIN n USING (doc_id) WHERE text IS NOT NULL")
def switch_points_by_doc(spark, sf):
    return M.switch_points(docs(spark, sf), "doc_id", "text")


@query(f"WITH {Q.POSITIONS} SELECT doc_id, any_value(switches) AS switches, any_value(content) AS content, round(any_value(CASE WHEN content >= 2 THEN switches / (content - 1) ELSE 0 END), 6) AS density FROM pos_all GROUP BY doc_id")
def switch_density(spark, sf):
    p = S.document_switches(docs(spark, sf), "doc_id", "text")
    return p.select(F.col("id").alias("doc_id"), "switches", "content", r6(S.density(F.col("switches"), F.col("content")), "density"))


@query(f"WITH {Q.hier()}, k AS (SELECT lang4, lag(lang4) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM hier WHERE content AND lang4 <> 'UNK') SELECT last AS from_label, lang4 AS to_label, count(*) AS n FROM k WHERE last <> lang4 GROUP BY 1, 2")
def transition_counts(spark, sf):
    return S.transitions(docs(spark, sf), "text")


@query(f"WITH {Q.POSITIONS} SELECT doc_id, pos::INT AS pos, lang, near FROM pos_all")
def near_switch_window(spark, sf):
    return S.positions(docs(spark, sf), "doc_id", "text").select(F.col("id").alias("doc_id"), "pos", "lang", "near")


@query(f"WITH {Q.POSITIONS} SELECT lang, run, count(*) AS n FROM pos_all WHERE lang <> 'SKIP' GROUP BY 1, 2")
def monolingual_runs(spark, sf):
    return S.positions(docs(spark, sf), "doc_id", "text").where("lang <> 'SKIP'").groupBy("lang", "run").agg(F.count("*").alias("n"))


@query(f"""WITH {Q.hier()}, s AS (SELECT *, last_value(CASE WHEN lang4 <> 'UNK' THEN lang4 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
 first_value(CASE WHEN lang4 <> 'UNK' THEN lang4 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM hier)
 SELECT doc_id, (pos - 1)::INT AS pos, (CASE WHEN lang4 = 'UNK' THEN 1.0 WHEN (a IS NOT NULL AND a <> lang4) OR (b IS NOT NULL AND b <> lang4) THEN 1.5 WHEN a = lang4 AND b = lang4 THEN 0.7 ELSE 1.0 END)::DOUBLE AS multiplier FROM s""")
def context_multiplier(spark, sf):
    l = docs(spark, sf).where("text is not null").select("doc_id", F.transform(T.tokenize(F.col("text")), lambda t: T.language4(t)).alias("l"))
    return l.select("doc_id", F.posexplode(S.context_multiplier(F.col("l"))).alias("pos", "multiplier"))


@query(f"""WITH {Q.POSITIONS}, p AS (SELECT *, CASE WHEN near THEN least(1.0, 0.3::DOUBLE * 1.8) ELSE 0.3::DOUBLE END AS p FROM pos_all WHERE lang = 'EN')
 SELECT doc_id, pos::INT AS pos, round(CASE WHEN run > 4 THEN greatest(0.0, p - (run - 4) * 0.07::DOUBLE) ELSE p END, 6) AS probability FROM p""")
def substitution_probability(spark, sf):
    p = S.positions(docs(spark, sf), "doc_id", "text").where("lang = 'EN'")
    prob = S.substitution_probability(F.col("lang"), F.col("near"), F.col("run"), S.density(F.col("switches"), F.col("content")))
    return p.select(F.col("id").alias("doc_id"), "pos", r6(prob, "probability"))


def _places(side, col):
    """(out_id, side): the relative places of the switches of a text, in order."""
    return f"""(SELECT out_id, list(place ORDER BY pos) FILTER (place IS NOT NULL) AS {side} FROM (SELECT out_id, pos, CASE WHEN lang <> last AND lang <> 'UNK' AND last <> 'UNK' THEN (pos - 1) / n END AS place
  FROM (SELECT *, lag(lang) OVER (PARTITION BY out_id ORDER BY pos) AS last, count(*) OVER (PARTITION BY out_id) AS n FROM (SELECT *, {Q.LANG3} AS lang FROM (SELECT out_id, generate_subscripts(l, 1) AS pos, unnest(l) AS tok
   FROM (SELECT out_id, list_filter(string_split_regex(coalesce({col}, ''), {Q.q(P.SPLIT)}), lambda x: x <> '') AS l FROM pr))))) GROUP BY out_id)"""


@query(f"""WITH RECURSIVE pr AS (SELECT o.out_id, u.text, o.processed_text FROM pipeline_output o JOIN uploads u USING (row_id)),
 ab AS (SELECT pr.out_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM pr LEFT JOIN {_places('a', 'text')} x USING (out_id) LEFT JOIN {_places('b', 'processed_text')} y USING (out_id)),
 step AS (SELECT out_id, a, b AS free, 0 AS i, 0 AS hit FROM ab WHERE len(a) > 0
  UNION ALL SELECT out_id, a, CASE WHEN k > 0 THEN list_concat(free[:k - 1], free[k + 1:]) ELSE free END, i + 1, hit + (k > 0)::INT FROM (SELECT *, coalesce(list_position(list_transform(free, lambda y: abs(y - a[i + 1]) <= 0.15), true), 0) AS k FROM step WHERE i < len(a))),
 r AS (SELECT len(a) AS n, hit FROM step WHERE i = len(a))
 SELECT count(*) AS n_rows, sum(n)::BIGINT AS n_orig, sum(hit)::BIGINT AS n_matched, round(avg(hit / n), 6) AS mean_ratio, round(sum(hit) / sum(n), 6) AS spri FROM r""")
def spri_corpus(spark, sf):
    return M.retention_corpus(paired(spark, sf), "text", "processed_text").select("n_rows", "n_orig", "n_matched", r6("mean_ratio"), r6("spri"))


@query("""WITH u AS (SELECT job_id, row_no, max(lower(trim(lang))) AS lang FROM uploads WHERE lang <> '' GROUP BY 1, 2) SELECT a.lang AS from_lang, b.lang AS to_lang, count(*) AS n FROM u a JOIN u b ON a.job_id = b.job_id AND b.row_no = a.row_no + 1 GROUP BY 1, 2""")
def job_row_switches(spark, sf):
    """Changes of the declared language between consecutive rows of an upload, by an equi-join on the next row's place."""
    u = table(spark, sf, "uploads").select("job_id", "row_no", F.lower(F.trim("lang")).alias("lang")).where("lang <> ''").groupBy("job_id", "row_no").agg(F.max("lang").alias("lang"))
    n = u.select("job_id", (F.col("row_no") - 1).alias("row_no"), F.col("lang").alias("next"))
    return u.join(n, ["job_id", "row_no"]).groupBy(F.col("lang").alias("from_lang"), F.col("next").alias("to_lang")).agg(F.count("*").alias("n"))


# --- tokens and labels -----------------------------------------------------------------------------------------------


@query(f"WITH {Q.hier()} SELECT DISTINCT tok, round({Q.SCORE}, 6) AS score FROM hier WHERE content")
def phonetic_score(spark, sf):
    t = docs(spark, sf).select(F.explode(T.tokenize(F.col("text"))).alias("tok")).where(T.is_content(F.col("tok"))).distinct()
    return t.select("tok", r6(T.phonetic_score(F.col("tok")), "score"))


@query(f"WITH {Q.hier()} SELECT lang4 AS label, count(*) AS n FROM hier WHERE content GROUP BY 1")
def lang4_tokens(spark, sf):
    t = docs(spark, sf).select(F.explode(T.tokenize(F.col("text"))).alias("tok")).where(T.is_content(F.col("tok")))
    return t.groupBy(T.language4(F.col("tok")).alias("label")).agg(F.count("*").alias("n"))


KIND = [("url", r"^(?:https?://|www\.)"), ("hashtag", "^#."), ("mention", "^@."), ("number", r"^\p{Nd}"), ("punctuation", P.PUNCTUATION)]


@query(f"WITH {Q.hier()}, k AS (SELECT CASE " + " ".join(f"WHEN {Q.has('tok', p)} THEN '{k}'" for k, p in KIND) + " ELSE 'word' END AS kind, tok FROM hier) SELECT kind, count(*) AS n, count(DISTINCT tok) AS n_distinct FROM k GROUP BY kind")
def hier_tokens(spark, sf):
    t = docs(spark, sf).select(F.explode(T.tokenize(F.col("text"))).alias("tok"))
    kind = F.lit("word")
    for k, p in reversed(KIND):
        kind = F.when(F.col("tok").rlike(p), k).otherwise(kind)
    return t.groupBy("tok").agg(F.count("*").alias("c")).groupBy(kind.alias("kind")).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"))


@query(f"WITH {Q.hier()}, o AS (SELECT doc_id, pos, tok AS o FROM hier), {Q.rebuilt('o')} SELECT d.doc_id, coalesce(t, '') AS rebuilt FROM documents d LEFT JOIN rebuilt USING (doc_id) WHERE d.text IS NOT NULL")
def reconstruct(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", T.tokenize(F.col("text")).alias("toks")).select("doc_id", T.reconstruct(F.col("toks")).alias("rebuilt"))


# --- spelling --------------------------------------------------------------------------------------------------------


def distinct_tokens(spark, sf):
    return docs(spark, sf).select(F.explode(T.tokenize(F.col("text"))).alias("tok")).where(T.is_content(F.col("tok"))).distinct()


@query(f"WITH {Q.PHONETIC} SELECT tok, canonical FROM done")
def phonetic_normalization(spark, sf):
    return distinct_tokens(spark, sf).select("tok", N.one(N.phonetic, F.col("tok")).alias("canonical"))


@query(f"WITH {Q.LANGUAGE_AWARE} SELECT tok, canonical FROM done")
def language_aware(spark, sf):
    return distinct_tokens(spark, sf).select("tok", N.one(N.language_aware, F.col("tok")).alias("canonical"))


@query(f"WITH {Q.BALANCED} SELECT tok, canonical FROM done")
def balanced_map(spark, sf):
    targets = lexicons.as_map(table(spark, sf, "lexicon"))
    return distinct_tokens(spark, sf).select("tok", N.balanced(F.col("tok"), targets).alias("canonical"))


@query(f"SELECT doc_id, {Q.cap_all_runs('text')} AS capped FROM documents WHERE text IS NOT NULL")
def repetition_cap(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", N.cap_runs(F.col("text")).alias("capped"))


@query(f"WITH {Q.spelled(Q.PHONETIC)}")
def phonetic_texts(spark, sf):
    return N.process(docs(spark, sf).where("text is not null").select("doc_id", "text"), N.phonetic, normalized=True).select("doc_id", "processed_text")


@query(f"WITH {Q.spelled(Q.LANGUAGE_AWARE)}")
def language_aware_texts(spark, sf):
    return N.process(docs(spark, sf).where("text is not null").select("doc_id", "text"), N.language_aware, normalized=True).select("doc_id", "processed_text")


@query(f"WITH {Q.spelled(Q.BALANCED)}")
def balanced_texts(spark, sf):
    """The spelling of the lexicon by joins, as for a lexicon of any size."""
    return lexicons.balanced_texts(docs(spark, sf).where("text is not null").select("doc_id", "text"), "doc_id", table(spark, sf, "lexicon")).select("doc_id", "processed_text")


@query(f"WITH {Q.hier()} SELECT doc_id, count(*) FILTER (lang4 IN ('HI_DEV', 'HI_ROM')) AS n_hindi FROM hier GROUP BY doc_id")
def hindi_tokens(spark, sf):
    t = docs(spark, sf).select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("tok"))
    return t.groupBy("doc_id").agg(F.count_if(T.is_hindi(F.col("tok"))).alias("n_hindi"))


@query(f"WITH {Q.hier()}, e AS (SELECT DISTINCT lower(trim(roman)) AS word FROM lexicon WHERE trim(roman) <> '') SELECT (lower(tok) IN (SELECT word FROM e) AND length(tok) >= 2) AS is_english, count(*) AS n FROM hier GROUP BY 1")
def word_list_join(spark, sf):
    """The join with a word list that is a table; here the keys of the lexicon stand for it."""
    words = table(spark, sf, "lexicon").select(F.lower(F.trim("roman")).alias("word")).where("word <> ''").distinct()
    t = docs(spark, sf).select(F.explode(T.tokenize(F.col("text"))).alias("tok"))
    return lexicons.english_flags(t, "tok", words, 2).groupBy("is_english").agg(F.count("*").alias("n"))


@query(f"WITH {Q.hier()}, o AS (SELECT doc_id, pos, CASE WHEN content THEN '<' || lang4 || '>' || tok || '</' || lang4 || '>' ELSE tok END AS o FROM hier), {Q.rebuilt('o')} SELECT d.doc_id, coalesce(t, '') AS tagged FROM documents d LEFT JOIN rebuilt USING (doc_id) WHERE d.text IS NOT NULL")
def lang_tagging(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", S.tag_tokens(F.col("text")).alias("o")).select("doc_id", S.join_marked(F.col("o")).alias("tagged"))


MARKS = Q.q(r"\s*(?:" + P.SWITCH_MARKER + ")")


@query(f"""WITH {Q.hier(text=f"regexp_replace(text, {MARKS}, '', 'g')")}, k AS (SELECT *, CASE WHEN content AND lang4 <> 'UNK' THEN last_value(CASE WHEN content AND lang4 <> 'UNK' THEN lang4 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS before FROM hier),
 o AS (SELECT doc_id, pos * 2 AS pos, tok AS o FROM k UNION ALL SELECT doc_id, pos * 2 - 1, '[SWITCH_' || before || '_' || lang4 || ']' FROM k WHERE before <> lang4), {Q.rebuilt('o')} SELECT d.doc_id, coalesce(t, '') AS encoded FROM documents d LEFT JOIN rebuilt USING (doc_id) WHERE d.text IS NOT NULL""")
def switch_encoding(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", S.encode_tokens(F.col("text")).alias("o")).select("doc_id", S.join_marked(F.col("o")).alias("encoded"))


def _cleaned(x: str) -> str:
    for p in P.MARKERS.values():
        x = f"regexp_replace({x}, {Q.q(p)}, ' ', 'g')"
    return x


@query(f"SELECT out_id, trim(regexp_replace({_cleaned('coalesce(processed_text, chr(32))')}, '\\s{{2,}}', ' ', 'g')) AS clean FROM pipeline_output")
def sanitize(spark, sf):
    return table(spark, sf, "pipeline_output").select("out_id", Z.clean_for_model(F.col("processed_text")).alias("clean"))


def _counts() -> str:
    out, x = [], "coalesce(processed_text, '')"
    for k, p in P.MARKERS.items():
        out.append(f"sum(len(regexp_extract_all({x}, {Q.q(p)})))::BIGINT AS {k}")
        x = f"regexp_replace({x}, {Q.q(p)}, ' ', 'g')"
    return ", ".join(out)


@query(f"SELECT {_counts()} FROM pipeline_output")
def marker_counts(spark, sf):
    t = table(spark, sf, "pipeline_output").select(*Z.marker_counts(F.col("processed_text")))
    return t.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in t.columns])


@query(f"SELECT count(*) AS n FROM pipeline_output WHERE regexp_matches(processed_text, {Q.q('|'.join(P.MARKERS.values()))})")
def contains_control_markers(spark, sf):
    return table(spark, sf, "pipeline_output").where(Z.contains_markers(F.col("processed_text"))).agg(F.count("*").alias("n"))


# --- scripts, augmentation, pipelines ----------------------------------------------------------------------------------


@query()
def script_unification(spark, sf):
    return V.script_unification(docs(spark, sf).select("doc_id", "text"))


@query()
def transliteration(spark, sf):
    return V.transliteration(docs(spark, sf).select("doc_id", "text"))


@query()
def transliteration_stats(spark, sf):
    return V.transliteration_stats(docs(spark, sf))


@query()
def augment(spark, sf):
    return A.augment(docs(spark, sf).select("doc_id", "text"), "doc_id", n_augments=2)


@query()
def subword_sampling(spark, sf):
    return A.subword_sampling(docs(spark, sf).select("doc_id", "text"), "doc_id")


# Composition as far as these texts need it: SQL has no compatibility forms.
COMPOSED = "zero AS (SELECT doc_id, replace(replace(nfc_normalize(text), '…', '...'), chr(160), ' ') AS text FROM documents)"
PRESET_SQL = {
    "P2": f"WITH {COMPOSED}, one AS (SELECT doc_id, processed_text AS text FROM (WITH {Q.spelled(Q.PHONETIC).replace('documents', 'zero')})), two AS (WITH {Q.spelled(Q.LANGUAGE_AWARE).replace('documents', 'one')}) SELECT d.doc_id, d.text, two.processed_text FROM documents d LEFT JOIN two USING (doc_id)",
    "P4": f"WITH {COMPOSED}, tags AS ({CATALOGUE['lang_tagging'][1].replace('documents', 'zero')}), marks AS ({CATALOGUE['switch_encoding'][1].replace('documents', 'zero')}) SELECT d.doc_id, d.text, zero.text AS processed_text, tagged AS analysis_language_identification_tagging, encoded AS analysis_switch_point_encoding FROM documents d JOIN zero USING (doc_id) LEFT JOIN tags USING (doc_id) LEFT JOIN marks USING (doc_id)",
}


def _preset(name):
    @query(PRESET_SQL.get(name))
    def run(spark, sf):
        targets = lexicons.as_map(table(spark, sf, "lexicon")) if name == "P1" else None
        return PL.preset(name, targets=targets).process(docs(spark, sf).select("doc_id", "text"))

    CATALOGUE[f"pipeline_{name.lower()}"] = CATALOGUE.pop("run")


for _n in PL.PRESETS:
    _preset(_n)


@query("""SELECT * FROM (VALUES ('balanced_tokenization', 'TRANSFORMATION'), ('phonetic_normalization', 'TRANSFORMATION'), ('language_aware_normalization', 'TRANSFORMATION'), ('script_unification', 'TRANSFORMATION'), ('transliteration', 'TRANSFORMATION'),
 ('context_aware_subword_sampling', 'TRANSFORMATION'), ('language_identification_tagging', 'ANALYSIS'), ('switch_point_encoding', 'ANALYSIS'), ('code_switch_augmentation', 'AUGMENTATION')) AS t(key, category)""")
def module_categories(spark, sf):
    return PL.modules_table(spark).select("key", "category")


@query()
def pipeline_statistics(spark, sf):
    """Statistics of all modules of a pipeline of two transformations and both annotations."""
    p = PL.Pipeline([*PL.PRESETS["P2"], *PL.PRESETS["P4"]], enable_analysis=True, output_mode="both")
    return p.collect_statistics(docs(spark, sf).select("doc_id", "text"))


@query()
def augmentation_statistics(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    return A.replacement_stats(d, A.augment(d, "doc_id", n_augments=2), "doc_id", n_augments=2)


@query()
def module_registry(spark, sf):
    return PL.modules_table(spark)


# --- vectors ---------------------------------------------------------------------------------------------------------

VEC = "vecs AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


@query(f"WITH {VEC} SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM vecs GROUP BY vec_id")
def embedding_norms(spark, sf):
    return M.vector_stats(vectors(spark, sf), "vec_id", "embedding").select("vec_id", r6("norm"), r6("mean"), r6("std"))


@query(f"""WITH {VEC}, p AS (SELECT a.vec_id, greatest(-1, least(1, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)) + 1e-12))) AS c, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS e FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1 AND a.d = b.d GROUP BY a.vec_id)
 SELECT count(*) AS n, round(avg(c), 6) AS mean_cosine, round(median(c), 6) AS median_cosine, round(stddev_pop(c), 6) AS std_cosine, round(min(c), 6) AS min_cosine, round(max(c), 6) AS max_cosine, round(avg(e), 6) AS mean_euclidean, round(avg(acos(c)), 6) AS mean_angular FROM p""")
def embedding_stability(spark, sf):
    v = vectors(spark, sf)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    s = M.stability(v.join(nxt, "vec_id"), "embedding", "after")
    return s.select("n", *[r6(c) for c in s.columns[1:]])


@query(f"""WITH {VEC}, c AS (SELECT label, d, avg(x) AS v FROM vecs GROUP BY label, d) SELECT a.label AS label_a, b.label AS label_b, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS euclidean, round(sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))), 6) AS cosine
 FROM c a JOIN c b ON a.d = b.d AND a.label < b.label GROUP BY 1, 2""")
def centroid_distance(spark, sf):
    return M.centroid_distance(vectors(spark, sf), "embedding", "label").select("label_a", "label_b", r6("euclidean"), r6("cosine"))


@query(f"""WITH {VEC}, u AS (SELECT vec_id, label, d, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM vecs), s AS (SELECT label, d, sum(x) AS s, count(*) AS n FROM u GROUP BY label, d)
 SELECT label, max(n) AS n, round(CASE WHEN max(n) > 1 THEN (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) END, 6) AS cohesion FROM s GROUP BY label""")
def intra_cohesion(spark, sf):
    return M.cohesion(vectors(spark, sf), "embedding", "label").select("label", "n", r6("cohesion"))


@query()
def covariance_spectrum(spark, sf):
    return M.spectrum(vectors(spark, sf), "embedding")


@query(f"WITH {VEC}, m AS (SELECT d, avg(x) AS m FROM vecs GROUP BY d), c AS (SELECT vec_id, d, x - m AS x FROM vecs JOIN m USING (d)) SELECT (a.d - 1)::INT AS i, (b.d - 1)::INT AS j, round(sum(a.x * b.x) / (count(*) - 1), 6) AS covariance FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2")
def covariance_matrix(spark, sf):
    c, _ = M.covariance(vectors(spark, sf), "embedding")
    return spark.createDataFrame([(i, j, round(float(c[i, j]), 6)) for i in range(len(c)) for j in range(len(c))], "i int, j int, covariance double")


@query(f"""WITH {VEC}, dist AS (SELECT a.vec_id, a.label AS y, b.label AS c, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM vecs a JOIN vecs b ON a.d = b.d AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id, a.label, b.label),
 per AS (SELECT vec_id, y, c, avg(d) AS d FROM dist GROUP BY 1, 2, 3), s AS (SELECT vec_id, max(d) FILTER (c = y) AS a, min(d) FILTER (c <> y) AS b FROM per GROUP BY vec_id)
 SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def silhouette(spark, sf):
    return spark.createDataFrame([(M.silhouette(vectors(spark, sf), "embedding", "label"),)], "x double").select(r6("x", "silhouette"))


LOO = f"""{VEC}, s AS (SELECT label, d, sum(x) AS s, count(*) AS n FROM vecs GROUP BY label, d),
 p AS (SELECT v.vec_id, v.label AS y, s.label AS c, v.x, CASE WHEN v.label = s.label THEN (s.s - v.x) / nullif(s.n - 1, 0) ELSE s.s / s.n END AS p FROM vecs v JOIN s USING (d)),
 g AS (SELECT vec_id, y, c, sum(x * p) / (sqrt(sum(x * x)) * sqrt(sum(p * p)) + 1e-8) AS score FROM p GROUP BY 1, 2, 3),
 best AS (SELECT vec_id, y, c FROM g WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, c) = 1),
 conf AS (SELECT y AS true_label, c AS pred_label, count(*) AS n FROM best GROUP BY 1, 2)"""


def _confusion(spark, sf):
    return C.confusion(C.leave_one_out(vectors(spark, sf), "vec_id", "embedding", "label"), "true_label", "pred_label")


@query(f"WITH {LOO} SELECT * FROM conf")
def loo_centroid_confusion(spark, sf):
    return _confusion(spark, sf)


@query(f"""WITH {LOO}, l AS (SELECT true_label AS label FROM conf UNION SELECT pred_label FROM conf), t AS (SELECT label, coalesce((SELECT sum(n) FROM conf WHERE true_label = label), 0) AS support, coalesce((SELECT sum(n) FROM conf WHERE pred_label = label), 0) AS said, coalesce((SELECT sum(n) FROM conf WHERE pred_label = label AND true_label = label), 0) AS tp FROM l),
 pr AS (SELECT label, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r, support FROM t)
 SELECT label, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support::BIGINT AS support FROM pr""")
def classification_report(spark, sf):
    return C.report(_confusion(spark, sf)).select("label", r6("precision"), r6("recall"), r6("f1"), "support")


# --- statistics and joins ----------------------------------------------------------------------------------------------

TERM = r"[\p{L}\p{N}_]{2,}"


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {Q.q(TERM)})) AS term FROM documents WHERE text IS NOT NULL), a AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY term)
 SELECT term, df, n, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 6) AS idf FROM a ORDER BY n DESC, term LIMIT 20000""")
def tfidf_top_terms(spark, sf):
    return M.tfidf_terms(docs(spark, sf), "text").select("term", "df", "n", r6("idf"))


@query(f"""WITH u AS (SELECT row_id, CASE lower(trim(sentiment)) WHEN 'negative' THEN '0' WHEN 'neutral' THEN '1' WHEN 'positive' THEN '2' END AS s, CASE WHEN label IN (0, 1, 2) THEN label::INT::VARCHAR END AS l, text FROM uploads),
 r AS (SELECT row_id, coalesce(l, s) AS y, coalesce(text, '') AS text FROM u WHERE coalesce(l, s) IS NOT NULL), n AS (SELECT count(*) AS n FROM r), ny AS (SELECT y, count(*) AS ny FROM r GROUP BY y),
 t AS (SELECT DISTINCT row_id, y, unnest(regexp_extract_all(lower(text), {Q.q(TERM)})) AS term FROM r), j AS (SELECT term, y, count(*) AS c FROM t GROUP BY 1, 2),
 top AS (SELECT term, sum(c) AS nt FROM j GROUP BY term ORDER BY nt DESC, term LIMIT 20000), g AS (SELECT top.term, nt, ny, n, coalesce(c, 0) AS c FROM top CROSS JOIN ny CROSS JOIN n LEFT JOIN j ON j.term = top.term AND j.y = ny.y)
 SELECT term, max(nt)::BIGINT AS df, round(sum((CASE WHEN c > 0 THEN c / n * ln(c::DOUBLE * n / (nt::DOUBLE * ny)) ELSE 0 END) + (CASE WHEN ny - c > 0 THEN (ny - c) / n * ln((ny - c)::DOUBLE * n / ((n - nt)::DOUBLE * ny)) ELSE 0 END)), 6) AS mi FROM g GROUP BY term""")
def term_label_mi(spark, sf):
    u = table(spark, sf, "uploads").withColumn("y", C.label_or_sentiment(F.col("label"), F.col("sentiment")))
    return M.term_label_mi(u, "text", "y").select("term", "df", r6("mi"))


@query("SELECT coalesce(verdict, 'none') AS verdict, count(*) AS n, count(DISTINCT u.row_id) AS n_rows, round(avg(length(u.text)), 6) AS mean_chars FROM review_labels r JOIN uploads u USING (row_id) GROUP BY 1")
def label_join_stats(spark, sf):
    j = table(spark, sf, "review_labels").select("row_id", "verdict").join(table(spark, sf, "uploads").select("row_id", "text"), "row_id")
    return j.groupBy(F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_rows"), r6(F.avg(F.length("text")), "mean_chars"))


@query("SELECT coalesce(CASE WHEN label IN (0, 1, 2) THEN label::INT END, CASE lower(trim(sentiment)) WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END, -1) AS label_id, count(*) AS n FROM uploads GROUP BY 1")
def label_coercion(spark, sf):
    return table(spark, sf, "uploads").groupBy(F.coalesce(C.label_or_sentiment(F.col("label"), F.col("sentiment")), F.lit(-1)).alias("label_id")).agg(F.count("*").alias("n"))


@query("WITH known AS (SELECT DISTINCT sha256('encoder' || chr(0) || text) AS k FROM documents d WHERE text IS NOT NULL AND source LIKE 'chat%') SELECT DISTINCT sha256('encoder' || chr(0) || text) AS cache_key FROM documents WHERE text IS NOT NULL AND sha256('encoder' || chr(0) || text) NOT IN (SELECT k FROM known)")
def embedding_cache_misses(spark, sf):
    """Texts that a cache holding those of the chats has no vector for."""
    d = docs(spark, sf).select("text", "source")
    known = cache.EmbeddingCache(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}")
    known.put(d.where("source like 'chat%'").select("text", F.array(F.lit(0.0)).alias("vector")).distinct(), "encoder")
    return known.misses(d, "encoder").select(cache.key("encoder", F.col("text")).alias("cache_key"))


@query("SELECT lower(trim(roman)) AS roman, arg_max(target, layer) AS target FROM lexicon WHERE trim(roman) <> '' AND target IS NOT NULL GROUP BY 1")
def lexicon_layers(spark, sf):
    return lexicons.layered(table(spark, sf, "lexicon"))


@query("""WITH j AS (SELECT rec_id, job_id, saved_at, coalesce(body->>'$.status.state', body->>'$.status') AS status FROM job_records WHERE json_valid(body)) SELECT job_id, arg_max(status, {'a': saved_at, 'b': rec_id}) AS status, count(*) AS n_records FROM j GROUP BY job_id""")
def job_status(spark, sf):
    return corpora.latest_status(table(spark, sf, "job_records"))


PAIR = """pr AS (SELECT o.out_id, u.text, o.processed_text FROM pipeline_output o JOIN uploads u USING (row_id)), lng AS (SELECT 'before' AS side, text AS t FROM pr UNION ALL SELECT 'after', processed_text FROM pr),
 tk AS (SELECT side, unnest(list_filter(string_split_regex(t, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS tok FROM lng WHERE t IS NOT NULL), c AS (SELECT side, lower(tok) AS w, count(*) AS c FROM tk GROUP BY 1, 2),
 e AS (SELECT side, sum(-(c / n) * log2(c / n + 1e-12)) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY side) AS n FROM c) GROUP BY side), v AS (SELECT side, count(DISTINCT tok)::DOUBLE AS vocab FROM tk GROUP BY side),
 m AS (SELECT max(entropy) FILTER (side = 'before') AS eb, max(entropy) FILTER (side = 'after') AS ea, max(vocab) FILTER (side = 'before') AS vb, max(vocab) FILTER (side = 'after') AS va FROM e JOIN v USING (side))"""


def _sides(spark, sf):
    p = paired(spark, sf)
    eb, ea = (M.token_entropy(p, c).withColumnRenamed("entropy", n) for c, n in (("text", "eb"), ("processed_text", "ea")))
    vb, va = (M.vocabulary_size(p, c).select(F.col("vocab_size").cast("double").alias(n)) for c, n in (("text", "vb"), ("processed_text", "va")))
    return eb.join(ea).join(vb).join(va)


@query(f"WITH {PAIR} SELECT round(eb, 6) AS entropy_before, round(ea, 6) AS entropy_after, round((ea - eb) / abs(eb) * 100, 6) AS entropy_change, vb AS vocab_before, va AS vocab_after, round((va - vb) / abs(vb) * 100, 6) AS vocab_change FROM m")
def compare_profiles(spark, sf):
    """The two metrics that have SQL. All sections with the composite: compare_sections."""
    x = _sides(spark, sf).first()
    change = M.compare({"entropy": x.eb, "vocab": x.vb}, {"entropy": x.ea, "vocab": x.va})
    row = (x.eb, x.ea, change["entropy"], x.vb, x.va, change["vocab"])
    names = ["entropy_before", "entropy_after", "entropy_change", "vocab_before", "vocab_after", "vocab_change"]
    return spark.createDataFrame([row], ", ".join(f"{n} double" for n in names)).select(*[r6(n) for n in names])


def _measured(pairs, v, out_col, vec_col):
    """All sections of a profile of (text, out_col) and of vectors (embedding, vec_col), with its composite."""
    one = lambda df: (r.asDict() if (r := df.first()) else {})
    mi = lambda c: one(M.term_label_mi(pairs, c, "y").agg(F.avg("mi").alias("m")))["m"]
    before, after = mi("text"), mi(out_col)
    x = {"entropy": one(M.token_entropy(pairs, out_col))["entropy"], "vocab_size": one(M.vocabulary_size(pairs, out_col))["vocab_size"], "mi": after}
    x |= {f"fertility_{k}": n for k, n in one(M.describe(M.fertility(pairs, "out_id", out_col), "h_f")).items()}
    x |= one(M.retention_corpus(pairs, "text", out_col).select("mean_ratio", "spri"))
    spectral = one(M.spectrum(v, vec_col))
    x |= {k: spectral.get(k) for k in ("spectral_entropy", "condition_number", "decay")}
    x |= {f"crd_{k}": n for k, n in one(M.centroid_distance(v, vec_col, "k").select("euclidean", "cosine")).items()}
    x |= {k: n for k, n in one(M.stability(v, "embedding", vec_col)).items() if k != "n"}
    terms = {"delta_mi": before - after if None not in (before, after) else None, "fertility_entropy": x["fertility_mean"], "crd": x.get("crd_euclidean"), "stability": x["mean_cosine"], "spectral_entropy": x["spectral_entropy"], "spri": x["spri"]}
    mpp = M.composite(terms, None, spectral.get("embedding_dim"))
    return {k: None if n is None else float(n) for k, n in (x | {"mpp": mpp["score"]}).items()}, mpp


def _profiled(spark, sf):
    """Uploads beside their results with the label, written since every section reads them; vectors beside the next one."""
    u = table(spark, sf, "uploads").select("row_id", C.label_or_sentiment(F.col("label"), F.col("sentiment")).alias("y"))
    v = vectors(spark, sf).withColumn("k", F.col("label") % 2)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return written(paired(spark, sf).join(u, "row_id"), "m22-pairs"), v.join(nxt, "vec_id")


@query()
def composite_six_terms(spark, sf):
    """M-22 whole: the composite of all six terms, each as scaled."""
    pairs, v = _profiled(spark, sf)
    _, mpp = _measured(pairs, v, "processed_text", "after")
    return spark.createDataFrame([(mpp["score"], *mpp["terms"].values())], "score double, " + ", ".join(f"{k} double" for k in mpp["terms"]))


@query()
def compare_sections(spark, sf):
    """M-23 whole: each metric of all sections and the composite, of texts and vectors left as they are (baseline) and as
    processed (candidate), with the change in percent; better is for the composite only."""
    pairs, v = _profiled(spark, sf)
    (old, _), (new, _) = _measured(pairs, v, "text", "embedding"), _measured(pairs, v, "processed_text", "after")
    change = M.compare(old, new)
    better = lambda k: new[k] > old[k] if k == "mpp" and None not in (old[k], new[k]) else None
    return spark.createDataFrame([(k, old[k], new.get(k), change[k], better(k)) for k in old], "metric string, baseline double, candidate double, change double, better boolean")


@query(f"""WITH {Q.FERTILITY}, {VEC}, c AS (SELECT (label % 2)::INT AS k, d, avg(x) AS v FROM vecs GROUP BY 1, 2), crd AS (SELECT sqrt(sum((a.v - b.v) * (a.v - b.v))) AS crd FROM c a JOIN c b ON a.d = b.d AND a.k = 0 AND b.k = 1),
 s AS (SELECT greatest(-1, least(1, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)) + 1e-12))) AS c FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1 AND a.d = b.d GROUP BY a.vec_id),
 m AS (SELECT (SELECT avg(h_f) FROM hf) AS h, (SELECT crd FROM crd) AS crd, (SELECT avg(c) FROM s) AS st) SELECT round((greatest(0, least(1, h)) + 1 - greatest(0, least(1, crd / 2)) + greatest(0, least(1, (st + 1) / 2))) / 3, 6) AS score FROM m""")
def composite_score(spark, sf):
    """The three terms that have SQL: balance, centroid distance, stability. All six: composite_six_terms."""
    h = M.fertility(docs(spark, sf), "doc_id", "text").agg(F.avg("h_f").alias("h"))
    v = vectors(spark, sf).withColumn("k", F.col("label") % 2)
    crd = M.centroid_distance(v, "embedding", "k").select("euclidean")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    st = M.stability(v.join(nxt, "vec_id"), "embedding", "after").select("mean_cosine")
    x = h.join(crd).join(st).first()
    mpp = M.composite({"fertility_entropy": x.h, "crd": x.euclidean, "stability": x.mean_cosine})
    return spark.createDataFrame([(mpp["score"],)], "score double").select(r6("score"))


@query(f"""WITH {Q.hier()}, k AS (SELECT doc_id, lang4, lag(lang4) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM hier WHERE content),
 a AS (SELECT (SELECT count(*) FROM hier) AS total_tokens, count(*) AS content_tokens, count(*) AS tagged_tokens, count(*) FILTER (lang4 <> last) AS boundaries FROM k)
 SELECT *, round(tagged_tokens / greatest(content_tokens, 1), 4) AS coverage, round(boundaries / greatest(content_tokens - 1, 1), 4) AS density FROM a""")
def tagging_stats(spark, sf):
    return S.tagging_stats(docs(spark, sf), "text")


@query(f"""WITH {Q.hier()}, k AS (SELECT lang4, lag(lang4) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM hier WHERE content AND lang4 <> 'UNK'),
 a AS (SELECT (SELECT count(*) FROM hier) AS total_tokens, (SELECT count(*) FROM hier WHERE content) AS content_tokens, count(*) FILTER (lang4 <> last) AS switches FROM k) SELECT *, round(switches / greatest(content_tokens - 1, 1), 4) AS density FROM a""")
def switch_stats(spark, sf):
    return S.switch_stats(docs(spark, sf), "text")


@query()
def centroid_bootstrap(spark, sf):
    """All vectors, on two sides as in composite_score."""
    return M.centroid_bootstrap(vectors(spark, sf).withColumn("k", F.col("label") % 2), "embedding", "k", 0, 1, id_col="vec_id")


@query()
def bootstrap_h_f(spark, sf):
    return M.bootstrap_mean(M.fertility(docs(spark, sf), "doc_id", "text"), "h_f", id_col="doc_id")


@query()
def proxy_sprc(spark, sf):
    """Tokens take the vector whose id their hash picks: the table has no vectors of tokens."""
    d = docs(spark, sf).where("text is not null").select("doc_id", M.switch_flags(F.col("text")).alias("f"), T.split_words(F.col("text"), lower=False).alias("w"))
    v = vectors(spark, sf).select("vec_id", "embedding")
    n = v.agg(F.count("*").alias("n"))
    t = d.select("doc_id", F.posexplode(F.arrays_zip("f", "w")).alias("pos", "x")).join(F.broadcast(n)).select("doc_id", "pos", F.col("x.f").alias("switch"), F.pmod(F.xxhash64("x.w"), F.col("n")).alias("vec_id"))
    return A.proxy_sprc(t.join(v, "vec_id").select("doc_id", "pos", "switch", F.col("embedding").alias("vector")))


# --- streams ---------------------------------------------------------------------------------------------------------


def _streamed(spark, sf, name, make, mode):
    """The rows that a stream over a table's files leaves in a table, batch by batch until there is no more to read."""
    source = table(spark, sf, name)
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a table is a folder of files, or one file, which a stream reads as the only one of its folder that is named so
    folder = len(source.inputFiles()) != 1 or not source.inputFiles()[0].endswith(f"/{name}.parquet")
    read = spark.readStream.schema(source.schema)
    stream = make(read.parquet(f"{sf}/{name}.parquet") if folder else read.option("pathGlobFilter", f"{name}.parquet").parquet(sf))
    spark.createDataFrame([], stream.schema).write.parquet(out)
    write = lambda rows, _: rows.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"WITH {Q.LABELLED3} SELECT date_trunc('hour', received_at) AS hour, lab3.lang, count(*) AS n FROM lab3 JOIN documents USING (doc_id) WHERE received_at IS NOT NULL GROUP BY 1, 2")
def stream_language_rates(spark, sf):
    return _streamed(spark, sf, "documents", ST.language_rates, "complete").select(F.col("window.start").alias("hour"), "lang", "n")


@query("SELECT job_id, count(DISTINCT row_no) AS n FROM uploads WHERE received_at IS NOT NULL GROUP BY job_id")
def stream_first_deliveries(spark, sf):
    return _streamed(spark, sf, "uploads", ST.first_deliveries, "append").groupBy("job_id").agg(F.count("*").alias("n"))


def queries():
    return {k: f for k, (f, _) in CATALOGUE.items()} | problems.queries()


def oracle_sql():
    return {k: s for k, (_, s) in CATALOGUE.items() if s} | problems.oracle_sql()
