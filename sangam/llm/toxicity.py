"""Problem 4: abusive, hateful or sexual passages, by maximum-scoring segment search.

Tokens are words freed of disguise: look-alike letters, digits and signs for letters, separated or repeated letters,
masked letters. @ $ and a leading ! that touch a word are its letters. Two readings are open until the words are learnt:
@name is a mention unless it reads as a toxic word in a-, and the last ! of a disguised word is a mark unless the word
reads as a toxic one in -i. Each word and each pair of neighbouring words has a log-odds (toxic against neutral) with an informative
Dirichlet prior, learnt from human verdicts; further rounds learn only from the passages that the round before found, so
that the neutral rest of a toxic text, and mistaken verdicts, count for what they are, and hold them against the counts
of the whole corpus. A linear scan (Ruzzo and Tompa)
yields every maximal-scoring passage of a text. The chance that neutral text of the same length holds a passage as high
follows an extreme-value law whose parameters come from the neutral verdicts; the text's score is -log10 of that chance,
and a row is toxic from SIGNIFICANT on.

The verdicts used are bounded by MAX_VERDICTS rows, picked by the hash of their ids; every row is scored, over its whole
text.

Defined results: a null, blank or word-free text scores 0; rows reviewed twice count as toxic or neutral by majority (a
tie is left out), null verdicts are left out; without verdicts of both kinds no row is toxic and all scores are 0; a null
source is a source of its own; rows without an id are left out.
"""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.session import written

from .lookalikes import TWINS, fold

MAX_VERDICTS = 20_000
PRIOR, OFFSET, CLIP, UNSEEN = 30.0, 1.0, 5.0, -1.0
#: Weight of a pair beside its words.
PAIR = 0.6
#: A token needs that many toxic or neutral occurrences to have a score of its own.
LEAST = 2
#: A row is toxic where the chance of such a passage in neutral text is below 10 to minus this: about 3 of 10,000 neutral rows.
SIGNIFICANT = 3.5

_twins = str.maketrans(TWINS)
# Signs written for letters.
_LEET = str.maketrans("013457@$", "oieastas")
_drop = re.compile(r"(?:https?://|www\.)\S+|(?<!\w)#[\w‌‍]+:?")
# A name has no other sign inside and no $ behind it; such are words.
_mention = re.compile(r"(?<!\w)@[\w‌‍]+(?![\w‌‍]|\$|[*#@!]+\w):?")
_name = re.compile(r"@\w+")
_mark = "ऀ-ःऺ-ॏॢॣঁ-ঃ়-্ஂா-்"
_spaced = re.compile(rf"(?<!\S)[^\W\d_][{_mark}]?(?:\s+(?:[^\W\d_]|[{_mark}])+(?!\S)(?<=\s..)|\s+(?:[^\W\d_]|[{_mark}])(?!\S)){{2,}}")
_apart = re.compile(r"(?<![^\W_])[^\W\d_][.\-_*~|][^\W\d_]")
_parts = re.compile(r"[.\-_*~|]+")
_edges = " \t\"'()[]{}<>.,!?;:।॥…-_~|"
_runs = re.compile(r"(.)\1+")
_word = re.compile(rf"[\w*#@$!{_mark}]+")
_sign = re.compile(r"[\d@$*#_!]")


def _joined(word: str) -> str:
    """A word whose letters are set apart by signs, written together; any other word as it is."""
    parts = [p for p in _parts.split(word.strip(_edges)) if p]
    return "".join(parts) if len(parts) >= 3 and all(len(p) <= 2 for p in parts) and sum(map(len, parts)) <= len(parts) + 2 else word


def tokens(text: str) -> list[str]:
    """Words in order, freed of disguise; masked letters are left as *, open readings as @... and ...! (see unmasked)."""
    if not text.isascii():
        text = fold(text).translate(_twins)
    text = _drop.sub(" ", text.lower())
    if "@" in text:
        text = _mention.sub(lambda m: f" {m.group().rstrip(':')} " if m.group().isascii() else " ", text)
    if _apart.search(text):
        text = " ".join(map(_joined, text.split()))
    text = _spaced.sub(lambda m: "".join(m.group().split()), text)
    found = _word.findall(_runs.sub(r"\1", text))
    if not _sign.search(text):
        return found
    out = []
    for w in found:
        if not w.isalpha() and _sign.search(w):
            bare = w.strip("!*#@$_")
            if not bare or bare.isdigit() or bare.strip("*_0123456789") == "":
                continue
            if _name.fullmatch(w):
                w = _runs.sub(r"\1", w.translate(_LEET))
                if len(w) > 2:
                    out.append("@" + w[1:])
                continue
            own = w.lstrip("#_").rstrip("!*#_")
            end = w.rstrip("*#_").endswith("!") and _sign.search(own)
            w = _runs.sub(r"\1", own.replace("#", "*").replace("!", "i").translate(_LEET))
            if end and w[-1] != "i":
                w += "!"
        out.append(w)
    return out


def unmasked(toks: list[str], masks: dict[str, str]) -> list[str]:
    """Tokens with the masked spellings that are known, without mentions, and without the marks behind other words."""
    out = []
    for t in toks:
        if "*" in t or t[:1] == "@" or t[-1:] == "!":
            t = masks.get(t) or ("" if t[:1] == "@" else masks.get(t[:-1] + "i") or masks.get(t[:-1], t[:-1]) if t[-1:] == "!" else t)
            if not t:
                continue
        out.append(t)
    return out


def elements(toks: list[str]) -> list[tuple[str, str]]:
    """Each word with the pair that it ends (none for the first word)."""
    return [(b, a + " " + b if a else "") for a, b in zip(["", *toks], toks)]


class Model:
    """scores: log-odds less OFFSET of words and pairs; masks: masked spellings of toxic words; lam, k: extreme-value law."""

    def __init__(self, scores=None, masks=None, lam=1.0, k=0.1, cut=math.inf):
        self.scores, self.masks, self.lam, self.k, self.cut = scores or {}, masks or {}, lam, k, cut

    def clean(self, toks: list[str]) -> list[str]:
        return unmasked(toks, self.masks)

    def line(self, toks: list[str]) -> list[float]:
        get = self.scores.get
        out, before = [], ""
        for t in toks:
            out.append(get(t, UNSEEN) + (get(before + " " + t, 0.0) if before else 0.0))
            before = t
        return out

    def passages(self, toks: list[str]) -> list[tuple[int, int, float]]:
        return segments(self.line(toks))

    def score(self, joined: str | None) -> tuple[float, float, int]:
        """(-log10 of the chance, best passage's score, passages that are significant by themselves) of joined tokens."""
        toks = self.clean(joined.split(" ")) if joined else []
        if not toks or not self.scores:
            return 0.0, 0.0, 0
        line = self.line(toks)
        if max(line) <= 0:
            return 0.0, 0.0, 0
        found = segments(line)
        best = max(s for _, _, s in found)
        many = sum(self.chance(s, len(toks)) >= self.cut for _, _, s in found)
        return self.chance(best, len(toks)), best, many

    def chance(self, s: float, n: int) -> float:
        e = self.k * n * math.exp(-self.lam * s)
        return max(0.0, -math.log10(max(-math.expm1(-e), 1e-300)))


def segments(line: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a line of scores, in linear time."""
    found: list[list] = []  # start, end, total before it, total at its end
    total = 0.0
    for i, s in enumerate(line):
        before = total
        total += s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r in found]


def log_odds(toxic: Counter, neutral: dict, n_neutral: int) -> dict[str, float]:
    """Log-odds of each token against the neutral counts, with a prior in proportion to its share of both."""
    nt, nn = sum(toxic.values()) or 1, n_neutral or 1
    out = {}
    for w in toxic.keys() | neutral.keys():
        t, n = toxic[w], max(neutral.get(w, 0), 0)
        if t + n < LEAST:
            continue
        a = PRIOR * (t + n) / (nt + nn) + 0.01
        d = math.log((t + a) / (nt + PRIOR)) - math.log((n + a) / (nn + PRIOR))
        # shrink what rests on few occurrences
        out[w] = max(-CLIP, min(CLIP, d * (t / (t + 1.0) if d > 0 else n / (n + 1.0))))
    return out


def _learn(texts: list[list[str]], toxic_spans: list[list[tuple[int, int]]], corpus=None) -> dict[str, float]:
    """Scores from texts and the spans in them that count as toxic. corpus: (counts, words, pairs) of the whole corpus,
    which then stands for neutral text."""
    tox, neu = (Counter(), Counter()), (Counter(), Counter())
    for toks, spans in zip(texts, toxic_spans):
        inside = [False] * len(toks)
        for a, b in spans:
            inside[a:b] = [True] * (b - a)
        for (w, p), x in zip(elements(toks), inside):
            for k, t in ((0, w), (1, p)):
                if t:
                    (tox if x else neu)[k][t] += 1
    if corpus:
        counts, n = corpus
        neu = tuple({w: counts.get(w, 0) for w in tox[k].keys() | neu[k].keys()} for k in (0, 1))
        total = (n, n)
    else:
        total = tuple(sum(c.values()) for c in neu)
    words, pairs = (log_odds(t, c, n) for t, c, n in zip(tox, neu, total))
    return {w: d - OFFSET for w, d in words.items()} | {p: PAIR * (d - math.copysign(OFFSET, d)) for p, d in pairs.items() if abs(d) > OFFSET}


def _masks(texts, scores) -> dict[str, str]:
    """Masked spellings of words that score as toxic, and those with an open reading."""
    out = {}
    for w, s in sorted(scores.items(), key=lambda x: x[1]):
        if s > 0.8 and " " not in w and "*" not in w and len(w) > 2:
            for i in range(len(w)):
                out[w[:i] + "*" + w[i + 1 :]] = w
                out.setdefault(w[:i] + "*" + w[i:], w)
            if w[0] == "a":
                out["@" + w[1:]] = w
            if w[-1] == "i":
                out[w[:-1] + "!"] = w
    return out


def _calibrate(m: Model, neutral: list[list[str]]) -> None:
    """lam from the scores of neutral tokens (the root of E exp(lam s) = 1), k from the passages of neutral texts."""
    s = np.array([x for toks in neutral for x in m.line(toks)]) if neutral else np.zeros(0)
    if not len(s) or s.max() <= 0 or s.mean() >= 0:
        return
    lo, hi = 1e-6, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.mean(np.exp(np.minimum(mid * s, 500))) < 1 else (lo, mid)
    m.lam = lo
    best = [(max((x[2] for x in m.passages(t)), default=0.0), len(t)) for t in neutral if t]
    # P(best <= x) = exp(-k n exp(-lam x)): each text gives -1 / (n exp(-lam x)) to the likelihood
    rate = np.mean([n * math.exp(-m.lam * x) for x, n in best])
    m.k = float(min(10.0, max(1e-4, 1.0 / max(rate, 1e-9))))


def fit_scores(texts: list[list[str]], bad: list[bool], rounds: int = 2, corpus=None, start: Model | None = None) -> Model:
    """Scores, masks and the extreme-value law from texts with verdicts; start: a model whose passages to begin with."""
    m = start or Model()
    own = [m.clean(t) for t in texts]
    spans = [[(0, len(t))] if b else [] for t, b in zip(own, bad)] if not start else _spans(m, own, bad, True)
    for r in range(rounds):
        m.scores = _learn(own, spans, corpus)
        m.masks = _masks(own, m.scores)
        own = [m.clean(t) for t in texts]
        _calibrate(m, [t for t, b in zip(own, bad) if not b])
        spans = _spans(m, own, bad, r > 0)
    return m


def _spans(m: Model, texts, bad, mend: bool) -> list[list[tuple[int, int]]]:
    """The passages that count as toxic. mend: a neutral verdict over an evident passage is taken for a mistake."""
    out = []
    for t, b in zip(texts, bad):
        found = m.passages(t) if t else []
        top = max((s for _, _, s in found), default=0.0)
        keep = [(a, e) for a, e, s in found if s >= 0.5 * top and m.chance(s, len(t)) > (2.0 if mend else 1.0)]
        out.append(keep if b or (mend and top and m.chance(top, len(t)) > 6.0) else [])
    return out


def fit(rows: list[tuple[str, bool]], count=None) -> Model:
    """The model of labelled rows, (tokens joined by blanks, toxic).

    count: gives the counts in the whole corpus of a vocabulary (the tokens and pairs of the rows, which bound it), and
    the corpus's number of tokens. The cut is SIGNIFICANT: verdicts over-represent toxic rows, so that a cut fitted to them
    would let too many neutral rows pass; the extreme-value law holds for rows as they come."""
    texts, bad = [t.split() for t, _ in rows], [b for _, b in rows]
    if not any(bad) or all(bad):
        return Model()
    m = fit_scores(texts, bad)
    if count:
        own = [m.clean(t) for t in texts]
        vocabulary = {x for t in own for e in elements(t) for x in e if x}
        m = fit_scores(texts, bad, corpus=count(vocabulary, m.masks), start=m)
    m.cut = SIGNIFICANT
    return m


def token_rows(df: DataFrame, id_col: str = "row_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row_id, source, toks), written: tokens joined by blanks, null for a null text."""

    def run(batches):
        for b in batches:
            toks = [None if t is None else " ".join(tokens(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(toks, pa.string())], names=["row_id", "source", "toks"])

    t = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("t"))
    return written(t.mapInArrow(run, "row_id long, source string, toks string"), "p4-tokens")


def corpus_counts(rows: DataFrame, vocabulary: set[str], masks: dict[str, str]):
    """(occurrences of each token or pair of the vocabulary, all tokens), over all rows."""
    names = sorted(vocabulary)
    index = {w: i for i, w in enumerate(names)}

    def run(batches):
        total = np.zeros(len(names) + 1, np.int64)
        get = index.get
        for b in batches:
            at = []
            for t in b.column(0).to_pylist():
                if t:
                    before = ""
                    toks = t.split(" ")
                    if "*" in t or "@" in t or "!" in t:
                        toks = unmasked(toks, masks)
                    total[-1] += len(toks)
                    for x in toks:
                        if (i := get(x)) is not None:
                            at.append(i)
                            if (i := get(before + " " + x)) is not None:
                                at.append(i)
                        before = x
            if at:
                total[:-1] += np.bincount(np.array(at), minlength=len(names))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(total[has])], names=["i", "n"])

    got = rows.select("toks").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(got.column("i").to_pylist(), got.column("n").to_pylist()))
    return {w: n.get(i, 0) for i, w in enumerate(names)}, n.get(len(names), 0)


def verdicts(labels: DataFrame, most: int = MAX_VERDICTS) -> DataFrame:
    """(row_id, toxic): the majority of each row's verdicts, for at most about `most` rows."""
    bad = F.avg(F.when(F.lower(F.trim("verdict")) == "ok", 0.0).otherwise(1.0))
    rows = labels.where("verdict is not null and row_id is not null").groupBy(F.col("row_id").cast("long").alias("row_id")).agg(bad.alias("share")).where("share <> 0.5")
    n = rows.count()
    span = 1 << 62
    rows = rows.where(F.pmod(F.xxhash64("row_id"), F.lit(span)) < F.lit(min(span, int(span * (most / max(n, 1))))))
    return rows.select("row_id", (F.col("share") > 0.5).alias("toxic")).limit(2 * most)


def train(rows: DataFrame, labels: DataFrame, most: int = MAX_VERDICTS) -> Model:
    """rows: token_rows of the whole table."""
    got = rows.where("toks is not null").join(F.broadcast(verdicts(labels, most)), "row_id").select("row_id", "toks", "toxic").orderBy(F.xxhash64("row_id"), "toks").limit(4 * most).collect()
    return fit([(r.toks, r.toxic) for r in got], lambda vocabulary, masks: corpus_counts(rows, vocabulary, masks))


def held_out(df: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "row_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(fold, toxic, found, neutral, flagged): each fold of the verdicts, by the hash of the row, judged by a model that learnt
    from the other folds only. What a verdict says is taken as true, though some are mistaken."""
    rows = token_rows(df, id_col, text_col, source_col)
    fold = F.pmod(F.xxhash64("row_id", F.lit("fold")), F.lit(folds))
    out = []
    for k in range(folds):
        m = train(rows, labels.where(fold != k))
        own = rows.where(fold == k).join(F.broadcast(verdicts(labels.where(fold == k))), "row_id").select("toks", "toxic").collect()
        said = [m.score(r.toks)[0] >= m.cut for r in own]
        out.append((k, *(sum(1 for r, s in zip(own, said) if r.toxic == t and (s or every)) for t in (True, False) for every in (True, False))))
    return df.sparkSession.createDataFrame(out, "fold int, toxic long, found long, neutral long, flagged long")


def scores(df: DataFrame, labels: DataFrame, id_col: str = "row_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row_id, source, score, best_passage, n_passages, toxic) of every row."""
    rows = token_rows(df, id_col, text_col, source_col)
    m = train(rows, labels)
    state = (m.scores, m.masks, m.lam, m.k, m.cut)

    def run(batches):
        own = Model(*state)
        for b in batches:
            got = [own.score(t) for t in b.column(2).to_pylist()]
            s, best, many = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array(best, pa.float64()), pa.array(many, pa.int32()), pa.array([x >= own.cut for x in s], pa.bool_())],
                names=["row_id", "source", "score", "best_passage", "n_passages", "toxic"],
            )

    return rows.mapInArrow(run, "row_id long, source string, score double, best_passage double, n_passages int, toxic boolean")


def source_rates(scored: DataFrame) -> DataFrame:
    """(source, n_rows, n_toxic, rate, mean_score)."""
    n = F.sum(F.when(F.col("toxic"), 1).otherwise(0))
    return scored.groupBy("source").agg(F.count("*").alias("n_rows"), n.alias("n_toxic"), (n / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))
