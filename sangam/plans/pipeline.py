"""The validated, ordered pipeline over text operators (P-1 to P-11 without P-9).

A pipeline is plan-time Python: it checks and orders the modules, then adds one projection after the other to the table.
"""

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.functions import tokens as T
from sangam.functions.lexicon import DEFAULT, Lexicons
from sangam.operators import augment as A
from sangam.operators import convert as C
from sangam.operators import normalize as N
from sangam.operators import switches as S
from sangam.session import written
from sangam.sources.corpora import read_csv, write_csv, write_manifest

TRANSFORMATION, ANALYSIS, AUGMENTATION = "TRANSFORMATION", "ANALYSIS", "AUGMENTATION"
# Module names with their category and priority (lower comes earlier).
MODULES = {
    "phonetic_normalization": (TRANSFORMATION, 0),
    "language_aware_normalization": (TRANSFORMATION, 0),
    "script_unification": (TRANSFORMATION, 1),
    "transliteration": (TRANSFORMATION, 1),
    "balanced_tokenization": (TRANSFORMATION, 2),
    "language_identification_tagging": (ANALYSIS, 3),
    "switch_point_encoding": (ANALYSIS, 3),
    "context_aware_subword_sampling": (TRANSFORMATION, 4),
    "code_switch_augmentation": (AUGMENTATION, 99),
}
DEFAULT_ORDER = [m for m in MODULES if m != "code_switch_augmentation"]
CONFLICTING = {frozenset({"transliteration", "script_unification"})}
REDUNDANT = {frozenset({"language_identification_tagging", "switch_point_encoding"})}
# The named pipelines.
PRESETS = {
    "P1": ["balanced_tokenization"],
    "P2": ["phonetic_normalization", "language_aware_normalization"],
    "P3": ["transliteration", "script_unification"],
    "P4": ["language_identification_tagging", "switch_point_encoding"],
}
OUTPUT_MODES = ("model", "analysis", "both")


@dataclass
class Pipeline:
    """enabled: module names; configs: parameters of each; order: their sequence (the default one if none is given)."""

    enabled: list[str]
    configs: dict[str, dict] = field(default_factory=dict)
    order: list[str] | None = None
    output_mode: str = "model"
    enable_analysis: bool = False
    allow_conflicts: bool = False
    random_seed: int = 42
    lexicons: Lexicons = DEFAULT
    targets: object = None  # roman to Devanagari map column, for balanced_tokenization
    id_col: str = "doc_id"

    def __post_init__(self):
        unknown = [m for m in [*self.enabled, *(self.order or ()), *self.configs] if m not in MODULES]
        if unknown:
            raise ValueError(f"unknown modules {unknown}")
        if self.output_mode not in OUTPUT_MODES:
            raise ValueError(f"output_mode {self.output_mode!r} is none of {OUTPUT_MODES}")
        self.sequence = [m for m in (self.order or DEFAULT_ORDER) if m in self.enabled]
        for w in self.validate():
            warnings.warn(w, stacklevel=3)

    @property
    def analysis_on(self) -> bool:
        return self.enable_analysis or self.output_mode in ("analysis", "both")

    def validate(self) -> list[str]:
        """Warnings of this configuration; raises ValueError for what cannot run."""
        out = []
        if len(set(self.sequence)) < len(self.sequence) or len(set(self.enabled)) < len(self.enabled):
            raise ValueError("a module occurs twice")
        on = set(self.enabled)
        for pair in CONFLICTING:
            if pair <= on:
                if not self.allow_conflicts:
                    raise ValueError(f"{sorted(pair)} conflict")
                out.append(f"{sorted(pair)} conflict")
        out += [f"{sorted(pair)} are redundant" for pair in REDUNDANT if pair <= on]
        pr = [MODULES[m][1] for m in self.sequence]
        out += [f"{b} stands after {a}, which it should precede" for a, b, x, y in zip(self.sequence, self.sequence[1:], pr, pr[1:]) if x > y]
        if not self.analysis_on:
            out += [f"{m} is skipped in output mode model" for m in self.sequence if MODULES[m][0] == ANALYSIS]
        if "context_aware_subword_sampling" in self.sequence and self.sequence[-1] != "context_aware_subword_sampling":
            out.append("context_aware_subword_sampling should come last")
        return out

    def recommend(self) -> list[str]:
        """Modules that would round off this pipeline."""
        on = set(self.enabled)
        want = []
        if on & {"transliteration", "script_unification", "balanced_tokenization"} and "phonetic_normalization" not in on:
            want.append("phonetic_normalization")
        if "phonetic_normalization" in on and "language_aware_normalization" not in on:
            want.append("language_aware_normalization")
        return want

    def describe(self) -> dict:
        return {"enabled": list(self.enabled), "order": list(self.sequence), "module_configs": dict(self.configs), "output_mode": self.output_mode, "enable_analysis": self.analysis_on, "allow_conflicts": self.allow_conflicts, "random_seed": self.random_seed}

    def _transform(self, df: DataFrame, m: str, col: str) -> DataFrame:
        kw = {"normalized": True} | self.configs.get(m, {})
        if m == "phonetic_normalization":
            return N.process(df, N.phonetic, col, col, lex=self.lexicons, **kw)
        if m == "language_aware_normalization":
            return N.process(df, N.language_aware, col, col, lex=self.lexicons, **kw)
        if m == "script_unification":
            return C.script_unification(df, col, col, lex=self.lexicons, **kw)
        if m == "transliteration":
            return C.transliteration(df, col, col, lex=self.lexicons, **kw)
        if m == "balanced_tokenization":
            targets = self.targets if self.targets is not None else F.from_json(F.lit("{}"), "map<string,string>")
            return C.balanced_tokenization(df, targets, col, col, lex=self.lexicons, **kw)
        return A.subword_sampling(df, self.id_col, col, col, lex=self.lexicons, **({"random_seed": self.random_seed} | kw))

    def process(self, df: DataFrame, text_col: str = "text", output_col: str = "processed_text") -> DataFrame:
        """P-5/P-6: output_col, and analysis_<module> columns made from the same transformed text."""
        if text_col not in df.columns:
            raise ValueError(f"no column {text_col!r}; there are {df.columns}")
        # composed once; what the modules write is composed already
        out = df.withColumn(output_col, T.nfkc(F.col(text_col)) if self.sequence else F.col(text_col))
        if self.output_mode != "analysis":
            for m in self.sequence:
                if MODULES[m][0] == TRANSFORMATION:
                    out = self._transform(out, m, output_col)
        if self.analysis_on:
            for m in self.sequence:
                if MODULES[m][0] == ANALYSIS:
                    f = S.tag_tokens if m == "language_identification_tagging" else S.encode_tokens
                    out = out.withColumn(f"analysis_{m}", f(F.col(output_col), self.lexicons, **self.configs.get(m, {}))).withColumn(f"analysis_{m}", S.join_marked(F.col(f"analysis_{m}")))
        return out

    def trace(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """P-8: a column trace of (module, before, after) for each transformation, in order."""
        out, steps = df.withColumn("processed_text", T.nfkc(F.col(text_col))), []
        for m in self.sequence:
            if MODULES[m][0] == TRANSFORMATION:
                k = f"__before_{len(steps)}"
                out = self._transform(out.withColumn(k, F.col("processed_text")), m, "processed_text").withColumn(k + "a", F.col("processed_text"))
                steps.append(F.struct(F.lit(m).alias("module"), F.col(k).alias("before"), F.col(k + "a").alias("after")))
        trace = F.array(*steps) if steps else F.array().cast("array<struct<module:string,before:string,after:string>>")
        return out.withColumn("trace", trace).drop(*[f"__before_{i}{s}" for i in range(len(steps)) for s in ("", "a")])

    def collect_statistics(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """P-9: (module, statistic, value) of every enabled module, from the texts that come to it, and of the pipeline itself:
        rows, and for each transformation the rows that it changed."""
        from sangam.operators import convert as V

        def rows(name, stats):
            return stats.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in stats.columns]), F.array(*[F.col(c).cast("double") for c in stats.columns]))).alias("statistic", "value")).select(F.lit(name).alias("module"), "statistic", "value")

        out = written(df.withColumn("processed_text", T.nfkc(F.col(text_col))), "p9-rows")  # several statistics read each state
        every = rows("pipeline", out.agg(F.count("*").alias("rows"), F.count(text_col).alias("texts")))
        for m in self.sequence:
            before = out
            config = self.configs.get(m, {})
            if MODULES[m][0] == TRANSFORMATION:
                out = written(self._transform(before.withColumn("__before", F.col("processed_text")), m, "processed_text"), "p9-rows")
                every = every.unionByName(rows(m, out.agg(F.count_if(~F.col("__before").eqNullSafe(F.col("processed_text"))).alias("changed_rows"))))
                out = out.drop("__before")
            if m == "transliteration":
                every = every.unionByName(rows(m, V.transliteration_stats(before, "processed_text", self.lexicons)))
            elif m == "language_identification_tagging":
                every = every.unionByName(rows(m, S.tagging_stats(before, "processed_text", self.lexicons, config.get("tag_unknown", True))))
            elif m == "switch_point_encoding":
                every = every.unionByName(rows(m, S.switch_stats(before, "processed_text", self.lexicons)))
        if "code_switch_augmentation" in self.enabled:
            every = every.unionByName(rows("code_switch_augmentation", A.augmentation_stats(self.augment(df, text_col))))
        return every

    def augment(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """P-10."""
        if "code_switch_augmentation" not in self.enabled:
            raise RuntimeError("code_switch_augmentation is not enabled")
        return A.augment(df, self.id_col, text_col, self.lexicons, **({"random_seed": self.random_seed} | self.configs.get("code_switch_augmentation", {})))

    def process_csv(self, spark, path: str, out: str, text_col: str = "text") -> DataFrame:
        """P-7."""
        df = self.process(read_csv(spark, path, (text_col,)), text_col)
        write_csv(df, out)
        return df


def preset(name: str, **kw) -> Pipeline:
    """A named pipeline; P3 pairs two conflicting modules and P4 only annotates, so both need their switches."""
    extra = {"P3": {"allow_conflicts": True}, "P4": {"enable_analysis": True, "output_mode": "both"}}.get(name, {})
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return Pipeline(list(PRESETS[name]), **(extra | kw))


def experiment_suite(df: DataFrame, base: Pipeline, out: str, text_col: str = "text") -> list[str]:
    """P-11: baseline, each enabled module alone, the presets that are enabled, and all together, each written to
    experiment=<name>, from one cached input; a manifest lies beside them. Sub-pipelines keep the base's switches."""
    runs = {"baseline": []} | {m: [m] for m in base.sequence} | {k: v for k, v in PRESETS.items() if set(v) <= set(base.enabled)} | {"full_pipeline": list(base.sequence)}
    names = []
    cached = df.persist()
    try:
        for name, mods in runs.items():
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                p = Pipeline(mods, {k: v for k, v in base.configs.items() if k in mods}, base.order, base.output_mode, base.enable_analysis, True, base.random_seed, base.lexicons, base.targets, base.id_col)
            p.process(cached, text_col).write.mode("overwrite").parquet(f"{out}/experiment={name}")
            names.append(name)
    finally:
        cached.unpersist()
    write_manifest(f"{out}/manifest.json", df.sparkSession, experiments=names, **base.describe())
    return names


def modules_table(spark) -> DataFrame:
    """The registry as a table: key, category, priority, conflicts."""
    rows = [(k, c, p, sorted(x for pair in CONFLICTING if k in pair for x in pair - {k})) for k, (c, p) in MODULES.items()]
    return spark.createDataFrame(rows, "key string, category string, priority int, conflicts array<string>")
