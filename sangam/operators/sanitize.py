"""Control markers out of texts for models (A-3 to A-5)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangam.functions import patterns as P


def clean_for_model(text: Column, parity: bool = False) -> Column:
    """Every marker becomes a blank, then runs of blanks one blank; null becomes the empty text."""
    t = F.coalesce(text, F.lit(""))
    for p in (P.MARKERS_PARITY if parity else P.MARKERS).values():
        t = F.regexp_replace(t, p, " ")
    return F.trim(F.regexp_replace(t, r"\s{2,}", " "))


def marker_counts(text: Column, parity: bool = False) -> list[Column]:
    """One count per kind of marker, each on the text that the kinds before it have left."""
    t, out = F.coalesce(text, F.lit("")), []
    for name, p in (P.MARKERS_PARITY if parity else P.MARKERS).items():
        out.append(F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0))).alias(name))
        t = F.regexp_replace(t, p, " ")
    return out


def contains_markers(text: Column) -> Column:
    return text.rlike("|".join(P.MARKERS.values()))


def add_model_input(df: DataFrame, text_col: str = "processed_text", output_col: str = "model_input_text") -> DataFrame:
    return df.withColumn(output_col, clean_for_model(F.col(text_col)))
