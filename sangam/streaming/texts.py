"""Text operators on streams. All transformations are per-row projections, so a pipeline runs unchanged on a stream; only
windowed statistics keep state, bounded by their watermark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.functions import tokens as T
from sangam.functions.lexicon import DEFAULT, Lexicons
from sangam.plans.pipeline import Pipeline


def process_stream(stream: DataFrame, pipeline: Pipeline, text_col: str = "text") -> DataFrame:
    return pipeline.process(stream, text_col)


def language_rates(stream: DataFrame, text_col: str = "text", time_col: str = "received_at", window: str = "1 hour", late: str = "2 days", lex: Lexicons = DEFAULT) -> DataFrame:
    """(window, lang, n): tokens by language and window; rows later than `late` are left out."""
    t = stream.withWatermark(time_col, late).select(time_col, F.explode(T.split_words(F.col(text_col), lower=False)).alias("tok"))
    return t.groupBy(F.window(time_col, window), T.language3(F.col("tok"), lex).alias("lang")).agg(F.count("*").alias("n"))


def first_deliveries(stream: DataFrame, keys=("job_id", "row_no"), time_col: str = "received_at", late: str = "2 days") -> DataFrame:
    """Redelivered rows dropped, as far back as the watermark reaches."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(list(keys))
