"""An addition for streams: the same classifier rules over questions as they arrive, counted in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.functions import text as T


def intents_by_window(questions: DataFrame, at: str, text: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, intent, n) per tumbling window; rows later than the watermark are dropped by the stream. Works on batches too."""
    df = questions.select(F.col(at).alias("_at"), T.classify_intent(F.col(text)).alias("intent"))
    if questions.isStreaming:
        df = df.withWatermark("_at", late)
    return df.groupBy(F.window("_at", width), "intent").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "intent", "n")
