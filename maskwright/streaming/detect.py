"""Detection, rewriting and latency on streams. All per-record operators are the batch ones; only windows need state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.detect import detect_rules
from maskwright.operators.transforms import rewrite


def rewrite_stream(source: DataFrame, mode: str = "label", rules: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Stateless: rule detection and rewriting of a streaming (or batch) table."""
    return rewrite(detect_rules(source, rules, text_col), "spans", text_col, mode)


def latency_windows(calls: DataFrame, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Per detector and window: calls, errors, measured calls and their summed latency, with a watermark for late rows; repeated rows count once."""
    key = ["id", "detector", "run_id", "started_at"]
    if calls.isStreaming:
        # event time must be a timestamp with a zone; the session's zone is used for tables without one
        timed = calls.withColumn("started_at", F.col("started_at").cast("timestamp"))
        once = timed.withWatermark("started_at", late).dropDuplicatesWithinWatermark(key)
    else:
        once = calls.dropDuplicates(key)
    ok = F.col("error").isNull() & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms")
    return once.groupBy(F.window("started_at", window).alias("w"), "detector").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(ok).alias("measured"), F.sum(F.when(ok, F.col("latency_ms"))).alias("sum_ms"),
    ).select(F.col("w.start").alias("window_start"), "detector", "calls", "errors", "measured", F.round("sum_ms", 3).alias("sum_ms"))
