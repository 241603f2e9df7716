"""Fixtures: a seeded sample of a dataset written once with a sidecar, reused only if everything matches; records from documents and texts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions import taxonomy as X
from maskwright.operators.documents import chunks
from maskwright.operators.records import gold_dropped, sample
from maskwright.sources.readers import SPAN_DDL
from maskwright.sources.store import content_hash, read_json, write_json


def _meta_path(path: str) -> str:
    return f"{path.rstrip('/')}.meta.json"


def target_labels(labels: list[str] | None) -> list[str]:
    """Given labels checked against the taxonomy, else all coarse ones."""
    unknown = [x for x in labels or [] if not X.is_known(x)]
    if unknown:
        raise ValueError(f"unknown labels {unknown}")
    return list(labels) if labels else list(X.COARSE)


def materialize(records: DataFrame, path: str, n: int, seed: int = 42, dataset: str = "", labels: list[str] | None = None, gold: str | None = None) -> dict:
    """Writes the first ``n`` records in seeded hash order, gold out of bounds dropped and counted, and a sidecar. ``gold``: None, ``none`` or ``silver``."""
    spark = records.sparkSession
    chosen = sample(records, n, seed)
    lost = gold_dropped(chosen).agg(F.coalesce(F.sum("n_dropped"), F.lit(0))).first()[0]
    ok = F.filter("gold_spans", lambda s: F.coalesce(S.in_bounds(s["start"], s["end"], F.col("text")) & s["label"].isin(X.COARSE), F.lit(False)))
    chosen.withColumn("gold_spans", ok).write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    meta = {
        "version": 1, "dataset": dataset, "seed": seed, "n_requested": n, "n_written": back.count(), "labels": target_labels(labels), "dropped_spans": int(lost),
        "gold": gold, "content": content_hash(back)}
    write_json(_meta_path(path), meta)
    return meta


def ensure(records: DataFrame, path: str, n: int, seed: int = 42, dataset: str = "") -> tuple[DataFrame, dict]:
    """Reuses written fixtures only if dataset, size, seed and content match their sidecar."""
    meta = read_json(_meta_path(path)) if os.path.exists(path) else {}
    if meta and (meta["dataset"], meta["n_requested"], meta["seed"]) == (dataset, n, seed):
        rows = records.sparkSession.read.parquet(path)
        if content_hash(rows) == meta["content"]:
            return rows, meta
    meta = materialize(records, path, n, seed, dataset)
    return records.sparkSession.read.parquet(path), meta


def from_documents(documents: DataFrame, max_chars: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(unlabelled records ``doc#k`` of all non-blank chunks, blank chunks); both are needed to rebuild the documents."""
    every = chunks(documents, max_chars)
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    records = every.where(~blank).select(
        F.concat_ws("#", F.col("doc_id").cast("string"), F.col("k").cast("string")).alias("id"), "text", F.lit(None).cast("string").alias("language"),
        F.array().cast(SPAN_DDL).alias("gold_spans"), "doc_id", "offset")
    return records, every.where(blank)


def load_run(spark: SparkSession, fixtures: str, raw: str, detectors: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, result rows) of a run; the detector list prunes partitions."""
    rows = spark.read.parquet(raw)
    return spark.read.parquet(fixtures), rows.where(F.col("detector").isin(detectors)) if detectors else rows
