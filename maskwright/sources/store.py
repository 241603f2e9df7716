"""Sinks: JSON lines, result folders of runs with a manifest, baselines, a cache of model answers."""

from __future__ import annotations

import json
import os
import re
import shutil
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines through Spark's commit protocol: readers see all files of a write or none."""
    df.write.mode(mode).json(path)


def write_json(path: str, value: object) -> None:
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1, sort_keys=True)
    os.replace(tmp, path)


def read_json(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def content_hash(records: DataFrame) -> str:
    """Order-independent hash of ids and texts: the sum of row hashes and the row count, one aggregate."""
    row = records.select(F.xxhash64("id", "text").cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{row['n']}:{row['s']}"


class RunStore:
    """A run folder: ``raw/detector=...`` rows, ``manifest.json``, reviews and reports."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.raw = os.path.join(path, "raw")
        self.manifest_path = os.path.join(path, "manifest.json")

    def manifest(self) -> dict:
        return read_json(self.manifest_path)

    def write(self, results: DataFrame, records: DataFrame, dataset: str, labels: Iterable[str], options: dict[str, dict] | None = None, fresh: bool = False) -> dict:
        """Writes the detectors of ``results``, leaving other detectors' rows alone. Other records need ``fresh``."""
        known, now = self.manifest(), content_hash(records)
        if known and known["records_hash"] != now and not fresh:
            raise ValueError("the run holds results of other records; pass fresh=True to start over")
        names = sorted(r[0] for r in results.select("detector").distinct().collect())
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        results.write.mode("overwrite").option("partitionOverwriteMode", "static" if fresh else "dynamic").partitionBy("detector").parquet(self.raw)
        keep = [] if fresh or not known else known["detectors"]
        manifest = {
            "dataset": dataset, "labels": list(labels), "records_hash": now, "n_examples": records.count(), "detectors": sorted({*keep, *names}),
            "detector_options": {**(known.get("detector_options", {}) if not fresh else {}), **(options or {})}}
        os.makedirs(self.path, exist_ok=True)
        write_json(self.manifest_path, manifest)
        return manifest

    def clear(self) -> list[str]:
        """Removes what runs write (rows, manifest, reviews, reports), nothing else in the folder; returns what was removed."""
        gone = []
        for name in sorted(os.listdir(self.path)) if os.path.isdir(self.path) else []:
            if name in ("raw", "manifest.json", "report.md") or name.startswith("review_") or name.endswith(".tmp"):
                full = os.path.join(self.path, name)
                shutil.rmtree(full) if os.path.isdir(full) else os.remove(full)
                gone.append(name)
        return gone

    def review_path(self, name: str) -> str:
        """Where the rows of a reviewer lie."""
        return os.path.join(self.path, f"review_{re.sub(r'[^A-Za-z0-9.-]+', '_', name)}")

    def reviews(self, name: str | None = None) -> DataFrame:
        """Rows of a review; without a name the only one there is. Raises if there is none, or more than one to choose from."""
        found = sorted(x for x in os.listdir(self.path) if x.startswith("review_")) if os.path.isdir(self.path) else []
        path = self.review_path(name) if name else os.path.join(self.path, found[0]) if len(found) == 1 else None
        if path is None or not os.path.exists(path):
            raise FileNotFoundError(f"no review {name or ''} in {self.path}; there are {found}")
        return self.spark.read.parquet(path)

    def results(self, detectors: list[str] | None = None) -> DataFrame:
        """Result rows; the detector list prunes partitions."""
        rows = self.spark.read.parquet(self.raw)
        return rows.where(F.col("detector").isin(detectors)) if detectors else rows

    def reuse_from(self, other: RunStore) -> list[str]:
        """Takes over results of detectors this run lacks."""
        mine = set(self.manifest().get("detectors", []))
        new = [d for d in other.manifest().get("detectors", []) if d not in mine]
        if new:
            other.results(new).write.mode("append").partitionBy("detector").parquet(self.raw)
            write_json(self.manifest_path, {**self.manifest(), "detectors": sorted(mine | set(new))})
        return new


def export_baseline(run: RunStore, records: DataFrame, path: str) -> dict:
    """Writes the run's rows with the hash of every record's text, so that other runs can start from them."""
    known = run.manifest()
    run.results().write.mode("overwrite").partitionBy("detector").parquet(os.path.join(path, "raw"))
    records.select("id", F.sha1("text").alias("text_sha1")).distinct().write.mode("overwrite").parquet(os.path.join(path, "hashes"))
    meta = {k: known.get(k) for k in ("dataset", "detectors", "detector_options", "n_examples")}
    write_json(os.path.join(path, "baseline.json"), meta)
    return meta


def find_baseline(folder: str, dataset: str, options: dict) -> str | None:
    """The baseline of a dataset with the same detector options."""
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        meta = read_json(os.path.join(folder, name, "baseline.json"))
        if meta and meta["dataset"] == dataset and (meta.get("detector_options") or {}) == options:
            return os.path.join(folder, name)
    return None


def seed_run(run: RunStore, baseline: str, records: DataFrame, dataset: str, labels: Iterable[str], options: dict | None = None) -> bool:
    """Takes the baseline's rows over if its options are the same and it covers every record with the same text; else changes nothing."""
    meta = read_json(os.path.join(baseline, "baseline.json"))
    if not meta or (meta.get("detector_options") or {}) != (options or {}):
        return False
    hashes = run.spark.read.parquet(os.path.join(baseline, "hashes"))
    own = records.select("id", F.sha1("text").alias("text_sha1")).distinct()
    if own.join(hashes, (own["id"] == hashes["id"]) & own["text_sha1"].eqNullSafe(hashes["text_sha1"]), "left_anti").limit(1).count():
        return False
    rows = run.spark.read.parquet(os.path.join(baseline, "raw")).join(own.select("id"), "id", "left_semi")
    run.write(rows, records, dataset, labels, options)
    return True


def cache_key(*parts: Column) -> Column:
    """Key of a model call: a SHA-256 over everything that shapes its answer."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]), 256)


def with_cached(calls: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls with a cached response, calls without); ``cache`` holds ``key, response``."""
    return calls.join(cache, "key"), calls.join(cache, "key", "left_anti")
