"""Records, gold spans and predictions in long form; coverage, counts, latency, validation, samples.

Long spans are keyed by record id; every span-to-span operator joins on that key first and treats positions as
a residual condition, so no plan has a nested loop. Nulls: records without id or text carry no spans; null span lists are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.functions import spans as S
from maskwright.functions import taxonomy as X


FIELDS = ("label", "fine_label", "raw_label", "start", "end")


def _slim(spans: str) -> Column:
    """A span list without the spans' texts, as field arrays zipped again: the scan then reads these fields only."""
    return F.arrays_zip(*[F.col(f"{spans}.{f}") for f in FIELDS])


def distinct_records(fixtures: DataFrame) -> DataFrame:
    """Records without exact repeats: ``id, language, n_chars, text_hash, gold_spans``. Texts are hashed and measured before the shuffle, never moved."""
    if "text_hash" in fixtures.columns:
        return fixtures
    return fixtures.select(
        "id", "language", F.length("text").alias("n_chars"), (F.trim("text") != "").alias("has_text"), F.xxhash64("text").alias("text_hash"), _slim("gold_spans").alias("gold_spans")).distinct()


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """One row per record and detector, the one that started last (ties: larger run id). One shuffle, span texts are not read."""
    body = F.struct(_slim("spans").alias("spans"), "error", "latency_ms")
    return (
        predictions.groupBy("id", "detector").agg(F.max_by(body, F.struct("started_at", "run_id", "ingested_at")).alias("p"))
        .select("id", "detector", "p.spans", "p.error", "p.latency_ms"))


def without_repeats(rows: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns of a table without exact repeats of whole rows. Rows are hashed before the shuffle (128 bits); other columns are not moved."""
    every = [F.col(c) for c in rows.columns]
    h = [F.xxhash64(*every).alias("_h1"), F.xxhash64(F.lit("second"), *every).alias("_h2")]
    return rows.select(*keep, *h).distinct().drop("_h1", "_h2")


def gold_long(records: DataFrame, level: str = "coarse") -> DataFrame:
    """``id, start, end, label`` of gold spans inside the text and inside the taxonomy; repeats count once."""
    flat = distinct_records(records).select("id", "n_chars", F.explode("gold_spans").alias("g")).where(S.within(F.col("g.start"), F.col("g.end"), F.col("n_chars")))
    label = F.col("g.label") if X.check_level(level) == "coarse" else F.coalesce("g.fine_label", "g.label")
    out = flat.where(F.col("g.label").isin(X.COARSE)).select("id", F.col("g.start").alias("start"), F.col("g.end").alias("end"), label.alias("label"))
    return out.distinct()


def gold_dropped(records: DataFrame) -> DataFrame:
    """``id, n_dropped``: gold spans out of the text or out of the taxonomy, per record with any."""
    flat = distinct_records(records).select("id", "n_chars", F.explode("gold_spans").alias("g"))
    ok = S.within(F.col("g.start"), F.col("g.end"), F.col("n_chars")) & F.col("g.label").isin(X.COARSE)
    return flat.where(~F.coalesce(ok, F.lit(False))).groupBy("id").agg(F.count(F.lit(1)).alias("n_dropped"))


def predicted_long(latest: DataFrame, level: str = "coarse") -> DataFrame:
    """``id, detector, start, end, label`` of calls without an error; repeats count once."""
    flat = latest.where("error is null").select("id", "detector", F.explode("spans").alias("p"))
    label = F.col("p.label") if X.check_level(level) == "coarse" else F.coalesce("p.fine_label", "p.label")
    return flat.select("id", "detector", F.col("p.start").alias("start"), F.col("p.end").alias("end"), label.alias("label")).distinct()


def inside_text(pred: DataFrame, records: DataFrame) -> DataFrame:
    """Predicted spans of known records that lie inside the record's text."""
    n = distinct_records(records).groupBy("id").agg(F.max("n_chars").alias("n"))
    return pred.join(n, "id").where(S.within(F.col("start"), F.col("end"), F.col("n"))).drop("n")


def coverage(records: DataFrame, latest: DataFrame) -> DataFrame:
    """Per detector: records, scored, errored and missing calls."""
    ids = records.select("id").distinct()
    total = ids.agg(F.count(F.lit(1))).scalar()
    per = latest.join(ids, "id", "left_semi").groupBy("detector").agg(
        F.count_if(F.col("error").isNull()).alias("scored"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return per.withColumn("n", total).select("detector", "n", "scored", "errors", (F.col("n") - F.col("scored") - F.col("errors")).alias("missing"))


def span_counts(latest: DataFrame) -> DataFrame:
    """Per detector: calls, spans, calls with any span."""
    return latest.groupBy("detector").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce(F.size("spans"), F.lit(0)).cast("bigint")).alias("n_spans"),
        F.count_if(F.size("spans") > 0).alias("with_spans"))


def label_counts(records: DataFrame) -> DataFrame:
    return gold_long(records).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def language_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(X.normalize_language(F.col("language")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def raw_label_counts(latest: DataFrame, vocab: str = "canonical") -> DataFrame:
    """Raw labels with their taxonomy label; the vocabulary is a literal map, so there is no join."""
    flat = latest.select("detector", F.explode("spans").alias("p")).select("detector", F.col("p.raw_label").alias("raw_label"))
    few = flat.groupBy("detector", "raw_label").agg(F.count(F.lit(1)).alias("n"))
    return few.withColumn("canonical", X.to_canonical_col(vocab, F.col("raw_label"), "coarse"))


def exact_quantiles(df: DataFrame, group: str, value: str, ranks: dict[str, Column], buckets_per_e: int = 200, parts: int = 4096) -> DataFrame:
    """Exact order statistics of non-negative values per group, at any size.

    ``ranks`` maps a result column to an expression of the count ``n`` that gives the wanted 0-based rank. Buckets on the logarithm of
    the value are counted first; the buckets that hold a wanted rank are cut into ``parts`` equal parts and counted again; only the values of the part that holds it are
    sorted, as value counts. No group ever comes into one task: windows run over bucket counts (bounded by the range of doubles), part counts and one part's distinct values.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("b", F.floor(F.log1p("v") * buckets_per_e))
    sizes = rows.groupBy("g", "b").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("g")
    spans = sizes.withColumns({"n": F.sum("c").over(w), "before": F.sum("c").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))})
    spans = spans.withColumn("before", F.coalesce("before", F.lit(0)))
    wanted = spans.select("g", "b", "c", "n", "before", F.explode(F.create_map(*[x for k, e in ranks.items() for x in (F.lit(k), e.cast("bigint"))])).alias("k", "rank"))
    wanted = wanted.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))).select("g", "b", "n", "before", "k", "rank")
    # a bucket may still hold very many values: it is cut into equal parts between its ends, and only the part of the wanted rank is sorted
    inside = rows.join(wanted.select("g", "b").distinct(), ["g", "b"], "left_semi")
    ends = inside.groupBy("g", "b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    part = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * parts), F.lit(0))
    inside = inside.join(ends, ["g", "b"]).select("g", "b", "v", part.alias("p"))
    small = Window.partitionBy("g", "b")
    sizes = inside.groupBy("g", "b", "p").agg(F.count(F.lit(1)).alias("c")).withColumn("first", F.sum("c").over(small.orderBy("p")) - F.col("c"))
    wanted = sizes.join(wanted, ["g", "b"]).withColumn("before", F.col("before") + F.col("first")).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
    wanted = wanted.select("g", "b", "p", "n", "before", "k", "rank")
    values = inside.join(wanted.select("g", "b", "p").distinct(), ["g", "b", "p"], "left_semi").groupBy("g", "b", "p", "v").agg(F.count(F.lit(1)).alias("m"))
    upto = values.withColumn("upto", F.sum("m").over(Window.partitionBy("g", "b", "p").orderBy("v")))
    hit = upto.join(wanted, ["g", "b", "p"]).where((F.col("rank") < F.col("before") + F.col("upto")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("m")))
    return hit.groupBy(F.col("g").alias(group)).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ranks])


def latency_summary(predictions: DataFrame) -> DataFrame:
    """Per detector p50 (median), p95, p99 (nearest rank, half-even) of successful calls; nulls and NaN are no measurements."""
    n1 = F.col("n") - 1
    ranks = {"lo": F.floor(n1 / 2), "hi": F.ceil(n1 / 2), "p95": F.bround(n1 * F.lit(0.95)), "p99": F.bround(n1 * F.lit(0.99))}
    got = exact_quantiles(predictions.where("error is null"), "detector", "latency_ms", ranks)
    return got.select("detector", "n", ((F.col("lo") + F.col("hi")) / 2).alias("p50"), "p95", "p99")


def validate(fixtures: DataFrame, unlabeled: bool = False) -> DataFrame:
    """One row per issue: ``id, severity, issue, n``. Errors: missing or repeated id, missing text, offsets out of the text, chunk without a sound offset; warnings:
    label outside the taxonomy, repeated span, overlapping gold, and with ``unlabeled`` any gold."""
    rows = fixtures.select("id", "text", "gold_spans")
    none = rows.where(F.col("id").isNull() | (F.col("id") == "")).select(F.col("id"), F.lit("error").alias("severity"), F.lit("missing id").alias("issue"))
    twice = rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id", F.lit("error").alias("severity"), F.lit("repeated id").alias("issue"))
    empty = rows.where("text is null").select("id", F.lit("error").alias("severity"), F.lit("missing text").alias("issue"))
    flat = rows.where("text is not null").select("id", "text", F.explode("gold_spans").alias("g"))
    out = flat.where(~F.coalesce(S.in_bounds(F.col("g.start"), F.col("g.end"), F.col("text")), F.lit(False))).select("id", F.lit("error").alias("severity"), F.lit("offsets out of the text").alias("issue"))
    label = flat.where(~F.coalesce(F.col("g.label").isin(X.ALL_LABELS), F.lit(False))).select("id", F.lit("warning").alias("severity"), F.lit("label outside the taxonomy").alias("issue"))
    # overlaps inside one record, on the record's own array
    sorted_spans = F.array_sort(F.transform("gold_spans", lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"))))
    pairs = rows.select("id", sorted_spans.alias("s")).select("id", "s", F.size(F.filter("s", lambda x, i: (i > 0) & (x["start"] < F.get(F.col("s"), i - 1)["end"]))).alias("k"))
    overlap = pairs.where("k > 0").select("id", F.lit("warning").alias("severity"), F.lit("overlapping gold").alias("issue"))
    once = F.array_distinct(F.transform("gold_spans", lambda g: F.struct(g["label"], g["start"], g["end"])))
    again = rows.where(F.size("gold_spans") > F.size(once)).select("id", F.lit("warning").alias("severity"), F.lit("repeated span").alias("issue"))
    overlap = overlap.unionByName(again)
    if {"doc_id", "offset"} <= set(fixtures.columns):
        loose = fixtures.where("doc_id is not null and coalesce(offset, -1) < 0")
        overlap = overlap.unionByName(loose.select("id", F.lit("error").alias("severity"), F.lit("chunk without an offset").alias("issue")))
    if unlabeled:
        overlap = overlap.unionByName(rows.where(F.size("gold_spans") > 0).select("id", F.lit("warning").alias("severity"), F.lit("gold in unlabeled records").alias("issue")))
    every = none.unionByName(twice).unionByName(empty).unionByName(out).unionByName(label).unionByName(overlap)
    return every.groupBy("id", "severity", "issue").agg(F.count(F.lit(1)).alias("n"))


def validate_jsonl(lines: DataFrame) -> DataFrame:
    """``line, issue`` of JSON lines (``line, value``) that are no record: ``bad JSON``, ``no object``, ``text is no string``, ``id is no string``. Blank lines are no issue."""
    v = lines.where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    whole = F.schema_of_variant("v")
    issue = (
        F.when(F.col("v").isNull(), "bad JSON").when(~whole.startswith("OBJECT"), "no object").when(~kind("$.text").eqNullSafe(F.lit("STRING")), "text is no string")
        .when(~kind("$.id").eqNullSafe(F.lit("STRING")), "id is no string"))
    return v.select("line", issue.alias("issue")).where("issue is not null")


def sample(records: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """The first n records in the order of a seeded hash: samples of one seed nest as prefixes. Top-n, not a full sort."""
    return records.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))), key).limit(n)


def holdout_split(ids: DataFrame, fraction: float, seed: int = 42, key: str = "id") -> DataFrame:
    """Adds ``holdout``: true for the share of ids whose seeded hash is below the fraction. No sort, no shuffle, stable under growth."""
    top = 0xFFFFFFFF
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))), 1, 8), 16, 10).cast("bigint")
    return ids.withColumn("holdout", h < F.lit(int(fraction * top)))


def baseline(fixtures: DataFrame) -> DataFrame:
    """``id, text_sha1`` of every record; texts are hashed before the shuffle."""
    return fixtures.select("id", F.sha1("text").alias("text_sha1")).distinct()


def baseline_covers(base: DataFrame, fixtures: DataFrame) -> DataFrame:
    """One row: how many records a baseline covers with the same text, with another text, or not at all."""
    now = baseline(fixtures).withColumnRenamed("text_sha1", "now")
    j = now.join(base, "id", "left")
    same = F.col("text_sha1").eqNullSafe(F.col("now"))
    known = F.col("text_sha1").isNotNull()
    return j.agg(
        F.count_if(known & same).alias("covered"), F.count_if(known & ~same).alias("changed"), F.count_if(~known).alias("missing"))
