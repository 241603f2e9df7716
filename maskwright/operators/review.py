"""Estimates without gold: reviews of pooled spans by a judge, and of spans and residual text by a classifier.

Judges are plug-ins; the deterministic stubs here answer from a gold table, which makes every summary checkable.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.operators.records import distinct_records

VERDICTS = ("correct", "wrong_label", "boundary", "not_pii")


def judge_from_gold(pooled: DataFrame, gold: DataFrame) -> DataFrame:
    """Review rows of kind ``span``: the pool with a verdict each (same rule as a careful reader with the gold at hand)."""
    g = gold.select("id", F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("label").alias("gl"))
    p = pooled.select("id", "start", "end", "label", "detectors")
    near = p.join(g, "id").where(S.overlaps(F.col("start"), F.col("end"), F.col("gs"), F.col("ge")))
    bounds = (F.col("start") == F.col("gs")) & (F.col("end") == F.col("ge"))
    rank = F.when(bounds & (F.col("label") == F.col("gl")), 0).when(bounds, 1).when(F.col("label") == F.col("gl"), 2).otherwise(3)
    best = near.groupBy("id", "start", "end", "label").agg(F.min(rank).alias("r"))
    j = p.join(best, ["id", "start", "end", "label"], "left")
    verdict = F.when(F.col("r") == 0, "correct").when(F.col("r").isin(1, 3), "wrong_label").when(F.col("r") == 2, "boundary").otherwise("not_pii")
    return j.select("id", "start", "end", "label", "detectors", verdict.alias("verdict"))


def missed_from_gold(pooled: DataFrame, gold: DataFrame) -> DataFrame:
    """Review rows of kind ``missed``: gold spans that no pooled span overlaps."""
    p = pooled.select(F.col("id").alias("pid"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    return gold.join(p, (F.col("id") == F.col("pid")) & S.overlaps(F.col("start"), F.col("end"), F.col("ps"), F.col("pe")), "left_anti")


def verdict_counts(reviewed: DataFrame) -> DataFrame:
    return reviewed.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def group_entities(spans: list[tuple[int, int, str]]) -> list[int]:
    """Entity number of each accepted span (start, end, verdict) of one record.

    Chains of overlapping ``correct`` spans are the entities. Any other span joins the one entity whose extent it overlaps most
    (the first of equals), so an over-long span never merges two; one that overlaps none founds an entity for those after it.
    Extents are disjoint at any time, so those that a span meets are neighbours in a sorted list.
    """
    sure = sorted((a, b, i) for i, (a, b, v) in enumerate(spans) if v == "correct")
    tops = list(accumulate((b for _, b, _ in sure), max))
    number = dict.fromkeys(range(len(spans)), -1)
    extents: list[tuple[int, int, int]] = []  # start, end, entity
    for k, (a, _, i) in enumerate(sure):
        if k == 0 or a >= tops[k - 1]:
            extents.append((a, tops[k], len(extents)))
        number[i] = len(extents) - 1
        extents[-1] = (extents[-1][0], tops[k], number[i])
    for a, b, i in sorted((a, b, i) for i, (a, b, v) in enumerate(spans) if v != "correct"):
        lo = bisect_right(extents, a, key=lambda x: x[1])
        met = extents[lo : bisect_left(extents, b, key=lambda x: x[0])]
        if met:
            number[i] = min((max(a, x) - min(b, y), n) for x, y, n in met)[1]
        else:
            number[i] = len(extents)
            extents.insert(lo, (a, b, number[i]))
    return [number[i] for i in range(len(spans))]


def entities(reviewed: DataFrame) -> DataFrame:
    """``id, entity, verdict, detectors`` of all spans that are personal data. Sequential inside a record, so it runs on the record's own list."""
    kept = reviewed.where("verdict <> 'not_pii'").groupBy("id").agg(F.collect_list(F.struct("start", "end", "verdict", "detectors")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers = group_entities([(s["start"], s["end"], s["verdict"]) for s in spans])
                rows += [(key, n, s["verdict"], s["detectors"]) for n, s in zip(numbers, spans)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "entity", "verdict", "detectors"])

    return kept.mapInArrow(run, "id string, entity int, verdict string, detectors array<string>")


def summarize(reviewed: DataFrame, missed: DataFrame, calls: DataFrame, lenient: bool = False) -> DataFrame:
    """Per detector over the records it answered: judged spans and verdicts, precision, pooled entity recall, F1, spans missed by all.

    A detector finds an entity if one of its spans there was judged correct (``lenient``: or boundary). Undefined ratios are null.
    ``calls`` holds the (id, detector) pairs without an error; records the reviewer failed on must be left out of all three tables.
    """
    hits = ["correct", "boundary"] if lenient else ["correct"]
    flat = reviewed.withColumn("detector", F.explode("detectors"))
    judged = flat.groupBy("detector").agg(F.count(F.lit(1)).alias("n_spans"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    # per record: how many entities it has and which detectors found how many of them
    ent = entities(reviewed)
    finders = F.when(F.col("verdict").isin(hits), F.col("detectors")).otherwise(F.array().cast("array<string>"))
    per_entity = ent.groupBy("id", "entity").agg(F.array_distinct(F.flatten(F.collect_list(finders))).alias("by"))
    per_record = per_entity.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.flatten(F.collect_list("by")).alias("by"))
    lost = missed.groupBy("id").agg(F.count(F.lit(1)).alias("lost"))
    known = calls.join(per_record, "id", "left").join(lost, "id", "left")
    found = F.size(F.filter(F.coalesce("by", F.array().cast("array<string>")), lambda x: x == F.col("detector")))
    totals = known.groupBy("detector").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(F.coalesce("k", F.lit(0))).alias("n_entities"), F.sum(found).alias("n_found"), F.sum(F.coalesce("lost", F.lit(0))).alias("missed_by_all"))
    rows = totals.join(judged, "detector", "left").fillna(0, ["n_spans", *VERDICTS])
    good = F.col("correct") + (F.col("boundary") if lenient else F.lit(0))
    p, r = S.ratio(good, F.col("n_spans")), S.ratio(F.col("n_found"), F.col("n_entities") + F.col("missed_by_all"))
    return rows.select("detector", "n_records", "n_spans", *VERDICTS, "n_entities", "missed_by_all", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def disagreements(reviewed: DataFrame, missed: DataFrame, records: DataFrame, limit: int | None = None, width: int = 30) -> DataFrame:
    """Everything a reader should look at: spans not judged correct, then misses, with context; ``limit`` is for display."""
    spans = reviewed.where("verdict <> 'correct'").select("id", "start", "end", "label", "verdict", F.lit(0).alias("part"))
    rows = spans.unionByName(missed.select("id", "start", "end", "label", F.lit("missed").alias("verdict"), F.lit(1).alias("part")))
    out = rows.join(records.select("id", "text"), "id").select("id", "start", "end", "label", "verdict", "part", S.context(F.col("text"), F.col("start"), F.col("end"), width).alias("context"))
    return out.orderBy("part", "id", "start", "end").limit(limit) if limit else out


def classifier_rows(pooled: DataFrame, gold: DataFrame) -> DataFrame:
    """Span pass of a stub classifier: ``id, start, end, label, detectors, p_pii, p_label_ok``, from the best overlap with gold.

    p_pii is the best IoU with any gold span, p_label_ok the best IoU with one of the same label.
    """
    g = gold.select("id", F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("label").alias("gl"))
    p = pooled.select("id", "start", "end", "label", "detectors")
    near = p.join(g, "id").where(S.overlaps(F.col("start"), F.col("end"), F.col("gs"), F.col("ge")))
    x = S.iou(F.col("start"), F.col("end"), F.col("gs"), F.col("ge"))
    best = near.groupBy("id", "start", "end", "label").agg(F.max(x).alias("a"), F.max(F.when(F.col("label") == F.col("gl"), x)).alias("b"))
    j = p.join(best, ["id", "start", "end", "label"], "left")
    return j.select("id", "start", "end", "label", "detectors", F.round(F.coalesce("a", F.lit(0.0)), 4).alias("p_pii"), F.round(F.coalesce("b", F.lit(0.0)), 4).alias("p_label_ok"))


def classifier_summary(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per detector at a threshold: precision (PII with the right label), precision with any label, mean p_pii."""
    flat = rows.withColumn("detector", F.explode("detectors"))
    hit = (F.col("p_pii") >= threshold) & (F.col("p_label_ok") >= threshold)
    return flat.groupBy("detector").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 9).alias("precision"), F.round(F.avg((F.col("p_pii") >= threshold).cast("double")), 9).alias("any_label"),
        F.round(F.avg("p_pii"), 9).alias("mean_p_pii"))


def threshold_sweep(rows: DataFrame, gold: DataFrame, thresholds: list[float]) -> DataFrame:
    """Estimated against true precision per detector and threshold. Each row is exploded over the thresholds it is given (a parameter), not joined."""
    g = gold.select("id", "start", "end", "label", F.lit(True).alias("true"))
    flat = rows.join(g, ["id", "start", "end", "label"], "left").withColumn("detector", F.explode("detectors"))
    per = flat.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = (F.col("p_pii") >= F.col("threshold")) & (F.col("p_label_ok") >= F.col("threshold"))
    out = per.groupBy("detector", "threshold").agg(F.round(F.avg(hit.cast("double")), 9).alias("estimate"), F.round(F.avg(F.coalesce("true", F.lit(False)).cast("double")), 9).alias("truth"))
    return out.withColumn("error", F.round(F.col("estimate") - F.col("truth"), 9))


def residual_rate(records: DataFrame, pred: DataFrame, gold: DataFrame, calls: DataFrame) -> DataFrame:
    """Per detector: share of answered records that still hold a gold span none of its own spans overlaps."""
    p = pred.select(F.col("id").alias("pid"), F.col("detector").alias("pd"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    asked = calls.join(gold, "id")
    left = asked.join(p, (F.col("id") == F.col("pid")) & (F.col("detector") == F.col("pd")) & S.overlaps(F.col("start"), F.col("end"), F.col("ps"), F.col("pe")), "left_anti")
    bad = left.select("id", "detector").distinct().groupBy("detector").agg(F.count(F.lit(1)).alias("residual"))
    n = calls.join(records.select("id").distinct(), "id", "left_semi").groupBy("detector").agg(F.count(F.lit(1)).alias("n"))
    return n.join(bad, "detector", "left").select("detector", "n", F.coalesce("residual", F.lit(0)).alias("residual"), F.round(S.ratio(F.coalesce(F.col("residual"), F.lit(0)), F.col("n")), 9).alias("rate"))


def plan_calls(records: DataFrame, max_chars: int = 4000) -> DataFrame:
    """One row: records, characters and model calls that a review in pieces of ``max_chars`` needs."""
    n = F.col("n_chars")
    return distinct_records(records).where("has_text").agg(
        F.count(F.lit(1)).alias("records"), F.sum(n.cast("bigint")).alias("chars"), F.sum(F.ceil(n / max_chars)).cast("bigint").alias("calls"))


def answer_misses(located: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``id, start, end, label, kind, reason`` of the reviewer's own findings (``id, label, start, end, reason`` as located in the text).

    A finding without a place keeps its reason. One that an accepted candidate stands for is dropped as ``covered_by_candidate``: the candidate holds all of it, or
    was judged right in its bounds and overlaps it, or is a ``boundary`` candidate that overlaps it and no candidate with right bounds (an over-long span
    of another entity covers nothing else). One whose exact stretch was judged no personal data is dropped as ``judged_not_pii``; of equal findings one counts.
    All others are misses. Candidates without a verdict cover nothing.
    """
    c = reviewed.select(F.col("id").alias("cid"), F.col("start").alias("cs"), F.col("end").alias("ce"), "verdict").distinct()
    right = c.where(F.col("verdict").isin("correct", "wrong_label")).select(F.col("cid").alias("rid"), F.col("cs").alias("rs"), F.col("ce").alias("re"))
    wide = c.where("verdict = 'boundary'").join(right, (F.col("cid") == F.col("rid")) & S.overlaps(F.col("cs"), F.col("ce"), F.col("rs"), F.col("re")), "left_semi").select("cid", "cs", "ce", F.lit(True).alias("wide"))
    c = c.join(wide.distinct(), ["cid", "cs", "ce"], "left")
    once = located.select("id", "start", "end", "label", "reason").distinct()
    met = once.where("reason is null").join(c, (F.col("id") == F.col("cid")) & S.overlaps(F.col("cs"), F.col("ce"), F.col("start"), F.col("end")))
    accepted = F.col("verdict").isin("correct", "wrong_label", "boundary")
    holds = (F.col("cs") <= F.col("start")) & (F.col("end") <= F.col("ce"))
    stands = accepted & (holds | (F.col("verdict") != "boundary") | F.col("wide").isNull())
    refused = (F.col("verdict") == "not_pii") & (F.col("cs") == F.col("start")) & (F.col("ce") == F.col("end"))
    flags = met.groupBy("id", "start", "end", "label").agg(F.bool_or(stands).alias("covered"), F.bool_or(refused).alias("refused"))
    j = once.join(flags, ["id", "start", "end", "label"], "left")
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("covered"), "covered_by_candidate").when(F.col("refused"), "judged_not_pii")
    return j.select("id", "start", "end", "label", F.when(reason.isNull(), "missed").otherwise("dropped").alias("kind"), reason.alias("reason"))


def without_failed(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of the records the reviewer did not fail on."""
    return rows.join(failed.select("id").distinct(), "id", "left_anti")
