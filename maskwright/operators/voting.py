"""Pooling, merging, agreement and ensembles of several detectors' spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.functions import spans as S
from maskwright.functions import taxonomy as X


def pool(pred: DataFrame) -> DataFrame:
    """Identical spans once, with who found them: ``id, start, end, label, detectors, n``. ``pred`` holds one row per span and detector."""
    return pred.groupBy("id", "start", "end", "label").agg(F.array_sort(F.collect_set("detector")).alias("detectors"), F.count_distinct("detector").alias("n"))


def pool_fine(latest: DataFrame) -> DataFrame:
    """The pool with the fine label of most votes (ties: the smaller detector that says it)."""
    flat = latest.where("error is null").select("id", "detector", F.explode("spans").alias("p")).select(
        "id", "detector", "p.start", "p.end", "p.label", F.col("p.fine_label").alias("fine")).distinct()
    votes = flat.where("fine is not null").groupBy("id", "start", "end", "label", "fine").agg(F.count_distinct("detector").alias("v"), F.min("detector").alias("d"))
    best = votes.groupBy("id", "start", "end", "label").agg(F.min_by("fine", F.struct(-F.col("v"), "d", "fine")).alias("fine_label"))
    return pool(flat.select("id", "detector", "start", "end", "label").distinct()).join(best, ["id", "start", "end", "label"], "left")


def agreement(latest: DataFrame, calls: DataFrame) -> DataFrame:
    """Pairs of detectors (a < b) on records both answered: exact matches as multisets, and precision, recall, F1 with ``a`` as the reference.

    Counted by grouping: each distinct span contributes the pairs of its detectors (at most detectors squared, a dimension),
    so no record's spans are compared with each other. 1.0 if both are empty.
    """
    flat = latest.where("error is null").select("id", "detector", F.explode("spans").alias("s")).select("id", "detector", "s.start", "s.end", "s.label")
    flat = flat.join(calls.select("id").distinct(), "id", "left_semi")
    own = flat.groupBy("id", "start", "end", "label", "detector").agg(F.count(F.lit(1)).alias("n"))
    lists = own.groupBy("id", "start", "end", "label").agg(F.array_sort(F.collect_list(F.struct("detector", "n"))).alias("d"))
    pairs = F.flatten(F.transform("d", lambda a: F.transform(F.filter("d", lambda b: b["detector"] > a["detector"]), lambda b: F.struct(
        a["detector"].alias("a"), b["detector"].alias("b"), F.least(a["n"], b["n"]).alias("n")))))
    same = lists.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.n").alias("same"))
    # spans of each detector on the records the other one answered too
    per = calls.join(own.groupBy("id", "detector").agg(F.sum("n").alias("k")), ["id", "detector"], "left").select("id", F.struct("detector", F.coalesce("k", F.lit(0)).alias("k")).alias("c"))
    rec = per.groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    two = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b["detector"] > a["detector"]), lambda b: F.struct(
        a["detector"].alias("a"), b["detector"].alias("b"), a["k"].alias("na"), b["k"].alias("nb")))))
    sizes = rec.select(F.explode(two).alias("x")).groupBy("x.a", "x.b").agg(F.count(F.lit(1)).alias("records"), F.sum("x.na").alias("n_a"), F.sum("x.nb").alias("n_b"))
    out = sizes.join(same, ["a", "b"], "left").withColumn("same", F.coalesce("same", F.lit(0)))
    empty = (F.col("n_a") == 0) & (F.col("n_b") == 0)
    share = lambda a, b: F.when(empty, 1.0).otherwise(F.coalesce(S.ratio(a, b), F.lit(0.0)))
    same_col, n_a, n_b = F.col("same"), F.col("n_a"), F.col("n_b")
    return out.select(
        "a", "b", "records", "n_a", "n_b", "same", share(same_col, n_b).alias("precision"), share(same_col, n_a).alias("recall"), share(2 * same_col, n_a + n_b).alias("f1"))


def pool_records(inside: DataFrame, records: DataFrame) -> DataFrame:
    """``id, spans``: the pool of every record as one sorted array, empty where no detector found anything."""
    one = F.struct("start", "end", "label", "detectors")
    lists = pool(inside).groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int,label:string,detectors:array<string>>>")
    return records.select("id").distinct().join(lists, "id", "left").select("id", F.coalesce("spans", none).alias("spans"))


def merge_fine(latest: DataFrame, merged: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``fine_label`` to merged spans: every detector that agrees gives the fine label of its best agreeing span, the most common one counts (ties: the
    smaller detector's)."""
    flat = latest.where("error is null").select("id", "detector", F.explode("spans").alias("p")).select(
        "id", "detector", F.col("p.label").alias("label"), F.col("p.start").alias("bs"), F.col("p.end").alias("be"), F.coalesce("p.fine_label", "p.label").alias("fine")).distinct()
    met = merged.select("id", "label", "start", "end").join(flat, ["id", "label"]).withColumn("iou", S.iou(F.col("start"), F.col("end"), F.col("bs"), F.col("be"))).where(F.col("iou") >= threshold)
    own = met.groupBy("id", "label", "start", "end", "detector").agg(F.min_by("fine", F.struct(-F.col("iou"), "bs", "be", "fine")).alias("fine"))
    votes = own.groupBy("id", "label", "start", "end", "fine").agg(F.count(F.lit(1)).alias("v"), F.min("detector").alias("d"))
    best = votes.groupBy("id", "label", "start", "end").agg(F.min_by("fine", F.struct(-F.col("v"), "d", "fine")).alias("fine_label"))
    return merged.join(best, ["id", "label", "start", "end"], "left")


def merge_votes(pred: DataFrame, calls: DataFrame, how: str = "majority", threshold: float = 0.5) -> DataFrame:
    """Votes for every pooled span: detectors with a span of the same label and IoU >= ``threshold``; kept by union, majority or intersection.

    Joined on (id, label), positions as residual. Majority and intersection count the detectors that answered for the record.
    """
    if how not in ("union", "majority", "intersection"):
        raise ValueError(f"unknown rule {how!r}")
    a = pool(pred).select("id", "label", F.col("start").alias("s"), F.col("end").alias("e"), F.col("n").alias("exact"))
    b = pred.select("id", "label", "detector", F.col("start").alias("bs"), F.col("end").alias("be"))
    near = a.join(b, ["id", "label"]).where(S.iou(F.col("s"), F.col("e"), F.col("bs"), F.col("be")) >= threshold)
    votes = near.groupBy("id", "label", "s", "e", "exact").agg(F.count_distinct("detector").alias("votes"))
    asked = calls.groupBy("id").agg(F.count_distinct("detector").alias("asked"))
    need = {"union": F.lit(1), "majority": F.floor(F.col("asked") / 2) + 1, "intersection": F.col("asked")}[how]
    return votes.join(asked, "id").where(F.col("votes") >= need).select("id", F.col("s").alias("start"), F.col("e").alias("end"), "label", "votes", "exact")


def resolve_overlaps(merged: DataFrame) -> DataFrame:
    """Greedy non-overlap per record: more votes first, then more exact finders, longer, earlier, label. A fold per record."""
    ranked = merged.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("votes")).alias("v"), (-F.col("exact")).alias("x"), (F.col("start") - F.col("end")).alias("l"), "start", "end", "label"))).alias("c"))
    kept = F.aggregate(
        "c", F.filter("c", lambda s: F.lit(False)),
        lambda acc, s: F.when(F.exists(acc, lambda k: S.overlaps(k["start"], k["end"], s["start"], s["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    return ranked.select("id", F.explode(kept).alias("k")).select("id", "k.start", "k.end", "k.label", (-F.col("k.v")).alias("votes"))


def recipe(scores_by_label: DataFrame) -> DataFrame:
    """Best detector per label by type F1 (ties: the larger name; F1 of 0 is dropped): ``label, detector, f1``."""
    rows = scores_by_label.where((F.col("schema") == "ent_type") & (F.col("f1") > 0) & ~F.col("detector").startswith("ensemble_"))
    best = rows.groupBy(F.col("tag").alias("label")).agg(F.max(F.struct("f1", "detector")).alias("b"))
    return best.select("label", "b.detector", "b.f1")


def top_candidates(scores_by_label: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` detectors per label; labels x detectors are a dimension."""
    w = Window.partitionBy("tag").orderBy(F.desc("f1"), F.desc("detector"))
    rows = scores_by_label.where(F.col("schema") == "ent_type").withColumn("place", F.row_number().over(w))
    return rows.where(F.col("place") <= top).select(F.col("tag").alias("label"), "place", "detector", "f1")


def apply_recipe(pred: DataFrame, recipe_rows: DataFrame) -> DataFrame:
    """Composite detector: each label from its chosen detector, overlaps removed in the order (start, longest)."""
    chosen = pred.join(recipe_rows.select("label", "detector"), ["label", "detector"])
    order = F.struct("start", (-F.col("end")).alias("neg"), "end", "label")
    lists = chosen.groupBy("id").agg(F.array_sort(F.collect_list(order)).alias("c"))
    kept = S.keep_left_to_right(F.col("c"))
    return lists.select("id", F.explode(kept).alias("k")).select("id", "k.start", "k.end", "k.label")


def ensemble_calls(latest: DataFrame, spans: DataFrame, recipe_rows: DataFrame, ids: DataFrame, name: str = "ensemble_category_best") -> DataFrame:
    """``id, detector, spans, latency_ms, error`` of the composite: its spans, the chosen calls' latencies added up per label (none counts as 0) and
    their errors joined; every record has a row."""
    part = latest.join(F.broadcast(recipe_rows.select("label", "detector")), "detector")  # at most one row per label
    ms = F.when(F.col("latency_ms").isNull() | F.isnan("latency_ms"), 0.0).otherwise(F.col("latency_ms"))
    said = F.when(F.col("error").isNotNull(), F.struct("label", F.concat("detector", F.lit(":"), "label", F.lit(": "), "error").alias("e")))
    calls = part.groupBy("id").agg(F.sum(ms).alias("latency_ms"), F.array_sort(F.collect_list(said)).alias("said"))
    lists = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    rows = ids.select("id").distinct().join(calls, "id", "left").join(lists, "id", "left")
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    return rows.select(
        "id", F.lit(name).alias("detector"), F.coalesce("spans", none).alias("spans"), F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
        F.when(F.size("said") > 0, F.array_join(F.transform("said", lambda x: x["e"]), "; ")).alias("error"))


def hit_rate(pred_raw: DataFrame, gold: DataFrame, threshold: float = 0.5, least: int = 5) -> DataFrame:
    """Share of spans per raw label that meet a gold span of their label with IoU >= threshold; DROP below 50 %, WEAK below 70 %, else KEEP."""
    g = gold.select("id", "label", F.col("start").alias("gs"), F.col("end").alias("ge"))
    p = pred_raw.select("id", "detector", "raw_label", "label", "start", "end").distinct()
    hit = p.join(g.withColumnsRenamed({"id": "gid", "label": "gl"}), (F.col("id") == F.col("gid")) & (F.col("label") == F.col("gl")) & (S.iou(F.col("start"), F.col("end"), F.col("gs"), F.col("ge")) >= threshold), "left_semi")
    n = p.groupBy("detector", "raw_label").agg(F.count(F.lit(1)).alias("n"))
    h = hit.groupBy("detector", "raw_label").agg(F.count(F.lit(1)).alias("hits"))
    rows = n.where(F.col("n") >= least).join(h, ["detector", "raw_label"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    pct = 100.0 * F.col("hits") / F.col("n")
    return rows.select("detector", "raw_label", "n", "hits", F.round(pct, 6).alias("pct"), F.when(pct < 50, "DROP").when(pct < 70, "WEAK").otherwise("KEEP").alias("verdict"))


def redundancy(pred_fine: DataFrame, gold_fine: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per detector and fine label: how many of its spans a span of the coarse parent covers (IoU above the threshold) and how many meet gold of that
    parent. DROP if more than 70 % are covered and fewer than 30 % meet gold, else KEEP."""
    up = X.parent_col(F.col("label"))
    fine = pred_fine.withColumn("general", up).where(F.col("general") != F.col("label")).select("id", "detector", "general", F.col("label").alias("granular"), "start", "end")
    near = lambda a, b: S.iou(F.col("start"), F.col("end"), F.col(a), F.col(b)) > threshold
    whole = pred_fine.where(up == F.col("label")).select(F.col("id").alias("wid"), F.col("detector").alias("wd"), F.col("label").alias("wl"), F.col("start").alias("ws"), F.col("end").alias("we"))
    gold = gold_fine.select(F.col("id").alias("gid"), up.alias("gl"), F.col("start").alias("gs"), F.col("end").alias("ge"))
    covered = fine.join(whole, (F.col("id") == F.col("wid")) & (F.col("detector") == F.col("wd")) & (F.col("general") == F.col("wl")) & near("ws", "we"), "left_semi")
    met = fine.join(gold, (F.col("id") == F.col("gid")) & (F.col("general") == F.col("gl")) & near("gs", "ge"), "left_semi")
    by = ["detector", "general", "granular"]
    count = lambda rows, name: rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    rows = count(fine, "n").join(count(covered, "redundant"), by, "left").join(count(met, "matches"), by, "left").fillna(0, ["redundant", "matches"])
    pct = 100.0 * F.col("redundant") / F.col("n")
    drop = (pct > 70) & (F.col("matches") < 0.3 * F.col("n"))
    return rows.select(*by, "n", "redundant", "matches", F.round(pct, 6).alias("pct"), F.when(drop, "DROP").otherwise("KEEP").alias("verdict"))
