"""SemEval-style scoring of predicted spans against gold spans, for all detectors, views and languages in one job.

Per prediction (not one to one): the overlapping gold span with the same bounds and label, else with the same bounds, else the first by
(start, end) is its partner. A gold span is missed only if no prediction of any label overlaps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions import taxonomy as X
from maskwright.operators.records import distinct_records, gold_long

SCHEMAS = ("strict", "exact", "partial", "ent_type")


def answered(records: DataFrame, latest: DataFrame, level: str = "coarse") -> DataFrame:
    """``id, detector, p, g``: each successful call on a known record with its predicted and gold spans as sorted arrays.

    Spans stay nested as they are stored: matching is then an expression on one row, without a join of spans. Repeats count once.
    """
    name = (lambda s: s["label"]) if X.check_level(level) == "coarse" else (lambda s: F.coalesce(s["fine_label"], s["label"]))
    plain = lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), name(s).alias("label"))
    valid = F.filter("gold_spans", lambda s: S.within(s["start"], s["end"], F.col("n_chars")) & s["label"].isin(X.COARSE))
    gold = distinct_records(records).select("id", F.coalesce(F.transform(valid, plain), F.array().cast(_PLAIN)).alias("g")).groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("g")))).alias("g"))
    own = F.array_sort(F.array_distinct(F.coalesce(F.transform("spans", plain), F.array().cast(_PLAIN))))
    return latest.where("error is null").select("id", "detector", own.alias("p")).join(gold, "id")


_PLAIN = "array<struct<start:int,end:int,label:string>>"


MAX_NAMES = 10_000


def names_of(df: DataFrame, column: str) -> list[str]:
    """The values of a dimension (labels, detectors), sorted; more than ``MAX_NAMES`` raise."""
    found = df.where(F.col(column).isNotNull()).select(column).distinct().limit(MAX_NAMES + 1).collect()
    if len(found) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} values of {column}")
    return sorted(r[0] for r in found)


def annotated_labels(records: DataFrame, level: str = "coarse") -> list[str]:
    """Labels of the taxonomy that the gold side uses."""
    return [x for x in names_of(gold_long(records, level), "label") if X.is_known(x)]


def scopes(records: DataFrame, predictions: DataFrame, level: str = "coarse", labels: list[str] | None = None) -> DataFrame:
    """``view, detector, project``: source label to scored label. raw = all labels of the gold side, fair = those the detector's vocabulary supports,
    whether it emitted them or not; ``labels`` overrides both. A dimension of two rows per detector, made from the distinct labels and detectors."""
    spark = records.sparkSession
    table = X.scope_table(spark, names_of(predictions, "detector"), annotated_labels(records, level), level, labels)
    return table.groupBy("view", "detector").agg(F.map_from_entries(F.collect_list(F.struct("src_label", "label"))).alias("project"))


def judged(p: Column, g: Column) -> Column:
    """array<struct<tag, kind>> of one record: kind in exact, bounds, type, overlap, spurious, missed."""
    over = lambda x, y: S.overlaps(x["start"], x["end"], y["start"], y["end"])

    def partner(x: Column) -> Column:
        bounds = lambda y: (x["start"] == y["start"]) & (x["end"] == y["end"])
        ranked = F.transform(F.filter(g, lambda y: over(x, y)), lambda y: F.struct(
            F.when(bounds(y) & (x["label"] == y["label"]), 0).when(bounds(y), 1).otherwise(2).alias("r"), y["start"].alias("s"), y["end"].alias("e"), y["label"].alias("l")))
        return F.array_min(ranked)

    def verdict(m: Column) -> Column:
        best = m["best"]
        kind = F.when(best["r"] == 0, "exact").when(best["r"] == 1, "bounds").when(best["l"] == m["label"], "type").when(best.isNotNull(), "overlap").otherwise("spurious")
        return F.struct(F.coalesce(best["l"], m["label"]).alias("tag"), kind.alias("kind"))

    matched = F.transform(F.transform(p, lambda x: F.struct(partner(x).alias("best"), x["label"].alias("label"))), verdict)
    missed = F.transform(F.filter(g, lambda y: ~F.exists(p, lambda x: over(x, y))), lambda y: F.struct(y["label"].alias("tag"), F.lit("missed").alias("kind")))
    return F.concat(matched, missed)


def outcomes(calls: DataFrame, scope: DataFrame) -> DataFrame:
    """One row per judged span: ``view, detector, id, tag, kind``. Spans are projected into their detector's scope on the row they lie in."""
    scoped = calls.join(F.broadcast(scope), "detector")  # two rows per detector

    def inside(c: str) -> Column:
        moved = F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.try_element_at(F.col("project"), s["label"]).alias("label")))
        return F.array_distinct(F.filter(moved, lambda s: s["label"].isNotNull()))

    own = scoped.select("view", "detector", "id", inside("p").alias("p"), inside("g").alias("g"))
    return own.select("view", "detector", "id", F.explode(judged(F.col("p"), F.col("g"))).alias("o")).select("view", "detector", "id", "o.tag", "o.kind")


def _counts() -> list[Column]:
    return [F.count_if(F.col("kind") == k).alias(k) for k in ("exact", "bounds", "type", "overlap", "spurious", "missed")]


def score(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts and P/R/F1 of all four schemas per group: ``by..., schema, cor, inc, par, mis, spu, possible, actual, precision, recall, f1``."""
    c = rows.groupBy(*by).agg(*_counts())
    col = F.col
    table = {
        "strict": (col("exact"), col("bounds") + col("type") + col("overlap"), F.lit(0)),
        "exact": (col("exact") + col("bounds"), col("type") + col("overlap"), F.lit(0)),
        "partial": (col("exact") + col("bounds"), F.lit(0), col("type") + col("overlap")),
        "ent_type": (col("exact") + col("type"), col("bounds") + col("overlap"), F.lit(0)),
    }
    cells = F.array(*[F.struct(
        F.lit(name).alias("schema"), a.cast("bigint").alias("cor"), b.cast("bigint").alias("inc"), h.cast("bigint").alias("par")) for name, (a, b, h) in table.items()])
    long = c.select(*by, col("missed").alias("mis"), col("spurious").alias("spu"), F.explode(cells).alias("s")).select(*by, "s.*", "mis", "spu")
    long = long.withColumns({"possible": col("cor") + col("inc") + col("par") + col("mis"), "actual": col("cor") + col("inc") + col("par") + col("spu")})
    credit = col("cor") + F.when(col("schema").isin("partial", "ent_type"), 0.5 * col("par")).otherwise(0.0)
    long = long.withColumns({"precision": F.coalesce(S.ratio(credit, col("actual")), F.lit(0.0)), "recall": F.coalesce(S.ratio(credit, col("possible")), F.lit(0.0))})
    return long.withColumn("f1", S.f1_of(col("precision"), col("recall")))


def headline(scores: DataFrame) -> DataFrame:
    """F1 of the four schemas and strict P/R, one row per view and detector."""
    pick = lambda schema, c: F.max(F.when(F.col("schema") == schema, F.col(c)))
    return scores.groupBy("view", "detector").agg(
        *[pick(s, "f1").alias(f"f1_{s}") for s in SCHEMAS], pick("strict", "precision").alias("precision"), pick("strict", "recall").alias("recall"))


def errors(calls: DataFrame, records: DataFrame, kind: str, width: int = 30, labels: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Error rows of one kind: missed, spurious, mislabeled (same bounds, other label), boundary (overlap, same label, other bounds), of the given gold or
    predicted labels; ``limit`` is for display and takes the first by record and place."""
    p, g = F.col("p"), F.col("g")
    over = lambda x, y: S.overlaps(x["start"], x["end"], y["start"], y["end"])
    row = lambda x, gold, own: F.struct(x["start"].alias("start"), x["end"].alias("end"), gold.alias("gold_label"), own.alias("label"))
    none = F.lit(None).cast("string")
    if kind == "missed":
        found = F.transform(F.filter(g, lambda y: ~F.exists(p, lambda x: over(x, y))), lambda y: row(y, y["label"], none))
    elif kind == "spurious":
        found = F.transform(F.filter(p, lambda x: ~F.exists(g, lambda y: over(x, y))), lambda x: row(x, none, x["label"]))
    elif kind in ("mislabeled", "boundary"):
        def test(x: Column, y: Column) -> Column:
            bounds = (x["start"] == y["start"]) & (x["end"] == y["end"])
            return over(x, y) & (bounds & (x["label"] != y["label"]) if kind == "mislabeled" else ~bounds & (x["label"] == y["label"]))

        found = F.array_distinct(F.flatten(F.transform(p, lambda x: F.transform(F.filter(g, lambda y: test(x, y)), lambda y: row(x, y["label"], x["label"])))))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    # the texts join before the rows multiply: one row per call, not per error
    rows = calls.withColumn("found", found).where(F.size("found") > 0).select("id", "detector", "found").join(records.select("id", "text"), "id")
    flat = rows.select("id", "detector", "text", F.explode("found").alias("e")).select("id", "detector", "text", "e.*")
    if labels is not None:
        flat = flat.where(F.coalesce("gold_label", "label").isin(labels))
    out = flat.select("id", "detector", "start", "end", "gold_label", "label", S.context(F.col("text"), F.col("start"), F.col("end"), width, None).alias("context"))
    return out if limit is None else out.orderBy("id", "detector", "start", "end", "label").limit(limit)


def greedy_matches(calls: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-to-one greedy matching by IoU within a label, in prediction order: ``detector, label, tp, n_pred, n_gold, precision, recall, f1``; a threshold of 1
    asks for equal bounds.

    Sequential by nature; runs as a fold inside each record. Matching never crosses labels.
    """
    by_label = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"))))
    both = calls.select("detector", by_label("p").alias("p"), by_label("g").alias("g"))
    zero = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("tp"))

    def step(acc: Column, p: Column) -> Column:
        scored = F.transform(F.col("g"), lambda g, i: F.struct(
            F.when((g["label"] == p["label"]) & ~F.array_contains(acc["used"], i), S.iou(p["start"], p["end"], g["start"], g["end"])).otherwise(F.lit(0.0)).alias("iou"),
            (-i).alias("order"), g["label"].alias("label")))
        best = F.array_max(scored)
        ok = F.coalesce((best["iou"] >= threshold) & (best["iou"] > 0), F.lit(False))
        return F.struct(
            F.when(ok, F.concat(acc["used"], F.array(-best["order"]))).otherwise(acc["used"]).alias("used"),
            F.when(ok, F.concat(acc["tp"], F.array(best["label"]))).otherwise(acc["tp"]).alias("tp"))

    tag = lambda c, what: F.transform(c, lambda s: F.struct(F.lit(what).alias("what"), s["label"].alias("label")))
    hits = F.transform(F.aggregate("p", zero, step)["tp"], lambda x: F.struct(F.lit("tp").alias("what"), x.alias("label")))
    flat = both.select("detector", F.explode(F.concat(hits, tag("p", "n_pred"), tag("g", "n_gold"))).alias("x")).select("detector", "x.what", "x.label")
    counts = flat.groupBy("detector", "label").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("tp", "n_pred", "n_gold")])
    p, r = (F.coalesce(S.ratio(F.col("tp"), F.col(n)), F.lit(0.0)) for n in ("n_pred", "n_gold"))
    return counts.withColumns({"precision": p, "recall": r, "f1": S.f1_of(p, r)})
