"""Rewriting text from spans: redact, label, label_number, label_token; find and replace over request tables.

Input spans are arrays of struct<label, start, end>. Overlaps: the earlier start wins, the later span stays as it is but still takes a number.
Nulls: a null text stays null; a null or empty span list leaves the text unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions import taxonomy as X

MODES = ("redact", "label", "label_number", "label_token")


def clean_spans(spans: Column, text: Column) -> Column:
    """In-bounds spans as struct<start, end, label>, distinct and sorted by (start, end, label)."""
    ok = F.filter(spans, lambda s: S.in_bounds(s["start"], s["end"], text))
    plain = F.transform(ok, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label")))
    return F.array_sort(F.array_distinct(F.coalesce(plain, F.array().cast("array<struct<start:int,end:int,label:string>>"))))


def numbered(spans: Column, text: Column) -> Column:
    """Adds ``n``: the number of each distinct (label, text) among its label's, in order of first appearance."""
    with_text = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), S.slice_text(text, s["start"], s["end"]).alias("text")))
    kinds = F.array_distinct(F.transform(with_text, lambda s: F.struct(s["label"].alias("label"), s["text"].alias("text"))))
    labels = F.array_distinct(F.transform(spans, lambda s: s["label"]))
    # one list of texts per label, so that a span looks only through its own label's
    texts = F.map_from_arrays(labels, F.transform(labels, lambda x: F.transform(F.filter(kinds, lambda k: k["label"] == x), lambda k: k["text"])))

    def add(seen: Column) -> Column:
        return F.transform(with_text, lambda s: F.struct(
            s["start"], s["end"], s["label"], s["text"], F.array_position(F.try_element_at(seen, s["label"]), s["text"]).cast("int").alias("n")))

    return F.get(F.transform(F.array(texts), add), F.lit(0))


def replacement(mode: Column, label: Column, text: Column, n: Column, secret: str = "maskwright") -> Column:
    """Placeholder of a span by mode; an unknown mode falls back to ``label``."""
    return (
        F.when(mode == "redact", F.lit(S.REDACTED))
        .when(mode == "label_number", F.concat(F.lit("["), label, F.lit("_"), n.cast("string"), F.lit("]")))
        .when(mode == "label_token", F.concat(F.lit("["), label, F.lit("_"), S.token_of(label, text, secret), F.lit("]")))
        .otherwise(F.concat(F.lit("["), label, F.lit("]"))))


def rewrite(df: DataFrame, spans_col: str, text_col: str = "text", mode: str | Column = "label", out: str = "replaced_text", secret: str = "maskwright") -> DataFrame:
    """Adds the rewritten text and ``detected_spans`` with replacement and ``replaced``; every row is kept."""
    if isinstance(mode, str):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
        mode = F.lit(mode)
    text = F.col(text_col)
    df = df.withColumn("_n", numbered(clean_spans(F.col(spans_col), text), text))
    df = df.withColumn("_p", F.transform("_n", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["text"].alias("text"),
        replacement(mode, s["label"], s["text"], s["n"], secret).alias("replacement"))))
    df = df.withColumn("_k", F.arrays_zip(F.col("_p").alias("s"), S.free_of_earlier(F.col("_p")).alias("replaced")))
    spans = F.transform("_k", lambda x: F.struct(
        x["s"]["label"].alias("label"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["text"].alias("text"), x["s"]["replacement"].alias("replacement"), x["replaced"].alias("replaced")))
    return df.withColumns({out: S.splice(text, F.col("_p")), "detected_spans": spans}).drop("_n", "_p", "_k")


def category_filter(spans: Column, categories: Column) -> Column:
    """Null categories let all labels through, an empty list none."""
    return F.filter(spans, lambda s: categories.isNull() | F.array_contains(categories, s["label"]))


def spans_by_request(detected: DataFrame, key: str = "request_id") -> DataFrame:
    """Span rows as one sorted array per request; repeated deliveries count once."""
    one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label")
    return detected.groupBy(key).agg(F.array_sort(F.collect_set(one)).alias("spans"))


def find(requests: DataFrame, spans: DataFrame, key: str = "request_id") -> DataFrame:
    """``request_id, spans, span_count, by_label`` after the category filter of each request; requests without spans have none."""
    j = requests.join(spans, key, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string>>")))
    found = j.withColumn("spans", category_filter(clean_spans(F.col("spans"), F.col("text")), F.col("categories")))
    labels = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["label"])))
    counts = F.transform(labels, lambda x: F.struct(x.alias("label"), F.size(F.filter("spans", lambda s: s["label"] == x)).alias("n")))
    return found.withColumns({"span_count": F.size("spans"), "by_label": F.map_from_entries(counts)})


def replace(requests: DataFrame, spans: DataFrame, key: str = "request_id") -> DataFrame:
    """Find, then rewrite each request in its own mode (null mode: label)."""
    return rewrite(find(requests, spans, key), "spans", mode=F.coalesce(F.col("mode"), F.lit("label")))


def render_modes(df: DataFrame, spans_col: str, text_col: str = "text") -> DataFrame:
    """All four renderings and the plain text side by side."""
    out = df
    for m in MODES:
        out = rewrite(out, spans_col, text_col, m, out=m).drop("detected_spans")
    return out.withColumn("plain", F.col(text_col))


def problems(requests: DataFrame) -> DataFrame:
    """``request_id, problem``: requests with a mode or a category that the service does not know."""
    mode = F.when(F.col("mode").isNotNull() & ~F.col("mode").isin(*MODES), F.concat(F.lit("unknown mode "), "mode"))
    unknown = F.transform(F.filter("categories", lambda c: c.isNotNull() & ~c.isin(X.ALL_LABELS)), lambda c: F.concat(F.lit("unknown category "), c))
    found = F.concat(F.filter(F.array(mode), lambda x: x.isNotNull()), F.coalesce(unknown, F.array().cast("array<string>")))
    return requests.select("request_id", F.explode(found).alias("problem"))


def vault_tokens(spans: DataFrame, labels: list[str] | None = None, secret: str = "maskwright") -> DataFrame:
    """``label, text, token`` of the distinct pairs, as a vault would give them in one batch; labels without a column in the vault have no token."""
    once = spans.where(F.col("text").isNotNull()).select("label", "text").distinct()
    known = once if labels is None else once.where(F.col("label").isin(labels))
    return known.withColumn("token", S.token_of(F.col("label"), F.col("text"), secret))


def rewrite_with_vault(df: DataFrame, spans_col: str, tokens: DataFrame, key: str = "request_id", text_col: str = "text") -> DataFrame:
    """``key, replaced_text``: spans become ``[LABEL_token]`` by a table of tokens, ``[LABEL]`` where it has none. Span values join the table by (label, text);
    texts do not move for that."""
    text = F.col(text_col)
    df = df.withColumn("_s", clean_spans(F.col(spans_col), text))
    flat = df.select(key, F.explode("_s").alias("s"), text.alias("_t")).select(key, "s", F.col("s.label").alias("label"), S.slice_text(F.col("_t"), F.col("s.start"), F.col("s.end")).alias("text"))
    met = flat.join(tokens.select("label", "text", "token"), ["label", "text"], "left")
    shown = F.when(F.col("token").isNull(), F.concat(F.lit("["), "label", F.lit("]"))).otherwise(F.concat(F.lit("["), "label", F.lit("_"), "token", F.lit("]")))
    parts = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s.start", "s.end", "label", shown.alias("replacement")))).alias("_p"))
    none = F.array().cast("array<struct<start:int,end:int,label:string,replacement:string>>")
    return df.join(parts, key, "left").select(key, S.splice(text, F.coalesce("_p", none)).alias("replaced_text"))


def token_collisions(spans: DataFrame) -> DataFrame:
    """Tokens of one label that stand for more than one text: ``label, token, n``. ``spans`` holds label and text."""
    return spans.select("label", "text").distinct().withColumn("token", S.token_of(F.col("label"), F.col("text"))).groupBy("label", "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def mask(df: DataFrame, spans_col: str, start: Column, end: Column, text_col: str = "text", out: str = "masked") -> DataFrame:
    """The stretch text[start:end] with the spans in it, clipped and merged, replaced by their coarse labels."""
    text = F.col(text_col)
    inside = F.filter(clean_spans(F.col(spans_col), text), lambda s: S.overlaps(s["start"], s["end"], start, end))
    parts = F.transform(inside, lambda s: F.struct(
        (F.greatest(s["start"], start) - start).cast("int").alias("start"), (F.least(s["end"], end) - start).cast("int").alias("end"), F.concat(F.lit("["), s["label"], F.lit("]")).alias("replacement")))
    return df.withColumn("_parts", parts).withColumn(out, S.splice(S.slice_text(text, start, end), F.col("_parts"))).drop("_parts")
