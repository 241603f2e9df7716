"""Named queries of the training-data operators. Each takes (spark, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import consensus, languages, leaks, lookalikes, pieces, pii, quantiles, sentences, spam, tokens
from .oracles import ORACLES  # noqa: F401 - the driver contract takes both from here

PROSE = ("txt", "docx", "eml", "pdf")
PAGES = ("html", "md")
Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _prose(spark: SparkSession, d: str) -> DataFrame:
    # \\S: not only white space
    return _table(spark, d, "documents").where(F.col("kind").isin(*PROSE) & F.col("text").rlike(r"\S"))


def _language_model(spark: SparkSession, d: str) -> languages.LanguageModel:
    # counted without reading texts
    labelled = _table(spark, d, "documents").where(F.col("kind").isin(*PROSE) & languages.label_language(F.col("lang")).isin(languages.LANGUAGES)).count()
    return languages.train_on(_prose(spark, d), total=labelled)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _prose(spark, d)
    rows = languages.language_stretches(docs, _language_model(spark, d))
    return languages.language_cases(rows).select("doc_id", "start_pos", "lang")


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    rows = languages.language_stretches(docs, _language_model(spark, d))
    return rows.select("doc_id", "label", "doc_lang", F.round("doc_confidence", 6).alias("doc_confidence"), "start_pos", "end_pos", "lang", F.round("confidence", 6).alias("confidence"))


def p1_words(spark: SparkSession, d: str) -> DataFrame:
    """Runs of words of one language inside the sentences of all documents."""
    rows = languages.language_words(_table(spark, d, "documents"), _language_model(spark, d))
    return rows.withColumn("confidence", F.round("confidence", 6))


def p1_properties(spark: SparkSession, d: str) -> DataFrame:
    """Per document: its stretches follow each other inside the text, neighbours differ in language, confidences are shares."""
    rows = p1_languages(spark, d)
    one = F.struct("start_pos", "end_pos", "lang", "confidence")
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("start_pos").isNotNull(), one))).alias("s"))
    s = F.col("s")
    follows = F.transform(s, lambda x, i: (x["start_pos"] < x["end_pos"]) & ((i == 0) | ((x["start_pos"] >= F.get(s, i - 1)["end_pos"]) & (x["lang"] != F.get(s, i - 1)["lang"]))))
    return per.select("doc_id", F.forall(follows, lambda ok: ok).alias("in_order"), F.forall(s, lambda x: x["confidence"].between(0, 1)).alias("shares"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    requests = _table(spark, d, "requests")
    return pii.find_mentions(requests, pii.train_on(requests, _table(spark, d, "detected_spans"))).distinct()


def p2_replaced(spark: SparkSession, d: str) -> DataFrame:
    requests = _table(spark, d, "requests")
    return pii.replace_mentions(requests, pii.train_on(requests, _table(spark, d, "detected_spans")))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every request with its placeholders turned back into the mentions: all other text must be as it was."""
    rows = p2_replaced(spark, d)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("shift"))

    def step(acc: Column, m: Column) -> Column:
        # the placeholder stands where the mention began, moved by what was put in before
        start = m["start"] + acc["shift"]
        gap = F.substring(F.col("replaced_text"), acc["at"] + 1, start - acc["at"])
        longer = F.length(m["replacement"]) - (m["end"] - m["start"])
        return F.struct(F.concat(acc["out"], gap, m["text"]).alias("out"), (start + F.length(m["replacement"])).alias("at"), (acc["shift"] + longer).alias("shift"))

    text = F.aggregate("mentions", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("replaced_text"), acc["at"] + 1, F.length("replaced_text"))))
    return rows.select("request_id", F.sha1(text).alias("text_sha1"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_rows(_prose(spark, d))


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text", "segments")
    flat = sentences.with_sentence_units(docs).select("doc_id", "segments", F.posexplode("units").alias("unit", "u"))
    return flat.select(
        "doc_id", "unit", F.col("u.start").alias("start_pos"), F.col("u.end").alias("end_pos"),
        sentences.place_in_segments(F.col("u.start"), F.col("u.end"), F.col("segments")).alias("segments"))


def p3_properties(spark: SparkSession, d: str) -> DataFrame:
    """Per document with visible text: units follow each other, hold no white space at their ends, and together every visible code point."""
    docs = sentences.with_sentence_units(_table(spark, d, "documents").where(F.col("text").rlike(pieces.VISIBLE)).select("doc_id", "text"))
    u, text = F.col("units"), F.col("text")
    own = F.transform(u, lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"]))
    visible = lambda c: F.regexp_replace(c, pieces.BLANK, "")
    return docs.select(
        "doc_id", F.forall(F.transform(u, lambda x, i: (i == 0) | (x["start"] >= F.get(u, i - 1)["end"])), lambda ok: ok).alias("in_order"),
        F.forall(own, lambda t: t.rlike(pieces.TRIMMED)).alias("trimmed"), (visible(F.array_join(own, "")) == visible(text)).alias("covered"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_table(spark, d, "annotations")).select("item_id", "label", "start_pos", "end_pos")


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_table(spark, d, "annotations"))


def p4_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes that count and the share of agreeing pairs per item."""
    return consensus.consensus(_table(spark, d, "annotations")).select("item_id", "n_votes", F.round("agreement", 6).alias("agreement"))


def p4_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.annotator_reliability(_table(spark, d, "annotations"))


QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
EPS = 0.005


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per detector, run and day in one table, from the summaries of one pass over the rows."""
    by = {"detector": F.col("detector"), "run_id": F.col("run_id"), "day": F.to_date("started_at")}
    parts = quantiles.summaries(_table(spark, d, "predictions"), "latency_ms", by, EPS, separate=True)
    return quantiles.percentiles(parts, ["grouping", "key"], QUANTILES, EPS)


def p5_latency(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per detector, merged from the summaries of single days."""
    rows = _table(spark, d, "predictions")
    days = quantiles.summaries(rows, "latency_ms", {"detector": F.col("detector"), "day": F.to_date("started_at")}, EPS)
    return quantiles.percentiles(days, ["detector"], QUANTILES, EPS)


def p5_latency_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "predictions")
    return quantiles.percentiles(quantiles.summaries(rows, "latency_ms", {"run_id": F.col("run_id")}, EPS), ["run_id"], QUANTILES, EPS)


def p5_latency_days(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "predictions")
    return quantiles.percentiles(quantiles.summaries(rows, "latency_ms", {"day": F.to_date("started_at")}, EPS), ["day"], QUANTILES, EPS)


def p5_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Exact ranks of the percentiles per detector: within the stated error?"""
    rows = _table(spark, d, "predictions")
    found = p5_latency(spark, d).withColumnRenamed("detector", "key")
    return quantiles.rank_check(rows, "latency_ms", F.col("detector"), found).withColumnRenamed("key", "detector")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    requests = lookalikes.lookalike_pairs(_table(spark, d, "requests"), "request_id")
    spans = lookalikes.lookalike_pairs(_table(spark, d, "detected_spans"), "span_id", within="request_id")
    return requests.select(F.lit("request").alias("tab"), "key_a", "key_b").unionByName(spans.select(F.lit("span").alias("tab"), "key_a", "key_b"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Requests that look like another one, by class."""
    return lookalikes.lookalike_classes(_table(spark, d, "requests"), "request_id").drop("grp")


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.with_consistent_text(_table(spark, d, "requests").select("request_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pieces(spark, d).select("doc_id", "cut")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(_table(spark, d, "documents"), _table(spark, d, "size_limits"))


def p7_properties(spark: SparkSession, d: str) -> DataFrame:
    """Limit, overlap, order and coverage of the pieces of every split document."""
    return pieces.piece_properties(p7_pieces(spark, d), _table(spark, d, "documents"), _table(spark, d, "size_limits"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(_table(spark, d, "documents"))


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the ids stand for."""
    return tokens.decoded(p8_ids(spark, d)).select("doc_id", F.sha1("text").alias("text_sha1"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document without its leaked spans."""
    return leaks.cleaned(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """The leaked spans with their items."""
    return leaks.leak_spans(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p9_after(spark: SparkSession, d: str) -> DataFrame:
    """How many passages are left once the leaked spans are cut."""
    return leaks.leaked_items(p9_cleaned(spark, d), _table(spark, d, "eval_items")).agg(F.count(F.lit(1)).alias("leaks"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").where(F.col("kind").isin(*PAGES))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed_pages(_pages(spark, d))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.score_pages(_pages(spark, d))


def p10_ways(spark: SparkSession, d: str) -> DataFrame:
    """The scores with broadcast information against those of the shuffle join: how many pages there are and how many differ."""
    a, b = (spam.score_pages(_pages(spark, d), most_pairs=m).select("doc_id", F.round("marked", 9).alias("marked")) for m in (2_000_000, 0))
    both = a.withColumnRenamed("marked", "ma").join(b.withColumnRenamed("marked", "mb"), "doc_id", "full")
    return both.agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("ma").eqNullSafe(F.col("mb"))).alias("different"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    p1_found, p1_languages, p1_words, p1_properties, p2_found, p2_replaced, p2_restored, p3_found, p3_units, p3_properties, p4_found, p4_agreement, p4_votes, p4_reliability, p5_percentiles, p5_latency, p5_latency_runs,
    p5_latency_days, p5_ranks, p6_found, p6_classes, p6_forms, p7_found, p7_pieces, p7_properties, p8_ids, p8_texts, p9_found, p9_cleaned, p9_spans, p9_after, p10_found, p10_scores, p10_ways)}
