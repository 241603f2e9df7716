"""Queries against plain Python, beside their SQL."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from maskwright.functions import taxonomy as X
from maskwright.operators import detect, search
from maskwright.plans.queries import QUERIES

REQUESTS = "request_id bigint, text string, categories array<string>, mode string"
SPANS = "request_id bigint, label string, start int, end int"


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def masked(text, spans, start, end):
    lo, hi, out = max(start - 30, 0), min(end + 30, len(text)), ""
    at = lo
    for s, e, label in sorted(spans):
        if 0 <= s < e <= len(text) and s < hi and lo < e and max(s, lo) >= at:
            out += text[at : max(s, lo)] + f"[{label}]"
            at = min(e, hi)
    return out + text[at:hi]


def test_masked_contexts_of_every_span(spark, data, tmp_path):
    text = "Kim of Acme wrote to Lee about the lease of the red house near the river, then Lee left."
    rows = [(1, 90, 99, "PERSON"), (1, 0, 3, "PERSON"), (1, 7, 11, "ORGANIZATION"), (1, 21, 24, "PERSON"), (1, 21, 24, "PERSON"), (1, 79, 82, "PERSON"), (2, -1, 2, "PERSON"), (2, 1, 3, "EMAIL")]
    d = write(spark, tmp_path, requests=([(1, text, None, None), (2, "a b@c", None, None), (3, "none", None, None)], REQUESTS), detected_spans=([(r, x, s, e) for r, s, e, x in rows], SPANS))
    got = {(r["request_id"], r["start"], r["end"], r["label"]): r["masked"] for r in QUERIES["masked_contexts"](spark, d).collect()}
    assert set(got) == {(1, 0, 3, "PERSON"), (1, 7, 11, "ORGANIZATION"), (1, 21, 24, "PERSON"), (1, 79, 82, "PERSON"), (2, 1, 3, "EMAIL")}
    texts = dict(zip(*pq.read_table(f"{data}/requests.parquet", columns=["request_id", "text"]).to_pydict().values()))
    spans = {}
    for r in pq.read_table(f"{data}/detected_spans.parquet", columns=["request_id", "start", "end", "label"]).to_pylist():
        spans.setdefault(r["request_id"], set()).add((r["start"], r["end"], r["label"]))
    want = {}
    for k, found in spans.items():
        for s, e, label in found:
            if texts.get(k) is not None and 0 <= s < e <= len(texts[k]):
                out = masked(texts[k], found, s, e)
                want[k, s, e, label] = out, not any(c.isalnum() for c in re.sub(r"\[[A-Z_]+\]", "", out))
    rows = QUERIES["masked_contexts"](spark, data).collect()
    assert {tuple(r)[:4]: tuple(r)[4:] for r in rows} == want and len(rows) == len(want) > len(spans)


def test_service_spans_of_every_mode(spark, tmp_path):
    modes = ["label", "redact", "label_number", "label_token", "other", None]
    d = write(
        spark, tmp_path, requests=([(k, "Kim met Lee", None, m) for k, m in enumerate(modes)], REQUESTS),
        detected_spans=([(k, "PERSON", s, e) for k in range(len(modes)) for s, e in ((0, 3), (8, 11), (9, 11))], SPANS))
    got = {(r["request_id"], r["start"]): r for r in QUERIES["service_spans"](spark, d).collect()}
    assert len(got) == 3 * len(modes) and {k: r["replaced"] for k, r in got.items()} == {k: k[1] != 9 for k in got}
    texts = QUERIES["service_replace"](spark, d).collect()
    for r in texts:
        k = r["request_id"]
        assert r["replaced_text"] == f"{got[k, 0]['replacement']} met {got[k, 8]['replacement']}"
    assert [got[k, 8]["replacement"] for k in (0, 1, 2, 4, 5)] == ["[PERSON]", "********", "[PERSON_2]", "[PERSON]", "[PERSON]"]
    assert re.fullmatch(r"\[PERSON_[0-9A-Za-z]{7}\]", got[3, 0]["replacement"]) and got[3, 0]["replacement"] != got[3, 8]["replacement"]


def test_rows_divisible_by_20_as_queries(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    queries = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    want = {(r["query_id"], r["place"]): (r["doc_id"], r["score"]) for r in search.bm25(docs, queries, 10).collect()}
    for small in ({"block": 200}, {"cells": 1}):
        got = {(r["query_id"], r["place"]): (r["doc_id"], r["score"]) for r in search.bm25_many(docs, queries, 10, **small).collect()}
        assert got.keys() == want.keys() and len({k[0] for k in got}) > 3
        assert all(got[k] == (d, pytest.approx(s, abs=2e-6)) for k, (d, s) in want.items())
    asked = {r["query_id"] for r in QUERIES["search_bm25"](spark, data).collect()}
    assert asked == {r["query_id"] for r in queries.where(F.size(search.tokens(F.col("text"))) > 0).collect()}


def test_retrieval_quality_of_every_mode(spark, data):
    rows = {r["mode"]: r for r in QUERIES["retrieval_quality"](spark, data).collect()}
    assert set(rows) == {"plain", "redact", "label", "label_number", "label_token"}
    assert rows["plain"]["precision"] == rows["plain"]["recall"] == 1 and len({r["queries"] for r in rows.values()}) == 1
    assert all(0 < r["recall"] <= 1 for r in rows.values())


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_spans_of_every_rule(spark, tmp_path):
    texts = [
        "Mail a.b@c.example or +41 44 123 4567, (555) 123-4567 by 2024-05-06.", "Card 4539578763621486, not 4539578763621487, see https://x.test/a?b=1 at 10.0.0.1",
        'token = "0123456789abcdef01234567" costs $12.50 or 3,20 EUR \U0001f600 on 2020-01-02', "", None]
    d = write(spark, tmp_path, requests=([(k, x, None, None) for k, x in enumerate(texts)], REQUESTS))
    want = set()
    for k, text in enumerate(texts):
        for name, (label, _, pattern) in detect.RULES.items():
            for m in re.finditer(pattern, text or ""):
                if name != "digits" or len(m[0]) == 16 and luhn(m[0]):
                    want.add((k, label, m.start(), m.end(), m[0]))
    rows = [tuple(r) for r in QUERIES["detect_rules"](spark, d).collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert {r[1] for r in rows} == {label for label, _, _ in detect.RULES.values()}


def test_f1_of_every_label(spark, data, tmp_path):
    for name, column in (("fixtures", "gold_spans"), ("predictions", "spans")):
        table = spark.read.parquet(f"{data}/{name}.parquet")
        turned = F.transform(column, lambda s: s.withField("label", F.when(s["label"] == "ADDRESS", F.lit("USERNAME")).when(s["label"] == "USERNAME", F.lit("ADDRESS")).otherwise(s["label"])))
        table.withColumn(column, turned).write.parquet(f"{tmp_path}/{name}.parquet")
    before = {r["detector"]: r for r in QUERIES["per_label_f1"](spark, data).collect()}
    found = QUERIES["per_label_f1"](spark, str(tmp_path))
    assert set(found.columns) == {"detector", *X.COARSE}
    rows = {r["detector"]: r for r in found.collect()}
    assert rows.keys() == before.keys() and any(r["ADDRESS"] for r in before.values())
    for k, r in rows.items():
        assert r["ADDRESS"] == 0 and (r["PERSON"], r["USERNAME"]) == (before[k]["PERSON"], before[k]["ADDRESS"])
