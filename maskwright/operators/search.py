"""BM25 search over (rewritten) texts, by an inverted index as tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.session import cut_lineage

TOKEN = r"\[[A-Z_]+_[A-Za-z0-9]+\]|[A-Za-z0-9_]+"


def tokens(text: Column) -> Column:
    """Lower-cased words; placeholders like [PERSON_3] are one word."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``query_id, doc_id, score, place``: the k best documents per query.

    Only the terms of the queries leave the scan of the documents (a semi join on the small term set), each with its document's
    length, so no table of all documents is joined. Top-k is a row number limit, which Spark applies in each task before the shuffle.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    words = docs.select(F.col(key).alias("doc_id"), tokens(F.col(text)).alias("w")).where(F.size("w") > 0)
    stats = words.agg(F.struct(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("w")).alias("avgdl"))).scalar()
    hit = words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    post = hit.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    df_t = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = post.join(df_t, "term").join(q, "term").withColumn("s", stats).select("*", "s.n_docs", "s.avgdl")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def term_counts(docs: DataFrame) -> DataFrame:
    """``term, df, words`` of ``doc_id, text``; the row of the empty term has the number of documents with words and of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, df, total = re.compile(TOKEN), Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = [x.lower() for x in word.findall(text)] if text else []
                if found:
                    total += len(found)
                    df.update({"", *found})
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([0 if t else total for t in df], pa.int64())], names=["term", "df", "words"])

    return docs.select("text").mapInArrow(run, "term string, df bigint, words bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


def bm25_many(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, key: str = "doc_id", text: str = "text", block: int = 1_000_000, cells: int = 4_000_000) -> DataFrame:
    """As ``bm25``, for many long queries: every document is scored against all queries in numpy.

    The queries go to the tasks in blocks of about ``block`` distinct terms; each task holds about ``cells`` scores at once and
    returns those that may be among the k best. The work is documents times queries.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    asked = cut_lineage(queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms")))
    kind = asked.schema["query_id"].dataType.simpleString()
    counts = cut_lineage(term_counts(source))
    stats = counts.where("term = ''").first()
    schema = f"query_id {kind}, doc_id {source.schema['doc_id'].dataType.simpleString()}, score double"
    n_blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block)
    if stats is None or not n_blocks:
        return spark.createDataFrame([], f"{schema}, place int")
    n_docs, avgdl = stats["df"], stats["words"] / stats["df"]
    found = []
    for i in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i)
        rows = part.select("query_id", F.explode("terms").alias("term")).join(counts, "term").select("query_id", "term", "df").toPandas()
        if len(rows):
            found.append(source.mapInArrow(_scan(spark, rows, n_docs, avgdl, k, k1, b, kind, cells), schema))
    if not found:
        return spark.createDataFrame([], f"{schema}, place int")
    scored = found[0]
    for more in found[1:]:
        scored = scored.unionByName(more)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _scan(spark, rows, n_docs, avgdl, k, k1, b, kind, cells):  # noqa: ANN001, ANN202 - the scoring of one block of queries
    ids, q = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
    t, terms = pd.factorize(rows["term"])
    order = np.argsort(t, kind="stable")
    q, ends = q[order].astype(np.int32), np.cumsum(np.bincount(t))
    df = np.zeros(len(terms))
    df[t] = rows["df"].to_numpy(float)
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((ids, terms.tolist(), q, ends, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, q, ends, idf = shared.value
        number, lists, n = {x: i for i, x in enumerate(terms)}, np.split(q, ends[:-1]), len(ids)
        sizes = np.diff(ends, prepend=0)
        word, most = re.compile(TOKEN), max(k, cells // n)
        best = np.zeros((n, k))
        keys: list[object] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal best
            s = np.stack(held)
            floor = best.min(axis=1)
            if not best.any() and len(s) > k:  # the first run; later ones are held against the best so far
                floor = np.partition(s, len(s) - k, axis=0)[-k]
            doc, at = np.nonzero(s >= np.maximum(floor - 1e-5, 1e-12))
            score = np.round(s[doc, at], 6)
            place = np.empty(len(keys), np.int64)
            place[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
            o = np.lexsort((place[doc], -score, at))
            at, doc, score = at[o], doc[o], score[o]
            first = np.searchsorted(at, at)
            rank = np.arange(len(at)) - first
            keep = rank < k  # no more than the k best of this run
            at, doc, score = at[keep], doc[keep], score[keep]
            top = np.zeros((n, k))
            top[at, rank[keep]] = score
            best = np.partition(np.concatenate([best, top], axis=1), k, axis=1)[:, -k:]
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids[at].tolist(), types[0]), pa.array([keys[j] for j in doc.tolist()], types[1]), pa.array(score)], names=["query_id", "doc_id", "score"])
            keys.clear()
            held.clear()
            return out

        types: list[pa.DataType] = [id_type]
        for batch in batches:
            types[1:] = [batch.schema.field(0).type]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [x.lower() for x in word.findall(text)] if text else []
                tf = Counter(found)
                hit = [(number[x], c) for x, c in tf.items() if x in number]
                if not hit:
                    continue
                at, c = np.array(hit).T
                weight = idf[at] * c * (k1 + 1) / (c + k1 * (1 - b + b * len(found) / avgdl))
                held.append(np.bincount(np.concatenate([lists[i] for i in at.tolist()]), np.repeat(weight, sizes[at]), n))
                keys.append(doc_id)
                if len(held) >= most:
                    yield flush()
        if held:
            yield flush()

    id_type = pa.int64() if kind == "bigint" else pa.string()
    return run


# The made-up addresses of the demonstration corpus.
DEMO_QUERIES = ["alice@example.com", "charlie@example.com"]


def demo_corpus(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, text`` of 130 short texts, ``query_id, text, relevant``): five texts name one address, three another, the rest names other people's
    addresses or none. Made by rule from the number of the text."""
    n = F.col("doc_id")
    other = lambda k: F.concat(F.lit("user"), (n * 7 + k).cast("string"), F.lit("@mail.example"))
    text = (
        F.when(n < 5, F.concat(F.lit("Please forward item "), n.cast("string"), F.lit(f" to {DEMO_QUERIES[0]} before noon")))
        .when(n < 8, F.concat(F.lit("Invoice "), n.cast("string"), F.lit(f" was sent to {DEMO_QUERIES[1]} today")))
        .when(n < 48, F.concat(F.lit("Team list: "), other(1), F.lit(", "), other(2), F.lit(" and "), other(3)))
        .when(n < 128, F.concat(F.lit("Reply to "), other(1), F.lit(" about room "), n.cast("string")))
        .otherwise(F.lit("The office is closed on Monday")))
    queries = spark.createDataFrame([(0, DEMO_QUERIES[0], list(range(5))), (1, DEMO_QUERIES[1], [5, 6, 7])], "query_id bigint, text string, relevant array<bigint>")
    return spark.range(130).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text")), queries


def retrieval_quality(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, precision, recall`` of retrieved against relevant documents."""
    got = hits.groupBy("query_id").agg(F.collect_set("doc_id").alias("got"))
    j = queries.join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<bigint>")))
    good = F.size(F.array_intersect("got", "relevant")).cast("double")
    return j.select("query_id", F.coalesce(F.try_divide(good, F.size("got")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(good, F.size("relevant")), F.lit(0.0)).alias("recall"))
