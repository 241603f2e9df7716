"""Visually identical text with different characters (problem 6).

Texts are exploded to positioned code points; two fixed tables, joined by broadcast, replace each by its
canonical decomposition, narrow form, plain letters of a ligature, plain space, look-alike letter or
nothing; combining marks are ordered by their class inside each cluster; clusters are recomposed by a
third fixed table; the strings are rebuilt. Only distinct texts outside printable ASCII are exploded: all
others are already in their consistent form.

Defined results: null stays null, empty stays empty. Line breaks and tabs are kept. Digits, case, accents and
signs are never changed. The tables come from the Unicode database of the Python runtime by rule; their size
does not depend on the data.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from maskwright.session import cut_lineage

# Letters of other scripts with the shape of a Latin letter.
SAME_SHAPE = dict(zip(
    "аеорсхуіѕјһԁԛԝҽӏ" "АВЕКМНОРСТХІЅЈҮԚԜ" "ονιϲϳ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ" "ɑɡɩⱭꓐ" "օսոհ",
    "aeopcxyisjhdqwel" "ABEKMHOPCTXISJYQW" "ovicj" "ABEZHIKMNOPTYXCJ" "agiAB" "ounh",
))
# Ligatures that are joined letters (others, like the ash, are letters of their own).
_JOINED = [*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), 0x132, 0x133, *range(0x1C4, 0x1CD), 0x1F1, 0x1F2, 0x1F3, *range(0xFEF5, 0xFEFD)]
_ASCII = r"^[\x20-\x7e\t\n\r]*$"


def _simple(ch: str) -> str | None:
    """One replacement step of a code point, or None."""
    c = ord(ch)
    if ch in SAME_SHAPE:
        return SAME_SHAPE[ch]
    cat = unicodedata.category(ch)
    if cat == "Zs" and ch != " ":
        return " "
    if cat == "Cf" or cat == "Cc" and ch not in "\t\n\r" or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0):
        return ""
    d = unicodedata.decomposition(ch)
    if d:
        if d[0] != "<":
            return unicodedata.normalize("NFD", ch)
        tag = d[1 : d.index(">")]
        if tag in ("wide", "narrow") or c in _JOINED:
            return unicodedata.normalize("NFKD", ch)
    elif 0xAC00 <= c <= 0xD7A3:
        return unicodedata.normalize("NFD", ch)
    return None


@functools.cache
def _full(ch: str) -> str:
    """The replacement of a code point, repeated until nothing changes."""
    out = _simple(ch)
    if out is None or out == ch:
        return ch
    return "".join(_full(x) for x in out)


def _jamo(ch: str) -> bool:
    return 0x1160 <= ord(ch) <= 0x11FF


@functools.cache
def mapping_rows() -> list[tuple[str, list[tuple[str, int, bool]]]]:
    """(code point, [(replacement, class, starts a cluster)]) of every code point that changes or combines."""
    rows = []
    for c in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000 or 0x30000 <= c < 0xE0000 or c >= 0xE0200:
            continue
        ch = chr(c)
        full = _full(ch)
        if full != ch or unicodedata.combining(ch) or _jamo(ch):
            rows.append((ch, [(x, unicodedata.combining(x), not unicodedata.combining(x) and not _jamo(x)) for x in full]))
    return rows


@functools.cache
def composition_rows() -> list[tuple[str, str]]:
    """(ordered cluster, composed form) of every cluster that has a composed form."""
    out: dict[str, str] = {}
    for c in range(0xC0, 0x1F800):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == ch:
            cluster = "".join(_full(x) for x in parts)
            out.setdefault(cluster, "".join(_full(parts[0])) and unicodedata.normalize("NFC", cluster))
    return [(k, v) for k, v in out.items() if k != v]


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    part = T.StructType([T.StructField("ch", T.StringType()), T.StructField("ccc", T.IntegerType()), T.StructField("starts", T.BooleanType())])
    mapping = spark.createDataFrame(mapping_rows(), T.StructType([T.StructField("ch", T.StringType()), T.StructField("to", T.ArrayType(part))]))
    compose = spark.createDataFrame(composition_rows(), "cluster string, composed string")
    return F.broadcast(mapping), F.broadcast(compose)  # fixed tables of some 20,000 short rows


def _id(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit("second"), text).alias("_h2")]


def consistent_texts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``_h1, _h2, form`` of every distinct text that is not plain ASCII. One shuffle, by text."""
    mapping, compose = _tables(texts.sparkSession)
    key = ["_h1", "_h2"]
    odd = texts.where(~F.col(text_col).rlike(_ASCII)).select(F.col(text_col).alias("_t")).select("_t", *_id(F.col("_t")))
    # of equal texts one is exploded; the rest meet it again by their 128 bits
    odd = odd.groupBy(*key).agg(F.first("_t").alias("_t"))
    points = odd.select(*key, F.posexplode(F.regexp_extract_all("_t", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    mapped = points.join(mapping, "ch", "left")
    same = F.array(F.struct(F.col("ch"), F.lit(0).alias("ccc"), F.lit(True).alias("starts")))
    parts = mapped.select(*key, "pos", F.posexplode_outer(F.coalesce("to", same)).alias("sub", "p")).select(
        *key, "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("p.ch", F.lit("")).alias("ch"),
        F.coalesce("p.ccc", F.lit(0)).alias("ccc"), F.coalesce("p.starts", F.lit(False)).alias("starts"))
    order = Window.partitionBy(*key).orderBy("pos", "sub")
    numbered = parts.withColumn("cluster", F.sum(F.col("starts").cast("int")).over(order))
    spot = F.struct(F.when(F.col("starts"), -1).otherwise(F.col("ccc")).alias("rank"), "pos", "sub", "ch")
    clusters = numbered.groupBy(*key, "cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(spot)), lambda s: s["ch"]), "").alias("s"))
    composed = clusters.join(compose, F.col("s") == compose["cluster"], "left").select(
        *key, clusters["cluster"], F.coalesce("composed", "s").alias("s"))
    return composed.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "s"))), lambda c: c["s"]), "").alias("form"))


def with_consistent_text(df: DataFrame, text_col: str = "text", out: str = "form") -> DataFrame:
    """Adds the consistent form of ``text_col``; every row and column of ``df`` is kept.

    Plain rows meet no form; they are spread by a hash of the whole row, so a plain text that a third of the rows share fills no
    single partition. A shared text that is not plain is a hot key of an outer join, which adaptive execution splits.
    """
    forms = consistent_texts(df, text_col).withColumnRenamed("form", "_form")
    plain = F.coalesce(F.col(text_col).rlike(_ASCII), F.lit(True))
    hashable = [F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = df.withColumns({
        "_h1": F.when(plain, F.xxhash64(*hashable)).otherwise(F.xxhash64(F.col(text_col))),
        "_h2": F.when(plain, F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.lit("second"), F.col(text_col)))})
    return keyed.join(forms, ["_h1", "_h2"], "left").withColumn(out, F.coalesce("_form", F.col(text_col))).drop("_h1", "_h2", "_form")


def _hashed(df: DataFrame, key_col: str, text_col: str, within: str | None) -> DataFrame:
    """``key, grp, _h1, _h2, s1, s2``: 128 bits each for the text and its form, of every row with a text. Written once: some 50 bytes a row."""
    rows = df.where(F.length(text_col) > 0).select(
        F.col(key_col).alias("key"), (F.col(within) if within else F.lit(0)).alias("grp"), F.col(text_col).alias("_text"))
    formed = with_consistent_text(rows, "_text", "_form0")
    return cut_lineage(formed.select(
        "key", "grp", *_id(F.col("_text")), F.xxhash64("_form0").alias("s1"), F.xxhash64(F.lit("second"), "_form0").alias("s2")).distinct())


def lookalike_classes(df: DataFrame, key_col: str, text_col: str = "text", within: str | None = None) -> DataFrame:
    """``key, grp, class_id, text_id, members, ways``: one row per row whose text looks like a different text of its group.

    ``class_id`` stands for the common form, ``text_id`` for the exact text; a class has ``members`` rows in ``ways`` different texts. Its size is that of the rows, however
    many copies a class has; any two members with different ``text_id`` are a pair. Null and empty texts are left out.
    """
    small = _hashed(df, key_col, text_col, within)
    form = ["grp", "s1", "s2"]
    texts = small.groupBy(*form, "_h1", "_h2").agg(F.count(F.lit(1)).alias("n"))
    classes = texts.groupBy(*form).agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("ways")).where("ways > 1")
    name = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    return small.join(classes, form).select("key", "grp", name("s1", "s2").alias("class_id"), name("_h1", "_h2").alias("text_id"), "members", "ways")


def lookalike_pairs(df: DataFrame, key_col: str, text_col: str = "text", within: str | None = None) -> DataFrame:
    """``key_a, key_b`` of rows whose texts look the same but are not equal, optionally only inside one ``within`` value.

    For queries that must have every pair of rows; ``lookalike_classes`` says the same in one row per row. Distinct texts are paired first, and only where a form has
    several of them; rows join those pairs afterwards, so copies of one text are never compared with each other. Null and empty texts are left out.
    """
    small = _hashed(df, key_col, text_col, within)
    ways = small.select("grp", "s1", "s2", "_h1", "_h2").distinct()
    several = ways.groupBy("grp", "s1", "s2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ways = ways.join(several, ["grp", "s1", "s2"])
    a = ways.select("grp", "s1", "s2", F.col("_h1").alias("a1"), F.col("_h2").alias("a2"))
    b = ways.select("grp", "s1", "s2", F.col("_h1").alias("b1"), F.col("_h2").alias("b2"))
    two = a.join(b, ["grp", "s1", "s2"]).where("a1 < b1 or (a1 = b1 and a2 < b2)").drop("s1", "s2")
    left = small.select("grp", F.col("_h1").alias("a1"), F.col("_h2").alias("a2"), F.col("key").alias("ka"))
    right = small.select("grp", F.col("_h1").alias("b1"), F.col("_h2").alias("b2"), F.col("key").alias("kb"))
    pairs = two.join(left, ["grp", "a1", "a2"]).join(right, ["grp", "b1", "b2"]).where("ka <> kb")
    return pairs.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
