"""Reading labelled datasets: JSON lines, JSON, CSV/TSV, Parquet, span schemas with other key names, privacy masks, BIO tags.

Every reader gives ``id, text, language, gold_spans`` with explicit types. Spans whose label the vocabulary does not know, or whose
offsets are missing or out of the text, are dropped. Ids default to the row's place in its file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from maskwright.functions import spans as S
from maskwright.functions import taxonomy as X

# Other names of the record and span keys, in order of preference.
TEXT_KEYS = ("text", "source_text", "body", "content", "sentence", "full_text")
ID_KEYS = ("id", "uid", "doc_id", "record_id")
SPAN_KEYS = ("spans", "gold_spans", "entities", "privacy_mask", "pii", "annotations", "labels")
LABEL_KEYS = ("label", "raw_label", "type", "entity_type", "kind", "entity", "tag")
START_KEYS = ("start", "begin", "start_offset", "start_char")
END_KEYS = ("end", "stop", "end_offset", "end_char")
LANGUAGE_KEYS = ("language", "lang", "locale")
FORMATS = {"jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "csv": "csv", "tsv": "tsv", "parquet": "parquet"}

SPAN_DDL = "array<struct<label:string,fine_label:string,raw_label:string,start:int,end:int,text:string>>"


def infer_format(path: str) -> str:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"cannot tell the format of {path!r}; known suffixes are {sorted(FORMATS)}")
    return FORMATS[suffix]


def read_raw(spark: SparkSession, path: str, fmt: str | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of a file or folder as they are. JSON lines fail fast on a bad line; JSON may be a list or an object that holds one."""
    fmt = fmt or infer_format(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt in ("csv", "tsv"):
        return spark.read.csv(path, header=True, multiLine=True, escape='"', sep="\t" if fmt == "tsv" else ",")
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "jsonl":
        return reader.json(path, mode="FAILFAST")
    rows = reader.json(path, multiLine=True, mode="FAILFAST")
    for key in ("data", "records", "examples", "rows"):
        if key in rows.columns and isinstance(rows.schema[key].dataType, T.ArrayType):
            return rows.select(F.inline(F.col(key)))
    return rows


def _first(df_type: T.StructType, keys: tuple[str, ...], of: Callable[[str], Column]) -> Column | None:
    found = [of(k) for k in keys if k in df_type.fieldNames()]
    return F.coalesce(*found) if len(found) > 1 else found[0] if found else None


def _string(c: Column | None) -> Column:
    return F.lit(None).cast("string") if c is None else c.cast("string")


def _row_id(df: DataFrame) -> DataFrame:
    """Adds ``_row``: the place of the row in its partition's order; dense within one file."""
    return df.withColumn("_row", F.monotonically_increasing_id())


def spans_dataset(
    raw: DataFrame, vocab: str | X.Vocab = "records", text_key: str | None = None, spans_key: str | None = None, id_key: str | None = None, keep_unmapped: bool = False,
) -> DataFrame:
    """Records from rows that hold a span list under any of the known key names. Labels that the vocabulary does not know are dropped with their span, or
    with ``keep_unmapped`` kept in upper case."""
    v = X.VOCABS[vocab] if isinstance(vocab, str) else vocab
    raw = _row_id(raw)
    schema = raw.schema
    text = F.col(text_key) if text_key else _first(schema, TEXT_KEYS, F.col)
    if text is None:
        raise ValueError(f"no text column among {raw.columns}")
    ident = F.col(id_key) if id_key else _first(schema, ID_KEYS, F.col)
    lang = _first(schema, LANGUAGE_KEYS, F.col)
    name = spans_key or next((k for k in SPAN_KEYS if k in schema.fieldNames()), None)
    base = raw.where(text.isNotNull())
    if name is not None and isinstance(schema[name].dataType, T.StringType):
        keys = ",".join([*(f"`{k}`:string" for k in LABEL_KEYS), *(f"`{k}`:int" for k in (*START_KEYS, *END_KEYS))])
        base = base.withColumn(name, F.from_json(name, f"array<struct<{keys}>>"))
        schema = base.schema
    if name is None:
        spans = F.array().cast(SPAN_DDL)
    else:
        element = schema[name].dataType.elementType
        as_int = lambda c: F.lit(None).cast("int") if c is None else c.try_cast("int")

        def span(s: Column) -> Column:
            raw_label = _string(_first(element, LABEL_KEYS, lambda k: s[k]))
            a, b = (as_int(_first(element, keys, lambda k: s[k])) for keys in (START_KEYS, END_KEYS))
            fine = F.coalesce(v.lookup_col(raw_label), F.upper(raw_label)) if keep_unmapped else v.lookup_col(raw_label)
            return F.struct(
                X.parent_col(fine).alias("label"), fine.alias("fine_label"), raw_label.alias("raw_label"), a.alias("start"), b.alias("end"), S.slice_text(text.cast("string"), a, b).alias("text"))

        ok = lambda s: F.coalesce(s["label"].isNotNull() & S.in_bounds(s["start"], s["end"], text.cast("string")), F.lit(False))
        spans = F.coalesce(F.filter(F.transform(F.col(name), span), ok), F.array()).cast(SPAN_DDL)
    return base.select(
        F.coalesce(_string(ident), F.col("_row").cast("string")).alias("id"), text.cast("string").alias("text"),
        X.normalize_language(_string(lang)).alias("language"), spans.alias("gold_spans"))


def privacy_mask_dataset(raw: DataFrame, vocab: str | X.Vocab = "records") -> DataFrame:
    return spans_dataset(raw, vocab, text_key="source_text", spans_key="privacy_mask")


def group_span_rows(raw: DataFrame, vocab: str | X.Vocab = "records") -> DataFrame:
    """Records from one row per span (``text, label, start, end`` and perhaps ``id``). An empty label gives its text only.

    Rows group by id, or by text where there is none; a hot text aggregates partially and its spans are a set.
    """
    raw = _row_id(raw)
    ident = F.when(F.col("id") != "", F.col("id")) if "id" in raw.columns else F.lit(None).cast("string")
    rows = raw.select("_row", ident.alias("_id"), "text", *[F.col(c) for c in ("label", "start", "end")])
    span = F.when(F.coalesce(F.col("label"), F.lit("")) != "", F.struct("label", F.col("start").try_cast("int").alias("start"), F.col("end").try_cast("int").alias("end")))
    grouped = rows.groupBy(F.coalesce("_id", "text").alias("_key")).agg(
        F.min("_row").alias("_first"), F.min_by("text", "_row").alias("text"), F.min("_id").alias("id"), F.array_sort(F.collect_set(span)).alias("spans"))
    return spans_dataset(grouped.select(F.coalesce("id", F.col("_first").cast("string")).alias("id"), "text", "spans"), vocab)


def csv_dataset(spark: SparkSession, path: str, vocab: str | X.Vocab = "records") -> DataFrame:
    """CSV or TSV in either form: one row per record with a JSON span column, or one row per span."""
    raw = read_raw(spark, path)
    if "text" not in raw.columns:
        raise ValueError(f"{path}: a text column is required, found {raw.columns}")
    per_span = {"label", "start", "end"} <= set(raw.columns) and "spans" not in raw.columns
    return group_span_rows(raw, vocab) if per_span else spans_dataset(raw, vocab)


def bio_spans(tokens: Column, tags: Column, whitespace: Column | None = None) -> Column:
    """struct<text, spans> of a token and tag list (BIO, BIOES, BILOU). ``I-`` that continues nothing starts a span; a bare label counts as ``I-``. Missing tags
    are outside, missing white space flags are a space."""
    space = F.transform(F.coalesce(whitespace, F.array().cast("array<boolean>")) if whitespace is not None else F.array().cast("array<boolean>"), lambda w: F.coalesce(w, F.lit(True)))
    text = F.array_join(F.transform(tokens, lambda t, i: F.concat(t, F.when(F.coalesce(F.get(space, i), F.lit(True)), F.lit(" ")).otherwise(F.lit("")))), "")
    starts = S.running_starts(F.transform(tokens, lambda t, i: F.length(t) + F.when(F.coalesce(F.get(space, i), F.lit(True)), 1).otherwise(0)))

    def item(t: Column, i: Column) -> Column:
        tag = F.coalesce(F.get(tags, i), F.lit("O"))
        has = tag.rlike("^[BIESLUbieslu][-_].")
        return F.struct(
            F.when(has, F.upper(F.substring(tag, 1, 1))).otherwise(F.lit("I")).alias("prefix"),
            F.when(tag.isin("O", "o", ""), F.lit(None).cast("string")).when(has, F.substring(tag, 3, 10_000)).otherwise(tag).alias("label"), F.length(t).alias("n"))

    placed = F.arrays_zip(F.transform(tokens, item).alias("x"), starts.alias("at"))
    outside = F.struct(F.struct(F.lit("O").alias("prefix"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("n")).alias("x"), F.lit(0).alias("at"))
    zero = F.struct(F.lit(None).cast("string").alias("label"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(open_: Column, p: Column) -> tuple[Column, Column]:
        x, end = p["x"], p["at"] + p["x"]["n"]
        goes_on = x["label"].isNotNull() & open_["label"].eqNullSafe(x["label"]) & x["prefix"].isin("I", "E", "L")
        after = F.struct(x["label"].alias("label"), F.when(goes_on, open_["start"]).otherwise(p["at"]).alias("start"), end.alias("end"))
        return after, F.when(~goes_on & open_["label"].isNotNull(), open_)  # the span that ends before this token

    # one token outside at the end closes the last span
    closed = S.scan(F.concat(placed, F.array(outside)), zero, step, "struct<label:string,start:int,end:int>")
    return F.struct(F.rtrim(text).alias("text"), F.filter(closed, lambda s: s.isNotNull()).alias("spans"))


def bio_dataset(raw: DataFrame, vocab: str | X.Vocab = "records", tokens: str = "tokens", tags: str = "tags", whitespace: str | None = None, tag_names: list[str] | None = None) -> DataFrame:
    """Records from token and tag lists; integer tags are indices into ``tag_names``."""
    tag_col = F.col(tags)
    if tag_names is not None:
        names = F.array(*[F.lit(n) for n in tag_names])
        tag_col = F.transform(tag_col, lambda i: F.get(names, i.cast("int")))
    raw = _row_id(raw).withColumn("_b", bio_spans(F.col(tokens), tag_col, F.col(whitespace) if whitespace else None))
    keys = [F.col(c) for c in ID_KEYS if c in raw.columns]
    ident = F.coalesce(*[k.cast("string") for k in keys], F.col("_row").cast("string"))
    return spans_dataset(raw.select(ident.alias("id"), F.col("_b.text").alias("text"), F.col("_b.spans").alias("spans")), vocab)


def from_texts(texts: DataFrame, text_col: str = "text", order_col: str | None = None, language: str | None = None) -> DataFrame:
    """Unlabelled records ``text-0001 ...`` in the order of ``order_col``; blank texts are left out but keep their number.

    Numbering needs a total order; it runs as a rank per range partition plus the partitions' sizes, never in one task.
    """
    if order_col is None:
        ordered = texts.withColumn("_o", F.monotonically_increasing_id())
    else:
        ordered = texts.withColumn("_o", F.col(order_col)).repartitionByRange("_o").sortWithinPartitions("_o")
    placed = ordered.select(F.col(text_col).alias("text"), "_o", F.spark_partition_id().alias("_p"))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition: a table of some thousand rows at most
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("_p").orderBy("_o"))).join(F.broadcast(sizes.select("_p", "before")), "_p")
    return numbered.where(F.trim("text") != "").select(
        F.format_string("text-%04d", F.col("k") + F.col("before")).alias("id"), "text", F.lit(language).cast("string").alias("language"), F.array().cast(SPAN_DDL).alias("gold_spans"))


@dataclass(frozen=True)
class Dataset:
    """A registered dataset: where it lies and how its rows become records."""

    name: str
    path: str
    loader: Callable[[DataFrame], DataFrame] = spans_dataset
    vocab: str = "records"
    labels: tuple[str, ...] = ()
    revision: str | None = None


DATASETS: dict[str, Dataset] = {}


def register_dataset(dataset: Dataset, replace: bool = False) -> Dataset:
    if dataset.name in DATASETS and not replace:
        raise ValueError(f"dataset {dataset.name!r} is registered already")
    unknown = [x for x in dataset.labels if not X.is_known(x)]
    if unknown:
        raise ValueError(f"unknown labels {unknown}")
    DATASETS[dataset.name] = dataset
    return dataset


def load_dataset(spark: SparkSession, name: str) -> DataFrame:
    found = DATASETS[name]
    return found.loader(read_raw(spark, found.path))
