"""Documents: line segments, chunks with offsets, rebuilding, location of spans in segments, interval unions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.functions import spans as S


def normalise_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def line_segments(df: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """``doc_id, line, start, end``: one row per non-blank line, lines counted from 1 with blank ones. Offsets are running sums of the lines' lengths."""
    cut = df.select(F.col(key_col).alias("doc_id"), F.split(normalise_newlines(F.col(text_col)), "\n", -1).alias("lines"))
    cut = cut.withColumn("at", S.running_starts(F.transform("lines", lambda x: F.length(x) + 1)))
    flat = cut.select("doc_id", F.posexplode(F.arrays_zip("at", F.col("lines").alias("t"))).alias("i", "x"))
    return flat.where(F.trim(F.col("x.t")) != "").select("doc_id", (F.col("i") + 1).alias("line"), F.col("x.at").alias("start"), (F.col("x.at") + F.length("x.t")).alias("end"))


def chunk_ranges(text: str, segments: list[tuple[int, int]], max_chars: int) -> list[tuple[int, int]]:
    """Contiguous ranges that cover the text, each at most ``max_chars`` long.

    A range ends at the last segment boundary in reach; a segment that is too long itself is cut after its last line break, sentence end or space in
    reach, else at the limit. White space is no range of its own while a neighbour has room: it leads the next segment, and if both do not fit
    together, it trails the range before; at the end of the text it trails the last range.
    """
    if max_chars < 1:
        raise ValueError("max_chars must be at least 1")
    n = len(text)
    stops = np.unique([x for s in segments for x in s if 0 < x < n] + [n])
    cuts = [0]

    def boundary(after: int, limit: int) -> int | None:
        """The last segment boundary in (after, limit]."""
        k = int(np.searchsorted(stops, limit, side="right"))
        return int(stops[k - 1]) if k and stops[k - 1] > after else None

    def stretch(to: int) -> None:
        """Blanks up to ``to`` go to the range before if it has room, else they are a range."""
        if len(cuts) > 1 and to - cuts[-2] <= max_chars:
            cuts[-1] = to
        else:
            cuts.append(to)

    while cuts[-1] < n:
        at = cuts[-1]
        limit = at + max_chars
        seen = _VISIBLE.search(text, at)
        body = seen.start() if seen else n
        if body == n and n - at <= max_chars:
            stretch(n)
        elif body == n and len(cuts) > 1 and n - cuts[-2] <= max_chars:
            cuts[-1] = n
        elif limit >= n:
            cuts.append(n)
        else:
            lead = body if body < limit else at
            end = boundary(lead, limit)
            if end is None and lead > at and boundary(lead, lead + max_chars) is not None:
                stretch(lead)
            else:
                cuts.append(end or _soft(text, lead, limit))
    return list(zip(cuts, cuts[1:]))


_VISIBLE = re.compile(r"\S")


def _soft(text: str, after: int, limit: int) -> int:
    """Just behind the last line break, else sentence end, else space in (after, limit]; else the limit."""
    behind = (text.rfind(mark, after, limit) + len(mark) if mark in text[after:limit] else 0 for mark in ("\n", ". ", " "))
    return next((p for p in behind if p > after), limit)


def chunks(df: DataFrame, max_chars: int = 4000, key_col: str = "doc_id", text_col: str = "text", segments_col: str | None = "segments") -> DataFrame:
    """``doc_id, k, offset, text``: chunks of all documents. Greedy packing is sequential, so it runs over Arrow batches; no shuffle."""
    kind = df.schema[key_col].dataType.simpleString()
    bounds = "array<struct<start:int,end:int>>"
    segs = F.transform(segments_col, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).cast(bounds) if segments_col else F.lit(None).cast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text:
                    good = [(s["start"], s["end"]) for s in own or [] if s is not None and s["start"] is not None and s["end"] is not None]
                    for k, (a, b) in enumerate(chunk_ranges(text, good, max_chars)):
                        rows.append((key, k, a, text[a:b]))
            cols = list(zip(*rows)) if rows else [[]] * 4
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "k", "offset", "text"])

    return df.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("text"), segs.alias("segs")).mapInArrow(run, f"doc_id {kind}, k int, offset int, text string")


def rebuild(pieces: DataFrame) -> DataFrame:
    """``doc_id, text, complete``: texts from chunks in any order; ``complete`` is false where offsets do not continue.

    The check is a running comparison inside the document's own sorted array.
    """
    lists = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("offset", "text"))).alias("p"))
    good = F.forall(F.transform("p", lambda x, i: F.when(i == 0, x["offset"] == 0).otherwise(
        x["offset"] == F.get(F.col("p"), i - 1)["offset"] + F.length(F.get(F.col("p"), i - 1)["text"]))), lambda b: b)
    return lists.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), good.alias("complete"))


def locate(start: Column, end: Column, segments: Column) -> Column:
    """Segments that a span touches; a zero-width one is located by containment."""
    return F.filter(segments, lambda s: F.when(start == end, (s["start"] <= start) & (start < s["end"])).otherwise((s["start"] < end) & (s["end"] > start)))


def _moved(records: DataFrame, spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans of chunk records shifted to their document, with the segments they touch as ``found``."""
    own = records.where("doc_id is not null and offset is not null").select("id", "doc_id", "offset").distinct()
    moved = spans.join(own, "id").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"), "label").distinct()
    placed = moved.join(documents.select("doc_id", "segments"), "doc_id")
    return placed.select("doc_id", "start", "end", "label", locate(F.col("start"), F.col("end"), F.col("segments")).alias("found"))


def chunk_spans_to_documents(records: DataFrame, spans: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, start, end, label, n_segments, segment_start``: spans of chunk records in their document, with the segments they touch."""
    return _moved(records, spans, documents).select(
        "doc_id", "start", "end", "label", F.size("found").alias("n_segments"), F.try_element_at("found", F.lit(1))["start"].alias("segment_start"))


def format_where(where: Column) -> Column:
    """A place in words: ``page 3``, ``line 2, part body``; keys in order."""
    pairs = F.array_sort(F.map_entries(where))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(" "), e["value"])), ", ")


def span_places(records: DataFrame, spans: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, start, end, label, segment, place``: one row per segment a span touches, the place in words; ``segment`` counts those of one span from 1."""
    flat = _moved(records, spans, documents).select("doc_id", "start", "end", "label", F.posexplode("found").alias("k", "s"))
    return flat.select("doc_id", "start", "end", "label", (F.col("k") + 1).alias("segment"), format_where(F.col("s.where")).alias("place"))


def interval_union(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Union of overlapping intervals per key (touching ones stay apart): gaps and islands, one window per key."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    seen = rows.select(*keys, "start", "end").distinct().withColumn("top", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = seen.withColumn("island", F.sum(F.when(F.col("top").isNull() | (F.col("start") >= F.col("top")), 1).otherwise(0)).over(w))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def document_map(fixtures: DataFrame) -> DataFrame:
    """``doc_id, n_chunks, length``: what is known of a document from its chunk records (repeated rows count once)."""
    once = fixtures.where("doc_id is not null").select("id", "doc_id", "offset", F.length("text").alias("n"), F.xxhash64("text", "language", "gold_spans").alias("h")).distinct()
    return once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.col("offset") + F.col("n")).alias("length"))
