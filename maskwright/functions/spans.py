"""Column expressions on spans: overlap, IoU, folds over sorted arrays, splicing, masking, context, tokens.

All folds run inside the JVM on arrays that are sorted by a total order first, so no result depends on the order of partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("fine_label", T.StringType()), T.StructField("raw_label", T.StringType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])
SPANS = T.ArrayType(SPAN)
REDACTED = "*" * 8


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half-open overlap; touching stretches do not overlap."""
    return (a0 < b1) & (b0 < a1)


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    inter = overlap_length(a0, a1, b0, b1)
    return F.coalesce(F.try_divide(inter.cast("double"), (a1 - a0) + (b1 - b0) - inter), F.lit(0.0))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] by code points."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def in_bounds(start: Column, end: Column, text: Column) -> Column:
    return (start >= 0) & (start < end) & (end <= F.length(text))


def within(start: Column, end: Column, length: Column) -> Column:
    """``in_bounds`` where only the length of the text is at hand."""
    return (start >= 0) & (start < end) & (end <= length)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for b = 0."""
    return F.try_divide(a.cast("double"), b)


def f1_of(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str, block: int = 256) -> Column:
    """Outputs of a left-to-right scan over an array: ``step(state, item)`` gives the next state and one output.

    Runs in blocks: an accumulator never holds more than one block's outputs or one entry per block, so that the work is nearly linear
    in the length of the array. Null arrays give null.
    """

    def let(value: Column, use: Callable[[Column], Column]) -> Column:
        # a transform over one element names a value, so that it is computed once
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def cut(xs: Column) -> Column:
        n_blocks = F.greatest(F.ceil(F.size(xs) / block).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(1), n_blocks), lambda k: F.slice(xs, (k - 1) * block + 1, F.lit(block)))

    def inner(state: Column, part: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            after, out = step(acc["state"], x)
            return F.struct(after.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

        return F.aggregate(part, F.struct(state.alias("state"), F.array().cast(f"array<{out_type}>").alias("out")), one)

    def outer(acc: Column, part: Column) -> Column:
        return let(inner(acc["state"], part), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
    return F.flatten(F.aggregate(let(items, cut), start, outer)["out"])


def running_starts(lengths: Column) -> Column:
    """Sum of the entries before each entry."""
    return scan(lengths, F.lit(0), lambda at, n: (at + n, at), "int")


def keep_left_to_right(spans: Column, start: str = "start", end: str = "end") -> Column:
    """Spans of an array sorted by (start, end) that do not start before the end of the last kept one."""
    return F.transform(F.filter(F.arrays_zip(spans.alias("s"), free_of_earlier(spans, start, end).alias("keep")), lambda x: x["keep"]), lambda x: x["s"])


def free_of_earlier(spans: Column, start: str = "start", end: str = "end") -> Column:
    """For each span of an array sorted by (start, end): does it start at or after the end of the last one that did?"""
    return scan(spans, F.lit(-1), lambda cursor, s: (F.when(s[start] >= cursor, s[end]).otherwise(cursor), s[start] >= cursor), "boolean")


def splice(text: Column, parts: Column) -> Column:
    """``text`` with ``parts`` (array of struct<start, end, replacement>, sorted by (start, end)) put in; earlier starts win overlaps."""
    zero = F.struct(F.lit(0).alias("cursor"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        ok = s["start"] >= acc["cursor"]
        return F.struct(
            F.when(ok, s["end"]).otherwise(acc["cursor"]).alias("cursor"),
            F.when(ok, F.concat(acc["out"], slice_text(text, acc["cursor"], s["start"]), F.coalesce(s["replacement"], F.lit("")))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["cursor"] + 1, F.length(text))))


def token_of(label: Column, text: Column, secret: str = "maskwright", length: int = 7) -> Column:
    """Deterministic pseudonymous token: the same label and text give the same ``length`` letters and digits.

    A keyed SHA-256 digest mapped to base 62. Not backed by a vault; different texts can collide (see ``token_collisions``).
    """
    digest = F.sha2(F.concat_ws("\u0001", F.lit(secret), label, text), 256)
    # ten hex digits are below 2^40; the first seven base-62 digits of them
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    parts = []
    for k in range(length):
        d = F.pmod(F.floor(number / F.lit(62**k).cast("bigint")).cast("bigint"), F.lit(62))
        parts.append(F.substring(F.lit(letters), (d + 1).cast("int"), F.lit(1)))
    return F.concat(*parts)


def context(text: Column, start: Column, end: Column, width: int = 30, marks: tuple[str, str] | None = ("⟦", "⟧")) -> Column:
    """The span with ``width`` code points on either side, marked, with ellipses where text was left out."""
    lo = F.greatest(start - width, F.lit(0))
    hi = F.least(end + width, F.length(text))
    a, b = marks or ("", "")
    return F.concat(
        F.when(lo > 0, "…").otherwise(""), slice_text(text, lo, start), F.lit(a), slice_text(text, start, end), F.lit(b),
        slice_text(text, end, hi), F.when(hi < F.length(text), "…").otherwise(""))


def nothing_left(text: Column) -> Column:
    """Is there no letter or digit once placeholders like [PERSON] are taken out?"""
    return ~F.regexp_replace(text, r"\[[A-Z_]+\]", "").rlike(r"[\p{L}\p{N}]")


def regex_spans(text: Column, pattern: str, label: str, raw: str) -> Column:
    """All matches of a pattern as spans with code-point offsets, without a UDF.

    The pieces between matches and the matches themselves give the offsets by running lengths.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.transform(hits, lambda h, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), h.alias("hit")))

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + p["gap"]
        end = start + F.length(p["hit"])
        return end, F.struct(
            F.lit(label).alias("label"), F.lit(label).alias("fine_label"), F.lit(raw).alias("raw_label"), start.alias("start"), end.alias("end"), p["hit"].alias("text"))

    return scan(pairs, F.lit(0), step, SPAN.simpleString())
