"""Splitting oversized items at natural boundaries (problem 7).

A text longer than its limit is cut into atoms: its segments; the sentences of segments that do not fit;
the words of sentences that do not fit; equal parts of words that do not fit. Neighbouring atoms are
then merged bottom-up: a heap holds the adjacent pairs, the weakest boundary goes first, as long as the combined size
plus the overlap fits the limit. What stays apart are the pieces; each but the first is then
extended to the left by up to ``overlap`` code points of the piece before, starting at a word.

Defined results: null texts and texts within the limit are not split (no row); a kind without a limit
row is not split; an overlap of at least the limit is treated as limit - 1; a single atom that fits only without
overlap gets a shorter one. White space between pieces belongs to none; every other code point lies in
a piece. Segments that are null, empty, reversed or out of the text are ignored; the text between segments is an atom of its own.

``cut`` is read from the pieces that the merging leaves: ``segment`` if none of their edges lies inside a segment longer than the limit (then every
segment fits), else ``hard`` if one lies inside a stretch, free of white space and sentence marks, that is longer than the limit, else ``inside``.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentences import sentence_units

# The marks that end a stretch, beside white space.
MARKS = ".!?…。！？।؟"
_STRETCH = re.compile(rf"[^\s{MARKS}]+|[{MARKS}]+")
_SOLID = re.compile(rf"[^\s{MARKS}]+")
_GLUE, _HARD, _WORD, _SENTENCE, _SEGMENT = range(5)

Atom = tuple[int, int, int]  # start, end, strength of the boundary before it


def _words(text: str, a: int, b: int, limit: int, part: int, before: int) -> list[Atom]:
    out: list[Atom] = []
    strength = before
    last = a
    for m in _STRETCH.finditer(text, a, b):
        s, e = m.span()
        if out:
            strength = _WORD if s > last else _GLUE
        last = e
        if e - s <= limit:
            out.append((s, e, strength))
            continue
        for k in range(s, e, part):
            out.append((k, min(k + part, e), strength))
            strength = _HARD
    return out


def atoms(text: str, segments: list[tuple[int, int]], limit: int, overlap: int) -> list[Atom]:
    """The smallest units of a text, each with the strength of the boundary before it."""
    part = max(1, limit - overlap)
    n = len(text)
    ranges: list[tuple[int, int]] = []
    at = 0
    for a, b in sorted(segments):
        a, b = max(a, at), min(b, n)
        if a >= b:
            continue
        if text[at:a].strip():
            ranges.append((at, a))
        ranges.append((a, b))
        at = b
    if text[at:].strip():
        ranges.append((at, n))
    out: list[Atom] = []
    for a, b in ranges:
        piece = text[a:b]
        lead = len(piece) - len(piece.lstrip())
        tail = len(piece.rstrip())
        if lead >= tail:
            continue
        a, b = a + lead, a + tail
        if b - a <= limit:
            out.append((a, b, _SEGMENT))
            continue
        before = _SEGMENT
        for s, e in sentence_units(text[a:b]):
            if e - s <= limit:
                out.append((a + s, a + e, before))
            else:
                out += _words(text, a + s, a + e, limit, part, before)
            before = _SENTENCE
    return out


def merge(parts: list[Atom], limit: int, overlap: int, text: str) -> list[tuple[int, int]]:
    """Agglomerative merging of atoms; returns the bodies of the pieces, without overlap."""
    k = len(parts)
    if not k:
        return []
    start = [p[0] for p in parts]
    end = [p[1] for p in parts]
    nxt = list(range(1, k + 1))
    prv = list(range(-1, k - 1))
    alive = [True] * k
    version = [0] * k

    def key(i: int) -> tuple:
        """The boundary before atom i: strength, blank lines in it, size of the pair."""
        gap = text[end[i - 1] : start[i]]
        return parts[i][2], gap.count("\n"), i

    strength = [key(i)[:2] if i else (0, 0) for i in range(k)]
    heap = [(strength[i], end[i] - start[i - 1], i, 0, 0) for i in range(1, k)]
    heapq.heapify(heap)
    while heap:
        _, _, i, vl, vr = heapq.heappop(heap)
        if not alive[i]:
            continue
        left = prv[i]
        if version[left] != vl or version[i] != vr:
            continue
        size = end[i] - start[left]
        if size + (overlap if left else 0) > limit:
            continue
        end[left] = end[i]
        alive[i] = False
        nxt[left] = nxt[i]
        if nxt[i] < k:
            prv[nxt[i]] = left
        version[left] += 1
        if left:
            heapq.heappush(heap, (strength[left], end[left] - start[prv[left]], left, version[prv[left]], version[left]))
        right = nxt[left]
        if right < k:
            heapq.heappush(heap, (strength[right], end[right] - start[left], right, version[left], version[right]))
    return [(start[i], end[i]) for i in range(k) if alive[i]]


def split_text(text: str, segments: list[tuple[int, int]], limit: int, overlap: int) -> tuple[str, list[tuple[int, int, int]]]:
    """(cut, pieces as (start, end, start of the piece's own text)) of a text longer than the limit."""
    overlap = max(0, min(overlap, limit - 1))
    bodies = merge(atoms(text, segments, limit, overlap), limit, overlap, text)
    out: list[tuple[int, int, int]] = []
    for j, (a, b) in enumerate(bodies):
        s = a
        if j and overlap:
            low = max(bodies[j - 1][0], a - overlap, b - limit)
            s = low
            if low > 0 and low < a and not text[low].isspace() and not text[low - 1].isspace():
                space = re.compile(r"\s").search(text, low, a)
                s = space.end() if space else low
            while s < a and text[s].isspace():
                s += 1
        out.append((s, b, a))
    return _cut_of(bodies, text, segments, limit), out


def _cut_of(bodies: list[tuple[int, int]], text: str, segments: list[tuple[int, int]], limit: int) -> str:
    """The weakest place that the merging was forced to break, from the edges of the pieces' own text."""
    edges = np.unique(np.array(bodies, np.int64))

    def broken(a: int, b: int) -> bool:
        return bool(np.searchsorted(edges, b, side="left") > np.searchsorted(edges, a, side="right"))

    if not any(broken(a, b) for a, b in segments if b - a > limit):
        return "segment"
    for left, right in zip(bodies, bodies[1:]):
        # a stretch longer than the limit is broken between two pieces that touch without white space
        if left[1] == right[0] and _solid_length(text, right[0], limit) > limit:
            return "hard"
    return "inside"


def _solid_length(text: str, at: int, limit: int) -> int:
    """Length of the stretch around a place, looked at up to the limit on either side."""
    sides = text[max(0, at - limit - 1) : at][::-1], text[at : at + limit + 1]
    return sum(m.end() for m in map(_SOLID.match, sides) if m)


_FIELDS = "doc_id {k}, kind string, cut string, pieces array<struct<start:int,end:int,body:int>>"


def split_oversized(docs: DataFrame, limits: DataFrame, key_col: str = "doc_id", text_col: str = "text", kind_col: str = "kind", segments_col: str = "segments") -> DataFrame:
    """One row per document longer than the limit of its kind: ``doc_id, kind, cut, pieces``.

    Only documents beyond their limit leave the JVM. The limits table joins by its key; Spark broadcasts it if it is
    as small as its threshold, and shuffles otherwise.
    """
    key_kind = docs.schema[key_col].dataType.simpleString()
    left = docs.select(
        F.col(key_col).alias("doc_id"), F.col(kind_col).alias("kind"), F.col(text_col).alias("text"),
        F.transform(F.coalesce(F.col(segments_col), F.array()), lambda s: s["start"]).alias("starts"),
        F.transform(F.coalesce(F.col(segments_col), F.array()), lambda s: s["end"]).alias("ends"))
    right = limits.where("max_chars > 0").groupBy("kind").agg(F.min("max_chars").alias("max_chars"), F.coalesce(F.min("overlap_chars"), F.lit(0)).alias("overlap_chars"))
    over = left.join(right, "kind").where(F.length("text") > F.col("max_chars")).select("doc_id", "kind", "text", "starts", "ends", "max_chars", "overlap_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("body", pa.int32())]))
        for batch in batches:
            cuts: list[str] = []
            pieces: list[list[dict]] = []
            for text, starts, ends, limit, overlap in zip(*(batch.column(i).to_pylist() for i in range(2, 7))):
                segments = [(a, b) for a, b in zip(starts, ends) if a is not None and b is not None and 0 <= a < b]
                cut, found = split_text(text, segments, limit, overlap)
                cuts.append(cut)
                pieces.append([{"start": s, "end": e, "body": b} for s, e, b in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cuts, pa.string()), pa.array(pieces, piece_type)], names=["doc_id", "kind", "cut", "pieces"])

    return over.mapInArrow(run, _FIELDS.format(k=key_kind))


# White space as Python sees it, for expressions of the JVM.
_WHITE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u000b\u001c-\u001f\u0085"
BLANK, VISIBLE, TRIMMED = f"[{_WHITE}]+", f"[^{_WHITE}]", f"(?s)^[^{_WHITE}](.*[^{_WHITE}])?$"


def piece_properties(split: DataFrame, docs: DataFrame, limits: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, within_limit, within_overlap, in_order, covered`` of every split document: no piece is longer than the limit, none shares more than the
    allowed overlap with the one before, own texts follow each other, and together they hold every code point that is not white space."""
    p = F.col("pieces")
    own = F.transform(p, lambda x: F.substring(F.col(text_col), x["body"] + 1, x["end"] - x["body"]))
    visible = lambda c: F.regexp_replace(c, BLANK, "")
    bounds = limits.groupBy("kind").agg(F.min("max_chars").alias("max_chars"), F.coalesce(F.min("overlap_chars"), F.lit(0)).alias("overlap_chars"))
    rows = split.join(docs.select(F.col(key_col).alias("doc_id"), text_col), "doc_id").join(bounds, "kind")
    return rows.select(
        "doc_id", F.forall(p, lambda x: x["end"] - x["start"] <= F.col("max_chars")).alias("within_limit"),
        F.forall(p, lambda x: (x["start"] <= x["body"]) & (x["body"] - x["start"] <= F.col("overlap_chars"))).alias("within_overlap"),
        F.forall(F.transform(p, lambda x, i: (i == 0) | (x["body"] >= F.get(p, i - 1)["end"])), lambda ok: ok).alias("in_order"),
        (visible(F.array_join(own, "")) == visible(F.col(text_col))).alias("covered"))
