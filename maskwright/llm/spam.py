"""Keyword-stuffed and link-list pages (problem 10).

Corpus counts of neighbouring words give each collocation its pointwise mutual information ``log(n(xy) N / (n(x.) n(.y)))``, at
least 0. It counts as far as the pair prefers its order: listed words come in either order alike, words of sentences do not, so the
information is multiplied by ``1 - min(n(xy), n(yx)) / max(n(xy), n(yx))``. A stretch of text is marked where the mean over a window of neighbouring words is
below ``salad`` times the mean of the corpus (word salad), or where the same collocation keeps coming back within a few dozen words
(excessive repetition: link lists, product tags). What a repeated collocation says counts less by ``stale``, so that both signs add up. A page is flagged if the marked words hold most of the
characters of all its words.

Words are runs of letters and digits of any length. Links, e-mail addresses, numbers and hash tags count as one word each by class; scripts without
spaces are cut into pieces of two (Han), three (Kana) or six (Thai) letters. The cuts inside an unbroken run are arbitrary, so pieces that touch
say nothing about coherence (they count as the corpus mean) but do count as repetition; listed words are set apart by blanks or marks. Collocations seen
fewer than ``rare`` times count as the corpus mean, too: odd or unreadable characters make no case.

In texts of fewer than ``min_words`` words a mean over a window says too little about incoherence, so only collocations that
occur three times mark there, and every pair of neighbouring links or tags. Short pages of different keywords that do not repeat are therefore not found.

Defined results: null, empty and blank texts and texts of a single word are not flagged and have score null; repeated rows give the same result each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.session import cut_lineage

_UNSPACED = "぀-ヿ㐀-鿿฀-๿"
# words of a stretch without white space; links and addresses are recognised before. More than twenty digits are no number
_TOKEN = re.compile(
    r"(?P<tag>#\w+)|[぀-ヿ]{1,3}|[㐀-鿿]{1,2}|[฀-๿]{1,6}"
    rf"|(?P<number>[$€£]?\d{{1,20}}(?:[.,:]\d{{1,20}})*(?![^\W_{_UNSPACED}]))|[^\W_{_UNSPACED}]+")
_SPLIT = re.compile(r"[()\[\]<>|、。，]+")
_HOST = re.compile(r"(?:https?://|www\.)|[a-zA-Z0-9.-]*\.[a-zA-Z0-9-]+/")
_LINK, _MAIL, _NUMBER, _TAG = 1, 2, 3, 4
_MARGIN = 4  # neighbours on either side of a smoothing window
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CACHE = 500_000
Words = tuple[list[int], list[int], list[bool]]  # codes, lengths, does the word touch the one before?


def _code(m: re.Match[str]) -> int:
    """A class for numbers and tags; else a hash of the lower-cased word."""
    if m.lastgroup:
        return _TAG if m.lastgroup == "tag" else _NUMBER
    low = m.group().lower().encode()
    return (zlib.crc32(low) << 16 ^ zlib.adler32(low)) & 0xFFFFFFFFFFFF | 8


def _analyse(stretch: str) -> Words:
    out: Words = ([], [], [])

    def add(code: int, length: int, touches: bool = False) -> None:
        for column, v in zip(out, (code, length, touches)):
            column.append(v)

    for part in _SPLIT.split(stretch) if not stretch.isalnum() else [stretch]:
        if "@" in part:
            add(_MAIL, len(part))
        elif "/" in part and _HOST.match(part) or part.startswith("www."):
            add(_LINK, len(part))
        else:
            last = -1
            for m in _TOKEN.finditer(part):
                add(_code(m), m.end() - m.start(), m.start() == last)
                last = m.end()
    return out


class _Words:
    """Codes of words, cached per worker by stretch of text without white space."""

    def __init__(self) -> None:
        self.cache: dict[str, Words] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, lengths, touching) of a text's words; neighbouring numbers are one word."""
        cache = self.cache
        if len(cache) > _CACHE:
            cache.clear()
        columns: Words = ([], [], [])
        for stretch in (text or "").split():
            found = cache.get(stretch)
            if found is None:
                found = _analyse(stretch)
                if len(stretch) < 40:
                    cache[stretch] = found
            for column, more in zip(columns, found):
                column += more
        c, n, t = np.array(columns[0], np.int64), np.array(columns[1], np.int64), np.array(columns[2], bool)
        if len(c) > 1:
            keep = np.concatenate([[True], (c[1:] != _NUMBER) | (c[:-1] != _NUMBER)])
            if not keep.all():
                n = np.add.reduceat(n, np.flatnonzero(keep))
                c, t = c[keep], t[keep]
        return c, n, t


def pair_codes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One 64-bit code for each pair of words."""
    h = x.astype(np.uint64) * _MIX1 ^ (y.astype(np.uint64) + _MIX2) * _MIX2
    return (h ^ (h >> np.uint64(31))).astype(np.int64)


def collocation_counts(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of all neighbouring words that do not touch: ``pair, x, y, n``; summed inside each task before the only shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            x, y = np.concatenate(held, axis=1)
            u, first, n = np.unique(pair_codes(x, y), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(x[first]), pa.array(y[first]), pa.array(n.astype(np.int64))], names=["pair", "x", "y", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                codes, _, touching = words(text)
                if len(codes) > 1:
                    apart = ~touching[1:]
                    held.append(np.stack([codes[:-1][apart], codes[1:][apart]]))
                    size += len(codes)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    parts = pages.select(text_col).mapInArrow(run, "pair bigint, x bigint, y bigint, n bigint")
    return parts.groupBy("pair", "x", "y").agg(F.sum("n").alias("n"))


def collocation_scores(counts: DataFrame, rare: int = 3) -> DataFrame:
    """``pair, n, score`` of every collocation that is not rare: pointwise mutual information, times its preference of order. ``counts`` is read five
    times, so it should be written before."""
    left = counts.groupBy("x").agg(F.sum("n").alias("nx"))
    right = counts.groupBy("y").agg(F.sum("n").alias("ny"))
    total = counts.agg(F.sum("n")).first()[0] or 1  # one number of the counts as written
    turned = counts.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("n").alias("back"))
    often = counts.where(F.col("n") >= rare).join(turned, ["x", "y"], "left").join(left, "x").join(right, "y")
    log = lambda c: F.log(F.col(c).cast("double"))
    pmi = F.greatest(log("n") + F.log(F.lit(float(total))) - log("nx") - log("ny"), F.lit(0.0))
    back = F.coalesce("back", F.lit(0))
    order = 1 - F.least("n", back) / F.greatest("n", back)
    return often.select("pair", "n", (pmi * order).alias("score"))


_LISTED = np.concatenate([pair_codes(np.array([a]), np.array([b])) for a in (_LINK, _TAG) for b in (_LINK, _TAG)])
_WINDOW = np.ones(2 * _MARGIN + 1) / (2 * _MARGIN + 1)


def _smooth(x: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, _MARGIN, mode="edge"), _WINDOW, "valid")


def repeats(pair: np.ndarray, reach: int = 40) -> np.ndarray:
    """1.0 where the same collocation occurs again at most ``reach`` words before or after."""
    order = np.argsort(pair, kind="stable")
    out = np.zeros(len(pair))
    near = (pair[order[1:]] == pair[order[:-1]]) & (order[1:] - order[:-1] <= reach)
    out[order[1:][near]] = 1.0
    out[order[:-1][near]] = 1.0
    return out


@dataclass(frozen=True)
class Rule:
    """What marks a window: mean information below ``below`` (the corpus mean is ``mean``), or a share of repetition above ``repetition``."""

    mean: float
    below: float
    repetition: float
    stale: float
    min_words: int

    def signs(self, pair: np.ndarray) -> np.ndarray:
        """Per pair 1 if marked by repetition, plus 2 if it occurs again near by."""
        again = repeats(pair)
        return (self._repeated(pair, again) + 2 * again).astype(np.uint8)

    def _repeated(self, pair: np.ndarray, again: np.ndarray) -> np.ndarray:
        """Pairs marked by repetition; in fewer than ``min_words`` words also neighbouring links and tags."""
        if len(pair) + 1 < self.min_words:
            _, kind, n = np.unique(pair, return_inverse=True, return_counts=True)
            return (_smooth((n[kind] >= 3).astype(float)) > self.repetition) | np.isin(pair, _LISTED)
        return _smooth(again) > self.repetition

    def judge(self, score: np.ndarray, signs: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
        """(mean information, share of the words' characters in marked stretches) of a page."""
        repeated = (signs & 1).astype(bool)
        fresh = score * (1 - self.stale * (signs >> 1))
        marked = repeated if len(score) + 1 < self.min_words else repeated | (_smooth(fresh) < self.below)
        return float(score.mean()), float((weight * marked).sum() / weight.sum())


def score_pages(
    pages: DataFrame, key_col: str = "doc_id", text_col: str = "text", salad: float = 0.62, repetition: float = 0.85, stale: float = 0.3,
    rare: int = 3, min_words: int = 12, most_pairs: int = 2_000_000,
) -> DataFrame:
    """``doc_id, coherence, marked`` of every page.

    The score table goes to the tasks as two sorted arrays if it has at most ``most_pairs`` rows (24 MB, counted before);
    beyond that each page's collocations meet it in a shuffle join, and the pages are put together again by sorting. Both give the same rows.
    """
    kind = pages.schema[key_col].dataType.simpleString()
    counts = cut_lineage(collocation_counts(pages, text_col))  # one pass over the texts; the scores read the counts four times
    scores = cut_lineage(collocation_scores(counts, rare))
    size, mean = scores.agg(F.count(F.lit(1)), F.try_divide(F.sum(F.col("n") * F.col("score")), F.sum("n"))).first()
    rule = Rule(mean or 0.0, salad * (mean or 0.0), repetition, stale, min_words)
    source = pages.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = f"doc_id {kind}, coherence double, marked double"
    return (_score_in_place if size <= most_pairs else _score_by_join)(source, scores.select("pair", "score"), fields, rule)


def _result(keys: list, key_type: pa.DataType, found: list[tuple[float, float] | None]) -> pa.RecordBatch:
    columns = [[f[i] if f else None for f in found] for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(c, pa.float64()) for c in columns)], names=["doc_id", "coherence", "marked"])


def _page(words: _Words, text: str | None, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(pair codes, pairs apart, signs of repetition, weights) of a page with at least two words."""
    codes, lengths, touching = words(text)
    if len(codes) < 2:
        return None
    pair = pair_codes(codes[:-1], codes[1:])
    return pair, ~touching[1:], rule.signs(pair), (lengths[:-1] + lengths[1:]).astype(np.int32)


def _score_in_place(source: DataFrame, scores: DataFrame, fields: str, rule: Rule) -> DataFrame:
    table = scores.toPandas().sort_values("pair")
    shared = source.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["score"].to_numpy(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        words = _Words()
        for batch in batches:
            found: list[tuple[float, float] | None] = []
            for text in batch.column(1).to_pylist():
                page = _page(words, text, rule)
                if page is None:
                    found.append(None)
                    continue
                pair, apart, signs, weight = page
                score = np.full(len(pair), rule.mean)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                    hit = (keys[at] == pair) & apart
                    score[hit] = values[at[hit]]
                found.append(rule.judge(score, signs, weight))
            yield _result(batch.column(0).to_pylist(), batch.schema.field(0).type, found)

    return source.mapInArrow(run, fields)


def _score_by_join(source: DataFrame, scores: DataFrame, fields: str, rule: Rule) -> DataFrame:
    """The same without a broadcast.

    Every page gives one head row (its weights and marks, five bytes a pair) and one row per pair that may have a score. Pairs meet their scores,
    those without one are dropped, and the rows of a page come together, in order, by one more shuffle and a sort; pages are then judged from the sorted
    rows as they stream by. Rows of a page are numbered by task and place, so repeated keys stay apart.
    """
    kind = fields.split()[1].rstrip(",")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = _page(words, text, rule)
                pair, apart, signs, weight = page or (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint8), np.zeros(0, np.int32))
                at = np.flatnonzero(apart)
                n = len(at)
                head = weight.tobytes() + signs.tobytes()
                # a head meets no score: its code only spreads it over the partitions
                spread = np.array([(number * 0x9E3779B97F4A7C15 + 1) & 0x7FFFFFFFFFFFFFFF], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n + 1, number)), pa.array(np.concatenate([[-1], at]).astype(np.int32)), pa.array(np.concatenate([spread, pair[at]])),
                    pa.array([key] + [None] * n, key_type), pa.array([head] + [None] * n, pa.binary())], names=["row", "at", "pair", "doc_id", "head"])
                number += 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def judged(done: pa.Table, key_type: pa.DataType) -> pa.RecordBatch:
            row, at, score = (done.column(c).to_numpy() for c in ("row", "at", "score"))
            heads = np.flatnonzero(at < 0)
            ends = np.append(heads[1:], len(row))
            keys = done.column("doc_id").take(pa.array(heads)).to_pylist()
            bodies = done.column("head").take(pa.array(heads)).to_pylist()
            found: list[tuple[float, float] | None] = []
            for a, b, body in zip(heads.tolist(), ends.tolist(), bodies):
                n = len(body) // 5
                x = np.full(n, rule.mean)
                x[at[a + 1 : b]] = score[a + 1 : b].astype(np.float32)
                found.append(rule.judge(x, np.frombuffer(body, np.uint8, n, 4 * n), np.frombuffer(body, np.int32, n)) if n else None)
            return _result(keys, key_type, found)

        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column("row").to_numpy()
            key_type = batch.schema.field("doc_id").type
            if last is not None and row[-1] != last or last is None and row[0] != row[-1]:
                cut = int(np.searchsorted(row, row[-1]))  # the last page may go on in the next batch
                done = pa.Table.from_batches([*held, batch.slice(0, cut)])
                if done.num_rows:
                    yield judged(done, key_type)
                held = [batch.slice(cut)]
            else:
                held.append(batch)
            last = row[-1]
        if held:
            yield judged(pa.Table.from_batches(held), held[0].schema.field("doc_id").type)

    pairs = source.mapInArrow(rows, f"row bigint, at int, pair bigint, doc_id {kind}, head binary")
    met = pairs.join(scores, "pair", "left").where("score is not null or at < 0").select("row", "at", "score", "doc_id", "head")
    return met.repartition("row").sortWithinPartitions("row", "at").mapInArrow(fold, fields)


def stuffed_pages(pages: DataFrame, most: float = 0.52, **options: object) -> DataFrame:
    """Keys of the pages most of whose characters are keywords, links or tags."""
    return score_pages(pages, **options).where(F.col("marked") > most).select("doc_id")
