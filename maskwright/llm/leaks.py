"""Evaluation texts leaking into training text (problem 9).

Held-out passages are normalised and cut into n-grams (12 consecutive words; 24 consecutive letters
and digits for scripts without spaces); their hashes form a broadcast set. Every document is scanned
window by window, hits are verified letter by letter against the passage, and the documents or only
the leaked spans can be removed.

Normalisation: invisible characters vanish; width forms are folded; case is ignored; punctuation, markup signs and white
space only separate words. Positions count code points of the stored text.

Defined results: null and empty texts leak nothing; a passage shorter than the window leaks nowhere;
repeated rows give the same result each; a passage found several times in a document is one pair.
The held-out set goes to the tasks in blocks of at most ``block_chars`` characters, so a broadcast is
never larger, however many items there are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import codepoints as cp

# Languages whose passages are measured in characters.
UNSPACED = ("zh", "ja", "th")
_SUB_CHARS = 400_000
_P = np.uint64(0xD6E8FEB86659FD93)


def _invisible() -> np.ndarray:
    drop = np.zeros(0x110000, bool)
    for c in (*range(0x300), *range(0x600, 0x620), *range(0x180B, 0x1810), *range(0x2000, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)):
        if unicodedata.category(chr(c)) == "Cf" or 0xFE00 <= c <= 0xFE0F or 0x180B <= c <= 0x180F:
            drop[c] = True
    return drop


_DROP = _invisible()


class Normal:
    """A batch of texts: folded code points without invisible ones, their places, word and character views."""

    def __init__(self, texts: list[str]) -> None:
        codes, self.base = cp.joined(texts)
        kind_of, fold_of = cp.tables()
        keep = np.flatnonzero(~_DROP[codes])
        codes = codes[keep]
        self.place = keep
        self.doc_of_char = np.searchsorted(self.base, keep, side="right") - 1
        self.kind = kind_of[codes]
        self.folded = fold_of[codes]
        word = (self.kind != cp.SPACE) & (self.kind != cp.PUNCT)
        word[codes == 0] = False
        self.word = word
        prev = np.concatenate([[False], word[:-1]])
        nxt = np.concatenate([word[1:], [False]])
        self.start = np.flatnonzero(word & ~prev)
        self.end = np.flatnonzero(word & ~nxt) + 1
        self.doc = self.doc_of_char[self.start]

    def word_grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every window of n words inside one text."""
        h = cp.hash_spans(self.folded, self.start, self.end)
        return _windows(h, self.doc, n)

    def char_grams(self, n: int, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters' indices, window starts, hashes) over letters and digits only, of the given texts."""
        mask = self.word if docs is None else self.word & docs[self.doc_of_char]
        at = np.flatnonzero(mask)
        h = (self.folded[at].astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        i, g = _windows(h, self.doc_of_char[at], n)
        return at, i, g

    def text(self, a: int, b: int) -> str:
        return self.folded[a:b].astype("<u4").tobytes().decode("utf-32-le", "replace")


def _windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(m, np.uint64)
    for j in range(n):
        g = g * _P + h[j : j + m]
    ok = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return ok, g[ok]


class ItemSet:
    """N-gram hashes of one block of held-out passages; at most one entry per passage character."""

    def __init__(self, items: list[tuple[int, str, str]], words: int, chars: int) -> None:
        self.words, self.chars = words, chars
        self.word_index = self._index([(i, t) for i, t, lang in items if lang not in UNSPACED], False)
        self.char_index = self._index([(i, t) for i, t, lang in items if lang in UNSPACED], True)

    def _index(self, items: list[tuple[int, str]], by_char: bool) -> tuple[np.ndarray, np.ndarray, list[int], list[tuple]]:
        ids = [i for i, _ in items]
        if not items:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), ids, []
        norm = Normal([t for _, t in items])
        grams: list[tuple] = []
        owner: list[int] = []
        if by_char:
            at, i, g = norm.char_grams(self.chars)
            letters = norm.folded[at]
            for k in i.tolist():
                grams.append(tuple(letters[k : k + self.chars].tolist()))
                owner.append(int(norm.doc_of_char[at[k]]))
        else:
            i, g = norm.word_grams(self.words)
            w = [norm.text(a, b) for a, b in zip(norm.start.tolist(), norm.end.tolist())]
            for k in i.tolist():
                grams.append(tuple(w[k : k + self.words]))
                owner.append(int(norm.doc[k]))
        order = np.argsort(g, kind="stable")
        return g[order], np.asarray(owner, np.int64)[order], ids, [grams[k] for k in order.tolist()]

    def hits(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """Verified (text, item id, first code point, end) windows."""
        norm = Normal(texts)
        out: list[tuple[int, int, int, int]] = []
        keys, owner, ids, grams = self.word_index
        if len(keys):
            i, g = norm.word_grams(self.words)
            for k, lo, hi in _found(keys, g):
                a = int(i[k])
                n = self.words
                seen = tuple(norm.text(x, y) for x, y in zip(norm.start[a : a + n].tolist(), norm.end[a : a + n].tolist()))
                d = int(norm.doc[a])
                base = int(norm.base[d])
                for q in range(lo, hi):
                    if grams[q] == seen:
                        out.append((d, ids[owner[q]], int(norm.place[norm.start[a]]) - base, int(norm.place[norm.end[a + n - 1] - 1]) + 1 - base))
        keys, owner, ids, grams = self.char_index
        if len(keys):
            unspaced = np.bincount(norm.doc_of_char[norm.kind >= cp.HAN], minlength=len(texts)) >= self.chars // 2
            if unspaced.any():
                at, i, g = norm.char_grams(self.chars, unspaced)
                letters = norm.folded[at]
                n = self.chars
                for k, lo, hi in _found(keys, g):
                    a = int(i[k])
                    seen = tuple(letters[a : a + n].tolist())
                    d = int(norm.doc_of_char[at[a]])
                    base = int(norm.base[d])
                    for q in range(lo, hi):
                        if grams[q] == seen:
                            out.append((d, ids[owner[q]], int(norm.place[at[a]]) - base, int(norm.place[at[a + n - 1]]) + 1 - base))
        return out


def _found(keys: np.ndarray, g: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Positions in g whose hash is among the sorted keys, with the range of equal keys. A bitmap of 2^20 bits goes first."""
    if not len(g):
        return
    bits = np.zeros(1 << 20, bool)
    bits[(keys >> np.uint64(44)).astype(np.int64)] = True
    cand = np.flatnonzero(bits[(g >> np.uint64(44)).astype(np.int64)])
    lo = np.searchsorted(keys, g[cand], side="left")
    hi = np.searchsorted(keys, g[cand], side="right")
    for k, a, b in zip(cand.tolist(), lo.tolist(), hi.tolist()):
        if a < b:
            yield k, a, b


def _blocks(items: DataFrame, key: str, text: str, lang: str, block_chars: int) -> Iterator[list[tuple[int, str, str]]]:
    block: list[tuple[int, str, str]] = []
    size = 0
    rows = items.select(key, text, F.lower(F.substring(F.coalesce(F.col(lang), F.lit("")), 1, 2))).distinct()
    for k, t, code in rows.toLocalIterator():
        if not t:
            continue
        block.append((k, t, code))
        size += len(t)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def leak_spans(
    docs: DataFrame, items: DataFrame, words: int = 12, chars: int = 24, block_chars: int = 4_000_000,
    doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", item_lang: str = "lang",
) -> DataFrame:
    """``doc_id, item_id, start_pos, end_pos``: maximal leaked spans, overlapping windows merged. No shuffle."""
    sc = docs.sparkSession.sparkContext
    kind, item_kind = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    fields = f"doc_id {kind}, item_id {item_kind}, start_pos bigint, end_pos bigint"
    source = docs.select(F.col(doc_key).alias("doc_id"), F.col(doc_text).alias("text"))
    parts = []
    for block in _blocks(items, item_key, item_text, item_lang, block_chars):
        shared = sc.broadcast(ItemSet(block, words, chars))
        parts.append(source.mapInArrow(_scanner(shared, fields, to_arrow_type(items.schema[item_key].dataType)), fields))
    if not parts:
        return docs.sparkSession.createDataFrame([], fields)
    return reduce(DataFrame.unionByName, parts)


def _parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, texts) of the texts that are not empty, in parts of about ``_SUB_CHARS``."""
    rows: list[int] = []
    part: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        if t:
            rows.append(i)
            part.append(t)
            size += len(t)
        if size >= _SUB_CHARS:
            yield rows, part
            rows, part, size = [], [], 0
    if part:
        yield rows, part


def _scanner(shared, fields: str, item_type: pa.DataType):  # noqa: ANN001, ANN202
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            out: list[tuple] = []
            for rows, part in _parts(texts):
                spans: dict[tuple[int, int], list[list[int]]] = {}
                for d, item, a, b in sorted(found.hits(part)):
                    runs = spans.setdefault((d, item), [])
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                out.extend((keys[rows[d]], item, a, b) for (d, item), runs in spans.items() for a, b in runs)
            cols = list(zip(*out)) if out else [[]] * 4
            types = [batch.schema.field(0).type, item_type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def leaked_items(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """``doc_id, item_id`` of every document that holds a passage, whole or in part."""
    return leak_spans(docs, items, **options).select("doc_id", "item_id").distinct()


def remove_leaks(docs: DataFrame, spans: DataFrame, mode: str = "span", doc_key: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """The documents without leaked spans (``mode="span"``) or without the documents that hold any (``"document"``)."""
    if mode == "document":
        return docs.join(spans.select(F.col("doc_id").alias(doc_key)).distinct(), doc_key, "left_anti")
    if mode != "span":
        raise ValueError(f"unknown mode {mode!r}")
    cuts = spans.groupBy(F.col("doc_id").alias(doc_key)).agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos"))).alias("_cuts"))
    text = F.col(doc_text)
    zero = F.struct(F.lit("").alias("kept"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, cut):  # noqa: ANN001, ANN202
        gap = F.when(cut["start_pos"] > acc["at"], F.substring(text, (acc["at"] + 1).cast("int"), (cut["start_pos"] - acc["at"]).cast("int"))).otherwise("")
        return F.struct(F.concat(acc["kept"], gap).alias("kept"), F.greatest(acc["at"], cut["end_pos"]).alias("at"))

    folded = F.aggregate("_cuts", zero, step, lambda acc: F.concat(acc["kept"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return docs.join(cuts, doc_key, "left").withColumn(doc_text, F.when(F.col("_cuts").isNull(), text).otherwise(folded)).drop("_cuts")


def cleaned(docs: DataFrame, items: DataFrame, words: int = 12, chars: int = 24, block_chars: int = 4_000_000, doc_key: str = "doc_id", doc_text: str = "text",
            item_key: str = "item_id", item_text: str = "text", item_lang: str = "lang") -> DataFrame:
    """``doc_id, text`` of every row, leaked spans cut out by the scanner that finds them: one pass over the texts, no join.

    Held-out sets of several blocks are scanned block by block; their spans then meet the texts by key (``remove_leaks``).
    """
    blocks = _blocks(items, item_key, item_text, item_lang, block_chars)
    first, more = next(blocks, []), next(blocks, None)
    source = docs.select(F.col(doc_key).alias("doc_id"), F.col(doc_text).alias("text"))
    if more is not None:
        spans = leak_spans(docs, items, words, chars, block_chars, doc_key, doc_text, item_key, item_text, item_lang)
        return remove_leaks(source, spans, doc_key="doc_id", doc_text="text")
    shared = docs.sparkSession.sparkContext.broadcast(ItemSet(first, words, chars))
    kind = docs.schema[doc_key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cuts: dict[int, list[tuple[int, int]]] = {}
            for rows, part in _parts(texts):
                for d, _, a, b in shared.value.hits(part):
                    cuts.setdefault(rows[d], []).append((a, b))
            for i, found in cuts.items():
                kept, at = [], 0
                for a, b in sorted(found):
                    kept.append(texts[i][at:a] if a > at else "")
                    at = max(at, b)
                texts[i] = "".join([*kept, texts[i][at:]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {kind}, text string")
