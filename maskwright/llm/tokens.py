"""Encoding of the whole corpus with a public byte-pair vocabulary (problem 8).

For every prefix of a byte string exactly one token can be the last token of the prefix' encoding.
The encoder fills that table from left to right: among the vocabulary's tokens that end at a position it keeps the one that
may follow the last token of the remaining prefix (no merge of the vocabulary could join across their seam earlier). The encoding is read back from the end. The table makes
appends exact and edits cheap: everything before an edit stays, everything after it is filled only
until the table agrees with the old one again.

The vocabulary's own pre-splitting bounds a prefix table to one piece of text; pieces are cached per
worker, and so are whole stretches between single spaces, whose encoding depends on nothing outside.

Defined results: null and empty texts have the empty list of ids; strings that look like special
tokens are ordinary text; no special tokens are added.
"""

from __future__ import annotations

import ast
import functools
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_DIR = "/opt/tokenizers"
_CACHE = 400_000
MAX_VOCABULARY = 64_000_000
_LONG = 24
_SHORT = (2, 1)


class Vocabulary:
    """Tokens, merges and the seam test of a byte-level vocabulary file (``.json`` of the tokenizers library)."""

    def __init__(self, source: str | bytes) -> None:
        """From the file's path or from its content."""
        model = json.loads(_read(source) if isinstance(source, str) else source)["model"]
        to_byte = {c: b for b, c in _byte_letters().items()}
        ids = model["vocab"]
        self.ids: dict[bytes, int] = {}
        for token, i in ids.items():
            if all(c in to_byte for c in token):
                self.ids[bytes(to_byte[c] for c in token)] = i
        self.pairs: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            joint = ids[left + right]
            self.pairs[ids[left], ids[right]] = joint
            if joint not in self.split:
                self.split[joint] = (ids[left], ids[right])
                self.rank[joint] = r
        self.longest = max(map(len, self.ids))
        # lengths of the tokens that end in the given (up to three) bytes, longest first
        ends: dict[bytes, set[int]] = {}
        for token in self.ids:
            ends.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {
            end: tuple(sorted(ends.get(end, set()) | {n for n in (1, 2) if end[-n:] in self.ids}, reverse=True)) for end in ends if len(end) == 3
        }
        self.seams: dict[tuple[int, int], bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` in an encoding? Undoes the later of the two tokens' merges step by step;
        a pair along the seam that merges before the parts around it were built would have destroyed both."""
        key = (left, right)
        known = self.seams.get(key)
        if known is None:
            if len(self.seams) > 2_000_000:
                self.seams.clear()
            known = self.seams[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        rank, pairs, split = self.rank, self.pairs, self.split
        bound = len(rank) + 1  # merges at or after this rank come too late to matter
        while True:
            joint = pairs.get((left, right))
            if joint is not None and rank[joint] < bound:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                # before the left token was merged, its right part met the seam; an equal merge further left comes first
                bound, left = a, split[left][1]
            else:
                # an equal merge across the seam lies further left and would have come first
                bound, right = b + 1, split[right][0]


def _byte_letters() -> dict[int, str]:
    """The printable letter that the vocabulary file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


class PrefixTable:
    """The last token of every prefix of a byte string, with exact appends and edits."""

    def __init__(self, vocab: Vocabulary, data: bytes = b"") -> None:
        self.vocab = vocab
        self.data = b""
        self.last: list[int] = []  # last[i]: last token of the encoding of data[:i + 1]
        self.size: list[int] = []
        self.append(data)

    def _fill(self, i: int) -> tuple[int, int]:
        vocab, data, last = self.vocab, self.data, self.last
        ids = vocab.ids
        for n in vocab.lengths.get(data[i - 2 : i + 1], _SHORT) if i > 1 else _SHORT:
            if n > i + 1:
                continue
            t = ids.get(data[i + 1 - n : i + 1])
            if t is not None and (n == i + 1 or vocab.fits(last[i - n], t)):
                return t, n
        raise ValueError(f"byte {data[i]} is not in the vocabulary")

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        for i in range(start, len(self.data)):
            t, n = self._fill(i)
            self.last.append(t)
            self.size.append(n)

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Replaces data[start:end]; returns how many prefixes were filled again."""
        old_last, old_size = self.last[end:], self.size[end:]
        self.data, tail = self.data[:start], self.data[end:]
        del self.last[start:], self.size[start:]
        self.append(data)
        self.data += tail
        filled = len(data)
        agree = 0
        for k in range(len(tail)):
            i = start + len(data) + k
            t, n = self._fill(i)
            self.last.append(t)
            self.size.append(n)
            filled += 1
            # once a whole token length of prefixes agrees again, all later ones do
            agree = agree + 1 if (t, n) == (old_last[k], old_size[k]) and k + 1 >= n else 0
            if agree >= self.vocab.longest:
                self.last += old_last[k + 1 :]
                self.size += old_size[k + 1 :]
                break
        return filled

    def ids(self) -> list[int]:
        out: list[int] = []
        i = len(self.data) - 1
        while i >= 0:
            out.append(self.last[i])
            i -= self.size[i]
        return out[::-1]


class Encoder:
    """Texts to ids with the caches described above."""

    def __init__(self, source: str | bytes, pattern: str) -> None:
        self.vocab = Vocabulary(source)
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, list[int]] = {}
        self.stretches: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        ids = self.pieces.get(text)
        if ids is None:
            data = text.encode("utf-8", "surrogatepass")
            ids = PrefixTable(self.vocab, data).ids()
            if len(self.pieces) > _CACHE:
                self.pieces.clear()
            self.pieces[text] = ids
        return ids

    def _stretch(self, text: str) -> list[int]:
        ids: list[int] = []
        for p in self.split(text):
            ids += self.piece(p)
        if len(text) <= _LONG:
            if len(self.stretches) > _CACHE:
                self.stretches.clear()
            self.stretches[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        parts = text.split(" ")
        known = self.stretches
        ids: list[int] = []
        hold = parts[0]  # text not yet encoded; later stretches carry their leading space
        for part in parts[1:]:
            # a cut before the space is safe only between two visible characters
            if part and hold and not part[0].isspace() and not hold[-1].isspace():
                found = known.get(hold)
                ids += self._stretch(hold) if found is None else found
                hold = " " + part
            else:
                hold += " " + part
        found = known.get(hold)
        ids += self._stretch(hold) if found is None else found
        return ids


@functools.cache
def encoder(source: str | bytes, pattern: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(source, pattern)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read(MAX_VOCABULARY + 1)


def token_ids(docs: DataFrame, name: str = "byte_bpe_50k", directory: str = DEFAULT_DIR, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row, null and empty texts included. Reads two columns, no shuffle.

    The vocabulary file is read on the driver and sent to the workers, so only the driver needs the folder; more than ``MAX_VOCABULARY`` bytes raise.
    """
    content, pattern = _read(f"{directory}/{name}.json"), _pattern(directory)
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"{name}.json has more than {MAX_VOCABULARY} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value, pattern).encode
        for batch in batches:
            lists = [encode(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int32, len(lists))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    kind = docs.schema[key_col].dataType.simpleString()
    return docs.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _pattern(directory: str) -> str:
    """The vocabulary's pre-splitting pattern, a constant of the package beside it; read, not run."""
    for node in ast.parse(_read(f"{directory}/__init__.py")).body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "PATTERN" for t in node.targets):
            return str(ast.literal_eval(node.value))
    raise ValueError(f"{directory} states no PATTERN")


def decoded(ids: DataFrame, name: str = "byte_bpe_50k", directory: str = DEFAULT_DIR) -> DataFrame:
    """``doc_id, text`` of id lists: the tokens' bytes in a row. Ids that are not in the vocabulary raise."""
    shared = ids.sparkSession.sparkContext.broadcast(_read(f"{directory}/{name}.json"))
    kind = ids.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {i: t for t, i in _vocabulary(shared.value).ids.items()}
        for batch in batches:
            texts = [b"".join(map(back.__getitem__, row or [])).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


@functools.cache
def _vocabulary(source: bytes) -> Vocabulary:
    return Vocabulary(source)
