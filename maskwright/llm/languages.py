"""Language of documents and of mixed-language segments (problem 1).

A linear-chain conditional random field labels the words of a whole document with languages. Its
features are word identity, affixes, character n-grams, script and a lexicon of log-odds; its two
learned transition matrices hold within a sentence unit and across unit boundaries. The posterior of
forward-backward is averaged over each sentence unit; consecutive units of one language form a stretch (``language_stretches``). Words
switched inside a sentence come out as runs of words (``language_words``).

Words inside e-mail addresses and URLs, and numbers, carry no language. Capitalised words after a
unit's first word (often names) count a quarter.

Defined results: null, empty and blank texts and texts without any word have language null,
confidence 0.0 and no stretches. A missing label (null, empty, ``und``) never equals a language.
Without any labelled row no document has a language.
The model is fitted at run time on at most ``train_docs`` labelled rows of at most ``max_train_chars``
code points each (documented bound); everything else runs over all rows and whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codepoints as cp
from .crf import Adam, Layout, forward_backward
from .sampling import lowest_hashes
from .sentences import sentence_units

# The languages of the test material.
LANGUAGES = "en de fr es pt it nl ru uk zh ja th ar hi".split()
_CODE = {x: i for i, x in enumerate(LANGUAGES)}
N_FEATURES = 1 << 16
_SUB_CHARS = 400_000
_CACHE_WORDS = 400_000


def _script(word: str) -> str:
    c = ord(word[0])
    if c < 0x250:
        return "L" if word.isascii() else "l"
    for name, lo, hi in (("C", 0x400, 0x52F), ("A", 0x600, 0x6FF), ("D", 0x900, 0x97F), ("T", 0xE00, 0xE7F), ("K", 0x3040, 0x30FF), ("H", 0x3400, 0x9FFF)):
        if lo <= c <= hi:
            return name
    return "O"


def word_features(word: str) -> np.ndarray:
    """Hashed features of one lower-cased word."""
    w = f"^{word}$"
    feats = ["w" + w, "s" + _script(word)]
    for n in (1, 2, 3):
        feats.append(f"p{w[: n + 1]}")
        feats.append(f"q{w[-n - 1 :]}")
    feats.extend("g" + w[i : i + 2] for i in range(len(w) - 1))
    feats.extend("t" + w[i : i + 3] for i in range(len(w) - 2))
    feats.extend("c" + ch for ch in set(word))
    return np.unique(np.fromiter((zlib.crc32(f.encode()) & (N_FEATURES - 1) for f in feats), np.int64, len(feats)))


@dataclass
class Tokens:
    """Word tokens of a batch of texts with their sentence units."""

    hashes: np.ndarray
    weight: np.ndarray
    unit: np.ndarray  # flat unit index of each token
    doc: np.ndarray
    breaks: np.ndarray
    first_char: np.ndarray
    last_char: np.ndarray
    folded: np.ndarray
    units: list[tuple[int, int, int]] = field(default_factory=list)  # (doc, start, end)

    def word(self, i: int) -> str:
        return self.folded[self.first_char[i] : self.last_char[i]].astype("<u4").tobytes().decode("utf-32-le", "replace")


def tokenize(texts: list[str], units_of: Callable[[str], list[tuple[int, int]]] = sentence_units) -> Tokens:
    """Words of the texts, as runs of letters; scripts without spaces give pieces of 2 (Han, Kana) or 4 (Thai)."""
    codes, starts = cp.joined(texts)
    kind_of, fold_of = cp.tables()
    kind = kind_of[codes]
    folded = fold_of[codes]
    n = len(codes)
    wordlike = (kind == cp.WORD) | (kind >= cp.HAN)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    run_start = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    at = np.arange(n) - run_start
    begin = wordlike & (change | ((kind == cp.HAN) | (kind == cp.KANA)) & (at % 2 == 0) | (kind == cp.THAI) & (at % 4 == 0))
    stop = np.empty(n, bool)
    stop[-1] = True
    stop[:-1] = wordlike[:-1] & (begin[1:] | change[1:])
    s = np.flatnonzero(begin)
    e = np.flatnonzero(stop & wordlike) + 1
    # words of addresses: the stretch without white space holds an at-sign or "://"
    space = (kind == cp.SPACE) | (codes == 0)
    chunk = np.cumsum(space)
    sign = (codes == 0x40) | (codes == 0xFF20)
    if n > 2:
        sign[:-2] |= (codes[:-2] == 0x3A) & (codes[1:-1] == 0x2F) & (codes[2:] == 0x2F)
    bad = np.zeros(int(chunk[-1]) + 1, bool)
    bad[chunk[sign]] = True
    keep = ~(bad[chunk[s]] & (kind[s] == cp.WORD) & (codes[s] < 0x250))
    s, e = s[keep], e[keep]
    units: list[tuple[int, int, int]] = []
    glob: list[int] = []
    for d, (text, base) in enumerate(zip(texts, starts.tolist())):
        for a, b in units_of(text):
            units.append((d, a, b))
            glob.append(base + a)
    unit = np.searchsorted(np.asarray(glob, np.int64), s, side="right") - 1
    ok = unit >= 0
    s, e, unit = s[ok], e[ok], unit[ok]
    doc_of_unit = np.asarray([u[0] for u in units], np.int64)
    doc = doc_of_unit[unit] if len(unit) else np.zeros(0, np.int64)
    breaks = np.empty(len(s), bool)
    if len(s):
        breaks[0] = True
        breaks[1:] = unit[1:] != unit[:-1]
    upper = folded[s] != codes[s]
    weight = np.where(upper & ~breaks, 0.25, 1.0).astype(np.float32)
    return Tokens(cp.hash_spans(folded, s, e), weight, unit, doc, breaks, s, e, folded, units)


@dataclass
class LanguageModel:
    """Everything the executors need; its size is fixed by N_FEATURES and the bounded training sample."""

    weights: np.ndarray
    trans: np.ndarray
    trans_break: np.ndarray
    start: np.ndarray
    lexicon: dict[int, np.ndarray]

    def save(self, path: str) -> None:
        """One file from which ``load`` gives the same model, so that a corpus is fitted once."""
        words = np.array(list(self.lexicon), np.uint64)
        values = np.stack(list(self.lexicon.values())) if self.lexicon else np.zeros((0, len(LANGUAGES)), np.float32)
        np.savez_compressed(path, weights=self.weights, trans=self.trans, trans_break=self.trans_break, start=self.start, words=words, values=values)

    @classmethod
    def load(cls, path: str) -> LanguageModel:
        with np.load(path) as f:
            return cls(f["weights"], f["trans"], f["trans_break"], f["start"], dict(zip(f["words"].tolist(), f["values"])))

    def __post_init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, len(LANGUAGES)), np.float32)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("weights", "trans", "trans_break", "start", "lexicon")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def emissions(self, tokens: Tokens) -> np.ndarray:
        uniq, first, inv = np.unique(tokens.hashes, return_index=True, return_inverse=True)
        if len(self.rows) > _CACHE_WORDS:
            self.__post_init__()
        row = np.empty(len(uniq), np.int64)
        for j, (h, i) in enumerate(zip(uniq.tolist(), first.tolist())):
            r = self.rows.get(h)
            if r is None:
                r = self.rows[h] = len(self.rows)
                if r >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[r] = self.weights[word_features(tokens.word(i))].sum(axis=0)
                lex = self.lexicon.get(h)
                if lex is not None:
                    self.table[r] += lex
            row[j] = r
        return self.table[row[inv]]

    def posteriors(self, tokens: Tokens) -> np.ndarray:
        lengths = np.unique(tokens.doc, return_counts=True)[1] if len(tokens.doc) else np.zeros(0, np.int64)
        post, *_ = forward_backward(
            self.emissions(tokens), Layout(lengths), self.trans, self.start, tokens.breaks, self.trans_break)
        return post


def unit_votes(tokens: Tokens, post: np.ndarray) -> np.ndarray:
    """Weighted sum of the word posteriors of every unit."""
    votes = np.zeros((len(tokens.units), len(LANGUAGES)), np.float64)
    if len(post):
        first = np.flatnonzero(tokens.breaks)
        votes[tokens.unit[first]] = np.add.reduceat(post * tokens.weight[:, None], first, axis=0)
    return votes


def fit(texts: list[str], labels: list[str], iterations: int = 22, rounds: int = 2) -> LanguageModel:
    """Fits the field. Wrong and mixed labels are repaired first: naive-Bayes votes of the lexicon relabel whole units
    a few times, and the votes of each fitted field relabel them again before the next round."""
    tokens = tokenize(texts)
    m = len(LANGUAGES)
    y_doc = np.asarray([_CODE[x] for x in labels], np.int64)
    y = y_doc[tokens.doc] if len(tokens.doc) else np.zeros(0, np.int64)
    uniq, first, inv = np.unique(tokens.hashes, return_index=True, return_inverse=True)
    feats = [word_features(tokens.word(i)) for i in first.tolist()]
    fid = np.concatenate(feats) if feats else np.zeros(0, np.int64)
    wid = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in feats])[:-1]]).astype(np.int64) if feats else np.zeros(0, np.int64)
    lengths = np.unique(tokens.doc, return_counts=True)[1] if len(tokens.doc) else np.zeros(0, np.int64)
    layout = Layout(lengths)
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    model = LanguageModel(
        np.zeros((N_FEATURES, m), np.float32), (np.eye(m) * 6 - 6).astype(np.float32),
        (np.eye(m) * 3 - 3).astype(np.float32), np.zeros(m, np.float32), {})
    if not len(y):
        return model

    def lexicon(y: np.ndarray) -> np.ndarray:
        counts = np.bincount(inv * m + y, minlength=len(uniq) * m).reshape(-1, m) + 0.0
        size = np.bincount(y, minlength=m) + 2000.0
        rate = counts / size + 0.3 / size.mean()  # a word never seen favours no language
        return np.clip(np.log(rate) - np.log(rate).mean(axis=1, keepdims=True), -5, 5).astype(np.float32)

    unit_first = np.flatnonzero(tokens.breaks)
    unit_of = np.cumsum(tokens.breaks) - 1
    occurs = np.bincount(inv)
    for _ in range(4):
        scores = lexicon(y)[inv] * tokens.weight[:, None]
        votes = np.add.reduceat(scores, unit_first, axis=0)
        y = votes.argmax(axis=1)[unit_of]
    order = np.argsort(inv, kind="stable")
    word_first = np.searchsorted(inv[order], np.arange(len(uniq)))
    used = np.unique(fid)
    short = np.searchsorted(used, fid)
    for turn in range(rounds):
        lex = 0.4 * lexicon(y)
        w = np.zeros((len(used), m), np.float32)
        params = {"w": w, "t": model.trans.copy(), "tb": model.trans_break.copy(), "s": model.start.copy()}
        gold_w = np.zeros((len(uniq), m), np.float32)
        np.add.at(gold_w, (inv, y), 1)
        inner = ~tokens.breaks.copy()
        inner[firsts] = False
        edge = tokens.breaks.copy()
        edge[firsts] = False
        gi, ge = np.flatnonzero(inner), np.flatnonzero(edge)
        gold_t = np.bincount(y[gi - 1] * m + y[gi], minlength=m * m).reshape(m, m)
        gold_tb = np.bincount(y[ge - 1] * m + y[ge], minlength=m * m).reshape(m, m)
        gold_s = np.bincount(y[firsts], minlength=m)
        adam = Adam(0.02)
        for _ in range(iterations):
            table = np.add.reduceat(params["w"][short], bounds, axis=0) + lex
            post, _, pt, ptb = forward_backward(
                table[inv], layout, params["t"], params["s"], tokens.breaks, params["tb"], want_pairs=True)
            exp_w = np.zeros((len(uniq), m), np.float32)
            exp_w[:] = np.add.reduceat(np.take(post, order, axis=0), word_first, axis=0)
            diff = (gold_w - exp_w) / np.sqrt(occurs)[:, None]
            grad = np.stack([np.bincount(short, diff[wid, j], minlength=len(used)) for j in range(m)], axis=1)
            adam.step(params, {
                "w": (grad - 0.02 * params["w"]).astype(np.float32),
                "t": (gold_t - pt - 0.1 * params["t"]).astype(np.float32),
                "tb": (gold_tb - ptb - 0.1 * params["tb"]).astype(np.float32),
                "s": (gold_s - post[firsts].sum(axis=0) - 0.1 * params["s"]).astype(np.float32)})
        model = LanguageModel(
            np.zeros((N_FEATURES, m), np.float32), params["t"], params["tb"], params["s"],
            dict(zip(uniq.tolist(), lex)))
        model.weights[used] = params["w"]
        table = np.add.reduceat(params["w"][short], bounds, axis=0) + lex
        post, *_ = forward_backward(table[inv], layout, params["t"], params["s"], tokens.breaks, params["tb"])
        votes = unit_votes(tokens, post)
        y = votes.argmax(axis=1)[tokens.unit]
    return model


def label_language(label: Column) -> Column:
    """The language a label states: its first two letters in lower case; null, empty and ``und`` are missing (null)."""
    low = F.lower(F.trim(label))
    return F.when(low.isNull() | (low == "") | low.startswith("und"), F.lit(None).cast("string")).otherwise(F.substring(low, 1, 2))


def train_on(docs: DataFrame, train_docs: int = 2500, max_train_chars: int = 3000, total: int | None = None,
             text_col: str = "text", label_col: str = "lang", key_col: str = "doc_id") -> LanguageModel:
    """Fits on at most ``train_docs`` labelled rows of at most ``max_train_chars`` code points, chosen by key hash; ``total`` is about the number of labelled rows."""
    rows = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t"), label_language(F.col(label_col)).alias("l")).where(
        F.col("l").isin(LANGUAGES) & (F.length("t") <= max_train_chars) & (F.length(F.trim("t")) > 0))
    sample = lowest_hashes(rows, F.col("k"), train_docs, total=total).select("t", "l").toPandas()
    return fit(sample["t"].tolist(), sample["l"].tolist())


def _sub_batches(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
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


_FIELDS = "doc_id {k}, label string, doc_lang string, doc_confidence double, n_langs int, start_pos bigint, end_pos bigint, lang string, confidence double, n_units int"


def language_stretches(docs: DataFrame, model: LanguageModel, key_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Longest stretches of consecutive sentence units in one language, one row each; documents without any word give one row with null positions.

    Columns: ``doc_id, label`` (normalised, null if missing), ``doc_lang, doc_confidence`` (language of most words),
    ``n_langs``, ``start_pos, end_pos, lang, confidence, n_units`` of the stretch. Reads three columns, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size, see LanguageModel

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            keys, labels, texts = (batch.column(i).to_pylist() for i in range(3))
            done = np.zeros(len(keys), bool)
            out: list[list] = [[] for _ in range(10)]
            for rows, part in _sub_batches(texts):
                tokens = tokenize(part)
                votes = unit_votes(tokens, crf.posteriors(tokens))
                if not crf.lexicon:
                    votes[:] = 0  # fitted on nothing: no language
                total = votes.sum(axis=1)
                best = votes.argmax(axis=1)
                strength = votes.max(axis=1)
                by_doc: dict[int, list[int]] = {}
                for u in np.flatnonzero(total > 0).tolist():
                    by_doc.setdefault(tokens.units[u][0], []).append(u)
                for d, us in by_doc.items():
                    i = rows[d]
                    done[i] = True
                    weight: dict[int, float] = {}
                    runs: list[list] = []
                    for u in us:
                        g = int(best[u])
                        weight[g] = weight.get(g, 0.0) + float(strength[u])
                        if runs and runs[-1][0] == g:
                            runs[-1][2] = tokens.units[u][2]
                            runs[-1][3] += strength[u]
                            runs[-1][4] += total[u]
                            runs[-1][5] += 1
                        else:
                            runs.append([g, tokens.units[u][1], tokens.units[u][2], strength[u], total[u], 1])
                    top = max(weight, key=lambda g: (weight[g], -g))
                    conf = weight[top] / float(sum(total[u] for u in us))
                    for g, a, b, st, to, k in runs:
                        for col, v in zip(out, (keys[i], labels[i], LANGUAGES[top], conf, len(weight), a, b, LANGUAGES[g], float(st / to), k)):
                            col.append(v)
            for i in np.flatnonzero(~done).tolist():
                for col, v in zip(out, (keys[i], labels[i], None, 0.0, 0, None, None, None, None, 0)):
                    col.append(v)
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32()]
            names = [f.split()[0] for f in _FIELDS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    kind = docs.schema[key_col].dataType.simpleString()
    source = docs.select(F.col(key_col).alias("doc_id"), label_language(F.col(label_col)).alias("label"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, _FIELDS.format(k=kind))


_RUNS = "doc_id {k}, start_pos bigint, end_pos bigint, lang string, confidence double, n_words int"


def language_words(docs: DataFrame, model: LanguageModel, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Code-switched text word by word: longest runs of words of one language inside a sentence unit, also where the language changes within the sentence.

    The language of a word is the one of its largest forward-backward marginal; ``confidence`` is the mean of these marginals over the run. Texts without any
    word have no row. Words inside addresses and numbers belong to the run around them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size, see LanguageModel
    kind = docs.schema[key_col].dataType.simpleString()
    names = [f.split()[0] for f in _RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32()]
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows, part in _sub_batches(texts):
                tokens = tokenize(part)
                if not len(tokens.hashes) or not crf.lexicon:
                    continue
                post = crf.posteriors(tokens)
                best = post.argmax(axis=1)
                new = tokens.breaks.copy()
                new[1:] |= best[1:] != best[:-1]
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(best)) - 1
                base = cp.joined(part)[1][tokens.doc[first]]
                n = last - first + 1
                sure = np.add.reduceat(post[np.arange(len(best)), best].astype(np.float64), first) / n
                columns = [
                    tokens.first_char[first] - base, tokens.last_char[last] - base, [LANGUAGES[k] for k in best[first].tolist()], sure, n.astype(np.int32)]
                owners = pa.array([keys[rows[d]] for d in tokens.doc[first].tolist()], batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([owners, *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return docs.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _RUNS.format(k=kind))


def language_cases(stretches: DataFrame) -> DataFrame:
    """Stretches of the documents whose label is missing or wrong or that hold several languages."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("doc_lang")) | (F.col("n_langs") > 1)
    return stretches.where(F.col("start_pos").isNotNull() & wrong)
