"""Personal information inside free text (problem 2).

A linear-chain conditional random field over word shapes, decoded by Viterbi in numpy batches, marks
e-mail addresses, phone numbers, identity numbers, street addresses and names. It is trained at run time from a
small labelled table (``train_requests`` rows, a documented bound); the table may be noisy, so after a
first fit its labels are replaced by the field's own best path and the field is fitted again.

The text is read through a view in which width forms, spaces, invisible characters and look-alike letters
are plain; positions always refer to the stored text. An exact check follows the field: a marked stretch
must have the form of its label, and its ends are moved to the ends of that form.

Defined results: null and empty texts have no mentions and are returned unchanged; an empty labelled table gives a field that marks nothing; mentions never overlap; texts are
processed whole. Labels: EMAIL, PHONE, GOV_ID, STREET_ADDRESS, PERSON.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crf import Adam, Layout, forward_backward, viterbi
from .lookalikes import SAME_SHAPE, _simple
from .sampling import lowest_hashes

# Labels, and the coarse labels of the labelled table that stand for them.
LABELS = ["EMAIL", "PHONE", "GOV_ID", "STREET_ADDRESS", "PERSON"]
COARSE = {"EMAIL": "EMAIL", "PHONE": "PHONE", "ACCOUNT": "GOV_ID", "ADDRESS": "STREET_ADDRESS", "PERSON": "PERSON"}
TAGS = ["O", *(f"{p}-{x}" for x in LABELS for p in "BI")]
N_TAGS = len(TAGS)
N_FEATURES = 1 << 18
_SUB_TOKENS = 60_000

_TOKEN = re.compile(r"[㐀-鿿぀-ヿ々]|[^\W\d_㐀-鿿぀-ヿ]+|\d+|\S")
_EMAIL = re.compile(
    r"[A-Za-z0-9][A-Za-z0-9._+-]*(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\sat\s)[A-Za-z0-9-]+"
    r"(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[A-Za-z0-9-]+)+", re.I)
_NUMBERS = re.compile(r"[+(]?\d(?:[\d ().\-/]*\d)?")
_CODE = re.compile(r"[A-Za-z0-9]+(?:[.\-/ ][A-Za-z0-9]+)*")
_FIELD_NAME = re.compile(r"[^\W\d_]{1,12}\s?[=:：]\s?|[^\W\d_㐀-鿿]{0,3}[㐀-鿿]{1,8}\W?[是为：]\W?")  # "id=", "Home: ", "身份证号是"
_CHUNK = re.compile(r"\S+")
_NO_NUMBER = re.compile(r"(?<=[㐀-鿿])[，,、]\s?[㐀-鿿]{1,4}\Z")
_CJK = re.compile(r"[㐀-鿿぀-ヿ]")
# Titles in front of names.
TITLES = frozenset("""
mr mrs ms miss dr prof sir madam hr herr frau m mme mlle monsieur madame sr sra srta don doña dña sig sig.ra signor
signora dott dott.ssa exmo exma senhor senhora dhr mevr mw mevrouw meneer г-н г-жа господин госпожа
""".split())
# Small words inside names.
PARTICLES = frozenset("van der den de ter ten von zu zur da do dos das del della di la le d e y".split())


@functools.cache
def _plain(ch: str) -> str:
    """The view of one code point: canonical decompositions stay composed."""
    if ch in SAME_SHAPE:
        return SAME_SHAPE[ch] if not ("Ѐ" <= ch <= "ӿ" or "Ͱ" <= ch <= "Ͽ") else ch
    if ch in "\n\t":
        return ch
    import unicodedata

    d = unicodedata.decomposition(ch)
    if d and d[0] != "<" or "가" <= ch <= "힣":
        return ch
    out = _simple(ch)
    return ch if out is None else out


_MIXED = re.compile(r"[A-Za-zÀ-ɏ][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-zÀ-ɏ]")


def view(text: str) -> tuple[str, list[int] | None]:
    """(plain view, place of each of its characters in the text); None if they are the same."""
    if text.isascii():
        return text, None
    chars: list[str] = []
    places: list[int] = []
    for i, ch in enumerate(text):
        p = ch if ch.isascii() else _plain(ch)
        for x in p:
            chars.append(x)
            places.append(i)
    # look-alike letters count only inside words of the other script
    out = "".join(chars)
    if _MIXED.search(out):
        for m in re.finditer(r"[^\W\d_]+", out):
            w = m.group()
            latin = sum("a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ɏ" for c in w)
            if 0 < latin < len(w) and all(c in SAME_SHAPE or c < "ɐ" for c in w):
                chars[m.start() : m.end()] = [SAME_SHAPE.get(c, c) for c in w]
        out = "".join(chars)
    return out, places


def _shape(w: str) -> str:
    c = w[0]
    if c.isdigit():
        return "0" * min(len(w), 6)
    if not c.isalpha():
        return c
    o = ord(c)
    script = "L" if o < 0x250 else "C" if 0x370 <= o < 0x530 else "H" if o >= 0x3400 else "K" if o >= 0x3040 else "o"
    case = "1" if len(w) == 1 else "2" if len(w) == 2 else "n"
    if script in "HK":
        return script
    if w.isupper():
        return script + "A" + case
    if c.isupper():
        return script + "a" + case
    return script + "x" + case


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


@functools.lru_cache(maxsize=300_000)
def _word(w: str) -> tuple[int, int, int, int]:
    """Hashes of a token: word, shape, prefix, suffix."""
    low = w.lower()
    if low[0].isdigit():
        low = "0" * min(len(low), 9)
    return _h("w" + low), _h("s" + _shape(w)), _h("p" + low[:3]), _h("q" + low[-3:])


@functools.lru_cache(maxsize=100_000)
def _form(s: str) -> int:
    """Hash of the form of a stretch: digits to 0, runs of letters to a or A."""
    s = re.sub(r"\d", "0", s)
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m.group().isupper() else "a", s)
    return _h("f" + s)


@dataclass
class Encoded:
    """Tokens of a batch of texts."""

    spans: list[list[tuple[int, int]]]
    features: np.ndarray  # tokens x features
    lengths: np.ndarray


_SALT = [np.uint64(x * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1) for x in range(1, 40)]


def encode(views: list[str]) -> Encoded:
    """Hashed features of all tokens; windows never cross texts."""
    spans: list[list[tuple[int, int]]] = []
    cols: list[tuple[int, int, int, int]] = []
    chunk: list[int] = []
    number: list[int] = []
    mail: list[int] = []
    for t in views:
        s = [m.span() for m in _TOKEN.finditer(t)]
        spans.append(s)
        cols.extend([_word(t[a:b]) for a, b in s])
        for kind, out, pattern in (("c", chunk, _CHUNK), ("n", number, _NUMBERS), ("m", mail, _EMAIL)):
            it = pattern.finditer(t) if kind != "m" or "@" in t or " at " in t.lower() or "at]" in t.lower() or "at)" in t.lower() else iter(())
            cur = next(it, None)
            for a, b in s:
                while cur is not None and cur.end() <= a:
                    cur = next(it, None)
                if cur is None or cur.start() > a:
                    out.append(0)
                elif kind == "m":
                    out.append(1 if cur.start() == a else 2)
                else:
                    out.append(_form(cur.group()) ^ (cur.start() == a))
    lengths = np.fromiter(map(len, spans), np.int64, len(spans))
    n = int(lengths.sum())
    if not n:
        return Encoded(spans, np.zeros((0, 22), np.int32), lengths)
    pad = 3
    # every text is followed by padding, so that windows stop at its ends
    starts = np.concatenate([[0], np.cumsum(lengths + pad)[:-1]]) + pad
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(n)
    total = int((lengths + pad).sum()) + pad
    word, shape, pre, suf = (np.zeros(total, np.uint64) for _ in range(4))
    c = np.array(cols, np.uint64).reshape(-1, 4)
    word[at], shape[at], pre[at], suf[at] = c.T
    ch, nu, ma = (np.zeros(total, np.uint64) for _ in range(3))
    ch[at], nu[at], ma[at] = chunk, number, mail

    def mix(*parts: np.ndarray) -> np.ndarray:
        k = mix.count = getattr(mix, "count", 0) + 1
        h = np.full(n, _SALT[k], np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return (h & np.uint64(N_FEATURES - 1)).astype(np.int32)

    W, S = (lambda o: word[at + o]), (lambda o: shape[at + o])
    feats = [
        mix(W(0)), mix(W(-1)), mix(W(1)), mix(W(-2)), mix(W(2)), mix(W(-1), W(0)), mix(W(0), W(1)), mix(W(-2), W(-1)), mix(W(1), W(2)),
        mix(S(0)), mix(S(-1), S(0)), mix(S(0), S(1)), mix(S(-1), S(0), S(1)), mix(S(-2), S(-1), S(0), S(1), S(2)),
        mix(S(-3), S(-2), S(-1), S(0)), mix(S(0), S(1), S(2), S(3)), mix(pre[at]), mix(suf[at]), mix(ch[at]), mix(nu[at]), mix(nu[at], W(-1)), mix(ma[at]),
    ]
    return Encoded(spans, np.stack(feats, axis=1), lengths)


@dataclass
class PiiModel:
    """Weights of the field; N_FEATURES x tags numbers."""

    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def save(self, path: str) -> None:
        """One file from which ``load`` gives the same model, so that a table is fitted once."""
        np.savez_compressed(path, weights=self.weights, trans=self.trans, start=self.start)

    @classmethod
    def load(cls, path: str) -> PiiModel:
        with np.load(path) as f:
            return cls(f["weights"], f["trans"], f["start"])

    def emissions(self, e: Encoded) -> np.ndarray:
        out = np.zeros((len(e.features), N_TAGS), np.float32)
        for j in range(e.features.shape[1]):
            out += self.weights[e.features[:, j]]
        return out

    def decode(self, e: Encoded, credit: float = 1.0) -> np.ndarray:
        """Best path; ``credit`` log-odds in favour of mentions make up for the gaps of the labelled table."""
        emissions = self.emissions(e)
        emissions[:, 0] -= credit
        return viterbi(emissions, Layout(e.lengths), self.trans, self.start)


def _legal() -> np.ndarray:
    """I-x follows only B-x or I-x."""
    bad = np.zeros((N_TAGS, N_TAGS), np.float32)
    for i, a in enumerate(TAGS):
        for j, b in enumerate(TAGS):
            if b[0] == "I" and a[2:] != b[2:]:
                bad[i, j] = -1e4
    return bad


def tag_tokens(spans: list[tuple[int, int]], marks: list[tuple[int, int, str]]) -> list[int]:
    """Tags of the tokens of one text from marked stretches (first one wins)."""
    tags = [0] * len(spans)
    for a, b, label in marks:
        inside = [k for k, (s, e) in enumerate(spans) if s < b and e > a]
        if inside and not any(tags[k] for k in inside):
            k = 1 + 2 * LABELS.index(label)
            for pos, i in enumerate(inside):
                tags[i] = k if pos == 0 else k + 1
    return tags


class _Trainer:
    """Fits fields on parts of one encoded training set."""

    def __init__(self, e: Encoded) -> None:
        self.e = e
        self.legal = _legal()
        self.start_legal = np.asarray([-1e4 if t[0] == "I" else 0.0 for t in TAGS], np.float32)
        self.used, short = np.unique(e.features, return_inverse=True)
        self.short = short.reshape(e.features.shape).astype(np.int32)

    def fit(self, y: np.ndarray, texts: np.ndarray, iterations: int) -> PiiModel:
        rows = np.flatnonzero(np.repeat(texts, self.e.lengths))
        short, y = self.short[rows], y[rows]
        lengths = self.e.lengths[texts]
        layout = Layout(lengths)
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[lengths > 0].astype(np.int64)
        inner = np.ones(len(y), bool)
        inner[firsts] = False
        gi = np.flatnonzero(inner)
        order = np.argsort(short.ravel(), kind="stable").astype(np.int32)
        seen, bounds = np.unique(short.ravel()[order], return_index=True)
        owner = order // np.int32(short.shape[1])
        del order
        often = np.sqrt(np.diff(np.append(bounds, len(owner)))).astype(np.float32)[:, None]
        # the gradient is summed in runs of features, so that its temporaries stay small
        runs = np.unique(np.searchsorted(bounds, np.arange(0, len(owner), 400_000), side="left"))
        runs = [*runs[runs < len(bounds)].tolist(), len(bounds)]
        runs = runs if runs[0] == 0 else [0, *runs]
        params = {"w": np.zeros((len(self.used), N_TAGS), np.float32), "t": np.zeros((N_TAGS, N_TAGS), np.float32), "s": np.zeros(N_TAGS, np.float32)}
        gold_t = np.bincount(y[gi - 1] * N_TAGS + y[gi], minlength=N_TAGS**2).reshape(N_TAGS, N_TAGS)
        gold_s = np.bincount(y[firsts], minlength=N_TAGS)
        hot = np.zeros((len(y), N_TAGS), np.float32)
        hot[np.arange(len(y)), y] = 1
        adam = Adam(0.06)
        columns = [np.ascontiguousarray(short[:, j]) for j in range(short.shape[1])]
        em, row = np.zeros((len(y), N_TAGS), np.float32), np.empty((len(y), N_TAGS), np.float32)
        tops = [bounds[hi] if hi < len(bounds) else len(owner) for hi in runs[1:]]
        gathered = np.empty((max((t - bounds[lo] for lo, t in zip(runs, tops)), default=0), N_TAGS), np.float32)
        for _ in range(iterations):
            em[:] = 0
            for column in columns:
                em += np.take(params["w"], column, axis=0, out=row, mode="clip")  # into a held buffer: no new memory each time
            post, _, pairs, _ = forward_backward(em, layout, params["t"] + self.legal, params["s"] + self.start_legal, want_pairs=True)
            grad = np.zeros_like(params["w"])
            miss = hot - post
            for lo, hi in zip(runs, runs[1:]):
                end = bounds[hi] if hi < len(bounds) else len(owner)
                part = np.take(miss, owner[bounds[lo] : end], axis=0, out=gathered[: end - bounds[lo]], mode="clip")
                grad[seen[lo:hi]] = np.add.reduceat(part, bounds[lo:hi] - bounds[lo], axis=0) / often[lo:hi]
            adam.step(params, {
                "w": grad - 0.05 * params["w"], "t": ((gold_t - pairs - 0.1 * params["t"]) / len(firsts)).astype(np.float32),
                "s": ((gold_s - post[firsts].sum(axis=0)) / len(firsts)).astype(np.float32)})
        model = PiiModel(np.zeros((N_FEATURES, N_TAGS), np.float32), params["t"] + self.legal, params["s"] + self.start_legal)
        model.weights[self.used] = params["w"]
        return model


def _relabel(views: list[str], y: np.ndarray, fold: int, folds: int, iterations: int, missed: float, e: Encoded | None = None) -> np.ndarray:
    """Tags of one fold's tokens by a field fitted on the other folds."""
    e = e or encode(views)
    own = np.arange(len(views)) % folds == fold
    path = _Trainer(e).fit(y, ~own, iterations).decode(e, missed)
    return path[np.repeat(own, e.lengths)].astype(np.int8)


def fit(
    views: list[str], marks: list[list[tuple[int, int, str]]], iterations: int = 28, folds: int = 3, missed: float = 2.5, spark: SparkSession | None = None,
) -> PiiModel:
    """Fits the field on a noisy table. Each fold is first relabelled by a field fitted on the other folds, which cannot
    have learnt the fold's own errors by heart; ``missed`` is the log-odds credit for mentions that the table lacks. With a session
    the folds are fitted in parallel tasks (each gets the bounded sample); the result is the same.

    More iterations learn the table's errors: with 40, 1.4 % of the found mentions are invoice, case and order numbers and the like, which the table
    holds as identity numbers now and then; with 28 none are. Stopping early is the regularisation here."""
    e = encode(views)
    y = np.asarray([t for s, m in zip(e.spans, marks) for t in tag_tokens(s, m)], np.int64)
    if not len(y):
        # nothing to learn from: a field that marks nothing
        trans, start = _legal(), np.zeros(N_TAGS, np.float32)
        trans[:, 0] += 10
        start[0] = 10
        return PiiModel(np.zeros((N_FEATURES, N_TAGS), np.float32), trans, start)
    if len(views) >= 20 * folds:
        part = iterations * 2 // 3
        if spark is None:
            paths = {k: _relabel(views, y, k, folds, part, missed, e) for k in range(folds)}
        else:
            shared = spark.sparkContext.broadcast((views, y))  # at most train_requests texts of at most max_chars

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k in batch.column(0).to_pylist():
                        path = _relabel(*shared.value, k, folds, part, missed)
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([path.tobytes()], pa.binary())], names=["fold", "path"])

            rows = spark.range(0, folds, 1, folds).mapInArrow(run, "fold bigint, path binary").collect()
            paths = {r["fold"]: np.frombuffer(r["path"], np.int8) for r in rows}
        clean = y.copy()
        for k, path in paths.items():
            clean[np.repeat(np.arange(len(views)) % folds == k, e.lengths)] = path
        y = clean
    return _Trainer(e).fit(y, np.ones(len(views), bool), iterations)


def plausible(label: str, text: str) -> bool:
    """Has a marked stretch the form of its label?"""
    digits = sum(c.isdigit() for c in text)
    letters = sum(c.isalpha() for c in text)
    if label == "EMAIL":
        return _EMAIL.fullmatch(text) is not None
    if label == "PHONE":
        return 7 <= digits <= 15 and letters == 0
    if label == "GOV_ID":
        return digits >= 5 and letters <= 9  # an Italian tax code has nine
    if label == "STREET_ADDRESS":
        return digits >= 1 and letters >= 2 and "@" not in text
    if digits or letters < 2 or "@" in text:
        return False
    if ord(text[0]) >= 0x3040:
        return True
    # given and family name: two words, each with a capital but for particles; or a name written all in lower case
    words = re.findall(r"[^\W\d_]+", text)
    small = [w for w in words if w.islower() and w not in PARTICLES]
    return len(words) > 1 and (not small or text.islower())


def _spans_of(tags: np.ndarray, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    cur: list | None = None
    for t, (a, b) in zip(tags.tolist(), spans):
        if t and t % 2 == 0 and cur is not None and cur[2] == t - 1:
            cur[1] = b
            continue
        if cur is not None:
            yield cur[0], cur[1], LABELS[(cur[2] - 1) // 2]
            cur = None
        if t % 2 == 1:
            cur = [a, b, t]
    if cur is not None:
        yield cur[0], cur[1], LABELS[(cur[2] - 1) // 2]


def _after_name(v: str, a: int, b: int) -> int:
    """The name of a field in front is not part of its value."""
    name = _FIELD_NAME.match(v, a, b)
    return name.end() if name and name.end() < b else a


def _settle(v: str, a: int, b: int, label: str, mails: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The exact check: ends of the form of the label, or None if the stretch has not that form."""
    if label == "EMAIL":
        return next(((s, e) for s, e in mails if s < b and e > a), None)
    if any(s < b and e > a for s, e in mails):
        return None
    if label == "PHONE":
        while a > 0 and v[a - 1] in "+(" or a > 1 and v[a - 1].isdigit():
            a -= 1
        while b < len(v) and v[b].isdigit():
            b += 1
        while a < b and not (v[a].isdigit() or v[a] in "+("):
            a += 1
        while b > a and not v[b - 1].isdigit():
            b -= 1
    elif label == "GOV_ID":
        while v[a].isalnum() and a > 0 and v[a - 1].isascii() and v[a - 1].isalnum():
            a -= 1
        a = _after_name(v, a, b)
        while b < len(v) and v[b].isascii() and v[b].isalnum():
            b += 1
        while a < b and not v[a].isalnum():
            a += 1
        while b > a and not v[b - 1].isalnum():
            b -= 1
    elif label == "STREET_ADDRESS":
        while a < b and not v[a].isalnum():
            a += 1
        if not _CJK.match(v, a):
            a = _after_name(v, a, b)
        tail = _NO_NUMBER.search(v, a, b)
        if tail and tail.start() > a:
            b = tail.start()  # what follows the last comma of a Han address without a number is the next field's name
        while b > a and (v[b - 1].isspace() or v[b - 1] in ",;:(。，、"):
            b -= 1
    else:
        while a < b and (not v[a].isalpha() or v[a] in "是叫"):  # "is", "is called"
            a += 1
        while True:
            m = re.match(r"([^\W\d_]+(?:[.\-][^\W\d_]+)*)\.?\s+", v[a:b])
            # a single letter with a full stop is an initial, not a title
            if m and m.group(1).lower() in TITLES and not (len(m.group(1)) == 1 and m.group().rstrip().endswith(".")):
                a += m.end()
            else:
                break
        if v[b - 2 : b] in ("'s", "’s"):
            b -= 2
        while b > a and not v[b - 1].isalpha():
            b -= 1
        if v[a:b].islower() and v.lstrip()[:1].isupper():
            return None  # small letters make a name only in a text that is written so
    return (a, b) if b > a and plausible(label, v[a:b]) else None


def find_in(texts: list[str | None], model: PiiModel) -> list[list[tuple[int, int, str]]]:
    """Mentions (start, end, label) in stored positions of every text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]

    def work(rows: list[int], views: list[str], places: list) -> None:
        e = encode(views)
        tags = model.decode(e)
        pos = 0
        for i, v, place, spans in zip(rows, views, places, e.spans):
            part = tags[pos : pos + len(spans)]
            pos += len(spans)
            if not part.any():
                continue
            mails = [m.span() for m in _EMAIL.finditer(v)]
            last = -1
            for a, b, label in _spans_of(part, spans):
                found = _settle(v, a, b, label, mails)
                if found is None or found[0] < last:
                    continue
                a, b = found
                last = b
                out[i].append((place[a], place[b - 1] + 1, label) if place else (a, b, label))

    rows: list[int] = []
    views: list[str] = []
    places: list = []
    size = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        v, p = view(t)
        rows.append(i)
        views.append(v)
        places.append(p)
        size += len(v)
        if size > 3 * _SUB_TOKENS:
            work(rows, views, places)
            rows, views, places, size = [], [], [], 0
    if rows:
        work(rows, views, places)
    return out


def labelled_sample(requests: DataFrame, spans: DataFrame, train_requests: int = 7000, max_chars: int = 600) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """At most ``train_requests`` texts of at most ``max_chars`` code points, by key hash, with their marked stretches in view positions."""
    short = requests.where((F.length("text") <= max_chars) & (F.length(F.trim("text")) > 0)).select("request_id", "text")
    chosen = lowest_hashes(short, F.col("request_id"), train_requests)
    marks = spans.where(F.col("label").isin(list(COARSE))).select("request_id", "label", "start", "end").distinct()
    rows = chosen.join(marks, "request_id", "left").groupBy("request_id").agg(
        F.first("text").alias("text"), F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end", "label")))).alias("marks")).collect()
    views: list[str] = []
    out: list[list[tuple[int, int, str]]] = []
    for r in sorted(rows, key=lambda r: r["request_id"]):
        v, place = view(r["text"])
        where = {p: i for i, p in reversed(list(enumerate(place)))} if place else None
        good = []
        for m in r["marks"]:
            a, b, label = m["start"], m["end"], COARSE[m["label"]]
            if where is not None:
                a = next((where[x] for x in range(a, len(r["text"])) if x in where), len(v))
                b = next((where[x] for x in range(b, len(r["text"])) if x in where), len(v))
            if 0 <= a < b <= len(v) and plausible(label, v[a:b].strip(" .,;:()")):
                good.append((a, b, label))
        views.append(v)
        out.append(good)
    return views, out


def train_on(requests: DataFrame, spans: DataFrame, **bounds: int) -> PiiModel:
    """Fits the field on a bounded sample of the labelled table."""
    return fit(*labelled_sample(requests, spans, **bounds), spark=requests.sparkSession)


def find_mentions(requests: DataFrame, model: PiiModel, key_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """``request_id, start_pos, end_pos, label`` of every mention. Reads two columns, no shuffle."""
    shared = requests.sparkSession.sparkContext.broadcast(model)  # fixed size
    kind = requests.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_in(batch.column(1).to_pylist(), shared.value)
            rows = [(k, a, b, lab) for k, m in zip(batch.column(0).to_pylist(), found) for a, b, lab in m]
            cols = list(zip(*rows)) if rows else [[]] * 4
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["request_id", "start_pos", "end_pos", "label"])

    source = requests.select(F.col(key_col).alias("request_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"request_id {kind}, start_pos bigint, end_pos bigint, label string")


_REPLACED = "request_id {k}, replaced_text string, mentions array<struct<label:string,start:int,end:int,text:string,replacement:string>>"


def replace_mentions(requests: DataFrame, model: PiiModel, key_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """Every row with its text rewritten: mentions become ``[LABEL]``, all other text is unchanged."""
    shared = requests.sparkSession.sparkContext.broadcast(model)
    kind = requests.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mention = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("replacement", pa.string())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            replaced: list[str | None] = []
            lists: list[list[dict]] = []
            for t, marks in zip(texts, find_in(texts, shared.value)):
                out: list[str] = []
                at = 0
                for a, b, lab in marks:
                    out += [t[at:a], f"[{lab}]"]
                    at = b
                replaced.append(t if t is None else "".join([*out, t[at:]]))
                lists.append([{"label": lab, "start": a, "end": b, "text": t[a:b], "replacement": f"[{lab}]"} for a, b, lab in marks])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replaced, pa.string()), pa.array(lists, mention)], names=["request_id", "replaced_text", "mentions"])

    source = requests.select(F.col(key_col).alias("request_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, _REPLACED.format(k=kind))
