"""Sentence units across languages and scripts (problem 3).

A pushdown automaton walks the *events* of a text (terminators, quotation marks, brackets, blank
lines, list markers, and the spaces that separate Thai sentences). Its stack holds the open list levels and, above them, the open
quotations and brackets; a terminator ends a unit only with no quotation or bracket open. Abbreviations are looked up in a
trie that is walked backwards from the full stop. The automaton emits code-point offsets only, so
units can be placed in ``documents.segments`` without copying text.

List levels: a marker at the start of a line opens a level of its indentation where a list can begin (after a terminator, a colon or at the
paragraph's start); a deeper marker after an open level opens one above it; a marker further left closes the levels above its own. The
full stop of the next marker of an open level ("2." after "1.") is no terminator.

Defined results: null, empty and blank texts give no units (an empty array); a quotation or bracket
that is never closed inside its paragraph is an ordinary character (marks are paired in one pass: a closing mark closes
the nearest mark it fits, and what was opened in between is never closed); a blank line clears
the stack. Units never contain surrounding white space and never overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

# Abbreviations written with a full stop.
# TIGHT ones are always followed by the rest of their phrase (titles, references).
TIGHT = """
mr mrs ms dr prof st sr jr vs no nos sec p pp fig vol ch al approx cf e.g i.e eg ie viz gen col capt sgt rev hon dept
hr fr frau z.b z d.h d u.a u s.o s.u vgl nr abs art bzw ca ggf inkl evtl str bd hrsg geb tel
m mme mlle mm c.-à-d c.-à c p.ex ex réf env av chap éd
sra srta dra d dña ud uds pág págs núm cap ej p.ej aprox depto avda
sig sig.ra dott dott.ssa ing avv pag pagg es p.es cfr n
exmo exma pág núm nº
dhr mevr mw drs blz bijv o.a d.w.z nl ca
см п с стр т.е т.д т.п т.н т др гл рис ул г им д
див стор напр п с т.з т.і вул ім р
د أ م ص ج
डॉ श्री पृ सं
""".split()
# LOOSE ones may also be the last word of a sentence: the next letter decides.
LOOSE = """
etc inc ltd co corp llc a.m p.m am pm jan feb mar apr jun jul aug sep sept oct nov dec u.s u.k ph.d
usw usf etw gmbh co.kg ss.gg
ltda s.a s.l eds
ecc s.p.a s.r.l
enz e.d b.v n.v
и т.д и т.п т.д т.п др руб млн тыс гг грн тощо
""".split()

_END = "$"


def _trie(words: list[str]) -> dict:
    """A trie over the reversed abbreviations, walked from the full stop to the left."""
    root: dict = {}
    for kind, group in (("loose", LOOSE), ("tight", TIGHT)):
        for w in group:
            if w not in words:
                continue
            node = root
            for ch in reversed(w):
                node = node.setdefault(ch, {})
            node[_END] = kind if node.get(_END) != "loose" else "loose"
    return root


_TRIE = _trie(TIGHT + LOOSE)

# Pairs of marks.
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "‹": "›", "„": "“”", "“": "”"}
_CLOSERS = set(")]}）】］」』》〉»›”")
_STOPS = ".!?…。！？｡।॥؟۔．"
_HARD_STOPS = set("。！？｡।॥؟۔")
_THAI = "฀-๿"
_EVENT = re.compile(
    rf"(?P<blank>\n[^\S\n]*\n\s*)|(?P<stop>[{re.escape(_STOPS)}]+)|(?P<mark>[\"()\[\]{{}}（）【】［］「」『』《》〈〉«»‹›„“”])"
    rf"|(?P<thai>(?<=[{_THAI}])[^\S\n]*\n?[^\S\n]*(?<=\s)(?=[^\s]))|(?P<list>(?:(?<=\n)|\A)[^\S\n]*(?:[-*•]|\d{{1,3}}[.)])[^\S\n])"
)
_THAI_CH = re.compile(f"[{_THAI}]")
_WORDCH = re.compile(r"\w")
_TOKEN = re.compile(r"\S+")
_NAME_IN_THAI = re.compile(rf"(?:\s*[A-Z][\w'’.\-]*){{1,5}}\s*(?=[{_THAI}]|\Z)")
_LEFT = re.compile(r"[\w.\-]*\Z")
_MAILISH = re.compile(r"[\w+\-.]*@|(?:[\w\-]+\.)*[a-z]{2,10}/")
_QUOTED_ON = re.compile(r"と|って")  # Japanese: the quotation goes on as part of its sentence
# Month names after a written ordinal ("3. Mai").
_MONTH = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")


def _abbreviation(text: str, dot: int, lo: int) -> str | None:
    """Kind of the longest abbreviation that ends right before the full stop at ``dot``."""
    node, i, found = _TRIE, dot - 1, None
    while i >= lo:
        ch = text[i].lower()
        if ch.isspace():
            # spaced abbreviations ("d. h.", "т. е.") are stored without the space
            if text[i - 1 : i] != ".":
                break
            i -= 1
            continue
        node = node.get(ch)
        if node is None:
            break
        if _END in node and (i == lo or not _WORDCH.match(text[i - 1])):
            found = node[_END]
        i -= 1
    return found


def _next_visible(text: str, i: int, hi: int) -> int:
    while i < hi and text[i].isspace():
        i += 1
    return i


def _breaks_after_stop(text: str, m_start: int, m_end: int, lo: int, hi: int) -> bool:
    """Does the stop text[m_start:m_end], outside all marks, end a unit?"""
    run = text[m_start:m_end]
    nxt = _next_visible(text, m_end, hi)
    if nxt >= hi:
        return True
    ch = text[nxt]
    if run[-1] in _HARD_STOPS:
        # a comma or a further closing mark keeps the sentence open
        return ch not in "，、,;；:：" and not ch.islower()
    gap = nxt > m_end
    if run == ".":
        prev = text[m_start - 1] if m_start > lo else ""
        if not prev or prev.isspace():
            return False
        if not gap:
            # "3.5", "v2.1", addresses and host names stay whole; "end.Next" is a missing space
            if not (ch.isupper() or ch in "¿¡\"“„«「" or ord(ch) > 0x2E7F or _THAI_CH.match(ch) or "؀" <= ch <= "ۿ" or "ऀ" <= ch <= "ॿ"):
                return False
            if not (prev.isalpha() or prev.isdigit() or prev in ")]»”") or prev.isupper() and text[m_start - 2 : m_start - 1].isupper() and ch.isascii():
                return False
            if _MAILISH.match(text, m_end, hi):
                return False
            left = _LEFT.search(text, max(lo, m_start - 60), m_start).group()
            if "@" in text[max(lo, m_start - len(left) - 1) : m_start] and not ch.isupper():
                return False
            if _initial(text, m_start, lo):
                return False
            return _abbreviation(text, m_start, lo) is None
        if _initial(text, m_start, lo) or prev.isdigit() and _MONTH.match(text, nxt, hi):
            return False
        kind = _abbreviation(text, m_start, lo)
        if kind == "tight":
            return False
        if ch.islower() or ch in ",;:)":
            return False
        if kind == "loose":
            return not ch.isdigit()
        return True
    # ! ? … and runs of stops
    if ch.islower() or ch in ",;:，、；：":
        return False
    if not gap and run[-1] == "." and not ch.isupper():
        return False
    if run in ("...", "…", "..") and not (ch.isupper() or not ch.isalpha() or not ch.isascii()):
        return False
    return True


def _initial(text: str, dot: int, lo: int) -> bool:
    """A single capital letter before the full stop ("J. Smith", "d'E. B.")."""
    if dot - 1 < lo or not text[dot - 1].isupper():
        return False
    if dot - 2 < lo:
        return True
    before = text[dot - 2]
    return not _WORDCH.match(before)


def _thai_break(text: str, a: int, b: int, hi: int, unit: int) -> bool:
    """Is the white space text[a:b] after a Thai letter a sentence boundary?"""
    ch = text[b]
    if _THAI_CH.match(ch):
        # Thai on both sides: a boundary unless the left side was opened by a number or a short address
        return True
    if ch.isdigit():
        return False
    word = _TOKEN.match(text, b).group()
    if "@" in word or "://" in word or not word[0].isalpha() or word.isupper() and len(word.rstrip(".")) > 1:
        return ch in "“\"«¿¡„"
    # another language starts: only with a capital or a caseless script
    if ch.islower():
        return False
    # a name inside a Thai sentence is followed by Thai text again
    rest = _NAME_IN_THAI.match(text, b)
    return rest is None


def _partners(marks: list[tuple[int, str]]) -> dict[int, int]:
    """Place of the closing mark of every mark that is closed, in one pass: each mark is pushed and popped once."""
    found: dict[int, int] = {}
    stack: list[tuple[int, str]] = []  # place, closing marks
    waiting: dict[str, list[int]] = {}  # heights in the stack of what a mark would close
    for at, ch in marks:
        heights = waiting.get(ch)
        if heights:
            height = heights[-1]
            found[stack[height][0]] = at
            for _, closers in stack[height:]:
                for c in closers:
                    waiting[c].pop()
            del stack[height:]
            continue
        closers = '"' if ch == '"' else "«" if ch == "»" and not stack else _PAIRS.get(ch)
        if closers:  # any other closing mark without its opening one is an ordinary character
            for c in closers:
                waiting.setdefault(c, []).append(len(stack))
            stack.append((at, closers))
    return found


def _can_begin_list(text: str, lo: int, a: int) -> bool:
    i = a - 1
    while i >= lo and text[i].isspace():
        i -= 1
    return i < lo or text[i] in _STOPS or text[i] in ":："


def _marker(text: str, a: int, b: int) -> tuple[int, int | None]:
    """(indentation, number or None for a bullet) of the list marker text[a:b]."""
    body = text[a:b].strip()
    lead = len(text[a:b]) - len(text[a:b].lstrip())
    return lead, int(body[:-1]) if body[:-1].isdigit() else None


def _paragraph(text: str, lo: int, hi: int, out: list[tuple[int, int]]) -> None:
    """Automaton over one paragraph text[lo:hi]; appends its units to ``out``."""
    events = list(_EVENT.finditer(text, lo, hi))
    closes = _partners([(m.start(), m.group()) for m in events if m.lastgroup == "mark"])
    levels: list[tuple[int, int | None]] = []  # open list levels, the lower part of the stack: indentation, last number
    stack: list[tuple[int, int, bool]] = []  # open marks: place of the closing one, own place, opened at the unit's start
    cuts: list[int] = []
    start = _next_visible(text, lo, hi)
    unit = start
    pos = lo
    for m in events:
        a, b = m.span()
        if a < pos:
            continue
        kind = m.lastgroup
        if kind == "stop":
            if stack:
                continue
            e = b
            # closing marks right after the stop belong to the unit; they close nothing here
            if _breaks_after_stop(text, a, b, unit, hi):
                cuts.append(e)
                unit = _next_visible(text, e, hi)
        elif kind == "mark":
            ch = text[a]
            if stack and a == stack[-1][0]:
                _, opened, at_start = stack.pop()
                if stack:
                    continue
                j = a - 1
                while j > opened and text[j].isspace():
                    j -= 1
                if j > opened and text[j] in _STOPS and ch not in ")]}）】］":
                    nxt = _next_visible(text, b, hi)
                    if nxt >= hi:
                        continue
                    c = text[nxt]
                    if c in _CLOSERS or c in ",;:，、；：.!?。！？…-–—" or c.islower():
                        continue
                    if at_start and not c.isupper() and c not in "\"“„«¿¡「":
                        continue  # "…!" followed by who said it, in a script without capitals
                    if "「" <= ch <= "』" and _QUOTED_ON.match(text, nxt, hi):
                        continue
                    cuts.append(b)
                    unit = nxt
                elif j > opened and text[j] in _STOPS:
                    # a bracketed sentence that fills the whole unit ends with its bracket
                    nxt = _next_visible(text, b, hi)
                    if at_start and nxt < hi and text[nxt].isupper():
                        cuts.append(b)
                        unit = nxt
            elif a in closes:
                stack.append((closes[a], a, a == unit))
        elif kind == "thai":
            if not stack and _thai_break(text, a, b, hi, unit):
                cuts.append(a)
                unit = b
        elif kind == "list":
            indent, number = _marker(text, a, b)
            while levels and levels[-1][0] > indent:
                levels.pop()
            known = bool(levels) and levels[-1][0] == indent
            goes_on = known and (number is None) == (levels[-1][1] is None) and (number is None or number == levels[-1][1] + 1)
            deeper = bool(levels) and not known and number in (None, 1)
            if goes_on or deeper or _can_begin_list(text, lo, a):
                if known:
                    levels.pop()
                levels.append((indent, number))
                pos = b  # the marker's own full stop is no terminator
                continue
            dot = text.find(".", a, b)
            if dot >= 0 and not stack and _breaks_after_stop(text, dot, dot + 1, unit, hi):
                cuts.append(dot + 1)
                unit = _next_visible(text, dot + 1, hi)
    s = start
    for c in cuts:
        _emit(text, s, c, out)
        s = c
    _emit(text, s, hi, out)


def _emit(text: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
    piece = text[a:b]
    left = piece.lstrip()
    if not left:
        return
    a += len(piece) - len(left)
    out.append((a, a + len(left.rstrip())))


_BLANK = re.compile(r"\r?\n[^\S\n]*\n\s*")


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    """Offsets of all sentence units of a text, in order."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    lo = 0
    for m in _BLANK.finditer(text):
        if m.start() > lo:
            _paragraph(text, lo, m.start(), out)
        lo = m.end()
    if lo < len(text):
        _paragraph(text, lo, len(text), out)
    return out


def _flat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) batches to (id, start_pos, end_pos) rows."""
    for batch in batches:
        ids: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for a, b in sentence_units(text):
                ids.append(key)
                starts.append(a)
                ends.append(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, batch.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
            names=["doc_id", "start_pos", "end_pos"],
        )


def sentence_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence unit: ``doc_id, start_pos, end_pos``. No shuffle; extra columns are not read."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_flat_batches, f"doc_id {kind}, start_pos bigint, end_pos bigint")


def with_sentence_units(df: DataFrame, text_col: str = "text", out: str = "units") -> DataFrame:
    """Adds the units as ``array<struct<start,end>>``; null texts get an empty array."""

    @F.pandas_udf(UNIT)
    def units(texts):  # noqa: ANN001
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in sentence_units(t)])

    return df.withColumn(out, units(F.col(text_col)))


def place_in_segments(unit_start: Column, unit_end: Column, segments: Column) -> Column:
    """Indices (0-based) of the segments that a unit overlaps; null segments give an empty array."""
    marked = F.transform(segments, lambda s, i: F.when((s["start"] < unit_end) & (s["end"] > unit_start), i))
    return F.coalesce(F.filter(marked, lambda i: i.isNotNull()), F.array().cast("array<int>"))
