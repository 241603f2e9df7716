"""SQL counterparts of the training-data queries.

Leaks and look-alike pairs are plain SQL at test size, by joining every n-gram and every form. For the operators that are no plain SQL the SQL checks
properties that every right result has; tests/llm holds brute-force versions.
"""

from __future__ import annotations

_WHITE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F\x85"

# Letters of other scripts and the Latin letters of the same shape, in the same order.
_LOOK = "аеорсхуіѕјһԁԛԝҽӏ" "АВЕКМНОРСТХІЅЈҮԚԜ" "ονιϲϳ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ" "ɑɡɩⱭꓐ" "օսոհ"
_LATIN = "aeopcxyisjhdqwel" "ABEKMHOPCTXISJYQW" "ovicj" "ABEZHIKMNOPTYXCJ" "agiAB" "ounh"
# Joined letters and what they stand for.
_JOINED = {"ﬃ": "ffi", "ﬄ": "ffl", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ"}
_WIDE, _NARROW = ("".join(chr(c - shift) for c in range(0xFF01, 0xFF5F)) for shift in (0, 0xFEE0))
_INVISIBLE = r"[\p{Cf}\x{FE00}-\x{FE0F}]"
_UNSEEN = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{00}-\x{08}\x0B\x0C\x0E-\x1F\x7F-\x9F\x{34F}\x{115F}\x{1160}\x{3164}\x{FFA0}]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _narrow(column: str) -> str:
    return f"translate({column}, {_text(_WIDE)}, {_text(_NARROW)})"


def _form(column: str) -> str:
    """The consistent form of a text."""
    out = f"regexp_replace(regexp_replace({column}, '[\\p{{Zs}}]', ' ', 'g'), '{_UNSEEN}', '', 'g')"
    for joined, letters in _JOINED.items():
        out = f"replace({out}, '{joined}', '{letters}')"
    return f"nfc_normalize(translate({_narrow(out)}, {_text(_LOOK)}, {_text(_LATIN)}))"


def _words(column: str) -> str:
    """Lower-case words without punctuation and invisible characters."""
    seen = f"regexp_replace({column}, '{_INVISIBLE}', '', 'g')"
    return f"regexp_extract_all(lower({_narrow(seen)}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"


ORACLES: dict[str, str] = {
    "p7_found": """
        WITH over AS (
            SELECT d.doc_id, d.text, d.segments, l.max_chars FROM documents d JOIN size_limits l ON d.kind = l.kind WHERE length(d.text) > l.max_chars)
        SELECT doc_id, CASE
            WHEN len(list_filter(segments, lambda s: s['end'] - s['start'] > max_chars)) = 0 THEN 'segment'
            WHEN list_max(list_transform(regexp_split_to_array(text, '[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B\\x1C-\\x1F\\x85.!?…。！？।؟]+'), lambda x: length(x))) <= max_chars THEN 'inside'
            ELSE 'hard' END AS cut
        FROM over""",
    "p1_properties": "SELECT doc_id, true AS in_order, true AS shares FROM documents",
    "p2_restored": "SELECT request_id, sha1(text) AS text_sha1 FROM requests",
    "p3_properties": f"SELECT doc_id, true AS in_order, true AS trimmed, true AS covered FROM documents WHERE regexp_matches(text, '[^{_WHITE}]')",
    "p4_votes": """
        WITH v AS (SELECT item_id, annotator, arg_max({'label': label, 's': "start", 'e': "end"}, {'at': labelled_at, 'label': label, 's': "start", 'e': "end"}) AS v
            FROM annotations WHERE label IS NOT NULL AND item_id IS NOT NULL AND annotator IS NOT NULL GROUP BY 1, 2),
        c AS (SELECT item_id, v['label'] AS label, count(*) AS c FROM v GROUP BY 1, 2), n AS (SELECT item_id, sum(c)::INTEGER AS n, sum(c * (c - 1)) AS same FROM c GROUP BY 1)
        SELECT item_id, n AS n_votes, CASE WHEN n > 1 THEN round(same::DOUBLE / (n * (n - 1)), 6) END AS agreement FROM n""",
    "p8_texts": "SELECT doc_id, sha1(coalesce(text, '')) AS text_sha1 FROM documents",
    "p9_after": "SELECT 0::BIGINT AS leaks",
    "p10_ways": "SELECT count(*) AS pages, 0::BIGINT AS different FROM documents WHERE kind IN ('html', 'md')",
    "p5_ranks": """
        SELECT detector, q, count(*) AS n, true AS within
        FROM predictions, (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS q)
        WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) GROUP BY 1, 2""",
    "p7_properties": """
        SELECT doc_id, true AS within_limit, true AS within_overlap, true AS in_order, true AS covered
        FROM documents d JOIN size_limits l ON d.kind = l.kind WHERE length(d.text) > l.max_chars""",
    "p6_found": f"""
        WITH r AS (SELECT DISTINCT request_id AS k, text, {_form('text')} AS f FROM requests WHERE text <> ''),
        s AS (SELECT DISTINCT span_id AS k, request_id AS g, text, {_form('text')} AS f FROM detected_spans WHERE text <> '')
        SELECT DISTINCT 'request' AS tab, least(a.k, b.k) AS key_a, greatest(a.k, b.k) AS key_b FROM r a JOIN r b ON a.f = b.f AND a.text <> b.text AND a.k <> b.k
        UNION ALL SELECT DISTINCT 'span', least(a.k, b.k), greatest(a.k, b.k) FROM s a JOIN s b ON a.g = b.g AND a.f = b.f AND a.text <> b.text AND a.k <> b.k""",
    "p6_forms": f"SELECT request_id, text, {_form('text')} AS form FROM requests",
    "p9_found": f"""
        WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text <> ''), i AS (SELECT item_id, lang, {_words('text')} AS w FROM eval_items WHERE text IS NOT NULL),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) > 11)),
        ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (
            SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) > 11 AND lang NOT IN ('zh', 'ja', 'th'))),
        dc AS (SELECT doc_id, array_to_string(w, '') AS c FROM d), ic AS (SELECT item_id, array_to_string(w, '') AS c FROM i WHERE lang IN ('zh', 'ja', 'th')),
        dh AS (SELECT DISTINCT doc_id, substr(c, k, 24) AS g FROM (SELECT doc_id, c, unnest(range(1, length(c) - 22)) AS k FROM dc
            WHERE length(c) > 23 AND regexp_matches(c, '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}\\x{{0E00}}-\\x{{0E7F}}]'))),
        ih AS (SELECT DISTINCT item_id, substr(c, k, 24) AS g FROM (SELECT item_id, c, unnest(range(1, length(c) - 22)) AS k FROM ic WHERE length(c) > 23))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g) UNION SELECT DISTINCT doc_id, item_id FROM dh JOIN ih USING (g)""",
}
