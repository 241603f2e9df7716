"""SQL counterparts of the named queries, over the same tables."""

from __future__ import annotations

# Fixed values, stated here again so that a wrong table of the engine shows: coarse labels, fine labels by parent.
COARSE = [
    "PERSON", "EMAIL", "PHONE", "ADDRESS", "URL", "DATE", "ACCOUNT", "SECRET", "USERNAME", "DEMOGRAPHIC", "ORGANIZATION", "OCCUPATION", "MONEY", "VEHICLE", "PHYSICAL"]
PARENT = {
    "GIVEN_NAME": "PERSON", "FAMILY_NAME": "PERSON", "STREET_ADDRESS": "ADDRESS", "CITY": "ADDRESS", "STATE": "ADDRESS", "POSTCODE": "ADDRESS", "COUNTRY": "ADDRESS",
    "GEO_COORDINATE": "ADDRESS", "IP_ADDRESS": "URL", "MAC_ADDRESS": "URL", "DATE_OF_BIRTH": "DATE", "TIME": "DATE", "BANK_ACCOUNT": "ACCOUNT", "CREDIT_CARD": "ACCOUNT",
    "CRYPTO_WALLET": "ACCOUNT", "GOV_ID": "ACCOUNT", "MEDICAL_ID": "ACCOUNT", "EMPLOYEE_ID": "ACCOUNT", "CUSTOMER_ID": "ACCOUNT", "DEVICE_ID": "ACCOUNT", "PASSWORD": "SECRET",
    "API_KEY": "SECRET", "AGE": "DEMOGRAPHIC", "GENDER": "DEMOGRAPHIC"}
ALL_LABELS = [*COARSE, *PARENT]
# label and pattern of each rule
RULES = {
    "email": ("EMAIL", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": ("URL", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    "phone": ("PHONE", r"\+[0-9]{1,3}[ -][0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,5}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    "money": ("MONEY", r"\$[0-9]+(?:\.[0-9]{2})?|CHF [0-9]+\.[0-9]{2}|[0-9]+,[0-9]{2} EUR"),
    "date": ("DATE", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    "url": ("URL", r"https?://[A-Za-z0-9./?=&_-]+"),
    "digits": ("ACCOUNT", r"[0-9]+"),
    "token": ("SECRET", r"token = \"[0-9a-f]{20,}\""),
}
TOKEN = r"\[[A-Z_]+_[A-Za-z0-9]+\]|[A-Za-z0-9_]+"

ORACLES: dict[str, str] = {}


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_REC = "rec AS (SELECT DISTINCT id, text, language, gold_spans FROM fixtures)"
_LATEST = """latest AS (SELECT id, detector, spans, latency_ms, error FROM (
    SELECT *, row_number() OVER (PARTITION BY id, detector ORDER BY started_at DESC, run_id DESC, ingested_at DESC) AS rn FROM predictions) WHERE rn = 1)"""


def _gold(label: str = "g.label") -> str:
    return f"""gold AS (SELECT DISTINCT id, g."start" AS s, g."end" AS e, {label} AS label FROM (SELECT id, text, unnest(gold_spans) AS g FROM rec)
    WHERE g."start" >= 0 AND g."start" < g."end" AND g."end" <= length(text) AND g.label IN {_in(COARSE)})"""


def _pred(label: str = "p.label") -> str:
    return f"""pred AS (SELECT DISTINCT id, detector, p."start" AS s, p."end" AS e, {label} AS label FROM (
        SELECT id, detector, unnest(spans) AS p FROM latest WHERE error IS NULL) WHERE id IN (SELECT id FROM rec)),
    calls AS (SELECT id, detector FROM latest WHERE error IS NULL AND id IN (SELECT id FROM rec))"""


_BASE = f"{_REC}, {_LATEST}, {_gold()}, {_pred()}"
_INSIDE = "inside AS (SELECT pred.* FROM pred JOIN (SELECT id, max(length(text)) AS n FROM rec GROUP BY 1) r ON pred.id = r.id WHERE s >= 0 AND s < e AND e <= r.n)"
_LANG = """CASE lower(trim(language)) WHEN 'english' THEN 'en' WHEN 'french' THEN 'fr' WHEN 'german' THEN 'de' WHEN 'italian' THEN 'it'
    WHEN 'spanish' THEN 'es' WHEN 'dutch' THEN 'nl' ELSE CASE WHEN length(trim(language)) = 2 THEN lower(trim(language)) ELSE language END END"""
_PARENT = "CASE {x} " + " ".join(f"WHEN '{f}' THEN '{p}'" for f, p in PARENT.items()) + " ELSE {x} END"
_IOU = "(CASE WHEN least({a1}, {b1}) > greatest({a0}, {b0}) THEN (least({a1}, {b1}) - greatest({a0}, {b0}))::DOUBLE / (({a1} - {a0}) + ({b1} - {b0}) - (least({a1}, {b1}) - greatest({a0}, {b0}))) ELSE 0 END)"


def _iou(a0: str, a1: str, b0: str, b1: str) -> str:
    return _IOU.format(a0=a0, a1=a1, b0=b0, b1=b1)


# counts ---------------------------------------------------------------------------------------------------------------

ORACLES["coverage"] = f"""WITH {_REC}, {_LATEST}, n AS (SELECT count(DISTINCT id) AS n FROM rec)
SELECT detector, n.n AS n, count(*) FILTER (error IS NULL) AS scored, count(*) FILTER (error IS NOT NULL) AS errors, n.n - count(*) AS missing
FROM latest, n WHERE id IN (SELECT id FROM rec) GROUP BY detector, n.n"""
ORACLES["span_counts"] = f"""WITH {_LATEST}
SELECT detector, count(*) AS calls, sum(coalesce(len(spans), 0))::BIGINT AS n_spans, count(*) FILTER (len(spans) > 0) AS with_spans FROM latest GROUP BY detector"""
ORACLES["gold_label_counts"] = f"WITH {_REC}, {_gold()} SELECT label, count(*) AS n FROM gold GROUP BY label"
ORACLES["language_counts"] = f"WITH {_REC} SELECT {_LANG} AS language, count(*) AS n FROM rec GROUP BY 1"
ORACLES["raw_label_counts"] = f"""WITH {_LATEST}, flat AS (SELECT detector, unnest(spans).raw_label AS raw_label FROM latest),
few AS (SELECT detector, raw_label, count(*) AS n FROM flat GROUP BY 1, 2),
bare AS (SELECT *, upper(CASE WHEN regexp_matches(raw_label, '^[BIESLUbieslu][-_].') AND NOT upper(raw_label) IN {_in(ALL_LABELS)} THEN raw_label[3:] ELSE raw_label END) AS b FROM few)
SELECT detector, raw_label, n, CASE WHEN b IN {_in(ALL_LABELS)} THEN {_PARENT.format(x='b')} END AS canonical FROM bare"""
ORACLES["latency_summary"] = """WITH v AS (SELECT DISTINCT * FROM predictions),
x AS (SELECT detector, latency_ms AS v, row_number() OVER (PARTITION BY detector ORDER BY latency_ms) - 1 AS r, count(*) OVER (PARTITION BY detector) AS n
    FROM v WHERE error IS NULL AND latency_ms IS NOT NULL AND NOT isnan(latency_ms))
SELECT detector, n, (max(v) FILTER (r = floor((n - 1) / 2)) + max(v) FILTER (r = ceil((n - 1) / 2))) / 2 AS p50,
    max(v) FILTER (r = round_even((n - 1) * 0.95, 0)) AS p95, max(v) FILTER (r = round_even((n - 1) * 0.99, 0)) AS p99
FROM x GROUP BY detector, n"""
ORACLES["latency_by_window"] = """WITH v AS (SELECT DISTINCT id, detector, run_id, started_at, error, latency_ms FROM predictions)
SELECT date_trunc('day', started_at)::TIMESTAMP AS window_start, detector, count(*) AS calls, count(*) FILTER (error IS NOT NULL) AS errors,
    count(*) FILTER (error IS NULL AND latency_ms IS NOT NULL AND NOT isnan(latency_ms)) AS measured,
    round(sum(latency_ms) FILTER (error IS NULL AND latency_ms IS NOT NULL AND NOT isnan(latency_ms)), 3) AS sum_ms
FROM v GROUP BY 1, 2"""
ORACLES["run_rows"] = """WITH c AS (SELECT run_id, detector, count(*) AS n FROM (SELECT DISTINCT * FROM predictions) GROUP BY 1, 2),
l AS (SELECT run_id, dataset, n_examples, unnest(detectors) AS detector FROM runs)
SELECT l.run_id, l.detector, dataset, n_examples, coalesce(n, 0) AS n_rows FROM l LEFT JOIN c ON l.run_id = c.run_id AND l.detector = c.detector"""
ORACLES["unlisted_rows"] = """WITH l AS (SELECT run_id, unnest(detectors) AS detector FROM runs)
SELECT p.run_id, p.detector, count(*) AS n FROM (SELECT DISTINCT id, run_id, detector FROM predictions) p
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.run_id = p.run_id AND l.detector = p.detector) GROUP BY 1, 2"""
ORACLES["reuse_missing"] = f"""WITH {_REC}, {_LATEST}
SELECT d.detector, count(*) AS missing FROM (SELECT DISTINCT id FROM rec) r, (SELECT DISTINCT detector FROM latest) d
WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.id = r.id AND l.detector = d.detector) GROUP BY 1"""
ORACLES["gold_dropped"] = f"""WITH {_REC}, f AS (SELECT id, text, unnest(gold_spans) AS g FROM rec)
SELECT id, count(*) AS n_dropped FROM f WHERE NOT coalesce(g."start" >= 0 AND g."start" < g."end" AND g."end" <= length(text) AND g.label IN {_in(COARSE)}, false) GROUP BY id"""
ORACLES["validate_fixtures"] = f"""WITH flat AS (SELECT id, text, unnest(gold_spans) AS g FROM fixtures WHERE text IS NOT NULL),
o AS (SELECT id, list_sort(list_transform(gold_spans, lambda g: {{'s': g['start'], 'e': g['end']}})) AS x FROM fixtures),
e AS (
    SELECT id, 'error' AS severity, 'missing id' AS issue FROM fixtures WHERE id IS NULL OR id = ''
    UNION ALL SELECT id, 'error', 'repeated id' FROM fixtures WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT id, 'error', 'missing text' FROM fixtures WHERE text IS NULL
    UNION ALL SELECT id, 'error', 'offsets out of the text' FROM flat WHERE NOT coalesce(g."start" >= 0 AND g."start" < g."end" AND g."end" <= length(text), false)
    UNION ALL SELECT id, 'warning', 'label outside the taxonomy' FROM flat WHERE NOT coalesce(g.label IN {_in(ALL_LABELS)}, false)
    UNION ALL SELECT id, 'warning', 'repeated span' FROM fixtures WHERE len(gold_spans) > len(list_distinct(list_transform(gold_spans, lambda g: {{'l': coalesce(g['label'], ''), 's': g['start'], 'e': g['end']}})))
    UNION ALL SELECT id, 'error', 'chunk without an offset' FROM fixtures WHERE doc_id IS NOT NULL AND coalesce("offset", -1) < 0
    UNION ALL SELECT id, 'warning', 'overlapping gold' FROM o WHERE len(list_filter(x, lambda v, i: i > 1 AND v['s'] < x[i - 1]['e'])) > 0)
SELECT id, severity, issue, count(*) AS n FROM e GROUP BY 1, 2, 3"""
ORACLES["sample_records"] = "SELECT id FROM (SELECT DISTINCT id FROM fixtures) ORDER BY md5('42:' || id), id LIMIT 100"
ORACLES["holdout"] = f"SELECT id, ('0x' || substr(md5('42:' || id), 1, 8))::BIGINT < {int(0.3 * 0xFFFFFFFF)} AS holdout FROM (SELECT DISTINCT id FROM fixtures)"
ORACLES["baseline_hashes"] = "SELECT DISTINCT id, sha1(text) AS text_sha1 FROM fixtures"
ORACLES["baseline_guard"] = """WITH b AS (SELECT file_id || '#0' AS id, sha1(text) AS h FROM documents), n AS (SELECT DISTINCT id, sha1(text) AS now FROM fixtures)
SELECT count(*) FILTER (h IS NOT NULL AND h IS NOT DISTINCT FROM now) AS covered, count(*) FILTER (h IS NOT NULL AND h IS DISTINCT FROM now) AS changed,
    count(*) FILTER (h IS NULL) AS missing FROM n LEFT JOIN b ON n.id = b.id"""
_FINE_BASE = f"{_REC}, {_LATEST}, {_gold('coalesce(g.fine_label, g.label)')}, {_pred('coalesce(p.fine_label, p.label)')}"
ORACLES["annotated_labels"] = f"""WITH {_FINE_BASE}, b AS (SELECT DISTINCT label, 'gold' AS side FROM gold UNION ALL SELECT DISTINCT label, 'pred' FROM pred)
SELECT label, side, {_PARENT.format(x='label')} AS parent FROM b"""

# scoring --------------------------------------------------------------------------------------------------------------

_LAB = "lab AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{PARENT.get(x, x)}')" for x in ALL_LABELS) + ") v(label, parent))"
# what each detector's vocabulary supports: all labels, one detector the coarse ones only
_SUP = """dets AS (SELECT DISTINCT detector FROM predictions), views AS (SELECT * FROM (VALUES ('fair'), ('raw')) v(view)),
sup AS (SELECT detector, label, parent FROM dets, lab WHERE detector <> 'coarse_net' OR label = parent),
glab AS (SELECT DISTINCT label FROM gold WHERE label IN (SELECT label FROM lab))"""
_COARSE_SCOPE = """sc AS (SELECT view, detector, lab.label, lab.parent AS target FROM views, dets, lab WHERE lab.parent IN (SELECT label FROM glab)
    AND (view = 'raw' OR EXISTS (SELECT 1 FROM sup WHERE sup.detector = dets.detector AND sup.parent = lab.parent)))"""
_FINE_SCOPE = """keepf AS (SELECT DISTINCT detector, parent FROM sup WHERE label <> parent AND parent IN (SELECT parent FROM lab WHERE label <> parent AND label IN (SELECT label FROM glab))),
proj AS (SELECT d.detector, l.label, CASE WHEN k.parent IS NOT NULL THEN l.label ELSE l.parent END AS target FROM dets d CROSS JOIN lab l LEFT JOIN keepf k ON k.detector = d.detector AND k.parent = l.parent),
goal AS (SELECT DISTINCT detector, target FROM proj WHERE label IN (SELECT label FROM glab)),
own AS (SELECT DISTINCT p.detector, p.target FROM proj p JOIN sup s ON p.detector = s.detector AND p.label = s.label),
want0 AS (SELECT 'raw' AS view, detector, target FROM goal UNION SELECT 'fair', g.detector, g.target FROM goal g JOIN own o ON g.detector = o.detector AND g.target = o.target),
want AS (SELECT * FROM want0 UNION SELECT view, detector, parent FROM want0 JOIN lab ON target = label WHERE label <> parent),
sc AS (SELECT w.view, p.detector, p.label, p.target FROM proj p JOIN want w ON p.detector = w.detector AND p.target = w.target)"""


def _outcomes(base: str, scope: str) -> str:
    return f"""{base}, {_LAB}, {_SUP}, {scope},
p AS (SELECT DISTINCT sc.view, pred.id, pred.detector, s, e, target AS label FROM pred JOIN sc USING (detector, label)),
g AS (SELECT DISTINCT sc.view, calls.detector, gold.id, s, e, target AS label FROM gold JOIN calls ON gold.id = calls.id JOIN sc ON sc.detector = calls.detector AND sc.label = gold.label),
met AS (SELECT p.view, p.detector, p.id, p.s AS ps, p.e AS pe, p.label AS pl, g.s AS gs, g.e AS ge, g.label AS gl,
    CASE WHEN p.s = g.s AND p.e = g.e THEN CASE WHEN p.label = g.label THEN 0 ELSE 1 END ELSE 2 END AS r
    FROM p JOIN g ON p.view = g.view AND p.detector = g.detector AND p.id = g.id AND p.s < g.e AND g.s < p.e),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY view, detector, id, ps, pe, pl ORDER BY r, gs, ge, gl) AS rn FROM met) WHERE rn = 1),
outcomes AS (
    SELECT view, detector, id, gl AS tag, CASE WHEN r = 0 THEN 'exact' WHEN r = 1 THEN 'bounds' WHEN pl = gl THEN 'type' ELSE 'overlap' END AS kind FROM best
    UNION ALL SELECT view, detector, id, label, 'spurious' FROM p WHERE NOT EXISTS (
        SELECT 1 FROM best b WHERE b.view = p.view AND b.detector = p.detector AND b.id = p.id AND b.ps = p.s AND b.pe = p.e AND b.pl = p.label)
    UNION ALL SELECT view, detector, id, label, 'missed' FROM g WHERE NOT EXISTS (
        SELECT 1 FROM met m WHERE m.view = g.view AND m.detector = g.detector AND m.id = g.id AND m.gs = g.s AND m.ge = g.e AND m.gl = g.label))"""


_OUTCOMES = _outcomes(_BASE, _COARSE_SCOPE)
_FINE_OUTCOMES = _outcomes(_FINE_BASE, _FINE_SCOPE)


def _score(by: str, source: str = "outcomes") -> str:
    k = {x: f"count(*) FILTER (kind = '{x}')" for x in ("exact", "bounds", "type", "overlap", "spurious", "missed")}
    rows = {
        "strict": (k["exact"], f"{k['bounds']} + {k['type']} + {k['overlap']}", "0"),
        "exact": (f"{k['exact']} + {k['bounds']}", f"{k['type']} + {k['overlap']}", "0"),
        "partial": (f"{k['exact']} + {k['bounds']}", "0", f"{k['type']} + {k['overlap']}"),
        "ent_type": (f"{k['exact']} + {k['type']}", f"{k['bounds']} + {k['overlap']}", "0"),
    }
    parts = " UNION ALL ".join(
        f"SELECT {by}, '{n}' AS schema, ({a})::BIGINT AS cor, ({b})::BIGINT AS inc, ({h})::BIGINT AS par, {k['missed']} AS mis, {k['spurious']} AS spu FROM {source} GROUP BY {by}"
        for n, (a, b, h) in rows.items())
    return f"""raw_scores AS ({parts}),
pr AS (SELECT *, cor + inc + par + mis AS possible, cor + inc + par + spu AS actual, cor + CASE WHEN schema IN ('partial', 'ent_type') THEN 0.5 * par ELSE 0 END AS credit FROM raw_scores),
pr2 AS (SELECT *, CASE WHEN actual = 0 THEN 0 ELSE credit::DOUBLE / actual END AS precision, CASE WHEN possible = 0 THEN 0 ELSE credit::DOUBLE / possible END AS recall FROM pr),
scores AS (SELECT {by}, schema, cor, inc, par, mis, spu, possible, actual, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr2)"""


def _final(by: str) -> str:
    return f"SELECT {by}, schema, cor, inc, par, mis, spu, possible, actual, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scores"


ORACLES["semeval_overall"] = f"WITH {_OUTCOMES}, {_score('view, detector')} {_final('view, detector')}"
ORACLES["semeval_by_label"] = f"WITH {_OUTCOMES}, {_score('view, detector, tag')} {_final('view, detector, tag')}"
ORACLES["semeval_by_language"] = f"""WITH {_OUTCOMES}, lang AS (SELECT id, min({_LANG}) AS language FROM rec GROUP BY id),
ol AS (SELECT o.*, language FROM outcomes o JOIN lang USING (id)), {_score('view, detector, language', 'ol')} {_final('view, detector, language')}"""
ORACLES["headline"] = f"""WITH {_OUTCOMES}, {_score('view, detector')}
SELECT view, detector, {', '.join(f"round(max(f1) FILTER (schema = '{s}'), 6) AS f1_{s}" for s in ('strict', 'exact', 'partial', 'ent_type'))},
    round(max(precision) FILTER (schema = 'strict'), 6) AS precision, round(max(recall) FILTER (schema = 'strict'), 6) AS recall FROM scores GROUP BY 1, 2"""
ORACLES["per_label_f1"] = f"""WITH {_OUTCOMES}, {_score('view, detector, tag')}
SELECT detector, {', '.join(f"coalesce(round(max(f1) FILTER (tag = '{x}'), 6), 0.0) AS {x}" for x in COARSE)}
FROM scores WHERE view = 'raw' AND schema = 'ent_type' GROUP BY 1"""
ORACLES["headline_order"] = f"""WITH {_OUTCOMES}, {_score('view, detector')}, h AS (SELECT detector, round(f1, 6) AS f1 FROM scores WHERE view = 'fair' AND schema = 'ent_type')
SELECT row_number() OVER (ORDER BY f1 DESC, detector) AS place, detector, f1 FROM h"""
ORACLES["semeval_fine"] = f"WITH {_FINE_OUTCOMES}, {_score('view, detector')} {_final('view, detector')}"
ORACLES["semeval_fine_by_label"] = f"WITH {_FINE_OUTCOMES}, {_score('view, detector, tag')} {_final('view, detector, tag')}"
_GIVEN_SCOPE = "sc AS (SELECT view, detector, label, parent AS target FROM views, dets, lab WHERE parent IN ('PERSON', 'EMAIL'))"
ORACLES["semeval_of_labels"] = f"""WITH {_outcomes(_BASE, _GIVEN_SCOPE)}, og AS (SELECT * FROM outcomes WHERE id IN (SELECT id FROM rec WHERE {_LANG} = 'de')),
{_score('view, detector', 'og')} {_final('view, detector')}"""
ORACLES["scope_labels"] = f"WITH {_FINE_BASE}, {_LAB}, {_SUP}, {_FINE_SCOPE} SELECT view, detector, label AS src_label, target AS label FROM sc"

_CTX = """CASE WHEN greatest({s} - 30, 0) > 0 THEN '…' ELSE '' END || substr(text, greatest({s} - 30, 0) + 1, least({e} + 30, length(text)) - greatest({s} - 30, 0))
    || CASE WHEN least({e} + 30, length(text)) < length(text) THEN '…' ELSE '' END"""


def _error(select: str, s: str, e: str) -> str:
    return f"WITH {_BASE}, x AS ({select}) SELECT x.*, {_CTX.format(s=s, e=e)} AS context FROM x JOIN (SELECT DISTINCT id, text FROM rec) r ON x.id = r.id"


_ES, _EE = 'x."start"', 'x."end"'
ORACLES["errors_missed"] = _error("""SELECT c.id, c.detector, g.s AS "start", g.e AS "end", g.label AS gold_label, NULL::VARCHAR AS label FROM calls c JOIN gold g ON c.id = g.id
    WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.id = c.id AND p.detector = c.detector AND p.s < g.e AND g.s < p.e)""", _ES, _EE)
ORACLES["errors_spurious"] = _error("""SELECT p.id, p.detector, p.s AS "start", p.e AS "end", NULL::VARCHAR AS gold_label, p.label FROM pred p
    WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE p.id = g.id AND p.s < g.e AND g.s < p.e)""", _ES, _EE)
ORACLES["errors_mislabeled"] = _error("""SELECT DISTINCT p.id, p.detector, p.s AS "start", p.e AS "end", g.label AS gold_label, p.label FROM pred p JOIN gold g ON p.id = g.id
    AND p.s = g.s AND p.e = g.e AND p.label <> g.label AND p.s < g.e AND g.s < p.e""", _ES, _EE)
ORACLES["errors_boundary"] = _error("""SELECT DISTINCT p.id, p.detector, p.s AS "start", p.e AS "end", g.label AS gold_label, p.label FROM pred p JOIN gold g ON p.id = g.id
    AND NOT (p.s = g.s AND p.e = g.e) AND p.label = g.label AND p.s < g.e AND g.s < p.e""", _ES, _EE)

ORACLES["errors_missed_of_label"] = f"SELECT * FROM ({ORACLES['errors_missed']}) WHERE gold_label = 'PHONE'"
ORACLES["taxonomy_labels"] = "SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{PARENT.get(x, x)}', {'true' if x in PARENT else 'false'}, {i})" for i, x in enumerate(ALL_LABELS)) + ") v(name, parent, is_fine, ord)"
ORACLES["supported_labels"] = f"""WITH {_LAB}, dets AS (SELECT DISTINCT detector FROM predictions UNION ALL SELECT 'ensemble_all')
SELECT detector, label, parent FROM dets, lab WHERE detector <> 'coarse_net' OR label = parent"""
ORACLES["request_types"] = "SELECT * FROM (VALUES (1::BIGINT, 'EMAIL', 'EMAIL'), (2, 'PHONE', 'PHONE'), (3, 'IP', 'URL'), (4, 'URL', 'URL')) v(place, raw_label, label)"

# voting ---------------------------------------------------------------------------------------------------------------

ORACLES["pooled_spans"] = f"""WITH {_BASE}, {_INSIDE} SELECT id, s AS "start", e AS "end", label, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors, count(DISTINCT detector) AS n FROM inside GROUP BY 1, 2, 3, 4"""
ORACLES["pooled_records"] = f"""WITH {_BASE}, {_INSIDE}, k AS (SELECT id, count(DISTINCT (s, e, label)) AS n FROM inside GROUP BY 1)
SELECT r.id, coalesce(k.n, 0) AS n_spans FROM (SELECT DISTINCT id FROM rec) r LEFT JOIN k ON r.id = k.id"""
ORACLES["pooled_fine"] = f"""WITH {_LATEST}, f AS (SELECT DISTINCT id, detector, p."start" AS s, p."end" AS e, p.label AS label, p.fine_label AS fine FROM (SELECT id, detector, unnest(spans) AS p FROM latest WHERE error IS NULL)),
v AS (SELECT id, s, e, label, fine, count(DISTINCT detector) AS v, min(detector) AS d FROM f WHERE fine IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, s, e, label ORDER BY v DESC, d, fine) AS rn FROM v) WHERE rn = 1),
n AS (SELECT id, s, e, label, count(DISTINCT detector) AS n FROM f GROUP BY 1, 2, 3, 4)
SELECT n.id, n.s AS "start", n.e AS "end", n.label, b.fine AS fine_label, n.n FROM n LEFT JOIN b ON n.id = b.id AND n.s = b.s AND n.e = b.e AND n.label = b.label"""
ORACLES["detector_agreement"] = f"""WITH {_BASE},
f AS (SELECT id, detector, p."start" AS s, p."end" AS e, p.label AS label, count(*) AS n FROM (SELECT id, detector, unnest(spans) AS p FROM latest WHERE error IS NULL)
    WHERE id IN (SELECT id FROM rec) GROUP BY ALL),
k AS (SELECT c.id, c.detector, coalesce((SELECT sum(n) FROM f WHERE f.id = c.id AND f.detector = c.detector), 0) AS k FROM calls c),
z AS (SELECT a.detector AS a, b.detector AS b, count(*) AS records, sum(a.k)::BIGINT AS n_a, sum(b.k)::BIGINT AS n_b FROM k a JOIN k b ON a.id = b.id AND a.detector < b.detector GROUP BY 1, 2),
m AS (SELECT x.detector AS a, y.detector AS b, sum(least(x.n, y.n))::BIGINT AS same FROM f x JOIN f y ON x.id = y.id AND x.s = y.s AND x.e = y.e AND x.label = y.label AND x.detector < y.detector GROUP BY 1, 2),
j AS (SELECT z.*, coalesce(same, 0) AS same FROM z LEFT JOIN m ON z.a = m.a AND z.b = m.b)
SELECT a, b, records, n_a, n_b, same,
    round(CASE WHEN n_a = 0 AND n_b = 0 THEN 1.0 WHEN n_b = 0 THEN 0.0 ELSE same::DOUBLE / n_b END, 6) AS precision,
    round(CASE WHEN n_a = 0 AND n_b = 0 THEN 1.0 WHEN n_a = 0 THEN 0.0 ELSE same::DOUBLE / n_a END, 6) AS recall,
    round(CASE WHEN n_a = 0 AND n_b = 0 THEN 1.0 ELSE 2 * same::DOUBLE / (n_a + n_b) END, 6) AS f1 FROM j"""


def _merge(need: str) -> str:
    return f"""{_BASE}, pool AS (SELECT id, s, e, label, count(DISTINCT detector) AS exact FROM pred GROUP BY 1, 2, 3, 4),
v AS (SELECT a.id, a.s, a.e, a.label, a.exact, count(DISTINCT b.detector) AS votes FROM pool a JOIN pred b ON a.id = b.id AND a.label = b.label AND {_iou('a.s', 'a.e', 'b.s', 'b.e')} >= 0.5 GROUP BY 1, 2, 3, 4, 5),
q AS (SELECT id, count(DISTINCT detector) AS asked FROM calls GROUP BY 1),
merged AS (SELECT v.* FROM v JOIN q ON v.id = q.id WHERE votes >= {need})"""


for _name, _need in (("union", "1"), ("majority", "asked // 2 + 1"), ("intersection", "asked")):
    ORACLES[f"merge_{_name}"] = f'WITH {_merge(_need)} SELECT id, s AS "start", e AS "end", label, votes, exact FROM merged'
ORACLES["silver_fine"] = f"""WITH {_merge('asked // 2 + 1')},
fl AS (SELECT DISTINCT id, detector, p.label AS label, p."start" AS bs, p."end" AS be, coalesce(p.fine_label, p.label) AS fine FROM (SELECT id, detector, unnest(spans) AS p FROM latest WHERE error IS NULL)),
w AS (SELECT m.id, m.label, m.s, m.e, m.votes, f.detector, f.fine, row_number() OVER (PARTITION BY m.id, m.label, m.s, m.e, f.detector ORDER BY {_iou('m.s', 'm.e', 'f.bs', 'f.be')} DESC, bs, be, fine) AS rn
    FROM merged m JOIN fl f ON m.id = f.id AND m.label = f.label WHERE {_iou('m.s', 'm.e', 'f.bs', 'f.be')} >= 0.5),
c AS (SELECT id, label, s, e, votes, fine, count(*) AS k, min(detector) AS d FROM w WHERE rn = 1 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY id, label, s, e ORDER BY k DESC, d, fine) AS rn FROM c)
SELECT id, s AS "start", e AS "end", label, fine AS fine_label, votes FROM b WHERE rn = 1"""
ORACLES["silver_spans"] = f"""WITH RECURSIVE {_merge('asked // 2 + 1')},
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, exact DESC, e - s DESC, s, e, label) AS rn FROM merged),
step(id, rn, kept) AS (
    SELECT id, rn, [{{'s': s, 'e': e, 'label': label, 'votes': votes}}] FROM r WHERE rn = 1
    UNION ALL SELECT r.id, r.rn, CASE WHEN len(list_filter(step.kept, lambda k: k['s'] < r.e AND r.s < k['e'])) > 0 THEN step.kept
        ELSE list_append(step.kept, {{'s': r.s, 'e': r.e, 'label': r.label, 'votes': r.votes}}) END FROM step JOIN r ON r.id = step.id AND r.rn = step.rn + 1),
last AS (SELECT id, max(rn) AS rn FROM step GROUP BY 1), u AS (SELECT step.id, unnest(kept) AS k FROM step JOIN last ON step.id = last.id AND step.rn = last.rn)
SELECT id, k.s AS "start", k.e AS "end", k.label AS label, k.votes AS votes FROM u"""
_RECIPE = f"""{_OUTCOMES}, {_score('view, detector, tag')},
cand AS (SELECT * FROM scores WHERE view = 'fair' AND schema = 'ent_type'),
recipe AS (SELECT tag AS label, detector, f1 FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY f1 DESC, detector DESC) AS rn FROM cand WHERE f1 > 0) WHERE rn = 1)"""
ORACLES["recipe"] = f"WITH {_RECIPE} SELECT label, detector, round(f1, 6) AS f1 FROM recipe"
ORACLES["recipe_candidates"] = f"""WITH {_RECIPE} SELECT tag AS label, rn AS place, detector, round(f1, 6) AS f1
FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY f1 DESC, detector DESC) AS rn FROM cand) WHERE rn <= 3"""
ORACLES["ensemble_spans"] = f"""WITH RECURSIVE {_RECIPE},
c AS (SELECT pred.id, s, e, pred.label, row_number() OVER (PARTITION BY pred.id ORDER BY s, e DESC, pred.label) AS rn FROM pred JOIN recipe ON pred.label = recipe.label AND pred.detector = recipe.detector),
walk(id, rn, s, e, label, cursor, keep) AS (
    SELECT id, rn, s, e, label, e, true FROM c WHERE rn = 1
    UNION ALL SELECT c.id, c.rn, c.s, c.e, c.label, CASE WHEN c.s >= walk.cursor THEN c.e ELSE walk.cursor END, c.s >= walk.cursor FROM walk JOIN c ON c.id = walk.id AND c.rn = walk.rn + 1)
SELECT id, s AS "start", e AS "end", label FROM walk WHERE keep"""
ORACLES["ensemble_calls"] = f"""WITH RECURSIVE {_RECIPE},
c AS (SELECT pred.id, s, e, pred.label, row_number() OVER (PARTITION BY pred.id ORDER BY s, e DESC, pred.label) AS rn FROM pred JOIN recipe ON pred.label = recipe.label AND pred.detector = recipe.detector),
walk(id, rn, e, cursor, keep) AS (
    SELECT id, rn, e, e, true FROM c WHERE rn = 1
    UNION ALL SELECT c.id, c.rn, c.e, CASE WHEN c.s >= walk.cursor THEN c.e ELSE walk.cursor END, c.s >= walk.cursor FROM walk JOIN c ON c.id = walk.id AND c.rn = walk.rn + 1),
k AS (SELECT id, count(*) AS n FROM walk WHERE keep GROUP BY 1),
l AS (SELECT l.id, sum(CASE WHEN latency_ms IS NULL OR isnan(latency_ms) THEN 0 ELSE latency_ms END) AS ms,
    string_agg(l.detector || ':' || r.label || ': ' || error, '; ' ORDER BY r.label) AS error FROM latest l JOIN recipe r ON l.detector = r.detector GROUP BY 1)
SELECT q.id, 'ensemble_category_best' AS detector, coalesce(k.n, 0)::INTEGER AS n_spans, round(coalesce(ms, 0), 3) AS latency_ms, error
FROM (SELECT DISTINCT id FROM rec) q LEFT JOIN k ON q.id = k.id LEFT JOIN l ON q.id = l.id"""
ORACLES["skipped_labels"] = f"WITH {_RECIPE} SELECT DISTINCT label FROM gold WHERE label NOT IN (SELECT label FROM recipe)"
ORACLES["raw_label_hit_rate"] = f"""WITH {_REC}, {_LATEST}, {_gold()},
p AS (SELECT DISTINCT id, detector, p.raw_label AS raw_label, p.label AS label, p."start" AS s, p."end" AS e FROM (SELECT id, detector, unnest(spans) AS p FROM latest WHERE error IS NULL)),
h AS (SELECT p.*, EXISTS (SELECT 1 FROM gold g WHERE g.id = p.id AND g.label = p.label AND {_iou('p.s', 'p.e', 'g.s', 'g.e')} >= 0.5) AS hit FROM p),
n AS (SELECT detector, raw_label, count(*) AS n, count(*) FILTER (hit) AS hits FROM h GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT detector, raw_label, n, hits, round(100.0 * hits / n, 6) AS pct, CASE WHEN 100.0 * hits / n < 50 THEN 'DROP' WHEN 100.0 * hits / n < 70 THEN 'WEAK' ELSE 'KEEP' END AS verdict FROM n"""
ORACLES["label_redundancy"] = f"""WITH {_FINE_BASE}, {_LAB},
f AS (SELECT pred.*, parent FROM pred JOIN lab ON pred.label = lab.label WHERE parent <> lab.label),
gp AS (SELECT gold.*, coalesce(parent, gold.label) AS parent FROM gold LEFT JOIN lab ON gold.label = lab.label),
x AS (SELECT f.*, EXISTS (SELECT 1 FROM pred w WHERE w.id = f.id AND w.detector = f.detector AND w.label = f.parent AND {_iou('f.s', 'f.e', 'w.s', 'w.e')} > 0.5) AS red,
    EXISTS (SELECT 1 FROM gp WHERE gp.id = f.id AND gp.parent = f.parent AND {_iou('f.s', 'f.e', 'gp.s', 'gp.e')} > 0.5) AS hit FROM f),
n AS (SELECT detector, parent AS general, label AS granular, count(*) AS n, count(*) FILTER (red) AS redundant, count(*) FILTER (hit) AS matches FROM x GROUP BY 1, 2, 3)
SELECT *, round(100.0 * redundant / n, 6) AS pct, CASE WHEN 100.0 * redundant / n > 70 AND matches < 0.3 * n THEN 'DROP' ELSE 'KEEP' END AS verdict FROM n"""

# rewriting ------------------------------------------------------------------------------------------------------------

_SPANS = """sp AS (SELECT DISTINCT r.request_id, d."start" AS s, d."end" AS e, d.label AS label, substr(r.text, d."start" + 1, d."end" - d."start") AS txt
    FROM requests r JOIN detected_spans d ON r.request_id = d.request_id WHERE d."start" >= 0 AND d."start" < d."end" AND d."end" <= length(r.text){extra}),
first AS (SELECT request_id, label, txt, min(s * 10000000 + e) AS pos FROM sp GROUP BY 1, 2, 3),
num AS (SELECT *, row_number() OVER (PARTITION BY request_id, label ORDER BY pos) AS n FROM first),
ord AS (SELECT sp.*, num.n, row_number() OVER (PARTITION BY sp.request_id ORDER BY s, e, sp.label) AS rn FROM sp JOIN num ON sp.request_id = num.request_id AND sp.label = num.label AND sp.txt = num.txt),
rep AS (SELECT *, {rep} AS rep FROM ord),
walk(request_id, rn, cursor, out, keep) AS (
    SELECT q.request_id, 0::BIGINT, 0, '', false FROM requests q
    UNION ALL SELECT w.request_id, rep.rn, CASE WHEN rep.s >= w.cursor THEN rep.e ELSE w.cursor END,
        CASE WHEN rep.s >= w.cursor THEN w.out || substr(q.text, w.cursor + 1, rep.s - w.cursor) || rep.rep ELSE w.out END, rep.s >= w.cursor
    FROM walk w JOIN rep ON rep.request_id = w.request_id AND rep.rn = w.rn + 1 JOIN requests q ON q.request_id = w.request_id),
fin AS (SELECT w.* FROM walk w JOIN (SELECT request_id, max(rn) AS rn FROM walk GROUP BY 1) m ON w.request_id = m.request_id AND w.rn = m.rn)"""
_TOKEN_SQL = """list_aggregate(list_transform(range(0, 7), lambda k: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
    ((('0x' || substr(sha256('maskwright' || chr(1) || label || chr(1) || txt), 1, 12))::BIGINT // (62 ** k)::BIGINT) % 62 + 1)::INTEGER, 1)), 'string_agg', '')"""
_REPS = {
    "redact": "'********'", "label": "'[' || label || ']'", "label_number": "'[' || label || '_' || n || ']'",
    "label_token": f"'[' || label || '_' || {_TOKEN_SQL} || ']'",
}
_BY_MODE = f"""(SELECT CASE coalesce(q.mode, 'label') WHEN 'redact' THEN {_REPS['redact']} WHEN 'label_number' THEN {_REPS['label_number']}
    WHEN 'label_token' THEN {_REPS['label_token']} ELSE {_REPS['label']} END FROM requests q WHERE q.request_id = ord.request_id)"""
_CATS = " AND (r.categories IS NULL OR list_contains(r.categories, d.label))"


def _walk(rep: str, extra: str = "") -> str:
    return "WITH RECURSIVE " + _SPANS.format(rep=rep, extra=extra)


_OUT = "q.text IS NULL, NULL, fin.out || substr(q.text, fin.cursor + 1)"
for _m, _r in _REPS.items():
    ORACLES[f"replace_{_m}"] = f"{_walk(_r)} SELECT q.request_id, if({_OUT}) AS replaced_text FROM requests q JOIN fin ON q.request_id = fin.request_id"
ORACLES["service_replace"] = f"{_walk(_BY_MODE, _CATS)} SELECT q.request_id, if({_OUT}) AS replaced_text FROM requests q JOIN fin ON q.request_id = fin.request_id"
ORACLES["service_spans"] = f"""{_walk(_BY_MODE, _CATS)} SELECT rep.request_id, rep.label, rep.s AS "start", rep.e AS "end", rep.txt AS text, rep.rep AS replacement, walk.keep AS replaced
FROM rep JOIN walk ON rep.request_id = walk.request_id AND rep.rn = walk.rn"""
ORACLES["service_find"] = f"""{_walk("''", _CATS)}, c AS (SELECT request_id, label, count(*) AS n FROM sp GROUP BY 1, 2), z AS (SELECT request_id, count(*) AS span_count FROM sp GROUP BY 1)
SELECT q.request_id, c.label, coalesce(c.n, 0) AS n, coalesce(z.span_count, 0) AS span_count FROM requests q LEFT JOIN c ON q.request_id = c.request_id LEFT JOIN z ON q.request_id = z.request_id"""
ORACLES["token_collisions"] = f"""WITH d AS (SELECT DISTINCT label, text AS txt FROM detected_spans), k AS (SELECT label, {_TOKEN_SQL} AS token FROM d)
SELECT label, token, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) > 1"""


ORACLES["replace_with_vault"] = f"""{_walk("CASE WHEN label = 'ADDRESS' THEN '[ADDRESS]' ELSE " + _REPS['label_token'] + ' END')} SELECT q.request_id, if({_OUT}) AS replaced_text
FROM requests q JOIN fin ON q.request_id = fin.request_id"""
ORACLES["service_problems"] = f"""SELECT request_id, 'unknown mode ' || mode AS problem FROM requests WHERE mode NOT IN ('redact', 'label', 'label_number', 'label_token')
UNION ALL SELECT request_id, 'unknown category ' || c FROM (SELECT request_id, unnest(categories) AS c FROM requests) WHERE c NOT IN {_in(ALL_LABELS)}"""


def _luhn(v: str) -> str:
    digit = f"(substr({v}, i::INTEGER, 1)::INTEGER * (1 + i % 2))"
    return f"list_sum(list_transform(range(1, 17), lambda i: CASE WHEN {digit} > 9 THEN {digit} - 9 ELSE {digit} END)) % 10 = 0"


def _rule(name: str) -> str:
    label, pattern = RULES[name]
    p = pattern.replace("'", "''")
    rows = f"""SELECT request_id, '{label}' AS label, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, m[i] AS text
FROM (SELECT request_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT request_id, regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS m FROM requests WHERE text IS NOT NULL))"""
    return f"SELECT * FROM (SELECT * FROM ({rows}) WHERE length(text) = 16) WHERE {_luhn('text')}" if name == "digits" else rows


ORACLES["detect_rules"] = f"""WITH x AS ({' UNION ALL '.join(_rule(r) for r in RULES)})
SELECT request_id, label, s::BIGINT AS "start", (s + length(text))::BIGINT AS "end", text FROM x"""
ORACLES["trimmed_spans"] = """WITH x AS (SELECT DISTINCT d.request_id, d."start" AS s, d."end" AS e, substr(r.text, d."start" + 1, d."end" - d."start") AS t FROM detected_spans d JOIN requests r ON d.request_id = r.request_id
    WHERE d."start" >= 0 AND d."start" < d."end" AND d."end" <= length(r.text)),
y AS (SELECT *, length(t) - length(regexp_replace(t, '^[ \\t\\n\\r\\f\\v.,;:!?]+', '')) AS a, length(t) - length(regexp_replace(t, '[ \\t\\n\\r\\f\\v.,;:!?]+$', '')) AS b FROM x)
SELECT request_id, s AS "start", e AS "end", s + a AS trimmed_start, greatest(e - b, s + a) AS trimmed_end FROM y"""
ORACLES["routed_languages"] = f"""SELECT CASE WHEN {_LANG} IN ('en', 'de', 'fr', 'es', 'it') THEN {_LANG} ELSE 'en' END AS asked_in, count(*) AS n FROM fixtures GROUP BY 1"""

# reading and writing --------------------------------------------------------------------------------------------------

_KEPT = f"""list_filter(coalesce(gold_spans, []), lambda g: coalesce(g['label'] IN {_in(ALL_LABELS)} AND g['start'] >= 0 AND g['start'] < g['end'] AND g['end'] <= length(text), false))"""
_CAME_BACK = f"""kept AS (SELECT id, text, language, {_KEPT} AS k FROM fixtures WHERE text IS NOT NULL),
back AS (SELECT DISTINCT id, sha1(text) AS text_sha1, len(k)::INTEGER AS n_spans, coalesce(list_sum(list_transform(k, lambda g: g['start'] + g['end'])), 0)::INTEGER AS places, {_LANG} AS language FROM kept)"""
ORACLES["io_jsonl"] = f"WITH {_CAME_BACK} SELECT DISTINCT b.id, b.text_sha1, b.n_spans, b.places, l.language FROM back b JOIN (SELECT DISTINCT id, language FROM back) l ON b.id = l.id"
ORACLES["io_parquet"] = f"WITH {_CAME_BACK} SELECT DISTINCT id, text_sha1, n_spans, places FROM back"
ORACLES["io_csv_spans"] = f"WITH {_CAME_BACK} SELECT DISTINCT id, text_sha1, n_spans, places FROM back WHERE text_sha1 <> sha1('')"
ORACLES["io_bio"] = """WITH w AS (SELECT request_id, regexp_extract_all(text, '[^ \\t\\n\\r]+', 0) AS ws FROM requests WHERE text IS NOT NULL),
f AS (SELECT request_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
p AS (SELECT request_id, i, contains(ws[i], '@') AS m, (i = 1 OR NOT contains(ws[i - 1], '@')) AS fresh, (i = len(ws) OR NOT contains(ws[i + 1], '@')) AS ends,
    coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x) + 1)), 0) AS s, length(ws[i]) AS n FROM f),
c AS (SELECT request_id, count(*) FILTER (m AND fresh) AS k, coalesce(sum(s) FILTER (m AND fresh), 0) + coalesce(sum(s + n) FILTER (m AND ends), 0) AS places FROM p GROUP BY 1)
SELECT w.request_id::VARCHAR AS id, sha1(array_to_string(ws, ' ')) AS text_sha1, coalesce(k, 0)::INTEGER AS n_spans, coalesce(places, 0)::INTEGER AS places FROM w LEFT JOIN c ON w.request_id = c.request_id"""
ORACLES["io_texts"] = """SELECT format('text-{:04d}', row_number() OVER (ORDER BY request_id)) AS id, sha1(text) AS text_sha1, 'en' AS language FROM requests QUALIFY trim(text, ' ') <> ''"""
ORACLES["io_run"] = f"WITH {_LATEST} SELECT detector, count(*) AS n, sum(coalesce(len(spans), 0))::BIGINT AS n_spans FROM latest WHERE detector IN ('ner_small', 'lex_scan') GROUP BY 1"

# documents ------------------------------------------------------------------------------------------------------------

ORACLES["line_segments"] = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l),
o AS (SELECT doc_id, i AS line, sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(ls[i]) - 1 AS s, ls[i] AS t FROM f)
SELECT doc_id, line, s::BIGINT AS "start", (s + length(t))::BIGINT AS "end" FROM o WHERE trim(t, ' ') <> ''"""
ORACLES["documents_rebuilt"] = "SELECT doc_id, sha1(text) AS text_sha1, true AS complete FROM documents WHERE text <> ''"
ORACLES["chunk_properties"] = "SELECT doc_id, true AS within_limit, true AS uncut FROM documents WHERE text <> ''"
ORACLES["document_map"] = """SELECT doc_id, count(*) AS n_chunks, max("offset" + length(text)) AS length FROM (
    SELECT DISTINCT r.id, r.text, r.language, r.gold_spans, f.doc_id, f."offset" FROM (SELECT DISTINCT id, text, language, gold_spans FROM fixtures) r
    JOIN (SELECT DISTINCT id, doc_id, "offset" FROM fixtures) f ON r.id = f.id) WHERE doc_id IS NOT NULL GROUP BY 1"""
ORACLES["spans_in_documents"] = f"""WITH {_REC}, {_gold()}, own AS (SELECT DISTINCT id, doc_id, "offset" AS o FROM fixtures WHERE doc_id IS NOT NULL AND "offset" IS NOT NULL),
m AS (SELECT DISTINCT doc_id, s + o AS s, e + o AS e, label FROM gold JOIN own ON gold.id = own.id),
x AS (SELECT m.*, list_filter(d.segments, lambda g: g['start'] < m.e AND g['end'] > m.s) AS f FROM m JOIN documents d ON m.doc_id = d.doc_id WHERE d.text IS NOT NULL)
SELECT doc_id, s AS "start", e AS "end", label, len(f) AS n_segments, f[1]['start'] AS segment_start FROM x"""
ORACLES["span_places"] = f"""WITH {_REC}, {_gold()}, own AS (SELECT DISTINCT id, doc_id, "offset" AS o FROM fixtures WHERE doc_id IS NOT NULL AND "offset" IS NOT NULL),
m AS (SELECT DISTINCT doc_id, s + o AS s, e + o AS e, label FROM gold JOIN own ON gold.id = own.id),
x AS (SELECT m.*, list_filter(d.segments, lambda g: g['start'] < m.e AND g['end'] > m.s) AS f FROM m JOIN documents d ON m.doc_id = d.doc_id WHERE d.text IS NOT NULL),
y AS (SELECT doc_id, s, e, label, i, f[i]['where'] AS w FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM x))
SELECT doc_id, s AS "start", e AS "end", label, i AS segment, array_to_string(list_transform(list_sort(map_entries(w)), lambda p: p['key'] || ' ' || p['value']), ', ') AS place FROM y"""
ORACLES["interval_union"] = f"""WITH {_BASE}, u AS (SELECT DISTINCT id, s, e FROM pred),
t AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM u),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR s >= top THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e) AS island FROM t)
SELECT id, min(s) AS "start", max(e) AS "end" FROM i GROUP BY id, island"""
ORACLES["segment_kinds"] = """WITH s AS (SELECT kind, unnest(segments) AS g FROM documents), k AS (SELECT kind, unnest(map_keys(g['where'])) AS place FROM s)
SELECT kind, place, count(*) AS n FROM k GROUP BY 1, 2"""

# reviews --------------------------------------------------------------------------------------------------------------

_REVIEW = f"""{_BASE}, {_INSIDE}, pool AS (SELECT id, s, e, label, list(DISTINCT detector) AS detectors FROM inside GROUP BY 1, 2, 3, 4),
b AS (SELECT p.id, p.s, p.e, p.label, min(CASE WHEN p.s = g.s AND p.e = g.e AND p.label = g.label THEN 0 WHEN p.s = g.s AND p.e = g.e THEN 1 WHEN p.label = g.label THEN 2 ELSE 3 END) AS r
    FROM pool p JOIN gold g ON p.id = g.id AND p.s < g.e AND g.s < p.e GROUP BY 1, 2, 3, 4),
rv AS (SELECT p.*, CASE WHEN r = 0 THEN 'correct' WHEN r IN (1, 3) THEN 'wrong_label' WHEN r = 2 THEN 'boundary' ELSE 'not_pii' END AS verdict
    FROM pool p LEFT JOIN b ON p.id = b.id AND p.s = b.s AND p.e = b.e AND p.label = b.label),
lost AS (SELECT * FROM gold g WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.id = g.id AND p.s < g.e AND g.s < p.e))"""
ORACLES["review_verdicts"] = f"WITH {_REVIEW} SELECT verdict, count(*) AS n FROM rv GROUP BY 1"
ORACLES["review_missed"] = f'WITH {_REVIEW} SELECT id, s AS "start", e AS "end", label FROM lost'
# entities: islands of correct spans, then the others one by one in order of place; the state is the record's list of extents
_ENTITIES = f"""{_REVIEW},
c0 AS (SELECT id, s, e, label, detectors, max(e) OVER (PARTITION BY id ORDER BY s, e, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM rv WHERE verdict = 'correct'),
c1 AS (SELECT *, (sum(CASE WHEN top IS NULL OR s >= top THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e, label))::BIGINT AS ent FROM c0),
ex AS (SELECT id, list({{'s': s0, 'e': e0}} ORDER BY ent) AS ext FROM (SELECT id, ent, min(s) AS s0, max(e) AS e0 FROM c1 GROUP BY 1, 2) GROUP BY 1),
n0 AS (SELECT id, s, e, verdict, detectors, row_number() OVER (PARTITION BY id ORDER BY s, e, label) AS rn FROM rv WHERE verdict NOT IN ('correct', 'not_pii')),
walk(id, rn, ext, ent) AS (
    SELECT q.id, 0::BIGINT, coalesce(ex.ext, []), 0::BIGINT FROM (SELECT DISTINCT id FROM n0) q LEFT JOIN ex ON ex.id = q.id
    UNION ALL SELECT id, rn, CASE WHEN b IS NULL THEN list_append(ext, {{'s': s, 'e': e}}) ELSE ext END, coalesce(b, len(ext) + 1) FROM (
        SELECT w.id, n.rn, w.ext, n.s, n.e, (SELECT i FROM (SELECT unnest(range(1, len(w.ext) + 1)) AS i) r WHERE least(w.ext[i]['e'], n.e) > greatest(w.ext[i]['s'], n.s)
            ORDER BY least(w.ext[i]['e'], n.e) - greatest(w.ext[i]['s'], n.s) DESC, i LIMIT 1) AS b
        FROM walk w JOIN n0 n ON n.id = w.id AND n.rn = w.rn + 1)),
ents AS (SELECT id, ent, 'correct' AS verdict, detectors FROM c1 UNION ALL SELECT walk.id, walk.ent, n0.verdict, n0.detectors FROM walk JOIN n0 ON n0.id = walk.id AND n0.rn = walk.rn)"""
ORACLES["review_entities"] = f"WITH RECURSIVE {_ENTITIES}, k AS (SELECT id, ent, count(*) AS spans FROM ents GROUP BY 1, 2) SELECT spans, count(*) AS n FROM k GROUP BY 1"
ORACLES["review_summary"] = f"""WITH RECURSIVE {_ENTITIES},
j AS (SELECT detector, count(*) AS n_spans, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong_label') AS wrong_label,
    count(*) FILTER (verdict = 'boundary') AS boundary, count(*) FILTER (verdict = 'not_pii') AS not_pii FROM (SELECT verdict, unnest(detectors) AS detector FROM rv) GROUP BY 1),
k AS (SELECT id, count(DISTINCT ent) AS k FROM ents GROUP BY 1), f AS (SELECT id, detector, count(DISTINCT ent) AS f FROM (SELECT id, ent, unnest(detectors) AS detector FROM ents WHERE verdict = 'correct') GROUP BY 1, 2),
m AS (SELECT id, count(*) AS lost FROM lost GROUP BY 1),
z AS (SELECT c.detector, count(*) AS n_records, coalesce(sum(k), 0)::BIGINT AS n_entities, coalesce(sum(f), 0)::BIGINT AS n_found, coalesce(sum(lost), 0)::BIGINT AS missed_by_all
    FROM calls c LEFT JOIN k ON c.id = k.id LEFT JOIN f ON c.id = f.id AND c.detector = f.detector LEFT JOIN m ON c.id = m.id GROUP BY 1),
y AS (SELECT z.*, coalesce(n_spans, 0) AS n_spans, coalesce(correct, 0) AS correct, coalesce(wrong_label, 0) AS wrong_label, coalesce(boundary, 0) AS boundary, coalesce(not_pii, 0) AS not_pii FROM z LEFT JOIN j ON z.detector = j.detector),
x AS (SELECT *, correct::DOUBLE / nullif(n_spans, 0) AS p, n_found::DOUBLE / nullif(n_entities + missed_by_all, 0) AS r FROM y)
SELECT detector, n_records, n_spans, correct, wrong_label, boundary, not_pii, n_entities, missed_by_all, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM x"""
ORACLES["review_disagreements"] = f"""WITH {_REVIEW}, x AS (SELECT id, s AS "start", e AS "end", label, verdict, 0 AS part FROM rv WHERE verdict <> 'correct'
    UNION ALL SELECT id, s, e, label, 'missed', 1 FROM lost)
SELECT x.*, CASE WHEN greatest("start" - 30, 0) > 0 THEN '…' ELSE '' END || substr(text, greatest("start" - 30, 0) + 1, "start" - greatest("start" - 30, 0)) || '⟦' || substr(text, "start" + 1, "end" - "start") || '⟧'
    || substr(text, "end" + 1, least("end" + 30, length(text)) - "end") || CASE WHEN least("end" + 30, length(text)) < length(text) THEN '…' ELSE '' END AS context
FROM x JOIN (SELECT DISTINCT id, text FROM rec) r ON x.id = r.id"""
_CLASS = f"""{_BASE}, {_INSIDE}, pool AS (SELECT id, s, e, label, list(DISTINCT detector) AS detectors FROM inside GROUP BY 1, 2, 3, 4),
b AS (SELECT p.id, p.s, p.e, p.label, max({_iou('p.s', 'p.e', 'g.s', 'g.e')}) AS a, max({_iou('p.s', 'p.e', 'g.s', 'g.e')}) FILTER (p.label = g.label) AS b
    FROM pool p JOIN gold g ON p.id = g.id AND p.s < g.e AND g.s < p.e GROUP BY 1, 2, 3, 4),
cr AS (SELECT p.id, p.s, p.e, p.label, unnest(detectors) AS detector, round(coalesce(a, 0), 4) AS p_pii, round(coalesce(b, 0), 4) AS p_label_ok
    FROM pool p LEFT JOIN b ON p.id = b.id AND p.s = b.s AND p.e = b.e AND p.label = b.label)"""
ORACLES["classifier_summary"] = f"""WITH {_CLASS} SELECT detector, count(*) AS n, round(avg((p_pii >= 0.5 AND p_label_ok >= 0.5)::INT), 6) AS precision,
    round(avg((p_pii >= 0.5)::INT), 6) AS any_label, round(round(avg(p_pii), 9), 6) AS mean_p_pii FROM cr GROUP BY 1"""
ORACLES["threshold_sweep"] = f"""WITH {_CLASS}, j AS (SELECT cr.*, (g.id IS NOT NULL)::INT AS truth FROM cr LEFT JOIN gold g ON cr.id = g.id AND cr.s = g.s AND cr.e = g.e AND cr.label = g.label),
k AS (SELECT *, unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS threshold FROM j),
a AS (SELECT detector, threshold, round(avg((p_pii >= threshold AND p_label_ok >= threshold)::INT), 9) AS e, round(avg(truth), 9) AS t FROM k GROUP BY 1, 2)
SELECT detector, threshold, round(e, 6) AS estimate, round(t, 6) AS truth, round(round(e - t, 9), 6) AS error FROM a"""
_JUDGED = f"""{_BASE}, {_INSIDE}, pool AS (SELECT i.id, i.s, i.e, i.label, list(DISTINCT i.detector) AS detectors, substr(any_value(text), i.s + 1, i.e - i.s) AS v
    FROM inside i JOIN (SELECT DISTINCT id, text FROM rec WHERE trim(text, ' ') <> '') r ON i.id = r.id WHERE label IN {_in(COARSE)} GROUP BY 1, 2, 3, 4)"""
ORACLES["judge_verdicts"] = f"""WITH {_JUDGED} SELECT label, CASE WHEN (label = 'EMAIL' AND NOT contains(v, '@')) OR (label IN ('PHONE', 'ACCOUNT') AND NOT regexp_matches(v, '[0-9]'))
    THEN 'not_pii' ELSE 'correct' END AS verdict, count(*) AS n FROM pool GROUP BY 1, 2"""
ORACLES["judge_dry_run"] = f"WITH {_JUDGED} SELECT 'span' AS kind, 'correct' AS verdict, count(*) AS n FROM pool"
ORACLES["classifier_spans"] = f"""WITH {_JUDGED}, x AS (SELECT unnest(detectors) AS detector, CASE WHEN length(v) > 3 THEN 0.9 ELSE 0.3 END AS p, CASE WHEN contains(v, '@') = (label = 'EMAIL') THEN 0.8 ELSE 0.2 END AS q FROM pool)
SELECT detector, count(*) AS n, round(avg((p >= 0.5 AND q >= 0.5)::INT), 6) AS precision, round(avg((p >= 0.5)::INT), 6) AS any_label, round(round(avg(p)::DOUBLE, 9), 6) AS mean_p_pii FROM x GROUP BY 1"""
ORACLES["segment_properties"] = f"""WITH {_BASE} SELECT DISTINCT c.id, true AS in_order, true AS uncut, true AS covered FROM calls c JOIN rec r ON c.id = r.id WHERE regexp_matches(r.text, '[\\p{{L}}\\p{{N}}]')"""
ORACLES["residual_rate"] = f"""WITH {_BASE}, b AS (SELECT DISTINCT c.id, c.detector FROM calls c JOIN gold g ON c.id = g.id
    WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.id = c.id AND p.detector = c.detector AND p.s < g.e AND g.s < p.e)),
x AS (SELECT detector, count(*) AS residual FROM b GROUP BY 1), n AS (SELECT detector, count(*) AS n FROM calls GROUP BY 1)
SELECT n.detector, n, coalesce(residual, 0) AS residual, round(coalesce(residual, 0)::DOUBLE / n, 6) AS rate FROM n LEFT JOIN x ON n.detector = x.detector"""
ORACLES["plan_calls"] = f"WITH {_REC} SELECT count(*) AS records, sum(length(text))::BIGINT AS chars, sum(ceil(length(text) / 4000))::BIGINT AS calls FROM rec WHERE trim(text, ' ') <> ''"

# search ---------------------------------------------------------------------------------------------------------------

_TOK = TOKEN.replace("'", "''")
ORACLES["search_tokens"] = f"""{_walk(_REPS['label_number'])},
o AS (SELECT if({_OUT}) AS text FROM requests q JOIN fin ON q.request_id = fin.request_id), w AS (SELECT lower(unnest(regexp_extract_all(text, '{_TOK}', 0))) AS term FROM o)
SELECT term, count(*) AS n FROM w GROUP BY 1"""


def _bm25(texts: str, asked: str, k: int = 10) -> str:
    """CTEs up to ``hits(query_id, doc_id, score, place)`` of the queries over the texts."""
    return f"""qt AS (SELECT DISTINCT query_id, lower(unnest(regexp_extract_all(text, '{_TOK}', 0))) AS term FROM ({asked})),
w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{_TOK}', 0))) AS term FROM ({texts})),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), dl AS (SELECT doc_id, count(*) AS dl FROM w GROUP BY 1),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sco AS (SELECT query_id, tf.doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM tf JOIN qt ON tf.term = qt.term JOIN df ON df.term = tf.term JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY 1, 2),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM sco) WHERE place <= {k})"""


_PROMPTS = "SELECT DISTINCT md5(prompt) AS query_id, prompt AS text FROM eval_items"
ORACLES["search_prompts"] = f"WITH {_bm25('SELECT doc_id, text FROM documents', _PROMPTS)} SELECT query_id, doc_id, round(score, 4) AS score, place FROM hits"
_OWN = "SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 20 = 0"
ORACLES["search_bm25"] = f"WITH {_bm25('SELECT doc_id, text FROM documents', _OWN)} SELECT query_id, doc_id, round(score, 4) AS score, place FROM hits"


def _hits_of(mode: str) -> str:
    texts = "SELECT request_id AS doc_id, text FROM requests" if mode == "plain" else f"SELECT request_id AS doc_id, replaced_text AS text FROM ({ORACLES[f'replace_{mode}']})"
    return f"SELECT query_id, doc_id FROM (WITH t AS MATERIALIZED ({texts}), {_bm25('SELECT * FROM t', 'SELECT doc_id AS query_id, text FROM t WHERE doc_id % 20 = 0')} SELECT query_id, doc_id FROM hits)"


_QUALITY = "WITH plain AS MATERIALIZED (" + _hits_of("plain") + "), rel AS (SELECT query_id, count(*) AS n FROM plain GROUP BY 1), got AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{m}' AS mode, query_id, doc_id FROM ({_hits_of(m) if m != 'plain' else 'SELECT * FROM plain'})" for m in ("plain", *_REPS)) + """),
modes AS (SELECT * FROM (VALUES ('plain'), ('redact'), ('label'), ('label_number'), ('label_token')) v(mode)),
good AS (SELECT mode, g.query_id, count(*) AS n, count(*) FILTER (p.doc_id IS NOT NULL) AS k FROM got g LEFT JOIN plain p ON g.query_id = p.query_id AND g.doc_id = p.doc_id GROUP BY 1, 2),
quality AS (SELECT m.mode, rel.query_id, coalesce(k::DOUBLE / good.n, 0) AS precision, coalesce(k, 0)::DOUBLE / rel.n AS recall
    FROM modes m CROSS JOIN rel LEFT JOIN good ON good.mode = m.mode AND good.query_id = rel.query_id)"""
ORACLES["retrieval_by_query"] = f"{_QUALITY} SELECT mode, query_id, round(precision, 6) AS precision, round(recall, 6) AS recall FROM quality"
ORACLES["retrieval_quality"] = f"{_QUALITY} SELECT mode, count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM quality GROUP BY 1"


def _count(rule: str, detector: str, luhn: bool = False) -> str:
    label, pattern = RULES[rule]
    p = pattern.replace("'", "''")
    hits = f"SELECT unnest(regexp_extract_all(text, '{p}', 0)) AS v FROM requests"
    if rule == "digits":
        hits = f"SELECT v FROM ({hits}) WHERE length(v) = 16"
        if luhn:
            hits = f"SELECT v FROM ({hits}) WHERE {_luhn('v')}"
    return f"SELECT '{detector}' AS detector, '{label}' AS label, count(*) AS n FROM ({hits})"


ORACLES["detect_compare"] = "SELECT detector, label, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(
    [_count(r, "regex_strict", True) for r in ("email", "ip", "phone", "digits", "token")]
    + [_count(r, "regex_loose") for r in ("email", "phone", "money", "date", "url", "digits")]) + ") WHERE n > 0 GROUP BY 1, 2"
ORACLES["render_modes"] = "SELECT a.request_id, q.text AS plain, " + ", ".join(f"{c}.replaced_text AS {m}" for c, m in zip("abcd", _REPS)) + " FROM requests q " + " ".join(
    f"JOIN ({ORACLES[f'replace_{m}']}) {c} ON q.request_id = {c}.request_id" for c, m in zip("abcd", _REPS))
ORACLES["masked_contexts"] = """WITH RECURSIVE d AS (SELECT DISTINCT s.request_id, s."start" AS s, s."end" AS e, label, q.text FROM detected_spans s JOIN requests q ON s.request_id = q.request_id
    WHERE s."start" >= 0 AND s."start" < s."end" AND s."end" <= length(q.text)),
w AS (SELECT request_id, s AS fs, e AS fe, label AS fl, text, greatest(s - 30, 0) AS lo, least(e + 30, length(text)) AS hi FROM d),
c AS (SELECT w.request_id, fs, fe, fl, greatest(d.s, lo) - lo AS s, least(d.e, hi) - lo AS e, '[' || label || ']' AS rep,
    row_number() OVER (PARTITION BY w.request_id, fs, fe, fl ORDER BY d.s, d.e, label) AS rn
    FROM w JOIN d ON w.request_id = d.request_id WHERE d.s < hi AND lo < d.e),
walk(request_id, fs, fe, fl, rn, cursor, out) AS (
    SELECT request_id, fs, fe, fl, 0::BIGINT, 0, '' FROM w
    UNION ALL SELECT k.request_id, k.fs, k.fe, k.fl, c.rn, CASE WHEN c.s >= k.cursor THEN c.e ELSE k.cursor END,
        CASE WHEN c.s >= k.cursor THEN k.out || substr(substr(w.text, w.lo + 1, w.hi - w.lo), k.cursor + 1, c.s - k.cursor) || c.rep ELSE k.out END
    FROM walk k JOIN c ON c.request_id = k.request_id AND c.fs = k.fs AND c.fe = k.fe AND c.fl = k.fl AND c.rn = k.rn + 1
    JOIN w ON w.request_id = k.request_id AND w.fs = k.fs AND w.fe = k.fe AND w.fl = k.fl),
z AS (SELECT walk.* FROM walk JOIN (SELECT request_id, fs, fe, fl, max(rn) AS rn FROM walk GROUP BY 1, 2, 3, 4) m USING (request_id, fs, fe, fl, rn)),
o AS (SELECT z.request_id, z.fs, z.fe, z.fl, z.out || substr(substr(w.text, w.lo + 1, w.hi - w.lo), z.cursor + 1) AS masked FROM z JOIN w USING (request_id, fs, fe, fl))
SELECT request_id, fs AS "start", fe AS "end", fl AS label, masked, NOT regexp_matches(regexp_replace(masked, '\\[[A-Z_]+\\]', '', 'g'), '[\\p{L}\\p{N}]') AS nothing_left FROM o"""


def _greedy(threshold: str) -> str:
    return f"""WITH RECURSIVE {_BASE},
g AS (SELECT id, list({{'label': label, 's': s, 'e': e}} ORDER BY label, s, e) AS g FROM gold GROUP BY 1),
p AS (SELECT id, detector, label, s, e, row_number() OVER (PARTITION BY id, detector ORDER BY label, s, e) AS rn FROM pred),
c AS (SELECT calls.id, calls.detector, coalesce(g.g, []) AS g FROM calls LEFT JOIN g ON calls.id = g.id),
walk(id, detector, rn, used, tp) AS (
    SELECT id, detector, 0::BIGINT, []::BIGINT[], []::VARCHAR[] FROM c
    UNION ALL SELECT id, detector, rn, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END, CASE WHEN b IS NULL THEN tp ELSE list_append(tp, label) END FROM (
        SELECT w.id, w.detector, p.rn, w.used, w.tp, p.label, (SELECT i FROM (SELECT unnest(range(1, len(c.g) + 1)) AS i) r
            WHERE c.g[i]['label'] = p.label AND NOT list_contains(w.used, i) AND {_iou('p.s', 'p.e', "c.g[i]['s']", "c.g[i]['e']")} >= {threshold}
            ORDER BY {_iou('p.s', 'p.e', "c.g[i]['s']", "c.g[i]['e']")} DESC, i LIMIT 1) AS b
        FROM walk w JOIN p ON p.id = w.id AND p.detector = w.detector AND p.rn = w.rn + 1 JOIN c ON c.id = w.id AND c.detector = w.detector)),
z AS (SELECT walk.* FROM walk JOIN (SELECT id, detector, max(rn) AS rn FROM walk GROUP BY 1, 2) m ON walk.id = m.id AND walk.detector = m.detector AND walk.rn = m.rn),
u AS (SELECT detector, unnest(tp) AS label, 'tp' AS k FROM z UNION ALL SELECT detector, label, 'p' FROM pred UNION ALL SELECT c.detector, unnest(c.g).label, 'g' FROM c),
c2 AS (SELECT detector, label, count(*) FILTER (k = 'tp') AS tp, count(*) FILTER (k = 'p') AS n_pred, count(*) FILTER (k = 'g') AS n_gold FROM u GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN n_pred = 0 THEN 0 ELSE tp::DOUBLE / n_pred END AS pr, CASE WHEN n_gold = 0 THEN 0 ELSE tp::DOUBLE / n_gold END AS re FROM c2)
SELECT detector, label, tp, n_pred, n_gold, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM r"""


ORACLES["greedy_prf"] = _greedy("0.5")
ORACLES["greedy_exact"] = _greedy("1.0")
