"""Markdown report from the (small) score tables.

A run's report scores every detector in the fair and in the raw view, breaks the raw view down by label and the fair one by language, and says what
was covered. Records without gold get counts only; silver gold is named as such. All numbers come from a few aggregated tables, read with a bound.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.functions import taxonomy as X
from maskwright.operators import records as R
from maskwright.operators import scoring

MAX_ROWS = 5000


def ranked(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``place``: the rows of a dimension (detectors) from the largest value down, ties by name."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(value), name)))


def esc(value: object) -> str:
    return str(value).replace("|", "\\|").replace("\n", " ")


def _cell(value: object) -> str:
    return "–" if value is None else f"{value:.3f}" if isinstance(value, float) else esc(value)


def md_table(rows: DataFrame | Iterable[dict], columns: list[str] | None = None) -> str:
    """A Markdown table; tables here are dimensions x detectors, read with a bound that raises instead of cutting."""
    if isinstance(rows, DataFrame):
        found = rows.limit(MAX_ROWS + 1).collect()
        if len(found) > MAX_ROWS:
            raise ValueError(f"more than {MAX_ROWS} rows for a report table")
        rows = [r.asDict() for r in found]
    rows = list(rows)
    columns = columns or (list(rows[0]) if rows else [])
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(_cell(r.get(c)) for c in columns) + " |" for r in rows)])


def safe_name(name: str) -> str:
    """A name as part of a file name: letters, digits, dots and dashes."""
    return re.sub(r"[^A-Za-z0-9.-]+", "_", name).strip("_.") or "unnamed"


def span_in_context(text: str, start: int, end: int, width: int = 30) -> str:
    """The span in bold with ``width`` characters on either side, as one table cell."""
    a, b = max(0, start - width), min(len(text), end + width)
    return esc(f"{'…' if a else ''}{text[a:start]}**{text[start:end]}**{text[end:b]}{'…' if b < len(text) else ''}")


def chosen_detectors(present: list[str], wanted: Iterable[str] | str | None) -> list[str]:
    """The run's detectors that were asked for, in the run's order; unknown or no names raise."""
    if wanted is None:
        return present
    names = {n.strip() for n in ([wanted] if isinstance(wanted, str) else wanted) if n.strip()}
    unknown = sorted(names - set(present))
    if unknown or not names:
        raise ValueError(f"no predictions of {unknown}; the run has {present}" if unknown else "no detector selected; pass None for all")
    return [d for d in present if d in names]


def text_bars(rows: Iterable[dict], name: str, value: str, width: int = 40) -> str:
    """A bar per row in plain text, scaled to the largest value; rows without a value have none."""
    rows = list(rows)
    top = max((r[value] for r in rows if r[value] is not None), default=0) or 1
    pad = max((len(str(r[name])) for r in rows), default=0)
    return "\n".join(f"{str(r[name]):<{pad}} {'█' * round(width * max(r[value] or 0, 0) / top)} {_cell(r[value])}" for r in rows)


def side_by_side(rows: Iterable[dict], modes: Iterable[str], width: int = 60) -> str:
    """Renderings of a few texts next to each other, one row per text, cut to ``width`` for display."""
    cut = lambda t: t if t is None or len(t) <= width else t[: width - 1] + "…"
    return md_table([{"plain": cut(r.get("plain")), **{m: cut(r.get(m)) for m in modes}} for r in rows])


def run_labels(dataset: list[str] | None, sidecar: list[str] | None, observed: Iterable[str]) -> list[str]:
    """Labels of a run: the dataset's, else the sidecar's, else those that were observed."""
    found = next((x for x in (dataset, sidecar) if x), None) or observed
    return [x for x in X.ALL_LABELS if x in set(found)]


def issues_summary(issues: DataFrame, shown: int = 20, most: int = 200) -> dict[str, object]:
    """Counts by severity, the first ``shown`` issues and how many of at most ``most`` listed ones are hidden. The cap is for display: counts are whole."""
    counts = {r["severity"]: r["n"] for r in issues.groupBy("severity").agg(F.sum("n").alias("n")).collect()}
    rows = [f"{r['severity']}: {r['id']}: {r['issue']} ({r['n']})" for r in issues.orderBy("severity", "id", "issue").limit(most).collect()]
    return {"ok": not counts.get("error"), "counts": counts, "shown": rows[:shown], "hidden": max(0, len(rows) - shown)}


_VIEWS = {
    "fair": "Each detector on the labels that the gold side uses and its vocabulary supports.",
    "raw": "Every detector on all labels the gold side uses; labels it does not support count as missed.",
}


def _few(rows: DataFrame) -> list[dict]:
    found = rows.limit(MAX_ROWS + 1).collect()
    if len(found) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows for a report")
    return [r.asDict() for r in found]


def run_report(
    fixtures: DataFrame, predictions: DataFrame, manifest: dict, level: str = "coarse", labels: list[str] | None = None, detectors: Iterable[str] | None = None,
    gold: str | None = None, silver: dict | None = None, failed: DataFrame | None = None,
) -> str:
    """The report of a run.

    ``gold``: None (real), ``none`` or ``silver``; ``silver`` names labelers and merge rule; ``failed`` holds the ids that every labeler failed on, which are left
    out. ``labels`` overrides both views.
    """
    names = chosen_detectors(scoring.names_of(predictions, "detector"), detectors)
    predictions = predictions.where(F.col("detector").isin(names))
    left_out = 0
    if failed is not None:
        left_out = failed.distinct().count()
        fixtures = fixtures.join(failed.select("id").distinct(), "id", "left_anti")
    rec, latest = R.distinct_records(fixtures), R.latest_predictions(predictions)
    n = rec.select("id").distinct().count()
    head = [f"- dataset: {manifest.get('dataset') or 'not registered'}", f"- records: {n}", f"- detectors: {', '.join(names) or 'none'}", f"- level: {X.check_level(level)}"]
    head += [f"- left out: {left_out} records that no labeler could label"] if left_out else []
    title = "Run without gold" if gold == "none" else "Report on silver labels" if gold == "silver" else "Detector report"
    parts = [f"# {title} {manifest.get('started_at', '')}".rstrip()]
    if gold == "silver":
        who = (silver or {}).get("labelers") or ["labelers that were not recorded"]
        how = f", merged by {(silver or {}).get('merge', 'a rule that was not recorded')}" if len(who) > 1 else ""
        parts.append(f"> The gold spans are labels by {', '.join(who)}{how}. Scores measure agreement with them, not truth.")
    parts.append("\n".join(head))
    counts = ["## Detected spans", md_table(_few(R.span_counts(latest).orderBy("detector")))]
    coverage = ["## Coverage", "Errored and missing calls are left out of every score.", md_table(_few(R.coverage(rec, latest).orderBy("detector")))]
    if gold == "none":
        return "\n\n".join([*parts, "> There is no gold, so no precision or recall: label a sample, or review the spans with a judge or a classifier.", *counts, *coverage]) + "\n"
    if gold == "silver" and n == 0:
        errors = [{"labeler": k, "errors": v} for k, v in ((silver or {}).get("n_errors") or {}).items()]
        return "\n\n".join([*parts, "> Every labeler failed on every record, so there is nothing to score.", md_table(errors, ["labeler", "errors"]), *counts]) + "\n"
    scope = scoring.scopes(rec, predictions, level, labels)
    out = scoring.outcomes(scoring.answered(rec, latest, level), scope)
    totals = _few(scoring.score(out, ["view", "detector"]))
    wide = {(r["view"], r["detector"]): sorted(set(r["project"].values())) for r in _few(scope)}
    for view, meaning in _VIEWS.items():
        cell = {(r["detector"], r["schema"]): r for r in totals if r["view"] == view}
        parts += [f"## {view.capitalize()} view", meaning, "### F1 by schema", md_table([
            {"detector": d, "labels": len(wide.get((view, d), [])), **{x: cell[d, x]["f1"] if (d, x) in cell else None for x in scoring.SCHEMAS}} for d in names])]
        parts += ["### Strict outcomes", md_table([
            {"detector": d, **{k: cell[d, "strict"][k] if (d, "strict") in cell else None for k in ("cor", "inc", "par", "mis", "spu")}} for d in names])]
        parts += ["### Labels scored", "\n".join(f"- **{d}** ({len(wide.get((view, d), []))}): {', '.join(wide.get((view, d), [])) or 'none'}" for d in names)]
    tags = {(r["tag"], r["detector"]): r for r in _few(scoring.score(out, ["view", "detector", "tag"]).where("view = 'raw' and schema = 'ent_type'"))}
    shown = lambda r: f"{r['precision']:.3f} / {r['recall']:.3f} / {r['f1']:.3f} (cor={r['cor']} inc={r['inc']} mis={r['mis']} spu={r['spu']})" if r else None
    parts += ["## By label, raw view: P / R / F1 of type", md_table([{"label": t, **{d: shown(tags.get((t, d))) for d in names}} for t in sorted({t for t, _ in tags})])]
    lang = rec.groupBy("id").agg(F.min(X.normalize_language(F.col("language"))).alias("language")).where("language is not null")
    per = {r["language"]: r["n"] for r in _few(lang.groupBy("language").agg(F.count(F.lit(1)).alias("n")))}
    by_lang = {(r["language"], r["detector"]): r["f1"] for r in _few(scoring.score(out.where("view = 'fair'").join(lang, "id"), ["detector", "language"]).where("schema = 'ent_type'"))}
    if per:
        parts += ["## By language, fair view: F1 of type", md_table([{"language": x, "records": per[x], **{d: by_lang.get((x, d)) for d in names}} for x in sorted(per)])]
    return "\n\n".join([*parts, *counts, *coverage]) + "\n"


def write_report(path: str, text: str) -> str:
    """Writes next to the target and renames, so that readers never see half a report."""
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, path)
    return path
