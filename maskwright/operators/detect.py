"""Detectors: rules as Catalyst expressions, and a plug-in contract for Python models.

Rules avoid word boundaries and lookaround, so that other engines' regular expressions agree with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions import taxonomy as X

# label, raw label, pattern
RULES: dict[str, tuple[str, str, str]] = {
    "email": ("EMAIL", "EMAIL", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": ("URL", "IP", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    "phone": ("PHONE", "PHONE", r"\+[0-9]{1,3}[ -][0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,5}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    "money": ("MONEY", "MONEY", r"\$[0-9]+(?:\.[0-9]{2})?|CHF [0-9]+\.[0-9]{2}|[0-9]+,[0-9]{2} EUR"),
    "date": ("DATE", "DATE", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    "url": ("URL", "URL", r"https?://[A-Za-z0-9./?=&_-]+"),
    "digits": ("ACCOUNT", "CARD", r"[0-9]+"),
    "token": ("SECRET", "TOKEN", r"token = \"[0-9a-f]{20,}\""),
}


def rule_spans(text: Column, rules: list[str], luhn: bool = True) -> Column:
    """Spans of the given rules, sorted by (start, end). Only the patterns asked for are built into the plan."""
    parts = []
    for name in rules:
        label, raw, pattern = RULES[name]
        found = S.regex_spans(text, pattern, label, raw)
        if name == "digits":
            found = F.filter(found, lambda s: (F.length(s["text"]) == 16) & (F.call_function("luhn_check", s["text"]) if luhn else F.lit(True)))
        parts.append(found)
    merged = F.flatten(F.array(*parts))
    order = F.transform(merged, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("s")))
    return F.transform(F.array_sort(order), lambda o: o["s"])


def detect_rules(df: DataFrame, rules: list[str] | None = None, text_col: str = "text", luhn: bool = True) -> DataFrame:
    """Adds ``spans``; null texts have null spans."""
    return df.withColumn("spans", rule_spans(F.col(text_col), rules or list(RULES), luhn))


@dataclass
class DetectorSpec:
    """A registered detector. ``column`` builds a Catalyst expression of text; ``load`` returns a function text, context -> spans for one worker."""

    name: str
    vocab: str = "canonical"
    column: Callable[[Column], Column] | None = None
    load: Callable[[], Callable[..., list[dict]]] | None = None
    requires: tuple[str, ...] = ()
    remote: bool = False
    in_api: bool = True
    tags: tuple[str, ...] = ()
    threshold: float = 0.7
    options: dict[str, str] = field(default_factory=dict)

    def missing(self) -> list[str]:
        import importlib.util

        return [m for m in self.requires if importlib.util.find_spec(m) is None]

    @property
    def available(self) -> bool:
        return not self.missing() and (self.column is not None or self.load is not None)


REGISTRY: dict[str, DetectorSpec] = {}


def register(spec: DetectorSpec, replace: bool = False) -> DetectorSpec:
    if spec.name in REGISTRY and not replace:
        raise ValueError(f"detector {spec.name!r} is registered already")
    REGISTRY[spec.name] = spec
    X.DETECTOR_VOCAB[spec.name] = spec.vocab
    return spec


def describe() -> list[dict[str, object]]:
    return [{"name": s.name, "vocab": s.vocab, "available": s.available, "missing": s.missing(), "remote": s.remote, "tags": list(s.tags)} for s in REGISTRY.values()]


def select_detectors(names: list[str]) -> list[str]:
    """Repeats dropped, order kept; unknown or no names raise."""
    out = list(dict.fromkeys(names))
    unknown = [n for n in out if n not in REGISTRY]
    if unknown or not out:
        raise ValueError(f"unknown detectors {unknown}" if unknown else "no detector selected")
    return out


def register_token_classifier(name: str, model: str, vocab: str = "canonical", threshold: float = 0.7, tags: tuple[str, ...] = (), replace: bool = False) -> DetectorSpec:
    """Registers a token-classification model by its id; it is available where ``transformers`` and ``torch`` are, and loads once per worker."""

    def load() -> Callable[..., list[dict]]:
        from transformers import pipeline  # noqa: PLC0415 - only where it is installed

        run, names = pipeline("token-classification", model=model, aggregation_strategy="simple"), X.VOCABS[vocab]
        return lambda text, **_: [made for e in run(text) if (made := model_span(names, e["entity_group"], e["start"], e["end"], text, e["score"]))]

    return register(DetectorSpec(name, vocab, load=load, requires=("transformers", "torch"), tags=("model", *tags), threshold=threshold, options={"model": model}), replace)


def register_prompted_model(name: str, model: str, vocab: str = "canonical", targets: list[str] | None = None, threshold: float = 0.7, replace: bool = False) -> DetectorSpec:
    """Registers a model that is asked for named kinds of spans: the vocabulary's raw labels whose coarse label is a target."""
    asked = X.prompts_for(vocab, targets or list(X.COARSE))

    def load() -> Callable[..., list[dict]]:
        import gliner  # noqa: PLC0415 - only where it is installed

        net, names = gliner.GLiNER.from_pretrained(model), X.VOCABS[vocab]
        return lambda text, **_: [made for e in net.predict_entities(text, asked, threshold=threshold) if (made := model_span(names, e["label"], e["start"], e["end"], text, e["score"]))]

    return register(DetectorSpec(name, vocab, load=load, requires=("gliner",), tags=("model",), threshold=threshold, options={"model": model}), replace)


def model_span(vocab: X.Vocab, raw: str, start: int, end: int, text: str, score: float = 1.0, keep_unmapped: bool = False) -> dict | None:
    """A span of a model's raw label; None if the vocabulary does not know it, or the label in upper case with ``keep_unmapped``."""
    fine = vocab.lookup(raw) or (raw.upper() if keep_unmapped else None)
    return fine and {"label": X.parent(fine), "fine_label": fine, "raw_label": raw, "start": int(start), "end": int(end), "text": text[start:end], "score": float(score)}


register(DetectorSpec("regex_strict", "rules", column=lambda t: rule_spans(t, ["email", "ip", "phone", "digits", "token"]), tags=("rules",)))
register(DetectorSpec("regex_loose", "rules", column=lambda t: rule_spans(t, ["email", "phone", "money", "date", "url", "digits"], luhn=False), tags=("rules",)))


def detect(df: DataFrame, detector: str, text_col: str = "text", key_col: str = "id", context: tuple[str, ...] = ()) -> DataFrame:
    """``id, detector, spans, latency_ms, error`` of one detector over all rows.

    Column detectors stay in the plan; models load once per worker and run over Arrow batches. Errors are returned, never raised.
    """
    spec = REGISTRY[detector]
    if not spec.available:
        raise RuntimeError(f"detector {detector!r} is not available, missing {spec.missing()}")
    if spec.column is not None:
        return df.select(
            F.col(key_col).alias("id"), F.lit(detector).alias("detector"), spec.column(F.col(text_col)).alias("spans"),
            F.lit(0.0).alias("latency_ms"), F.lit(None).cast("string").alias("error"))
    load, floor = spec.load, spec.threshold

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model = load()
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                began = time.perf_counter()
                try:
                    text = rec.get("_text")
                    found = model(text, **{c: rec[c] for c in context}) if text is not None else []
                    spans = [s for s in found if s.get("score", 1.0) >= floor]
                    error = None
                except Exception as e:  # noqa: BLE001 - a detector's failure is data
                    spans, error = [], f"{type(e).__name__}: {e}"[:500]
                keep = [{k: s.get(k) for k in ("label", "fine_label", "raw_label", "start", "end", "text")} for s in spans]
                rows.append((rec["_key"], detector, keep, (time.perf_counter() - began) * 1000, error))
            yield pd.DataFrame(rows, columns=["id", "detector", "spans", "latency_ms", "error"])

    kind = df.schema[key_col].dataType.simpleString()
    source = df.select(F.col(key_col).alias("_key"), F.col(text_col).alias("_text"), *context)
    return source.mapInPandas(run, f"id {kind}, detector string, spans {S.SPANS.simpleString()}, latency_ms double, error string")


def detect_all(df: DataFrame, detectors: list[str], **options: object) -> DataFrame:
    """Union of the selected detectors' rows."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [detect(df, d, **options) for d in select_detectors(detectors)])


def route_by_language(language: Column, supported: list[str], default: str = "en") -> Column:
    """The language a model is asked in: the record's own if supported, else the default."""
    norm = X.normalize_language(language)
    return F.when(norm.isin(supported), norm).otherwise(F.lit(default))


def trim_boundaries(text: Column, start: Column, end: Column) -> Column:
    """struct<start, end> without white space and punctuation at the ends."""
    piece = S.slice_text(text, start, end)
    lead = F.length(piece) - F.length(F.regexp_replace(piece, r"^[\s.,;:!?]+", ""))
    tail = F.length(piece) - F.length(F.regexp_replace(piece, r"[\s.,;:!?]+$", ""))
    return F.struct((start + lead).alias("start"), F.greatest(end - tail, start + lead).alias("end"))
