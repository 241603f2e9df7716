"""Model calls as table operators: prompts, a client contract, answer parsing and checking, caching, splitting of truncated calls.

Clients are plug-ins built once per Python worker; the stub answers by rule, so everything around it can be tested offline.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.sources.store import cache_key, with_cached


@dataclass
class Answer:
    text: str | None = None
    error: str | None = None
    truncated: bool = False
    refused: bool = False
    fallback: str | None = None  # the model that answered in place of the one asked


Client = Callable[[str], Answer]


def remote_allowed(setting: str | None) -> bool:
    """May texts leave the machine? Not set: yes; any value that is not a clear yes: no."""
    return setting is None or setting.strip().lower() in ("1", "true", "yes", "on", "allow")


def guarded(client: Callable[[], Client], remote: bool, setting: str | None) -> Callable[[], Client]:
    """The client's factory, unless it is remote and remote calls are switched off."""
    if remote and not remote_allowed(setting):
        raise PermissionError("remote models are switched off")
    return client


def stub_client(rule: Callable[[str], object], limit: int | None = None) -> Callable[[], Client]:
    """A factory of clients that answer ``rule(prompt)`` as JSON, and truncate prompts longer than ``limit``."""

    def build() -> Client:
        def ask(prompt: str) -> Answer:
            if limit is not None and len(prompt) > limit:
                return Answer(truncated=True, error="truncated")
            return Answer(json.dumps(rule(prompt), ensure_ascii=False))

        return ask

    return build


def json_candidates(text: str) -> Iterator[object]:
    """Values that an answer may mean, likeliest first: the whole text, fenced blocks, then every value that decodes somewhere inside."""
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)
    for candidate in [text, *fenced]:
        try:
            yield json.loads(candidate.strip())
        except ValueError:
            continue
    decoder = json.JSONDecoder()
    at = 0
    while (m := re.compile(r"[\[{]").search(text, at)) is not None:
        try:
            value, at = decoder.raw_decode(text, m.start())
            yield value
        except ValueError:
            at = m.start() + 1


def parse_json(text: str, schema: dict | None = None) -> object:
    """The first candidate that fits the schema, else the first of all. Raises ValueError without one."""
    found = list(json_candidates(text))
    if not found:
        raise ValueError("no JSON in the answer")
    return next((v for v in found if schema is None or not problems(v, schema)), found[0])


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def problems(value: object, schema: dict, path: str = "$") -> list[str]:
    """Where a value breaks a JSON schema (type, enum, const, bounds, lengths, pattern, required, properties, additionalProperties, items, anyOf)."""
    if "anyOf" in schema:
        tried = [problems(value, s, path) for s in schema["anyOf"]]
        return [] if any(not t for t in tried) else [f"{path}: fits no alternative"]
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind] if kind else []

    def fits(k: str) -> bool:
        if k in ("integer", "number"):
            return isinstance(value, int | float) and not isinstance(value, bool) and (k == "number" or float(value).is_integer())
        return isinstance(value, _TYPES[k])

    if kinds and not any(fits(k) for k in kinds):
        return [f"{path}: expected {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of {schema['enum']}")
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: not {schema['const']!r}")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{path}: out of bounds")
    if isinstance(value, str | list):
        short, long = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if not schema.get(short, 0) <= len(value) <= schema.get(long, len(value)):
            out.append(f"{path}: wrong length {len(value)}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{path}: does not match {schema['pattern']}")
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{path}: {k} is missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}: unexpected {k}" for k in value if k not in props]
        for k, s in props.items():
            if k in value:
                out += problems(value[k], s, f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += problems(v, schema["items"], f"{path}[{i}]")
    return out


def minimal(schema: dict) -> object:
    """The smallest value that fits a schema."""
    if "const" in schema:
        return schema["const"]
    if "enum" in schema:
        return schema["enum"][0]
    if "anyOf" in schema:
        return minimal(schema["anyOf"][0])
    kind = schema.get("type", "null")
    kind = kind[0] if isinstance(kind, list) else kind
    if kind == "object":
        return {k: minimal(schema.get("properties", {}).get(k, {})) for k in schema.get("required", [])}
    if kind == "array":
        return [minimal(schema.get("items", {})) for _ in range(schema.get("minItems", 0))]
    plain = {"string": "x" * schema.get("minLength", 0), "integer": schema.get("minimum", 0), "number": schema.get("minimum", 0), "boolean": False}
    return plain.get(kind)


def scrub(text: str) -> str:
    """Lone surrogates become the replacement character."""
    return re.sub("[\ud800-\udfff]", "�", text)


def labels_prompt(text: Column, labels: list[str]) -> Column:
    """Prompt that asks for all values of the labels in a text, as JSON."""
    return F.concat(F.lit("List every value of these kinds in the text as JSON [{\"value\", \"label\"}]: " + ", ".join(labels) + "\nText:\n"), text)


class CallFailed(Exception):
    """A call that gave no usable answer; ``truncated`` if a shorter question may help."""

    def __init__(self, message: str, truncated: bool = False) -> None:
        super().__init__(message)
        self.truncated = truncated


def call_json(client: Client, prompt: str, schema: dict | None = None, retries: int = 1) -> object:
    """The checked JSON answer to one prompt; a bad answer is asked again with what was wrong. Raises CallFailed."""
    note, last = "", CallFailed("no answer")
    for _ in range(retries + 1):
        try:
            a = client(scrub(prompt + note))
        except Exception as e:  # noqa: BLE001 - a client's failure is data
            last = CallFailed(f"{type(e).__name__}: {e}"[:300])
            continue
        if a.error or a.refused or a.truncated:
            raise CallFailed(a.error or ("refused" if a.refused else "truncated"), a.truncated)
        try:
            value = parse_json(a.text or "", schema)
            bad = problems(value, schema) if schema else []
        except ValueError as e:
            bad = [str(e)]
        if not bad:
            return value
        last = CallFailed("; ".join(bad)[:300])
        note = f"\nThe last answer was not valid: {last}"
    raise last


def ask(df: DataFrame, prompt: Column, client: Callable[[], Client], schema: dict | None = None, key_col: str = "id", retries: int = 1) -> DataFrame:
    """``id, response, error, truncated``: checked JSON answers. A bad answer is asked again with what was wrong; errors are rows, never raised."""
    kind = df.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["k"], pdf["p"]):
                row = (key, None, "no prompt", False)
                if text is not None:
                    try:
                        row = (key, json.dumps(call_json(call, text, schema, retries), ensure_ascii=False), None, False)
                    except CallFailed as e:
                        row = (key, None, str(e), e.truncated)
                rows.append(row)
            yield pd.DataFrame(rows, columns=["id", "response", "error", "truncated"])

    return df.select(F.col(key_col).alias("k"), prompt.alias("p")).mapInPandas(run, f"id {kind}, response string, error string, truncated boolean")


def ask_cached(df: DataFrame, prompt: Column, model: str, client: Callable[[], Client], cache: DataFrame, schema: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers of all rows, new cache rows); equal prompts are asked once and errors are never cached."""
    keyed = df.select("id", prompt.alias("prompt")).withColumn("key", cache_key(F.lit(model), F.col("prompt"), F.lit(json.dumps(schema))))
    hit, miss = with_cached(keyed, cache)
    once = miss.select("key", "prompt").distinct()
    new = ask(once, F.col("prompt"), client, schema, "key").withColumnRenamed("id", "key")
    answered = miss.join(new, "key").select("id", "response", "error")
    return hit.select("id", "response", F.lit(None).cast("string").alias("error")).unionByName(answered), new.where("error is null").select("key", "response")


def halve(text: str) -> int:
    """Where to cut a text in two near-equal parts: behind the line break nearest to the middle, else the white space, else in the middle. No part is longer than
    three quarters."""
    n = len(text)
    mid = n // 2
    for mark in (r"\n", r"\s"):
        near = [m.end() for m in re.compile(mark).finditer(text, max(n // 4 - 1, 0), n - n // 4) if n // 4 <= m.end() < n and m.end() > 0]
        if near:
            return min(near, key=lambda p: (abs(p - mid), p))
    return mid
