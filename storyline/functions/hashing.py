"""Content hashes: equal inputs give equal keys on every engine and in every run."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH = 24


def content_hash(*parts: Column | str) -> Column:
    """First 24 hexadecimal digits of the SHA-256 over all parts, each followed by a zero byte."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.substring(F.sha2(F.concat(*(x for p in columns for x in (p.cast("string"), F.lit("\x00")))), 256), 1, LENGTH)


def json_string(text: Column) -> Column:
    """A string as a JSON literal, non-ASCII characters as they are."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(name))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def json_array(items: Column) -> Column:
    """An array of strings as JSON with ", " between."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, json_string), ", "), F.lit("]"))


def json_map(entries: Column) -> Column:
    """A string map as JSON with sorted keys."""
    items = F.array_sort(F.map_entries(entries))
    return F.concat(F.lit("{"), F.array_join(F.transform(items, lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_string(e["value"]))), ", "), F.lit("}"))


def params_json(params: dict, seed: Column | None = None) -> Column:
    """Synthesis parameters as JSON with sorted keys; seed is one of them if given."""
    if seed is None:
        return F.lit(json.dumps(params, sort_keys=True, ensure_ascii=False))
    before = {k: v for k, v in params.items() if k < "seed"}
    after = {k: v for k, v in params.items() if k > "seed"}
    body = lambda d: json.dumps(d, sort_keys=True, ensure_ascii=False)[1:-1]
    head = body(before) + ", " if before else ""
    tail = ", " + body(after) if after else ""
    return F.concat(F.lit("{" + head + '"seed": '), seed.cast("string"), F.lit(tail + "}"))


def render_key(backend: Column | str, voice: Column, params: dict, seed: Column, text: Column) -> Column:
    """Name of the audio of a line: changes with backend, voice, parameters, seed and text."""
    return content_hash("render", backend, voice, params_json(params, seed), text)
