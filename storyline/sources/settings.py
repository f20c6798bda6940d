"""What a book's configuration may say. Every key has a rule; what no rule knows, and a value that breaks its rule, is a problem."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from typing import Any

Rule = Callable[[Any], bool]


def text(value: Any) -> bool:
    return isinstance(value, str)


def maybe(rule: Rule) -> Rule:
    return lambda value: value is None or rule(value)


def number(least: float, most: float = float("inf")) -> Rule:
    return lambda value: isinstance(value, int | float) and not isinstance(value, bool) and least <= value <= most


def whole(least: int) -> Rule:
    return lambda value: isinstance(value, int) and not isinstance(value, bool) and value >= least


def one_of(*values: str) -> Rule:
    return lambda value: text(value) and value in values


def texts(value: Any) -> bool:
    return isinstance(value, list) and all(map(text, value))


def voices(value: Any) -> bool:
    """One map from role to voice, or one for each provider."""
    if not isinstance(value, dict):
        return False
    return all(text(v) or isinstance(v, dict) and all(map(text, v.values())) for v in value.values())


#: Rules by key, sections being tables of their own, with what a problem says is wanted.
RULES: dict[str, Any] = {
    "title": (text, "a text"), "author": (text, "a text"), "genre": (text, "a text"), "language": (one_of("en", "zh"), "en or zh"), "cover": (maybe(text), "a path"),
    "narrator": (text, "a text"), "narrator_description": (maybe(text), "a text"), "chapter_regex": (maybe(text), "a pattern"), "styles": (texts, "a list of texts"),
    "voices": (voices, "voices by role, or such a map for each provider"), "loudness_lufs": (number(-70, 0), "a number from -70 to 0"),
    "pauses": {k: (number(0), "seconds") for k in ("sentence", "paragraph", "speaker_change", "chapter")},
    "tts": {
        "backend": (text, "a provider's name"), "params": (lambda v: isinstance(v, dict), "a map"), "command": (lambda v: texts(v) and bool(v), "a list of texts"), "name": (text, "a text"),
        "sample_rate": (whole(1), "a whole number from 1"), "batch": (maybe(whole(1)), "a whole number from 1"), "batch_tokens": (whole(1), "a whole number from 1"), "batch_size": (whole(1), "a whole number from 1"),
        "max_chars": (whole(1), "a whole number from 1"), "deadline": (number(0), "seconds"), "restarts": (whole(0), "a whole number"),
        "checkpoint_chapters": (whole(1), "a whole number from 1"), "checkpoint_lines": (whole(1), "a whole number from 1"),
    },
    "llm": {"provider": (text, "a provider's name"), "model": (maybe(text), "a text"), "num_ctx": (whole(1024), "a whole number from 1024")},
    "cast": {"main_cap": (whole(0), "a whole number"), "merge_chapters": (whole(1), "a whole number from 1")},
    "verify": {
        "provider": (text, "a provider's name"), "threshold": (number(0), "a number from 0"), "max_attempts": (whole(1), "a whole number from 1"),
        "batch": (whole(1), "a whole number from 1"), "whisper_model": (maybe(text), "a text"),
    },
    "build": {"chapter_format": (one_of("mp3", "m4b", "none"), "mp3, m4b or none")},
}


def problems(config: Any, rules: dict[str, Any] = RULES, at: str = "") -> list[str]:
    """What is wrong with a configuration, in the order of its keys; keys that begin with "_" are remarks."""
    if not isinstance(config, dict):
        return [f"{at.rstrip('.') or 'the configuration'} should be a map"]
    out = []
    for key, value in config.items():
        rule = rules.get(key)
        if str(key).startswith("_"):
            continue
        if rule is None:
            near = difflib.get_close_matches(str(key), rules, 1)
            out.append(f"{at}{key}: unknown" + (f" (perhaps {near[0]}?)" if near else ""))
        elif isinstance(rule, dict):
            out += problems(value, rule, f"{at}{key}.")
        elif not rule[0](value):
            out.append(f"{at}{key}: {value!r} should be {rule[1]}")
    return out


def validated(config: Any, path: str) -> dict:
    """The configuration, if nothing is wrong with it."""
    if found := problems(config):
        raise ValueError(f"{path}: " + "; ".join(found))
    return config
