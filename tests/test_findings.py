"""Findings on voice maps, against difflib over all pairs and against the plain check of one book."""

from __future__ import annotations

import difflib
import random
from collections import defaultdict

import pytest

from storyline.operators import findings, voices
from storyline.operators.cast import Character


def plain(roles, names):
    of = defaultdict(set)
    for book, name in names:
        if name is not None:
            of[book].add(name)
    out = {}
    for book, role in roles:
        if role is not None and (best := difflib.get_close_matches(role, of[book], n=1, cutoff=0.6)):
            out[book, role] = best[0]
    return out


def nearest(spark, roles, names, **sizes):
    rows = findings.nearest(spark.createDataFrame(roles, "book string, role string").repartition(3), spark.createDataFrame(names, "book string, name string"), **sizes).collect()
    assert len({(r.book, r.role) for r in rows}) == len(rows)
    assert all(r.ratio == difflib.SequenceMatcher(None, r.name, r.role).ratio() for r in rows)
    return {(r.book, r.role): r.name for r in rows}


@pytest.mark.parametrize("sizes", [{}, {"block": 3}])
def test_nearest_is_difflibs(spark, sizes):
    """Short alphabets, so that letters repeat and ratios lie at 0.6; null and empty books and strings; repeats; very long strings."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abAB é你😀", k=draw.randint(0, 9)))
    books = ["hot"] * 5 + ["x", "", None]
    roles = [(draw.choice(books), draw.choice([word()] * 9 + [None])) for _ in range(150)]
    names = [(draw.choice(books), draw.choice([word()] * 9 + [None])) for _ in range(150)]
    roles += [("x", ""), ("", ""), ("x", "ab" * 300), ("no names", "abc"), *roles[:9]]
    names += [("x", ""), ("x", "ba" * 290), ("no roles", "abc"), *names[:9]]
    expected = plain(roles, names)
    assert len(expected) > 60
    assert nearest(spark, roles, names, **sizes) == expected


def test_nearest_at_the_cutoff(spark):
    """Exactly 0.6 is near, and strings that have nothing but single characters in common are."""
    names = [("b", "abcdexxxxx"[:5]), ("b", "a1b2c3d"), ("b", "qrstuvw"), ("b", "Elizabeth"), ("b", "Elisabeth")]
    roles = [("b", "abcyy"), ("b", "axbycz"), ("b", "qr"), ("b", "Elizabet"), ("b", "Elixabeth"), ("c", "Elizabeth")]
    assert nearest(spark, roles, names) == plain(roles, names)
    assert plain(roles, names)["b", "abcyy"] == "abcde" and difflib.SequenceMatcher(None, "abcde", "abcyy").ratio() == 0.6


def found(spark, maps, casts, clips, backend, styles=("angry",)):
    entries = [(b, k, v) for b, m in maps.items() for k, v in m.items()]
    people = [(b, i, c.name, c.aliases, c.main) for b, cast in casts.items() for i, c in enumerate(cast)]
    return findings.findings(
        spark.createDataFrame(entries, "book string, key string, voice string"), spark.createDataFrame(people, "book string, rank int, name string, aliases array<string>, main boolean"), voices.pool_table(spark),
        spark.createDataFrame(clips, "book string, path string"), spark.createDataFrame([(b, backend, "en", list(styles)) for b in maps], "book string, backend string, lang string, styles array<string>"),
    ).collect()


def test_each_kind(spark):
    people = [Character("Elizabeth", ["Lizzy"]), Character("Jane")]
    maps = {"a": {"Elizabet": "af_heart", "Lizzy": "zf_xiaoni", "Jane@loud": "nope", "Jane@x@angry": "af_heart"}, "b": {"narrator": "af_sky", "Elizabeth": "af_sky", "Jane": "am_adam"}}
    got = {(r.book, r.error, r.kind, r.key, r.voice, r.detail) for r in found(spark, maps, {"a": people, "b": people}, [], "kokoro")}
    assert got == {
        ("a", True, "no narrator", None, None, None), ("a", True, "nobody", "Elizabet", "af_heart", "Elizabeth"), ("a", True, "nobody", "Jane@x@angry", "af_heart", "Jane"), ("a", True, "no voice", "Jane@loud", "nope", None),
        ("a", True, "language", "Lizzy", "zf_xiaoni", "zh"), ("a", False, "style", "Jane@loud", "nope", "loud"), ("a", False, "alias", "Lizzy", "zf_xiaoni", "Elizabeth"),
        ("a", False, "silent", "Elizabeth", None, None), ("a", False, "silent", "Jane", None, None), ("a", False, "shared", None, "af_heart", "Elizabet, Jane@x@angry"),
    }


def test_clips_and_backends_without_voices(spark):
    maps = {"a": {"narrator": "voices/a.wav", "Jane": "voices/b.wav"}, None: {"narrator": "voices/a.wav"}}
    got = {(r.book, r.kind, r.key) for r in found(spark, maps, {"a": [Character("Jane")]}, [("a", "voices/a.wav")], "qwen3tts")}
    assert got == {("a", "no clip", "Jane"), (None, "no clip", "narrator")}
    assert found(spark, {"a": {"narrator": "anything"}}, {}, [], "tone") == []
    assert found(spark, {}, {"a": [Character("Jane")]}, [("a", "x.wav")], "kokoro") == []


def test_as_the_plain_check_says(spark):
    """As many findings of each book as `voices.check` has, that sums silent people up in one."""
    draw = random.Random(3)
    names = ["Anne", "Ann", "Beth", "beth", "Dr. Who", "Bob"]
    maps, casts = {}, {}
    for k in range(12):
        casts[str(k)] = [Character(n, draw.sample(names, 2), main=draw.random() < 0.5) for n in draw.sample(names, 3)]
        maps[str(k)] = {r + draw.choice(["", "", "@angry", "@odd"]): draw.choice(["af_heart", "am_adam", "zm_yunxi", "none"]) for r in draw.sample([*names, "narrator", "_default", "Bethh", "!"], 5)}
    rows = found(spark, maps, casts, [], "kokoro")
    for book, entries in maps.items():
        errors, warnings = voices.check(entries, casts[book], "kokoro", "en", ["angry"])
        mine = [r for r in rows if r.book == book]
        assert sum(r.error for r in mine) == len(errors)
        silent = any(r.kind == "silent" for r in mine)
        assert sum(not r.error and r.kind != "silent" for r in mine) + silent == len(warnings)
        for r in mine:
            if r.kind == "nobody":
                assert any(r.key in e and (f"{r.detail!r}?" in e if r.detail else "perhaps" not in e) for e in errors)
