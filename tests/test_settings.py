"""A book's configuration: what is wrong with it is said at once, all of it."""

from __future__ import annotations

import json

import pytest

from storyline.book import Book
from storyline.sources import books, settings


def test_what_is_right():
    assert settings.problems({}) == []
    full = {"_": 1, "title": "T", "language": "zh", "chapter_regex": None, "styles": ["sad"], "voices": {"narrator": "a", "kokoro": {"narrator": "b"}}, "loudness_lufs": -18, "build": {"chapter_format": "m4b"}}
    full |= {"tts": {"backend": "kokoro", "params": {"speed": 1.1}, "batch": None, "command": ["x"]}, "verify": {"threshold": 0}, "pauses": {"chapter": 2}, "cast": {"main_cap": 0}, "llm": {"num_ctx": 4096}}
    assert settings.problems(full) == []


@pytest.mark.parametrize(
    ("config", "said"),
    [
        ({"voces": {}}, "voces: unknown (perhaps voices?)"),
        ({"tts": {"bakend": "tone"}}, "tts.bakend: unknown (perhaps backend?)"),
        ({"q": 1}, "q: unknown"),
        ({"language": "fr"}, "language: 'fr' should be en or zh"),
        ({"verify": {"threshold": "0.1"}}, "verify.threshold: '0.1' should be a number from 0"),
        ({"verify": {"max_attempts": True}}, "verify.max_attempts: True should be a whole number from 1"),
        ({"verify": 3}, "verify should be a map"),
        ({"voices": {"a": 1}}, "voices: {'a': 1} should be voices by role, or such a map for each provider"),
        ({"tts": {"command": []}}, "tts.command: [] should be a list of texts"),
        ({"styles": "sad"}, "styles: 'sad' should be a list of texts"),
        ([], "the configuration should be a map"),
    ],
)
def test_what_is_wrong(config, said):
    assert settings.problems(config) == [said]


def test_a_book_says_all_of_it(spark, tmp_path):
    (tmp_path / "book.json").write_text(json.dumps({"titel": "T", "pauses": {"chapter": -1}}))
    with pytest.raises(ValueError, match=r"book.json: titel: unknown \(perhaps title\?\); pauses.chapter: -1 should be seconds"):
        Book(spark, str(tmp_path))


def test_a_new_book_is_right(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One.")
    assert settings.problems(books.scaffold(spark, str(tmp_path / "a.txt"), str(tmp_path / "new"))) == []


def test_a_book_checks_its_voices(spark, tmp_path):
    (tmp_path / "voices").mkdir()
    (tmp_path / "voices" / "a.wav").write_bytes(b"x")
    (tmp_path / "cast.json").write_text(json.dumps([{"name": "Elizabeth", "aliases": ["Lizzy"]}, {"name": "Jane"}]))
    (tmp_path / "book.json").write_text(json.dumps({"title": "T", "styles": ["angry"], "tts": {"backend": "kokoro"}, "voices": {"Elizabet": "af_heart", "Lizzy": "zf_xiaoni", "Jane@loud": "nope"}}))
    errors, warnings = Book(spark, str(tmp_path)).check()
    at = "voices.kokoro."
    assert errors == [f"{at}Lizzy: 'zf_xiaoni' doesn't speak en", "voices.kokoro: there is no narrator", f"{at}Jane@loud: no such voice: 'nope'", f"{at}Elizabet: nobody of the cast (perhaps 'Elizabeth'?)"]
    assert warnings == [f"{at}Lizzy: an alias of 'Elizabeth'; use that name", f"{at}Jane@loud: the book has no style 'loud', so this clip is never used", "2 of the main cast speak as _default: Elizabeth, Jane"]
    (tmp_path / "book.json").write_text(json.dumps({"tts": {"backend": "qwen3tts"}, "voices": {"narrator": "voices/a.wav", "Jane": "voices/b.wav", "Elizabeth": "voices/a.wav"}}))
    assert Book(spark, str(tmp_path)).check() == (["voices.qwen3tts.Jane: no such clip: voices/b.wav"], [])
