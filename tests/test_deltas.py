"""Tables as logs of commits."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from storyline import providers
from storyline.book import Book
from storyline.sources import books, deltas

SCHEMA = books.RENDER


def rows(spark, *some):
    return spark.createDataFrame([(i, c, a, "tone", 0) for i, c, a in some], SCHEMA)


def held(spark, root, chapters=None):
    return sorted((r.id, r.chapter, r.audio) for r in books.read_table(spark, root, "render", chapters).collect())


def test_last_commit_wins(spark, tmp_path):
    root = str(tmp_path)
    assert held(spark, root) == [] and not deltas.has_table(spark, root, "render")
    books.write_table(rows(spark, ("a", 0, "1"), ("b", 0, "1"), ("c", 1, "1")), root, "render")
    books.add_rows(rows(spark, ("b", 0, "2"), ("d", 1, "2")), root, "render")
    assert held(spark, root) == [("a", 0, "1"), ("b", 0, "2"), ("c", 1, "1"), ("d", 1, "2")]
    assert held(spark, root, [1]) == [("c", 1, "1"), ("d", 1, "2")]
    books.write_table(rows(spark, ("b", 0, "3")), root, "render")  # whole: a is gone
    assert held(spark, root) == [("b", 0, "3"), ("c", 1, "1"), ("d", 1, "2")]
    books.write_table(books.read_table(spark, root, "render").withColumn("audio", F.concat("audio", F.lit("x"))), root, "render")  # from itself
    assert held(spark, root) == [("b", 0, "3x"), ("c", 1, "1x"), ("d", 1, "2x")]
    assert books.prune_chapters(spark, root, "render", 1) == [1] and held(spark, root) == [("b", 0, "3x")]
    assert len(deltas.commits(spark, root, "render")) == 1


def test_a_commit_that_was_broken_off_does_not_count(spark, tmp_path):
    root = str(tmp_path)
    books.write_table(rows(spark, ("a", 0, "1")), root, "render")
    books.write_table(rows(spark, ("a", 0, "2")), root, "render")
    (Path(root) / "render.log/commit=00000002/_SUCCESS").unlink()
    assert held(spark, root) == [("a", 0, "1")]
    books.add_rows(rows(spark, ("b", 0, "3")), root, "render")  # takes the next number
    assert deltas.commits(spark, root, "render") == [1, 3] and held(spark, root) == [("a", 0, "1"), ("b", 0, "3")]


def test_compaction_says_the_same(spark, tmp_path):
    rng, root, want = random.Random(3), str(tmp_path), {}
    rows(spark, ("old", 0, "0")).write.partitionBy("chapter").parquet(f"{root}/render")  # a table of before is commit 0
    want["old"] = (0, "0")
    for n in range(12):
        some = {f"l{rng.randint(0, 9)}": (rng.randint(0, 2), str(n)) for _ in range(rng.randint(1, 5))}
        some = {i: (int(i[1:]) % 3, a) for i, (_, a) in some.items()}
        whole = rng.random() < 0.3
        if whole:
            want = {i: v for i, v in want.items() if v[0] not in {c for c, _ in some.values()}}
        want |= some
        (books.write_table if whole else books.add_rows)(rows(spark, *((i, c, a) for i, (c, a) in some.items())), root, "render")
        assert held(spark, root) == sorted((i, *v) for i, v in want.items())
    deltas.compact(spark, root, "render", SCHEMA)
    assert held(spark, root) == sorted((i, *v) for i, v in want.items())
    assert len(deltas.commits(spark, root, "render")) == 1 and not books.exists(spark, f"{root}/render")


def test_commits_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(books, "MOST_COMMITS", 2)
    for n in range(4):
        books.write_table(rows(spark, ("a", 0, str(n)), (f"b{n}", n, "x")), str(tmp_path), "render")
    assert len(deltas.commits(spark, str(tmp_path), "render")) <= 2
    assert ("a", 0, "3") in held(spark, str(tmp_path))


def test_last_line_of_json_wins(spark, tmp_path):
    at = tmp_path / "lines.jsonl"
    at.write_text("\n".join(json.dumps({"id": i, "chapter": 0, "audio": a, "backend": "t", "attempts": 0}) for i, a in [("x", "1"), ("y", "1"), ("x", "2"), ("x", "0")]) + "\n\n")
    assert sorted((r.id, r.audio) for r in books.read_jsonl(spark, str(at), "render").collect()) == [("x", "0"), ("y", "1")]


def test_an_interrupted_render_keeps_finished_lines(spark, tmp_path, monkeypatch):
    """The provider fails at a word; lines of the steps before have their audio and rows, and aren't made again."""
    flag = tmp_path / "fail"

    class Failing(providers.Tone):
        def synthesize(self, text, voice, lang="en", **params):
            if "three" in text and flag.exists():
                raise RuntimeError("out of memory")
            with open(f"{flag}.asked", "a") as f:
                f.write(text + "\n")
            return super().synthesize(text, voice, lang, **params)

    monkeypatch.setattr(providers, "configured", lambda tts: Failing)
    (tmp_path / "source.txt").write_text("CHAPTER I\n\nLine one.\n\nLine two.\n\nLine three.\n\nLine four.\n")
    (tmp_path / "book.json").write_text(json.dumps({"title": "T", "voices": {"narrator": "a220"}, "tts": {"checkpoint_lines": 1}}))
    (tmp_path / "cast.json").write_text("[]")
    book = Book(spark, str(tmp_path))
    book.ingest()
    book.attribute()
    flag.touch()
    with pytest.raises(Exception, match="out of memory"):
        book.render()
    done = {r.id for r in book.table("render").collect()}
    assert len(done) == 2 and book.inventory().count() == 2
    flag.unlink()
    book.render()
    assert book.table("render").where("audio IS NOT NULL").count() == 4 and book.states().where("stage = 'render' AND size(reasons) = 0").count() == 1
    asked = Path(f"{flag}.asked").read_text().split("\n")[:-1]
    assert sorted(asked) == ["Line four.", "Line one.", "Line three.", "Line two."]
