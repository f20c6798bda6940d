from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from storyline.__main__ import main
from storyline.book import Book
from storyline.operators import cast

SOURCE = """CHAPTER I

"Good morning, sir," said Ann. "How are you?"

The day was fine.

CHAPTER II

"I am well, thank you," replied Bob.
"""


@pytest.fixture
def root(tmp_path):
    (tmp_path / "source.txt").write_text(SOURCE)
    (tmp_path / "book.json").write_text(json.dumps({"title": "T", "voices": {"narrator": "220", "Ann": "330", "_default": "440"}, "styles": ["angry"]}))
    (tmp_path / "cast.json").write_text(json.dumps([{"name": "Ann"}, {"name": "Bob", "aliases": ["Robert"]}]))
    return tmp_path


def fresh(book):
    return {(r.chapter, r.stage): r.reasons for r in book.states().collect()}


def test_a_book_from_source_to_timeline_and_what_edits_redo(spark, root):
    assert main(["run", str(root)]) == 0
    book = Book(spark, str(root))
    lines = {r.id: r for r in book.read("lines").collect()}
    assert [(lines[k].speaker, lines[k].text) for k in sorted(lines)] == [("Ann", "Good morning, sir,"), ("narrator", "said Ann."), ("Ann", "How are you?"), ("narrator", "The day was fine."), ("Bob", "I am well, thank you,"), ("narrator", "replied Bob.")]
    states = fresh(book)
    assert all(states[c, s] == [] for c in (0, 1) for s in ("attribute", "render", "build")) and states[0, "verify"] == ["missing"]
    assert [r.chapter for r in book.read("markers").orderBy("chapter").collect()] == [0, 1]
    audio = book.read("audio").count()

    main(["fix", str(root), "c001p0000s00", "--speaker", "robert", "--text", "I am quite well.", "--style", "angry"])
    assert fresh(book)[1, "render"] == ["lines"] and fresh(book)[0, "render"] == []
    book.attribute(force=True)  # the fixed line's text differs from the source's, so its lock no longer holds
    main(["fix", str(root), "c001p0000s00", "--speaker", "Ann"])
    book.attribute(force=True)
    assert book.read("lines").where("id = 'c001p0000s00'").first().speaker == "Ann"
    book.render()
    assert fresh(book)[1, "render"] == [] and book.read("audio").count() == audio + 1

    (root / "source.txt").write_text(SOURCE.replace("fine", "grey"))
    book.ingest()
    assert fresh(book)[0, "attribute"] == ["chapter"] and fresh(book)[1, "attribute"] == []
    book.attribute()
    book.render()
    assert book.read("audio").count() == audio + 2
    book.verify(lambda rows: rows.join(book.read("lines").select("id", F.col("text").alias("transcript")), "id").select("id", "transcript"))
    assert book.read("verify").where("ok").count() == 6
    assert "| render | fresh | 2/2 chapters fresh |" in book.report() and "[lock]" in " ".join(r.line for r in book.script().collect())

    (root / "source.txt").write_text(SOURCE.partition("CHAPTER II")[0])
    book.ingest()
    book.attribute()
    assert {r.chapter for r in book.read("lines").select("chapter").collect()} == {0}


def test_commands(spark, root, capsys):
    main(["voices", "kokoro"])
    assert "af_heart en f young" in capsys.readouterr().out
    assert main(["check", str(root)]) == 0
    main(["new", str(root / "source.txt"), str(root / "copy")])
    assert (root / "copy" / "source.txt").read_text() == SOURCE
    with pytest.raises(ValueError, match="no voices"):
        Book(spark, str(root / "copy")).render()


def test_discovery(spark):
    chapters = spark.createDataFrame([(0, ["a" * 30, "b" * 30, "c" * 300]), (1, ["x"])], "chapter int, paragraphs array<string>")
    windows = cast.discovery_windows(chapters, "en", 25)
    assert sorted((r.chapter, r.window, len(r.text)) for r in windows.collect()) == [(0, 0, 62), (0, 1, 300), (1, 0, 1)]
    assert cast.discovery_windows(chapters, "en", 25, windows.where("chapter = 0")).count() == 1
    entries = spark.createDataFrame([(k, 0, f"name{k}", [], "d" * 30) for k in range(7) if k != 3], "chapter int, pos int, name string, aliases array<string>, description string")
    assert sorted((r.chapter, r.batch) for r in cast.merge_batches(entries, 10**6, 5).collect()) == [(0, 0), (1, 0), (2, 0), (4, 0), (5, 0), (6, 1)]
    assert len({r.batch for r in cast.merge_batches(entries, 40).collect()}) == 3
