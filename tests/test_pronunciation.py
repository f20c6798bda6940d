"""Comparison of compatible forms, and of Chinese by pronunciation, down to a book's results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from storyline.book import Book
from storyline.operators import verify

TABLE = {"林": "lin", "琳": "lin", "风": "feng", "峰": "feng", "風": "feng", "来": "lai", "來": "lai", "了": "le"}


@pytest.mark.parametrize(
    ("text", "transcript", "lang", "edits"),
    [("chapter ｔｗｅｌｖｅ of the ﬁle", "chapter twelve of the file", "en", 0), ("Ａ１ b", "a1 b", "en", 0), ("näive x", "näive x", "en", 0), ("我有１５只猫", "我有十五只猫", "zh", 0), ("plain", "other", "en", 1), ("林风来了", "林峰來了", "zh", 0), ("林风来了", "琳云来了", "zh", 1)],
)
def test_compare(spark, text, transcript, lang, edits):
    pairs = spark.createDataFrame([(text, transcript)], "text string, transcript string")
    assert verify.compare(pairs, lang, syllable=verify.pronunciation(TABLE)).first().edits == edits


def test_characters_without_a_syllable_stay(value):
    assert value(verify.tokens(F.lit("林云風 lin"), "zh", verify.pronunciation(TABLE))) == ["lin", "云", "feng", "lin"]


def test_judge_counts_syllables(value):
    text, many = F.lit("林琳林琳风峰"), (F.lit(1.0), F.lit(6), F.lit(1.0), "zh")
    assert value(verify.judge(text, *many)) is False and value(verify.judge(text, *many, syllable=verify.pronunciation(TABLE))) is True


@pytest.mark.parametrize("table", [True, False])
def test_a_chinese_book(spark, tmp_path, table):
    (tmp_path / "source.txt").write_text("第一章\n\n林风来了林风来了林风来了。\n", encoding="utf-8")
    (tmp_path / "book.json").write_text(json.dumps({"title": "T", "language": "zh", "voices": {"narrator": "220", "_default": "440"}}))
    (tmp_path / "cast.json").write_text("[]")
    if table:
        (tmp_path / "pinyin.json").write_text(json.dumps(TABLE))
    book = Book(spark, str(tmp_path))
    book.ingest()
    book.attribute()
    book.render()
    book.verify(lambda rows: rows.select("id", F.lit("琳峰來了琳峰來了琳峰來了").alias("transcript")))
    assert [r.ok for r in book.read("verify").collect()] == [table]
