from __future__ import annotations

from storyline.operators import sections

EN = """Preface line

CHAPTER I

It is a truth
universally   acknowledged.

“However little,” he said.

CHAPTER II
Second.

3.

Third one.
"""


def rows(spark, text, **options):
    books = spark.createDataFrame([("b", text)], "book string, text string")
    return [(r.chapter, r.title, r.paragraphs) for r in sections.chapters(books, **options).orderBy("chapter").collect()]


def test_plain_text(spark):
    assert rows(spark, EN) == [
        (0, "Chapter 1", ["Preface line"]),
        (1, "CHAPTER I", ["It is a truth universally acknowledged.", '"However little," he said.']),
        (2, "CHAPTER II", ["Second."]),
        (3, "3.", ["Third one."]),
    ]


def test_markdown(spark):
    assert rows(spark, "# One\n\nfoo\n\n## Two ##\n\nbar\n### no\n", markdown=True) == [(0, "One", ["foo"]), (1, "Two", ["bar ### no"])]


def test_chinese_lines_join_without_space(spark):
    assert rows(spark, "第一章 雪\n\n他说\n「好」．\n", lang="zh") == [(0, "第一章 雪", ['他说"好".'])]


def test_own_heading_pattern_keeps_bare_numerals(spark):
    assert rows(spark, "Scene one\na\nCHAPTER I\nIV\nb", pattern="Scene") == [(0, "Scene one", ["a CHAPTER I"]), (1, "IV", ["b"])]


def test_boilerplate(spark):
    text = "x\n*** START OF THIS PROJECT GUTENBERG EBOOK\nCHAPTER 1\na\n*** end of the project gutenberg\nCHAPTER 2\nb"
    assert rows(spark, text) == [(0, "CHAPTER 1", ["a"])]


def test_empty_and_heading_only(spark):
    assert rows(spark, "") == [] and rows(spark, " \n\r\n ") == [] and rows(spark, None) == []
    assert rows(spark, "CHAPTER 1") == [(0, "CHAPTER 1", [])]


def test_paragraph_rows_and_summary(spark):
    books = spark.createDataFrame([("b", EN)], "book string, text string")
    chapters = sections.chapters(books)
    assert sections.paragraph_rows(chapters).count() == 5
    assert tuple(sections.summary(chapters).first()) == (4, 5)
