from __future__ import annotations

import pytest

from storyline.operators import attribution, cast, dialogue
from storyline.operators.cast import Character

CAST = [Character("Mrs. Bennet", ["his wife", "his lady"]), Character("Mr. Bennet"), Character("Elizabeth", ["Lizzy"]), Character("Jane")]


def spans(spark, paragraphs, people=CAST, lang="en"):
    chapters = spark.createDataFrame([(0, paragraphs)], "chapter int, paragraphs array<string>")
    return [(r.para, r.kind, r.text, r.speaker, r.confidence, r.quote_id) for r in dialogue.span_rows(chapters, people, lang).orderBy("para", "span").collect()]


def speakers(spark, paragraphs, **options):
    return [s[3] for s in spans(spark, paragraphs, **options) if s[1] == "dialogue"]


def test_tag_after_and_split_quote(spark):
    found = spans(spark, ['"My dear Mr. Bennet," said his lady to him one day, "have you heard?"'])
    assert [(s[1], s[3], s[4], s[5]) for s in found] == [("dialogue", "Mrs. Bennet", 0.95, 1), ("narration", "narrator", 1.0, None), ("dialogue", "Mrs. Bennet", 0.95, 2)]


def test_tag_before_and_name_first(spark):
    assert speakers(spark, ['Jane said, "Hello." "Hi," Elizabeth replied.']) == ["Jane", "Elizabeth"]


def test_unresolved(spark):
    found = spans(spark, ['"One thing is here."', '"Two things, sir."'])
    assert [(s[3], s[5]) for s in found] == [(None, 1), (None, 2)]


def test_continued_quote(spark):
    assert speakers(spark, ['"It began long ago, said nobody.', '"And it ended," said Jane.']) == [None, "Jane"]
    assert speakers(spark, ['Jane said, "It began long ago.', '"And went on for years.']) == ["Jane", "Jane"]


def test_speech_over_three_paragraphs_loses_its_link(spark):
    found = spans(spark, ['Jane said, "One, two.', '"three, four.', '"five, six."'])
    assert [(s[0], s[3], s[4]) for s in found if s[1] == "dialogue"] == [(0, "Jane", 0.95), (1, "Jane", 0.85), (2, None, 0.0)]


def test_chinese(spark):
    people = [Character("店主"), Character("小明")]
    assert speakers(spark, ['店主说："你好，请进。" "要买什么？"小明答道："一本书。"'], people=people, lang="zh")[:1] == ["店主"]


def test_scare_quotes_and_empty_ones(spark):
    assert [s[1] for s in spans(spark, ['the "Ghost" walked "" away'])] == ["narration"] * 4
    assert [s[1] for s in spans(spark, ['he cried "Bingley." loudly'])] == ["narration", "dialogue", "narration"]


def test_open_tail_takes_a_number_even_if_empty(spark):
    assert [(s[1], s[2], s[5]) for s in spans(spark, ['He spoke: "'])] == [("narration", "He spoke:", None), ("dialogue", "", 1)]


def test_empty_chapter_and_cast(spark):
    assert spans(spark, []) == [] and spans(spark, [""]) == []
    assert [(s[1], s[2]) for s in spans(spark, ['"a," said b'], people=[])] == [("narration", '"a," said b')]


def test_chain_of_split_quotes(spark):
    assert speakers(spark, ['"A, b," said Jane, "c, d," and then "e, f," and so "g, h."']) == ["Jane"] * 4


@pytest.mark.parametrize(("name", "found"), [("mrs bennet", "Mrs. Bennet"), ("Mrs. Bennet.", "Mrs. Bennet"), ("LIZZY", "Elizabeth"), ("Bingley", None), ("", None)])
def test_resolve(value, name, found):
    from pyspark.sql import functions as F

    assert value(cast.resolver(CAST)(F.col("n")), n=name) == found


def test_lines_keep_gaps_and_locks(spark):
    chapters = spark.createDataFrame([(2, ['"..." said Jane. "Go, now."'])], "chapter int, paragraphs array<string>")
    rows = dialogue.span_rows(chapters, CAST)
    old = spark.createDataFrame([("c002p0000s02", 2, 0, "dialogue", "Elizabeth", "Go, now.", "en", "angry", 1.0, True), ("c002p0000s01", 2, 0, "dialogue", "Elizabeth", "other text", "en", None, 1.0, True)], "id string, chapter int, para int, kind string, speaker string, text string, lang string, style string, confidence double, locked boolean")
    found = {r.id: r for r in attribution.lines(rows, locked=old).collect()}
    assert set(found) == {"c002p0000s01", "c002p0000s02"}
    assert found["c002p0000s02"].speaker == "Elizabeth" and found["c002p0000s02"].style == "angry" and found["c002p0000s01"].speaker == "narrator"
    assert attribution.statistics(attribution.lines(rows, locked=old)).first().locked == 1


def test_answers(spark):
    chapters = spark.createDataFrame([(0, ['"One, a."', '"Two, b."', '"Three, c."', '"Four, d," said Jane.'])], "chapter int, paragraphs array<string>")
    rows = dialogue.span_rows(chapters, [*CAST, Character("Ann"), Character("Bob")])
    response = '{"speakers":[{"quote_id":1,"speaker":"nobody"},{"quote_id":1,"speaker":"ann","confidence":0.99,"style":"soft"},{"quote_id":1,"speaker":"Bob","style":"loud"},{"quote_id":2,"speaker":"Bob"},{"quote_id":4,"speaker":"Bob","style":"angry"}]}'
    responses = spark.createDataFrame([(0, 0, response)], "chapter int, window int, response string")
    out = attribution.fold_answers(rows, attribution.parse_answers(responses), [*CAST, Character("Ann"), Character("Bob")], ["angry", "soft"])
    got = [(r.quote_id, r.speaker, r.confidence, r.style) for r in out.where("quote_id is not null").orderBy("quote_id").collect()]
    assert got == [(1, "Ann", 0.8, "soft"), (2, "Bob", 0.5, None), (3, "unknown", 0.0, None), (4, "Jane", 0.95, "angry")]
    assert attribution.low_confidence(attribution.lines(out)).count() == 3


def test_requests_skip_what_is_resolved(spark):
    chapters = spark.createDataFrame([(0, ['"Hello, you," said Jane.']), (1, ["plain", '"Hello, you."'])], "chapter int, paragraphs array<string>")
    rows = dialogue.span_rows(chapters, CAST)
    got = attribution.requests(rows, 10000).collect()
    assert [(r.chapter, r.first, r.last, r.passage) for r in got] == [(1, 0, 1, 'plain\n\n[q1](?) "Hello, you."')]
    assert attribution.requests(rows, 10000, styled=True).count() == 2


def test_budgets():
    assert attribution.prompt_budget() == 16384 - 2048
    with pytest.raises(attribution.PromptTooLong):
        attribution.window_budget(2000, 4096)
