"""Attribution by a language provider that knows nothing but what it is shown."""

from __future__ import annotations

import json
import re
import sys

import pytest
from pyspark import cloudpickle

from storyline import providers
from storyline.__main__ import main
from storyline.book import Book
from storyline.operators import attribution
from storyline.operators.cast import Character

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stand-in goes to workers, which don't have this module
SOURCE = """CHAPTER I

"Good morning to you all," said Ann.

"And to you."

He thought about it. "Now to work!"

CHAPTER II

"Who is there, at this hour?"
"""
CAST = [{"name": "Ann", "aliases": ["Annie"]}, {"name": "Bob"}, {"name": "Cy", "main": False, "chapters": [1]}, {"name": "Dee", "main": False, "chapters": [7]}]


class Reader:
    """Gives every open quote to the last name on its list, and a style to every quote; says its list as confidence allows."""

    takes_schema = True

    def answer(self, prompt, system, schema):
        fields = schema["properties"]["speakers"]["items"]["properties"]
        names = re.findall(r"^- ([A-Z][a-z]+)", prompt, re.M)
        assert fields["speaker"]["enum"] == [*names, "unknown"] and "JSON" in system
        out = [{"quote_id": int(q), "speaker": names[-1] if who == "?" else "nobody", "confidence": 0.99} for q, who in re.findall(r"\[q(\d+)\]\(([^)]*)\)", prompt.rpartition("\n\n{")[2])]
        return {"speakers": [x | ({"style": fields["style"]["enum"][0]} if "style" in fields else {}) for x in out]}


@pytest.fixture
def root(tmp_path, monkeypatch):
    monkeypatch.setitem(providers.LANGUAGE, "reader", Reader)
    (tmp_path / "source.txt").write_text(SOURCE)
    (tmp_path / "cast.json").write_text(json.dumps(CAST))

    def make(**config):
        (tmp_path / "book.json").write_text(json.dumps({"title": "T", "voices": {"narrator": "a220"}} | config))
        return tmp_path

    return make


def spoken(book):
    return {r.text: (r.speaker, r.confidence, r.style) for r in book.table("lines").collect() if r.kind == "dialogue"}


def test_the_command_asks_the_configured_provider(spark, root):
    at = root(llm={"provider": "reader"}, styles=["angry", "sad"])
    assert main(["ingest", str(at)]) == 0 and main(["attribute", str(at)]) == 0
    book = Book(spark, str(at))
    found = spoken(book)
    assert found["Good morning to you all,"][:2] == ("Ann", 0.95)
    first, second = found["And to you."], found["Who is there, at this hour?"]
    assert first[0] == "Bob" and second[0] == "Cy"  # Cy is known in chapter 1 only, Dee in neither
    assert 0 < first[1] == second[1] < 0.85 and {x[2] for x in found.values()} == {"angry"}
    asked = spark.read.json(f"{book.work}/exchanges").collect()
    assert len(asked) == 2 and all("Annie" in r.prompt and "angry, sad" in r.prompt and "Dee" not in r.prompt for r in asked)
    assert re.search(r"attribute: 2 chapters: \d+ narration, 1 rules, 3 model, 0 unknown, 0 locked, 4 styled", "\n".join(book.log()))


def test_without_a_provider_rules_are_all(spark, root):
    at = root()
    main(["ingest", str(at)])
    main(["attribute", str(at)])
    book = Book(spark, str(at))
    assert spoken(book)["And to you."][0] == "unknown" and not book.has("exchanges")


def test_corrupt_answers_say_nothing(spark):
    rows = [(0, 0, '{"speakers": [{"quote_id": 1, "speaker": "Ann", "confidence": 0.5, "style": null}]}'), (0, 1, "no json"), (0, 2, '{"speakers": "Ann"}'), (0, 3, "{}"), (0, 4, None), (0, 5, '{"speakers": [{"quote_id": "one"}]}'), (0, 6, '{"speakers": []}')]
    responses = spark.createDataFrame(rows, "chapter int, window int, response string")
    assert {r.window: r.corrupt for r in attribution.answers_of(responses).collect() if r.corrupt is not None} == {1: "no json", 2: '{"speakers": "Ann"}', 3: "{}", 4: "", 5: '{"speakers": [{"quote_id": "one"}]}'}
    assert [(r.quote_id, r.speaker) for r in attribution.parse_answers(responses).collect()] == [(1, "Ann")]


def test_instructions_fit_what_is_counted(spark):
    cast = [Character(**c) for c in CAST]
    requests = spark.createDataFrame([(0, 0, "text {names}"), (1, 0, "text"), (7, 0, "text")], "chapter int, window int, passage string")
    rows = {r.chapter: r for r in attribution.with_instructions(requests, cast, "en", ["sad"]).collect()}
    assert "text {names}" in rows[0].passage and "- Cy" in rows[1].passage and "- Dee" in rows[7].passage and "- Cy" not in rows[7].passage
    assert json.loads(rows[7].schema)["properties"]["speakers"]["items"]["properties"]["speaker"]["enum"] == ["Ann", "Bob", "Dee", "unknown"]
    most = attribution.instruction_cost(cast, "en", ["sad"])
    assert all(providers.tokens_of(r.passage) <= most + 10 for r in rows.values())
    assert "style" not in json.loads(attribution.with_instructions(requests, cast).first().schema)["properties"]["speakers"]["items"]["properties"]
