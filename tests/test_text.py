from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from storyline.functions import folds, hashing
from storyline.functions import text as t

TEXT = None


@pytest.fixture(autouse=True)
def _column(spark):
    global TEXT
    TEXT = F.col("text")  # columns need a session


@pytest.mark.parametrize(
    ("text", "lang", "expected"),
    [
        ('"My dear Mr. Bennet," said his lady. Mr. Bennet replied. He was tired.', "en", ['"My dear Mr. Bennet," said his lady.', "Mr. Bennet replied.", "He was tired."]),
        ("你好。需要帮忙吗？不用。", "zh", ["你好。", "需要帮忙吗？", "不用。"]),
        ("Mr.", "en", ["Mr."]),
        ("Mr. Dr. Prof. Jones came. And e.g. This.", "en", ["Mr. Dr. Prof. Jones came.", "And e.g. This."]),
        ("Élan! élan? Étude. \"Yes.\" (No.) 3 more.", "en", ["Élan! élan? Étude.", '"Yes."', "(No.)", "3 more."]),
        ("", "en", []),
        ("  \n ", "en", []),
    ],
)
def test_sentences(value, text, lang, expected):
    assert value(t.sentences(TEXT, lang), text=text) == expected


def test_chunks_fit_and_lose_nothing(value):
    text = " ".join(f"This is sentence {i}." for i in range(20))
    chunks = value(t.chunks(TEXT, "en", 60), text=text)
    assert all(len(c) <= 60 for c in chunks) and " ".join(chunks) == text


def test_long_sentences_are_cut(value):
    assert value(t.chunks(TEXT, "en", 10), text="one two three, four five sixteen seventeenths") == ["one two", "three,", "four five", "sixteen", "seventeenths"]
    assert value(t.chunks(TEXT, "zh", 4), text="一二三，四五六七八九十") == ["一二三，", "四五六七", "八九十"]
    assert value(t.chunks(TEXT, "en", 10), text="") == []


@pytest.mark.parametrize(
    ("text", "lang", "expected"),
    [
        ("Mr. Darcy met Dr. Jones — briefly, etc.", "en", "Mr. Darcy met Dr. Jones, briefly, et cetera"),
        ("la~la~ la", "en", "la, la, la"),
        ("a , , b  c", "en", "a, b c"),
        ("2024年有3个人和15只猫", "zh", "二零二四年有三个人和十五只猫"),
        ("哒哒~~哒哒~~哒哒~~", "zh", "哒哒，哒哒，哒哒，"),
        ('"...."', "zh", '"，"'),
        ("好……——好", "zh", "好，好"),
        ("", "zh", ""),
    ],
)
def test_normalize(value, text, lang, expected):
    assert value(t.normalize(TEXT, lang), text=text) == expected


@pytest.mark.parametrize(("n", "words"), [("0", "零"), ("105", "一百零五"), ("20000", "二万"), ("12345", "一万二千三百四十五"), ("10", "十"), ("10001", "一万一"), ("1050", "一千零五十"), ("100000", "十万"), ("0007", "七"), ("100000000", "100000000"), ("99999999", "九千九百九十九万九千九百九十九")])
def test_zh_number(value, n, words):
    assert value(t.zh_number(F.col("n")), n=n) == words


def test_overrides_follow_each_other(value):
    assert value(t.normalize(TEXT, "en", {"a": "b", "b": "c"}), text="a-b") == "c-c"


@pytest.mark.parametrize(("text", "tokens"), [("", 0), ("一二三四五六七", 7), ("abcdef", 2), ("说：你好", 4), ("Mr. Bennet 说：你好", 8)])
def test_approx_tokens(value, text, tokens):
    assert value(t.approx_tokens(TEXT), text=text) == tokens


def test_sizes(value):
    assert value(t.audio_tokens(TEXT, "en"), text="x" * 15) == 13
    assert value(t.sequence_cost(TEXT, "zh"), text="四个汉字") == 313
    assert value(t.token_cap(F.col("n"), "zh"), n=134) == int(134 / 4 * 12 * 2) + 48
    assert value(t.token_cap(F.col("n"), "zh"), n=100000) == 2048


def test_names(value):
    assert value(t.role_slug(TEXT), text="Mr. Bennet") == "Mr_Bennet"
    assert value(t.role_slug(TEXT), text="...") == "role"
    assert value(t.title_slug(TEXT), text="Pride & Prejudice!") == "Pride__Prejudice"
    assert value(t.title_slug(TEXT), text="!") == "book"
    assert value(t.file_name(TEXT), text=' a/b:c*"d" ') == "a_b_c__d_"
    assert value(t.file_name(TEXT), text="  ") == "untitled"
    assert value(t.fold_name(TEXT), text="Mrs. Bénnet-9") == "mrsbénnet9"
    assert [value(t.human_age(F.col("s")), s=s) for s in (5.0, 61.0, 7200.0, 200000.0)] == ["5s ago", "1m ago", "2h ago", "2d ago"]


def test_quotes(value):
    assert value(t.canonical_quotes(TEXT), text="“a” 「b」 ‘c’") == "\"a\" \"b\" 'c'"
    assert value(t.canonical_punctuation(TEXT), text="a　b．") == "a b."


def test_content_hash_is_that_of_its_bytes(value):
    parts = ["render", "b", "v", json.dumps({"seed": 2, "speed": 1.5, "a": "é"}, sort_keys=True, ensure_ascii=False), "text "]
    expected = hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts)).hexdigest()[:24]
    key = lambda text, seed: value(hashing.render_key("b", F.lit("v"), {"speed": 1.5, "a": "é"}, F.lit(seed), TEXT), text=text)
    assert key("text ", 2) == expected
    assert len({key("text ", 2), key("text", 2), key("text ", 3)}) == 3


def test_json(value):
    assert value(hashing.json_array(F.col("a")), a=['x"y', "\\é\n"]) == json.dumps(['x"y', "\\é\n"], ensure_ascii=False)
    assert value(hashing.json_map(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a": "2", "b": "1"}'


@pytest.mark.parametrize(("costs", "budget", "most", "groups"), [([10, 10, 100, 10], 25, None, [0, 0, 1, 2]), ([1, 1, 1, 1], 100, 3, [0, 0, 0, 1]), ([], 5, None, []), ([9], 5, None, [0])])
def test_pack_groups(value, costs, budget, most, groups):
    column = F.array(*map(F.lit, costs)) if costs else F.array().cast("array<int>")
    assert value(folds.pack_groups(column, budget, 1, most)) == groups


def test_windows(value):
    ones = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda _: F.lit(5))
    assert value(folds.context_windows(ones, 100000)) == [0] * 12 + [1] * 12 + [2] * 12 + [3] * 4
    small = value(folds.context_windows(ones, 40))
    assert small == sorted(small) and max(small.count(k) for k in set(small)) < 12
