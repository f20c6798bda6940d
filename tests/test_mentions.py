"""Mentions of many books' casts, against `str.count`."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from storyline.operators import mentions

TEXTS, CASTS = "book string, text string, name int", "book string, name string, aliases array<string>, n string"


def plain(texts, casts):
    forms, total = defaultdict(set), {}
    for book, name, aliases, _ in casts:
        forms[book, name] |= {f for f in [name, *(aliases or [])] if f}
    for (book, name), some in forms.items():
        total[book, name] = sum((t or "").count(f) for b, t, _ in texts if b == book for f in some)
    return total


def counted(spark, texts, casts, **sizes):
    rows = mentions.mentions(spark.createDataFrame(texts, TEXTS).repartition(3), spark.createDataFrame(casts, CASTS), **sizes).collect()
    assert len({(r.book, r.name) for r in rows}) == len(rows)
    return {(r.book, r.name): r.mentions for r in rows}


def test_names_count_as_str_count():
    draw = random.Random(5)
    for _ in range(300):
        forms = list({"".join(draw.choices("ab你", k=draw.randint(1, 4))) for _ in range(draw.randint(1, 8))})
        text = "".join(draw.choices("ab你c", k=draw.randint(0, 60)))
        got = mentions.Names(forms).count(text)
        assert [got[k] for k in range(len(forms))] == [text.count(f) for f in forms]


@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 64, "shard_forms": 3}])
def test_mentions_of_many_books(spark, sizes):
    """Hot books over parts, casts over shards, copies, null books and names, forms that hold, overlap and repeat one another."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choices("ab了", k=draw.randint(1, 3)))
    books = ["hot"] * 4 + ["x", "", None]
    texts = [(draw.choice(books), " ".join(word() for _ in range(draw.randint(0, 30))), 1) for _ in range(120)] + [("hot", "aaaa ab", 2)] * 40
    texts += [("x", None, 1), (None, "", 1), ("no cast", "ab ab", 1), ("x", "aab " * 5000, 1)]
    casts = [(draw.choice(books), draw.choice([word(), word(), None]), draw.choice([None, [], [word(), word(), "", None], ["aa", "aa"]]), "n") for _ in range(60)]
    casts += [("no text", "ab", ["a"], "n"), ("x", "", [""], "n"), ("x", "never there", [], "n")]
    assert counted(spark, texts, casts, **sizes) == plain(texts, casts)


def test_empty_tables(spark):
    assert counted(spark, [], []) == counted(spark, [("a", "b", 1)], []) == {}
    assert counted(spark, [], [("a", "b", [], "n")]) == {("a", "b"): 0}
