"""Sequential groupings of an ordered array, as folds over it: each returns the group number of every element.

The arrays belong to one chapter, or hold a number for each chapter of a book, so their length doesn't grow with the corpus. A fold notes where
groups start and nothing else, as every note copies the ones before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def pack_groups(costs: Column, budget: int, between: int = 0, most: int | None = None) -> Column:
    """Consecutive groups whose costs, with `between` from one element to the next, stay within budget; at most `most` elements each.
    An element over budget is a group of its own."""

    def add(s: Column, cost: Column) -> Column:
        full = (s["n"] == 0) | (s["used"] + between + cost > budget) | ((s["n"] >= most) if most else F.lit(False))
        return noted(s, full, F.when(full, cost).otherwise(s["used"] + between + cost))

    return F.aggregate(costs, nothing_noted(), add, numbers)


def nothing_noted() -> Column:
    return F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(0).alias("seen"))


def noted(s: Column, full: Column, used: Column) -> Column:
    """The state after an element; a group starts with it if the one before is full."""
    return F.struct(F.when(full, F.array_append(s["starts"], s["seen"])).otherwise(s["starts"]).alias("starts"), used.cast("long").alias("used"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), (s["seen"] + 1).alias("seen"))


def numbers(s: Column) -> Column:
    """The group of every element, from where groups start."""
    return F.flatten(F.transform(s["starts"], lambda at, g: F.array_repeat(g, F.coalesce(F.get(s["starts"], g + 1), s["seen"]) - at)))


def greedy_runs(histogram: Column, size: int, tokens: int) -> Column:
    """How groups are cut from elements sorted by cost, of which only `histogram` is known: an array of struct(chars, cost, n), in order.

    An array of struct(chars, before, group, room, per): elements of that length come after `before` others; the first `room` of them join
    group `group`, and each `per` more make a group of their own. As elements of one length cost the same, that is what adding them one by
    one would do, so the work is in the number of different lengths and not of elements.
    """
    fields = "array<struct<chars:int,before:bigint,group:bigint,room:bigint,per:bigint>>"
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(F.array().cast(fields).alias("out"), long(0).alias("before"), long(-1).alias("group"), long(0).alias("used"), long(0).alias("n"))

    def add(s: Column, e: Column) -> Column:
        per = F.greatest(long(1), F.least(long(size), F.floor(long(tokens) / e["cost"])))
        fits = F.greatest(long(0), F.least(long(size) - s["n"], F.floor((long(tokens) - s["used"]) / e["cost"])))
        room = F.when(s["n"] == 0, long(0)).otherwise(F.least(fits, e["n"]))
        rest = e["n"] - room
        new = F.ceil(rest / per)
        last = F.when(rest > 0, rest - (new - 1) * per)
        one = F.struct(e["chars"].alias("chars"), s["before"].alias("before"), s["group"].alias("group"), room.alias("room"), per.alias("per"))
        return F.struct(F.array_append(s["out"], one).alias("out"), (s["before"] + e["n"]).alias("before"), (s["group"] + new).alias("group"), F.coalesce(last * e["cost"], s["used"] + room * e["cost"]).alias("used"), F.coalesce(last, s["n"] + room).alias("n"))

    return F.aggregate(histogram, start, add, lambda s: s["out"])


def context_windows(costs: Column, budget: int, most: int = fixed.WINDOW_PARAGRAPHS, context: int = fixed.CONTEXT_PARAGRAPHS) -> Column:
    """Consecutive windows of paragraphs: at most `most`, and within budget together with up to `context` paragraphs before them. The first
    paragraph of a window is always in."""
    numbered = F.transform(costs, lambda c, i: F.struct(c.alias("c"), i.alias("i")))

    def add(s: Column, x: Column) -> Column:
        full = (s["n"] == 0) | (s["n"] >= most) | (s["used"] + x["c"] > budget)
        before = F.slice(costs, F.greatest(x["i"] - context, F.lit(0)) + 1, F.least(x["i"], F.lit(context)))
        shown = F.aggregate(before, F.lit(0).cast("long"), lambda t, c: t + c)
        return noted(s, full, F.when(full, shown).otherwise(s["used"]) + x["c"])

    return F.aggregate(numbered, nothing_noted(), add, numbers)


def sample_passage(pieces: Column, joiner: str, most: int, least_piece: int = fixed.SAMPLE_PIECE) -> Column:
    """Pieces in order that fit in a passage of `most` characters; what doesn't fit is left out and later ones may still fit."""

    def add(passage: Column, piece: Column) -> Column:
        fits = F.length(piece).between(least_piece, most) & ((passage == "") | (F.length(passage) + len(joiner) + F.length(piece) <= most))
        return F.when(~fits, passage).when(passage == "", piece).otherwise(F.concat(passage, F.lit(joiner), piece))

    return F.aggregate(pieces, F.lit(""), add)
