"""How often the names of many books' casts occur in the books' texts, all names of a book in one pass over each text.

The names of a book become an automaton in every task that reads a part of the book, and a text walks through it once, however many names
there are. A large book is spread over parts and a large cast over shards, by sizes counted before, so that a task's share of either is
bounded; equal texts of a book are read once and counted as often as they come.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTED = "book string, form string, n long"


def overlaps_itself(form: str) -> bool:
    """Whether two occurrences can overlap: an end of the form is also its beginning."""
    return any(form.startswith(form[k:]) for k in range(1, len(form)))


class Names:
    """An automaton over distinct, non-empty names that counts as `str.count` does: each name from the left and without overlaps of its
    own, whatever other names occur in it or across it."""

    def __init__(self, forms: Sequence[str]) -> None:
        self.forms = forms
        self.twice = {k: len(f) for k, f in enumerate(forms) if overlaps_itself(f)}
        self.automaton = ahocorasick.Automaton()
        for k, form in enumerate(forms):
            self.automaton.add_word(form, k)
        self.automaton.make_automaton()

    def count(self, text: str) -> Counter[int]:
        found = Counter(map(itemgetter(1), self.automaton.iter(text)))
        if any(found[k] > 1 for k in self.twice.keys() & found.keys()):
            apart, free = Counter(), {}
            for end, k in self.automaton.iter(text):
                if k in self.twice and end - self.twice[k] >= free.get(k, -1):
                    apart[k] += 1
                    free[k] = end
            found.update({k: n - found[k] for k, n in apart.items()})
        return found


def same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    """Equal in the columns; null is equal to null."""
    both = [a[c].eqNullSafe(b[c]) for c in columns]
    out = both[0]
    for c in both[1:]:
        out = out & c
    return out


def form_counts(texts: DataFrame, forms: DataFrame, part_bytes: int = 64 << 20, shard_forms: int = 1 << 17) -> DataFrame:
    """(book, form, n) for distinct (book, form) over texts (book, text); a form that doesn't occur has no row.

    A task holds the automaton of at most about `shard_forms` forms and reads some `part_bytes` of a book's texts, or one text. A cast beyond
    one shard has its book's texts read once for each shard.
    """
    read = texts.where("text <> ''").select("book", "text")
    sizes = read.groupBy("book").agg(F.sum(F.octet_length("text")).alias("bytes"))
    casts = forms.groupBy("book").agg(F.count(F.lit(1)).alias("forms"))
    up = lambda n, by: F.ceil(F.col(n) / by).cast("int")
    plan = sizes.join(casts, same(sizes, casts, "book")).select(sizes["book"], up("bytes", part_bytes).alias("parts"), up("forms", shard_forms).alias("shards"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    once = read.groupBy("book", "text").agg(F.count(F.lit(1)).alias("copies"))
    known = forms.join(plan, same(forms, plan, "book")).select(forms["book"], every("parts").alias("part"), one_of("form", "shards").alias("shard"), F.lit(0).alias("kind"), F.col("form").alias("value"), F.lit(0).cast("long").alias("copies"))
    shown = once.join(plan, same(once, plan, "book")).select(once["book"], one_of("text", "parts").alias("part"), every("shards").alias("shard"), F.lit(1).alias("kind"), F.col("text").alias("value"), "copies")
    rows = known.unionByName(shown).repartition("book", "part", "shard").sortWithinPartitions("book", "part", "shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)

        for (book, _, _), group in groupby(each(), key=itemgetter(0, 1, 2)):
            listed, names, total = [], None, Counter()
            for _, _, _, kind, value, copies in group:
                if kind == 0:
                    listed.append(value)
                elif listed:
                    names = names or Names(listed)
                    for k, n in names.count(value).items():
                        total[k] += n * copies
            if total:
                at = list(total)
                yield pa.RecordBatch.from_arrays([pa.array([book] * len(at), pa.string()), pa.array([listed[k] for k in at], pa.string()), pa.array([total[k] for k in at], pa.int64())], ["book", "form", "n"])

    return rows.mapInArrow(run, COUNTED).groupBy("book", "form").agg(F.sum("n").alias("n"))


def mentions(texts: DataFrame, casts: DataFrame, part_bytes: int = 64 << 20, shard_forms: int = 1 << 17) -> DataFrame:
    """(book, name, mentions) for casts (book, name, aliases) over texts (book, text), book a string: how often the name and its aliases
    occur, each distinct one by itself and without overlaps.

    Null and empty texts, names and aliases occur nowhere; rows of one book and name are one character with the aliases of all; null is a
    book, and a name, like others. A character whose book has no text has 0, and texts of a book without a cast aren't read by any automaton.
    """
    forms = F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))
    pairs = casts.select("book", "name", F.explode(F.filter(F.array_distinct(forms), lambda f: f != "")).alias("form")).distinct()
    counts = form_counts(texts, pairs.select("book", "form").distinct(), part_bytes, shard_forms)
    found = pairs.join(counts, same(pairs, counts, "book", "form")).groupBy(pairs["book"], "name").agg(F.sum("n").alias("mentions"))
    people = casts.select("book", "name").distinct()
    return people.join(found, same(people, found, "book", "name"), "left").select(people["book"], people["name"], F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"))
