from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from storyline.llm import mixing


def fill(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in sizes if s not in held)
        left = total - sum(most * sizes[s] for s in held)
        share = Fraction(left, free) if free else Fraction(0)
        more = {s for s in sizes if s not in held and weight[s] * share > most * sizes[s]}
        if not more:
            return {s: Fraction(most * sizes[s]) if s in held else weight[s] * share for s in sizes}
        held |= more


def test_targets_and_taken(spark, documents, words, rng):
    rows = [(k, " ".join(words(rng.randint(0, 60))), rng.choice(["a", "b", "b", "b", "b", "B", "é", "z", None])) for k in range(1500)]
    rows += [(None, "one two", "a"), (9, None, "a"), (7, "dup dup", "b"), (7, "dup dup", "b"), (8, "", "empty")]
    got = mixing.mix_report(spark, documents(rows)).withColumn("k", F.monotonically_increasing_id()).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fill(dict(sizes))
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(float(want[s]), 6)) for s in sizes})
    assert abs(sum(map(float, want.values())) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert all(r.taken % r["size"] == 0 and r.taken <= 3 * r["size"] if r["size"] else r.taken == 0 for r in got)
    taken, target = defaultdict(int), {}
    for r in got:
        key = (r.source_size, round(r.target, 6))
        taken[key] += r.taken
        target[key] = r.target
    assert all(abs(taken[k] - target[k]) <= 0.05 * target[k] + 60 for k in taken)
    again = mixing.mix_report(spark, documents(rows[::-1]).repartition(7))
    assert Counter((r.doc_id, r["size"], r.taken) for r in again.collect()) == Counter((r.doc_id, r["size"], r.taken) for r in got)


def test_documents_go_out_as_often_as_reported(spark, documents, words):
    rows = [(k, " ".join(words(20)), "abc"[k % 3] if k % 7 else None) for k in range(300)]
    docs = documents(rows, extra=True)
    report = {r.doc_id: r.taken // r["size"] for r in mixing.mix_report(spark, docs).collect()}
    out = mixing.mix_documents(spark, docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: n for k, n in report.items() if n})


def test_rows_without_id_draw_by_their_texts(spark, documents, words):
    """A source of such rows gets near its target, not all or nothing."""
    rows = [(None, " ".join(words(20)), "ab"[k % 2]) for k in range(600)]
    got = mixing.mix_report(spark, documents(rows)).groupBy("target").agg(F.sum("taken").alias("taken"), F.countDistinct("taken").alias("kinds")).collect()
    assert len(got) == 2 and all(r.kinds == 2 and abs(r.taken - r.target) < 0.02 * r.target for r in got)


def test_no_words_and_no_rows(spark, documents):
    assert [(r.taken, r.target) for r in mixing.mix_report(spark, documents([(1, None), (2, " \n")])).collect()] == [(0, 0.0)] * 2
    assert mixing.mix_report(spark, documents([(1, "x")]).limit(0)).count() == 0
    assert mixing.mix_documents(spark, documents([(1, "x")]).limit(0)).count() == 0


def test_one_source_is_taken_once(spark, documents):
    assert [r.taken for r in mixing.mix_report(spark, documents([(1, "a b"), (2, "c d e")])).orderBy("doc_id").collect()] == [2, 2]
