from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storyline.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, ngrams):
    w = words_of(text)
    return [[" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] for n in range(1, ngrams + 1)]


def brute(rows, target, percent=10, ngrams=1, buckets=10000, least=20, seed="2024"):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    corpus, wanted = [0] * buckets, [0] * buckets
    for held, texts in ((corpus, [t for _, t in rows]), (wanted, target)):
        for text in texts:
            for some in runs(text, ngrams):
                for f in some:
                    held[bucket(f)] += 1
    big_s, big_t = sum(corpus), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (big_s + buckets) / ((s + 1) * (big_t + buckets)))) for s, t in zip(corpus, wanted, strict=True)]
    out = []
    for doc_id, text in rows:
        found = [gain[bucket(f)] for some in runs(text, ngrams) for f in some]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    left = list(out)
    for r in drawn:
        left.remove(r)
    return sorted([(*r[:4], k) for k, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in left], key=repr)


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgABCDéß漢0123", k=rng.randint(1, 9))) for _ in range(300)]
    return [rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary[: 60 if k % 3 else 300], k=rng.randint(0, 60))) for k in range(n)]


@pytest.mark.parametrize("ngrams", [1, 3])
def test_against_brute_force(spark, documents, ngrams):
    rows = list(enumerate(texts(400)))
    target = texts(30, 2)
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(spark, documents(rows, extra=True).repartition(5), frame, ngrams=ngrams, buckets=997)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, target, ngrams=ngrams, buckets=997)


def test_nulls_empty_repeated_and_long(spark, documents):
    long = " ".join(texts(200, 5))
    rows = [(1, None), (2, ""), (3, " ,.\x00 "), (None, "one two " * 10), (None, "one two " * 10), (4, "a b " * 10), (4, "a b " * 10), (5, "x" * 300000 + " " + "y " * 30), (6, long * 20), (7, "ABC abc é É 漢字 🙂 " * 7), (8, "nineteen " * 19), (9, "twenty " * 20)]
    target = [None, "", "twenty abc É"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(spark, documents(rows), frame, percent=60)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, target, percent=60)


@pytest.mark.parametrize("percent", [0, 10, 100])
def test_no_rows_no_target_and_all(spark, documents, percent):
    empty = spark.createDataFrame([], "text string")
    assert importance.resample(spark, documents([]), empty, percent=percent).collect() == []
    rows = list(enumerate(texts(50)))
    got = importance.resample(spark, documents(rows), empty, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, [], percent=percent)


def test_drawn_documents_keep_their_columns(spark, documents):
    rows = list(enumerate(texts(300)))
    target = texts(30, 2)
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    docs = documents(rows, extra=True)
    got = importance.resample(spark, docs, frame, percent=20, whole=True)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted((i, rows[i][1]) for i, *_, rank in brute(rows, target, percent=20) if rank)


def test_one_score_may_hold_all_rows(spark, documents):
    """Rows without doc_id and with one text tie; exactly as many as asked for are drawn."""
    rows = [(None, "same words here " * 8)] * 500
    frame = spark.createDataFrame([("same",)], "text string")
    ranks = [r["rank"] for r in importance.resample(spark, documents(rows), frame).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 51)) and len(ranks) == 500


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ09 ,é漢🙂\x00\x7f_", max_size=120), st.text(max_size=30)), max_size=8), st.integers(1, 4))
def test_automaton_against_zlib(some, ngrams):
    column = pa.array(["before", *some, "after"], pa.string())[1:-1]
    for (crc, counts), n in zip(importance.features(column, ngrams), range(1, ngrams + 1), strict=True):
        want = [runs(t, ngrams)[n - 1] for t in some]
        assert counts.tolist() == [len(w) for w in want]
        assert crc.tolist() == [zlib.crc32(f.encode()) for w in want for f in w]


def test_crc_table_and_long_words():
    words = ["a" * n for n in (1, 47, 48, 49, 50, 5000)]
    crc, counts = next(importance.features(pa.array([" ".join(words)])))
    assert counts.tolist() == [6] and crc.tolist() == [zlib.crc32(w.encode()) for w in words]
    assert np.array_equal(importance.CRC[[0, 1, 255]], np.array([0, 0x77073096, 0x2D02EF8D], np.uint32))
