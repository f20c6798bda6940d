from __future__ import annotations

import math
import zlib
from pathlib import Path

import pytest

from storyline.llm import toxicity
from storyline.llm.queries import QUERIES

SLURS = ["grulk", "vashnet", "blorf"]


@pytest.fixture
def corpus(spark, documents, words, rng):
    rows, labels = [], []
    for k in range(900):
        text = words(rng.randint(20, 200))
        bad = k % 4 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(SLURS) + rng.choice(["", "s", "ing", "y", "x", "!"])
        rows.append((k, " ".join(text)))
        if k < 700:
            labels.append((k, 1, int(bad)))
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_recognised(spark, documents, corpus):
    rows, labels = corpus
    got = toxicity.score_documents(spark, documents(rows), table(spark, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    unseen = [r for r in got if r.held_out or r.doc_id >= 700]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in unseen) / len(unseen) > 0.9


def test_misspellings_share_subwords(corpus):
    rows, labels = corpus
    texts = dict(rows)
    model = toxicity.train([texts[i] for i, _, _ in labels], [y for _, _, y in labels])
    filler = " ".join(rows[1][1].split()[:15])
    seen, unseen, clean = toxicity.score_texts([f"{filler} grulks {filler}", f"{filler} grulkst {filler}", f"{filler} {filler}"], model)
    assert seen > 0.5 and unseen > 0.5 > clean


def test_a_few_words_count_in_a_very_long_text(corpus, words):
    rows, labels = corpus
    texts = dict(rows)
    model = toxicity.train([texts[i] for i, _, _ in labels], [y for _, _, y in labels])
    long = words(60_000)
    long[45_000] = "vashnet"
    assert toxicity.score_texts([" ".join(long)], model)[0] > 0.5


def plain_score(text, model):
    """The scorer word by word and n-gram by n-gram: the highest mean over windows of words."""
    words = [b" " + w + b" " for w in text.lower().encode("utf-8", "surrogatepass").split()]
    best = None
    for start in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if words else []:
        values = []
        for w in words[start : start + toxicity.WINDOW]:
            for n in toxicity.ORDERS:
                for k in range(len(w) - n + 1):
                    h = 2166136261
                    for byte in w[k : k + n]:
                        h = (h ^ byte) * 16777619 % 2**32
                    values.append(float(model.scores[(h ^ (h >> 15)) % 2**toxicity.BUCKET_BITS]))
        logit = sum(values) / max(1, len(values)) + model.bias
        best = logit if best is None else max(best, logit)
    return model.prior if best is None else 1 / (1 + math.exp(-best))


def test_scores_against_a_plain_scorer(corpus, words):
    rows, labels = corpus
    texts = dict(rows)
    model = toxicity.train([texts[i] for i, _, _ in labels], [y for _, _, y in labels], epochs=3)
    some = [t for _, t in rows[:60]] + ["", " ", "a", "ab", "one two", "a b c d e", "é ü 漢字 🙂 vashnet", "x" * 400, " lead", "trail ", "Case CASE cAsE", "a\x0bb\x0cc", *(" ".join(words(n)) for n in range(1, 12))]
    assert toxicity.score_texts(some, model) == pytest.approx([plain_score(t, model) for t in some], abs=1e-5)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_query_against_a_plain_scorer(spark):
    """Which rows are learned from, held out and predicted, row by row of the smallest tables."""
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op2_toxicity"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.toxic is not None and r.doc_id is not None:
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), int(r.toxic > 0))
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    learned = sorted((i, t, labels[i]) for i, t in docs if t is not None and i in labels and not out(i))
    model = toxicity.train([t for _, t, _ in learned], [y for _, _, y in learned])
    want = {i: plain_score(t or "", model) for i, t in docs if len(t or "") < 4000}
    assert {r.doc_id for r in got} == {i for i, _ in docs} and all(r.held_out == out(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-5) for r in got if r.doc_id in want) and len(want) > 100


def test_labels_of_held_out_rows_are_never_learned(spark, documents, corpus):
    rows, labels = corpus
    fold = [(i, q, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, q, t in labels]
    first, second = ({r.doc_id: r.score for r in toxicity.score_documents(spark, documents(rows), table(spark, some)).collect()} for some in (labels, fold))
    assert first == second


def test_scores_dont_depend_on_other_columns_or_batches(spark, documents, corpus):
    rows, labels = corpus
    some = rows[:120]
    first = {r.doc_id: r.score for r in toxicity.score_documents(spark, documents(rows).where("doc_id < 400"), table(spark, labels)).collect()}
    docs = documents(rows, extra=True).where("doc_id < 400").selectExpr("doc_id", "text", "'zz' AS lang", "null AS source", "1L AS n_chars", "score").repartition(5)
    second = {r.doc_id: r.score for r in toxicity.score_documents(spark, docs, table(spark, labels)).collect()}
    assert all(first[i] == pytest.approx(second[i], abs=1e-6) for i, _ in some)


def test_odd_rows_and_labels(spark, documents, corpus):
    rows, labels = corpus
    more = [*rows, (None, "no id"), (5000, None), (5001, ""), (5002, " \n\t "), (5003, "x"), (5004, "é" * 300_000), (3, rows[3][1])]
    odd = [*labels, (None, 1, 1), (1, 1, None), (9999, 1, 1), (labels[0][0], 1, 0)]
    got = toxicity.score_documents(spark, documents(more), table(spark, odd)).collect()
    assert len(got) == len(more)
    empty = {r.score for r in got if r.doc_id in (5000, 5001, 5002)}
    assert len(empty) == 1 and empty.pop() < 0.5


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 1, 1)], [(1, 1, 0)]])
def test_without_both_classes(spark, documents, labels):
    got = toxicity.score_documents(spark, documents([(1, "a"), (2, "b"), (6, None)]), table(spark, labels)).collect()
    share = 1.0 if labels and labels[0][2] else 0.0
    assert [r.score for r in got] == [share] * 3


def test_filter(spark, documents, corpus):
    rows, labels = corpus
    docs = documents(rows, extra=True)
    out = toxicity.drop_toxic(spark, docs, table(spark, labels))
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    clean = [i for i, _ in rows if i % 4]
    assert len(kept & set(clean)) > 0.97 * len(clean) and len(kept - set(clean)) < 0.2 * 225
    assert toxicity.score_documents(spark, docs.limit(0), table(spark, labels)).count() == 0
