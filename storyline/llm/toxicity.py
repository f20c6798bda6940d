"""Toxicity by subword bags: embeddings of character n-grams, averaged, into a linear softmax, all trained jointly in numpy.

A word's n-grams (3 to 6 bytes of its lower-case UTF-8, with a space as mark at either end) hash into buckets, each with an embedding, so a
misspelling or an inflected form that training never saw shares most of its vectors with forms that it did see. A window of words is the
average of its n-grams' embeddings; a text's score is that of its most toxic window, so a few words in a very long text count as much as in
a short one. Every text is read whole.

Training takes labelled rows whose crc32(doc_id) mod 5 isn't 0, at most `sample` of them and about `sample_bytes` of text, the first by a
hash of doc_id: the one bounded thing here, as a classifier needs no more. Each epoch finds every text's highest window under the model so
far and learns from these (and from a random window of each clean text).

Defined cases: null and empty texts, and texts without words, score the toxic share of the training rows. Without labels that name both
classes, every text scores that share (0 if there are none). Of several labels for a doc_id the highest counts; null labels don't count.
A null doc_id is held out and stays null. Repeated rows are scored alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean

BUCKET_BITS, DIM, ORDERS = 18, 8, (3, 4, 5, 6)
WINDOW, STRIDE = 4, 2
#: Bytes of text that one step of scoring holds as arrays.
STEP_BYTES = 512 << 10
_TO_SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))


@dataclass
class Model:
    #: An average of embeddings times the softmax's weights is the average of these products, one for each bucket.
    scores: np.ndarray | None
    bias: float
    prior: float


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts as one byte array with a space before, between and after; where each text starts, and the end."""
    parts = [t.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE) for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    return np.frombuffer(b" " + b" ".join(parts) + b" " + b"\0" * 8, np.uint8), at


def grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of the n-gram that starts at each byte, and whether it is within a word and its marks."""
    space, n = data == 32, len(data) - 8
    h = np.full(n, 2166136261, np.uint32)
    for k in range(2):
        h = (h ^ data[k : n + k]) * np.uint32(16777619)
    broken = np.zeros(n, bool)
    for order in range(3, max(ORDERS) + 1):
        h = (h ^ data[order - 1 : n + order - 1]) * np.uint32(16777619)
        broken |= space[order - 2 : n + order - 2]
        if order in ORDERS:
            valid = ~broken
            valid[max(0, n - order + 1) :] = False
            yield (h ^ (h >> np.uint32(15))) & np.uint32((1 << BUCKET_BITS) - 1), valid


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """First bytes of the words (the space before each), and for each window its text, first word and word past the last."""
    space = data[:-8] == 32
    words = np.flatnonzero(space[:-1] & ~space[1:])
    bounds = np.searchsorted(words, at)
    n = np.diff(bounds)
    per = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = bounds[:-1][text] + STRIDE * k
    return words, text, first, np.minimum(first + WINDOW, bounds[1:][text])


def window_logits(data: np.ndarray, words: np.ndarray, first: np.ndarray, last: np.ndarray, scores: np.ndarray) -> np.ndarray:
    total, count = np.zeros(len(data) - 8, np.float32), np.zeros(len(data) - 8, np.float32)
    for bucket, valid in grams(data):
        total += scores[bucket] * valid
        count += valid
    sums = [np.concatenate([[0.0], np.cumsum(np.add.reduceat(x, words, dtype=np.float64))]) if len(words) else np.zeros(1) for x in (total, count)]
    s, c = (x[last] - x[first] for x in sums)
    return s / np.maximum(c, 1)


def steps(texts: list[str], limit: int = STEP_BYTES) -> Iterator[tuple[int, list[str]]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, texts[start:]


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    out = np.full(len(texts), model.prior)
    if model.scores is None:
        return out
    for start, some in steps(texts):
        data, at = lay_out(some)
        words, text, first, last = windows_of(data, at)
        if len(text):
            logits = window_logits(data, words, first, last, model.scores) + model.bias
            heads = np.flatnonzero(np.diff(text, prepend=-1))
            out[start + text[heads]] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(logits, heads), -40, 40)))
    return out.round(9)


def train(texts: list[str], labels: list[int], epochs: int = 10, rate: float = 0.6, seed: int = 7) -> Model:
    y = np.asarray(labels, np.int64)
    prior = float(y.mean()) if len(y) else 0.0
    if not 0 < prior < 1:
        return Model(None, 0.0, prior)
    rng, size = np.random.default_rng(seed), 1 << BUCKET_BITS
    seen = np.ones((2, size))
    for start, some in steps(texts):  # which n-grams are commoner in toxic texts: only to choose the first epochs' windows
        data, at = lay_out(some)
        toxic = np.repeat(y[start : start + len(some)], np.diff(at))
        toxic = np.resize(toxic, len(data) - 8)
        for bucket, valid in grams(data):
            for label in (0, 1):
                seen[label] += np.bincount(bucket[valid & (toxic == label)], minlength=size)
    share = seen / seen.sum(1, keepdims=True)
    choose = np.log(share[1] / share[0]).astype(np.float32)
    vectors = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    past, past_out, past_bias = np.full((size, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    weight = np.where(y == 1, min(10.0, ((1 - prior) / prior) ** 0.5), 1.0)
    for epoch in range(epochs):
        bags: list[np.ndarray] = []
        owner: list[int] = []
        for start, some in steps(texts):
            data, at = lay_out(some)
            words, text, first, last = windows_of(data, at)
            if not len(text):
                continue
            logits = window_logits(data, words, first, last, choose)
            order = np.lexsort((logits, text))
            heads = np.flatnonzero(np.diff(text, prepend=-1))
            tails = np.append(heads[1:], len(text)) - 1
            clean = y[start + text[heads]] == 0
            picked = np.concatenate([order[tails], (heads + rng.integers(0, tails - heads + 1))[clean]])
            made = [(b, v) for b, v in grams(data)]
            ends = np.append(words, len(data) - 8)
            for w in picked:
                a, z = ends[first[w]], ends[last[w]]
                bags.append(np.concatenate([b[a:z][v[a:z]] for b, v in made]))
                owner.append(start + text[w])
        shuffled = rng.permutation(len(bags))
        for k in range(0, len(shuffled), 256):
            some = [i for i in shuffled[k : k + 256] if len(bags[i])]
            if not some:
                continue
            n = np.array([len(bags[i]) for i in some])
            whose = np.array([owner[i] for i in some])
            distinct, inverse = np.unique(np.concatenate([bags[i] for i in some]), return_inverse=True)
            row = np.repeat(np.arange(len(some)), n)
            held = vectors[distinct]
            mean = np.add.reduceat(held[inverse], np.cumsum(n) - n) / n[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[whose]] -= 1
            g = p * weight[whose][:, None] / len(some)
            back = (g @ out.T) / n[:, None]
            for value, memory, step in ((out, past_out, mean.T @ g), (bias, past_bias, g.sum(0))):
                memory += step**2
                value -= rate * step / np.sqrt(memory)
            step = np.stack([np.bincount(inverse, back[row, d], len(distinct)) for d in range(DIM)], 1)
            past[distinct] += step**2
            vectors[distinct] = held - rate * step / np.sqrt(past[distinct])
        if epoch:
            choose = vectors @ (out[:, 1] - out[:, 0])
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, sample: int = 8192, sample_bytes: int = 32 << 20) -> Model:
    """Trains on at most `sample` labelled rows that aren't held out. Labels are few and narrow; only the chosen rows' texts are fetched,
    with a broadcast of at most `sample` identifiers."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    chosen = known.orderBy(order, "doc_id").limit(sample)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), "doc_id")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size > sample_bytes:
        chosen = known.orderBy(order, "doc_id").limit(max(1, sample * sample_bytes // size))
        rows = texts.join(F.broadcast(chosen), "doc_id")
    found = sorted((r["doc_id"], r["text"], int(r["toxic"] > 0)) for r in rows.collect())
    return train([t for _, t, _ in found], [y for _, _, y in found])


def scorer(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """The score of a column of texts. Only the texts go to Python, and a few at a time become Python strings."""
    sc = spark.sparkContext.broadcast(model)

    @lean
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = [score_texts([t or "" for t in batch.slice(k, 256).to_pylist()], sc.value) for k in range(0, len(batch), 256)]
            yield pa.array(np.concatenate(values) if values else np.empty(0), pa.float64())

    return F.arrow_udf(score, T.DoubleType())(F.col(text))


def score_documents(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "text")
    model = fit(rows, labels)
    ids = rows.select("doc_id", scorer(spark, model).alias("score"))
    return ids.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """documents without those that the classifier rejects, with the same columns."""
    (score,) = fresh(documents, "toxic_score")
    model = fit(documents.select("doc_id", "text"), labels)
    return documents.withColumn(score, scorer(spark, model)).where(F.col(score) < threshold).select(documents.columns)
