"""Whitening of embeddings: mean and covariance by Chan's merging, eigenvectors on the driver, and a second pass that verifies the result.

Vectors become integers, floor(256 * x). The fit list holds each distinct integer vector once. Each task of a pass over it goes by Arrow
batches: count, mean, and the scatter centred at that mean, merged pairwise into what the task has by Chan's formula; treeReduce merges the
tasks' states by the same formula, so the driver gets one state of dims x dims numbers whatever the rows. The driver takes eigenvalues and
eigenvectors of that matrix, the only thing whose size is that of the dimension. A second pass over the fit list projects every vector and
merges the covariance of the projections in the same way; how far that is from the identity comes with every row.

Distinct vectors cost little shuffle: hashes that occur more than once are found first (16 bytes a row, combined before the shuffle, so that
a hot vector is one row a task); a bounded bitmap of these marks, as integer vectors are written, the rows that are compared by their whole
vectors. All others are distinct as they are.

Sums and deviations are exact, in Python's integers where 64 bits don't hold them. A deviation beyond 64 bits is null in `deviation` and
whole, as text, in `exact_deviation`.

Defined cases: rows whose vector is null or holds a null or non-finite entry take no part (entries beyond 64 bits once scaled are held at the
ends of the 64-bit range). A shorter vector counts as filled up with zeros, before vectors are compared. Null and repeated vec_ids are
kept, each row on its own. A component whose eigenvalue is 0 within double precision (there are such where vectors are fewer than
dimensions or all alike) can't be whitened: its rows have whitened null and explained 0, and the identity is verified over the others. There
are no more components than dimensions. An empty table, or one with vectors of no dimension alone, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sieve, Workspace

SCALE, COMPONENTS = 256, 4
#: Rows of a batch whose products are taken together.
ROWS = 4096
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, exact_deviation string"


def integers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each entry, as an array of long; null unless all entries are there and finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def filled(vector: Column, dims: int) -> Column:
    return F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(vector)))


def matrix(column: pa.ListArray, dims: int) -> Iterator[np.ndarray]:
    """The vectors of an Arrow column, some rows at a time."""
    for k in range(0, len(column), ROWS):
        yield np.asarray(column.slice(k, ROWS).flatten(), np.int64).reshape(-1, dims)


@dataclass
class Moments:
    """Count, mean and centred scatter of vectors, and the exact sums of their integers."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @classmethod
    def none(cls, dims: int) -> Moments:
        return cls(0, np.zeros(dims), np.zeros((dims, dims)), [0] * dims)

    @classmethod
    def of(cls, x: np.ndarray, whole: bool = True) -> Moments:
        mean = x.mean(0)
        centred = x - mean
        return cls(len(x), mean, centred.T @ centred, exact_sums(x) if whole else [0] * x.shape[1])

    def merge(self, other: Moments) -> Moments:
        """Chan's formula for two parts."""
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        apart = other.mean - self.mean
        mean = self.mean + apart * (other.n / n)
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * (other.n / n))
        return Moments(n, mean, scatter, [a + b for a, b in zip(self.sums, other.sums, strict=True)])

    def covariance(self) -> np.ndarray:
        both = self.scatter / max(self.n, 1)
        return (both + both.T) / 2


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums by column; halves of 32 bits can't overflow in a batch."""
    high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
    return [(int(h) << 32) + int(v) for h, v in zip(high, low, strict=True)]


def moments(fit: DataFrame, dims: int, project: Callable[[np.ndarray], np.ndarray] | None = None, size: int | None = None) -> Moments:
    """Moments of all vectors of fit (a column `x`), or of their projections, to `size` dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Moments.none(size or dims)
        for batch in batches:
            for x in matrix(batch.column(0), dims):
                held = held.merge(Moments.of(project(x), False) if project else Moments.of(x))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["state"])

    def merged(a: bytes, b: bytes) -> bytes:
        return pickle.dumps(pickle.loads(a).merge(pickle.loads(b)))

    states = fit.select("x").mapInArrow(run, "state binary").rdd.map(lambda row: bytes(row[0]))
    parts = states.getNumPartitions()
    if not parts:
        return Moments.none(size or dims)
    return pickle.loads(states.treeReduce(merged, depth=2 if parts < 64 else 3))


@dataclass
class Whitener:
    """What whitens integer vectors: their number and exact sums, and scaled eigenvectors in columns (zeros for what can't be whitened)."""

    n: int
    sums: list[int]
    centre: np.ndarray
    axes: np.ndarray
    explained: list[float]
    usable: list[bool]
    identity_error: float = 0.0

    @classmethod
    def fit(cls, found: Moments, components: int = COMPONENTS) -> Whitener:
        values, vectors = np.linalg.eigh(found.covariance())
        top = np.argsort(-values, kind="stable")[:components]
        total = float(np.trace(found.covariance()))
        least = max(len(values), 1) * np.finfo(float).eps * float(max(values.max(initial=0.0), 0.0)) * 8
        usable = [bool(v > least) for v in values[top]]
        axes = np.stack([vectors[:, k] / np.sqrt(values[k]) if good else np.zeros(len(values)) for k, good in zip(top, usable, strict=True)], 1)
        for k in range(axes.shape[1]):  # the largest entry of an eigenvector is positive
            if axes[np.argmax(np.abs(axes[:, k])), k] < 0:
                axes[:, k] = -axes[:, k]
        explained = [float(v / total) if good else 0.0 for v, good in zip(values[top], usable, strict=True)]
        return cls(found.n, found.sums, np.array([s / found.n for s in found.sums]), axes, explained, usable)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.axes

    def verify(self, found: Moments) -> None:
        """The largest entry by which the covariance of the projections, of which found are the moments, misses the identity."""
        some = np.flatnonzero(self.usable)
        off = np.abs(found.covariance()[np.ix_(some, some)] - np.eye(len(some)))
        self.identity_error = float(off.max(initial=0.0))

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n * x - S)^2, as n^2 x^2 - 2 n x S + S^2 of exact sums."""
        if len(x) and max(abs(int(x.min())), abs(int(x.max()))) >= 1 << 24:
            return [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        parts, rest = [], list(self.sums)
        while any(rest):  # sums by 24 bits, so that products of any number of dimensions fit
            sign = [-1 if r < 0 else 1 for r in rest]
            parts.append(np.array([z * (abs(r) & 0xFFFFFF) for r, z in zip(rest, sign, strict=True)], np.int64))
            rest = [z * (abs(r) >> 24) for r, z in zip(rest, sign, strict=True)]
        squares = (x * x).sum(1).astype(object)
        across = sum(((x @ p).astype(object) << (24 * k) for k, p in enumerate(parts)), np.zeros(len(x), object))
        return list(squares * (self.n * self.n) - across * (2 * self.n) + sum(s * s for s in self.sums))


def whiten(spark: SparkSession, embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row for each remaining row of embeddings (vec_id, embedding) and component."""
    ws = Workspace(spark, "whitening")
    rows = embeddings.select(F.col("vec_id").cast("long"), integers(F.col("embedding"), scale).alias("x")).where(F.col("x").isNotNull())
    dims = rows.agg(F.max(F.size("x")).alias("n")).first()["n"]
    if not dims:
        return spark.createDataFrame([], RESULT)
    rows = rows.withColumn("x", filled(F.col("x"), dims))
    key = F.xxhash64("x")
    repeated = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    sieve = Sieve.of(ws.put(repeated, "repeated"))
    rows = ws.put(rows.withColumn("again", sieve.passes(key)), "vectors")
    once = ws.put(rows.where("again").select("x").distinct(), "once")
    fit = once.unionByName(rows.where(~F.col("again")).select("x"))
    whitener = Whitener.fit(moments(fit, dims), components)
    whitener.verify(moments(fit, dims, whitener.project, len(whitener.usable)))
    ws.drop("repeated", "once")
    sent = spark.sparkContext.broadcast(whitener)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        k, longs = len(w.usable), range(-(1 << 63), 1 << 63)
        for batch in batches:
            start = 0
            for x in matrix(batch.column(1), dims):
                ids = batch.column(0).slice(start, len(x))
                start += len(x)
                exact = w.deviations(x)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                values = w.project(x).reshape(-1)
                columns = [
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), w.n)),
                    pa.array([d if d in longs else None for d in exact], pa.int64()).take(each), pa.array(values, mask=np.tile(~np.array(w.usable, bool), len(x))),
                    pa.array(np.tile(w.explained, len(x))), pa.array(np.full(k * len(x), w.identity_error)), pa.array([str(d) for d in exact], pa.string()).take(each),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RESULT.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(run, RESULT)
