"""Exact top-k by inner product with MaxScore over shards of the vectors.

A term is a dimension; its weight in a query is the query's component. The index holds each shard of vectors dimension by dimension, with
the least and greatest component of each. For a query they bound what a term can add, above the least that it adds anyway. Terms are
ordered by that bound. The last ones, whose bounds together can't lift a vector from the base over the k-th best score so far, are
non-essential: only the postings of the essential terms are traversed for all vectors of the shard, and the others are probed only for
vectors that are still competitive, in small groups, with the competitive ones thinned after each. The essential terms of some queries at
a time are one matrix product. Shards read by one task share their thresholds, and all shards' best k are merged by a ranked window.

Rows are counted and dealt into as many shards as they fill, whatever the partitions they come in. Queries go in blocks of bounded size,
one broadcast each, against all shards; each block's result is written before the next starts.

Components become floor(1024 * x), of any size: a shard's products run in doubles where these are exact, else in 64-bit integers, else in
Python's. Vectors with components beyond 32 bits have shards of their own, so that they slow down no others. A score beyond 64 bits is
given as the nearest 64-bit number, and ranked by its exact value.

Defined cases: vectors that are null or hold a null or non-finite component take no part (nor does one with a double so large that 1024
times it isn't finite). A row with a null vec_id is a candidate, after all others on ties, but no query. A shorter vector counts as filled
up with zeros. A query's own row is every row with its vec_id. Repeated rows are each candidates; repeated query rows are one query, and
rows with one vec_id and different vectors are queries of their own. Ties go to the smaller vec_id. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, partitions_for

K, SCALE, SHARD_ROWS, QUERY_BLOCK, GROUP, PROBE = 10, 1024, 4096, 1 << 14, 64, 8
LONG_MAX = (1 << 63) - 1
#: Bounds on the sum of products up to which doubles and 64-bit integers are exact.
DOUBLES, LONGS = 1 << 52, 1 << 62
#: Bits that no exact score needs: two doubles below 2^1024 for each of at most 2^40 dimensions.
OFFSET = 1 << 2100
SHARD = "dims int, wide boolean, ids binary, named binary, vectors binary"
FOUND = "query int, query_id long, vec_id long, score long, beyond binary"


def scaled(rows: DataFrame) -> DataFrame:
    """vec_id and vector, as doubles without a fraction, of all rows that take part."""
    times = lambda x: x.cast("double") * SCALE
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(times(x)) < float("inf")))
    whole = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    return rows.where(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: whole(times(x))).alias("vector"))


def shards(vectors: DataFrame, count: int, rows: int) -> DataFrame:
    """vectors (vec_id, vector) as shards of about `rows`: identifiers, and the vectors dimension by dimension. count is an upper bound of the
    number of vectors; the rows are dealt out evenly, so that there are as many shards as they need and not as partitions came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, ...]]] = {}

        def made(key: tuple[int, bool], last: bool) -> Iterator[pa.RecordBatch]:
            n = sum(len(p[0]) for p in held[key])
            if n < 2 * rows and not last:  # a few more than `rows` don't make a shard of their own
                return
            ids, named, x = (np.concatenate([p[i] for p in held[key]]) for i in range(3))
            full = n if last else n // rows * rows - rows
            for a in range(0, full, rows if full > 2 * rows else 2 * rows):
                z = min(a + (rows if full > 2 * rows else 2 * rows), full)
                yield pa.RecordBatch.from_pydict({"dims": pa.array([key[0]], pa.int32()), "wide": [key[1]], "ids": [ids[a:z].tobytes()], "named": [named[a:z].tobytes()], "vectors": [np.ascontiguousarray(x[a:z].T).tobytes()]})
            held[key] = [(ids[full:], named[full:], x[full:])]

        for batch in batches:
            offsets = np.asarray(batch.column(1).offsets)
            ids, named, flat = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_valid()), np.asarray(batch.column(1).values)
            lengths = np.diff(offsets)
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                x = flat[offsets[at][:, None] + np.arange(dims)]
                large = (np.abs(x) >= 1 << 31).any(1) if dims else np.zeros(len(at), bool)
                for wide in (False, True):
                    some = large == wide
                    if some.any():
                        held.setdefault((dims, wide), []).append((ids[at[some]], named[at[some]], x[some].astype(np.float64 if wide else np.int32)))
                        yield from made((dims, wide), False)
        for key in list(held):
            yield from made(key, True)

    return vectors.repartition(partitions_for(count, rows)).mapInArrow(run, SHARD)


class Shard:
    """Vectors dimension by dimension, as the integers and doubles that products need."""

    def __init__(self, ids: np.ndarray, named: np.ndarray, x: np.ndarray):
        self.ids, self.named, self.x = ids, named, x
        self.largest = int(np.abs(x.astype(np.float64)).max(initial=1))
        self.forms: dict[type, np.ndarray] = {}

    @classmethod
    def of(cls, row: dict) -> Shard:
        ids = np.frombuffer(row["ids"], np.int64)
        return cls(ids, np.frombuffer(row["named"], bool), np.frombuffer(row["vectors"], np.float64 if row["wide"] else np.int32).reshape(row["dims"], len(ids)))

    def form(self, kind: type) -> np.ndarray:
        """The components as float64, int64 or Python integers; made once."""
        if kind not in self.forms:
            self.forms[kind] = exactly(self.x) if kind is object else self.x.astype(kind)
        return self.forms[kind]

    def bounds(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        x = self.form(kind) if kind is object else self.x
        return (x.min(1), x.max(1)) if kind is object else (x.min(1).astype(np.int64), x.max(1).astype(np.int64))


def exactly(x: np.ndarray) -> np.ndarray:
    """Numbers without a fraction as Python integers."""
    return np.frompyfunc(int, 1, 1)(x).astype(object)


class Best:
    """The k best (score, then smaller vec_id, null last) of one query so far."""

    __slots__ = ("ids", "k", "named", "scores")

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.named = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def threshold(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        s, i, v = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.named, named])
        if s.dtype == object:
            order = sorted(range(len(s)), key=lambda j: (-s[j], not v[j], i[j]))[: self.k]
        else:
            order = np.lexsort((i, ~v, -s))[: self.k]
        self.scores, self.ids, self.named = s[order], i[order], v[order]
        if s.dtype == object and all(-LONGS < x < LONGS for x in self.scores):
            self.scores = self.scores.astype(np.int64)


def max_score(query: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, least: np.ndarray, most: np.ndarray, best: Best) -> int:
    """Adds the competitive ones of the vectors x to best; returns the number of components that it read."""
    return search(np.asarray(query)[None], np.array([own]), Shard(ids, np.ones(len(ids), bool), x), [best], (least, most))


def search(queries: np.ndarray, owns: np.ndarray, shard: Shard, best: list[Best], bounds: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Adds the shard's competitive vectors to each query's best; returns the number of components that were read."""
    n, rows = min(queries.shape[1], len(shard.x)), len(shard.ids)
    total = int(np.abs(queries[:, :n].astype(np.float64)).max(initial=1)) * shard.largest * max(n, 1)
    kind = np.float64 if total < DOUBLES else np.int64 if total < LONGS else object
    whole = object if kind is object else np.int64
    x = shard.form(kind)[:n]
    least, most = (b[:n] for b in (bounds if bounds is not None and kind is not object else shard.bounds(kind)))
    q = exactly(queries[:, :n]) if kind is object else queries[:, :n].astype(np.int64)
    a, b = q * least, q * most
    low, gain = np.minimum(a, b), np.abs(b - a)
    order = np.argsort(-gain, axis=1, kind="stable")
    sorted_low, sorted_gain = np.take_along_axis(low, order, 1), np.take_along_axis(gain, order, 1)
    after = lambda v: np.concatenate([np.cumsum(v[:, ::-1], axis=1)[:, ::-1], np.zeros((len(v), 1), v.dtype)], 1)
    rest, base = after(sorted_gain), after(sorted_low)  # what the terms from each place on can add to the base, and their part of it
    thetas = [b.threshold() for b in best]
    if whole is not object:  # all sums are below LONGS here
        thetas = [None if t is None else max(-LONGS, min(LONGS, t)) for t in thetas]
    essential = np.array([n if t is None else int(np.count_nonzero(base[i, 0] + rest[i, :-1] >= t)) for i, t in enumerate(thetas)], np.int64)
    live = np.flatnonzero((essential > 0) | np.array([t is None for t in thetas]) | (n == 0))
    if not len(live):
        return 0
    chosen = np.zeros(q.shape, bool)
    np.put_along_axis(chosen, order, np.arange(n)[None] < essential[:, None], 1)
    terms = np.flatnonzero(chosen[live].any(0))
    product = np.where(chosen[live][:, terms], q[live][:, terms], 0).astype(kind) @ x[terms] if len(terms) else np.zeros((len(live), rows), np.int64)
    product = product.astype(whole)
    read = 0
    for r, i in enumerate(live.tolist()):
        theta, at = thetas[i], int(essential[i])
        score, alive = product[r], np.flatnonzero(~shard.named | (shard.ids != owns[i]))
        read += at * rows
        if theta is None:
            if whole is not object and len(alive) > 4 * best[i].k:
                kth = len(alive) - best[i].k
                alive = alive[score[alive] >= np.partition(score[alive], kth)[kth]]
        else:
            alive = alive[score[alive] + base[i, at] + rest[i, at] >= theta]
        score = score[alive]
        while at < n and len(alive):
            some = order[i, at : at + PROBE]
            score = score + (q[i, some].astype(kind) @ x[np.ix_(some, alive)]).astype(whole)
            read, at = read + len(some) * len(alive), at + len(some)
            left = score + base[i, at] + rest[i, at] >= theta
            alive, score = alive[left], score[left]
        if len(alive):
            best[i].add(score, shard.ids[alive], shard.named[alive])
    return read


def order_of(score: int) -> bytes | None:
    """Beyond 64 bits, bytes that are ordered as the exact scores are."""
    return None if -LONG_MAX - 1 < score < LONG_MAX else (score + OFFSET).to_bytes(264, "big")


def search_block(index: DataFrame, block: Shard, k: int) -> tuple[DataFrame, object]:
    """query, query_id, vec_id, score, beyond: k best or fewer of each task's shards, for one block of queries; and the block's broadcast."""
    sent = index.sparkSession.sparkContext.broadcast((block.ids, block.named, block.x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, q = sent.value
        q = np.ascontiguousarray(q.T)
        best = [Best(k) for _ in own]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.of(row)
                for a in range(0, len(own), GROUP):
                    search(q[a : a + GROUP], own[a : a + GROUP], shard, best[a : a + GROUP])
        n = [len(b.ids) for b in best]
        if sum(n):
            scores = [int(s) for b in best for s in b.scores]
            ids, named = (np.concatenate([getattr(b, c) for b in best]) for c in ("ids", "named"))
            bounded = pa.array([max(-LONG_MAX - 1, min(LONG_MAX, s)) for s in scores], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own), dtype=np.int32), n)), pa.array(np.repeat(own, n)), pa.array(ids, mask=~named), bounded, pa.array([order_of(s) for s in scores], pa.binary())], ["query", "query_id", "vec_id", "score", "beyond"])

    return index.mapInArrow(run, FOUND), sent


def top_k(spark: SparkSession, queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for tables of (vec_id, embedding)."""
    ws = Workspace(spark, "topk")
    small_pages = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4}
    index = ws.put(shards(scaled(candidates), candidates.count(), SHARD_ROWS), "index", **small_pages)
    asked = ws.put(scaled(queries).where(F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "vector"]), "asked")
    blocks = ws.put(shards(asked, asked.count(), QUERY_BLOCK), "queries", **small_pages)
    place = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), F.asc_nulls_last("vec_id")))
    schema = "query_id long, rank int, vec_id long, score long"
    n = 0
    for n, row in enumerate(blocks.toLocalIterator(), 1):
        found, sent = search_block(index, Shard.of(row.asDict()), k)
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        ranked.write.mode("overwrite").parquet(ws.path(f"found/block={n}"))
        sent.unpersist()
    ws.drop("index", "asked", "queries")
    if not n:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", block int").parquet(ws.path("found")).drop("block")


def search_embeddings(spark: SparkSession, embeddings: DataFrame, k: int = K) -> DataFrame:
    """Every row whose vec_id is divisible by 100, against all rows."""
    rows = embeddings.select("vec_id", "embedding")
    return top_k(spark, rows.where(F.col("vec_id") % 100 == 0), rows, k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
