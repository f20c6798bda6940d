"""Target-distribution importance resampling: documents are drawn by how much likelier their words are in a target text than in the corpus.

Features are all runs of 1 to `ngrams` consecutive words, hashed into buckets by CRC-32. Each bucket's gain is the logarithm of its smoothed
share in the target over its share in the corpus; a document's weight is the mean of its features' gains. Gumbel noise, seeded by the
identifier, is added to the weight, and the highest scores are drawn: sampling without replacement in proportion to the weights.

Words are found and hashed by a vectorised automaton on the bytes of an Arrow batch, without a Python string: a lookup table gives each byte
its lower-case form or its place between words, differences of that give where words begin and end, and the table of CRC-32 advances the
state of many words by one byte at a time, the longest first, so that those still going on are a prefix. Words past LONG bytes finish
in zlib. Runs of words go on from the state of the run that is one shorter.

Counts by bucket are summed in each task and then by Spark; `buckets` numbers come to the driver and go back to the tasks, a fixed size. The
lowest score to be drawn follows from the counts by score, which are thousandths of logarithms and so have a bounded number of values. Only
rows that may be drawn are ranked, over sorted ranges.

Defined cases: a null or empty text has no words, no features, weight 0 and a score, but isn't drawn, as all texts below `least_words`
aren't. A null doc_id is seeded by an empty string, and comes last on ties; repeated rows each count and are each ranked. An empty target or corpus has
smoothed counts alone. An empty table gives no rows. Very long texts and words are hashed whole. Other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import positions
from .common import Workspace, fresh

NGRAMS, BUCKETS, LEAST_WORDS, PERCENT, SEED, SCALE = 1, 10000, 20, 10, "2024", 1000
#: Bytes of a word that the automaton reads; what is left of longer ones is one call of zlib each.
LONG = 48
#: Words that are advanced together.
STEP = 1 << 16
#: Each byte in lower case, or 0 between words: words are runs of digits, ASCII letters and all bytes beyond ASCII.
CLASSES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def crc_steps(polynomial: int = 0xEDB88320) -> np.ndarray:
    """The table of CRC-32 by byte, from its reversed polynomial."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> np.uint32(1)) ^ np.uint32(polynomial), steps >> np.uint32(1))
    return steps


CRC = crc_steps()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column in a row, and where each begins, with the end of the last. A null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in classified bytes; no word reaches over the beginning of a text."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = data != 0
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The states of CRC-32 after each has read its own stretch of data."""
    out = np.empty(len(state), np.uint32)
    for first in range(0, len(state), STEP):
        some = slice(first, first + STEP)
        length = ends[some] - starts[some]
        order = np.argsort((LONG + 1 - np.minimum(length, LONG + 1)).astype(np.uint8), kind="stable")  # longest first
        at, now = starts[some][order], state[some][order]
        going = len(order) - np.cumsum(np.bincount(np.minimum(length, LONG), minlength=LONG + 1))  # how many are longer than 0, 1, ... bytes
        for k in range(LONG):
            n = going[k]
            if not n:
                break
            now[:n] = CRC[(now[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (now[:n] >> np.uint32(8))
        for i in range(int(np.count_nonzero(length > LONG))):
            rest = data[at[i] + LONG : at[i] + length[order[i]]]
            now[i] = zlib.crc32(rest, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        out[first + order] = now
    return out


def features(column: pa.Array, ngrams: int = NGRAMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: the CRC-32 of every run in the column's texts, in order, and how many each text has."""
    raw, at = utf8(column)
    data = CLASSES[raw]
    starts, ends = word_spans(data, at)
    words = np.diff(np.searchsorted(starts, at))
    text = np.repeat(np.arange(len(column)), words)
    first, state = np.arange(len(starts)), np.full(len(starts), 0xFFFFFFFF, np.uint32)  # the word that each run starts with, and its state
    for n in range(1, ngrams + 1):
        if n > 1:
            longer = np.flatnonzero(text[n - 1 :] == text[: max(0, len(text) - n + 1)])
            state, first = state[np.searchsorted(first, longer)], longer
            state = CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = advance(state, data, starts[first + n - 1], ends[first + n - 1])
        yield state ^ np.uint32(0xFFFFFFFF), np.maximum(words - n + 1, 0)


def bucket_counts(texts: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (a table with one column) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for crc, _ in features(batch.column(0), ngrams):
                found += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(found[used])], ["bucket", "n"])

    summed = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[np.asarray(summed["bucket"])] = np.asarray(summed["n"])
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Each bucket's gain in whole parts of a log, by counts with one added to each bucket."""
    buckets, s, t = len(corpus), corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * float(int(corpus.sum()) + buckets) / ((s + 1) * float(int(target.sum()) + buckets))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def weigher(spark: SparkSession, gain: np.ndarray, ngrams: int = NGRAMS, text: str = "text") -> Column:
    """A struct of n_words, n_features and weight for a column of texts. Only the texts go to Python."""
    sent = spark.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            gain = sent.value
            words, total, n = None, np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for crc, counts in features(batch, ngrams):
                words = counts if words is None else words
                sums = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])
                ends = np.cumsum(counts)
                total += sums[ends] - sums[ends - counts]
                n += counts
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (words, n, weight)], ["n_words", "n_features", "weight"])

    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    return F.arrow_udf(run, kind)(F.col(text))


def noise(doc_id: Column, seed: str = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise in whole parts of a log, from the SHA-256 of seed and identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(-float(scale) * F.log(-F.log(uniform))).cast("long")


def draw(scored: DataFrame, put, percent: int = PERCENT, least_words: int = LEAST_WORDS, score: str = "score", words: str = "n_words", rank: str = "rank") -> DataFrame:
    """scored (a written table with doc_id) with `rank`, from 1 for the highest score on, of the drawn rows; null for all others."""
    fit = F.col(words) >= least_words
    by_score = scored.where(fit).groupBy(score).agg(F.count(F.lit(1)).alias("n")).toArrow()
    scores, counts = np.asarray(by_score[score], np.int64), np.asarray(by_score["n"], np.int64)
    most = percent * int(counts.sum()) // 100
    order = np.argsort(-scores)
    reached = np.flatnonzero(np.cumsum(counts[order]) >= most)
    if not most:
        return scored.withColumn(rank, F.lit(None).cast("long"))
    may = fit & (F.col(score) >= int(scores[order[reached[0]]]))
    place, = fresh(scored, "place")
    ranked = positions(scored.where(may), [F.desc(score), F.asc_nulls_last("doc_id")], put, place)
    ranked = ranked.withColumn(rank, F.when(F.col(place) < most, F.col(place) + 1)).drop(place)
    return ranked.unionByName(scored.where(~F.coalesce(may, F.lit(False))).withColumn(rank, F.lit(None).cast("long")))


def resample(spark: SparkSession, documents: DataFrame, target: DataFrame, percent: int = PERCENT, ngrams: int = NGRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: str = SEED, whole: bool = False) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; with `whole`, the drawn documents alone, with their own columns.

    documents has doc_id and text, target a column text. With `whole`, texts of documents that can't be drawn are neither written nor moved.
    """
    ws = Workspace(spark, "importance")
    gain = gains(bucket_counts(documents.select("text"), ngrams, buckets), bucket_counts(target.select("text"), ngrams, buckets))
    if not whole:
        found = documents.select(F.col("doc_id").cast("long"), weigher(spark, gain, ngrams).alias("found")).select("doc_id", "found.*")
        scored = ws.put(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
        out = draw(scored, lambda df: ws.put(df, "ranked"), percent, least_words)
        return out.select("doc_id", "n_features", "weight", "score", "rank")
    found, score, words, rank = fresh(documents, "found", "score", "n_words", "rank")
    scored = documents.withColumn(found, weigher(spark, gain, ngrams))
    scored = scored.withColumn(score, F.col(f"{found}.weight") + noise(F.col("doc_id"), seed)).withColumn(words, F.col(f"{found}.n_words")).drop(found)
    return draw(ws.put(scored, "scored"), lambda df: ws.put(df, "ranked"), percent, least_words, score, words, rank).where(F.col(rank).isNotNull()).select(documents.columns)


#: CRC-32 as SQL: the table by eight shifts of each byte, then one fold over the bytes of each distinct word.
ORACLE = r"""
WITH RECURSIVE steps AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT)) ORDER BY b) AS step FROM range(256) t(b)),
split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
asked AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
had AS (SELECT row_number() OVER () AS row, doc_id, words FROM split),
used AS (SELECT row, unnest(words) AS word FROM had),
kinds AS (SELECT DISTINCT word FROM (SELECT word FROM used UNION ALL SELECT word FROM asked)),
digits AS (SELECT word, hex(encode(word)) AS h FROM kinds),
hashed AS (SELECT word, xor(list_reduce(list_transform(range(0, CAST(length(h) AS BIGINT), 2), lambda i: CAST('0x' || substr(h, CAST(i + 1 AS INT), 2) AS BIGINT)),
    lambda c, b: xor(step[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM digits, steps),
s AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS n FROM used JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS n FROM asked JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM s) AS s, (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM t) AS t),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (sums.s + 10000) / ((s.n + 1) * (sums.t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
totals AS (SELECT row, CAST(count(*) AS BIGINT) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM used JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row),
scored AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM had LEFT JOIN totals USING (row)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * total // 100 THEN place END AS rank FROM ranked
"""
