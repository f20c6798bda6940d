"""Mixing sources to target weights, by DataFrame operations alone.

Tokens are summed per source; each source's target gives its repetition rate; a document goes out floor(rate) times, and once more by a
Bernoulli draw seeded by its identifier, with the rate's fraction as probability. A source tries 32 seeds, each a full set of draws, and
takes the one whose words come nearest its target, so that small sources with a few long documents aren't left to chance. So each set of
draws is Bernoulli with the fraction as probability, and which of the sets counts is a choice among them. Draws depend on doc_id and seed
only: reruns, retries and other partitionings agree.

Targets share the words of all sources by weight, but none exceeds 3 times its source: the excess goes to the others by weight, again and
again until none is above. That loop runs on the table of sources and brings one row of sums to the driver each time.

Defined cases: a null text has no words; a null source is one source, ordered last; a row with a null doc_id draws by its text instead, so
that such rows don't all draw alike; repeated rows do; a source without words has rate 0. An empty table gives no rows. When documents are emitted, all their columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, fresh, text_of, word_count

WEIGHTS, MOST, SEEDS = (5, 2, 1), 3, 32
#: Digits of a hash that make a draw: 12 hexadecimal ones, exact in a double.
DRAW = 1 << 48


def draw_parts(doc_id: Column, text: Column) -> list[Column]:
    """Two numbers from the MD5 of the identifier, or without one of the text; the draw under seed k is their combination a + k * b."""
    h = F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), text)).cast("binary"))
    return [F.conv(F.substring(h, 1, 12), 16, 10).cast("long"), F.conv(F.substring(h, 13, 12), 16, 10).cast("long")]


def draw(a: Column, b: Column, seed: Column | int) -> Column:
    return ((a + b * seed) % DRAW) / float(DRAW)


def source_order(sources: DataFrame) -> DataFrame:
    """sources with `place`, from 0, by code point and null last. Ranks come from sorted ranges and their sizes, not from one task."""
    ranged = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    within = ranged.withColumn("in_part", F.row_number().over(W.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1)
    return within


def targets(sizes: DataFrame, ws: Workspace, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target of each source of sizes (source, size)."""
    sums = ws.put(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    within = ws.put(source_order(sums), "ranges")
    # one row for each range of sources; Spark makes no more ranges than shuffle partitions
    before = within.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = within.join(before, "part").withColumn("place", F.col("before") + F.col("in_part"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    shares = ws.put(placed.select("source", "source_size", weight.cast("long").alias("weight")), "weights")
    total = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    left, share = total, -1.0
    cap, held = F.col("source_size") * most, -1
    while True:
        # `share` is what a weight of 1 gets; sources whose share is above their cap are held at it
        full = F.col("weight") * F.lit(share) > cap
        got = shares.agg(F.count_if(full).alias("held"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("caps"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weights")).first()
        if got["held"] == held or not got["weights"]:
            break
        held, left = got["held"], total - got["caps"]
        share = left / got["weights"]
    return shares.withColumn("target", F.when(F.col("weight") * F.lit(share) > cap, cap.cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(max(1, got["weights"])))))


def rates(sized: DataFrame, ws: Workspace, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate and the seed whose draws come nearest the target; sized has source, size, a, b."""
    table = ws.put(targets(sized, ws, weights, most), "targets")
    table = table.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    table = ws.put(table.select("source", "source_size", "target", F.least("rate", F.lit(float(most))).alias("rate")), "rates")
    part = F.col("rate") - F.floor("rate")
    tried = sized.join(table, sized["source"].eqNullSafe(table["source"])).select(table["source"], "source_size", "target", "rate", "size", part.alias("part"), "a", "b")
    got = tried.groupBy("source", "source_size", "target", "rate").agg(*(F.sum(F.when(draw(F.col("a"), F.col("b"), k) < F.col("part"), F.col("size")).otherwise(0)).alias(f"got{k}") for k in range(SEEDS)))
    wish = F.col("target") - F.floor("rate") * F.col("source_size")
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col(f"got{k}") - wish).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS))))
    return ws.put(got.select("source", "source_size", "target", "rate", nearest["seed"].alias("seed")), "seeds")


def sized_rows(documents: DataFrame) -> DataFrame:
    a, b = draw_parts(F.col("doc_id"), text_of("text"))
    return documents.select("doc_id", F.col("source"), word_count(text_of("text")).alias("size"), a.alias("a"), b.alias("b"))


def copies() -> Column:
    return (F.floor("rate") + F.when(draw(F.col("a"), F.col("b"), F.col("seed")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")


def mix_report(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """What the mix takes of every document."""
    ws = Workspace(spark, "mixing")
    sized = ws.put(sized_rows(documents), "sized")
    table = rates(sized, ws)
    out = sized.join(table, sized["source"].eqNullSafe(table["source"]))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """documents, each as often as the mix takes it, with the same columns."""
    ws = Workspace(spark, "mixing")
    table = rates(ws.put(sized_rows(documents), "sized"), ws)
    names = fresh(documents, "mix_source", "mix_rate", "mix_seed", "mix_copy")
    table = table.select(F.col("source").alias(names[0]), F.col("rate").alias(names[1]), F.col("seed").alias(names[2]))
    a, b = draw_parts(F.col("doc_id"), text_of("text"))
    rate = F.col(names[1])
    times = (F.floor(rate) + F.when(draw(a, b, F.col(names[2])) < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    out = documents.join(table, documents["source"].eqNullSafe(table[names[0]]))
    return out.withColumn(names[3], F.explode(F.array_repeat(F.lit(1), times))).select(documents.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null' || coalesce(text, ''))), 1, 12) AS BIGINT) AS a,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null' || coalesce(text, ''))), 13, 12) AS BIGINT) AS b FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s0),
t AS (SELECT CAST(sum(source_size) AS BIGINT) AS total FROM s),
fill AS (
  SELECT 0 AS step, CAST(-1.0 AS DOUBLE) AS share, CAST(-1 AS BIGINT) AS held, CAST(0 AS BIGINT) AS leftover, CAST(1 AS BIGINT) AS weights
  UNION ALL
  SELECT step + 1, CASE WHEN w > 0 THEN (total - caps) / CAST(w AS DOUBLE) ELSE share END, h, total - caps, w
  FROM (SELECT f.step, f.share, f.held, t.total,
               (SELECT CAST(count(*) AS BIGINT) FROM s WHERE s.weight * f.share > 3 * s.source_size) AS h,
               (SELECT CAST(coalesce(sum(3 * s.source_size), 0) AS BIGINT) FROM s WHERE s.weight * f.share > 3 * s.source_size) AS caps,
               (SELECT CAST(coalesce(sum(s.weight), 0) AS BIGINT) FROM s WHERE NOT s.weight * f.share > 3 * s.source_size) AS w
        FROM fill f, t) WHERE h <> held AND w > 0),
last AS (SELECT share, leftover, weights FROM fill ORDER BY step DESC LIMIT 1),
g AS (SELECT s.source, s.source_size,
        CASE WHEN s.weight * l.share > 3 * s.source_size THEN CAST(3 * s.source_size AS DOUBLE) ELSE CAST(l.leftover AS DOUBLE) * s.weight / CAST(l.weights AS DOUBLE) END AS target
      FROM s, last l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM g),
k AS (SELECT r.source, x.seed, abs(sum(CASE WHEN ((d.a + d.b * x.seed) % 281474976710656) / 281474976710656.0::DOUBLE < r.rate - floor(r.rate) THEN d.size ELSE 0 END)
             - (any_value(r.target) - floor(any_value(r.rate)) * any_value(r.source_size))) AS miss
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, range(32) AS x(seed) GROUP BY r.source, x.seed),
b AS (SELECT source, arg_min(seed, (miss, seed)) AS seed FROM k GROUP BY source)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(d.size * (floor(r.rate) + CASE WHEN ((d.a + d.b * b.seed) % 281474976710656) / 281474976710656.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN b ON b.source IS NOT DISTINCT FROM r.source
"""
