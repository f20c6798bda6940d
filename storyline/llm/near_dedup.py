"""Near-duplicate detection with SetSketch registers (Ertl, 2021).

A document's set is its distinct 5-word shingles. Each of 128 registers holds the least of the set's exponentially distributed hash values
in steps of a power of 1.001, truncated to 16 bits: such sketches merge by maximum, and equal registers are as likely as the sets are
similar. Four registers make a band; documents that share a band are candidates. At a similarity of 0.75, 32 bands miss a pair with
probability (1 - 0.75^4)^32 = 5e-6.

Sets come once each: documents with equal sets form a class, and only the class's first document goes on. In every band each document is
compared with the band's first document, never with all. Links join documents into components. Where a band's documents are then still in
more than one component, those go on that have enough shingles that any other document has at all, and are compared with the band's most
central document. A band of what is left after that is split by a second key, from documents' rarest shared shingles: sets as similar as
asked for have one in common among each one's rarest quarter (prefix filtering; Chaudhuri et al., 2006), so documents that no chain of such
shingles connects are of different clusters and can't be linked. A passage that very many documents share is nobody's key, and a key whose
documents are all in one component counts for none. Pairs meet within one band and cluster and across components only, once each; they need
like sizes, enough equal registers, and few enough different parities of 2048 finer ones, before their sets are fetched. What stays
quadratic is the work on documents of one cluster that differ from its centre and yet could be linked with each other by all these bounds.

A candidate pair is estimated first: the likelihood of the numbers of greater, less and equal registers, jointly with both set sizes, gives
the similarity; a pair is put aside only if a similarity of 0.75 is less likely than the best one by e^30. All others are confirmed on the
full sets. Components come from contracting links in tables, by identifier and then by hashes, so that a chain of any order loses about half
of its vertices a round; once no more than a fixed number of links is left, one task finishes them. Nothing of them goes to the driver.

Defined cases: with fewer than five words the whole sequence is one shingle; without words, or null, a document has no set, links with
nothing and stays. Rows that share a doc_id are one document for linking. Rows without doc_id join their set's class only; a class
of such rows alone has a null component and all of them stay. An empty table gives no rows. Very long texts are read whole. Other columns are ignored, or kept by drop_near_copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, fresh, lean
from .words import batches_of, mixed, rolling, word_hashes

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
REGISTERS, BAND, BASE, RATE = 128, 4, 1.001, 20.0
#: Log-likelihood by which 0.75 must be behind for a pair to be put aside without its sets.
BEYOND_DOUBT = 30.0
#: Equal registers that a link has at least: below, its probability at 0.75 (mean 96, deviation 4.9) is under 1e-6.
LEAST_EQUAL = 71
SKETCH = "doc_id long, n_shingles long, digest binary, registers binary"
#: Further registers, of which a document that is still undecided keeps one bit each; and most bits in which a link differs: at 0.75, one in
#: eight (256, deviation 15) differ, and five deviations more are too many.
PARITIES, MOST_DIFFERENT = 2048, 331
#: Links that one task joins into components, as 16 bytes each; more are contracted first.
FINISH = 1 << 18
_rng = np.random.default_rng(20210101)
_A = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_C = _rng.integers(0, 1 << 32, PARITIES, dtype=np.uint32) | np.uint32(1)
_D = _rng.integers(0, 1 << 32, PARITIES, dtype=np.uint32)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, last in batches_of(texts):
        h, n, _, _ = word_hashes([t.lower() for t in texts[first:last]])
        at = np.cumsum(n) - n
        all_of = rolling(h, SHINGLE)
        for start, size in zip(at.tolist(), n.tolist(), strict=True):
            if size >= SHINGLE:
                yield np.unique(all_of[start : start + size - SHINGLE + 1])
            elif size:
                yield mixed(rolling(h[start : start + size], size) + np.uint64(size))
            else:
                yield np.empty(0, np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 512) -> np.ndarray:
    """The least hash of the set under each of many hash functions."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    s = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(s), step):
        np.minimum(low, (a[:, None] * s[None, k : k + step] + b[:, None]).min(1), out=low)
    return low


def parities(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of 2048 minima, as 32 numbers; sets differ in half of those bits whose minima differ."""
    low = minima(shingles, _C, _D, 64)
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.packbits((low >> np.uint32(20)).astype(np.uint8) & 1).view("<i8")


def registers(shingles: np.ndarray) -> np.ndarray:
    """128 truncated minima, each in steps of a power of BASE; more for a set with more elements."""
    low = minima(shingles, _A, _B)
    x = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype("<u2")


def digest_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def set_digest(text: Column) -> Column:
    """The digest of a text's set, as sketches have it."""

    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(map(digest_of, shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in batch.to_pylist()])), pa.binary())

    return F.arrow_udf(run, "binary")(text)


def sketches(documents: DataFrame) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            n, digests, rows = [], [], []
            for some in shingle_sets(texts):
                n.append(len(some))
                digests.append(digest_of(some))
                rows.append(registers(some).tobytes() if len(some) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCH)


def bands(sketched: DataFrame) -> DataFrame:
    """(band, doc_id): 32 keys for each sketch. A key is its four registers, which fill 64 bits, mixed with the band's number."""
    salt = mixed(np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = mixed(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(batch.num_rows, -1) ^ salt)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), keys.shape[1]))], ["band", "doc_id"])

    return sketched.select("doc_id", "registers").mapInArrow(run, "band long, doc_id long")


def log_likelihood(j: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Of a similarity, given the numbers of registers in which a is greater, less and equal, and both set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.minimum(j, np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-9
    return more * np.log(up + tiny) + less * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, 0) + tiny)


def possible(n_a: np.ndarray, n_b: np.ndarray, r_a: np.ndarray, r_b: np.ndarray) -> np.ndarray:
    """Whether pairs may have the similarity asked for: by size alone, and by likelihood against the best of a grid."""
    goal = NUMERATOR / DENOMINATOR
    counts = (r_a > r_b).sum(1), (r_a < r_b).sum(1), (r_a == r_b).sum(1)
    at_goal = log_likelihood(np.full(len(n_a), goal), n_a, n_b, *counts)
    best = np.max([log_likelihood(np.full(len(n_a), j), n_a, n_b, *counts) for j in np.linspace(0, goal, 31)], 0)
    sizes = DENOMINATOR * np.minimum(n_a, n_b) >= NUMERATOR * np.maximum(n_a, n_b)
    return sizes & (best - at_goal < BEYOND_DOUBT)


def set_table(documents: DataFrame, some: DataFrame, sketched: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, registers and the full set of the documents in some (doc_id)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], ["doc_id", "shingles"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, "doc_id", "left_semi")
    return ws.put(texts.mapInArrow(run, "doc_id long, shingles binary").join(sketched.select("doc_id", "registers"), "doc_id"), "sets", codec="none")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are links: estimated from the registers, then confirmed on the full sets."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, s_a, r_a, s_b, r_b = (batch.column(i) for i in range(6))
            n_a, n_b = (np.asarray([len(x.as_buffer()) // 8 for x in s], np.float64) for s in (s_a, s_b))
            regs = [np.frombuffer(b"".join(r.to_pylist()), "<u2").reshape(-1, REGISTERS) for r in (r_a, r_b)]
            keep = []
            for k in np.flatnonzero(possible(n_a, n_b, *regs)).tolist():
                x, y = (np.frombuffer(s[k].as_buffer(), "<u8") for s in (s_a, s_b))
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if DENOMINATOR * common >= NUMERATOR * (len(both) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int32())), b.take(pa.array(keep, pa.int32()))], ["a", "b"])

    side = lambda n: sets.select(F.col("doc_id").alias(n), F.col("shingles").alias(f"s_{n}"), F.col("registers").alias(f"r_{n}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "s_a", "r_a", "s_b", "r_b").mapInArrow(run, "a long, b long")


def finished(edges: DataFrame) -> DataFrame:
    """(v, to): every end of few links with the least end of its component, by one task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            return v

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
                parent[max(x, y)] = min(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(v) for v in parent], pa.int64())], ["v", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "v long, to long")


def contractions(edges: DataFrame, ws: Workspace, name: str, finish: int = FINISH) -> list[DataFrame]:
    """Tables (v, to), one a round: where each vertex that the rounds before have left goes.

    Each vertex goes to the first one, in the round's order, of itself and its neighbours. The first round's order is the identifier's, as
    most links are stars round a least one; later orders are hashes, another one every other round, so that no order of the input is bad.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out: list[DataFrame] = []
    while left := edges.count():
        n = len(out) + 1
        if left <= finish:
            return [*out, ws.put(finished(edges), f"{name}-to{n}")]
        if n == 1:
            to = both(edges).groupBy("a").agg(F.min("b").alias("first")).select(F.col("a").alias("v"), F.least("a", "first").alias("to"))
        else:
            place = lambda c: F.xxhash64(F.col(c), F.lit(n // 2))  # noqa: B023, E731
            near = both(edges).groupBy("a").agg(F.min_by("b", place("b")).alias("first"), F.min(place("b")).alias("place"))
            to = near.select(F.col("a").alias("v"), F.when(F.col("place") < place("a"), F.col("first")).otherwise(F.col("a")).alias("to"))
        to = ws.put(to, f"{name}-to{n}")
        moved = edges.join(to.select(F.col("v").alias("a"), F.col("to").alias("to_a")), "a").join(to.select(F.col("v").alias("b"), F.col("to").alias("to_b")), "b")
        edges = ws.put(moved.where("to_a <> to_b").select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct(), f"{name}-edges{n}")
        out.append(to)
    return out


def components(links: DataFrame, ws: Workspace, name: str, finish: int = FINISH) -> DataFrame:
    """(doc_id, component) for every end of links (a, b): the smallest end that it is linked with."""
    edges = ws.put(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges0")
    rounds = contractions(edges, ws, name, finish)
    if not rounds:
        return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))
    found = rounds[-1]
    for n in range(len(rounds) - 2, -1, -1):  # each table is about half of the one before it
        after = found.select(F.col("v").alias("to"), F.col("to").alias("end"))
        found = ws.put(rounds[n].join(after, "to", "left").select("v", F.coalesce("end", "to").alias("to")), f"{name}-of{n}")
    if len(rounds) > 1:  # hashes may have chosen which vertex stays
        found = found.join(found.groupBy("to").agg(F.min("v").alias("least")), "to").select("v", F.col("least").alias("to"))
    return ws.put(found.select(F.col("v").alias("doc_id"), F.col("to").alias("component")), f"{name}-of")


def different_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def equal_registers(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def register_array(registers: Column) -> Column:
    """Four hexadecimal digits for each register."""
    return F.regexp_extract_all(F.hex(registers), F.lit("[0-9A-F]{4}"), F.lit(0))


def each_shingle(sets: DataFrame) -> DataFrame:
    """(shingle, doc_id): the sets, a row for each shingle."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, shingles in zip(batch.column(0), batch.column(1), strict=True):
                values = np.frombuffer(shingles.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.full(len(values), doc_id.as_py()))], ["shingle", "doc_id"])

    return sets.select("doc_id", "shingles").mapInArrow(run, "shingle long, doc_id long")


def unique_shingles(sets: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, n, shared): set sizes, and how many of a document's shingles also occur in another document of sets."""
    alone = each_shingle(sets).groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other")).where("doc_id = other").groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
    n = (F.octet_length("shingles") / 8).cast("long")
    sized = sets.select("doc_id", n.alias("n")).join(alone, "doc_id", "left")
    return ws.put(sized.select("doc_id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")), "shared_shingles")


def parity_table(sets: DataFrame) -> DataFrame:
    """(doc_id, bits) of documents with full sets."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [parities(np.frombuffer(x.as_buffer(), "<u8")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "bits"])

    return sets.select("doc_id", "shingles").mapInArrow(run, "doc_id long, bits array<long>")


def may_link(n_a: Column, shared_a: Column, n_b: Column, shared_b: Column) -> Column:
    """No pair has more common shingles than either has shared ones."""
    common = F.least(shared_a, shared_b)
    return (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (n_a + n_b)


def open_members(members: DataFrame, linked: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Those of members (band, doc_id, ...) whose band still has more than one component, with `component`."""
    placed = members.join(linked.select("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = ws.put(placed, f"{name}-placed")
    still = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    return ws.put(placed.join(ws.put(still, f"{name}-bands"), "band", "left_semi"), f"{name}-members")


def prefix_keys(left: DataFrame, sets: DataFrame, ws: Workspace) -> DataFrame:
    """(key, size, doc_id, component, n, shared) of documents left (doc_id, component, n, shared): the rarest shingles of each, in one order
    for all, as many as any set that is similar enough must share one of; without those that no other document has. `size` is a class of set
    sizes such that similar sets have one in common."""
    each = each_shingle(sets.join(left.select("doc_id"), "doc_id", "left_semi"))
    often = ws.put(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    counted = each.join(often, "shingle").join(left, "doc_id")
    within = W.partitionBy("doc_id")
    first = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    alone = F.col("n") - F.count(F.lit(1)).over(within)
    kept = counted.withColumn("alone", alone).withColumn("place", F.row_number().over(within.orderBy("often", "shingle"))).where(F.col("place") <= first - F.col("alone"))
    size = F.floor(F.log("n") / float(np.log(DENOMINATOR / NUMERATOR))).cast("int")
    keyed = ws.put(kept.select(F.col("shingle").alias("key"), F.explode(F.array(size, size + 1)).alias("size"), "doc_id", "component", "n", "shared"), "keys")
    open_keys = keyed.groupBy("key", "size").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "size")
    return ws.put(keyed.join(open_keys, ["key", "size"], "left_semi"), "open-keys")


def clusters(keys: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, cluster): documents that share keys, directly or through others, are of one cluster; no link is between two of them."""
    first = keys.groupBy("key", "size").agg(F.min("doc_id").alias("first"))
    edges = ws.put(keys.join(first, ["key", "size"]).select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct(), "cluster-edges")
    return components(edges, ws, "clusters").withColumnRenamed("component", "cluster")


def across(left: DataFrame, sets: DataFrame, ws: Workspace) -> DataFrame:
    """Candidates (a, b) of left (band, cluster, doc_id, component, n, shared) in different components: each pair once, in its first common
    band, and only if sizes, shared shingles, registers and parities allow a link. The largest component of a band and cluster meets the
    others and not itself."""
    counts = left.groupBy("band", "cluster", "component").agg(F.count(F.lit(1)).alias("k"))
    main = ws.put(counts.groupBy("band", "cluster").agg(F.max_by("component", F.struct("k", "component")).alias("main")), "main")
    held = sets.join(left.select("doc_id").distinct(), "doc_id", "left_semi")
    finer = parity_table(held).join(held.select("doc_id", register_array(F.col("registers")).alias("regs")), "doc_id")
    finer = ws.put(finer.join(left.groupBy("doc_id").agg(F.collect_set("band").alias("bands")), "doc_id"), "finer")  # 32 bands at most
    sides = ws.put(left.join(main, ["band", "cluster"]).join(finer, "doc_id"), "sides")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "component", "n", "shared", "bands", "regs", "bits")]
    minor = sides.where("component <> main").select("band", "cluster", *side("a"))
    other = sides.select("band", "cluster", *side("b"), (F.col("component") == F.col("main")).alias("in_main"))
    met = (F.col("component_a") != F.col("component_b")) & (F.col("in_main") | (F.col("doc_id_a") < F.col("doc_id_b")))
    met = met & may_link(F.col("n_a"), F.col("shared_a"), F.col("n_b"), F.col("shared_b"))
    met = met & (DENOMINATOR * F.least("n_a", "n_b") >= NUMERATOR * F.greatest("n_a", "n_b"))
    met = met & (minor["band"] == F.array_min(F.array_intersect("bands_a", "bands_b")))
    met = met & (equal_registers(F.col("regs_a"), F.col("regs_b")) >= LEAST_EQUAL)
    met = met & (different_bits(F.col("bits_a"), F.col("bits_b")) <= MOST_DIFFERENT)
    pairs = minor.join(other, (minor["band"] == other["band"]) & (minor["cluster"] == other["cluster"]) & met)
    return ws.put(pairs.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct(), "across")


def settle(members: DataFrame, sets: DataFrame, links: DataFrame, ws: Workspace) -> DataFrame:
    """links, with all that are missing between members of a band: first against the band's most central document, the one with the
    largest part of its shingles shared, then across what components are left."""
    left = open_members(members, components(links, ws, "stars"), ws, "first")
    if left.isEmpty():
        return links
    held = sets.join(left.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = unique_shingles(held, ws).where(may_link(F.col("n"), F.col("shared"), F.ceil(F.col("n") * NUMERATOR / DENOMINATOR), F.col("shared")))
    left = ws.put(left.drop("component").join(sizes, "doc_id"), "sized")

    centre = ws.put(left.groupBy("band").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("part"), F.bitwise_not("doc_id").alias("order"), "doc_id", "n", "shared")).alias("c")).select("band", "c.*"), "centres")
    to = centre.select("band", F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("shared_a"))
    met = left.join(to, (left["band"] == to["band"]) & (F.col("doc_id") != F.col("a")) & may_link(F.col("n_a"), F.col("shared_a"), F.col("n"), F.col("shared")))
    more = ws.put(confirmed(ws.put(met.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct(), "central"), sets), "central-links")
    links = links.unionByName(more)

    left = open_members(left, components(links, ws, "centres"), ws, "second")
    if left.isEmpty():
        return links
    unsettled = ws.put(left.select("doc_id", "component", "n", "shared").distinct(), "unsettled")
    of = clusters(prefix_keys(unsettled, sets, ws), ws)
    split = ws.put(left.join(of, "doc_id"), "split")
    still = split.groupBy("band", "cluster").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "cluster")
    pairs = across(ws.put(split.join(still, ["band", "cluster"], "left_semi"), "open"), sets, ws)
    return links.unionByName(ws.put(confirmed(pairs, sets), "across-links"))


def link_documents(documents: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = documents.select("doc_id", "text")
    sketched = ws.put(sketches(rows), "sketches")
    classes = ws.put(sketched.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "classes")
    members = ws.put(sketched.join(classes, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("digest").isNotNull(), F.coalesce("first", "doc_id")).alias("class"), F.when(F.col("doc_id") == F.coalesce("first", "doc_id"), F.col("registers")).alias("registers")), "members")
    ws.drop("sketches")
    firsts = members.where(F.col("registers").isNotNull()).select("doc_id", "registers")
    keyed = bands(firsts)
    pivots = ws.put(keyed.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("other"), F.count(F.lit(1)).alias("n")).where("pivot <> other").select("band", "pivot", "n"), "pivots")
    ws.sweep()
    shared = ws.put(keyed.join(pivots, "band"), "shared")
    ws.sweep()
    stars = ws.put(shared.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    some = stars.select(F.col("b").alias("doc_id")).union(stars.select("a")).distinct()
    sets = set_table(rows, ws.put(some, "some"), firsts, ws)
    ws.sweep()
    links = ws.put(confirmed(stars, sets), "links")
    ws.sweep()
    links = settle(shared.where("n > 2").select("band", "doc_id"), sets, links, ws)
    of = components(links, ws, "all").select(F.col("doc_id").alias("class"), "component")
    ws.drop("sets", "shared", "pivots", "first-placed", "first-members", "second-placed", "second-members", "sized", "keys", "open-keys", "often", "finer", "sides", "split", "open")
    ws.sweep()
    out = members.join(of, "class", "left").select("doc_id", "n_shingles", F.coalesce("component", "class", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return link_documents(documents, Workspace(spark, "near"))


def drop_near_copies(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """documents with one of each component, with the same columns. Rows without doc_id go by their set, which some document has."""
    ws = Workspace(spark, "near")
    dropped, first, digest = fresh(documents, "dropped_id", "first", "digest")
    rest = link_documents(documents, ws).where(~F.col("kept"))
    gone = ws.put(rest.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(dropped)).distinct(), "gone")
    taken = ws.get("classes", T.StructType.fromDDL("digest binary, first long")).select(F.col("digest").alias(first))
    nameless = documents.where(F.col("doc_id").isNull()).withColumn(digest, set_digest(F.col("text")))
    stays = documents.where(F.col("doc_id").isNotNull()).join(gone, F.col("doc_id") == F.col(dropped), "left_anti")
    return stays.select(documents.columns).unionByName(nameless.join(taken, F.col(digest) == F.col(first), "left_anti").select(documents.columns))


#: All pairs that share a shingle; only for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
