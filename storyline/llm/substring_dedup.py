"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is 20 consecutive words of a document. A word goes if some window that covers it also starts earlier: in a document with a smaller
doc_id, or earlier in the same one.

1. Which passages recur. Each window's rarest 6-word phrase by hash (its anchor) is the same wherever the window stands, and one in eight
   positions is an anchor. Anchors that occur in two different texts are found by sums per anchor; windows with such an anchor, about a
   fifth, are then counted in the same way, which gives each recurring window's first document. Both counts meet in partial sums, so a
   passage in a third of all documents costs a row a task. Copies of a whole document are settled by its digest beforehand.
2. Automata. The first document of a recurring window writes the passage's words to a library shard; all other documents that may hold it
   write the stretch in question to the same shard. Shards hold a few thousand windows each, so their number grows with the input and their
   size doesn't; a shard that very many stretches need is dealt out to as many tasks as these fill, each with the automaton again.
3. Each task compiles its shard's windows with pyahocorasick and streams the stretches through. What the automaton finds are occurrences
   of the very words, so a hash that two phrases share removes nothing.
4. Words that are covered go. Repeats within a document are found and compared where it is read first, and a document that has no other
   ones is finished there; only those with stretches found elsewhere are gone through again.

Nothing is capped, and no document is cut: every stretch that the counts name is streamed.

Every step is keyed by the row: by its doc_id and the digest of its words where what is found decides, and before that, where a chance
meeting of two rows only adds candidates, by one hash of doc_id and text.

Defined cases: a null text has no words; texts under 20 words lose nothing. Null doc_ids are equal to each other and count as the greatest.
Rows with equal doc_ids and different texts are documents of their own, of which neither is earlier: each loses what it repeats itself and
what rows with smaller doc_ids have. Rows that repeat both doc_id and text are one document, and each gets its result. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace
from .words import batches_of, mixed, rolling, sliding_min, word_hashes

WINDOW, ANCHOR = 20, 6
SHARD_WINDOWS, TASK_WORDS, STRETCH_COST, HOT = 4096, 50_000, 64, 1000
NULL_ID = (1 << 63) - 1
FACTS = "row long, doc long, n_words long, sha string, own_removed long, own_sha string, anchors array<long>"
#: What a row of stretches is: a passage for a shard's library, a stretch to look through, or a whole text that has such stretches.
LIBRARY, STREAM, WHOLE = 0, 1, 2
STRETCHES = "shard long, kind int, doc long, sha binary, start int, words binary, cost long"
NOTHING = hashlib.sha256(b"").hexdigest()


def hashed_texts(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its words joined by single spaces, where each word starts and ends in that, and the hashes of its windows and of
    their anchors. A window's anchor is the phrase in it with the least hash. Many texts are hashed as one array; what spans two of them
    isn't used."""
    for first, last in batches_of(texts):
        joined = [b" ".join(t.split()) for t in texts[first:last]]
        h, counts, starts, ends = word_hashes(joined)
        windows, anchors = rolling(h, WINDOW), sliding_min(rolling(h, ANCHOR), WINDOW - ANCHOR + 1)
        at = 0
        for k, (text, words) in enumerate(zip(joined, counts.tolist(), strict=True), first):
            n = max(0, words - WINDOW + 1)
            yield k, text, starts[at : at + words], ends[at : at + words], windows[at : at + n], anchors[at : at + n]
            at += words


def texts_of(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def own_repeats(text: bytes, windows: np.ndarray) -> list[int]:
    """Where windows start that also start earlier in the same text."""
    order = np.sort(windows)
    if not (order[1:] == order[:-1]).any():
        return []
    _, at, inverse = np.unique(windows, return_index=True, return_inverse=True)
    again, words = np.flatnonzero(at[inverse] < np.arange(len(windows))).tolist(), text.split()
    return [i for i in again if words[i : i + WINDOW] == words[(j := int(at[inverse[i]])) : j + WINDOW]]


def without(text: bytes, starts: list[int], ends: list[int]) -> tuple[int, str]:
    """Number of words covered by runs of windows, and the digest of the others."""
    words = text.split()
    edge = np.zeros(len(words) + WINDOW + 1, np.int64)
    np.add.at(edge, np.minimum(np.asarray(starts, np.int64), len(words)), 1)
    np.add.at(edge, np.minimum(np.asarray(ends, np.int64), len(words)) + WINDOW, -1)
    kept = np.flatnonzero(np.cumsum(edge[: len(words)]) == 0).tolist()
    return len(words) - len(kept), hashlib.sha256(b" ".join([words[i] for i in kept])).hexdigest()


def runs(mask: np.ndarray, by: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(first, last) of runs of true values, broken also where `by` changes."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    new = np.diff(at) != 1
    if by is not None:
        new |= by[at[1:]] != by[at[:-1]]
    heads = np.concatenate([[0], np.flatnonzero(new) + 1])
    return list(zip(at[heads].tolist(), at[np.append(heads[1:], len(at)) - 1].tolist(), strict=True))


def keyed(documents: DataFrame) -> DataFrame:
    """row, doc, text: the hash of identifier and text, the identifier, and the text."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    return documents.select(F.xxhash64(doc, F.col("text")).alias("row"), doc.alias("doc"), "text")


def facts(rows: DataFrame) -> DataFrame:
    """For each document: its words and the digest of them all, what is left without its own repeats, and its distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, shas, removed, own, anchors = [], [], [], [], []
            for _, text, starts, _, windows, phrases in hashed_texts(texts_of(batch.column(2))):
                n.append(len(starts))
                shas.append(hashlib.sha256(text).hexdigest())
                repeats = own_repeats(text, windows)
                gone, left = without(text, repeats, repeats) if repeats else (0, shas[-1])
                removed.append(gone)
                own.append(left)
                anchors.append(np.unique(phrases).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(removed, pa.int64()), pa.array(own, pa.string()), pa.array(anchors, pa.list_(pa.int64()))], [c.split()[0] for c in FACTS.split(", ")])

    return rows.mapInArrow(run, FACTS)


def places(listed: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values are in the sorted list, and whether they are in it."""
    if not len(listed):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return at, listed[at] == values


class Unseen:
    """Rows of a task that weren't there before. A task whose rows repeat goes through each once."""

    def __init__(self) -> None:
        self.keys: set[tuple[int, bytes]] = set()

    def __call__(self, doc: int, text: bytes) -> bool:
        key = (doc, hashlib.sha256(text).digest())
        if key in self.keys:
            return False
        self.keys.add(key)
        return True


def candidate_windows(rows: DataFrame) -> DataFrame:
    """(row, doc, windows): distinct hashes of the windows whose anchor is in `anchors`; rows has row, doc, text, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen = Unseen()
        for batch in batches:
            docs, keep, out = batch.column(1).to_pylist(), [], []
            for k, text, _, _, windows, phrases in hashed_texts(texts_of(batch.column(2))):
                if unseen(docs[k], text):
                    listed = np.sort(np.asarray(batch.column(3)[k].values))
                    keep.append(k)
                    out.append(np.unique(windows[places(listed, phrases.view(np.int64))[1]]).view(np.int64))
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.list_(pa.int64()))], ["row", "doc", "windows"])

    return rows.select("row", "doc", "text", "anchors").mapInArrow(run, "row long, doc long, windows array<long>")


def stretches(rows: DataFrame, shards: int) -> DataFrame:
    """What each document gives to the shards: passages that it has first, and stretches that others had before; with such, its whole text.

    rows has doc, text, windows and firsts: recurring windows' hashes, and the first document of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in STRETCHES.split(", ")]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64())
        unseen = Unseen()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [], [], [])

            def put(*row: object) -> None:
                for column, value in zip(out, row, strict=True):  # noqa: B023
                    column.append(value)

            held = 0
            for k, text, starts, ends, windows, _ in hashed_texts(texts_of(batch.column(1))):
                if not unseen(docs[k], text):
                    continue
                listed, firsts = (np.asarray(batch.column(i)[k].values) for i in (2, 3))
                order = np.argsort(listed)
                at, found = places(listed[order], windows.view(np.int64))
                if not found.any():
                    continue
                first, sha = firsts[order][at], hashlib.sha256(text).digest()
                shard = (mixed(first.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
                for kind, mask in ((LIBRARY, found & (first == docs[k])), (STREAM, found & (first < docs[k]))):
                    parts = runs(mask, shard)
                    for a, z in parts:
                        put(int(shard[a]), kind, docs[k], sha, a, text[starts[a] : ends[z + WINDOW - 1]], z - a + WINDOW + STRETCH_COST)
                        held += len(out[5][-1])
                    if kind == STREAM and parts:
                        put(-1, WHOLE, docs[k], sha, 0, text, 0)
                        held += len(out[5][-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                    out, held = ([], [], [], [], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return rows.select("doc", "text", "windows", "firsts").mapInArrow(run, STRETCHES)


class Library:
    """The windows of a shard, compiled into one automaton over the numbers of its words."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], None] = {}
        self.automaton = None

    def add(self, words: list[bytes]) -> None:
        letters = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
        for k in range(len(letters) - WINDOW + 1):
            self.windows[letters[k : k + WINDOW]] = None

    def compile(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for letters in self.windows:
            self.automaton.add_word(letters, 1)
        self.windows.clear()
        self.automaton.make_automaton()

    def occurrences(self, words: list[bytes]) -> np.ndarray:
        """Where the shard's windows start among the words."""
        if self.automaton is None:
            self.compile()
        if not len(self.automaton):
            return np.empty(0, np.int64)
        letters = tuple(self.numbers.get(w, 0) for w in words)
        return np.array([end for end, _ in self.automaton.iter(letters)], np.int64) - (WINDOW - 1)


def streamed(dealt: DataFrame) -> DataFrame:
    """(doc, sha, starts, ends): first and last windows of the runs found. dealt is sorted so that each shard's library comes before its stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, library = None, Library()
        for batch in batches:
            docs, shas, starts, ends = [], [], [], []
            for shard, part, kind, doc, sha, start, data in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (shard, part) != of:
                    of, library = (shard, part), Library()
                words = data.split(b" ")
                if kind == LIBRARY:
                    library.add(words)
                    continue
                hits = library.occurrences(words)
                if len(hits):
                    seen = np.zeros(len(words), bool)
                    seen[hits] = True
                    found = runs(seen)
                    docs.append(doc)
                    shas.append(sha)
                    starts.append([start + a for a, _ in found])
                    ends.append([start + z for _, z in found])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(shas, pa.binary()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["doc", "sha", "starts", "ends"])

    return dealt.select("shard", "part", "kind", "doc", "sha", "start", "words").mapInArrow(run, "doc long, sha binary, starts array<int>, ends array<int>")


def locate_occurrences(table: DataFrame, ws: Workspace) -> DataFrame:
    """Deals stretches and libraries to tasks by need and runs the automata."""
    stream = F.col("kind") == STREAM
    need = table.where(stream).groupBy("shard").agg(F.sum("cost").alias("cost"))
    need = ws.put(need.select("shard", F.ceil(F.col("cost") / TASK_WORDS).cast("int").alias("parts")), "parts")
    both = table.where(F.col("kind") != WHOLE).join(need, "shard")
    part = F.when(stream, F.array(F.pmod(F.xxhash64("doc", "sha", "start"), F.col("parts").cast("long")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = both.select("shard", F.explode(part).alias("part"), "kind", "doc", "sha", "start", "words")
    return streamed(dealt.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind"))


def kept_words(rows: DataFrame) -> DataFrame:
    """(doc, sha, removed, kept): rows has doc, sha, the whole text's words, and the runs of windows to remove besides its own repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, left = [], []
            for k, text, _, _, windows, _ in hashed_texts(batch.column(2).to_pylist()):
                own = own_repeats(text, windows)
                gone, digest = without(text, batch.column(3)[k].as_py() + own, batch.column(4)[k].as_py() + own)
                removed.append(gone)
                left.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(left, pa.string())], ["doc", "sha", "removed", "kept"])

    return rows.select("doc", "sha", "words", "starts", "ends").mapInArrow(run, "doc long, sha binary, removed long, kept string")


def remove_repeats(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """What is left of every document."""
    ws, rows = Workspace(spark, "repeats"), keyed(documents)
    known = ws.put(facts(rows), "facts")
    narrow = ws.put(known.drop("row", "anchors"), "narrow")
    long = narrow.where(F.col("n_words") >= WINDOW)
    classes = ws.put(long.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("sha", "first", "n"), "classes")
    # no more than HOT classes have more than one in HOT of all rows, so these are broadcast and their rows stay where they are
    hot = F.col("n") > F.lit(-(-narrow.count() // HOT))
    large = F.broadcast(classes.where(hot).select("sha", F.col("first").alias("hot_first")))
    rest = long.join(large, "sha", "left")
    copies = rest.where("doc > hot_first").select("doc", "sha")
    copies = copies.unionByName(rest.where("hot_first IS NULL").join(classes.where(~hot), "sha").where("doc > first").select("doc", "sha"))
    copies = ws.put(copies.distinct(), "copies")
    # of copies only the first is looked at from here on
    each = known.join(copies, ["doc", "sha"], "left_anti").select("row", F.explode("anchors").alias("anchor"))
    twice = ws.put(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "twice")
    ws.sweep()
    held = ws.put(each.join(twice, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("anchors")), "held")
    ws.drop("facts", "twice")
    ws.sweep()
    windows = ws.put(candidate_windows(rows.join(held, "row")), "windows")
    ws.drop("held")
    ws.sweep()
    each = windows.select("doc", F.explode("windows").alias("window"))
    firsts = ws.put(each.groupBy("window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("window", "first"), "firsts")
    ws.sweep()
    recurring = windows.select("row", F.explode("windows").alias("window")).join(firsts, "window").groupBy("row").agg(F.collect_set(F.struct("window", "first")).alias("of"))
    recurring = ws.put(recurring.select("row", F.col("of.window").alias("windows"), F.col("of.first").alias("firsts")), "recurring")
    shards = max(1, firsts.count() // SHARD_WINDOWS)
    ws.drop("windows", "firsts")
    ws.sweep()
    table = ws.put(stretches(rows.join(recurring, "row"), shards), "stretches")
    ws.drop("recurring")
    ws.sweep()
    found = ws.put(locate_occurrences(table, ws), "found")
    ws.sweep()
    by = ["doc", "sha"]
    whole = table.where(F.col("kind") == WHOLE).select(*by, "words").join(found.groupBy(by).agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")), by)
    again = kept_words(whole).select("doc", F.lower(F.hex("sha")).alias("sha"), "removed", "kept").dropDuplicates(by)
    again = ws.put(again, "again")
    ws.drop("stretches", "found")
    ws.sweep()
    out = narrow.join(again, by, "left").join(copies.withColumn("copy", F.lit(True)), by, "left")
    gone = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", "own_removed"))
    left = F.when(F.col("copy"), NOTHING).otherwise(F.coalesce("kept", "own_sha"))
    return out.select(F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), "n_words", gone.alias("n_removed"), left.alias("kept_sha256"))


#: All windows as strings; only for small tables.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS r(i) WHERE len(w) >= 20),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM x),
c AS (SELECT DISTINCT doc_id, p FROM f, unnest(range(i, i + 20)) AS r(p) WHERE n > 1),
v AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (SELECT v.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY v.p) AS t FROM v LEFT JOIN c ON c.doc_id = v.doc_id AND c.p = v.p WHERE c.p IS NULL GROUP BY v.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
