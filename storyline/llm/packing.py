"""Best-fit packing of documents into sequences of at most 1024 tokens.

Token ids come from the tokenizer file. Only documents longer than a sequence are cut, into full sequences after a shorter first piece. Every
piece goes, when it comes and for good, into the open sequence where it fits best: open sequences hang under their free space, and a bitset
of the free spaces in use gives the tightest fit in one shift. The number of open sequences is fixed; when a new one is needed beyond it,
the fullest closes. Pieces are narrow rows (no text, no ids), dealt by a hash into parts of about `part_rows`, each packed by one task; a
part's last open sequences are all that a larger part would save. A part's pieces come from the longest on, which leaves under a thousandth
of the space empty, or in the order of a hash (`longest_first` false), which leaves about a hundredth. Order and parts depend on the rows
alone, so retries agree.

Ids are those of tokenizers. tiktoken has them several times faster, by the vocabulary of the same file, and is used where that is shown and
not trusted: the file's model must be plain byte-level BPE with merges in the order of its ids, so that texts can only differ in how their
characters are classed; a worker compares both encoders on every character that it meets for the first time, next to a letter, a digit, a
sign and a space, before the text's ids are used, and on the first text of every batch. Texts with a character that differs, and texts that
hold the string of a special token, go through tokenizers; so does everything from a batch's first difference on, that batch included.

Defined cases: null and empty texts are one piece of one token (the end). The string of a special token, like "<|endoftext|>", is that token
in a text, as tokenizers has it; with `special_as_text` it is ordinary text. A null doc_id stays null. Repeated rows are each packed. Very long texts are encoded whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lean, partitions_for

LENGTH, END, OPEN_BINS, PART_ROWS = 1024, 2, 1 << 14, 1 << 17
TOKENIZER = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name is one of the public tokenizers on this machine."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text by a byte-level BPE file of tokenizers."""

    cache: dict[tuple[str, bool], Encoder] = {}
    #: What a character is put next to, so that its class shows.
    BESIDE = ("a{0}a", "1{0}1", "!{0}!", " {0} ", "{0}{0}", "'{0}")

    @classmethod
    def of(cls, name: str, special_as_text: bool = False) -> Encoder:
        key = (name, special_as_text)
        if key not in cls.cache:
            cls.cache[key] = cls(tokenizer_path(name), special_as_text)
        return cls.cache[key]

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = special_as_text
        file = json.load(open(path, encoding="utf-8"))
        self.fast = self.same_ranks(file["model"]) if self.plain(file) else None
        self.special = [] if special_as_text else [t["content"] for t in file.get("added_tokens") or []]
        self.compared: set[str] = set()
        self.different: set[str] = set()

    @staticmethod
    def plain(file: dict) -> bool:
        """Whether the file does nothing but cut texts by the usual pattern and merge bytes by rank."""
        model, before = file["model"], file.get("pre_tokenizer") or {}
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        return model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in options) and not file.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)

    @staticmethod
    def same_ranks(model: dict):
        """A tiktoken encoding of the vocabulary, if a token's id is its rank among the merges."""
        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        vocabulary, ids = model["vocab"], []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ids.append(vocabulary.get(left + right, -1))
        if ids != list(range(256, 256 + len(ids))):
            return None
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(ids) and all(c in letters for c in token)}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def slowly(self, text: str) -> np.ndarray:
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def quickly(self, text: str) -> np.ndarray:
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def alike(self, text: str) -> bool:
        """Whether both encoders class all characters of a text alike."""
        characters = set(text)
        new = characters - self.compared
        for c in new:
            if any(not np.array_equal(self.quickly(t), self.slowly(t)) for t in (b.format(c) for b in self.BESIDE)):
                self.different.add(c)
        self.compared |= new
        return not self.different or self.different.isdisjoint(characters)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or not self.alike(text):
            return self.slowly(text)
        return self.quickly(text)

    def test(self, text: str) -> None:
        if self.fast is not None and not np.array_equal(self.slowly(text), self.ids(text)):
            self.fast = None


def cut(n: int, length: int = LENGTH) -> list[int]:
    """Where the pieces of n tokens end."""
    return list(range(n % length or length, n + 1, length))


def pieces(documents: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end: int = END, special_as_text: bool = False) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, special_as_text)
        for batch in batches:
            docs, texts, out = batch.column(0).to_pylist(), batch.column(1), ([], [], [], [], [])
            for k, doc_id in enumerate(docs):
                text = texts[k].as_py() or ""
                if k == 0:
                    encoder.test(text)
                data = np.append(encoder.ids(text), np.uint32(end)).astype("<u4").tobytes()
                start = 0
                for i, stop in enumerate(cut(len(data) // 4, length)):
                    for column, value in zip(out, (doc_id, i, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])), strict=True):
                        column.append(value)
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class BestFit:
    """Online best fit into a bounded number of open bins."""

    def __init__(self, capacity: int = LENGTH, open_bins: int = OPEN_BINS):
        self.capacity, self.most, self.open, self.made, self.used_spaces = capacity, open_bins, 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def take(self, space: int) -> int:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            self.used_spaces &= ~(1 << space)
        return found

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it of a piece."""
        fits = self.used_spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            found = self.take(space)
        else:
            space, found = self.capacity, self.made
            self.made += 1
            self.open += 1
            if self.open > self.most:  # bins without free space have left already; the fullest of the others closes
                self.take((self.used_spaces & -self.used_spaces).bit_length() - 1)
                self.open -= 1
        left = space - size
        if left:
            self.by_space[left].append(found)
            self.used_spaces |= 1 << left
        else:
            self.open -= 1
        return found, self.capacity - space


def pack(table: DataFrame, rows: int, length: int = LENGTH, open_bins: int = OPEN_BINS, part_rows: int = PART_ROWS, longest_first: bool = True) -> DataFrame:
    """table (a written table of pieces, with its number of rows) with sequence_id and offset."""
    parts = partitions_for(rows, part_rows)
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    arrival = [F.desc("length")] if longest_first else []
    dealt = table.repartition(parts, order).sortWithinPartitions(*arrival, order, "doc_id", "piece", "start", "length", "ids_crc32").withColumn("part", F.spark_partition_id().cast("long"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(length, open_bins)
        for batch in batches:
            places = [bins.place(n) for n in batch.column(3).to_pylist()]
            sequence, offset = np.array(places, np.int64).reshape(-1, 2).T
            sequence = sequence + (np.asarray(batch.column(5)) << 36)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return dealt.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, documents: DataFrame, tokenizer: str = TOKENIZER, longest_first: bool = True, special_as_text: bool = False) -> DataFrame:
    """Where every piece of every document lies."""
    ws = Workspace(spark, "packing")
    table = ws.put(pieces(documents, tokenizer, special_as_text=special_as_text), "pieces")
    return pack(table, table.count(), longest_first=longest_first)
