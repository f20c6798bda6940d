from __future__ import annotations

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from storyline.llm import packing  # noqa: E402


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", None, "Hello world", "  two\n\n spaces\t ", "été ñ 漢字 🙂" * 50, "word " * 3000, "a" * 5000, "x y z", "don't we'll I'd", "1234567890 " * 400, "\x00\x01"]


def test_pieces_and_places(spark, documents, reference, words, rng):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, " ".join(words(rng.randint(1, 700)))) for k in range(150)] + [(None, "no id"), (2, "Hello world")]
    got = packing.pack_documents(spark, documents(rows, extra=True)).collect()
    want = defaultdict(int)
    for doc_id, text in rows:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        ends = list(range(len(ids) % 1024 or 1024, len(ids) + 1, 1024))
        for i, (a, z) in enumerate(zip([0, *ends], ends, strict=False)):
            want[doc_id, i, a, z - a, zlib.crc32(ids[a:z].tobytes())] += 1
    have = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * sum(r.length for r in got) / 1024 + 1


def test_best_fit_is_bounded_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]  # the tightest fit; bin 1 is full
    assert bins.place(8) == (2, 0)
    assert bins.place(9) == (3, 0)  # closes bin 2, with 2 left
    assert bins.place(2) == (0, 6)
    assert bins.place(1) == (3, 9)
    assert bins.open == 1


def test_best_fit_against_plain_search(rng):
    bins, open_bins, made = packing.BestFit(100, 8), {}, 0
    for _ in range(3000):
        size = rng.randint(1, 100)
        where, offset = bins.place(size)
        fits = [space for space in open_bins.values() if space >= size]
        if fits:
            assert open_bins[where] == min(fits) and offset == 100 - min(fits)
            open_bins[where] -= size
        else:
            assert (where, offset) == (made, 0)
            made += 1
            if len(open_bins) == 8:
                fullest = min(open_bins.values())
                gone = [b for b, s in open_bins.items() if s == fullest]
                open_bins.pop(next(b for b in gone if b not in sum(bins.by_space, [])))
            open_bins[where] = 100 - size
        if not open_bins[where]:
            open_bins.pop(where)
        assert bins.open == len(open_bins) <= 8


def test_fast_and_slow_ids_agree():
    encoder = packing.Encoder.of(packing.TOKENIZER)
    assert encoder.fast is not None
    fast = [encoder.ids(t or "").tolist() for t in TEXTS]
    slow = packing.Encoder(packing.tokenizer_path(packing.TOKENIZER))
    slow.fast = None
    assert fast == [slow.ids(t or "").tolist() for t in TEXTS]


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y " * 300, "<|endoftext", "<|ENDOFTEXT|>"]


def test_special_strings_are_tokens_as_tokenizers_has_them(reference):
    got = packing.Encoder.of(packing.TOKENIZER)
    assert got.ids(SPECIAL[0]).tolist() == [64, 220, 50256, 275]
    assert all(got.ids(t).tolist() == reference.encode(t, add_special_tokens=False).ids for t in SPECIAL)


def test_special_strings_may_be_text():
    assert 50256 not in packing.Encoder.of(packing.TOKENIZER, special_as_text=True).ids(SPECIAL[0]).tolist()


def test_all_texts_of_a_table_and_odd_ones(spark, documents, reference, tables):
    """Every piece of the smallest table, and of texts of special strings and of unusual characters, is that of tokenizers."""
    odd = ["".join(chr(c) for c in range(a, a + 300) if not 0xD800 <= c < 0xE000) for a in range(0x80, 0x20000, 1999)] + ["\u1885 \U000323af \x85 \u2028a\u3000b", "ab\u0301c\u200d\ufe0f"]
    rows = [(k, t) for k, t in enumerate(SPECIAL + odd)]
    sf = Path("/root/testdata/sf0.001/documents.parquet")
    if sf.exists():
        rows += [(r.doc_id + 10_000, r.text) for r in spark.read.parquet(str(sf)).select("doc_id", "text").collect()]
    want = set()
    for doc_id, text in rows:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        ends = packing.cut(len(ids))
        want |= {(doc_id, i, a, z - a, zlib.crc32(ids[a:z].tobytes())) for i, (a, z) in enumerate(zip([0, *ends], ends, strict=False))}
    assert {tuple(r)[:5] for r in packing.pack_documents(spark, documents(rows)).collect()} == want


def test_a_character_that_differs_goes_the_slow_way(reference):
    encoder = packing.Encoder(packing.tokenizer_path(packing.TOKENIZER))
    quickly, calls = encoder.quickly, []
    encoder.quickly = lambda t: np.append(quickly(t), np.uint32(7)) if "ж" in t else (calls.append(t), quickly(t))[1]
    for text in ("plain words", "with a ж in it", "plain again"):
        assert encoder.ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids
    assert encoder.different == {"ж"} and "plain again" in calls and "with a ж in it" not in calls


@pytest.mark.parametrize("longest_first", [True, False])
def test_pieces_go_in_as_they_come(spark, documents, words, rng, longest_first):
    """The packing of a part is that of one online best fit over its rows in order."""
    docs = documents([(k, " ".join(words(rng.randint(1, 400)))) for k in range(80)])
    rows = packing.pack_documents(spark, docs, longest_first=longest_first).collect()
    bins = packing.BestFit(packing.LENGTH, packing.OPEN_BINS)
    assert [(r.sequence_id, r.offset) for r in rows] == [bins.place(r.length) for r in rows]
    assert (sorted((r.length for r in rows), reverse=True) == [r.length for r in rows]) == longest_first


def test_empty(spark, documents):
    assert packing.pack_documents(spark, documents([(1, "x")]).limit(0)).count() == 0
