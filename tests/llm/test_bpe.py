from __future__ import annotations

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyline.llm import bpe
from storyline.llm.packing import TOKENIZER, tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(TOKENIZER))


ODD = [
    None, "", " ", "\n\n  \t x", "it's we'll 'S !'s a''ll '", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftex", "é 漢字漢字。🙂🙂👩‍👩‍👧 ́ ​ x\x85y\xa0z", "a" * 5000, " " * 5000 + "x", "\n" * 3000,
    "qzxj" * 700, "漢" * 3000, "🙂" * 900, "1234567890" * 300, "\x00\x01\x7f�\U0010ffff", "Ünïcödé ǅ ⅷ ½ ٣ ㊿", "x\x1cy\x1d z\x1e\x1f", "word " * 120000, "wo-rd" * 120000, "ab1 " * 90000 + "é's",
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


def test_against_the_library(spark, documents, library):
    rows = [*enumerate(ODD), (None, "no identifier"), (None, None), (3, ODD[3]), (3, "another text")]
    got = bpe.encode_documents(spark, documents(rows, extra=True).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(library, rows)
    assert bpe.encode_documents(spark, documents([])).collect() == []


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = bpe.encode_documents(spark, docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(library, [(r.doc_id, r.text) for r in docs.collect()])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abeq zx'stl1 \n\t-_é漢🙂́<|endoftext>", max_size=200)))
def test_any_text(library, text):
    codec = bpe.Codec.of(TOKENIZER)
    ids = codec.encode(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50260), max_size=30))
def test_decoding_of_any_ids(library, ids):
    assert bpe.Codec.of(TOKENIZER).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_certain(library):
    """No token has a cut within; and cuts shorten what is merged at once, which words alone don't."""
    codec = bpe.Codec.of(TOKENIZER)
    for token in random.Random(1).sample(sorted(library.get_vocab(with_added_tokens=False)), 3000):
        b = codec.bytes_of[library.token_to_id(token)]
        assert not any(codec.never[x << 8 | y] for x, y in zip(b, b[1:], strict=False))
    codec.pieces.clear()
    codec.known.clear()
    codec.encode("qzxj" * 700)
    assert codec.pieces and max(map(len, codec.pieces)) < 16


def test_bounded_memory(library, monkeypatch):
    codec = bpe.Codec(tokenizer_path(TOKENIZER))
    monkeypatch.setattr(bpe, "KEPT", 50)
    monkeypatch.setattr(bpe, "BLOCK", 100)
    text = " ".join(f"w{k}x é{k}" for k in range(3000))
    assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(codec.known) < 200
    assert [*codec.blocks("ab cd " * 60)] != ["ab cd " * 60] and "".join(codec.blocks("ab cd " * 60)) == "ab cd " * 60


def test_blocks_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 37)
    codec = bpe.Codec(tokenizer_path(TOKENIZER))
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choices(["a", "B1", " ", "  ", "\n", "'s", "é", "漢", "!", " the", "\t "], k=300))
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_characters_classed_otherwise_go_by_the_library(library, monkeypatch):
    import regex

    monkeypatch.setattr(bpe, "PATTERN", regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?\p{N}+| ?[^\sA-Za-z\p{N}]+|\s+(?!\S)|\s+"))
    codec = bpe.Codec(tokenizer_path(TOKENIZER))
    assert codec.encode("naïve café, ok").tolist() == library.encode("naïve café, ok", add_special_tokens=False).ids
    assert codec.different == {"ï", "é"}


def test_columns(spark, library):
    frame = spark.createDataFrame([(1, "two words"), (2, None)], "a int, text string").withColumn("ids", bpe.encode(F.col("text")))
    got = {r.a: (r.ids, r.back) for r in frame.withColumn("back", bpe.decode(F.col("ids"))).collect()}
    assert got == {1: (library.encode("two words").ids, "two words"), 2: ([], "")}


def test_other_files_are_an_error(tmp_path):
    with open(tokenizer_path(TOKENIZER), encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.Codec(str(tmp_path / "t.json"))
