"""Entries carry whole descriptions and several aliases a row."""

from __future__ import annotations

from storyline.plans.registry import QUERIES


def test_whole_texts_and_several_aliases(spark, tmp_path):
    long = "Ann the old friend of Bob who came by every evening"
    turns = [(1, 0, "user", long), (1, 1, "user", "Annie Ann user"), (1, 2, "system", None), (2, 0, "user", " short ")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.chapter, r.name): (r.aliases, r.description) for r in QUERIES["whole_entries"](spark, str(tmp_path)).collect()}
    assert got == {(1, "user"): (",".join(sorted({*long.split(), "Annie"})), long), (1, "system"): ("", ""), (2, "user"): ("short", "short")}
