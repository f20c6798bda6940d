"""Render planning: voices, cache keys, what is still to do, and batches of like length within two budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.folds import greedy_runs
from ..functions.hashing import params_json, render_key
from ..functions.ranks import positions_within
from ..functions.text import chunks, sequence_cost
from ..sources.shared import written

NO_LIMIT = 1 << 62


def voice_key(role: Column, style: Column) -> Column:
    return F.when(style.isNotNull() & (style != fixed.NEUTRAL), F.concat(role, F.lit("@"), style)).otherwise(role)


def split_key(key: Column) -> tuple[Column, Column]:
    """Role and style of a key of the voice map; the style is what follows the last @."""
    styled = key.contains("@")
    return F.when(styled, F.regexp_extract(key, "(?s)^(.*)@([^@]*)$", 1)).otherwise(key), F.when(styled, F.regexp_extract(key, "(?s)^(.*)@([^@]*)$", 2))


def style_phrase(style: str, lang: str) -> str:
    known = fixed.STYLES.get(style)
    return known.get(lang, known["en"]) if known else style


def resolve_voice(voices: dict[str, str], speaker: Column, style: Column) -> Column:
    """The voice of a speaker in a style: styled, plain, styled default, default, narrator; an error if there is none of these."""
    if not voices:
        return F.raise_error(F.lit("the voice map is empty"))
    known = F.create_map(*(F.lit(x) for kv in voices.items() for x in kv))
    tries = [F.try_element_at(known, key) for role in (speaker, F.lit("_default")) for key in (voice_key(role, style), role)]
    last = F.lit(voices["narrator"]) if "narrator" in voices else F.raise_error(F.concat(F.lit("no voice for "), speaker)).cast("string")
    return F.coalesce(*tries, last)


def voice_fingerprints(voices: dict[str, str], clip_hashes: dict[str, str]) -> dict[str, str]:
    """Voices whose identity changes with the clip behind them."""
    return {role: f"{voice}#{clip_hashes[voice]}" if voice in clip_hashes else voice for role, voice in voices.items()}


def plan(lines: DataFrame, state: DataFrame, inventory: DataFrame, voices: dict[str, str], backend: str, params: dict, max_chars: int, lang: str = "en", fingerprints: dict[str, str] | None = None, force: bool = False) -> DataFrame:
    """Each line with voice, expected audio and, where that isn't there yet, its chunks. state has (id, audio, attempts), inventory (audio).

    A line whose expected audio isn't the one it has starts its attempts over, which may change the expected audio once more.
    """
    rows = lines.join(state.select("id", F.col("audio").alias("had"), "attempts"), "id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    voice, identity = (resolve_voice(v, F.col("speaker"), F.col("style")) for v in (voices, fingerprints or voices))
    expected = lambda seed: F.concat(F.lit("05-audio/"), render_key(backend, F.col("identity"), params, seed, F.col("text")), F.lit(".wav"))
    rows = rows.withColumn("voice", voice).withColumn("identity", identity).withColumn("audio", expected(F.col("attempts")))
    moved = F.col("had").isNotNull() & (F.col("had") != F.col("audio"))
    rows = rows.withColumn("attempts", F.when(moved, 0).otherwise(F.col("attempts"))).withColumn("audio", F.when(moved, expected(F.lit(0))).otherwise(F.col("audio")))
    there = inventory.select(F.col("audio").alias("file")).distinct()
    rows = rows.join(there, rows["audio"] == there["file"], "left")
    todo = F.lit(True) if force else F.col("file").isNull()
    return rows.withColumn("params", params_json(params, F.col("attempts"))).withColumn("chunks", F.when(todo, chunks(F.col("text"), lang, max_chars))).drop("file", "identity")


def batch_size(configured: int | None, default: int, batched: bool) -> int:
    return (configured or default) if batched else 1


def batches(jobs: DataFrame, size: int, tokens: int = 8000, lang: str = "en") -> DataFrame:
    """(voice, params, batch, place, id, chunk_idx, chunk): chunks of one voice and parameters, shortest first, cut at `size` chunks or
    where their cost passes `tokens` (0: no limit).

    A chunk's cost follows from its length, so the cuts of a voice follow from how many chunks it has of each length: only these counts meet in
    one row, and a chunk's batch is arithmetic on its place among its voice's. Places come from sorted ranges of all chunks and how many these
    hold, so a voice's chunks, or those of one length, are spread over tasks however many there are; chunks and ranges are written once.
    """
    items = jobs.where(F.col("chunks").isNotNull()).select("voice", "params", "id", F.posexplode("chunks").alias("chunk_idx", "chunk"))
    items = written(items.withColumn("chars", F.length("chunk")).withColumn("cost", sequence_cost(F.col("chunk"), lang)), "chunks")  # counted, sampled and sorted
    counts = items.groupBy("voice", "params", "chars", "cost").agg(F.count(F.lit(1)).alias("n"))
    lengths = counts.groupBy("voice", "params").agg(F.array_sort(F.collect_list(F.struct("chars", "cost", "n"))).alias("lengths"))
    cuts = lengths.select("voice", "params", F.explode(greedy_runs(F.col("lengths"), size, tokens or NO_LIMIT)).alias("c")).select("voice", "params", "c.*")
    placed = positions_within(items, ["voice", "params"], [F.col("chars"), F.col("id"), F.col("chunk_idx")], lambda df: written(df, "batches"), "place").join(cuts, ["voice", "params", "chars"])
    rank = F.col("place") - F.col("before")
    batch = F.when(rank < F.col("room"), F.col("group")).otherwise(F.col("group") + 1 + F.floor((rank - F.col("room")) / F.col("per")))
    return placed.select("id", "chunk_idx", "voice", "params", batch.alias("batch"), "place", "chunk", "cost")


def reassembled(pieces: DataFrame) -> DataFrame:
    """(id, pieces): the pieces (id, chunk_idx, audio) of each line by chunk number, whatever batch they came from."""
    return pieces.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "audio"))), lambda x: x["audio"]).alias("pieces"))


def with_style_keys(roles: Sequence[str], styles: Sequence[str]) -> list[str]:
    return [key for r in roles for key in ([r] if r == "narrator" else [r, *(f"{r}@{s}" for s in styles)])]
