"""Provenance: what each artifact was built from, why it is stale, status of chapters and stages, the script view, and hand fixes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.hashing import content_hash, json_array, json_map

STAGES = ["attribute", "render", "verify", "build"]


def inputs(**named: Column | str) -> Column:
    """Named inputs as a map of strings."""
    return F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(v))))


def ingest_inputs(source: Column, lang: str, pattern: str | None = None, rules: int = 1) -> Column:
    return inputs(source=content_hash(source), language=lang, chapter_regex=pattern or "", rules=str(rules))


def attribute_inputs(title: Column, paragraphs: Column, lang: str, cast: str, styles: list[str]) -> Column:
    return inputs(chapter=content_hash(title, json_array(paragraphs)), language=lang, cast=cast, styles=",".join(styles))


def normalize_inputs(chapters: Column, lang: str, overrides: str, rules: int = 2) -> Column:
    return inputs(chapters=chapters, language=lang, overrides=overrides, rules=str(rules))


def verify_inputs(render_hash: Column, transcriber: str, threshold: float) -> Column:
    return inputs(render=render_hash, transcriber=transcriber, threshold=str(threshold))


def build_inputs(render_hash: Column, pauses: str) -> Column:
    return inputs(render=render_hash, pauses=pauses)


def render_inputs(lines_hash: Column, backend: str, voices: Column, params: str) -> Column:
    return inputs(lines=lines_hash, backend=backend, voices=content_hash(json_map(voices)), params=params)


def stale_reasons(current: Column, stamp: Column, exists: Column) -> Column:
    """Array of reasons, empty if fresh. current and stamp are maps; a null stamp is one that can't be read as named inputs."""
    differ = F.filter(F.map_keys(current), lambda k: ~F.try_element_at(current, k).eqNullSafe(F.try_element_at(stamp, k)))
    other = F.map_entries(current) != F.map_entries(stamp)
    known = F.when(F.size(differ) > 0, differ).when((F.size(current) != F.size(stamp)) & other, F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>"))
    return F.when(~exists, F.array(F.lit("missing"))).when(stamp.isNull(), F.array(F.lit("no stamp"))).otherwise(known)


def with_reasons(current: DataFrame, stamps: DataFrame, keys: list[str]) -> DataFrame:
    """current (keys, inputs) with `reasons`; stamps has (keys, inputs) of the artifacts that exist."""
    old = stamps.select(*keys, F.col("inputs").alias("stamp"), F.lit(True).alias("there"))
    rows = current.join(old, keys, "left")
    return rows.withColumn("reasons", stale_reasons(F.col("inputs"), F.col("stamp"), F.coalesce("there", F.lit(False)))).drop("stamp", "there")


def render_reasons(reasons: DataFrame, lines: DataFrame, state: DataFrame, inventory: DataFrame) -> DataFrame:
    """Chapters (chapter, reasons) where a chapter that its stamp calls fresh is stale too if lines have no audio."""
    there = state.where(F.col("audio").isNotNull()).join(inventory.select("audio").distinct(), "audio", "left_semi").select("id")
    without = lines.join(there, "id", "left_anti").groupBy("chapter").agg(F.count(F.lit(1)).alias("n"))
    rows = reasons.join(without, "chapter", "left")
    extra = F.when((F.size("reasons") == 0) & F.col("n").isNotNull(), F.array(F.concat(F.col("n").cast("string"), F.lit(" lines without audio"))))
    return rows.withColumn("reasons", F.coalesce(extra, F.col("reasons"))).drop("n")


def state_of(reasons: Column) -> Column:
    return F.when(F.size(reasons) == 0, "fresh").when(F.array_contains(reasons, "missing"), "missing").otherwise("stale")


def chapter_grid(chapters: DataFrame, states: DataFrame) -> DataFrame:
    """chapters (chapter, ...) with a column per stage: fresh, stale or missing; states has (chapter, stage, reasons)."""
    pivot = states.groupBy("chapter").pivot("stage", STAGES).agg(F.first(state_of(F.col("reasons"))))
    return chapters.join(pivot, "chapter", "left").na.fill("missing", STAGES)


def progress(lines: DataFrame, state: DataFrame, inventory: DataFrame, results: DataFrame) -> DataFrame:
    """(chapter, lines, rendered, verified): how many lines a chapter has, and how many of them have audio that is there, and a result."""
    there = state.where(F.col("audio").isNotNull()).join(inventory.select("audio").distinct(), "audio", "left_semi").select("id", F.lit(1).alias("done"))
    heard = results.select("id", F.lit(1).alias("heard")).distinct()
    rows = lines.select("chapter", "id").join(there, "id", "left").join(heard, "id", "left")
    return rows.groupBy("chapter").agg(F.count(F.lit(1)).alias("lines"), F.count("done").alias("rendered"), F.count("heard").alias("verified"))


def stage_status(states: DataFrame) -> DataFrame:
    """(stage, status, detail, reasons) over all chapters of each stage."""
    state = state_of(F.col("reasons"))
    out = states.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(state == "missing").alias("missing"), F.count_if(state == "fresh").alias("fresh"), F.count_if(state == "stale").alias("stale"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(state == "stale", F.col("reasons")))))).alias("why"))
    status = F.when(F.col("missing") == F.col("n"), "missing").when(F.col("fresh") == F.col("n"), "fresh").when((F.col("fresh") > 0) | (F.col("stale") > 0), "stale").otherwise("missing")
    return out.select("stage", status.alias("status"), F.concat(F.col("fresh").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" chapters fresh")).alias("detail"), F.substring(F.array_join("why", ", "), 1, 60).alias("reasons"))


def line_details(lines: DataFrame, results: DataFrame) -> DataFrame:
    """Counts over all lines, and the mean error as it is (not cut at 1, unlike the summary of verification)."""
    talk = F.col("kind") == "dialogue"
    counts = lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(talk).alias("dialogue"), F.count_if(talk & (F.col("confidence") < fixed.RULES)).alias("low_confidence"), F.count_if(F.col("speaker") == "unknown").alias("unknown"))
    return counts.crossJoin(results.agg(F.avg("error_rate").alias("mean_error"), F.count_if(~F.col("ok")).alias("failed")))  # one row each


def marks(failed: Column) -> Column:
    unknown, doubtful = F.col("speaker") == "unknown", (F.col("kind") == "dialogue") & (F.col("confidence") < fixed.RULES)
    found = F.array(
        F.when(unknown, "(!)").when(doubtful, "(?)"),
        F.when(failed, "[x]"),
        F.when(F.col("locked"), "[lock]"),
        F.when(F.col("style").isNotNull(), F.concat(F.lit("{"), F.col("style"), F.lit("}"))),
    )
    return F.array_join(F.array_compact(found), " ")


def script(lines: DataFrame, failures: DataFrame) -> DataFrame:
    """(chapter, id, line): lines as a screenplay with markers; failures has (id)."""
    rows = lines.join(failures.select("id", F.lit(True).alias("bad")).distinct(), "id", "left")
    sign = marks(F.coalesce("bad", F.lit(False)))
    who = F.when(F.col("kind") == "narration", "narrator").otherwise(F.col("speaker"))
    text = F.concat(F.lit("`"), F.col("id"), F.lit("` **"), who, F.lit("**"), F.when(sign != "", F.concat(F.lit(" "), sign)).otherwise(""), F.lit(": "), F.col("text"))
    return rows.select("chapter", "id", text.alias("line"))


def speakers(lines: DataFrame) -> DataFrame:
    """(speaker, lines, first): most lines first; of equal ones the speaker first seen."""
    return lines.groupBy("speaker").agg(F.count(F.lit(1)).alias("lines"), F.min("id").alias("first")).orderBy(F.col("lines").desc(), "first")


def fix_lines(lines: DataFrame, edits: DataFrame, styles: list[str] | None = None) -> DataFrame:
    """lines with hand edits (id, speaker, text, style, unlock) merged in; null edits nothing. An edited line is certain and locked. The
    narrator narrates and all others speak; the neutral style clears the style."""
    allowed = [*(styles if styles is not None else fixed.STYLES), fixed.NEUTRAL]
    e = edits.select("id", F.struct("speaker", "text", "style", "unlock").alias("e"))
    rows = lines.join(e, "id", "left")
    new = F.col("e")
    checked = F.when(new["style"].isNull() | new["style"].isin(allowed), new["style"]).otherwise(F.raise_error(F.concat(F.lit("no such style: "), new["style"])).cast("string"))
    speaker = F.coalesce(new["speaker"], F.col("speaker"))
    values = {
        "kind": F.when(new["speaker"].isNull(), F.col("kind")).when(new["speaker"] == "narrator", "narration").otherwise("dialogue"),
        "speaker": speaker,
        "text": F.coalesce(new["text"], F.col("text")),
        "style": F.when(checked == fixed.NEUTRAL, F.lit(None)).otherwise(F.coalesce(checked, F.col("style"))),
        "confidence": F.when(new.isNotNull(), 1.0).otherwise(F.col("confidence")),
        "locked": F.when(new.isNull(), F.col("locked")).otherwise(~F.coalesce(new["unlock"], F.lit(False))),
    }
    return rows.select(*(values.get(c, F.col(c)).alias(c) for c in lines.columns))


def without_fixed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Render or verify rows that edits leave valid."""
    return rows.join(edits.select("id"), "id", "left_anti")


def chapter_set(spec: str) -> set[int]:
    """`3`, `0,4` and `2-5` as chapter numbers."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        found = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not found:
            raise ValueError(f"not a chapter or range: {part!r}")
        out |= set(range(int(found[1]), int(found[2] or found[1]) + 1))
    return out


def audio_of(state: DataFrame, line: str) -> DataFrame:
    return state.where(F.col("id") == line).select("id", "audio")


def backend_name(registered: str) -> str | None:
    return fixed.BACKEND_NAMES.get(registered)


def report(title: str, stages: DataFrame, grid: DataFrame, lines: DataFrame, failures: DataFrame, log: list[str]) -> str:
    """A book's status as Markdown. The tables are a book's stages, chapters and speakers; all lines to look at are listed, a partition at a time."""
    out = [f"# {title}", "", "| stage | status | detail | reasons |", "|---|---|---|---|"]
    out += [f"| {r['stage']} | {r['status']} | {r['detail']} | {r['reasons']} |" for r in stages.collect()]
    counts = [c for c in ("lines", "rendered", "verified") if c in grid.columns]
    out += ["", "| chapter | " + " | ".join([*STAGES, *counts]) + " |", "|---" * (len(STAGES) + len(counts) + 1) + "|"]
    out += [f"| {r['chapter']} | " + " | ".join([*(r[s] for s in STAGES), *(str(r[c]) for c in counts)]) + " |" for r in grid.orderBy("chapter").collect()]
    out += ["", "## Speakers", ""] + [f"- {r['speaker']}: {r['lines']}" for r in speakers(lines).collect()]
    doubtful = lines.where((F.col("kind") == "dialogue") & (F.col("confidence") < fixed.RULES)).orderBy("id")
    out += ["", "## To review", ""] + [f"- `{r['id']}` {r['speaker']} ({r['confidence']:.2f}): {r['text'][:100]}" for r in doubtful.toLocalIterator()]
    bad = failures.orderBy(F.col("error_rate").desc(), "id")
    out += ["", "## Failed verification", ""] + [f"- `{r['id']}` {r['error_rate']:.2f}: {r['transcript'][:100]}" for r in bad.toLocalIterator()]
    return "\n".join([*out, "", "## Log", "", *log[-25:], ""])
