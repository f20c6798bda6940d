"""Verification: transcripts against texts by edit distance over tokens, verdicts, retries, and segments assigned to clips."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import chars_per_s, replace_matches, strip, zh_number

COMPARED = ["edits", "reference", "hypothesis", "kinds"]
#: Rows of an Arrow batch that are Python strings at once.
STEP_ROWS = 256


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Some rows at a time are Python strings, as with `compared`; neither needs pandas, whose import each worker would hold."""
    slices = (texts.slice(k, STEP_ROWS).to_pylist() for k in range(0, max(1, len(texts)), STEP_ROWS))
    return pa.concat_arrays([pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in some], pa.string()) for some in slices])


def compatible(text: Column) -> Column:
    """Compatibility forms made alike (NFKC). ASCII texts have none, and Python gets nothing of them."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def pronunciation(table: dict[str, str]) -> Callable[[Column], Column]:
    """A table from Han character to toneless syllable, for `syllable`: characters go to the first one of their syllable, and those few to
    it. Others have none."""
    table = {character: "".join(syllable.split()) for character, syllable in table.items()}
    first: dict[str, str] = {}
    for character, syllable in table.items():
        first.setdefault(syllable, character)
    characters, firsts = "".join(table), "".join(first[s] for s in table.values())
    known = F.create_map(*(F.lit(x) for syllable, character in first.items() for x in (character, syllable)))
    return lambda c: F.try_element_at(known, F.translate(c, characters, firsts))


def spaced(text: Column, lang: str = "en", syllable: Callable[[Column], Column] | None = None) -> Column:
    """Tokens to compare, of compatible forms, with white space between them. English: words without punctuation. Chinese: digits in words,
    then each Han character (by `syllable`, if there is a pronunciation table) and other runs whole."""
    if lang == "zh":
        return F.array_join(tokens(text, lang, syllable), " ")
    return F.regexp_replace(F.lower(compatible(text)), r"(?U)[^\w\s]+", "")


def tokens(text: Column, lang: str = "en", syllable: Callable[[Column], Column] | None = None) -> Column:
    """The same as an array."""
    if lang != "zh":
        return F.filter(F.split(strip(spaced(text, lang)), r"(?U)\s+", -1), lambda t: t != "")
    text = F.regexp_replace(replace_matches(F.lower(compatible(text)), "[0-9]+", zh_number), r"(?U)[^\w\s]", "")
    found = F.regexp_extract_all(text, F.lit(r"(?U)[一-鿿]|[^一-鿿\s]+"), F.lit(0))
    return F.transform(found, lambda t: F.coalesce(syllable(t), t)) if syllable else found


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Fewest insertions, deletions and substitutions, by bit vectors of any length.

    Down a column of the table neighbours differ by one at most, so a column is two sets of rows as bits of an integer: where the distance
    grows from the row before, and where it falls. One step to the next column is a few operations on whole integers (an addition carries
    along runs of equal tokens), whatever the number of rows; the last row's distance is kept by its own bit.
    """
    a, b = list(a), list(b)
    first = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[first:], b[first:]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    rows_of: dict[object, int] = {}
    for k, token in enumerate(a):
        rows_of[token] = rows_of.get(token, 0) | 1 << k
    every, last, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    grows, falls = every, 0
    for token in b:
        same = rows_of.get(token, 0)
        along = (((same & grows) + grows) ^ grows) | same  # rows whose diagonal step costs nothing, by a run that the carry extends
        more, less = (falls | ~(along | grows)) & every, grows & along  # against the column before
        distance += bool(more & last) - bool(less & last)
        more, less = more << 1 | 1, less << 1
        either = same | falls
        grows, falls = (less | ~(either | more)) & every, more & either & every
    return distance


@F.arrow_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in COMPARED]))
def compared(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Distance of two texts' tokens, which white space separates, how many each has, and how many different ones the first. Texts come as
    they lie in Arrow and are split here, since an array of strings costs the JVM more than the rest of the comparison. One pair at a time
    is Python strings."""
    found = []
    for a, b in zip(reference, hypothesis, strict=True):
        x, y = (a.as_py() or "").split(), (b.as_py() or "").split()
        found.append((edit_distance(x, y), len(x), len(y), len(set(x))))
    columns = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], COMPARED)


def error_rate(edits: Column, reference: Column, hypothesis: Column) -> Column:
    """Edits by the number of reference tokens; without any, 0 if there is nothing to compare and 1 otherwise. May exceed 1."""
    return F.when(reference > 0, edits / reference).when(hypothesis > 0, 1.0).otherwise(0.0)


def few(n: Column, kinds: Column) -> Column:
    """Whether a text is a few syllables, or one or two again and again: too little for a transcript to say anything about."""
    return (n <= 4) | (kinds <= 2)


def compare(pairs: DataFrame, lang: str = "en", reference: str = "text", hypothesis: str = "transcript", syllable: Callable[[Column], Column] | None = None, short: str | None = None) -> DataFrame:
    """pairs with edits and error_rate, and in column `short`, if asked for, whether the reference has few tokens."""
    rows = pairs.withColumn("_c", compared(spaced(F.col(reference), lang, syllable), spaced(F.col(hypothesis), lang, syllable)))
    rows = rows.withColumn("edits", F.col("_c.edits")).withColumn("error_rate", error_rate(F.col("_c.edits"), F.col("_c.reference"), F.col("_c.hypothesis")))
    return (rows.withColumn(short, few(F.col("_c.reference"), F.col("_c.kinds"))) if short else rows).drop("_c")


def judge(text: Column, rate: Column, edits: Column, duration: Column, lang: str = "en", threshold: float = 0.15, syllable: Callable[[Column], Column] | None = None, short: Column | None = None) -> Column:
    """Whether audio is acceptable: never if far too long; always if the text has few tokens (`short`, where that is known already); else by
    error rate, or a single edit."""
    runaway = duration > 3 * (F.length(text) / chars_per_s(lang)) + 3
    if short is None:
        words = tokens(text, lang, syllable)
        short = few(F.size(words), F.size(F.array_distinct(words)))
    return F.when(runaway, False).when(short, True).otherwise((rate <= threshold) | (edits <= 1))


def pending(state: DataFrame, results: DataFrame) -> DataFrame:
    """Lines (id, audio, ...) with audio that has no result of its own yet."""
    return state.where(F.col("audio").isNotNull()).join(results.select("id", "audio"), ["id", "audio"], "left_anti")


def current(state: DataFrame, results: DataFrame) -> DataFrame:
    """Results that belong to the audio a line has now."""
    return results.join(state.where(F.col("audio").isNotNull()).select("id", "audio"), ["id", "audio"], "left_semi")


def failures(state: DataFrame, results: DataFrame) -> DataFrame:
    return current(state, results).where(~F.col("ok"))


def retry(state: DataFrame, results: DataFrame, max_attempts: int = 3) -> DataFrame:
    """state (id, audio, attempts, ...) after a pass: a line that failed and has attempts left loses its audio and counts one more."""
    bad = failures(state, results).select("id", F.lit(True).alias("bad")).distinct()
    rows = state.join(bad, "id", "left")
    again = F.coalesce("bad", F.lit(False)) & (F.col("attempts") + 1 < max_attempts)
    return rows.withColumn("audio", F.when(again, F.lit(None)).otherwise(F.col("audio"))).withColumn("attempts", F.when(again, F.col("attempts") + 1).otherwise(F.col("attempts"))).drop("bad")


def verify_until_done(state: DataFrame, render: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], max_attempts: int = 3, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """At most max_attempts passes of check and render over lines that failed. `keep` writes a table and reads it again, so that a pass
    doesn't recompute the ones before."""
    keep = keep or (lambda df, name: df)
    results = keep(check(state.where(F.col("audio").isNotNull())), "results0")
    for n in range(1, max_attempts):
        after = keep(retry(state, results, max_attempts), f"failed{n}")
        if after.where(F.col("audio").isNull()).isEmpty():
            break
        state = keep(render(after), f"state{n}")
        old = current(state, results)
        results = keep(old.unionByName(check(pending(state, results))), f"results{n}")
    return state, results


def summary(state: DataFrame, results: DataFrame) -> DataFrame:
    """Over results of current audio: how many, their mean error with each at most 1, and how many failed."""
    now = current(state, results)
    return now.agg(F.count(F.lit(1)).alias("checked"), F.avg(F.least("error_rate", F.lit(1.0))).alias("mean_error"), F.count_if(~F.col("ok")).alias("failed"))


def fixed_groups(rows: DataFrame, order: str, size: int, by: str) -> DataFrame:
    """rows with `group`: consecutive groups of `size` within `by`."""
    place = F.row_number().over(W.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("group", F.floor(place / size).cast("int"))


def clips(audio: DataFrame, by: str = "group", order: str = "id", gap: float = fixed.CLIP_GAP_S) -> DataFrame:
    """audio (duration) with each clip's start and end in its group, laid end to end with gaps."""
    before = F.coalesce(F.sum(F.col("duration") + gap).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return audio.withColumn("start", F.round(before, 3)).withColumn("end", F.round(before + F.col("duration"), 3))


def goes_alone(duration: Column, group_size: Column) -> Column:
    return (duration > fixed.LONGEST_CLIP_S) | (group_size == 1)


def heard_in_groups(audio: DataFrame, size: int, together: Callable[[DataFrame], DataFrame], alone: Callable[[DataFrame], DataFrame], lang: str = "en") -> DataFrame:
    """(id, transcript) of audio (id, chapter, duration, samples), `size` lines of a chapter in one call.

    together gives segments (whose, start, text) of clips (whose, id, start, end, samples) that are laid end to end; each goes to the clip in
    which it starts. Clips that are too long, or left over in their group, go to alone, which gives (id, transcript). A clip in which nothing
    was heard has an empty transcript.
    """
    grouped = fixed_groups(audio, "id", size, "chapter").withColumn("whose", F.concat_ws("/", F.col("chapter").cast("string"), F.col("group").cast("string")))
    short = F.count_if(F.col("duration") <= fixed.LONGEST_CLIP_S).over(W.partitionBy("whose"))
    marked = grouped.withColumn("single", goes_alone(F.col("duration"), short))
    laid = clips(marked.where(~F.col("single")), by="whose")
    found = segments_to_clips(together(laid), laid, by="whose", lang=lang)
    quiet = laid.select("id").join(found.select("id", "transcript"), "id", "left").select("id", F.coalesce("transcript", F.lit("")).alias("transcript"))
    return quiet.unionByName(alone(marked.where("single")).select("id", "transcript"))


def segments_to_clips(segments: DataFrame, clips: DataFrame, by: str = "group", lang: str = "en") -> DataFrame:
    """(by, id, transcript): segments (start, text) go to the last clip that starts by then, or the first. One sort of both together: a
    segment takes the last clip before it, so no pair of a segment and a clip is made but the right one."""
    both = clips.select(by, F.col("start").alias("at"), F.lit(0).alias("kind"), "id", F.lit(None).cast("string").alias("text"))
    both = both.unionByName(segments.select(by, (F.col("start") + 1e-3).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(clips.schema["id"].dataType).alias("id"), "text"))
    w = W.partitionBy(by).orderBy("at", "kind")
    owner = F.coalesce(F.last("id", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first("id", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    owned = both.withColumn("id", owner).where("kind = 1")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"] if lang == "zh" else strip(s["text"]))
    return owned.groupBy(by, "id").agg(F.array_join(texts, "" if lang == "zh" else " ").alias("transcript"))


