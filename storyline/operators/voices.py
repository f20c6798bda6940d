"""Voices: profiles from descriptions, assignment, checks of the voice map, and plans for designed voices.

Casts, pools and voice maps are configuration of a book, so assignment and checks are plain functions; profiles and samples are columns.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.folds import sample_passage
from ..functions.text import role_slug, strip
from .cast import Character, alias_map, folded
from .planning import style_phrase

Voice = tuple[str, str, str, str, bool]
#: Roles of the voice map that need no character.
ROLES = ("narrator", "_default")
CLIP_BACKENDS = ("qwen3tts", "chatterbox")


def gender(description: Column) -> Column:
    d = F.coalesce(description, F.lit(""))
    explicit = d.rlike(fixed.FEMALE), d.rlike(fixed.MALE)
    related = d.rlike(fixed.FEMALE_RELATION), d.rlike(fixed.MALE_RELATION)
    one = lambda f, m, other: F.when(f & ~m, "f").when(m & ~f, "m").otherwise(other)
    return one(*explicit, one(*related, F.lit("?")))


def age(description: Column) -> Column:
    out = F.lit("?")
    for name, pattern in reversed(fixed.AGES):
        out = F.when(F.coalesce(description, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def profiles(spark: SparkSession, cast: Sequence[Character]) -> dict[str, tuple[str, str]]:
    """(gender, age) by name, for a cast."""
    rows = spark.createDataFrame([(c.name, c.description) for c in cast], "name string, description string")
    return {r["name"]: (r["gender"], r["age"]) for r in rows.select("name", gender(F.col("description")).alias("gender"), age(F.col("description")).alias("age")).collect()}


def pool(backend: str, lang: str) -> list[Voice]:
    return [v for v in fixed.VOICES.get(backend, []) if v[1] == lang]


def pool_table(spark: SparkSession) -> DataFrame:
    rows = [(b, k, *v) for b, voices in fixed.VOICES.items() for k, v in enumerate(voices)]
    return spark.createDataFrame(rows, "backend string, pos int, id string, lang string, gender string, age string, narrator boolean")


def narrowed(candidates: Sequence[Voice], *wishes: Callable[[Voice], bool]) -> Sequence[Voice]:
    """The candidates that meet each wish in turn; a wish that none of those left meets is passed over."""
    for wish in wishes:
        candidates = [v for v in candidates if wish(v)] or candidates
    return candidates


def choose(pool: Sequence[Voice], wanted: tuple[str, str], uses: Counter[str], narrator: str) -> str:
    """The voice for a wanted gender and age: of a fitting gender if there is one, among those the least used, then by age, then not the
    narrator's, then by place in the pool."""
    sex, years = wanted
    left = narrowed(pool, lambda v: sex in ("?", v[2]))
    least = min(uses[v[0]] for v in left)
    return narrowed(left, lambda v: uses[v[0]] == least, lambda v: years in ("?", v[3]), lambda v: v[0] != narrator)[0][0]


def assign(people: Sequence[tuple[str, tuple[str, str]]], voices: Sequence[Voice], existing: dict[str, str] | None = None) -> dict[str, str]:
    """Role to voice for (name, profile) in order of importance. As use counts, each choice depends on those before."""
    chosen = dict(existing or {})
    chosen.setdefault("narrator", narrowed(voices, lambda v: v[4])[0][0])
    uses = Counter(chosen.values())
    for name, wanted in people:
        if name not in chosen:
            chosen[name] = choose(voices, wanted, uses, chosen["narrator"])
            uses[chosen[name]] += 1
    return chosen if "_default" in chosen else chosen | {"_default": chosen["narrator"]}


ASSIGNED = "book string, role string, voice string"


def assigned(roles: DataFrame, voices: Sequence[Voice]) -> DataFrame:
    """(book, role, voice) for the roles (book, role, description, lines) of many books: profiles are columns, and books are folded in
    parallel, each over its roles as they come sorted, the most lines first. A task holds the voices in use of one book, and no role list."""
    wanted = roles.select("book", "role", gender(F.col("description")).alias("gender"), age(F.col("description")).alias("age"), "lines")
    ordered = wanted.repartition("book").sortWithinPartitions("book", F.desc("lines"), "role")
    narrator = narrowed(voices, lambda v: v[4])[0][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, uses, started = None, Counter(), False
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for r in batch.to_pylist():
                if not started or r["book"] != book:
                    book, uses, started = r["book"], Counter([narrator]), True
                    out += [(book, "narrator", narrator), (book, "_default", narrator)]
                voice = choose(voices, (r["gender"], r["age"]), uses, narrator)
                uses[voice] += 1
                out.append((book, r["role"], voice))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 3, ["book", "role", "voice"])

    return ordered.mapInArrow(run, ASSIGNED)


def closest(name: str, names: Sequence[str]) -> str | None:
    found = difflib.get_close_matches(name, names, n=1, cutoff=0.6)
    return found[0] if found else None


def is_clip(voice: str) -> bool:
    """Whether a voice is a recording and not one of a model's own."""
    return "/" in voice or voice.endswith(".wav")


def check(voices: dict[str, str], cast: Sequence[Character], backend: str, lang: str, styles: Sequence[str] = (), clips: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Errors and warnings of a voice map; clips are the paths that exist. A table of entries (key, role, style, voice) is joined with the
    cast's names, the backend's voices and the clips; what each join leaves without a partner is a finding."""
    entries = pd.DataFrame([(k, *(k.rsplit("@", 1) if "@" in k else (k, None)), v) for k, v in voices.items()], columns=["key", "role", "style", "voice"])
    entries["at"] = f"voices.{backend}." + entries["key"].astype(str)
    known = pd.DataFrame(list(alias_map(cast).items()), columns=["fold", "name"])
    presets = pd.DataFrame([(v[0], v[1]) for v in fixed.VOICES.get(backend, [])], columns=["voice", "speaks"])
    table = entries.assign(fold=entries["role"].map(folded)).merge(known, "left", on="fold").merge(presets, "left", on="voice")
    table["clip"] = table["voice"].map(is_clip).astype(bool) & (backend in CLIP_BACKENDS)
    needs = table[~table["role"].isin(ROLES)]
    names = [c.name for c in cast]

    def nobody(role: str) -> str:
        near = closest(role, names)
        return "nobody of the cast" + (f" (perhaps {near!r}?)" if near else "")

    preset = table[~table["clip"]] if backend in fixed.VOICES else table[:0]
    errors = [] if "narrator" in voices else [f"voices.{backend}: there is no narrator"]
    errors += [f"{r.at}: {nobody(r.role)}" for r in needs[needs["name"].isna()].itertuples()]
    errors += [f"{r.at}: no such clip: {r.voice}" for r in table[table["clip"] & ~table["voice"].isin(list(clips))].itertuples()]
    errors += [f"{r.at}: no such voice: {r.voice!r}" for r in preset[preset["speaks"].isna()].itertuples()]
    errors += [f"{r.at}: {r.voice!r} doesn't speak {lang}" for r in preset[preset["speaks"].notna() & (preset["speaks"] != lang)].itertuples()]
    warnings = [f"{r.at}: the book has no style {r.style!r}, so this clip is never used" for r in table[table["style"].notna() & ~table["style"].isin(list(styles))].itertuples()]
    warnings += [f"{r.at}: an alias of {r.name!r}; use that name" for r in needs[needs["name"].notna() & (needs["name"] != needs["role"])][["at", "name"]].itertuples(index=False)]
    silent = [c.name for c in cast if c.main and c.name not in voices]
    if silent:
        warnings.append(f"{len(silent)} of the main cast speak as _default: {', '.join(silent[:8])}" + (" ..." if len(silent) > 8 else ""))
    for voice, keys in needs.groupby("voice", sort=False)["key"]:
        if len(keys) > 1:
            warnings.append(f"{voice!r} is the voice of {', '.join(keys)}")
    return errors, warnings


def shared_voices(voice_map: DataFrame) -> DataFrame:
    """(backend, voice_id, roles) of voices that several roles of a map table (backend, role, voice_id) have."""
    named = voice_map.where(~F.col("role").isin(*ROLES))
    return named.groupBy("backend", "voice_id").agg(F.array_join(F.array_sort(F.collect_list("role")), ", ").alias("roles"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def sample_texts(lines: DataFrame, lang: str = "en", order: str = "id") -> DataFrame:
    """(speaker, sample): a passage of each speaker's own lines, whole ones in order; speakers with too little have none.

    The room in a passage only shrinks. So of a speaker's lines of one length the first that fit are the only ones that do, and no more can
    fit than fill the passage: a few hundred lines of all lengths, to which each task cuts its own before any line is moved.
    """
    joiner, most = "" if lang == "zh" else " ", fixed.SAMPLE_MOST[lang]
    size = F.length("piece")
    usable = lines.select("speaker", F.col(order).alias("place"), strip(F.col("text")).alias("piece")).withColumn("chars", size).where(F.col("chars").between(fixed.SAMPLE_PIECE, most))
    room = (most + len(joiner)) // (fixed.SAMPLE_PIECE + len(joiner))
    first = usable.withColumn("n", F.row_number().over(W.partitionBy("speaker", "chars").orderBy("place"))).where(F.col("n") <= room)
    first = first.where(F.col("n") <= F.floor((most + len(joiner)) / (F.col("chars") + len(joiner))))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"])
    passage = sample_passage(F.col("pieces"), joiner, most)
    return first.groupBy("speaker").agg(pieces.alias("pieces")).select("speaker", passage.alias("sample")).where(F.length("sample") >= fixed.SAMPLE_LEAST)


def design_plan(roles: DataFrame, samples: DataFrame, lang: str, styles: Sequence[str], default: str) -> DataFrame:
    """(key, path, text, instruct): one clip for each role (role, description), and one per style for all but the narrator."""
    between = "，" if lang == "zh" else ", "
    options = F.array(F.struct(F.lit(None).cast("string").alias("style"), F.lit(None).cast("string").alias("phrase")), *(F.struct(F.lit(s).alias("style"), F.lit(style_phrase(s, lang)).alias("phrase")) for s in styles))
    rows = roles.join(samples.withColumnRenamed("speaker", "role"), "role", "left").withColumn("o", F.explode(options))
    rows = rows.where((F.col("role") != "narrator") | F.col("o.style").isNull())
    plain = F.col("o.style").isNull()
    return rows.select(
        F.when(plain, F.col("role")).otherwise(F.concat(F.col("role"), F.lit("@"), F.col("o.style"))).alias("key"),
        F.concat(F.lit("voices/"), role_slug(F.col("role")), F.when(plain, "").otherwise(F.concat(F.lit("."), F.col("o.style"))), F.lit(".wav")).alias("path"),
        F.coalesce("sample", F.lit(default)).alias("text"),
        F.when(plain, F.col("description")).otherwise(F.concat(F.col("description"), F.lit(between), F.col("o.phrase"))).alias("instruct"),
    )


def voice_map_of(voices: dict, backend: str) -> dict[str, str]:
    """A backend's part of a voice map. Once any backend has a part of its own, entries beside it don't count."""
    if any(isinstance(v, dict) for v in voices.values()):
        if not isinstance(voices.get(backend), dict):
            raise KeyError(f"no voices for {backend!r}")
        return dict(voices[backend])
    return {k: v for k, v in voices.items() if isinstance(v, str)}


def with_voice_map(voices: dict, backend: str, new: dict[str, str], current: str) -> dict:
    """voices with a backend's map set; a flat map of before stays under the current backend."""
    nested = voices if any(isinstance(v, dict) for v in voices.values()) else ({current: voices} if voices else {})
    return {**nested, backend: new}


def missing_clips(plan: DataFrame, inventory: DataFrame, force: bool = False) -> DataFrame:
    """The part of a design plan whose clips aren't there; inventory has (path)."""
    return plan if force else plan.join(inventory.select("path"), "path", "left_anti")


def gate(errors: Sequence[str]) -> None:
    """Rendering doesn't start with a voice map that has errors."""
    if errors:
        raise ValueError("; ".join(errors))
