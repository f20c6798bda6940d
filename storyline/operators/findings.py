"""What is wrong or odd in the voice maps of many books: joins of their entries with casts, the models' voices and the clips that exist, and
for a role that nobody of the cast has, the nearest name.

Nearest is by difflib's ratio, as `difflib.get_close_matches(role, names, n=1)` has it. The ratio is 2M / (a + b), where the M matched
characters are a part of those that both strings have, each as often as in the one that has it less often. So a pair with 0.6 or more shares
3 (a + b) / 10 of them: its strings are at most 7 to 3 in length, and if the characters of each are put in one order, the rarest of the book
first, among the first 4/7 of both there is a common one. That makes the join; counts of characters in 32 buckets then reject most pairs in
the join's condition, and difflib sees what is left. No pair of ratio 0.6 is lost by any of these.

Defined cases: null is a book like others, and so is a null role or name in no pair at all. Repeated rows count once. The empty string is near
itself only. Characters are code points. A long string costs difflib its length squared at worst, and names are short.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold_name
from ..sources.shared import written
from .voices import CLIP_BACKENDS, ROLES

#: The least ratio, as a fraction.
NUMERATOR, DENOMINATOR = 6, 10
BUCKETS = 32
NEAREST = "book string, role string, name string, ratio double"


def matched(a: DataFrame, b: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """a joined with b where the columns are equal, null being equal to null; the columns are those of a."""
    other = b.select(*(F.col(c).alias(f"{c} of b") if c in columns else F.col(c) for c in b.columns))
    on = [F.col(c).eqNullSafe(F.col(f"{c} of b")) for c in columns]
    return a.join(other, on, how).drop(*(f"{c} of b" for c in columns))


def enough(shared: Column, a: Column, b: Column) -> Column:
    """Whether strings of lengths a and b with so many common characters can have the ratio."""
    return 2 * DENOMINATOR * shared >= NUMERATOR * (a + b)


def characters(strings: DataFrame) -> DataFrame:
    """(book, s, size, token, often, counts) for distinct strings (book, s): a row for each of the first characters of a string that any
    other must share one of, by rarity in the book. A token is a character and which of its kind in the string it is."""
    chars = F.when(F.col("s") == "", F.array(F.lit(""))).otherwise(F.split("s", ""))
    each = strings.select("book", "s", F.char_length("s").alias("size"), F.explode(chars).alias("c"))
    kinds = each.groupBy("book", "s", "size", "c").agg(F.count(F.lit(1)).cast("int").alias("k"))
    within = W.partitionBy("book", "s")
    bucket = F.pmod(F.xxhash64("c"), F.lit(BUCKETS)).cast("int")
    counted = kinds.withColumn("kinds", F.collect_list(F.struct(bucket.alias("bucket"), "k")).over(within))
    sums = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.aggregate(F.filter("kinds", lambda x: x["bucket"] == i), F.lit(0), lambda t, x: t + x["k"]))
    tokens = counted.select("book", "s", "size", sums.alias("counts"), "c", F.explode(F.sequence(F.lit(1), "k")).alias("i"))
    often = tokens.groupBy("book", "c", "i").agg(F.count(F.lit(1)).alias("often"))
    ranked = matched(tokens, often, "book", "c", "i").select("book", "s", "size", "counts", F.concat("i", F.lit(" "), "c").alias("token"), "often")
    # The shorter of two strings has at least r / (2 - r) of the longer one's length, and all that is shared.
    least = F.ceil(F.col("size") * NUMERATOR / (2 * DENOMINATOR - NUMERATOR))
    return ranked.withColumn("place", F.row_number().over(within.orderBy("often", "token"))).where(F.col("place") <= F.col("size") - least + 1).drop("place")


def candidates(roles: DataFrame, names: DataFrame, block: int) -> DataFrame:
    """(book, role, name) of roles (book, role) and names (book, name) that may have the ratio, each pair once. Names that share a token of a
    book are dealt over blocks of about `block`, each of which meets the roles with the token."""
    asked = roles.where("role IS NOT NULL").select("book", F.col("role").alias("s")).distinct().withColumn("asked", F.lit(True))
    listed = names.where("name IS NOT NULL").select("book", F.col("name").alias("s")).distinct().withColumn("asked", F.lit(False))
    sides = written(asked.unionByName(listed).groupBy("book", "s").agg(F.max("asked").alias("asked"), F.max(~F.col("asked")).alias("listed")), "strings")
    firsts = matched(characters(sides.select("book", "s")), sides, "book", "s")
    firsts = written(firsts.withColumn("tokens", F.collect_list("token").over(W.partitionBy("book", "s"))), "firsts")
    blocks = firsts.where("listed").groupBy("book", "token").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    held = matched(firsts, blocks, "book", "token")
    a = held.where("asked").select("book", "token", F.col("s").alias("role"), F.col("size").alias("a"), F.col("counts").alias("counts_a"), F.col("tokens").alias("tokens_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    b = held.where("listed").select("book", "token", F.col("s").alias("name"), F.col("size").alias("b"), F.col("counts").alias("counts_b"), F.col("tokens").alias("tokens_b"), F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int").alias("block"))
    shared = F.aggregate(F.zip_with("counts_a", "counts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    first = F.array_min(F.array_intersect("tokens_a", "tokens_b"))
    met = enough(F.least("a", "b"), F.col("a"), F.col("b")) & enough(shared, F.col("a"), F.col("b")) & (F.col("token") == first)
    return matched(a, b, "book", "token", "block").where(met).select("book", "role", "name")


def ratios(pairs: DataFrame) -> DataFrame:
    """(book, role, name, ratio) of pairs (book, role, name) with the ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, cutoff = difflib.SequenceMatcher(), NUMERATOR / DENOMINATOR
        for batch in batches:
            rows = []
            for book, role, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                matcher.set_seq1(name)
                if matcher.b != role:
                    matcher.set_seq2(role)
                if matcher.quick_ratio() >= cutoff and (found := matcher.ratio()) >= cutoff:
                    rows.append((book, role, name, found))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], ["book", "role", "name", "ratio"])

    return pairs.mapInArrow(run, NEAREST)


def nearest(roles: DataFrame, names: DataFrame, block: int = 4096) -> DataFrame:
    """(book, role, name, ratio): for each of roles (book, role) that has one, the nearest of its book's names (book, name), of equally near
    ones the last."""
    best = ratios(candidates(roles, names, block)).groupBy("book", "role").agg(F.max(F.struct("ratio", "name")).alias("best"))
    return best.select("book", "role", F.col("best.name").alias("name"), F.col("best.ratio").alias("ratio"))


def known_names(casts: DataFrame) -> DataFrame:
    """(book, fold, name): who has a folded name. Of several the first by rank, and there a name comes before aliases."""
    forms = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = casts.select("book", "name", "rank", F.posexplode(forms).alias("place", "form")).withColumn("fold", fold_name(F.col("form"))).where("fold <> ''")
    return each.groupBy("book", "fold").agg(F.min_by("name", F.struct("rank", "place")).alias("name"))


def findings(entries: DataFrame, casts: DataFrame, voices: DataFrame, clips: DataFrame, books: DataFrame) -> DataFrame:
    """(book, error, kind, key, voice, detail) for the voice maps `entries` (book, key, voice), a key being a role or role@style, of `books`
    (book, backend, lang, styles), of which there is a row each.

    `casts` is (book, rank, name, aliases, main), `voices` (backend, id, lang), `clips` (book, path). Kinds of errors: no narrator; nobody
    (detail: the nearest name); no clip; no voice; language (detail: the voice's). Kinds of warnings: style (detail: one the book doesn't
    have); alias (detail: the name); silent (key: one of the main cast without a voice); shared (detail: the roles of one voice). An entry
    may be found for several reasons. Steps that are read more than once are written to the shared folder. A backend without a list of voices has none to check, and one without clips takes paths as voices.
    """
    at = F.length("key") - F.instr(F.reverse("key"), "@")
    split = F.contains("key", F.lit("@"))
    named = entries.distinct().select(
        "book", "key", "voice", F.when(split, F.substring("key", F.lit(1), at)).otherwise(F.col("key")).alias("role"), F.when(split, F.substring("key", at + 2, F.length("key"))).alias("style"),
    )
    named = written(named.withColumn("fold", fold_name(F.col("role"))), "entries")
    casts, books = written(casts.select("book", "rank", "name", "aliases", "main"), "casts"), written(books.select("book", "backend", "lang", "styles"), "books")
    known, taken = known_names(casts), clips.select("book", F.col("path").alias("voice")).distinct().withColumn("there", F.lit(True))
    listed = voices.groupBy("backend", F.col("id").alias("voice")).agg(F.first("lang").alias("speaks"))
    backends = voices.select("backend").distinct().withColumn("lists", F.lit(True))
    rows = matched(matched(named, books, "book"), known, "book", "fold", how="left")
    rows = matched(rows.join(listed, ["backend", "voice"], "left").join(backends, "backend", "left"), taken, "book", "voice", how="left")
    clip = (F.contains("voice", F.lit("/")) | F.endswith("voice", F.lit(".wav"))) & F.col("backend").isin(*CLIP_BACKENDS)
    person, preset = ~F.col("role").isin(*ROLES), F.col("lists").isNotNull() & ~clip
    none = F.lit(None).cast("string")
    kind = lambda hit, error, name, detail=none: F.when(hit, F.struct(F.lit(error).alias("error"), F.lit(name).alias("kind"), detail.alias("detail")))
    said = F.array_compact(F.array(
        kind(person & F.col("name").isNull(), True, "nobody"), kind(clip & F.col("there").isNull(), True, "no clip"), kind(preset & F.col("speaks").isNull(), True, "no voice"),
        kind(preset & (F.col("speaks") != F.col("lang")), True, "language", F.col("speaks")), kind(F.col("style").isNotNull() & ~F.array_contains("styles", F.col("style")), False, "style", F.col("style")),
        kind(person & (F.col("name") != F.col("role")), False, "alias", F.col("name")),
    ))
    single = written(rows.select("book", "key", "voice", "role", F.explode(said).alias("f")).select("book", "f.error", "f.kind", "key", "voice", "f.detail", "role"), "found")
    near = nearest(single.where("kind = 'nobody'").select("book", "role"), casts.select("book", "name")).select("book", "role", F.col("name").alias("near"))
    single = matched(single, near, "book", "role", how="left").select("book", "error", "kind", "key", "voice", F.when(F.col("kind") == "nobody", F.col("near")).otherwise(F.col("detail")).alias("detail"))
    keys = named.select("book", "key").distinct()
    rest = lambda error, name, key, voice, detail: (F.lit(error).alias("error"), F.lit(name).alias("kind"), key.alias("key"), voice.alias("voice"), detail.alias("detail"))
    told = keys.where("key = 'narrator'").select("book")
    untold = matched(books, told.withColumn("told", F.lit(True)), "book", how="left").where("told IS NULL").select("book", *rest(True, "no narrator", none, none, none))
    main = casts.where("main AND name IS NOT NULL").select("book", F.col("name").alias("key")).distinct()
    silent = matched(matched(main, books.select("book"), "book"), keys.withColumn("told", F.lit(True)), "book", "key", how="left").where("told IS NULL").select("book", *rest(False, "silent", F.col("key"), none, none))
    shared = named.where(person).groupBy("book", "voice").agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("roles"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = shared.select("book", *rest(False, "shared", none, F.col("voice"), F.col("roles")))
    return single.unionByName(untold).unionByName(silent).unionByName(shared)


def sentences(rows: list, backend: str, lang: str) -> tuple[list[str], list[str]]:
    """Errors and warnings in words, for the findings of one book; silent people are named in one sentence."""
    said: dict[bool, list[str]] = {True: [], False: []}
    for r in sorted(rows, key=lambda r: (r["kind"], r["key"] or "", r["voice"] or "")):
        at, near = f"voices.{backend}.{r['key']}", f" (perhaps {r['detail']!r}?)" if r["detail"] else ""
        words = {
            "no narrator": f"voices.{backend}: there is no narrator",
            "nobody": f"{at}: nobody of the cast{near}",
            "no clip": f"{at}: no such clip: {r['voice']}",
            "no voice": f"{at}: no such voice: {r['voice']!r}",
            "language": f"{at}: {r['voice']!r} doesn't speak {lang}",
            "style": f"{at}: the book has no style {r['detail']!r}, so this clip is never used",
            "alias": f"{at}: an alias of {r['detail']!r}; use that name",
            "shared": f"{r['voice']!r} is the voice of {r['detail']}",
        }
        if r["kind"] in words:
            said[r["error"]].append(words[r["kind"]])
    silent = sorted(r["key"] for r in rows if r["kind"] == "silent")
    if silent:
        said[False].append(f"{len(silent)} of the main cast speak as _default: {', '.join(silent[:8])}" + (" ..." if len(silent) > 8 else ""))
    return said[True], said[False]
