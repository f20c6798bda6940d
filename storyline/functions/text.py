"""Text functions as Column expressions: quotes, normalisation, sentences, chunks, sizes, names for files. No Python runs on executors."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

MARK = "\x01"


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once; within a lambda Spark evaluates a repeated expression again each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def canonical_quotes(text: Column) -> Column:
    return F.translate(text, fixed.QUOTES_FROM, fixed.QUOTES_TO)


def canonical_punctuation(text: Column) -> Column:
    return F.translate(text, fixed.PUNCTUATION_FROM, fixed.PUNCTUATION_TO)


def override(text: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements in order; later ones see the outcome of earlier ones."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), text)


def normalize_en(text: Column) -> Column:
    for pattern, spoken in fixed.SPOKEN:
        text = F.regexp_replace(text, "(?U)" + pattern, spoken)
    for pattern, to in ((r"\s*[—–]\s*", ", "), (r"\s*~+\s*", ", "), (r"\s*,\s*,", ","), (r"\s+", " ")):
        text = F.regexp_replace(text, "(?U)" + pattern, to)
    return strip(text)


def _zh_group(n: Column) -> Column:
    """A number below 10,000 in words; empty for 0."""
    digits = F.lpad(n.cast("string"), 4, "0")
    parts = []
    for k, unit in enumerate(fixed.ZH_UNITS):
        digit = F.substring(digits, k + 1, 1)
        parts.append(F.when(digit == "0", "零").otherwise(F.concat(F.translate(digit, "0123456789", fixed.ZH_DIGITS), F.lit(unit))))
    words = F.regexp_replace(F.regexp_replace(F.concat(*parts), "零+", "零"), "^零|零$", "")
    return F.regexp_replace(words, "^一十", "十")


def zh_number(digits: Column) -> Column:
    """A run of digits in Chinese words, by groups of 10,000; from 100,000,000 on it stays in digits."""
    plain = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    n = F.when(F.length(plain) <= 8, plain.cast("int"))
    high, low = F.floor(n / 10000).cast("int"), (n % 10000).cast("int")
    words = F.concat(F.when(high > 0, F.concat(_zh_group(high), F.lit(fixed.ZH_TEN_THOUSAND))).otherwise(""), _zh_group(low))
    return F.when(n.isNull(), plain).when(n == 0, "零").otherwise(words)


def replace_matches(text: Column, pattern: str, f) -> Column:
    """text with every match of pattern replaced by f(match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda part, m: F.concat(part, F.coalesce(f(m), F.lit("")))), "")


def normalize_zh(text: Column) -> Column:
    text = replace_matches(text, "[0-9]{4}(?=年)", lambda m: F.translate(m, "0123456789", fixed.ZH_DIGITS))
    text = replace_matches(text, "[0-9]+", zh_number)
    text = F.regexp_replace(text, r"…+|\.{2,}|——+|—|[~～]+", "，")
    return strip(F.regexp_replace(text, "，{2,}", "，"))


def normalize(text: Column, lang: str, overrides: dict[str, str] | None = None) -> Column:
    text = override(text, overrides or {})
    return normalize_zh(text) if lang == "zh" else normalize_en(text)


def _pieces(text: Column, boundary: str) -> Column:
    """text cut after each match, stripped, without empty pieces."""
    cut = F.split(F.regexp_replace(text, boundary, "$1" + MARK), MARK, -1)
    return F.filter(F.transform(cut, strip), lambda p: p != "")


def sentences(text: Column, lang: str) -> Column:
    """Array of sentences. In English, a piece whose last word is an abbreviation takes the next one in; that depends on the piece alone,
    so the joints are found side by side and no fold is needed."""
    if lang == "zh":
        return _pieces(text, r"([。！？；…][\"”」』]?)")
    def last_word(piece: Column) -> Column:
        return F.lower(F.regexp_replace(F.substring_index(F.regexp_replace(piece, r"""["')]+$""", ""), " ", -1), r"\.+$", ""))

    pieces = _pieces(text, r"""(?U)([.!?]["')\]]?\s+)(?=["'(\[]?[A-Z0-9])""")
    joined = F.array_join(F.transform(pieces, lambda p: F.concat(p, F.when(last_word(p).isin(fixed.ABBREVIATIONS), " ").otherwise(MARK))), "")
    return F.filter(F.transform(F.split(joined, MARK, -1), lambda s: F.regexp_replace(s, " $", "")), lambda s: s != "")


def greedy(pieces: Column, joiner: str, most: int) -> Column:
    """Pieces joined in order as long as the joined text is no longer than `most`; a longer piece stays alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(s: Column, p: Column) -> Column:
        fits = F.length(s["now"]) + len(joiner) + F.length(p) <= most
        return (
            F.when(s["now"] == "", F.struct(s["done"].alias("done"), p.alias("now")))
            .when(fits, F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit(joiner), p).alias("now")))
            .otherwise(F.struct(F.array_append(s["done"], s["now"]).alias("done"), p.alias("now")))
        )

    return F.aggregate(pieces, start, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.array_append(s["done"], s["now"])))


def clauses(sentence: Column, lang: str, most: int) -> Column:
    """The parts of a sentence that is too long: by clause, then by words (by characters in Chinese)."""
    if lang == "zh":
        parts = F.filter(F.split(sentence, "(?<=[，、；：])", -1), lambda p: ~blank(p))
        slices = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.substring(p, k * most + 1, F.lit(most)))
        return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= most, F.array(strip(p))).otherwise(slices(p))))
    parts = F.filter(F.split(sentence, r"(?U)(?<=[,;:])\s+", -1), lambda p: ~blank(p))
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= most, F.array(strip(p))).otherwise(greedy(F.split(strip(p), r"(?U)\s+", -1), " ", most))))


def chunks(text: Column, lang: str, most: int) -> Column:
    """Whole sentences packed into chunks of at most `most` characters; longer sentences are cut first."""
    parts = F.flatten(F.transform(sentences(text, lang), lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(clauses(s, lang, most))))
    return greedy(parts, "" if lang == "zh" else " ", most)


def chars_per_s(lang: str) -> float:
    return fixed.CHARS_PER_S.get(lang, fixed.OTHER_CHARS_PER_S)


def audio_tokens(text: Column, lang: str) -> Column:
    """Audio tokens that speaking the text should take."""
    return (F.floor(F.length(text) / chars_per_s(lang) * fixed.TOKENS_PER_S) + 1).cast("long")


def sequence_cost(text: Column, lang: str) -> Column:
    return audio_tokens(text, lang) + fixed.SEQUENCE_TOKENS


def token_cap(longest: Column, lang: str, override: int | None = None) -> Column:
    """Most tokens that a batch may generate, from its longest text's length."""
    if override:
        return F.lit(override).cast("long")
    return F.least(F.floor(longest / chars_per_s(lang) * fixed.TOKENS_PER_S * 2) + 48, F.lit(2048)).cast("long")


def approx_tokens(text: Column) -> Column:
    """Estimate for language models, on the high side: a CJK character is one token, three others are one."""
    other = F.length(F.regexp_replace(text, fixed.CJK, ""))
    return (F.length(text) - other + F.ceil(other / 3)).cast("long")


def tokens_of(text: str) -> int:
    """approx_tokens of a text that isn't in a column."""
    other = len(re.sub(fixed.CJK, "", text))
    return len(text) - other - (-other // 3)


def fold_name(name: Column) -> Column:
    """Letters and digits of any script, in lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def title_slug(title: Column) -> Column:
    slug = F.replace(strip(F.regexp_replace(title, r"(?U)[^\w\s-]", "")), F.lit(" "), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("book"))


def role_slug(role: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(role, r"(?U)\W+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("role"))


def file_name(title: Column) -> Column:
    name = F.substring(strip(F.regexp_replace(title, r'[\\/:*?"<>|]', "_")), 1, 120)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("untitled"))


def human_age(seconds: Column) -> Column:
    """Age in the largest unit that it fills, without decimals."""
    out = F.concat(F.format_string("%.0f", F.bround(seconds, 0)), F.lit("s ago"))
    for unit, size in (("m", 60), ("h", 3600), ("d", 86400)):
        out = F.when(seconds >= size, F.concat(F.format_string("%.0f", F.bround(seconds / size, 0)), F.lit(f"{unit} ago"))).otherwise(out)
    return out
