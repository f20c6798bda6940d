"""Queries over texts: sentences, chunks, sizes, normalisation, sections, names, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t
from ..functions.folds import pack_groups
from ..operators import sections as s
from ..sources import pages as p
from .registry import query, table

TEXT = "coalesce(text, '')"
#: Pieces of a text at sentence boundaries. RE2 has no lookahead: the character after a boundary is captured and put back.
PIECES = rf"""list_filter(list_transform(string_split(regexp_replace({TEXT}, '([.!?]["'')\]]?\s+)(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""
LAST_WORD = r"""lower(regexp_replace(regexp_extract(regexp_replace(x, '["'')]+$', ''), '[^ ]*$'), '\.+$', ''))"""
ABBREVIATIONS = ", ".join(f"'{a}'" for a in fixed.ABBREVIATIONS)
#: Heading pattern of the derived books: one word and a full stop.
ONE_WORD = r"[A-Za-z]+\.$"


def chunks_sql(rows: str, columns: str, most: int) -> str:
    """CTEs whose last, `chunked`, has rows' columns (with text among the table's) and the text's chunks of at most `most` characters."""
    packed = lambda xs: f"""CASE WHEN len({xs}) = 0 THEN [] ELSE list_reduce(list_transform({xs}, lambda x: [x]), lambda acc, x:
    CASE WHEN length(acc[-1]) + 1 + length(x[1]) <= {most} THEN list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) ELSE list_concat(acc, x) END) END"""  # noqa: E731
    trimmed = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
    return rf"""p1 AS (SELECT {columns}, {PIECES} AS p FROM {rows}),
  p2 AS (SELECT {columns}, array_to_string(list_transform(p, lambda x: x || CASE WHEN {LAST_WORD} IN ({ABBREVIATIONS}) THEN ' ' ELSE chr(1) END), '') AS j FROM p1),
  p3 AS (SELECT {columns}, list_filter(list_transform(string_split(j, chr(1)), lambda x: regexp_replace(x, ' $', '')), lambda x: x <> '') AS s FROM p2),
  p4 AS (SELECT {columns}, list_transform(s, lambda x: CASE WHEN length(x) <= {most} THEN [x] ELSE list_filter(string_split(regexp_replace(x, '([,;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: regexp_matches(y, '\S')) END) AS s FROM p3),
  p5 AS (SELECT {columns}, flatten(list_transform(flatten(s), lambda x: CASE WHEN length(x) <= {most} THEN [{trimmed}] ELSE {packed(f"regexp_split_to_array({trimmed}, '" + chr(92) + "s+')")} END)) AS s FROM p4),
  chunked AS (SELECT {columns}, {packed("s")} AS chunks FROM p5)"""


@query(f"""
WITH p AS (SELECT doc_id, {PIECES} AS p FROM documents)
SELECT doc_id, CAST(len(p) - len(list_filter(list_transform(p[1:len(p) - 1], lambda x: {LAST_WORD}), lambda w: w IN ({ABBREVIATIONS}))) AS INTEGER) AS sentences FROM p
""")
def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(t.sentences(F.coalesce("text", F.lit("")), "en")).alias("sentences"))


@query(f"""
WITH p AS (SELECT doc_id, {PIECES} AS p FROM documents),
j AS (SELECT doc_id, array_to_string(list_transform(p, lambda x: x || CASE WHEN {LAST_WORD} IN ({ABBREVIATIONS}) THEN ' ' ELSE chr(1) END), '') AS j FROM p),
u AS (SELECT doc_id, list_filter(list_transform(string_split(j, chr(1)), lambda x: regexp_replace(x, ' $', '')), lambda x: x <> '') AS s FROM j)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM u, unnest(range(1, len(s) + 1)) AS r(i)
""")
def sentence_explode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(t.sentences(F.coalesce("text", F.lit("")), "en")).alias("pos", "sentence"))


@query(rf"""
WITH d AS (SELECT doc_id, {TEXT} AS t, regexp_replace({TEXT}, '[\x{{3000}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{FF00}}-\x{{FFEF}}]', '', 'g') AS o FROM documents)
SELECT doc_id, CAST(length(t) - length(o) + ceil(length(o) / 3.0) AS BIGINT) AS tokens,
  CAST(floor(length(t) / 15.0::DOUBLE * 12) + 1 AS BIGINT) AS audio_tokens, CAST(floor(length(t) / 15.0::DOUBLE * 12) + 301 AS BIGINT) AS cost FROM d
""")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", t.approx_tokens(text).alias("tokens"), t.audio_tokens(text, "en").alias("audio_tokens"), t.sequence_cost(text, "en").alias("cost"))


@query(rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, CAST(ceil(length(regexp_replace({TEXT}, '[\x{{3000}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{FF00}}-\x{{FFEF}}]', '', 'g')) / 3.0) AS BIGINT)
    + length({TEXT}) - length(regexp_replace({TEXT}, '[\x{{3000}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{FF00}}-\x{{FFEF}}]', '', 'g')) AS cost,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, turn, k, cost AS used, 1 AS n, 0 AS grp FROM c WHERE k = 1
  UNION ALL
  SELECT c.conv_id, c.turn, c.k, CASE WHEN f.used + 1 + c.cost > 200 OR f.n >= 3 THEN c.cost ELSE f.used + 1 + c.cost END,
    CASE WHEN f.used + 1 + c.cost > 200 OR f.n >= 3 THEN 1 ELSE f.n + 1 END, f.grp + CASE WHEN f.used + 1 + c.cost > 200 OR f.n >= 3 THEN 1 ELSE 0 END
  FROM f JOIN c ON c.conv_id = f.conv_id AND c.k = f.k + 1)
SELECT conv_id, CAST(grp AS INTEGER) AS "group", CAST(count(*) AS BIGINT) AS turns, min(turn) AS first_turn FROM f GROUP BY conv_id, grp
""")
def turn_groups(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", t.approx_tokens(F.coalesce("text", F.lit(""))).alias("cost"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "cost"))).alias("ts"))
    of = pack_groups(F.transform("ts", lambda x: x["cost"]), 200, 1, 3)
    rows = ordered.select("conv_id", F.explode(F.arrays_zip(F.transform("ts", lambda x: x["turn"]).alias("turn"), of.alias("group"))).alias("x"))
    return rows.select("conv_id", F.col("x.group").alias("group"), F.col("x.turn").alias("turn")).groupBy("conv_id", "group").agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"))


@query(f"""
WITH {chunks_sql("documents", "doc_id", 250)}
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_idx, chunks[i] AS chunk FROM chunked, unnest(range(1, len(chunks) + 1)) AS r(i)
""")
def chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    chunks = t.chunks(F.coalesce("text", F.lit("")), "en", 250)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunks).alias("chunk_idx", "chunk"))


@query(rf"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({TEXT},
  '\betc\.', 'et cetera', 'g'), '\be\.g\.', 'for example', 'g'), '\bi\.e\.', 'that is', 'g'), '\s*[—–]\s*', ', ', 'g'), '\s*~+\s*', ', ', 'g'), '\s*,\s*,', ',', 'g'), '\s+', ' ', 'g'),
  '^\s+|\s+$', '', 'g') AS normalized FROM documents
""")
def normalize_english(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.normalize_en(F.coalesce("text", F.lit(""))).alias("normalized"))


_UNITS = "['千', '百', '十', '']"
_GROUP = lambda n: rf"""regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform([1, 2, 3, 4], lambda i: CASE WHEN substr(lpad(CAST({n} AS VARCHAR), 4, '0'), i, 1) = '0' THEN '零'
  ELSE translate(substr(lpad(CAST({n} AS VARCHAR), 4, '0'), i, 1), '0123456789', '零一二三四五六七八九') || ({_UNITS})[i] END), ''), '零+', '零', 'g'), '^零|零$', '', 'g'), '^一十', '十')"""  # noqa: E731


@query(f"""
WITH n AS (SELECT p_partkey, p_partkey * 37 AS n FROM part)
SELECT p_partkey, CASE WHEN n = 0 THEN '零' ELSE CASE WHEN n >= 10000 THEN {_GROUP("n // 10000")} || '万' ELSE '' END || {_GROUP("n % 10000")} END || '年' AS words FROM n
""")
def chinese_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.concat(t.zh_number((F.col("p_partkey") * 37).cast("string")), F.lit("年")).alias("words"))


#: Years digit by digit, other numbers in words, pauses, and sentences that end within quotes.
@query(f"""
WITH n AS (SELECT p_partkey, p_partkey * 37 + 3 AS n, translate(CAST(1000 + p_partkey % 9000 AS VARCHAR), '0123456789', '零一二三四五六七八九') AS y FROM part),
s AS (SELECT p_partkey, [y || '年，他买了' || CASE WHEN n >= 10000 THEN {_GROUP("n // 10000")} || '万' ELSE '' END || {_GROUP("n % 10000")} || '本书，“好吗？”', '她问，「好」。', '再见！', '，'] AS s FROM n)
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM s, unnest(range(1, 5)) AS r(i)
""")
def chinese_sentences(spark: SparkSession, sf: str) -> DataFrame:
    year, n = (1000 + F.col("p_partkey") % 9000).cast("string"), (F.col("p_partkey") * 37 + 3).cast("string")
    text = F.concat(F.lit("  "), year, F.lit("年，他买了"), n, F.lit("本书……“好吗？”她问——「好」。再见！~~\n"))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(t.sentences(t.normalize_zh(text), "zh")).alias("pos", "sentence"))


#: Books with the headings that each language has by itself, once with marks round them and once as Markdown.
_BODY = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g'))"
_TITLED = lambda one, two, joint: f"""
WITH b AS (SELECT doc_id, {_BODY} AS b FROM documents),
c AS (SELECT doc_id, unnest([{{'chapter': 0, 'title': '{one}', 'text': b}}, {{'chapter': 1, 'title': '{two}', 'text': b || CASE WHEN b = '' THEN '' ELSE '{joint}' END || 'end'}}]) AS c FROM b)
SELECT doc_id, c.chapter, c.title, c.text FROM c
"""  # noqa: E731


def _books(spark: SparkSession, sf: str, template: str) -> DataFrame:
    body = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z ]+", " "), " +", " "))
    return table(spark, sf, "documents").select("doc_id", F.replace(F.lit(template), F.lit("{b}"), body).alias("text"))


def _texts(chapters: DataFrame) -> DataFrame:
    return chapters.select("doc_id", "chapter", "title", F.array_join("paragraphs", "\n\n").alias("text"))


@query(_TITLED("CHAPTER I", "Chapter 2: More", " "))
def book_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """What is before and after the marks is no part of the book."""
    text = "A licence.\r\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\r\n\r\nCHAPTER I\r\n\r\n{b}\r\n\r\nChapter 2: More\r\n{b}\r\n  end\r\n\r\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\r\nMore licence.\r\n"
    return _texts(s.chapters(_books(spark, sf, text), key="doc_id"))


@query(_TITLED("One", "Two # 2", " "))
def markdown_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(s.chapters(_books(spark, sf, "# One #\n\n{b}\n\n##  Two # 2\n{b}\nend\n"), markdown=True, key="doc_id"))


@query(_TITLED("第一章 起", "第二章", ""))
def chinese_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Wrapped lines of Chinese are joined without a space."""
    return _texts(s.chapters(_books(spark, sf, "第一章 起\n\n{b}\n\n第二章\n{b}\nend\n"), lang="zh", key="doc_id"))


_LINES = rf"""l AS (SELECT doc_id, i, string_split(replace({TEXT}, chr(13) || chr(10), chr(10)), chr(10))[i] AS line
    FROM documents, unnest(range(1, len(string_split(replace({TEXT}, chr(13) || chr(10), chr(10)), chr(10))) + 1)) AS r(i)),
  t AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l),
  h AS (SELECT *, s <> '' AND (regexp_matches(s, '^(?:{ONE_WORD})') OR regexp_matches(s, '^\s*([0-9]+|[IVXLC]+)\.?\s*$')) AS head FROM t),
  g AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
  b AS (SELECT *, sum(CAST(s = '' AS INTEGER)) OVER (PARTITION BY doc_id, sec ORDER BY i) AS block FROM g),
  k AS (SELECT doc_id, sec, max(CASE WHEN head THEN s END) AS title, count(CASE WHEN NOT head AND s <> '' THEN 1 END) AS filled FROM b GROUP BY doc_id, sec),
  kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS place FROM k WHERE title IS NOT NULL OR filled > 0),
  full_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS chapter FROM kept),
  par AS (SELECT doc_id, sec, block, regexp_replace(string_agg(s, ' ' ORDER BY i), '[ \t]+', ' ', 'g') AS para FROM b WHERE NOT head AND s <> '' GROUP BY doc_id, sec, block),
  parts AS (SELECT doc_id, sec, count(*) AS paragraphs, sum(length(para)) AS chars FROM par GROUP BY doc_id, sec)"""


@query(f"""
WITH {_LINES}
SELECT f.doc_id, CAST(f.chapter AS INTEGER) AS chapter, coalesce(f.title, 'Chapter ' || f.place) AS title, CAST(coalesce(p.paragraphs, 0) AS BIGINT) AS paragraphs, CAST(coalesce(p.chars, 0) AS BIGINT) AS chars
FROM full_ f LEFT JOIN parts p ON p.doc_id = f.doc_id AND p.sec = f.sec
""")
def chapters_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    chapters = s.chapters(table(spark, sf, "documents").select("doc_id", "text"), pattern=ONE_WORD, key="doc_id")
    chars = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return chapters.select("doc_id", "chapter", "title", F.size("paragraphs").cast("long").alias("paragraphs"), chars.alias("chars"))


@query(f"""
WITH {_LINES}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM full_) AS chapters, (SELECT CAST(sum(paragraphs) AS BIGINT) FROM parts) AS paragraphs
""")
def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return s.summary(s.chapters(table(spark, sf, "documents").select("doc_id", "text"), pattern=ONE_WORD, key="doc_id"))


@query(r"""
SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(p_name, '[^\pL\pN_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'role') AS role_slug,
  coalesce(nullif(replace(trim(regexp_replace(p_type, '[^\pL\pN_\s-]', '', 'g')), ' ', '_'), ''), 'book') AS title_slug,
  coalesce(nullif(substr(trim(regexp_replace(p_brand || ':' || p_name, '[\\/:*?"<>|]', '_', 'g')), 1, 120), ''), 'untitled') AS file_name,
  regexp_replace(lower(p_brand), '[^\pL\pN]', '', 'g') AS folded FROM part
""")
def part_slugs(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_brand", F.lit(":"), "p_name")
    return table(spark, sf, "part").select("p_partkey", t.role_slug(F.col("p_name")).alias("role_slug"), t.title_slug(F.col("p_type")).alias("title_slug"), t.file_name(name).alias("file_name"), t.fold_name(F.col("p_brand")).alias("folded"))


@query(r"""
WITH b AS (SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h, regexp_extract(regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?s)<article[^>]*>(.*?)</article>', 1) AS body FROM pages),
p AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS title,
  list_filter(list_transform(regexp_extract_all(body, '(?s)<p[^>]*>(.*?)</p>', 1), lambda x: regexp_replace(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM b)
SELECT page_id, title, CAST(len(ps) AS INTEGER) AS paragraphs, sha256(array_to_string(ps, chr(10))) AS digest FROM p
""")
def page_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    found = p.well_formed(table(spark, sf, "pages"))
    return found.select("page_id", "title", F.size("paragraphs").alias("paragraphs"), F.sha2(F.array_join("paragraphs", "\n"), 256).alias("digest"))


#: Paragraphs end with the next one at the latest. The pages have these entities.
_PLAIN = lambda x: rf"""regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '(?s)<[^>]*>', '', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '^\s+|\s+$', '', 'g')"""


@query(rf"""
WITH b AS (SELECT page_id, regexp_matches(html, '<a[^>]*rel="next"') AS has_next, {_PLAIN("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
    regexp_split_to_array(regexp_extract(regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '(?s)<article[^>]*>(.*?)</article>', 1), '<p(\s[^>]*)?>') AS ps FROM pages),
p AS (SELECT *, list_filter(list_transform(ps[2:], lambda x: {_PLAIN("regexp_replace(x, '(?s)</p>.*', '')")}), lambda x: x <> '') AS paragraphs FROM b)
SELECT page_id, title, array_to_string(paragraphs, chr(10)) AS text, has_next, coalesce(nullif(substr(trim(regexp_replace(title, '[\\/:*?"<>|]', '_', 'g')), 1, 120), ''), 'untitled') AS file FROM p
""")
def page_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return p.chapters(table(spark, sf, "pages")).select("page_id", "title", F.array_join("paragraphs", "\n").alias("text"), "has_next", "file")
