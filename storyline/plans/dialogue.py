"""Queries over dialogue: turns of conversations as quoted speech, speakers, attribution, casts.

A conversation is a chapter and a turn a paragraph: `"<text>" said <role>.`, so that the rules have something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.folds import context_windows
from ..operators import attribution, dialogue, mentions
from ..operators import cast as c
from .registry import ORACLES, QUERIES, query, table

CAST = [c.Character("User", ["the user", "USER."]), c.Character("Assistant", ["assist-ant"]), c.Character("System")]

#: Spans of every turn: its speech, a number among its chapter's quotes, and the tag. Short terms without punctuation are no speech.
SPANS = r"""t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS para, regexp_replace(replace(coalesce(text, ''), '"', ''), '^\s+|\s+$', '', 'g') AS said, role FROM conversations),
  q AS (SELECT *, said <> '' AND (regexp_matches(said, '[.!?,;:。！？，；：…]') OR len(regexp_split_to_array(said, '\s+')) > 2) AS speech FROM t),
  n AS (SELECT *, sum(CAST(speech AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY para) AS number FROM q),
  people AS (SELECT * FROM (VALUES ('user', 'User'), ('theuser', 'User'), ('assistant', 'Assistant'), ('system', 'System')) AS v(folded, name)),
  named AS (SELECT n.*, p.name FROM n LEFT JOIN people p ON p.folded = regexp_replace(lower(role), '[^\pL\pN]', '', 'g')),
  spans AS (SELECT CAST(conv_id AS INTEGER) AS chapter, CAST(para AS INTEGER) AS para, 0 AS span, CASE WHEN speech THEN 'dialogue' ELSE 'narration' END AS kind, said AS text,
      CASE WHEN speech THEN name ELSE 'narrator' END AS speaker, CASE WHEN NOT speech THEN 1.0 WHEN name IS NOT NULL THEN 0.95 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN speech THEN CAST(number AS INTEGER) END AS quote_id FROM named WHERE said <> ''
    UNION ALL
    SELECT CAST(conv_id AS INTEGER), CAST(para AS INTEGER), CASE WHEN said <> '' THEN 1 ELSE 0 END, 'narration', 'said ' || role || '.', 'narrator', 1.0, NULL FROM named)"""
LINES = r"""lines AS (SELECT 'c' || lpad(CAST(chapter AS VARCHAR), CAST(greatest(3, length(CAST(chapter AS VARCHAR))) AS INTEGER), '0') || 'p' || lpad(CAST(para AS VARCHAR), 4, '0') || 's' || lpad(CAST(span AS VARCHAR), 2, '0') AS id,
    chapter, para, span, kind, coalesce(speaker, 'unknown') AS speaker, text, confidence FROM spans WHERE regexp_matches(text, '[\pL\pN_]'))"""


def chapters(spark: SparkSession, sf: str, tagged: bool = True) -> DataFrame:
    """(chapter, paragraphs) of the conversations."""
    text = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit("")), F.lit('"'))
    text = F.concat(text, F.lit(" said "), "role", F.lit(".")) if tagged else text
    turns = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("p"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "p"))).alias("ps"))
    return ordered.select(F.col("conv_id").cast("int").alias("chapter"), F.transform("ps", lambda x: x["p"]).alias("paragraphs"))


def spans(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.span_rows(chapters(spark, sf), CAST)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.lines(spans(spark, sf))


@query(f"""
WITH {SPANS}
SELECT speaker, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(row_number() OVER (ORDER BY count(*) DESC, speaker) AS INTEGER) AS rank
FROM spans WHERE kind = 'dialogue' AND speaker IS NOT NULL GROUP BY speaker
""")
def speaker_rank(spark: SparkSession, sf: str) -> DataFrame:
    talk = spans(spark, sf).where((F.col("kind") == "dialogue") & F.col("speaker").isNotNull())
    sums = talk.groupBy("speaker").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))
    return sums.withColumn("rank", F.row_number().over(W.orderBy(F.col("lines").desc(), "speaker")))  # speakers are a cast


@query(f"WITH {SPANS} SELECT * REPLACE (coalesce(quote_id, 0) AS quote_id) FROM spans")
def quoted_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans(spark, sf).drop("open_end").na.fill(0, ["quote_id"])


@query(f"WITH {SPANS}, {LINES} SELECT id, chapter, para, kind, speaker, text, confidence FROM lines")
def tagged_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("id", "chapter", "para", "kind", "speaker", "text", "confidence")


@query(f"""
WITH {SPANS}, {LINES}
SELECT CAST(count(CASE WHEN kind = 'narration' THEN 1 END) AS BIGINT) AS narration, CAST(count(CASE WHEN kind = 'dialogue' AND confidence >= 0.85 THEN 1 END) AS BIGINT) AS rules,
  CAST(count(CASE WHEN kind = 'dialogue' AND confidence < 0.85 AND speaker <> 'unknown' THEN 1 END) AS BIGINT) AS model, CAST(count(CASE WHEN kind = 'dialogue' AND speaker = 'unknown' THEN 1 END) AS BIGINT) AS unknown,
  CAST(0 AS BIGINT) AS locked, CAST(0 AS BIGINT) AS styled FROM lines
""")
def attribution_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.statistics(lines(spark, sf))


#: Untagged quotes, and a stand-in for a model's answers: every third quote goes unanswered, and every seventh gets a name nobody has.
UNTAGGED = r"""t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS para, regexp_replace(replace(coalesce(text, ''), '"', ''), '^\s+|\s+$', '', 'g') AS said FROM conversations),
  q AS (SELECT *, said <> '' AND (regexp_matches(said, '[.!?,;:。！？，；：…]') OR len(regexp_split_to_array(said, '\s+')) > 2) AS speech FROM t),
  n AS (SELECT *, sum(CAST(speech AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY para) AS number FROM q)"""


def untagged(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.span_rows(chapters(spark, sf, tagged=False), CAST)


def answers(spans: DataFrame) -> DataFrame:
    """Deterministic answers; nothing is said about how well a model would do."""
    k = F.col("quote_id")
    one = spans.where((F.col("kind") == "dialogue") & (k % 3 != 0))
    given = one.select("chapter", "quote_id", F.when(k % 7 == 0, "nobody").when(k % 2 == 0, "ASSIST ANT").otherwise("the user").alias("speaker"), (F.lit(0.5) + (k % 5) / 10.0).alias("confidence"), F.when(k % 4 == 0, "angry").when(k % 4 == 1, "loud").alias("style"), F.struct(k.alias("window"), F.lit(0).alias("k")).alias("pos"))
    again = given.select("chapter", "quote_id", F.lit("System").alias("speaker"), F.lit(0.1).alias("confidence"), F.lit("soft").alias("style"), F.struct(F.col("quote_id").alias("window"), F.lit(1).alias("k")).alias("pos"))
    return given.unionByName(again)


@query(f"""
WITH {UNTAGGED}
SELECT CAST(conv_id AS INTEGER) AS chapter, CAST(number AS INTEGER) AS quote_id,
  CASE WHEN number % 3 = 0 THEN 'unknown' WHEN number % 7 = 0 THEN 'System' WHEN number % 2 = 0 THEN 'Assistant' ELSE 'User' END AS speaker,
  CASE WHEN number % 3 = 0 THEN 0.0 WHEN number % 7 = 0 THEN 0.1 ELSE least(0.5 + (number % 5) / 10.0, 0.8) END::DOUBLE AS confidence,
  CASE WHEN number % 3 <> 0 THEN 'soft' END AS style FROM n WHERE speech
""")
def answer_fold(spark: SparkSession, sf: str) -> DataFrame:
    open_spans = untagged(spark, sf)
    folded = attribution.fold_answers(open_spans, answers(open_spans), CAST, list(fixed.STYLES))
    return folded.where("kind = 'dialogue'").select("chapter", "quote_id", "speaker", "confidence", "style")


#: Windows of paragraphs as requests show them: at most 12 of them, within 300 tokens together with up to 4 before.
WINDOWS = rf"""p AS (SELECT CAST(conv_id AS INTEGER) AS chapter, CAST(para AS INTEGER) AS para, speech, CASE WHEN speech THEN '[q' || CAST(number AS INTEGER) || '](?) "' || said || '"' ELSE said END AS shown FROM n WHERE said <> ''),
e AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY para) AS k, CAST(length(shown) - length(regexp_replace(shown, '[\x{{3000}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{FF00}}-\x{{FFEF}}]', '', 'g'))
  + ceil(length(regexp_replace(shown, '[\x{{3000}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{FF00}}-\x{{FFEF}}]', '', 'g')) / 3.0) AS BIGINT) + 2 AS cost FROM p),
x AS (SELECT *, CAST(coalesce(sum(cost) OVER (PARTITION BY chapter ORDER BY k ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM e),
f AS (SELECT chapter, k, before + cost AS used, 1 AS n, 0 AS w FROM x WHERE k = 1
  UNION ALL
  SELECT x.chapter, x.k, CASE WHEN f.n >= 12 OR f.used + x.cost > 300 THEN x.before + x.cost ELSE f.used + x.cost END, CASE WHEN f.n >= 12 OR f.used + x.cost > 300 THEN 1 ELSE f.n + 1 END,
    f.w + CASE WHEN f.n >= 12 OR f.used + x.cost > 300 THEN 1 ELSE 0 END FROM f JOIN x ON x.chapter = f.chapter AND x.k = f.k + 1)"""


@query(f"WITH RECURSIVE {UNTAGGED}, {WINDOWS} SELECT chapter, CAST(w AS INTEGER) AS \"window\", CAST(count(*) AS BIGINT) AS paragraphs FROM f GROUP BY chapter, w")
def request_windows(spark: SparkSession, sf: str) -> DataFrame:
    shown = attribution.paragraphs_shown(untagged(spark, sf))
    chapter = shown.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("para", "cost"))).alias("ps"))
    rows = chapter.select("chapter", F.explode(context_windows(F.transform("ps", lambda p: p["cost"]), 300)).alias("window"))
    return rows.groupBy("chapter", "window").agg(F.count(F.lit(1)).alias("paragraphs"))


@query(f"""
WITH RECURSIVE {UNTAGGED}, {WINDOWS},
g AS (SELECT f.chapter, f.w, min(f.k) AS a, max(f.k) AS z, min(e.para) AS first, max(e.para) AS last, bool_or(e.speech) AS asked FROM f JOIN e ON e.chapter = f.chapter AND e.k = f.k GROUP BY f.chapter, f.w)
SELECT g.chapter, CAST(g.w AS INTEGER) AS "window", g.first, g.last, string_agg(e.shown, chr(10) || chr(10) ORDER BY e.k) AS passage
FROM g JOIN e ON e.chapter = g.chapter AND e.k BETWEEN g.a - 4 AND g.z WHERE asked GROUP BY ALL
""")
def model_requests(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.requests(untagged(spark, sf), 300)


@query(f"""
WITH {UNTAGGED}
SELECT 'c' || lpad(CAST(CAST(conv_id AS INTEGER) AS VARCHAR), CAST(greatest(3, length(CAST(conv_id AS VARCHAR))) AS INTEGER), '0') || 'p' || lpad(CAST(para AS VARCHAR), 4, '0') || 's00' AS id, 'unknown' AS speaker, '0.00' AS confidence, substr(said, 1, 100) AS text
FROM n WHERE speech AND regexp_matches(said, '[\\pL\\pN_]')
""")
def review_list(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.low_confidence(attribution.lines(untagged(spark, sf)))


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST((length(t) - length(replace(t, 'the', ''))) // 3 + (length(t) - length(replace(t, 'tion', ''))) // 4 + (length(t) - length(replace(t, 'Mr. Bennet', ''))) // 10 AS BIGINT) AS mentions FROM d
""")
def mention_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", c.mentions(F.coalesce("text", F.lit("")), ["the", "tion", "Mr. Bennet", "the", ""]).alias("mentions"))


#: Sources are books; their characters are the first words of texts, with the second words as aliases.
@query(r"""
WITH d AS (SELECT source AS book, coalesce(text, '') AS t FROM documents),
w AS (SELECT book, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')[1:2] AS ws FROM d),
f AS (SELECT DISTINCT book, ws[1] AS name, unnest(ws) AS form FROM w),
n AS (SELECT f.book, f.form, sum((length(t) - length(replace(t, form, ''))) // length(form)) AS n FROM (SELECT DISTINCT book, form FROM f) f JOIN d ON d.book IS NOT DISTINCT FROM f.book GROUP BY ALL)
SELECT f.book, f.name, CAST(sum(n) AS BIGINT) AS mentions FROM f JOIN n ON n.book IS NOT DISTINCT FROM f.book AND n.form = f.form GROUP BY ALL
""")
def book_mentions(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("source").alias("book"), "text")
    start = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+", 3)
    words = F.filter(F.slice(start, 1, 2), lambda w: w != "")
    people = texts.select("book", words.alias("ws")).where(F.size("ws") > 0).select("book", F.col("ws")[0].alias("name"), F.col("ws").alias("aliases"))
    return mentions.mentions(texts, people.distinct())


@query(f"""
WITH {SPANS},
b AS (SELECT string_agg('"' || replace(coalesce(text, ''), '"', '') || '" said ' || role || '.', chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
a AS (SELECT * FROM (VALUES ('User', 'User'), ('User', 'the user'), ('User', 'USER.'), ('Assistant', 'Assistant'), ('Assistant', 'assist-ant'), ('System', 'System')) AS v(name, alias)),
m AS (SELECT name, CAST(sum((length(t) - length(replace(t, alias, ''))) // length(alias)) AS BIGINT) AS mentions FROM a, b GROUP BY name),
l AS (SELECT speaker AS name, CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT chapter) AS INTEGER) AS chapters FROM spans WHERE kind = 'dialogue' GROUP BY speaker),
r AS (SELECT m.name, coalesce(l.lines, 0) AS lines, m.mentions, coalesce(l.chapters, 0) AS chapters FROM m LEFT JOIN l ON l.name = m.name)
SELECT *, CAST(row_number() OVER (ORDER BY lines DESC, mentions DESC, encode(name)) - 1 AS INTEGER) AS rank, row_number() OVER (ORDER BY lines DESC, mentions DESC, encode(name)) <= 2 AS main FROM r
""")
def cast_topk(spark: SparkSession, sf: str) -> DataFrame:
    spoken = spans(spark, sf).where("kind = 'dialogue'").select("chapter", "speaker")
    ranked = c.rank_cast(spark, CAST, chapters(spark, sf), spoken, main_cap=2)
    return ranked.select("name", "lines", "mentions", F.size("chapters").alias("chapters"), "rank", "main")


#: Whole turns are descriptions, and all their words aliases.
ENTRIES = """
WITH e AS (SELECT CAST(conv_id AS INTEGER) AS chapter, turn, trim(role) AS name, coalesce(text, '') AS t FROM conversations),
d AS (SELECT chapter, name, regexp_replace(arg_min(t, turn), '^\\s+|\\s+$', '', 'g') AS description FROM e GROUP BY chapter, name),
a AS (SELECT DISTINCT chapter, name, unnest(string_split(t, ' ')) AS alias FROM e),
g AS (SELECT chapter, name, string_agg(alias, ',' ORDER BY encode(alias)) AS aliases FROM (SELECT DISTINCT chapter, name, trim(alias) AS alias FROM a) WHERE alias <> '' AND alias <> name GROUP BY chapter, name)
SELECT d.chapter, d.name, coalesce(g.aliases, '') AS aliases, d.description FROM d LEFT JOIN g ON g.chapter = d.chapter AND g.name = d.name
"""


@query(ENTRIES)
def discovered_entries(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    found = table(spark, sf, "conversations").select(F.col("conv_id").cast("int").alias("chapter"), F.col("turn").alias("pos"), F.concat(F.lit(" "), "role").alias("name"), F.split(text, " ", -1).alias("aliases"), text.alias("description"))
    return c.dedupe_entries(found).select("chapter", "name", F.array_join(F.array_sort("aliases"), ",").alias("aliases"), "description")


#: The name that it had when discovered_entries still cut turns.
QUERIES["whole_entries"], ORACLES["whole_entries"] = discovered_entries, ENTRIES


#: Every conversation is a book and every turn a chapter, whose first word is a character's name and whose other words are aliases: names
#: become aliases and aliases names throughout. A fold whose every step depends on all before it, so it has no SQL.
@query()
def merged_casts(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    turns = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("book"), F.col("turn").cast("int").alias("chapter"), F.lit(0).alias("pos"), words.alias("words"), F.coalesce("text", F.lit("")).alias("description"))
    entries = turns.where(F.size("words") > 0).select("book", "chapter", "pos", F.get("words", F.lit(0)).alias("name"), F.array_distinct("words").alias("aliases"), "description")
    return c.merged_casts(entries, 2000).select(F.col("book").cast("long").alias("conv_id"), "pos", "name", F.array_join("aliases", ",").alias("aliases"), "description", F.array_join(F.transform("chapters", lambda x: x.cast("string")), ",").alias("chapters"))


#: Each turn in one of four forms: a quote split by its tag; a tag before the quote; a quote left open that the next paragraph goes on with,
#: which has a tag; and one whose next paragraph has none, so that its speaker goes on. What the rules must find is stated form by form.
TAG, BEFORE = "said User, who was smiling at all of us in the room.", "Assistant said:"
FORMS = [
    (['"{x}," ' + TAG + ' "And {x}."'], [(0, 0, "dialogue", "", ",", "User", 0.95), (0, 1, "narration", TAG, "", "narrator", 1.0), (0, 2, "dialogue", "And ", ".", "User", 0.9)]),
    ([BEFORE + ' "{x}."'], [(0, 0, "narration", BEFORE, "", "narrator", 1.0), (0, 1, "dialogue", "", ".", "Assistant", 0.95)]),
    (['"{x}.', '"And {x}." said System.'], [(0, 0, "dialogue", "", ".", None, 0.0), (1, 0, "dialogue", "And ", ".", "System", 0.95), (1, 1, "narration", "said System.", "", "narrator", 1.0)]),
    (['"{x}," ' + TAG + ' "And {x}.', '"Then {x}."'], [(0, 0, "dialogue", "", ",", "User", 0.95), (0, 1, "narration", TAG, "", "narrator", 1.0), (0, 2, "dialogue", "And ", ".", "User", 0.9), (1, 0, "dialogue", "Then ", ".", "User", 0.85)]),
]
_FOUND = ", ".join(f"({k}, {p}, {i}, '{kind}', '{before}', '{after}', {'NULL' if who is None else repr(who)}, {sure}::DOUBLE, {sum(x[2] == 'dialogue' for x in spans[: n + 1])})" for k, (_, spans) in enumerate(FORMS) for n, (p, i, kind, before, after, who, sure) in enumerate(spans))
_PARAS, _QUOTES = ([f(x) for x in FORMS] for f in (lambda x: len(x[0]), lambda x: sum(s[2] == "dialogue" for s in x[1])))


@query(rf"""
WITH c AS (SELECT CAST(conv_id AS INTEGER) AS chapter, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, 'Listen, ' || trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z ]+', '', 'g'), ' +', ' ', 'g')) || ' now' AS x FROM conversations),
b AS (SELECT *, k % 4 AS form, sum(({_PARAS})[CAST(k % 4 + 1 AS INTEGER)]) OVER w - ({_PARAS})[CAST(k % 4 + 1 AS INTEGER)] AS paras, sum(({_QUOTES})[CAST(k % 4 + 1 AS INTEGER)]) OVER w - ({_QUOTES})[CAST(k % 4 + 1 AS INTEGER)] AS quotes FROM c WINDOW w AS (PARTITION BY chapter ORDER BY k)),
f AS (SELECT * FROM (VALUES {_FOUND}) AS v(form, para, span, kind, before, after, speaker, confidence, quote))
SELECT chapter, CAST(b.paras + f.para AS INTEGER) AS para, span, kind, CASE WHEN kind = 'dialogue' THEN before || x || after ELSE before END AS text, coalesce(speaker, '') AS speaker, confidence,
  CASE WHEN kind = 'dialogue' THEN CAST(quotes + quote AS INTEGER) ELSE 0 END AS quote_id FROM b JOIN f ON f.form = b.form
""")
def quote_forms(spark: SparkSession, sf: str) -> DataFrame:
    words = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]+", ""), " +", " "))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("Listen, "), words, F.lit(" now")).alias("x"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "x"))).alias("ts"))
    shown = lambda x, form: F.array(*(F.replace(F.lit(p), F.lit("{x}"), x) for p in form[0]))
    paragraphs = F.flatten(F.transform("ts", lambda t, i: F.when(i % 4 == 0, shown(t["x"], FORMS[0])).when(i % 4 == 1, shown(t["x"], FORMS[1])).when(i % 4 == 2, shown(t["x"], FORMS[2])).otherwise(shown(t["x"], FORMS[3]))))
    rows = ordered.select(F.col("conv_id").cast("int").alias("chapter"), paragraphs.alias("paragraphs"))
    return dialogue.span_rows(rows, CAST).drop("open_end").na.fill(0, ["quote_id"]).na.fill("", ["speaker"])
