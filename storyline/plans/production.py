"""Queries over production data: cache keys, voices, batches, verification, timelines, provenance, reports.

Lines are the turns of conversations, with the role as speaker; durations are those of the tone stand-in. Nothing here says how good a
model's output is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import providers
from ..functions import hashing
from ..functions.text import human_age, token_cap
from ..operators import findings, planning, provenance, timeline, verify, voices
from ..operators.attribution import last_of_each
from ..sources import deltas
from .registry import ORACLES, QUERIES, query, table
from .texts import chunks_sql

VOICES = {"narrator": "bm_george", "user": "af_heart", "user@angry": "af_bella", "_default": "am_adam", "_default@sad": "am_echo"}
PARAMS = {"speed": 1.0}

#: Lines: identifier, chapter, place, speaker, style, text, seconds; every fifth is angry and every seventh sad.
LINES = r"""lines AS (SELECT printf('c%03dp%04ds00', CAST(conv_id AS INTEGER), CAST(turn AS INTEGER)) AS id, CAST(conv_id AS INTEGER) AS chapter, CAST(turn AS INTEGER) AS para, 'dialogue' AS kind, role AS speaker, coalesce(text, '') AS text,
    CASE WHEN (conv_id * 3 + turn) % 5 = 0 THEN 'angry' WHEN (conv_id * 3 + turn) % 7 = 0 THEN 'sad' END AS style, CASE WHEN (conv_id + turn) % 4 = 0 THEN 0.5 ELSE 0.95 END::DOUBLE AS confidence, (conv_id + turn) % 11 = 0 AS locked,
    greatest(1, CAST(floor(24000 * length(coalesce(text, '')) / 15.0::DOUBLE) AS BIGINT)) AS samples FROM conversations)"""
VOICE = """CASE WHEN speaker = 'user' THEN CASE WHEN style = 'angry' THEN 'af_bella' ELSE 'af_heart' END WHEN style = 'sad' THEN 'am_echo' ELSE 'am_adam' END"""
KEY = """'05-audio/' || substr(sha256('render' || chr(0) || 'kokoro-82m-v1.0' || chr(0) || voice || chr(0) || '{"seed": ' || attempts || ', "speed": 1.0}' || chr(0) || text || chr(0)), 1, 24) || '.wav'"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("conv_id") * 3 + F.col("turn")
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "conversations").select(
        F.format_string("c%03dp%04ds00", F.col("conv_id").cast("int"), F.col("turn").cast("int")).alias("id"), F.col("conv_id").cast("int").alias("chapter"), F.col("turn").cast("int").alias("para"),
        F.lit("dialogue").alias("kind"), F.col("role").alias("speaker"), text.alias("text"), F.lit("en").alias("lang"), F.when(k % 5 == 0, "angry").when(k % 7 == 0, "sad").alias("style"),
        F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, 0.5).otherwise(0.95).alias("confidence"), ((F.col("conv_id") + F.col("turn")) % 11 == 0).alias("locked"), providers.tone_samples(text).alias("samples"),
    )


#: State: no render at all for every third chapter; a render that still fits for even places, one of an older text for odd ones.
STATE = f"""voiced AS (SELECT *, {VOICE} AS voice FROM lines),
  old AS (SELECT id, CASE WHEN chapter % 3 = 0 THEN NULL WHEN para % 2 = 0 THEN {KEY.replace("attempts", "1")} ELSE '05-audio/old.wav' END AS had, CASE WHEN chapter % 3 = 0 THEN 0 ELSE 1 END AS attempts FROM voiced)"""


def state(rows: DataFrame) -> DataFrame:
    voice = planning.resolve_voice(VOICES, F.col("speaker"), F.col("style"))
    fits = F.concat(F.lit("05-audio/"), hashing.render_key(provenance.backend_name("kokoro"), voice, PARAMS, F.lit(1), F.col("text")), F.lit(".wav"))
    none = F.col("chapter") % 3 == 0
    return rows.select("id", F.when(none, F.lit(None)).when(F.col("para") % 2 == 0, fits).otherwise("05-audio/old.wav").alias("audio"), F.when(none, 0).otherwise(1).alias("attempts"))


def render_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf)
    held = state(rows)
    there = held.where(F.substring("id", 9, 1) != "4").where(F.col("audio") != "05-audio/old.wav").select("audio")
    return planning.plan(rows, held, there, VOICES, provenance.backend_name("kokoro"), PARAMS, 120)


@query(f"""
WITH {LINES}, v AS (SELECT *, {VOICE} AS voice, CAST(length(text) % 3 AS INTEGER) AS attempts FROM lines)
SELECT id, voice, {KEY} AS audio FROM v
""")
def render_keys(spark: SparkSession, sf: str) -> DataFrame:
    voice = planning.resolve_voice(VOICES, F.col("speaker"), F.col("style"))
    key = hashing.render_key(provenance.backend_name("kokoro"), F.col("voice"), PARAMS, F.length("text") % 3, F.col("text"))
    return lines(spark, sf).withColumn("voice", voice).select("id", "voice", F.concat(F.lit("05-audio/"), key, F.lit(".wav")).alias("audio"))


@query(f"WITH {LINES} SELECT {VOICE} AS voice, speaker, coalesce(style, '') AS style, CAST(count(*) AS BIGINT) AS lines FROM lines GROUP BY ALL")
def voice_resolution(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).withColumn("voice", planning.resolve_voice(VOICES, F.col("speaker"), F.col("style")))
    return rows.groupBy("voice", "speaker", F.coalesce("style", F.lit("")).alias("style")).agg(F.count(F.lit(1)).alias("lines"))


@query(f"""
WITH {LINES}, {STATE},
j AS (SELECT v.*, o.had, o.attempts FROM voiced v JOIN old o ON o.id = v.id),
e AS (SELECT *, {KEY} AS want, {KEY.replace("attempts", "0")} AS fresh FROM j),
p AS (SELECT id, voice, CASE WHEN had IS NOT NULL AND had <> want THEN fresh ELSE want END AS audio, CAST(CASE WHEN had IS NOT NULL AND had <> want THEN 0 ELSE attempts END AS INTEGER) AS attempts FROM e),
inv AS (SELECT DISTINCT had FROM old WHERE had IS NOT NULL AND substr(id, 9, 1) <> '4' AND had <> '05-audio/old.wav')
SELECT p.*, i.had IS NULL AS todo FROM p LEFT JOIN inv i ON i.had = p.audio
""")
def cache_probe(spark: SparkSession, sf: str) -> DataFrame:
    return render_plan(spark, sf).select("id", "voice", "audio", "attempts", F.col("chunks").isNotNull().alias("todo"))


@query(f"""
WITH RECURSIVE {LINES}, {STATE},
j AS (SELECT v.*, o.had, o.attempts FROM voiced v JOIN old o ON o.id = v.id),
e AS (SELECT *, {KEY} AS want, {KEY.replace("attempts", "0")} AS fresh FROM j),
p AS (SELECT id, voice, text, CASE WHEN had IS NOT NULL AND had <> want THEN fresh ELSE want END AS audio, CAST(CASE WHEN had IS NOT NULL AND had <> want THEN 0 ELSE attempts END AS INTEGER) AS attempts FROM e),
inv AS (SELECT DISTINCT had FROM old WHERE had IS NOT NULL AND substr(id, 9, 1) <> '4' AND had <> '05-audio/old.wav'),
todo AS (SELECT p.id, p.voice, '{{"seed": ' || p.attempts || ', "speed": 1.0}}' AS params, p.text FROM p LEFT JOIN inv i ON i.had = p.audio WHERE i.had IS NULL),
{chunks_sql("todo", "id, voice, params", 120)},
c AS (SELECT voice, params, id, CAST(i - 1 AS INTEGER) AS chunk_idx, chunks[i] AS chunk, CAST(floor(length(chunks[i]) / 15.0::DOUBLE * 12) + 301 AS BIGINT) AS cost FROM chunked, unnest(range(1, len(chunks) + 1)) AS r(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY voice, params ORDER BY length(chunk), id, chunk_idx) AS k FROM c),
f AS (SELECT *, cost AS used, 1 AS n, CAST(0 AS BIGINT) AS batch FROM k WHERE k = 1
  UNION ALL
  SELECT k.*, CASE WHEN f.n >= 16 OR f.used + k.cost > 8000 THEN k.cost ELSE f.used + k.cost END, CASE WHEN f.n >= 16 OR f.used + k.cost > 8000 THEN 1 ELSE f.n + 1 END,
    f.batch + CASE WHEN f.n >= 16 OR f.used + k.cost > 8000 THEN 1 ELSE 0 END FROM f JOIN k ON k.voice = f.voice AND k.params = f.params AND k.k = f.k + 1)
SELECT voice, params, batch, k - 1 AS place, id, chunk_idx, chunk, cost FROM f
""")
def synthesis_batches(spark: SparkSession, sf: str) -> DataFrame:
    return planning.batches(render_plan(spark, sf), 16, 8000).select("voice", "params", "batch", "place", "id", "chunk_idx", "chunk", "cost")


#: One chunk per line, so that SQL can follow: the line itself, at most 8 to a batch and 4000 tokens.
@query(f"""
WITH RECURSIVE {LINES},
c AS (SELECT {VOICE} AS voice, id, CAST(floor(length(text) / 15.0::DOUBLE * 12) + 301 AS BIGINT) AS cost, row_number() OVER (PARTITION BY {VOICE} ORDER BY length(text), id) AS k FROM lines),
f AS (SELECT voice, id, k, cost AS used, 1 AS n, 0 AS b FROM c WHERE k = 1
  UNION ALL
  SELECT c.voice, c.id, c.k, CASE WHEN f.n >= 8 OR f.used + c.cost > 4000 THEN c.cost ELSE f.used + c.cost END, CASE WHEN f.n >= 8 OR f.used + c.cost > 4000 THEN 1 ELSE f.n + 1 END,
    f.b + CASE WHEN f.n >= 8 OR f.used + c.cost > 4000 THEN 1 ELSE 0 END FROM f JOIN c ON c.voice = f.voice AND c.k = f.k + 1)
SELECT voice, CAST(b AS BIGINT) AS batch, CAST(k - 1 AS BIGINT) AS place, id FROM f
""")
def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).withColumn("voice", planning.resolve_voice(VOICES, F.col("speaker"), F.col("style"))).withColumn("params", F.lit("{}")).withColumn("chunks", F.array("text"))
    return planning.batches(rows, 8, 4000).select("voice", "batch", "place", "id")


@query(f"""
WITH {LINES} SELECT speaker, CAST(least(floor(max(length(text)) / 15.0::DOUBLE * 12 * 2) + 48, 2048) AS BIGINT) AS cap FROM lines GROUP BY speaker
""")
def token_caps(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("speaker").agg(F.max(F.length("text")).alias("longest")).select("speaker", token_cap(F.col("longest"), "en").alias("cap"))


#: A turn against the next one, whole. The table of edit distances grows by a row a step for all pairs at once; within a row, insertions
#: spread as a running minimum of the distance less its column.
PAIRS = r"""a AS (SELECT conv_id, turn, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM conversations),
  w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(t), '[^\pL\pN\pM_\s]', '', 'g'), '\s+'), lambda x: x <> '') AS r,
    list_filter(regexp_split_to_array(regexp_replace(lower(u), '[^\pL\pN\pM_\s]', '', 'g'), '\s+'), lambda x: x <> '') AS h, t AS text FROM a WHERE u IS NOT NULL),
  c AS (SELECT conv_id, turn, list_transform(r, lambda x: hash(x)) AS r, list_transform(h, lambda x: hash(x)) AS h FROM w),
  d AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, j, j AS v FROM c, unnest(range(0, len(h) + 1)) AS x(j)
    UNION ALL
    SELECT conv_id, turn, i, j, CAST(j + min(t - j) OVER (PARTITION BY conv_id, turn ORDER BY j) AS BIGINT) AS v FROM (
      SELECT d.conv_id, d.turn, d.i + 1 AS i, d.j, CASE WHEN d.j = 0 THEN d.i + 1 ELSE least(d.v + 1, lag(d.v) OVER (PARTITION BY d.conv_id, d.turn ORDER BY d.j) + CASE WHEN c.r[d.i + 1] = c.h[d.j] THEN 0 ELSE 1 END) END AS t
      FROM d JOIN c ON c.conv_id = d.conv_id AND c.turn = d.turn WHERE d.i < len(c.r))),
  e AS (SELECT w.*, CAST(d.v AS INTEGER) AS edits FROM w JOIN d ON d.conv_id = w.conv_id AND d.turn = w.turn AND d.i = len(w.r) AND d.j = len(w.h)),
  rated AS (SELECT *, CASE WHEN len(r) > 0 THEN edits / CAST(len(r) AS DOUBLE) WHEN len(h) > 0 THEN 1.0 ELSE 0.0 END AS error_rate FROM e)"""
ERRORS = f"WITH RECURSIVE {PAIRS} SELECT conv_id, turn, edits, round(error_rate, 9) AS error_rate FROM rated"
VERDICTS = f"""
WITH RECURSIVE {PAIRS}
SELECT conv_id, turn, CASE WHEN turn + length(text) / 10.0::DOUBLE > 3 * (length(text) / 15.0::DOUBLE) + 3 THEN false WHEN len(r) <= 4 OR len(list_distinct(r)) <= 2 THEN true ELSE error_rate <= 0.95 OR edits <= 1 END AS ok FROM rated
"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf, "conversations").withColumn("next", F.lead(text).over(W.partitionBy("conv_id").orderBy("turn"))).where(F.col("next").isNotNull())
    return verify.compare(rows.select("conv_id", "turn", text.alias("text"), F.col("next").alias("transcript")), short="short")


@query(ERRORS)
def word_errors(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("conv_id", "turn", "edits", F.round("error_rate", 9).alias("error_rate"))


@query(VERDICTS)
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    duration = F.col("turn") + F.length("text") / 10.0
    return pairs(spark, sf).select("conv_id", "turn", verify.judge(F.col("text"), F.col("error_rate"), F.col("edits"), duration, threshold=0.95, short=F.col("short")).alias("ok"))


#: Names under which whole turns were compared when the two above still cut them.
QUERIES["whole_word_errors"], ORACLES["whole_word_errors"] = word_errors, ERRORS
QUERIES["whole_verdicts"], ORACLES["whole_verdicts"] = verdicts, VERDICTS


#: Segments to clips: purchases go to the user's last signup by then, or to the first.
@query("""
WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'),
s AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM c)),
f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id FROM c GROUP BY user_id),
l AS (SELECT s.user_id, s.event_id, arg_max(c.event_id, (c.ts, c.event_id)) AS clip FROM s LEFT JOIN c ON c.user_id = s.user_id AND epoch_us(c.ts) <= epoch_us(s.ts) + 1000 GROUP BY s.user_id, s.event_id)
SELECT l.user_id, CAST(coalesce(l.clip, f.first_id) AS BIGINT) AS id, CAST(count(*) AS BIGINT) AS segments FROM l JOIN f ON f.user_id = l.user_id GROUP BY 1, 2
""")
def segment_clips(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    clips = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("id"), seconds.alias("start"))
    segments = events.where("event_type = 'purchase'").select("user_id", seconds.alias("start"), F.lit("x").alias("text")).join(clips.select("user_id").distinct(), "user_id", "left_semi")
    found = verify.segments_to_clips(segments, clips, by="user_id")
    return found.select("user_id", "id", F.size(F.split("transcript", " ")).cast("long").alias("segments"))


#: The same with texts, which come in the order of their times.
@query("""
WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'),
s AS (SELECT user_id, event_id, ts, event_type || ' ' || CAST(event_id AS VARCHAR) AS text FROM events WHERE event_type <> 'signup' AND user_id IN (SELECT user_id FROM c)),
f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id FROM c GROUP BY user_id),
l AS (SELECT s.user_id, s.event_id, any_value(s.ts) AS ts, any_value(s.text) AS text, arg_max(c.event_id, (c.ts, c.event_id)) AS clip FROM s LEFT JOIN c ON c.user_id = s.user_id AND epoch_us(c.ts) <= epoch_us(s.ts) + 1000 GROUP BY s.user_id, s.event_id)
SELECT l.user_id, CAST(coalesce(l.clip, f.first_id) AS BIGINT) AS id, string_agg(l.text, ' ' ORDER BY l.ts, encode(l.text)) AS transcript FROM l JOIN f ON f.user_id = l.user_id GROUP BY 1, 2
""")
def segment_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    clips = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("id"), seconds.alias("start"))
    segments = events.where("event_type <> 'signup'").select("user_id", seconds.alias("start"), F.concat(F.lit(" "), "event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")).alias("text"))
    return verify.segments_to_clips(segments.join(clips.select("user_id").distinct(), "user_id", "left_semi"), clips, by="user_id")


#: Results: every fourth place has none, every sixth chapter's belong to older audio; errors by length.
RESULTS = """st AS (SELECT id, chapter, para, CASE WHEN para % 5 <> 4 THEN 'a' || length(text) END AS audio, CAST(para % 3 AS INTEGER) AS attempts FROM lines),
  res AS (SELECT s.id, CASE WHEN s.chapter % 6 = 0 THEN 'old' ELSE s.audio END AS audio, (length(l.text) % 30) / 20.0::DOUBLE AS error_rate, length(l.text) % 30 < 12 AS ok FROM st s JOIN lines l ON l.id = s.id WHERE s.audio IS NOT NULL AND s.para % 4 <> 3),
  cur AS (SELECT r.* FROM res r JOIN st s ON s.id = r.id AND s.audio = r.audio)"""


def states_and_results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = lines(spark, sf)
    audio = F.when(F.col("para") % 5 != 4, F.concat(F.lit("a"), F.length("text").cast("string")))
    held = rows.select("id", "chapter", "para", audio.alias("audio"), (F.col("para") % 3).alias("attempts"), F.length("text").alias("n"))
    results = held.where(F.col("audio").isNotNull() & (F.col("para") % 4 != 3)).select("id", F.when(F.col("chapter") % 6 == 0, "old").otherwise(F.col("audio")).alias("audio"), ((F.col("n") % 30) / 20.0).alias("error_rate"), (F.col("n") % 30 < 12).alias("ok"))
    return held.drop("n"), results


@query(f"WITH {LINES}, {RESULTS} SELECT CAST(count(*) AS BIGINT) AS checked, round(avg(least(error_rate, 1.0)), 9) AS mean_error, CAST(count(CASE WHEN NOT ok THEN 1 END) AS BIGINT) AS failed FROM cur")
def verify_summary(spark: SparkSession, sf: str) -> DataFrame:
    return verify.summary(*states_and_results(spark, sf)).withColumn("mean_error", F.round("mean_error", 9))


@query(f"WITH {LINES}, {RESULTS} SELECT s.id, s.audio FROM st s WHERE s.audio IS NOT NULL AND NOT EXISTS (SELECT 1 FROM res r WHERE r.id = s.id AND r.audio = s.audio)")
def verify_pending(spark: SparkSession, sf: str) -> DataFrame:
    return verify.pending(*states_and_results(spark, sf)).select("id", "audio")


@query(f"""
WITH {LINES}, {RESULTS}, bad AS (SELECT DISTINCT id FROM cur WHERE NOT ok)
SELECT s.id, coalesce(CASE WHEN b.id IS NOT NULL AND s.attempts + 1 < 3 THEN NULL ELSE s.audio END, 'none') AS audio, CAST(CASE WHEN b.id IS NOT NULL AND s.attempts + 1 < 3 THEN s.attempts + 1 ELSE s.attempts END AS INTEGER) AS attempts
FROM st s LEFT JOIN bad b ON b.id = s.id
""")
def retry_step(spark: SparkSession, sf: str) -> DataFrame:
    return verify.retry(*states_and_results(spark, sf)).select("id", F.coalesce("audio", F.lit("none")).alias("audio"), "attempts")


def timed(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).withColumn("duration", F.col("samples") / 24000.0)


TIMED = """t AS (SELECT *, samples / 24000.0::DOUBLE AS duration, lag(speaker) OVER (PARTITION BY chapter ORDER BY id) AS before, row_number() OVER (PARTITION BY chapter ORDER BY id) AS k FROM lines),
  p AS (SELECT *, CASE WHEN k = 1 THEN 2.5 WHEN speaker = before THEN 0.6 ELSE 1.2 END::DOUBLE AS pause FROM t)"""


@query(f"WITH {LINES}, {TIMED}, o AS (SELECT *, sum(pause + duration) OVER (PARTITION BY chapter ORDER BY id ROWS UNBOUNDED PRECEDING) AS stop FROM p) SELECT id, chapter, pause, round(stop - duration, 4) AS start, round(stop, 4) AS \"end\" FROM o")
def line_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.with_offsets(timed(spark, sf)).select("id", "chapter", "pause", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


#: Chapters of five books, each with its start and end in milliseconds.
MARKERS = """d AS (SELECT CAST(chapter % 5 AS VARCHAR) AS book, chapter, CAST(count(*) AS BIGINT) AS lines, sum(pause + duration) + 0.6 AS duration FROM p GROUP BY chapter),
  m AS (SELECT *, CAST(floor(round(coalesce(sum(duration) OVER (PARTITION BY book ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 1000, 3)) AS BIGINT) AS start_ms,
    CAST(floor(round(sum(duration) OVER (PARTITION BY book ORDER BY chapter ROWS UNBOUNDED PRECEDING) * 1000, 3)) AS BIGINT) AS end_ms FROM d)"""


def marked(spark: SparkSession, sf: str) -> DataFrame:
    chapters = timeline.chapter_durations(timed(spark, sf)).withColumn("book", (F.col("chapter") % 5).cast("string"))
    return timeline.markers(chapters.withColumn("title", F.concat(F.lit("Part; "), F.col("chapter").cast("string"))))


@query(f"WITH {LINES}, {TIMED}, {MARKERS} SELECT book, chapter, lines, start_ms, end_ms FROM m")
def chapter_markers(spark: SparkSession, sf: str) -> DataFrame:
    return marked(spark, sf).select("book", "chapter", "lines", "start_ms", "end_ms")


@query(f"""
WITH {LINES}, {TIMED}, {MARKERS}
SELECT book, ';FFMETADATA1' || chr(10) || 'title=' || book || chr(10) || 'artist=\\=' || chr(10) || 'album=' || book || chr(10) || 'genre=Tales' || chr(10) || chr(10)
  || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms || chr(10) || 'title=Part\\; ' || chapter || chr(10), chr(10) ORDER BY chapter) AS metadata
FROM m GROUP BY book
""")
def chapter_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.metadata(marked(spark, sf).withColumn("author", F.lit("=")), "Tales")


#: Stamps: of chapters built before, every second with another text, every third with other settings, every fifth unreadable.
STAMPS = """cur AS (SELECT chapter, sha256(string_agg(text, chr(10) ORDER BY id)) AS h FROM lines GROUP BY chapter),
  stages AS (SELECT * FROM (VALUES ('attribute', 1), ('render', 2), ('verify', 3), ('build', 4)) AS v(stage, n)),
  reasons AS (SELECT chapter, stage, CASE WHEN chapter % 7 < n THEN 'missing' WHEN chapter % 5 = 0 THEN 'no stamp' ELSE array_to_string(list_filter(list_value(CASE WHEN chapter % 2 = 0 THEN 'lines' END, CASE WHEN chapter % 3 = 0 AND n > 1 THEN 'params' END), lambda x: x IS NOT NULL), ',') END AS reasons FROM cur, stages)"""


def stage_reasons(spark: SparkSession, sf: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n")
    now = lines(spark, sf).groupBy("chapter").agg(F.sha2(text, 256).alias("h"))
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(n).alias("n")) for n, s in enumerate(provenance.STAGES, 1)))
    rows = now.withColumn("s", F.explode(stages)).select("chapter", "h", "s.stage", "s.n")
    current = rows.select("chapter", "stage", provenance.inputs(lines=F.col("h"), params="p2").alias("inputs"))
    lines_then = F.when(F.col("chapter") % 2 == 0, "other").otherwise(F.col("h"))
    params_then = F.when((F.col("chapter") % 3 == 0) & (F.col("n") > 1), "p1").otherwise("p2")
    stamp = F.when(F.col("chapter") % 5 != 0, provenance.inputs(lines=lines_then, params=params_then))
    stamps = rows.where(F.col("chapter") % 7 >= F.col("n")).select("chapter", "stage", stamp.alias("inputs"))
    return provenance.with_reasons(current, stamps, ["chapter", "stage"]).select("chapter", "stage", "reasons")


@query(f"WITH {LINES}, {STAMPS} SELECT * FROM reasons")
def stale_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return stage_reasons(spark, sf).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""
WITH {LINES}, {STAMPS}, s AS (SELECT chapter, stage, CASE WHEN reasons = '' THEN 'fresh' WHEN reasons = 'missing' THEN 'missing' ELSE 'stale' END AS s FROM reasons)
SELECT chapter, max(CASE WHEN stage = 'attribute' THEN s END) AS attribute, max(CASE WHEN stage = 'render' THEN s END) AS render, max(CASE WHEN stage = 'verify' THEN s END) AS verify, max(CASE WHEN stage = 'build' THEN s END) AS build FROM s GROUP BY chapter
""")
def status_grid(spark: SparkSession, sf: str) -> DataFrame:
    states = stage_reasons(spark, sf)
    return provenance.chapter_grid(states.select("chapter").distinct(), states)


@query(f"""
WITH {LINES}, {STAMPS}, s AS (SELECT *, CASE WHEN reasons = '' THEN 'fresh' WHEN reasons = 'missing' THEN 'missing' ELSE 'stale' END AS s FROM reasons),
g AS (SELECT stage, count(*) AS n, count(CASE WHEN s = 'fresh' THEN 1 END) AS f, count(CASE WHEN s = 'missing' THEN 1 END) AS m, count(CASE WHEN s = 'stale' THEN 1 END) AS t,
  array_to_string(list_sort(list_distinct(flatten(coalesce(list(string_split(reasons, ',')) FILTER (WHERE s = 'stale'), [])))), ', ') AS why FROM s GROUP BY stage)
SELECT stage, CASE WHEN m = n THEN 'missing' WHEN f = n THEN 'fresh' WHEN f > 0 OR t > 0 THEN 'stale' ELSE 'missing' END AS status, f || '/' || n || ' chapters fresh' AS detail, substr(why, 1, 60) AS reasons FROM g
""")
def stage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.stage_status(stage_reasons(spark, sf))


@query(f"""
WITH {LINES}, {RESULTS}, bad AS (SELECT DISTINCT id FROM cur WHERE NOT ok),
m AS (SELECT l.chapter, l.id, l.speaker, l.text, array_to_string(list_filter([CASE WHEN l.confidence < 0.85 THEN '(?)' END, CASE WHEN b.id IS NOT NULL THEN '[x]' END, CASE WHEN l.locked THEN '[lock]' END, CASE WHEN l.style IS NOT NULL THEN chr(123) || l.style || chr(125) END], lambda x: x IS NOT NULL), ' ') AS marks FROM lines l LEFT JOIN bad b ON b.id = l.id)
SELECT chapter, id, '`' || id || '` **' || speaker || '**' || CASE WHEN marks <> '' THEN ' ' || marks ELSE '' END || ': ' || text AS line FROM m
""")
def script_view(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.script(lines(spark, sf), verify.failures(*states_and_results(spark, sf)))


@query(f"WITH {LINES} SELECT speaker, CAST(count(*) AS BIGINT) AS lines, min(id) AS first FROM lines GROUP BY speaker")
def speaker_lines(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.speakers(lines(spark, sf))


@query(f"""
WITH {LINES}, {RESULTS}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM lines) AS lines, (SELECT CAST(count(*) AS BIGINT) FROM lines) AS dialogue, (SELECT CAST(count(CASE WHEN confidence < 0.85 THEN 1 END) AS BIGINT) FROM lines) AS low_confidence, CAST(0 AS BIGINT) AS unknown,
  (SELECT round(avg(error_rate), 9) FROM cur) AS mean_error, (SELECT CAST(count(CASE WHEN NOT ok THEN 1 END) AS BIGINT) FROM cur) AS failed
""")
def report_details(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.line_details(lines(spark, sf), verify.current(*states_and_results(spark, sf))).withColumn("mean_error", F.round("mean_error", 9))


#: Edits: every ninth line to the narrator, every tenth gets a style or loses it.
@query(f"""
WITH {LINES}, e AS (SELECT id, CASE WHEN (chapter + para) % 9 = 0 THEN 'narrator' END AS speaker, CASE WHEN (chapter + para) % 20 = 0 THEN 'soft' WHEN (chapter + para) % 10 = 0 THEN 'neutral' END AS style FROM lines WHERE (chapter + para) % 9 = 0 OR (chapter + para) % 10 = 0)
SELECT l.id, CASE WHEN e.speaker IS NULL THEN l.kind ELSE 'narration' END AS kind, coalesce(e.speaker, l.speaker) AS speaker, coalesce(CASE WHEN e.style = 'neutral' THEN NULL ELSE coalesce(e.style, l.style) END, '') AS style,
  CASE WHEN e.id IS NOT NULL THEN 1.0 ELSE l.confidence END AS confidence, e.id IS NOT NULL OR l.locked AS locked FROM lines l LEFT JOIN e ON e.id = l.id
""")
def fix_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).drop("samples")
    k = F.col("chapter") + F.col("para")
    none = F.lit(None).cast("string")
    edits = rows.where((k % 9 == 0) | (k % 10 == 0)).select("id", F.when(k % 9 == 0, "narrator").alias("speaker"), none.alias("text"), F.when(k % 20 == 0, "soft").when(k % 10 == 0, "neutral").alias("style"), F.lit(None).cast("boolean").alias("unlock"))
    return provenance.fix_lines(rows, edits).select("id", "kind", "speaker", F.coalesce("style", F.lit("")).alias("style"), "confidence", "locked")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'f' WHEN c_custkey % 4 = 1 THEN 'm' WHEN c_custkey % 4 = 2 THEN 'f' ELSE '?' END AS gender,
  CASE WHEN c_custkey % 4 = 0 THEN 'adult' WHEN c_custkey % 4 = 1 THEN 'old' WHEN c_custkey % 4 = 2 THEN 'young' ELSE '?' END AS age FROM customer
""")
def voice_profiles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, "A middle-aged woman, his wife").when(k == 1, "An old man, " + "her father").when(k == 2, "She is a student").otherwise("Somebody, him and her")
    return table(spark, sf, "customer").select("c_custkey", voices.gender(text).alias("gender"), voices.age(text).alias("age"))


#: Every conversation is a book whose roles are described by the longest of their turns. What a choice is depends on those before it.
@query()
def assigned_voices(spark: SparkSession, sf: str) -> DataFrame:
    spoken = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("book"), F.concat(F.col("role"), F.lit(" "), F.col("turn") % 5).alias("role"))
    roles = spoken.agg(F.count(F.lit(1)).alias("lines"), F.max_by(F.coalesce("text", F.lit("")), F.struct(F.length("text"), F.col("turn"))).alias("description"))
    return voices.assigned(roles, voices.pool("kokoro", "en")).select(F.col("book").cast("long").alias("conv_id"), "role", "voice")


@query(rf"""
WITH RECURSIVE {LINES}, t AS (SELECT speaker, id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM lines),
u AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY id) AS k FROM t WHERE length(t) BETWEEN 4 AND 160),
f AS (SELECT speaker, k, t AS s FROM u WHERE k = 1
  UNION ALL SELECT u.speaker, u.k, CASE WHEN length(f.s) + 1 + length(u.t) <= 160 THEN f.s || ' ' || u.t ELSE f.s END FROM f JOIN u ON u.speaker = f.speaker AND u.k = f.k + 1)
SELECT speaker, arg_max(s, k) AS sample FROM f GROUP BY speaker HAVING length(arg_max(s, k)) >= 12
""")
def sample_passages(spark: SparkSession, sf: str) -> DataFrame:
    return voices.sample_texts(lines(spark, sf))


@query("""
WITH r AS (SELECT n_name AS role, 'voice of ' || n_name AS description FROM nation UNION ALL SELECT 'narrator', 'calm'),
s AS (SELECT * FROM (VALUES ('', NULL), ('angry', 'angry, raised voice, sharp and forceful'), ('sad', 'sad, low, slow and subdued')) AS v(style, phrase))
SELECT CASE WHEN style = '' THEN role ELSE role || '@' || style END AS key, 'voices/' || regexp_replace(role, '[^\\pL\\pN_]+', '_', 'g') || CASE WHEN style = '' THEN '' ELSE '.' || style END || '.wav' AS path,
  'Say this.' AS text, CASE WHEN style = '' THEN description ELSE description || ', ' || phrase END AS instruct FROM r, s WHERE role <> 'narrator' OR style = ''
""")
def design_plan(spark: SparkSession, sf: str) -> DataFrame:
    roles = table(spark, sf, "nation").select(F.col("n_name").alias("role"), F.concat(F.lit("voice of "), "n_name").alias("description"))
    roles = roles.unionByName(spark.createDataFrame([("narrator", "calm")], roles.schema))
    return voices.design_plan(roles, spark.createDataFrame([], "speaker string, sample string"), "en", ["angry", "sad"], "Say this.")


@query("""
WITH v AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'kokoro' ELSE 'qwen3tts' END AS backend, s_name AS role, CAST(s_nationkey AS VARCHAR) AS voice_id FROM supplier)
SELECT backend, voice_id, string_agg(role, ', ' ORDER BY role) AS roles FROM v GROUP BY ALL HAVING count(*) > 1
""")
def shared_voices(spark: SparkSession, sf: str) -> DataFrame:
    table_of = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "kokoro").otherwise("qwen3tts").alias("backend"), F.col("s_name").alias("role"), F.col("s_nationkey").cast("string").alias("voice_id"))
    return voices.shared_voices(table_of)


@query("""
SELECT backend, lang, gender, CAST(count(*) AS BIGINT) AS voices FROM (VALUES ('kokoro', 'en', 'f', 7), ('kokoro', 'en', 'm', 6), ('kokoro', 'zh', 'f', 4), ('kokoro', 'zh', 'm', 4), ('qwen3tts', 'en', 'm', 2), ('qwen3tts', 'zh', 'f', 2), ('qwen3tts', 'zh', 'm', 3)) AS v(backend, lang, gender, n), range(n) GROUP BY ALL
""")
def voice_pool(spark: SparkSession, sf: str) -> DataFrame:
    return voices.pool_table(spark).where(F.col("lang").isin("en", "zh")).groupBy("backend", "lang", "gender").agg(F.count(F.lit(1)).alias("voices"))


@query("""
WITH a AS (SELECT event_id, epoch(TIMESTAMP '2030-01-01') - epoch(ts) AS s FROM events)
SELECT event_id, CAST(round_even(s / 86400.0::DOUBLE, 0) AS BIGINT) || 'd ago' AS age FROM a
""")
def event_ages(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.lit(1893456000.0) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf, "events").select("event_id", human_age(seconds).alias("age"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("order", F.struct("ts", "event_id"))
    return last_of_each(rows, "user_id", "order").select("user_id", "event_id")


#: Events as a log of commits, a day each, of a table with users as identifiers; some commits are whole for their chapters.
@query("""
WITH e AS (SELECT user_id AS id, user_id % 97 AS chapter, event_type AS kind, value, epoch_us(ts) // 86400000000 AS "commit", event_id AS place, event_id % 61 = 0 AS whole FROM events),
f AS (SELECT chapter, max("commit") AS floor FROM e WHERE whole GROUP BY chapter),
r AS (SELECT e.*, row_number() OVER (PARTITION BY id ORDER BY "commit" DESC, place DESC) AS k FROM e LEFT JOIN f ON f.chapter = e.chapter WHERE f.floor IS NULL OR e."commit" >= f.floor)
SELECT id, chapter, kind, value FROM r WHERE k = 1
""")
def merged_commits(spark: SparkSession, sf: str) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000)
    rows = table(spark, sf, "events").select(F.col("user_id").alias("id"), (F.col("user_id") % 97).alias("chapter"), F.col("event_type").alias("kind"), "value", day.alias("commit"), F.col("event_id").alias("place"), (F.col("event_id") % 61 == 0).alias("whole"))
    return deltas.merged(rows)


@query()
def tone_audio(spark: SparkSession, sf: str) -> DataFrame:
    return providers.spoken(planning.batches(render_plan(spark, sf), 16, 8000), "tone", what="digest")


#: Pieces fade into each other over 240 samples.
@query(f"""
WITH {LINES}, rows AS (SELECT id, text FROM lines), {chunks_sql("rows", "id", 120)}
SELECT id, CAST(list_sum(list_transform(chunks, lambda x: length(x) * 1600)) - 240 * (len(chunks) - 1) AS BIGINT) AS n_samples FROM chunked WHERE len(chunks) > 0
""")
def tone_lengths(spark: SparkSession, sf: str) -> DataFrame:
    plan = planning.plan(lines(spark, sf), state(lines(spark, sf)), spark.createDataFrame([], "audio string"), VOICES, provenance.backend_name("kokoro"), PARAMS, 120)
    return providers.spoken(planning.batches(plan, 16, 8000), "tone", what=None)


@query(f"""
WITH {LINES}, {TIMED}, g AS (SELECT *, (row_number() OVER (PARTITION BY chapter ORDER BY id) - 1) // 16 AS grp FROM p)
SELECT id, CAST(grp AS INTEGER) AS "group", round(coalesce(sum(duration + 0.5) OVER (PARTITION BY chapter, grp ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS start, duration > 28.0 AS alone FROM g
""")
def clip_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = verify.fixed_groups(timed(spark, sf), "id", 16, "chapter").withColumn("whose", F.struct("chapter", "group"))
    return verify.clips(groups, by="whose").select("id", "group", "start", verify.goes_alone(F.col("duration"), F.lit(2)).alias("alone"))




#: Conversations are books: the first words of even turns are the cast, each with itself without its last letter as an alias, and the words of odd turns have voices.
#: A word may have a style, lose a letter, or be spoken by a voice that doesn't exist, has another language or is a clip.
FIRST = r"""f AS (SELECT CAST(conv_id AS VARCHAR) AS book, turn, regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)', 1) AS w FROM conversations),
people AS (SELECT book, w AS name, CAST(min(turn) AS INTEGER) AS rank, left(w, -1) AS alias, min(turn) % 4 = 0 AS main FROM f WHERE turn % 2 = 0 AND w <> '' GROUP BY ALL),
entries AS (SELECT DISTINCT book, CASE WHEN turn % 5 = 0 THEN 'narrator' WHEN turn % 3 = 0 THEN left(w, -1) WHEN turn % 7 = 0 THEN w || '@loud' ELSE w END AS key,
  CASE turn % 6 WHEN 1 THEN 'af_heart' WHEN 3 THEN 'zf_xiaoni' ELSE 'nobody' END AS voice FROM f WHERE turn % 2 = 1 OR turn % 3 = 0),"""


def first_words(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Casts, entries and books."""
    word = F.regexp_extract(F.coalesce("text", F.lit("")), r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)", 1)
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("book"), "turn", word.alias("w"))
    short, t = F.expr("left(w, length(w) - 1)"), F.col("turn")
    casts = rows.where((t % 2 == 0) & (F.col("w") != "")).groupBy("book", "w").agg(F.min("turn").alias("t"))
    casts = casts.select("book", F.col("w").alias("name"), F.col("t").cast("int").alias("rank"), F.array(short).alias("aliases"), (F.col("t") % 4 == 0).alias("main"))
    key = F.when(t % 5 == 0, "narrator").when(t % 3 == 0, short).when(t % 7 == 0, F.concat("w", F.lit("@loud"))).otherwise(F.col("w"))
    voice = F.when(t % 6 == 1, "af_heart").when(t % 6 == 3, "zf_xiaoni").otherwise("nobody")
    entries = rows.where((t % 2 == 1) | (t % 3 == 0)).select("book", key.alias("key"), voice.alias("voice")).distinct()
    return casts, entries, rows.select("book").distinct().select("book", F.lit("kokoro").alias("backend"), F.lit("en").alias("lang"), F.array(F.lit("angry")).alias("styles"))


#: What of findings SQL can say: all but the nearest names.
@query(rf"""
WITH {FIRST}
forms AS (SELECT book, name, rank, 0 AS place, name AS form FROM people UNION ALL SELECT book, name, rank, 1, alias FROM people),
folds AS (SELECT book, regexp_replace(lower(form), '[^\p{{L}}\p{{N}}]', '', 'g') AS fold, name, rank, place FROM forms),
known AS (SELECT book, fold, arg_min(name, (rank, place)) AS name FROM folds WHERE fold <> '' GROUP BY ALL),
e AS (SELECT *, CASE WHEN key LIKE '%@%' THEN regexp_extract(key, '(?s)^(.*)@', 1) ELSE key END AS role, CASE WHEN key LIKE '%@%' THEN regexp_extract(key, '(?s)^.*@(.*)$', 1) END AS style FROM entries),
r AS (SELECT e.*, known.name, e.role <> 'narrator' AS person FROM e LEFT JOIN known ON known.book = e.book AND known.fold = regexp_replace(lower(e.role), '[^\p{{L}}\p{{N}}]', '', 'g'))
SELECT book, true AS error, 'nobody' AS kind, key, voice, NULL AS detail FROM r WHERE person AND name IS NULL
UNION ALL SELECT book, true, 'no voice', key, voice, NULL FROM r WHERE voice = 'nobody'
UNION ALL SELECT book, true, 'language', key, voice, 'zh' FROM r WHERE voice = 'zf_xiaoni'
UNION ALL SELECT book, false, 'style', key, voice, style FROM r WHERE style IS NOT NULL AND style <> 'angry'
UNION ALL SELECT book, false, 'alias', key, voice, name FROM r WHERE person AND name <> role
UNION ALL SELECT DISTINCT book, true, 'no narrator', NULL, NULL, NULL FROM f WHERE book NOT IN (SELECT book FROM entries WHERE key = 'narrator')
UNION ALL SELECT book, false, 'silent', name, NULL, NULL FROM people WHERE main AND (book, name) NOT IN (SELECT (book, key) FROM entries)
UNION ALL SELECT book, false, 'shared', NULL, voice, string_agg(key, ', ' ORDER BY key) FROM r WHERE person GROUP BY book, voice HAVING count(*) > 1
""")
def voice_findings(spark: SparkSession, sf: str) -> DataFrame:
    casts, entries, books = first_words(spark, sf)
    found = findings.findings(entries, casts, voices.pool_table(spark), spark.createDataFrame([], "book string, path string"), books)
    return found.withColumn("detail", F.when(F.col("kind") != "nobody", F.col("detail")))


#: The nearest names of all words of odd turns among those of even turns of the same conversation, by a ratio that SQL doesn't have.
@query()
def nearest_names(spark: SparkSession, sf: str) -> DataFrame:
    casts, entries, _ = first_words(spark, sf)
    return findings.nearest(entries.select("book", F.col("key").alias("role")), casts.select("book", "name")).select(F.col("book").cast("long").alias("conv_id"), "role", "name", "ratio")
