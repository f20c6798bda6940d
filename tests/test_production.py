from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline import providers
from storyline.operators import cast, planning, provenance, timeline, verify, voices
from storyline.operators.cast import Character
from storyline.sources import shared

LINES = "id string, chapter int, para int, kind string, speaker string, text string, lang string, style string, confidence double, locked boolean"


def line(k, speaker, text, chapter=0, style=None, kind="dialogue", confidence=0.95):
    return (f"c{chapter:03d}p{k:04d}s00", chapter, k, kind, speaker, text, "en", style, confidence, False)


VOICES = {"narrator": "n", "Ann": "a", "Ann@angry": "aa", "_default": "d", "_default@sad": "ds"}


@pytest.mark.parametrize(("speaker", "style", "voice"), [("Ann", "angry", "aa"), ("Ann", "sad", "a"), ("Ann", None, "a"), ("Bob", "sad", "ds"), ("Bob", "angry", "d"), ("Ann", "neutral", "a")])
def test_voice(value, speaker, style, voice):
    assert value(planning.resolve_voice(VOICES, F.lit(speaker), F.lit(style).cast("string"))) == voice


def test_voice_of_last_resort(value):
    assert value(planning.resolve_voice({"narrator": "n"}, F.lit("Bob"), F.lit(None).cast("string"))) == "n"
    with pytest.raises(Exception, match="no voice for Bob"):
        value(planning.resolve_voice({"Ann": "a"}, F.lit("Bob"), F.lit(None).cast("string")))


def test_style_keys(value):
    role, style = planning.split_key(F.lit("a@b@angry"))
    assert (value(role), value(style)) == ("a@b", "angry")
    role, style = planning.split_key(F.lit("plain"))
    assert (value(role), value(style)) == ("plain", None)
    assert planning.with_style_keys(["narrator", "Ann"], ["sad"]) == ["narrator", "Ann", "Ann@sad"]


def plan(spark, rows, state=(), inventory=(), **options):
    lines = spark.createDataFrame(rows, LINES)
    held = spark.createDataFrame(list(state), "id string, audio string, attempts int")
    there = spark.createDataFrame(list(inventory), "audio string")
    return planning.plan(lines, held, there, VOICES, "tone-test", {}, 30, **options)


def test_plan_uses_the_cache_and_restarts_attempts(spark):
    rows = [line(0, "Ann", "Hello there."), line(1, "Ann", "And more.")]
    first = {r.id: r for r in plan(spark, rows).collect()}
    assert all(r.chunks == [r.text] for r in first.values())
    have = [(r.audio,) for r in first.values()]
    assert [r.chunks for r in plan(spark, rows, inventory=have).collect()] == [None, None]
    assert all(r.chunks for r in plan(spark, rows, inventory=have, force=True).collect())
    moved = plan(spark, rows[:1], state=[(rows[0][0], "05-audio/old.wav", 2)], inventory=have).first()
    assert moved.attempts == 0 and moved.chunks is None
    again = plan(spark, rows[:1], state=[(rows[0][0], None, 1)], inventory=have).first()
    assert again.attempts == 1 and again.audio != first[rows[0][0]].audio and again.chunks


def test_batches_by_voice_and_budget(spark):
    rows = [line(0, "narrator", "One is here. Two is here now. Three is here too."), line(1, "narrator", "Short."), line(2, "narrator", "A bit longer."), line(3, "Ann", "Hi."), line(4, "Ann", "Hi again."), line(5, "Bob", "Yes.")]
    made = planning.batches(plan(spark, rows), 4, 0).collect()
    sizes = {}
    for r in made:
        sizes.setdefault((r.voice, r.batch), []).append((r.place, len(r.chunk)))
    assert sorted((v, len(x)) for (v, _), x in sizes.items()) == [("a", 2), ("d", 1), ("n", 4)]
    assert all([n for _, n in sorted(x)] == sorted(n for _, n in x) for x in sizes.values())
    same = [line(k, "Ann", f"Word {k:02d}.") for k in range(20)]
    cost = planning.batches(plan(spark, same), 100, 0).first().cost
    by = planning.batches(plan(spark, same), 100, 5 * cost).groupBy("batch").count().collect()
    assert [r["count"] for r in by] == [5] * 4
    assert sorted(r["count"] for r in planning.batches(plan(spark, same), 8, 0).groupBy("batch").count().collect()) == [4, 8, 8]
    assert planning.batch_size(None, 24, True) == 24 and planning.batch_size(8, 24, False) == 1


def test_audio_is_made_in_as_many_tasks_as_the_session_has(spark):
    """Texts are small and their audio is not: Spark would gather the texts of a small table in one task."""
    jobs = spark.range(200).select(F.concat(F.lit("v"), F.col("id") % 50).alias("voice"), F.lit("{}").alias("params"), F.format_string("l%06d", "id").alias("id"), F.array(F.lit("x")).alias("chunks"))
    batches = planning.batches(jobs, 4, 0)
    for step in ("synthesize", "spoken"):
        made = getattr(providers, step)(batches, "tone")
        assert made.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_lines_are_spoken_alike_in_batches_and_alone(spark):
    class Several(providers.Tone):
        def synthesize_batch(self, texts, voice, lang="en", **params):
            return [self.synthesize(t, voice, lang) for t in texts]

    text = " ".join(f"This is number {k}, which goes on and on for {k} words." for k in range(30))
    batches = planning.batches(plan(spark, [line(0, "Ann", text), line(1, "Ann", "Short."), line(2, "Bob", text[::-1])]), 4, 0)
    want = {r.id: (r.n_samples, bytes(r.audio)) for r in providers.joined_audio(providers.synthesize(batches, "tone")).collect()}
    for provider in ("tone", Several):
        assert {r.id: (r.n_samples, bytes(r.audio)) for r in providers.spoken(batches, provider).collect()} == want
        assert {tuple(r) for r in providers.spoken(batches, provider, what="digest").collect()} == {(k, n, hashlib.sha256(a).hexdigest()) for k, (n, a) in want.items()}
        assert {tuple(r) for r in providers.spoken(batches, provider, what=None).collect()} == {(k, n) for k, (n, _) in want.items()}


def test_fading_by_one_copy(spark):
    """Against joining pieces one by one, with pieces that are empty or shorter than a fade."""
    rng, pieces = np.random.default_rng(5), []
    for n in (0, 3, 5, 1000, 0, 7, 240, 239, 2, 2, 900):
        pieces.append(rng.normal(size=n).astype(np.float32))
        out = np.zeros(0, np.float32)
        for p in (p for p in pieces if len(p)):
            k = min(240, len(out), len(p))
            ramp = np.linspace(0, 1, k, dtype=np.float32)
            out = np.concatenate([out[: len(out) - k], out[len(out) - k :] * (1 - ramp) + p[:k] * ramp, p[k:]])
        assert np.array_equal(providers.crossfade(pieces, 24000), out)
        assert providers.joined_length([len(p) for p in pieces], 24000) == len(out)


def test_one_voice_of_one_length_is_spread(spark, monkeypatch):
    """All chunks are alike in voice and length; no range of them has most, and batches are as adding them one by one would cut them."""
    monkeypatch.setattr(planning, "written", lambda df, name: ranges.setdefault(name, real(df, name)))
    real, ranges = shared.written, {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        jobs = spark.range(20000).select(F.lit("v").alias("voice"), F.lit("{}").alias("params"), F.format_string("l%06d", "id").alias("id"), F.array(F.lit("same text")).alias("chunks"))
        got = planning.batches(jobs, 7, 0).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.place, r.batch, r.id) for r in got] == [(k, k // 7, f"l{k:06d}") for k in range(20000)]
    sizes = [r["count"] for r in ranges["batches"].groupBy(F.shiftright("at", 33)).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 12000


def test_pieces_join_by_number_not_by_arrival(spark):
    pieces = spark.createDataFrame([("x", 1, "b"), ("x", 0, "a"), ("x", 10, "c")], "id string, chunk_idx int, audio string")
    assert planning.reassembled(pieces).first().pieces == ["a", "b", "c"]


def test_tone_and_joining(spark):
    rows = [line(0, "Ann", "One is here. Two is here now. Three is here too."), line(1, "Ann", "Short.")]
    single, batched = (providers.joined_audio(providers.synthesize(planning.batches(plan(spark, rows), n, 0), "tone")).orderBy("id").collect() for n in (1, 8))
    assert [(r.id, r.n_samples, bytes(r.audio)) for r in single] == [(r.id, r.n_samples, bytes(r.audio)) for r in batched]
    assert batched[1].n_samples == int(24000 * 6 / 15)
    assert len(providers.crossfade([np.ones(500, np.float32), np.zeros(0, np.float32), np.ones(500, np.float32)], 1000)) == 990
    assert len(providers.silence(0.5, 1000)) == 500
    with pytest.raises(KeyError):
        providers.speech("nobody")


@pytest.mark.parametrize(
    ("text", "transcript", "lang", "edits", "rate"),
    [("A b c.", "a B c", "en", 0, 0.0), ("one two three four five six", "one two three four six", "en", 1, 1 / 6), ("one two", "", "en", 2, 1.0), ("", "", "en", 0, 0.0), ("", "x y", "en", 2, 1.0), ("我有15只猫", "我有十五只猫", "zh", 0, 0.0), ("你好吗", "你好", "zh", 1, 1 / 3)],
)
def test_error_rates(spark, text, transcript, lang, edits, rate):
    got = verify.compare(spark.createDataFrame([(text, transcript)], "text string, transcript string"), lang).first()
    assert got.edits == edits and got.error_rate == pytest.approx(rate)


def test_edit_distance_against_the_plain_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.integers(0, 4, rng.integers(0, 12)) for _ in range(2))
        table = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert verify.edit_distance(a, b) == table[len(a), len(b)]


@pytest.mark.parametrize("most", [0, 1, 40, 130, 2000])
def test_bit_vectors_against_the_plain_recurrence(most):
    """Texts of up to 2000 tokens, beyond any machine word, of few and of many kinds of tokens, alike and unlike."""
    rng = np.random.default_rng(most)
    for kinds in (1, 2, 5, 400):
        a = rng.integers(0, kinds, most)
        b = np.delete(np.insert(a, rng.integers(0, most + 1, 3), 7), rng.integers(0, most + 1, min(2, most))) if kinds == 400 else rng.integers(0, kinds, rng.integers(0, most + 1))
        columns = np.arange(len(b) + 1)
        row = columns.copy()
        for k, token in enumerate(a, 1):
            changed = np.append(k, np.minimum(row[1:] + 1, row[:-1] + (b != token)))
            row = np.minimum.accumulate(changed - columns) + columns
        assert verify.edit_distance(a, b) == verify.edit_distance(b, a) == row[-1]


def test_texts_are_split_as_tokens_are(spark):
    """What Python splits at is what the array of tokens is split at: white space of all kinds, and none that is left out before."""
    texts = ["a\u00a0b\u2003c d\u0085e\x1cf\x1fg h", " \t\n", "", None, "\u3000x  y, z!", "co-op it's _u \u200b v\u2028w"]
    rows = spark.createDataFrame([(t, t) for t in texts], "text string, transcript string").withColumn("c", verify.compared(verify.spaced(F.col("text")), verify.spaced(F.col("transcript"))))
    for r in rows.withColumn("tokens", verify.tokens(F.col("text"))).collect():
        assert r.c.edits == 0 and r.c.reference == r.c.hypothesis == len(r.tokens or []) and r.c.kinds == len(set(r.tokens or []))


def test_pronunciation_table(value):
    same = lambda c: F.when(c.isin("风", "峰"), "feng").when(c.isin("林"), "lin")
    assert value(verify.tokens(F.lit("林风 ok"), "zh", same)) == ["lin", "feng", "ok"] == value(verify.tokens(F.lit("林峰ok"), "zh", same))


@pytest.mark.parametrize(("text", "rate", "edits", "seconds", "lang", "ok"), [("哒哒哒哒", 1.0, 9, 3.4, "zh", True), ("哒哒哒哒", 1.0, 9, 20.0, "zh", False), ("one two three four five six seven", 0.5, 3, 2.0, "en", False), ("one two three four five six seven", 0.2, 1, 2.0, "en", True), ("one two three four five six seven", 0.15, 3, 2.0, "en", True)])
def test_verdict(value, text, rate, edits, seconds, lang, ok):
    assert value(verify.judge(F.lit(text), F.lit(rate), F.lit(edits), F.lit(seconds), lang)) is ok


def test_clips_and_segments(spark):
    clips = verify.clips(spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (0, "c", 0.5)], "group int, id string, duration double"))
    assert [(r.start, r.end) for r in clips.orderBy("id").collect()] == [(0.0, 1.0), (1.5, 3.5), (4.0, 4.5)]
    segments = spark.createDataFrame([(0, 0.0, " a "), (0, 1.4995, "b1"), (0, 2.4, "b2"), (0, 4.0, "c"), (0, -1.0, "early")], "group int, start double, text string")
    got = {r.id: r.transcript for r in verify.segments_to_clips(segments, clips).collect()}
    assert got == {"a": "early a", "b": "b1 b2", "c": "c"}
    groups = verify.fixed_groups(spark.createDataFrame([("x", k) for k in range(5)], "w string, id int"), "id", 2, "w")
    assert [r.group for r in groups.orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_retries_end(spark):
    state = spark.createDataFrame([("good", "g0", 0), ("bad", "b0", 0)], "id string, audio string, attempts int")
    render = lambda s: s.withColumn("audio", F.coalesce("audio", F.concat(F.substring("id", 1, 1), F.col("attempts").cast("string"))))
    check = lambda s: s.select("id", "audio", F.lit(0.5).alias("error_rate"), (F.col("id") == "good").alias("ok"))
    keep = lambda df, name: df.sparkSession.createDataFrame(df.collect(), df.schema)
    end, results = verify.verify_until_done(state, render, check, 3, keep)
    assert {r.id: (r.audio, r.attempts) for r in end.collect()} == {"good": ("g0", 0), "bad": ("b2", 2)}
    assert tuple(verify.summary(end, results).first()) == (2, 0.5, 1)


def test_timeline(spark):
    rows = spark.createDataFrame([(0, "1", "a", 1.0), (0, "2", "a", 1.0), (0, "3", "b", 1.0), (1, "4", "b", 2.0)], "chapter int, id string, speaker string, duration double")
    assert [(r.pause, round(r.start, 6), round(r.end, 6)) for r in timeline.with_offsets(rows).orderBy("id").collect()] == [(2.5, 2.5, 3.5), (0.6, 4.1, 5.1), (1.2, 6.3, 7.3), (2.5, 2.5, 4.5)]
    chapters = timeline.chapter_durations(rows).withColumn("book", F.lit("B=1")).withColumn("title", F.lit("T;#")).withColumn("author", F.lit("A"))
    marked = timeline.markers(chapters.withColumn("duration", F.col("duration").cast("decimal(9,3)").cast("double") + 0.0001))
    assert [(r.start_ms, r.end_ms) for r in marked.orderBy("chapter").collect()] == [(0, 7900), (7900, 13000)]
    assert timeline.metadata(marked).first().metadata.startswith(";FFMETADATA1\ntitle=B\\=1\nartist=A\nalbum=B\\=1\ngenre=Speech\n\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=7900\ntitle=T\\;\\#\n")
    files = spark.createDataFrame([("b", 1, "/y"), ("b", 0, "/x")], "book string, chapter int, path string")
    assert timeline.concat_list(files).first()["list"] == "file '/x'\nfile '/y'\n"
    done = spark.createDataFrame([("b", True, True), ("b", True, False), ("c", True, True)], "book string, ready boolean, fresh boolean")
    assert {r.book: r.complete for r in timeline.complete(done).collect()} == {"b": False, "c": True}
    state = spark.createDataFrame([("b", "1", None), ("b", "2", "x")], "book string, id string, backend string")
    assert timeline.book_backend(state).first().backend == "x"


def test_stale_reasons(spark):
    maps = [("fresh", {"a": "1", "b": "2"}, {"a": "1", "b": "2"}, True), ("changed", {"a": "1", "b": "2"}, {"a": "0", "b": "2"}, True), ("missing", {"a": "1"}, None, False), ("no stamp", {"a": "1"}, None, True), ("unknown", {"a": "1"}, {"a": "1", "z": "1"}, True)]
    rows = spark.createDataFrame(maps, "k string, now map<string,string>, then map<string,string>, there boolean")
    got = {r.k: r.v for r in rows.select("k", provenance.stale_reasons(F.col("now"), F.col("then"), F.col("there")).alias("v")).collect()}
    assert got == {"fresh": [], "changed": ["a"], "missing": ["missing"], "no stamp": ["no stamp"], "unknown": ["unknown"]}


def test_lines_without_audio_make_a_chapter_stale(spark):
    reasons = spark.createDataFrame([(0, []), (1, ["lines"]), (2, [])], "chapter int, reasons array<string>")
    lines = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 2)], "id string, chapter int")
    state = spark.createDataFrame([("a", "x"), ("b", None), ("d", "y")], "id string, audio string")
    inventory = spark.createDataFrame([("x",), ("y",)], "audio string")
    got = {r.chapter: r.reasons for r in provenance.render_reasons(reasons, lines, state, inventory).collect()}
    assert got == {0: ["1 lines without audio"], 1: ["lines"], 2: []}


def test_fix_and_script(spark):
    lines = spark.createDataFrame([line(0, "unknown", "Hi, you.", confidence=0.0), line(1, "Bob", "Yes, sir.", confidence=0.5, style="angry"), line(2, "narrator", "He left.", kind="narration")], LINES)
    edits = spark.createDataFrame([("c000p0000s00", "Ann", None, "soft", None), ("c000p0001s00", None, "No, sir.", "neutral", True)], "id string, speaker string, text string, style string, unlock boolean")
    fixed = provenance.fix_lines(lines, edits)
    failed = spark.createDataFrame([("c000p0001s00",)], "id string")
    assert [r.line for r in provenance.script(lines, failed).orderBy("id").collect()] == ["`c000p0000s00` **unknown** (!): Hi, you.", "`c000p0001s00` **Bob** (?) [x] {angry}: Yes, sir.", "`c000p0002s00` **narrator**: He left."]
    assert [r.line for r in provenance.script(fixed, failed.limit(0)).orderBy("id").collect()][:2] == ["`c000p0000s00` **Ann** [lock] {soft}: Hi, you.", "`c000p0001s00` **Bob**: No, sir."]
    assert provenance.without_fixed(lines, edits).count() == 1
    with pytest.raises(Exception, match="no such style"):
        provenance.fix_lines(lines, edits.withColumn("style", F.lit("loud"))).collect()


def test_status(spark):
    states = spark.createDataFrame([(0, "render", []), (1, "render", ["lines"]), (0, "build", ["missing"]), (1, "build", ["missing"])], "chapter int, stage string, reasons array<string>")
    grid = provenance.chapter_grid(states.select("chapter").distinct(), states)
    assert [(r.attribute, r.render, r.build) for r in grid.orderBy("chapter").collect()] == [("missing", "fresh", "missing"), ("missing", "stale", "missing")]
    assert {r.stage: (r.status, r.detail, r.reasons) for r in provenance.stage_status(states).collect()} == {"render": ("stale", "1/2 chapters fresh", "lines"), "build": ("missing", "0/2 chapters fresh", "")}
    assert provenance.chapter_set("3, 5-7,0") == {0, 3, 5, 6, 7}
    with pytest.raises(ValueError, match="x"):
        provenance.chapter_set("x")


def test_profiles(spark):
    people = [Character("a", description="A middle-aged woman, his wife"), Character("b", description="an old man"), Character("c", description="男性，16岁"), Character("d", description="无性别"), Character("e", description="her brother and his sister")]
    assert voices.profiles(spark, people) == {"a": ("f", "adult"), "b": ("m", "old"), "c": ("m", "young"), "d": ("?", "?"), "e": ("?", "?")}


def test_assign():
    pool = voices.pool("kokoro", "en")
    out = voices.assign([(str(k), ("?", "?")) for k in range(12)], pool)
    assert out["narrator"] == out["_default"] == "am_michael" and len({out[str(k)] for k in range(12)}) == 12 and "am_michael" not in [out[str(k)] for k in range(12)]
    two = [v for v in pool if v[0] in ("af_heart", "am_adam")] + [v for v in pool if v[0] in ("bf_emma", "bm_george")]
    used = list(voices.assign([(str(k), ("f" if k % 2 else "m", "?")) for k in range(6)], two).values())
    assert max(used.count(v) for v in used) <= 4
    assert voices.assign([("x", ("f", "?"))], pool, {"x": "am_adam", "narrator": "bm_george"})["x"] == "am_adam"


def test_assign_for_many_books(spark):
    """Each book as one by itself, its roles by lines; null is a book too."""
    pool = voices.pool("kokoro", "en")
    kinds = ["an old man", "a young girl", "his wife", "", None, "a middle-aged woman"]
    rows = [(b, f"r{k:02d}", kinds[(k * 7 + n) % 6], (k * 5) % 9) for n, b in enumerate(["x", "y", None]) for k in range(20)]
    got = voices.assigned(spark.createDataFrame(rows, "book string, role string, description string, lines int").repartition(5), pool).collect()
    for b in ("x", "y", None):
        people = [Character(r, description=d or "") for _, r, d, n in sorted((r for r in rows if r[0] == b), key=lambda r: (-r[3], r[1]))]
        found = voices.profiles(spark, people)
        assert {r.role: r.voice for r in got if r.book == b} == voices.assign([(c.name, found[c.name]) for c in people], pool)
    assert voices.assigned(spark.createDataFrame([], "book string, role string, description string, lines int"), pool).collect() == []


def test_wishes_come_in_order():
    """Gender before use, use before age, age before not being the narrator's, and then the pool's order."""
    pool = [("n", "en", "m", "old", True), ("f1", "en", "f", "young", False), ("m1", "en", "m", "young", False), ("m2", "en", "m", "adult", False)]
    out = voices.assign([("a", ("m", "adult")), ("b", ("m", "adult")), ("c", ("m", "old")), ("d", ("f", "old")), ("e", ("f", "?")), ("g", ("m", "old")), ("h", ("?", "young"))], pool)
    assert [out[k] for k in "abcdegh"] == ["m2", "m1", "n", "f1", "f1", "m1", "m2"]


def test_voice_check():
    people = [Character("Elizabeth", ["Lizzy"]), Character("Jane")]
    errors, warnings = voices.check({"Elizabet": "af_heart", "Lizzy": "zf_xiaoni", "Jane@loud": "nope"}, people, "kokoro", "en", ["angry"])
    assert any("no narrator" in e for e in errors) and any("'Elizabeth'" in e for e in errors) and any("no such voice" in e for e in errors) and any("doesn't speak en" in e for e in errors)
    assert any("alias" in w for w in warnings) and any("'loud'" in w for w in warnings) and any("main cast" in w for w in warnings)
    errors, _ = voices.check({"narrator": "voices/a.wav"}, [], "qwen3tts", "en")
    assert errors == ["voices.qwen3tts.narrator: no such clip: voices/a.wav"]
    assert voices.voice_map_of({"kokoro": {"narrator": "x"}, "stray": "y"}, "kokoro") == {"narrator": "x"}
    assert voices.with_voice_map({"narrator": "x"}, "qwen3tts", {"narrator": "y"}, "kokoro") == {"kokoro": {"narrator": "x"}, "qwen3tts": {"narrator": "y"}}


def test_samples_and_designs(spark):
    rows = spark.createDataFrame([line(0, "Ann", "Hi."), line(1, "Ann", "This is me."), line(2, "Ann", "x" * 155), line(3, "Ann", "And I go on."), line(4, "Bob", "Too short")], LINES)
    samples = voices.sample_texts(rows)
    assert [(r.speaker, r.sample) for r in samples.collect()] == [("Ann", "This is me. And I go on.")]
    roles = spark.createDataFrame([("narrator", "calm"), ("Ann", "bright")], "role string, description string")
    got = sorted(tuple(r) for r in voices.design_plan(roles, samples, "en", ["angry", "sad"], "Default.").collect())
    assert [g[0] for g in got] == ["Ann", "Ann@angry", "Ann@sad", "narrator"] and got[1][1] == "voices/Ann.angry.wav" and got[1][3] == "bright, angry, raised voice, sharp and forceful" and got[3][2] == "Default."


def test_cast_merge_and_rank(spark):
    people = [Character("Ann", ["Annie"], chapters=[0]), Character("Bob")]
    entries = [{"chapter": 3, "name": "annie", "aliases": ["Miss A"], "description": "d"}, {"chapter": 4, "name": "Kid", "aliases": [], "description": "a kid"}]
    merged = cast.merge_entries(people, entries, [])
    assert [(c.name, c.aliases, c.chapters) for c in merged] == [("Ann", ["Annie", "annie", "Miss A"], [0, 3]), ("Bob", [], []), ("Kid", [], [4])]
    grouped = cast.merge_entries(people, entries[1:], [{"canonical": "Robert", "aliases": ["Bob", "Kid"], "description": "r"}])
    assert [(c.name, c.aliases, c.chapters, c.description) for c in grouped] == [("Ann", ["Annie"], [0], ""), ("Bob", ["Robert", "Kid"], [4], "r")]
    chapters = spark.createDataFrame([(0, ["Bob Bob", "Annie Ann"]), (1, ["Bob"])], "chapter int, paragraphs array<string>")
    spoken = spark.createDataFrame([(0, "Ann"), (1, "Ann"), (1, "Bob")], "chapter int, speaker string")
    ranked = cast.rank_cast(spark, people, chapters, spoken, main_cap=1).orderBy("rank").collect()
    assert [(r.name, r.lines, r.mentions, r.main, r.chapters) for r in ranked] == [("Ann", 2, 3, True, [0, 1]), ("Bob", 1, 3, False, [1])]
    assert cast.from_table(cast.cast_table(spark, people)) == people
    assert cast.cast_hash(people) == cast.cast_hash([Character("Ann", ["Annie"], "other", False), Character("Bob")]) != cast.cast_hash(people[:1])
    assert cast.names_for_chapter([Character("a", main=False, chapters=[2]), Character("b")], 2) == ["a", "b"]
