"""A book through all seven stages with stand-in providers, and what makes each of them stale."""

from __future__ import annotations

import json
import sys
import textwrap
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline import providers
from storyline.__main__ import main
from storyline.book import Book
from storyline.operators import attribution, cast
from storyline.operators.cast import Character

SOURCE = """CHAPTER I

"Good morning, sir," said Ann. "How are you this fine morning, if I may ask?"

The day was fine, and nobody else was to be seen.

CHAPTER II

"I am well, thank you, and so is my brother," replied Bob.
"""
CONFIG = {"title": "T", "genre": "Tales", "voices": {"narrator": "a220", "Ann": "a330", "_default": "a440"}, "tts": {"checkpoint_chapters": 1}, "verify": {"provider": "echo", "max_attempts": 3}}


@pytest.fixture
def root(tmp_path):
    (tmp_path / "source.txt").write_text(SOURCE)
    (tmp_path / "book.json").write_text(json.dumps(CONFIG))
    return tmp_path


def echo(book, wrong=()):
    """Hears every line as it is written, and those whose current audio is in `wrong` not at all."""
    def hear(rows):
        lines = book.read("lines").select("id", F.col("text").alias("transcript"))
        return rows.join(lines, "id").select("id", F.when(F.col("audio").isin(list(wrong) or ["-"]), "").otherwise(F.col("transcript")).alias("transcript"))
    return hear


def states(book):
    return {(r.chapter, r.stage): r.reasons for r in book.states().collect()}


def test_seven_stages(spark, root, monkeypatch):
    monkeypatch.setattr(Book, "heard", lambda book, lines: echo(book)(lines))
    assert main(["run", str(root), "--skip", ""]) == 0
    book = Book(spark, str(root))
    assert [c.name for c in book.cast()] == ["Ann", "Bob"] and all(c.main for c in book.cast())
    assert set(map(tuple, states(book).values())) == {()}
    assert {r.stage: r.status for r in book.status().collect()} == dict.fromkeys(["ingest", "normalize", "attribute", "render", "verify", "build"], "fresh")
    assert [(r.lines, r.rendered, r.verified) for r in book.progress().orderBy("chapter").collect()] == [(4, 4, 4), (2, 2, 2)]
    assert "genre=Tales" in book.read("metadata").first().metadata
    asked = spark.read.json(f"{book.work}/exchanges").collect()
    assert len(asked) >= 2 and {r.model for r in asked} == {"tagged"}
    assert book.has("review/attribute") and book.has("review/verify")
    before = len(asked)
    assert [c.name for c in book.find_cast(force=True)] == ["Ann", "Bob"]  # unchanged chapters aren't asked about again, only the merge is
    assert spark.read.json(f"{book.work}/exchanges").count() == before + 1

    lost = book.read("render").where("id = 'c001p0000s00'").first().audio
    book.read("audio").where(F.col("audio") != lost).write.parquet(f"{book.work}/less")
    spark.read.parquet(f"{book.work}/less").write.mode("overwrite").parquet(f"{book.work}/audio")
    assert states(book)[1, "render"] == ["1 lines without audio"] and states(book)[0, "render"] == []
    (root / "overrides.json").write_text(json.dumps({"fine": "fair"}))
    assert {r.stage: r.reasons for r in book.whole_states().collect()} == {"ingest": [], "normalize": ["overrides"]}
    (root / "source.txt").write_text(SOURCE + "\nMore.\n")
    assert {r.stage: r.reasons for r in book.whole_states().collect()}["ingest"] == ["source"]
    (root / "book.json").write_text(json.dumps(CONFIG | {"pauses": {"paragraph": 0.9}, "verify": {"provider": "echo", "threshold": 0.2}}))
    later = states(Book(spark, str(root)))
    assert later[0, "build"] == ["pauses"] and later[0, "verify"] == ["threshold"]


def test_failed_lines_are_rendered_again(spark, root):
    (root / "cast.json").write_text(json.dumps([{"name": "Ann"}, {"name": "Bob"}]))
    main(["run", str(root), "--to", "render"])
    book = Book(spark, str(root))
    first = {r.id: r.audio for r in book.read("render").collect()}
    bad = ["c000p0000s02", "c001p0000s00"]
    results = {r.id: r for r in book.verify(echo(book, [first[i] for i in bad])).collect()}
    now = {r.id: r for r in book.read("render").collect()}
    assert all(r.ok for r in results.values()) and len(results) == 6
    assert all(now[i].attempts == 1 and now[i].audio != first[i] for i in bad)
    assert all(now[i].attempts == 0 and now[i].audio == first[i] for i in first if i not in bad)
    assert states(book)[0, "verify"] == states(book)[1, "verify"] == states(book)[0, "render"] == []
    book.verify(lambda rows: rows.select("id", F.lit("").alias("transcript")), force=True)  # nothing is ever heard
    assert max(r.attempts for r in book.read("render").collect()) == 2 and book.read("render").where("audio IS NULL").count() == 0
    assert book.read("verify").where("NOT ok").count() > 0 and states(book)[0, "verify"] == []


def test_clips_are_voices_by_content(spark, root):
    (root / "voices").mkdir()
    (root / "voices/a.wav").write_bytes(b"one")
    (root / "book.json").write_text(json.dumps(CONFIG | {"voices": {"narrator": "voices/a.wav", "_default": "a220"}}))
    main(["run", str(root), "--to", "render"])
    book = Book(spark, str(root))
    assert states(book)[0, "render"] == []
    (root / "voices/a.wav").write_bytes(b"two")
    assert states(book)[0, "render"] == ["voices"]


def test_prompts_over_budget_are_not_sent(spark):
    class Model:
        prompt_tokens = None

        def answer(self, prompt, system):
            return {"got": len(prompt)}

    class Reader(Model):
        prompt_tokens = 900

    rows = spark.createDataFrame([(0, 0, "a" * 300)], "chapter int, window int, passage string")
    assert providers.ask(rows, Model, budget=100).first().response == '{"got": 300}'
    with pytest.raises(Exception, match="a prompt has more than the 99 tokens allowed: 100"):
        providers.ask(rows, Model, budget=99).collect()
    with pytest.raises(Exception, match="the model read 900 tokens"):
        providers.ask(rows, Reader, budget=500).collect()
    assert attribution.over_budget(rows.select(F.lit("s").alias("system"), F.repeat("passage", F.lit(200)).alias("prompt"))).count() == 1
    assert attribution.tokens_of("你好 ab") == 3 == spark.range(1).select(attribution.approx_tokens(F.lit("你好 ab"))).first()[0]


def test_only_unknown_entries_are_asked_about():
    people = [Character("Ann", ["Annie"])]
    entries = [{"name": "annie", "aliases": [], "description": ""}, {"name": "Kid", "aliases": ["Boy"], "description": "small"}, {"name": "Kid", "aliases": [], "description": ""}]
    assert [e["name"] for e in cast.unresolved(people, entries)] == ["Kid"]
    prompt = cast.merge_prompt("{known}|{entries}", "none", people, entries[1:2])
    assert prompt == "- Ann (Annie)|- Kid (aka Boy): small" and cast.merge_prompt("{known}", "none", [], []) == "none"


def test_kokoro_voices_and_languages():
    assert [providers.kokoro_code(v, lang) for v, lang in (("af_heart", "en"), ("bm_george", "en"), ("zf_xiaoni", "zh"))] == ["a", "b", "z"]
    for voice, lang in (("zf_xiaoni", "en"), ("af_heart", "zh")):
        with pytest.raises(ValueError, match=voice):
            providers.kokoro_code(voice, lang)


WORKER = """
import json, sys, wave
print("loading the model")
print(json.dumps({"ready": True, "sr": 8000, "batch": True}), flush=True)
def make(text, path):
    with wave.open(path, "wb") as f:
        f.setnchannels(1); f.setsampwidth(2); f.setframerate(8000)
        f.writeframes(b"\\x00\\x40" * len(text))
    return path
for line in sys.stdin:
    r = json.loads(line)
    texts = [i["text"] for i in r["items"]] if r.get("kind") == "batch" else [r["text"]]
    if "stop" in texts:
        break
    if "bad" in texts and r.get("kind") == "batch" or texts == ["never"]:
        print(json.dumps({"ok": False, "error": "no such text"}), flush=True)
    elif r.get("kind") == "batch":
        print(json.dumps({"ok": True, "paths": [make(i["text"], i["out"]) for i in r["items"]]}), flush=True)
    else:
        print(json.dumps({"ok": True, "path": make(r["text"], r["out"])}), flush=True)
"""


def test_a_worker_program(tmp_path):
    (tmp_path / "worker.py").write_text(textwrap.dedent(WORKER))
    worker = providers.Worker([sys.executable, str(tmp_path / "worker.py")], "own")
    assert worker.synthesize("four", "v").tolist() == [0.5] * 4 and worker.sample_rate == 8000
    assert [len(x) for x in worker.synthesize_batch(["a", "bbb"], "v")] == [1, 3]
    assert [len(x) for x in worker.synthesize_batch(["bad", "x"], "v")] == [3, 1]  # the batch fails, its texts don't
    with pytest.raises(ValueError, match="no such text"):
        worker.synthesize("never", "v")
    with pytest.raises(RuntimeError, match="ended"):
        worker.synthesize("stop", "v")
    with wave.open(str(tmp_path / "x.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(16000)
        f.writeframes(b"\0\0")
    with pytest.raises(RuntimeError, match="16000"):
        worker.samples(str(tmp_path / "x.wav"))
    worker.close()


RESTART = """
import json, os, sys, time, wave
print(json.dumps({"ready": True, "sr": 8000, "batch": True}), flush=True)
for line in sys.stdin:
    r = json.loads(line)
    items = r["items"] if r.get("kind") == "batch" else [r]
    with open(os.path.join(sys.argv[1], "asked"), "a") as f:
        f.write(json.dumps([i["text"] for i in items]) + "\\n")
    if any(i["text"] == "die" for i in items) and not os.path.exists(os.path.join(sys.argv[1], "died")):
        open(os.path.join(sys.argv[1], "died"), "w").close()
        break
    if any(i["text"] == "hang" for i in items):
        time.sleep(60)
    if sum(i["text"].startswith("bad") for i in items) and len(items) > 1:
        print(json.dumps({"ok": False, "error": "too hard"}), flush=True)
        continue
    for i in items:
        with wave.open(i["out"], "wb") as f:
            f.setnchannels(1); f.setsampwidth(2); f.setframerate(8000)
            f.writeframes(b"\\x00\\x40" * len(i["text"]))
    print("[1, 2]")
    print(json.dumps({"ok": True, "paths": [i["out"] for i in items]} if "items" in r else {"ok": True, "path": r["out"], "lang_code": r["params"].get("lang_code")}), flush=True)
"""


@pytest.fixture
def program(tmp_path):
    (tmp_path / "program.py").write_text(RESTART)
    asked = lambda: [json.loads(x) for x in (tmp_path / "asked").read_text().splitlines()]
    return [sys.executable, str(tmp_path / "program.py"), str(tmp_path)], asked


def test_a_program_that_ends_is_started_again(program):
    command, asked = program
    worker = providers.Worker(command, "own")
    assert [len(x) for x in worker.synthesize_batch(["one", "die"], "v")] == [3, 3]
    assert asked() == [["one", "die"], ["one", "die"]]
    worker.close()


def test_refused_batches_are_halved(program):
    command, asked = program
    worker = providers.Worker(command, "own")
    assert [len(x) for x in worker.synthesize_batch(["a", "bb", "ccc", "bad2"], "v")] == [1, 2, 3, 4]
    assert sorted(asked()) == sorted([["a", "bb", "ccc", "bad2"], ["ccc", "bad2"], ["bad2"], ["ccc"], ["a", "bb"]])
    worker.close()


def test_a_program_that_hangs_is_given_up(program):
    command, asked = program
    worker = providers.Worker(command, "own", deadline=2, restarts=1)
    with pytest.raises(RuntimeError, match="no answer in 2 s"):
        worker.synthesize("hang", "v")
    assert len(asked()) == 2
    with pytest.raises(RuntimeError, match="8000 samples a second, and the configuration says 24000"):
        providers.Worker(command, "own", sample_rate=24000).synthesize("x", "v")


def test_programs_by_configuration(spark, root, program):
    command, asked = program
    for backend in ("qwen3tts", "chatterbox", "subprocess"):
        with pytest.raises(KeyError, match="tts.command"):
            providers.configured({"backend": backend})
    made = providers.configured({"backend": "qwen3tts", "command": command, "sample_rate": 8000, "batch_size": 3})()
    assert (made.name, made.batch_size, made.max_chars, made.sample_rate) == ("qwen3tts-1.7B", 3, 300, 8000)
    assert type(providers.configured({"backend": "tone"})()) is providers.Tone
    kokoro = providers.configured({"backend": "kokoro", "command": command, "sample_rate": 8000})()
    assert len(kokoro.synthesize("four", "bm_george")) == 4
    with pytest.raises(ValueError, match="zf_xiaoni"):
        kokoro.synthesize("four", "zf_xiaoni")
    kokoro.close()
    (root / "cast.json").write_text("[]")
    (root / "book.json").write_text(json.dumps(CONFIG | {"tts": {"backend": "subprocess", "command": command, "sample_rate": 8000, "batch_size": 4}}))
    assert main(["run", str(root), "--to", "render"]) == 0
    book = Book(spark, str(root))
    lengths = {r.id: len(r.text) for r in book.table("lines").collect()}
    assert {r.id: r.n_samples for r in book.table("render").join(book.inventory(), "audio").collect()} == lengths
    assert any(len(x) > 1 for x in asked())


def test_hearing_in_groups(spark, root, monkeypatch):
    """Several clips in one call; two segments in one clip, in any order; nothing heard in one; one of over 28 s heard alone."""

    class Segments:
        name = "segments"

        def transcribe(self, clips, sample_rate, lang):
            return [f"alone {len(c)}" for c in clips]

        def segments(self, samples, clips, sample_rate, lang):
            found = []
            for start, end in clips:
                one = samples[round(start * sample_rate) : round(end * sample_rate)]
                assert len(set(one.tolist())) == 1  # a clip's own samples, and no gap among them
                if one[0] != 9:
                    found += [(start + (end - start) / 2, f" second {int(one[0])} "), (start, f"first of {len(clips)}")]
            return found

    monkeypatch.setitem(providers.HEARING, "echo", Segments)
    (root / "book.json").write_text(json.dumps(CONFIG | {"verify": {"provider": "echo", "batch": 4}}))
    book = Book(spark, str(root))
    sizes = {"a": 24000, "b": 12000, "c": 24000 * 29, "d": 6000, "e": 48000, "f": 2400}
    samples = [(k, n, np.full(n, i + 5, "<f4").tobytes()) for i, (k, n) in enumerate(sizes.items())]
    spark.createDataFrame(samples, "audio string, n_samples long, samples binary").write.parquet(f"{book.work}/audio")
    lines = spark.createDataFrame([(f"{c}{k}", k, c) for c in (0, 1) for k in sizes], "id string, audio string, chapter int")
    got = {r.id: r.transcript for r in book.heard(lines).collect()}
    one = {"a": "first of 3 second 5", "b": "first of 3 second 6", "c": f"alone {24000 * 29}", "d": "first of 3 second 8", "e": "", "f": "first of 2 second 10"}
    assert got == {f"{c}{k}": t for c in (0, 1) for k, t in one.items()}
    assert {r.id: r.transcript for r in book.heard(lines.where("id IN ('0a', '0c')")).collect()} == {"0a": "alone 24000", "0c": one["c"]}  # one left over goes alone
    (root / "book.json").write_text(json.dumps(CONFIG | {"verify": {"provider": "echo", "batch": 1}}))
    assert {r.transcript for r in Book(spark, str(root)).heard(lines.where("audio = 'a'")).collect()} == {"alone 24000"}


def test_tone_voices():
    tone = providers.speech("tone")
    assert tone.voices() == ["a220", "a330", "a440"] and tone.max_chars == 200
    assert np.array_equal(tone.synthesize("hello", "a330"), tone.synthesize("hello", "330")) and not np.array_equal(tone.synthesize("hello", "a330"), tone.synthesize("hello", "x"))
    assert np.array_equal(tone.synthesize("hello", "x"), tone.synthesize("hello", "a440"))


def test_designed_voices(spark, root):
    (root / "cast.json").write_text(json.dumps([{"name": "Ann", "description": "bright"}]))
    main(["run", str(root), "--to", "attribute"])
    book, made = Book(spark, str(root)), []
    (root / "voices").mkdir()
    (root / "voices/narrator.wav").write_bytes(b"")
    chosen = book.design_voices(lambda path, text, instruct: made.append((path, instruct)), "qwen3tts")
    assert made == [(f"{root}/voices/Ann.wav", "bright")]
    assert chosen == {"tone": CONFIG["voices"], "qwen3tts": {"Ann": "voices/Ann.wav", "narrator": "voices/narrator.wav"}}


def test_transcription_by_a_provider(spark, root, monkeypatch):
    """The book's provider gets the samples of each line's current audio."""

    class Counting:
        name = "counting"

        def transcribe(self, clips, sample_rate, lang):
            return [f"{len(c)} {sample_rate} {lang}" for c in clips]

    monkeypatch.setitem(providers.HEARING, "echo", Counting)
    book = Book(spark, str(root))
    lines = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", "a")], "id string, audio string")
    samples = [("a", 3, np.zeros(3, "<f4").tobytes()), ("b", 5, np.zeros(5, "<f4").tobytes()), ("c", 1, np.zeros(1, "<f4").tobytes())]
    spark.createDataFrame(samples, "audio string, n_samples long, samples binary").write.parquet(f"{book.work}/audio")
    assert {tuple(r) for r in book.heard(lines).collect()} == {("x", "3 24000 en"), ("y", "5 24000 en"), ("z", "3 24000 en")}
    assert providers.Deaf().transcribe([np.zeros(2)], 24000, "en") == [""]
    with pytest.raises(KeyError, match="no transcription provider 'none'"):
        providers.found(providers.HEARING, "none", "transcription")
