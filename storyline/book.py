"""A book's folder and its stages: each reads the tables of the one before, does what its stamps call stale, and replaces those chapters.

    <root>/source.md | source.txt, book.json or book.yaml (title, author, language, genre, chapter_regex, styles, voices, tts, pauses, llm,
        verify), cast.json, overrides.json, pinyin.json (Chinese only: toneless syllable by character)
    <root>/work/chapters, normalized, entries, lines, render, audio, verify, timeline: tables; work/stamps: what each chapter was built from;
        work/review: what a person should look at; work/exchanges: what models were asked; work/log.txt

Speech, transcription and language models are providers (storyline.providers); encoding audio files isn't part of the library.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import providers
from .functions import fixed, prompts
from .functions.hashing import content_hash, json_array
from .functions.ranks import positions
from .functions.text import normalize
from .operators import attribution, dialogue, findings, planning, provenance, sections, timeline, verify, voices
from .operators import cast as people
from .sources import books, deltas, settings
from .sources.shared import written

STAMP = "stage string, chapter int, inputs map<string,string>"
#: Stages of a whole book have one stamp, under this number.
WHOLE = -1
Model = Callable[[], providers.Language]


class Book:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.work = spark, root.rstrip("/"), f"{root.rstrip('/')}/work"
        self.config: dict = {}
        for name in ("book.json", "book.yaml"):
            text = books.read_text(spark, f"{self.root}/{name}")
            if text is not None:
                self.config = settings.validated(books.read_config(name, text), f"{self.root}/{name}")
                break
        self.lang = self.config.get("language", "en")
        self.styles: list[str] = self.config.get("styles", [])
        self.backend = self.config.get("tts", {}).get("backend", "tone")
        self.params: dict = self.config.get("tts", {}).get("params", {})
        self.num_ctx: int = self.config.get("llm", {}).get("num_ctx", 16384)
        self.pauses: dict[str, float] = fixed.PAUSES | self.config.get("pauses", {})

    # configuration

    def _json(self, name: str, default: object) -> object:
        text = books.read_text(self.spark, f"{self.root}/{name}")
        return default if text is None else json.loads(text)

    def cast(self) -> list[people.Character]:
        return [people.Character(**c) for c in self._json("cast.json", [])]

    def voice_map(self) -> dict[str, str]:
        return voices.voice_map_of(self.config.get("voices", {}), self.backend)

    def pronunciation(self) -> Callable[[Column], Column] | None:
        """By pinyin.json, a Chinese book's table from character to toneless syllable; without it characters are compared."""
        table = self._json("pinyin.json", {}) if self.lang == "zh" else {}
        return verify.pronunciation(table) if table else None

    def model(self) -> Model:
        return providers.found(providers.LANGUAGE, self.config.get("llm", {}).get("provider", "tagged"), "language")

    def speech(self) -> Callable[[], providers.Speech]:
        """The maker of the book's speech provider, for executors."""
        return providers.configured(self.config.get("tts", {}))

    def hearing(self) -> Callable[[], providers.Hearing]:
        return providers.found(providers.HEARING, self.config.get("verify", {}).get("provider", "deaf"), "transcription")

    def note(self, message: str) -> None:
        """One more line of the log, which is a book's and so a small file."""
        line = books.log_line(message, datetime.datetime.now())
        books.write_text(self.spark, f"{self.work}/log.txt", "\n".join([*self.log(), line]) + "\n")

    def log(self) -> list[str]:
        return (books.read_text(self.spark, f"{self.work}/log.txt") or "").splitlines()

    # tables and stamps

    def read(self, name: str) -> DataFrame:
        if name in books.SCHEMAS:
            return self.table(name)
        return self.spark.read.parquet(f"{self.work}/{name}")

    def table(self, name: str, chapters: list[int] | None = None) -> DataFrame:
        return books.read_table(self.spark, self.work, name, chapters)

    def has(self, name: str) -> bool:
        if name in books.SCHEMAS:
            return deltas.has_table(self.spark, self.work, name)
        return books.exists(self.spark, f"{self.work}/{name}")

    def inventory(self) -> DataFrame:
        """(audio, n_samples) of the audio that is there."""
        if not self.has("audio"):
            return self.spark.createDataFrame([], "audio string, n_samples long")
        return self.read("audio").select("audio", "n_samples").dropDuplicates(["audio"])

    def stamps(self, stage: str) -> DataFrame:
        if not self.has(f"stamps/stage={stage}"):
            return self.spark.createDataFrame([], STAMP).drop("stage")
        return self.spark.read.schema(STAMP.partition(", ")[2]).parquet(f"{self.work}/stamps/stage={stage}")

    def _stamped(self, stage: str, rows: dict[int, dict[str, str]]) -> None:
        table = self.spark.createDataFrame(sorted(rows.items()), "chapter int, inputs map<string,string>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.work}/stamps/stage={stage}")

    def mark(self, stage: str, current: DataFrame) -> None:
        """Stamps (chapter, inputs) for chapters that a stage has done; other chapters keep theirs. A book's stamps are few and small."""
        self._stamped(stage, {r["chapter"]: r["inputs"] for r in self.stamps(stage).collect()} | {r["chapter"]: r["inputs"] for r in current.collect()})

    def unmark(self, stage: str, chapters: list[int]) -> None:
        self._stamped(stage, {r["chapter"]: r["inputs"] for r in self.stamps(stage).collect() if r["chapter"] not in chapters})

    def reasons(self, stage: str, current: DataFrame) -> DataFrame:
        return provenance.with_reasons(current, self.stamps(stage), ["chapter"])

    def stale(self, rows: DataFrame, chapters: set[int] | None, force: bool) -> list[int]:
        """Chapters to do, of rows (chapter, reasons)."""
        rows = rows if force else rows.where(F.size("reasons") > 0)
        return sorted(r["chapter"] for r in rows.select("chapter").collect() if chapters is None or r["chapter"] in chapters)

    def replace(self, rows: DataFrame, name: str) -> None:
        """Replaces the chapters that rows has; rows may be computed from the same table, of which nothing is overwritten."""
        books.write_table(rows, self.work, name)

    # stages

    def ingest_inputs(self) -> DataFrame:
        source = books.read_source(self.spark, self.root)
        return source.select(F.lit(WHOLE).alias("chapter"), provenance.ingest_inputs(F.col("text"), self.lang, self.config.get("chapter_regex")).alias("inputs"))

    def ingest(self) -> DataFrame:
        """Chapters of the source, and their normalized text."""
        source = books.read_source(self.spark, self.root)
        markdown = bool(source.select("markdown").first()["markdown"])
        found = sections.chapters(source, self.lang, self.config.get("chapter_regex"), markdown)
        found.write.mode("overwrite").parquet(f"{self.work}/chapters")
        self.mark("ingest", self.ingest_inputs())
        return self.normalize()

    def _hash_of(self, rows: DataFrame, *columns: str) -> DataFrame:
        """(chapter, h): one hash of all rows of each chapter."""
        one = F.concat_ws("\x1f", *columns)
        return rows.groupBy("chapter").agg(content_hash(json_array(F.array_sort(F.collect_list(one)))).alias("h"))

    def normalize_inputs(self) -> DataFrame:
        all_of = self.read("chapters").agg(content_hash(json_array(F.transform(F.array_sort(F.collect_list(F.struct("chapter", F.concat_ws("\x1f", "title", F.array_join("paragraphs", "\x1e")).alias("t")))), lambda x: x["t"]))).alias("h"))
        overrides = json.dumps(self._json("overrides.json", {}), sort_keys=True, ensure_ascii=False)
        return all_of.select(F.lit(WHOLE).alias("chapter"), provenance.normalize_inputs(F.col("h"), self.lang, overrides).alias("inputs"))

    def normalize(self) -> DataFrame:
        text = lambda c: normalize(c, self.lang, self._json("overrides.json", {}))
        rows = self.read("chapters").select("chapter", text(F.col("title")).alias("title"), F.transform("paragraphs", text).alias("paragraphs"))
        rows.write.mode("overwrite").parquet(f"{self.work}/normalized")
        self.mark("normalize", self.normalize_inputs())
        n = sections.summary(self.read("normalized")).first()
        self.note(f"ingest: {n['chapters']} chapters, {n['paragraphs']} paragraphs")
        return self.read("normalized")

    def asked(self, requests: DataFrame, model: Model, system: str = "") -> DataFrame:
        """Answers (chapter, window, response) to requests, none of which may be over budget; both go to the log of exchanges."""
        requests.write.mode("overwrite").parquet(f"{self.work}/requests")
        requests = self.read("requests")
        answers = providers.ask(requests, model, system, budget=attribution.prompt_budget(self.num_ctx))
        answers.write.mode("overwrite").parquet(f"{self.work}/answers")
        answers = self.read("answers")
        self.exchanged(requests.join(answers, ["chapter", "window"]).select(F.col("passage").alias("prompt"), "response"))
        return answers

    def exchanged(self, rows: DataFrame) -> None:
        """Adds (prompt, response) to the log of exchanges."""
        attribution.exchanges(rows, self.config.get("llm", {}).get("provider", "tagged"), self.num_ctx).write.mode("append").json(f"{self.work}/exchanges")

    def discover(self, model: Model) -> DataFrame:
        """Entries (chapter, hash, pos, name, aliases, description) of who speaks. Chapters whose text was read before keep theirs."""
        ask, system = prompts.DISCOVER[self.lang], prompts.ROLE[self.lang]
        schema = "chapter int, hash string, pos int, name string, aliases array<string>, description string"
        known = self.read("entries") if self.has("entries") else self.spark.createDataFrame([], schema)
        known = known.join(people.discovery_hashes(self.read("normalized"), self.lang), ["chapter", "hash"], "left_semi").select(*(c.split()[0] for c in schema.split(", ")))
        budget = attribution.window_budget(attribution.tokens_of(ask + system), self.num_ctx)
        windows = people.discovery_windows(self.read("normalized"), self.lang, budget, known)
        answers = self.asked(windows.withColumn("passage", F.replace(F.lit(ask), F.lit("{text}"), F.col("text"))), model, system)
        found = people.parse_discoveries(answers).join(windows.select("chapter", "hash").distinct(), "chapter")
        new = people.dedupe_entries(found).join(windows.select("chapter", "hash").distinct(), "chapter")
        # a chapter where nobody speaks keeps a row without a name, so that it isn't asked about again
        silent = windows.select("chapter", "hash").distinct().join(new.select("chapter"), "chapter", "left_anti")
        none = silent.select("chapter", "hash", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("description"))
        known.unionByName(new.select(known.columns)).unionByName(none).write.mode("overwrite").parquet(f"{self.work}/new-entries")
        self.read("new-entries").write.mode("overwrite").parquet(f"{self.work}/entries")
        return self.read("entries")

    def find_cast(self, model: Model | None = None, force: bool = False) -> list[people.Character]:
        """Discovers who speaks, merges the chapters' entries batch by batch and ranks them. A cast that is there may have been edited, and is
        only replaced by force."""
        if books.exists(self.spark, f"{self.root}/cast.json") and not force:
            return self.cast()
        model = model or self.model()
        entries = self.discover(model).where(F.col("name").isNotNull())
        overhead = attribution.tokens_of(prompts.MERGE[self.lang] + prompts.ROLE[self.lang])
        room = attribution.window_budget(overhead, self.num_ctx) // 2
        merged = people.merged_casts(entries.withColumn("book", F.lit(self.root)), room, self.config.get("cast", {}).get("merge_chapters", 5), self.lang, model, attribution.prompt_budget(self.num_ctx))
        merged.write.mode("overwrite").parquet(f"{self.work}/merged")
        merged = self.read("merged")
        self.exchanged(merged.where("kind = 'exchange'").select("prompt", "response"))
        rows = merged.where("kind = 'character'").orderBy("pos").collect()  # a book's characters, as its configuration holds them
        cast = [people.Character(r["name"], list(r["aliases"]), r["description"], chapters=list(r["chapters"])) for r in rows]
        if cast:
            spoken = dialogue.span_rows(self.read("normalized"), cast, self.lang).where("kind = 'dialogue' AND speaker IS NOT NULL").select("chapter", "speaker")
            ranked = people.rank_cast(self.spark, cast, self.read("normalized"), spoken, self.config.get("cast", {}).get("main_cap", 20))
            cast = people.from_table(ranked)
        books.write_text(self.spark, f"{self.root}/cast.json", json.dumps([vars(c) for c in cast], ensure_ascii=False, indent=1))
        self.note(f"cast: {len(cast)} characters ({sum(c.main for c in cast)} main)")
        return cast

    def attribute_inputs(self) -> DataFrame:
        key = people.cast_hash(self.cast())
        return self.read("normalized").select("chapter", provenance.attribute_inputs(F.col("title"), F.col("paragraphs"), self.lang, key, self.styles).alias("inputs"))

    def attribute(self, chapters: set[int] | None = None, force: bool = False, model: Model | None = None) -> DataFrame:
        """Lines with speakers: by rules, and quotes that these leave open by a language provider, the given or the configured one. Without
        either, or without a cast, rules are all there is."""
        current = self.attribute_inputs()
        todo = self.stale(self.reasons("attribute", current), chapters, force)
        books.prune_chapters(self.spark, self.work, "lines", self.read("normalized").count())
        said = ""
        if todo:
            cast = self.cast()
            model = model or (self.model() if self.config.get("llm", {}).get("provider") else None)
            spans = dialogue.span_rows(self.read("normalized").where(F.col("chapter").isin(todo)), cast, self.lang)
            if cast and model:
                budget = attribution.window_budget(attribution.instruction_cost(cast, self.lang, self.styles), self.num_ctx)
                asked = attribution.with_instructions(attribution.requests(spans, budget, bool(self.styles)), cast, self.lang, self.styles)
                answers = self.asked(asked, model, prompts.ROLE[self.lang])
                spans = attribution.fold_answers(spans, attribution.parse_answers(answers), cast, self.styles)
                corrupt = attribution.answers_of(answers).where(F.col("corrupt").isNotNull())
                books.write_review(corrupt.select("chapter", "window", "corrupt"), f"{self.work}/review/answers")
            seen = Observation()
            self.replace(attribution.lines(spans, self.lang, self.table("lines")).observe(seen, *attribution.statistic_columns()), "lines")
            said = ": " + ", ".join(f"{n} {kind}" for kind, n in seen.get.items())
            self.mark("attribute", current.where(F.col("chapter").isin(todo)))
            books.write_review(attribution.low_confidence(self.table("lines")), f"{self.work}/review/attribute")
        self.note(f"attribute: {len(todo)} chapters{said}")
        return self.table("lines")

    def fingerprints(self) -> dict[str, str]:
        """Voices by role; one that is a clip is named with the clip's content, so that audio is stale when the clip changes."""
        chosen = self.voice_map()
        at = {v: v if v.startswith("/") or "://" in v else f"{self.root}/{v}" for v in chosen.values() if voices.is_clip(v)}
        hashes = books.file_hashes(self.spark, sorted(set(at.values())))
        return planning.voice_fingerprints(chosen, {v: hashes[p] for v, p in at.items() if p in hashes})

    def render_inputs(self) -> DataFrame:
        hashes = self._hash_of(self.table("lines"), "id", "speaker", "style", "text")
        named = self.fingerprints()
        chosen = F.create_map(*(F.lit(x) for kv in sorted(named.items()) for x in kv)) if named else F.create_map().cast("map<string,string>")
        return hashes.select("chapter", provenance.render_inputs(F.col("h"), self.backend, chosen, json.dumps(self.params, sort_keys=True)).alias("inputs"))

    def render_reasons(self) -> DataFrame:
        """(chapter, reasons): also where a stamp fits and audio is lost."""
        return provenance.render_reasons(self.reasons("render", self.render_inputs()).select("chapter", "reasons"), self.table("lines"), self.table("render"), self.inventory())

    def check(self) -> tuple[list[str], list[str]]:
        """Errors and warnings of the voice map."""
        chosen = self.voice_map()
        clips = {v for v in chosen.values() if voices.is_clip(v) and books.exists(self.spark, v if v.startswith("/") else f"{self.root}/{v}")}
        made, me = self.spark.createDataFrame, F.lit(self.root)
        found = findings.findings(
            made(list(chosen.items()), "key string, voice string").withColumn("book", me), people.cast_table(self.spark, self.cast()).withColumn("book", me), voices.pool_table(self.spark),
            made([(v,) for v in sorted(clips)], "path string").withColumn("book", me), made([(self.root, self.backend, self.lang, list(self.styles))], "book string, backend string, lang string, styles array<string>"),
        )
        return findings.sentences(found.collect(), self.backend, self.lang)

    def render(self, chapters: set[int] | None = None, force: bool = False) -> DataFrame:
        """Plans, synthesizes what isn't there yet and records each line's audio with its number of samples: some chapters at a time, each of
        which is stamped when its audio is written."""
        if not self.voice_map():
            raise ValueError("the book has no voices")
        if self.backend in fixed.VOICES:
            voices.gate(self.check()[0])
        current = self.render_inputs()
        todo = self.stale(self.render_reasons(), chapters, force)
        step = self.config.get("tts", {}).get("checkpoint_chapters", 8)
        for k in range(0, len(todo), step):
            self._render_some(todo[k : k + step], current, force)
        self.note(f"render: {len(todo)} chapters")
        return self.table("render")

    def _render_some(self, chapters: list[int], current: DataFrame, force: bool) -> None:
        """Lines are synthesized some at a time, by their identifiers, and each time audio is written and the lines that have it are added to the
        render table: a run that breaks off keeps every line of the steps that it has done, and finds their audio when it plans again."""
        make = self.speech()
        speech, tts = make(), self.config.get("tts", {})
        jobs = planning.plan(self.table("lines", chapters), self.table("render"), self.inventory().select("audio"), self.voice_map(), speech.name, self.params, speech.max_chars, self.lang, self.fingerprints(), force)
        jobs.write.mode("overwrite").parquet(f"{self.work}/jobs")
        jobs = self.read("jobs")
        todo, step = jobs.where(F.col("chunks").isNotNull()), tts.get("checkpoint_lines", 512)
        n = todo.count()
        if n > step:
            todo = positions(todo, [F.col("id")], lambda df: written(df, "jobs"), "place").withColumn("step", F.floor(F.col("place") / step))
        rendered = lambda rows: rows.select("id", "chapter", "audio", F.lit(speech.name).alias("backend"), "attempts")
        size = planning.batch_size(tts.get("batch"), speech.batch_size, hasattr(speech, "synthesize_batch"))
        for k in range(-(-n // step)):
            some = todo.where(F.col("step") == k).drop("step", "place") if n > step else todo
            made = providers.spoken(planning.batches(some, size, 8000 if size > 1 else 0, self.lang), make, self.lang, speech.sample_rate)
            fresh = made.join(some.select("id", F.col("audio").alias("file")), "id").select(F.col("file").alias("path"), "n_samples", F.col("audio").alias("samples"))
            fresh.dropDuplicates(["path"]).withColumnRenamed("path", "audio").write.mode("append").parquet(f"{self.work}/audio")
            if n > step:
                books.add_rows(rendered(some), self.work, "render")
        self.replace(rendered(jobs), "render")
        self.mark("render", current.where(F.col("chapter").isin(chapters)))

    def heard(self, lines: DataFrame) -> DataFrame:
        """(id, transcript) of lines (id, audio) by the book's transcription provider, several lines of a chapter in one call if it gives
        segments."""
        make, rate = self.hearing(), self.speech()().sample_rate
        samples = self.read("audio").select("audio", "samples", (F.col("n_samples") / rate).alias("duration")).dropDuplicates(["audio"])
        alone = lambda rows: providers.transcribe(rows, make, rate, self.lang)
        size = self.config.get("verify", {}).get("batch", 16)
        if size < 2 or not providers.hears_segments(make):
            return alone(lines.select("id", "audio").join(samples, "audio"))
        chapter = F.col("chapter") if "chapter" in lines.columns else F.lit(0).alias("chapter")
        rows = lines.select("id", "audio", chapter).join(samples, "audio")
        return verify.heard_in_groups(rows, size, lambda laid: providers.transcribe_groups(laid, make, rate, self.lang), alone, self.lang)

    def rendered_hash(self) -> DataFrame:
        return self._hash_of(self.table("render"), "id", "audio")

    def verify_inputs(self, threshold: float) -> DataFrame:
        name = self.config.get("verify", {}).get("provider", "deaf")
        return self.rendered_hash().select("chapter", provenance.verify_inputs(F.col("h"), name, threshold).alias("inputs"))

    def threshold(self) -> float:
        return self.config.get("verify", {}).get("threshold", 0.15)

    def verify(self, transcribe: Callable[[DataFrame], DataFrame] | None = None, threshold: float | None = None, chapters: set[int] | None = None, force: bool = False) -> DataFrame:
        """Checks lines without a current result; transcribe turns (id, audio, n_samples) into (id, transcript), and is the book's provider if
        not given. Lines that fail lose their audio and are rendered anew with another seed, at most max_attempts times in all."""
        transcribe, threshold = transcribe or self.heard, self.threshold() if threshold is None else threshold
        most = self.config.get("verify", {}).get("max_attempts", 3)
        for n in range(most):
            todo = self.stale(self.reasons("verify", self.verify_inputs(threshold)), chapters, force)
            if not todo:
                break
            self._verify_some(todo, transcribe, threshold, force)
            state = self.table("render", todo)
            after = verify.retry(state, self.table("verify", todo), most)
            failed = sorted(r["chapter"] for r in after.where(F.col("audio").isNull()).select("chapter").distinct().collect())
            self.mark("verify", self.verify_inputs(threshold).where(F.col("chapter").isin(todo) & ~F.col("chapter").isin(failed)))
            if not failed:
                break
            self.replace(after.where(F.col("chapter").isin(failed)), "render")
            self.unmark("render", failed)
            self.note(f"verify: chapters {', '.join(map(str, failed))} have failed lines, which are rendered again (pass {n + 2})")
            self.render(set(failed))
            force = False
        books.write_review(verify.failures(self.table("render"), self.table("verify")).select("id", F.format_string("%.2f", "error_rate").alias("error_rate"), F.substring("transcript", 1, 100).alias("transcript")), f"{self.work}/review/verify")
        n = verify.summary(self.table("render"), self.table("verify")).first()
        self.note(f"verify: {n['checked']} checked, {n['failed']} failed")
        return self.table("verify")

    def _verify_some(self, chapters: list[int], transcribe: Callable[[DataFrame], DataFrame], threshold: float, force: bool) -> None:
        state, results = self.table("render", chapters), self.table("verify", chapters)
        rate = self.speech()().sample_rate
        todo = (state.where(F.col("audio").isNotNull()) if force else verify.pending(state, results)).join(self.inventory(), "audio")
        heard = todo.join(transcribe(todo), "id").join(self.table("lines", chapters).select("id", "text"), "id")
        syllable = self.pronunciation()
        rated = verify.compare(heard, self.lang, syllable=syllable, short="short").withColumn("duration", F.col("n_samples") / rate)
        new = rated.withColumn("ok", verify.judge(F.col("text"), F.col("error_rate"), F.col("edits"), F.col("duration"), self.lang, threshold, syllable, F.col("short")))
        columns = [c.split()[0] for c in books.VERIFY.split(", ")]
        kept = verify.current(state, results).join(todo.select("id"), "id", "left_anti")
        self.replace(kept.select(columns).unionByName(new.select(columns)), "verify")

    def build_inputs(self) -> DataFrame:
        return self.rendered_hash().select("chapter", provenance.build_inputs(F.col("h"), json.dumps(self.pauses, sort_keys=True)).alias("inputs"))

    def build(self) -> DataFrame:
        """The timeline of chapters that are ready: every line's start and end, chapter markers, and the chapter metadata once all are ready."""
        states = self.render_reasons()
        rate = self.speech()().sample_rate
        lines = timeline.ready(self.table("lines"), states).join(self.table("render").select("id", "audio"), "id").join(self.inventory(), "audio")
        lines = lines.withColumn("duration", F.col("n_samples") / rate)
        timeline.with_offsets(lines, self.pauses).select("id", "chapter", "speaker", "audio", "pause", "start", "end").write.mode("overwrite").parquet(f"{self.work}/timeline")
        chapters = timeline.chapter_durations(lines, self.pauses).join(self.read("normalized").select("chapter", "title"), "chapter").withColumn("book", F.lit(self.config.get("title", "")))
        timeline.markers(chapters).write.mode("overwrite").parquet(f"{self.work}/markers")
        done = self.read("markers").select("chapter")
        self.mark("build", self.build_inputs().join(done, "chapter", "left_semi"))
        grid = self.read("normalized").select("chapter").join(done.withColumn("ready", F.lit(True)), "chapter", "left").select(F.lit("b").alias("book"), F.coalesce("ready", F.lit(False)).alias("ready"), F.lit(True).alias("fresh"))
        whole = timeline.complete(grid).first()
        if whole and whole["complete"]:
            titled = self.read("markers").withColumn("author", F.lit(self.config.get("author", "")))
            timeline.metadata(titled, self.config.get("genre", "Speech")).write.mode("overwrite").parquet(f"{self.work}/metadata")
        self.note("build: timeline" + ("" if whole and whole["complete"] else " of the chapters that are ready"))
        return self.read("markers")

    # looking at it, and mending it

    def states(self) -> DataFrame:
        """(chapter, stage, reasons) of every chapter."""
        chapters = self.read("normalized").select("chapter")
        found = self.reasons("attribute", self.attribute_inputs()).select("chapter", F.lit("attribute").alias("stage"), "reasons")
        if self.has("lines"):
            found = found.unionByName(self.render_reasons().select("chapter", F.lit("render").alias("stage"), "reasons"))
        if self.has("render"):
            for stage, now in (("verify", self.verify_inputs(self.threshold())), ("build", self.build_inputs())):
                found = found.unionByName(self.reasons(stage, now).select("chapter", F.lit(stage).alias("stage"), "reasons"))
        everything = chapters.crossJoin(self.spark.createDataFrame([(s,) for s in provenance.STAGES], "stage string"))  # chapters of a book, times 4
        return everything.join(found, ["chapter", "stage"], "left").withColumn("reasons", F.coalesce("reasons", F.array(F.lit("missing"))))

    def whole_states(self) -> DataFrame:
        """(chapter, stage, reasons) of the stages that a book has as a whole."""
        found = self.reasons("ingest", self.ingest_inputs()).select("chapter", F.lit("ingest").alias("stage"), "reasons")
        now = self.normalize_inputs() if self.has("chapters") else self.spark.createDataFrame([(WHOLE, {})], "chapter int, inputs map<string,string>")
        return found.unionByName(self.reasons("normalize", now).select("chapter", F.lit("normalize").alias("stage"), "reasons"))

    def progress(self) -> DataFrame:
        """(chapter, attribute, render, verify, build, lines, rendered, verified): every chapter's states and how far it is."""
        grid = provenance.chapter_grid(self.read("normalized").select("chapter"), self.states())
        done = provenance.progress(self.table("lines"), self.table("render"), self.inventory(), verify.current(self.table("render"), self.table("verify")))
        return grid.join(done, "chapter", "left").na.fill(0, ["lines", "rendered", "verified"])

    def status(self) -> DataFrame:
        return provenance.stage_status(self.whole_states().unionByName(self.states()))

    def script(self) -> DataFrame:
        return provenance.script(self.table("lines"), verify.failures(self.table("render"), self.table("verify"))).orderBy("id")

    def report(self) -> str:
        failed = verify.failures(self.table("render"), self.table("verify"))
        return provenance.report(self.config.get("title", self.root), self.status(), self.progress(), self.table("lines"), failed, self.log())

    def fix(self, line: str, speaker: str | None = None, text: str | None = None, style: str | None = None, unlock: bool = False) -> None:
        """A hand edit of one line; what was made from the line before is dropped."""
        if speaker and speaker != "narrator":
            known = people.alias_map(self.cast())
            speaker = known.get(people.folded(speaker), speaker)
        edit = self.spark.createDataFrame([(line, speaker, text, style, unlock)], "id string, speaker string, text string, style string, unlock boolean")
        chapter = int(line[1 : line.index("p")])
        lines = self.table("lines", [chapter])
        if lines.where(F.col("id") == line).isEmpty():
            raise KeyError(f"there is no line {line}")
        self.replace(provenance.fix_lines(lines, edit, self.styles), "lines")
        for name in ("render", "verify"):
            rows = self.table(name, [chapter])
            if not rows.isEmpty():
                self.replace(provenance.without_fixed(rows, edit), name)

    def assign_voices(self) -> dict[str, str]:
        main = sorted((c for c in self.cast() if c.main), key=lambda c: -c.lines)
        found = voices.profiles(self.spark, main)
        return voices.assign([(c.name, found[c.name]) for c in main], voices.pool(self.backend, self.lang), self.voice_map())

    def design_voices(self, design: Callable[[str, str, str], None], backend: str = "qwen3tts", force: bool = False, styles: bool = True) -> dict[str, str]:
        """Has a clip made for every main role that has none (design: path, text, instruction), and gives the backend's voice map with them."""
        roles = [("narrator", self.config.get("narrator", "")), *((c.name, c.description) for c in self.cast() if c.main)]
        table = self.spark.createDataFrame(roles, "role string, description string")
        samples = voices.sample_texts(self.table("lines"), self.lang)
        plan = voices.design_plan(table, samples, self.lang, self.styles if styles else [], prompts.SAMPLE[self.lang])
        there = [(r["path"],) for r in plan.select("path").collect() if books.exists(self.spark, f"{self.root}/{r['path']}")]  # a cast's clips
        for job in voices.missing_clips(plan, self.spark.createDataFrame(there, "path string"), force).orderBy("key").collect():
            design(f"{self.root}/{job['path']}", job["text"], job["instruct"])
        return voices.with_voice_map(self.config.get("voices", {}), backend, {r["key"]: r["path"] for r in plan.select("key", "path").collect()}, self.backend)
