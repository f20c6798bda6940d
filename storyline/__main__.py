"""python -m storyline COMMAND BOOK ...: stages and tools of a book's folder."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import providers
from .book import Book
from .functions import fixed
from .operators.provenance import audio_of, chapter_set
from .sources import books

STAGES = ["ingest", "normalize", "cast", "attribute", "render", "verify", "build"]
#: Stages that can be told which chapters to do.
BY_CHAPTER = ("attribute", "render", "verify")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="storyline")
    commands = out.add_subparsers(dest="command", required=True)
    for name in STAGES:
        c = commands.add_parser(name)
        c.add_argument("book")
        if name in BY_CHAPTER:
            c.add_argument("--chapters", type=chapter_set)
        if name in (*BY_CHAPTER, "cast"):
            c.add_argument("--force", action="store_true")
    run = commands.add_parser("run")
    run.add_argument("book")
    run.add_argument("--to", choices=STAGES, default="build")
    run.add_argument("--force", choices=STAGES)
    run.add_argument("--skip", default="cast,verify", help="stages to leave out, with commas between")
    for name in ("status", "report", "script", "check", "voices-assign", "llm-check"):
        commands.add_parser(name).add_argument("book")
    design = commands.add_parser("voices-design")
    design.add_argument("book")
    design.add_argument("--backend", default="qwen3tts")
    design.add_argument("--force", action="store_true")
    design.add_argument("--no-styles", action="store_true")
    commands.add_parser("voices").add_argument("backend", choices=sorted(fixed.VOICES))
    play = commands.add_parser("play")
    play.add_argument("book")
    play.add_argument("line")
    fix = commands.add_parser("fix")
    fix.add_argument("book")
    fix.add_argument("line")
    for option in ("--speaker", "--text", "--style"):
        fix.add_argument(option)
    fix.add_argument("--unlock", action="store_true")
    new = commands.add_parser("new")
    new.add_argument("source")
    new.add_argument("book")
    new.add_argument("--title")
    return out


def stage(book: Book, name: str, force: bool = False, chapters: set[int] | None = None) -> None:
    if name == "cast":
        book.find_cast(force=force)
    elif name in BY_CHAPTER:
        getattr(book, name)(chapters=chapters, force=force)
    else:
        getattr(book, name)()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "voices":
        print("\n".join(" ".join(map(str, v)) for v in fixed.VOICES[a.backend]))
        return 0
    spark = SparkSession.builder.appName("storyline").getOrCreate()
    if a.command == "new":
        config = books.scaffold(spark, a.source, a.book, a.title)
        rows = Book(spark, a.book).ingest()
        print(json.dumps({k: config[k] for k in ("title", "language")} | {"chapters": rows.count(), "first": [r["title"] for r in rows.orderBy("chapter").limit(5).collect()]}, ensure_ascii=False))
        return 0
    book = Book(spark, a.book)
    if a.command == "run":
        skipped, forced = set(filter(None, a.skip.split(","))), False
        for name in STAGES[: STAGES.index(a.to) + 1]:
            forced |= name == a.force
            if name not in skipped and name != "normalize":  # ingest normalizes as well
                stage(book, name, forced)
    elif a.command in STAGES:
        stage(book, a.command, getattr(a, "force", False), getattr(a, "chapters", None))
    elif a.command in ("status", "script"):
        for row in getattr(book, a.command)().collect():
            print(row["line"] if a.command == "script" else "\t".join(map(str, row)))
    elif a.command == "report":
        print(book.report())
    elif a.command == "check":
        errors, warnings = book.check()
        print("\n".join([*(f"error: {e}" for e in errors), *(f"warning: {w}" for w in warnings)]))
        return int(bool(errors))
    elif a.command == "voices-assign":
        print(json.dumps(book.assign_voices(), ensure_ascii=False))
    elif a.command == "voices-design":
        design = providers.found(providers.DESIGN, a.backend, "voice design")()
        print(json.dumps(book.design_voices(design, a.backend, a.force, not a.no_styles), ensure_ascii=False))
    elif a.command == "llm-check":
        print(json.dumps(book.model()().answer("", ""), ensure_ascii=False))
    elif a.command == "play":
        for row in audio_of(book.table("render"), a.line).collect():
            print(row["audio"])
    elif a.command == "fix":
        book.fix(a.line, a.speaker, a.text, a.style, a.unlock)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
