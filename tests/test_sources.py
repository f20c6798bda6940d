from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from storyline.operators import sections
from storyline.sources import books, pages
from storyline.streaming.chapters import ingest_new

LINE = ("c000p0000s00", 0, 0, "dialogue", "Ann", "Hi.", "en", None, 1.0, False)


def test_source_markdown_comes_first(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        books.locate_source(spark, str(tmp_path))
    (tmp_path / "source.txt").write_text("plain")
    assert books.read_source(spark, str(tmp_path)).first().markdown is False
    (tmp_path / "source.md").write_text("# A\n\nb\n")
    row = books.read_source(spark, str(tmp_path)).first()
    assert (row.text, row.markdown, row.book) == ("# A\n\nb\n", True, tmp_path.name)


def test_tables_by_chapter(spark, tmp_path):
    root = str(tmp_path)
    assert books.read_table(spark, root, "lines").count() == 0
    rows = [LINE, ("c001p0000s00", 1, *LINE[2:]), ("c002p0000s00", 2, *LINE[2:])]
    books.write_table(spark.createDataFrame(rows, books.LINES), root, "lines")
    books.write_table(spark.createDataFrame([("c001p0000s00", 1, 0, "dialogue", "Bob", "New.", "en", None, 1.0, False)], books.LINES), root, "lines")
    assert [r.speaker for r in books.read_table(spark, root, "lines").orderBy("id").collect()] == ["Ann", "Bob", "Ann"]
    assert books.read_table(spark, root, "lines", [1]).count() == 1
    assert books.prune_chapters(spark, root, "lines", 2) == [2] and books.chapter_numbers(spark, root) == [0, 1]


def test_older_rows_get_defaults(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id":"c000p0000s00","chapter":0,"text":"x"}\n\n')
    rows = books.read_jsonl(spark, str(tmp_path / "l.jsonl"), "lines")
    assert rows.where("id is not null").count() == 1
    books.write_table(rows.where("id is not null"), str(tmp_path), "lines")
    assert tuple(books.read_table(spark, str(tmp_path), "lines").select("lang", "confidence", "locked").first()) == ("en", 1.0, False)
    assert books.read_jsonl(spark, str(tmp_path / "none.jsonl"), "render").count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x\ty\nz")], "id string, text string")
    books.write_review(rows, str(tmp_path / "review"))
    assert next((tmp_path / "review").glob("part-*")).read_text() == "a\tx y z\n"
    books.write_cast(rows, str(tmp_path / "cast"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        books.write_cast(rows, str(tmp_path / "cast"))
    books.write_cast(rows, str(tmp_path / "cast"), force=True)
    books.write_jsonl(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    state = spark.createDataFrame([("l", "05-audio/k.wav"), ("m", None)], "id string, audio string")
    assert [tuple(r) for r in books.by_line(state).collect()] == [("l.wav", "../k.wav")]
    assert books.log_line("[bold]done[/bold] [1]", datetime.datetime(2030, 1, 2, 3, 4, 5)) == "2030-01-02T03:04:05 done [1]"


def test_scaffold(spark, tmp_path):
    (tmp_path / "in.txt").write_text("CHAPTER 1\na")
    assert books.scaffold(spark, str(tmp_path / "in.txt"), str(tmp_path / "my-book"))["title"] == "My Book"
    assert books.read_config(str(tmp_path / "my-book" / "book.json"))["language"] == "en"
    with pytest.raises(FileExistsError):
        books.scaffold(spark, str(tmp_path / "in.txt"), str(tmp_path / "my-book"))


PAGE = """<html><script>var x = "</p><p>no</p>";</script><h1 class="headline"> A &amp; B </h1><h1>other</h1>
<div id="content"><p>One &lt;1&gt;<span id="ad">buy</span> more</p><p> </p><p>Two<p>Three</div><p>outside</p><a rel="next" href="x">n</a></html>"""


def test_page_parser():
    page = pages.parse(PAGE, container=("div", "content"))
    assert (page.title, page.paragraphs, page.has_next) == ("A & B", ["One <1> more", "Two", "Three"], True)
    assert pages.parse(None).paragraphs == []


def test_pages(spark):
    rows = spark.createDataFrame([(1, PAGE), (2, None), (3, "<h1>T:x</h1><article><p>a</p><p>b <b>c</b></p></article>")], "page_id long, html string")
    got = {r.page_id: r for r in pages.chapters(rows).collect()}
    assert got[3].paragraphs == ["a", "b c"] and got[3].file == "T_x" and got[2].file == "untitled" and got[1].paragraphs == []
    plain = {r.page_id: (r.title, r.paragraphs) for r in pages.well_formed(rows.where("html is not null")).collect()}
    assert plain[3] == ("T:x", ["a", "b c"])


def test_entities_that_are_broken_off_stay(spark, tmp_path):
    """Rows of page_chapters against its SQL: titles that end within an entity, and ones that would change if they were decoded twice."""
    import duckdb

    from storyline.plans.registry import ORACLES, QUERIES

    titles = ["and &amp", "a &am", "b &", "x &amp;&amp;&amp", "&ampere; &ltd; &copyright;", "&amp;lt;", "&amp;amp;", "&middot; &lt;p&gt;"]
    rows = [(k, f'<h1>{t}</h1><article><p>{t}</p><p>more &copy</p></article><a href="?a=1&copy=2" rel="next">n</a>') for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["page_chapters"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.sql(ORACLES["page_chapters"])
    assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(want.fetchall())
    page = pages.parse("<h1>&#65;&#x42;&#67 &nope; &eacute;</h1><article><p>&lt;&lt</p></article>")
    assert (page.title, page.paragraphs) == ("AB&#67 &nope; é", ["<&lt"])


def test_stream_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    (folder / "one.txt").write_text("CHAPTER 1\na\n\nb")
    ingest_new(spark, str(folder), out, checkpoint)
    (folder / "two.txt").write_text("CHAPTER 1\nc")
    ingest_new(spark, str(folder), out, checkpoint)
    got = spark.read.parquet(out).orderBy("book")
    assert [(r.book, r.title, r.paragraphs) for r in got.collect()] == [("one", "CHAPTER 1", ["a", "b"]), ("two", "CHAPTER 1", ["c"])]
    assert sections.paragraph_rows(got).where(F.col("book") == "one").count() == 2
