from __future__ import annotations

import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from storyline.llm import warc
from storyline.llm.common import Workspace

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i} y\n", h) for i, h in rows], PAGES)


def expected(rows):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and (h or "") in first and i != first[h or ""]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


ROWS = [(5, "a" * 100), (3, "a" * 100), (9, "é" * 50), (2, "é" * 50), (7, "short"), (1, "short"), (4, None), (6, ""), (None, "a" * 100), (8, "\r\n\r\nWARC/1.1\r\n" * 20), (10, "\0x" * 200), (3, "a" * 100), (11, "long " * 200_000)]


def test_round_trip(spark):
    got = warc.archive_round_trip(spark, pages(spark, ROWS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(ROWS)


def test_empty(spark):
    assert warc.archive_round_trip(spark, pages(spark, ROWS).limit(0)).count() == 0


def test_extra_columns(spark):
    rows = pages(spark, ROWS[:3]).withColumn("digest", F.lit("x")).withColumn("payload", F.lit(1)).withColumn("first", F.lit(2))
    assert sorted((tuple(r) for r in warc.archive_round_trip(spark, rows).collect()), key=repr) == expected(ROWS[:3])


def test_a_record_is_read_from_its_frame_alone(spark, tmp_path):
    rows = [(k, f"<p>{k}</p>" * 40) for k in range(200)]
    table = warc.write_bundles(pages(spark, rows), Workspace(spark, "t"), frame_bytes=4096, bundle_bytes=2048)
    assert table.count() > 1
    spot = warc.locate(table, [123]).first()
    bundle = bytes(table.where(F.col("bundle") == spot.bundle).first().data)
    frames = warc.seek_table(bundle)
    data = warc.frame(bundle, frames[spot.frame])
    found = warc.parse(data[spot.offset : spot.offset + spot.length])
    assert (found["page_id"], found["payload"].decode()) == rows[123] and len(frames) > 1
    whole = zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read()
    assert data in whole  # any Zstandard decoder reads past the seek table
    paths = [r.path for r in warc.export_files(table, str(tmp_path / "out")).collect()]
    assert len(paths) == table.count() and all(p.endswith(".warc.zst") for p in paths)


def test_damage_is_found(spark):
    with pytest.raises(ValueError, match="seek table"):
        warc.seek_table(b"x" * 40)
    record = warc.record(1, "u", b"payload", "0" * 64, None)
    with pytest.raises(ValueError, match="doesn't have the payload"):
        warc.parse(record)
