"""A report lists every line to look at."""

from __future__ import annotations

from storyline.operators import provenance


def test_no_line_is_left_out(spark):
    n = 130
    stages = spark.createDataFrame([("render", "fresh", "", "")], "stage string, status string, detail string, reasons string")
    grid = spark.createDataFrame([(0, "", "", "", "")], "chapter int, " + ", ".join(f"{s} string" for s in provenance.STAGES))
    lines = spark.createDataFrame([(f"l{k:03}", "dialogue", "Ann", "text", 0.5) for k in range(n)], "id string, kind string, speaker string, text string, confidence double").repartition(3)
    failures = spark.createDataFrame([(f"f{k:03}", 0.2 + k / 1000, "heard") for k in range(n)], "id string, error_rate double, transcript string").repartition(3)
    found = provenance.report("T", stages, grid, lines, failures, []).split("\n")
    assert [x[3:7] for x in found if x.startswith("- `l")] == [f"l{k:03}" for k in range(n)]
    assert [x[3:7] for x in found if x.startswith("- `f")] == [f"f{k:03}" for k in reversed(range(n))]
