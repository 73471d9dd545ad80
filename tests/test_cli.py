"""The commands of a shell over a store."""

import json

import pytest
from pyspark.sql import functions as F

from pagemill import cli
from pagemill.sources import xlsx


@pytest.fixture
def call(spark, tmp_path):
    def run(*argv):
        out = []
        code = cli.run(["--store", str(tmp_path / "store"), *argv], spark, out.append)
        return code, out

    lines = [(1, 0, "Visit https://example.com/a now."), (1, 1, "Second one here, it is."), (2, 0, "Third one stands."), (2, 1, "Fourth one stands.")]
    spark.createDataFrame(lines, cli.LINES).write.parquet(str(tmp_path / "lines"))
    return run


def test_from_lines_to_output(call, spark, tmp_path):
    lines, sent, back, out = (str(tmp_path / n) for n in ("lines", "sent", "back", "out"))
    code, said = call("export", "T1", lines, sent)
    assert code == 0 and said[0] == "task T1: pages 2, segments 4, to translate 4" and said[1].startswith(f"{sent}/T1_001_of_001.xlsx")
    assert call("list") == (0, ["T1\t2 pages\t0/4"])
    code, said = call("validate", "T1")
    assert code == 2 and said[0].startswith("segments 0/4") and said[1].startswith("- blocking/EMPTY_TRANSLATION")
    assert call("generate", "T1", out) == (2, ["error: issues stand against task T1"])

    segments = cli.Commands(spark, str(tmp_path / "store"))._segments("T1").orderBy("segment_id")
    first, *others = segments.collect()
    made = spark.createDataFrame([("T1", r.segment_id, r.row_key, 1, 1, f"译文 {r.protected_text}") for r in others], "task_id string, segment_id string, row_key string, package_index bigint, package_total bigint, text string")
    xlsx.write_packages(made, back).collect()
    code, said = call("import", "T1", back)
    assert code == 2 and any("MISSING_ROW_KEY" in s and first.row_key in s for s in said) and any(s.startswith("segments 3/4") for s in said)
    code, said = call("edit", "T1", first.segment_id, f"译文 {first.protected_text}")
    assert code == 0 and said[0].startswith("segments 4/4, blocking 0")
    assert call("import", "T1", back)[0] == 0  # what was edited stays where files do not have it
    code, said = call("validate", "T1", "--json")
    assert code == 0 and json.loads("\n".join(said))["translated_segments"] == 4
    assert call("generate", "T1", out)[0] == 0
    assert {r.text for r in spark.read.parquet(out).select(F.col("text")).collect()} >= {"译文 Visit https://example.com/a now."}

    code, (place,) = call("delete", "T1")
    assert code == 0 and call("list") == (0, []) and call("validate", "T1") == (1, ["error: no task T1"])
    assert call("restore", place)[0] == 0 and call("list") == (0, ["T1\t2 pages\t4/4"])


def test_errors(call, spark, tmp_path):
    assert call("analyze", "../x", str(tmp_path / "lines"))[1] == ["error: no name of a task: '../x'"]
    code, said = call("analyze", "T", str(tmp_path / "none"))
    assert code == 1 and said[0].startswith("error: no lines at")
    spark.createDataFrame([], cli.LINES).write.parquet(str(tmp_path / "empty"))
    assert call("analyze", "T", str(tmp_path / "empty"))[0] == 1
    assert call("analyze", "T", str(tmp_path / "lines"), "--page-start", "2")[1] == ["task T: pages 1, segments 2, to translate 2"]
    assert call("edit", "T", "nothing", "x") == (1, ["error: no segment nothing"])
