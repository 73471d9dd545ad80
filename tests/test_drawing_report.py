"""The report on drawn tasks and its files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagemill.operators import drawing_report
from pagemill.plans import drawing
from pagemill.sources import report_files


@pytest.fixture(scope="module")
def reports(spark, sf):
    tables = drawing.drawn_tables(spark, sf)
    tables = [t.withColumn("task", F.when(F.col("task") == "src0", "plain").otherwise(F.col("task"))) for t in tables]
    return drawing_report.drawing_report(*tables, shown=3).cache()


def test_lists_are_short_and_counts_whole(reports):
    rows = reports.collect()
    assert any(r.source_bbox_overlap_warnings > 3 for r in rows) and all(len(r.source_bbox_overlap_pairs) <= 3 for r in rows)
    for r in rows:
        assert len(r.overflow_segment_ids) == min(3, r.overflow_errors) and r.overflow_segment_ids == sorted(r.overflow_segment_ids)
        assert len(r.layout_fallback_reasons) == min(3, r.layout_fallback_segments)
        assert all(p.intersection_area > 0 and p.first < p.second for p in r.source_bbox_overlap_pairs)


def test_status(spark):
    """A task without anything, one with a warning alone, one whose page is not there."""
    page = "task string, page int, output_page int, same_size boolean, tiles int, redactions int, vector_cleaned boolean, rasterized boolean, dense boolean, complex_backgrounds int, mask_ratio double"
    pages = spark.createDataFrame([(t, i, None if t == "c" else i, t != "c", 0, 0, False, False, False, 0, 0.25) for i, t in enumerate("abc")], page)
    none = lambda schema: spark.createDataFrame([], schema)
    placements = none("task string, page int, box_id long, segment_id string, x0 double, y0 double, x1 double, y1 double, font_size double, source_size double, rotated boolean, contour_flow boolean, fitted boolean, background string")
    segments, fallbacks = none("task string, segment_id string, should_translate boolean, status string"), none("task string, segment_id string, reason string")
    issues = spark.createDataFrame([("b", "warning", "S1", "<look>"), ("a", "info", "S2", "fine")], "task string, severity string, segment_id string, message string")
    got = {r.task: r for r in drawing_report.drawing_report(placements, pages, segments, fallbacks, issues).collect()}
    assert {t: r.status for t, r in got.items()} == {"a": "passed", "b": "passed_with_warnings", "c": "needs_review"}
    assert got["a"].minimum_rendered_font_size == 0 and got["c"].output_pages == 0 and got["b"].shown_issues[0].message == "<look>"


def test_files_of_all_reports(reports, tmp_path):
    report_files.write_reports(reports, str(tmp_path))
    rows = {r.task: r for r in reports.collect()}
    assert sorted(os.listdir(tmp_path)) == sorted(f"{t}.{kind}" for t in rows for kind in ("html", "json"))
    for task, row in rows.items():
        back = json.loads((tmp_path / f"{task}.json").read_text())
        assert back == json.loads(json.dumps(row.asDict(recursive=True), default=str))
        assert f"<h1>{task}</h1>" in (tmp_path / f"{task}.html").read_text()


def test_nothing_is_left_of_a_failed_write(reports, tmp_path):
    bad = reports.withColumn("task", F.when(F.col("task") == "plain", "../out").otherwise(F.col("task"))).repartition(3)
    with pytest.raises(Exception, match="no name of a file"):
        report_files.write_reports(bad, str(tmp_path / "d"))
    assert not os.path.exists(tmp_path / "d") or os.listdir(tmp_path / "d") == []


def test_pages_escape_their_texts():
    page = report_files.page({"task": "t", "status": "passed", "shown_issues": [{"severity": "warning", "segment_id": None, "message": "<b>&"}]})
    assert "&lt;b&gt;&amp;" in page and "<b>&" not in page
