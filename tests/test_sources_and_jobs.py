"""XLSX packages, the engine's verbs, and job states as a stream."""

import datetime as dt

from pyspark.sql import functions as F

from pagemill.api import Engine, Settings
from pagemill.operators import matching
from pagemill.sources import xlsx
from pagemill.streaming import jobs


def test_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, "Visit https://example.com/a now."), (1, 1, "Second one here."), (2, 0, "CTI"), (2, 1, "Third & <last>.")], "page int, line_no int, line string")
    engine = Engine(spark, "T1", Settings(max_rows=2))
    segments = engine.create(lines).cache()
    files = engine.export(segments, str(tmp_path)).orderBy("package_index").collect()
    assert [(f.filename, f.n_rows) for f in files] == [("T1_001_of_002.xlsx", 2), ("T1_002_of_002.xlsx", 1)]
    cells = xlsx.read_cells(spark, str(tmp_path))
    sheet = cells.where("sheet_state = 'visible'")
    assert {r.subject for r in sheet.collect()} == {"PKG-T1-001", "PKG-T1-002"}
    returned = sheet.withColumn("cells", F.transform("cells", lambda c, i: F.when(i == 1, F.concat(F.lit("译文 "), c)).otherwise(c)))
    done = engine.import_(segments, returned)
    issues, report = engine.validate(done)
    assert report.first().can_generate and report.first().total_segments == 3
    assert {r.code for r in issues.collect()} <= {"LOW_CHINESE_RATIO"}


def test_imported_files_and_their_issues(spark):
    """A hidden sheet with more rows, a number before the key, a repeated key, a foreign package, a lost one, moved rows."""
    lines = spark.createDataFrame([(1, k, f"{w} stands here {k}.") for k, w in enumerate(("One", "Two", "Three", "Four"))], "page int, line_no int, line string")
    engine = Engine(spark, "T", Settings(max_bytes=200))
    segments = engine.create(lines).cache()
    packages = engine.export(segments).orderBy("package_index").collect()
    assert [p.n_rows for p in packages] == [2, 2] and packages[0].filename == "T_001_of_002.xlsx"
    row = lambda file, subject, sheet, state, at, *cells: (file, subject, sheet, state, at, list(cells))
    cells = [
        row("a.xlsx", "PKG-T-001", 0, "hidden", 1, "00000001", "no"), row("a.xlsx", "PKG-T-001", 0, "hidden", 2, "00000002", "no"), row("a.xlsx", "PKG-T-001", 1, "visible", 1, "99", "R1", None, "eins"), row("a.xlsx", "PKG-T-001", 1, "visible", 2, "1", "later"),
        row("b_002_of_002.xlsx", None, 0, "visible", 1, "gone", "drei"), row("b_002_of_002.xlsx", None, 0, "visible", 2, "gone", "vier"), row("c.xlsx", "PKG-X-001", 0, "visible", 1, "1", "foreign"), row("d.xlsx", None, 0, "visible", 1, "1", "whose"),
    ]
    df = spark.createDataFrame(cells, "file string, subject string, sheet_index int, sheet_state string, row_index int, cells array<string>")
    done, issues = engine.import_with_issues(segments, df)
    lost = lambda file, *keys: {(file, "blocking", "MISSING_ROW_KEY", f"0000000{k}") for k in keys}
    # b is known by its name alone, so its rows are not matched by place; d has no package, so that all keys are expected
    assert {r.row_key: r.translated_text for r in done.collect()} == {"00000001": "whose", "00000002": None, "00000003": None, "00000004": None}
    assert {tuple(r) for r in issues.collect()} == {("a.xlsx", "blocking", "DUPLICATE_ROW_KEY", "00000001"), ("c.xlsx", "blocking", "WRONG_PACKAGE", None)} | lost("a.xlsx", 2) | lost("b_002_of_002.xlsx", 3, 4) | lost("d.xlsx", 2, 3, 4)


def test_imports_that_claim_their_package(spark):
    """An id in a cell, a subject that is a note, an index of no package, no key at all, and more missing keys than listed."""
    expected = spark.createDataFrame([(f"PKG-T-{p:03d}", p, f"{p * 1000 + k:08d}", k) for p, n in ((1, 2), (2, 130)) for k in range(n)], "package_id string, package_index bigint, row_key string, position int")
    row = lambda file, subject, sheet, at, *cells: (file, subject, sheet, "visible", at, list(cells))
    cells = [
        row("note.xlsx", "a note", 1, 30, None, " PKG-no", "PKG-T-001 "), row("note.xlsx", "a note", 0, 1, "gone", "eins"), row("note.xlsx", "a note", 0, 2, "gone", "zwei"),
        row("v_009_of_009.xlsx", None, 0, 1, "2005", "fünf"), row("z.xlsx", "my subject", 0, 1, "7", "sieben"), row("late.xlsx", None, 0, 31, "1", "PKG-T-001"),
        row("few.xlsx", "PKG-T-002", 0, 1, "2001", "two"), row("few.xlsx", "PKG-T-002", 0, 2, "2129", "last"),
    ]
    df = spark.createDataFrame(cells, "file string, subject string, sheet_index int, sheet_state string, row_index int, cells array<string>")
    texts, issues = matching.import_cells(df, expected)
    assert {r.row_key: (r.translated_text, r.match) for r in texts.collect()} == {"00001000": ("eins", "position"), "00001001": ("zwei", "position"), "00002001": ("two", "key"), "00002005": ("fünf", "key"), "00002129": ("last", "key")}
    got = issues.collect()
    assert {(r.file, r.severity, r.code) for r in got if r.row_key is None} == {("note.xlsx", "warning", "POSITIONAL_MATCH"), ("z.xlsx", "blocking", "UNKNOWN_PACKAGE"), ("late.xlsx", "blocking", "UNKNOWN_PACKAGE"), ("few.xlsx", "blocking", "MISSING_ROW_KEY_SUMMARY"), ("v_009_of_009.xlsx", "blocking", "MISSING_ROW_KEY_SUMMARY")}
    lost = {f: sorted(r.row_key for r in got if r.file == f and r.code == "MISSING_ROW_KEY") for f in ("few.xlsx", "v_009_of_009.xlsx")}
    assert lost["few.xlsx"] == [f"{2000 + k:08d}" for k in range(102) if k != 1][:100]
    assert lost["v_009_of_009.xlsx"] == ["00001000", "00001001", *[f"{2000 + k:08d}" for k in range(100) if k != 5][:98]]


def test_states_follow_events(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    events = [("a", t + dt.timedelta(seconds=i), i, 4, "running") for i in range(1, 5)] + [("b", t, 1, 10, "running"), ("b", t + dt.timedelta(seconds=5), 2, 10, "failed")]
    schema = "job_id string, ts timestamp, current bigint, total bigint, state string"
    df = spark.createDataFrame(events, schema)
    batch = {r.job_id: r for r in jobs.track_batch(df).collect()}
    assert batch["a"].state == "completed" and batch["a"].percent == 100.0 and batch["b"].state == "failed"
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.track(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.job_id: r for r in spark.sql("select * from job_states").collect()} == batch


def test_time_left_by_hand():
    """Two steps of ten after 4 s: 2 s a step, eight left and one more; a second later 3 steps, 5/3 s a step."""
    assert jobs.smoothed(None, 0.0, 4.0, 2, 10) == 18.0
    assert abs(jobs.smoothed(18.0, 1.0, 5.0, 3, 10) - (0.65 * 17.0 + 0.35 * 5 / 3 * 8)) < 1e-12
    state = jobs.advance(None, 100.0, 0, 10, "running")
    state = jobs.advance(jobs.advance(state, 104.0, 2, 10, "running"), 105.0, 3, 10, "running")
    assert abs(state[4] - (0.65 * 17.0 + 0.35 * 5 / 3 * 8)) < 1e-12
    assert jobs.advance(state, 106.0, 1, 20, "running")[0] == 106.0
