"""Returned rows against the expected ones: by key, by position, and what is missing, repeated or unknown."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators.packing import in_ranges, sums_before
from pagemill.operators.store import Steps


def key_cell(cells: Column, expected: Column) -> Column:
    """Index (from 0) of the first cell whose canonical key is among the expected ones; null if there is none."""
    at = F.array_position(F.transform(cells, lambda c: F.coalesce(F.array_contains(expected, T.row_key(c)), F.lit(False))), True)
    return F.when(at > 0, at - 1)


def value_after(cells: Column, at: Column) -> Column:
    """The first non-null cell to the right of the key."""
    return F.get(F.filter(F.slice(cells, at.cast("int") + 2, F.size(cells)), lambda c: c.isNotNull()), 0)


def last_value(cells: Column) -> Column:
    """The last non-empty cell, for matching by position."""
    return F.get(F.reverse(F.filter(cells, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")), 0)


def best_sheet(sheets: DataFrame) -> DataFrame:
    """Per file the sheet with (visible, distinct keys, keyed rows, non-empty rows) largest in this order; the first wins."""
    rank = F.struct("visible", "distinct_keys", "keyed_rows", "filled_rows", (-F.col("sheet_index")).alias("first"))
    return sheets.groupBy("file").agg(F.max_by("sheet_index", rank).alias("sheet_index"))


def first_wins(imported: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key (smallest order)."""
    others = [c for c in imported.columns if c != key]
    return imported.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def duplicate_keys(imported: DataFrame, key: str) -> DataFrame:
    return imported.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def sheet_scores(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, sheet_index, distinct_keys, keyed_rows, filled_rows) of cells (file, sheet_index, row_index, cell): rows of
    which a cell is an expected key (expected: row_key), how many keys those are, and rows with any text."""
    known = cells.withColumn("row_key", T.row_key(F.col("cell"))).join(expected.select("row_key").distinct(), "row_key", "left_semi")
    keyed = known.groupBy("file", "sheet_index").agg(F.countDistinct("row_key").alias("distinct_keys"), F.countDistinct("row_index").alias("keyed_rows"))
    rows = cells.groupBy("file", "sheet_index").agg(F.countDistinct(F.when(F.trim(F.coalesce("cell", F.lit(""))) != "", F.col("row_index"))).alias("filled_rows"))
    return rows.join(keyed, ["file", "sheet_index"], "left").fillna(0, ["distinct_keys", "keyed_rows"])


def import_issues(imported: DataFrame, positional: DataFrame, lost: DataFrame, task: str, key: str, shown: int = 100) -> DataFrame:
    """(task, severity, code, row_key): blocking issues for each key that rows repeat, for the first `shown` missing keys of
    each task and, where there are more, for the rest together; a warning for each task matched by position, which then
    misses nothing."""
    issue = lambda df, severity, code, row_key: df.select(task, F.lit(severity).alias("severity"), code.alias("code"), row_key.cast("string").alias("row_key"))
    twice = imported.groupBy(task, key).agg(F.count("*").alias("n")).where("n > 1")
    rescued = positional.select(task).distinct()
    gone = missing_report(lost.join(rescued, task, "left_anti"), task, key, shown)
    return issue(twice, "blocking", F.lit("DUPLICATE_ROW_KEY"), F.col(key)).unionByName(issue(rescued, "warning", F.lit("POSITIONAL_MATCH"), F.lit(None))).unionByName(issue(gone, "blocking", F.col("code"), F.col("row_key")))


#: Stands for all keys of a task, where a file names no package.
WHOLE_TASK = -1
#: A package's id begins so; it is looked for in a file's subject, then in so many rows and columns of each sheet.
PACKAGE_MARK, MARK_ROWS, MARK_COLUMNS = "PKG-", 30, 8


def claimed_package(cells: DataFrame) -> DataFrame:
    """(file, package_id) of returned rows: the subject if it is a package's id, else the first cell that begins like one
    in the first rows and columns of all sheets, in order; else null."""
    subject = F.when(F.col("subject").startswith(PACKAGE_MARK), F.col("subject"))
    marked = F.filter(F.slice("cells", 1, MARK_COLUMNS), lambda c: F.coalesce(c.startswith(PACKAGE_MARK), F.lit(False)))
    cell = F.when(F.col("row_index") <= MARK_ROWS, F.trim(F.get(marked, 0)))
    found = F.min_by(cell, F.when(cell.isNotNull(), F.struct("sheet_index", "row_index")))
    return cells.groupBy("file").agg(F.coalesce(F.max(subject), found).alias("package_id"))


def expected_keys(expected: DataFrame, steps: Steps) -> DataFrame:
    """(package_index, row_key, position, rank) of expected (package_index, row_key, position): the keys of each package, and
    once more all of the task, numbered from 0 in their order."""
    own = expected.select("package_index", F.col("package_index").alias("first__"), "position", "row_key")
    every = expected.groupBy("row_key").agg(F.min(F.struct("package_index", "position")).alias("m"))
    every = every.select(F.lit(WHOLE_TASK).cast("bigint").alias("package_index"), F.col("m.package_index").alias("first__"), F.col("m.position").alias("position"), "row_key")
    both = own.withColumn("package_index", F.col("package_index").cast("bigint")).unionByName(every)
    keys, order = ["package_index"], ["first__", "position", "row_key"]
    return steps.keep(sums_before(in_ranges(both, keys, order, steps, "ranged"), keys, order, {"rank": F.lit(1)}).drop("first__", "range__"), "keys")


def import_cells(cells: DataFrame, expected: DataFrame, shown: int = 100) -> tuple[DataFrame, DataFrame]:
    """(texts, issues) of returned rows (file, subject, sheet_index, sheet_state, row_index, cells) for expected keys
    (package_id, package_index, row_key, position) of a task.

    A file belongs to the package whose id it claims (see claimed_package), else to the only one of the index in its name; a
    foreign id is a blocking WRONG_PACKAGE. Without a package all keys of the task are expected, and a file without any of
    them is a blocking UNKNOWN_PACKAGE. Of each file the best sheet counts: visible ones first, then by keys and rows. A
    row's key is its first cell that is an expected key, its text the next cell that is not null. The first row of a key
    wins in a file, a later file (by name) over an earlier one. In a file that claims its package itself, where all rows
    stand but less than half of the keys, the n-th row is that of the n-th key, with its last text. A key that rows repeat is
    a blocking issue, as are the first `shown` missing keys of a file and the number of the others.
    texts: (row_key, translated_text, file, match); issues: (file, severity, code, row_key). The keys and the rows with
    theirs are stored, as all steps read them.
    """
    steps = Steps(cells.sparkSession)
    packages = expected.select("package_id", "package_index").distinct()
    keys = expected_keys(expected, steps)
    wanted = keys.groupBy("package_index").agg(F.count("*").alias("wanted"))
    states = steps.keep(package_of(claimed_package(cells), packages), "states")
    fit = states.where("state <> 'WRONG_PACKAGE'").select("file", F.coalesce(F.col("package_index").cast("bigint"), F.lit(WHOLE_TASK)).alias("package_index"), "by_id")
    rows = cells.join(fit, "file").select("file", "package_index", "sheet_index", "row_index", "sheet_state", "cells")
    at_row = ["file", "sheet_index", "row_index"]
    each = rows.select(*at_row, "package_index", F.posexplode("cells").alias("at", "cell")).withColumn("row_key", T.row_key(F.col("cell")))
    keyed = each.where("row_key is not null").join(keys.select("package_index", "row_key"), ["package_index", "row_key"], "left_semi")
    keyed = keyed.groupBy(*at_row).agg(F.min_by("row_key", "at").alias("row_key"), F.min("at").alias("at"), F.collect_set("row_key").alias("keys"))
    # A row for each returned one, with its key if it has one: all that follows reads this table.
    known = steps.keep(rows.join(keyed, at_row, "left").withColumn("filled", F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != "")), "returned")
    several = known.select("file", "sheet_index", F.explode("keys").alias("k")).groupBy("file", "sheet_index").agg(F.countDistinct("k").alias("distinct_keys"))
    scores = known.groupBy("file", "sheet_index").agg(F.count("row_key").alias("keyed_rows"), F.count_if("filled").alias("filled_rows"), F.max(F.col("sheet_state") == "visible").alias("visible"))
    best = best_sheet(scores.join(several, ["file", "sheet_index"], "left").fillna(0, ["distinct_keys"]))
    sheet = known.join(best, ["file", "sheet_index"])
    found = sheet.where("row_key is not null").select("file", "row_key", "row_index", value_after(F.col("cells"), F.col("at")).alias("translated_text"))
    once = found.groupBy("file", "row_key").agg(F.min_by("translated_text", "row_index").alias("translated_text"), F.count("*").alias("n"))
    exact = once.groupBy("file").agg(F.sum("n").alias("exact"), F.count("*").alias("known"))
    got = sheet.where("filled").groupBy("file").agg(F.count("*").alias("got"))
    counts = fit.join(wanted, "package_index", "left").join(got, "file", "left").join(exact, "file", "left").fillna(0, ["wanted", "got", "exact", "known"])
    counts = steps.keep(counts, "counts")
    moved = counts.where("by_id and known < wanted and got = wanted and exact * 2 < wanted").select("file", "package_index")
    nth = sheet.join(moved.select("file"), "file", "left_semi").where("filled").withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("row_index")) - 1)
    by_place = moved.join(keys, "package_index").join(nth.select("file", "rank", "cells"), ["file", "rank"]).select("file", "row_key", last_value(F.col("cells")).alias("translated_text"))
    texts = once.join(moved, "file", "left_anti").select("file", "row_key", "translated_text", F.lit("key").alias("match")).unionByName(by_place.withColumn("match", F.lit("position")))
    texts = texts.groupBy("row_key").agg(F.max_by(F.struct(F.trim(F.coalesce("translated_text", F.lit(""))).alias("translated_text"), "file", "match"), "file").alias("t")).select("row_key", "t.*")
    lacking = counts.where("known < wanted").join(moved, "file", "left_anti")
    strange = lacking.where(F.col("known") == 0).where(F.col("package_index") == WHOLE_TASK).select("file")
    lacking = lacking.join(strange, "file", "left_anti")
    # The first missing keys are among the first ones that are as many as those that the file has and `shown` more.
    head = lacking.join(keys, "package_index").where(F.col("rank") < F.col("known") + shown).join(once.select("file", "row_key"), ["file", "row_key"], "left_anti")
    head = head.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("rank"))).where(F.col("nth") <= shown)
    issue = lambda df, severity, code, key=None: df.select("file", F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit(None).cast("string") if key is None else F.col(key)).alias("row_key"))
    parts = [
        issue(states.where("state = 'WRONG_PACKAGE'"), "blocking", "WRONG_PACKAGE"),
        issue(strange, "blocking", "UNKNOWN_PACKAGE"),
        issue(once.where("n > 1"), "blocking", "DUPLICATE_ROW_KEY", "row_key"),
        issue(moved, "warning", "POSITIONAL_MATCH"),
        issue(head, "blocking", "MISSING_ROW_KEY", "row_key"),
        issue(lacking.where(F.col("wanted") - F.col("known") > shown), "blocking", "MISSING_ROW_KEY_SUMMARY"),
    ]
    return texts, functools.reduce(DataFrame.unionByName, parts)


def page_lookup(wanted: DataFrame, pages: DataFrame, columns: list[str]) -> DataFrame:
    """wanted (doc, page) with the stored page's columns; reopen says that the page is not stored."""
    known = pages.select("doc", "page", *columns).withColumn("known__", F.lit(True))
    return wanted.join(known, ["doc", "page"], "left").withColumn("reopen", F.col("known__").isNull()).drop("known__")


def recognized_instead(pages: DataFrame, recognized: DataFrame, least: int = 20) -> DataFrame:
    """(page, text, n_chars, used_ocr) of pages (page, text, n_images): where fewer than `least` signs stand beside an image,
    the recognized text (page, text) takes their place; none, if nothing was recognized."""
    found = recognized.select("page", F.col("text").alias("ocr__"))
    poor = (F.length(T.strip(F.coalesce("text", F.lit("")))) < least) & (F.col("n_images") > 0)
    text = F.when(poor, F.coalesce("ocr__", F.lit(""))).otherwise(F.coalesce("text", F.lit("")))
    return pages.join(found, "page", "left").select("page", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"), F.coalesce(poor & (F.length("ocr__") > 0), F.lit(False)).alias("used_ocr"))


def by_key(segments: DataFrame, imported: DataFrame, key: str, order: str) -> DataFrame:
    """segments with the texts of the rows of their keys; unknown keys are ignored."""
    return segments.join(first_wins(imported, key, order), key)


def missing(segments: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    return segments.join(imported.select(key).distinct(), key, "left_anti")


def missing_report(lost: DataFrame, task: str, key: str, shown: int = 100) -> DataFrame:
    """(task, code, row_key, n): the first `shown` missing keys of each task, and one summary row for the rest."""
    rank = F.row_number().over(Window.partitionBy(task).orderBy(key))
    first = lost.withColumn("r__", rank).where(F.col("r__") <= shown).select(task, F.lit("MISSING_ROW_KEY").alias("code"), F.col(key).cast("string").alias("row_key"), F.lit(1).cast("bigint").alias("n"))
    rest = lost.groupBy(task).agg((F.count("*") - shown).alias("n")).where("n > 0").select(task, F.lit("MISSING_ROW_KEY_SUMMARY").alias("code"), F.lit(None).cast("string").alias("row_key"), "n")
    return first.unionByName(rest)


def by_position(segments: DataFrame, imported: DataFrame, task: str, order: str, key: str) -> DataFrame:
    """The n-th segment with the n-th non-empty row, for tasks whose rows are as many as the segments and of which less
    than half match by key; their exact matches are dropped."""
    seg = segments.withColumn("pos__", F.row_number().over(Window.partitionBy(task).orderBy(order)))
    rows = imported.where(F.coalesce(F.trim("translated_text"), F.lit("")) != "").withColumn("pos__", F.row_number().over(Window.partitionBy(task).orderBy("row_index")))
    exact = segments.join(imported.select(task, key).distinct(), [task, key], "left_semi").groupBy(task).agg(F.count("*").alias("exact"))
    wanted, got = segments.groupBy(task).agg(F.count("*").alias("wanted")), rows.groupBy(task).agg(F.count("*").alias("got"))
    fits = wanted.join(got, task).join(exact, task, "left").where("wanted = got and coalesce(exact, 0) < wanted and coalesce(exact, 0) * 2 < wanted").select(task)
    return seg.join(fits, task, "left_semi").join(rows.select(task, "pos__", "translated_text"), [task, "pos__"]).drop("pos__").withColumn("match", F.lit("position"))


def package_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(file, state, package_index, by_id) of files (file, package_id): the package of the id, which must be known, else the
    only one of the index that the file's name gives; by_id says which."""
    index = F.regexp_extract("file", r"_(\d{3})_of_\d{3}\.xlsx$", 1)
    known = packages.select("package_id", F.col("package_index").alias("own__"))
    single = packages.groupBy(F.col("package_index").alias("named__")).agg(F.count("*").alias("n__")).where("n__ = 1").select("named__", F.col("named__").alias("index__"))
    named = files.withColumn("named__", F.when(F.col("package_id").isNull() & (index != ""), index.cast("bigint")))
    met = named.join(known, "package_id", "left").join(single, "named__", "left").withColumn("found__", F.coalesce("own__", "index__"))
    state = F.when(F.col("found__").isNotNull(), "OK").when(F.col("package_id").isNotNull(), "WRONG_PACKAGE").otherwise("UNKNOWN_PACKAGE")
    return met.select("file", state.alias("state"), F.col("found__").alias("package_index"), F.col("own__").isNotNull().alias("by_id"))


def manual_updates(segments: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(segments with the new texts, updates of unknown keys)."""
    new = updates.select(key, F.col("translated_text").alias("new__"))
    done = segments.join(new, key, "left").withColumn("translated_text", F.coalesce("new__", "translated_text")).drop("new__")
    return done, updates.join(segments.select(key), key, "left_anti")
