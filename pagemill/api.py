"""The engine's verbs, each from DataFrames to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import layout, masking, matching, packing, quality, store, validation, visual
from pagemill.sources import xlsx


@dataclass(frozen=True)
class Settings:
    """Options of a task."""

    page_start: int = 1
    page_end: int | None = None
    stable_keys: bool = False
    number_warnings: bool = False
    protected_terms: tuple[str, ...] = ()
    max_rows: int = packing.MAX_ROWS
    max_chars: int = packing.MAX_CHARS
    max_bytes: int = packing.MAX_BYTES


@dataclass
class Engine:
    """One task over a table of lines (page, line_no, line)."""

    spark: SparkSession
    task: str
    settings: Settings = field(default_factory=Settings)

    def inspect(self, lines: DataFrame) -> DataFrame:
        signs = lines.groupBy("page").agg(F.sum(F.length("line")).alias("n_signs"))
        return quality.inspect_pages(signs.withColumn("doc", F.lit(self.task)))

    def create(self, lines: DataFrame) -> DataFrame:
        """Segments with ids, keys and masks."""
        own = self.settings
        if own.page_start != 1 or own.page_end is not None:
            lines = lines.where(F.col("page") >= own.page_start) if own.page_end is None else lines.where(F.col("page").between(own.page_start, own.page_end))
        seg = layout.segments(layout.paragraphs(layout.merge_lines(lines)), own.stable_keys).withColumnRenamed("text", "source_text")
        return masking.protect(seg.withColumn("task_id", F.lit(self.task)), self.task, "segment_id", "source_text", own.protected_terms)

    def _packed(self, segments: DataFrame) -> DataFrame:
        """The translatable rows in packages bounded by rows, signs and bytes."""
        rows = segments.where("should_translate").select("task_id", "segment_id", "row_key", F.col("protected_text").alias("text"), F.length("protected_text").alias("n"))
        own = self.settings
        sized = rows.withColumn("row_bytes", packing.checked_bytes("text", "segment_id", own.max_bytes))
        return packing.next_fit(sized, "task_id", "segment_id", "n", own.max_chars, own.max_rows, "row_bytes", own.max_bytes)

    def export(self, segments: DataFrame, path: str | None = None) -> DataFrame:
        """The packages of the translatable rows; with a path, as XLSX files there."""
        packed = self._packed(segments)
        each = packing.packages(packed, "task_id", "n")
        return each if path is None else xlsx.write_packages(packed.join(each.select("task_id", "package_index", "package_total"), ["task_id", "package_index"]), path)

    def import_(self, segments: DataFrame, cells: DataFrame) -> DataFrame:
        """segments with the texts of returned cells, as `import_with_issues` finds them."""
        return self.import_with_issues(segments, cells)[0]

    def import_with_issues(self, segments: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(segments with the texts of returned cells (file, subject, sheet_index, sheet_state, row_index, cells), issues of
        the files), by the rules of `matching.import_cells`."""
        packed = self._packed(segments)
        name = F.format_string("PKG-%s-%03d", F.col("task_id"), F.col("package_index"))
        expected = packed.select(name.alias("package_id"), "package_index", "row_key", F.col("segment_id").alias("position"))
        texts, issues = matching.import_cells(cells, expected)
        return segments.join(texts.select("row_key", "translated_text"), "row_key", "left"), issues

    def validate(self, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(issues, report) of the translatable segments, tokens restored."""
        rows = masking.restored(segments.where("should_translate"), "translated_text", "placeholders").withColumns({"allowed": masking.allowed_missing(F.col("placeholders"), F.col("missing"), not self.settings.number_warnings), "missing": masking.blocking_missing(F.col("placeholders"), F.col("missing"), not self.settings.number_warnings)})
        ready = rows.withColumn("translated_text", F.when(F.col("translated_text").isNotNull(), F.col("restored_text")))
        found = validation.issues(ready, ["task_id", "segment_id"], self.settings.number_warnings)
        return found, validation.report(ready, found, "task_id")

    def update(self, segments: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
        return matching.manual_updates(segments, updates, "segment_id")

    def confirm(self, report: DataFrame) -> DataFrame:
        """The confirmation that generation asks for, if the report allows it."""
        return report.where("can_generate").select("task_id", F.lit(True).alias("confirmed"))

    def generate(self, segments: DataFrame, anchors: DataFrame) -> DataFrame:
        """A row for each visual anchor (segment_id, anchors: array of source parts; crossing, if it is there: whether the
        paragraph crosses columns or pages), with its part of the text, tokens put back. Segments whose tokens cannot be put
        back keep their source, as do anchors whose labels stay."""
        found = masking.restored(segments, "translated_text", "placeholders")
        safe = masking.restore_ok(F.col("placeholders"), F.col("missing"), F.col("duplicated"), F.col("unknown"), not self.settings.number_warnings)
        done = validation.source_fallback(found, safe, F.col("restored_text")).join(anchors, "segment_id")
        crossing = done if "crossing" in anchors.columns else done.withColumn("crossing", F.lit(False))
        fallen = F.col("status") == "source_fallback"
        parts = visual.over_anchors(crossing, "output_text", "anchors", "crossing")
        return visual.expand(parts.withColumn("parts", F.when(fallen, F.col("anchors")).otherwise(F.col("parts"))))

    def cleanup(self, files: DataFrame, referenced: DataFrame) -> DataFrame:
        return store.orphans(files, referenced, "file")

    def delete(self, tasks: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
        gone = self.spark.createDataFrame([(self.task,)], "task_id string")
        return store.remove_tasks(tasks, segments, gone, "task_id")
