"""The report on a drawn task: one row of measures for each task, with the first of what is to be looked at by eye."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.spatial import overlap_pairs

#: So many entries of each list are shown; counts are of all.
SHOWN = 100
FLAT = "dense-flat-cleanup"


def first_of(rows: DataFrame, task: str, order: list[str], entry: Column, out: str, shown: int = SHOWN) -> DataFrame:
    """(task, out): the entries of the first `shown` rows of each task in order. Ranks above that end before the shuffle, so
    that a task gathers no more rows than are shown from each of Spark's tasks."""
    rank = F.row_number().over(Window.partitionBy(task).orderBy(*order))
    some = rows.select(task, *order, entry.alias("entry__"), rank.alias("rank__")).where(F.col("rank__") <= shown)
    ordered = F.array_sort(F.collect_list(F.struct("rank__", "entry__")))
    return some.groupBy(task).agg(F.transform(ordered, lambda x: x["entry__"]).alias(out))


def _of_placements(placements: DataFrame) -> DataFrame:
    size = F.col("font_size")
    return placements.groupBy("task").agg(
        F.count("*").alias("replaced_segments"),
        F.count_if(~F.col("fitted")).alias("overflow_errors"),
        F.min(size).alias("minimum_rendered_font_size"),
        F.count_if(size + 0.1 < F.col("source_size")).alias("font_reductions"),
        F.count_if("rotated").alias("rotated_segments"),
        F.count_if("contour_flow").alias("contour_flow_segments"),
    )


def _of_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("task").agg(
        F.count("*").alias("source_pages"),
        F.count("output_page").alias("output_pages"),
        F.bool_and(F.coalesce("same_size", F.lit(False))).alias("page_sizes_preserved"),
        F.count_if(F.col("tiles") > 0).alias("repair_image_layers"),
        F.sum("tiles").alias("repair_image_tiles"),
        F.sum("redactions").alias("vector_text_redactions"),
        F.count_if("vector_cleaned").alias("vector_cleaned_pages"),
        F.count_if("rasterized").alias("rasterized_pages"),
        F.count_if("dense").alias("dense_pages"),
        F.sum("complex_backgrounds").alias("complex_background_repairs"),
        F.bround(F.avg("mask_ratio"), 6).alias("masked_page_area_ratio"),
        F.bround(F.max("mask_ratio"), 6).alias("maximum_page_mask_area_ratio"),
    )


def _of_segments(segments: DataFrame) -> DataFrame:
    back = F.coalesce(F.col("status") == "source_fallback", F.lit(False))
    return segments.groupBy("task").agg(
        F.count("*").alias("visual_anchors"),
        F.count_if("should_translate").alias("semantic_paragraphs"),
        F.count_if(back & F.col("should_translate")).alias("source_fallback_segments"),
        F.count_if(back).alias("visual_source_fallback_segments"),
    )


def drawing_report(placements: DataFrame, pages: DataFrame, segments: DataFrame, fallbacks: DataFrame, issues: DataFrame, shown: int = SHOWN) -> DataFrame:
    """One row for each task of `pages`.

    placements: (task, page, box_id, segment_id, x0, y0, x1, y1, font_size, source_size, rotated, contour_flow, fitted,
    background), page being unique over the tasks; pages: (task, page, output_page, same_size, tiles, redactions,
    vector_cleaned, rasterized, dense, complex_backgrounds, mask_ratio); segments: (task, segment_id, should_translate,
    status); fallbacks: (task, segment_id, reason); issues: (task, severity, segment_id, message).

    A task needs review if a text overflowed, a page's size changed or a page is dense; it passed with warnings if boxes
    overlap, issues warn or texts fell back; else it passed. Lists hold the first `shown` entries.
    """
    pairs = overlap_pairs(placements).join(placements.select("page", F.col("box_id").alias("a"), "task", F.col("segment_id").alias("first")), ["page", "a"])
    pairs = pairs.join(placements.select("page", F.col("box_id").alias("b"), F.col("segment_id").alias("second")), ["page", "b"])
    shared = F.round(F.col("width") * F.col("height"), 2)
    dense = pages.where("dense").select("task", "page")
    flat = placements.where(F.col("background").startswith(FLAT)).select("task", "page").distinct()
    counted = pages.select("task").distinct()
    for part in (
        _of_pages(pages),
        _of_placements(placements),
        _of_segments(segments),
        fallbacks.groupBy("task").agg(F.count("*").alias("layout_fallback_segments")),
        pairs.groupBy("task").agg(F.count("*").alias("source_bbox_overlap_warnings")),
        issues.groupBy("task").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "warning").alias("warnings")),
        first_of(pages.where("rasterized"), "task", ["page"], F.col("page"), "rasterized_source_pages", shown),
        first_of(dense, "task", ["page"], F.col("page"), "dense_pages_requiring_review", shown),
        first_of(dense.join(flat, ["task", "page"], "left_semi"), "task", ["page"], F.col("page"), "dense_flat_page_cleanups", shown),
        first_of(segments.where("status = 'source_fallback' and should_translate"), "task", ["segment_id"], F.col("segment_id"), "source_fallback_segment_ids", shown),
        first_of(segments.where("status = 'source_fallback'"), "task", ["segment_id"], F.col("segment_id"), "visual_source_fallback_segment_ids", shown),
        first_of(fallbacks, "task", ["segment_id"], F.struct("segment_id", "reason"), "layout_fallback_reasons", shown),
        first_of(placements.where("not fitted"), "task", ["page", "box_id"], F.col("segment_id"), "overflow_segment_ids", shown),
        first_of(pairs, "task", ["page", "a", "b"], F.struct("page", "first", "second", shared.alias("intersection_area")), "source_bbox_overlap_pairs", shown),
        first_of(issues, "task", ["severity", "segment_id", "message"], F.struct("severity", "segment_id", "message"), "shown_issues", shown),
    ):
        counted = counted.join(part, "task", "left")
    filled = {name: F.coalesce(F.col(name), F.lit(0).cast(kind)) for name, kind in counted.dtypes if kind in ("bigint", "int", "double")}
    filled |= {name: F.coalesce(F.col(name), F.array().cast(kind)) for name, kind in counted.dtypes if kind.startswith("array")}
    counted = counted.withColumns(filled)
    review = (F.col("overflow_errors") > 0) | ~F.col("page_sizes_preserved") | (F.col("dense_pages") > 0)
    warned = (F.col("source_bbox_overlap_warnings") > 0) | (F.col("warnings") > 0) | (F.col("layout_fallback_segments") > 0)
    return counted.withColumn("status", F.when(review, "needs_review").when(warned, "passed_with_warnings").otherwise("passed"))
