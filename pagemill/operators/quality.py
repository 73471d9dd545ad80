"""Roll-ups: layout quality, page risk, colors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layout_report(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page, n_boxes, n_pairs, max_ratio, risk, status): boxes of each page with the overlaps that were found."""
    n = boxes.groupBy("page").agg(F.count("*").alias("n_boxes"))
    found = pairs.groupBy("page").agg(F.count("*").alias("n_pairs"), F.max("ratio").alias("max_ratio"))
    out = n.join(found, "page", "left").fillna({"n_pairs": 0, "max_ratio": 0.0})
    risk = F.round(0.25 * F.least("n_pairs", F.lit(30)) + F.col("max_ratio"), 6)
    status = F.when(F.col("max_ratio") >= 0.95, "needs_review").when(F.col("n_pairs") > 0, "passed_with_warnings").otherwise("passed")
    return out.withColumns({"risk": risk, "status": status})


def audit_risk(pages: DataFrame) -> DataFrame:
    """(page, outside_ratio, outside_share, n_pairs, max_ratio, risk_score) of pages (page, changed, outside, pixels, n_pairs,
    max_ratio): 10,000 times the share of pixels changed outside text, 10 times their share of all changed ones, a quarter
    for each overlap up to 30, and the largest overlap. The weights are fixed values."""
    ratio = F.col("outside") / F.greatest("pixels", F.lit(1))
    share = F.col("outside") / F.greatest("changed", F.lit(1))
    risk = ratio * 10_000 + share * 10 + F.least("n_pairs", F.lit(30)) * 0.25 + F.col("max_ratio")
    return pages.select("page", F.round(ratio, 6).alias("outside_ratio"), F.round(share, 6).alias("outside_share"), "n_pairs", F.round("max_ratio", 4).alias("max_ratio"), F.round(risk, 4).alias("risk_score"))


def audit_report(risks: DataFrame) -> DataFrame:
    """One row: pages checked, those with more than 0.1 % changed outside text, those with overlaps, the largest share."""
    return risks.agg(F.count("*").alias("pages_checked"), F.count_if(F.col("outside_ratio") > 0.001).alias("pages_changed_outside"), F.count_if(F.col("n_pairs") > 0).alias("pages_with_overlaps"), F.coalesce(F.max("outside_ratio"), F.lit(0.0)).alias("largest_outside_ratio"))


def task_counts(segments: DataFrame, task: str) -> DataFrame:
    """(task, n_segments, n_translatable, n_translated, n_fallback, n_chinese) of segments (task, translated_text,
    should_translate, status): what a saved task states. All counts but the first are of translatable segments."""
    own, filled = F.col("should_translate"), F.trim(F.coalesce("translated_text", F.lit(""))) != ""
    fallback = F.coalesce(F.col("status") == "source_fallback", F.lit(False))
    return segments.groupBy(task).agg(F.count("*").alias("n_segments"), F.count_if(own).alias("n_translatable"), F.count_if(own & filled).alias("n_translated"), F.count_if(own & fallback).alias("n_fallback"), F.count_if(own & filled & ~fallback).alias("n_chinese"))


def font_stats(spans: DataFrame) -> DataFrame:
    """(page, block, largest, median_size, font) of spans (page, block, span_no, size, font): sizes that are no zero, 0
    without any; the most common font, of several the first seen, '' without any."""
    size = F.nullif(F.col("size"), F.lit(0.0))
    sizes = spans.groupBy("page", "block").agg(F.coalesce(F.max(size), F.lit(0.0)).alias("largest"), F.coalesce(F.median(size), F.lit(0.0)).alias("median_size"))
    fonts = spans.where("font <> ''").groupBy("page", "block", "font").agg(F.count("*").alias("n"), F.min("span_no").alias("first"))
    best = fonts.groupBy("page", "block").agg(F.max_by("font", F.struct("n", -F.col("first"))).alias("font"))
    return sizes.join(best, ["page", "block"], "left").withColumn("font", F.coalesce("font", F.lit("")))


def page_median(stats: DataFrame, default: float = 10.0) -> DataFrame:
    """(page, page_median): the median of the blocks' positive sizes."""
    return stats.groupBy("page").agg(F.coalesce(F.median(F.when(F.col("median_size") > 0, F.col("median_size"))), F.lit(default)).alias("page_median"))


def same_page_sizes(source: DataFrame, output: DataFrame) -> DataFrame:
    """(doc, n_source, n_output, same_sizes): as many pages, each within a tenth of a point (doc, page, width, height)."""
    both = source.join(output.select("doc", "page", F.col("width").alias("w__"), F.col("height").alias("h__")), ["doc", "page"], "full_outer")
    fine = (F.abs(F.col("width") - F.col("w__")) < 0.1) & (F.abs(F.col("height") - F.col("h__")) < 0.1)
    return both.groupBy("doc").agg(F.count("width").alias("n_source"), F.count("w__").alias("n_output"), F.bool_and(F.coalesce(fine, F.lit(False))).alias("same_sizes"))


def riskiest(report: DataFrame, n: int = 30) -> DataFrame:
    """The n pages of highest risk (ties: the smaller page)."""
    return report.orderBy(F.desc("risk"), "page").limit(n)


def color_mode(values: DataFrame, step: int = 12) -> DataFrame:
    """(page, bin, n, ratio): values in bins of `step`; the fullest (ties: the smaller) and its share."""
    bins = values.groupBy("page", F.floor(F.col("value") / step).alias("bin")).agg(F.count("*").alias("n"))
    best = bins.groupBy("page").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.select("page", "bin", "n", F.round(F.col("n") / F.col("total"), 6).alias("ratio"))


def inspect_pages(pages: DataFrame) -> DataFrame:
    """(doc, n_pages, text_pages, image_pages, mode): a page has text from 20 signs on; text, image or mixed."""
    out = pages.groupBy("doc").agg(F.count("*").alias("n_pages"), F.count_if(F.col("n_signs") >= 20).alias("text_pages"), F.count_if(F.col("n_signs") < 20).alias("image_pages"))
    return out.withColumn("mode", F.when(F.col("image_pages") == 0, "text").when(F.col("text_pages") == 0, "image").otherwise("mixed"))


def reflow_quality(segments: DataFrame, placed: DataFrame) -> DataFrame:
    """(page, n_segments, n_missing, coverage): segments of each page that were not placed."""
    lost = segments.join(placed.select("segment_id").distinct(), "segment_id", "left_anti").groupBy("page").agg(F.count("*").alias("n_missing"))
    out = segments.groupBy("page").agg(F.count("*").alias("n_segments")).join(lost, "page", "left").fillna(0, ["n_missing"])
    return out.withColumn("coverage", F.round(1 - F.col("n_missing") / F.col("n_segments"), 6))
