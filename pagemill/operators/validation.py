"""Declarative validation of translations, with source fallback and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T


def source_fallback(segments: DataFrame, restorable: Column | None = None, text: Column | None = None) -> DataFrame:
    """Empty or missing translations take the source text, with the reason and a sticky status; so do those whose protected
    tokens cannot be put back, where `restorable` tells that. Others give `text`, or the translation where none is named."""
    empty = T.strip(F.coalesce("translated_text", F.lit(""))) == ""
    old = F.col("status") == "source_fallback" if "status" in segments.columns else F.lit(False)
    broken = F.lit(False) if restorable is None else ~F.coalesce(restorable, F.lit(False))
    fall = F.coalesce(empty | old | broken, F.lit(False))
    reason = F.when(F.col("translated_text").isNull(), "missing").when(empty, "empty").when(old, "earlier").when(broken, "unrestorable")
    done = F.when(fall, F.col("source_text")).otherwise(F.col("translated_text") if text is None else text)
    return segments.withColumns({"output_text": done, "fallback_reason": reason, "status": F.when(fall, "source_fallback").otherwise("translated")})


def after_fallback(found: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, severity, code) once segments (keys, fallback_reason) fell back: issues but those of missing keys, which the
    source text now answers, and a warning for each segment that fell back."""
    kept = found.where(~F.col("code").isin("MISSING_ROW_KEY", "MISSING_ROW_KEY_SUMMARY")).select(*keys, "severity", "code")
    fallen = segments.where("fallback_reason is not null").select(*keys, F.lit("warning").alias("severity"), F.lit("SOURCE_FALLBACK").alias("code"))
    return kept.unionByName(fallen)


def issues(segments: DataFrame, keys: list[str], number_warnings: bool = True) -> DataFrame:
    """(keys, severity, code): every rule that a row breaks, in one pass. Rows in fallback break none but SOURCE_FALLBACK;
    an empty text breaks only EMPTY_TRANSLATION. Token rules apply where the columns missing (those that block), allowed (those that do not), duplicated, unknown exist."""
    text, source = F.coalesce("translated_text", F.lit("")), F.coalesce("source_text", F.lit(""))
    ratio = F.length(T.strip(text)) / F.greatest(F.length(T.strip(source)), F.lit(1))
    rules = [
        ("UNCHANGED_TEXT", "warning", T.casefold(T.squeeze(text)) == T.casefold(T.squeeze(source))),
        ("ABNORMAL_LENGTH", "warning", (ratio > 4.0) | (ratio < 0.08)),
        ("LOW_CHINESE_RATIO", "warning", (F.length(T.strip(source)) >= 30) & (T.cjk_ratio(text) < 0.08)),
    ]
    rules += [("NUMBER_CHANGED", "warning", T.numbers(text) != T.numbers(source))] if number_warnings else []
    rules += [("PLACEHOLDER_CHANGED_ALLOWED", "warning", F.size("allowed") > 0)] if "allowed" in segments.columns else []
    for column, code in (("missing", "MISSING_PLACEHOLDER"), ("duplicated", "DUPLICATED_PLACEHOLDER"), ("unknown", "UNKNOWN_PLACEHOLDER")):
        rules += [(code, "blocking", F.size(column) > 0)] if column in segments.columns else []
    rows = [F.when(broken, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for code, severity, broken in rules]
    fallback = F.lit(False) if "status" not in segments.columns else F.col("status") == "source_fallback"
    empty = T.strip(text) == ""
    one = lambda severity, code: F.array(F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    every = F.when(fallback, one("warning", "SOURCE_FALLBACK")).when(empty, one("blocking", "EMPTY_TRANSLATION")).otherwise(F.filter(F.array(*rows), lambda x: x.isNotNull()))
    return segments.select(*keys, F.inline(every))


def report(segments: DataFrame, found: DataFrame, task: str) -> DataFrame:
    """(task, total_segments, translated_segments, blocking_errors, warnings, can_generate)."""
    filled = T.strip(F.coalesce("translated_text", F.lit(""))) != ""
    filled = filled | (F.col("status") == "source_fallback") if "status" in segments.columns else filled
    totals = segments.groupBy(task).agg(F.count("*").alias("total_segments"), F.count_if(filled).alias("translated_segments"))
    broken = found.groupBy(task).agg(F.count_if(F.col("severity") == "blocking").alias("blocking_errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = totals.join(broken, task, "left").fillna(0, ["blocking_errors", "warnings"])
    return out.withColumn("can_generate", (F.col("blocking_errors") == 0) & (F.col("translated_segments") == F.col("total_segments")))
