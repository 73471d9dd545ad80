"""Registered queries of what is settled before and reported after drawing: collisions, room for texts, quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.operators import caching, collisions, drawing_report, fitting, masking, validation, visual
from pagemill.plans.catalog import BOXES, PAIRS, WRAPPED, _boxes, _docs, _pairs, query
from pagemill.sources import adapters as A

#: Boxes as labels of a map: a tenth of the size, with words that repeat; upright ones are read from below.
LABELS = f"""{BOXES}, labels AS (SELECT page, box_id, x0 / 8 AS x0, y0 / 8 AS y0, x0 / 8 + 2 + (x1 - x0) / 16 AS x1, y0 / 8 + 2 + (y1 - y0) / 16 AS y1,
  CASE WHEN box_id % 17 = 3 THEN 'ab c' WHEN box_id % 23 = 5 THEN 'It ends.' || repeat(' word', 9) ELSE 'Label ' || (box_id % 7) END AS source, 'text ' || (box_id % 13) AS text, 4.0 + box_id % 5 AS size FROM boxes)"""
SHAPES = """shaped AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, greatest(y1 - y0, 1) > greatest(x1 - x0, 1) * 1.45 AS turned FROM labels),
  laid AS (SELECT *, CASE WHEN turned THEN greatest(1, least(greatest(w, 1), greatest(1, size * 1.45))) ELSE w END AS pw, CASE WHEN turned THEN greatest(1, greatest(h, 1)) ELSE h END AS ph FROM shaped),
  regions AS (SELECT page, box_id, lower(source) AS words, x0, y0, x1, y1, turned, (x0 + x1 - pw) / 2 AS px0, (x0 + x1 + pw) / 2 AS px1, (y0 + y1 - ph) / 2 AS py0, (y0 + y1 + ph) / 2 AS py1, pw * ph AS area, w * h AS box_area
    FROM laid WHERE length(source) <= 48 AND {kept})"""
MET = """met AS (SELECT l.page, l.box_id AS a, r.box_id AS b, l.words = r.words AS same, l.turned OR r.turned AS turned, least(l.area, r.area) AS least_area,
    greatest(0, least(l.px1, r.px1) - greatest(l.px0, r.px0)) * greatest(0, least(l.py1, r.py1) - greatest(l.py0, r.py0)) AS common,
    greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0)) / greatest(least(l.box_area, r.box_area), 0.01) AS boxes FROM regions l JOIN regions r ON l.page = r.page AND l.box_id < r.box_id),
  pairs AS (SELECT page, a, b, same, CASE WHEN least_area > 0.1 THEN common / least_area ELSE 0 END AS shared FROM met WHERE (least_area > 0.1 AND common / least_area >= 0.08) OR (turned AND boxes >= 0.15)),
  told AS (SELECT page, a, b, b AS segment_id, CASE WHEN same THEN '{repeated}' ELSE '{collides}' END AS reason FROM pairs UNION ALL SELECT page, a, b, a, '{collides}' FROM pairs WHERE NOT same),
  crowded AS (SELECT page, segment_id, arg_min(reason, (a, b)) AS reason FROM told GROUP BY 1, 2)""".format(repeated=collisions.REPEATED, collides=collisions.COLLIDES)


def _labels(s, d):
    k = F.col("box_id")
    words = F.when(k % 17 == 3, "ab c").when(k % 23 == 5, F.concat(F.lit("It ends."), F.repeat(F.lit(" word"), F.lit(9)))).otherwise(F.concat(F.lit("Label "), k % 7))
    far = lambda a, b: F.col(a) / 8 + 2 + (F.col(b) - F.col(a)) / 16
    spots = _boxes(s, d).withColumns({"x1": far("x0", "x1"), "y1": far("y0", "y1"), "x0": F.col("x0") / 8, "y0": F.col("y0") / 8})
    return spots.select("page", k.alias("region"), k.alias("segment_id"), words.alias("source"), F.concat(F.lit("text "), k % 13).alias("text"), "x0", "y0", "x1", "y1", F.lit(0.0).alias("rotation"), (4.0 + k % 5).alias("size"), F.lit(1).alias("n_boxes"))


@query(f"WITH {LABELS}, {SHAPES.format(kept='true')}, {MET} SELECT page, a, b, round(shared, 6) AS shared, same FROM pairs")
def q84_label_collisions(s, d):
    """Labels of a page that would be drawn over each other."""
    pairs = collisions.colliding(collisions.label_regions(_labels(s, d)), 8.0)
    return pairs.select("page", "a", "b", G.rounded(F.col("shared"), 6).alias("shared"), "same")


@query()
def q85_turned_label_collisions(s, d):
    """Labels turned by all multiples of 15 degrees, with the reason that each keeps its source for."""
    turned = _labels(s, d).withColumn("rotation", (F.col("region") % 24 * 15 - 180).cast("double"))
    return collisions.collision_reasons(collisions.first_colliding(collisions.label_regions(turned), 8.0))


@query(f"""WITH {LABELS}, {SHAPES.format(kept="source <> 'ab c' AND length(text) * 0.5 * size <= w * h")}, {MET},
fit AS (SELECT *, CASE WHEN source = 'ab c' THEN '{collisions.FRAGMENTED}' WHEN length(text) * 0.5 * size > (x1 - x0) * (y1 - y0) THEN '{collisions.NO_ROOM}' END AS first FROM labels)
SELECT page, box_id AS segment_id, coalesce(first, crowded.reason) AS reason FROM fit LEFT JOIN crowded ON crowded.page = fit.page AND crowded.segment_id = fit.box_id WHERE coalesce(first, crowded.reason) IS NOT NULL""".replace("SELECT page, box_id AS segment_id", "SELECT fit.page AS page, box_id AS segment_id"))
def q86_preflight_fallbacks(s, d):
    """What keeps its source text before anything is erased, with the first reason that holds."""
    room = F.length("text") * 0.5 * F.col("size") <= (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return collisions.preflight(_labels(s, d).withColumns({"fits": room, "whole": F.col("source"), "n_whole": F.col("n_boxes")}), 8.0)


#: Sources as drawn tasks, their documents as pages and lines as placed texts, with faults of each kind here and there.
DRAWN = f"""{WRAPPED}, l AS (SELECT source AS task, page, line_no AS k, length(line) AS n, 'P' || lpad(page::VARCHAR, 7, '0') || '-' || lpad(line_no::VARCHAR, 5, '0') AS segment_id FROM visual_lines JOIN documents ON doc_id = page),
 placed AS (SELECT *, k * 12.0::DOUBLE AS y0, k * 12.0::DOUBLE + CASE WHEN k % 7 = 3 THEN 14.0 ELSE 11.0 END AS y1, 40.0::DOUBLE + 4.0 * n AS x1, 8.0::DOUBLE - 0.5 * (k % 4) AS font_size, k % 97 <> 5 AS fitted, k % 13 = 6 AS flat, k % 37 = 8 AS back, n > 3 AS own FROM l),
 p AS (SELECT source AS task, doc_id AS page, doc_id % 4 AS tiles, doc_id % 9 = 4 AS rasterized, (SELECT count(*) FROM l WHERE l.page = doc_id) AS lines FROM documents),
 pg AS (SELECT task, count(*) AS source_pages, count(*) FILTER (page % 50 <> 7) AS output_pages, bool_and(page % 50 <> 7 AND page % 31 <> 9) AS page_sizes_preserved, count(*) FILTER (tiles > 0) AS repair_image_layers, CAST(sum(tiles) AS BIGINT) AS repair_image_tiles, CAST(sum(CASE WHEN page % 2 = 0 THEN lines ELSE 0 END) AS BIGINT) AS vector_text_redactions, count(*) FILTER (page % 2 = 0) AS vector_cleaned_pages,
  count(*) FILTER (rasterized) AS rasterized_pages, count(*) FILTER (lines >= 120) AS dense_pages, CAST(sum(page % 3) AS BIGINT) AS complex_background_repairs, round(avg(least(1.0::DOUBLE, lines / 487)), 6) AS masked_page_area_ratio, round(max(least(1.0::DOUBLE, lines / 487)), 6) AS maximum_page_mask_area_ratio,
  coalesce(array_to_string((list(page ORDER BY page) FILTER (rasterized))[1:100], ','), '') AS rasterized_source_pages, coalesce(array_to_string((list(page ORDER BY page) FILTER (lines >= 120))[1:100], ','), '') AS dense_pages_requiring_review, coalesce(array_to_string((list(page ORDER BY page) FILTER (lines >= 120 AND page IN (SELECT page FROM placed WHERE flat)))[1:100], ','), '') AS dense_flat_page_cleanups FROM p GROUP BY 1),
 pl AS (SELECT task, count(*) AS replaced_segments, count(*) FILTER (NOT fitted) AS overflow_errors, min(font_size) AS minimum_rendered_font_size, count(*) FILTER (font_size + 0.1 < 8.0) AS font_reductions, count(*) FILTER (k % 31 = 4) AS rotated_segments, count(*) FILTER (k % 5 = 2) AS contour_flow_segments, count(*) AS visual_anchors, count(*) FILTER (own) AS semantic_paragraphs,
  count(*) FILTER (back AND own) AS source_fallback_segments, count(*) FILTER (back) AS visual_source_fallback_segments, count(*) FILTER (k % 41 = 9) AS layout_fallback_segments, count(*) FILTER (k % 53 = 1) AS issues, count(*) FILTER (k % 53 = 1 AND k % 2 = 1) AS warnings,
  coalesce(array_to_string((list(segment_id ORDER BY segment_id) FILTER (back AND own))[1:100], ','), '') AS source_fallback_segment_ids, coalesce(array_to_string((list(segment_id ORDER BY segment_id) FILTER (back))[1:100], ','), '') AS visual_source_fallback_segment_ids, coalesce(array_to_string((list(segment_id || '=' || (k % 2) ORDER BY segment_id) FILTER (k % 41 = 9))[1:100], ','), '') AS layout_fallback_reasons,
  coalesce(array_to_string((list(segment_id ORDER BY page, k) FILTER (NOT fitted))[1:100], ','), '') AS overflow_segment_ids FROM placed GROUP BY 1),
 ov AS (SELECT a.task, a.page, a.segment_id AS first, b.segment_id AS second, a.k FROM placed a JOIN placed b ON b.page = a.page AND b.k = a.k + 1 AND a.k % 7 = 3 AND a.n > 0 AND b.n > 0),
 op AS (SELECT task, count(*) AS source_bbox_overlap_warnings, array_to_string(list(first || '+' || second ORDER BY page, k)[1:100], ',') AS source_bbox_overlap_pairs FROM ov GROUP BY 1)"""
COUNTS = "replaced_segments overflow_errors minimum_rendered_font_size font_reductions rotated_segments contour_flow_segments visual_anchors semantic_paragraphs source_fallback_segments visual_source_fallback_segments layout_fallback_segments issues warnings source_bbox_overlap_warnings".split()
LISTS = "source_fallback_segment_ids visual_source_fallback_segment_ids layout_fallback_reasons overflow_segment_ids source_bbox_overlap_pairs".split()


def drawn_tables(s, d):
    """(placements, pages, segments, fallbacks, issues) as `drawing_report` takes them."""
    docs, k, p = _docs(s, d), F.col("line_no"), F.col("page")
    lines = A.visual_lines(docs).join(docs.select(F.col("doc_id").alias("page"), F.col("source").alias("task")), "page")
    lines = lines.withColumn("segment_id", F.format_string("P%07d-%05d", p, k))
    top, flag = k * 12.0, (lambda test, yes, no: F.when(test, F.lit(yes)).otherwise(F.lit(no)))
    background = flag(k % 13 == 6, f"{drawing_report.FLAT}-x", "plain")
    placements = lines.select("task", "page", k.alias("box_id"), "segment_id", F.lit(40.0).alias("x0"), top.alias("y0"), (F.length("line") * 4.0 + 40.0).alias("x1"), (top + flag(k % 7 == 3, 14.0, 11.0)).alias("y1"), (F.lit(8.0) - k % 4 * 0.5).alias("font_size"), F.lit(8.0).alias("source_size"), (k % 31 == 4).alias("rotated"), (k % 5 == 2).alias("contour_flow"), (k % 97 != 5).alias("fitted"), background.alias("background"))
    own = docs.select(F.col("source").alias("task"), F.col("doc_id").alias("page")).join(lines.groupBy("page").agg(F.count("*").alias("lines")), "page", "left").fillna(0, ["lines"])
    pages = own.select("task", "page", F.when(p % 50 != 7, p).alias("output_page"), (p % 31 != 9).alias("same__"), (p % 4).alias("tiles"), F.when(p % 2 == 0, F.col("lines")).otherwise(0).alias("redactions"), (p % 2 == 0).alias("vector_cleaned"), (p % 9 == 4).alias("rasterized"), (F.col("lines") >= 120).alias("dense"), (p % 3).alias("complex_backgrounds"), F.least(F.lit(1.0), F.col("lines") / 487).alias("mask_ratio"))
    pages = pages.withColumn("same_size", F.col("output_page").isNotNull() & F.col("same__")).drop("same__")
    segments = lines.select("task", "segment_id", (F.length("line") > 3).alias("should_translate"), flag(k % 37 == 8, "source_fallback", "translated").alias("status"))
    fallbacks = lines.where(k % 41 == 9).select("task", "segment_id", (k % 2).cast("string").alias("reason"))
    issues = lines.where(k % 53 == 1).select("task", flag(k % 2 == 1, "warning", "info").alias("severity"), "segment_id", F.lit("a line to look at").alias("message"))
    return placements, pages, segments, fallbacks, issues


@query(f"""WITH {DRAWN}, t AS (SELECT pg.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS)}, {", ".join(f"coalesce({c}, '') AS {c}" for c in LISTS)} FROM pg LEFT JOIN pl USING (task) LEFT JOIN op USING (task))
SELECT *, CASE WHEN overflow_errors > 0 OR NOT page_sizes_preserved OR dense_pages > 0 THEN 'needs_review' WHEN source_bbox_overlap_warnings > 0 OR warnings > 0 OR layout_fallback_segments > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM t""")
def q87_drawing_report(s, d):
    """All measures of the report, with the first hundred entries of its lists."""
    out = drawing_report.drawing_report(*drawn_tables(s, d)).drop("shown_issues")
    told = {"layout_fallback_reasons": lambda x: F.concat(x["segment_id"], F.lit("="), x["reason"]), "source_bbox_overlap_pairs": lambda x: F.concat(x["first"], F.lit("+"), x["second"])}
    lists = [name for name, kind in out.dtypes if kind.startswith("array")]
    return out.withColumns({name: F.array_join(F.transform(name, told.get(name, lambda x: x.cast("string"))), ",") for name in lists})


@query()
def q88_paragraph_fit(s, d):
    """The font size at which each line of the documents fits a box of its own."""
    k = F.col("line_no")
    lines = A.doc_lines(_docs(s, d)).select("page", "line_no", "line", (120.0 + k % 5 * 60).alias("w"), (14.0 + k % 7 * 12).alias("h"), (7.0 + k % 4).alias("z"), F.when(k % 6 == 0, "heading").otherwise("paragraph").alias("kind"))
    return fitting.paragraph_fit(lines, "line", "w", "h", "z", "kind").select("page", "line_no", F.round("fit_size", 4).alias("fit_size"), "fit_leading", "fit_lines", "fits")


@query()
def q89_anchored_parts(s, d):
    """Texts over the labels and lines that they were drawn at, where identifiers stay with their own."""
    k, t = F.col("turn"), F.col("source_text")
    spots = F.array(F.concat(F.lit("Fig. "), k), F.when(F.col("conv_id") % 2 == 0, "PUMP ROOM").otherwise(F.substring(t, 1, 60)), F.concat(F.lit("No. "), k + 1))
    rows = _pairs(s, d).where("translated_text is not null").select("conv_id", "turn", F.concat("translated_text", F.lit(" Fig. "), k, F.lit(" No. "), k + 1).alias("text"), spots.alias("spots"), (F.col("conv_id") % 3 == 0).alias("crossing"))
    return visual.over_anchors(rows, "text", "spots", "crossing").select("conv_id", "turn", F.array_join("parts", "|").alias("parts"), F.array_join(F.col("kept").cast("array<string>"), "|").alias("kept"), "kept_reason")


BLANK = "trim(coalesce(translated_text, ''), ' ' || chr(9) || chr(10) || chr(13)) = ''"


@query(f"""WITH {PAIRS}, p AS (SELECT *, (conv_id + turn) % 5 = 0 OR (conv_id + turn) % 11 = 3 AS broken FROM turn_pairs), r AS (SELECT conv_id, turn, CASE WHEN translated_text IS NULL THEN 'missing' WHEN {BLANK} THEN 'empty' WHEN broken THEN 'unrestorable' END AS reason, (conv_id + turn) % 3 = 0 AS lost FROM p)
SELECT conv_id, turn, 'warning' AS severity, 'SOURCE_FALLBACK' AS code FROM r WHERE reason IS NOT NULL UNION ALL SELECT conv_id, turn, 'warning', 'ABNORMAL_LENGTH' FROM r WHERE lost AND turn % 2 = 0""")
def q90_issues_after_fallback(s, d):
    """What is left of issues once texts that are missing, empty or have lost tokens keep their source."""
    k = F.col("conv_id") + F.col("turn")
    token = lambda name, kind: F.struct(F.lit(name).alias("token"), F.lit("o").alias("original"), F.lit(kind).alias("kind"))
    held = F.array(token("T1", "url"), token("T2", "number_unit"))
    gone = F.when(k % 5 == 0, F.array(F.lit("T1"))).when(k % 7 == 0, F.array(F.lit("T2"))).otherwise(F.array().cast("array<string>"))
    none, twice = F.array().cast("array<string>"), F.when(k % 11 == 3, F.array(F.lit("T2"))).otherwise(F.array().cast("array<string>"))
    done = validation.source_fallback(_pairs(s, d), masking.restore_ok(held, gone, twice, none))
    found = done.where(k % 3 == 0).select("conv_id", "turn", F.lit("blocking").alias("severity"), F.lit("MISSING_ROW_KEY").alias("code"))
    found = found.unionByName(done.where((k % 3 == 0) & (F.col("turn") % 2 == 0)).select("conv_id", "turn", F.lit("warning").alias("severity"), F.lit("ABNORMAL_LENGTH").alias("code")))
    return validation.after_fallback(found, done, ["conv_id", "turn"])


@query("""WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || n_chars || '}') AS h FROM documents),
a AS (SELECT source, n // 8 AS k, sha256(string_agg(h, ',' ORDER BY n)) AS h FROM r GROUP BY 1, 2), b AS (SELECT source, k // 8 AS m, sha256(string_agg(h, ',' ORDER BY k)) AS h FROM a GROUP BY 1, 2)
SELECT source, sha256(string_agg(h, ',' ORDER BY m)) AS fingerprint FROM b GROUP BY 1""")
def q91_fingerprint_tree(s, d):
    """Fingerprints of sources as trees of hashes over their documents' records, eight to a node."""
    return caching.fingerprint_tree(_docs(s, d), "source", "doc_id", ["n_chars", "lang", "doc_id"], 8, 3)


@query("""WITH w AS (SELECT doc_id AS task, sha256(text) AS f, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS g, n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS bytes, n_chars FROM documents)
SELECT task, CASE WHEN task % 11 = 0 THEN 'no_report' WHEN f <> g THEN 'other_fingerprint' WHEN task % 17 = 0 THEN 'no_file' WHEN bytes <> n_chars THEN 'other_size' WHEN task % 19 = 0 THEN 'not_verified' ELSE 'valid' END AS state FROM w""")
def q92_cache_validity(s, d):
    """Which drawn documents still hold, and why the others do not."""
    docs, k = _docs(s, d), F.col("doc_id")
    path = F.format_string("out/%d.pdf", k)
    wanted = docs.select(k.alias("task"), F.sha2("text", 256).alias("fingerprint"))
    reports = docs.where(k % 11 != 0).select(k.alias("task"), F.sha2(F.when(k % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("fingerprint"), path.alias("path"), F.col("n_chars").alias("size_bytes"))
    files = docs.where(k % 17 != 0).select(path.alias("path"), (F.col("n_chars") + F.when(k % 13 == 0, 1).otherwise(0)).alias("bytes"), (k % 19 != 0).alias("verified"))
    return caching.cache_validity(wanted, reports, files)
