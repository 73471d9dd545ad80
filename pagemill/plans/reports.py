"""Further registered queries: label tests, matching, assembly, roll-ups and reports, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import assembly, layout, masking, matching, packing, quality, spatial, validation, visual
from pagemill.plans.catalog import BLANK, BOXES, LINES, PAIRS, SQ, WRAPPED, _boxes, _docs, _pairs, query
from pagemill.sources import adapters as A

CAPITALS = "[A-Z][A-Z0-9 /&+.-]*"
#: Words of a squeezed text, and whether it is a compact label.
WORDS = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split_regex({0}, '\\s+')) END"
COMPACT = f"length(t) BETWEEN 1 AND 48 AND {WORDS.format('t')} <= 8 AND NOT regexp_matches(t, '[!?;。！？；]$')"


@query(f"""WITH {WRAPPED}, l AS (SELECT page, line_no, {SQ.format("substr(line, 1 + (page + line_no) % 70)")} AS t FROM visual_lines)
SELECT page, line_no, length(t) <= 30 AND {WORDS.format('t')} <= 5 AND regexp_full_match(t, '{CAPITALS}') AS short, {COMPACT} AS compact,
 {COMPACT} AND regexp_full_match(t, '[A-Za-z ]+') AND length(replace(t, ' ', '')) <= 6 AND len(list_filter(string_split(t, ' '), lambda w: length(w) > 2)) = 0 AS fragmentary FROM l""")
def q61_label_predicates(s, d):
    """Labels among the ends of lines, which are short often enough."""
    t = F.expr("substr(line, cast(1 + (page + line_no) % 70 as int))")
    return A.visual_lines(_docs(s, d)).select("page", "line_no", T.short_label(t).alias("short"), T.compact_label(t).alias("compact"), T.fragmentary_label(t).alias("fragmentary"))


#: Lines as blocks of two columns with gaps, sizes, indents and list marks that vary.
BLOCKS = f"""{WRAPPED}, blocks AS (SELECT page % 3 AS doc, page // 3 AS page, line_no AS box_id, CASE WHEN (page + line_no) % 13 = 0 THEN '- ' ELSE '' END || line AS text, CASE WHEN line_no % 17 = 5 THEN 'heading' ELSE 'paragraph' END AS block_type, line_no % 19 = 7 AS is_table_cell,
 CASE WHEN line_no % 23 = 3 THEN 90.0 ELSE 0.0 END AS rotation, 10.0 + CASE WHEN line_no % 11 = 4 THEN 4.0 ELSE 0.0 END AS size, 40.0 + 300.0 * (line_no % 2) + CASE WHEN (line_no + page) % 9 = 0 THEN 30.0 ELSE 0.0 END AS x0, (line_no // 2) * 14.0 + ((line_no * 7) % 5) AS y0 FROM visual_lines),
 placed AS (SELECT *, y0 + 10.0 AS y1, x0 + 220.0 AS x1, line_no_col AS column_id FROM (SELECT *, CASE WHEN is_table_cell THEN -1 WHEN block_type = 'paragraph' THEN box_id % 2 + 1 ELSE 0 END AS line_no_col FROM blocks))"""


def _blocks(s, d, with_columns: bool = True):
    k, p = F.col("line_no"), F.col("page")
    lines = A.visual_lines(_docs(s, d))
    flag = lambda test, yes, no: F.when(test, F.lit(yes)).otherwise(F.lit(no))
    out = lines.select(
        (p % 3).alias("doc"), F.floor(p / 3).alias("page"), k.cast("bigint").alias("box_id"), F.concat(flag((p + k) % 13 == 0, "- ", ""), F.col("line")).alias("text"), flag(k % 17 == 5, "heading", "paragraph").alias("block_type"), (k % 19 == 7).alias("is_table_cell"),
        flag(k % 23 == 3, 90.0, 0.0).alias("rotation"), flag(k % 11 == 4, 14.0, 10.0).alias("size"), (40.0 + 300.0 * (k % 2) + flag((k + p) % 9 == 0, 30.0, 0.0)).alias("x0"), (F.floor(k / 2) * 14.0 + (k * 7) % 5).alias("y0"),
    )
    out = out.withColumns({"x1": F.col("x0") + 220.0, "y1": F.col("y0") + 10.0, "page_width": F.lit(600.0), "page_height": F.lit(800.0)})
    column = F.when(F.col("is_table_cell"), -1).when(F.col("block_type") == "paragraph", (F.col("box_id") % 2 + 1).cast("int")).otherwise(0)
    return out.withColumn("column_id", column) if with_columns else out


@query(rf"""WITH {BLOCKS}, w AS (SELECT *, block_type = 'paragraph' AND NOT is_table_cell AS free FROM placed), g AS (SELECT *, {SQ.format('text')} AS a, {SQ.format('lag(text) OVER o')} AS b, lag(block_type) OVER o AS bt, lag(rotation) OVER o AS r, lag(size) OVER o AS s, lag(x0) OVER o AS px, y0 - lag(y1) OVER o AS gap FROM w WINDOW o AS (PARTITION BY doc, page, column_id, free ORDER BY y0, x0, box_id)),
j AS (SELECT *, greatest(size, s, 1.0) AS base FROM g), m AS (SELECT *, free AND block_type = bt AND abs(rotation - r) <= 5 AND abs(size - s) <= greatest(1.5, base * 0.22) AND abs(x0 - px) <= 24.0 AND gap BETWEEN -0.4 * base AND 1.35 * base AND a <> '' AND b <> '' AND NOT regexp_matches(a, '^(?:[-•▪◦‣]|\d+[.)])\s*')
 AND ((regexp_matches(a, '^\p{{Ll}}') AND (right(b, 1) = '-' OR gap <= base)) OR (NOT regexp_matches(b, '[.!?。！？:：;；]["''”’)]?$') AND gap <= 0.65 * base)) AS joined FROM j),
n AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page, column_id, free ORDER BY y0, x0, box_id) AS run FROM m)
SELECT doc, page, box_id, first_value(box_id) OVER (PARTITION BY doc, page, column_id, free, run ORDER BY y0, x0, box_id) AS piece FROM n""")
def q62_in_column_paragraphs(s, d):
    return assembly.in_columns(_blocks(s, d)).select("doc", "page", "box_id", "piece")


@query()
def q63_assembled_paragraphs(s, d):
    """Columns, columns' runs, and what goes on across columns and pages; greedy columns: held against plain Python in tests."""
    return assembly.assemble(_blocks(s, d, False))


SMALL = f"{BOXES}, small AS (SELECT page, box_id, CASE WHEN box_id % 3 = 0 THEN 'segment' WHEN box_id % 3 = 1 THEN 'fragment' ELSE 'block' END AS kind, 't' || (box_id % 4) AS text, round(x0 / 40, 2) AS x0, round(y0 / 40, 2) AS y0, round(x1 / 40, 2) AS x1, round(y1 / 40, 2) AS y1 FROM boxes)"


@query(f"""WITH {SMALL}, d AS (SELECT l.page, l.box_id AS a, r.box_id AS b, r.kind, l.text = r.text AS same, round(abs(l.x0 - r.x0) + abs(l.y0 - r.y0) + abs(l.x1 - r.x1) + abs(l.y1 - r.y1), 4) AS distance FROM small l JOIN small r ON l.page = r.page AND l.kind = 'segment' AND r.kind <> 'segment'),
t AS (SELECT *, CASE WHEN kind = 'fragment' AND same AND distance <= 8 THEN 1 WHEN kind = 'block' AND same AND distance <= 12 THEN 2 WHEN kind = 'block' AND distance <= 4 THEN 3 END AS tier FROM d)
SELECT page, a, tier, b, distance FROM (SELECT *, row_number() OVER (PARTITION BY page, a ORDER BY tier, distance, b) AS k FROM t WHERE tier IS NOT NULL) WHERE k = 1""")
def q64_matched_fragments(s, d):
    """Segments to fragments and blocks in three tiers."""
    edge = lambda c: G.rounded(F.col(c) / 40, 2).alias(c)
    small = _boxes(s, d).select("page", "box_id", F.concat(F.lit("t"), F.col("box_id") % 4).alias("text"), *map(edge, ("x0", "y0", "x1", "y1")))
    segments, fragments, blocks = (small.where(F.col("box_id") % 3 == k) for k in range(3))
    return spatial.matched_fragments(segments, fragments, blocks)


SPANS = f"{WRAPPED}, spans AS (SELECT page, line_no // 4 AS block, line_no AS span_no, (CASE WHEN length(line) % 5 = 0 THEN 0.0 ELSE 8.0 + length(line) % 9 END)::DOUBLE AS size, CASE WHEN length(line) % 7 = 0 THEN '' ELSE 'F' || (length(line) % 3) END AS font FROM visual_lines)"


@query(f"""WITH {SPANS}, z AS (SELECT page, block, coalesce(max(nullif(size, 0)), 0.0::DOUBLE) AS largest, coalesce(median(nullif(size, 0)), 0.0::DOUBLE) AS median_size FROM spans GROUP BY 1, 2), f AS (SELECT page, block, font, count(*) AS n, min(span_no) AS first FROM spans WHERE font <> '' GROUP BY 1, 2, 3),
b AS (SELECT page, block, arg_max(font, (n, -first)) AS font FROM f GROUP BY 1, 2), p AS (SELECT page, coalesce(median(median_size) FILTER (median_size > 0), 10.0::DOUBLE) AS page_median FROM z GROUP BY 1)
SELECT page, block, largest, median_size, coalesce(font, '') AS font, page_median FROM z LEFT JOIN b USING (page, block) JOIN p USING (page)""")
def q65_font_stats(s, d):
    n = F.length("line")
    spans = A.visual_lines(_docs(s, d)).select("page", F.floor(F.col("line_no") / 4).alias("block"), F.col("line_no").alias("span_no"), F.when(n % 5 == 0, 0.0).otherwise(8.0 + n % 9).alias("size"), F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("F"), n % 3)).alias("font"))
    stats = quality.font_stats(spans)
    return stats.join(quality.page_median(stats), "page")


@query(f"""WITH {PAIRS}, s AS (SELECT conv_id, translated_text, regexp_matches(source_text, '[A-Za-z]') AND NOT regexp_matches(trim(source_text), '^[A-Z]{{1,6}}$') AS own, {BLANK} AS blank FROM turn_pairs)
SELECT conv_id, count(*) AS n_segments, count(*) FILTER (own) AS n_translatable, count(*) FILTER (own AND trim(coalesce(translated_text, '')) <> '') AS n_translated, count(*) FILTER (own AND blank) AS n_fallback, count(*) FILTER (own AND trim(coalesce(translated_text, '')) <> '' AND NOT blank) AS n_chinese FROM s GROUP BY 1""")
def q66_task_counts(s, d):
    own = validation.source_fallback(_pairs(s, d)).withColumn("should_translate", T.translatable(F.col("source_text")))
    return quality.task_counts(own, "conv_id")


@query("""WITH c AS (SELECT conv_id AS file, turn % 2 AS sheet_index, turn AS row_index, unnest(['R' || (length(text) % 60), text, (length(text) % 7)::VARCHAR]) AS cell FROM conversations),
k AS (SELECT *, CASE WHEN regexp_matches(cell, '^R?\\d{1,8}$') THEN lpad(replace(cell, 'R', ''), 8, '0') END AS row_key FROM c), e AS (SELECT lpad(doc_id::VARCHAR, 8, '0') AS row_key FROM labels WHERE doc_id IS NOT NULL)
SELECT file, sheet_index, count(DISTINCT row_key) FILTER (row_key IN (SELECT row_key FROM e)) AS distinct_keys, count(DISTINCT row_index) FILTER (row_key IN (SELECT row_key FROM e)) AS keyed_rows, count(DISTINCT row_index) FILTER (trim(coalesce(cell, '')) <> '') AS filled_rows FROM k GROUP BY 1, 2""")
def q67_sheet_scores(s, d):
    n = F.length("text")
    cells = A.table(s, d, "conversations").select(F.col("conv_id").alias("file"), (F.col("turn") % 2).alias("sheet_index"), F.col("turn").alias("row_index"), F.explode(F.array(F.concat(F.lit("R"), n % 60), F.col("text"), (n % 7).cast("string"))).alias("cell"))
    expected = A.table(s, d, "labels").select(T.row_key(F.col("doc_id").cast("string")).alias("row_key"))
    return matching.sheet_scores(cells, expected)


@query("""SELECT d.source AS doc, d.doc_id AS page, p.url, p.page_id IS NULL AS reopen FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def q68_page_lookup(s, d):
    stored = A.table(s, d, "pages").select(F.col("page_id").alias("page"), "url")
    wanted = _docs(s, d).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"))
    return matching.page_lookup(wanted, wanted.join(stored, "page"), ["url"])


@query("""WITH s AS (SELECT lang AS doc, doc_id AS page, 500.0 + n_chars % 100 AS w FROM documents), o AS (SELECT doc, page, w + CASE WHEN doc = 'en' AND page % 50 = 0 THEN 0.2 ELSE 0.05 END AS w FROM s WHERE NOT (doc = 'fr' AND page % 40 = 1))
SELECT s.doc, count(*) AS n_source, count(o.w) AS n_output, bool_and(coalesce(abs(s.w - o.w) < 0.1, false)) AS same_sizes FROM s LEFT JOIN o USING (doc, page) GROUP BY 1""")
def q69_page_sizes(s, d):
    source = _docs(s, d).select(F.col("lang").alias("doc"), F.col("doc_id").alias("page"), (500.0 + F.col("n_chars") % 100).alias("width"), F.lit(800.0).alias("height"))
    changed = F.col("width") + F.when((F.col("doc") == "en") & (F.col("page") % 50 == 0), 0.2).otherwise(0.05)
    output = source.where(~((F.col("doc") == "fr") & (F.col("page") % 40 == 1))).withColumn("width", changed)
    return quality.same_page_sizes(source, output)


@query("""WITH p AS (SELECT page_id AS page, CASE WHEN page_id % 3 = 0 THEN left(url, 12) ELSE url END AS t, page_id % 2 AS n_images FROM pages), r AS (SELECT page_id AS page, 'recognized ' || page_id AS o FROM pages WHERE page_id % 5 <> 0)
SELECT page, x AS text, length(x) AS n_chars, used AS used_ocr FROM (SELECT page, CASE WHEN length(trim(t)) < 20 AND n_images > 0 THEN coalesce(o, '') ELSE t END AS x, coalesce(length(trim(t)) < 20 AND n_images > 0 AND length(o) > 0, false) AS used FROM p LEFT JOIN r USING (page))""")
def q70_recognized_instead(s, d):
    k = F.col("page_id")
    pages = A.table(s, d, "pages")
    own = pages.select(k.alias("page"), F.when(k % 3 == 0, F.left("url", F.lit(12))).otherwise(F.col("url")).alias("text"), (k % 2).alias("n_images"))
    return matching.recognized_instead(own, pages.where(k % 5 != 0).select(k.alias("page"), F.concat(F.lit("recognized "), k).alias("text")))


@query("""WITH i AS (SELECT source AS task, sha256(text) AS row_key, doc_id FROM documents), p AS (SELECT DISTINCT source AS task FROM documents WHERE source LIKE '%1%'), e AS (SELECT task, row_key FROM i WHERE doc_id % 2 = 0 AND task NOT IN (SELECT task FROM p)),
n AS (SELECT task, row_key, row_number() OVER (PARTITION BY task ORDER BY row_key) AS k FROM e)
SELECT task, 'blocking' AS severity, 'DUPLICATE_ROW_KEY' AS code, row_key FROM i GROUP BY task, row_key HAVING count(*) > 1 UNION ALL SELECT task, 'warning', 'POSITIONAL_MATCH', NULL FROM p
UNION ALL SELECT task, 'blocking', 'MISSING_ROW_KEY', row_key FROM n WHERE k <= 20 UNION ALL SELECT task, 'blocking', 'MISSING_ROW_KEY_SUMMARY', NULL FROM n GROUP BY task HAVING count(*) > 20""")
def q71_import_issues(s, d):
    """Issues of tasks: repeated keys, tasks matched by position, and missing keys, of which twenty are listed."""
    rows = _docs(s, d).select(F.col("source").alias("task"), F.sha2("text", 256).alias("row_key"), "doc_id")
    return matching.import_issues(rows, rows.where("task like '%1%'"), rows.where("doc_id % 2 = 0"), "task", "row_key", 20)


OCR = f"""{WRAPPED}, o AS (SELECT page, line_no, CASE WHEN line_no % 29 = 0 THEN (100 + line_no)::VARCHAR WHEN line_no % 11 = 3 THEN translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE line END AS text, 0.5::DOUBLE + (line_no % 5) * 0.1::DOUBLE AS confidence, 40.0::DOUBLE + CASE WHEN line_no % 9 = 4 THEN 60.0 ELSE line_no % 3 END AS x0, line_no * 15.0::DOUBLE + CASE WHEN line_no % 13 = 6 THEN 25.0 ELSE 0.0 END AS y0,
 (CASE WHEN line_no % 31 = 9 THEN 6.0 ELSE 300.0 END)::DOUBLE AS w, (CASE WHEN line_no % 17 = 2 THEN 30.0 ELSE 10.0 + line_no % 3 END)::DOUBLE AS h FROM visual_lines WHERE line <> '')"""


@query(rf"""WITH {OCR}, u AS (SELECT *, x0 + w AS x1, y0 + h AS y1, w < 1.2 * h AS upright, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= 3 AND length(text) <= 90 AND length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) >= length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) * 0.9 AS heading FROM o),
g AS (SELECT *, lag(x0) OVER v AS px, lag(y0) OVER v AS py0, lag(y1) OVER v AS py1, lag(h) OVER v AS ph, lag(heading) OVER v AS hd, lag(upright) OVER v AS up FROM u WINDOW v AS (PARTITION BY page ORDER BY upright, line_no)),
n AS (SELECT *, CAST(sum(CASE WHEN NOT upright AND abs(x0 - px) <= 39.0 AND y0 >= py0 - 1 AND y0 - py1 <= 1.8 * greatest(h, ph) AND greatest(h, ph) / greatest(least(h, ph), 0.1) < 1.55 AND heading = hd THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY upright, line_no) AS BIGINT) AS block FROM g),
b AS (SELECT page, block, string_agg(text, ' ' ORDER BY line_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, avg(h) AS h, round(avg(confidence), 3) AS confidence, bool_or(upright) AS upright FROM n GROUP BY 1, 2), m AS (SELECT page, median(h) AS typical FROM u WHERE NOT upright GROUP BY 1)
SELECT page, block, text, x0, y0, x1, y1, round(greatest(7.5, h * 0.9), 2) AS font_size, confidence, CASE WHEN regexp_full_match(text, '\d{{1,5}}') THEN 'page_number' WHEN h >= 2.1 * coalesce(typical, 8.0) AND length(text) <= 100 THEN 'title' WHEN length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) / greatest(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 1) > 0.72 AND length(text) <= 120 THEN 'heading' WHEN upright THEN 'other' ELSE 'paragraph' END AS block_type FROM b LEFT JOIN m USING (page)""")
def q72_grouped_ocr_lines(s, d):
    """Recognized lines as blocks, with sizes, types and confidences."""
    k = F.col("line_no")
    flag = lambda test, yes, no: F.when(test, yes).otherwise(no)
    lines = A.visual_lines(_docs(s, d)).where("line <> ''").select(
        "page", "line_no", F.when(k % 29 == 0, (k + 100).cast("string")).when(k % 11 == 3, F.translate("line", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.col("line")).alias("text"), (0.5 + k % 5 * 0.1).alias("confidence"), F.lit(600.0).alias("page_width"), (40.0 + flag(k % 9 == 4, F.lit(60.0), k % 3)).alias("x0"), (k * 15.0 + flag(k % 13 == 6, 25.0, 0.0)).alias("y0"),
        flag(k % 31 == 9, 6.0, 300.0).alias("w"), flag(k % 17 == 2, F.lit(30.0), 10.0 + k % 3).alias("h"),
    )
    return layout.group_ocr_lines(lines.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("h")}).drop("w", "h"))


@query(f"""WITH {WRAPPED}, l AS (SELECT page AS block, line_no, line, CASE page % 4 WHEN 0 THEN 0.0 WHEN 1 THEN -90.0 WHEN 2 THEN (line_no % 2) * 7.0 ELSE (line_no % 2) * 3.0 END AS rotation FROM visual_lines), w AS (SELECT block, rotation, sum(greatest(length(line), 1)) AS weight FROM l GROUP BY 1, 2),
m AS (SELECT block, arg_max(rotation, (weight, -rotation)) AS main FROM w GROUP BY 1), t AS (SELECT block, max(greatest(abs(rotation - main), abs(main))) >= 5 AS turned FROM l JOIN m USING (block) GROUP BY 1)
SELECT block, line_no, CASE WHEN turned THEN row_number() OVER (PARTITION BY block ORDER BY line_no) ELSE 1 END AS fragment FROM l JOIN t USING (block)""")
def q73_rotated_lines(s, d):
    p, k = F.col("page") % 4, F.col("line_no") % 2
    turn = F.when(p == 0, 0.0).when(p == 1, -90.0).when(p == 2, k * 7.0).otherwise(k * 3.0)
    return layout.rotated_lines(A.visual_lines(_docs(s, d)).select(F.col("page").alias("block"), "line_no", "line", turn.cast("double").alias("rotation"))).select("block", "line_no", "fragment")


@query(f"""WITH {BOXES}, k AS (SELECT page, box_id, y1 - y0 AS h, CASE box_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'heading' ELSE 'paragraph' END AS kind, (box_id % 90)::DOUBLE AS f FROM boxes), x AS (SELECT *, greatest(0.9, least(3.0, h * 0.2)) AS plain FROM k)
SELECT page, box_id, round(CASE WHEN kind = 'title' THEN greatest(plain, least(10.0, greatest(h * 0.08, f * 0.1))) ELSE plain END, 6) AS pad_x, round(CASE kind WHEN 'title' THEN greatest(3.0, least(14.0, h * 0.58)) WHEN 'heading' THEN greatest(1.5, least(5.0, h * 0.34)) ELSE plain END, 6) AS pad_y,
 CAST(greatest(1, round_even(greatest(1.0, 200 / 120.0, least(8.0, greatest(0.75, f * 0.08)) * 1.5), 0)) AS INT) AS margin FROM x""")
def q74_erase_padding(s, d):
    k = F.col("box_id")
    kind = F.when(k % 3 == 0, "title").when(k % 3 == 1, "heading").otherwise("paragraph")
    size = (k % 90).cast("double")
    own = _boxes(s, d).withColumn("pad", G.erase_padding(kind, F.col("y1") - F.col("y0"), size))
    return own.select("page", "box_id", F.round("pad.x", 6).alias("pad_x"), F.round("pad.y", 6).alias("pad_y"), G.growth_margin(size, F.lit(1.5), F.lit(200)).alias("margin"))


AUDIT = """a AS (SELECT page_id AS page, length(html) AS pixels, length(html) // 3 AS changed, length(html) // (3 + page_id % 900) AS outside, page_id % 45 AS n_pairs, (page_id % 10) / 10.0 AS max_ratio FROM pages),
 r AS (SELECT page, round(outside / greatest(pixels, 1), 6) AS outside_ratio, round(outside / greatest(changed, 1), 6) AS outside_share, n_pairs, round(max_ratio, 4)::DOUBLE AS max_ratio, round(outside / greatest(pixels, 1) * 10000 + outside / greatest(changed, 1) * 10 + least(n_pairs, 30) * 0.25::DOUBLE + max_ratio, 4) AS risk_score FROM a)"""


def _audited(s, d):
    k, n = F.col("page_id"), F.length("html").cast("bigint")
    pages = A.table(s, d, "pages").select(k.alias("page"), n.alias("pixels"), F.floor(n / 3).alias("changed"), F.floor(n / (k % 900 + 3)).alias("outside"), (k % 45).alias("n_pairs"), ((k % 10) / 10.0).alias("max_ratio"))
    return quality.audit_risk(pages)


@query(f"WITH {AUDIT} SELECT * FROM r")
def q75_audit_risk(s, d):
    return _audited(s, d)


@query(f"WITH {AUDIT} SELECT count(*) AS pages_checked, count(*) FILTER (outside_ratio > 0.001) AS pages_changed_outside, count(*) FILTER (n_pairs > 0) AS pages_with_overlaps, coalesce(max(outside_ratio), 0.0) AS largest_outside_ratio FROM r")
def q76_audit_report(s, d):
    return quality.audit_report(_audited(s, d))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'number_unit' WHEN 1 THEN 'file_path' WHEN 2 THEN 'file_path' ELSE 'url' END AS kind, CASE page_id % 4 WHEN 1 THEN '/2/3' ELSE url END AS original, page_id % 5 <> 0 AS lost FROM pages WHERE url IS NOT NULL),
a AS (SELECT *, lost AND (kind = 'number_unit' OR (kind = 'file_path' AND NOT regexp_matches(original, '\\p{L}'))) AS allowed FROM p) SELECT page_id, 'warning' AS severity, 'PLACEHOLDER_CHANGED_ALLOWED' AS code FROM a WHERE allowed UNION ALL SELECT page_id, 'blocking', 'MISSING_PLACEHOLDER' FROM a WHERE lost AND NOT allowed""")
def q77_token_issues(s, d):
    """Lost tokens: which may be lost, and which block."""
    k = F.col("page_id")
    held = F.array(F.struct(F.lit("T").alias("token"), F.when(k % 4 == 1, "/2/3").otherwise(F.col("url")).alias("original"), F.when(k % 4 == 0, "number_unit").when(k % 4 == 3, "url").otherwise("file_path").alias("kind")))
    lost = F.when(k % 5 != 0, F.array(F.lit("T"))).otherwise(F.array().cast("array<string>"))
    rows = A.table(s, d, "pages").where("url is not null").select("page_id", held.alias("held"), lost.alias("lost"), F.lit("一二三四五六七八九十").alias("translated_text"), F.lit("ten signs!").alias("source_text"))
    return validation.issues(rows.withColumns({"missing": masking.blocking_missing(F.col("held"), F.col("lost")), "allowed": masking.allowed_missing(F.col("held"), F.col("lost"))}), ["page_id"])


@query(r"""WITH l AS (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents), o AS (SELECT doc_id, list_filter(list_transform(list_concat(l, [CASE WHEN doc_id % 3 = 0 THEN ' 。) ' ELSE ' ' END]), lambda x: trim(x)), lambda x: x <> '') AS x FROM l)
SELECT doc_id, len(x) >= 2 AND regexp_full_match(x[len(x)], '[)\]}>）】》」』〕〉.,，。！？!?；;：:、]+') AS orphan, CASE WHEN doc_id % 50 + 1 = 1 AND 20 = doc_id % 30 THEN '全部 20 页' WHEN doc_id % 30 < doc_id % 50 + 1 THEN '未选择页面' ELSE '第 ' || (doc_id % 50 + 1) || '–' || (doc_id % 30) || ' 页，共 ' || (doc_id % 30 - doc_id % 50) || ' 页' END AS label FROM o""")
def q78_orphans_and_ranges(s, d):
    """Lines of closing punctuation alone, and labels of page ranges."""
    k = F.col("doc_id")
    lines = F.concat(F.split("text", "\n"), F.array(F.when(k % 3 == 0, " 。) ").otherwise(" ")))
    return _docs(s, d).select("doc_id", T.orphan_punctuation(lines).alias("orphan"), T.range_label(k % 50 + 1, k % 30, F.lit(20)).alias("label"))


@query()
def q79_partitioned_texts(s, d):
    """A reply over its question's sentences by identifiers and shares; a search over cuts: held against all partitions in tests."""
    pairs = _pairs(s, d).where("translated_text is not null").withColumn("sources", F.split("source_text", r"(?<=\.)\s+"))
    return visual.split_over_anchors(pairs, "translated_text", "sources", how=visual.parts_of).select("conv_id", "turn", F.size("sources").alias("n_sources"), F.to_json("parts").alias("parts"))


@query(f"""WITH {LINES} SELECT page, line_no, {SQ.format('line')} AS text, CASE WHEN {SQ.format('line')} = '' THEN 0 ELSE len(string_split_regex({SQ.format('line')}, '\\s+')) END AS n_words FROM doc_lines""")
def q80_squeezed_lines(s, d):
    """Lines in their comparable form. (Plain forms of compatible signs are tested on their own: SQL has no such form.)"""
    return A.doc_lines(_docs(s, d)).select("page", "line_no", T.squeeze(F.col("line")).alias("text"), T.word_count(F.col("line")).alias("n_words"))


@query("""WITH RECURSIVE o AS (SELECT lang, doc_id, n_chars, octet_length(encode(text)) + 64 AS b, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT lang, doc_id, n_chars, b, rn, 1::BIGINT AS p, n_chars AS held, 1::BIGINT AS k FROM o WHERE rn = 1 UNION ALL
 SELECT o.lang, o.doc_id, o.n_chars, o.b, o.rn, CASE WHEN f.held + o.n_chars > 400000 OR f.k >= 60 THEN f.p + 1 ELSE f.p END, CASE WHEN f.held + o.n_chars > 400000 OR f.k >= 60 THEN o.n_chars ELSE f.held + o.n_chars END, CASE WHEN f.held + o.n_chars > 400000 OR f.k >= 60 THEN 1 ELSE f.k + 1 END FROM f JOIN o ON o.lang = f.lang AND o.rn = f.rn + 1),
g AS (SELECT lang, doc_id, b, rn, p, 1::BIGINT AS q, b AS held FROM f WHERE rn = 1 UNION ALL
 SELECT f.lang, f.doc_id, f.b, f.rn, f.p, CASE WHEN f.p <> g.p OR g.held + f.b > 250000 THEN g.q + 1 ELSE g.q END, CASE WHEN f.p <> g.p OR g.held + f.b > 250000 THEN f.b ELSE g.held + f.b END FROM g JOIN f ON f.lang = g.lang AND f.rn = g.rn + 1)
SELECT lang, doc_id, q AS package_index FROM g""")
def q81_byte_bounded_packages(s, d):
    """Packages bounded by signs and rows, then by bytes."""
    rows = _docs(s, d).withColumn("row_bytes", packing.checked_bytes("text", "doc_id", 250_000))
    return packing.next_fit(rows, "lang", "doc_id", "n_chars", 400_000, 60, "row_bytes", 250_000).select("lang", "doc_id", "package_index")


#: Returned tables: a conversation is a file and the keys of its turns a package. In every third all keys are changed; of
#: those, every second says by its name alone which package it is. Some claim a foreign package, some none at all.
RETURNED = """r AS (SELECT conv_id, turn, conv_id * 100 + turn AS num, text FROM conversations),
 kind AS (SELECT conv_id, CASE WHEN conv_id % 11 = 4 THEN 'foreign' WHEN conv_id % 11 = 5 THEN 'none' WHEN conv_id % 2 = 0 AND conv_id < 1000 THEN 'named' ELSE 'claimed' END AS kind,
  'f' || conv_id || CASE WHEN conv_id % 2 = 0 AND conv_id < 1000 THEN '_' || lpad(conv_id::VARCHAR, 3, '0') || '_of_999.xlsx' WHEN conv_id % 11 = 5 THEN '_copy.xlsx' ELSE '.xlsx' END AS file FROM (SELECT DISTINCT conv_id FROM conversations)),
 kinds AS (SELECT conv_id, file, CASE WHEN kind = 'none' AND conv_id % 2 = 0 AND conv_id < 1000 THEN 'named' ELSE kind END AS kind FROM kind),
 c AS (SELECT r.conv_id, turn AS row_index, CASE WHEN r.conv_id % 3 = 0 THEN 'x' || turn WHEN r.conv_id % 5 = 1 AND turn = 1 THEN 'R' || (r.conv_id * 100) WHEN r.conv_id % 7 = 2 AND turn % 2 = 1 THEN 'lost' ELSE 'R' || num END AS k, text FROM r),
 e AS (SELECT conv_id, lpad(num::VARCHAR, 8, '0') AS row_key, turn AS position FROM r), n_all AS (SELECT count(DISTINCT row_key) AS n FROM e),
 f AS (SELECT c.conv_id, kinds.kind, kinds.file, e.row_key, c.row_index, c.text FROM c JOIN kinds USING (conv_id) JOIN e ON kinds.kind <> 'foreign' AND (kinds.kind = 'none' OR e.conv_id = c.conv_id) AND e.row_key = lpad(replace(c.k, 'R', ''), 8, '0')),
 n AS (SELECT conv_id, count(*) AS exact, count(DISTINCT row_key) AS known FROM f GROUP BY 1),
 w AS (SELECT kinds.*, coalesce(exact, 0) AS exact, coalesce(known, 0) AS known, CASE WHEN kind = 'none' THEN (SELECT n FROM n_all) ELSE (SELECT count(*) FROM e WHERE e.conv_id = kinds.conv_id) END AS wanted FROM kinds LEFT JOIN n USING (conv_id) WHERE kind <> 'foreign'),
 moved AS (SELECT conv_id, file FROM w WHERE kind = 'claimed' AND known < wanted AND exact * 2 < wanted),
 lacking AS (SELECT * FROM w WHERE known < wanted AND conv_id NOT IN (SELECT conv_id FROM moved) AND (known > 0 OR kind <> 'none'))"""


def _imported(s, d):
    conv = A.table(s, d, "conversations")
    k, c = F.col("turn"), F.col("conv_id")
    named = (c % 2 == 0) & (c < 1000)
    key = F.when(c % 3 == 0, F.concat(F.lit("x"), k)).when((c % 5 == 1) & (k == 1), F.concat(F.lit("R"), c * 100)).when((c % 7 == 2) & (k % 2 == 1), "lost").otherwise(F.concat(F.lit("R"), c * 100 + k))
    file = F.when(named, F.format_string("f%d_%03d_of_999.xlsx", c, c)).when(c % 11 == 5, F.format_string("f%d_copy.xlsx", c)).otherwise(F.format_string("f%d.xlsx", c))
    subject = F.when(c % 11 == 4, "PKG-of another").when(named | (c % 11 == 5), "a note").otherwise(F.format_string("PKG-%d", c))
    cells = conv.select(file.alias("file"), subject.alias("subject"), F.lit(0).alias("sheet_index"), F.lit("visible").alias("sheet_state"), k.alias("row_index"), F.array(key, F.lit(None).cast("string"), F.col("text")).alias("cells"))
    expected = conv.select(F.format_string("PKG-%d", c).alias("package_id"), c.cast("bigint").alias("package_index"), T.row_key((c * 100 + k).cast("string")).alias("row_key"), k.alias("position"))
    return cells, expected


@query(f"""WITH {RETURNED}, first AS (SELECT l.file, e.row_key, row_number() OVER (PARTITION BY l.file ORDER BY e.conv_id, e.position, e.row_key) AS k FROM lacking l JOIN e ON l.kind = 'none' OR e.conv_id = l.conv_id WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.conv_id = l.conv_id AND f.row_key = e.row_key))
SELECT file, 'blocking' AS severity, 'WRONG_PACKAGE' AS code, NULL AS row_key FROM kinds WHERE kind = 'foreign' UNION ALL SELECT file, 'blocking', 'UNKNOWN_PACKAGE', NULL FROM w WHERE kind = 'none' AND known = 0
UNION ALL SELECT file, 'blocking', 'DUPLICATE_ROW_KEY', row_key FROM f GROUP BY file, row_key HAVING count(*) > 1 UNION ALL SELECT file, 'warning', 'POSITIONAL_MATCH', NULL FROM moved
UNION ALL SELECT file, 'blocking', 'MISSING_ROW_KEY', row_key FROM first WHERE k <= 100 UNION ALL SELECT file, 'blocking', 'MISSING_ROW_KEY_SUMMARY', NULL FROM lacking WHERE wanted - known > 100""")
def q82_import_file_issues(s, d):
    """Foreign, unknown and moved files, repeated and missing keys."""
    return matching.import_cells(*_imported(s, d))[1]


@query(f"""WITH {RETURNED}, o AS (SELECT file, row_key, arg_min(text, row_index) AS text, 'key' AS match FROM f WHERE conv_id NOT IN (SELECT conv_id FROM moved) GROUP BY 1, 2
 UNION ALL SELECT moved.file, e.row_key, r.text, 'position' FROM moved JOIN e USING (conv_id) JOIN r ON r.conv_id = e.conv_id AND r.turn = e.position)
SELECT row_key, trim(coalesce(arg_max(text, file), '')) AS translated_text, max(file) AS file, arg_max(match, file) AS match FROM o GROUP BY 1""")
def q83_imported_texts(s, d):
    """Texts by key or position; of files with the same key the last one wins."""
    return matching.import_cells(*_imported(s, d))[0]
