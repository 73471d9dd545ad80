"""Every registered query of the document operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import layout, masking, matching, packing, quality, spatial, store, validation, visual
from pagemill.sources import adapters as A
from pagemill.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "q01_repeated_marginals"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: SQL of the adapters.
LINES = r"""doc_lines AS (SELECT source AS doc, doc_id AS page, generate_subscripts(l, 1) - 1 AS line_no, trim(regexp_replace(unnest(l), '[ \t\r\f\v]+', ' ', 'g')) AS line
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents))"""
WRAPPED = r"""visual_lines AS (SELECT page, generate_subscripts(l, 1) - 1 AS line_no, rtrim(regexp_replace(unnest(l), '\n$', '')) AS line
  FROM (SELECT doc_id AS page, regexp_extract_all(text, '([^\n]{1,80}(?: |\n|$))', 1) AS l FROM documents))"""
PAIRS = """turn_pairs AS (SELECT u.conv_id, u.turn, u.text AS source_text, a.text AS translated_text FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""
BOXES = """boxes AS (SELECT label AS page, vec_id AS box_id, round(least(embedding[1]::DOUBLE, embedding[3]::DOUBLE) * 500 + 250, 2) AS x0, round(least(embedding[2]::DOUBLE, embedding[4]::DOUBLE) * 500 + 250, 2) AS y0,
  round(greatest(embedding[1]::DOUBLE, embedding[3]::DOUBLE) * 500 + 250, 2) AS x1, round(greatest(embedding[2]::DOUBLE, embedding[4]::DOUBLE) * 500 + 250, 2) AS y1 FROM embeddings)"""
MARGINALS = """marginals AS (SELECT c.doc, c.text, c.n FROM (SELECT doc, lower(upper(line)) AS text, count(*) AS n FROM doc_lines WHERE line <> '' AND length(line) <= 200 GROUP BY 1, 2) c
  JOIN (SELECT doc, count(DISTINCT page) AS pages FROM doc_lines GROUP BY 1) p USING (doc) WHERE c.n >= greatest(2, CAST(ceil(CAST(0.35 AS DOUBLE) * pages) AS BIGINT)))"""
#: Whether b goes on with a, both squeezed.
SQ = r"trim(regexp_replace(replace({0}, chr(173), ''), '[ \t\r\f\v]+', ' ', 'g'), chr(10) || ' ')"
CONTINUES = r"""(b <> '' AND a <> '' AND NOT (length(b) <= 30 AND len(string_split(b, ' ')) <= 5 AND regexp_full_match(b, '[A-Z][A-Z0-9 /&+.-]*')) AND ((right(b, 1) = '-' AND regexp_matches(a, '^\p{Ll}')) OR least(length(a), length(b)) >= 8)
  AND (regexp_matches(a, '^\p{Ll}') OR NOT regexp_matches(b, '[.!?。！？]["''”’)]?$')))"""
TAGGED = f"tagged AS (SELECT page, line_no, line, {SQ.format('line')} AS a, {SQ.format('lag(line) OVER (PARTITION BY page ORDER BY line_no)')} AS b FROM visual_lines)"
PARAGRAPHS = rf"""{WRAPPED}, {TAGGED},
  merged AS (SELECT page, line_no, line, sum(CASE WHEN {CONTINUES} THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY line_no) AS paragraph FROM tagged),
  paragraphs AS (SELECT page, CAST(paragraph AS BIGINT) AS paragraph, replace(regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '-\n(\p{{Ll}})', '\1', 'g'), chr(10), ' ') AS text, count(*) AS n_lines FROM merged GROUP BY 1, 2)"""


def _docs(s, d):
    return A.table(s, d, "documents")


@query(f"WITH {LINES}, {MARGINALS} SELECT doc, text, n FROM marginals")
def q01_repeated_marginals(s, d):
    return layout.repeated_marginals(A.doc_lines(_docs(s, d)))


@query(f"""WITH {LINES}, {MARGINALS}, sized AS (SELECT *, count(*) OVER (PARTITION BY page) AS page_lines FROM doc_lines)
SELECT l.doc, l.page, l.line_no, CASE WHEN m.text IS NULL THEN 'body' WHEN l.line_no * 2 < l.page_lines THEN 'header' ELSE 'footer' END AS role FROM sized l LEFT JOIN marginals m ON m.doc = l.doc AND m.text = lower(upper(l.line))""")
def q02_relabelled_lines(s, d):
    lines = A.doc_lines(_docs(s, d))
    return layout.relabel_marginals(lines, layout.repeated_marginals(lines)).drop("line")


@query(rf"""WITH {WRAPPED}, {TAGGED}
SELECT page, line_no, CAST(sum(CASE WHEN {CONTINUES} THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY line_no) AS BIGINT) AS paragraph FROM tagged""")
def q03_line_islands(s, d):
    return layout.merge_lines(A.visual_lines(_docs(s, d))).select("page", "line_no", "paragraph")


def _paragraphs(s, d):
    return layout.paragraphs(layout.merge_lines(A.visual_lines(_docs(s, d))))


@query(f"WITH {PARAGRAPHS} SELECT * FROM paragraphs")
def q04_merged_paragraphs(s, d):
    return _paragraphs(s, d)


SEGMENTS = PARAGRAPHS + """, ordered AS (SELECT page, paragraph, text, row_number() OVER (PARTITION BY page ORDER BY paragraph) AS reading_order, regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(trim(text), '^[A-Z]{1,6}$') AS should_translate FROM paragraphs),
  segments AS (SELECT *, 'P' || lpad(page::VARCHAR, greatest(4, length(page::VARCHAR))::INT, '0') || '-S' || lpad(reading_order::VARCHAR, 6, '0') AS segment_id, CASE WHEN should_translate THEN lpad(CAST(sum(should_translate::INT) OVER (ORDER BY page, paragraph) AS BIGINT)::VARCHAR, 8, '0') ELSE '' END AS row_key FROM ordered)"""


@query(f"WITH {SEGMENTS} SELECT segment_id, row_key, reading_order, should_translate FROM segments")
def q05_segment_ids_keys(s, d):
    return layout.segments(_paragraphs(s, d)).select("segment_id", "row_key", "reading_order", "should_translate")


@query(rf"""WITH {LINES}, f AS (SELECT page, line_no, line AS t, line_no % 7 AS o, CASE (page + line_no) % 5 WHEN 0 THEN 20.0 WHEN 1 THEN 12.5 WHEN 2 THEN 8.0 ELSE 10.0 END AS size, (line_no % 100) / 100.0 AS top, least(1.0, (line_no % 100) / 100.0 + 0.02) AS bottom FROM doc_lines), g AS (SELECT page, median(size) AS m FROM f GROUP BY 1)
SELECT page, line_no, CASE WHEN regexp_matches(t, '(?i)^(page\s*)?\d+(\s*/\s*\d+)?$') AND (top < 0.08 OR bottom > 0.92) THEN 'page_number' WHEN regexp_matches(t, '(?i)^(figure|fig\.|table)\s+\d+') THEN 'caption'
 WHEN page = 1 AND o <= 3 AND size >= greatest(16.0, m * 1.55) THEN 'title' WHEN length(t) <= 180 AND size >= greatest(12.0, m * 1.25) THEN 'heading' WHEN top < 0.035 THEN 'header' WHEN bottom > 0.965 THEN 'footer' WHEN bottom > 0.82 AND size < m * 0.9 THEN 'footnote' ELSE 'paragraph' END AS block_type
FROM f JOIN g USING (page)""")
def q06_block_classes(s, d):
    """All lines of all documents as blocks, each against its page's median size."""
    k = F.col("line_no")
    size = F.element_at(F.array(*[F.lit(x) for x in (20.0, 12.5, 8.0, 10.0, 10.0)]), ((F.col("page") + k) % 5 + 1).cast("int"))
    top = (k % 100) / 100.0  # not rounded: 0.8 + 0.02 is above 0.82
    blocks = A.doc_lines(_docs(s, d)).withColumns({"size": size, "top": top, "bottom": F.least(F.lit(1.0), top + 0.02)})
    medians = blocks.groupBy("page").agg(F.median("size").alias("m"))
    kind = layout.classify(F.col("line"), F.col("size"), F.col("size"), F.col("m"), F.col("top"), F.col("bottom"), F.col("page"), k % 7)
    return blocks.join(medians, "page").select("page", "line_no", kind.alias("block_type"))


@query(f"""WITH {BOXES}, r AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes),
c AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach + 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, x1, box_id) AS cell FROM r) SELECT page, CAST(cell AS BIGINT) AS cell, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM c GROUP BY 1, 2""")
def q07_interval_islands(s, d):
    return layout.interval_islands(A.boxes(A.table(s, d, "embeddings")))


@query(r"""SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest([{'kind': 'code', 'n': len(regexp_extract_all(t, '```[\s\S]*?```|`[^`\n]+`'))}, {'kind': 'url', 'n': len(regexp_extract_all(t, '(?i)\b(?:https?://|www\.)[^\s<>{}\[\]]+'))},
 {'kind': 'email', 'n': len(regexp_extract_all(t, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'))}, {'kind': 'doi', 'n': len(regexp_extract_all(t, '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b'))}, {'kind': 'citation', 'n': len(regexp_extract_all(t, '\[(?:\s*\d+(?:\s*[-–]\s*\d+)?\s*,?)+\]|\((?:19|20)\d{2}[a-z]?\)'))}], recursive := true) FROM (SELECT text AS t FROM documents UNION ALL SELECT url FROM pages UNION ALL SELECT html FROM pages)) GROUP BY kind""")
def q08_mask_counts(s, d):
    pages = A.table(s, d, "pages")
    texts = _docs(s, d).select(F.col("text").alias("t")).unionAll(pages.select("url")).unionAll(pages.select("html"))
    return masking.kind_counts(texts, "t", ("code", "url", "email", "doi", "citation"))


@query()
def q09_mask_tokens(s, d):
    """Masks and tokens of all kinds; patterns with lookaround, which SQL lacks: held against plain Python in tests."""
    done = masking.protect(_docs(s, d).select("doc_id", "text"), "task", "doc_id", "text")
    return done.select("doc_id", F.sha2("protected_text", 256).alias("protected_sha256"), F.size("placeholders").cast("bigint").alias("n_masks"))


NUMBERS = r"list_sort(list_transform(regexp_extract_all({0}, '(\d+(?:[.,]\d+)?)', 1), lambda x: replace(x, ',', '.')))"


@query(f"SELECT doc_id, array_to_string({NUMBERS.format('text')}, ' ') AS numbers, len({NUMBERS.format('text')}) AS n_numbers FROM documents")
def q10_numbers_multiset(s, d):
    own = T.numbers(F.col("text"))
    return _docs(s, d).select("doc_id", F.array_join(own, " ").alias("numbers"), F.size(own).cast("bigint").alias("n_numbers"))


TEXT = "coalesce(translated_text, '')"
BLANK = "regexp_matches(coalesce(translated_text, ''), '^\\s*$')"
SQUEEZED = r"lower(upper(trim(regexp_replace({0}, '[ \t\r\f\v]+', ' ', 'g'), chr(10) || ' ')))"
ISSUES = rf"""{PAIRS}, tested AS (SELECT *, {TEXT} AS t, length(trim({TEXT}, chr(10) || ' ')) / greatest(length(trim(source_text, chr(10) || ' ')), 1) AS ratio, length(regexp_replace({TEXT}, '[^\p{{L}}]', '', 'g')) AS letters FROM turn_pairs),
 issues AS (SELECT conv_id, turn, 'blocking' AS severity, 'EMPTY_TRANSLATION' AS code FROM tested WHERE {BLANK}
 UNION ALL SELECT conv_id, turn, 'warning', 'UNCHANGED_TEXT' FROM tested WHERE NOT {BLANK} AND {SQUEEZED.format('t')} = {SQUEEZED.format('source_text')}
 UNION ALL SELECT conv_id, turn, 'warning', 'ABNORMAL_LENGTH' FROM tested WHERE NOT {BLANK} AND (ratio > 4.0 OR ratio < 0.08)
 UNION ALL SELECT conv_id, turn, 'warning', 'LOW_CHINESE_RATIO' FROM tested WHERE NOT {BLANK} AND length(trim(source_text, chr(10) || ' ')) >= 30 AND (letters = 0 OR length(regexp_replace(t, '[^㐀-鿿]', '', 'g')) / letters < 0.08)
 UNION ALL SELECT conv_id, turn, 'warning', 'NUMBER_CHANGED' FROM tested WHERE NOT {BLANK} AND {NUMBERS.format('t')} <> {NUMBERS.format('source_text')})"""


def _pairs(s, d):
    return A.turn_pairs(A.table(s, d, "conversations"))


@query(f"WITH {ISSUES} SELECT * FROM issues")
def q11_validation_issues(s, d):
    return validation.issues(_pairs(s, d), ["conv_id", "turn"])


@query(f"""WITH {ISSUES}, t AS (SELECT conv_id, count(*) AS total_segments, count(*) FILTER (NOT {BLANK}) AS translated_segments FROM turn_pairs GROUP BY 1),
b AS (SELECT conv_id, count(*) FILTER (severity = 'blocking') AS blocking_errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues GROUP BY 1)
SELECT conv_id, total_segments, translated_segments, coalesce(blocking_errors, 0) AS blocking_errors, coalesce(warnings, 0) AS warnings, coalesce(blocking_errors, 0) = 0 AND translated_segments = total_segments AS can_generate FROM t LEFT JOIN b USING (conv_id)""")
def q12_validation_report(s, d):
    pairs = _pairs(s, d)
    return validation.report(pairs, validation.issues(pairs, ["conv_id", "turn"]), "conv_id")


@query("""WITH lost AS (SELECT source AS task, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY doc_id) AS k FROM lost)
SELECT task, 'MISSING_ROW_KEY' AS code, doc_id::VARCHAR AS row_key, CAST(1 AS BIGINT) AS n FROM r WHERE k <= 10 UNION ALL SELECT task, 'MISSING_ROW_KEY_SUMMARY', NULL, count(*) - 10 FROM lost GROUP BY 1 HAVING count(*) > 10""")
def q13_missing_rows(s, d):
    lost = matching.missing(_docs(s, d).select(F.col("source").alias("task"), "doc_id"), A.table(s, d, "labels"), "doc_id")
    return matching.missing_report(lost, "task", "doc_id", 10)


@query("""WITH k AS (SELECT sha256(text) AS row_key, doc_id, source FROM documents) SELECT row_key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS n, count(*) > 1 AS repeated FROM k GROUP BY 1""")
def q14_duplicate_keys_first_wins(s, d):
    rows = _docs(s, d).select(F.sha2("text", 256).alias("row_key"), "doc_id", "source")
    first = matching.first_wins(rows, "row_key", "doc_id")
    return first.join(rows.groupBy("row_key").agg(F.count("*").alias("n")), "row_key").withColumn("repeated", F.col("n") > 1)


@query("""WITH seg AS (SELECT conv_id, turn, 'K' || turn AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'user'),
imp AS (SELECT conv_id, turn AS row_index, CASE WHEN conv_id % 2 = 0 THEN 'changed-' || turn ELSE 'K' || (turn - 1) END AS k, text AS translated_text FROM conversations WHERE role = 'assistant'),
rows AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY row_index) AS pos FROM imp WHERE trim(translated_text) <> ''),
fits AS (SELECT w.conv_id FROM (SELECT conv_id, count(*) AS wanted FROM seg GROUP BY 1) w JOIN (SELECT conv_id, count(*) AS got FROM rows GROUP BY 1) g USING (conv_id) LEFT JOIN (SELECT s.conv_id, count(*) AS exact FROM seg s WHERE EXISTS (SELECT 1 FROM imp i WHERE i.conv_id = s.conv_id AND i.k = s.k) GROUP BY 1) e USING (conv_id) WHERE wanted = got AND coalesce(exact, 0) * 2 < wanted)
SELECT s.conv_id, s.turn, r.translated_text, 'position' AS match FROM seg s JOIN rows r USING (conv_id, pos) WHERE s.conv_id IN (SELECT conv_id FROM fits)""")
def q15_positional_rescue(s, d):
    conv = A.table(s, d, "conversations")
    seg = conv.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("K"), "turn").alias("k"))
    key = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("changed-"), "turn")).otherwise(F.concat(F.lit("K"), (F.col("turn") - 1).cast("string")))
    imported = conv.where("role = 'assistant'").select("conv_id", F.col("turn").alias("row_index"), key.alias("k"), F.col("text").alias("translated_text"))
    return matching.by_position(seg, imported, "conv_id", "turn", "k").drop("k")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT source, doc_id, n_chars, rn, 1::BIGINT AS package_index, n_chars AS held FROM o WHERE rn = 1 UNION ALL
 SELECT o.source, o.doc_id, o.n_chars, o.rn, CASE WHEN f.held + o.n_chars > 50000 THEN f.package_index + 1 ELSE f.package_index END, CASE WHEN f.held + o.n_chars > 50000 THEN o.n_chars ELSE f.held + o.n_chars END FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1),
p AS (SELECT source, package_index, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_size FROM f GROUP BY 1, 2)
SELECT source, package_index, n_rows, n_size, max(package_index) OVER (PARTITION BY source) AS package_total, source || '_' || lpad(package_index::VARCHAR, 3, '0') || '_of_' || lpad((max(package_index) OVER (PARTITION BY source))::VARCHAR, 3, '0') || '.xlsx' AS filename FROM p""")
def q16_next_fit_packages(s, d):
    packed = packing.next_fit(_docs(s, d).select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 50_000)
    return packing.packages(packed, "source", "n_chars")


@query("SELECT o_orderstatus AS status, o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 500 + 1 AS package_index FROM orders")
def q17_row_cap_packages(s, d):
    rows = A.table(s, d, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey")
    return packing.row_cap(rows, "status", "o_orderkey", 500)


@query("""WITH new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 13 <> 0 UNION ALL SELECT o_orderkey + 100000000, o_totalprice FROM orders WHERE o_orderkey % 17 = 0),
old AS (SELECT o_orderkey, o_totalprice AS p FROM orders) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete' WHEN o.p <> n.p THEN 'update' ELSE 'unchanged' END AS action FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey""")
def q18_store_diff(s, d):
    old = A.table(s, d, "orders").select("o_orderkey", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = old.where("o_orderkey % 13 <> 0").withColumn("o_totalprice", price).unionByName(old.where("o_orderkey % 17 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000))
    return store.diff(old, new, ["o_orderkey"], ["o_totalprice"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5 OFFSET 10")
def q19_history_page(s, d):
    """The third page of five of a history: a feature that is a limit."""
    return store.history_page(A.table(s, d, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_orderkey", "o_custkey", "o_totalprice")


OVERLAPS = f"""{BOXES}, pairs AS (SELECT a.page, a.box_id AS a, b.box_id AS b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS s FROM boxes a JOIN boxes b ON a.page = b.page AND a.box_id < b.box_id WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.75 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.75),
 overlapped AS (SELECT page, a, b, round(w, 2) AS width, round(h, 2) AS height, round(CASE WHEN s > 0 THEN w * h / s ELSE 0.0 END, 6) AS ratio FROM pairs)"""


def _boxes(s, d):
    return A.boxes(A.table(s, d, "embeddings"))


@query(f"WITH {OVERLAPS} SELECT page, a, b, ratio FROM overlapped")
def q20_overlap_pairs(s, d):
    return spatial.overlap_pairs(_boxes(s, d)).select("page", "a", "b", "ratio")


@query(f"""WITH {BOXES}, d AS (SELECT l.page, l.box_id AS a, r.box_id AS b, round(abs(l.x0 - r.x0) + abs(l.y0 - r.y0) + abs(l.x1 - r.x1) + abs(l.y1 - r.y1), 4) AS distance FROM boxes l JOIN boxes r ON l.page = r.page AND l.box_id % 2 = 0 AND r.box_id % 2 = 1)
SELECT page, a, b, distance FROM (SELECT *, row_number() OVER (PARTITION BY page, a ORDER BY distance, b) AS k FROM d WHERE distance <= 60) WHERE k = 1""")
def q21_nearest_fragment(s, d):
    boxes = _boxes(s, d)
    return spatial.nearest(boxes.where("box_id % 2 = 0"), boxes.where("box_id % 2 = 1"), 60.0)


@query(f"""WITH {OVERLAPS}, p AS (SELECT page, count(*) AS n_pairs, max(ratio) AS max_ratio FROM overlapped GROUP BY 1), n AS (SELECT page, count(*) AS n_boxes FROM boxes GROUP BY 1)
SELECT page, n_boxes, coalesce(n_pairs, 0) AS n_pairs, coalesce(max_ratio, 0.0) AS max_ratio, round(0.25 * least(coalesce(n_pairs, 0), 30) + coalesce(max_ratio, 0.0), 6) AS risk, CASE WHEN coalesce(max_ratio, 0) >= 0.95 THEN 'needs_review' WHEN n_pairs > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM n LEFT JOIN p USING (page)""")
def q22_overlap_quality(s, d):
    boxes = _boxes(s, d)
    return quality.layout_report(boxes, spatial.overlap_pairs(boxes))


@query(f"""WITH {WRAPPED} SELECT page, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(*) AS n_lines, count(*) >= 240 OR sum(length(line)) / 500990.0 >= 0.012 AS dense FROM visual_lines GROUP BY 1""")
def q23_dense_documents(s, d):
    return spatial.density(A.visual_lines(_docs(s, d)), 500_990.0)


@query(r"""WITH c AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^㐀-鿿]', '', 'g')) AS cjk, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\s]', '', 'g')) AS blank, length(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'), '[㐀-鿿]', '', 'g')) AS plain FROM documents)
SELECT doc_id, CASE WHEN letters = 0 THEN 0.0 ELSE cjk / letters END AS cjk_ratio, round(cjk * 1.0 + blank * 0.25 + plain * 0.55 + (n - cjk - blank - plain) * 0.45, 4)::DOUBLE AS visual_length FROM c""")
def q24_cjk_and_visual_length(s, d):
    return _docs(s, d).select("doc_id", T.cjk_ratio(F.col("text")).alias("cjk_ratio"), F.round(T.visual_length(F.col("text")).cast("double"), 4).alias("visual_length"))


@query("""WITH s AS (SELECT conv_id AS file, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS sheet_index, count(DISTINCT length(text)) AS distinct_keys, count(*) AS keyed_rows, count(*) FILTER (trim(text) <> '') AS filled_rows FROM conversations GROUP BY 1, 2)
SELECT file, CAST(sheet_index AS INT) AS sheet_index FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY distinct_keys DESC, keyed_rows DESC, filled_rows DESC, sheet_index) AS k FROM s) WHERE k = 1""")
def q25_sheet_argmax(s, d):
    index = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    sheets = A.table(s, d, "conversations").groupBy(F.col("conv_id").alias("file"), index.alias("sheet_index")).agg(F.lit(True).alias("visible"), F.countDistinct(F.length("text")).alias("distinct_keys"), F.count("*").alias("keyed_rows"), F.count_if(F.trim("text") != "").alias("filled_rows"))
    return matching.best_sheet(sheets)


@query("""WITH v AS (SELECT label AS page, CAST(floor((unnest(embedding)::DOUBLE + 1) * 128) AS BIGINT) AS value FROM embeddings), b AS (SELECT page, value // 12 AS bin, count(*) AS n FROM v GROUP BY 1, 2)
SELECT page, arg_max(bin, (n, -bin)) AS bin, max(n) AS n, round(max(n) / sum(n), 6) AS ratio FROM b GROUP BY 1""")
def q26_color_histogram(s, d):
    values = A.table(s, d, "embeddings").select(F.col("label").alias("page"), F.explode("embedding").alias("e")).select("page", F.floor((F.col("e").cast("double") + 1) * 128).alias("value"))
    return quality.color_mode(values)


@query("""SELECT source, sha256(string_agg(sha256(doc_id::VARCHAR || '|' || text), ',' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY 1""")
def q27_fingerprint(s, d):
    return store.fingerprint(_docs(s, d), "source", "doc_id", ["doc_id", "text"])


@query("""WITH n AS (SELECT max(doc_id) AS last FROM documents) SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT CAST(round_even(i * last / 4, 0) AS BIGINT) FROM n, range(5) t(i))""")
def q28_even_sample(s, d):
    """An even sample of five pages: a feature that is a sample."""
    return layout.even_sample(_docs(s, d).select("doc_id", "n_chars"), "doc_id")


@query("""SELECT user_id AS job_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS current, count(*) OVER (PARTITION BY user_id) AS total, round(100.0 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / count(*) OVER (PARTITION BY user_id), 1) AS percent FROM events""")
def q29_job_progress(s, d):
    return jobs.progress(A.job_events(A.table(s, d, "events")))


@query("SELECT user_id AS job_id, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def q30_job_retention(s, d):
    return jobs.retained(A.job_events(A.table(s, d, "events")))


@query(rf"""WITH {WRAPPED}, e AS (SELECT page, arg_min(line, line_no) AS first_text, arg_max(line, line_no) AS last_text FROM visual_lines GROUP BY 1), p AS (SELECT lang AS doc, page, {SQ.format('first_text')} AS a, {SQ.format('lag(last_text) OVER w')} AS b, lag(page) OVER w AS before_page, (page % 4) * 0.1 AS top, 0.6 + ((page - 1) % 5) * 0.1 AS bottom FROM e JOIN documents ON doc_id = page WINDOW w AS (PARTITION BY lang ORDER BY page))
SELECT doc, page, CAST(sum(CASE WHEN before_page = page - 1 AND bottom >= 0.72 AND top <= 0.28 AND {CONTINUES} THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page) AS BIGINT) AS chain FROM p""")
def q31_page_chains(s, d):
    docs = _docs(s, d)
    ends = A.visual_lines(docs).groupBy("page").agg(F.min_by("line", "line_no").alias("first_text"), F.max_by("line", "line_no").alias("last_text"))
    own = ends.join(docs.select(F.col("doc_id").alias("page"), F.col("lang").alias("doc")), "page")
    own = own.withColumns({"bottom": 0.6 + F.col("page") % 5 * 0.1, "top": F.col("page") % 4 * 0.1})
    return layout.page_chains(own, "bottom", "top").select("doc", "page", "chain")


@query()
def q32_proportional_split(s, d):
    """A reply over the sentences of its question; ordered search, held against plain Python in tests."""
    pairs = _pairs(s, d).where("translated_text is not null").withColumn("sources", F.split("source_text", r"(?<=\.)\s+"))
    return visual.split_over_anchors(pairs, "translated_text", "sources").select("conv_id", "turn", F.size("sources").alias("n_sources"), F.to_json("parts").alias("parts"))


@query(f"""WITH {PARAGRAPHS}, l AS (SELECT page, paragraph, line, row_number() OVER (PARTITION BY page, paragraph ORDER BY line_no) AS k FROM merged)
SELECT 'P' || page || '-' || CAST(paragraph AS BIGINT) || '@A' || lpad(k::VARCHAR, 3, '0') AS visual_id, count(*) OVER (PARTITION BY page, paragraph) AS n_anchors, line AS text FROM l""")
def q33_exploded_anchors(s, d):
    merged = layout.merge_lines(A.visual_lines(_docs(s, d)))
    anchors = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    seg = merged.groupBy("page", "paragraph").agg(anchors.alias("anchors")).select(F.concat(F.lit("P"), "page", F.lit("-"), "paragraph").alias("segment_id"), "anchors", F.col("anchors").alias("parts"))
    return visual.expand(seg).select("visual_id", F.col("n_anchors").cast("bigint").alias("n_anchors"), "text")


@query("""SELECT lang AS doc, count(*) AS n_pages, count(*) FILTER (length(text) >= 20) AS text_pages, count(*) FILTER (length(text) < 20) AS image_pages, CASE WHEN count(*) FILTER (length(text) < 20) = 0 THEN 'text' WHEN count(*) FILTER (length(text) >= 20) = 0 THEN 'image' ELSE 'mixed' END AS mode FROM documents GROUP BY 1""")
def q34_inspect_pages(s, d):
    return quality.inspect_pages(_docs(s, d).select(F.col("lang").alias("doc"), F.length("text").alias("n_signs")))


@query(f"""WITH {BOXES}, r AS (SELECT page, box_id, round(60 + least(abs(x0) / 1000, 0.9) * 481.37, 2) AS x0, round(9 + (1 - least(abs(y0) / 1000, 0.9) - 0.03) * 703.37, 2) AS y0, round(60 + (least(abs(x0) / 1000, 0.9) + 0.1) * 481.37, 2) AS x1, round(9 + (1 - least(abs(y0) / 1000, 0.9)) * 703.37, 2) AS y1 FROM boxes WHERE (box_id % 100) / 100.0 >= 0.35) SELECT * FROM r""")
def q35_ocr_lines(s, d):
    words = _boxes(s, d).select("page", "box_id", F.lit("word").alias("text"), ((F.col("box_id") % 100) / 100.0).alias("confidence"), F.least(F.abs("x0") / 1000, F.lit(0.9)).alias("x"), F.least(F.abs("y0") / 1000, F.lit(0.9)).alias("y"), F.lit(0.1).alias("width"), F.lit(0.03).alias("height"), F.lit(60.0).alias("rx0"), F.lit(9.0).alias("ry0"), F.lit(541.37).alias("rx1"), F.lit(712.37).alias("ry1"))
    return layout.ocr_lines(words).select("page", "box_id", "x0", "y0", "x1", "y1")


@query(f"""WITH {WRAPPED}, b AS (SELECT page, CAST(((page * 7 + line_no * 13) % 36) * 5 - 90 AS DOUBLE) AS angle, CAST(sum(greatest(length(line), 1)) AS BIGINT) AS weight FROM visual_lines GROUP BY 1, 2) SELECT page, arg_max(angle, (weight, -angle)) AS rotation, max(weight) AS weight FROM b GROUP BY 1""")
def q36_dominant_rotation(s, d):
    lines = A.visual_lines(_docs(s, d)).withColumn("rotation", (((F.col("page") * 7 + F.col("line_no") * 13) % 36) * 5 - 90).cast("double"))
    return layout.dominant_rotation(lines)


@query(f"""WITH {WRAPPED}, z AS (SELECT page, line_no, 8.0 + length(line) % 9 AS size FROM visual_lines), b AS (SELECT *, lag(size) OVER (PARTITION BY page ORDER BY line_no) AS before FROM z)
SELECT page, line_no, CAST(sum(CASE WHEN before IS NULL OR abs(size - before) > greatest(2.0, 0.25 * greatest(size, before)) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line_no) AS BIGINT) AS fragment FROM b""")
def q37_font_islands(s, d):
    spans = A.visual_lines(_docs(s, d)).select("page", "line_no", (F.lit(8.0) + F.length("line") % 9).alias("size"))
    return layout.font_islands(spans).select("page", "line_no", "fragment")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN lpad(o_orderkey::VARCHAR, 8, '0') WHEN o_orderkey % 3 = 1 THEN 'P' || lpad((o_orderkey % 500)::VARCHAR, 4, '0') || '-S' || lpad((o_orderkey % 70000)::VARCHAR, 6, '0') END AS row_key FROM orders""")
def q38_row_keys(s, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" R"), k)).when(k % 3 == 1, F.concat(F.lit("p"), k % 500, F.lit("-s"), k % 70000)).otherwise(F.concat(F.lit("x"), k))
    return A.table(s, d, "orders").select("o_orderkey", T.row_key(raw).alias("row_key"))


@query(r"""SELECT page_id, CASE WHEN left(s, 80) = '' THEN 'document' ELSE left(s, 80) END AS stem FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_一-鿿.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS s FROM pages)""")
def q39_safe_stems(s, d):
    return A.table(s, d, "pages").select("page_id", T.safe_stem(F.col("url")).alias("stem"))


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0) ELSE printf('%.1f GB', b / 1073741824.0) END AS label FROM (SELECT doc_id, n_chars * n_chars AS b FROM documents)""")
def q40_size_labels(s, d):
    return _docs(s, d).select("doc_id", T.size_label(F.col("n_chars") * F.col("n_chars")).alias("label"))


@query(f"""WITH {BOXES} SELECT page, box_id, x1, round(CASE WHEN lead(x0) OVER w IS NULL THEN x1 + 14.0 ELSE greatest(x1, lead(x0) OVER w - 1.5) END, 2) AS lead_x1 FROM boxes WINDOW w AS (PARTITION BY page ORDER BY x0, box_id)""")
def q41_fragment_leads(s, d):
    return spatial.leads(_boxes(s, d))


@query()
def q42_repair_clusters(s, d):
    """Agglomeration of boxes a page; every merge depends on the last one: held against brute force in tests."""
    return spatial.clusters(_boxes(s, d), 2.0)


@query()
def q43_columns(s, d):
    """Greedy columns by medians, a page at a time: held against plain Python in tests."""
    return layout.assign_columns(_boxes(s, d).withColumn("page_width", F.lit(500.0)))


@query(r"""WITH i AS (SELECT page_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(url, '(?:https?://|www\.)\S+|[A-Za-z]*\d[\w./:%+-]*|[A-Z]{2,}'), lambda x: lower(trim(x, '.,;:()[]{}'))), lambda x: x <> ''))) AS identifier FROM pages)
SELECT identifier, min(page_id) AS page_id FROM i GROUP BY 1 HAVING count(DISTINCT page_id) = 1""")
def q44_unique_identifiers(s, d):
    each = A.table(s, d, "pages").select("page_id", F.explode(T.identifiers(F.col("url"))).alias("identifier"))
    return each.groupBy("identifier").agg(F.min("page_id").alias("page_id"), F.countDistinct("page_id").alias("n")).where("n = 1").drop("n")


@query(rf"""WITH {LINES} SELECT page, line_no, length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) >= 3 AND length(line) <= 90 AND length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) >= length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) * 0.9 AS heading, regexp_matches(line, '[A-Za-z]') AND NOT regexp_matches(trim(line), '^[A-Z]{{1,6}}$') AS translatable FROM doc_lines""")
def q45_line_predicates(s, d):
    return A.doc_lines(_docs(s, d)).select("page", "line_no", T.looks_like_heading(F.col("line")).alias("heading"), T.translatable(F.col("line")).alias("translatable"))


@query("""WITH u AS (SELECT doc_id, 'new ' || quality AS t FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id + 10000000, 'lost' FROM labels WHERE doc_id % 10 = 0)
SELECT 'segment' AS kind, d.doc_id, coalesce(u.t, d.lang) AS text FROM documents d LEFT JOIN u USING (doc_id) UNION ALL SELECT 'unknown', doc_id, t FROM u WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def q46_manual_updates(s, d):
    labels = A.table(s, d, "labels")
    updates = labels.where("quality is not null").select("doc_id", F.concat(F.lit("new "), "quality").alias("translated_text")).unionByName(labels.where("doc_id % 10 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit("lost").alias("translated_text")))
    done, unknown = matching.manual_updates(_docs(s, d).select("doc_id", F.col("lang").alias("translated_text")), updates, "doc_id")
    return done.select(F.lit("segment").alias("kind"), "doc_id", F.col("translated_text").alias("text")).unionByName(unknown.select(F.lit("unknown").alias("kind"), "doc_id", F.col("translated_text").alias("text")))


@query("""SELECT page_id * 2 + side AS position, page_id, CASE side WHEN 0 THEN 'source' ELSE 'translated' END AS side, length(html) AS size FROM pages, range(2) t(side)""")
def q47_interleaved_pages(s, d):
    """Source and translated page in turn: the row plan of a bilingual document."""
    pages = A.table(s, d, "pages")
    return pages.select("page_id", F.length("html").cast("bigint").alias("size"), F.posexplode(F.array(F.lit("source"), F.lit("translated"))).alias("k", "side")).select((F.col("page_id") * 2 + F.col("k")).alias("position"), "page_id", "side", "size")


@query("""SELECT page_id, sha256(html) AS file_hash, strlen(html) AS n_bytes, left(html, 9) = '<!DOCTYPE' AND strlen(html) BETWEEN 1 AND 20000 AS accepted FROM pages""")
def q48_upload_checks(s, d):
    raw = F.encode("html", "UTF-8")
    return A.table(s, d, "pages").select("page_id", F.sha2(raw, 256).alias("file_hash"), F.octet_length(raw).cast("bigint").alias("n_bytes"), ((F.substring(raw, 1, 9) == F.lit(b"<!DOCTYPE")) & F.octet_length(raw).between(1, 20_000)).alias("accepted"))


@query("""SELECT * FROM (SELECT label AS page, vec_id AS box_id FROM embeddings) b WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = b.box_id)""")
def q49_orphans(s, d):
    files = A.table(s, d, "embeddings").select(F.col("label").alias("page"), F.col("vec_id").alias("box_id"))
    return store.orphans(files, A.table(s, d, "labels").withColumnRenamed("doc_id", "box_id"), "box_id")


@query(f"""WITH {PAIRS} SELECT conv_id, turn, CASE WHEN {BLANK} THEN 'source_fallback' ELSE 'translated' END AS status, CASE WHEN translated_text IS NULL THEN 'missing' WHEN {BLANK} THEN 'empty' END AS fallback_reason, length(CASE WHEN {BLANK} THEN source_text ELSE translated_text END) AS n FROM turn_pairs""")
def q50_source_fallback(s, d):
    return validation.source_fallback(_pairs(s, d)).select("conv_id", "turn", "status", "fallback_reason", F.length("output_text").cast("bigint").alias("n"))


@query("""SELECT doc_id AS page, length(text) AS n_signs, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def q51_pages_with_segments(s, d):
    return _docs(s, d).join(A.table(s, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("page"), F.length("text").cast("bigint").alias("n_signs"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""WITH f AS (SELECT o_orderkey, o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '_copy.xlsx' ELSE '_' || lpad((o_orderkey % 45 + 1)::VARCHAR, 3, '0') || '_of_040.xlsx' END AS file, CASE WHEN o_orderkey % 3 = 0 THEN 'PKG-' || (o_orderkey % 50 + 1) END AS package_id FROM orders),
k AS (SELECT 'PKG-' || i AS id, CASE WHEN i = 40 THEN 39 ELSE i END AS package_index FROM range(1, 41) AS t(i)), one AS (SELECT package_index FROM k GROUP BY 1 HAVING count(*) = 1),
g AS (SELECT file, package_id, k.package_index AS own, CASE WHEN package_id IS NULL THEN one.package_index END AS named FROM f LEFT JOIN k ON k.id = f.package_id LEFT JOIN one ON o_orderkey % 7 <> 0 AND one.package_index = o_orderkey % 45 + 1)
SELECT file, CASE WHEN coalesce(own, named) IS NOT NULL THEN 'OK' WHEN package_id IS NOT NULL THEN 'WRONG_PACKAGE' ELSE 'UNKNOWN_PACKAGE' END AS state, coalesce(own, named) AS package_index, own IS NOT NULL AS by_id FROM g""")
def q52_package_lookup(s, d):
    """Files by claimed id or by the index in the name: some ids and indexes are of no package, one index is of two."""
    k = F.col("o_orderkey")
    name = F.when(k % 7 == 0, F.concat(k, F.lit("_copy.xlsx"))).otherwise(F.format_string("%d_%03d_of_040.xlsx", k, k % 45 + 1))
    files = A.table(s, d, "orders").select(name.alias("file"), F.when(k % 3 == 0, F.concat(F.lit("PKG-"), k % 50 + 1)).alias("package_id"))
    known = s.range(1, 41).select(F.concat(F.lit("PKG-"), "id").alias("package_id"), F.when(F.col("id") == 40, 39).otherwise(F.col("id")).alias("package_index"))
    return matching.package_of(files, known)


@query(f"""WITH {OVERLAPS}, r AS (SELECT page, count(*) AS n_pairs FROM overlapped GROUP BY 1) SELECT page, n_pairs FROM r ORDER BY n_pairs DESC, page LIMIT 30""")
def q53_riskiest_pages(s, d):
    """The thirty pages of highest risk: a feature that is a limit."""
    pairs = spatial.overlap_pairs(_boxes(s, d)).groupBy("page").agg(F.count("*").alias("n_pairs"))
    return quality.riskiest(pairs.withColumn("risk", F.col("n_pairs"))).select("page", "n_pairs")


@query("""SELECT l_orderkey, l_linenumber, ((l_orderkey % 360) - 180)::DOUBLE AS turn, round((l_quantity * cos(radians(-(l_orderkey % 4) * 90.0)) - l_linenumber * sin(radians(-(l_orderkey % 4) * 90.0))), 6) AS u FROM lineitem""")
def q54_rotations(s, d):
    k, q = F.col("l_orderkey"), F.col("l_quantity")
    turn = G.rotation(F.cos(F.radians((k % 360).cast("double") - 180.0)), F.sin(F.radians((k % 360).cast("double") - 180.0)))
    angle = (-(k % 4) * 90.0).cast("double")
    return A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.pmod(F.round(turn, 6) + 180.0, F.lit(360.0)).alias("t"), F.round(q * F.cos(F.radians(angle)) - F.col("l_linenumber") * F.sin(F.radians(angle)), 6).alias("u")).withColumn("turn", F.col("t") - 180.0).drop("t")


@query(r"""WITH n AS (SELECT conv_id, turn, role, greatest(1, CAST(ceil(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) * 0.6::DOUBLE) AS INT)) AS n,
    list_transform(regexp_extract_all(text, '(\d+(?:[.,]\d+)?)', 1)[CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END:], lambda x: replace(x, ',', '.')) AS left_ FROM conversations)
SELECT conv_id, turn, concat_ws(' ', left(repeat('测试', CAST(ceil(n / 2) AS INT)), n), role, CASE WHEN len(left_) > 0 THEN array_to_string(list_sort(left_), ' ') END) AS stress FROM n""")
def q55_stress_text(s, d):
    """Texts for layout tests; on even turns a token stands for the first number and its unit."""
    first = F.when(F.col("turn") % 2 == 0, F.regexp_extract("text", r"\d+(?:[.,]\d+)?[a-z]*", 0)).otherwise("")
    return A.table(s, d, "conversations").select("conv_id", "turn", T.stress_text(F.col("text"), "测试", 0.6, F.array("role"), F.array(first)).alias("stress"))


@query(f"WITH {BOXES} SELECT page, box_id, greatest(0.0, least(x0, 300.0)) AS x0, greatest(0.0, least(y1, 400.0)) AS y1, greatest(greatest(0.0, least(x1, 300.0)) - greatest(0.0, least(x0, 300.0)), 0.0) AS width FROM boxes")
def q56_clamped_boxes(s, d):
    b = F.col("b")
    return _boxes(s, d).select("page", "box_id", G.clamp(G.box("x0", "y0", "x1", "y1"), F.lit(300.0), F.lit(400.0)).alias("b")).select("page", "box_id", b["x0"].alias("x0"), b["y1"].alias("y1"), G.width(b).alias("width"))


@query("""SELECT page_id::VARCHAR AS file, CASE WHEN page_id % 3 <> 0 THEN 'same' WHEN page_id % 2 = 0 THEN 'same_content' ELSE 'changed' END AS state FROM pages""")
def q57_changed_files(s, d):
    k = F.col("page_id")
    files = A.table(s, d, "pages").select(k.cast("string").alias("file"), F.octet_length("html").alias("size"), k.alias("mtime"), F.sha2("html", 256).alias("hash"))
    known = A.table(s, d, "pages").select(k.cast("string").alias("file"), F.octet_length("html").alias("size"), F.when(k % 3 == 0, k + 1).otherwise(k).alias("mtime"), F.when(k % 2 == 0, F.sha2("html", 256)).otherwise("other").alias("hash"))
    return store.unchanged(files, known)


@query("""WITH s AS (SELECT lang AS page, doc_id AS segment_id FROM documents) SELECT page, count(*) AS n_segments, count(*) FILTER (segment_id NOT IN (SELECT doc_id FROM labels)) AS n_missing, round(1 - count(*) FILTER (segment_id NOT IN (SELECT doc_id FROM labels)) / count(*), 6) AS coverage FROM s GROUP BY 1""")
def q58_reflow_quality(s, d):
    return quality.reflow_quality(_docs(s, d).select(F.col("lang").alias("page"), F.col("doc_id").alias("segment_id")), A.table(s, d, "labels").select(F.col("doc_id").alias("segment_id")))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 170 WHEN page_id % 4 = 1 THEN 240 ELSE 200 END AS dpi, least(64, page_id) AS workers FROM pages""")
def q59_options(s, d):
    k = F.col("page_id")
    dpi = F.when(k % 4 == 0, " 170 ").when(k % 4 == 1, "240").when(k % 4 == 2, "300").otherwise("x")
    return A.table(s, d, "pages").select("page_id", T.chosen(dpi, (170, 200, 240), 200).alias("dpi"), T.clamped(k.cast("string"), 0, 64, 1).alias("workers"))


HTML_BLOCKS = "html_blocks AS (" + " UNION ALL ".join(
    rf"""SELECT page, '{kind}' AS kind, generate_subscripts(l, 1) - 1 AS block_no, trim(regexp_replace(replace(regexp_replace(unnest(l), '<[^>]*>', ' ', 'g'), chr(173), ''), '[ \t\r\f\v]+', ' ', 'g'), chr(10) || ' ') AS t FROM (SELECT page_id AS page, regexp_extract_all(html, '(?s)<{tag}>(.*?)</{tag}>', 1) AS l FROM pages)"""
    for tag, kind in {"title": "title", "h1": "heading", "p": "paragraph", "li": "item", "nav": "navigation", "footer": "footer"}.items()
) + ")"


@query(rf"""WITH {HTML_BLOCKS}, f AS (SELECT *, CASE kind WHEN 'title' THEN 20.0 WHEN 'heading' THEN 14.0 WHEN 'footer' THEN 8.0 ELSE 10.0 END AS size, CASE kind WHEN 'title' THEN 0.04 WHEN 'heading' THEN 0.1 WHEN 'paragraph' THEN 0.2 WHEN 'footer' THEN CASE page % 2 WHEN 0 THEN 0.96 ELSE 0.9 END ELSE 0.02 END AS top FROM html_blocks),
m AS (SELECT page, median(size) AS m FROM f GROUP BY 1)
SELECT page, kind, block_no, CASE WHEN regexp_matches(t, '(?i)^(page\s*)?\d+(\s*/\s*\d+)?$') AND (top < 0.08 OR top + 0.02 > 0.92) THEN 'page_number' WHEN regexp_matches(t, '(?i)^(figure|fig\.|table)\s+\d+') THEN 'caption'
 WHEN page = 1 AND block_no <= 3 AND size >= greatest(16.0, m * 1.55) THEN 'title' WHEN length(t) <= 180 AND size >= greatest(12.0, m * 1.25) THEN 'heading' WHEN top < 0.035 THEN 'header' WHEN top + 0.02 > 0.965 THEN 'footer' WHEN top + 0.02 > 0.82 AND size < m * 0.9 THEN 'footnote' ELSE 'paragraph' END AS block_type FROM f JOIN m USING (page)""")
def q60_html_block_classes(s, d):
    """All blocks of all pages, each against its page's median size."""
    of = lambda other, **by: F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in by.items()], other)
    top = of(F.lit(0.02), title=F.lit(0.04), heading=F.lit(0.1), paragraph=F.lit(0.2), footer=F.when(F.col("page") % 2 == 0, 0.96).otherwise(0.9))
    blocks = A.html_blocks(A.table(s, d, "pages")).withColumns({"size": of(F.lit(10.0), title=F.lit(20.0), heading=F.lit(14.0), footer=F.lit(8.0)), "top": top})
    median = blocks.groupBy("page").agg(F.median("size").alias("m"))
    kind = layout.classify(F.col("text"), F.col("size"), F.col("size"), F.col("m"), F.col("top"), F.col("top") + 0.02, F.col("page"), F.col("block_no"))
    return blocks.join(median, "page").select("page", "kind", "block_no", kind.alias("block_type"))


from pagemill.plans import drawing, reports, stored  # noqa: E402, F401  (add their queries to the same tables)
