"""Registered queries of stored documents and of pixels: strict reading, recognized lines, colors of regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import colors, layout
from pagemill.plans.catalog import HTML_BLOCKS, LINES, SQ, _docs, query
from pagemill.sources import adapters as A
from pagemill.sources import payloads as P

#: Which documents are broken, and how; the same rules as in `_documents`.
FAULTS = """faults AS (SELECT doc_id, '$' AS path, 'no object' AS problem FROM documents WHERE doc_id % 13 = 3
  UNION ALL SELECT doc_id, 'colour', 'unknown key' FROM documents WHERE doc_id % 7 = 1 AND doc_id % 13 <> 3
  UNION ALL SELECT doc_id, 'anchors[1].shade', 'unknown key' FROM documents WHERE doc_id % 5 = 2 AND doc_id % 13 <> 3
  UNION ALL SELECT doc_id, 'row_key', 'missing' FROM documents WHERE doc_id % 11 = 2 AND doc_id % 13 <> 3
  UNION ALL SELECT doc_id, 'font_size', 'no double' FROM documents WHERE doc_id % 17 = 4 AND doc_id % 13 <> 3
  UNION ALL SELECT doc_id, 'placeholders', 'no list' FROM documents WHERE doc_id % 19 = 5 AND doc_id % 13 <> 3)"""


def _documents(s, d):
    """(doc_id, json): each document as a stored segment of its whole text, two of three with anchors of their own; some are
    cut off, some have keys that nobody knows, lack a key or hold a value of another type."""
    k, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    box = F.array(F.lit(0.0), k.cast("double"), F.lit(10.5), k + 20.0)
    shade = F.when(k % 5 == 2, "grey")
    anchor = lambda i, *more: F.struct(F.format_string(f"A%d-{i}", k).alias("anchor_id"), k.cast("int").alias("page_number"), F.lit(i).alias("reading_order"), box.alias("bbox"), *more)
    none = F.lit(None).cast("string").alias("shade")
    anchors = F.when((k % 3 > 0) | (k % 5 == 2), F.array(anchor(0, none), anchor(1, shade.alias("shade"))))
    held = F.array(F.struct(F.lit("T1").alias("token"), F.lit("o").alias("original"), F.lit("url").alias("kind")))
    fields = {
        "segment_id": F.format_string("S%d", k), "row_key": F.when(k % 11 != 2, F.format_string("%08d", k)), "page_number": k.cast("int"),
        "reading_order": F.lit(1), "block_type": F.lit("paragraph"), "source_text": t, "protected_text": t,
        "source_text_hash": F.sha2(t, 256), "bbox": box, "colour": F.when(k % 7 == 1, "red"), "anchors": anchors,
        "layout_label": F.when(k % 2 == 0, "heading"),
    }
    plain = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    size = F.when(k % 17 == 4, F.lit('"big"')).otherwise((k % 9 + 6.5).cast("string"))
    placeholders = F.when(k % 19 == 5, F.lit('"none"')).otherwise(F.to_json(held))
    whole = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(',"font_size":'), size, F.lit(',"placeholders":'), placeholders, F.lit("}"))
    return _docs(s, d).select("doc_id", F.when(k % 13 == 3, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole).alias("json"))


@query(f"WITH {FAULTS} SELECT * FROM faults")
def q99_faults_of_documents(s, d):
    """What is wrong with stored documents, and where."""
    return P.faults(P.read_strict(_documents(s, d), "json", P.SEGMENT), "doc_id")


@query(f"""WITH {FAULTS}, v AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 3 > 0 AS own FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM faults))
SELECT doc_id, 'S' || doc_id AS segment_id, CAST(i AS INT) AS position, CASE WHEN own THEN 'A' || doc_id || '-' || i ELSE 'S' || doc_id || '-A001' END AS anchor_id,
  CASE WHEN own THEN i ELSE 1 END AS reading_order, CASE WHEN own THEN 0 ELSE 1 END AS n_erased, CASE WHEN own THEN 'paragraph' WHEN doc_id % 2 = 0 THEN 'heading' ELSE 'paragraph' END AS layout_label,
  CASE WHEN own THEN '' ELSE md5(t) END AS text_hash, doc_id + 20.0 AS bottom FROM v, range(2) r(i) WHERE own OR i = 0""")
def q93_anchors_of_documents(s, d):
    """Valid documents piece by piece as they are drawn; those without anchors by the one that their box makes."""
    rows = P.anchor_rows(P.read_strict(_documents(s, d), "json", P.SEGMENT), "doc_id")
    text = F.when(F.col("source_text") == "", "").otherwise(F.md5("source_text")).alias("text_hash")
    return rows.select("doc_id", "segment_id", "position", "anchor_id", "reading_order", F.size("erase_bboxes").alias("n_erased"), "layout_label", text, F.col("bbox")[3].alias("bottom"))


@query(f"""WITH {LINES}, w AS (SELECT page, CAST(line_no AS INT) AS line_no, {SQ.format("line")} AS text, (line_no * 7 + page) % 20 / 20.0 AS confidence, least(line_no, 90) / 100.0 AS y FROM doc_lines WHERE page % 23 <> 6)
SELECT page, line_no, md5(text) AS text_hash, confidence::DOUBLE AS confidence, round(60 + 0.25 * 180.0, 2) AS x0, round(9 + (1 - y - 0.05) * 140.0, 2) AS y0, round(60 + 0.75 * 180.0, 2) AS x1, round(9 + (1 - y) * 140.0, 2) AS y1, false AS broken FROM w WHERE text <> '' AND (line_no * 7 + page) % 20 >= 7
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM documents WHERE doc_id % 23 = 6""")
def q94_recognized_payloads(s, d):
    """Lines of all documents out of what a recognizer returned for each page; some answers were cut off."""
    k, p = F.col("line_no"), F.col("page")
    raw = _docs(s, d).select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    confidence, y = ((k * 7 + p) % 20 / 20.0).alias("confidence"), (F.least(k, F.lit(90)) / 100.0).alias("y")
    line = F.struct("line_no", F.struct(F.col("line").alias("text"), confidence, F.lit(0.25).alias("x"), y, F.lit(0.5).alias("width"), F.lit(0.05).alias("height")).alias("l"))
    payload = F.to_json(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]))
    pages = raw.groupBy("page").agg(payload.alias("payload")).withColumn("payload", F.when(p % 23 == 6, F.substring("payload", 1, 9)).otherwise(F.col("payload")))
    rect = {"rx0": F.lit(60.0), "ry0": F.lit(9.0), "rx1": F.lit(240.0), "ry1": F.lit(149.0)}
    lines, broken = P.recognized_lines(pages.withColumns(rect), "payload", "page")
    told = lines.select("page", "line_no", F.md5("text").alias("text_hash"), "confidence", "x0", "y0", "x1", "y1", F.lit(False).alias("broken"))
    return told.unionByName(broken.withColumn("broken", F.lit(True)), allowMissingColumns=True)


#: Vectors as images of eight by eight pixels, colors of three neighbours; a region leaves a rim of one or two.
PIXELS = """px AS (SELECT vec_id AS page, i % 8 AS x, i // 8 AS y, CAST(least(255, greatest(0, floor(128 + 300 * embedding[i + 1]::DOUBLE))) AS BIGINT) AS r,
    CAST(least(255, greatest(0, floor(128 + 300 * embedding[(i + 1) % 64 + 1]::DOUBLE))) AS BIGINT) AS g, CAST(least(255, greatest(0, floor(128 + 300 * embedding[(i + 2) % 64 + 1]::DOUBLE))) AS BIGINT) AS b
    FROM embeddings, range(64) t(i) WHERE len(embedding) = 64),
  cut AS (SELECT *, x BETWEEN 2 AND 5 AND y BETWEEN 2 + page % 2 AND 5 AS crop, r * 2126 + g * 7152 + b * 722 AS l, r // 12 AS qr, g // 12 AS qg, b // 12 AS qb FROM px WHERE y >= page % 2)"""


def _images(s, d):
    """(pixels, regions) of all vectors."""
    own = A.table(s, d, "embeddings").where(F.size("embedding") == 64)
    value = lambda i: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.element_at("embedding", (i % 64 + 1).cast("int")).cast("double") * 300 + 128))).cast("bigint")
    i = F.col("i")
    pixels = own.select(F.col("vec_id").alias("page"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    pixels = pixels.select("page", (i % 8).alias("x"), F.floor(i / 8).alias("y"), value(i).alias("r"), value(i + 1).alias("g"), value(i + 2).alias("b"))
    box = {"region": F.lit(0), "x0": F.lit(2), "y0": F.col("page") % 2 + 2, "x1": F.lit(6), "y1": F.lit(6)}
    return pixels, own.select(F.col("vec_id").alias("page")).withColumns(box)


@query(f"""WITH {PIXELS}, bins AS (SELECT page, qr, qg, qb, count(*) AS k FROM cut WHERE crop GROUP BY 1, 2, 3, 4),
  best AS (SELECT page, arg_max((qr, qg, qb), (k, -qr, -qg, -qb)) AS q, max(k) AS k, sum(k) AS total FROM bins GROUP BY 1)
SELECT c.page, CAST(floor(median(r)) AS BIGINT) AS r, CAST(floor(median(g)) AS BIGINT) AS g, CAST(floor(median(b)) AS BIGINT) AS b, round(first(k / total), 6) AS ratio
FROM cut c JOIN best ON best.page = c.page AND abs(qr - q[1]) <= 1 AND abs(qg - q[2]) <= 1 AND abs(qb - q[3]) <= 1 WHERE crop GROUP BY 1""")
def q95_dominant_backgrounds(s, d):
    """The commonest color of each image's middle, out of all its pixels."""
    counted = colors.region_pixels(*_images(s, d))
    return colors.dominant_background(counted.where("part = 'crop'")).drop("region")


@query(f"""WITH {PIXELS}, rim AS (SELECT * FROM cut WHERE NOT crop), lv AS (SELECT page, median(l) AS m, quantile_cont(l, 0.45) AS low, quantile_cont(l, 0.55) AS high FROM rim GROUP BY 1),
  kept AS (SELECT rim.* FROM rim JOIN lv USING (page) WHERE CASE WHEN m >= 1200000 THEN l >= low ELSE l <= high END),
  around AS (SELECT page, median(r) * 2126 + median(g) * 7152 + median(b) * 722 AS a, round((stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3, 4) AS spread FROM kept GROUP BY 1),
  ink AS (SELECT page, first(spread) AS spread, sum(greatest(a - l - 140000, 0)) / 10000 AS dark, sum(greatest(l - a - 140000, 0)) / 10000 AS light FROM cut JOIN around USING (page) WHERE crop GROUP BY 1)
SELECT page, spread, round(dark, 4) AS dark, round(light, 4) AS light, CASE WHEN light > dark * 1.08 THEN 'light' ELSE 'dark' END AS polarity FROM ink""")
def q96_ink_polarity(s, d):
    """Whether what stands in each image's middle is darker or lighter than its rim."""
    pixels, regions = _images(s, d)
    out = colors.ink(colors.region_pixels(pixels, regions), regions)
    return out.select("page", "spread", F.round("dark", 4).alias("dark"), F.round("light", 4).alias("light"), "polarity")


@query(f"""WITH {LINES}, p AS (SELECT page AS doc, line_no + 1 AS page, length({SQ.format("line")}) AS n, line_no % 3 = 1 AS drawn FROM doc_lines),
  c AS (SELECT doc, count(*) AS page_count FROM p GROUP BY 1),
  r AS (SELECT doc, page_count, CASE WHEN doc % 4 = 0 THEN 1 ELSE doc % 4 END AS a, CASE WHEN doc % 5 = 0 THEN 12 ELSE page_count END AS z FROM c),
  f AS (SELECT *, a <= z AND z <= page_count AS fine FROM r),
  s AS (SELECT DISTINCT doc, CAST(round_even(i * (z - a) / greatest(1, least(4, z - a)), 0) AS BIGINT) + a AS page FROM f, range(5) t(i) WHERE fine AND i <= least(4, z - a)),
  g AS (SELECT doc, array_to_string(list(page ORDER BY page), ',') AS sampled, count(*) AS k, count(*) FILTER (n >= 20) AS texts,
    coalesce(array_to_string(list(page ORDER BY page) FILTER (n >= 20), ','), '') AS text_pages, coalesce(array_to_string(list(page ORDER BY page) FILTER (drawn), ','), '') AS image_pages FROM s JOIN p USING (doc, page) GROUP BY 1)
SELECT doc, page_count, a AS page_start, z AS page_end, sampled, text_pages, image_pages, CASE WHEN NOT fine THEN 'bad_range' WHEN texts = k THEN 'text' WHEN texts > 0 THEN 'mixed' ELSE 'image' END AS status,
  CASE WHEN fine THEN CASE WHEN texts = k THEN 'off' ELSE 'vision' END END AS recommended_mode FROM f LEFT JOIN g USING (doc)""")
def q97_inspections(s, d):
    """What a look at a few pages says of each document whose lines are its pages; some ranges end beyond the last one."""
    k = F.col("doc")
    lines = A.doc_lines(_docs(s, d)).select(F.col("page").alias("doc"), (F.col("line_no") + 1).alias("page"), F.col("line").alias("text"), F.when(F.col("line_no") % 3 == 1, 1).otherwise(0).alias("n_images"))
    ranges = _docs(s, d).select(F.col("doc_id").alias("doc")).select("doc", F.when(k % 4 > 0, k % 4).alias("page_start"), F.when(k % 5 == 0, 12).alias("page_end"))
    out = layout.inspection(lines, ranges)
    told = lambda c: F.array_join(c, ",")
    return out.select("doc", "page_count", "page_start", "page_end", told("sampled_pages").alias("sampled"), told("text_layer_pages").alias("text_pages"), told("image_pages").alias("image_pages"), "status", "recommended_mode")


@query(rf"""WITH {HTML_BLOCKS}, b AS (SELECT page % 40 AS doc, page, kind, block_no, t, lower(upper(t)) AS key, CASE WHEN kind IN ('footer', 'title') AND page % 3 = 0 THEN 'footer' WHEN kind = 'navigation' AND page % 2 = 0 THEN 'header' ELSE 'paragraph' END AS type, CASE kind WHEN 'footer' THEN 0.9 WHEN 'item' THEN 0.5 ELSE 0.2 END AS top FROM html_blocks),
  c AS (SELECT doc, key, count(*) AS n FROM b WHERE type <> 'paragraph' AND length(t) <= 200 GROUP BY 1, 2), k AS (SELECT doc, count(DISTINCT page) AS pages FROM b GROUP BY 1),
  r AS (SELECT doc, key FROM c JOIN k USING (doc) WHERE n >= greatest(2, CAST(ceil(0.35::DOUBLE * pages) AS BIGINT)))
SELECT b.doc, page, kind, block_no, CASE WHEN type <> 'paragraph' OR r.key IS NULL THEN type WHEN top < 0.5 THEN 'header' ELSE 'footer' END AS block_type FROM b LEFT JOIN r ON r.doc = b.doc AND r.key = b.key""")
def q98_repeated_marginal_blocks(s, d):
    """All blocks of all pages; what repeats in headers and footers of forty documents is one wherever it stands."""
    p, kind = F.col("page"), F.col("kind")
    known = F.when(kind.isin("footer", "title") & (p % 3 == 0), "footer").when((kind == "navigation") & (p % 2 == 0), "header").otherwise("paragraph")
    top = F.when(kind == "footer", 0.9).when(kind == "item", 0.5).otherwise(0.2)
    blocks = A.html_blocks(A.table(s, d, "pages")).withColumns({"doc": p % 40, "block_type": known, "top": top})
    return layout.mark_repeated(blocks).select("doc", "page", "kind", "block_no", "block_type")
