"""Strict reading of stored documents, recognized payloads, and colors of regions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import colors, layout
from pagemill.sources import payloads as P

SEGMENT = {"segment_id": "S1", "row_key": "1", "page_number": 3, "reading_order": 2, "block_type": "caption", "source_text": "a", "protected_text": "a", "source_text_hash": "h", "bbox": [0, 1, 2, 3.5]}
ANCHOR = {"anchor_id": "A", "page_number": 3, "reading_order": 0, "bbox": [1, 1, 1, 1]}


def read(spark, schema, *documents):
    texts = [(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return P.read_strict(spark.createDataFrame(texts, "id int, json string"), "json", schema)


def test_each_problem_and_its_place(spark):
    got = read(
        spark, P.SEGMENT,
        SEGMENT, None, "", "[1]", '{"segment_id": "S', {},
        {**SEGMENT, "nested": {"x": 1}, "bbox": "wide", "page_number": "3"},
        {**SEGMENT, "anchors": [ANCHOR, {**ANCHOR, "hue": 1}, None, 7], "placeholders": [{"token": "T", "original": "o"}]},
        {**SEGMENT, "anchors": {"anchor_id": "A"}, "row_key": None, "warnings": None, "fallback_reason": None},
        {**SEGMENT, "anchors": [{**ANCHOR, "erase_bboxes": [[0, "x"]]}]},
    )
    found = {}
    for r in P.faults(got, "id").collect():
        found.setdefault(r.id, []).append((r.path, r.problem))
    needed = [f.name for f in P.SEGMENT if not f.nullable]
    assert found == {
        **{i: [("$", "no object")] for i in (1, 2, 3, 4)},
        5: [(n, "missing") for n in needed],
        6: [("nested", "unknown key"), ("page_number", "no int"), ("bbox", "no array<double>")],
        7: [("placeholders[0].kind", "missing"), ("anchors[1].hue", "unknown key"), ("anchors[2]", "no object"), ("anchors[3]", "no object")],
        8: [("row_key", "missing"), ("anchors", "no list")],
        9: [("anchors[0].erase_bboxes", "no array<array<double>>")],
    }
    assert {r.id for r in got.where("document is not null").collect()} == {0}


def test_defaults_at_every_depth(spark):
    row = read(spark, P.SEGMENT, {**SEGMENT, "anchors": [ANCHOR], "status": "done", "font_size": None}).first().document
    assert row.status == "done" and row.font_size == 0.0 and row.should_translate is True and row.fallback_reason is None
    assert row.placeholders == [] and row.anchors[0].layout_label == "paragraph" and row.anchors[0].erase_bboxes == []
    pages = read(spark, P.DOCUMENT, {"pages": [{"page_number": 1, "width": 10, "height": 20}]}, {}).collect()
    assert [r.document.version for r in pages] == [2, 2] and pages[0].document.pages[0].rotation == 0 and pages[1].document.pages == []
    own = read(spark, P.SETTINGS, {"page_end": 4, "protected_terms": ["x"]}).first().document
    assert (own.page_start, own.page_end, own.protected_terms, own.ocr_mode, own.ignore_page_numbers) == (1, 4, ["x"], "off", True)
    assert read(spark, P.PACKAGE, {"package_id": "P"}).first().document is None


def test_anchors_of_segments_without_any(spark):
    docs = [SEGMENT, {**SEGMENT, "segment_id": "S2", "layout_label": "title", "erase_bboxes": [[9, 9, 9, 9]]}, {**SEGMENT, "segment_id": "S3", "anchors": [ANCHOR, {**ANCHOR, "anchor_id": "B"}]}, "{"]
    got = [tuple(r) for r in P.anchor_rows(read(spark, P.SEGMENT, *docs), "id").select("segment_id", "position", "anchor_id", "layout_label", "erase_bboxes", "source_text").orderBy("segment_id", "position").collect()]
    assert got == [
        ("S1", 0, "S1-A001", "caption", [[0.0, 1.0, 2.0, 3.5]], "a"),
        ("S2", 0, "S2-A001", "title", [[9.0, 9.0, 9.0, 9.0]], "a"),
        ("S3", 0, "A", "paragraph", [], ""),
        ("S3", 1, "B", "paragraph", [], ""),
    ]


def test_clashing_columns_empty_tables_and_long_texts(spark):
    wide = spark.createDataFrame([("{}", "p", "d", 1)], "json string, path string, position string, segment_id int")
    assert P.faults(P.read_strict(wide, "json", P.PACKAGE), "path").count() == 6
    assert P.read_strict(wide.limit(0), "json", P.SEGMENT).count() == 0
    text = "a \"b\" \\ é\n" * 400_000
    row = read(spark, P.SEGMENT, {**SEGMENT, "source_text": text}).select("problems", F.sha2("document.source_text", 256), F.length("document.source_text")).first()
    assert row[0] == [] and row[2] == len(text)


def test_recognized_lines_and_broken_answers(spark):
    line = lambda c, **more: {"text": " a\tb ", "confidence": c, "x": 0, "y": 0.1, "width": 0.5, "height": 0.1, **more}
    answers = [[line(0.34), line(0.35, x=0.25), line(0.9, text="  ")], [{"text": "bare"}], [], '[{"text": "cut', None, [{"text": "x", "confidence": "high"}]]
    rows = [(i, a if a is None or isinstance(a, str) else json.dumps(a), 60.0, 128.0, 240.0, 149.0) for i, a in enumerate(answers)]
    lines, broken = P.recognized_lines(spark.createDataFrame(rows, "page int, p string, rx0 double, ry0 double, rx1 double, ry1 double"), "p", "page")
    assert [tuple(r) for r in lines.collect()] == [(0, 1, "a b", 0.35, 105.0, 144.8, 195.0, 146.9)]
    assert {r.page for r in broken.collect()} == {3, 4, 5}


def image(seed, width=40, height=30):
    rng = np.random.default_rng(seed)
    return rng.choice(np.array([0, 11, 12, 40, 130, 250, 255]), size=(height, width, 3))


@pytest.fixture(scope="module")
def drawn(spark):
    pages = {i: image(i) for i in range(3)}
    pages[3] = np.full((30, 40, 3), 200)
    pages[3][10:14, 10:20] = 20
    pixels = [(p, x, y, *map(int, a[y, x])) for p, a in pages.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    regions = [(p, 0, 10, 10, 20, 14) for p in pages] + [(1, 1, 0, 0, 40, 30), (2, 2, 31, 5, 34, 6), (2, 3, 5, 5, 5, 9), (9, 4, 0, 0, 4, 4), (0, 5, 15, 8, 39, 29)]
    schema = "page int, region int, x0 int, y0 int, x1 int, y1 int"
    own = spark.createDataFrame(regions, schema)
    counted = colors.region_pixels(spark.createDataFrame(pixels, "page int, x int, y int, r int, g int, b int"), own)
    return pages, {(p, r): box for p, r, *box in regions}, own, counted.cache()


def crop_and_rim(pages, key, box):
    """Pixels by a mask over the whole image."""
    if key[0] not in pages:
        return np.empty((0, 3)), np.empty((0, 3))
    a, (x0, y0, x1, y1) = pages[key[0]], box
    m = min(6, max(2, (y1 - y0) // 2))
    yy, xx = np.mgrid[: a.shape[0], : a.shape[1]]
    crop = (xx >= x0) & (xx < x1) & (yy >= y0) & (yy < y1)
    wide = (xx >= x0 - m) & (xx < x1 + m) & (yy >= y0 - m) & (yy < y1 + m)
    return (a[crop], a[wide & ~crop]) if crop.any() else (np.empty((0, 3)), np.empty((0, 3)))


def test_every_pixel_of_a_region_once(drawn):
    pages, regions, _, counted = drawn
    sums = {(r.page, r.region, r.part): r.n for r in counted.groupBy("page", "region", "part").agg(F.sum("n").alias("n")).collect()}
    for key, box in regions.items():
        crop, rim = crop_and_rim(pages, key, box)
        assert (sums.get((*key, "crop"), 0), sums.get((*key, "border"), 0)) == (len(crop), len(rim))


def test_backgrounds_and_ink_by_sorting(drawn):
    pages, regions, own, counted = drawn
    rims = {(r.page, r.region): r for r in colors.robust_background(counted.where("part = 'border'")).collect()}
    crops = {(r.page, r.region): r for r in colors.dominant_background(counted.where("part = 'crop'")).collect()}
    inks = {(r.page, r.region): r for r in colors.ink(counted, own).collect()}
    weight = np.array([2126, 7152, 722])
    assert set(inks) == set(regions)
    for key, box in regions.items():
        crop, rim = crop_and_rim(pages, key, box)
        around = 2_550_000
        if len(rim):
            light = rim @ weight
            cut = np.sort(light)
            kept = rim[light >= np.percentile(cut, 45)] if np.median(light) >= 1_200_000 else rim[light <= np.percentile(cut, 55)]
            assert (rims[key].r, rims[key].g, rims[key].b) == tuple(np.median(kept, axis=0))
            assert rims[key].spread == pytest.approx(kept.std(axis=0).mean(), abs=1e-4)
            around = np.median(kept, axis=0) @ weight
        far = crop @ weight - around
        dark, bright = np.clip(-far - 140_000, 0, None).sum() / 1e4, np.clip(far - 140_000, 0, None).sum() / 1e4
        assert (inks[key].dark, inks[key].light) == pytest.approx((dark, bright))
        assert inks[key].polarity == ("light" if bright > dark * 1.08 else "dark")
        if len(crop):
            bins, counts = np.unique(crop // 12, axis=0, return_counts=True)  # in order of r, g, b
            near = crop[np.abs(crop // 12 - bins[counts.argmax()]).max(axis=1) <= 1]
            assert (crops[key].r, crops[key].g, crops[key].b) == tuple(np.floor(np.median(near, axis=0)))
            assert crops[key].ratio == pytest.approx(counts.max() / len(crop), abs=1e-6)
        else:
            assert key not in crops
    assert inks[3, 0].polarity == "dark" and inks[9, 4].spread == 0


def test_text_is_as_its_first_lines_are(spark):
    inks = spark.createDataFrame([(1, i, 0.0, 5.0) for i in range(3)] + [(1, 9, 1000.0, 0.0)], "page int, region int, dark double, light double")
    lines = spark.createDataFrame([(1, "a", 0, 0), (1, "a", 19, 1), (1, "a", 20, 9), (1, "b", 0, 9), (1, "b", 1, 2), (1, "c", 0, 77)], "page int, text string, line_no int, region int")
    got = {r.text: (r.dark, r.light, r.polarity) for r in colors.text_polarity(inks, lines).collect()}
    assert got == {"a": (0.0, 10.0, "light"), "b": (1000.0, 5.0, "dark"), "c": (0.0, 0.0, "dark")}


def test_repeated_marginals_make_headers_and_footers(spark):
    """Case and blanks do not matter; twice at least and in 35 of 100 pages; long texts, other documents and bodies do not count."""
    rows = [("d", i, "header", "My  Title", 0.0) for i in (1, 2)] + [("d", 3, "paragraph", "MY TITLE", 0.49), ("d", 4, "heading", "my title", 0.5), ("d", 5, "footer", "my title", 0.1)]
    rows += [("d", 1, "footer", "once", 0.9), ("d", 2, "paragraph", "once", 0.9), ("d", 3, "paragraph", "body", 0.1), ("d", 4, "paragraph", "body", 0.1)]
    rows += [("d", i, "footer", "x" * 201, 0.9) for i in (1, 2)] + [("d", 5, "paragraph", "x" * 201, 0.9), ("e", 1, "paragraph", "my title", 0.9), (None, 1, "paragraph", None, 0.9)]
    df = spark.createDataFrame(rows, "doc string, page int, block_type string, text string, top double")
    got = layout.mark_repeated(df).collect()
    assert len(got) == len(rows) and layout.mark_repeated(df.limit(0)).count() == 0
    changed = sorted((r.page, r.text, r.block_type) for r in got if (r.doc, r.page, r.block_type, r.text, r.top) not in rows)
    assert changed == [(3, "MY TITLE", "header"), (4, "my title", "footer")]
    many = spark.createDataFrame([("d", i, "header" if i < 34 else "body", "t", 0.0) for i in range(100)], df.schema)
    assert layout.mark_repeated(many).where("block_type = 'header'").count() == 34


def test_inspections(spark):
    text = "a text of twenty signs and more"
    pages = [("a", p, text, 0) for p in range(1, 11)] + [("b", 1, text, 1), ("b", 2, "  short " + " " * 30, 2), ("c", 1, None, 0), ("c", 2, "", 1), ("d", 1, text, 0)]
    ranges = [("a", 2, 9), ("c", None, None), ("d", 1, 2), ("nothing", 1, 1)]
    df = spark.createDataFrame(pages, "doc string, page int, text string, n_images int")
    got = {r.doc: tuple(r)[1:] for r in layout.inspection(df, spark.createDataFrame(ranges, "doc string, page_start int, page_end int")).collect()}
    assert got == {
        "a": (10, 2, 9, [2, 4, 6, 7, 9], [2, 4, 6, 7, 9], [], "text", "off"),  # 1.75, 3.5, 5.25 beyond the first
        "b": (2, 1, 2, [1, 2], [1], [1, 2], "mixed", "vision"),
        "c": (2, 1, 2, [1, 2], [], [2], "image", "vision"),
        "d": (1, 1, 2, None, None, None, "bad_range", None),
    }


def test_stress_texts_and_stems(spark):
    df = spark.createDataFrame([("Pay 3,5 kg or 12 of 12 é", ["3,5 kg", "12"]), ("", []), ("７ ﬁle?.", ["9"])], "t string, held array<string>")
    got = [tuple(r) for r in df.select(X.stress_text(F.col("t"), "测试", 0.5, F.array(F.lit("T1")), F.col("held")), X.safe_stem(F.col("t"))).collect()]
    assert got[:2] == [("测试测试测 T1 12", "Pay_3_5_kg_or_12_of_12_é"), ("测 T1", "document")] and got[2][1] == "7_file"
