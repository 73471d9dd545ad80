"""Room for paragraphs, and texts over labels, against plain search."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagemill.api import Engine
from pagemill.operators import fitting, visual
from pagemill.plans import drawing


def lines_by_hand(text, width, size):
    n = 0
    for line in text.split("\n"):
        used, n = 0, n + 1
        for c in line:
            w = round(1000 * visual.width_of(c))
            if used and used + w > int(width / size * 1000 + 1e-6):
                used, n = 0, n + 1
            used += w
    return n - (text.endswith("\n") and len(text) > 0)


def fit_by_hand(text, width, height, source, display):
    start = max(3.5, min(34.0, source * 1.08))
    start = min(36.0, max(start, source)) if display else start
    stands = lambda size, leading: lines_by_hand(text, width, size) * size * leading <= height + 0.35
    found = []
    for leading in (1.18, 1.12, 1.06, 1.02):
        if stands(3.5, leading):
            low, high = 3.5, start
            for _ in range(14):
                low, high = ((low + high) / 2, high) if stands((low + high) / 2, leading) else (low, (low + high) / 2)
            found.append((low, leading))
    return (*max(found), True) if found else (3.5, 1.02, False)


def test_paragraph_fit_by_plain_search():
    rng = random.Random(6)
    texts = ["", "a", "\n", "一" * 300, "word " * 80, *("".join(rng.choice("ab 漢字.\n1") for _ in range(rng.randrange(1, 200))).strip("\n") for _ in range(150))]
    width, height, source = (np.array([rng.uniform(a, b) for _ in texts]) for a, b in ((5, 300), (3, 120), (2, 40)))
    display = np.array([rng.random() < 0.3 for _ in texts])
    size, leading, lines, fits = fitting.fit_paragraphs(texts, width, height, source, display)
    for i, t in enumerate(texts):
        want = fit_by_hand(t, width[i], height[i], source[i], display[i])
        assert (size[i], leading[i], bool(fits[i])) == want, (i, t)
        assert lines[i] == lines_by_hand(t, width[i], size[i])
    assert 20 < fits.sum() < len(texts) and len({*leading.tolist()}) > 1


def test_query_fits_what_it_says(spark, sf):
    rows = drawing.q88_paragraph_fit(spark, sf).collect()
    assert rows and all(r.fit_lines * r.fit_size * r.fit_leading <= 14.0 + r.line_no % 7 * 12 + 0.36 for r in rows if r.fits) and {r.fits for r in rows} == {True, False}


def test_no_closing_sign_alone():
    """At size 10 the full stop would stand alone on the second line; one step smaller it does not."""
    text = "一二三四五。"
    assert visual.fit_lines(text, [50.0, 50.0], 10.0)[1] == ["一二三四五", "。"] or visual.fit_lines(text, [50.0, 50.0], 10.0)[0] < 10.0
    size, lines = visual.fit_lines(text, [50.0, 50.0], 10.0)
    assert size < 10.0 and not visual.orphaned(lines)
    assert visual.fit_lines("一。", [10.0, 10.0], 10.0, least=9.5) == (10.0, ["一", "。"])


def test_identifiers_stay_with_their_labels():
    parts, kept, why = visual.anchored_parts("图 2 泵 与 图 3 阀", ["Fig. 2 pump", "Fig. 3 valve"], False)
    assert (why is None and "2" in parts[0] and "3" in parts[1]) or (kept == [True, True] and parts == ["Fig. 2 pump", "Fig. 3 valve"])
    assert visual.split_is_safe("a1 b2", ["x a1", "y b2"], ["a1", "b2"]) and not visual.split_is_safe("a1 b2", ["x a1", "y b2"], ["a1 b2", ""])
    parts, kept, why = visual.anchored_parts("泵的说明文字在这里继续", ["PUMP ROOM", "the text goes on here", "and here it ends"], True)
    assert parts[0] == "PUMP ROOM" and kept == [True, False, False] and why == "label" and "".join(parts[1:]) == "泵的说明文字在这里继续"
    assert visual.anchored_parts("全部", ["PUMP", "ROOM"], True)[1] == [False, False]


def test_generation_restores_or_keeps_the_source(spark):
    """A token put back, one lost (the source stays, anchor by anchor), a text that is missing."""
    lines = spark.createDataFrame([(1, 0, "Visit https://example.com/a now."), (2, 0, "See https://example.com/b there."), (3, 0, "Nothing came back.")], "page int, line_no int, line string")
    engine = Engine(spark, "T")
    segments = engine.create(lines)
    token = F.get(F.col("placeholders"), 0)["token"]
    page = F.col("page")
    done = segments.withColumn("translated_text", F.when(page == 1, F.concat(F.lit("请看 "), token, F.lit(" 。"))).when(page == 2, "没有了"))
    anchors = segments.select("segment_id", F.array(F.lit("first"), F.col("source_text")).alias("anchors"))
    got = {(r.segment_id.split("-")[0], r.visual_id[-4:]): r.text for r in engine.generate(done, anchors).collect()}
    texts = {k: [v for (s, _), v in sorted(got.items()) if s == k] for k in {s for s, _ in got}}
    pages = sorted(texts)
    assert "https://example.com/a" in "".join(texts[pages[0]]) and "first" not in texts[pages[0]]
    assert texts[pages[1]] == ["first", "See https://example.com/b there."] and texts[pages[2]] == ["first", "Nothing came back."]
