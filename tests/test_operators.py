"""Operators against plain Python and small stated cases."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import layout, masking, matching, packing, spatial, store, validation, visual


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]


def test_text_functions(spark):
    assert values(spark, T.squeeze, "  a \t b\nc  ", None) == ["a b\nc", None]
    assert values(spark, T.row_key, "R12", "P1-S2", "00000007", "x", "123456789", " 5 ") == ["00000012", "P0001-S000002", "00000007", None, "123456789", "00000005"]
    assert values(spark, T.numbers, "1,5 and 2.0 and 1") == [["1", "1.5", "2.0"]]
    assert values(spark, T.cjk_ratio, "隆升ab", "12", "") == [0.5, 0.0, 0.0]
    assert values(spark, T.translatable, "11/9-7112", "Q", "CTI", "KXIXI", "quartz 89") == [False, False, False, False, True]
    assert values(spark, T.looks_like_heading, "PUMP ROOM", "Pump Room", "AB") == [True, False, False]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.1,), (10.0,), (10.1,)], "t double").select(T.eta_label(F.col("t"))).collect()] == ["0:00", "0:10", "0:10", "0:20"]
    assert values(spark, T.escape_html, "a<b>\n&") == ["a&lt;b&gt;<br/>&amp;"]


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 10.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    one, two = G.box("a", "b", "c", "d"), G.box("e", "f", "g", "h")
    got = df.select(G.overlap_ratio(one, two), G.distance(one, two), G.near(one, two, 0.0), G.union(one, two)["x1"]).first()
    assert tuple(got) == (0.5, 15.0, True, 15.0)
    turned = df.select(G.logical(one, F.lit(100.0), F.lit(200.0), F.lit(-90.0)).alias("b")).first().b
    assert all(abs(a - b) < 1e-9 for a, b in zip(turned, (190.0, 0.0, 200.0, 10.0)))


def test_paragraphs(spark):
    lines = spark.createDataFrame([(1, 0, "Some sentence which"), (1, 1, "goes on below it."), (1, 2, "A broken hyph-"), (1, 3, "enated word."), (1, 4, "Another one")], "page int, line_no int, line string")
    got = layout.paragraphs(layout.merge_lines(lines)).orderBy("paragraph").collect()
    assert [r.text for r in got] == ["Some sentence which goes on below it.", "A broken hyphenated word.", "Another one"]


def test_segments_count_over_pages(spark):
    rows = [(p, k, t) for p in (1, 5000, 9000) for k, t in enumerate(["abc d", "CTI", "x y"], 1)]
    got = layout.segments(spark.createDataFrame(rows, "page int, paragraph int, text string")).orderBy("page", "paragraph").collect()
    assert [r.row_key for r in got] == ["00000001", "", "00000002", "00000003", "", "00000004", "00000005", "", "00000006"]
    assert got[0].segment_id == "P0001-S000001"


def test_ocr_lines(spark):
    words = [("First line", 0.9, 0.1, 0.8, 0.3, 0.03), ("dropped", 0.34, 0.1, 0.7, 0.3, 0.03), ("kept", 0.35, 0.1, 0.76, 0.3, 0.03)]
    df = spark.createDataFrame([(1, *w, 0.0, 0.0, 600.0, 800.0) for w in words], "page int, text string, confidence double, x double, y double, width double, height double, rx0 double, ry0 double, rx1 double, ry1 double")
    got = layout.ocr_lines(df)
    assert sorted(tuple(r) for r in got.select("text", "x0", "y0", "x1", "y1").collect()) == [("First line", 60.0, 136.0, 240.0, 160.0), ("kept", 60.0, 168.0, 240.0, 192.0)]
    numbered = got.withColumns({"line_no": F.when(F.col("text") == "kept", 2).otherwise(1), "page_width": F.lit(600.0)})
    assert [(r.text, r.y0, r.y1, r.font_size, r.block_type, r.confidence) for r in layout.group_ocr_lines(numbered).collect()] == [("First line kept", 136.0, 192.0, 21.6, "paragraph", 0.625)]


def plain_columns(rows):
    """rows (page, id, x0, x1, width, free): {(page, id): column}, by the rules in plain words."""
    import statistics

    out = {}
    for page in {r[0] for r in rows}:
        own, columns = sorted((r for r in rows if r[0] == page), key=lambda r: (r[2], r[1])), []
        for r in own:
            out[page, r[1]] = 0
            if not r[5] or r[3] - r[2] >= 0.72 * r[4]:
                continue

            def fit(c, r=r):
                left, right = statistics.median(m[2] for m in c), statistics.median(m[3] for m in c)
                share = max(0, min(r[3], right) - max(r[2], left)) / max(1, min(max(r[3] - r[2], 1), right - left))
                return max(share, 1 - abs(r[2] - left) / max(1, 0.08 * r[4]))

            best = max(columns, key=fit, default=None)
            if best is not None and fit(best) >= 0.48:
                best.append(r)
            else:
                columns.append([r])
        for k, c in enumerate(sorted(columns, key=lambda c: statistics.median(m[2] for m in c)), 1):
            out.update({(page, m[1]): k for m in c})
    return out


def test_columns(spark):
    rng = random.Random(12)
    rows = [(p, i, x := rng.choice([40.0, 45.0, 300.0, 320.0, rng.uniform(0, 500)]), x + rng.choice([200.0, 230.0, 450.0, rng.uniform(1, 300)]), 600.0, "paragraph" if rng.random() < 0.9 else "heading") for p in range(6) for i in range(25)]
    got = layout.assign_columns(spark.createDataFrame(rows, "page int, box_id long, x0 double, x1 double, page_width double, block_type string"))
    want = plain_columns([(*r[:5], r[5] == "paragraph") for r in rows])
    assert {(r.page, r.box_id): r.column_id for r in got.collect()} == want and max(want.values()) > 1
    table = spark.createDataFrame([(1, 1, 0.0, 10.0, 600.0, True)], "page int, box_id long, x0 double, x1 double, page_width double, is_table_cell boolean")
    assert layout.assign_columns(table).first().column_id == -1


def test_page_range(spark):
    pages = spark.createDataFrame([(i,) for i in range(1, 6)], "page int")
    assert layout.page_range(pages, 2, 3, 5).count() == 2
    for bad in ((6, None), (3, 2), (1, 9)):
        with pytest.raises(ValueError):
            layout.page_range(pages, *bad, 5)


SAMPLE = "Write to ann.lee@mail.example today; the list is at https://docs.example/b?p=4 and weighs 310 kg, as $a+b=c$ shows [7]."


def test_mask_and_restore():
    text, held = masking.mask(SAMPLE, "t", "s")
    assert len(held) >= 5 and {"email", "url", "formula"} <= {k for _, _, k in held}
    changed = text.replace("⟦", "〔 ").replace("⟧", " ）").lower()
    assert masking.restore(changed, held)[1:] == ([], [], [])
    assert masking.mask("Half of it, as in 7*/3), was built during the 1970s.", "t", "s")[1] == []
    text, held = masking.mask("See https://docs.example first.", "t", "s")
    twice = text + held[0][0]
    assert masking.restore(twice, held) == (twice, [], [held[0][0]], [])
    assert masking.restore("Siehe https://docs.example zuerst", held)[1:] == ([], [], [])
    assert masking.restore("nothing of it", held)[1] == [held[0][0]]
    assert masking.restore("x0123456789 " + text, held)[3] == ["X0123456789"]
    assert masking.mask("the Borealis pump", "t", "s", ("borealis",))[1][0][2] == "protected_term"


def test_protect_and_policy(spark):
    df = spark.createDataFrame([("a", SAMPLE), ("b", "plain words"), ("c", None)], "id string, text string")
    got = {r.id: r for r in masking.protect(df, "t", "id", "text").collect()}
    assert got["a"].protected_text == masking.mask(SAMPLE, "t", "a")[0] and got["b"].placeholders == [] and got["c"].protected_text == ""
    lost = spark.createDataFrame([("x", [("T1", "25 mg", "number_unit"), ("T2", "u", "url")], ["T1", "T2"])], "id string, p array<struct<token:string,original:string,kind:string>>, m array<string>")
    assert lost.select(masking.blocking_missing(F.col("p"), F.col("m"))).first()[0] == ["T2"]
    back = masking.restored(masking.protect(df, "t", "id", "text").where("id = 'a'"), "protected_text", "placeholders").first()
    assert back.restored_text == SAMPLE and back.missing == []


def test_next_fit(spark):
    rng = random.Random(4)
    rows = [(t, i, rng.choice([1, 5, 20, 70])) for t in ("a", "b") for i in range(200)]
    got = packing.next_fit(spark.createDataFrame(rows, "task string, k int, n int"), "task", "k", "n", 60, 7).collect()
    for t in ("a", "b"):
        at, held, count, want = 1, 0, 0, {}
        for _, k, n in sorted(r for r in rows if r[0] == t):
            if count and (held + n > 60 or count >= 7):
                at, held, count = at + 1, 0, 0
            held, count = held + n, count + 1
            want[k] = at
        assert {r.k: r.package_index for r in got if r.task == t} == want


def test_next_fit_of_one_large_task(spark):
    """Zero sizes, rows over the bound, orders that are texts, and bytes that split packages; one task has nearly all rows."""
    rng = random.Random(14)
    rows = [("hot", f"{i:05d}", rng.choice([0, 0, 1, 9, 30, 200]), rng.randrange(1, 40)) for i in range(260)] + [(t, "00001", 5, 5) for t in "xyz"]
    df = spark.createDataFrame(rows, "task string, k string, n int, b int").repartition(5)
    for size, cap in ((100, 12), (0, 30)):
        got = {(r.task, r.k): r.package_index for r in packing.next_fit(df, "task", "k", "n", size, cap, "b", 90).collect()}
        at, part, held, count, heavy, current, want = 1, 0, 0, 0, 0, None, {}
        for t, k, n, b in sorted(rows):
            if t != current:
                at, held, count, heavy, current = 1, 0, 0, 0, t
            elif held + n > size or count >= cap:
                at, held, count, heavy = at + 1, 0, 0, 0
            elif heavy + b > 90:
                at, heavy = at + 1, 0
            held, count, heavy = held + n, count + 1, heavy + b
            want[t, k] = at
        assert got == want, (size, cap)
    assert packing.next_fit(df.limit(0), "task", "k", "n", 10).count() == 0


def test_oversize_row_is_an_error(spark):
    df = spark.createDataFrame([("a", 1, "x" * 200)], "task string, k int, text string")
    with pytest.raises(Exception, match="exceeds"):
        packing.refine_by_bytes(df, "task", "k", "text", 100).collect()


def test_matching(spark):
    cells = spark.createDataFrame([(["note", "R3", None, "text"],), (["none"],)], "cells array<string>")
    expected = F.array(F.lit("00000003"))
    got = cells.select(matching.key_cell(F.col("cells"), expected).alias("at"), "cells").select("at", matching.value_after(F.col("cells"), F.col("at"))).collect()
    assert [tuple(r) for r in got] == [(1, "text"), (None, None)]
    assert cells.select(matching.last_value(F.col("cells"))).first()[0] == "text"


def test_validation(spark):
    rows = [("a", "Version 2 of a long English sentence here", "版本 3"), ("b", "same", "same"), ("c", "some words", " "), ("d", "x", "xxxxxxxxx")]
    df = spark.createDataFrame(rows, "id string, source_text string, translated_text string")
    found = {(r.id, r.code) for r in validation.issues(df, ["id"]).collect()}
    assert {("a", "NUMBER_CHANGED"), ("b", "UNCHANGED_TEXT"), ("c", "EMPTY_TRANSLATION"), ("d", "ABNORMAL_LENGTH")} <= found
    assert not {("c", "UNCHANGED_TEXT"), ("a", "LOW_CHINESE_RATIO")} & found
    assert not any(c == "NUMBER_CHANGED" for _, c in {(r.id, r.code) for r in validation.issues(df, ["id"], False).collect()})


def test_spatial_against_brute_force(spark):
    rng = random.Random(5)
    boxes = [(p, i, x := rng.uniform(-100, 400), y := rng.uniform(-100, 400), x + rng.uniform(0, 150), y + rng.uniform(0, 90)) for p in (1, 2) for i in range(60)]
    df = spark.createDataFrame(boxes, "page int, box_id long, x0 double, y0 double, x1 double, y1 double")
    want = {(a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and min(a[4], b[4]) - max(a[2], b[2]) > 0.75 and min(a[5], b[5]) - max(a[3], b[3]) > 0.75}
    assert {(r.page, r.a, r.b) for r in spatial.overlap_pairs(df).collect()} == want
    clustered = spatial.clusters(df, 2.0).collect()
    assert sum(r.n for r in clustered) == 120 and all(sum(c.page == p for c in clustered) <= 16 for p in (1, 2))


def test_a_crowded_cell_is_dealt_to_many_tasks(spark):
    rng = random.Random(6)
    boxes = [(1, i, x := rng.uniform(0, 30), y := rng.uniform(0, 30), x + rng.uniform(0, 30), y + rng.uniform(0, 30)) for i in range(300)] + [(2, 7, 0.0, 0.0, 9.0, 9.0), (2, 8, 8.0, 8.0, 9.0, 9.0)]
    df = spark.createDataFrame(boxes, "page int, box_id long, x0 double, y0 double, x1 double, y1 double")
    want = sorted((a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and min(a[4], b[4]) - max(a[2], b[2]) > 0.75 and min(a[5], b[5]) - max(a[3], b[3]) > 0.75)
    got = spatial.overlap_pairs(df, block=30).select("page", "a", "b", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.page, r.a, r.b) for r in got) == want
    by_task = Counter(r.task for r in got)
    assert len(by_task) > 20 and max(by_task.values()) < len(got) / 5
    assert spatial.overlap_pairs(df.where("false")).count() == 0


def test_split_text_follows_shares():
    assert visual.split_text("沉积，然后抬升", ["slow sedimentation", "uplift"]) == ["沉积，", "然后抬升"]  # share ends at 5, the comma 2 before it
    assert visual.split_text("one two, three four", ["aaaaaaa", "bbbbbbbb"]) == ["one two,", "three four"]
    assert visual.split_text("  ", ["a", "b"]) == ["", ""] and visual.split_text(" x ", ["a"]) == [" x "]
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice("abc ,。x 漢") for _ in range(rng.randrange(1, 120)))
        sources = ["s" * rng.randrange(12) for _ in range(rng.randrange(2, 6))]
        parts, body = visual.split_text(text, sources), text.strip()
        if not body:
            continue
        # every place for each cut, by trial
        signs, at, want = [max(1, len(x)) for x in sources], 0, []
        for k in range(1, len(sources)):
            aim = max(at + 1, min(round(len(body) * sum(signs[:k]) / sum(signs)), len(body) - 1))
            tried = sorted((abs(p - aim), p) for p in range(at + 1, len(body)) if body[p - 1] in " ,，。！？!?；;：:、" and abs(p - aim) <= max(2, min(24, len(body) // 12)))
            to = tried[0][1] if tried else aim
            want.append(body[at:to].strip())
            at = to
        assert parts == [*want, body[at:].strip()]


def test_partition_takes_the_least_cost():
    """Against all ways to cut, with the costs counted part by part."""
    import itertools

    rng = random.Random(10)

    def cost(parts, sources):
        wide = lambda t: sum(map(visual.width_of, t))
        own = [visual.identifiers(s) for s in sources]
        all_, total = sum(max(0.5, wide(s)) for s in sources), max(0.5, sum(wide(t) for p in parts for t in p))
        c = 0.0
        for j, p in enumerate(parts):
            text = " ".join(p).casefold()
            c += 12 * abs(sum(map(wide, p)) / total - max(0.5, wide(sources[j])) / all_)
            for i, found in enumerate(own):
                for x in found:
                    if sum(x in f for f in own) > 1 or not any(x in t.casefold() for q in parts for t in q):
                        continue
                    if x in text:
                        c += -2 if i == j else 8
                    elif i == j:
                        c += 3
                    if i == j and sources[j].casefold().startswith(x) and not text.startswith(x):
                        c += 12
        return c

    words = ["K17", "ab", "旧部件", "R2D", "x", "9", "Longer", "WIDE"]
    for _ in range(150):
        tokens = [rng.choice(words) for _ in range(rng.randrange(2, 8))]
        sources = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(2, 5))]
        got = visual.partition_tokens(" ".join(tokens), sources)
        if len(tokens) < len(sources):
            assert got == []
            continue
        ways = [[tokens[a:b] for a, b in itertools.pairwise((0, *cuts, len(tokens)))] for cuts in itertools.combinations(range(1, len(tokens)), len(sources) - 1)]
        assert abs(cost([p.split() for p in got], sources) - min(cost(w, sources) for w in ways)) < 1e-9
    assert visual.partition_tokens("K17 泵 R2D 阀", ["K17 pump", "R2D valve"]) == ["K17 泵", "R2D 阀"]
    assert visual.partition_text("a b", ["short", "labels"]) == [] and visual.parts_of("完成。K3 开始", ["long text " * 9, "K3 begins " * 9]) == ["完成。", "K3 开始"]


def test_fitted_lines():
    size, lines = visual.fit_lines("新楼建于2031年", [45.0, 60.0], 10.0)
    assert "".join(lines) == "新楼建于2031年" and size <= 10.0


def test_fragments_in_tiers(spark):
    box = lambda *rows: spark.createDataFrame([(1, i, t, x, 0.0, x + 5, 5.0) for i, t, x in rows], "page int, box_id long, text string, x0 double, y0 double, x1 double, y1 double")
    segments = box((1, "alpha", 0.0), (2, "beta", 100.0), (3, "gamma", 200.0), (4, "delta", 300.0))
    fragments = box((10, "other", 1.0), (11, " alpha", 3.0), (12, "beta", 105.0))
    blocks = box((20, "alpha", 0.0), (21, "beta", 105.5), (22, "else", 201.0), (23, "delta", 320.0))
    got = {r.a: (r.tier, r.b) for r in spatial.matched_fragments(segments, fragments, blocks).collect()}
    assert got == {1: (1, 11), 2: (2, 21), 3: (3, 22)}


def test_clusters_by_brute_force(spark):
    """What is near through others, by the closure of nearness of unions, while no merging is needed."""
    rng = random.Random(21)
    rows = [(p, i, x := rng.uniform(0, 900), y := rng.uniform(0, 900), x + rng.uniform(1, 90), y + rng.uniform(1, 60)) for p in range(8) for i in range(12)]
    want = set()
    for p in range(8):
        parts = [((r[2], r[3], r[4], r[5]), 1) for r in rows if r[0] == p]
        while True:
            hit = next(((a, b) for a in parts for b in parts if a is not b and min(a[0][2], b[0][2]) - max(a[0][0], b[0][0]) >= -2 and min(a[0][3], b[0][3]) - max(a[0][1], b[0][1]) >= -2), None)
            if not hit:
                break
            a, b = hit
            parts = [x for x in parts if x is not a and x is not b] + [((min(a[0][0], b[0][0]), min(a[0][1], b[0][1]), max(a[0][2], b[0][2]), max(a[0][3], b[0][3])), a[1] + b[1])]
        assert len(parts) <= 16
        want |= {(p, k, n, *map(lambda v: round(v, 6), b)) for k, (b, n) in enumerate(sorted(parts, key=lambda x: (x[0][1], x[0][0])))}
    got = spatial.clusters(spark.createDataFrame(rows, "page int, box_id long, x0 double, y0 double, x1 double, y1 double"), 2.0).collect()
    assert {(r.page, r.cluster, r.n, *(round(r[c], 6) for c in ("x0", "y0", "x1", "y1"))) for r in got} == want


def test_labels_and_signs(spark):
    assert values(spark, T.fragmentary_label, "ab c de", "PUMP ROOM", "words", "a1") == [True, False, False, False]
    assert values(spark, T.short_label, "PUMP ROOM 2", "Pump room", "A B C D E F") == [True, False, False]
    assert values(spark, T.compact_label, "two words", "ends here!", "", "w " * 9) == [True, False, False, False]
    assert values(spark, T.compatible, "ＡＢ１\u3000ﬁn…", "é plain", None) == ["AB1 fin...", "é plain", None]
    assert values(spark, T.identifiers, "see www.x.example/a1, (R2-D2) and IBM; ok") == [["ibm", "r2-d2", "www.x.example/a1"]]
    assert values(spark, T.visual_length, "漢é 1!") == [1.0 + 0.55 + 0.25 + 0.55 + 0.45]


def test_continuity(spark):
    cases = [("It was built", "in one summer of work", True), ("They left.", "Another day began there", False), ("He asked: why", "Nobody knew the answer", True), ("the long trans-", "fer", True), ("PUMP ROOM", "and what stands in it", False), ("short", "words", False), ("She said so.”", "Then it all went quiet", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", T.continues(F.col("a"), F.col("b")).alias("got")).collect())
    assert not df.limit(1).select(T.continues(F.col("a"), F.col("b"), F.lit(10.0), F.lit(14.0))).first()[0]


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "k int, v string")
    assert {r.k: r.action for r in store.diff(old, new, ["k"], ["v"]).collect()} == {1: "unchanged", 2: "update", 3: "delete", 4: "insert"}
    assert [r.k for r in store.history_page(old, ["k"], 9, 2).collect()] == [3]


def test_saved_tables(spark, tmp_path):
    path = str(tmp_path / "segments")
    first = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "task string, k int, v string")
    assert {r.action: r["count"] for r in store.save(spark, path, first, ["task", "k"], "task").collect()} == {"insert": 3}
    second = spark.createDataFrame([("a", 1, "x"), ("a", 3, "n")], "task string, k int, v string")
    assert {r.action: r["count"] for r in store.save(spark, path, second, ["task", "k"], "task").collect()} == {"unchanged": 1, "insert": 1, "delete": 1}
    assert [(r.task, r.k) for r in store.load(spark, path, first.schema, "task", "a", "k").collect()] == [("a", 1), ("a", 3)]
    assert store.load(spark, path, first.schema, "task", "b", "k").count() == 1


def test_more_text_and_geometry(spark):
    assert values(spark, T.local_path, "'/a b/c'", r"/a\ b", "plain") == ["/a b/c", "/a b", "plain"]
    df = spark.createDataFrame([([(0.0, 0.0, 5.0, 5.0), (30.0, 6.0, 50.0, 11.0)],), ([(0.0, 0.0, 5.0, 5.0), (3.0, 6.0, 9.0, 11.0)],)], "b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert [r[0] for r in df.select(G.irregular(F.col("b"))).collect()] == [True, False]
    turned = df.select(G.corners(F.col("b")[0], F.lit(90.0)).alias("c")).first().c
    assert abs(turned[0].x - 5.0) < 1e-9 and abs(turned[0].y) < 1e-9


def test_pages_come_whole_from_any_batches():
    """Keys with nulls, pages longer than batches, batches that begin with a page, and empty ones."""
    rng = random.Random(16)
    keys = [(d, p) for d in (1, 2, None) for p in (1, 2, 3, None)]
    rows = [(d, p, i) for d, p in keys for i in range(rng.choice([1, 2, 9]))]
    frame = pd.DataFrame(rows, columns=["doc", "page", "i"])
    for size in (1, 2, 3, 7, 100):
        batches = [frame.iloc[a : a + size] for a in range(0, len(frame), size)]
        batches.insert(1, frame.iloc[:0])
        got = []
        for whole, starts in layout._by_page(iter(batches), ["doc", "page"]):
            ends = [*starts[1:], len(whole)]
            got += [whole.iloc[a:b][["doc", "page", "i"]] for a, b in zip(starts, ends)]
        assert len(got) == len(keys) and all(g["i"].tolist() == list(range(len(g))) for g in got)
        assert pd.concat(got, ignore_index=True).astype("float64").equals(frame.astype("float64"))
    assert list(layout._by_page(iter([]), ["doc"])) == []
