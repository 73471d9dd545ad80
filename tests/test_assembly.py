"""Paragraph assembly on pages made by hand, each for one rule, and what holds of any pages."""

import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import assembly

BLOCK = "doc int, page int, box_id long, text string, block_type string, is_table_cell boolean, rotation double, size double, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, column_id int"
OPEN, SMALL, CLOSED, CAPITAL = "a line that is open", "and goes on small", "It ends right here.", "Another one begins"


def at(top, text=OPEN, page=1, column=1, **other):
    """A block of height 10 and size 10 on a page of 600 by 1000, in the column's place."""
    left = other.pop("left", 40 + 180 * column)
    plain = {"doc": 0, "page": page, "box_id": None, "text": text, "block_type": "paragraph", "is_table_cell": False, "rotation": 0.0, "size": 10.0, "page_width": 600.0, "page_height": 1000.0, "x0": float(left), "y0": float(top), "x1": left + 150.0, "y1": top + 10.0, "column_id": column}
    return plain | other


#: What a page shows, its blocks, and the groups of their places in the list.
CASES = [
    ("an open line and a capital one close below", [at(0), at(15, CAPITAL)], [[0, 1]]),
    ("a capital line 0.7 sizes below an open one", [at(0), at(17, CAPITAL)], [[0], [1]]),
    ("a small line one size below", [at(0, CLOSED), at(20, SMALL)], [[0, 1]]),
    ("a small line 1.1 sizes below", [at(0), at(21, SMALL)], [[0], [1]]),
    ("a broken word 1.3 sizes below", [at(0, "a broken hyph-"), at(23, "en goes on")], [[0, 1]]),
    ("a broken word 1.4 sizes below", [at(0, "a broken hyph-"), at(24, "en goes on")], [[0], [1]]),
    ("a line that ends before a capital one", [at(0, CLOSED), at(12, CAPITAL)], [[0], [1]]),
    ("a colon ends a clause", [at(0, "as follows:"), at(12, CAPITAL)], [[0], [1]]),
    ("an item of a list", [at(0), at(12, "- an item")], [[0], [1]]),
    ("a numbered item of a list", [at(0), at(12, "2. second item")], [[0], [1]]),
    ("a footnote below a paragraph", [at(0), at(12, SMALL, block_type="footnote")], [[0], [1]]),
    ("footnotes among themselves", [at(0, block_type="footnote"), at(12, SMALL, block_type="footnote")], [[0, 1]]),
    ("headings stay alone", [at(0, block_type="heading"), at(12, SMALL, block_type="heading")], [[0], [1]]),
    ("an indent of 24, the page's 4 %", [at(0), at(12, SMALL, left=244)], [[0, 1]]),
    ("an indent of 25", [at(0), at(12, SMALL, left=245)], [[0], [1]]),
    ("a turned block", [at(0), at(12, SMALL, rotation=90.0)], [[0], [1]]),
    ("a turn of 4 degrees over the half circle", [at(0, rotation=178.0), at(12, SMALL, rotation=-178.0)], [[0, 1]]),
    ("sizes 10 and 11.5", [at(0), at(12, SMALL, size=11.5)], [[0, 1]]),
    ("sizes 10 and 16", [at(0), at(12, SMALL, size=16.0)], [[0], [1]]),
    ("lines that overlap a little", [at(0), at(7, SMALL)], [[0, 1]]),
    ("lines that overlap by half", [at(0), at(5, SMALL)], [[0], [1]]),
    ("a table cell between two lines is none of them", [at(0), at(12, SMALL, is_table_cell=True, column=-1, left=220), at(12, SMALL)], [[0, 2], [1]]),
    ("an empty line", [at(0), at(12, "")], [[0], [1]]),
    ("four lines in a row", [at(0), at(12, SMALL), at(24, SMALL), at(36, SMALL)], [[0, 1, 2, 3]]),
    ("order is by place, not by number", [at(24, SMALL), at(0), at(12, SMALL)], [[1, 2, 0]]),
    ("a left column's foot and a right one's head", [at(570), at(410, SMALL, column=2)], [[0, 1]]),
    ("a left column that ends above 58 %", [at(560), at(410, SMALL, column=2)], [[0], [1]]),
    ("a right column that begins below 42 %", [at(570), at(430, SMALL, column=2)], [[0], [1]]),
    ("a right column's foot before a left one's head", [at(410, SMALL), at(570, column=2)], [[0], [1]]),
    ("the lowest piece goes on, in the highest one", [at(600), at(900), at(300, SMALL, column=2), at(100, SMALL, column=2)], [[0], [1, 3], [2]]),
    ("a label of capitals goes on nowhere", [at(900, "PUMP ROOM"), at(100, SMALL, column=2)], [[0], [1]]),
    ("a text of fewer than eight signs", [at(900), at(100, "of it", column=2)], [[0], [1]]),
    ("a short rest of a broken word", [at(900, "a broken hyph-"), at(100, "en", column=2)], [[0, 1]]),
    ("a heading is no foot", [at(900, block_type="heading"), at(100, SMALL, column=2)], [[0], [1]]),
    ("through three columns", [at(900), at(100, SMALL, column=2), at(112, SMALL, column=2), at(600, SMALL, column=2), at(100, SMALL, column=3)], [[0, 1, 2], [3, 4]]),
    ("a whole column passed through", [at(900), *[at(10 + 12 * i, SMALL, column=2) for i in range(60)], at(100, SMALL, column=3)], [[0, *range(1, 61)], [61]]),
    ("the foot of one page and the head of the next", [at(720, column=1), at(270, SMALL, page=2)], [[0, 1]]),
    ("a foot above 72 %", [at(700), at(270, SMALL, page=2)], [[0], [1]]),
    ("a head below 28 %", [at(720), at(290, SMALL, page=2)], [[0], [1]]),
    ("a page between", [at(900), at(100, SMALL, page=3)], [[0], [1]]),
    ("over three pages", [at(900), at(20, SMALL, page=2), *[at(32 + 12 * i, SMALL, page=2) for i in range(60)], at(20, SMALL, page=3)], [[0, *range(1, 63)]]),
    ("an ended sentence and a capital head", [at(900, CLOSED), at(20, CAPITAL, page=2)], [[0], [1]]),
    ("an ended sentence and a small head", [at(900, CLOSED), at(20, SMALL, page=2)], [[0, 1]]),
    ("a footnote below the foot does not count", [at(800), at(950, block_type="footnote"), at(20, SMALL, page=2)], [[0, 2], [1]]),
]


def grouped(spark, blocks):
    rows = [tuple(b[c.split()[0]] for c in BLOCK.split(", ")) for b in blocks]
    return {(r.doc, r.page, r.box_id): (r.doc, r.group_page, r.group_id) for r in assembly.assemble(spark.createDataFrame(rows, BLOCK)).collect()}


def numbered(blocks):
    seen: dict = {}
    for b in blocks:
        if b["box_id"] is None:
            b["box_id"] = seen[b["doc"], b["page"]] = seen.get((b["doc"], b["page"]), -1) + 1
    return blocks


@pytest.fixture(scope="module")
def by_hand(spark):
    """All cases in one table, a document each."""
    blocks = [numbered([b | {"doc": i} for b in own]) for i, (_, own, _) in enumerate(CASES)]
    return blocks, grouped(spark, [b for own in blocks for b in own])


@pytest.mark.parametrize("case", range(len(CASES)), ids=[c[0].replace(" ", "_") for c in CASES])
def test_rule(by_hand, case):
    own, got = by_hand[0][case], by_hand[1]
    key = lambda b: (b["doc"], b["page"], b["box_id"])
    want = {key(own[i]): key(own[group[0]]) for group in CASES[case][2] for i in group}
    assert {k: v for k, v in got.items() if k[0] == case} == want


def test_of_any_pages(spark):
    """Every block is in one group, named by a member; what must stand alone does; groups hold runs of columns and
    neighbouring pages, of one kind and turn."""
    rng = random.Random(31)
    texts = [OPEN, SMALL, CLOSED, CAPITAL, "broken hyph-", "PUMP ROOM", "- an item", "short", ""]
    blocks = []
    for doc in range(25):
        for page in range(1, 6):
            tops = {}
            for _ in range(rng.randrange(1, 9)):
                cell, kind = rng.random() < 0.05, rng.choice(["paragraph"] * 6 + ["footnote", "heading"])
                column = -1 if cell else 0 if kind == "heading" else rng.choice([1, 2, 2, 3])
                tops[column] = top = tops.get(column, rng.choice([5.0, 800.0])) + rng.choice([12.0, 14.0, 19.0, 60.0])
                blocks.append(at(top, rng.choice(texts), page, column, doc=doc, block_type=kind, is_table_cell=cell, rotation=rng.choice([0.0] * 9 + [90.0])))
    blocks = numbered(blocks)
    got = grouped(spark, blocks)
    known = {(b["doc"], b["page"], b["box_id"]): b for b in blocks}
    assert got.keys() == known.keys() and all(got[head] == head for head in got.values())
    groups: dict = {}
    for k, head in got.items():
        groups.setdefault(head, []).append(known[k])
    assert sum(len(g) > 1 for g in groups.values()) > 30 and any(len({b["page"] for b in g}) > 1 for g in groups.values())
    for g in groups.values():
        pages, columns = sorted({b["page"] for b in g}), {(b["page"], b["column_id"]) for b in g}
        assert pages == list(range(pages[0], pages[-1] + 1))
        assert len(g) == 1 or not any(b["is_table_cell"] or b["block_type"] == "heading" or not b["text"] for b in g)
        assert len({(b["block_type"], b["rotation"]) for b in g}) == 1
        for page, column in columns if len(g) > 1 else ():
            order = sorted((b for b in blocks if (b["doc"], b["page"], b["column_id"]) == (g[0]["doc"], page, column) and b["block_type"] in assembly.MERGED), key=lambda b: (b["y0"], b["x0"], b["box_id"]))
            places = [i for i, b in enumerate(order) if b in g]
            assert places == list(range(places[0], places[-1] + 1))


def test_texts_do_not_travel(spark):
    """Of 4 MB of texts that do not compress, the stored steps hold little, and no shuffle within columns holds any."""
    text = F.concat(F.lit("small "), *[F.sha2(F.concat_ws(":", "id", F.lit(i)), 512) for i in range(160)])
    plain = {k: v for k, v in at(0).items() if k not in ("doc", "page", "box_id", "text", "y0", "y1", "column_id")}
    blocks = spark.range(200).select(F.lit(0).alias("doc"), (F.col("id") % 4).cast("int").alias("page"), F.col("id").alias("box_id"), text.alias("text"), *[F.lit(v).alias(k) for k, v in plain.items()], (F.col("id") * 3.0).alias("y0"), (F.col("id") * 3.0 + 10).alias("y1"))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True))
    before = size()
    assert assembly.assemble(blocks).count() == 200
    assert 0 < size() - before < 100_000
    runs = assembly.in_columns(blocks.withColumn("column_id", F.lit(1))).select("doc", "page", "box_id", "piece")
    plan = runs._jdf.queryExecution().explainString(runs.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    dealt = [node for node in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", node)]
    assert dealt and not any("text#" in node for node in dealt)


def test_a_block_of_no_document_stays(spark):
    """A block whose document or page is null is in a paragraph of its column; no step loses it."""
    rows = [at(0, doc=None, box_id=0), at(12, SMALL, doc=None, box_id=1), at(0, page=None, box_id=0), at(0, box_id=0)]
    table = spark.createDataFrame([tuple(b[c.split()[0]] for c in BLOCK.split(", ")) for b in rows], BLOCK)
    want = {(None, 1, 0, 1, 0), (None, 1, 1, 1, 0), (0, None, 0, None, 0), (0, 1, 0, 1, 0)}
    for blocks in (table, table.drop("column_id")):
        assert {(r.doc, r.page, r.box_id, r.group_page, r.group_id) for r in assembly.assemble(blocks).collect()} == want


def test_marks_stand_for_texts(spark):
    """What goes on with what is the same by marks as by texts."""
    texts = [OPEN, SMALL, CLOSED, CAPITAL, "a broken hyph-", "PUMP ROOM", "- an item", "short", "", " ", None, "12 345 678", "as follows:", "éclair und mehr", "soft\xad-", "A" * 31]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    marks = [T.marked(T.marks(T.squeeze(F.col(c)))) for c in "ab"]
    got = pairs.select(T.continues(F.col("a"), F.col("b")).alias("by_text"), T.follows(*marks).alias("by_marks")).collect()
    assert all(bool(r.by_text) == r.by_marks for r in got) and 20 < sum(r.by_marks for r in got) < 200
