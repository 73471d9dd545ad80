"""Paragraphs from blocks: within a column, across columns and across pages.

Blocks have doc, page, box_id, text, block_type, is_table_cell, rotation, size (median font size), page_width, page_height
and, in reading axes, x0, y0, x1, y1; box_id is their order on the page. All limits are fixed values. Of a text only its marks
(functions.text.marks) travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators.layout import assign_columns, islands
from pagemill.operators.store import stored

MERGED = ("paragraph", "footnote")
PAGE = ["doc", "page"]
#: What the steps read of a block besides its place on the page and its marks.
READ = ("block_type", "is_table_cell", "rotation", "size", "page_width", "page_height", "x0", "y0", "x1", "y1")


def with_marks(blocks: DataFrame) -> DataFrame:
    """blocks with the marks of their texts, each squeezed once."""
    return blocks.withColumn("squeezed__", T.squeeze(F.col("text"))).withColumn("marks", T.marks(F.col("squeezed__"))).drop("squeezed__")


def joins_above(lag) -> Column:
    """Whether a block goes on from the one above it in its column; lag gives that one's value of a column."""
    base = F.greatest("size", lag("size"), F.lit(1.0))
    gap = F.col("y0") - lag("y1")
    place = (F.abs(F.col("x0") - lag("x0")) <= F.greatest(F.lit(14.0), F.col("page_width") * 0.04)) & gap.between(-0.4 * base, 1.35 * base)
    style = (F.col("block_type") == lag("block_type")) & (G.turned_apart(F.col("rotation"), lag("rotation")) <= 5.0) & T.similar_size(F.col("size"), lag("size"))
    above, text = T.marked(lag("marks")), T.marked(F.col("marks"))
    goes_on = (text["small"] & (above["hyphen"] | (gap <= base))) | (~above["clause"] & (gap <= 0.65 * base))
    return style & place & above["some"] & text["some"] & ~text["item"] & goes_on


def in_columns(blocks: DataFrame) -> DataFrame:
    """blocks (with column_id) and `piece`: the box_id of the first block of each run of a column. Only the block right
    above counts, so a lag decides; tables and blocks of other types stand alone. Blocks may have their marks already."""
    own = blocks if "marks" in blocks.columns else with_marks(blocks)
    free = F.col("block_type").isin(*MERGED) & ~F.col("is_table_cell")
    w = Window.partitionBy(*PAGE, "column_id", "free__").orderBy("y0", "x0", "box_id")
    opens = ~F.coalesce(F.col("free__") & joins_above(lambda c: F.lag(c).over(w)), F.lit(False))
    begun = own.withColumn("free__", free).withColumn("opens__", opens)
    last = F.last(F.when(F.col("opens__"), F.col("box_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("piece", last).select(*blocks.columns, "piece")


def pieces(runs: DataFrame) -> DataFrame:
    """(doc, page, column_id, piece, at, boxes, first, last): each run with its least box_id, all of them, and what the next
    steps read of its first and its last block."""
    block = F.struct("box_id", "y0", "y1", "block_type", "is_table_cell", "rotation", "size", "page_height", "marks")
    place = F.struct("y0", "x0", "box_id")
    return runs.groupBy(*PAGE, "column_id", "piece").agg(F.min("box_id").alias("at"), F.collect_list("box_id").alias("boxes"), F.min_by(block, place).alias("first"), F.max_by(block, place).alias("last"))


def _goes_on(a: Column, b: Column, bottom: float, top: float) -> Column:
    """Paragraph a, which ends in the lower part of its page, goes on with b, which begins in the upper part of its own."""
    kinds = (a["block_type"] == "paragraph") & (b["block_type"] == "paragraph") & ~a["is_table_cell"] & ~b["is_table_cell"]
    place = (a["y1"] >= a["page_height"] * bottom) & (b["y0"] <= b["page_height"] * top)
    return kinds & place & (G.turned_apart(a["rotation"], b["rotation"]) <= 5.0) & T.follows(T.marked(a["marks"]), T.marked(b["marks"]), a["size"], b["size"])


def across_columns(found: DataFrame) -> DataFrame:
    """(doc, page, links): the pieces of each page that go on from another one, each with that one as its head; pages
    without any are missing.

    Columns with a paragraph are gone through in pairs: the piece that ends lowest in the left one goes on with the one that
    begins highest in the right one. A piece taken so is no longer of its column, and what took it ends where it ends; so the
    pairs are decided in turn, over the few ends of columns of a page alone: all steps are within a page, which is dealt once.
    """
    column = Window.partitionBy(*PAGE, "column_id")
    ranked = found.where("column_id > 0").select(
        *PAGE, "column_id", "piece", "first", "last",
        F.row_number().over(column.orderBy("first.y0", "at")).alias("top"), F.row_number().over(column.orderBy(F.desc("last.y1"), "at")).alias("foot"),
    )
    top, foot = F.struct("piece", "first"), F.struct("piece", "last")
    # For each column the piece on top, the lowest one, and the lowest one but for that on top, which the pair before may take.
    ends = ranked.groupBy(*PAGE, "column_id").agg(
        F.max(F.col("first.block_type") == "paragraph").alias("opens"), F.max(F.when(F.col("top") == 1, top)).alias("top"),
        F.max(F.when(F.col("foot") == 1, foot)).alias("a"), F.max(F.when((F.col("foot") <= 2) & (F.col("top") > 1), F.struct((-F.col("foot")).alias("k"), foot.alias("end")))).alias("else"),
    ).where("opens").withColumn("a_else", F.col("else.end"))
    pairs = ends.withColumn("b", F.lead("top").over(Window.partitionBy(*PAGE).orderBy("column_id"))).where("b is not null")
    decided = pairs.select(*PAGE, "column_id", F.col("a.piece").alias("a"), F.col("a_else.piece").alias("a_else"), F.col("b.piece").alias("b"), *[F.coalesce(_goes_on(F.col(f"{a}.last"), F.col("b.first"), 0.58, 0.42), F.lit(False)).alias(out) for a, out in (("a", "plain"), ("a_else", "otherwise"))])

    kind = dict(found.dtypes)["piece"]

    def settle(state: Column, pair: Column) -> Column:
        """The pairs in turn; the state holds what the last one took, and all that was taken with its head."""
        lost = state["taken"].eqNullSafe(pair["a"])
        fine = F.when(lost, pair["otherwise"]).otherwise(pair["plain"])
        link = F.struct(pair["b"].alias("piece"), F.when(lost, pair["a_else"]).otherwise(pair["a"]).alias("head"))
        return F.struct(F.when(fine, pair["b"]).alias("taken"), F.when(fine, F.concat(state["links"], F.array(link))).otherwise(state["links"]).alias("links"))

    start = F.struct(F.lit(None).cast(kind).alias("taken"), F.array().cast(f"array<struct<piece:{kind},head:{kind}>>").alias("links"))
    inside = F.array_sort(F.collect_list(F.struct("column_id", "a", "a_else", "plain", "otherwise", "b")))  # a row for each two columns of a page
    return decided.groupBy(*PAGE).agg(F.aggregate(inside, start, settle)["links"].alias("links")).where(F.size("links") > 0)


def _head(links: str, piece: str) -> Column:
    """The head of a piece by its page's links; null if it goes on from none."""
    return F.get(F.filter(links, lambda x: x["piece"] == F.col(piece)), F.lit(0))["head"]


def page_ends(found: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, page, a, b): of each page the group that ends lowest, with its last block, and the one that begins highest, with
    its first; null where there is no paragraph. A group is a piece, or two that a link joins: no piece is linked twice on
    one side, and none on both."""
    own = found.select(*PAGE, "piece", "first", "last").join(links, PAGE, "left").withColumn("head", _head("links", "piece"))
    goes_on = F.coalesce(F.exists("links", lambda x: x["head"] == F.col("piece")), F.lit(False))
    ends = ~goes_on & (F.col("last.block_type") == "paragraph")
    begins = F.col("head").isNull() & (F.col("first.block_type") == "paragraph")
    a, b = F.struct(F.coalesce("head", "piece").alias("piece"), "last"), F.struct("piece", "first")
    return own.groupBy(*PAGE).agg(F.max_by(a, F.when(ends, F.struct("last.y1", "last.box_id"))).alias("a"), F.min_by(b, F.when(begins, F.struct("first.y0", "first.box_id"))).alias("b"))


def across_pages(ends: DataFrame) -> DataFrame:
    """(doc, page, to_, root_page, root) of page_ends: where the group begins that a page's group to_ goes on from. Of each
    page the group that ends lowest may go on with the one that begins highest on the next page."""
    before = ends.select("doc", (F.col("page") + 1).alias("page"), "a")
    links = before.join(ends.select(*PAGE, "b"), PAGE).where(_goes_on(F.col("a.last"), F.col("b.first"), 0.72, 0.28))
    links = links.select(*PAGE, F.col("a.piece").alias("from_"), F.col("b.piece").alias("to_"))
    w = Window.partitionBy("doc").orderBy("page")  # a row for each page that a paragraph crosses into
    goes = (F.lag("page").over(w) == F.col("page") - 1) & (F.lag("to_").over(w) == F.col("from_"))
    chains = islands(links, ["doc"], ["page"], ~goes, "chain__")
    v = Window.partitionBy("doc", "chain__").orderBy("page")
    return chains.select(*PAGE, "to_", (F.first("page").over(v) - 1).alias("root_page"), F.first("from_").over(v).alias("root"))


def assemble(blocks: DataFrame) -> DataFrame:
    """(doc, page, box_id, column_id, group_page, group_id): for each block the page and the first block of its paragraph.

    Columns are assigned, blocks joined within them, then pieces across columns, then groups across pages. Groups are read in
    the order of their least box_id, then from the top and the left (order_groups). Blocks are dealt twice, by page and
    without their texts; from then on a row is a piece, a page or a crossing, and all steps but the last are within a page.
    Pieces and what is found of pages are stored on the way.
    """
    narrow = with_marks(blocks)
    if "column_id" in blocks.columns:
        own = narrow.select(*PAGE, "box_id", *READ, "marks", "column_id")
    else:
        own = assign_columns(narrow, keys=tuple(PAGE), carried=(*READ, "marks"))
    single = stored(pieces(in_columns(own.repartition(*PAGE))), "pieces")
    links = stored(across_columns(single), "links")
    roots = across_pages(stored(page_ends(single, links), "ends"))
    of_pages = links.join(roots, PAGE, "full_outer")
    placed = single.select(*PAGE, "column_id", "piece", "boxes").join(of_pages, PAGE, "left").withColumn("head", F.coalesce(_head("links", "piece"), "piece"))
    goes_on = F.col("head") == F.col("to_")
    group = (F.when(goes_on, F.col("root_page")).otherwise(F.col("page")).alias("group_page"), F.when(goes_on, F.col("root")).otherwise(F.col("head")).alias("group_id"))
    return placed.select(*PAGE, F.explode("boxes").alias("box_id"), "column_id", *group)


def order_groups(groups: DataFrame) -> DataFrame:
    """groups (doc, page, piece, at, first) with reading_order on their page, from 1: by least box_id, top and left edge."""
    w = Window.partitionBy("doc", "page").orderBy("at", "first.y0", "first.x0")
    return groups.withColumn("reading_order", F.row_number().over(w).cast("bigint"))
