"""From lines and blocks to paragraphs and segments."""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T


def classify(text: Column, largest: Column, size: Column, page_median: Column, top: Column, bottom: Column, page: Column, order: Column) -> Column:
    """The type of a block by its place (top and bottom as shares of the page's height), its largest and median font size
    against the page's median, and its order on the first page. The thresholds are fixed values."""
    text = F.trim(text)
    return (
        F.when(text.rlike(r"(?i)^(page\s*)?\d+(\s*/\s*\d+)?$") & ((top < 0.08) | (bottom > 0.92)), "page_number")
        .when(text.rlike(r"(?i)^(figure|fig\.|table)\s+\d+"), "caption")
        .when((page == 1) & (order <= 3) & (largest >= F.greatest(F.lit(16.0), page_median * 1.55)), "title")
        .when((F.length(text) <= 180) & (largest >= F.greatest(F.lit(12.0), page_median * 1.25)), "heading")
        .when(top < 0.035, "header")
        .when(bottom > 0.965, "footer")
        .when((bottom > 0.82) & (size < page_median * 0.9), "footnote")
        .otherwise("paragraph")
    )


def repeated_marginals(lines: DataFrame, share: float = 0.35, most: int = 200) -> DataFrame:
    """(doc, text, n): lines of up to `most` signs that stand at least max(2, ceil(share * pages)) times in a document.

    Two aggregates on (doc, text) and doc, no window: a document's size does not matter.
    """
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    found = lines.where((F.col("line") != "") & (F.length("line") <= most)).groupBy("doc", T.casefold(F.col("line")).alias("text")).agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(2), F.ceil(F.lit(share).cast("double") * F.col("pages").cast("double")).cast("bigint"))
    return found.join(pages, "doc").where(F.col("n") >= least).select("doc", "text", "n")


def relabel_marginals(lines: DataFrame, marginals: DataFrame) -> DataFrame:
    """lines with a role: header or footer (by the half of the page) where the text repeats, else body."""
    counts = lines.groupBy("page").agg(F.count("*").alias("page_lines"))
    known = marginals.select(F.col("doc").alias("doc__"), F.col("text").alias("marginal"))
    joined = lines.join(counts, "page").join(known, (F.col("doc") == F.col("doc__")) & (T.casefold(F.col("line")) == F.col("marginal")), "left")
    role = F.when(F.col("marginal").isNull(), "body").when(F.col("line_no") * 2 < F.col("page_lines"), "header").otherwise("footer")
    return joined.select("doc", "page", "line_no", "line", role.alias("role"))


def mark_repeated(blocks: DataFrame, share: float = 0.35, most: int = 200) -> DataFrame:
    """blocks (doc, page, text, block_type, top) in whose documents a text that stands in header and footer blocks at least
    max(2, ceil(share * pages)) times makes every block of that text one: a header above half the page, else a footer.

    Only texts of up to `most` signs count; they are compared squeezed and without regard to case. Pages are those with
    blocks. What is counted is aggregated before the shuffle, a row for each text of a document; the blocks meet these rows
    by document and a hash of the text, which is compared then, so that no text is a key of its own length.
    """
    squeezed = T.casefold(T.squeeze(F.col("text")))
    own = blocks.withColumns({"text__": squeezed, "h__": F.xxhash64(squeezed)})
    marginal = F.col("block_type").isin("header", "footer")
    pages = own.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    found = own.where(marginal & (F.length("text") <= most)).groupBy("doc", "h__", "text__").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(2), F.ceil(F.lit(share) * F.col("pages")).cast("bigint"))
    repeated = found.join(pages, found["doc"].eqNullSafe(pages["doc"])).where(F.col("n") >= least)
    repeated = repeated.select(found["doc"].alias("doc__"), F.col("h__").alias("k__"), F.col("text__").alias("known__"))
    same = F.col("doc").eqNullSafe(F.col("doc__")) & (F.col("h__") == F.col("k__")) & (F.col("text__") == F.col("known__"))
    joined = own.join(repeated, same, "left").drop("doc__", "h__", "k__", "text__")
    role = F.when(F.col("top") < 0.5, "header").otherwise("footer")
    return joined.withColumn("block_type", F.when(marginal | F.col("known__").isNull(), F.col("block_type")).otherwise(role)).drop("known__")


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, out: str) -> DataFrame:
    """Numbers from 1 for runs of rows in order; a row at which `breaks` holds (or is null) starts a new run. The column
    may refer to the row before as F.lag over the same window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("break__", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(out, F.sum("break__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("break__")


def merge_lines(lines: DataFrame) -> DataFrame:
    """lines (page, line_no, line) with the paragraph each belongs to: it goes on while `continues` holds."""
    w = Window.partitionBy("page").orderBy("line_no")
    own = lines.withColumn("own__", T.squeeze(F.col("line")))  # once a line: the next one reads it by lag
    return islands(own, ["page"], ["line_no"], ~T.continues(F.lag("own__").over(w), F.col("own__"), squeezed=True), "paragraph").drop("own__")


def paragraphs(merged: DataFrame) -> DataFrame:
    """(page, paragraph, text, n_lines): lines joined by blanks; a hyphen before a small letter is dropped with the break."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.col("parts"), "\n"), r"-\n(?=\p{Ll})", ""), "\n", " ")
    return merged.groupBy("page", "paragraph").agg(parts.alias("parts")).select("page", "paragraph", text.alias("text"), F.size("parts").cast("bigint").alias("n_lines"))


def segments(paras: DataFrame, stable_keys: bool = False) -> DataFrame:
    """Ids by page and order, the translatable flag, and row keys: the id, or a running number over translatable rows.

    The running number is taken over page totals first, so that no window spans more than a page.
    """
    w = Window.partitionBy("page").orderBy("paragraph")
    seg = paras.withColumns({"reading_order": F.row_number().over(w).cast("bigint"), "should_translate": T.translatable(F.col("text"))})
    seg = seg.withColumn("segment_id", F.format_string("P%04d-S%06d", F.col("page"), F.col("reading_order")))
    if stable_keys:
        return seg.withColumn("row_key", F.when(F.col("should_translate"), F.col("segment_id")).otherwise(""))
    before = running_offset(seg.groupBy("page").agg(F.sum(F.col("should_translate").cast("bigint")).alias("n")), "page", "n")
    rank = F.sum(F.col("should_translate").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = seg.withColumn("rank__", rank).join(before, "page")
    key = F.when(F.col("should_translate"), F.lpad((F.col("rank__") + F.col("before")).cast("string"), 8, "0")).otherwise("")
    return numbered.withColumn("row_key", key).drop("rank__", "before", "n")


def running_offset(totals: DataFrame, key: str, n: str, span: int = 4096) -> DataFrame:
    """(key, n, before): the sum of n over all smaller keys. Keys are integers; a window spans `span` of them, and the
    windows' sums are taken in turn."""
    w = Window.partitionBy("block__").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.withColumn("block__", F.floor(F.col(key) / span)).withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)))
    outer = Window.orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    blocks = inner.groupBy("block__").agg(F.sum(n).alias("m")).withColumn("shift__", F.coalesce(F.sum("m").over(outer), F.lit(0)))
    return inner.join(blocks.drop("m"), "block__").select(key, n, (F.col("before") + F.col("shift__")).alias("before"))


def dominant_rotation(lines: DataFrame) -> DataFrame:
    """(page, rotation, weight): the 5-degree bucket with most text; ties go to the smaller angle."""
    each = lines.groupBy("page", (F.bround(F.col("rotation") / 5) * 5).alias("angle")).agg(F.sum(F.greatest(F.length("line"), F.lit(1))).cast("bigint").alias("weight"))
    return each.groupBy("page").agg(F.max_by("angle", F.struct("weight", -F.col("angle"))).alias("rotation"), F.max("weight").alias("weight"))


def font_islands(spans: DataFrame) -> DataFrame:
    """Spans (page, line_no, size) with the fragment each belongs to: a size differs by more than max(2, 25 %)."""
    w = Window.partitionBy("page").orderBy("line_no")
    before = F.lag("size").over(w)
    return islands(spans, ["page"], ["line_no"], F.abs(F.col("size") - before) > F.greatest(F.lit(2.0), 0.25 * F.greatest(F.col("size"), before)), "fragment")


def interval_islands(boxes: DataFrame, gap: float = 1.5) -> DataFrame:
    """Boxes merged along x within a page while they overlap or lie at most `gap` apart: (page, cell, n, x0, x1)."""
    w = Window.partitionBy("page").orderBy("x0", "x1", "box_id")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cells = islands(boxes.withColumn("reach__", reach), ["page"], ["x0", "x1", "box_id"], F.col("x0") > F.col("reach__") + gap, "cell")
    return cells.groupBy("page", "cell").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def running(df: DataFrame, keys: list[str], order: str, value: Column, out: str, span: int = 4096) -> DataFrame:
    """df with the sum of value (a whole number) over the rows of its keys up to and with its own, by the whole number
    `order`. In two steps, so that no window is longer than `span` orders or the number of such spans."""
    own = df.withColumns({"block__": F.floor(F.col(order) / span), "value__": value.cast("bigint")})
    sums = own.groupBy(*keys, "block__").agg(F.sum("value__").alias("sum__"))
    before = F.coalesce(F.sum("sum__").over(Window.partitionBy(*keys).orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "block__", before.alias("earlier__"))
    inner = F.sum("value__").over(Window.partitionBy(*keys, "block__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn(out, inner).join(sums, [*keys, "block__"]).withColumn(out, F.col(out) + F.col("earlier__")).drop("block__", "value__", "earlier__")


def page_chains(pages: DataFrame, bottom: str | None = None, top: str | None = None) -> DataFrame:
    """pages (doc, page, first_text, last_text) with a chain number: a page whose first paragraph goes on from the last
    one of the page before (consecutive pages only) belongs to its chain. Where the columns are named, the last
    paragraph must end below 72 % of its page (bottom) and the first begin above 28 % of its own (top)."""
    low = F.col(bottom) if bottom else F.lit(1.0)
    before = pages.select("doc", (F.col("page") + 1).alias("page"), F.col("last_text").alias("before__"), low.alias("low__"))
    linked = T.continues(F.col("before__"), F.col("first_text")) & (F.col("low__") >= 0.72)
    linked = linked & (F.col(top) <= 0.28) if top else linked
    starts = pages.join(before, ["doc", "page"], "left").withColumn("starts__", (~F.coalesce(linked, F.lit(False))).cast("int"))
    return running(starts, ["doc"], "page", F.col("starts__"), "chain").drop("before__", "low__", "starts__")


def ocr_lines(words: DataFrame, least: float = 0.35) -> DataFrame:
    """Recognized lines in page points: empty texts and confidences below `least` go; the normalized box (origin at the
    bottom left) is mapped into the placed rectangle (rx0, ry0, rx1, ry1), rounded to two places."""
    w, h = F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0")
    kept = words.where((F.trim("text") != "") & (F.col("confidence") >= least))
    return kept.withColumns({
        "x0": F.round(F.col("rx0") + F.col("x") * w, 2),
        "y0": F.round(F.col("ry0") + (1 - F.col("y") - F.col("height")) * h, 2),
        "x1": F.round(F.col("rx0") + (F.col("x") + F.col("width")) * w, 2),
        "y1": F.round(F.col("ry0") + (1 - F.col("y")) * h, 2),
    })


def group_ocr_lines(lines: DataFrame) -> DataFrame:
    """(page, block, text, x0, y0, x1, y1, font_size, block_type, confidence) of lines (page, line_no, text, confidence,
    page_width and the box): a horizontal line (its width 1.2 heights or more) joins the one before if their left edges
    are near, it goes downwards with a gap of at most 1.8 heights, heights are similar and both or neither look like a
    heading. Vertical lines follow, each for itself. The limits are fixed values."""
    h = F.col("y1") - F.col("y0")
    own = lines.withColumns({"h": h, "upright": (F.col("x1") - F.col("x0")) < 1.2 * h, "heading": T.looks_like_heading(F.col("text"))})
    w = Window.partitionBy("page").orderBy("upright", "line_no")
    lag = lambda c: F.lag(c).over(w)
    near = F.abs(F.col("x0") - lag("x0")) <= F.greatest(F.lit(14.0), F.col("page_width") * 0.065)
    follows = (F.col("y0") >= lag("y0") - 1.0) & (F.col("y0") - lag("y1") <= 1.8 * F.greatest("h", lag("h")))
    alike = (F.greatest("h", lag("h")) / F.greatest(F.least("h", lag("h")), F.lit(0.1)) < 1.55) & (F.col("heading") == lag("heading"))
    blocks = islands(own, ["page"], ["upright", "line_no"], ~(~F.col("upright") & near & follows & alike), "block")
    typical = own.where("not upright").groupBy("page").agg(F.median("h").alias("typical"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    found = blocks.groupBy("page", "block").agg(text.alias("text"), *box, F.avg("h").alias("h"), F.round(F.avg("confidence"), 3).alias("confidence"), F.first("upright").alias("upright")).join(typical, "page", "left")
    capitals = F.regexp_count("text", F.lit(r"\p{Lu}")) / F.greatest(T.letters(F.col("text")), F.lit(1))
    kind = F.when(F.col("text").rlike(r"^\d{1,5}$"), "page_number").when((F.col("h") >= 2.1 * F.coalesce("typical", F.lit(8.0))) & (F.length("text") <= 100), "title").when((capitals > 0.72) & (F.length("text") <= 120), "heading").when(F.col("upright"), "other").otherwise("paragraph")
    return found.select("page", "block", "text", "x0", "y0", "x1", "y1", F.round(F.greatest(F.lit(7.5), F.col("h") * 0.9), 2).alias("font_size"), kind.alias("block_type"), "confidence")


def rotated_lines(lines: DataFrame) -> DataFrame:
    """lines (block, line_no, rotation) with the fragment each belongs to in its block: each its own where the dominant
    rotation (that of most text) or any line's distance to it is 5 degrees or more; else all of the block in one."""
    weights = lines.groupBy("block", "rotation").agg(F.sum(F.greatest(F.length("line"), F.lit(1))).alias("weight"))
    main = weights.groupBy("block").agg(F.max_by("rotation", F.struct("weight", -F.col("rotation"))).alias("main"))
    apart = F.abs(F.pmod(F.col("rotation") - F.col("main") + 180.0, F.lit(360.0)) - 180.0)
    turned = lines.join(main, "block").groupBy("block").agg((F.max(F.greatest(apart, F.abs("main"))) >= 5.0).alias("turned"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("line_no"))
    return lines.join(turned, "block").withColumn("fragment", F.when(F.col("turned"), rank).otherwise(1).cast("bigint")).drop("turned")


class _Edges:
    """The left and right edges of a column's blocks, sorted, for each rotation among them."""

    def __init__(self):
        self.of: dict[float, tuple[list, list]] = {}

    def add(self, turn: float, left: float, right: float) -> None:
        lefts, rights = self.of.setdefault(turn, ([], []))
        bisect.insort(lefts, left)
        bisect.insort(rights, right)

    def medians(self, turn: float | None) -> tuple[float, float] | None:
        """Of the blocks within five degrees (or of all, without a turn); none without any."""
        alike = [e for t, e in self.of.items() if turn is None or abs((turn - t + 180) % 360 - 180) <= 5]
        if not alike:
            return None
        lefts, rights = alike[0] if len(alike) == 1 else (sorted(x for e in alike for x in e[k]) for k in (0, 1))
        middle = lambda x: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
        return middle(lefts), middle(rights)


def _columns_of(state: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: np.ndarray, turn: np.ndarray, least: float) -> np.ndarray:
    """The columns of a page's blocks, which come by left edge."""
    members: list[list[int]] = []
    edges: list[_Edges] = []
    for i in np.flatnonzero(state == 1).tolist():
        left, right, own = float(x0[i]), float(x1[i]), float(turn[i])
        best, at = -np.inf, -1
        for k, column in enumerate(edges):
            fit = 0.0
            if found := column.medians(own):
                shared = max(0.0, min(right, found[1]) - max(left, found[0]))
                narrower = max(1.0, min(max(right - left, 1.0), found[1] - found[0]))
                fit = max(shared / narrower, 1 - abs(left - found[0]) / max(float(width[i]) * 0.08, 1.0))
            if fit > best:
                best, at = fit, k
        if best < least:
            at = len(edges)
            members.append([])
            edges.append(_Edges())
        members[at].append(i)
        edges[at].add(own, left, right)
    ids = np.minimum(state, 0)
    for k, column in enumerate(sorted(range(len(members)), key=lambda c: edges[c].medians(None)[0]), 1):
        ids[members[column]] = k
    return ids


def _by_page(batches, keys: list[str]):
    """Frames of whole pages from sorted batches, and where in each a page begins."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch):
            now = pd.concat([held[-1].tail(1), batch], ignore_index=True) if held else batch
            new = pd.Series(False, now.index)
            for k in keys:
                before = now[k].shift()
                new |= (now[k] != before) & ~(now[k].isna() & before.isna())
            starts = np.flatnonzero(new.to_numpy()[1:]) + (0 if held else 1)
            if len(starts):
                whole = pd.concat([*held, batch.iloc[: starts[-1]]], ignore_index=True)
                offset = sum(map(len, held))
                yield whole, np.concatenate([[0], starts[:-1] + offset])
                held = [batch.iloc[starts[-1] :]]
            else:
                held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True), np.array([0])


def assign_columns(blocks: DataFrame, wide: float = 0.72, least: float = 0.48, keys: tuple[str, ...] = ("page",), carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, box_id, the columns carried, column_id) of blocks (box_id, x0, x1, page_width, the keys of a page and, if they
    are there, block_type, is_table_cell, rotation). What is carried need not be joined again.

    Paragraphs and footnotes narrower than `wide` of the page take, by their left edges, the column that fits best (by
    overlap with, or alignment to, the medians of its edges) if the fit is `least` or more, or open one; columns count from
    1, left to right. Table cells have -1, all others 0. Greedy by nature, so a page is one task's work; pages come sorted,
    many in a batch.
    """
    has = lambda c, other: F.col(c) if c in blocks.columns else F.lit(other)
    free = has("block_type", "paragraph").isin("paragraph", "footnote") & ~has("is_table_cell", False) & (F.col("x1") - F.col("x0") < wide * F.col("page_width"))
    more = [c for c in carried if c not in ("x0", "x1", "page_width")]
    own = blocks.select(*keys, "box_id", "x0", "x1", "page_width", *more, has("rotation", 0.0).cast("double").alias("rotation__"), F.when(has("is_table_cell", False), -1).when(free, 1).otherwise(0).alias("state__"))

    def assign(batches):
        for frame, starts in _by_page(batches, list(keys)):
            state, x0, x1, width, turn = (frame[c].to_numpy() for c in ("state__", "x0", "x1", "page_width", "rotation__"))
            pages = [_columns_of(*(v[a:b] for v in (state, x0, x1, width, turn)), least) for a, b in itertools.pairwise([*starts, len(frame)])]
            yield frame.assign(column_id=np.concatenate(pages))[[*keys, "box_id", *carried, "column_id"]]

    kinds = dict(blocks.dtypes)
    ordered = own.repartition(*keys).sortWithinPartitions(*keys, "x0", "box_id")
    named = lambda columns: [f"`{c}` {kinds[c]}" for c in columns]
    return ordered.mapInPandas(assign, ", ".join([*named(keys), "box_id bigint", *named(carried), "column_id int"]))


def even_sample(ids: DataFrame, key: str, n: int = 5) -> DataFrame:
    """At most n of the dense ordinals 0..last in even steps (half to even); key holds the ordinal."""
    last = ids.agg(F.max(key).alias("last"))
    wanted = last.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.least(F.lit(n - 1), F.col("last").cast("int"))), lambda i: F.bround(i * F.col("last") / F.greatest(F.lit(1), F.least(F.lit(n - 1), F.col("last")))).cast("bigint")))).alias(key))
    return ids.join(F.broadcast(wanted), key, "left_semi")  # n rows


def inspection(pages: DataFrame, ranges: DataFrame, most: int = 5, least: int = 20) -> DataFrame:
    """(doc, page_count, page_start, page_end, sampled_pages, text_layer_pages, image_pages, status, recommended_mode) of
    documents (doc, page, text, n_images), pages counted from 1, and what is wanted of each (doc, page_start, page_end).

    At most `most` pages in even steps (half to even) are looked at: those of `least` squeezed signs have a text layer. All of
    them: `text`, mode `off`; some: `mixed`, none: `image`, mode `vision`. A missing start is 1, a missing end the last page;
    a range that is not within the document gives `bad_range` and no pages. Pages are counted by document and then met by
    the few that are sampled; the texts of no others are read.
    """
    counts = pages.groupBy("doc").agg(F.count("*").alias("page_count"))
    start, end = F.coalesce("page_start", F.lit(1)), F.coalesce("page_end", "page_count")
    own = counts.join(ranges.select("doc", "page_start", "page_end"), "doc", "left").select("doc", "page_count", start.cast("int").alias("page_start"), end.cast("int").alias("page_end"))
    fine = (F.col("page_start") >= 1) & (F.col("page_start") <= F.col("page_end")) & (F.col("page_end") <= F.col("page_count"))
    last = F.col("page_end") - F.col("page_start")
    steps = F.least(F.lit(most - 1), last)
    spread = F.transform(F.sequence(F.lit(0), steps), lambda i: (F.bround(i * last / F.greatest(F.lit(1), steps)) + F.col("page_start")).cast("int"))
    own = own.withColumn("sampled_pages", F.when(fine, F.array_sort(F.array_distinct(spread))))
    chosen = own.where("sampled_pages is not null").select("doc", F.explode("sampled_pages").alias("page"))
    listed = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("page").cast("int"))))
    text, drawn = listed(F.length(T.squeeze(F.col("text"))) >= least), listed(F.col("n_images") > 0)
    seen = pages.join(chosen, ["doc", "page"]).groupBy("doc").agg(text.alias("text_layer_pages"), drawn.alias("image_pages"))
    n, of = F.size("text_layer_pages"), F.size("sampled_pages")
    status = F.when(F.col("sampled_pages").isNull(), "bad_range").when(n == of, "text").when(n > 0, "mixed").otherwise("image")
    mode = F.when(F.col("status") == "text", "off").when(F.col("status") != "bad_range", "vision")
    return own.join(seen, "doc", "left").withColumn("status", status).withColumn("recommended_mode", mode)


def page_range(pages: DataFrame, start: int, end: int | None, count: int) -> DataFrame:
    """Pages start..end (from 1, inclusive); bounds outside the document are an error."""
    end = count if end is None else end
    if not 1 <= start <= count or end < start or end > count:
        raise ValueError(f"pages {start} to {end} are not within 1 to {count}")
    return pages.where(F.col("page").between(start, end))
