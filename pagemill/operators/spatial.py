"""Boxes against boxes, on a grid so that only neighbours meet."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T

CELL = 64.0
#: Boxes of a crowded cell that one task lets meet as many others.
BLOCK = 2048


def gridded(boxes: DataFrame, cell: float = CELL, margin: float = 0.0) -> DataFrame:
    """A row for each grid cell that a box (grown by the margin) touches, in columns gx and gy."""
    span = lambda a, b: F.sequence(F.floor((F.col(a) - margin) / cell), F.floor((F.col(b) + margin) / cell))
    return boxes.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))


def dealt(tiles: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The tiles as left and as right side of a join by page, gx, gy, i and j, in which every two tiles of a cell meet once.

    A cell of more than `block` tiles is dealt into blocks, and each left block (i) meets each right one (j) by itself. There
    are as many tasks as give each block * block meetings on average, however few bytes these are.
    """
    cells = tiles.groupBy("page", "gx", "gy").agg(F.count("*").alias("n"))
    meetings = cells.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    tasks = max(tiles.sparkSession.sparkContext.defaultParallelism, math.ceil(meetings / block**2))
    crowded = cells.where(F.col("n") > block).select("page", "gx", "gy", F.ceil(F.col("n") / block).alias("blocks"))
    tiles = tiles.join(F.broadcast(crowded), ["page", "gx", "gy"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    own, each = F.pmod(F.xxhash64("box_id"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    left, right = tiles.withColumn("i", own).withColumn("j", each), tiles.withColumn("i", each).withColumn("j", own)
    return tuple(t.drop("blocks").repartition(tasks, "page", "gx", "gy", "i", "j") for t in (left, right))


def overlap_pairs(boxes: DataFrame, least: float = 0.75, cell: float = CELL, block: int = BLOCK) -> DataFrame:
    """(page, a, b, width, height, ratio), a < b: boxes of one page that share more than `least` in both directions.

    A pair is kept in the one cell where the corner of the shared part lies, so that no distinct is needed.
    """
    tiles = gridded(boxes.select("page", "box_id", "x0", "y0", "x1", "y1"), cell)
    left, right = (t.select("page", "gx", "gy", "i", "j", F.col("box_id").alias(n), G.box("x0", "y0", "x1", "y1").alias(f"box_{n}")) for t, n in zip(dealt(tiles, block), "ab"))
    w, h = G.overlap(F.col("box_a"), F.col("box_b"))
    corner = (F.floor(F.greatest("box_a.x0", "box_b.x0") / cell) == F.col("gx")) & (F.floor(F.greatest("box_a.y0", "box_b.y0") / cell) == F.col("gy"))
    found = left.join(right, ["page", "gx", "gy", "i", "j"]).where((F.col("a") < F.col("b")) & (w > least) & (h > least) & corner)
    return found.select("page", "a", "b", G.rounded(w, 2).alias("width"), G.rounded(h, 2).alias("height"), G.rounded(G.overlap_ratio(F.col("box_a"), F.col("box_b")), 6).alias("ratio"))


def nearest(left: DataFrame, right: DataFrame, most: float, cell: float = 4.0, same: tuple[str, ...] = ()) -> DataFrame:
    """(page, a, b, distance): for each box of left the box of right on its page with the least sum of edge differences
    (ties: the smaller id), if that is at most `most`; only of those that agree in the columns `same`. Corners that near
    lie in the same or a neighbouring cell."""
    step = max(cell, most)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    l = left.select("page", *same, F.col("box_id").alias("a"), G.box("x0", "y0", "x1", "y1").alias("box_a"), F.explode(F.transform(around, lambda i: F.floor(F.col("x0") / step) + i)).alias("gx")).withColumn("gy", F.explode(F.transform(around, lambda i: F.floor(F.col("box_a.y0") / step) + i)))  # noqa: E741
    r = right.select("page", *same, F.col("box_id").alias("b"), G.box("x0", "y0", "x1", "y1").alias("box_b"), F.floor(F.col("x0") / step).alias("gx"), F.floor(F.col("y0") / step).alias("gy"))
    d = G.rounded(G.distance(F.col("box_a"), F.col("box_b")), 4)
    found = l.join(r, ["page", *same, "gx", "gy"]).withColumn("distance", d).where(F.col("distance") <= most)
    best = found.groupBy("page", "a").agg(F.min(F.struct("distance", "b")).alias("m"))
    return best.select("page", "a", F.col("m.b").alias("b"), F.col("m.distance").alias("distance"))


def matched_fragments(segments: DataFrame, fragments: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, a, tier, b, distance): for each segment the nearest fragment of equal text within 8 (tier 1), else the
    nearest block of equal text within 12 (2), else the nearest block of any within 4 (3). Tables have page, box_id, text
    and the box; texts are compared squeezed."""
    segments, fragments, blocks = (t.withColumn("text", T.squeeze(F.col("text"))) for t in (segments, fragments, blocks))
    tiers = [nearest(segments, fragments, 8.0, same=("text",)), nearest(segments, blocks, 12.0, same=("text",)), nearest(segments, blocks, 4.0)]
    every = functools.reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(k)) for k, t in enumerate(tiers, 1)])
    return every.groupBy("page", "a").agg(F.min(F.struct("tier", "distance", "b")).alias("m")).select("page", "a", "m.tier", "m.b", "m.distance")


def leads(boxes: DataFrame, font: float = 10.0) -> DataFrame:
    """(page, box_id, x1, lead_x1): a box may grow to 1.5 before its right neighbour; the last by max(12, 1.4 font)."""
    from pyspark.sql import Window

    nxt = F.lead("x0").over(Window.partitionBy("page").orderBy("x0", "box_id"))
    return boxes.select("page", "box_id", "x1", F.round(F.when(nxt.isNull(), F.col("x1") + max(12.0, 1.4 * font)).otherwise(F.greatest(F.col("x1"), nxt - 1.5)), 2).alias("lead_x1"))


def density(lines: DataFrame, page_area: float) -> DataFrame:
    """(page, n_chars, n_lines, dense): 240 lines or more, or 0.012 signs a square point."""
    each = lines.groupBy("page").agg(F.sum(F.length("line")).cast("bigint").alias("n_chars"), F.count("*").alias("n_lines"))
    return each.withColumn("dense", (F.col("n_lines") >= 240) | (F.col("n_chars") / page_area >= 0.012))


def clusters(boxes: DataFrame, gap: float, most: int = 16) -> DataFrame:
    """(page, cluster, n, x0, y0, x1, y1): boxes that are near each other through others; then the pairs whose union adds
    least area are merged until `most` are left. One group function a page, as every step depends on the last."""

    def group(page: pd.DataFrame) -> pd.DataFrame:
        own = [[*r, 1] for r in page.sort_values("box_id")[["x0", "y0", "x1", "y1"]].itertuples(index=False)]
        joined = lambda a, b: [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]]
        near = lambda a, b: min(a[2], b[2]) - max(a[0], b[0]) >= -gap and min(a[3], b[3]) - max(a[1], b[1]) >= -gap
        size = lambda a: (a[2] - a[0]) * (a[3] - a[1])
        out: list[list] = []
        for b in own:
            while (hit := next((i for i, a in enumerate(out) if near(a, b)), None)) is not None:
                b = joined(out.pop(hit), b)
            out.append(b)
        while len(out) > most:
            _, i, j = min((size(joined(a, b)) - size(a) - size(b), i, j) for i, a in enumerate(out) for j, b in enumerate(out[:i]))
            merged = joined(out[i], out[j])
            out = [x for k, x in enumerate(out) if k not in (i, j)] + [merged]
        out.sort(key=lambda b: (b[1], b[0], b[3], b[2]))
        return pd.DataFrame([[page["page"].iloc[0], k, b[4], *b[:4]] for k, b in enumerate(out)], columns=["page", "cluster", "n", "x0", "y0", "x1", "y1"])

    return boxes.select("page", "box_id", "x0", "y0", "x1", "y1").groupBy("page").applyInPandas(group, "page int, cluster bigint, n bigint, x0 double, y0 double, x1 double, y1 double")
