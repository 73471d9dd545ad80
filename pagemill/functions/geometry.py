"""Box algebra over columns. A box is a struct of x0, y0, x1, y1 (doubles, y grows downwards)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def rounded(x: Column, places: int) -> Column:
    """x to so many places, half away from zero, as SQL engines round doubles: multiplied, rounded, divided. F.round takes the
    shortest decimal of x instead, which ends in 5 where the product does not, or not where it does."""
    return F.round(x * 10.0**places) / 10.0**places


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Width and height that two boxes share (negative: their distance)."""
    return F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over that of the smaller box."""
    w, h = overlap(a, b)
    least = F.least(area(a), area(b))
    return F.when((w > 0) & (h > 0) & (least > 0), w * h / least).otherwise(0.0)


def union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def distance(a: Column, b: Column) -> Column:
    """Sum of the differences of the four edges."""
    return F.abs(a["x0"] - b["x0"]) + F.abs(a["y0"] - b["y0"]) + F.abs(a["x1"] - b["x1"]) + F.abs(a["y1"] - b["y1"])


def near(a: Column, b: Column, gap: float) -> Column:
    w, h = overlap(a, b)
    return (w >= -gap) & (h >= -gap)


def rotation(dx: Column, dy: Column) -> Column:
    """A line's direction in degrees, in [-180, 180), tiny angles as 0."""
    turn = F.pmod(F.degrees(F.atan2(dy, dx)) + 180.0, F.lit(360.0)) - 180.0
    return F.when(F.abs(turn) < 0.05, 0.0).otherwise(turn)


def logical(b: Column, page_width: Column, page_height: Column, degrees: Column) -> Column:
    """The box in reading axes: turned back by the rotation around the origin and shifted so that the page starts at 0."""
    c, s = F.cos(F.radians(-degrees)), F.sin(F.radians(-degrees))

    def turned(x0, y0, x1, y1):
        xs = [x * c - y * s for x in (x0, x1) for y in (y0, y1)]
        ys = [x * s + y * c for x in (x0, x1) for y in (y0, y1)]
        return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)

    zero = F.lit(0.0)
    px, py, _, _ = turned(zero, zero, page_width, page_height)
    u0, v0, u1, v1 = turned(b["x0"], b["y0"], b["x1"], b["y1"])
    return F.struct((u0 - px).alias("x0"), (v0 - py).alias("y0"), (u1 - px).alias("x1"), (v1 - py).alias("y1"))


def clamp(b: Column, page_width: Column, page_height: Column) -> Column:
    """The part of a box that lies on the page."""
    inside = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    return box(inside(b["x0"], page_width), inside(b["y0"], page_height), inside(b["x1"], page_width), inside(b["y1"], page_height))


def padded(b: Column, by: Column) -> Column:
    return box(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by)


def erase_padding(kind: Column, h: Column, font_size: Column) -> Column:
    """Room (x, y) around what is erased, by the box's height: more for titles and headings. The factors are fixed values."""
    within = lambda low, high, v: F.greatest(F.lit(low), F.least(F.lit(high), v))
    plain = within(0.9, 3.0, h * 0.20)
    display = F.greatest(plain, F.least(F.lit(10.0), F.greatest(h * 0.08, F.coalesce(font_size, F.lit(0.0)) * 0.10)))
    y = F.when(kind == "title", within(3.0, 14.0, h * 0.58)).when(kind == "heading", within(1.5, 5.0, h * 0.34)).otherwise(plain)
    return F.struct(F.when(kind == "title", display).otherwise(plain).alias("x"), y.alias("y"))


def growth_margin(font_size: Column, scale: Column, dpi: Column) -> Column:
    """Pixels by which a recognized box may grow to its glyphs' edges; scale is the mean of both axes."""
    points = F.least(F.lit(8.0), F.greatest(F.lit(0.75), font_size * 0.08))
    return F.greatest(F.lit(1), F.bround(F.greatest(F.lit(1.0), dpi / 120.0, points * F.greatest(F.lit(1.0), scale))).cast("int"))


def turned_apart(a: Column, b: Column) -> Column:
    """Degrees between two rotations, 0 to 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def irregular(lines: Column) -> Column:
    """An array of line boxes whose left edges spread by max(12, twice the median height) or more."""
    left = F.transform(lines, lambda b: b["x0"])
    heights = F.array_sort(F.transform(lines, lambda b: b["y1"] - b["y0"]))
    n = F.size(heights)
    median = (F.get(heights, F.floor((n - 1) / 2).cast("int")) + F.get(heights, F.floor(n / 2).cast("int"))) / 2
    return (n > 1) & (F.array_max(left) - F.array_min(left) >= F.greatest(F.lit(12.0), 2 * median))


def upright(b: Column, degrees: Column) -> Column:
    """Width and height of a box as its text reads: exchanged at a quarter turn."""
    quarter = F.abs(F.abs(degrees) - 90) < 45
    return F.struct(F.when(quarter, height(b)).otherwise(width(b)).alias("w"), F.when(quarter, width(b)).otherwise(height(b)).alias("h"))


def corners(b: Column, degrees: Column) -> Column:
    """The four corners of a box turned around its middle."""
    cx, cy, c, s = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2, F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    turn = lambda x, y: F.struct((cx + (x - cx) * c - (y - cy) * s).alias("x"), (cy + (x - cx) * s + (y - cy) * c).alias("y"))
    return F.array(turn(b["x0"], b["y0"]), turn(b["x1"], b["y0"]), turn(b["x1"], b["y1"]), turn(b["x0"], b["y1"]))


def safe_page(w: Column, h: Column) -> Column:
    """A page size between 250 and 3000 points; else A4."""
    fine = w.between(250.0, 3000.0) & h.between(250.0, 3000.0)
    return F.struct(F.when(fine, w).otherwise(595.28).alias("w"), F.when(fine, h).otherwise(841.89).alias("h"))


def fits_page(image: Column, page_width: Column, page_height: Column, share: float = 0.94) -> Column:
    """An image covers at least `share` of the page."""
    return area(image) >= share * page_width * page_height


def scan_source(n_images: Column, long_side: Column, image_ratio: Column, page_ratio: Column, degrees: Column) -> Column:
    """A page's only image stands for the page: unrotated, 900 pixels or more, and of nearly its proportions."""
    return (n_images == 1) & (long_side >= 900) & (F.abs(image_ratio - page_ratio) <= 0.035) & (F.abs(degrees) < 0.05)
