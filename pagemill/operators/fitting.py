"""Room for a paragraph: the largest font size at which it fits a box, for a batch of texts at once.

Widths follow the model of `visual.width_of`, in thousandths of the font size, so that all sums are whole numbers. Lines break
at any sign, as in Chinese text, and at line ends. All limits are fixed values.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.visual import width_of

#: Heights of a line in font sizes, tried from the widest; steps of the bisection; what a paragraph may stand out.
LEADINGS, STEPS, SLACK = (1.18, 1.12, 1.06, 1.02), 14, 0.35
LEAST = 3.5


@functools.lru_cache(1 << 16)
def _thousandths(sign: str) -> int:
    return 0 if sign == "\n" else round(1000 * width_of(sign))


class Signs:
    """The signs of a batch of texts one after another, with running widths and, for each sign, its line's end."""

    def __init__(self, texts: list[str]):
        whole = "".join(texts)
        self.ends = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        signs, which = np.unique(points, return_inverse=True)
        self.upto = np.concatenate([[0], np.cumsum(np.array([_thousandths(chr(c)) for c in signs], np.int64)[which])])
        breaks = np.unique(np.concatenate([np.flatnonzero(points == ord("\n")) + 1, self.ends[1:]]))
        self.line_end = breaks[np.searchsorted(breaks, np.arange(len(whole)), side="right")] if len(whole) else breaks

    def lines(self, rows: np.ndarray, room: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many lines of `room` thousandths the texts of these rows take; above most: most + 1."""
        at, last, n = self.ends[rows].copy(), self.ends[rows + 1], np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero((at < last) & (n <= most))
        while len(open_):
            here = at[open_]
            to = np.searchsorted(self.upto, self.upto[here] + room[open_], side="right") - 1
            at[open_] = np.minimum(np.maximum(to, here + 1), self.line_end[here])
            n[open_] += 1
            open_ = open_[(at[open_] < last[open_]) & (n[open_] <= most[open_])]
        return np.maximum(n, 1)


def fit_paragraphs(texts: list[str], width: np.ndarray, height: np.ndarray, source: np.ndarray, display: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, ...]:
    """(size, leading, lines, fits) for each text in its box. The search begins at 1.08 source sizes, 34 at most (titles and
    headings: at the source's size if that is larger, 36 at most), and halves towards the least size for each leading; the
    largest size wins, of equal ones the widest leading."""
    signs, n = Signs(texts), len(texts)
    start = np.maximum(least, np.minimum(34.0, source * 1.08))
    start = np.where(display, np.minimum(36.0, np.maximum(start, source)), start)
    size, leading, lines, fits = np.full(n, least), np.full(n, LEADINGS[-1]), np.zeros(n, np.int64), np.zeros(n, bool)

    def stands(rows: np.ndarray, sizes: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        most = np.floor((height[rows] + SLACK) / (sizes * ratio)).astype(np.int64)
        count = signs.lines(rows, np.floor(width[rows] / sizes * 1000 + 1e-6).astype(np.int64), most)
        return count * sizes * ratio <= height[rows] + SLACK, count

    for ratio in LEADINGS:
        good, count = stands(np.arange(n), np.full(n, least), ratio)
        rows = np.flatnonzero(good)
        low, high, best = np.full(len(rows), least), start[rows].copy(), count[rows]
        for _ in range(STEPS):
            middle = (low + high) / 2
            ok, count = stands(rows, middle, ratio)
            low, high, best = np.where(ok, middle, low), np.where(ok, high, middle), np.where(ok, count, best)
        better = ~fits[rows] | (low > size[rows])
        took = rows[better]
        size[took], leading[took], lines[took], fits[took] = low[better], ratio, best[better], True
    none = np.flatnonzero(~fits)
    lines[none] = signs.lines(none, np.floor(width[none] / least * 1000 + 1e-6).astype(np.int64), np.full(len(none), 2**40))
    return size, leading, lines, fits


def paragraph_fit(df: DataFrame, text: str, width: str, height: str, source_size: str, block_type: str) -> DataFrame:
    """df with fit_size, fit_leading, fit_lines and fits. A null text is empty and takes one line."""

    @F.pandas_udf("struct<size:double,leading:double,lines:bigint,fits:boolean>")
    def fit(texts: pd.Series, w: pd.Series, h: pd.Series, z: pd.Series, kind: pd.Series) -> pd.DataFrame:
        found = fit_paragraphs([t or "" for t in texts], *(x.to_numpy(np.float64) for x in (w, h, z)), kind.isin(["title", "heading"]).to_numpy())
        return pd.DataFrame(dict(zip(("size", "leading", "lines", "fits"), found)))

    own = df.withColumn("f__", fit(F.col(text), F.col(width), F.col(height), F.col(source_size), F.col(block_type)))
    return own.withColumns({"fit_size": F.col("f__.size"), "fit_leading": F.col("f__.leading"), "fit_lines": F.col("f__.lines"), "fits": F.col("f__.fits")}).drop("f__")
