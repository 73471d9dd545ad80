"""Ordered rows in packages of bounded size."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.layout import running
from pagemill.operators.store import Steps

MAX_ROWS, MAX_CHARS, MAX_BYTES = 1_000_000, 100_000_000, 9_500_000


def in_ranges(df: DataFrame, keys: list[str], order: list[str], steps: Steps, name: str) -> DataFrame:
    """df, stored in ranges of its keys and order; `range__` numbers them. A key of most rows is many ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return steps.keep(df.repartitionByRange(n, *keys, *order).withColumn("range__", F.spark_partition_id()), name)


def sums_before(ranged: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """ranged (see in_ranges) with, for each name, the sum of a whole number over the rows of its keys before its own: within
    the range, and over the earlier ranges' sums, of which there is one row for each key and range that meet."""
    own = ranged.withColumns({f"{k}own__": v.cast("bigint") for k, v in sums.items()})
    earlier = Window.partitionBy(*keys).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*keys, "range__").agg(*[F.sum(f"{k}own__").alias(f"{k}all__") for k in sums])
    same = [F.col(k).alias(f"{k}of__") for k in [*keys, "range__"]]
    totals = totals.select(*same, *[F.coalesce(F.sum(f"{k}all__").over(earlier), F.lit(0)).alias(f"{k}base__") for k in sums])
    matched = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}of__")) for k in [*keys, "range__"]])
    inside = Window.partitionBy(*keys, "range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = own.withColumns({k: F.coalesce(F.sum(f"{k}own__").over(inside), F.lit(0)) for k in sums}).join(totals, matched)
    return out.withColumns({k: F.col(k) + F.col(f"{k}base__") for k in sums}).drop(*[f"{k}{x}__" for k in sums for x in ("own", "base")], *[f"{k}of__" for k in [*keys, "range__"]])


def following(placed: DataFrame, task: str, size: str, most_size: int, most_rows: int) -> DataFrame:
    """(task, at, to): for each row, by its number `at` and the sum of sizes `before` it, the row that a package closes
    before if it begins here: the first whose end lies more than most_size behind, or the one most_rows on, if any.

    Ends and bounds meet in windows of a task's sizes as long as a package, so that a window holds what a package or two
    hold; where it has no answer, the next window with a row in it does, of which a task has some for each package.
    """
    ends = placed.select(task, (F.col("before") + F.col(size)).alias("value"), F.lit(0).alias("asks"), "at")
    bounds = placed.select(task, (F.col("before") + most_size).alias("value"), F.lit(1).alias("asks"), "at")
    both = ends.unionByName(bounds).withColumn("window", F.floor(F.col("value") / F.lit(max(1, most_size))))
    row = F.when(F.col("asks") == 0, F.col("at"))
    above = Window.partitionBy(task, "window").orderBy(F.desc("value"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy(task).orderBy(F.desc("window")).rowsBetween(Window.unboundedPreceding, -1)
    windows = both.groupBy(task, "window").agg(F.min(row).alias("first"), F.max("at").alias("last"))
    windows = windows.withColumns({"later": F.min("first").over(beyond), "last": F.max("last").over(Window.partitionBy(task))})
    met = both.withColumn("found", F.min(row).over(above)).where("asks = 1").join(windows, [task, "window"])
    to = F.greatest(F.col("at") + 1, F.least(F.col("at") + F.lit(most_rows).cast("bigint"), F.coalesce("found", "later")))
    return met.select(task, "at", to.alias("to")).where(F.col("to") <= F.col("last"))


def starts(jumps: DataFrame, firsts: DataFrame, task: str, steps: Steps) -> DataFrame:
    """(task, at) of all rows that jumps (task, at, to) lead to from firsts (task, at), themselves included.

    Each round takes the jumps of all rows twice as far and follows them from all rows found, so that there are as many
    rounds as the packages of the largest task have binary digits; jumps that would leave a task go.
    """
    found, fresh, k = steps.keep(firsts, "starts0"), True, 0
    jumps = steps.keep(jumps, "jumps")
    while fresh:
        k += 1
        more = steps.keep(found.join(jumps, [task, "at"]).select(task, F.col("to").alias("at")), f"starts{k}")
        if fresh := not more.isEmpty():
            found = found.unionByName(more)
            onward = jumps.select(task, F.col("at").alias("to"), F.col("to").alias("beyond"))
            jumps = steps.keep(jumps.join(onward, [task, "to"]).select(task, "at", F.col("beyond").alias("to")), "jumps")
    steps.drop("jumps", f"starts{k}")
    return found


def _by_bytes(task: str, order: str, most_bytes: int):
    """Numbers the parts of packages (task, package__), read in order, that most_bytes end."""

    def split(batches):
        heavy, part, current = 0, 0, object()
        for batch in batches:
            out = []
            for t, p, b in zip(batch[task], batch["package__"], batch["weight__"]):
                if (t, p) != current:
                    heavy, part, current = 0, 0, (t, p)
                elif heavy and heavy + b > most_bytes:
                    heavy, part = 0, part + 1
                heavy += b
                out.append(part)
            yield pd.DataFrame({task: batch[task], order: batch[order], "package__": batch["package__"], "part__": out})

    return split


def next_fit(rows: DataFrame, task: str, order: str, size: str, most_size: int = MAX_CHARS, most_rows: int = MAX_ROWS, bytes_: str | None = None, most_bytes: int = MAX_BYTES) -> DataFrame:
    """rows with package_index (from 1): a package is closed as soon as the next row would exceed a bound. A row larger
    than the bound has a package of its own. Where a column of bytes is named, packages that hold more than most_bytes are
    split in order; the bounds of size and rows count on over such splits. An order occurs once in a task; sizes are whole
    and not negative.

    Sums start anew with each package, so each package's end depends on the one before. No task of Spark reads a whole task
    for that: sums and numbers of rows come from ranges, the row that each row's package would close before from windows as
    long as a package, and the rows that packages begin with from jumps that double. Only then are packages read in order,
    each by itself, to split them by bytes. Texts are not touched and join on the task and order.
    """
    kinds = dict(rows.dtypes)
    steps = Steps(rows.sparkSession)
    slim = rows.select(task, order, F.col(size).cast("bigint").alias("size__"), (F.lit(0) if bytes_ is None else F.col(bytes_)).cast("bigint").alias("weight__"))
    ranged = in_ranges(slim, [task], [order], steps, "ranged")
    placed = steps.keep(sums_before(ranged, [task], [order], {"before": F.col("size__"), "at": F.lit(1)}), "placed")
    begun = starts(following(placed, task, "size__", most_size, most_rows), placed.where("at = 0").select(task, "at"), task, steps)
    flagged = placed.drop("before").join(begun.withColumn("begins__", F.lit(1)), [task, "at"], "left").fillna(0, ["begins__"])
    numbered = sums_before(flagged, [task], [order], {"begun": F.col("begins__")}).withColumn("package__", F.col("begun") + F.col("begins__"))
    if bytes_ is None:
        return rows.join(numbered.select(task, order, F.col("package__").alias("package_index")), [task, order])
    grouped = numbered.select(task, order, "package__", "weight__").repartition(F.col(task), F.col("package__")).sortWithinPartitions(task, "package__", order)
    parts = steps.keep(grouped.mapInPandas(_by_bytes(task, order, most_bytes), f"`{task}` {kinds[task]}, `{order}` {kinds[order]}, package__ bigint, part__ bigint"), "parts")
    earlier = Window.partitionBy(task).orderBy("package__").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(task, "package__").agg((F.max("part__") + 1).alias("n__"))
    counts = counts.select(task, "package__", F.coalesce(F.sum("n__").over(earlier), F.lit(0)).alias("earlier__"))
    split = parts.join(counts, [task, "package__"]).select(task, order, (F.col("earlier__") + F.col("part__") + 1).alias("package_index"))
    return rows.join(split, [task, order])


def row_cap(rows: DataFrame, task: str, order: str, most_rows: int) -> DataFrame:
    """Only the row cap: the running number decides, no fold is needed. Orders are whole numbers, each once a task."""
    return running(rows, [task], order, F.lit(1), "n__").withColumn("package_index", F.floor((F.col("n__") - 1) / most_rows) + 1).drop("n__")


def packages(packed: DataFrame, task: str, size: str) -> DataFrame:
    """(task, package_index, package_total, n_rows, n_size, filename)."""
    each = packed.groupBy(task, "package_index").agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_size"))
    total = each.groupBy(task).agg(F.max("package_index").alias("package_total"))
    name = F.format_string("%s_%03d_of_%03d.xlsx", F.col(task).cast("string"), F.col("package_index"), F.col("package_total"))
    return each.join(total, task).withColumn("filename", name)


def checked_bytes(text: str, order: str, most: int = MAX_BYTES, overhead: int = 64) -> Column:
    """An additive estimate of a row's bytes in the file; a single row over the bound is an error."""
    n = (F.octet_length(text) + F.lit(overhead)).cast("bigint")
    return F.when(n > most, F.raise_error(F.concat(F.lit("a row exceeds the package size: "), F.col(order).cast("string")))).otherwise(n)


def refine_by_bytes(rows: DataFrame, task: str, order: str, text: str, most: int = MAX_BYTES, overhead: int = 64) -> DataFrame:
    """Next fit on an additive estimate of a row's bytes in the file; a single row over the bound is an error."""
    return next_fit(rows.withColumn("row_bytes", checked_bytes(text, order, most, overhead)), task, order, "row_bytes", most)
