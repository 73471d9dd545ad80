"""Mixing sources to target weights, in DataFrame expressions only.

Every document gets a random key by hash; (source, key, words) is sorted by ranges, and prefix sums over the whole order
(within a range, and over the ranges' sums) tell where a source's budget ends. What lies before is taken once more than
the budget's whole passes, what lies behind is not, and the document at the cut gives its first words. Only numbers are
shuffled: the texts meet one row a source, which holds its cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import Scratch, partitions

SPACE = r"\x20\x09-\x0D"
#: Hexadecimal digits of the hash that make a key: 60 bits.
DIGITS = 15


def words(text: Column) -> Column:
    """The number of words, without a list of them: a sign for each word with the blanks behind it."""
    return F.length(F.regexp_replace(F.ltrim(text, F.lit(" \t\n\x0b\f\r")), f"[^{SPACE}]+[{SPACE}]*", "w")).cast("bigint")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """df with, for each name of `sums`, the sum of its column over all rows before in that order, which must be total.

    Rows are dealt to ranges of the order, so that a source of a third of all rows is many ranges. Ranges' own sums, one
    row for each shuffle partition, are summed in one window and joined back.
    """
    own, base = {k: f"{k}_own" for k in sums}, {k: f"{k}_base" for k in sums}
    ranged = df.withColumns({own[k]: v.cast("bigint") for k, v in sums.items()})
    ranged = ranged.repartitionByRange(partitions(df.sparkSession), *order).withColumn("range", F.spark_partition_id())
    ranged = scratch.keep(ranged, name)  # bounds of ranges are sampled, so they hold for one run
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(*[F.sum(own[k]).alias(own[k]) for k in sums])
    totals = totals.select("range", *[F.coalesce(F.sum(own[k]).over(earlier), F.lit(0)).alias(base[k]) for k in sums])
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({k: F.coalesce(F.sum(own[k]).over(before), F.lit(0)) for k in sums})
    out = inside.join(F.broadcast(totals), "range").withColumns({k: F.col(k) + F.col(base[k]) for k in sums})
    return out.drop("range", *own.values(), *base.values())


def targets(sizes: DataFrame, weights: list[int], most: int, scratch: Scratch) -> DataFrame:
    """(none, src, start, source_size, target, budget) from (none, src, source_size), a row each.

    Sources in their order weigh as `weights` say, again and again, and share the sum of all sizes by weight. No source gets
    more than `most` times its size; what that cuts off is shared by weight among the others, until none is above. So all
    others get one level for each unit of weight: that of the first source, by size over weight, whose share of what the
    ones before it leave is within its bound. The budget is the target's nearest integer, halves up.
    """
    if not weights or any(w < 1 for w in weights):
        raise ValueError("weights must be positive integers")
    unit = math.lcm(*weights)
    ranked = prefix_sums(sizes, ["none", "src"], {"rank": F.lit(1), "start": F.col("source_size")}, scratch, "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight.cast("bigint")).withColumn("bound", F.col("source_size") * most)
    weighed = weighed.withColumn("ratio", F.col("bound") * F.expr(f"{unit} div weight"))
    full, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    big = lambda x: x.cast("decimal(19,0)")  # noqa: E731  the product of two keeps all digits
    steps = prefix_sums(weighed, ["ratio", "none", "src"], {"spent": F.col("bound"), "lighter": F.col("weight")}, scratch, "levels")
    rest, shares = F.lit(full) - F.col("spent"), F.lit(all_weights) - F.col("lighter")
    within = steps.where(big(rest) * big(F.col("weight")) <= big(F.col("bound")) * big(shares))
    first = within.agg(F.min(F.struct("lighter", rest.alias("rest"), shares.alias("shares")))).first()[0]
    rest, shares = (first["rest"], first["shares"]) if first else (0, 1)
    part = F.col("weight") * F.lit(rest)
    free = big(part) <= big(F.col("bound")) * big(F.lit(shares))
    nearest = F.expr(f"(weight * {rest}L * 2 + {shares}L) div {2 * shares}L")
    return weighed.select("none", "src", "start", "source_size", F.when(free, part.cast("double") / F.lit(float(shares))).otherwise(F.col("bound").cast("double")).alias("target"), F.when(free, nearest).otherwise(F.col("bound")).alias("budget"))


def mix(docs: DataFrame, weights: list[int] = [1, 2, 3], most: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, text, source, size, source_size, target, copies, part) for each row of docs: the mix takes its text `copies`
    times, and once its beginning `part` (null for all but the documents at the cuts). A source's words taken are exactly
    its budget (see `targets`).

    size counts the words, source_size those of the source. Sources are ordered by code point, null last. A null text
    counts as empty and a null id as an empty one. A document's key is a hash of the seed, its id and its text. Rows that
    repeat both are one unit of the order; if the cut falls on them, each gives the same share of its words, rounded up or
    down by a hash of the row's place, so that the source comes near its budget instead of meeting it. An empty table gives
    no rows; columns other than the three named are not read. No document is taken more than `most` times.
    """
    scratch = Scratch(docs.sparkSession)
    source = F.col(f"`{source_col}`").cast("string")
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary"), 256), 1, DIGITS), 16, 10).cast("bigint")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("src"), F.monotonically_increasing_id().alias("place"))
    own = own.withColumns({"size": words(F.col("text")), "key": key})
    units = scratch.keep(own.groupBy("none", "src", "key").agg(F.sum("size").alias("words")), "units")
    goals = scratch.keep(targets(units.groupBy("none", "src").agg(F.sum("words").alias("source_size")), weights, most, scratch), "goals")
    placed = prefix_sums(units.where("words > 0"), ["none", "src", "key"], {"before": F.col("words")}, scratch, "units_in_order")
    left = F.expr("start + budget % source_size - before")
    cuts = placed.join(goals.where("source_size > 0"), ["none", "src"]).withColumn("left", left).where("left >= 0 and left < words")
    cuts = goals.join(cuts.select("none", "src", F.col("key").alias("cut"), "left", "words"), ["none", "src"], "left")
    cuts = scratch.keep(cuts.withColumn("passes", F.expr("if(source_size = 0, 0, budget div source_size)")).drop("start", "budget"), "cuts")
    scratch.drop("units", "sources", "levels", "goals", "units_in_order")
    met = own.join(cuts, ["none", "src"])
    at_cut = (F.col("key") == F.col("cut")) & (F.col("size") > 0)
    some = F.expr("left * size div words + if(pmod(xxhash64(place), words) < left * size % words, 1, 0)")
    met = met.withColumn("some", F.when(at_cut, some).otherwise(F.lit(0)))
    copies = F.col("passes") + F.when(F.col("key") < F.col("cut"), 1).otherwise(0)
    return met.select("id", "text", F.when(~F.col("none"), F.col("src")).alias("source"), "size", "source_size", "target", copies.alias("copies"), F.when(F.col("some") > 0, first_words(F.col("text"), F.col("some"))).alias("part"))


def rows_of(mixed: DataFrame) -> DataFrame:
    """(id, source, epoch, text): the rows that the mix takes, `epoch` counting from 0 for each document."""
    n = F.col("copies") + F.when(F.col("part").isNotNull(), 1).otherwise(0)
    each = mixed.where(n > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return each.select("id", "source", "epoch", F.when(F.col("epoch") < F.col("copies"), F.col("text")).otherwise(F.col("part")).alias("text"))
