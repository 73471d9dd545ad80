"""Whether what was drawn earlier still holds: canonical documents, fingerprints over any number of rows, and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.packing import in_ranges, sums_before
from pagemill.operators.store import Steps


def _sorted(c: Column, kind: T.DataType) -> Column:
    """c with the fields of all structs and the keys of all maps in order, at any depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[_sorted(c.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), _sorted(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return c


def canonical_json(rows: DataFrame, columns: list[str]) -> Column:
    """The columns of a row as one JSON document without blanks: names in order at every depth, nulls stated. Maps have
    texts as keys."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return F.to_json(F.struct(*[_sorted(F.col(f"`{c}`"), kinds[c]).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def fingerprint_tree(rows: DataFrame, group: str, order: str, columns: list[str], fan: int = 1024, levels: int = 4) -> DataFrame:
    """(group, fingerprint): the root of a tree of hashes over the rows' canonical documents in order, `order` being unique in
    a group.

    A leaf is the sha256 of a row's document, a node that of the hashes of `fan` nodes below, joined by commas; the root is
    over what is left after `levels` - 1 of such steps. So no array holds more than `fan` hashes up to fan ** levels rows, and
    a group of most rows is spread over ranges and nodes.
    """
    steps = Steps(rows.sparkSession)
    leaves = rows.select(F.col(group).alias("group"), F.col(order).alias("order"), F.sha2(canonical_json(rows, columns), 256).alias("h"))
    ranged = in_ranges(leaves, ["group"], ["order"], steps, "leaves")
    nodes = sums_before(ranged, ["group"], ["order"], {"n": F.lit(1)}).select("group", "n", "h")
    joined = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), ","), 256)
    for _ in range(levels - 1):
        nodes = nodes.groupBy("group", F.floor(F.col("n") / fan).alias("above")).agg(joined().alias("h")).withColumnRenamed("above", "n")
    return nodes.groupBy("group").agg(joined().alias("fingerprint")).withColumnRenamed("group", group)


def cache_validity(wanted: DataFrame, reports: DataFrame, files: DataFrame) -> DataFrame:
    """(task, state) of wanted (task, fingerprint): `valid` if a report (task, fingerprint, path, size_bytes) of that
    fingerprint names a file (path, bytes, verified) of the stated size that was verified; else the first reason against it:
    no_report, other_fingerprint, no_file, other_size or not_verified. A task has one report at most, a path one file."""
    told = reports.select("task", F.col("fingerprint").alias("drawn__"), "path", "size_bytes")
    met = wanted.select("task", "fingerprint").join(told, "task", "left").join(files.select("path", "bytes", "verified"), "path", "left")
    reasons = [
        ("no_report", F.col("drawn__").isNull()),
        ("other_fingerprint", F.col("drawn__") != F.col("fingerprint")),
        ("no_file", F.col("bytes").isNull()),
        ("other_size", ~F.col("bytes").eqNullSafe(F.col("size_bytes"))),
        ("not_verified", ~F.coalesce("verified", F.lit(False))),
    ]
    state = F.lit("valid")
    for name, holds in reversed(reasons):
        state = F.when(holds, name).otherwise(state)
    return met.select("task", state.alias("state"))
