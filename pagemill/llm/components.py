"""Connected components of a link table, by alternating star contractions; no link ever leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import Scratch


def _forest(batches):
    """Each partition keeps a spanning forest of its links: every node with the smallest of its tree."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = up = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent]
    pairs = [(x, r) for x, r in pairs if x != r]
    for at in range(0, len(pairs), 1 << 16):
        part = pairs[at : at + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"node": pa.array([p[0] for p in part], pa.int64()), "low": pa.array([p[1] for p in part], pa.int64())})


def _state(pairs: DataFrame) -> tuple:
    """Number of links and the sum of their hashes: equal sets have equal states."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, low): for every node of links (a bigint, b bigint), the smallest node that it can reach.

    Nodes without a link do not appear. Null ends are dropped; self-links and repeated links change nothing; an empty
    table gives an empty table.
    """
    scratch = Scratch(links.sparkSession)
    pairs = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a is not null and b is not null and a <> b")
    pairs = scratch.keep(pairs.mapInArrow(_forest, "node bigint, low bigint"), "links")
    state = _state(pairs)
    while state[0]:
        # Large star: every larger neighbour of a node is tied to the smallest of its neighbourhood.
        both = pairs.union(pairs.select(F.col("low").alias("node"), F.col("node").alias("low")))
        least = both.groupBy("node").agg(F.min("low").alias("m")).select("node", F.least("m", "node").alias("m"))
        large = both.where("low > node").join(least, "node").select(F.col("low").alias("node"), F.col("m").alias("low"))
        # Small star: every smaller neighbour (and the node itself) is tied to the smallest one.
        least = large.groupBy("node").agg(F.min("low").alias("m"))
        small = large.join(least, "node").select(F.col("low").alias("node"), F.col("m").alias("low")).union(least.select("node", F.col("m").alias("low")))
        pairs = scratch.keep(small.where("node <> low").distinct(), "links")
        before, state = state, _state(pairs)
        if state == before:
            break
    lows = pairs.groupBy("node").agg(F.min("low").alias("low"))
    return lows.union(pairs.select(F.col("low").alias("node"), "low").distinct())
