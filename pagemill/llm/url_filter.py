"""URL filters: rules first, then the ratio of two character language models.

The models of accepted and rejected URLs are Markov models of variable order: the probability of a character is that of
the longest context, smoothed with those of all shorter ones (each order adds STRENGTH times the next lower order's
probability). Contexts are counted exactly: a table has every string of ORDER + 1 characters (a gram) that was seen, with
its counts; those of shorter contexts are sums over it. It grows with the corpus and is never gathered: URLs are read in
blocks, a block sends its distinct grams, they meet the table in a join, and what a gram adds to the score returns to the
block.
The verdict is the log-likelihood difference a character against a threshold that is calibrated on URLs that the models
have not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import chunks, code_points, materialize, texts_of

ORDER = 4
ALPHABET = 256.0
STRENGTH = 2.0
#: Of ten URLs with a known verdict, so many are held out of the models to calibrate the threshold.
HELD_OUT = 2
CHUNK = 1 << 20
#: Bytes of URLs in a block.
BLOCK = 1 << 17


def split_url(url):
    """(host, path) columns: the host after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; the path then
    up to "?", "#" or the end. Null or without "://": both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(path, F.lit(""))


def rule_of(host, path, rules: list[tuple[str, str, str]]):
    """(rule, verdict) columns of the longest rule (verdict, host, path prefix) that fits; null where none does. A rule
    fits its host and all subdomains if the path starts with its path. Equally long rules: the first in order wins."""
    rule = verdict = F.lit(None).cast("string")
    for what, of, start in sorted(sorted(rules, key=lambda r: r[1] + r[2], reverse=True), key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct grams; for each character (and the end) of the texts the number of the gram that ends there; and the
    texts' bounds."""
    points, ends = code_points(["\x02" * ORDER + t + "\x03" for t in texts])
    at = np.ones(len(points), bool)
    for i in range(ORDER):
        at[ends[:-1] + i] = False
    at = np.flatnonzero(at)
    signs, sign = np.unique(points, return_inverse=True)
    number = np.zeros(len(at), np.int64)
    first = np.zeros(0, np.int64)
    for back in range(ORDER, -1, -1):  # numbered anew each time, so that they stay below the number of characters
        _, first, number = np.unique(number * len(signs) + sign[at - back], return_index=True, return_inverse=True)
    every = points[at[first][:, None] + np.arange(-ORDER, 1)].astype("<u4").tobytes().decode("utf-32-le")
    return [every[i : i + ORDER + 1] for i in range(0, len(every), ORDER + 1)], number, np.searchsorted(at, ends)


def _counted(known: DataFrame) -> DataFrame:
    """(gram, accepted, rejected): how often each gram occurs in the texts of side 0 and 1."""

    def count(batches):
        for part in chunks(batches, "text", CHUNK):
            grams, number, first = _grams(texts_of(part))
            of = np.repeat(np.array(part.column(1).to_pylist(), np.int64), np.diff(first))
            yield pa.RecordBatch.from_pydict({"gram": pa.array(grams, pa.string())} | {name: np.bincount(number[of == side], minlength=len(grams)) for side, name in enumerate(("accepted", "rejected"))})

    each = known.select("text", "side").mapInArrow(count, "gram string, accepted bigint, rejected bigint")
    return each.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def _differences(counts: DataFrame) -> DataFrame:
    """(gram, difference): of the log-probabilities of a gram's last character after its others, accepted less rejected."""
    sides = ("accepted", "rejected")

    def level(order):  # strings of order + 1 characters with their counts
        return counts.groupBy(F.expr(f"right(gram, {order + 1})").alias("gram")).agg(*[F.sum(x).alias(x) for x in sides])

    def probabilities(rows, lower):
        return rows.select("gram", *[((F.col(x) + STRENGTH * lower(x)) / (F.col(f"all_{x}") + STRENGTH)).alias(f"p_{x}") for x in sides])

    total = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(f"all_{x}") for x in sides])  # one row
    p = probabilities(level(0).crossJoin(F.broadcast(total)), lambda x: F.lit(1 / ALPHABET))
    for order in range(1, ORDER + 1):
        context = Window.partitionBy(F.expr(f"left(gram, {order})"))
        rows = level(order).withColumns({f"all_{x}": F.sum(x).over(context) for x in sides})
        shorter = p.select(F.col("gram").alias("shorter"), *[F.col(f"p_{x}").alias(f"lower_{x}") for x in sides])
        p = probabilities(rows.join(shorter, F.expr(f"right(gram, {order})") == F.col("shorter")), lambda x: F.col(f"lower_{x}"))
    return p.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("difference"))


class Model:
    """counts: a stored table (gram, accepted, rejected)."""

    def __init__(self, counts: DataFrame, threshold: float = 0.0):
        self.counts, self.threshold = counts, threshold

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood difference a character; positive is like accepted URLs. For a few texts."""
        urls = self.counts.sparkSession.createDataFrame(list(enumerate(texts)), "at bigint, text string")
        return np.array([r.score for r in scored(urls, self, "text", "at").orderBy("at").collect()])


def _known(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows with a verdict (text, side): those to learn from and those held out."""
    text = F.coalesce("url", F.lit(""))
    known = urls.where("verdict in ('allow', 'block')").select(text.alias("text"), (F.col("verdict") == "block").cast("int").alias("side"), _held(text).alias("held"))
    return known.where("not held").drop("held"), known.where("held").drop("held")


def _held(text):
    return F.pmod(F.xxhash64(text), F.lit(10)) < HELD_OUT


def _learned(known: DataFrame) -> Model:
    return Model(materialize(_counted(known), "url-grams"))


def _threshold(held: DataFrame) -> float:
    """From scores (side, score) of held-out URLs in bins of 0.01, however many they are."""
    bins = held.groupBy("side", F.round("score", 2).alias("bin")).agg(F.count("*").alias("n")).toPandas()
    good, bad = (bins[bins.side == i].sort_values("bin") for i in (0, 1))
    if not len(good) or not len(bad):
        return 0.0
    cuts = np.unique(bins["bin"].to_numpy())
    wrong = [good.n[good["bin"] < c].sum() / good.n.sum() + bad.n[bad["bin"] >= c].sum() / bad.n.sum() for c in cuts]
    return float(cuts[int(np.argmin(wrong))]) - 0.005


def fit(urls: DataFrame) -> Model:
    """From all rows of urls (url, verdict allow or block; others are not used). Without one of the verdicts its model is
    the uniform one; without both the threshold is 0."""
    known, held = _known(urls)
    model = _learned(known)
    model.threshold = _threshold(scored(held, model, "text", "side"))
    return model


def scored(urls: DataFrame, model: Model, url_col: str, *more) -> DataFrame:
    """The columns `more` of each row of urls and its score."""
    kept = urls.select(*more, F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("text"))
    named = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]

    def numbered(batches):
        block, size = TaskContext.get().partitionId() << 32, 0
        for part in chunks(batches, "text", BLOCK):
            own = part.column(part.num_columns - 1).nbytes
            if size and size + own > BLOCK:
                block, size = block + 1, 0
            size += own
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([block] * part.num_rows, pa.int64())], names=[*part.schema.names, "block"])

    def grams(batches):
        for part in chunks(batches, "text", CHUNK):
            block, texts = np.array(part.column(1).to_pylist(), np.int64), texts_of(part)
            for b in np.unique(block).tolist():
                own = _grams([texts[i] for i in np.flatnonzero(block == b).tolist()])[0]
                yield pa.RecordBatch.from_pydict({"block": pa.array([b] * len(own), pa.int64()), "gram": pa.array(own, pa.string())})

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right["gram"].to_pylist(), right["difference"].to_pylist()))
        own, number, first = _grams(left["text"].to_pylist())
        each = np.array([known[g] for g in own])[number]
        upto = np.concatenate([[0.0], np.cumsum(each)])
        found = np.round((upto[first[1:]] - upto[first[:-1]]) / np.maximum(1, np.diff(first)), 9)
        return left.drop_columns(["text", "block"]).append_column("score", pa.array(found))

    # Stored, so that a block has the same rows each time it is read.
    rows = materialize(kept.mapInArrow(numbered, ", ".join([*named, "text string", "block bigint"])), "url-blocks")
    sent = materialize(rows.select("text", "block").mapInArrow(grams, "block bigint, gram string"), "url-sent")
    unseen = sent.select("gram", F.lit(0).cast("bigint").alias("accepted"), F.lit(0).cast("bigint").alias("rejected"))
    counts = model.counts.unionByName(unseen).groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    back = sent.join(_differences(materialize(counts, "url-counts")), "gram").select("block", "gram", "difference")
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, ", ".join([*named, "score double"]))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages.

    The models learn from all URLs that a rule decides; they decide where no rule fits (score at or above the threshold:
    allow). A null URL counts as empty and has empty host and path; repeated rows give a row each, an empty table none;
    columns other than the two named are not read.
    """
    host, path = split_url(F.col("url"))
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = own.withColumns({"rule": rule, "verdict": verdict})
    model = _learned(_known(ruled)[0])
    rows = materialize(scored(ruled, model, "url", "page_id", "host", "path", "rule", "verdict", _held(F.coalesce("url", F.lit(""))).alias("held")), "url-scores")
    model.threshold = _threshold(rows.where("held and verdict in ('allow', 'block')").withColumn("side", (F.col("verdict") == "block").cast("int")))
    by_method = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return rows.drop("held").withColumn("verdict", F.coalesce("verdict", by_method))
