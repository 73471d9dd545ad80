"""Quality classification by importance resampling.

Two generative models of hashed word and punctuation n-grams (runs and pairs of runs), one of target texts (labelled
good) and one of the raw corpus, give each document the log weight log p_target - log p_raw. Documents are then drawn
without replacement in proportion to weight ** sharpness: Gumbel noise is added to the log weights and the k largest
keys are kept. k is the number of documents on the good side of the boundary that labelled documents set.

A bucket's ratio counts only where the two models differ beyond chance (by a factor of LEAST_RATIO, and by a likelihood
ratio of so many standard deviations); elsewhere the models are taken as equal, so that rare words say nothing. How many
deviations is one of LEVELS: the one with the least error on labelled documents that the models have not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm._common import chunks, fresh, materialize, mix, partitions, small_batches, texts_of
from pagemill.llm.pretokens import _packed, _unpacked
from pagemill.llm.tokens import runs

BUCKETS = 1 << 21
BLOCK = 1 << 15
#: Labelled documents that are learned from: about so many good ones and so many others, chosen by a hash of their ids.
MOST_LABELLED = 20_000
LEVELS, LEAST_RATIO = (3.0, 4.0, 5.0, 6.0, 7.5, 9.0), 2.0
#: The power of the weights: 1 draws by the ratio itself. (On 0.1 GB of labelled documents 1 keeps 97.5 % of the clean ones
#: and 5.7 % of the toxic ones; 8, which is hardly a draw any more, 97.7 % and 4.3 %.)
SHARPNESS = 1.0
CHUNK = 1 << 20


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct runs and pairs of neighbouring runs of each text, and the texts' bounds.

    A text counts an n-gram once, so that a word which one text repeats a thousand times says little of others. That
    much of a text repeats is an n-gram of its own: one for each halving of the share of its pairs that are distinct.
    """
    h, first = runs(texts)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    inside = of[:-1] == of[1:]
    pairs = of[:-1][inside] * BUCKETS + (mix(h[:-1] * np.uint64(3) + h[1:])[inside] >> shift).astype(np.int64)
    distinct = np.unique(pairs)
    many, few = (np.bincount(x // BUCKETS, minlength=len(texts)) for x in (pairs, distinct))
    halved = [np.flatnonzero((many >= 1 << j) & (few << j <= many)) * BUCKETS + int(mix(np.array([j], np.uint64))[0] >> shift) for j in range(1, 8)]
    keys = np.unique(np.concatenate([of * BUCKETS + (h >> shift).astype(np.int64), distinct, *halved]))
    return keys % BUCKETS, np.searchsorted(keys, np.arange(len(texts) + 1) * BUCKETS)


def _add(counts: np.ndarray, found: np.ndarray) -> None:
    which, n = np.unique(found, return_counts=True)
    counts[which] += n.astype(np.uint32)


def _counted(batches):
    """Per task: counts of all documents (model 0) and of the good ones to learn from (model 1), in blocks."""
    counts = np.zeros((2, BUCKETS), np.uint32)  # of one task, which reads far fewer than 2**32 words
    for part in chunks(batches, "text", CHUNK):
        found, first = features(texts_of(part))
        _add(counts[0], found)
        good = np.array([x == 1 for x in part.column(1).to_pylist()])
        _add(counts[1], found[np.repeat(good, np.diff(first))])
    for model in (0, 1):
        for at in range(0, BUCKETS, BLOCK):
            if (own := counts[model, at : at + BLOCK]).any():
                yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.int32()), "at": pa.array([at], pa.int32()), "counts": [_packed(own)]})


def _summed(batches):
    sums: dict = {}
    for batch in batches:
        for r in batch.to_pylist():
            own = _unpacked(r["counts"]).astype(np.int64)
            key = (r["model"], r["at"])
            sums[key] = sums[key] + own if key in sums else own
    for (model, at), own in sums.items():
        yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.int32()), "at": pa.array([at], pa.int32()), "counts": [own.tobytes()]})


def log_ratios(raw: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log p_target - log p_raw of each bucket, smoothed; and how many of LEVELS the difference reaches."""
    expected = raw * (target.sum() / max(1, raw.sum()))
    ratio = np.log((target + 1) / (expected + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        deviance = 2 * (np.where(target > 0, target * np.log(target / np.maximum(expected, 1e-9)), 0.0) - (target - expected))
    level = np.searchsorted(LEVELS, np.sqrt(np.maximum(deviance, 0)), side="right")
    return ratio.astype(np.float32), np.where(np.abs(ratio) > np.log(LEAST_RATIO), level, 0).astype(np.uint8)


def _labelled(docs: DataFrame, labels: DataFrame, most: int, label: str = "label") -> DataFrame:
    """docs with the column `label`: 1 good and to learn from, 2 good and 3 not good to calibrate by; else null."""
    own = fresh(docs, "id_")
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    every = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.min(good).alias("good"))
    sizes = {r.good: r.n for r in every.groupBy("good").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("good") == 1, min(1.0, most / max(1, sizes.get(1, 0)))).otherwise(min(1.0, most / max(1, sizes.get(0, 0))))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sample = every.where(h < share * (1 << 20)).select(F.col("doc_id").alias(own), F.when(F.col("good") == 0, 3).when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0, 2).otherwise(1).alias(label))
    # At most about 2 * most ids of 12 bytes: bounded by the parameter, whatever the corpus.
    return docs.join(F.broadcast(sample), docs["doc_id"] == F.col(own), "left").drop(own)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """The log ratio and the level of every bucket. The raw model counts all documents; the models have BUCKETS numbers each."""
    spark = small_batches(docs.sparkSession)
    rows = _labelled(docs.select("doc_id", "text"), labels, most_labelled).select("text", "label")
    schema = "model int, at int, counts binary"
    sums = rows.mapInArrow(_counted, schema).repartition(min(64, partitions(spark)), "model", "at").mapInArrow(_summed, schema)
    counts = np.zeros((2, BUCKETS), np.int64)
    for r in sums.toLocalIterator():
        counts[r.model, r["at"] : r["at"] + BLOCK] = np.frombuffer(r.counts, "<i8")
    return log_ratios(*counts)


def weigh(texts: list[str], ratios: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log weights of the texts, a row for each of LEVELS."""
    found, first = features(texts)
    ratio, level = ratios[0][found], ratios[1][found]
    out = []
    for i in range(len(LEVELS)):
        upto = np.concatenate([[0.0], np.cumsum(np.where(level > i, ratio, 0), dtype=np.float64)])
        out.append(np.round(upto[first[1:]] - upto[first[:-1]], 6) + 0.0)
    return np.array(out)


def boundary(good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """The log weight from which on documents count as good, with least balanced error on labelled documents; midway
    between its neighbours; and that error. Without labels of both kinds: none is below it."""
    if not len(good) or not len(bad):
        return -np.inf, 1.0
    every = np.unique(np.concatenate([good, bad]))
    lost, passed = np.searchsorted(np.sort(good), every) / len(good), 1 - np.searchsorted(np.sort(bad), every) / len(bad)
    best = int(np.argmin(lost + passed))
    return float((every[best] + every[best - 1]) / 2) if best else float(every[0]), float(lost[best] + passed[best])


def _gumbel(id_: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> float:
    """Exactly the k-th largest `key`, by histograms of BINS bins; nothing but counts reaches the driver."""
    bins = 4096
    total, low, high = keys.agg(F.count("key"), F.min("key"), F.max("key")).first()
    if not total or k <= 0:
        return np.inf
    if k >= total:
        return low
    while low < high:
        width = (high - low) / bins
        bin_ = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        found = keys.where(F.col("key").between(low, high)).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("b")).collect()
        for r in found:
            if k <= r.n:
                if (r.low, r.high) == (low, high) and len(found) == 1:
                    low = high  # one bin that no longer narrows: adjacent numbers
                low, high = (r.low, r.high) if low < high else (low, high)
                break
            k -= r.n
    return low


class Model:
    def __init__(self, ratios: tuple[np.ndarray, np.ndarray], level: int, least: float, threshold: float, sharpness: float, seed: int):
        self.ratios, self.level, self.least, self.threshold, self.sharpness, self.seed = ratios, level, least, threshold, sharpness, seed


def _scored(docs: DataFrame, labels: DataFrame, ratios: tuple[np.ndarray, np.ndarray], most: int, columns: list[str]) -> tuple[DataFrame, str, str]:
    """The stored rows of docs with the named columns, the label, and the log weight at each of LEVELS; the names of these
    two. Texts are read once."""
    label, weights = fresh(docs, "label"), fresh(docs, "weights")

    def score(batches):
        for part in chunks(batches, "text", CHUNK):
            found = weigh(texts_of(part), ratios)
            lists = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * len(LEVELS), found.T.ravel())
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in [*columns, label]), lists], names=[*columns, label, weights])

    rows = _labelled(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, "text"])]), labels, most, label)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(label, T.IntegerType()), T.StructField(weights, T.ArrayType(T.DoubleType()))])
    return materialize(rows.mapInArrow(score, schema), "weights"), label, weights


def _key(weight: Column, sharpness: float, seed: int) -> Column:
    return weight * sharpness + _gumbel(F.coalesce(F.col("doc_id"), F.lit(0)), seed)


def _drawn(docs: DataFrame, labels: DataFrame, columns: list[str], sharpness: float, seed: int, most_labelled: int) -> tuple[DataFrame, Column, Model]:
    """The stored rows of docs, their log weight, and the fitted model."""
    ratios = fit(docs, labels, most_labelled)
    rows, label, weights = _scored(docs, labels, ratios, most_labelled, columns)
    each = [F.min(F.col(weights)[i]).alias(f"w{i}") for i in range(len(LEVELS))]
    # A row for each id of the sample: of rows that repeat a labelled id, the least weights count.
    known = rows.where(F.col(label) >= 2).groupBy("doc_id", F.col(label).alias("label")).agg(*each).toPandas()
    good, bad = (known[known.label == x] for x in (2, 3))
    bounds = [boundary(good[f"w{i}"].to_numpy(), bad[f"w{i}"].to_numpy()) for i in range(len(LEVELS))]
    level = min(range(len(LEVELS)), key=lambda i: (bounds[i][1], -i))
    weight, least = F.col(weights)[level], bounds[level][0]
    k = rows.where(weight >= float(least)).count()
    threshold = float(kth_largest(rows.select(_key(weight, sharpness, seed).alias("key")), k))
    return rows, weight, Model(ratios, level, least, threshold, sharpness, seed)


def resample(docs: DataFrame, labels: DataFrame, sharpness: float = SHARPNESS, seed: int = 7, most_labelled: int = MOST_LABELLED) -> tuple[DataFrame, Model]:
    """((doc_id, log_weight, kept) for each row of docs (doc_id, text), the fitted model).

    A null or empty text has the log weight 0. A label row with a null quality or id says nothing of quality; a
    repeated id is good if all its labels are. Rows that repeat an id share the noise; a null id has that of 0. Of rows
    whose keys tie at the k-th place all are kept. Without labels of both kinds all rows are kept. An empty table gives no
    rows. Columns other than the named ones are not read. docs must be a stored table.
    """
    rows, weight, model = _drawn(docs, labels, ["doc_id"], sharpness, seed, most_labelled)
    kept = _key(weight, sharpness, seed) >= model.threshold
    return rows.select("doc_id", weight.alias("log_weight"), kept.alias("kept")), model


def keep(docs: DataFrame, labels: DataFrame, sharpness: float = SHARPNESS, seed: int = 7, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """The rows of docs that resampling keeps, with all their columns, whatever their names; each row by itself as
    `resample` says."""
    rows, weight, model = _drawn(docs, labels, docs.columns, sharpness, seed, most_labelled)
    return rows.where(_key(weight, sharpness, seed) >= model.threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
