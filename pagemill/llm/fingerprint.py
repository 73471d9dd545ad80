"""Document fingerprints by one-permutation MinHash with optimal densification, in DataFrame expressions only.

The hash of every run of WORDS words falls into one of BINS bins by its high bits, and each bin keeps its least hash. An
empty bin takes the value of a non-empty one drawn at random by a hash of the empty bin and the attempt (the same draw in
every document), so that the collision probability of a bin stays the Jaccard similarity. Stored are the low BITS bits of
each bin; as unequal bins agree with probability 2 ** -BITS, the share of equal bins is corrected for that.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import NULL_ID

BINS, BITS, WORDS = 128, 8, 5
#: Bits of a hash below those that name its bin.
LOW = 64 - BINS.bit_length() + 1
PROBES = 4
#: Ids that differ only in so many low bits are neighbours of one window.
SPAN = 12
WHITE = " \t\n\x0b\f\r"


def _empty(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << LOW) - 1)) == F.lit((1 << LOW) - 1)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("smallint")


def _draws() -> list[Column]:
    """For each attempt, the bin that an empty bin draws: fixed by a seed."""
    rng = random.Random(1)
    return [F.array(*[F.lit(rng.randrange(BINS)) for _ in range(BINS)]) for _ in range(PROBES)]


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array of BINS values of a text column; an empty array for a text without words.

    A text of fewer than WORDS words counts as one run. Each step is a projection of its own, as later ones use it
    several times.
    """
    w, m, h, s, b, f = (f"{out}__{x}" for x in ("words", "m", "hashes", "sorted", "bins", "filled"))
    df = df.withColumn(w, F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(WHITE)), r"[\x20\x09-\x0D]+"))
    df = df.withColumn(m, F.when((F.size(w) == 1) & (F.col(w)[0] == ""), 0).otherwise(F.size(w)))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.col(m) - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(WORDS)]))
    df = df.withColumn(h, runs)
    ends = F.array(*[F.lit(((i + 1) << LOW) - 1) for i in range(-BINS // 2, BINS // 2)])
    df = df.withColumn(s, F.sort_array(F.concat(F.col(h), ends)))
    df = df.withColumn(b, F.filter(F.col(s), lambda x, i: (i == 0) | (F.shiftright(x, LOW) != F.shiftright(F.get(F.col(s), i - 1), LOW))))
    df = df.withColumn(f, F.filter(F.col(b), lambda x: ~_empty(x)))

    def drawn(i: Column) -> Column:
        tries = [F.get(F.col(b), F.get(d, i)) for d in _draws()]
        every = F.array_min(F.transform(F.col(f), lambda y: F.struct(F.xxhash64(i, F.shiftright(y, LOW)).alias("h"), y.alias("y"))))
        return F.coalesce(*[F.when(~_empty(t), _low(t)) for t in tries], _low(every["y"]))

    dense = F.transform(F.col(b), lambda x, i: F.when(_empty(x), drawn(i)).otherwise(_low(x)))
    return df.withColumn(out, F.when(F.col(m) == 0, F.array().cast("array<smallint>")).otherwise(dense)).drop(w, m, h, s, b, f)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate (0 to 1) of two fingerprints; 1 for two without words, 0 if only one is without."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(inside)


def packed(a: Column) -> Column:
    """The values of all bins as hexadecimal digits."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x.cast("bigint")), BITS // 4, "0")), "")


def _window(k: Column) -> Column:
    """The number of an id's window: 0 to 2**52, in the order of the ids, whatever their signs."""
    return F.shiftrightunsigned(k.bitwiseXOR(F.lit(NULL_ID)), SPAN)


def _next_lower(keys: DataFrame, low: int, high: int) -> DataFrame:
    """(k, following): for each distinct k, from low to high and not negative, the next lower one, the highest after the
    lowest. A window holds no more than 2 ** SPAN keys; the ends of windows are settled by the same means among windows."""
    window = F.shiftright(F.col("k") - low, SPAN)
    led = keys.select("k", window.alias("b"), F.lead("k").over(Window.partitionBy(window).orderBy(F.desc("k"))).alias("following"))
    last = (high - low) >> SPAN
    if not last:
        return led.select("k", F.coalesce("following", F.lit(high)).alias("following"))
    tops = keys.groupBy(window.alias("b")).agg(F.max("k").alias("top"))
    after = _next_lower(tops.select(F.col("b").alias("k")), 0, last).withColumnRenamed("k", "b")
    entry = after.join(tops.withColumnRenamed("b", "following"), "following").select("b", "top")
    return led.join(entry, "b").select("k", F.coalesce("following", "top").alias("following"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (id, text, fp) with next_text and next_fp, those of the next row by descending id (after the last: the first).

    Rows of one id follow by hash of the text, then by text. One shuffle: ids of a window share all but their low bits,
    and each window gets a copy of the row with which the next one begins. Rows that repeat an id share a window.
    """
    ordered = F.struct("id", F.xxhash64("text").alias("h"), "text")
    keyed = docs.select(_window(F.col("id")).alias("w"), "id", "text")
    low, high = keyed.agg(F.min("w"), F.max("w")).first()
    if low is None:
        return docs.select("*", F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    tops = keyed.groupBy("w").agg(F.max(ordered).alias("top"))
    after = _next_lower(keyed.select(F.col("w").alias("k")).distinct(), low, high)
    ghosts = after.join(tops.withColumnRenamed("w", "following"), "following").select(F.col("k").alias("w"), F.lit(None).cast("bigint").alias("id"), F.col("top.text").alias("text"))
    rows = with_fingerprint(keyed.unionByName(ghosts), "text", "fp")
    w = Window.partitionBy("w").orderBy(F.col("id").desc_nulls_last(), F.xxhash64("text").desc(), F.desc("text"))
    return rows.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)}).where("id is not null").drop("w")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row by
    descending id. A null text counts as empty, a null id as the smallest; rows of one id follow by the text's hash and
    then the text. A text without words has an empty fingerprint. A single row is its own next. An empty table gives no
    rows; columns other than the two named are not read.
    """
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.lit(None).cast("array<smallint>").alias("fp"))
    rows = with_next(own).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "edited_fp")
    return rows.select(F.nullif(F.col("id"), F.lit(NULL_ID)).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("fp")).alias("fingerprint"), packed(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
