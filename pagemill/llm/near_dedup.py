"""Near-duplicate groups by bottom-k sketches of one hash function.

Texts with equal shingle sets form one class, which only its smallest id represents. A representative retains the k
smallest hashes of its set. Inverted lists of the retained values give the overlaps: under one order of all values
(rarest first) two sketches with at least `least` common values share a value among their first m - least + 1, so only
those are indexed, and what is common to many texts is indexed nowhere unless a text consists of little else.

The lists are made twice. Those of sketches of K values only tell which texts can have a partner at all; of these, and
among these, sketches of WIDE values (for most texts the whole set, so that nothing is left to chance) make the lists
whose members are compared. A member meets another one of its list only if the sizes of their sets and the places of the
common value in both orders allow the similarity. Pairs are filtered by the Jaccard estimate of their union's sketch and
then verified on full sets.

A list is not expanded into all its pairs either: its members are first compared with a leader, the one with the fewest
rarer values, and later only members of different components with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import NULL_ID, Scratch, chunks, fresh, id_text, texts_of
from pagemill.llm.components import components
from pagemill.llm.shingles import shingle_sets

K, WIDE = 64, 1024
#: Standard deviations below the mean of what two sketches have in common: the exact
#: binomial tail at the stated similarity is up to 1.5e-7 a pair (0.85, 64 values) and 1.9e-8 (0.8).
DEVIATIONS = 6.0
#: Rounds of comparing with a leader before components are compared with each other.
STAR_ROUNDS = 1
CHUNK = 1 << 20


def _signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed numbers of the same order."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """(doc_id, h, n, c1, c2, sketch): n the set's size, c1 and c2 a 128-bit hash of the set, sketch its k smallest
    hashes in order."""

    def sketch(batches):
        for part in chunks(batches, "text", CHUNK):
            sets = shingle_sets(texts_of(part), words)
            names = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            half = lambda shift: pa.array([((n >> shift) & (2**64 - 1)) - 2**63 for n in names], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0).cast(pa.int64()), "h": part.column(2), "n": pa.array([len(s) for s in sets], pa.int64()), "c1": half(64), "c2": half(0), "sketch": pa.array([_signed(s[:k]) for s in sets], pa.list_(pa.int64()))})

    return docs.mapInArrow(sketch, "doc_id bigint, h bigint, n bigint, c1 bigint, c2 bigint, sketch array<bigint>")


def inverted_lists(reps: DataFrame, percent: int, k: int) -> DataFrame:
    """(v, rep, n, m, place, least): each of reps (rep, n, sketch) under the rarest of its retained values, as far as a
    partner can need them, and only under values that others retain, too.

    m is the sketch's size, place the value's in the order from the rarest, and least what any partner has in common:
    all of percent * n, if the partner's set is whole as well; at least m * (2 p - 1) / p of a whole set, if it may not
    be; and of two full sketches k * p less DEVIATIONS standard deviations, as the common part is binomial.
    """
    p = percent / 100
    cut = max(0.0, p - DEVIATIONS * (p * (1 - p) / k) ** 0.5)
    values = reps.select("rep", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    found = values.join(often, "v").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("common"))
    n = F.col("n")
    whole = F.when(100 * n <= percent * k, F.ceil(n * percent / 100)).when(n <= k, F.floor(n * max(0.0, (2 * p - 1) / p)))
    sized = reps.select("rep", "n", F.size("sketch").cast("bigint").alias("m"), F.coalesce(whole, F.lit(int(k * cut))).alias("least"))
    rows = found.join(sized, "rep").withColumn("alone", F.col("m") - F.size("common"))
    room = F.greatest(F.col("m") - F.col("least") + 1 - F.col("alone"), F.lit(0)).cast("int")
    out = rows.select("rep", "n", "m", "least", "alone", F.posexplode(F.slice("common", 1, room)).alias("i", "c"))
    return out.select("c.v", "rep", "n", "m", (F.col("alone") + F.col("i")).alias("place"), "least")


def _may(x: str, y: str, percent: int, k: int) -> Column:
    """Whether sizes and places of the common value allow the similarity, if that value is the rarest common one."""
    sizes = f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
    left = f"least({x}.m - {x}.place, {y}.m - {y}.place)"
    places = f"if({x}.n <= {k} and {y}.n <= {k}, {100 + percent} * {left} >= {percent} * ({x}.n + {y}.n), {left} >= greatest({x}.least, {y}.least))"
    return F.expr(f"{sizes} and {places}")


def _led(lists: DataFrame, percent: int, k: int) -> DataFrame:
    """Distinct (a, b) of members of a list and its leader, if they are of different components."""
    row = F.struct("rep", "comp", "n", "m", "place", "least")
    lead = lists.groupBy("v").agg(F.min_by(row, F.struct("place", F.xxhash64("rep"), "rep")).alias("y"))
    met = lists.withColumn("x", row).select("v", "x").join(lead, "v").where(F.expr("x.comp <> y.comp") & _may("x", "y", percent, k))
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _apart(lists: DataFrame, percent: int, k: int) -> DataFrame:
    """Distinct (a, b) of members of a list that are of different components. The component with most members in the
    list meets only the others."""
    each = lists.groupBy("v", "comp").agg(F.count("*").alias("c"))
    main = each.groupBy("v").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    row = F.struct("rep", "comp", "n", "m", "place", "least")
    apart = lists.join(main.drop("comps"), "v")
    x, y = apart.where("comp <> main").select("v", row.alias("x")), apart.select("v", row.alias("y"), "main")
    met = x.join(y, "v").where(F.expr("x.comp <> y.comp and (y.comp = main or x.rep < y.rep)") & _may("x", "y", percent, k))
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _linked(rows, percent: int, k: int, least: float):
    """(a, b) of the rows (a, b, set_a, set_b) whose union's sketch lets the similarity be expected, and that have it."""
    for batch in rows:
        keep = []
        for i in range(batch.num_rows):
            x, y = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
            u, w = x[:k], y[:k]
            low = min(u[-1] if len(x) > k else 2**63 - 1, w[-1] if len(y) > k else 2**63 - 1)
            u, w = u[u <= low], w[w <= low]
            both = len(np.intersect1d(u, w, assume_unique=True))
            near = both >= least * (len(u) + len(w) - both)
            if near:
                both = len(np.intersect1d(x, y, assume_unique=True))
                near = 100 * both >= percent * (len(x) + len(y) - both)
            keep.append(near)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _grouped(docs: DataFrame, words: int, percent: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, n, comp, low) for each row: hash of the text, set size, the component's name and its smallest id.
    Names are ids where those are unique; a null id is NULL_ID; rows without shingles have no name."""
    source = id_text(docs, id_col, text_col)
    source = source.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    scratch = Scratch(docs.sparkSession)
    each = scratch.keep(sketches(source, words, k), "sketches")
    classes = each.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # A class is named by its smallest id; where ids repeat, two classes may share it, and a half of their hash names them.
    by_id = not each.groupBy("doc_id").count().where("count > 1").limit(1).count()
    reps = scratch.keep(classes.withColumn("rep", F.col("id" if by_id else "c1")), "classes")
    first = inverted_lists(reps.select("rep", "n", "sketch"), percent, k)
    crowd = first.groupBy("v").agg(F.count("*").alias("f")).where("f > 1").select("v")
    able = scratch.keep(first.select("v", "rep").join(crowd, "v").select("rep").distinct().join(reps.select("rep", "id"), "rep"), "able")

    def sets(batches):
        for part in chunks(batches, "text", CHUNK):
            whole = shingle_sets(texts_of(part), words)
            rep = part.column(0) if by_id else pa.array([(xxhash.xxh3_128_intdigest(s.tobytes()) >> 64) - 2**63 for s in whole], pa.int64())
            yield pa.RecordBatch.from_pydict({"rep": rep, "n": pa.array([len(s) for s in whole], pa.int64()), "set": pa.array([_signed(s) for s in whole], pa.list_(pa.int64()))})

    texts = source.select("doc_id", "text").join(able.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    full = texts.mapInArrow(sets, "rep bigint, n bigint, set array<bigint>")
    if not by_id:  # further texts under the same ids go, and repeated ones
        full = full.join(able.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.first("n").alias("n"), F.first("set").alias("set"))
    full = scratch.keep(full, "sets")
    lists = inverted_lists(full.select("rep", "n", F.slice("set", 1, WIDE).alias("sketch")), percent, WIDE)
    lists = scratch.keep(lists, "lists")
    least = max(0.0, percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / WIDE) ** 0.5)
    left, right = (full.select(F.col("rep").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    comps, links = lists.select("rep", F.col("rep").alias("comp")).limit(0), None
    for round_ in range(STAR_ROUNDS + 1):
        tagged = lists.withColumn("comp", F.col("rep")) if links is None else lists.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        pairs = _led(tagged, percent, WIDE) if round_ < STAR_ROUNDS else _apart(tagged, percent, WIDE)
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
        found = scratch.keep(both.mapInArrow(lambda rows: _linked(rows, percent, WIDE, least), "a bigint, b bigint"), f"links{round_}")
        links = found if links is None else links.union(found)
        comps = scratch.keep(components(links).select(F.col("node").alias("rep"), F.col("low").alias("comp")), "components")
    named = reps.select("c1", "c2", "rep", "id").join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).select("c1", "c2", "comp", "id")
    if by_id:
        named = named.withColumn("low", F.col("comp"))
    else:
        named = named.join(named.groupBy("comp").agg(F.min("id").alias("low")), "comp")
    named = scratch.keep(named.select("c1", "c2", "comp", "low"), "named")
    scratch.drop("classes", "able", "sets", "lists", "components", *[f"links{r}" for r in range(STAR_ROUNDS + 1)])
    return each.select("doc_id", "h", "n", "c1", "c2").join(named, ["c1", "c2"], "left").select("doc_id", "h", "n", "comp", F.coalesce("low", "doc_id").alias("low"))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Words are runs of bytes other than U+0020 and U+0009-U+000D, A-Z lower-cased; a text of fewer than `words` words is
    one shingle. Two texts are linked where 100 * |A & B| >= percent * |A | B|. component_id is the smallest doc_id that
    can be reached, kept says whether it is the row's own.

    A null, empty or blank text has no shingles, stays alone and is kept. Rows with equal sets are one class. A null id
    counts as the smallest one. Rows that repeat an id get a row each; with different texts they are documents of their
    own that happen to share the id. An empty table gives no rows. Columns other than the two named are not read, so
    their names cannot clash. docs must be a stored table.
    """
    rows = _grouped(docs, words, percent, k, id_col, text_col)
    real = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return rows.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("low").alias("component_id"), (F.col("doc_id") == F.col("low")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which each group of near-duplicates keeps one: that of the smallest id, of rows that share it
    that of the smallest hash of the text, and of rows that share both the smallest by all other columns in order (maps apart).

    Links are those of near_groups. Rows without words are in no group; of those that repeat id and text one stays. All
    columns return as they are, whatever their names. An empty table gives no rows. docs must be a stored table.
    """
    rows = _grouped(docs, words, percent, k, id_col, text_col)
    alone = rows.where("comp is null").select("doc_id", "h")
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "h")).alias("x")).select("x.*")
    kept = alone.union(first).select(F.struct("doc_id", "h").alias("kept"))
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, F.struct(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h")))
    out = keyed.join(kept, keyed[key] == kept["kept"], "left_semi")
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        order = F.struct(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
        out = out.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
