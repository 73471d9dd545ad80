"""Mixing, fill-in-the-middle and centroid clustering against plain Python on small tables with hard rows."""

import collections
import fractions
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import centroids, fill_middle, mixing, queries
from pagemill.llm._common import Scratch

NAMES = "doc_id bigint, text string, source string, size string, key string, src int, none int, cut string, units int, n string, h int"
FURTHER = ("s", "k", 1, 2, "c", 3, "n", 4)


def stored(spark, rows, names, path, parts=3):
    spark.createDataFrame(rows, names).repartition(parts).write.parquet(str(path))
    return spark.read.parquet(str(path))


def waterfill(sizes: list[int], weights: list[int], most: int = 3) -> list[fractions.Fraction]:
    """Shares by weight; whoever is above its bound keeps the bound, and the rest is shared anew."""
    total, fixed = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in fixed)
        weight = sum(w for i, w in enumerate(weights) if i not in fixed)
        share = [fractions.Fraction(most * s if i in fixed else left * w / fractions.Fraction(weight)) for i, (s, w) in enumerate(zip(sizes, weights))]
        above = {i for i, (x, s) in enumerate(zip(share, sizes)) if x > most * s} - fixed
        if not above:
            return share
        fixed |= above


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        source = rng.choice(["b", "b", "b", "b", "a", "é", "Z", None, "\U0001f600", ""])
        text = rng.choice([None, "", " \n\t ", "a", "two\x0bwords", " lead  and\ttrail \r\n"]) if i % 5 == 0 else "  ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 60)))
        rows.append((i, text, source, *FURTHER))
    rows += [(None, f"null id {'x ' * (i % 7)}", "b", *FURTHER) for i in range(20)]
    rows += [(7000, "one long " * 4000, "é", *FURTHER), (None, None, None, *[None] * 8)]
    rows += [(8000, "all the same", "same", *FURTHER)] * 50 + [(9000, "", "empty", *FURTHER)] * 3
    return stored(spark, rows, NAMES, tmp_path_factory.mktemp("mix") / "t")


def test_mix_meets_every_budget(spark, corpus):
    out = mixing.mix(corpus).collect()
    assert len(out) == corpus.count()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sources = sorted({r.source for r in out}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(len(word.findall(r.text)) for r in out if r.source == s) for s in sources}
    share = dict(zip(sources, waterfill([size[s] for s in sources], [1 + i % 3 for i in range(len(sources))])))
    taken = collections.Counter()
    for r in out:
        assert r.size == len(word.findall(r.text)) and r.source_size == size[r.source]
        assert r.target == pytest.approx(float(share[r.source]), rel=1e-12)
        assert r.part is None or r.text.startswith(r.part) and not r.part[-1].isspace()
        own = r.copies * r.size + len(word.findall(r.part or ""))
        assert own <= 3 * r.size
        taken[r.source] += own
    assert size["empty"] == 0 and len({x for x in share.values()}) > 4 and any(share[s] == 3 * size[s] > 0 for s in sources)
    for s in sources:
        assert abs(taken[s] - share[s]) <= (50 if s == "same" else fractions.Fraction(1, 2)), s
    rows = mixing.rows_of(mixing.mix(corpus))
    assert collections.Counter({r.source: r.n for r in rows.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect() if r.n}) == +taken


def test_mix_does_not_depend_on_the_layout(spark, corpus, tmp_path):
    """Rows in other files and order give the same result; rows that repeat id and text may trade places."""
    other = stored(spark, corpus.collect()[::-1], NAMES, tmp_path / "t", 7)
    rows = lambda df: sorted((str(r.id), r.text, str(r.source), r.copies, str(r.part)) for r in mixing.mix(df).where("not source <=> 'same'").collect())
    assert rows(corpus) == rows(other) == rows(corpus)


def test_mix_shares_of_equal_rows(spark, tmp_path):
    """Fifty rows of one id and text share what the cut leaves them, none beyond three times its size."""
    rows = [(1, "three little words", "x", *FURTHER)] * 50 + [(2, "w " * 60, "y", *FURTHER)]
    out = mixing.mix(stored(spark, rows, NAMES, tmp_path / "t")).collect()
    taken = [r.copies * 3 + len((r.part or "").split()) for r in out if r.source == "x"]
    assert max(taken) - min(taken) <= 1 and abs(sum(taken) - 70) <= 25 and max(taken) <= 9


def test_mix_of_nothing(spark, corpus, tmp_path):
    assert mixing.mix(corpus.limit(0)).count() == 0
    bare = stored(spark, [(1, None, "a", *FURTHER), (2, "", None, *FURTHER)], NAMES, tmp_path / "t")
    assert [(r.size, r.target, r.copies, r.part) for r in mixing.mix(bare).collect()] == [(0, 0.0, 0, None)] * 2


def test_prefix_sums_over_one_hot_key(spark, tmp_path):
    rows = [("hot", i) for i in range(2000)] + [(c, i) for c in "abxyz" for i in range(10)]
    df = stored(spark, rows, "k string, v bigint", tmp_path / "t")
    out = mixing.prefix_sums(df, ["k", "v"], {"before": F.col("v"), "place": F.lit(1)}, Scratch(spark), "t")
    at = 0
    for place, r in enumerate(sorted(out.collect(), key=lambda r: (r.k, r.v))):
        assert (r.before, r.place) == (at, place)
        at += r.v


MIDDLE_TEXTS = [None, "", "a", "abc def", "héllo wörld", "\U0001f600\U0001f601ab\U0001f602", "x<P>y", "<S>", "a<M>b", "ends with <", "<S <P S> M>", "a\r\nb\n\nc\n", "z" * 50_000, "1 2 3" * 20_000, "é ‍\U0001f468‍\U0001f469 ok"]


def test_fill_in_middle_by_hand(spark, tmp_path):
    rows = [(i * 20 + j, t, "s", *FURTHER) for i, t in enumerate(MIDDLE_TEXTS) for j in range(20)] + [(None, "no id here", None, *[None] * 8), (3, "a repeated id", "s", *FURTHER), (3, "a repeated id", "s", *FURTHER)]
    docs = stored(spark, rows, NAMES, tmp_path / "t")
    out = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows)
    seen = collections.Counter()
    for r in out:
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", r.text)
        h = [int(hashlib.sha256(f"1:{'' if r.id is None else r.id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
        plain = not r.text or any(x in r.text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        seen[form] += 1
        p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
        assert (r.n, r.form, r.back) == (len(tokens), form, r.text)
        assert (r.prefix, r.middle, r.suffix) == ((None, None, None) if plain else (p, m, s))
        assert r.output == {"plain": r.text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    assert min(seen.values()) > 10 and len(seen) == 3
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "pattern"), [("letter runs", r"[A-Za-z]+|[^A-Za-z]"), ("characters", r"[\s\S]"), ("words", r"[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+"), ("lines", r"[^\n]*\n|[^\n]+")])
def test_grammars_become_boundaries(spark, name, pattern):
    texts = [t for t in MIDDLE_TEXTS if t]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", fill_middle.units(F.col("t"), fill_middle.GRAMMARS[name]).alias("u")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == re.findall(pattern, t), (name, t[:30])


def plain_clusters(rows, k, rounds, width=64, scale=64):
    """(id, vector) rows; every distance is computed, in Python's integers."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centers = [v for _, v in start]
    for at in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers)) for _, v in kept]
        if at == rounds:
            return sorted(((-1 if i is None else i), j, d) for (i, _), (d, j) in zip(kept, near)), centers
        for j in range(len(centers)):
            mine = [v for (_, v), (_, x) in zip(kept, near) if x == j]
            if mine:
                centers[j] = [sum(c) // len(mine) for c in zip(*mine)]


def hard_vectors(n: int):
    rng = random.Random(5)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.05) for m in middles[i % 6]]) for i in range(n)]
    rows += [(1000 + i, middles[0]) for i in range(30)] + [(2000 + i, [float(i % 2)] * 64) for i in range(20)] + [(5, middles[1])] * 4  # copies, ties and repeats
    rows += [(None, middles[2]), (3000, None), (3001, []), (3002, [1.0] * 63), (3003, [1.0] * 65), (3004, [float("nan")] * 64), (3005, [float("inf")] + [0.0] * 63), (3006, [None] + [0.0] * 63)]
    return rows


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (5, 6)])
def test_clusters_equal_plain_ones(spark, tmp_path, k, rounds):
    rows = hard_vectors(300)
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, v, 1, "c", 2.0) for i, v in rows], "vec_id bigint, embedding array<float>, id int, cluster string, upper double").repartition(5).write.parquet(path)
    near, centers, computed = centroids.cluster(spark.read.parquet(path), k=k, rounds=rounds)
    want, plain_centers = plain_clusters(rows, k, rounds)
    assert sorted(((-1 if r.id is None else r.id), r.cluster, r.distance) for r in near.collect()) == want
    assert centers.tolist() == plain_centers
    assert computed < 0.7 * len(want) * k * (rounds + 1)  # bounds skip distances


def test_clusters_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id bigint, embedding array<double>")
    near, centers, _ = centroids.cluster(df)
    assert len(centers) == 3 and sorted((r.id, r.distance) for r in near.collect()) == [(0, 0), (1, 0), (2, 0)]
    near, centers, _ = centroids.cluster(df.limit(0))
    assert near.count() == 0 and near.columns == ["id", "cluster", "distance"] and len(centers) == 0


def test_components_too_large_are_named(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="a scaled component is not within"):
        centroids.cluster(df)


def test_assign_keeps_ties_and_bounds():
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (500, 4))
    centers = rng.integers(-3, 4, (7, 4))
    own, upper, lower, _ = centroids.assign(x, np.zeros(500, np.int64), np.full(500, np.inf), np.zeros((500, 7)), centers)
    for _ in range(4):
        d2 = centroids.squared(x[:, None], centers[None])
        assert (own == d2.argmin(1)).all() and (lower**2 <= d2 * (1 + 1e-9)).all() and (upper**2 >= d2[np.arange(500), own] * (1 - 1e-15)).all()
        old, centers = centers, centers + rng.integers(-1, 2, centers.shape)
        moved = centroids.up(centroids.squared(old, centers))
        own, upper, lower, count = centroids.assign(x, own, (upper + moved[own]) * (1 + centroids.SLACK), np.maximum(lower - moved, 0) * (1 - centroids.SLACK), centers)
        assert count <= 500 * 7


def test_queries_have_their_columns(spark, sf):
    out = queries.op13_centroids(spark, sf)
    assert set(out.columns) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}
    total = {r.inertia for r in out.select("inertia").distinct().collect()}
    assert total == {out.agg(F.sum("distance")).first()[0]}
    assert set(queries.op11_mixing(spark, sf).columns) == {"doc_id", "size", "source_size", "target", "taken"}
    assert {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"} == set(queries.op12_fill_middle(spark, sf).columns)
