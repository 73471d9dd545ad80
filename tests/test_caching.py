"""Canonical documents, trees of hashes and the validity of what was drawn."""

import hashlib
import json

from pyspark.sql import functions as F

from pagemill.operators import caching


def test_canonical_documents_are_those_of_sorted_json(spark):
    """Nested structs, arrays of structs, maps, nulls and texts beyond ASCII."""
    rows = [(2, "é \"x\" \\ 漢", (1, (None, "b")), [(3, "k"), (None, None)], {"z": 1, "a": 2}), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "z int, a string, s struct<y:int,b:struct<q:int,c:string>>, l array<struct<n:int,k:string>>, m map<string,int>")
    got = [r[0] for r in df.select(caching.canonical_json(df, df.columns)).collect()]
    plain = [{"z": 2, "a": rows[0][1], "s": {"y": 1, "b": {"q": None, "c": "b"}}, "l": [{"n": 3, "k": "k"}, {"n": None, "k": None}], "m": {"z": 1, "a": 2}}, dict.fromkeys("zaslm")]
    assert got == [json.dumps(p, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for p in plain]


def test_tree_by_hand(spark):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [("big", f"{i:03d}", i * i) for i in range(75)] + [("one", "7", 7), (None, "x", 1)]
    df = spark.createDataFrame(rows, "g string, k string, v int").repartition(4)
    got = {r.g: r.fingerprint for r in caching.fingerprint_tree(df, "g", "k", ["v", "k"], 4, 3).collect()}
    for g in ("big", "one", None):
        level = [digest(json.dumps({"k": k, "v": v}, separators=(",", ":"))) for _, k, v in sorted(r for r in rows if r[0] == g)]
        for _ in range(2):
            level = [digest(",".join(level[i : i + 4])) for i in range(0, len(level), 4)]
        assert got[g] == digest(",".join(level))
    assert caching.fingerprint_tree(df.limit(0), "g", "k", ["v"]).count() == 0
    changed = df.withColumn("v", F.when(F.col("k") == "040", -1).otherwise(F.col("v")))
    again = {r.g: r.fingerprint for r in caching.fingerprint_tree(changed, "g", "k", ["v", "k"], 4, 3).collect()}
    assert again["big"] != got["big"] and again["one"] == got["one"]


def test_validity_by_reason(spark):
    wanted = spark.createDataFrame([(t, "f") for t in "abcdef"], "task string, fingerprint string")
    reports = spark.createDataFrame([("b", "g", "pb", 1), ("c", "f", "pc", 1), ("d", "f", "pd", None), ("e", "f", "pe", 1), ("f", "f", "pf", 1)], "task string, fingerprint string, path string, size_bytes long")
    files = spark.createDataFrame([("pb", 1, True), ("pd", 1, True), ("pe", 1, None), ("pf", 1, True)], "path string, bytes long, verified boolean")
    got = {r.task: r.state for r in caching.cache_validity(wanted, reports, files).collect()}
    assert got == {"a": "no_report", "b": "other_fingerprint", "c": "no_file", "d": "other_size", "e": "not_verified", "f": "valid"}
