"""The pipeline's stages on a small table."""

import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    out = corpus_pipeline.run(spark, sf)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "byte-level BPE"]
    assert 0 < out.count() < n and "ids" in out.columns
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, empty, sf).columns == columns, name


HARD = "doc_id bigint, text string, lang string, source string, n_chars bigint, label int, weights string, kept boolean, ranges string, key int, comp int, row_id int, item_id int"


def test_stages_on_hard_rows(spark, sf, tmp_path):
    """Nulls in every column, empty and repeated rows, repeated ids, ties, clashing names: each stage by itself."""
    benchmark = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars between 900 and 3000").orderBy("doc_id").limit(3).collect()]
    more = (1, "w", True, "r", 2, 3, 4, 5)
    rows = [(1, clean[0], "en", "s", len(clean[0]), *more), (2, clean[0] + " end", "en", "s", 9, *more), (2, clean[1], None, None, None, *more), (2, clean[1], None, None, None, *more), (None, clean[2], "en", "s", 1, *[None] * 8), (None, None, *[None] * 11), (None, "", "en", "s", 0, *more), (5, None, "en", "s", 0, *more), (6, f"{clean[1][:300]} {benchmark[0]} {clean[2][:300]}", "en", "s", 7, *more)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, HARD).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect()))
    out = {name: stage[name](spark, docs, sf) for name in list(stage)[:4]}
    assert all(df.columns == docs.columns for df in out.values())
    assert ids(out["quality classifier"]) == ids(docs)  # too few labelled rows to reject any
    assert ids(out["MinHash near-dedup"]) == [-1, -1, -1, 1, 2, 5, 6]
    cut = {(r.doc_id, r.text): r.n_chars for r in out["suffix-array dedup"].collect()}
    assert len(out["suffix-array dedup"].collect()) == len(rows) and all(n == (None if t is None else len(t)) for (_, t), n in cut.items())
    assert ids(out["benchmark decontamination"]) == [-1, -1, -1, 1, 2, 2, 2, 5]
    encoded = stage["byte-level BPE"](spark, docs, sf)
    assert ids(encoded) == ids(docs) and encoded.where("n_tokens = 0").count() == 3
    assert stage["byte-level BPE"](spark, docs.limit(0), sf).count() == 0
