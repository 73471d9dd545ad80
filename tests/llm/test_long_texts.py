"""Texts longer than every buffer: bounded memory, and the same results as in one piece."""

import base64
import math
import random
import tracemalloc

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import bpe, decontaminate, language_id, near_dedup, token_counts, warc
from pagemill.llm.bpe import read_ranks
from pagemill.llm.tokens import WORD, runs

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_count(word: bytes, scores: dict[bytes, float], longest: int) -> int:
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        best.append(max((best[i][0] + scores[word[i:d]], best[i][1] - 1) for i in range(max(0, d - longest), d) if word[i:d] in scores))
    return -best[-1][1]


def test_trie_counts_with_shared_beginnings():
    raw = read_ranks(RANKS)
    vocabulary = token_counts._vocabulary(raw)
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    norm = math.log(sum(1 / (r + 1) for r in range(len(table))))
    scores = {t: -math.log(r + 1) - norm for t, r in table.items()}
    rng = random.Random(7)
    words = {bytes(rng.choice(b"=- a") for _ in range(rng.randrange(40))) for _ in range(400)}
    for _ in range(40):  # branches of branches, at all depths, far beyond the longest token
        stem = bytes(rng.choice(b"=te") for _ in range(rng.randrange(600)))
        words |= {stem, stem + b"x", stem[: len(stem) // 2] + b"y" * 9, *(stem[:k] for k in range(0, len(stem), 150))}
    words = list(words)
    rng.shuffle(words)
    assert token_counts.trie_counts(words, vocabulary) == [plain_count(w, scores, vocabulary[1]) for w in words]
    assert token_counts.trie_counts([], vocabulary) == [] and token_counts.trie_counts([b""], vocabulary) == [0]


def test_common_beginnings():
    rng = random.Random(8)
    for _ in range(300):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randrange(60)))
        b = a[: rng.randrange(len(a) + 1)] + bytes(rng.choice(b"abc") for _ in range(rng.randrange(20)))
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert token_counts.common(a, b) == n


def test_memory_of_a_long_pretoken():
    """Two runs of signs that share all but their ends: what is held does not grow with them."""
    vocabulary = token_counts._vocabulary(read_ranks(RANKS))
    words = [b"=" * 30_000 + b"a", b"=" * 30_000, b"=" * 20_000 + b"-"]
    tracemalloc.start()
    counts = token_counts.trie_counts(words, vocabulary)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000 and counts[0] == counts[1] + 1 and 0 < counts[1] < 30_000


def test_decontaminates_a_long_text_in_slices(spark, sf, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontaminate.Index(items, 5)
    rng = random.Random(9)
    words = []
    while len(words) < 60_000:
        passage = rng.choice(items)[1].split()
        words += passage[: rng.randrange(1, len(passage) + 1)] if rng.random() < 0.9 else [f"w{rng.randrange(99)}" for _ in range(30)]
    hashes, _ = runs([" ".join(words)], (WORD,))
    tracemalloc.start()
    sliced = decontaminate.matches(hashes, index, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    monkeypatch.setattr(decontaminate, "SLICE", 1 << 22)
    short = hashes[:9000]
    whole = decontaminate.matches(short, index, 0.8)
    monkeypatch.setattr(decontaminate, "SLICE", 1000)
    assert sorted(decontaminate.matches(short, index, 0.8)) == sorted(whole) and whole
    assert {m[0] for m in sliced} >= {m[0] for m in whole} and peak < 100_000_000


@pytest.fixture(scope="module")
def long_docs(spark, sf, tmp_path_factory):
    """Texts of 1.2 and 2.6 million signs among short ones."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars between 300 and 4000").orderBy("doc_id").limit(40).collect()]
    rng = random.Random(10)
    big = [" ".join(" ".join(rng.sample(t.split(), len(t.split()))) for t in rng.choices(texts, k=n)) for n in (600, 1300)]
    assert len(big[0]) > 1 << 20 and len(big[1]) > 2 << 20
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, *big, big[0], big[1][:-40] + " another ending of the text"])]
    path = str(tmp_path_factory.mktemp("long") / "t")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_operators_on_long_texts(spark, long_docs, tmp_path):
    n = long_docs.count()
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, read_ranks(RANKS).splitlines())}, special_tokens={})
    texts = {r.doc_id: r.text for r in long_docs.collect()}
    encoded = {r.doc_id: (r.n_tokens, r.decoded) for r in bpe.encode(long_docs, RANKS, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "decoded").collect()}
    for i in (40, 41, 42, 43):
        decoded = encoded[i][1]
        assert (decoded if isinstance(decoded, str) else bytes(decoded).decode()) == texts[i]
        assert encoded[i][0] == len(encoding.encode_ordinary(texts[i]))
    groups = {r.doc_id: r.component_id for r in near_dedup.near_groups(long_docs, words=3, percent=85).collect()}
    assert len(groups) == n and groups[42] == groups[40] == 40 and groups[43] == groups[41] == 41
    learned = language_id.learn(long_docs)
    assert language_id.identify(long_docs, learned, "text", "doc_id").where("lang_pred = 'en'").count() == n
    counted = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(long_docs, RANKS).collect()}
    assert counted[40] == counted[42] and counted[41][0] > 300_000 and len(counted) == n
    pages = long_docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.col("text").alias("html"))
    pages.write.parquet(str(tmp_path / "pages"))
    back = {r.page_id: r for r in warc.round_trip(spark.read.parquet(str(tmp_path / "pages"))).collect()}
    assert len(back) == n and back[40].record_type == "revisit" and back[40].refers_to == 42 and back[43].payload_bytes == len(texts[43].encode())


def test_stages_on_long_texts(spark, sf, long_docs):
    stage = dict(corpus_pipeline.STAGES)
    docs = long_docs
    rated = stage["quality classifier"](spark, docs, sf)  # the labels are of other texts, so only whole rows are asked for
    assert rated.count() == rated.join(docs, docs.columns).count() > 0
    kept = {r.doc_id for r in stage["MinHash near-dedup"](spark, docs, sf).select("doc_id").collect()}
    assert {40, 41} <= kept and not {42, 43} & kept
    cut = {r.doc_id: r.n_chars for r in stage["suffix-array dedup"](spark, docs, sf).select("doc_id", "n_chars").collect()}
    assert len(cut) == docs.count() and cut[42] == 0 and 0 < cut[43] < 200
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = docs.withColumn("text", F.when(F.col("doc_id") == 41, F.concat("text", F.lit(f" {bench[0]} and {bench[1]} "), "text")).otherwise(F.col("text")))
    clean = {r.doc_id for r in stage["benchmark decontamination"](spark, dirty, sf).select("doc_id").collect()}
    assert 41 not in clean and {40, 42, 43} <= clean
    assert stage["byte-level BPE"](spark, docs, sf).where("n_tokens > 200000").count() == 4

