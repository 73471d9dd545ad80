"""The operators of the llm subpackage against brute force on small tables with nulls, empty texts, ties and repeats."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from pagemill.llm import bpe, decontaminate, fingerprint, induced, language_id, near_dedup, pretokens, quality, suffix_dedup, token_counts, url_filter, warc
from pagemill.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


BASE = [prose(n) for n in (60, 80, 120, 300, 40)]
TEXTS = [*BASE, BASE[0], BASE[1] + " tail", "x " + BASE[3], BASE[2][:300], None, "", "  \n ", "one two", "One TWO", "a's 'll\t漢字 12!", "ab " * 200, BASE[3][200:900] + " " + BASE[0], "\U0001f600 é" * 40]
NAMES = "doc_id bigint, text string, lang string, block string, key string, ranges string"


@pytest.fixture(autouse=True)
def same_texts():
    """Texts do not depend on which tests ran before."""
    RNG.seed(12)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """A stored table with further columns whose names operators might use."""
    rows = [(i, t, "en", "b", "k", "r") for i, t in enumerate(TEXTS)]
    rows += [(None, BASE[4], None, None, None, None), (3, TEXTS[3], "en", "b", "k", "r"), (4, "another text under a known id", None, None, None, None)]
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, NAMES).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def unique(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("unique") / "t")
    docs.where("doc_id is not null and text <> 'another text under a known id' or text is null").dropDuplicates(["doc_id"]).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "t")
    spark.createDataFrame([], NAMES).write.parquet(path)
    return spark.read.parquet(path)


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pretokens_follow_the_pattern():
    signs = ["a", "é", "1", "٣", " ", "  ", "\n", "\t", "\xa0", "'", "'s", "'ll", "'re", "'S", "!", "漢", "\x1c", "\x85", "\U0001f600", "l", "s", "́", "²"]
    texts = ["".join(RNG.choice(signs) for _ in range(RNG.randrange(14))) for _ in range(5000)]
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert pretokens.pretokens(texts) == [pattern.findall(t) for t in texts]


def test_bpe(docs, nothing):
    enc = encoding()
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), tuple(ids), r.text or ""] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in got) == want
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="pattern"):
        bpe.encode(docs, RANKS, r"\w+")


def test_token_counts(docs, nothing):
    import math

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    norm = math.log(sum(1 / (r + 1) for r in range(len(ranks))))
    longest = max(map(len, ranks))

    def count(word: bytes) -> int:
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            best.append(max((best[a][0] - math.log(ranks[word[a:end]] + 1) - norm, best[a][1] - 1) for a in range(max(0, end - longest), end) if word[a:end] in ranks))
        return -best[-1][1]

    pattern = regex.compile(public_tokenizers.PATTERN)
    want = collections.Counter((r.doc_id, len(w := pattern.findall(r.text or "")), sum(count(x.encode()) for x in w)) for r in docs.collect())
    assert collections.Counter(tuple(r) for r in token_counts.count_tokens(docs, RANKS).collect()) == want
    assert token_counts.count_tokens(nothing, RANKS).count() == 0


def brute_ranges(rows, length):
    """rows in order: (bytes) -> covered flags."""
    seen, out = set(), []
    for raw in rows:
        covered = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                covered[p : p + length] = True
            seen.add(w)
        out.append(covered)
    return out


def test_suffix_dedup(unique, docs, nothing):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in unique.collect())
    for length in (20, 100):
        got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(unique, length).collect()}
        for (i, raw), covered in zip(rows, brute_ranges([r for _, r in rows], length)):
            left = np.frombuffer(raw, np.uint8)[~covered].tobytes()
            spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
            assert got[i] == (len(raw), int(covered.sum()), spans, hashlib.sha256(left).hexdigest())
    every = suffix_dedup.digest(docs, 100).collect()
    assert len(every) == docs.count() and len({tuple(r) for r in every if r.doc_id == 3}) == 1
    cut = suffix_dedup.remove_repeats(docs, 100)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert suffix_dedup.digest(nothing).count() == 0


def test_suffix_dedup_cuts_whole_characters(spark, tmp_path):
    """A range that begins within a character and ends within another takes both; nothing is fused from their rests."""
    raw = "xÉ" + "b" * 3 + "»y"
    ranges = [{"a": 2, "b": 7}]
    assert raw.encode()[2] & 0xC0 == raw.encode()[7] & 0xC0 == 0x80
    assert suffix_dedup.cut_ranges(raw.encode(), suffix_dedup.whole_characters(raw.encode(), ranges))[0].decode() == "xy"
    same = "ß" + prose(60)
    rows = [(1, "é" + same), (2, "è" + same + "é")]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(spark.read.parquet(path)).collect()}
    assert got == {1: rows[0][1], 2: "èé"}


def test_suffix_dedup_of_a_line_that_most_texts_have(spark, tmp_path, monkeypatch):
    """One anchor between other words in each text: no shard sorts them all, and the result is that of brute force."""
    rng = random.Random(16)
    noise = lambda n: "".join(rng.choices("abc", k=n))
    line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=60))
    rows = [(i, noise(rng.randint(0, 60)) + line + noise(rng.randint(0, 60))) for i in range(400)]
    rows += [(1000 + i, rows[i][1][5:] + noise(9)) for i in range(0, 40, 2)]
    path, told = str(tmp_path / "t"), tmp_path / "told"
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2).write.parquet(path)
    told.mkdir()
    plain, folder = suffix_dedup._sorted_shard, str(told)

    def weighed(batches, length):
        import uuid

        own = list(batches)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(sum(len(x) for x in {x for b in own for x in b.column(5).to_pylist()})))
        return plain(iter(own), length)

    monkeypatch.setattr(suffix_dedup, "_sorted_shard", weighed)
    for name, value in (("SHARD", 4000), ("CROWD", 1500)):
        monkeypatch.setattr(suffix_dedup, name, value, raising=False)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.digest(spark.read.parquet(path)).collect()}
    texts = [t.encode() for _, t in rows]
    want = {i: (int(c.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~c].tobytes()).hexdigest()) for (i, _), t, c in zip(rows, texts, brute_ranges(texts, 100))}
    assert got == want and sum(n > 0 for n, _ in got.values()) > 10
    assert max(int(f.read_text()) for f in told.iterdir()) < sum(map(len, texts)) / 8


def test_suffix_dedup_of_texts_longer_than_a_buffer(spark, tmp_path):
    """A text of several pieces, with passages that repeat within a piece, across its edge and in other documents."""
    rng = random.Random(15)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage, n = noise(300), suffix_dedup.BUFFER
    long_ = noise(n - 150) + passage + noise(n // 2) + passage + noise(n)
    rows = [(1, noise(400)), (2, long_), (3, noise(50) + passage + noise(50) + long_[n + 500 : n + 700]), (4, long_)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2).write.parquet(path)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(spark.read.parquet(path)).collect()}
    at = [n - 150, n - 150 + 300 + n // 2]
    assert long_.find(passage, at[0] + 1) == at[1]
    left = {1: (rows[0][1], 0, 0), 2: (long_[: at[1]] + long_[at[1] + 300 :], 300, 1), 3: (rows[2][1][:50] + rows[2][1][350:400], 500, 2), 4: ("", len(long_), 1)}
    assert got == {i: (len(rows[i - 1][1]), removed, spans, hashlib.sha256(kept.encode()).hexdigest()) for i, (kept, removed, spans) in left.items()}


def test_suffix_dedup_sorts_only_what_may_repeat(monkeypatch):
    """Snippets with one anchor, few of which share a window: only these are sorted, and all shared windows are found; the
    snippets of many texts are cut out in few batches."""
    import pyarrow as pa

    rng = random.Random(17)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    lines = [noise(40) for _ in range(5)]
    texts = [(noise(100) + lines[i % 5] + noise(100)).encode() for i in range(300)]
    texts += [noise(20).encode() + texts[i][60:190] + noise(20).encode() for i in range(0, 30, 3)]
    ends = np.cumsum([0, *map(len, texts)])
    start, windows, anchor, _ = suffix_dedup.snippets(np.frombuffer(b"".join(texts), np.uint8), ends)
    of = np.searchsorted(ends, start, side="right") - 1
    wanted = [[{"key": int(k), "a": int(a - ends[i]), "b": int(n), "crowded": False} for k, a, n, o in zip(anchor.view(np.int64), start, windows, of) if o == i] for i in range(len(texts))]
    kind = pa.list_(pa.struct([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("crowded", pa.bool_())]))
    rows = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts]), pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(wanted, kind)], names=["text", "i", "t", "wanted"])
    cut = list(suffix_dedup._cut_out([rows.slice(0, 7), rows.slice(7)], 0, 100))
    pieces = [x for c in cut for x in zip(*(c.column(i).to_pylist() for i in (1, 3, 4, 5)))]
    assert len(pieces) == len(start) and all(texts[i][a : a + b + 99] == piece for i, a, b, piece in pieces)
    assert len(cut) < 10
    sorted_bytes, plain = [], induced.sorted_suffixes
    monkeypatch.setattr(induced, "sorted_suffixes", lambda text, *more: sorted_bytes.append(len(text)) or plain(text, *more))
    removed = [np.zeros(len(t), bool) for t in texts]
    for r in suffix_dedup._sorted_shard(cut, 100):
        for i, low, high in zip(r.column(0).to_pylist(), r.column(2).to_pylist(), r.column(3).to_pylist()):
            removed[i][low:high] = True
    assert all((got == want).all() for got, want in zip(removed, brute_ranges(texts, 100))) and 1300 <= sum(map(sum, removed)) < 1400
    assert 0 < sum(sorted_bytes) < sum(len(x[3]) for x in pieces) / 4


def test_suffix_dedup_block_by_block(monkeypatch):
    """Neither blocks of texts nor the number of rows settled at once change what is found."""
    import pyarrow as pa

    texts = [(prose(RNG.randint(0, 60)) + BASE[i % 3]).encode() for i in range(40)] + [b"", b"short"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["id", "th", "text"])

    def found(block, many):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        monkeypatch.setattr(suffix_dedup, "MANY", many)
        scanned = pa.Table.from_batches(list(suffix_dedup._scanned([rows.slice(0, 20), rows.slice(20)], 100))).sort_by("key")
        matched = [r for b in suffix_dedup._matched(scanned.combine_chunks().to_batches(max_chunksize=3), 100) for r in b.to_pylist()]
        return sorted(map(str, scanned.to_pylist())), sorted(map(str, matched))

    want = found(1 << 20, 1 << 20)
    assert all(want) and all(found(*x) == want for x in ((1, 1), (500, 1), (3000, 10), (3000, 1 << 20)))


def test_induced_sorting_finds_all_equal_strings():
    for trial in range(300):
        n, depth = RNG.randrange(1, 70), RNG.choice([1, 2, 3, 8])
        text = [RNG.choice([0] * (RNG.random() < 0.2) + [1, 2, 3][: RNG.choice([1, 2, 3])]) for _ in range(n)] + [0]
        want = collections.defaultdict(set)
        for i in range(len(text) - depth + 1):
            if 0 not in text[i : i + depth]:
                want[tuple(text[i : i + depth])].add(i)
        found = [{int(x) for x in p if x + depth <= len(text) and 0 not in text[x : x + depth]} for p in induced.groups(np.array(text, np.uint16), depth, RNG.choice([1, 40_000, 1 << 20]))]
        assert sorted(map(sorted, (f for f in found if len(f) > 1))) == sorted(map(sorted, (w for w in want.values() if len(w) > 1))), trial


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def test_near_groups(unique, docs, nothing):
    rows = {r.doc_id: shingles(r.text, 3) for r in unique.collect()}
    parent = {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows.items():
        for j, b in rows.items():
            if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r.doc_id: r for r in near_dedup.near_groups(unique, 3, 85).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), root(i), root(i) == i) for i, s in rows.items()}
    every = near_dedup.near_groups(docs, 3, 85).collect()
    assert len(every) == docs.count()
    assert {r.component_id for r in every if r.doc_id == 3} == {3} and {r.component_id for r in every if r.doc_id is None} == {None}
    assert near_dedup.near_groups(nothing).count() == 0 and near_dedup.keep_one(nothing).count() == 0


def near_texts(rng, base, n, edits):
    """Copies of base, each with some of its words replaced."""
    for _ in range(n):
        words_ = base.split()
        for at in rng.sample(range(len(words_)), rng.randrange(1, edits + 1)):
            words_[at] = f"{rng.choice(VOCABULARY)}{rng.randrange(9)}"
        yield " ".join(words_)


def brute_components(rows, percent):
    """{id: smallest id reachable}, of {id: set of shingles}."""
    parent = {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows.items():
        for j, b in rows.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in rows}


@pytest.mark.parametrize("words_, percent, edits", [(3, 85, 6), (5, 80, 7)])
def test_near_groups_of_many(spark, tmp_path, words_, percent, edits):
    """A large group of near copies of a text that is there or not, one of exact copies, a passage shared by unlike texts,
    texts of more shingles than a wide sketch keeps: every link is found, none more."""
    rng = random.Random(5)
    prose_ = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    there, absent, passage, long_ = prose_(120), prose_(100), prose_(30), prose_(1500)
    texts = [there, *near_texts(rng, there, 150, edits), *near_texts(rng, absent, 90, edits - 2)]
    texts += [f"{prose_(rng.randrange(1, 60))} {passage} {prose_(rng.randrange(1, 9))}" for _ in range(90)]
    texts += [prose_(30)] * 60 + [long_, *near_texts(rng, long_, 12, 60)]
    texts += [t.upper() for t in texts[:3]] + [f"{t} more" for t in texts[100:120]]
    rng.shuffle(texts)
    path = str(tmp_path / "t")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5).write.parquet(path)
    df = spark.read.parquet(path)
    sets = {i: shingles(t, words_) for i, t in enumerate(texts)}
    want = brute_components(sets, percent)
    assert len(set(want.values())) < len(want) - 150
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df, words_, percent).collect()}
    assert got == {i: (len(sets[i]), c, i == c) for i, c in want.items()}
    assert {r.doc_id for r in near_dedup.keep_one(df, words_, percent).collect()} == set(want.values())


def test_keep_one_of_rows_that_share_an_id(spark, tmp_path):
    """An id with unlike texts and with near copies, null ids, exact repeats, clashing names."""
    rng = random.Random(6)
    a, b, c = (" ".join(rng.choice(VOCABULARY) for _ in range(60)) for _ in range(3))
    rows = [(3, a, 1), (5, b, 2), (5, a + " tail", 3), (6, c, 4), (6, c + " tail", 5), (6, c, 4), (None, b + " x", 6), (None, None, 7), (None, "", 8), (9, "", 9), (9, "", 9)]
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, t, k, 0, {"m": 1}) for i, t, k in rows], "doc_id bigint, text string, key int, rep int, h map<string,int>").write.parquet(path)
    df = spark.read.parquet(path)
    out = near_dedup.keep_one(df).collect()
    assert out[0].asDict().keys() == set(df.columns)
    kept = collections.Counter((r.doc_id, r.text) for r in out)
    assert {kept.pop(x) for x in ((3, a), (None, b + " x"), (None, None), (None, ""), (9, ""))} == {1}
    assert len(kept) == 1 and [*kept][0] in {(6, c), (6, c + " tail")} and [*kept.values()] == [1]


def test_components(spark):
    links = [(RNG.randrange(60), RNG.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components(spark.createDataFrame([*links, (None, 1)], "a bigint, b bigint"))
    assert {r.node: r.low for r in got.collect()} == {x: root(x) for x in parent}


def test_language_id(spark, nothing):
    make = {"xx": "abcde", "yy": "vwxyz"}
    text = lambda k, n=30: " ".join("".join(RNG.choice(make[k]) for _ in range(5)) for _ in range(n))
    rows = [(i, text(k), k) for i in range(200) for k in ("xx" if i % 2 else "yy",)] + [(900, None, "xx"), (901, "12 !!", "xx"), (902, "abcde", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language_id.learn(df.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in language_id.identify(df, learned).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:200])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(nothing, learned).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, language_id.learn(nothing)).collect()} == {"und"}


def test_language_id_by_plain_counts(spark):
    """Every text's languages by exact sets of n-grams, which the filters stand for; repeated rows and clashing names."""
    rng = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "defghijk", "cc": "uvwxyzab"}
    text = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randrange(1, 6))) for _ in range(n))
    rows = [(i, text(k, rng.randrange(1, 40)), k, "p", 1.0) for i in range(300) for k in (rng.choice(sorted(letters)),)]
    rows += [rows[5], (7, rows[8][1], "aa", "p", 1.0), (None, rows[9][1], None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score double")
    learned = language_id.learn(df)
    counts = collections.defaultdict(collections.Counter)
    for _, t, k, *_ in {r for r in rows if r[2]}:
        counts[k].update(language_id.grams([t])[0].tolist())
    for r in (rows[5],):  # a repeated row is learned from twice
        counts[r[2]].update(language_id.grams([r[1]])[0].tolist())
    often = {k: {g: n for g, n in c.items() if n >= language_id.LEAST_COUNT} for k, c in counts.items()}
    share = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in often.items()}
    known = {k: {g for g, x in share[k].items() if x >= language_id.LEAST_SHARE * max(o.get(g, 0) for o in share.values())} for k in share}
    agree = 0
    got = collections.defaultdict(set)
    for r in language_id.identify(df, learned).collect():
        got[r.doc_id].add(r.lang_pred)
    for i, t, *_ in rows[:300]:
        hits = sorted(((sum(g in known[k] for g in language_id.grams([t])[0].tolist()), k) for k in known), reverse=True)
        if i in (7,) or hits[0][0] < hits[1][0] + 2:  # false positives may turn near ties
            continue
        agree += 1
        assert got[i] == {hits[0][1]}, (i, hits)
    assert agree > 200


def test_quality(spark, nothing):
    rows = [(i, prose(40) + (" nasty wretch" * 4 if i % 4 == 0 else ""), "more") for i in range(600)] + [(700, None, ""), (701, "", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, log_weight string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 600, 2)] + [(None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.resample(df, labels)[0].collect()}
    assert len(got) == 602 and got[700] and got[701]
    assert not any(got[i] for i in range(0, 600, 4)) and all(got[i] for i in range(600) if i % 4)
    kept = quality.keep(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert quality.resample(nothing, labels)[0].count() == 0
    assert quality.resample(df, labels.limit(0))[0].where("not kept").count() == 0


def test_quality_by_plain_counts(spark, tmp_path):
    """Weights and the draw, with repeated rows and ids, ties, nulls and clashing names, against plain counts of n-grams."""
    import math

    rng = random.Random(3)
    text = lambda i: " ".join(rng.choice(VOCABULARY[: 40 + 300 * (i % 3 == 0)]) for _ in range(30)) + (" vile" * 2 if i % 4 == 0 else "")
    rows = [(i, text(i), 1, "w", "l") for i in range(300)]
    rows += [rows[7], (8, rows[9][1], 1, "w", "l"), (None, rows[1][1], None, None, None), (None, None, 2, "", ""), (301, "", 0, "", "")]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id bigint, text string, label int, weights string, id_ string").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 300, 1)], "doc_id bigint, quality int, toxic int")
    got, model = quality.resample(df, labels)
    got = sorted(map(tuple, got.collect()), key=repr)
    marks = {r.doc_id: r.label for r in quality._labelled(df.select("doc_id", "text").distinct(), labels, quality.MOST_LABELLED).collect()}
    grams = [quality.features([r[1] or ""])[0].tolist() for r in rows]
    raw, target = collections.Counter(), collections.Counter()
    for r, own in zip(rows, grams):
        raw.update(own)
        if marks.get(r[0]) == 1:
            target.update(own)
    share = sum(target.values()) / sum(raw.values())

    def ratio(g):
        expected, t = raw[g] * share, target[g]
        away = math.sqrt(max(0.0, 2 * ((t * math.log(t / expected) if t else 0) - (t - expected))))
        found = math.log((t + 1) / (expected + 1))
        return found if abs(found) > math.log(quality.LEAST_RATIO) and away >= quality.LEVELS[model.level] else 0.0

    noise = {r.doc_id: r.g for r in df.select("doc_id").distinct().withColumn("g", quality._gumbel(F.coalesce("doc_id", F.lit(0)), model.seed)).collect()}
    weights = [sum(map(ratio, own)) for own in grams]
    assert any(weights) and np.allclose(sorted(weights), sorted(w for _, w, _ in got), atol=1e-4)
    keys = sorted((w * model.sharpness + noise[i] for i, w, _ in got), reverse=True)
    k = sum(w >= model.least for _, w, _ in got)
    assert 0 < k < len(rows) and sorted((i, w) for i, w, kept in got if kept and i is not None) == sorted((i, w) for i, w, _ in got if i is not None and w * model.sharpness + noise[i] >= keys[k - 1] - 1e-9)
    kept = quality.keep(df, labels)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _, x in got if x and i is not None)


def test_kth_largest(spark):
    keys = [RNG.choice([1.5, 2.5, RNG.gauss(0, 1)]) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 7, 250, 500):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]


def test_decontamination(spark, nothing):
    items = [(1, prose(20)), (2, prose(30)), (3, "two words"), (4, None), (5, "")]
    edited = items[1][1].split()
    edited[-1] = "changed"
    rows = [(1, prose(50) + ". " + items[0][1].upper() + "! " + prose(9)), (2, " ".join(edited)), (3, prose(80)), (4, None), (5, "has TWO words inside"), (6, items[0][1][: len(items[0][1]) // 2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (5, 3)} and got[1, 1].similarity == 1.0 and got[1, 1].start_word == 50
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == {3, 4, 6}
    assert decontaminate.contaminated(nothing, bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_of_shorter_documents(spark):
    """Items less their last or first words: one window of the whole document."""
    word = lambda i, k: f"w{i}x{k}"
    items = [(i, [word(i, k) for k in range(n)]) for i, n in enumerate((15, 38, 59, 9))]
    cuts = [(10, items[0][1][:-1], 0, 10 / 11), (11, items[0][1][:-2], 0, 9 / 11), (12, items[1][1][5:], 1, 29 / 34), (13, items[2][1][:-5], 2, 50 / 55), (14, items[0][1][:-3], None, 8 / 11), (15, items[3][1][:-1], 3, 4 / 5), (16, items[3][1][:-2], None, 3 / 5), (17, items[0][1][:3], None, 0)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t, _, _ in cuts], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words): r.similarity for r in decontaminate.contaminated(df, bench).collect()}
    assert got == pytest.approx({(i, item, 0, len(t)): similarity for i, t, item, similarity in cuts if item is not None})
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == {14, 16, 17}


def test_decontamination_by_brute_force(spark, tmp_path):
    """All windows against all items by exact similarity: items with some words changed, repeated rows, clashing names."""
    rng = random.Random(8)
    prose_ = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = [prose_(rng.randrange(6, 45)) for _ in range(25)] + [["ab"] * 12, ["ab", "cd"] * 8]
    texts = []
    for k in range(150):
        own = list(items[k % len(items)])
        for _ in range(rng.randrange(4)):
            own[rng.choice([0, -1, rng.randrange(len(own))])] = f"z{rng.randrange(99)}"
        texts.append(prose_(rng.randrange(40)) + own + prose_(rng.randrange(40)))
    rows = [(i, " ".join(t), i, "s", 0) for i, t in enumerate(texts)] + [(0, " ".join(texts[0]), 0, "s", 0), (None, " ".join(texts[1]), 0, "s", 0)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id bigint, text string, item_id int, similarity string, start_word int").write.parquet(path)
    df = spark.read.parquet(path)
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id bigint, text string")

    def best(words_, item):
        w = min(5, len(item))
        grams = lambda x: collections.Counter(tuple(x[i : i + w]) for i in range(len(x) - w + 1))
        target, n = grams(item), min(len(item), len(words_))
        found = [(sum((g & target).values()) / max(1, sum((g | target).values())), -a) for a in range(len(words_) - n + 1) for g in [grams(words_[a : a + n])]]
        return max(found, default=(0, 0))

    want = collections.Counter()
    for i, text, *_ in rows:
        for j, item in enumerate(items):
            similarity, at = best(text.split(), item)
            if similarity >= 0.8:
                want[i, j, -at, round(similarity, 9)] += 1
    assert 60 < sum(want.values())
    got = collections.Counter((r.doc_id, r.item_id, r.start_word, round(r.similarity, 9)) for r in decontaminate.contaminated(df, bench).collect())
    assert got == want
    clean = decontaminate.keep_clean(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {i for i, *_ in want}


def test_hamming_blocks_miss_nothing():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 16, (300, decontaminate.BLOCKS), np.uint16)
    windows = prints[rng.integers(0, 300, 3000)].copy()
    for row in windows:
        for bit in rng.choice(decontaminate.BITS, rng.integers(40, 80), replace=False):
            row[bit // 16] ^= np.uint16(1 << (bit % 16))
    every = np.array([[int(x).bit_count() for x in range(1 << 16)]]).ravel()[windows[:, None] ^ prints[None]].sum(2)
    i, j, d = decontaminate.candidates(windows, prints)
    assert sorted(zip(i.tolist(), j.tolist(), d.tolist())) == sorted((a, b, every[a, b]) for a, b in zip(*np.nonzero(every <= decontaminate.RADIUS)))


def test_fingerprints(docs, unique, nothing):
    rows = sorted(((r.doc_id, r.text or "") for r in unique.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.fingerprints(unique).collect()}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    assert got[0].fingerprint == got[5].fingerprint != got[1].fingerprint
    a, b = shingles_case(BASE[1]), shingles_case(BASE[1] + " tail")
    assert abs(got[6].near_next - len(shingles_case(BASE[0]) & b) / len(shingles_case(BASE[0]) | b)) < 0.15 and len(a & b)
    assert fingerprint.fingerprints(docs).count() == docs.count() and fingerprint.fingerprints(nothing).count() == 0


def shingles_case(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def signature(text, bins=128):
    """One-permutation values of a text's distinct five-word runs before densification: {bin: least hash}, by plain code."""
    from pyspark.sql import SparkSession

    words_ = re.split(r"[\x20\x09-\x0D]+", text.strip(" \t\n\x0b\x0c\r"))
    runs = [words_[i : i + 5] for i in range(max(1, len(words_) - 4))]
    frame = SparkSession.getActiveSession().createDataFrame([(r + [None] * (5 - len(r)),) for r in runs], "r array<string>")
    hashes = [r.h for r in frame.select(F.xxhash64(*[F.col("r")[i] for i in range(5)]).alias("h")).collect()]
    least = {}
    for h in hashes:
        least[h >> 57] = min(least.get(h >> 57, h), h)
    return least


def test_fingerprint_bins(unique):
    """Filled bins hold the low bits of their least hash; empty ones a value of a filled bin; likeness follows the bins."""
    texts = {r.doc_id: r.text or "" for r in unique.collect()}
    for r in fingerprint.fingerprints(unique).collect():
        values = [int(r.fingerprint[i : i + 2], 16) for i in range(0, len(r.fingerprint), 2)]
        if not texts[r.doc_id].strip(" \t\n\x0b\x0c\r"):
            assert values == []
            continue
        least = signature(texts[r.doc_id])
        assert len(values) == 128 and all(values[b + 64] == h & 255 for b, h in least.items())
        assert set(values) <= {h & 255 for h in least.values()}
        edited = [int(r.edited_fingerprint[i : i + 2], 16) for i in range(0, len(r.edited_fingerprint), 2)]
        if edited:
            same = sum(a == b for a, b in zip(values, edited)) / 128
            assert abs(r.near_edited - min(1, max(0, (same - 1 / 256) / (1 - 1 / 256)))) < 1e-12


@pytest.mark.parametrize("ids", [[None, 5, 7], [-1, 0, 1], [None, -(2**63) + 1, -4096, -5, 0, 3, 2**63 - 1], [7, 7, 7, -7, None, None]])
def test_fingerprints_of_any_ids(spark, ids):
    """Null, negative and repeated ids: each row's next one is that of the next lower id."""
    df = spark.createDataFrame([(i, f"text number {k} of some") for k, i in enumerate(ids)], "doc_id bigint, text string")
    order = {(r.doc_id, r.text): r.h for r in df.select("*", F.xxhash64("text").alias("h")).collect()}
    rows = sorted(order, key=lambda x: (-(2**63) if x[0] is None else x[0], order[x]), reverse=True)
    want = collections.Counter()
    for k, (i, text) in enumerate(rows):
        half = len(text) // 2
        want[i, hashlib.sha256((text[: len(text) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()] += 1
    got = fingerprint.fingerprints(df).collect()
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_next_over_sparse_ids(spark):
    ids = sorted({RNG.randrange(-(2**62), 2**62) for _ in range(50)} | {-5, -4, 3}, reverse=True)
    df = spark.createDataFrame([(i, f"t{i}", None) for i in ids], "id bigint, text string, fp array<smallint>")
    assert min(ids) < 0 < max(ids)
    got = {r.id: r.next_text for r in fingerprint.with_next(df).collect()}
    assert got == {i: f"t{j}" for i, j in zip(ids, [*ids[1:], ids[0]])}


def test_url_filter(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")]
    urls = ["http://A.Example.org/es/1?x", "https://b.org/x#y", "http://example.org/en/12", "http://x.net/a", None, "no scheme", "ftp://host", "http://notorg/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r for r in url_filter.judge(df, rules).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(8)] == [("a.example.org", "/es/1", "example.org/es/"), ("b.org", "/x", "org/"), ("example.org", "/en/12", "example.org/en/1"), ("x.net", "/a", None), ("", "", None), ("", "", None), ("host", "", None), ("notorg", "/es/", None)]
    assert got[0].verdict == "block" and got[1].verdict == "allow" and all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.judge(df.limit(0), rules).count() == 0


def test_url_models_tell_urls_apart(spark):
    make = lambda k: f"http://{''.join(RNG.choice(k) for _ in range(12))}.com/"
    rows = [(i, make("abcd" if i % 2 else "wxyz"), "allow" if i % 2 else "block") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    model = url_filter.fit(df)
    good, bad = (model.score([make(k) for _ in range(50)]) for k in ("abcd", "wxyz"))
    assert (good >= model.threshold).mean() > 0.95 and (bad < model.threshold).mean() > 0.95


def test_url_models_count_exactly(spark):
    """More contexts than any fixed table would hold apart."""
    signs = "abcdefghijklmnopqrstuvwxyz0123456789-_~%é漢"
    rows = [(i, "".join(RNG.choice(signs) for _ in range(40)), "allow" if i % 3 else "block") for i in range(4000)]
    rows += [(4000, "nul\0\0in\0", "block"), (4001, None, "allow")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    held = {r.page_id for r in df.where(url_filter._held(F.coalesce("url", F.lit("")))).collect()}
    seen, follow = collections.Counter(), collections.Counter()
    grams = lambda t: [(p[i - k : i], p[i], k) for p in ["\x02" * 4 + t + "\x03"] for i in range(4, len(p)) for k in range(5)]
    for i, url, side in rows:
        if i not in held:
            for context, c, k in grams(url or ""):
                seen[side, context] += 1
                follow[side, context, c] += 1

    def want(t):
        total = 0.0
        for side, sign in (("allow", 1), ("block", -1)):
            for context, c, k in grams(t):
                p = (follow[side, context, c] + 2.0 * (p if k else 1 / 256)) / (seen[side, context] + 2.0)
                total += sign * np.log(p) if k == 4 else 0
        return total / (len(t) + 1)

    texts = [r[1] or "" for r in rows[:20] + rows[-2:]] + ["".join(RNG.choice(signs) for _ in range(30)) for _ in range(20)]
    assert len({x for x in seen if len(x[1]) == 4}) > 1 << 16
    assert np.allclose(url_filter.fit(df).score(texts), [want(t) for t in texts], atol=1e-8)


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/\n1", "<p>x</p>"), (2, None, "<p>x</p>"), (5, "u", "<p>x</p>"), (3, "v", "é" * 70_000), (4, "w", None), (None, "z", "q"), (6, "w2", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(df).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = {1: (8, digest("<p>x</p>"), "revisit", 5), 2: (8, digest("<p>x</p>"), "revisit", 5), 5: (8, digest("<p>x</p>"), "response", None), 3: (140_000, digest("é" * 70_000), "response", None), 4: (0, digest(""), "revisit", 6), 6: (0, digest(""), "response", None), None: (1, digest("q"), "response", None)}
    assert got == want
    assert {r.record_type for r in warc.round_trip(df, least_bytes=100).collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0
    path = str(tmp_path / "plain")
    warc.register(spark)
    spark.createDataFrame([("response", "urn:x:1", "u", None, None, b"body")], "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload binary").write.format("warc").option("compression", "none").mode("append").save(path)
    full = spark.read.format("warc").load(path).first()
    assert bytes(full.payload) == b"body" and full.http_length == 4 and full.target_uri == "u"
    filtered = spark.read.format("warc").schema("record_id string").load(path).where("record_id = 'other'")
    assert filtered.count() == 0


def test_warc_headers_cannot_be_smuggled(spark):
    """Signs that other line ends are made of stay within the URL; ids repeat, payloads too."""
    url = "http://a/\u2028WARC-Payload-Digest: sha1:AAAA\u0085WARC-Refers-To: <urn:pagemill:page:9>\x1cContent-Length: 3\r\nWARC-Type: revisit"
    pages = [(1, url, "own"), (2, url, "same"), (3, url, "same"), (3, url, "other"), (2, "x", "same")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("sha", F.lit(1)).withColumn("id", F.lit(2)).withColumn("lead", F.lit(2))
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    got = collections.Counter(tuple(r) for r in warc.round_trip(df).collect())
    assert got == {(1, 3, digest("own"), "response", None): 1, (2, 4, digest("same"), "revisit", 3): 2, (3, 4, digest("same"), "response", None): 1, (3, 5, digest("other"), "response", None): 1}


def test_sql_twins(spark):
    """The queries that SQL expresses, on the whole small tables."""
    import duckdb

    from pagemill.llm import queries

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        rows = lambda found: sorted(map(tuple, found), key=repr)
        assert rows(got.select(*want.columns).collect()) == rows(want.fetchall()), name
