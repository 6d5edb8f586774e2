"""Line dedup, prefix tree and resampling against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import make
from tidegrid.llm import line_dedup, prefix_trie, resampling
from tidegrid.llm.common import join_hot, plain_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_lines(rows, least_docs=2):
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                docs.setdefault(key(line), set()).add(math.inf if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = math.inf if i is None else i
        kept = [x for x in lines if len(docs.get(key(x), ())) < least_docs or min(docs[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(3)
    pool = ["a common line here", "  A COMMON LINE HERE\t", "short", "ÉPÉE is not épée here", "épée is not épée here", "exactly10!", "exactly9!", "\x0bend marks\x0c\r", "end marks", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "a common line here\nonly without id"), (None, "only without id"), (52, "twice in here\nTwice in here"), (53, "x" * 10), (54, "x" * 10 + "\n"), (54, "x" * 10 + "\n")]
    return rows + [(60, "\n".join(f"line number {k % 70_000}" for k in range(100_000))), (61, "line number 69999\nline number 70000"), (10, rows[10][1])]


@pytest.mark.parametrize("least_docs", [2, 3])
def test_lines_equal_brute_force(spark, least_docs):
    rows = line_rows()
    found = line_dedup.dedup_lines(make(spark, rows), least_docs=least_docs).select("doc_id", "n_lines", "n_dropped", "text")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_lines(rows, least_docs)


def test_lines_hot_empty_and_clashing_columns(spark, empty):
    rows = [(i, f"the line that all documents have\nown line {i}") for i in range(3_000)]
    docs = make(spark, rows).withColumns({"k1": F.lit("x"), "_gone": F.lit(1), "n_lines": F.lit("old"), "first": F.lit(None).cast("int")})
    found = line_dedup.dedup_lines(docs)
    assert set(found.columns) == {*docs.columns, "n_dropped"}
    assert found.filter("k1 = 'x' AND _gone = 1 AND first IS NULL AND n_lines = 2").count() == 3_000
    assert found.filter("n_dropped = 0").select("doc_id").collect() == [(0,)]
    none = line_dedup.dedup_lines(empty)
    assert none.count() == 0 and "text" in none.columns


def test_join_hot_is_a_join(spark):
    rows = spark.range(9_000).select((F.col("id") % 2 * F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") + 1).filter("k <> 5")
    found = join_hot(rows, facts, ["k"], "n", 9_000)
    assert sorted(map(tuple, found.select("k", "id", "x").collect())) == sorted((i % 2 * i, i, i % 2 * i + 1) for i in range(9_000) if i != 5)


# --- conversations ------------------------------------------------------------------------------------------


def order_of(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest())


def brute_tree(rows, rebuild=True):
    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order_of):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
        convs = {c: convs.get(c - c % 100, [])[: h[c]] + convs[c][h[c] :] for c in convs}
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, below = Counter(p[:-1] for p in members if p), {}
    for p in members:
        for d in range(len(p) + 1):
            below.setdefault(p[:d], []).append(p)
    out = []
    for p, own in members.items():
        leaves = sum(children[x] == 0 for x in below[p])
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below[p] if x)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves, saved, sha(ends)))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def tree_rows(seed):
    rng = random.Random(seed)
    texts = ["hi", "hello there", "", "épée", None]
    rows = []
    for c in [*range(60), *range(100, 130), 205, 207, 340]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts[: 2 + c % 4])) for t in range(rng.randint(1, 9))]
    rows += [(400, None, "user", "b"), (400, None, "user", "a"), (400, 1, "user", "z"), (400, 1, "user", "z"), (None, 1, "user", "lost"), (401, -3, "user", "a"), (401, 7, None, "b")]
    return rows + [(c, t, "user", "same") for c in range(500, 540) for t in range(8)]


@pytest.mark.parametrize(("rebuild", "seed"), [(True, 1), (False, 2)])
def test_tree_equals_brute_force(spark, rebuild, seed):
    rows = tree_rows(seed)
    found = prefix_trie.prefix_tree(spark.createDataFrame(rows, SCHEMA).withColumn("_part", F.lit("x")).repartition(3), rebuild)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_tree(rows, rebuild)


def test_tree_of_long_nested_and_many(spark, monkeypatch):
    """Conversations over many stretches, chains nested in each other, more ids at an end than a part holds."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 8)
    monkeypatch.setattr(prefix_trie, "IDS", 16)
    rows = [(1000, t, "user", f"t{t}") for t in range(90)]
    rows += [(1001 + k, t, "user", f"t{t}" if t < 60 - 3 * k else f"own {k // 2} {t}") for k in range(18) for t in range(70)]
    rows += [(2000 + k, 0, "user", "t0") for k in range(100)]
    found = prefix_trie.prefix_tree(spark.createDataFrame(rows, SCHEMA), rebuild=False)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_tree(rows, False)


def test_tree_turnless_and_empty(spark):
    rows = [(c, 0, "user", "x") for c in (7, 8, 9, 10, 11, 12)]  # no conversation 0: those with h > 0 lose their turn
    found = prefix_trie.prefix_tree(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_tree(rows)
    only = [(c, 0, "user", "x") for c in range(7, 60) if zlib.crc32(str(c).encode()) % 6]
    found = prefix_trie.prefix_tree(spark.createDataFrame(only, SCHEMA))
    assert [tuple(r) for r in found.collect()] == brute_tree(only)
    assert prefix_trie.prefix_tree(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.prefix_tree(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).columns == list(prefix_trie.COLUMNS)


# --- resampling ---------------------------------------------------------------------------------------------


def brute_runs(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[a : a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1)]


def brute_sample(rows, target, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    runs = [brute_runs(t) for _, t in rows]
    s, t = Counter(bucket(f) for _, x in runs for f in x), Counter(bucket(f) for x in target for f in brute_runs(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0))))
    found = []
    for (i, _), (n, x) in zip(rows, runs):
        weight = sum(gain(bucket(f)) for f in x)
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        found.append((i, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in found if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    rank = {id(x): k + 1 for k, x in enumerate(order[: percent * len(order) // 100])}
    return sorted(((*x, rank.get(id(x))) for x in found), key=repr)


def test_resampling_equals_brute_force(spark, odd_rows, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "épée", "x1", "the", "of", "ÀB"]
    rows = [r for r in odd_rows if not r[1] or len(r[1]) < 5_000] + [(200 + k, " ".join(rng.choice(words) for _ in range(rng.randint(15, 60)))) for k in range(150)]
    rows += [(103, " ".join(rng.choice(words) for _ in range(3_000)))]
    target = ["alpha gamma the of", None, "", "one unseen phrase, x1."]
    bench = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    found = resampling.resample(make(spark, rows).withColumn("score", F.lit("x")), bench, percent=20)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = brute_sample(rows, target, 20)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert sorted(r[5] for r in got if r[5]) == list(range(1, len([r for r in want if r[5]]) + 1))
    assert {r for r in got if r[5] and r[0] != 104} == {r for r in want if r[5] and r[0] != 104}  # equal rows may swap


def test_long_texts_are_counted_in_pieces():
    rng = random.Random(6)
    words = [rng.choice([b"a", b"bb", b"the", b"x"]) for _ in range(2_003)]
    whole = resampling.counted([words])
    for block in (10, 500, 2_001, 2_002, 2_003, 5_000):
        bucket, n = resampling.counted_long(words, block)
        assert bucket.tolist() == whole[0][0].tolist() and n.tolist() == whole[1][0].tolist()
    assert plain_words(b"A b") == [b"a", b"b"]


def test_resampling_empty(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, bench).collect() == []
    one = resampling.resample(make(spark, [(1, None), (2, "a b")]), bench)
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in one.collect()) == [(1, 0, None), (2, 3, None)]
