"""The operators that compare or place documents: packing, archives, near duplicates, contamination, language model."""

import gzip
import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import decontam, packing, queries, simhash, suffix_lm, warc

from .conftest import make
from .test_maps import BLANK, WORD, low

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# --- packing ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.lists(st.sampled_from(["it's", "<|endoftext|>", "  \n ", "日本", "12", "é", "\x00", "🙂", "don't"])).map("".join))
def test_ids_are_the_tokenizers(reference_tokenizer, text):
    assert packing.encoder(TOKENIZER).encode(text, allowed_special="all") == reference_tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\t", "\n", "\r\n", "\x85", "\xa0", "\u2003", "\x1c", "ab", "'s", "7", "<|endoftext|>"])).map("".join), st.sampled_from([1, 2, 3]))
def test_runs_of_white_space_cut_by_hand(reference_tokenizer, text, least):
    assert packing.token_ids(text, TOKENIZER, least).tolist() == reference_tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [999_999, 1_000_001, 3_000_000])
def test_long_runs_of_white_space(reference_tokenizer, n):
    for run in (" ", "\n", " \t\n"):
        for before, after in (("a", "b"), ("", ""), ("a", "<|endoftext|>x"), ("é.", "\n7")):
            text = before + (run * n)[:n] + after
            assert packing.token_ids(text, TOKENIZER).tolist() == reference_tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_of_a_long_run_of_blanks(spark):
    packed = packing.pack(packing.token_pieces(make(spark, [(1, "a" + " " * 1_000_001 + "b"), (2, "c")]), TOKENIZER))
    assert packed.filter("doc_id = 1").agg({"length": "sum"}).first()[0] == len(packing.token_ids("a" + " " * 1_000_001 + "b", TOKENIZER)) + 1


def test_ids_of_documents_are_the_tokenizers(spark, reference_tokenizer, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert [packing.encoder(TOKENIZER).encode(t, allowed_special="all") for t in texts] == [x.ids for x in reference_tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=30))
def test_plan_places_every_piece_once(counts):
    kinds = packing.plan(counts, 40)
    used = Counter()
    for copies, places in kinds:
        assert copies > 0 and sum(n * k for n, k in places) <= 40
        assert sum(k for n, k in places if 3 * n > 40) <= 2
        for n, k in places:
            used[n] += copies * k
    assert used == Counter(counts)
    runs = packing.places_by_length(kinds)
    taken = Counter()
    for n, (first, sequence, offset) in runs.items():
        edges = [*first, counts[n]]
        for f, to, s, o in zip(first, edges[1:], sequence, offset):
            for r in range(f, to):
                taken.update((s + r - f, o + x) for x in range(n))
    assert all(v == 1 for v in taken.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_plan_is_near_the_optimum(sizes):
    def fits(bins, rest):
        return not rest or any(fits([*bins[:i], b + rest[0], *bins[i + 1 :]], rest[1:]) for i, b in enumerate(bins) if b + rest[0] <= 12 and b not in bins[:i])

    best = next(k for k in range(1, 10) if fits([0] * k, sorted(sizes, reverse=True)))
    assert sum(m for m, _ in packing.plan(Counter(sizes), 12)) <= max(best + 1, 11 * best // 9)


def check_packing(rows, docs, tokenizer, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and 1 <= r.length
            at += r.length
        assert at <= capacity
    want = Counter()
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by)


def test_packing_on_odd_rows(odd, odd_rows, empty, reference_tokenizer):
    for capacity in (64, 2048):
        pieces = packing.token_pieces(odd.withColumnsRenamed({"lang": "length", "source": "_rank"}), TOKENIZER, capacity)
        rows = packing.pack(pieces, capacity).collect()
        n = check_packing(rows, odd_rows, reference_tokenizer, capacity)
        assert n <= 1.05 * sum(r.length for r in rows) / capacity + 2
    assert packing.pack(packing.token_pieces(empty, TOKENIZER)).count() == 0


def test_packing_query(spark, sf, reference_tokenizer):
    rows = queries.op2_best_fit_packing(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_packing(rows, docs, reference_tokenizer, 2048)


def test_ranks_of_a_hot_length_are_spread(spark):
    pieces = spark.range(50_000).selectExpr("id doc_id", "0 piece", "0L start", "IF(id % 3 = 0, 7L, id % 50 + 1) length", "id ids_crc32")
    rows, counts = packing.ranked(pieces, 5_000_000)
    got = rows.groupBy("length").agg({"_rank": "max", "*": "count"}).collect()
    assert rows.select("length", "_rank").distinct().count() == 50_000
    assert all(r["max(_rank)"] == r["count(1)"] - 1 == counts[r["length"]] - 1 for r in got)


# --- archives -----------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, archive string, digest string")


def test_archives_on_odd_rows(spark):
    big, other = "<p>é" * 100, "x" * 100
    rows = [
        (5, "http://a/ b", big), (3, "http://a", big), (9, None, big), (1, "http://s", "small"), (2, "http://s", "small"), (4, "u", None),
        (6, "u", ""), (None, "n", other), (8, "n", other), (8, "n", other), (7, "m", "y" * 99), (10, "m", "y" * 99), (11, "l", "z\r\n\r\n" * 50_000),
    ]
    found = warc.archive_pages(spark, pages(spark, [(*r, "c", "d") for r in rows]).repartition(3)).collect()
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        first = min(same, default=None) if len(raw) >= 100 else None
        to = first if first is not None and first != i else None
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    assert warc.archive_pages(spark, pages(spark, [])).count() == 0
    assert {r.target_uri for r in found if r.page_id == 5} == {"http://a/%20b"}
    by_id = {r.record_id: r for r in found}
    for r in found:
        assert (r.refers_to is None) == (r.refers_to_id is None)
        if r.refers_to is not None:  # the record that is named is there, and a response
            assert (by_id[r.refers_to_id].page_id, by_id[r.refers_to_id].record_type) == (r.refers_to, "response")


def test_page_ids_keep_their_type(spark):
    rows = [("b 2", "u", "x" * 100), ("a\r\n1", "v", "x" * 100), ("", "w", "y"), (None, "n", "z")]
    found = warc.archive_pages(spark, spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in found) == Counter(
        [("b 2", "revisit", "a\r\n1"), ("a\r\n1", "response", None), ("", "response", None), (None, "response", None)]
    )


def test_each_archive_is_a_task(spark, tmp_path):
    data = [(k, f"http://x/{k}", f"{k} " * 200, "c", "d") for k in range(60)]
    index = warc.write_arc(pages(spark, data).repartition(12), f"{tmp_path}/arc")
    n = index.select("archive").distinct().count()
    records = warc.read_arc(index, f"{tmp_path}/arc")
    assert n > 8 and len(records.inputFiles()) == n
    files = warc.convert(warc.with_revisits(records), f"{tmp_path}/arc", f"{tmp_path}/warc")
    assert files.count() == n and warc.read_warc(files, f"{tmp_path}/warc").count() == 60


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers_of_each_version(version):
    payload = b"<html>\n\nhi\n"
    raw = warc.arc_record(version, "f.arc.gz", 7, "http://x/a b\n", payload, "19970301123456")
    got = warc.parse_arc(raw, version)
    assert (got.url, got.ip, got.date, got.mime, got.page_id, got.payload) == ("http://x/a%20b%0A", "0.0.0.0", "19970301123456", "text/html", "7", payload)
    assert len(raw.split(b"\n", 1)[0].split(b" ")) == (5 if version == 1 else 10)
    assert warc.arc_version(warc.arc_opening(version, "f", "1997")) == version
    with pytest.raises(ValueError, match="declared"):
        warc.parse_arc(raw[:-5], version)
    with pytest.raises(ValueError, match="not an ARC header"):
        warc.parse_arc(b"http://x 1.1.1.1 2000 text/html many\n", version)
    # A raw blank within the URL, as old writers left it.
    assert warc.parse_arc(raw.replace(b"a%20b", b"a b", 1), version).url == "http://x/a b%0A"


def test_converted_records():
    arc = warc.parse_arc(warc.arc_record(1, "f", 7, "http://x", b"body", "199703"), 1)
    digest = hashlib.sha256(b"body").hexdigest()
    head, block = warc.parse_warc(warc.convert_record(arc, None, digest))
    assert head["WARC-Type"] == "response" and block == arc.block and head["WARC-Date"] == "1997-03-01T00:00:00Z"
    assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", head["WARC-Record-ID"]) and head["WARC-Payload-Digest"] == f"sha256:{digest}"
    first = warc.parse_arc(warc.arc_record(1, "f", 3, "http://first", b"body", "1996"), 1)
    response, _ = warc.parse_warc(warc.convert_record(first, None, digest))
    again, rest = warc.parse_warc(warc.convert_record(arc, warc.Response("3", "http://first", "1996"), digest))
    assert again["WARC-Type"] == "revisit" and rest.endswith(b"\r\n\r\n") and again["WARC-Record-ID"] == head["WARC-Record-ID"]
    assert again["WARC-Refers-To"] == response["WARC-Record-ID"] and again["WARC-Refers-To-Date"] == response["WARC-Date"] == "1996-01-01T00:00:00Z"
    assert again["WARC-Refers-To-Target-URI"] == response["WARC-Target-URI"] == "http://first" and again["X-Refers-To-Page"] == "3"


def test_members_are_streamed(tmp_path):
    parts = [b"a" * 10, b"", np.random.default_rng(0).bytes(700_000), b"end"]
    (tmp_path / "x.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    got = list(warc.members(str(tmp_path), "x.gz"))
    assert [b for _, b in got] == parts and got[1][0] == len(gzip.compress(parts[0]))
    (tmp_path / "y.gz").write_bytes(gzip.compress(b"hello" * 100)[:-9])
    with pytest.raises(ValueError, match="it ends within"):
        list(warc.members(str(tmp_path), "y.gz"))


# --- near duplicates ----------------------------------------------------------------------------------------


def fingerprint_brute(text):
    words = BLANK.findall(low(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "É", "\t", "\x0b", "\x1c", "c c c", "\x85"]), max_size=900))
def test_fingerprints(parts):
    text = " ".join(parts)
    assert simhash.fingerprint(text.encode()) == fingerprint_brute(text)


def components_brute(fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def noisy(rng, n, bases, flips):
    base = [int(x) for x in rng.integers(0, 1 << 63, bases, dtype=np.uint64)]
    out = []
    for _ in range(n):
        x = base[rng.integers(0, bases)]
        for _ in range(rng.integers(0, flips + 1)):
            x ^= 1 << int(rng.integers(0, 64))
        out.append(x)
    return out


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 7])
@pytest.mark.parametrize("seed", range(4))
def test_bit_slices_find_all_links(seed, radius):
    rng = np.random.default_rng(seed)
    fps = noisy(rng, 300, 25, 6)
    group = np.sort(rng.integers(0, 4, 300))
    root = simhash.link(np.array(fps, np.uint64), group, radius)
    for g in range(4):
        at = np.flatnonzero(group == g)
        want = [at[k] for k in components_brute([fps[i] for i in at], radius)]
        assert root[at].tolist() == want


@pytest.mark.parametrize("radius,blocks", [(3, 4), (3, 5), (3, 6), (2, 4)])
def test_masks_leave_no_pair_out(radius, blocks):
    own = simhash.masks(blocks, radius)
    rng = np.random.default_rng(1)
    for _ in range(500):
        bits = rng.choice(64, radius, replace=False)
        d = sum(1 << int(b) for b in bits)
        assert any(not d & m for m in own)


@pytest.mark.parametrize("block,n", [(4096, 10), (16, 10), (16, 1 << 30)])
def test_near_edges_and_components(spark, block, n):
    rng = np.random.default_rng(9)
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in noisy(rng, 400, 20, 5)})
    edges = simhash.near_edges(spark.createDataFrame([(x,) for x in fps], "fp long"), n, block=block)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    want = components_brute([x & (1 << 64) - 1 for x in fps])
    assert [found.get(x, x) for x in fps] == [min(fps[k] for k in range(len(fps)) if want[k] == w) for w in want]


def test_long_chains_end(spark):
    edges = spark.range(300).selectExpr("(id * 7919) % 1000003 u", "((id + 1) * 7919) % 1000003 v")
    found = simhash.components(edges).collect()
    assert len(found) == 301 and len({r.root for r in found}) == 1 and found[0].root == 0


def test_near_duplicates_on_odd_rows(spark, odd, odd_rows, empty):
    rows = odd_rows + [(200 + k, odd_rows[5][1] + " tail" * k) for k in range(3)]
    docs = make(spark, rows).withColumnsRenamed({"lang": "fp", "source": "component_id"})
    found = simhash.near_duplicates(docs).collect()
    fps = [fingerprint_brute(t) for _, t in rows]
    root = components_brute(fps)
    least = {r: min((i for (i, _), q in zip(rows, root) if q == r and i is not None), default=None) for r in root}
    want = Counter((i, f - (1 << 64) if f >> 63 else f, least[r]) for (i, _), f, r in zip(rows, fps, root))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in found) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in kept)) == sorted((least[r] is None, least[r] or 0) for r in {*root})
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_simhash_query(spark, sf):
    found = {r.doc_id: r for r in queries.op6_simhash_dedup(spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps = [fingerprint_brute(t) for _, t in docs]
    root = components_brute(fps)
    for (i, _), f, r in zip(docs, fps, root):
        assert found[i].fingerprint == f"{f:016x}"
        assert found[i].component_id == min(j for (j, _), q in zip(docs, root) if q == r)


# --- contamination ------------------------------------------------------------------------------------------


def contaminated_brute(docs, items, window=10):
    bench = [(i, WORD.findall(low(t or ""))) for i, t in items]
    out = []
    for i, t in docs:
        words = WORD.findall(low(t or ""))
        hit, ids = set(), set()
        for item, w in bench:
            n = min(window, len(w))
            wins = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            for k in range(len(words) - n + 1):
                if n and tuple(words[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    ids.add(str(item))
        out.append((i, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_contamination_on_odd_rows(spark, odd, odd_rows, empty):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(rng.integers(1, 30))) for k in range(12)] + [(50, None), (51, ""), (52, "same text"), (52, "same text"), (53, "same text"), (9, "w1 W2"), (60, "É é"), (None, "w3 w4 w5")]
    docs = odd_rows + [(300 + k, text(5) + " " + (items[k % 12][1] or "") + ". " + text(300)) for k in range(40)]
    docs += [(400, "w1 " * 2000), (401, " ".join(t or "" for _, t in items).upper())]
    items += [(70, "w1 " * 25)]
    frame = make(spark, docs).withColumnsRenamed({"lang": "k1", "source": "items"})
    found = decontam.decontaminate(frame, benchmark(spark, items))
    some = [(i, t) for i, t in items if i is not None]
    got = Counter(tuple(r)[:6] for r in decontam.decontaminate(frame, benchmark(spark, some)).collect())
    assert got == contaminated_brute(docs, some)
    assert found.count() == len(docs)
    clean = decontam.drop_contaminated(frame, benchmark(spark, some))
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, t in docs if not any(x[-1] for x in contaminated_brute([(i, t)], some)))
    assert decontam.decontaminate(empty, benchmark(spark, items)).count() == 0
    assert decontam.decontaminate(odd, benchmark(spark, [])).filter("contaminated").count() == 0


@pytest.mark.parametrize("most", [0, 500_000])
def test_contamination_by_shuffles_alone(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "small", lambda df, rows=0: decontam.F.broadcast(df) if most else df)
    docs = [(k, f"x{k} a b c d e f g h i j k l y{k}" if k % 2 else "a b c") for k in range(30)]
    items = [(1, "a b c d e f g h i j k l"), (2, "a b"), (3, "z")]
    got = Counter(tuple(r)[:6] for r in decontam.decontaminate(make(spark, docs), benchmark(spark, items)).collect())
    assert got == contaminated_brute(docs, items)


def test_no_python_in_the_contamination_plan(spark, sf):
    plan = queries.op10_decontamination(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def near_brute(docs, items, slop=decontam.SLOP, miss=decontam.MISS, window=10):
    """(doc, item, start, len, spread, words found) of every place, by the definition."""
    texts = [WORD.findall(low(t or "")) for _, t in docs]
    freq = Counter(w for t in texts for w in t)
    out = Counter()
    for item, t in {*items}:
        words = WORD.findall(low(t or ""))
        n = min(window, len(words))
        spare = miss if n == window else 0
        for s in range(len(words) - n + 1) if n else ():
            rarest = sorted(range(s, s + n), key=lambda k: (freq[words[k]], k))[: spare + 1]
            for (doc, _), own in zip(docs, texts):
                for d in {p - k for k in rarest for p, w in enumerate(own) if w == words[k]}:
                    off = [min((abs(p - k - d) for p in range(max(0, d + k - slop), min(len(own), d + k + slop + 1)) if own[p] == words[k]), default=None) for k in range(s, s + n)]
                    there = [x for x in off if x is not None]
                    if len(there) >= n - spare:
                        out[(doc, item, d + s, n, max(there), len(there))] += 1
    return out


def near_found(spark, docs, items):
    bench, at = decontam.item_terms(benchmark(spark, items))
    index = decontam.build_index(make(spark, docs), at.select("term", "tid").distinct())
    ids = decontam.documents_of(index).select("id", "k1", "k2").distinct()
    rows = decontam.proximity_matches(index, bench, at).join(ids, ["k1", "k2"]).join(bench.select("ik", "item_id"), "ik").collect()
    return Counter((r.id, r.item_id, r.start, r.len, r.spread, r.n_found) for r in rows)


def test_proximity_matches(spark):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = phrase.split()
    docs = [
        (1, f"one {phrase} two"), (2, phrase.replace("gamma", "gamma NEW")), (3, "zeta nothing alpha"), (4, " ".join(w if k % 10 != 4 else "other" for k, w in enumerate(words))),
        (5, " ".join([*words, *["x"] * 4, *words])), (6, " ".join(reversed(words))), (7, " ".join(words[1:])), (8, " w ".join(words)), (9, "word"), (10, None),
    ]
    items = [(1, phrase), (2, "word"), (3, "one two"), (4, None)]
    found = near_found(spark, docs, items)
    assert found == near_brute(docs, items)
    assert {k[0] for k in found if k[1] == 1} == {1, 2, 4, 5, 7}
    assert sorted(k[2] for k in found if k[:2] == (5, 1)) == [0, 1, 2, 16, 17, 18]  # each place, at its own start
    assert (2, 1, 0, 10, 1, 10) in found and (4, 1, 0, 10, 0, 9) in found and (7, 1, -1, 10, 0, 9) in found


@pytest.mark.parametrize("seed", range(2))
def test_proximity_by_brute_force(spark, seed):
    """Few words, so that they repeat within windows and tie; words put in, left out and swapped."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(1, 16)))) for k in range(10)]
    docs = []
    for k in range(40):
        own = items[k % 10][1].split()
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, len(own) + 1)
            own[at : at + rng.integers(0, 2)] = list(rng.choice(vocabulary, rng.integers(0, 2)))
        docs.append((k, " ".join([*rng.choice(vocabulary, 20), *own, *rng.choice(vocabulary, 20)])))
    want = near_brute(docs, items)
    assert near_found(spark, docs, items) == want and len(want) > 50


# --- language model -----------------------------------------------------------------------------------------


def tree_brute(texts):
    """Counts, retained contexts and a scorer, by the definitions."""
    depth, pad = suffix_lm.DEPTH, b"\n" * suffix_lm.DEPTH
    counts: dict[bytes, Counter] = {}
    total = 0
    for s in texts:
        for k in range(len(s)):
            total += 1
            for d in range(depth + 1):
                counts.setdefault((pad + s)[k + depth - d : k + depth], Counter())[s[k]] += 1
    least = suffix_lm.LEAST_COUNT
    kept = {b""}
    for c, n in counts.items():
        size = sum(n.values())
        if c and size >= least:
            up = counts[c[1:]]
            gain = sum(x * np.log(x / size / (up[a] / sum(up.values()))) for a, x in n.items())
            if gain >= suffix_lm.LEAST_KL * size and gain >= suffix_lm.LEAST_GAIN * len(n):
                kept |= {c[k:] for k in range(len(c))}

    def p(c, a):
        n = counts.get(c, Counter())
        size = sum(n.values())
        if not c:
            return (n[a] + 0.5) / (size + 128)
        return (n[a] + len(n) * p(c[1:], a)) / (size + len(n))

    def score(s):
        out = 0.0
        for k in range(len(s)):
            c = (pad + s)[k : k + depth]
            while c not in kept:
                c = c[1:]
            out += np.log10(p(c, s[k]))
        return out

    return kept, score


def lm_brute(docs):
    tokens = lambda t: [*BLANK.findall(low(t or "")), ""]
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5
    c = Counter(w for i, t in docs if fold(i) not in (1, None) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in docs:
        own = tokens(t)
        out.append((i, fold(i) == 1, len(own), sum(c[w] > 0 for w in own), n, round(float(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)), 4)))
    return Counter(out)


def test_language_model_on_odd_rows(spark, odd, odd_rows, empty):
    found = suffix_lm.score_documents(odd.withColumnsRenamed({"lang": "ids", "source": "score"})).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == lm_brute(odd_rows)
    train = [suffix_lm.stream((t or "").encode()) for i, t in odd_rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    _, score = tree_brute(train)
    want = Counter((i, round(float(score(suffix_lm.stream((t or "").encode()))), 3)) for i, t in odd_rows)
    assert Counter((r.doc_id, round(r.score, 3)) for r in found) == want
    assert suffix_lm.score_documents(empty).count() == 0
    alone = suffix_lm.score_documents(make(spark, [(None, "a b")])).collect()
    assert np.isclose(alone[0].score, 4 * np.log10(1 / 256)) and alone[0].train_tokens == 0


def test_suffix_tree_states(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(25).collect()
    texts = [suffix_lm.stream(r.text.encode()) for r in rows]
    raw = spark.createDataFrame([(bytearray(r.text.encode()),) for r in rows], "_raw binary")
    table = suffix_lm.grow(suffix_lm.count_grams(raw))
    tree = suffix_lm.fetch(table)
    kept, score = tree_brute(texts)
    got = {b""} | {int(c).to_bytes(d, "big")[::-1] for d in range(1, suffix_lm.DEPTH + 1) for c in tree.contexts[d]}
    assert got == kept and len(kept) > 50
    probe = texts[:5] + [b"entirely new words 123\n", b"\n"]
    key = np.unique(suffix_lm.grams(probe)[0])
    joined = suffix_lm.gram_scores(spark.createDataFrame([(int(k),) for k in key], "gram long"), table).toPandas().sort_values("gram")["x"]
    assert np.allclose(joined, tree.score_grams(key))
    assert np.allclose(tree.score(probe), [score(s) for s in probe])


def test_blocks_and_joins_do_not_change_scores(spark, sf, odd):
    """Many small blocks and steps, and a tree that is joined, not sent."""
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    some = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for docs in (odd, some.unionByName(odd.select(some.columns))):
        got = [
            [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in sorted(found.collect(), key=key)]
            for found in (
                suffix_lm.score_documents(docs),
                suffix_lm.score_documents(docs.coalesce(1), block_bytes=20_000, step=7_000, count_step=9_000),
                suffix_lm.score_documents(docs, most_edges=0),
                suffix_lm.score_documents(docs.coalesce(1), most_edges=0, block_bytes=20_000),
            )
        ]
        assert got[0] == got[1] == got[2] == got[3]


def test_language_model_holds_one_block_at_a_time(spark, sf):
    """Counts are handed on when a task has many, and facts of words and grams come to a block as rows, not as lists that wait for others."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    raw = docs.selectExpr("cast(text AS binary) AS _raw").coalesce(1)
    few, all_ = (Counter({r.gram: r.n for r in suffix_lm.count_grams(raw, step=3_000, most_held=n).collect()}) for n in (2_000, 10**9))
    assert few == all_ and len(all_) > 10_000
    for most_edges in (suffix_lm.MOST_EDGES, 0):
        found = suffix_lm.score_documents(docs, most_edges=most_edges)
        assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_ids_may_be_text(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, "three"), ("b", None)], "doc_id string, text string")
    assert {r.doc_id for r in suffix_lm.score_documents(docs).collect()} == {"a", None, "b"}


def test_language_model_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op7_suffix_tree_lm(spark, sf).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == lm_brute(docs)
    train = [suffix_lm.stream(t.encode()) for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    _, score = tree_brute(train)
    by = {r.doc_id: r.score for r in found}
    assert all(np.isclose(by[i], score(suffix_lm.stream(t.encode()))) for i, t in docs[:20])


@pytest.mark.parametrize("query", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, query):
    import duckdb

    at = "/root/testdata/sf0.001" if query == "op5_warc_convert" else "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    want = c.sql(queries.ORACLES[query])
    names = sorted(want.columns)
    found = queries.QUERIES[query](spark, at)
    assert sorted(found.columns) == names
    assert Counter(tuple(r) for r in found.select(*names).collect()) == Counter(c.sql(queries.ORACLES[query]).select(*names).fetchall())
