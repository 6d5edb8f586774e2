"""The operators that judge each text by itself: licenses, quality, languages, toxicity, line rules."""

import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import langid, licenses, line_rules, quality_rank, queries, toxicity
from tidegrid.llm.common import blank_words, plain_words

from .conftest import make

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aBz09 \n\t\x0b\x0c\x1c|#-éÉß \x7f\x85{`@[")))
def test_words(text):
    assert [w.decode() for w in plain_words(text.encode())] == WORD.findall(low(text))
    assert [w.decode() for w in blank_words(text.encode())] == BLANK.findall(text)


# --- licenses -----------------------------------------------------------------------------------------------


def base_brute(text):
    words = WORD.findall(low(text or ""))
    places = [
        (i, label)
        for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["cc", "by", "CC-BY", "general", "public", "license", "all rights", "reserved", "é", ".", "acc", "bye", "\n"])))
def test_base_places(parts):
    text = " ".join(parts)
    n, exact, _, score = licenses.scan_text(text.encode(), licenses.BASE_NOTICES + licenses.FUZZY_NOTICES)
    starts = [w for _, w in exact]
    assert (n, len(exact), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in exact}))) == base_brute(text)
    assert 0 <= score <= 1


def test_fuzzy_spans_are_all_found():
    """Every text within the edits of a notice, by a plain edit-distance table over all substrings, is covered by a span."""

    def best(phrase, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(phrase):
            new = [i + 1]
            for j, b in enumerate(text):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    rng = np.random.default_rng(3)
    notice = licenses.Notice("gpl", "general public license", 2)
    for _ in range(150):
        chars = list("some words general public license and more")
        for _ in range(rng.integers(0, 5)):
            k = rng.integers(0, len(chars))
            chars[k : k + 1] = [[], [chars[k], "q"], ["z"]][rng.integers(0, 3)]
        text = "".join(chars)
        norm = f" {' '.join(WORD.findall(text))} "
        found = licenses.scan_text(text.encode(), (notice,))[2]
        assert bool(found) == (best(notice.phrase, norm) <= notice.edits), text
        assert all(e <= 2 for *_, e, _ in found)


def test_license_query_on_odd_rows(odd, odd_rows, empty):
    docs = odd.withColumnsRenamed({"lang": "n_words", "source": "score"})
    rows = licenses.license_digest(licenses.scan_licenses(docs)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base) for r in rows) == Counter((i, *base_brute(t)[:2]) for i, t in odd_rows)
    assert licenses.license_digest(licenses.scan_licenses(empty)).count() == 0


def test_license_spans(spark):
    docs = make(spark, [(1, "Foo. Relased under the MIT Licence! All rights reserved. CC BY-SA"), (2, "nothing here")])
    one, two = licenses.license_digest(licenses.scan_licenses(docs)).orderBy("doc_id").collect()
    assert one.base_labels == "cc-by,reserved" and one.labels == "cc-by,mit,reserved" and one.score == 1.0
    assert (two.base_labels, two.labels, two.score, two.n_base, two.first_word) == ("", "", 0.0, 0, None)
    assert any(s.start == 1 and s.edits > 0 for s in one.spans)


def test_notices_that_follow_each_other():
    """A match with edits that stands before a better one is found too."""
    found = licenses.scan_text(b"general public licence general public license, generel public license", (licenses.Notice("gpl", "general public license", 2),))[2]
    assert [(a, b, e) for _, a, b, e, _ in found] == [(0, 3, 1), (3, 6, 0), (6, 9, 1)]


def test_long_texts_full_of_notices_take_linear_time():
    took = []
    for n in (20_000, 160_000):
        began = time.perf_counter()
        _, exact, fuzzy, score = licenses.scan_text(b"CC-BY. all rights resirved " * n, licenses.BASE_NOTICES + licenses.FUZZY_NOTICES)
        took.append(time.perf_counter() - began)
        assert (len(exact), exact[-1], score) == (n, ("cc-by", 5 * (n - 1)), 1.0) and len(fuzzy) >= n
    assert took[1] < 24 * took[0]


@pytest.mark.parametrize("query", ["op1_license_scan"])
def test_license_query(spark, sf, query):
    """All base columns of the query by brute force; labels hold the base ones, and those of every fuzzy notice's span."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES[query](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_brute(docs[r.doc_id])
        own = {x for x in r.labels.split(",") if x}
        assert {x for x in r.base_labels.split(",") if x} <= own and ",".join(sorted(own)) == r.labels
        assert (len(r.spans) + r.n_base > 0) == bool(own) and 0 <= r.score <= 1 and (r.score == 1) >= (r.n_base > 0)


# --- quality ranking ----------------------------------------------------------------------------------------


def test_ranking_orders_pairs():
    rng = np.random.default_rng(1)
    y = (rng.random(600) < 0.8).astype(int)
    x = np.zeros((600, quality_rank.N_FEATURES))
    x[:, 2] = rng.normal(0, 1, 600) - 2 * y
    x[:, 4] = rng.normal(0, 1, 600)
    m = quality_rank.fit_pairs(x, y)
    s = m.score(x)
    good, bad = s[y == 1], s[y == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert abs((s < quality_rank.CUT).mean() - (y == 0).mean()) < 0.02  # the quantile
    assert ((0 <= s) & (s <= 1)).all()


def features_brute(text):
    """The features in plain Python, over a list of characters."""
    raw = (text or "").encode()
    words = BLANK.findall(text or "")
    n = len(words)
    if not n:
        return [0.0] * (quality_rank.N_FEATURES - 1) + [1.0]
    has = lambda chars: sum(c in chars for c in raw)
    upper, lower, high = has(range(65, 91)), has(range(97, 123)), has(range(128, 256))
    letters = max(1, upper + lower + high // 2)
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    pairs, symbols = len({*zip(words, words[1:])}), has(b"#*$%&|<>")
    return [
        np.log1p(n) / 5, min(n, 20) / 20, upper / letters, float(upper > letters / 2), min(symbols / n, 2.0), float(symbols > 0.1 * n), min(has(b"!") / n, 2.0), min(has(b"|") / n, 1.0),
        has(range(48, 58)) / len(raw), min(has(b",.") / n, 1.0), min(len(raw) / n, 30.0) / 10, len({*words}) / n, 1 - pairs / max(1, n - 1), float(pairs < 0.7 * (n - 1)),
        1 - len({*lines}) / len(lines), len(lines) / n, sum(w.encode() in quality_rank.FUNCTION_WORDS for w in words) / n, letters / len(raw), min((has(b"@") + (text or "").count("://")) / n, 1.0), 0.0,
    ]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["The", "of", "ABC", "é", "12", "a@b", "http://x", "|", "#", "!", "\n", "same line\n", ",", "."]), max_size=60))
def test_features_by_plain_python(parts):
    text = " ".join(parts)
    assert np.allclose(quality_rank.features(text.encode()), features_brute(text))


def test_pair_sums_by_brute_force():
    """Gradient and Hessian over every pair, one by one; the fitted weights are where the gradient with its penalty is zero."""
    rng = np.random.default_rng(7)
    z, y = rng.normal(size=(40, 4)), (rng.random(40) < 0.6).astype(int)
    w = rng.normal(size=4)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    grad, hess = np.zeros(4), np.zeros((4, 4))
    for i in good:
        for j in bad:
            d = z[i] - z[j]
            p = 1 / (1 + np.exp(-d @ w))
            grad += (p - 1) * d
            hess += p * (1 - p) * np.outer(d, d)
    n = len(good) * len(bad)
    for block in (512, 3):
        got = quality_rank.pair_sums(z, w, good, bad, block)
        assert np.allclose(got[0], grad / n) and np.allclose(got[1], hess / n)
    x = np.zeros((40, quality_rank.N_FEATURES))
    x[:, :4] = z
    m = quality_rank.fit_pairs(x, y)
    own = quality_rank.pair_sums((x - m.mean) / m.scale, m.weights, good, bad)[0] + 1e-3 * m.weights
    assert np.abs(own).max() < 1e-6


def test_quality_query(spark, sf):
    """The query's rows by plain Python from a model fitted on plain features."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality in (0, 1)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    known = sorted((i, y) for i, y in marks if i in docs and fold(i) != 2)
    model = quality_rank.fit_pairs(np.array([features_brute(docs[i]) for i, _ in known]), np.array([y for _, y in known]))
    rows = queries.op3_quality_ranking(spark, sf).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    for r in rows:
        z = sum((a - b) / c * w for a, b, c, w in zip(features_brute(docs[r.doc_id]), model.mean, model.scale, model.weights))
        want = 1 / (1 + np.exp(-min(max((z - model.cut) / model.width + np.log(0.7 / 0.3), -30), 30)))
        assert r.held_out == (fold(r.doc_id) == 2) and np.isclose(r.score, want, atol=1e-6) and r.predicted == (r.score >= 0.7)


def test_quality_on_odd_rows(odd, odd_rows, empty, labels):
    model = quality_rank.train(odd, labels)
    found = quality_rank.score_quality(odd.withColumnRenamed("source", "quality_score"), model).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.quality_score <= 1 for r in found)
    blank = {r.quality_score for r in found if not (r.text or "").strip()}
    assert len(blank) == 1
    assert len({r.quality_score for r in found if r.doc_id == 104}) == 1
    for m in (model, quality_rank.train(odd, labels.limit(0)), quality_rank.train(empty, labels)):
        assert quality_rank.score_quality(empty, m).count() == 0


def test_quality_held_out(spark, sf):
    docs, marks = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    found = quality_rank.score_quality(docs, quality_rank.train(docs, marks, fold=(4, 2))).join(marks, "doc_id").toPandas()
    held = found[found["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]
    assert ((held["quality_score"] >= quality_rank.CUT) == held["quality"]).mean() > 0.95


# --- languages ----------------------------------------------------------------------------------------------


def test_scores_equal_a_plain_sum(spark):
    texts = ["The cat sat on the mat", "der Hund und die Katze", "Über Öl", "a", ""]
    docs = make(spark, list(enumerate(texts)))
    model = langid.train(docs)
    got = langid.log_likelihood(texts, model)
    for k, t in enumerate(texts):
        c = langid.codes(t)
        want = model.prior + sum(model.log_prob[h] for n in langid.ORDERS for h in (langid.hashed(c, n) if len(c) >= n else []))
        assert np.allclose(got[k], want, rtol=1e-4)


def test_long_texts_are_scored_whole(spark, monkeypatch):
    docs = make(spark, [(1, "the cat and the dog"), (2, "x")])
    model = langid.train(docs)
    text = "the cat and the dog " * 50
    whole = langid.log_likelihood([text], model)
    monkeypatch.setattr(langid, "STEP", 37)
    assert np.allclose(langid.log_likelihood([text], model), whole)


def test_language_on_odd_rows(spark, odd, odd_rows, empty):
    model = langid.train(odd)
    found = langid.identify(odd.withColumnRenamed("source", "lang_pred"), model).collect()
    assert len(found) == len(odd_rows)
    assert all((r.lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in r.text or "")) for r in found)
    assert langid.identify(empty, model).count() == 0
    none = langid.identify(odd, langid.train(empty)).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(make(spark, [(1, "12 34 __"), (2, "5"), (3, "\u00b2 \u00bd \u2167")]), model).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(make(spark, [(1, "\u02b0"), (2, "\u65e5")]), model).filter("lang_pred = 'und'").count() == 0


def test_language_query(spark, sf):
    """Prediction, score and fold by plain counts of hashed n-grams."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    own = lambda t: [(h) for n in langid.ORDERS for h in langid.hashed(langid.codes(t), n).tolist()]
    known = [(t, x) for i, t, x in docs if t is not None and x is not None and fold(i) != 0]
    langs = sorted({x for _, x in known})
    counts = {x: Counter(h for t, y in known if y == x for h in own(t)) for x in langs}
    sizes, seen = {x: sum(c.values()) for x, c in counts.items()}, Counter(x for _, x in known)
    rows = {r.doc_id: r for r in queries.op4_language_id(spark, sf).collect()}
    assert rows.keys() == {i for i, _, _ in docs}
    for i, t, _ in docs:
        r = rows[i]
        assert r.held_out == (fold(i) == 0)
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        grams = own(t)
        z = [np.log(seen[x] / len(known)) + sum(np.log((counts[x][h] + 0.1) / (sizes[x] + 0.1 * langid.BUCKETS)) for h in grams) for x in langs]
        assert r.lang_pred == langs[int(np.argmax(z))] and np.isclose(r.score, 1 / np.exp(np.array(z) - max(z)).sum(), atol=1e-3)


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    found = langid.identify(docs, langid.train(docs, fold=(5, 0))).toPandas()
    held = found[found["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95


# --- toxicity -----------------------------------------------------------------------------------------------



def test_rare_languages_are_learned(spark):
    """Over 40,000 rows of one language don't crowd out one with two rows."""
    many = spark.range(60_000).selectExpr("id doc_id", "'the cat and the dog' text", "'en' lang")
    few = spark.range(60_000, 60_002).selectExpr("id doc_id", "'жук и кот' text", "'ru' lang")
    model = langid.train(many.unionByName(few))
    assert model.langs == ["en", "ru"]
    assert np.allclose(np.exp(model.prior), [60_000 / 60_002, 2 / 60_002])

def test_identity_swaps_move_no_score():
    """A group that is named mostly in toxic texts gets no weight of its own when its swap is penalised."""
    rows, swapped, y = [], [], []
    rng = np.random.default_rng(2)
    for k in range(800):
        toxic = k % 4 == 0
        words = {b"w%d" % rng.integers(0, 50) for _ in range(8)} | ({b"insult"} if toxic and rng.random() < 0.8 else set())
        words |= {b"muslims"} if rng.random() < (0.7 if toxic else 0.05) else set()
        named = words & toxicity.SWAP.keys()
        rows.append(toxicity.word_ids(words))
        swapped.append(toxicity.word_ids((words - named) | {toxicity.SWAP[w] for w in named}) if named else None)
        y.append(float(toxic))
    plain = toxicity.fit(rows, swapped, np.array(y), swap_penalty=0.0)
    fair = toxicity.fit(rows, swapped, np.array(y), swap_penalty=5.0)
    gap = lambda m: abs(m.score(b"muslims live here") - m.score(b"christians live here"))
    assert gap(fair) < 0.25 * gap(plain)
    assert fair.score(b"insult") > 0.5 > fair.score(b"muslims live here")


def ids_brute(text):
    """A text's words and their beginnings of 4 to 8 bytes, as (length or 0, bytes)."""
    words = {w.encode() for w in WORD.findall(low(text or ""))}
    return {(0, w) for w in words} | {(k, w[:k]) for w in words for k in range(4, 9) if len(w) > k}


def swap_brute(text):
    named = {w for w in WORD.findall(low(text or "")) if w.encode() in toxicity.SWAP}
    return " ".join(toxicity.SWAP[w.encode()].decode() if w in named else w for w in WORD.findall(low(text or ""))) if named else None


def fit_brute(rows, swapped, y, l2=3e-4, swap_penalty=1.0, rounds=300):
    """The same loss over dense tables: a row for each text, a column for each kept word; one row more for each swap."""
    share = y.mean()
    df, pos = Counter(x for r in rows for x in r), Counter(x for r, t in zip(rows, y) for x in r if t)
    identity = {x for w in toxicity.SWAP for x in ids_brute(w.decode())}
    far = lambda x: df[x] >= 5 and abs(pos[x] - df[x] * share) >= 3 * np.sqrt(df[x] * share * (1 - share) + 1e-9)
    kept = sorted(x for x in df if x in identity or far(x))
    table = np.array([[1.0, *(float(x in r) for x in kept)] for r in rows])
    moved = np.array([[0.0, *(float(x in r) - float(x in s) for x in kept)] for r, s in zip(rows, swapped) if s is not None]).reshape(-1, len(kept) + 1)
    w, m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    w[0] = np.log(share / (1 - share))
    for t in range(1, rounds + 1):
        g = table.T @ (1 / (1 + np.exp(-table @ w)) - y) / len(y)
        g[1:] += l2 * w[1:]
        if len(moved):
            g += 2 * swap_penalty / len(moved) * moved.T @ (moved @ w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return dict(zip(kept, w[1:])), w[0]


def test_toxicity_by_brute_force(spark, sf):
    """The query's rows from labelled texts by plain sets and dense tables: words, screen, swaps, penalty, score."""
    at = sf.replace("0.001", "0.01")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    marks = {(r.doc_id, r.toxic) for r in spark.read.parquet(f"{at}/labels.parquet").collect() if r.toxic in (0, 1)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = [(i, y) for i, y in sorted(marks) if i in docs and fold(i) != 0]
    swaps = [swap_brute(docs[i]) for i, _ in known]
    weights, bias = fit_brute([ids_brute(docs[i]) for i, _ in known], [None if s is None else ids_brute(s) for s in swaps], np.array([float(y) for _, y in known]))
    rows = queries.op8_toxicity(spark, at).collect()
    assert len(rows) == len(docs) == len({r.doc_id for r in rows}) and len(weights) > 5
    for r in rows:
        z = bias + sum(weights.get(x, 0.0) for x in ids_brute(docs[r.doc_id]))
        assert np.isclose(r.score, 1 / (1 + np.exp(-min(max(z, -30), 30))), atol=1e-4), r.doc_id
        assert r.held_out == (fold(r.doc_id) == 0) and r.predicted == (r.score >= 0.5)


def test_toxicity_on_odd_rows(odd, odd_rows, empty, labels):
    model = toxicity.train(odd, labels)
    found = toxicity.score_toxicity(odd, model).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.toxic_score <= 1 for r in found)
    for m in (model, toxicity.train(odd, labels.limit(0)), toxicity.train(empty, labels)):
        assert toxicity.score_toxicity(empty, m).count() == 0


def test_toxicity_held_out(spark, sf):
    at = sf.replace("0.001", "0.1")
    docs, marks = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    found = toxicity.score_toxicity(docs, toxicity.train(docs, marks, fold=(5, 0))).join(marks, "doc_id").toPandas()
    held = found[found["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)]
    said = held["toxic_score"] >= 0.5
    assert (said & (held["toxic"] == 1)).sum() / (held["toxic"] == 1).sum() > 0.85
    assert (said & (held["toxic"] == 0)).sum() / (held["toxic"] == 0).sum() < 0.02


# --- line rules ---------------------------------------------------------------------------------------------


def base_lines(text):
    words = BLANK.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    hit = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cé", "#|", "\n", " ", "  \n", " ", "\x1c", "\x85"])))
def test_base_line_counts(parts):
    text = " ".join(parts)
    assert line_rules.base_counts(text.encode()) == base_lines(text)


def test_viterbi_finds_the_best_path():
    import itertools

    rng = np.random.default_rng(4)
    for n in range(1, 9):
        model = line_rules.LineModel(np.zeros((line_rules.N_FEATURES, 2)), rng.normal(size=(2, 2)))
        scores = rng.normal(size=(n, 2))
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:]))
        assert tuple(model.decode(scores)) == max(itertools.product((0, 1), repeat=n), key=value)


def test_marginals_are_exact():
    import itertools

    rng = np.random.default_rng(6)
    node, moves = rng.normal(size=(1, 5, 2)), rng.normal(size=(2, 2))
    mask = np.array([[True] * 4 + [False]])
    node[0, 4] = 0
    got, pairs = line_rules._expected(node, moves, mask)
    paths = list(itertools.product((0, 1), repeat=4))
    w = np.array([np.exp(sum(node[0, i, x] for i, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
    w /= w.sum()
    for i in range(4):
        assert np.isclose(got[0, i, 1], sum(v for v, p in zip(w, paths) if p[i] == 1))
    assert np.isclose(pairs[0, 1], sum(v * sum((a, b) == (0, 1) for a, b in zip(p, p[1:])) for v, p in zip(w, paths)))


def test_line_rules_on_odd_rows(odd, odd_rows, empty):
    model = line_rules.train(odd)
    found = line_rules.apply_rules(odd.withColumnRenamed("source", "kept"), model).collect()
    want = Counter((i, *base_lines(t or "")) for i, t in odd_rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert len(r.line_marks) == sum(bool(BLANK.search(x)) for x in (r.text or "").split("\n"))
    assert line_rules.apply_rules(empty, model).count() == 0
    assert line_rules.apply_rules(empty, line_rules.train(empty)).count() == 0


def test_line_rules_query(spark, sf):
    """Base columns by brute force, verdicts from the marks that Viterbi's best path gives."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = line_rules.train(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = queries.op9_line_rules(spark, sf).collect()
    assert {r.doc_id for r in rows} == docs.keys()
    for r in rows:
        text = docs[r.doc_id] or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_lines(text)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        x, sizes, _ = line_rules.line_features(text.encode())
        paths = [((), 0.0)]
        for row in x @ model.weights:
            paths = [max((((*p, b), v + row[b] + (model.moves[p[-1], b] if p else 0.0)) for p, v in paths), key=lambda c: c[1]) for b in (0, 1)]
        marks = max(paths, key=lambda c: c[1])[0]
        content = sum(n for n, m in zip(sizes, marks) if m == line_rules.CONTENT)
        assert r.kept == (not failed and content >= 0.5 * r.n_words)
        assert r.base_failed == failed and not (failed and r.kept)


def test_boilerplate_lines_are_marked(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = line_rules.train(docs)
    body = """The harbour was quiet in the early morning, before the first boats came in.
Two men carried baskets along the pier and spoke about the price of salt.
Nobody had seen the old keeper since the storm broke his lamp last week.
A dog slept under an upturned hull, and gulls quarrelled over some bread.
Later that day children gathered near the well to hear how it had ended.
Their teacher told them only half, since rain began and lessons called.
By evening most windows glowed, while fog crept slowly over every roof."""
    menu = "\n".join("Home | About | Log in | Help | #tag | **" for _ in range(4))
    rows = {r.doc_id: r for r in line_rules.apply_rules(make(spark, [(1, body), (2, body + "\n" + menu), (3, menu * 3)]), model).collect()}
    assert set(rows[1].line_marks) == {"C"} and rows[1].kept
    assert rows[2].line_marks.endswith("BBBB") and rows[2].line_marks.startswith("CCCCCC") and rows[2].content_share < 1
    assert not rows[3].kept and rows[3].content_share < 0.5


@pytest.mark.parametrize("most", [400, 10_000])
def test_bounded_sample(spark, most):
    """Chosen by the keys alone: any layout gives the same rows."""
    from tidegrid.llm.common import bounded_sample

    rows = spark.range(2_000).selectExpr("id doc_id", "id % 7 x")
    got = [sorted(tuple(r) for r in bounded_sample(rows.repartition(n).orderBy(o), ["doc_id"], most).collect()) for n, o in ((3, "x"), (7, "doc_id"), (1, "x"))]
    assert got[0] == got[1] == got[2]
    assert (len(got[0]) == 2_000) if most > 2_000 else abs(len(got[0]) - most) < 5 * most**0.5


@pytest.fixture(scope="module")
def layouts(spark, sf):
    """The same documents and labels, some ids repeated with other texts, in three layouts."""
    at = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    docs = docs.unionByName(docs.filter("doc_id < 40").withColumn("text", docs.text.substr(1, 50))).unionByName(docs.filter("doc_id < 300"))
    return [(docs.repartition(n, c), labels.repartition(m)) for n, c, m in ((3, "text", 7), (7, "lang", 2), (1, "doc_id", 1))]


def test_models_do_not_hang_on_the_layout(layouts):
    ranks = [quality_rank.train(d, m, most_rows=300, fold=(4, 2)) for d, m in layouts]
    assert all((r.weights == ranks[0].weights).all() and r.cut == ranks[0].cut for r in ranks) and ranks[0].weights.any()
    toxic = [toxicity.train(d, m, most_rows=300) for d, m in layouts]
    assert all(m.weights == toxic[0].weights and m.bias == toxic[0].bias for m in toxic) and toxic[0].weights
    lines = [line_rules.train(d, most_rows=200) for d, _ in layouts]
    assert all((m.weights == lines[0].weights).all() and (m.moves == lines[0].moves).all() for m in lines)
    langs = [langid.train(d) for d, _ in layouts]
    assert all(m.langs == langs[0].langs and (m.log_prob == langs[0].log_prob).all() for m in langs)
