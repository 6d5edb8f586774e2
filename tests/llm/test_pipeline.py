"""The pipeline's stages against brute-force versions."""

import numpy as np
import pytest

import corpus_pipeline
from tidegrid.llm import line_rules, quality_rank

from .conftest import make
from .test_joins import TOKENIZER, check_packing, components_brute, contaminated_brute, fingerprint_brute
from .test_near_sets import kept_brute


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, out[-1], sf)
        if name != "best-fit packing":
            assert found.schema == docs.schema
        out.append(corpus_pipeline.staged(found, "test"))
    return [d.collect() for d in out]


def test_stages_are_these():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near duplicates", "benchmark decontamination", "best-fit packing"]


def test_quality_stage(spark, sf, steps):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rank.train(docs, labels)
    score = lambda t: model.score(np.array([quality_rank.features((t or "").encode())]))[0]
    assert {r.doc_id for r in steps[1]} == {r.doc_id for r in steps[0] if score(r.text) >= quality_rank.CUT}
    bad = {r.doc_id for r in labels.collect() if r.quality == 0}
    assert len(bad & {r.doc_id for r in steps[1]}) <= 0.1 * len(bad)


def test_rules_stage(steps):
    kept = {r.doc_id for r in steps[2]}
    for r in steps[1]:
        n, _, _, _, repeats = line_rules.base_counts(r.text.encode())
        if n < 50 or 100 * repeats > 50 * n:
            assert r.doc_id not in kept
    assert kept <= {r.doc_id for r in steps[1]}


def test_near_duplicate_stage(steps):
    want = kept_brute([(r.doc_id, r.text) for r in steps[2]])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in steps[3]) == want


def test_decontamination_stage(spark, sf, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = contaminated_brute([(r.doc_id, r.text) for r in steps[3]], items)
    assert sorted(r.doc_id for r in steps[4]) == sorted(x[0] for x in found if not x[-1])


def test_packing_stage(steps):
    from tokenizers import Tokenizer

    check_packing(steps[5], [(r.doc_id, r.text) for r in steps[4]], Tokenizer.from_file(TOKENIZER), 2048)


def test_only_the_result_stays(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr("tidegrid.llm.common.shared_dir", lambda spark: str(tmp_path))
    rows = corpus_pipeline.run(spark, sf)
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["tidegrid-best-fit-packing"]
    assert rows.count() > 0


def test_odd_tables(spark, tmp_path, odd, empty, labels):
    """Nulls, empty texts, repeated rows, and no rows at all, through every stage."""
    for k, docs in enumerate((odd, empty)):
        at = str(tmp_path / f"t{k}")
        docs.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "the of alpha")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, at).collect()
        assert (k == 0) or not rows


def test_repeated_and_nameless_rows(spark, sf):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text + " and an entirely different end of it, with many more words " * 3), (3, text.upper())]
    docs = make(spark, rows)
    kept = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    root = components_brute([fingerprint_brute(t) for _, t in rows])
    assert len(kept) == len(set(root))
    assert sorted((r.doc_id for r in kept), key=lambda i: (i is None, i)) == [1, None]


def test_extra_columns_pass_through(spark, sf):
    """Columns named like a stage's own ones keep their values."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'a' quality_score", "'b' kept", "'c' n_words", "'d' k1", "'e' fp", "'f' component_id", "'g' _k1", "'h' _k2", "'i' _found")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    rows = docs.distinct().collect()
    assert rows and {(r.quality_score, r.kept, r.n_words, r.k1, r.fp, r.component_id, r["_k1"], r["_k2"], r["_found"]) for r in rows} == {tuple("abcdefghi")}
