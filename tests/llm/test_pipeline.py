"""The corpus pipeline: each stage against what it should do to its own input."""

import re

import corpus_pipeline
import pytest

from tidewater.llm import fm, minhash, secrets, substrings

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    out = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(root / f"{i}-{name}")
        stage(spark, out[-1], SMOKE).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_names(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "near_dedup", "substring_dedup", "secret_scan", "packing"]
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_classifier_drops_what_it_rejects(spark, steps):
    labels = spark.read.parquet(f"{SMOKE}/labels.parquet")
    scores = fm.score(steps[0], fm.fit(steps[0], labels)).collect()
    assert set(rows(steps[1])) == {r.doc_id for r in scores if r.predicted == 1}


def test_classifier_without_usable_labels_drops_nothing(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    labels = spark.read.parquet(f"{SMOKE}/labels.parquet").limit(0)
    assert set(rows(fm.reject_low_quality(docs, labels))) == set(rows(docs))


def test_one_document_of_each_group_stays(steps):
    found = minhash.near_duplicates(steps[1]).collect()
    assert set(rows(steps[2])) == {r.component_id for r in found}


def test_spans_are_cut(steps):
    before, after = rows(steps[2]), rows(steps[3])
    assert set(before) == set(after)
    for r in substrings.repeated_words(steps[2]).collect():
        if r.n_removed == 0:
            assert after[r.doc_id].text == before[r.doc_id].text
        else:
            assert len(after[r.doc_id].text.split()) == r.n_words - r.n_removed
            assert after[r.doc_id].n_chars == len(after[r.doc_id].text)


def test_secrets_are_masked(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    for k, r in after.items():
        assert not re.search(r"AKIA[A-Z0-9]{14,}", r.text)
        if r.text != before[k].text:
            assert secrets.MASK in r.text and r.n_chars == len(r.text)


def test_packing_covers_all(steps):
    pieces = steps[5].collect()
    size, got = {r.doc_id: r.doc_tokens for r in pieces}, {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert set(got) == set(rows(steps[4])) and got == size


def test_run_equals_the_stages(spark, steps):
    cols = ["doc_id", "start", "length", "ids_crc32"]
    whole = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    out = corpus_pipeline.run(spark, SMOKE)
    assert set(cols) <= set(out.columns) and whole(out) == whole(steps[5])
