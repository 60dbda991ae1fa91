"""Each stage of the pipeline on its own input, against brute force."""

import hashlib

import pytest
from test_operators import LOWER, brute_components

import corpus_pipeline
from helixspark.llm import mixing, toxicity
from helixspark.session import table


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, found = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        found.append((docs, out))
        docs = out
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], found, strict=True))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_columns(stages):
    for name in ("toxicity", "exact_dedup", "near_dedup", "mixing"):
        assert [c for c, _ in stages[name][1].dtypes] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity(spark):
    """Over a folder with enough labels to learn from."""
    d = "/root/testdata/sf0.01"
    before = table(spark, d, "documents")
    bad = {r.doc_id for r in toxicity.toxicity(before, table(spark, d, "labels")).collect() if r.predicted}
    after = corpus_pipeline.remove_toxic(spark, before, d)
    assert bad and rows(after) == [r for r in rows(before) if r[0] not in bad]


def test_exact(stages):
    before, after = stages["exact_dedup"]
    last = {}
    for r in rows(before):
        last[r[1].translate(LOWER)] = r
    assert rows(after) == sorted(last.values())


def test_near(stages):
    before, after = stages["near_dedup"]
    found = brute_components({r[0]: r[1] for r in rows(before)}, 5)
    assert rows(after) == [r for r in rows(before) if found[r[0]][1] == r[0]]


def test_mixing(stages):
    before, after = stages["mixing"]
    kept = {r.doc_id for r in mixing.mix(before, alpha=0.9, least=0.9).collect() if r.kept}
    assert kept and rows(after) == [r for r in rows(before) if r[0] in kept]


def test_tokens(stages):
    before, after = stages["tokens"]
    assert {r.doc_id: r.decoded_sha256 for r in after.collect()} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect()}


def test_run(spark, sf, stages):
    assert rows(corpus_pipeline.run(spark, sf)) == rows(stages["tokens"][1])
