"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from helixspark.llm import bpe, exact_dedup, mixing, near_dedup, pii, quality_lm, quality_rules, toxicity, url_filter, warc
from helixspark.session import scratch

EXTRA = "kept boolean, digest string, `row` long, label string, cluster long, n long, host string, draw double, id string, weight double, words array<string>, toxic int, quality int, `meta.url` string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
MORE = (True, "d", 7, "l", 3, 9, "h", 0.5, "i", 1.0, ["w"], 1, 1, "u")


@pytest.fixture(scope="module")
def docs(spark):
    long = "word " * 30_000
    texts = [
        (1, "Hello there you all"), (2, "hello THERE you all"), (2, "hello THERE you all"), (3, None), (4, ""), (5, "   \n\t "), (6, long), (7, long + "tail"), (8, "x" * 300_000),
        (9, "1" * 100_000), (10, "ÄÖÜ ß é 日本語 🙂"), (None, "no id"), (None, None), (11, "a@b.co +1 (569) 555-8554 1.2.3.4"), (12, "hello there you all"), (13, "$ # !!"),
    ]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None if i in (5, 6) else "s", None, *MORE) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (6, None, None), (None, 1, 1), (99, 1, 1), (11, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact_groups": lambda d, s: exact_dedup.exact_groups(d),
    "near_groups": lambda d, s: near_dedup.near_groups(d, size=2),
    "mix": lambda d, s: mixing.mix(d),
    "toxicity": toxicity.toxicity,
    "find_spans": lambda d, s: pii.digests(pii.find_spans(d)),
    "round_trip": lambda d, s: bpe.round_trip(d),
    "tokenized": lambda d, s: bpe.tokenized(d),
    "quality": quality_lm.quality,
    "quality_rules": lambda d, s: quality_rules.quality_rules(d),
}
KEEPERS = {
    "drop_exact_copies": lambda d, s: exact_dedup.drop_exact_copies(d),
    "drop_near_copies": lambda d, s: near_dedup.drop_near_copies(d),
    "draw_mix": lambda d, s: mixing.draw_mix(d),
    "drop_toxic": toxicity.drop_toxic,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row_per_document(docs, labels, name):
    found = OPERATORS[name](docs, labels).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", [*OPERATORS, *KEEPERS])
def test_empty_tables(spark, docs, labels, name):
    empty, none = docs.where(F.lit(False)), labels.where(F.lit(False))
    assert {**OPERATORS, **KEEPERS}[name](empty, none).collect() == []


@pytest.mark.parametrize("name", list(KEEPERS))
def test_columns_stay(docs, labels, name):
    found = KEEPERS[name](docs, labels)
    assert found.dtypes == docs.dtypes
    assert {str(r.doc_id) for r in found.collect()} <= {str(r.doc_id) for r in docs.collect()}


def test_exact_ties(docs):
    found = exact_dedup.exact_groups(docs, tracked=64, max_heavy=2).collect()
    same = [r for r in found if r.group_size == 4]
    assert {(r.keep_id, r.doc_id) for r in same} == {(12, 1), (12, 2), (12, 12)} and sum(r.kept for r in same) == 1
    empty = [r for r in found if r.doc_id in (3, 4) or r.doc_id is None and r.group_size == 3]
    assert len(empty) == 3 and [r.doc_id for r in empty if r.kept] == [4]
    for limits in ((2, 64), (1, 64), (1000, 1024)):  # wherever the split falls
        kept = exact_dedup.drop_exact_copies(docs, max_heavy=limits[0], tracked=limits[1]).collect()
        assert sorted(str(r.doc_id) for r in kept) == sorted(["12", "4", "5", "6", "7", "8", "9", "10", "None", "11", "13"])


def test_toxicity_without_labels(docs, labels):
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where(F.lit(False))).collect()} == {0}


PAGES = "page_id long, url string, html string, host string, path string, `digest` string, verdict string"


def test_pages(spark):
    rows = [(1, None, None), (2, "", "<p>"), (3, "http://A.ORG?x", "<p>"), (4, "x://h.com/de/1#f", "é" * 50_000), (None, "http://b.com/fr/", "<p>"), (5, "no scheme", "WARC/1.1\r\n\r\n"), (6, "a://b://c/d", ""), (6, "a://b://c/d", "")]
    pages = spark.createDataFrame([(*r, "h", "p", "d", "v") for r in rows], PAGES)
    for feed in (url_filter.stand_in_feed(pages), spark.createDataFrame([("c",), (None,)], "key string"), spark.createDataFrame([], "key string")):
        found = {r.page_id: r for r in url_filter.judge_urls(pages, feed).collect()}
        assert [(found[i].host, found[i].path, found[i].rule, found[i].verdict) for i in (1, 4)] == [("", "", None, "allow"), ("h.com", "/de/1", "com/de/", "block")]
        assert (found[3].host, found[3].path, found[3].rule, found[5].verdict) == ("a.org", "", None, "allow")
    got = sorted(warc.write_and_read(pages, scratch(spark, "w")).collect(), key=lambda r: str(r.page_id))
    assert len(got) == 8 and [(r.record_type, r.refers_to) for r in got if r.page_id == 6] == [("response", None)] * 2  # each repeated row has its record
    by = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in got}
    assert by[1] == (0, "revisit", 6) and by[6] == (0, "response", None) and by[None] == (3, "revisit", 3) and by[4] == (100_000, "response", None)
    empty = pages.where(F.lit(False))
    assert url_filter.judge_urls(empty, url_filter.stand_in_feed(empty)).collect() == []
    assert warc.write_and_read(empty, scratch(spark, "w")).collect() == []
