"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest

import corpus_pipeline
from millrace.llm.common import stage
from millrace.llm.decontaminate import decontaminate, drop_contaminated
from millrace.llm.html_text import extract_text
from millrace.llm.licenses import scan_licenses
from millrace.llm.pitman_yor import score_documents
from millrace.llm.quality import keep_good, quality_rules
from millrace.llm.secrets import redact, scan_secrets
from millrace.llm.sentence_pieces import decode_pieces, digest_pieces, encode_pieces
from millrace.llm.simhash_dedup import keep_one, near_duplicates
from millrace.llm.token_count import count_tokens
from millrace.llm.url_filters import filter_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, fp string, words string, spans string, first string, _0 string"
LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, "plain words stand here and say little", "en", "a"),
    (1, "plain words stand here and say little", "en", "a"),
    (2, None, None, None),
    (None, "a row without an id " * 8, "xx", "b"),
    (3, "", "en", "a"),
    (4, " \n\t ", "en", None),
    (5, LONG, "en", "a"),
    (6, "x" * 30_000, "de", "a"),
    (None, None, None, None),
    (7, "token = \"abcdef0123456789\" mit license 😀 é\x00", "en", "c"),
]
EXTRA = ("h", "f", "w", "s", "1", "0")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "say little"), (2, None), (None, "mit license"), (3, "")], "item_id long, text string")


BY_ROW = [count_tokens, quality_rules, digest_pieces, scan_secrets, scan_licenses, score_documents, near_duplicates, lambda d: extract_text(d, "text", ("doc_id",)), encode_pieces, lambda d: decode_pieces(encode_pieces(d))]


@pytest.mark.parametrize("operator", BY_ROW)
def test_a_row_for_each_row(docs, empty, operator):
    ids = sorted((r[0] is None, r[0]) for r in operator(docs).collect())
    assert ids == sorted((r[0] is None, r[0]) for r in ROWS)
    assert operator(empty).count() == 0


def test_decontaminate_rows(docs, empty, bench):
    got = decontaminate(docs, bench).collect()
    assert len(got) == len(ROWS)
    assert {(r.doc_id, r.n_hit, r.n_items) for r in got if r.n_hit} == {(1, 2, 1), (7, 2, 1)}
    assert [r.item_ids for r in got if r.doc_id == 7] == [["null"]]
    assert decontaminate(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate(docs, bench.limit(0)).collect()} == {0}
    assert [r for r in decontaminate(docs, bench, max_set=0).collect() if r.n_hit] != []
    assert drop_contaminated(docs, bench).count() == len(ROWS) - 3


def test_urls(spark, docs):
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/x?q"), (1, "http://A.Example.com/en/x?q"), (2, None), (None, "no scheme"), (3, "x://h"), (4, "http://www.example.com/en/")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, labels).collect()}
    assert got == {
        (1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "", "", None, "allow"), (None, "", "", None, "allow"),
        (3, "h", "", None, "allow"), (4, "www.example.com", "/en/", "www.example.com/en/", "allow"),
    }
    assert filter_urls(pages, labels).count() == 6
    assert filter_urls(pages.limit(0), labels).count() == 0
    assert filter_urls(pages, labels.limit(0)).count() == 6


def test_urls_beside_other_columns(spark):
    """Columns of pages and labels that are named like the operator's own do no harm, and suffixes of two labels share nothing."""
    from millrace.llm.url_filters import levels

    pages = spark.createDataFrame([(1, "http://a.b.co.uk/x", 7, 8, "p"), (2, "http://c.com/", 7, 8, "q")], "page_id long, url string, bad int, n int, host string")
    labels = spark.createDataFrame([(1, 0, 0, "r", 5)], "doc_id long, quality int, toxic int, host string, page_id int")
    assert {(r.page_id, r.host, r.n_labelled) for r in filter_urls(pages, labels).collect()} == {(1, "a.b.co.uk", 1), (2, "c.com", 0)}
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("co.uk",), ("z",)], "host string")
    assert [(r.suffix, r.domain) for r in levels(hosts).collect()] == [("co.uk", "b.co.uk"), ("com", "y.com"), ("co.uk", "co.uk"), ("z", "z")]


def test_filters_keep_columns(docs, empty):
    for f in (keep_good, keep_one, redact):
        got = f(docs)
        assert got.columns == docs.columns and f(empty).count() == 0
    assert {r.doc_id for r in keep_one(docs).collect()} >= {1, 2, 5, 6}
    assert [r.text for r in redact(docs).collect() if r.doc_id == 7] == ["<SECRET>\" mit license 😀 é\x00"]
    assert redact(docs).count() == len(ROWS)


def test_pipeline_stages(spark, docs, empty, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for at in (docs, empty):
        for k, (name, f) in enumerate(corpus_pipeline.STAGES):
            at = stage(f(spark, at, str(tmp_path)), name)
            assert k == 4 or at.columns == docs.columns
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(ROWS)
