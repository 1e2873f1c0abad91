"""Each stage of the pipeline on its own input against brute force, on a whole small table."""

import collections
import re

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import quality, secrets, sentence_pieces
from millrace.llm.common import read, stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage."""
    docs, out = read(spark, SF, "documents"), {}
    for name, f in corpus_pipeline.STAGES:
        before = docs
        docs = stage(f(spark, docs, SF), name)
        out[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()}, docs.columns)
    return out


def test_columns_stay(stages):
    names = duckdb.sql(f"select * from '{SF}/documents.parquet' limit 0").columns
    for name, (_, _, columns) in list(stages.items())[:-1]:
        assert columns == names, name
    for name, (before, after, _) in list(stages.items())[:3]:
        assert all(before[d] == r for d, r in after.items()), name


def test_quality(stages):
    before, after, _ = stages["quality"]
    rows = list(before.values())
    judged = quality.judge(quality.VOCABULARY, quality.BANDS)([r.text for r in rows], [r.lang for r in rows])
    assert after.keys() == {r.doc_id for r, j in zip(rows, judged) if j[6]}
    assert len(after) > 0.8 * len(before)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup(stages):
    """One row, of the least id, of each group that similarities of 0.8 or more connect."""
    before, after, _ = stages["near_dedup"]
    ids = sorted(before)
    sets = {d: shingles(before[d].text) for d in ids}
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert after.keys() == {find(d) for d in ids}


def test_decontamination(stages):
    before, after, _ = stages["decontamination"]
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall():
        w = words(t)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[size].add(tuple(w[i : i + size]))
    clean = set()
    for d, r in before.items():
        w = words(r.text)
        hit = {i + k for size, found in windows.items() for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in found for k in range(size)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(d)
    assert after.keys() == clean


def test_secret_scans(spark):
    """The text outside of marks is as it was, base secrets are gone, and n_chars tells the new length. On a larger table, as the small one has no secrets left."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    before, after = ({r.doc_id: r for r in df.collect()} for df in (docs, corpus_pipeline.secret_scans(spark, docs, "")))
    assert after.keys() == before.keys()
    changed = 0
    for d, r in after.items():
        old = before[d].text
        assert r.n_chars == len(r.text)
        assert not [x for x in secrets.find(r.text) if x[0] < 3]
        pieces = r.text.split("<SECRET>")
        changed += len(pieces) > 1
        assert re.fullmatch(".+?".join(map(re.escape, pieces)), old, re.S)
        if not [x for x in secrets.find(old)]:
            assert r.text == old
    assert changed


def test_pieces(stages):
    before, after, columns = stages["pieces"]
    own = sentence_pieces.codec()
    assert {"doc_id", "lang", "source", "ids"} <= set(columns) and after.keys() == before.keys()
    for d, r in after.items():
        assert own.decode(r.ids) == before[d].text and r.n_pieces == len(r.ids)
