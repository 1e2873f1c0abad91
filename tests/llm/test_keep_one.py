"""Which rows the pipeline's near-duplicate stage keeps."""

import random

from millrace.llm.simhash_dedup import keep_one

SCHEMA = "doc_id long, text string, hash string"


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_unrelated_texts_without_an_id_or_under_one_id_stay(spark):
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(2)), (7, prose(3)), (7, prose(4)), (7, prose(4)), (9, prose(1)), (None, None), (None, " ")]
    kept = keep_one(spark.createDataFrame([(*r, "h") for r in rows], SCHEMA))
    got = sorted(((r.doc_id or 0, (r.text or "").strip()) for r in kept.collect()))
    assert got == sorted([(9, prose(1)), (0, prose(2)), (7, prose(3)), (7, prose(4)), (0, "")])
    assert kept.columns == ["doc_id", "text", "hash"]


def test_copies_of_which_a_tenth_differs(spark):
    """Pairs of Jaccard similarity 0.80 to 0.85 are found, and pairs of 0.6 stay; a large group of copies is one."""
    rows, rng = [], random.Random(5)
    for i in range(40):
        words = prose(100 + i, 300).split()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:280] + prose(900 + i, 10).split()) if i % 2 else " ".join(words[:240] + prose(900 + i, 60).split()))]
    base = prose(1, 300).split()
    for i in range(60):
        at = rng.randrange(300)
        rows.append((1000 + i, " ".join([*base[:at], f"x{i}", *base[at + 1 :]])))
    kept = {r.doc_id for r in keep_one(spark.createDataFrame([(*r, "h") for r in rows], SCHEMA)).collect()}
    assert kept == {2 * i for i in range(40)} | {2 * i + 1 for i in range(0, 40, 2)} | {1000}
