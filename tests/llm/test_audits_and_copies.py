"""Exact copies, token alignment and filter audits against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from millrace.llm import filter_audit, radix_dedup, registry, token_alignment
from millrace.llm.radix_dedup import exact_duplicates
from millrace.llm.token_alignment import align_tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, Text string, digit string, name long, row long, pairs string"
LONG = "lorem ipsum dolor " * 40_000
ODD = ["<|endoftext|> and </s> stay text", "mark ▁ of pieces", "tab\there \x0b\x0c\r\n\n end  ", "\x00 nul", "emoji 😀 \U0001f9ff ॐ ٣ ½", "no break　wide \x1c\x85", " lead", "trail ", "   ", "\n", "don't we'll I'S", "x" * 3000, "漢字かな한글", "don't" + "." * 50]


def rows(texts):
    return [(k, t, "en", "x", "y", 0, 0, "z") for k, t in texts]


# --- exact copies


def copies(texts):
    """keep, size and whether kept, by position."""
    groups = collections.defaultdict(list)
    for k, (d, t) in enumerate(texts):
        groups[re.sub("[ \t-\r]+", " ", t or "")].append((d is None, d or 0, k))
    out = {}
    for t, members in groups.items():
        first = min(members)
        for m in members:
            out[m[2]] = (texts[first[2]][0], len(members), m == first, hashlib.sha256(t.encode()).hexdigest())
    return out


def test_copies_by_bytes(spark):
    """Texts that part at every possible place: first byte, a digit's border, the last byte, the length alone."""
    rng = random.Random(3)
    base = "".join(rng.choice("ab ") for _ in range(5000))
    texts = [base, base, base[:-1], base[:-1] + "é", base[:64] + "#" + base[65:], base[:63] + "#" + base[64:], base[:1088] + "#" + base[1089:], base[:1087] + "#" + base[1088:], "#" + base[1:], base + " ", base + "  "]
    texts += [t for t in texts[:6]] + ["", None, " ", "\n\t", "a", "a"] + [LONG, LONG + "x", LONG.replace(" ", "\n"), LONG[:-2] + "#r"]
    texts += ["the hot one"] * 300
    ids = [rng.choice([None, 5, 5, k, 1000 - k]) for k in range(len(texts))]
    docs = list(zip(ids, texts))
    got = exact_duplicates(spark.createDataFrame([(d, t, "en", "x", "y", 0, 0, "z") for d, t in docs], SCHEMA).repartition(7)).collect()
    want = copies(docs)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == collections.Counter((docs[k][0], *w) for k, w in want.items())


def test_copies_of_an_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert exact_duplicates(spark.createDataFrame([("a", "x y"), ("b", "x  y")], "doc_id string, text string"), white=False).where("kept").count() == 2


# --- alignment


def links(a, b):
    """Overlapping pairs and groups of two lists of (id, bytes), by walking over bytes."""
    ends = lambda side: list(itertools.accumulate(len(x) for _, x in side))
    ea, eb = ends(a), ends(b)
    both = sorted(set(ea) & set(eb))
    found = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - len(a[i][1]), eb[j] - len(b[j][1])) < min(ea[i], eb[j])]
    groups, start = [], 0
    for end in both:
        inside = lambda side, e: ",".join(str(side[k][0]) for k in range(len(side)) if start < e[k] <= end)
        groups.append(f"{inside(a, ea)}|{inside(b, eb)}")
        start = end
    return [(a[i][0], b[j][0]) for i, j in found], groups


def brute(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {c: b for b, c in bytes_to_chars().items()}
    raw_a = lambda i: bytes(byte_of[c] for c in t.id_to_token(i)) if t.id_to_token(i) != "<|endoftext|>" else b""
    raw_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, df = [], collections.Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = [(i, raw_a(i)) for i in t.encode(whole.decode(), add_special_tokens=False).ids] if text else []
        b = [(i, raw_b(i)) for i in sp.encode(text)] if text else []
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        pairs, groups = links(a, b)
        df.update(set(pairs))
        docs.append((len(a), len(b), groups, pairs))
    most = collections.defaultdict(int)
    for (i, _), n in df.items():
        most[i] = max(most[i], n)
    return [(na, nb, len(g), len(p), sum(df[x] == most[x[0]] for x in p), sum(df[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, p in docs], df, most


def bytes_to_chars():
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@pytest.mark.parametrize("hot", [1e-4, 0.01, 2.0])
def test_alignment(spark, monkeypatch, hot):
    monkeypatch.setattr(token_alignment, "HOT_SHARE", hot)
    monkeypatch.setattr(token_alignment, "BUCKET", 700)
    monkeypatch.setattr(token_alignment, "PACKET", 4000)
    monkeypatch.setattr(token_alignment, "PART", 900)
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' where length(text) < 1500 order by doc_id").fetchall()][:100]
    texts += [*ODD, None, "", "twice", "twice"]
    want, df, most = brute(texts)
    docs, pairs = align_tokens(spark.createDataFrame(rows(list(enumerate(texts))), SCHEMA).repartition(5))
    got = {r[0]: tuple(r)[1:] for r in docs.collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert {(r.a_id, r.b_id): (r.documents, r.best) for r in pairs.collect()} == {p: (n, most[p[0]] == n) for p, n in df.items()}


def test_encoders_equal_the_libraries():
    own = token_alignment.pair_of(token_alignment.BYTE_VOCABULARY, token_alignment.BYTE_RANKS, token_alignment.VOCABULARY)
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    letters = "abcXYZ 123 \n\n \t\r\x0b\x1c\xa0　é漢😀\U0001f9ff▁\x00'.,-ॐ½"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 50))) for _ in range(1500)]
    texts += [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall() if r[0]]
    for k in range(0, len(texts), 40):
        some = texts[k : k + 40]
        a, b = own.encode(some)
        assert a.to_pylist() == [e.ids for e in own.library.encode_batch([" " + t for t in some], add_special_tokens=False)]
        assert b.to_pylist() == sp.encode(some)


def test_alignment_edges(spark):
    long = "word " * 60_000
    docs = spark.createDataFrame(rows([(1, long), (1, long), (None, "a"), (None, None)]), SCHEMA)
    got = sorted(map(tuple, align_tokens(docs)[0].collect()), key=str)
    by = collections.Counter(r[0] for r in got)
    assert by == {1: 2, None: 2}
    sizes = {r[1:5] for r in got if r[0] == 1}
    assert len(sizes) == 1 and min(next(iter(sizes))) >= 60_000
    none, pairs = align_tokens(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and pairs.count() == 0


# --- audit


def audit(docs, labels):
    """Plain simulation: every order is run, filter after filter, over the documents left."""
    texts = collections.defaultdict(list)
    for d, t, _ in docs:
        if d is not None:
            texts[t or ""].append(d)
    fails, parts = [], collections.defaultdict(list)
    for k, (d, t, lang) in enumerate(docs):
        t = t or ""
        words = [w for w in re.split("[ \t-\r]+", t) if w]
        own = set()
        own |= {"A"} if len(words) < 100 else set()
        own |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        own |= {"D"} if re.search("[#$%&*|]", t) else set()
        own |= {"E"} if d is not None and min(texts[t]) < d else set()
        fails.append(own)
        parts[lang or ""].append(k)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for part, members in parts.items():
        worth = collections.Counter()
        found = {}
        for order in itertools.permutations("ABCDE"):
            left = list(members)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                worth[f] += len(gone)
                redundant = sum(f in fails[k] for k in members) - len(gone)
                found["".join(order), step] = [len(left), len(gone), redundant, sum(fails[k] == {f} for k in members), sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone)]
        for (order, step), v in found.items():
            out[part, order, step] = (*v, worth[order[step - 1]])
    return out


def test_audit(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(200)] + ["UPPER", "Mixed", "a|b", "c#", "é"]
    docs = [(None, "", None), (None, None, "en"), (3, None, "de"), (2, "", None), (4, LONG, "en"), (4, LONG, "en"), (9, LONG, "de")]
    for k in range(300):
        words = rng.choices(vocabulary[: rng.choice([20, 200, 205])], k=rng.randrange(0, 200))
        docs.append((rng.choice([k, 17, None]), " ".join(words), rng.choice(["en", "de", None, "", "xx"])))
    docs += [(1000 + k, rng.choice(docs)[1], rng.choice(["en", "fr"])) for k in range(200)]
    labels = [(rng.choice([None, *range(300)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(250)]
    df = spark.createDataFrame([(d, t, lang, "x", "y", 0, 0, "z") for d, t, lang in docs], SCHEMA).repartition(5)
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in filter_audit.audit_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == audit(docs, labels)


def test_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(spark.createDataFrame([], SCHEMA), labels).count() == 0
    one = filter_audit.audit_filters(spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string"), labels.limit(0))
    assert one.count() == 600 and one.where("good_lost + toxic_lost > 0").count() == 0


def test_min_plus_steps():
    masks = np.where(np.array([[1, 0, 1], [0, 0, 0]]) > 0, 0.0, np.inf)
    assert filter_audit.removal_steps(masks, np.array([[3, 1, 2], [1, 2, 3]])).tolist() == [[2.0, 1.0], [np.inf, np.inf]]


def test_queries_are_registered():
    assert {"op11_exact_dedup", "op12_token_alignment", "op13_filter_audit"} <= registry.QUERIES.keys()
    assert {"op11_exact_dedup", "op13_filter_audit"} <= registry.ORACLE_SQL.keys()
    assert radix_dedup.FIRST * radix_dedup.GROWTH <= radix_dedup.MOST
