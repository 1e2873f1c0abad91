"""Each operator against brute force, a library, an exact round trip, or held-out data, on whole small tables."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from millrace.llm import decontaminate, html_text, licenses, pitman_yor, quality, registry, secrets, sentence_pieces, simhash_dedup, token_count
from millrace.llm.common import encoded

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def by_id(df):
    return {r[0]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=str)
    df = registry.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want


def test_lm_scores(spark, texts):
    got = by_id(registry.QUERIES["op1_lm_scoring"](spark, SF))
    words = {d: t.encode().lower().split() + [b""] for d, t in texts.items()}
    c = collections.Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in words.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 7 == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_ids_of_text(spark):
    """Ids that are no numbers are held out by their text, and come back as they are."""
    rows = [(f"doc-{i}", f"a text of word{i} and more") for i in range(20)]
    got = pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    assert all(r.held_out == (zlib.crc32(r.doc_id.encode()) % 7 == 2) for r in got)
    assert sum(r.held_out for r in got) == sum(zlib.crc32(d.encode()) % 7 == 2 for d, _ in rows)


def test_lm_sums_in_rounds(spark, texts, monkeypatch):
    """Sizes are the same however many rows are summed at a time, and so are all scores."""
    docs = spark.createDataFrame(list(texts.items())[:60], "doc_id long, text string").coalesce(2)
    score = lambda: sorted(map(tuple, pitman_yor.score_documents(docs, block_bytes=20_000, bucket_bytes=8_000).collect()))
    whole = score()
    monkeypatch.setattr(pitman_yor, "SUMMED_AT_ONCE", 3)
    assert score() == whole and len(whole) == 60


def test_lm_groups_by_share():
    plan = pitman_yor.Plan(5000, 3, hot=(b"a", b"b"), shares=(0.05, 0.0003))
    assert plan.groups == {b"a": 1024, b"b": 24} and len({plan.bucket(b"a", g) for g in range(1024)}) == 1024
    assert pitman_yor.Plan(1, 3, hot=(b"a",), shares=(0.5,)).groups == {b"a": 1}


def small_model(plan):
    rng = random.Random(3)
    vocabulary = [f"w{i}".encode() for i in range(40)]
    rows = []
    for number in range(2):
        block = pitman_yor.Block(number)
        for d in range(60):
            block.add(d, " ".join(rng.choice(vocabulary[: 1 + d]).decode() if d else "" for _ in range(30)))
        block.held = [d % 5 == 0 for d in range(60)]
        block.close(plan)
        rows += block.packets()
    names = [x.split()[0] for x in pitman_yor.WORDS.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    buckets, words = [], []
    for k, part in frame.groupby("bucket"):
        buckets.append(pitman_yor.Bucket(pitman_yor.merge_with(plan)((k,), part).iloc[0].to_dict(), plan.bits))
        words.append(list(dict.fromkeys(w for x in part.sort_values("block")["words"] for w in x.split(b"\n"))))
    edges = pitman_yor.range_edges(plan.bits)

    def total(batches):
        value, customers = np.zeros(int(edges[-1])), np.zeros(int(edges[-1]))
        for r in (r for b in batches for r in b.to_pylist()):
            value[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["value"])
            customers[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["customers"])
        n = pitman_yor.SINGLES
        return value[:-n], customers[:-n], value[-n:]

    openings = []
    for b in buckets:
        pairs, families, own = b.opening()
        at_word = np.bincount(b.family_word, weights=families, minlength=b.n)
        openings.append(pitman_yor.sized(b, plan.bits, pairs, families, at_word, own, [float(b.total.sum()), float((b.total[b.whole] > 0).sum()), 10.0, 5, 10, 5, 10, 5]))
    flat, customers, singles = total(openings)
    singles[2:] /= len(buckets)
    model = pitman_yor.Model(plan.bits, customers[: plan.classes], customers[plan.classes + pitman_yor.PARENTS + 1 :], singles)
    model.record(flat, opening=True)
    for _ in range(pitman_yor.BURN_IN + pitman_yor.SAMPLES):
        drawn = []
        for b in buckets:
            *_, (tables, _, families, at_word, own) = model.sweeps(b)
            drawn.append(pitman_yor.sized(b, plan.bits, tables, families, at_word, own))
        model.record(total(drawn)[0])
    return model, buckets, words


@pytest.mark.parametrize("hot", [(), (b"w0", b"", b"w3", b"absent")])
def test_lm_probabilities_sum_to_one(hot):
    """Over all words seen in training and one unknown word, each restaurant's predictive probabilities sum to one in each sample, in however many buckets a word lies."""
    plan = pitman_yor.Plan(3, 3, hot=hot)
    model, buckets, words = small_model(plan)
    plain = small_model(pitman_yor.Plan(1, 3))[0]
    assert (model.n, model.v) == (plain.n, plain.v) and np.array_equal(model.customers, plain.customers)
    assert {w for w in hot if w != b"absent"} == {w for b, own in zip(buckets, words) for w in np.array(own, object)[b.split].tolist()}
    for j in range(3):
        z, samples = model.sizes[j + 1], [list(model.sweeps(b, 3))[j] for b in buckets]
        root, parents, classes = {}, collections.defaultdict(dict), collections.defaultdict(dict)
        for b, own, (tables, at_family, families, at_word, mine) in zip(buckets, words, samples):
            total = b.total.copy()
            total[b.split] = model.hot_totals[b.hot]
            root |= {own[i]: p for i, p in enumerate(model.root_of(b, at_word, mine, z).tolist()) if total[i]}
            for i, (w, k) in enumerate(zip(b.family_word.tolist(), b.parents.tolist())):
                parents[k][own[w]] = at_family[i], families[i]
            for i, (w, k) in enumerate(zip(b.word.tolist(), b.classes.tolist())):
                classes[k][own[w]] = b.counts[i], tables[i]
        unknown = float(model.at_root(np.zeros(1), np.zeros(1), z)[0])
        assert math.isclose(sum(root.values()) + unknown, 1.0, rel_tol=1e-9)
        at = lambda f, seats, k, up: float(f(*(np.array([x], float) for x in seats), np.array([k]), np.array([up]), z)[0])
        for k in sorted(classes)[:20]:
            parent = k >> plan.bits
            up = {w: at(model.at_parent, parents[parent].get(w, (0, 0)), parent, p) for w, p in root.items()}
            up_unknown = at(model.at_parent, (0, 0), parent, unknown)
            assert math.isclose(sum(up.values()) + up_unknown, 1.0, rel_tol=1e-9)
            p = sum(at(model.at_class, classes[k].get(w, (0, 0)), k, x) for w, x in up.items())
            assert math.isclose(p + at(model.at_class, (0, 0), k, up_unknown), 1.0, rel_tol=1e-9)


def test_lm_draws_are_exact():
    """Numbers of tables against the posterior over all partitions of a few customers, for light and heavy new tables."""

    def partitions(n):
        if not n:
            yield []
            return
        for p in partitions(n - 1):
            for i in range(len(p)):
                yield [*p[:i], p[i] + 1, *p[i + 1 :]]
            yield [*p, 1]

    rng = np.random.default_rng(4)
    for c, d, weight in ((2, 0.5, 0.3), (6, 0.4, 1.5), (6, 0.8, 0.05)):
        want = np.zeros(c + 1)
        for p in partitions(c):
            want[len(p)] += weight ** len(p) * math.prod(math.prod(i - d for i in range(1, size)) for size in p)
        got = np.bincount(pitman_yor.Seats(d).draw(np.full(40_000, c), np.full(40_000, weight), rng), minlength=c + 1) / 40_000
        assert np.abs(got - want / want.sum()).max() < 0.012


def test_lm_classes_grow():
    assert pitman_yor.class_bits(0) == pitman_yor.class_bits(6_000_000) == 0 < pitman_yor.class_bits(10**8) < pitman_yor.class_bits(5 * 10**8) < pitman_yor.class_bits(10**12) == pitman_yor.MOST_BITS
    assert all(0 < pitman_yor.word_class(w, 5) < pitman_yor.PARENTS << 5 for w in (b"", b"a", b"walked", b"united"))
    assert pitman_yor.word_class(b"walked", 5) >> 5 == pitman_yor.word_class(b"united", 0)


def test_lm_coding_by_kernels():
    """Tokens, classes and distinct pairs as found word by word, for odd white space, words of every length and texts without words."""
    texts = [None, "", " \t\x0b ", "A\x1cb  \u00a0\u0130 x", "\rUnited walked \u00e9 ab ABC abcd\n", "x x\x00 \ud800z ab"]
    block = pitman_yor.Block(0)
    for d, text in enumerate(texts):
        block.add(d, text)
    words, tokens = block.coded()
    want = [[*encoded(t).lower().split(), b""] for t in texts]
    assert [words[i] for i in tokens.tolist()] == [w for ws in want for w in ws] and block.sizes.tolist() == [len(ws) for ws in want]
    assert words == list(dict.fromkeys([b"", *[w for ws in want for w in ws]]))
    for bits in (0, 5, 10):
        assert pitman_yor.word_classes(words, bits).tolist() == [pitman_yor.word_class(w, bits) for w in words]
    rng = np.random.default_rng(5)
    for keys in (rng.integers(0, 50, 400), rng.integers(0, 2**62, 400), np.zeros(0, np.int64), np.array([2**62])):
        assert all(np.array_equal(x, y) for x, y in zip(pitman_yor.distinct(keys), np.unique(keys, return_inverse=True)))


def naive_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64(b" ".join(words[i : i + 4]), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    groups = simhash_dedup.Groups(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                groups.link(i, j)
    return [groups.find(i) for i in range(len(fps))]


def test_near_duplicates(spark, texts):
    got = by_id(registry.QUERIES["op2_simhash_dedup"](spark, SF))
    ids = sorted(texts)
    fps = [naive_fingerprint(texts[d]) for d in ids]
    roots = brute_groups(fps)
    assert {d: (got[d].fingerprint, got[d].component_id) for d in ids} == {d: (f"{f:016x}", ids[r]) for d, f, r in zip(ids, fps, roots)}


@pytest.mark.parametrize("dense", [False, True])
def test_links_of_many_shards(spark, dense):
    """Vantage points, parted shards and pivots lose no link: chains, groups and strays against brute force."""
    rng = random.Random(7)
    fps = set()
    while len(fps) < 2500:
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.choice((0, 0, 3, 60 if dense else 5))):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(simhash_dedup.signed(x) for x in fps)
    unsigned = [x % (1 << 64) for x in fps]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = collections.defaultdict(set)
    for x, r in zip(fps, brute_groups(unsigned)):
        want[r].add(x)
    from millrace.llm.components import connected

    for most in (50_000, 40):
        roots = dict(connected(simhash_dedup.links(df, 100_000, most=most)).select("node", "root").collect())
        groups = collections.defaultdict(set)
        for x in fps:
            groups[roots.get(x, x)].add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_token_counts(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.vocabulary_path(token_count.VOCABULARY))
    rng = random.Random(1)
    odd = ["".join(rng.choice("aaab c  \n▁étheingon😀\x00<s>中in1=") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    all_texts = [*texts.values(), *odd, "ab" * 3000]
    got = token_count.counter(token_count.VOCABULARY)(all_texts)
    assert [n for _, n in got] == [len(sp.encode(t)) for t in all_texts]
    merger = token_count.merger()
    for k in range(200):
        words = ["".join(rng.choice("abcdethingons") for _ in range(rng.randint(1, 40 if k else 4000))) for _ in range(3)]
        sym, sizes = merger.merge(words)
        want = [brute_merge(merger, w) for w in words]
        assert sym.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
        assert merger.by_rank(merger.symbols(words[:1])[0]).tolist() == want[0]


def brute_merge(merger, word):
    """Lowest rank first, then leftmost, one pair at a time."""
    sym = merger.symbols([word])[0].tolist()
    while True:
        found = [(merger.rank[m], k, m) for k in range(len(sym) - 1) if (m := merger.become.get(sym[k] * merger.size + sym[k + 1])) is not None]
        if not found:
            return sym
        _, k, m = min(found)
        sym[k : k + 2] = [m]


def test_token_counts_query(spark, texts):
    """The whole query against the library, with a memory that is full all the time."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.vocabulary_path(token_count.VOCABULARY))
    got = by_id(registry.QUERIES["op4_token_counts"](spark, SF))
    want = {d: (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for d, t in texts.items()}
    assert {d: (r.n_bytes, r.n_tokens, r.over_limit) for d, r in got.items()} == want
    memory = token_count.Memory(3)
    for some in ({"a", "b"}, {"b", "c"}, {"c", "d"}, {"a", "d"}):
        new = memory.unknown(some)
        memory.young.update(zip(new, new))
        assert some <= memory.young.keys() and all(memory.young[w] == w for w in some)


def test_fertility(texts):
    """The measures against the two libraries' own tokens."""
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.vocabulary_path(token_count.VOCABULARY))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(quality.BYTE_VOCABULARY), "rb"))}
    second = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = [t for t in texts.values() if t.strip()][:150] + ["中文 text 😀 mixed", "a"]
    rows = quality.judge(quality.VOCABULARY, quality.BANDS)(some, ["en"] * len(some))
    for t, r in zip(some, rows):
        ids = sp.encode(t)
        in_bytes = sum(sp.is_byte(i) for i in ids)
        assert (r[7], r[8], r[9]) == (len(ids), len(t) / len(ids), in_bytes / len(ids))
        if not in_bytes:
            c = np.array(list(collections.Counter(ids).values())) / len(ids)
            assert math.isclose(r[10], -(c * np.log2(c)).sum(), abs_tol=1e-9)
        words = [w.replace(token_count.SPACE, " ") for w in token_count.pretokens(t)]
        assert math.isclose(r[11], len(t) / sum(len(second.encode_ordinary(w)) for w in words))
        low, high, share, bits, low2, high2 = quality.BANDS["en"]
        wide = 1 + quality.WIDER / math.sqrt(r[7])
        fits = low / wide <= r[8] <= high * wide and r[9] <= share * wide and low2 / wide <= r[11] <= high2 * wide and r[10] >= min(bits, quality.ENTROPY_SHARE * math.log2(r[7]))
        assert r[6] == (fits and not r[5])


def test_quality_counts(spark, texts):
    got = by_id(registry.QUERIES["op5_quality_rules"](spark, SF))
    for d, t in texts.items():
        words = re.findall("[^\\x20\\x09-\\x0D]+", t)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.strip(" \t\n\v\f\r"):
                dup += line in seen
                seen.add(line)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit))
        assert r.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words)) and r.kept <= (not r.base_failed)


def test_quality_keeps_good(spark):
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    got = [r for r in registry.QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").collect() if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in got) >= 0.99 * len(got)


def test_pieces(texts):
    """Exact round trips, and scores as a plain dynamic program finds them."""
    own = sentence_pieces.codec()
    for t in [*texts.values(), "", " ", "  a\nb😀\x00", "x" * 5000]:
        ids, score, in_bytes = own.encode(t)
        assert own.decode(ids) == t and in_bytes == sum(own.is_byte[i] for i in ids)
        assert math.isclose(score, brute_score(own, t), rel_tol=1e-12, abs_tol=1e-9)


def test_pieces_of_ordinary_text():
    """About as many pieces as the library's own encoding has."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.vocabulary_path(token_count.VOCABULARY))
    text = "The committee met on Tuesday to discuss the transport budget, and several members of the council asked why the figures had changed since the spring."
    assert len(sentence_pieces.codec().encode(text)[0]) <= 1.05 * len(sp.encode(text))


def brute_score(own, text):
    """Plain dynamic program over all substrings, pre-token by pre-token."""
    pieces = {own.raw[i].decode().replace(" ", "▁"): s for i, _, s in own.automaton.values()}
    total = 0.0
    for word in token_count.pretokens(text):
        best = [0.0]
        for end in range(1, len(word) + 1):
            found = [best[b] + pieces[word[b:end]] for b in range(max(0, end - 16), end) if word[b:end] in pieces]
            best.append(max(found, default=best[-1] + own.unknown))
        total += best[-1]
    return total


def test_html():
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var a="</p>"</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>'
        '<div class="cookie-notice"><p>We use cookies and you agree to all of it by reading on, and on.</p></div><div class=ad>Buy</div><main><article><h1>A &amp; B</h1>'
        '<p><b>First</b> text&nbsp;is\n here<br>now.<p>Second <a href="x>y">link</a>.</p><form>Name <input></form><aside>See also</aside></article>'
        '<section id="comments"><p>Great article, thanks for writing it.</p></section></main><footer>&copy; me</footer></body></html>'
    )
    assert html_text.main_text(page) == "A & B\nFirst text is here now.\nSecond link."
    assert html_text.main_text("<p>Just one paragraph of plain words that go on for a while without any frame.</p>") != ""


def test_min_cut_is_least():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 8)
        s, t = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(1, 5)) for _ in range(rng.randint(0, 12))]
        edges = [e for e in edges if e[0] != e[1]]
        cost = lambda keep: sum(t[i] if k else s[i] for i, k in enumerate(keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: E731, B023
        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(html_text.min_cut(list(map(float, s)), list(map(float, t)), [(a, b, float(c)) for a, b, c in edges])), best)


def test_secrets(spark):
    live, copied = "q9Xv2LmZ8rTn4KpW7sYd3HbJ", "zZ81kQm5Vx0Lw2Rt6Ny9Bc4P"
    rows = [(1, f"PASSWORD = 'short' and api-key: no; key AKIAABCDEFGHIJKL12 {live}", "a"), (2, f"x {copied}", "a"), (3, f"y {copied}", "b"), (4, "Token:\t" + "f" * 32, "c"), (5, "token: " + "f" * 40, "d")]
    got = by_id(secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    at = rows[0][1].index("AKIA")
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (0, 1, 0)
    assert got[1].base_sha256 == hashlib.sha256(f"access:{at}:{at + 18}".encode()).hexdigest()
    assert got[1].spans == f"access:{at}:{at + 18},entropy:{at + 19}:{at + 19 + len(live)}"
    assert got[2].spans == got[3].spans == ""
    assert (got[4].n_assign, got[4].n_hex, got[5].n_assign, got[5].n_hex) == (0, 1, 1, 1)
    assert got[5].spans == "assign:0:47,hex:7:47"


def test_licenses(texts):
    own = licenses.automaton()
    phrases = [(p.encode().split(), label) for p, label in licenses.PHRASES]
    for t in [*texts.values(), *[x for _, x in licenses.TEMPLATES], "MIT license-MIT  License the gnu general public licens general public license", "mit"]:
        words = licenses.alnum_words(t)
        want = sorted((i, len(p), label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p)] == p)
        places, matches = own.scan(words)
        assert sorted(places) == want
        for template, at, start, size in matches:
            source = licenses.alnum_words(licenses.TEMPLATES[template][1])
            assert source[at : at + size] == words[start : start + size]
        if len(words) < 400:
            assert {(t, a + n, s + n) for t, a, s, n in matches} == brute_matches(words)
    for label, text in licenses.TEMPLATES:
        assert own.covers(own.scan(licenses.alnum_words("before it " + text + " after"))[1])[label] == 1.0


def brute_matches(words):
    """(template, end there, end in the file) of all runs of MIN_MATCH words or more that their next words do not prolong."""
    out = set()
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        template = licenses.alnum_words(text)
        runs = {}
        for e, w in enumerate([*words, None]):
            now = {i: runs.get(i - 1, 0) + 1 for i, x in enumerate(template) if x == w}
            out |= {(k, i + 1, e) for i, n in runs.items() if n >= licenses.MIN_MATCH and i + 1 not in now}
            runs = now
    return out


def test_shared_runs_count_for_all_templates():
    own = licenses.automaton()
    covers = own.covers(own.scan(licenses.alnum_words("the above copyright notice and this permission notice shall"))[1])
    assert {"mit", "isc"} <= covers.keys()


def test_license_query(spark, texts):
    got = by_id(registry.QUERIES["op9_license_scans"](spark, SF))
    phrases = [(p.encode().split(), label) for p, label in licenses.PHRASES]
    for d, t in texts.items():
        words, r = licenses.alnum_words(t), got[d]
        places = sorted((i, label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p)] == p)
        base = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(base))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(base) <= set(r.labels.split(",")) if base else True
        assert 0 <= r.score <= 1


def test_secret_query(spark, texts):
    """Base counts and spans of the whole table against plain patterns."""
    got = by_id(registry.QUERIES["op8_secret_scans"](spark, SF))
    for d, t in texts.items():
        base = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        digest = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base))
        r, kinds = got[d], [k for _, k, _ in base]
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds.count(0), kinds.count(1), kinds.count(2))
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert set(digest.split(",")) <= set(r.spans.split(","))


def test_many_secrets_in_one_text():
    text = "token=abcdefgh1 key Zq8xV2mLr5Tn4KpW7sYd3HbJ9c " * 20_000
    began = time.process_time()
    assert len(secrets.find(text)) == 40_000 and time.process_time() - began < 10


def test_decontaminate_spans(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[5:20]) + " c"), (2, " ".join(words[5:17])), (3, "É " + " ".join(words[:13]).upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(words)), (9, "é " + " ".join(words[:12]))], "item_id long, text string")
    for bound in (100_000, 1):
        got = by_id(decontaminate.decontaminate(docs, bench, max_set=bound))
        assert [(s.start, s.end) for s in got[1].spans][0] == (2, 15) and got[1].n_hit == 15 and got[1].contaminated
        assert got[2].n_hit == 0 and not got[2].contaminated
        assert got[3].n_hit == 13 and got[3].item_ids == ["10"]
