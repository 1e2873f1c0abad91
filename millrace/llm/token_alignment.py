"""Alignment of two tokenisers over a corpus, on Arrow arrays.

Texts are encoded by both vocabularies and their ids laid out as lists; flattened, with parent indices, they have byte
lengths whose running sums, begun anew in each document, are token ends. A hash join of both sides' document-end keys
finds the places where tokens of both end: these cut documents into groups. Tokens whose bytes overlap are linked, and how
many documents link a pair of ids is counted by Table.group_by in each task and summed by Spark. Counts go back to the
documents by buckets of pairs: pairs that hold a ten-thousandth of all links or more (so at most ten thousand pairs) are
looked up on the spot, the others where their bucket's counts are.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import encoded, pick, read, stage
from millrace.llm.token_count import PRETOKEN, SPACE, VOCABULARY, kept, merger, pretokens, vocabulary_path

#: Vocabulary A (a tokenizers file), and the same one as ranks, by which pre-tokens are encoded.
BYTE_VOCABULARY, BYTE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Bytes of text aligned at a time; a longer text is aligned alone.
AT_ONCE = 1 << 20
#: Pairs with at least this share of all documents' links are hot; there are no more of them than its inverse.
HOT_SHARE = 1e-4
#: Distinct pairs of a bucket, links of a part of one, and links gathered before they are handed to parts.
BUCKET, PART, PACKET = 250_000, 1 << 20, 1 << 21
#: Chunks remembered, and their ids, until all are forgotten.
REMEMBERED, MOST_IDS = 500_000, 1 << 22
#: Neither side has a token across the start of a chunk: white space, if only spaces and line feeds, goes with the word behind it.
CHUNK = re.compile("[ \n]*[^ \n]+|[ \n]+")
#: A text with other white space, or beyond the code points long assigned (on whose classes every Unicode version agrees), is encoded as a whole.
ODD = re.compile("[^\n -~¡-ͯΑ-ΡΣ-ϿЀ-ҁҊ-ӿ‐-‧‰-⁞₠-₵←-⏏─-▀▂-⛿、-〿ぁ-ゖ゠-ヿ一-龥가-힣\U0001f300-\U0001f5ff\U0001f600-\U0001f640]")
SIZES = "n_a long, n_b long, n_groups long, n_links long"


class Pair:
    """Both vocabularies: ids of texts, bytes of ids, and decimal ids with the marks of the groups' digest."""

    def __init__(self, byte_vocabulary: str, byte_ranks: str, vocabulary: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(byte_vocabulary))
        self.library.encode_special_tokens = True
        with open(vocabulary_path(byte_ranks), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        raw = [b""] * self.library.get_vocab_size()
        for b, i in ranks.items():
            raw[i] = b
        self.a_bytes = pa.array(raw, pa.binary())
        self.pieces = merger(vocabulary)
        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
        self.of_byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        at = {i: bytes([b]) for b, i in enumerate(self.of_byte)}
        self.b_bytes = pa.array([at.get(i) or sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(sp.get_piece_size())], pa.binary())
        self.a_size, self.b_size = len(self.a_bytes), len(self.b_bytes)
        if self.a_size * self.b_size >= 1 << 31:
            raise ValueError("pairs of ids need more than 31 bits")
        # Strings of the digest: A's ids, A's last of a group, B's ids, B's last of a group, B's last of a text.
        marks = [(self.a_size, ","), (self.a_size, "|"), (self.b_size, ","), (self.b_size, ";"), (self.b_size, "")]
        self.marked = pa.array([f"{i}{m}".encode() for size, m in marks for i in range(size)], pa.binary())
        self.a_lengths, self.b_lengths = (pc.binary_length(x) for x in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        """Chunks known so far: their number, and where in the arrays of both sides' ids each begins."""
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(1 << 16, np.int32) for _ in range(2)]
        self.begins = [np.zeros(1 << 12, np.int64) for _ in range(2)]

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of space + text by A and of text by B, of each text."""
        # An odd text is one chunk of its own.
        split = [[t] if ODD.search(t) else CHUNK.findall(" " + t) if t else [] for t in texts]
        wanted = set().union(*split)
        if len(self.known) + len(wanted) > REMEMBERED or max(b[len(self.known)] for b in self.begins) > MOST_IDS:
            self.forget()
        self.learn(list(wanted.difference(self.known)))
        numbers = np.fromiter((n for chunks in split for n in map(self.known.__getitem__, chunks)), np.int64)
        ends = np.cumsum([0, *map(len, split)])
        out = []
        for ids, begins in zip(self.ids, self.begins):
            first, sizes = begins[numbers], begins[numbers + 1] - begins[numbers]
            upto = np.r_[0, np.cumsum(sizes)]
            flat = ids[np.repeat(first - upto[:-1], sizes) + np.arange(upto[-1])]
            out.append(pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pa.array(flat)))
        return out[0], out[1]

    def learn(self, new: list[str]) -> None:
        """An odd text stands without its leading space, as its vocabularies want it."""
        odd = [bool(ODD.search(c)) for c in new]
        library = iter(self.library.encode_batch([" " + c for c, o in zip(new, odd) if o], add_special_tokens=False))
        a = [next(library).ids if o else self.ranks.encode_ordinary(c) for c, o in zip(new, odd)]
        words = [pretokens(c) if o else PRETOKEN.findall(c.replace(" ", SPACE)) for c, o in zip(new, odd)]
        sym, sizes = self.pieces.merge([w for ws in words for w in ws])
        at = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum([len(ws) for ws in words], dtype=np.int64)]].astype(np.int64)
        b, per_chunk = self.with_bytes(sym, at, words)
        for side, (flat, counts) in enumerate(((np.fromiter((i for ids in a for i in ids), np.int32), [len(ids) for ids in a]), (b, per_chunk))):
            n = len(self.known)
            begins = self.begins[side][n] + np.cumsum(counts, dtype=np.int64)
            self.begins[side] = grown(self.begins[side], n + 1, begins)
            self.ids[side] = grown(self.ids[side], int(self.begins[side][n]), flat)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))

    def with_bytes(self, sym: np.ndarray, at: np.ndarray, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with those of unknown characters, which are never merged, as the ids of their bytes; how many each chunk has."""
        weight = np.where(sym < self.pieces.size, 1, sym - self.pieces.size)
        upto = np.r_[0, np.cumsum(weight)]
        out = np.empty(upto[-1], np.int32)
        plain = sym < self.pieces.size
        out[upto[:-1][plain]] = sym[plain]
        owners = np.unique(np.searchsorted(at, np.flatnonzero(~plain), "right") - 1)
        chars = [c for k in owners.tolist() for w in words[k] for c in w if self.pieces.point[ord(c)] >= self.pieces.size]
        for place, c in zip(upto[:-1][~plain].tolist(), chars):
            for k, byte in enumerate(c.encode()):
                out[place + k] = self.of_byte[byte]
        return out, np.diff(upto[at])


def grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """held with `more` behind its first `used` values."""
    if used + len(more) > len(held):
        held = np.r_[held[:used], np.zeros(max(used, len(more)) + len(more), held.dtype)]
    held[used : used + len(more)] = more
    return held


def pair_of(byte_vocabulary: str, byte_ranks: str, vocabulary: str) -> Pair:
    return kept("alignment", byte_vocabulary, vocabulary, make=lambda: Pair(byte_vocabulary, byte_ranks, vocabulary))


def spelled(ids: pa.ListArray, raw: pa.Array, wanted: list[bytes]) -> np.ndarray:
    """Which lists' tokens, bytes joined, are the wanted bytes."""
    made = raw.take(ids.flatten())
    offsets = np.frombuffer(made.buffers()[1], np.int32)[: len(made) + 1]
    ends = offsets[ids.offsets.to_numpy()]
    whole = made.buffers()[2].to_pybytes() if len(made) else b""
    return np.array([whole[a:b] == w for a, b, w in zip(ends[:-1].tolist(), ends[1:].tolist(), wanted)], bool)


def ends_of(ids: pa.ListArray, lengths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: its document, and its document-end key, the document's number above 32 bits of the byte where it ends. The running sum begins anew in each document."""
    parents = ids.value_parent_indices().to_numpy().astype(np.int64)
    running = pc.cumulative_sum(lengths.take(ids.flatten()).cast(pa.int64())).to_numpy()
    before = np.r_[0, running][ids.offsets.to_numpy()[:-1]]
    return parents, (parents << 32) + running - before[parents]


def aligned(own: Pair, texts: list[str | None]) -> tuple[np.ndarray, list[str], pa.ListArray, pa.ListArray, dict]:
    """Of each text: n_a, n_b, n_groups, n_links; the digest of its groups; its linked pairs (a * size of B + b) in order, each once; how often each is linked."""
    plain = [t or "" for t in texts]
    wanted = [b" " + encoded(t) for t in plain]
    a, b = own.encode(plain)
    good = spelled(a, own.a_bytes, wanted) & spelled(b, own.b_bytes, wanted) & np.array([t != "" for t in plain], bool)
    if not good.all():
        nothing = pa.array(good)
        a, b = (pc.if_else(nothing, x, pa.array([[]], x.type)[0]) for x in (a, b))
    a_ids, b_ids = a.flatten().to_numpy(), b.flatten().to_numpy()
    (a_doc, a_end), (b_doc, b_end) = ends_of(a, own.a_lengths), ends_of(b, own.b_lengths)
    # Where tokens of both end.
    sides = [pa.table({"end": end, name: np.arange(len(end))}) for end, name in ((a_end, "a"), (b_end, "b"))]
    cuts = sides[0].join(sides[1], "end", join_type="inner", use_threads=False)
    a_cut, b_cut = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    a_cut[cuts["a"].to_numpy()], b_cut[cuts["b"].to_numpy()] = True, True
    # Every end begins an overlap's last byte: of the token that ends there and the other side's that covers it.
    covers_a, rest = np.searchsorted(b_end, a_end), np.flatnonzero(~b_cut)
    link_a = np.r_[a_ids, a_ids[np.searchsorted(a_end, b_end[rest])]].astype(np.int64)
    link_b = np.r_[b_ids[covers_a], b_ids[rest]]
    link_doc = np.r_[a_doc, b_doc[rest]]
    keys = np.sort((link_doc << 31) + link_a * own.b_size + link_b)
    lead = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.r_[lead, len(keys)]).astype(np.int32)
    n = len(texts)
    offsets = pa.array(np.searchsorted(keys[lead] >> 31, np.arange(n + 1)).astype(np.int32))
    pairs = pa.ListArray.from_arrays(offsets, pa.array((keys[lead] & ((1 << 31) - 1)).astype(np.int32)))
    count = lambda doc: np.bincount(doc, minlength=n)
    sizes = np.stack([count(a_doc), count(b_doc), count(a_doc[a_cut]), count(link_doc)], axis=1)
    return sizes, digests(own, a_ids, b_ids, a_doc, a_cut, b_cut, n), pairs, pa.ListArray.from_arrays(offsets, pa.array(times))


def digests(own: Pair, a_ids: np.ndarray, b_ids: np.ndarray, a_doc: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, n: int) -> list[str]:
    """SHA-256 of each text's groups, `a1,a2|b1;a3|b2,b3`; of a text without tokens an empty string. A token's place in the whole is its own number and that of the other side's tokens in the groups before, its own too if it is B's."""
    a_upto, b_upto = np.cumsum(a_cut), np.cumsum(b_cut)  # groups ended, by token
    a_at, b_at = np.flatnonzero(a_cut) + 1, np.flatnonzero(b_cut) + 1  # tokens up to the end of each group
    a_place = np.arange(len(a_ids)) + np.r_[0, b_at][a_upto - a_cut]
    b_place = np.arange(len(b_ids)) + a_at[b_upto - b_cut] if len(b_ids) else np.zeros(0, np.int64)
    last = np.zeros(len(b_ids), bool)
    per_doc = np.bincount(a_doc[a_cut], minlength=n)
    groups = np.cumsum(per_doc)
    last[b_at[groups[per_doc > 0] - 1] - 1] = True
    code = np.empty(len(a_ids) + len(b_ids), np.int64)
    code[a_place] = a_ids + np.where(a_cut, own.a_size, 0)
    code[b_place] = b_ids + 2 * own.a_size + np.where(last, 2 * own.b_size, np.where(b_cut, own.b_size, 0))
    made = own.marked.take(pa.array(code))
    offsets = np.frombuffer(made.buffers()[1], np.int32)[: len(made) + 1]
    view = memoryview(made.buffers()[2]) if len(made) else memoryview(b"")
    upto = np.r_[0, a_at + b_at][np.r_[0, groups]]  # tokens of both sides up to each text's end
    ends = offsets[upto].tolist()
    return [hashlib.sha256(view[a:b]).hexdigest() if b > a else "" for a, b in zip(ends[:-1], ends[1:])]


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of AT_ONCE characters at most, or of one text."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and size + n > AT_ONCE:
            yield start, k
            start, size = k, 0
        size += n
    if texts:
        yield start, len(texts)


def align_documents(docs: DataFrame, carry: list[str], text: str, names: tuple[str, str, str]) -> DataFrame:
    """carry, SIZES, groups_sha256, pairs and times (see aligned) of every row."""
    head = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair_of(*names)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for start in range(0, batch.num_rows, 1000):
                some = texts.slice(start, 1000).to_pylist()
                for a, b in slices(some):
                    sizes, sha, pairs, times = aligned(own, some[a:b])
                    columns = [batch.column(batch.schema.get_field_index(c)).slice(start + a, b - a) for c in carry]
                    yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sizes.T.copy()), pa.array(sha, pa.string()), pairs, times], names=[*carry, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(*carry, text).mapInArrow(run, ", ".join([*head, SIZES, "groups_sha256 string, pairs array<int>, times array<int>"]))


def pair_counts(each: DataFrame) -> DataFrame:
    """pair and n, the documents that link it; partial counts of each task by Table.group_by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"pair": t["pair"], "n": t["n_sum"]})

        for batch in batches:
            pairs = batch.column(0).flatten()
            held.append(pa.table({"pair": pairs, "n": pa.array(np.ones(len(pairs), np.int64))}))
            size += len(pairs)
            if size > PACKET:
                held = [summed()]
                size = held[0].num_rows
                if size > PACKET // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from summed().to_batches()

    return each.select("pairs").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def bucket_of(pairs: np.ndarray, n: int) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n


def looked_up(each: DataFrame, counts: DataFrame, buckets: int, parts: int, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """row, n_best and count_sum in parts that add up. each: row, pairs, times. counts: pair, n, best. hot: such columns as arrays, sorted by pair.

    A bucket's links are dealt to its `parts`, each of which has all counts of the bucket.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of rows whose pairs are hot (kind 2), and pairs left by bucket (kind 1)."""
        hot_pair, hot_n, hot_best = hot
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packets() -> Iterator[pa.RecordBatch]:
            rows, pairs, times = (np.concatenate(x) for x in zip(*held))
            if not len(rows):
                return
            bucket = bucket_of(pairs, buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(at))
            yield packet(full * parts + int(rows[0] + len(rows)) % parts, 1, np.r_[at[full], at[-1]], rows[order], pairs[order].astype(np.int64), times[order].astype(np.int64))

        for k, batch in enumerate(batches):
            rows, pairs, times = batch.column(0).to_numpy(), batch.column(1), batch.column(2).flatten().to_numpy()
            parents, flat = pairs.value_parent_indices().to_numpy(), pairs.flatten().to_numpy()
            found = np.searchsorted(hot_pair, flat)
            known = np.zeros(len(flat), bool) if not len(hot_pair) else hot_pair[np.minimum(found, len(hot_pair) - 1)] == flat
            at = found[known]
            sums = [np.bincount(parents[known], weights=w, minlength=len(rows)) for w in (times[known] * hot_best[at], times[known].astype(np.float64) * hot_n[at])]
            yield packet(np.array([k % (buckets * parts)]), 2, np.array([0, len(rows)]), rows, *(s.astype(np.int64) for s in sums))
            held.append((rows[parents[~known]], flat[~known], times[~known]))
            if sum(len(h[0]) for h in held) > PACKET:
                yield from packets()
                held.clear()
        if held:
            yield from packets()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts one after another, counts before links."""
        part, loose, known = -1, [], None
        for batch in batches:
            head = [batch.column(c).to_numpy() for c in (0, 1)]
            for k, (b, kind) in enumerate(zip(*(h.tolist() for h in head))):
                rows, x, y = (batch.column(c)[k].values.to_numpy() for c in (2, 3, 4))
                if b != part:
                    part, loose, known = b, [], None
                if kind == 0:
                    loose.append((rows, x, y))
                elif kind == 2:
                    yield sums_of(rows, x, y)
                else:
                    if known is None:
                        known = [np.concatenate(c) for c in zip(*loose)]
                        order = np.argsort(known[0])
                        known = [c[order] for c in known]
                    at = np.searchsorted(known[0], x)
                    own, first = np.unique(rows, return_inverse=True)
                    yield sums_of(own, *(np.bincount(first, weights=y * w[at]).astype(np.int64) for w in (known[2], known[1])))

    def packet(part: np.ndarray, kind: int, at: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(at.astype(np.int32))
        made = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), kind, np.int32)), *made], names=["part", "kind", "rows", "x", "y"])

    def sums_of(rows: np.ndarray, best: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(map(pa.array, (rows, best, total))), names=["row", "n_best", "count_sum"])

    def shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts by bucket (kind 0)."""
        for batch in batches:
            pair, n, best = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
            bucket = bucket_of(pair, buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(at))
            for k in range(parts):
                yield packet(full * parts + k, 0, np.r_[at[full], at[-1]], pair[order], n[order], best[order])

    shape = "part long, kind int, rows array<long>, x array<long>, y array<long>"
    all_packets = counts.select("pair", "n", "best").mapInArrow(shelved, shape).unionAll(each.select("row", "pairs", "times").mapInArrow(spread, shape))
    return all_packets.repartition(buckets * parts, "part").sortWithinPartitions("part", "kind").mapInArrow(meet, "row long, n_best long, count_sum long")


def align_tokens(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_vocabulary: str = BYTE_VOCABULARY, byte_ranks: str = BYTE_RANKS, vocabulary: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """Documents and pairs: doc_id, SIZES, n_best, count_sum and groups_sha256 for every row of docs; a_id, b_id, documents and best for every pair of ids linked in the corpus.

    A text that is null or empty, or that either side's tokens do not spell, has no tokens: zeros and an empty digest. Null
    ids and repeated rows give a row each, and count as documents of their own; an empty table gives empty ones; other columns
    are not read. All b of an a_id whose counts tie for the highest are best. Texts are aligned whole.
    """
    numbered = pick(docs, doc_id=doc_id, text=text).withColumn("row", F.monotonically_increasing_id())
    each = stage(align_documents(numbered, ["row", "doc_id"], "text", (byte_vocabulary, byte_ranks, vocabulary)), "aligned")
    own = functools.partial(pair_of, byte_vocabulary, byte_ranks, vocabulary)
    size_b = own().b_size
    a_id = F.floor(F.col("pair") / size_b)
    # An id of A has no more pairs than B has ids.
    counts = stage(pair_counts(each).withColumn("best", F.max("n").over(Window.partitionBy(a_id)) == F.col("n")), "pair-counts")
    n_pairs, n_links = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = counts.where(F.col("n") >= max(2, n_links * HOT_SHARE)).toPandas().sort_values("pair")
    hot_arrays = tuple(hot[c].to_numpy(np.int64) for c in ("pair", "n", "best"))
    buckets = max(12, -(-n_pairs // BUCKET))
    parts = max(1, -(-(n_links - int(hot["n"].sum())) // (buckets * PART)))
    sums = looked_up(each, counts, buckets, parts, hot_arrays).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = each.drop("pairs", "times").join(sums, "row", "left")
    out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
    return out, counts.select(a_id.cast("int").alias("a_id"), (F.col("pair") % size_b).alias("b_id"), F.col("n").alias("documents"), "best")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(read(spark, sf_dir, "documents"))[0]
