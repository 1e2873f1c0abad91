"""SimHash near-duplicates, linked exactly through vantage points.

Fingerprints of 64 bits that differ in at most RADIUS bits are linked. Distances of a 64-bit fingerprint to a vantage point
crowd around 32, so the triangle bound of a plain vantage-point tree cuts off little: a shard and its borders keep about
nine tenths of all rows a level. So the bits are parted into ranges. Two fingerprints within RADIUS bits agree
wholly on all but RADIUS of them, so for every choice of that many ranges there is a tree whose distances see those bits
alone: the bound there is 0, and a linked pair has equal distances to all vantage points of some tree. A shard is a choice
and its distances. Inside a shard, full distances to a local vantage point bound the search by RADIUS on either side.
Shards give links to each found group's least member, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard_dedup
from millrace.llm.common import numbered, pick, read, space_words, stage, text_map
from millrace.llm.components import connected

SHINGLE = 4
RADIUS = 4
SEED = 42
#: A shard is meant to have so many fingerprints; vantage points are added, and more ranges taken, until it has.
SHARD = 512
#: Shards of more are parted into blocks, and each two blocks meet in a task.
MOST = 50_000
#: Bits that a vantage point's distance tells about a shard, about.
BITS_EACH = 2.9
#: Parts of a group when its members are named.
SALTS = 32
#: Above so many links a member, groups are first covered by pivots.
DENSE = 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = space_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    h64 = xxhash.xxh64_intdigest
    last = ends[len(words) - n :]
    h = np.array([h64(joined[b:e], SEED) for b, e in zip(begins[:n].tolist(), last.tolist())], np.uint64)
    # Bits become bytes of 0 and 1; sums of at most 255 of them fit a byte, so eight are added in one word.
    lanes = np.zeros((-(-n // 255) * 255, 64), np.uint8)
    lanes[:n] = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    counts = lanes.view(np.uint64).reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) for every row."""

    def make() -> Callable[[list], list]:
        return lambda texts: [(f - (1 << 64) if f >> 63 else f,) for f in map(fingerprint, texts)]

    return text_map(pick(docs, doc_id=doc_id, text=text), make, "fp long")


def plan(n: int, radius: int = RADIUS) -> tuple[list[int], list[int]]:
    """Masks of the trees and vantage points for n fingerprints: as many ranges as keep shards small, as few trees as do."""
    for ranges in range(radius + 1, radius + 5):
        bits = 64 * (ranges - radius) / ranges
        if n / 2**bits <= SHARD or ranges == radius + 4:
            break
    edges = [round(64 * i / ranges) for i in range(ranges + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, ranges - radius)]
    points = max(0, math.ceil(math.log2(max(1, n / SHARD)) / BITS_EACH))
    rng = np.random.default_rng(SEED)
    return masks, [int(x) for x in rng.integers(0, 2**64, min(points, 9), dtype=np.uint64)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_of(fp: Column, mask: int, k: int, points: list[int]) -> Column:
    """The tree and the distances to its vantage points, in one long."""
    key = F.lit(k).cast("long")
    for p in points:
        key = key * 65 + F.bit_count(fp.bitwiseXOR(F.lit(signed(p))).bitwiseAND(F.lit(signed(mask)))).cast("long")
    return key


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


class Groups:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def link_shard(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, least member of its group) for all members that are not the least; fps are distinct."""
    fps = np.sort(np.asarray(fps, np.int64)).view(np.uint64)
    n = len(fps)
    if n < 2:
        return []
    groups = Groups(n)
    order = np.argsort(np.bitwise_count(fps ^ fps[0]), kind="stable")
    a = fps[order]
    d = np.bitwise_count(a ^ fps[0]).astype(np.int64)
    rows = max(1, min(256, 4_000_000 // n))
    pairs, sparse = [], True
    for at in range(0, n, rows):
        stop = min(n, at + rows)
        to = int(np.searchsorted(d, d[stop - 1] + radius, "right"))  # triangle bound: none beyond lies within radius
        i, j = np.nonzero(near(a[at:stop], a[at:to], radius))
        up = j > i
        pairs.append((order[i[up] + at], order[j[up] + at]))
        if sum(len(p[0]) for p in pairs) > DENSE * n:
            sparse = False
            break
    if sparse:
        for i, j in zip(np.concatenate([p[0] for p in pairs]).tolist(), np.concatenate([p[1] for p in pairs]).tolist()):
            groups.link(i, j)
    else:
        cover(fps, groups, radius)
    out = []
    signed_fps = fps.view(np.int64).tolist()
    for i in range(n):
        r = groups.find(i)
        if r != i:
            out.append((signed_fps[i], signed_fps[r]))
    return out


def cover(fps: np.ndarray, groups: Groups, radius: int) -> None:
    """Links a dense shard. Each pivot takes all free members within radius; clusters meet member by member only if their pivots' distance allows and nothing has linked them yet."""
    free = np.arange(len(fps))
    clusters: list[tuple[int, np.ndarray, int]] = []
    while len(free):
        p = int(free[0])
        d = np.bitwise_count(fps[free] ^ fps[p])
        inside = d <= radius
        members = free[inside]
        for m in members.tolist():
            groups.link(p, m)
        clusters.append((p, members, int(d[inside].max())))
        free = free[~inside]
    pivots = fps[[c[0] for c in clusters]]
    spread = np.array([c[2] for c in clusters])
    for k in range(len(clusters) - 1):
        d = np.bitwise_count(pivots[k + 1 :] ^ pivots[k])
        for j in (np.flatnonzero(d <= radius + spread[k] + spread[k + 1 :]) + k + 1).tolist():
            (p, own, _), (q, other, _) = clusters[k], clusters[j]
            if groups.find(p) == groups.find(q):
                continue
            step = max(1, 4_000_000 // len(other))
            if any(near(fps[own[s : s + step]], fps[other], radius).any() for s in range(0, len(own), step)):
                groups.link(p, q)


def links(distinct: DataFrame, n: int, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b) with fingerprints of one group for distinct fingerprints fp; together they connect all that links of `radius` bits connect."""
    masks, points = plan(n, radius)
    fp = F.col("fp")
    spread = distinct.select("fp", F.explode(F.array(*[shard_of(fp, m, k, points) for k, m in enumerate(masks)])).alias("shard"))
    large = spread.groupBy("shard").count().where(F.col("count") > most).select("shard", F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    spread = spread.join(large, "shard", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(other, lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own)))
    spread = spread.select("fp", "shard", F.explode(meets).alias("part"))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(link_shard(pdf["fp"].to_numpy(), radius), columns=["a", "b"], dtype="int64")

    return spread.groupBy("shard", "part").applyInPandas(work, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable over links, for every row.

    A null or empty text, or one without words, has fingerprint zero and is linked like any other. Null ids are linked but
    are never a component's least unless all of its ids are null; repeated rows give a row each; an empty table an empty
    one; other columns are not read. Copies are one fingerprint before links are sought.
    """
    fps = stage(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected(links(distinct.select("fp"), distinct.count(), radius))
    linked = roots.join(distinct, F.col("node") == F.col("fp")).select("fp", "first", "root")
    # A group's name goes to its members in SALTS parts, so that a large group is no single key.
    least = linked.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"]).select("fp", "component_id")
    known = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fps.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = jaccard_dedup.SHINGLE, threshold: float = jaccard_dedup.THRESHOLD) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one of least (doc_id, hash of the whole text), null ids last; all columns stay.

    Near-duplicates are texts whose shingle sets have a Jaccard similarity of `threshold` or more, and what these connect.
    Rows that repeat both id and text are one document; other texts under the same id, or under none, are documents of their own.
    """
    flat, at = numbered(docs)
    keyed = flat.withColumn("hash", F.sha2(F.col(at[text]), 256))
    rows = keyed.select(F.col(at[doc_id]).alias("doc_id"), "hash", F.col(at[text]).alias("text"))
    distinct, roots = jaccard_dedup.jaccard_roots(rows, shingle, threshold)
    return least_rows(keyed, at[doc_id], distinct, roots).toDF(*docs.columns)


def least_rows(keyed: DataFrame, doc_id: str, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each root, the rows of keyed with its least `first` key (none, doc_id, hash) among the fingerprints in distinct, each once, without the hash. Only rows that repeat are dealt out again."""
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key.doc_id").alias("first_id"), F.col("first.key.hash").alias("first_hash"), (F.col("first.times") > 1).alias("repeats"))
    columns = [c for c in keyed.columns if c != "hash"]
    kept = keyed.join(stage(first, "first"), F.col(doc_id).eqNullSafe(F.col("first_id")) & F.col("hash").eqNullSafe(F.col("first_hash")))
    return kept.where(~F.col("repeats")).select(*columns).union(kept.where("repeats").dropDuplicates([doc_id, "hash"]).select(*columns))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
