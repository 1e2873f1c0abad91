"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in each text. The candidates' hashes, never the texts, are shuffled and counted by distinct
repositories and owners. One that many owners carry is an example that was copied about; one that a single owner carries in
few repositories looks like a live credential. Base kinds stay whatever the counts say; a generic candidate becomes a span
only if its ownership says live.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import numbered, pick, read, stage, text_map

#: Kinds in the order in which spans of equal start stand; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "prefixed", "private_key", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PREFIXED = re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})")
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----")
GENERIC = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
DIGIT = re.compile(r"[0-9]")
MIN_ENTROPY = 3.5
#: A candidate of more owners, or of more repositories of one owner, is a copied example.
MAX_OWNERS = 1
MAX_REPOSITORIES = 50


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret) of all candidates, by start, then kind; positions are code points."""
    if not text:
        return []
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    if "eyJ" in text:
        found += [(3, m.start(), m.end(), m[0]) for m in JWT.finditer(text)]
    found += [(4, m.start(), m.end(), m[0]) for m in PREFIXED.finditer(text)]
    if "-----BEGIN " in text:
        found += [(5, m.start(), m.end(), m[0]) for m in PRIVATE_KEY.finditer(text)]
    begins, ends = [], []  # what is taken, as spans that don't touch
    for s, e in sorted((s, e) for _, s, e, _ in found):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(s)
            ends.append(e)
    for m in GENERIC.finditer(text):
        s, e = m.span()
        before = bisect_left(begins, e) - 1  # the last that begins before this one ends
        if DIGIT.search(m[0]) and not (before >= 0 and ends[before] > s) and entropy(m[0]) >= MIN_ENTROPY:
            found.append((6, s, e, m[0]))
    return sorted(found, key=lambda x: (x[1], x[0]))


def digest(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in spans)


def scanner() -> Callable[[list], list]:
    def work(texts: list) -> list:
        rows = []
        for text in texts:
            found = find(text)
            base = digest([x for x in found if x[0] < 3])
            n = Counter(x[0] for x in found)
            hashed = [{"kind": k, "start": s, "end": e, "h": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for k, s, e, v in found]
            rows.append((n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), hashed))
        return rows

    return work


def scan_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES
) -> DataFrame:
    """One row for every row of docs: doc_id, hash (XXH64 of the text), n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, found.

    `found` holds the spans as structs with kind, start, end, owners and repositories. A null or empty text has none.
    A null owner or repository counts as one of its own. Null ids and repeated rows give a row each, repeated rows with
    equal results; an empty table gives an empty one; other columns are not read. Spans of equal start stand in KINDS'
    order. Only hashes of candidates are shuffled, partly counted before; texts never are.
    """
    df = pick(docs, doc_id=doc_id, text=text, owner=owner, repository=repository).withColumn("hash", F.xxhash64("text"))
    keep = ("doc_id", "hash", "owner", "repository")
    scan = text_map(df, scanner, "n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,start:int,end:int,h:string>>", keep=keep)
    scan = stage(scan.withColumn("row", F.struct("doc_id", "hash")), "secrets")
    each = scan.select("row", "owner", "repository", F.explode("found").alias("x")).select("row", "owner", "repository", "x.*")
    unset = F.lit("\0")
    counts = (
        each.select("h", F.coalesce(F.col("owner").cast("string"), unset).alias("o"), F.coalesce(F.col("repository").cast("string"), unset).alias("r"))
        .groupBy("h", "o", "r").agg(F.lit(1).alias("one"))
        .groupBy("h", "o").agg(F.count("*").alias("r"))
        .groupBy("h").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))
    )
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    kept = (
        each.join(counts, "h").withColumn("live", live)
        .where((F.col("kind") < 6) | F.col("live"))
        .groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias("found"))
    )
    left = scan.drop("found").alias("l")
    joined = left.join(kept.withColumnRenamed("row", "k"), F.col("row").eqNullSafe(F.col("k")), "left")
    names = F.array(*map(F.lit, KINDS))
    some = F.coalesce("found", F.array().cast(kept.schema["found"].dataType))
    return joined.withColumn("found", some).select(
        "doc_id", "hash", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda x: ~x["live"])).cast("long").alias("n_example"),
        "found",
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "<SECRET>", **names: str) -> DataFrame:
    """docs with every base, keyed and live generic secret in `text` replaced by a mark; all columns stay.

    The spans come from scan_secrets, so copied generic examples stay in the text. Null texts stay null; the other cases
    are as in scan_secrets.
    """
    spans = scan_secrets(docs, text=text, **names).where(F.size("found") > 0)
    spans = spans.select(F.col("doc_id").alias("id"), "hash", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
    spans = spans.dropDuplicates(["id", "hash"])
    flat, at = numbered(docs)
    own = at[text]
    out = flat.join(spans, F.col(at[names.get("doc_id", "doc_id")]).eqNullSafe(F.col("id")) & (F.xxhash64(own) == F.col("hash")), "left")
    cut = F.expr(f"""
        aggregate(array_sort(spans), named_struct('at', 0, 'out', cast('' as string)),
          (a, x) -> named_struct(
            'at', greatest(a.at, x.end),
            'out', concat(a.out, if(x.start >= a.at, concat(substring({own}, a.at + 1, x.start - a.at), '{mark}'), ''))),
          a -> concat(a.out, substring({own}, a.at + 1)))""")
    return out.withColumn(own, F.when(F.col("spans").isNull(), F.col(own)).otherwise(cut)).select(*flat.columns).toDF(*docs.columns)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents")).drop("found", "hash")
