"""Commits of many tables, shreds of raw lines, and extractors with a deadline."""

import json
import os
import threading
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import manifest, parsers, shred
from millrace.operators.positions import with_group


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_commits(spark, tmp_path):
    root, df = str(tmp_path / "lake"), spark.range(5)
    assert manifest.manifest(spark, root)["version"] == 0 and manifest.versions(spark, root) == []
    assert manifest.commit(spark, root, {"a": (df, "error"), "b": (df.limit(0), "append")}, "j1") == 1
    assert manifest.commit(spark, root, {"a": (df, "append")}, "j2") == 2
    held = manifest.read(spark, root, "a")
    assert manifest.commit(spark, root, {"a": (df.where("id > 3"), "replace"), "b": (df, "append")}, "j3") == 3
    assert ids(held) == sorted([*range(5)] * 2) and ids(manifest.read(spark, root, "a")) == [4] and ids(manifest.read(spark, root, "b")) == list(range(5))
    assert ids(manifest.read(spark, root, "a", 1)) == list(range(5)) and manifest.read(spark, root, "b", 1).count() == 0
    assert manifest.history(spark, root).where("output = 'a'").orderBy("version").select("n_folders").collect() == [(1,), (2,), (1,)]
    for outputs, job, error in (({"a": (df, "error")}, "j4", FileExistsError), ({"a": (df, "append")}, "j3", FileExistsError), ({"a": (df.selectExpr("cast(id as string) id"), "append")}, "j5", ValueError), ({"A": (df, "append")}, "j6", ValueError), ({"a": (df, "upsert")}, "j7", ValueError)):
        with pytest.raises(error):
            manifest.commit(spark, root, outputs, job)
    assert manifest.versions(spark, root) == [1, 2, 3]


def test_a_failed_commit_leaves_nothing(spark, tmp_path):
    root, df = str(tmp_path), spark.range(5)
    manifest.commit(spark, root, {"a": (df, "replace"), "b": (df, "replace")}, "j1")
    before = {t: set(os.listdir(f"{root}/{t}")) for t in "ab"}
    with pytest.raises(Exception):
        manifest.commit(spark, root, {"a": (df.limit(1), "replace"), "b": (df.select(F.raise_error(F.lit("no")).cast("long").alias("id")), "replace")}, "j2")
    with pytest.raises(RuntimeError):
        manifest.commit(spark, root, {"a": (df.limit(1), "replace")}, "j3", may_commit=lambda: False)
    assert {t: set(os.listdir(f"{root}/{t}")) for t in "ab"} == before and ids(manifest.read(spark, root, "a")) == list(range(5))


def test_writers_at_once(spark, tmp_path):
    root, errors = str(tmp_path), []

    def write(k):
        try:
            manifest.commit(spark, root, {"a": (spark.range(k, k + 1), "append")}, f"j{k}")
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and ids(manifest.read(spark, root, "a")) == list(range(6)) and manifest.versions(spark, root) == list(range(1, 7))


def test_formats_and_vacuum(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, t string")
    for k, kind in enumerate(("csv", "json", "parquet")):
        manifest.commit(spark, root, {"t": (df, "replace")}, f"j{k}", kind)
        got = manifest.read(spark, root, "t")
        assert got.schema == df.schema and sorted(map(tuple, got.collect())) == [(1, "a,b"), (2, None)]
    with pytest.raises(ValueError):
        manifest.commit(spark, root, {"t": (df, "replace")}, "j9", "xml")
    assert manifest.vacuum(spark, root, keep=2) == 0  # young folders stay
    assert manifest.vacuum(spark, root, keep=1, grace_ms=0) == 2
    assert manifest.versions(spark, root) == [3] and manifest.read(spark, root, "t").count() == 2


# --- shreds


def test_keys(spark):
    df = spark.createDataFrame([('1,"a;b",c',), ("x",), ('{"e":{"t":"a"},"n":null}',), ("t=q z",)], "line string")
    c = F.col("line")
    assert [r[0] for r in df.select(shred.csv_key(c, 1)).collect()][:2] == ["a;b", None]
    assert df.select(shred.csv_key(F.lit("a|b||c"), 3, "|"), shred.csv_key(F.lit("a|b||c"), 2, "|")).first() == ("c", None)
    assert [r[0] for r in df.select(shred.json_key(c, "e.t")).collect()] == [None, None, "a", None]
    assert [r[0] for r in df.select(shred.regex_key(c, r"(x|t)=(?P<k>\w*)(?<=q)", "k")).collect()] == [None, None, None, "q"]


@pytest.mark.parametrize("limit", [40, 100, 1000])
def test_line_files(spark, tmp_path, limit):
    """A hot shard, tiny ones, odd names, empty and null lines, and lines longer than a file."""
    lines = [(k, "hot," + "x" * (k % 17)) for k in range(400)] + [(1000, "a/b,1"), (1001, "cold,é"), (1002, "cold,"), (1003, None), (1004, ""), (1005, "hot," + "y" * 60), (1006, "big," + "z" * 500)]
    df = spark.createDataFrame(lines, "n int, line string").repartition(4)
    header = "h1,h2"
    sharded = shred.shred_lines(df, "line", "csv", top=9, promotion=1, index=0)
    made = shred.write_line_files(sharded, str(tmp_path), "line", ["n"], limit, header).collect()
    got = defaultdict(list)
    for folder, _, names in os.walk(tmp_path):
        for name in sorted(names):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                text = f.read()
            first, *rest = text.split("\n")[:-1]
            assert first == header and (len(text.encode()) <= limit or len(rest) == 1)
            got[os.path.relpath(folder, tmp_path).removeprefix("shard=")] += rest
    want = defaultdict(list)
    for _, line in sorted(lines):
        key = (line or "").split(",")[0]
        want[{"": "_MISC", "a/b": "a%2Fb"}.get(key, key)].append(line or "")
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert [x for x in got["hot"] if len(x) < 12] == [x for x in want["hot"] if len(x) < 12]  # in order
    assert sum(r.n_lines for r in made) == len(lines)
    assert len([r for r in made if r.shard == "hot"]) >= 5000 // limit


def test_headers_and_strategies(spark):
    df = spark.createDataFrame([(0, "id,kind"), (1, "1,a"), (2, "2,b")], "n int, line string")
    assert shred.shred_lines(df, "line", "csv", has_header=True, order=["n"], index=1).count() == 2
    assert [r.shard for r in shred.shred_lines(df, "line", "passthrough").select("shard").distinct().collect()] == [shred.REST]
    with pytest.raises(ValueError):
        shred.shred_lines(df, "line", "xml")


def test_with_group(spark):
    df = spark.createDataFrame([(None, k) for k in range(300)] + [("a", 1), ("b", 5), ("b", 3)], "k string, v long")
    got = with_group(df, ["k"], {"least": F.min("v"), "n": F.count(F.lit(1))}).collect()
    assert len(got) == 303 and {(r.k, r.least, r.n) for r in got} == {(None, 0, 300), ("a", 1, 1), ("b", 3, 2)}


# --- deadlines


def odd(path, content):
    if content == b"hang":
        time.sleep(60)
    if content == b"crash":
        os.kill(os.getpid(), 9)
    if content == b"raise":
        raise KeyError("x")
    return {"n": len(content)}


def test_deadlines(spark):
    texts = ["a", "hang", "bb", "crash", "ccc", "raise", None, "hang", ""]
    df = spark.createDataFrame([(str(k), None if t is None else bytearray(t.encode())) for k, t in enumerate(texts)], "path string, content binary").coalesce(1)
    began = time.time()
    got = {int(r.path): (r.status, json.loads(r.metadata)["n"] if r.metadata else None, r.error) for r in parsers.extract(df, odd, 1.0).collect()}
    assert time.time() - began < 30
    assert [got[k][0] for k in range(9)] == ["ok", "timeout", "ok", "crash", "ok", "error", "ok", "timeout", "ok"]
    assert [got[k][1] for k in (0, 2, 4, 6, 8)] == [1, 2, 3, 0, 0] and got[3][2] == "exit code -9" and got[1][2] == "no answer within 1 s"


def test_streamed_outputs_appear_together(spark, tmp_path):
    from millrace.operators.contract import ContractColumn
    from millrace.streaming.contract_stream import KEPT, done_batches, run_available, visible

    src, out = spark.createDataFrame([(1, "1.5"), (2, "x")], "id long, amount string"), f"{tmp_path}/out"
    columns = [ContractColumn("id", "bigint", False), ContractColumn("amount", "decimal(5,1)", False)]
    run = lambda: run_available(spark, f"{tmp_path}/in", src.schema, columns, ["id", "amount"], out, "j")
    for k in range(KEPT + 2):
        src.write.mode("append").parquet(f"{tmp_path}/in")
        valid, bad = run()
        assert (valid.count(), bad.count()) == (k + 1, k + 1)
    assert done_batches(spark, out) == list(range(2, KEPT + 2))
    src.write.parquet(f"{out}/valid/batch=99")  # half of a batch that broke off
    assert [df.count() for df in visible(spark, out)] == [KEPT + 2, KEPT + 2]
