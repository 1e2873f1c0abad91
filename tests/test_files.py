"""Walks, file generations, positions, budgets and life cycles on small inputs."""

import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import lifecycle, positions
from millrace.sources import walk as walks
from millrace.sources.walk import WalkOptions, walk, write_files
from millrace.streaming.generation_stream import process_generations


def put(root, name, text, at=1_600_000_000):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    os.utime(path, (at, at))


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "tree")
    for k in range(40):
        put(root, f"{k % 4}/{k % 3}/f{k}.csv", "x" * k)
    for name in (".hidden/a.txt", "b/.b.txt", "node_modules/c.js", "deep/1/2/3/4/5/d.txt", "cloud/drive/e.txt", "noext"):
        put(root, name, name)
    os.symlink(root, f"{root}/0/loop")
    os.symlink(f"{root}/deep", f"{root}/1/again")
    os.symlink(f"{root}/gone", f"{root}/dangling")
    return root


def plain(root, **options):
    """What os.walk finds, with the same options."""
    o, out = WalkOptions(**options), {}

    def below(folder, depth, above):
        for x in os.scandir(folder):
            if (x.is_symlink() and not o.follow) or not os.path.exists(x.path) or not o.wanted(x.name, x.path, x.is_dir()):
                continue
            if x.is_dir():
                if (o.max_depth is None or depth < o.max_depth) and os.path.realpath(x.path) not in above:
                    below(x.path, depth + 1, [*above, os.path.realpath(x.path)])
            else:
                out[os.path.relpath(x.path, root)] = (x.stat().st_size, depth)

    below(root, 1, [os.path.realpath(root)])
    return out


@pytest.mark.parametrize("options", [{}, {"hidden": False}, {"follow": True}, {"max_depth": 1}, {"max_depth": 3}, {"skip_folders": (), "skip_paths": ("cloud/drive",)}])
@pytest.mark.parametrize("budget", [1, 7, 100_000])
def test_walk(spark, tree, options, budget):
    files, errors = walk(spark, tree, WalkOptions(**options), budget)
    assert {r.rel_path: (r.size, r.depth) for r in files.collect()} == plain(tree, **options)
    found = {r.error if r.error == "loop" else "other" for r in errors.collect()}
    assert found == ({"loop", "other"} if options.get("follow") else set())


def test_walk_of_no_folder(spark, tmp_path):
    files, errors = walk(spark, str(tmp_path / "none"))
    assert files.count() == 0 and errors.count() == 1
    os.makedirs(tmp_path / "empty")
    assert [df.count() for df in walk(spark, str(tmp_path / "empty"))] == [0, 0]


def test_links_to_one_file_share_an_identity(spark, tree):
    files = walk(spark, tree, WalkOptions(follow=True))[0].where("name = 'd.txt'")
    assert sorted(r.rel_path for r in files.collect()) == ["1/again/1/2/3/4/5/d.txt", "deep/1/2/3/4/5/d.txt"]
    assert files.select("uid").distinct().count() == 1


def test_a_scan_sees_changes_and_deletions(spark, tree):
    from millrace.operators.catalog import diff

    before = walk(spark, tree)[0].select("rel_path", "size", "mtime")
    before.collect()
    put(tree, "0/0/f0.csv", "other", 1_600_000_100)
    put(tree, "new.csv", "")
    os.remove(f"{tree}/1/1/f1.csv")
    states = {r.rel_path: r.state for r in diff(before, walk(spark, tree)[0].select("rel_path", "size", "mtime"), ["rel_path"], ["size", "mtime"]).where("state <> 'unchanged'").collect()}
    assert states == {"0/0/f0.csv": "changed", "new.csv": "new", "1/1/f1.csv": "deleted"}


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", "é", 5000), ("a/c.txt", None, None)], "rel_path string, content string, at long")
    assert sorted(map(tuple, write_files(df, str(tmp_path), mtime="at").collect())) == [("a/b.txt", 2), ("a/c.txt", 0)]
    assert os.stat(tmp_path / "a/b.txt").st_mtime == 5 and sorted(os.listdir(tmp_path / "a")) == ["b.txt", "c.txt"]


# --- generations


def lines_of(df):
    return df.select("path", "mtime", "line")


def seen(df):
    return sorted((os.path.basename(r.path), r.mtime // 1000, r.line) for r in df.collect())


def test_a_generation_comes_once(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(root, "x/a.txt", "1\n2\n", 1_600_000_000)
    put(root, "b.txt", "3", 1_600_000_010)
    put(root, "e.txt", "", 1_600_000_010)
    run = lambda parser="1": process_generations(spark, root, lines_of, out, parser, "t")
    first = [("a.txt", 1_600_000_000, "1"), ("a.txt", 1_600_000_000, "2"), ("b.txt", 1_600_000_010, "3")]
    assert seen(run()) == first
    assert seen(run()) == first
    put(root, "x/a.txt", "4", 1_600_000_020)  # written anew
    put(root, "c.txt", "5", 1_500_000_000)  # moved in with its old time
    both = sorted([*first, ("a.txt", 1_600_000_020, "4"), ("c.txt", 1_500_000_000, "5")])
    assert seen(run()) == both
    put(root, "b.txt", "33", 1_600_000_010)  # another size at the same time
    both = sorted([*both, ("b.txt", 1_600_000_010, "33")])
    assert seen(run()) == both
    assert len(seen(run("2"))) == len(both) + 3  # another parser takes what is there
    assert len(seen(run())) == len(both) + 3


def test_a_failed_batch_is_done_again(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(5):
        put(root, f"{k}.txt", str(k))

    def fails(df):
        raise RuntimeError("no")

    with pytest.raises(Exception):
        process_generations(spark, root, fails, out, "1", "t")
    assert len(seen(process_generations(spark, root, lines_of, out, "1", "t"))) == 5


def test_a_file_still_being_written_waits(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(root, "old.txt", "1")
    put(root, "now.txt", "2", time.time())
    run = lambda settle: process_generations(spark, root, lines_of, out, "1", "t", {"settle_ms": settle})
    assert [x[0] for x in seen(run("60000"))] == ["old.txt"]
    assert [x[0] for x in seen(run("0"))] == ["now.txt", "old.txt"]


# --- positions


def test_positions_of_ties(spark):
    """Nine rows in ten have one key; it is cut into ranges as any other."""
    df = spark.range(2000).select(F.when(F.col("id") % 10 > 0, 5).otherwise(F.col("id")).alias("k"), "id")
    rows, parts = positions.ranged(df, ["k"], ranges=8)
    assert max(n for _, n, _ in parts) < 3 * 2000 / len(parts)
    out = positions.with_positions(df, ["k"], running="sum", weight=F.col("id"), ranges=8).orderBy("position").collect()
    assert [r.position for r in out] == list(range(2000)) and [r.k for r in out] == sorted(r.k for r in out)
    total = 0
    for r in out:
        total += r.id
        assert r["sum"] == total


def test_budgets(spark):
    texts = ["aaa", None, "é", "bbbb", "", "cc"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    give = lambda n, b: [(r.k, r.truncated) for r in positions.budgeted(df, ["k"], n, b, F.octet_length("t")).orderBy("k").collect()]
    assert give(10, 100) == [(k, False) for k in range(6)]
    assert give(10, 11) == [(k, False) for k in range(6)]
    assert give(2, 100) == [(0, True), (1, True)]
    assert give(10, 9) == [(k, True) for k in range(5)]
    assert give(10, 2) == give(0, 5) == []
    assert positions.budgeted(df.limit(0), ["k"], 5, 5).count() == 0
    with pytest.raises(ValueError):
        positions.budgeted(df, ["k"], -1, 5)


def test_texts_within_bytes(spark):
    from millrace.functions.text import within_bytes

    texts = ["", "abc", "aé", "é" * 5, "漢字", "😀😀", None, "a😀b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in range(9):
        want = [None if t is None else next(t[:i] for i in range(len(t), -1, -1) if len(t[:i].encode()) <= most) for t in texts]
        assert [r[0] for r in df.select(within_bytes(F.col("t"), most)).collect()] == want, most


def test_pages(spark):
    df = spark.range(25)
    got = [[(r.id, r.position, r.next_cursor) for r in positions.page(df, ["id"], s, 10).orderBy("id").collect()] for s in (0, 10, 20, 30)]
    assert got == [[(k, k, 10) for k in range(10)], [(k, k, 20) for k in range(10, 20)], [(k, k, None) for k in range(20, 25)], []]
    assert positions.page(df.limit(0), ["id"], 0, 10).count() == 0


# --- life cycle


def simulate(log):
    state, n, bad = {}, {}, {}
    for f, at, s in log:
        before = state.setdefault(f, "pending")
        n[f] = n.get(f, 0) + 1
        to = (s or "").lower()
        if to in lifecycle.STATES and (to == before or to in lifecycle.MOVES[before]):
            state[f] = to
        else:
            bad.setdefault(f, []).append((at, before, s))
    return {f: (state[f], n[f], len(bad.get(f, []))) for f in state}, {(f, *x) for f, xs in bad.items() for x in xs}


@pytest.mark.parametrize("block", [2, 5, 256])
def test_life_cycle(spark, block):
    rng = random.Random(1)
    names = [*lifecycle.STATES, "QUEUED", "odd", None]
    log = [(rng.choice(["hot", "hot", "a", "b", None]), k, rng.choice(names)) for k in range(400)]
    want, moves = simulate(log)
    df = spark.createDataFrame(rng.sample(log, len(log)), "f string, at long, status string").repartition(3)
    got = {r.f: (r.status, r.n_changes, r.n_illegal) for r in lifecycle.final_states(df, "f", ["at"], block=block).collect()}
    assert got == want
    assert {(r.f, r.at, r.from_status, r.status) for r in lifecycle.illegal_moves(df, "f", ["at"], block=block).collect()} == moves


def test_life_cycle_of_nothing(spark):
    df = spark.createDataFrame([], "f string, at long, status string")
    assert lifecycle.final_states(df, "f", ["at"]).count() == lifecycle.illegal_moves(df, "f", ["at"]).count() == 0


def test_walk_while_files_come(spark, tmp_path):
    """Files that come and go while the walk runs do not make it fail."""
    root, stop = str(tmp_path), threading.Event()

    def churn():
        k = 0
        while not stop.is_set():
            put(root, f"c/{k % 20}.txt", "x")
            if k % 3 == 0:
                os.remove(f"{root}/c/{k % 20}.txt")
            k += 1

    put(root, "stays.txt", "x")
    t = threading.Thread(target=churn)
    t.start()
    try:
        names = [r.name for r in walk(spark, root)[0].collect()]
    finally:
        stop.set()
        t.join()
    assert "stays.txt" in names and walks.BUDGET > 0
