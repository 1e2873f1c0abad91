"""Variant pairs by probing one place against all pairs by brute force, and many templates of one initial string."""

import itertools
import random
import time

from pyspark.sql import functions as F

from millrace.functions.text import GUID
from millrace.operators import path_groups, structure
from millrace.operators.path_groups import candidate_pairs, fuzzy, signatures


def test_no_pair_is_lost(spark):
    """All pairs that agree in BLOCK and whose literals may be spellings of one at every place are candidates."""
    rng = random.Random(9)
    words = ["mission", "msn", "mis", "missions", "mi", "m", "flight", "flt", "fligt", "flgt", "fl", "flights", "data", "dat", "dta", "daat", "date", "config", "confg", "cfg", "cnfig", "configs"]
    paths = {"/".join([rng.choice(words) for _ in range(rng.choice([1, 2, 3]))] + rng.choice([[], [str(rng.randrange(100, 999))]])) + f"/f_{rng.randrange(100, 999)}.{rng.choice(['csv', 'json'])}" for _ in range(260)}
    own = signatures(spark.createDataFrame([(p,) for p in paths], "rel_path string"))
    rows = own.collect()
    got = {(r.a, r.b) for r in candidate_pairs(own).collect()}
    block = lambda r: tuple(r[k] for k in path_groups.BLOCK)
    asked = [(a, b) for a, b in itertools.permutations(rows, 2) if a.template < b.template and block(a) == block(b)]
    pairs = spark.createDataFrame([(a.template, b.template, x, y) for a, b in asked for x, y in zip(a.literals[: a.n_literal], b.literals[: b.n_literal])], "a string, b string, x string, y string")
    ok = pairs.groupBy("a", "b").agg(F.bool_and((F.col("x") == F.col("y")) | fuzzy(F.col("x"), F.col("y"))).alias("ok")).where("ok")
    want = {(r.a, r.b) for r in ok.collect()} | {(a.template, b.template) for a, b in asked if a.n_literal == 0}
    assert len(want) > 50 and want <= got and len(got) < len(asked)


def test_many_templates_of_one_initial_string(spark):
    """A hundred thousand templates with the same initials: a thousand words at one place, a hundred at the next."""
    rng = random.Random(2)
    word = lambda first: first + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    left, right = [word("m") for _ in range(1000)], [word("f") for _ in range(100)]
    a = spark.createDataFrame([(w,) for w in left], "a string")
    b = spark.createDataFrame([(w,) for w in right], "b string")
    paths = a.crossJoin(b).select(F.concat_ws("/", "a", "b", F.lit("x.csv")).alias("rel_path")).union(spark.createDataFrame([(f"msn/{right[0]}/x.csv",)], "rel_path string"))
    own = path_groups.staged(signatures(paths), "own")
    began = time.time()
    assert own.count() == 100_001
    pairs = candidate_pairs(own).count()
    assert pairs < 11_000_000 and time.time() - began < 240


def test_kinds_of_a_path_are_found_once(spark):
    """However many parts a path has, the plan asks for their kinds in one place; fields are numbered within their kind."""
    df = spark.createDataFrame([("2024-01-02/" + "/".join(f"a{k}_{10 + k}.x" for k in range(40)),)], "p string").select(structure.pattern_of(F.col("p")).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(GUID) == 1
    assert df.first().p == "<date:date>/" + "/".join(f"a{k}_<number{'' if not k else f'_{k + 1}'}:int>.x" for k in range(40))
