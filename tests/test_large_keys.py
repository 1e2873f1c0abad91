"""Queries against their SQL on keys that the smallest tables do not have."""

import datetime

import duckdb
import pytest

from millrace.plans.registry import ORACLE_SQL, QUERIES
from millrace.sources import lines
from tests.test_queries import rows

ODD = (1, 7, 10, 99, 1899, 1900, 1950, 2100, 2101, 15000, 18991231, 19000101, 20240229, 21009999, 21010000, 123456789)


@pytest.mark.parametrize("name", ["rule_candidates", "patterns_of_paths"])
def test_keys_that_look_like_dates(spark, tmp_path, name):
    """A client's or a sum's number of four or eight digits may be a date."""
    day = datetime.datetime(1995, 3, 4)
    spark.createDataFrame([(max(s - 10, 1), c, day) for s in ODD for c in ODD], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert rows([tuple(r) for r in got.collect()], [got.columns.index(n) for n in names]) == rows(cur.fetchall(), range(len(names)))


def test_schema_of_many_json_files(spark, tmp_path):
    """Many files of arrays over many lines are inferred by several tasks, as Spark's own inference would have it; nulls, other encodings, empty and broken files too."""
    for k in range(200):
        (tmp_path / f"{k}.json").write_text(f'[{{"a": {k},\n "b": "x"}},\n {{"a": null, "c": {{"d": [{k}.5]}}}}]')
    (tmp_path / "wide.json").write_bytes('{"e":\n "ä"}'.encode("utf-16-le"))
    (tmp_path / "bom.json").write_bytes('{"f":\n 12345678901234567890}'.encode("utf-8-sig"))
    (tmp_path / "none.json").write_bytes(b"")
    (tmp_path / "bad.json").write_text('{"g": ')
    spark.sparkContext.setJobGroup("many-json", "")
    got = lines.read_table(spark, str(tmp_path), "json")
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("many-json") for s in tracker.getJobInfo(j).stageIds]
    assert max(tasks) > 1
    own = spark.read.json(str(tmp_path), multiLine=True)
    assert got.schema == own.schema and {"a", "c", "e", "f"} <= set(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, own.collect()))
