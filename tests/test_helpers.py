"""Driver-side helpers of contracts, sinks, values and backtests."""

import glob

import pytest
from pyspark.sql import functions as F

from millrace.functions import text, values
from millrace.operators import backtest, catalog, contract, listing, paths, samples, sinks, sql_gate, structure
from millrace.operators.contract import ContractColumn, SchemaMismatch

COLUMNS = [ContractColumn("a", "bigint", False), ContractColumn("b", "date", True, "%Y-%m-%d")]


def test_contracts_are_locked_and_approved():
    one, digest = contract.lock(COLUMNS)
    assert contract.lock(list(COLUMNS)) == (one, digest) and len(digest) == 64
    assert contract.lock(COLUMNS[::-1])[1] != digest
    assert [c.name for c in contract.approve(COLUMNS, {"a": "x"})] == ["x", "b"]
    for bad in ([], [COLUMNS[0], COLUMNS[0]]):
        with pytest.raises(SchemaMismatch):
            contract.lock(bad)
    with pytest.raises(SchemaMismatch):
        contract.approve(COLUMNS, {"a": "b"})
    nested = [ContractColumn("l", "array<int>")]
    with pytest.raises(SchemaMismatch):
        contract.approve(nested)
    assert contract.approve(nested, nested=True) == nested
    assert contract.override("s", {"s": nested}, COLUMNS) == nested and contract.override("t", {"s": nested}, COLUMNS) == COLUMNS


def test_sinks_are_routed():
    assert sinks.route("a", {"a": "1", "*": "2"}) == "1"
    assert sinks.route("b", {"a": "1", "*": "2"}) == "2"
    assert sinks.route("b", {"a": "1", "output": "3"}) == "3"
    assert sinks.route("b", {"a": "1"}) == "1"
    with pytest.raises(KeyError):
        sinks.route("b", {"a": "1", "c": "2"})
    assert sinks.quarantine_sink("a", "parquet://x") == ("a_quarantine", "parquet://x")
    assert sinks.quarantine_sink("a", "table://x", "csv://q") == ("a_quarantine", "csv://q")
    with pytest.raises(ValueError):
        sinks.quarantine_sink("a", "parquet://x", "table://q")
    with pytest.raises(ValueError):
        sql_gate.read_only(None, "select 1; install httpfs", 1)


def test_writes_are_taken_back(spark, tmp_path):
    df = spark.range(10)
    root = str(tmp_path)
    at = sinks.write_all({"good": df, "bad": df.limit(0)}, root, "j1")
    assert spark.read.parquet(at["good"]).count() == 10
    bad = df.select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception):
        sinks.write_all({"good": df, "worse": bad}, root, "j2")
    with pytest.raises(RuntimeError):
        sinks.write_all({"good": df}, root, "j3", may_commit=lambda: False)
    with pytest.raises(FileExistsError):
        sinks.write_all({"good": df}, root, "j1")
    assert [p.rsplit("/", 1)[1] for p in glob.glob(f"{root}/good/*")] == ["job=j1"]
    assert spark.read.parquet(at["good"]).count() == 10


def test_values():
    assert values.same_zone("UTC", "etc/gmt") and values.same_zone("Europe/Paris", "europe/paris") and not values.same_zone("UTC", "Europe/Paris")
    assert [values.iso_duration_ms(t) for t in ("P2D", "PT3H", "PT4M", "PT5S")] == [172_800_000, 10_800_000, 240_000, 5_000]
    for bad in ("P", "PT", "P1H", "PT1D", "1D", "PT1H2M"):
        with pytest.raises(ValueError):
            values.iso_duration_ms(bad)
    assert values.logical_date_ms("1970-01-02") == values.logical_date_ms("1970-01-02T01:00:00+01:00") == 86_400_000
    assert values.sensitive(["Email", "qty", "user_password", "apiKey"]) == ["Email", "user_password", "apiKey"]


def test_hex_and_slugs(spark):
    df = spark.createDataFrame([("0x7FFFFFFFFFFFFFFF",), ("0x8000000000000000",), ("0x0000000000000000000A",), ("0x",)], "v string")
    assert [r.t for r in df.select(text.value_type(F.col("v")).alias("t")).collect()] == ["hex", "string", "hex", "string"]
    names = spark.createDataFrame([("--",), ("É Ab",), ("ok_1",)], "v string").select(text.safe_name(F.col("v")).alias("n")).collect()
    assert names[0].n.startswith("output_") and names[1].n.startswith("ab_") and names[2].n == "ok_1"


def test_stop_reasons():
    assert backtest.stop_reason([], 0) is None and backtest.stop_reason([0.5], 0) is None
    assert backtest.stop_reason([0.1, 0.96], 999) == "pass_rate_achieved"
    assert backtest.stop_reason([0.1 * i / 10 for i in range(10)], 0) == "max_iterations"
    assert backtest.stop_reason([0.1], 300) == "timeout"
    assert backtest.stop_reason([0.5, 0.5, 0.505], 1) == "plateau" and backtest.stop_reason([0.5, 0.5, 0.52], 1) is None


def test_headers(spark):
    rows = spark.createDataFrame([(["id", "name"],), (["1", "2"],), (["a", ""],), (["nan", "x"],)], "c array<string>")
    got = [r.n for r in rows.select(samples.column_names(F.col("c")).alias("n")).collect()]
    assert got == [["id", "name"], ["column_1", "column_2"], ["column_1", "column_2"], ["nan", "x"]]


def test_row_numbers_fall_back(spark):
    bad = spark.createDataFrame([(0, 5), (1, None)], "at long, __cf_row_id long")
    assert [(r._source_row, r._output_row_index) for r in contract.with_row_numbers(bad, "at").orderBy("at").collect()] == [(None, 0), (None, 1)]
    assert [(r._source_row, r._output_row_index) for r in contract.with_row_numbers(bad.where("at = 0"), "at").collect()] == [(5, None)]
    assert contract.with_row_numbers(bad.drop("__cf_row_id"), "at").count() == 2


def test_pages_end(spark):
    df = spark.range(25).withColumnRenamed("id", "file_id")
    last = listing.page(df, ["file_id"], 20, 10).collect()
    assert [r.file_id for r in last] == list(range(20, 25)) and {r.next_cursor for r in last} == {None}
    assert listing.page(df, ["file_id"], 30, 10).count() == 0


def test_excluded_substrings(spark):
    df = spark.createDataFrame([("a/.git/x",), ("a/b.tmp/x",), ("a/x",)], "rel_path string")
    assert [r.rel_path for r in catalog.without_excluded(df, substrings=("b.tmp",)).collect()] == ["a/x"]


def test_patterns_fit_their_paths(spark):
    rows = [("m_042/2024-01-05/x_12.csv",), ("a/20240105_101112/b-0a1b2c3d4e.log",)]
    got = [r.p for r in spark.createDataFrame(rows, "p string").select(structure.pattern_of(F.col("p")).alias("p")).collect()]
    assert got == ["m_<number:int>/<date:date>/x_<number_2:int>.csv", "a/<datetime>/b-<hex>.log"]
    for pattern, (path,) in zip(got, rows):
        regex, names = paths.placeholder_regex(pattern)
        import re

        assert re.fullmatch(regex.removeprefix("(?i)"), path, re.I), (regex, path)


def test_records_longer_than_their_columns(spark):
    from millrace.sources import lines

    rows = ['1,A:,x,"y, ""z""",w', ",B", "1,,c", "2,C,", ""]
    got = lines.record_types(spark.createDataFrame([(r,) for r in rows], "line string"), "line", [], 3, rest="rest").collect()
    assert [tuple(r) for r in got] == [("A", "1", "A:", "x", ['y, "z"', "w"]), ("B", None, "B", None, []), ("C", "2", "C", None, [])]


def test_table_modes(spark):
    import uuid

    name, df = f"modes_{uuid.uuid4().hex[:8]}", spark.range(3)
    try:
        sinks.write(df, f"table://{name}", "error")
        sinks.write(df, f"table://{name}", "append")
        assert spark.table(name).count() == 6
        with pytest.raises(Exception, match="already exists"):
            sinks.write(df, f"table://{name}", "error")
        sinks.write(df, f"table://{name}", "replace")
        assert spark.table(name).count() == 3
        with pytest.raises(ValueError):
            sinks.write(df, "parquet:///tmp/x", "replace")
    finally:
        spark.sql(f"drop table if exists {name}")
