"""Read-only SQL by its plan, nested contracts, and inference over streams."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import contract, inference, nested, sql_gate
from millrace.operators.contract import ContractColumn, SchemaMismatch
from millrace.sources import event_records
from millrace.streaming import inference_stream
from millrace.streaming.inference_stream import infer_until_resolved

READS = [
    "select 1 as load, 'drop table x; --' as call",
    "select `copy`, max(n) from gate_view group by 1 having max(n) > 0 order by 1 limit 3;",
    "with a as (select * from gate_view), b as (select * from a) select count(*) from a join b using (n) /* insert */",
    "select n from gate_view where n in (select max(n) from gate_view) union all select id from range(3)",
    "select n, row_number() over w from gate_view window w as (order by n)",
    "select x from gate_view lateral view explode(array(1, 2)) t as x",
    "select * from (values (1), (2)) t(a) where exists (select 1 from gate_view)",
    "explain select * from gate_view",
    "select (select max(n) from gate_view) as import",
]
REFUSED = [
    "drop table gate_view", "insert into gate_view values (1, 'a')", "create table x as select 1", "set spark.sql.shuffle.partitions = 1", "select 1; select 2", "", "  ;", "selec 1",
    "select * from parquet.`/etc`", "select * from default.gate_view", "select * from nowhere", "select reflect('java.lang.System', 'getenv', 'HOME')", "add jar 'x'", "explain drop view gate_view",
    "with a as (select * from nowhere) select * from a", "select n from gate_view where n in (select x from nowhere)", "refresh table gate_view", "cache table gate_view", "use default", "select * from read_files('/etc')",
    "insert overwrite directory '/tmp/x' using parquet select 1", "describe gate_view", "select java_method('java.lang.System', 'exit', 0)",
]


@pytest.fixture
def view(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "n long, copy string").createOrReplaceTempView("gate_view")


@pytest.mark.parametrize("query", READS)
def test_reading_statements(spark, view, query):
    assert sql_gate.read_only(spark, query, 2).count() <= 2


@pytest.mark.parametrize("query", REFUSED)
def test_refused_statements(spark, view, query):
    with pytest.raises(ValueError):
        sql_gate.read_only(spark, query, 2)


# --- nested contracts


def test_outcomes():
    t = nested.type_of
    assert nested.fit(t("void"), t("int")) == "null_only" and nested.fit(t("string"), t("decimal(5,2)")) == "cast"
    assert nested.fit(t("string"), t("date"), formatted=False) == "mismatch" and nested.fit(t("smallint"), t("double")) == "compatible"
    assert nested.fit(t("bigint"), t("int")) == nested.fit(t("decimal(5,2)"), t("decimal(6,2)")) == nested.fit(t("array<int>"), t("int")) == "mismatch"
    deep = nested.compatibility(t("array<struct<a: array<string>, b: int>>"), t("array<struct<a: array<date>, c: int>>"), "x")
    assert [(p, how) for p, _, _, how in deep] == [("x", "compatible"), ("x[]", "compatible"), ("x[].a", "compatible"), ("x[].a[]", "cast"), ("x[].c", "mismatch"), ("x[].b", "mismatch")]


def test_nested_values(spark):
    rows = [(1, [{"p": "1.50", "days": ["2024-02-29", None]}, None]), (2, [{"p": "x", "days": ["2024-02-30", "2024-01-01"]}]), (3, []), (4, None), (5, [{"p": "", "days": None}]), (6, [{"p": None, "days": []}])]
    df = spark.createDataFrame(rows, "id long, items array<struct<p: string, days: array<string>>>")
    c = [ContractColumn("id", "bigint", False), ContractColumn("items", "array<struct<p: decimal(6,2) NOT NULL, days: array<date>>>", False)]
    got = {r.id: (r[contract.ERROR], r["items"]) for r in contract.enforce(df, c).collect()}
    assert got[1][0] is None and got[1][1][0].p == Decimal("1.50") and got[1][1][1] is None and str(got[1][1][0].days[0]) == "2024-02-29"
    assert got[2][0] == "schema: value does not match format 'decimal(6,2)' for 'items[0].p'; schema: value does not match format 'date' for 'items[0].days[0]'"
    assert got[2][1][0].p is None and got[2][1][0].days[0] is None and got[2][1][0].days[1] is not None
    assert got[3] == (None, []) and got[4][0] == "schema: null not allowed in 'items'"
    assert got[5][0] == got[6][0] == "schema: null not allowed in 'items[0].p'"
    good, bad = contract.split(contract.enforce(df, c), "j")
    assert good.count() == 2 and bad.where("_violation_type = 'null_not_allowed'").count() >= 3
    with pytest.raises(SchemaMismatch, match=r"items\[\].q is missing"):
        contract.enforce(df, [c[0], ContractColumn("items", "array<struct<p: string, q: int>>")])


# --- inference over a stream


def test_streamed_inference_stops(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("string").alias("n"), F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("day"), F.lit("word").alias("w"))
    at = str(tmp_path / "in")
    df.repartitionByRange(10, F.col("n").cast("int")).write.parquet(at)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)
    whole = infer_until_resolved(stream(), df.columns, min_rows=10_000, max_rows=None)
    want = sorted(map(tuple, inference.infer(df, df.columns).collect()))
    assert sorted(map(tuple, whole.types.collect())) == want and (whole.rows, whole.stopped) == (1000, "end")
    early = infer_until_resolved(stream(), df.columns, min_rows=1)
    assert early.stopped == "resolved" and 0 < early.rows < 1000 and set(early.resolved_at) == set(df.columns)
    assert {r.name: r.resolved for r in early.types.collect()} == {r.name: r.resolved for r in whole.types.collect()}
    limited = infer_until_resolved(stream(), df.columns, min_rows=10_000, max_rows=250)
    assert limited.stopped == "rows" and 250 <= limited.rows < 1000
    hinted = infer_until_resolved(stream(), ["n"], min_rows=10_000, must_be={"n": "float"})
    assert hinted.types.first().resolved == "float"


def test_a_streamed_file_is_many_tasks_work(spark, tmp_path, monkeypatch):
    """The rows of one file of one row group are dealt over all cores before their values are judged."""
    at, tasks = str(tmp_path / "in"), str(tmp_path / "tasks")
    df = spark.range(2000).select(F.col("id").cast("string").alias("n"))
    df.coalesce(1).write.parquet(at)

    def judged(dealt, columns):
        seen = dealt.withColumn("task", F.spark_partition_id())
        seen.select("task").writeStream.format("parquet").option("checkpointLocation", tasks + "-log").trigger(availableNow=True).start(tasks).awaitTermination()
        return inference.masks(dealt, columns)

    monkeypatch.setattr(inference_stream, "masks", judged)
    found = infer_until_resolved(spark.readStream.schema(df.schema).parquet(at), ["n"], max_rows=None)
    assert found.rows == 2000 and spark.read.parquet(tasks).distinct().count() == spark.sparkContext.defaultParallelism > 1


def test_a_stopped_stream_goes_on(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("n"))
    at, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    df.repartitionByRange(5, F.col("n").cast("int")).write.parquet(at)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)
    first = infer_until_resolved(stream(), ["n"], min_rows=1, max_rows=10, checkpoint=checkpoint)
    then = infer_until_resolved(stream(), ["n"], min_rows=10_000, max_rows=None, checkpoint=checkpoint)
    assert first.rows < 100 and then.rows == 100


def test_deep_user_data(spark):
    """Levels do not end; empty members have no leaf; attributes and texts are leaves whatever they hold."""
    depth = 23
    text = '{"Event":{"System":{},"UserData":{"U":' + '{"n":[7,' * depth + '{"#text":{"a":[1]},"#attributes":{"k":[2]},"e":{},"z":null}' + "]}" * depth + "}}}"
    df = spark.createDataFrame([(1, None, text)], "event_record_id long, timestamp timestamp, record string")
    got = {(r.key.count(".n"), r.key.rpartition(".n")[2], r.idx): r.value_raw for r in event_records.user_data(df).collect()}
    want = {(k, "", 0): "7" for k in range(1, depth + 1)} | {(depth, ".#text", 1): '{"a":[1]}', (depth, ".#attributes.k", 1): "[2]", (depth, ".z", 1): None}
    assert got == want


# --- rows completed beside them


def test_globs_in_parts(spark):
    from millrace.operators.listing import glob_parts, like_of, matching_parts

    cases = {"*.rs": ("rs", None), "**/*.PY": ("py", None), "src/**/*.rs": ("rs", "src/%"), "data/*": (None, "data/%"), "**": (None, None), "name": (None, None), "a_b/100%/*": (None, "a\\_b/100\\%/%"), "x/*.tar/*": (None, "x/%.tar/%"), "**/v?/*.csv": ("csv", "%v_/%")}
    assert {g: glob_parts(g) for g in cases} == cases
    assert like_of("100%_*") == "100\\%\\_%"
    df = spark.createDataFrame([("a_b/100%/x", ""), ("aXb/100%/x", ""), ("a_b/1000/x", "")], "rel_path string, extension string")
    assert [r[0] for r in matching_parts(df, "a_b/100%/*").collect()] == ["a_b/100%/x"]


def test_flexible_tables(spark, tmp_path):
    from millrace.operators.amend import samples_of
    from millrace.sources.lines import read_flexible

    (tmp_path / "a.csv").write_text('id;name\n1;"a;""b"\n2\n3;c;d;"e;f"\n\n4;\n')
    rows = sorted((r.id, r.name, r._rest) for r in read_flexible(spark, str(tmp_path / "a.csv"), ";").collect())
    assert rows == [("1", 'a;"b', None), ("2", None, None), ("3", "c", ["d", "e;f"]), ("4", None, None)]
    df = spark.createDataFrame([("b", None), ("a", ""), ("b", None), ("d", None), ("c", None)], "x string, y string")
    assert [tuple(r) for r in samples_of(df, ["x", "y"]).collect()] == [("x", ["a", "b", "c"])]


def test_contract_changes():
    a = [ContractColumn("x", "int"), ContractColumn("d", "date", True, "%Y")]
    b = [ContractColumn("d", "date", False, "%d"), ContractColumn("y", "int")]
    assert contract.contract_changes(a, b) == [("x", "removed", "int", None), ("d", "nullability", "true", "false"), ("d", "format", "%Y", "%d"), ("y", "added", None, "int")]
    assert contract.contract_changes(a, a) == []
