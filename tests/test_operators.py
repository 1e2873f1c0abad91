"""Golden cases and invariants of the ingestion operators."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions import text
from millrace.operators import amend, backtest, catalog, contract, inference, parsers, path_groups, paths, sinks, sql_gate
from millrace.operators.contract import ContractColumn
from millrace.sources import event_records, fix_outputs, lines
from millrace.streaming.contract_stream import run_available

LIFECYCLE = [
    ("8=FIX.4.4|35=D|34=1|11=A|38=100.12345678905|10=0|", ["new_order"]),
    ("8=FIX.4.4|35=8|150=0|39=0|", ["ack"]),
    ("2024 INFO 8=FIX.4.4\x0135=8\x01150=1\x018=FIX.4.4\x0135=8\x01150=2\x01", ["partial_fill", "fill"]),
    ("8=FIX.4.4 35=F 11=B 10=0", ["cancel_request"]),
    ("8=FIX.4.4^A35=8^A150=4^A", ["cancel"]),
    ("8=FIX.4.4|35=8|150=A|39=8|", ["reject"]),
    ("8=FIX.4.4|35=A|", [None]),
    ("# nothing here", []),
]


def test_fix(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LIFECYCLE)], "line_number long, line string")
    got = fix_outputs.typed_messages(df).orderBy("line_number", "message_index").collect()
    assert [(r.line_number, r.lifecycle_event) for r in got] == [(i, e) for i, (_, es) in enumerate(LIFECYCLE) for e in es]
    assert str(got[0].order_qty) == "100.1234567891"
    assert {r.kind for r in got if r.msg_type == "A"} == {"session"}


def test_strict_decimal(spark):
    cases = {"1.5": "1.50", "-.5": "-0.50", "+12.": "12.00", "1.005": None, "1e3": None, " 1": None, "0001.10": None, "abc": None, "": None, ".": None, "999.99": "999.99"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.strict_decimal(F.col("v"), 5, 2).cast("string").alias("d"))
    assert {r.v: r.d for r in df.collect()} == cases


def test_contract_splits(spark):
    df = spark.createDataFrame([("1", "2024-02-29", "a"), ("x", "2024-02-30", None), ("", "", "b")], "amount string, day string, name string")
    columns = [ContractColumn("amount", "decimal(5,1)"), ContractColumn("day", "date", False, "%Y-%m-%d"), ContractColumn("name", "string", False)]
    out = contract.enforce(df, columns)
    valid, bad = contract.split(out, "j")
    assert valid.count() + bad.count() == 3 and valid.count() == 1
    assert [r._cf_row_error for r in bad.orderBy(F.length("_cf_row_error").desc()).collect()][0] == (
        "schema: value does not match format 'decimal(5,1)' for 'amount'; schema: value does not match format '%Y-%m-%d' for 'day'; schema: null not allowed in 'day'; schema: null not allowed in 'name'"
    )
    with pytest.raises(contract.SchemaMismatch):
        contract.enforce(df.drop("day"), columns)
    with pytest.raises(ValueError):
        contract.with_lineage(contract.with_lineage(valid, F.lit("h"), "j", "1"), F.lit("h"), "j", "1")


def test_value_types(spark):
    cases = {"": "empty", " TRUE ": "bool", "0xFF": "hex", "-12": "int", "2024-01-01T00:00:00Z": "timestamp", "PT5M": "duration", "S-1-5-18": "sid", "123e4567-e89b-12d3-a456-426614174000": "guid", "word": "string"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.value_type(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == cases


def test_path_templates(spark):
    cases = {"in/2024-01-15/File_001.csv": "in/<date>/file_<n>_csv", "a/20240115_120000/x": "a/<datetime>/x", "v1/ab12/2024": "v1/<code>/<date>", "Plain/Name.TXT": "plain/name.txt", "h/deadbeef99/1": "h/<hex>/1"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.path_template(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == cases


def test_globs(spark):
    df = spark.createDataFrame([("a/b/c.CSV",), ("c.csv",), ("a/x.txt",)], "rel_path string")
    n = lambda *g: df.where(catalog.any_glob(F.col("rel_path"), g)).count()
    assert (n("*.csv"), n("a/*"), n("**/*"), n(""), n("a/**/c.csv"), n("?.csv")) == (2, 1, 3, 3, 1, 2)


def test_inference(spark):
    df = spark.createDataFrame([("1", "31/05/24", "12:30", "1h", "true"), ("0", "01/02/24", "NA", "2 days", "no"), ("", None, "3:5", "PT5M", "y")], "bits string, day string, at string, took string, flag string")
    got = {r.name: (r.resolved, r.date_formats) for r in inference.infer(df, df.columns).collect()}
    assert got["bits"][0] == "ambiguous" and got["day"] == ("date", "%d/%m/%y,%y/%m/%d") and got["at"][0] == "time" and got["took"][0] == "duration" and got["flag"][0] == "boolean"


def test_inference_hints(spark):
    df = spark.createDataFrame([("1", "240115"), ("0", "991231")], "bits string, day string")
    at = lambda **h: {r.name: r.resolved for r in inference.infer(df, df.columns, **h).collect()}
    assert at() == {"bits": "ambiguous", "day": "ambiguous"}
    assert at(cannot_be={"bits": ("boolean",)}, must_be={"day": "date"}) == {"bits": "integer", "day": "date"}
    with pytest.raises(ValueError):
        at(cannot_be={"bits": ("money",)})


def test_second_run_finds_nothing(spark):
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None)], "file_id long, key string")
    assert {r.file_id for r in catalog.to_process(wanted, wanted.where("key = 'a'")).collect()} == {1, 2, 3}
    assert {r.file_id for r in catalog.to_process(wanted, wanted.where("key is not null")).collect()} == {3}


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumn("k", F.col("id") % 2)
    done = sinks.write_all({"good": df, "bad": df.limit(0)}, str(tmp_path), "j1")
    assert spark.read.parquet(done["good"]).count() == 5
    with pytest.raises(ValueError):
        sinks.write(df, f"csv://{tmp_path}/x", "replace")
    with pytest.raises(ValueError):
        sql_gate.read_only(spark, "drop table x", 1)
    assert sql_gate.read_only(spark, "select 1 as a", 5).count() == 1
    assert sinks.format_of("file://a/b.csv") == ("csv", "a/b.csv")
    assert lines.files(spark, str(tmp_path)).where("size > 0").count() > 0


def test_formats(spark):
    cases = {"PAR1xx": "parquet", '{"a":1}\n{"a":2}': "ndjson", '[{"a":1}]': "json", "a,b\n1,2": "csv", "a\tb\n1\t2": "tsv", "plain": "text"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", lines.detect_format(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == cases


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([(1, "1.5"), (2, "x"), (3, None)], "id long, amount string")
    src.repartition(3).write.parquet(f"{tmp_path}/in")
    columns = [ContractColumn("id", "bigint", False), ContractColumn("amount", "decimal(5,1)", False)]
    for _ in range(2):  # the second run finds no new file
        valid, bad = run_available(spark, f"{tmp_path}/in", src.schema, columns, ["id", "amount"], f"{tmp_path}/out", "j")
        assert (valid.count(), bad.count()) == (1, 2)


def test_concentration(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "k string")
    assert paths.concentration(df, "k").first()["concentration"] == 0.0


def test_fix_outputs(spark):
    rows = [
        "8=FIX.4.4|9=100|35=D|34=2|52=20240102-09:30:00.123|11=A|38=100.12345678905|44=1e2|10=0|", "x=1 comment 8=)", "# 8=FIX mention", "8=FIX.4.4|35=A|34=1|52=20240102-09:30:00|",
        "8=FIX.4.4|35=8|38=abc|44=9999999999999999999|32=1.5|32=2|", "  8=FIX.4.2 35=0 34=1 ", "plain", "", "8=FIX.4.4|35=|35=Z|35=|",
    ]
    df = spark.createDataFrame([("p", i + 1, x, "f") for i, x in enumerate(rows)], "source_path string, line_number long, line string, source_fingerprint string")
    got = fix_outputs.outputs(df, "America/New_York", (35, 32))
    assert {k: (len(v.columns), v.count()) for k, v in got.items()} == {"fix_order_lifecycle": (53, 2), "fix_session_events": (29, 2), "fix_parse_errors": (7, 6), "fix_tags": (9, 6)}
    first, second = got["fix_order_lifecycle"].orderBy("line_number").collect()
    assert (str(first.order_qty), str(first.price), first.lifecycle_event) == ("100.1234567891", "100.0000000000", "new_order")
    assert (second.price, second.order_qty, str(second.last_qty)) == (None, None, "2.0000000000")
    at = got["fix_order_lifecycle"].where("line_number = 1").select(F.unix_millis("sending_time")).first()[0]
    assert at == 1704205800123
    assert all(v.count() == 0 for v in fix_outputs.outputs(df.limit(0), "UTC", (35,)).values())


RECORD = """{"Event":{"System":{"EventID":{"#text":"0x1F","#attributes":{"Qualifiers":7}},"Version":"x","Level":4,"Task":1.5,"Opcode":true},
"EventData":{"Data":["a",5,null,"true"],"A":null,"B":[1],"C":{"#text":"12"},"D":{"x":1}},
"UserData":{"U":{"a":[1,{"b":2},{}],"e":{},"#attributes":{"k":{"z":1}},"#text":"t","n":null}}}}"""


def test_event_records(spark):
    rows = [(1, RECORD), (2, "bad"), (3, '{"System":{"EventID":3},"EventData":"str"}'), (4, '{"Event":{"EventData":{"Data":{"#text":"one"}}}}'), (5, None)]
    df = spark.createDataFrame(rows, "event_record_id long, record string").withColumn("timestamp", F.lit(None).cast("timestamp"))
    events = {r.event_record_id: r for r in event_records.events(df).collect()}
    assert sorted(events) == [1, 3, 4] and len(events[1]) == 21
    assert (events[1].event_id, events[1].event_qualifiers, events[1].version, events[1].level, events[1].task) == (31, 7, None, 4, None)
    data = {(r.event_record_id, r.key, r.idx): (r.value_raw, r.value_type) for r in event_records.event_data(df).collect()}
    assert data == {
        (1, "A", None): (None, "empty"), (1, "B", None): ("[1]", "json"), (1, "C", None): ("12", "int"), (1, "D", None): ('{"x":1}', "json"), (1, "Data", 0): ("a", "string"),
        (1, "Data", 1): ("5", "int"), (1, "Data", 2): ("true", "bool"), (4, "Data", 0): ("one", "string"),
    }
    user = {(r.key, r.idx): r.value_raw for r in event_records.user_data(df).collect()}
    assert user == {("U.#attributes.k", None): '{"z":1}', ("U.#text", None): "t", ("U.a", 0): "1", ("U.a.b", 1): "2", ("U.n", None): None}
    notes = [tuple(r) for r in event_records.annotations(df).collect()]
    assert len(notes) == 10 and (1, "conversion_failed", "System.Task", "1.5", 4) in notes and (5, "parse_warning", "Event", "Missing Event object", 3) in notes


def test_record_types(spark):
    df = spark.createDataFrame([(1, 'a,T:,"x,y",3'), (2, "b,T"), (3, "c"), (4, ""), (5, None), (6, "d,U,1,2,3,4,5")], "n long, line string")
    got = {r.n: tuple(r)[1:] for r in lines.record_types(df, "line", ["n"], 4).collect()}
    assert got == {1: ("T", "a", "T:", "x,y", "3"), 2: ("T", "b", "T", None, None), 6: ("U", "d", "U", "1", "2")}


def test_fuzzy_literals(spark):
    cases = {("abc", "abcdef"): True, ("ns", "netsuite"): True, ("small", "smell"): True, ("longerword", "longerwords"): False, ("xyz", "abc"): False, ("a.c", "abcdefgh"): False, ("", "a"): False}
    df = spark.createDataFrame(list(cases), "a string, b string").select("a", "b", path_groups.fuzzy(F.col("a"), F.col("b")).alias("f"))
    assert {(r.a, r.b): r.f for r in df.collect()} == cases


def test_variant_groups(spark):
    found = [f"fin/{a}/ap_aging/rep_{20240101 + i}.csv" for a in ("netsuite", "ns", "payroll") for i in range(5)] + ["gl/x.csv"]
    got = path_groups.variant_groups(spark.createDataFrame([(p,) for p in found], "rel_path string")).collect()
    assert {(r.group, r.template) for r in got} == {("fin/netsuite/ap_aging", "fin/netsuite/ap_aging"), ("fin/netsuite/ap_aging", "fin/ns/ap_aging")}


def test_synonyms(spark):
    base = [("cfg/tmp",), ("cfg/temp",), ("cfg/apps",), ("app/x1",), ("apps/reports",), ("apps/repor",)]
    df = spark.createDataFrame(base * 6, "rel_path string")
    got = {(r.short_form, r.canonical_form, r.score) for r in path_groups.synonyms(df, top=None).collect()}
    assert got == {("cfg", "config", 3), ("app", "application", 3), ("tmp", "temp", 3), ("tmp", "temp", 2), ("app", "apps", 3), ("repor", "reports", 2)}
    assert path_groups.synonyms(df).count() == 5 and path_groups.synonyms(df.limit(29)).count() == 0


def test_least_reachable(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)]
    got = {r.node: r.root for r in path_groups.least_reachable(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_placeholders(spark):
    df = spark.createDataFrame([("mission_042/20240115/a.csv",), ("mission_x/20240115/a.csv",), ("b/mission_7/2024-01-15/c.csv",)], "rel_path string")
    got = paths.placeholder_fields(df, "**/mission_<id:int>/<day:date>/*.csv").collect()
    assert {(r._cf_path_id, r._cf_path_day) for r in got} == {("042", "20240115"), ("7", "2024-01-15")}
    for bad in ("<a", "a>", "<a><a>", "<a:money>", "<1a>", "<a<b>>", "<>"):
        with pytest.raises(ValueError):
            paths.placeholder_regex(bad)


def test_fail_fast(spark):
    history = spark.createDataFrame([(i, False) for i in range(4)] + [(9, True)], "file long, resolved boolean")
    run = lambda rate: lambda f: f.select("file", (F.col("file") % 4 < rate).alias("passed"))
    files = spark.range(10).toDF("file")
    for rate, n, stopped in ((3, 4, True), (4, 10, False)):
        got, early = backtest.fail_fast(files, history, run(rate))
        assert (got.count(), early) == (n, stopped)


def test_changes(spark):
    df = spark.createDataFrame([("1", None), ("x", "b")], "a string, b string")
    got = amend.apply_changes(df, [amend.Change("retype", "a", "int"), amend.Change("default", "b", default="z"), amend.Change("rename", "b", "c"), amend.Change("reorder", to="c")])
    assert got.columns == ["c", "a"] and {tuple(r) for r in got.collect()} == {("z", 1), ("b", None)}
    for bad in (amend.Change("remove", "q"), amend.Change("reorder", to="q"), amend.Change("add", "a", "int"), amend.Change("rename", "a", "b"), amend.Change("turn", "a")):
        with pytest.raises(ValueError):
            amend.apply_changes(df, [bad])
    assert amend.proposals(df.limit(0), [ContractColumn("a", "int"), ContractColumn("b", "string", False)]).count() == 0


def test_parsers(spark):
    def parse(path, content):
        for i, line in enumerate(content.decode().split("\n")):
            if line == "boom":
                raise RuntimeError("bad line")
            yield ("long_lines" if len(line) > 3 else "lines"), {"n": i, "text": line, "other": 1}

    def odd(path, content):
        yield "nowhere", {}

    files = spark.createDataFrame([("a", bytearray(b"x\nlonger\ny")), ("b", bytearray(b"z\nboom")), ("c", None), ("d", bytearray(b"\xff"))], "path string, content binary")
    shape = StructType().add("n", "long").add("text", "string")
    got = parsers.run_parser(files, parse, {"lines": shape, "long_lines": shape})
    assert {tuple(r) for r in got["lines"].collect()} == {(0, "x", "a", 0), (2, "y", "a", 1), (0, "", "c", 0)}
    assert [tuple(r) for r in got["long_lines"].collect()] == [(1, "longer", "a", 0)]
    assert {r.path: r.error.split(":")[0] for r in got["_errors"].collect()} == {"b": "RuntimeError", "d": "UnicodeDecodeError"}
    assert parsers.preview(got, 1)["lines"].collect()[0].text == "x"
    assert parsers.run_parser(files, odd, {"lines": shape})["_errors"].count() == 4
    assert all(v.count() == 0 for v in parsers.run_parser(files.limit(0), parse, {"lines": shape}).values())
    meta = parsers.extract(files, lambda p, c: {"size": len(c), "text": c.decode()}).collect()
    assert {r.path: r.status for r in meta} == {"a": "ok", "b": "ok", "c": "ok", "d": "error"}
    log = spark.createDataFrame([("e", i, "ok" if i == 1 else "error") for i in range(5)] + [("f", i, "error") for i in range(2)], "extractor string, run long, status string")
    assert [tuple(r) for r in parsers.paused(log).collect()] == [("e", 3)]
