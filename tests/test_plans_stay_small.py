"""What a row's value is asked for several times is made once: results on odd values, and how often a plan makes them."""

import weakref

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions import text
from millrace.operators import contract, lifecycle, parsers
from millrace.operators.contract import ContractColumn
from millrace.sources import event_records

#: JSON, cut to four letters two levels deep, and as digests one level deep.
JSON = [
    ('{"b":"long word","a":[1,"two words",{"c":null,"d":{"e":"x"}}],"t":true}', '{"b":"long...","a":[1,"two ...","[hash:d2c11aa9]"],"t":true}', '{"b":"[hash:82f1fe21]","a":"[hash:a7ba52a6]","t":true}'),
    *[(x, x, x) for x in ("[]", "{}", "null", "", "{broken", None, '{"a":1,"a":2}')],
    ('"plain text"', '"plai..."', '"[hash:c9ecf5e5]"'),
    ("1.50", "1.50", '"[hash:1a60b208]"'),
    ('{"k\\"ey":"v\\"alue"}', '{"k\\"ey":"v\\"al..."}', '{"k\\"ey":"[hash:cf4fb7f0]"}'),
    ('{"z":1,"a":2}', '{"z":1,"a":2}', '{"z":"[hash:6b86b273]","a":"[hash:d4735e3a]"}'),
    (' [ 1 , "x" ] ', '[1,"x"]', '["[hash:6b86b273]","[hash:2d711642]"]'),
]


def test_json_is_parsed_once_a_level(spark):
    """A text is parsed in one place, for all levels."""
    df = spark.createDataFrame([(j,) for j, _, _ in JSON], "j string").select("j", text.redacted_json(F.col("j"), 4, depth=2).alias("cut"), text.redacted_json(F.col("j"), depth=1).alias("hashed"))
    assert df.select("cut")._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert sorted(map(str, df.collect())) == sorted(map(str, spark.createDataFrame(JSON, "j string, cut string, hashed string").collect()))


def test_kinds_of_values_without_the_schema_of_what_they_hold(spark):
    """A list's or an object's kind is told by itself; only other values' schemas are made."""
    values = {'{"a":[{"b":1}]}': "OBJECT", "{}": "OBJECT", "[[1],{}]": "ARRAY", "[]": "ARRAY", '"x"': "STRING", '"{}"': "STRING", "null": "VOID", "12": "BIGINT", "1.5": "DECIMAL", "1e300": "DOUBLE", "true": "BOOLEAN", "{": None, None: None}
    df = spark.createDataFrame([(j,) for j in values], "j string").select("j", event_records.kind(F.try_parse_json("j")).alias("k"))
    assert {r.j: r.k for r in df.collect()} == values
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("OBJECT") < plan.index("schemaOfVariant")


def test_nested_parts_are_rewritten_once(spark):
    """A part is cast in one place of the plan, however many lists it lies in and however often the column is used."""
    rows = [(1, [[[("2024-02-29", 1), ("", None)], None], [[("2023-02-29", 2)]]]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id bigint, x array<array<array<struct<day: string, n: bigint>>>>")
    columns = [ContractColumn("id", "bigint"), ContractColumn("x", "array<array<array<struct<day: date, n: bigint NOT NULL>>>>", False)]
    done = contract.enforce(df, columns).select("id", "_cf_row_error", F.transform(F.col("x")[0][0]["day"], lambda d: d.cast("string")).alias("days"), F.size(F.flatten("x")).alias("n"), F.col("x")[1][0][0]["day"].isNull().alias("none"))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp") == 1
    found = {r.id: (r._cf_row_error, r.days, r.n, r.none) for r in done.where("id = 1").collect()}
    assert found == {1: ("schema: null not allowed in 'x[0][0][1].n'; schema: value does not match format 'date' for 'x[1][0][0].day'", ["2024-02-29", None], 3, True)}
    errors = {r.id: r._cf_row_error for r in contract.enforce(df, columns).where("id > 1").collect()}
    assert errors == {2: None, 3: "schema: null not allowed in 'x'"}


def test_rows_of_a_file_are_held_packed(spark):
    """Of a long file's rows only the last few are Python objects at any time; a row that fits no type still spoils its file alone, and the parser's own error goes before it."""

    def parse(path, content):
        class Word(str):
            __slots__ = ("__weakref__",)

        alive, most = weakref.WeakSet(), 0
        for i in range(20_000):
            word = Word(i)
            alive.add(word)
            most = max(most, len(alive))
            yield "words", {"n": "no number" if i == 5 and path != "good" else i, "word": word}
        if path == "worst":
            raise KeyError("end")
        yield "most", {"n": most}

    files = spark.createDataFrame([(p, b"") for p in ("good", "bad", "worst")], "path string, content binary")
    found = parsers.run_parser(files, parse, {"words": StructType().add("n", "long").add("word", "string"), "most": StructType().add("n", "long")})
    assert found["most"].first().n <= parsers.ROWS_AT_ONCE + 1
    rows = found["words"].orderBy("_source_row").collect()
    assert [(r.n, r.word, r._source_path, r._source_row) for r in rows] == [(i, str(i), "good", i) for i in range(20_000)]
    errors = {r.path: r.error for r in found["_errors"].collect()}
    assert errors.keys() == {"bad", "worst"} and errors["worst"] == "KeyError: 'end'" and "no number" in errors["bad"]


def test_blocks_are_sorted_without_a_comparator(spark):
    """array_sort calls a lambda for every two changes; places are unique, so their natural order is the same."""
    df = spark.createDataFrame([("f", n, n % 3) for n in (3, 1, 0, 2)], "_file string, _nth long, _code int")
    got = lifecycle.runs_of(df, 3, "_code")
    assert "lambda" not in got._jdf.queryExecution().analyzed().toString()
    assert sorted((r._up, [x._nth for x in r.xs]) for r in got.collect()) == [(0, [0, 1, 2]), (1, [3])]
