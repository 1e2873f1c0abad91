"""Event records as JSON text to five tables: events, event data, user data, annotations and files.

Records come as a table with event_record_id, timestamp, record (JSON text) and whatever names their file. A record is parsed
once into a variant; keys of open-ended objects become rows by generators, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import value_type
from millrace.operators.staging import staged

INFO, WARN, ERROR = 1, 3, 4
SHAPE, FAILED, WARNING = "field_shape_variant", "conversion_failed", "parse_warning"
#: Levels of user data that a round opens.
LEVELS = 4


def at(v: Column, *keys: str) -> Column:
    """What a variant has under nested keys; null where there is none."""
    return F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in keys), "variant")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID (a JSON null), BIGINT, ...; null for no value. Objects and lists are looked at one level deep: the schema of all they hold grows with it."""
    scalar = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), "OBJECT").when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), "ARRAY").otherwise(scalar)


def plain(v: Column) -> Column:
    """A string, number or boolean as text; null for other values."""
    return F.when(kind(v).isin("OBJECT", "ARRAY", "VOID"), None).otherwise(F.try_variant_get(v, "$", "string"))


def json_text(v: Column) -> Column:
    return F.when(kind(v) == "VOID", "null").otherwise(F.to_json(v))


#: A whole number in hexadecimal that fits a signed long.
HEX = "^0[xX]0*([0-9a-fA-F]{1,15}|[0-7][0-9a-fA-F]{15})$"


def integer(text: Column) -> Column:
    t = F.trim(text)
    hexed = F.conv(F.regexp_extract(t, HEX, 1), 16, 10).try_cast("bigint")
    return F.when(t.rlike(HEX), hexed).when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("bigint"))


def note(kind_: str, key: str | Column, value: Column, severity: int) -> Column:
    return F.struct(F.lit(kind_).alias("note_type"), (F.lit(key) if isinstance(key, str) else key).alias("note_key"), value.alias("note_value"), F.lit(severity).cast("long").alias("severity"))


def coerced(name: str, field: str) -> tuple[Column, Column]:
    """A whole number from a number, or from text, plain or in an object's `#text`; and the note on what was unusual, or null. Of the columns that system_of() made for `name`."""
    v, k, text = F.col(f"_v_{name}"), F.col(f"_k_{name}"), F.col(f"_t_{name}")
    number = F.when(k.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), F.try_variant_get(v, "$", "bigint"))
    got = F.coalesce(number, integer(text))
    remark = (
        F.when(v.isNull() | number.isNotNull(), None)
        .when(text.isNotNull() & got.isNotNull(), note(SHAPE, field, text, INFO)).when(text.isNotNull(), note(FAILED, field, text, ERROR))
        .when(k.isin("DECIMAL", "DOUBLE", "FLOAT"), note(FAILED, field, F.try_variant_get(v, "$", "string"), ERROR)).otherwise(note(SHAPE, field, json_text(v), WARN))
    )
    return got, remark


def events_of(records: DataFrame) -> DataFrame:
    """records with `event` (a variant): the record's Event if that is an object, else the record if it has a System; null otherwise."""
    r = records.withColumn("_v", F.try_parse_json("record"))
    v = F.col("_v")
    event = F.when(kind(at(v, "Event")) == "OBJECT", at(v, "Event")).when(at(v, "System").isNotNull(), v)
    return r.withColumn("event", event).drop("_v")


#: Whole-number columns of System and their paths in notes.
FIELDS = {
    "event_id": "System.EventID", "event_qualifiers": "System.EventID.Qualifiers", "version": "System.Version", "level": "System.Level", "task": "System.Task", "opcode": "System.Opcode",
    "execution_process_id": "System.Execution.ProcessID", "execution_thread_id": "System.Execution.ThreadID",
}
ATTRIBUTES = ("Provider", "Execution", "Security", "Correlation")


def system_of(records: DataFrame) -> DataFrame:
    """events_of() with System's parts, each step in columns of its own, so that generated code stays small: attributes of a key come from `<key>_attributes` if that is an object, else from its `#attributes`."""
    df = events_of(records).withColumn("_s", at(F.col("event"), "System"))
    s = F.col("_s")
    df = df.withColumns({f"_own_{k}": at(s, f"{k}_attributes") for k in (*ATTRIBUTES, "EventID")})
    df = df.withColumns({f"_a_{k}": F.when(kind(F.col(f"_own_{k}")) == "OBJECT", F.col(f"_own_{k}")).otherwise(at(s, k, "#attributes")) for k in ATTRIBUTES})
    raw = {n: at(s, path.split(".")[1]) for n, path in FIELDS.items() if path.count(".") == 1}
    raw |= {n: at(F.col("_a_Execution"), FIELDS[n].split(".")[2]) for n in ("execution_process_id", "execution_thread_id")}
    own = F.col("_own_EventID")
    raw["event_qualifiers"] = F.coalesce(F.when(kind(own) == "OBJECT", at(own, "Qualifiers")).otherwise(own), at(s, "EventID", "#attributes", "Qualifiers"))
    df = df.withColumns({f"_v_{n}": v for n, v in raw.items()})
    df = df.withColumns({f"_k_{n}": kind(F.col(f"_v_{n}")) for n in FIELDS} | {f"_i_{n}": at(F.col(f"_v_{n}"), "#text") for n in FIELDS})
    text = lambda n: F.when(F.col(f"_k_{n}") == "STRING", F.try_variant_get(f"_v_{n}", "$", "string")).when(kind(F.col(f"_i_{n}")) == "STRING", F.try_variant_get(f"_i_{n}", "$", "string"))
    return df.withColumns({f"_t_{n}": text(n) for n in FIELDS})


def events(records: DataFrame) -> DataFrame:
    """One row of 21 columns for each record that has an event."""
    df = system_of(records).where("event is not null")
    s, a = F.col("_s"), {k: F.col(f"_a_{k}") for k in ATTRIBUTES}
    n = {name: coerced(name, field)[0].alias(name) for name, field in FIELDS.items()}
    guid = F.regexp_replace(plain(at(a["Provider"], "Guid")), "^[{}]+|[{}]+$", "")
    return df.select(
        "event_record_id", "timestamp", plain(at(a["Provider"], "Name")).alias("provider_name"), guid.alias("provider_guid"),
        plain(at(a["Provider"], "EventSourceName")).alias("provider_event_source_name"), plain(at(s, "Channel")).alias("channel"), plain(at(s, "Computer")).alias("computer"),
        *list(n.values())[:6], plain(at(s, "Keywords")).alias("keywords_hex"), *list(n.values())[6:],
        plain(at(a["Security"], "UserID")).alias("security_user_id"), plain(at(a["Correlation"], "ActivityID")).alias("correlation_activity_id"),
        plain(at(a["Correlation"], "RelatedActivityID")).alias("correlation_related_activity_id"), F.col("record").alias("raw_event_json"), F.lit(None).cast("string").alias("raw_event_xml"),
    )


def members(df: DataFrame, v: str, *keep: str) -> DataFrame:
    """keep, key, value: a row for each member of the object in column v; none for other values."""
    held = df.select(*keep, F.when(kind(F.col(v)) == "OBJECT", F.col(v)).alias("_o"))
    return held.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_o").outer()).toDF("_pos", "key", "value")).select(*keep, "key", "value")


def typed(rows: DataFrame, section: str, kind_: Column | None = None) -> DataFrame:
    """Key-value rows in their ten columns; the type is read off value_raw unless it is given."""
    raw = F.col("value_raw")
    t = value_type(raw) if kind_ is None else F.coalesce(kind_, value_type(raw))
    rows = rows.withColumn("value_type", t)
    v = F.trim("value_raw")
    is_a = lambda *names: F.col("value_type").isin(*names)
    return rows.select(
        "event_record_id", F.lit(section).alias("section"), "key", F.col("idx").cast("long").alias("idx"), "value_raw", "value_type",
        F.when(is_a("int", "hex"), integer(v)).alias("value_int64"), F.when(is_a("bool"), F.lower(v) == "true").alias("value_bool"),
        F.when(is_a("timestamp"), v.try_cast("timestamp")).alias("value_ts"), F.lit(None).cast("binary").alias("value_bytes"),
    )


def event_data(records: DataFrame) -> DataFrame:
    """Key-value rows of EventData. `Data` gives a row for each text of its list with its place; arrays and objects stay JSON text, but for an object's `#text`."""
    df = events_of(records).select("event_record_id", at(F.col("event"), "EventData").alias("data"))
    m = members(df, "data", "event_record_id").withColumns({"_k": kind(F.col("value")), "_text": at(F.col("value"), "#text")})
    m = m.withColumns({"_plain": plain(F.col("value")), "_json": json_text(F.col("value")), "_inner": plain(F.col("_text"))})
    v, k, text, own, inner = (F.col(c) for c in ("value", "_k", "_text", "_plain", "_inner"))
    items = lambda a: F.filter(F.transform(F.try_variant_get(a, "$", "array<string>"), lambda x: x), lambda x: x.isNotNull())
    one = lambda raw, t: F.array(F.struct(F.lit(None).cast("int").alias("idx"), raw.alias("raw"), F.lit(t).cast("string").alias("kind")))
    listed = lambda a: F.transform(a, lambda x, i: F.struct(i.alias("idx"), x.alias("raw"), F.lit(None).cast("string").alias("kind")))
    data = F.when(k == "ARRAY", listed(items(v))).when((k == "OBJECT") & (kind(text) == "ARRAY"), listed(items(text))).when(k == "STRING", listed(F.array(own)))
    data = data.when((k == "OBJECT") & inner.isNotNull(), listed(F.array(inner))).otherwise(one(F.coalesce(own, "_json"), None))
    other = F.when(k == "VOID", one(F.lit(None).cast("string"), "empty")).when((k == "OBJECT") & text.isNotNull(), one(F.coalesce(inner, json_text(text)), None))
    other = other.when(k.isin("ARRAY", "OBJECT"), one(F.col("_json"), "json")).otherwise(one(own, None))
    each = m.select("event_record_id", "key", F.explode(F.when(F.col("key") == "Data", data).otherwise(other)).alias("x"))
    each = each.select("event_record_id", "key", F.col("x.idx").alias("idx"), F.col("x.raw").alias("value_raw"), F.col("x.kind").alias("_kind"))
    return typed(each, "EventData", F.col("_kind"))


def opened(rows: DataFrame, leaf: Column) -> DataFrame:
    """rows (event_record_id, key, idx, value) with the members of objects and the items of arrays in place of them, one level; an empty one has none."""
    own = rows.withColumn("_k", kind(F.col("value"))).withColumn("_open", F.when(~leaf & F.col("_k").isin("OBJECT", "ARRAY"), F.col("value")))
    each = own.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_open").outer()).toDF("_pos", "_name", "_value"))
    return each.where("_open is null or _pos is not null").select(
        "event_record_id", F.when(F.col("_name").isNotNull(), F.concat("key", F.lit("."), "_name")).otherwise(F.col("key")).alias("key"),
        F.when(F.col("_open").isNotNull() & (F.col("_k") == "ARRAY"), F.col("_pos").cast("long")).otherwise(F.col("idx")).alias("idx"),
        F.when(F.col("_open").isNotNull(), F.col("_value")).otherwise(F.col("value")).alias("value"),
    )


def user_data(records: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaves of UserData by dotted path; array items keep their parent's path and have their place in `idx`. Members of `#attributes` and `#text` are leaves.

    However deep: a round opens some levels, and what is still an object or an array is staged as JSON and opened by the next.
    """
    df = events_of(records).select("event_record_id", at(F.col("event"), "UserData").alias("data"))
    rows = members(df, "data", "event_record_id").select("event_record_id", "key", F.lit(None).cast("long").alias("idx"), "value")
    leaf, v, leaves = F.col("key").rlike(r"\.#text$|\.#attributes\."), F.col("value"), None
    while True:
        for _ in range(levels):
            rows = opened(rows, leaf)
        still = F.when(~leaf & kind(v).isin("OBJECT", "ARRAY"), json_text(v))
        raw = F.when(kind(v) == "VOID", None).otherwise(F.coalesce(plain(v), json_text(v)))
        attributes = F.col("key").rlike(r"\.#attributes$") & (kind(v) != "OBJECT")
        out = staged(rows.select("event_record_id", "key", "idx", still.alias("still"), F.coalesce(attributes, F.lit(False)).alias("aside"), raw.alias("value_raw")), "user-data")
        own = out.where("still is null and not aside").select("event_record_id", "key", "idx", "value_raw")
        leaves = own if leaves is None else leaves.unionAll(own)
        rows = out.where("still is not null").select("event_record_id", "key", "idx", F.parse_json("still").alias("value"))
        if rows.isEmpty():
            return typed(leaves, "UserData")


def annotations(records: DataFrame) -> DataFrame:
    """What was unusual: records without an event, numbers in other shapes, members that are arrays or objects."""
    df = system_of(records).withColumns({"_data": at(F.col("event"), "EventData"), "_user": at(F.col("event"), "UserData")})
    event, data, user = F.col("event"), F.col("_data"), F.col("_user")
    odd = lambda v, key: F.when(kind(v).isNotNull() & ~kind(v).isin("OBJECT", "VOID"), note(SHAPE, key, json_text(v), WARN))
    whole = F.when(event.isNull(), F.array(note(WARNING, "Event", F.lit("Missing Event object"), WARN))).otherwise(
        F.array_compact(F.array(*[coerced(n, f)[1] for n, f in FIELDS.items()], odd(data, "Event.EventData"), odd(user, "Event.UserData")))
    )
    first = df.select("event_record_id", F.explode(whole).alias("n"))
    m = members(events_of(records).select("event_record_id", at(event, "EventData").alias("data")), "data", "event_record_id").where("key <> 'Data'")
    k = kind(F.col("value"))
    shape = F.when(k == "ARRAY", "array_value").when((k == "OBJECT") & at(F.col("value"), "#text").isNotNull(), "object_text").when(k == "OBJECT", "complex_value")
    second = m.where(k.isin("ARRAY", "OBJECT")).select("event_record_id", note(SHAPE, F.concat(F.lit("Event.EventData."), "key"), shape, INFO).alias("n"))
    return first.unionByName(second).select("event_record_id", "n.*")


def files(records: DataFrame, file: str, version: str) -> DataFrame:
    """A row a file: its path, record count and the version of these outputs."""
    return records.groupBy(F.col(file).alias("file_path")).agg(F.count("*").alias("record_count"), F.lit(version).alias("parser_output_version"))
