"""Registered queries of the log and record sources; lines and records are made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.queries import query, table
from millrace.sources import event_records, fix_outputs, lines

ZONE = "UTC"


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A log line for each order: session message, new order, text without a message, message without a type, in turn."""
    o = table(spark, sf, "orders")
    k, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd")
    quantity = F.round("o_totalprice").cast("long").cast("string")
    who = F.concat(F.lit("|34="), k, F.lit("|49=C"), F.col("o_custkey").cast("string"), F.lit("|56=BRK|52="), day)
    session = F.concat(F.lit("8=FIX.4.4|9=12|35=0"), who, F.lit("-09:30:00|10=1|"))
    order = F.concat(F.lit("app: 8=FIX.4.4|9=99|35=D"), who, F.lit("-09:30:00.250|11="), k, F.lit("|55=ABC|54=1|38="), quantity, F.lit(".5|44=abc|31=1.00000000005|10=1|"))
    turn = F.col("o_orderkey") % 4
    line = F.when(turn == 0, session).when(turn == 1, order).when(turn == 2, F.concat(F.lit("note x="), k)).otherwise(F.concat(F.lit("8=FIX.4.4|34="), k, F.lit("|")))
    status = F.col("o_orderstatus")
    return o.select(F.concat(F.lit("logs/"), status).alias("source_path"), F.col("o_orderkey").alias("line_number"), line.alias("line"), F.substring(F.sha2(status, 256), 1, 16).alias("source_fingerprint"))


LOG = """
log as (
  select *, sha256(line) as raw_line_hash, 'logs/' || o_orderstatus as source_path, left(sha256(o_orderstatus), 16) as source_fingerprint from (
    select *, case o_orderkey % 4 when 0 then '8=FIX.4.4|9=12|35=0' || who || '-09:30:00|10=1|'
      when 1 then 'app: 8=FIX.4.4|9=99|35=D' || who || '-09:30:00.250|11=' || o_orderkey || '|55=ABC|54=1|38=' || qty || '|44=abc|31=1.00000000005|10=1|'
      when 2 then 'note x=' || o_orderkey else '8=FIX.4.4|34=' || o_orderkey || '|' end as line
    from (select *, cast(round(o_totalprice) as bigint) || '.5' as qty, '|34=' || o_orderkey || '|49=C' || o_custkey || '|56=BRK|52=' || strftime(o_orderdate, '%Y%m%d') as who from orders))
)"""
SQL_TYPES = {"string": "varchar", "event": "varchar", "bigint": "bigint", "decimal": "decimal(38,10)", "timestamp": "timestamp"}


def _columns_sql(spec: tuple, known: dict[str, str]) -> str:
    head = "source_path, o_orderkey as line_number, 0 as message_index, raw_line_hash, source_fingerprint, o_orderkey as __cf_row_id"
    return ", ".join([head, *[f"cast({known.get(name, 'null')} as {SQL_TYPES[kind]}) as {name}" for name, _, kind in spec]])


_BOTH = {"begin_string": "'FIX.4.4'", "msg_seq_num": "o_orderkey", "sender_comp_id": "'C' || o_custkey", "target_comp_id": "'BRK'"}
_ORDER = _BOTH | {
    "body_length": "99", "msg_type": "'D'", "sending_time": "date_trunc('day', o_orderdate) + interval 34200250 milliseconds", "cl_ord_id": "o_orderkey", "symbol": "'ABC'", "side": "'1'", "order_qty": "qty",
    "last_px": "1.0000000001", "lifecycle_event": "'new_order'",
}
_SESSION = _BOTH | {"body_length": "12", "msg_type": "'0'", "sending_time": "date_trunc('day', o_orderdate) + interval 34200 seconds"}


@query(f"with {LOG} select {_columns_sql(fix_outputs.ORDER, _ORDER)} from log where o_orderkey % 4 = 1")
def fix_order_lifecycle(spark, sf):
    return fix_outputs.order_lifecycle(log_lines(spark, sf), ZONE)


@query(f"with {LOG} select {_columns_sql(fix_outputs.SESSION, _SESSION)} from log where o_orderkey % 4 = 0")
def fix_session_events(spark, sf):
    return fix_outputs.session_events(log_lines(spark, sf), ZONE)


@query(f"""with {LOG}, e as (
  select *, null::int as message_index, 'No FIX message found (missing 8=FIX prefix)' as error_reason, line as raw_line_preview from log where o_orderkey % 4 = 2
  union all select *, 0, 'Missing msg_type (tag 35)', line from log where o_orderkey % 4 = 3
  union all select *, 0, 'Invalid decimal: field=price value=abc', substr(line, 6) from log where o_orderkey % 4 = 1
  union all select *, 0, 'Decimal rounded: field=last_px value=1.00000000005 rounded=1.0000000001', substr(line, 6) from log where o_orderkey % 4 = 1)
select source_path, o_orderkey as line_number, message_index, raw_line_hash, source_fingerprint, error_reason, raw_line_preview from e""")
def fix_parse_errors(spark, sf):
    return fix_outputs.parse_errors(log_lines(spark, sf))


@query(f"""with {LOG} select source_path, o_orderkey as line_number, 0 as message_index, raw_line_hash, source_fingerprint, case o_orderkey % 4 when 0 then '0' else 'D' end as msg_type, x.tag, x.value, x.position
from log, lateral (select unnest(['34', '56']) as tag, unnest([cast(o_orderkey as varchar), 'BRK']) as value, unnest([4, 6]) as position) x where o_orderkey % 4 < 2""")
def fix_allowed_tags(spark, sf):
    return fix_outputs.tag_rows(log_lines(spark, sf), (34, 56))


# ---- event records

def records(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as a JSON record, some with odd shapes."""
    e = table(spark, sf, "events")
    k = F.col("event_id").cast("string")
    system = F.concat(
        F.lit('{"Event":{"System":{"Provider":{"#attributes":{"Name":"'), "event_type", F.lit('","Guid":"{123e4567-e89b-12d3-a456-426614174000}"}},"EventID":'),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"0x1F"'))).otherwise(k), F.lit(',"Level":'), F.when(F.col("event_id") % 5 == 0, '"high"').otherwise("4"),
        F.lit(',"Execution_attributes":{"ProcessID":'), F.col("user_id").cast("string"), F.lit('},"Channel":"Web"},"EventData":{"props":'), "props", F.lit(',"user":"'), F.col("user_id").cast("string"),
        F.lit('","Data":["a",'), k, F.lit(']},"UserData":{"U":{"list":[1,{"b":"x"}],"#attributes":{"t":"'), "event_type", F.lit('"}}}}}'),
    )
    return e.select(F.col("event_id").alias("event_record_id"), F.col("ts").alias("timestamp"), F.when(F.col("event_id") % 7 == 0, '{"Other":1}').otherwise(system).alias("record"), (F.col("event_id") % 10).alias("file"))


@query("""select event_id as event_record_id, ts as timestamp, event_type as provider_name, '123e4567-e89b-12d3-a456-426614174000' as provider_guid, null as provider_event_source_name, 'Web' as channel, null as computer,
  case when event_id % 3 = 0 then 31 else event_id end as event_id, null as event_qualifiers, null as version, case when event_id % 5 <> 0 then 4 end as level, null as task, null as opcode, null as keywords_hex, user_id as execution_process_id, null as execution_thread_id,
  null as security_user_id, null as correlation_activity_id, null as correlation_related_activity_id, null as raw_event_xml from events where event_id % 7 <> 0 and props is not null""")
def event_record_rows(spark, sf):
    return event_records.events(records(spark, sf)).drop("raw_event_json")


@query("""select event_id as event_record_id, 'EventData' as section, x.key, x.idx, x.raw as value_raw, x.t as value_type, x.n as value_int64, null as value_bool, null as value_ts, null as value_bytes
from events, lateral (select unnest(['props', 'user', 'Data', 'Data']) as key, unnest([null, null, 0, 1]) as idx, unnest([replace(replace(props, ': ', ':'), ', ', ','), cast(user_id as varchar), 'a', cast(event_id as varchar)]) as raw,
  unnest(['json', 'int', 'string', 'int']) as t, unnest([null, user_id, null, event_id]) as n) x where event_id % 7 <> 0 and props is not null""")
def event_data_rows(spark, sf):
    return event_records.event_data(records(spark, sf))


@query("""select event_id as event_record_id, 'UserData' as section, x.key, x.idx, x.raw as value_raw, x.t as value_type, x.n as value_int64, null as value_bool, null as value_ts, null as value_bytes
from events, lateral (select unnest(['U.list', 'U.list.b', 'U.#attributes.t']) as key, unnest([0, 1, null]) as idx, unnest(['1', 'x', event_type]) as raw, unnest(['int', 'string', 'string']) as t, unnest([1, null, null]) as n) x where event_id % 7 <> 0 and props is not null""")
def user_data_rows(spark, sf):
    return event_records.user_data(records(spark, sf))


@query("""with a as (select event_id as event_record_id, 'parse_warning' as note_type, 'Event' as note_key, 'Missing Event object' as note_value, 3 as severity from events where event_id % 7 = 0 or props is null
  union all select event_id, 'field_shape_variant', 'System.EventID', '0x1F', 1 from events where event_id % 7 <> 0 and props is not null and event_id % 3 = 0
  union all select event_id, 'conversion_failed', 'System.Level', 'high', 4 from events where event_id % 7 <> 0 and props is not null and event_id % 5 = 0
  union all select event_id, 'field_shape_variant', 'Event.EventData.props', 'complex_value', 1 from events where event_id % 7 <> 0 and props is not null) select * from a""")
def event_annotations(spark, sf):
    return event_records.annotations(records(spark, sf))


@query("select event_id % 10 as file_path, count(*) as record_count, '1' as parser_output_version from events group by 1")
def event_files(spark, sf):
    return event_records.files(records(spark, sf), "file", "1")


@query("""select l_orderkey, l_returnflag as record_type, case l_returnflag when 'A' then cast(l_orderkey as varchar) when 'N' then l_linestatus else cast(l_linenumber as varchar) end as first_value,
  case l_returnflag when 'A' then l_linestatus when 'N' then cast(l_linenumber as varchar) else cast(l_orderkey as varchar) end as second_value from lineitem""")
def discriminated_records(spark, sf):
    """All three tables of one file, each with columns of its own."""
    li = table(spark, sf, "lineitem")
    text = F.concat_ws(",", F.col("l_orderkey").cast("string"), F.concat("l_returnflag", F.lit(":")), "l_linestatus", F.col("l_linenumber").cast("string"))
    found = lines.record_types(li.select("l_orderkey", text.alias("line")), "line", ["l_orderkey"], 5)
    own = {"A": ("column_1", "column_3"), "N": ("column_3", "column_4"), "R": ("column_4", "column_1")}
    tables = lines.tables_by_type(found, {t: {"l_orderkey": "l_orderkey", "record_type": "record_type", "first_value": a, "second_value": b} for t, (a, b) in own.items()})
    return tables["A"].unionByName(tables["N"]).unionByName(tables["R"])


# ---- user data of any depth


def deep_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose user data is nested up to ten levels, deeper the higher the event's number."""
    e = table(spark, sf, "events")
    depth = (F.col("event_id") % 10).cast("int")
    data = F.concat(F.repeat(F.lit('{"n":['), depth), F.lit('{"v":'), F.col("event_id").cast("string"), F.lit(',"t":"'), "event_type", F.lit('"}'), F.repeat(F.lit("]}"), depth))
    record = F.concat(F.lit('{"Event":{"System":{"EventID":1},"UserData":{"U":'), data, F.lit("}}}"))
    return e.select(F.col("event_id").alias("event_record_id"), F.col("ts").alias("timestamp"), record.alias("record"))


@query("""select event_id as event_record_id, 'UserData' as section, 'U' || repeat('.n', cast(event_id % 10 as int)) || x.k as key, case when event_id % 10 > 0 then 0 end as idx, x.raw as value_raw, x.t as value_type, x.n as value_int64, null as value_bool, null as value_ts, null as value_bytes
from events, lateral (select unnest(['.v', '.t']) as k, unnest([cast(event_id as varchar), event_type]) as raw, unnest(['int', 'string']) as t, unnest([event_id, null]) as n) x""")
def deep_user_data(spark, sf):
    return event_records.user_data(deep_records(spark, sf))
