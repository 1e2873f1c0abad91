"""Registered queries of text validity, samples, quarantine rows, keys, readers, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import values
from millrace.functions.text import key_of
from millrace.operators import backtest, catalog, contract, listing, samples, shred, sinks, sql_gate
from millrace.operators.contract import ContractColumn
from millrace.operators.staging import shared_folder
from millrace.plans.queries import CATALOG, ENFORCED, EVENTS, RUNS, VIOLATION, enforced_events, files, query, runs, table
from millrace.sources import lines
from millrace.sources.walk import write_files
from millrace.streaming.contract_stream import run_available

# ---- validity of texts


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as texts: keys, prices, days (of which some are in no calendar), times, flags and spans."""
    o, k, d = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    day = F.concat(F.date_format(d, "yyyy"), F.lit("-"), F.date_format(d, "dd"), F.lit("-"), F.date_format(d, "MM"))
    clock = F.concat((k % 30).cast("string"), F.lit(":"), F.lpad((k % 70).cast("string"), 2, "0"), F.when(k % 2 == 0, ":05").otherwise(""))
    stamp = F.concat(F.date_format(d, "yyyy-MM-dd"), F.when(k % 3 == 0, " 10:20:30").when(k % 3 == 1, "T10:20:30Z").otherwise("T10:20:30"))
    flag = F.element_at(F.array(*map(F.lit, ("yes", "No", "T", "maybe", "1", "2", ""))), (k % 7 + 1).cast("int"))
    span = F.when(k % 4 == 0, "PT5").when(k % 4 == 1, "1h").otherwise("5 y")
    each = {"key": k.cast("string"), "price": F.concat(F.floor("o_totalprice").cast("string"), F.lit(".25")), "day": day, "clock": clock, "stamp": stamp, "flag": flag, "span": span}
    return o.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("v")) for n, v in each.items()])).alias("x")).select("o_orderkey", "x.*")


TEXTS = """
texts as (select o_orderkey, 'key' as name, cast(o_orderkey as varchar) as v from orders union all select o_orderkey, 'price', cast(cast(floor(o_totalprice) as bigint) as varchar) || '.25' from orders
union all select o_orderkey, 'day', strftime(o_orderdate, '%Y-%d-%m') from orders
union all select o_orderkey, 'clock', (o_orderkey % 30) || ':' || lpad(cast(o_orderkey % 70 as varchar), 2, '0') || case when o_orderkey % 2 = 0 then ':05' else '' end from orders
union all select o_orderkey, 'stamp', strftime(o_orderdate, '%Y-%m-%d') || case o_orderkey % 3 when 0 then ' 10:20:30' when 1 then 'T10:20:30Z' else 'T10:20:30' end from orders
union all select o_orderkey, 'flag', (['yes', 'No', 'T', 'maybe', '1', '2', ''])[o_orderkey % 7 + 1] from orders
union all select o_orderkey, 'span', case o_orderkey % 4 when 0 then 'PT5' when 1 then '1h' else '5 y' end from orders)"""
KINDS = ("bigint", "double", "decimal(9,2)", "date", "time", "timestamp", "timestamp_tz", "boolean", "duration")


@query(f"""with {TEXTS}, judged as (select name, v,
  v = '' or (regexp_full_match(v, '[+-]?[0-9]+') and try_cast(v as bigint) is not null) as k0, v = '' or regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') as k1,
  v = '' or (regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]{{0,2}}|\\.[0-9]{{1,2}})') and length(regexp_replace(v, '[^0-9]', '', 'g')) <= 9 and length(regexp_extract(v, '^[+-]?([0-9]*)', 1)) <= 7) as k2,
  v = '' or (regexp_full_match(v, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') and try_strptime(v, '%Y-%m-%d') is not null) as k3,
  v = '' or (regexp_full_match(v, '[0-9]{{1,2}}:[0-9]{{1,2}}(:[0-9]{{1,2}})?') and try_cast(string_split(v, ':')[1] as int) < 24 and try_cast(string_split(v, ':')[2] as int) < 60) as k4,
  v = '' or regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}( [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}|T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z)') as k5, v = '' or regexp_full_match(v, '[0-9-]{{10}}T[0-9:]{{8}}Z') as k6,
  v = '' or lower(v) in ('true', 'false', '1', '0', 'yes', 'no', 't', 'f') as k7, v = '' or starts_with(v, 'PT') or contains(v, 'h') or contains(v, 'm') or contains(v, 's') as k8 from texts)
select name, kind, count(*) filter (ok) as n_valid, count(*) as n_rows from (select name, unnest([{', '.join(f"'{k}'" for k in KINDS)}]) as kind, unnest([k0, k1, k2, k3, k4, k5, k6, k7, k8]) as ok from judged) group by 1, 2""")
def text_validity(spark, sf):
    flags = F.array(*[F.struct(F.lit(k).alias("kind"), values.valid_text(F.col("v"), k).alias("ok")) for k in KINDS])
    return texts(spark, sf).select("name", F.explode(flags).alias("x")).groupBy("name", "x.kind").agg(F.count_if("x.ok").alias("n_valid"), F.count("*").alias("n_rows"))


@query("""with e as (select event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case event_id % 3 when 0 then '-05:00' when 1 then '-04:00' else 'Z' end as v, case event_id % 3 when 0 then -18000 when 1 then -14400 else 0 end as named from events),
i as (select *, ts - to_seconds(named) as utc from e)
select event_id, epoch(timezone('America/New_York', timezone('UTC', utc))) - epoch(utc) = named as in_new_york, named = 0 as in_utc from i""")
def zone_offsets(spark, sf):
    e = table(spark, sf, "events")
    v = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "-05:00").when(F.col("event_id") % 3 == 1, "-04:00").otherwise("Z"))
    return e.select("event_id", values.offset_fits(v, "America/New_York").alias("in_new_york"), values.offset_fits(v, "Etc/UTC").alias("in_utc"))


@query(f"""with {TEXTS} select name, case when bool_and(lower(v) in ('true', 'false', '0', '1')) filter (v not in ('', 'NA')) then 'boolean' when bool_and(regexp_full_match(v, '[+-]?[0-9]+')) filter (v not in ('', 'NA')) then 'int64'
  when bool_and(regexp_full_match(v, '[0-9]+\\.[0-9]*')) filter (v <> '') then 'float64' when bool_and(regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) filter (v <> '') then 'date'
  when bool_and(regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}')) filter (v <> '') then 'timestamp' else 'string' end as data_type,
  case when bool_and(regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) filter (v <> '') then '%Y-%m-%d' end as format, bool_or(v in ('', 'null', 'NULL', 'NA')) as nullable from texts group by 1""")
def sample_types(spark, sf):
    """Columns of texts, one row an order, typed by all of their values."""
    wide = texts(spark, sf).groupBy("o_orderkey").pivot("name", ["key", "price", "day", "clock", "stamp", "flag", "span"]).agg(F.first("v"))
    return samples.infer_samples(wide, [c for c in wide.columns if c != "o_orderkey"])


@query("""with l as (select doc_id, string_split(string_split(text, chr(10))[1], ',') as cells from documents),
h as (select *, len(list_filter(cells, lambda c: c = '' or (regexp_full_match(c, '(?i)[+-]?(inf|infinity|nan|([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?)') and not regexp_matches(c, '\\p{L}')))) = 0 as header from l)
select doc_id, header, array_to_string(case when header then cells else list_transform(range(1, len(cells) + 1), lambda i: 'column_' || i) end, '|') as names from h""")
def header_rows(spark, sf):
    """The first line of each document as a header row."""
    first = F.substring_index("text", "\n", 1)
    cells = F.split(first, ",")
    return table(spark, sf, "documents").select("doc_id", samples.is_header(cells).alias("header"), F.array_join(samples.column_names(cells), "|").alias("names"))


def mixed_json(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON objects whose keys have one type, several, or are texts of numbers and days."""
    k = F.col("event_id")
    parts = (
        '{"n":', k.cast("string"), ',"half":', k.cast("string"), '.5,"flag":', F.when(k % 2 == 0, "true").otherwise("false"), ',"text":"', "event_type", '","digits":"', k.cast("string"),
        '","day":"', F.date_format("ts", "yyyy-MM-dd"), '","at":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), '","mixed":', F.when(k % 5 == 0, F.concat(F.lit('"'), k.cast("string"), F.lit('x"'))).otherwise(k.cast("string")), ',"wide":', F.when(k % 7 == 0, "1.5").otherwise("2"), "}",
    )
    return table(spark, sf, "events").select("event_id", F.concat(*[p if not isinstance(p, str) else F.col(p) if p == "event_type" else F.lit(p) for p in parts]).alias("json"))


MIXED = """
j as (select event_id, '{"n":' || event_id || ',"half":' || event_id || '.5,"flag":' || case when event_id % 2 = 0 then 'true' else 'false' end || ',"text":"' || event_type || '","digits":"' || event_id || '","day":"' || strftime(ts, '%Y-%m-%d') || '","at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
  || '","mixed":' || case when event_id % 5 = 0 then '"' || event_id || 'x"' else cast(event_id as varchar) end || ',"wide":' || case when event_id % 7 = 0 then '1.5' else '2' end || '}' as json from events),
v as (select name, json_type(json, '$.' || name) as t, json_extract_string(json, '$.' || name) as s from j, (values ('n'), ('half'), ('flag'), ('text'), ('digits'), ('day'), ('at'), ('mixed'), ('wide')) k(name))"""
JSON_KEYS = ["n", "half", "flag", "text", "digits", "day", "at", "mixed", "wide"]


@query(f"""with {MIXED}, f as (select name, bool_and(t = 'BOOLEAN' or (t = 'VARCHAR' and lower(s) in ('true', 'false', '1', '0'))) as b, bool_and((t <> 'VARCHAR' and t <> 'BOOLEAN' and try_cast(s as double) = floor(try_cast(s as double))) or (t = 'VARCHAR' and regexp_full_match(s, '[+-]?[0-9]+'))) as i,
  bool_and((t <> 'VARCHAR' and t <> 'BOOLEAN') or (t = 'VARCHAR' and try_cast(s as double) is not null)) as d, bool_and(t = 'VARCHAR' and regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) as day, bool_and(t = 'VARCHAR' and regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}')) as stamped from v group by 1),
c as (select name, list_filter([case when b then 'boolean' end, case when i then 'int64' end, case when d and not i then 'float64' end, case when day then 'date' end, case when stamped and not day then 'timestamp' end], lambda x: x is not null) as c from f)
select name, case when len(c) = 0 then 'string' else array_to_string(c, ',') end as candidates, case when len(c) <= 1 then 'constraint_elimination' else 'ambiguous_requires_human' end as method from c""")
def json_value_types(spark, sf):
    return samples.json_types(mixed_json(spark, sf), "json", JSON_KEYS)


@query(f"""with {MIXED}, g as (select distinct name, case when t = 'BOOLEAN' then 'boolean' when t = 'VARCHAR' then 'string' when t = 'DOUBLE' then 'double' else 'bigint' end as k from v)
select name, case when count(*) = 1 then any_value(k) when bool_and(k in ('bigint', 'double')) then 'double' else 'string' end as type from g group by 1""")
def mixed_columns(spark, sf):
    return samples.one_type(mixed_json(spark, sf), "json", JSON_KEYS)


# ---- quarantine

NUMBERED = f"with {ENFORCED}, bad as (select event_id, event_type, _cf_row_error as _error_msg, {VIOLATION} as _violation_type, row_number() over (order by event_id) - 1 as at from enforced where _cf_row_error is not null)"


def quarantined(spark: SparkSession, sf: str, broken: bool) -> DataFrame:
    raw = table(spark, sf, "events").select("event_id", "ts", "event_type", F.col("value").cast("string").alias("amount"), F.col("event_id").alias("__cf_row_id"))
    if broken:
        raw = raw.withColumn("__cf_row_id", F.when(F.col("event_id") % 10 != 0, F.col("event_id")))
    return contract.with_row_numbers(contract.split(contract.enforce(raw, EVENTS), "job-1")[1], "event_id")


@query(f"{NUMBERED} select event_id, _violation_type, event_id as _source_row, cast(null as bigint) as _output_row_index from bad order by event_id limit 200")
def quarantine_by_row(spark, sf):
    return quarantined(spark, sf, False).orderBy("_source_row").limit(200).select("event_id", "_violation_type", "_source_row", "_output_row_index")


@query(f"{NUMBERED} select event_id, cast(null as bigint) as _source_row, event_id as _output_row_index from bad")
def quarantine_by_index(spark, sf):
    """As the parser's row ids are broken for some rows, all have their place in the output."""
    return quarantined(spark, sf, True).select("event_id", "_source_row", "_output_row_index")


@query(f"{NUMBERED} select event_id, event_type, _error_msg from bad where _violation_type = 'schema' or _violation_type = 'null_not_allowed' order by event_id limit 5")
def quarantine_examples(spark, sf):
    bad = contract.split(enforced_events(spark, sf), "job-1")[1]
    return bad.where(F.col("_violation_type").isin("schema", "null_not_allowed")).orderBy("event_id").limit(5).select("event_id", "event_type", "_error_msg")


@query(f"with {ENFORCED} select e.event_id, 'user/' || u.user_id as path, sha256(u.user_id || chr(31)) as _cf_source_hash from enforced e join events u using (event_id) where e._cf_row_error is null")
def rows_to_files(spark, sf):
    """Valid rows with the file they came from: lineage's source hash against the catalog's."""
    raw = table(spark, sf, "events")
    source = raw.select("event_id", key_of(F.col("user_id")).alias("_cf_source_hash"))
    valid = contract.split(enforced_events(spark, sf), "job-1")[0].select("event_id").join(source, "event_id")
    catalog = raw.select("user_id").distinct().select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), key_of(F.col("user_id")).alias("source_hash"))
    return valid.join(catalog, F.col("_cf_source_hash") == F.col("source_hash")).select("event_id", "path", "_cf_source_hash")


DECLARED = [ContractColumn("event_id", "bigint"), ContractColumn("k", "bigint"), ContractColumn("flag", "boolean")]


@query("""select event_id as file, 'missing' as kind, 'flag' as "column", 'boolean' as expected, null as actual from events where event_id % 3 = 0 union all select event_id, 'extra', 'note', null, 'string' from events where event_id % 5 = 0
union all select event_id, 'type', 'k', 'bigint', 'string' from events where event_id % 7 = 0 union all select event_id, 'order', c, 'bigint', 'bigint' from events, (values ('event_id'), ('k')) x(c) where event_id % 11 = 0 and event_id % 3 <> 0 and event_id % 5 <> 0 and (c = 'event_id' or event_id % 7 <> 0)""")
def schema_mismatches(spark, sf):
    """The columns that each event's record has, against a contract."""
    k = F.col("event_id")
    swap = k % 11 == 0
    rows = F.array_compact(F.array(
        F.struct(F.lit("event_id").alias("name"), F.lit("bigint").alias("type"), F.when(swap, 1).otherwise(0).alias("position")),
        F.struct(F.lit("k").alias("name"), F.when(k % 7 == 0, "string").otherwise("bigint").alias("type"), F.when(swap, 0).otherwise(1).alias("position")),
        F.when(k % 3 != 0, F.struct(F.lit("flag").alias("name"), F.lit("boolean").alias("type"), F.lit(2).alias("position"))),
        F.when(k % 5 == 0, F.struct(F.lit("note").alias("name"), F.lit("string").alias("type"), F.lit(3).alias("position"))),
    ))
    observed = table(spark, sf, "events").select(k.alias("file"), F.explode(rows).alias("x")).select("file", "x.*")
    return contract.mismatches(observed, DECLARED)


# ---- keys


@query(f"""with {CATALOG}, t as (select *, sha256('out' || chr(31) || 'parquet://lake' || chr(31) || 'append' || chr(31) || '' || chr(31) || 'v1' || chr(31)) as target from cat)
select file_id, sha256(file_id || chr(31) || mtime || chr(31) || size || chr(31) || 'parser-1' || chr(31) || target || chr(31)) as materialization_key, sha256('mail' || ':' || '1.0' || ':' || extension) as scope_id from t""")
def materialization_keys(spark, sf):
    target = key_of("out", "parquet://lake", "append", "", "v1")
    key = key_of(F.col("file_id"), F.col("mtime"), F.col("size"), "parser-1", target)
    return files(spark, sf).select("file_id", key.alias("materialization_key"), contract.scope_id("mail", "1.0", F.col("extension")).alias("scope_id"))


@query(f"with {CATALOG} select c.file_id, sha256(html) as content_hash, case when c.file_id % 3 = 0 then 's3v:lake:' || c.file_id when c.file_id % 3 = 1 then 's3e:lake:' || md5(html) || ':' || c.size else 'path:' || rel_path end as uid from cat c join pages p on p.page_id = c.file_id")
def file_identities(spark, sf):
    html = table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("content_hash"), F.md5("html").alias("etag"))
    k = F.col("file_id")
    uid = values.file_uid(F.col("rel_path"), F.lit("lake"), F.when(k % 3 == 0, k.cast("string")), F.when(k % 3 == 1, F.col("etag")), F.col("size"))
    return files(spark, sf).join(html, F.col("page_id") == k).select("file_id", "content_hash", uid.alias("uid"))


@query(f"""with {CATALOG}, s as (select sha256(cast(file_id as varchar)) as h from cat where status <> 'deleted')
select count(*) as n_files, sha256(concat_ws(',', count(*), {', '.join(f"sum(cast(cast('0x' || substr(h, {1 + 8 * i}, 8) as bigint) as hugeint))" for i in range(4))})) as snapshot_hash from s""")
def snapshot_digest(spark, sf):
    """A selection's digest as sums, so no task holds the selection."""
    df = files(spark, sf).where("status <> 'deleted'")
    return df.agg(F.count("*").alias("n_files"), listing.set_digest(df, "file_id").alias("snapshot_hash"))


# ---- readers, sinks, streams


@query("select doc_id, (array_to_string(list_transform(range(1, least(17, strlen(text) + 1)), lambda i: substr(hex(encode(text)), 2 * i - 1, 2)), ' ')) as head from documents")
def raw_heads(spark, sf):
    return table(spark, sf, "documents").select("doc_id", lines.raw_head(F.encode("text", "utf-8"), 16).alias("head"))


@query("""with h as (select doc_id, case doc_id % 6 when 0 then text when 1 then '{"a": 1}' || chr(10) || '{"a": ' || doc_id || '}' when 2 then '[1, ' || doc_id || ']' when 3 then 'a,b' || chr(10) || '1,2' when 4 then 'a' || chr(9) || 'b' || chr(10) || '1' else 'PAR1' || doc_id end as head from documents)
select doc_id, case when doc_id % 6 = 1 then 'ndjson' when doc_id % 6 = 2 then 'json' when doc_id % 6 = 3 then 'csv' when doc_id % 6 = 4 then 'tsv' when doc_id % 6 = 5 then 'parquet' when regexp_matches(head, '[\\x00-\\x08\\x0E-\\x1F\\x{FFFD}]') then 'binary'
  when regexp_matches(ltrim(head), '^[\\[{]') then 'json' when contains(head, ',') and contains(head, chr(10)) then 'csv' when contains(head, chr(9)) and contains(head, chr(10)) then 'tsv' else 'text' end as format from h""")
def detected_formats(spark, sf):
    k = F.col("doc_id")
    head = (
        F.when(k % 6 == 0, F.col("text")).when(k % 6 == 1, F.concat(F.lit('{"a": 1}\n{"a": '), k.cast("string"), F.lit("}"))).when(k % 6 == 2, F.concat(F.lit("[1, "), k.cast("string"), F.lit("]")))
        .when(k % 6 == 3, F.lit("a,b\n1,2")).when(k % 6 == 4, F.lit("a\tb\n1")).otherwise(F.concat(F.lit("PAR1"), k.cast("string")))
    )
    return table(spark, sf, "documents").select("doc_id", lines.detect_format(head).alias("format"))


@query("select unnest(['csv', 'json', 'ndjson', 'parquet', 'tsv']) as format, count(*) as n_rows, cast(sum(c_custkey) as bigint) as keys, count(distinct c_name) as n_names, min(c_mktsegment) as segment from customer")
def formats_read_back(spark, sf):
    """Customers written in each format below the shared folder and read by its reader."""
    root = f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}"
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    out = None
    for kind in ("csv", "tsv", "json", "ndjson", "parquet"):
        at = f"{root}/{kind}"
        if kind == "json":  # files that hold an array each, of objects over many lines
            arrays = df.groupBy(F.floor(F.col("c_custkey") / 100).alias("g")).agg(F.replace(F.to_json(F.collect_list(F.struct(*df.columns))), F.lit(","), F.lit(",\n  ")).alias("content"))
            write_files(arrays.select(F.concat("g", F.lit(".json")).alias("rel_path"), "content"), at).write.format("noop").mode("overwrite").save()
        else:
            df.write.options(**({"header": True, "sep": "\t" if kind == "tsv" else ","} if kind.endswith("sv") else {})).format({"tsv": "csv", "ndjson": "json"}.get(kind, kind)).save(at)
        got = lines.read_table(spark, at, kind)
        one = got.agg(F.count("*").alias("n_rows"), F.sum(F.col("c_custkey").cast("bigint")).alias("keys"), F.count_distinct("c_name").alias("n_names"), F.min("c_mktsegment").alias("segment")).select(F.lit(kind).alias("format"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {ENFORCED} select 'events' as output, 'job-1' as job, count(*) as n_rows, cast(sum(event_id) as bigint) as keys from enforced where _cf_row_error is null union all select 'events_quarantine', 'job-1', count(*), cast(sum(event_id) as bigint) from enforced where _cf_row_error is not null")
def outputs_read_back(spark, sf):
    """Valid and quarantined rows written together, routed to their tables and read back by job."""
    root = f"{shared_folder(spark)}/lake-{uuid.uuid4().hex}"
    valid, bad = contract.split(enforced_events(spark, sf), "job-1")
    uri = sinks.route("events", {"*": f"parquet://{root}"})
    name, _ = sinks.quarantine_sink("events", uri)
    at = sinks.write_all({"events": valid, name: bad}, root, "job-1")
    out = None
    for output, folder in at.items():
        one = spark.read.parquet(folder).groupBy("job").agg(F.count("*").alias("n_rows"), F.sum("event_id").alias("keys")).select(F.lit(output).alias("output"), "job", "n_rows", "keys")
        out = one if out is None else out.unionByName(one)
    return out


@query("select event_type, count(*) as n_rows, cast(sum(event_id) as bigint) as keys from events group by 1")
def appended_twice(spark, sf):
    """A file sink appends: events written in two halves by their sink's uri."""
    root = f"{shared_folder(spark)}/append-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", "event_type")
    for half in (0, 1):
        sinks.write(e.where(F.col("event_id") % 2 == half), f"parquet://{root}")
    return spark.read.parquet(root).groupBy("event_type").agg(F.count("*").alias("n_rows"), F.sum("event_id").alias("keys"))


@query(f"with {ENFORCED} select 'valid' as output, count(*) as n_rows, cast(sum(event_id) as bigint) as keys from enforced where _cf_row_error is null union all select 'quarantine', count(*), cast(sum(event_id) as bigint) from enforced where _cf_row_error is not null")
def streamed_contract(spark, sf):
    """The contract on a stream of the table's files, run twice: the second run finds nothing new."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    for _ in range(2):
        valid, bad = run_available(spark, f"{sf}/events*", schema, EVENTS, ["event_id", "ts", "event_type", "cast(value as string) amount"], out, "job-1")
    one = lambda name, df: df.agg(F.count("*").alias("n_rows"), F.sum("event_id").alias("keys")).select(F.lit(name).alias("output"), "n_rows", "keys")
    return one("valid", valid).unionByName(one("quarantine", bad))


@query(f"""with {RUNS}, p as (select file, count(*) as n_runs, count(*) filter (passed) as n_passed, max(run) filter (passed) as last_pass from runs group by 1), h as (select p.file, n_runs, n_passed, count(r.run) as n_consecutive from p left join runs r on r.file = p.file and not r.passed and (last_pass is null or r.run > last_pass) group by all)
select file, case when n_consecutive > 0 then 0 when n_passed < n_runs then 1 else 2 end as bucket, n_consecutive from h order by bucket, n_consecutive desc, file limit 100""")
def backtest_queue(spark, sf):
    return backtest.backtest_order(backtest.consecutive_failures(runs(spark, sf))).limit(100).select("file", "bucket", "n_consecutive")


@query("""with g as (select l_orderkey * 8 + l_linenumber as k from lineitem), p as (select k, 'd' || (k % 100) || '/d' || (k % 97) || '/file_' || k || '.dat' as rel_path, k % 4096 as size from g),
b as (select rel_path, size + case when k % 7 = 0 then 1 else 0 end as size from p where k % 10 <> 0), n as (select rel_path, size from p where k % 11 <> 0)
select case when b.rel_path is null then 'new' when n.rel_path is null then 'deleted' when b.size = n.size then 'unchanged' else 'changed' end as state, count(*) as n_files from n full join b using (rel_path) group by 1""")
def generated_upsert(spark, sf):
    """Made-up paths of line items as two scans of a catalog, merged."""
    keys = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    made = lambda df: lines.made_paths(df, "k", (100, 97), 4096)
    shifted = made(keys.where("k % 10 <> 0 and k % 7 = 0")).withColumn("size", F.col("size") + 1)
    before = made(keys.where("k % 10 <> 0 and k % 7 <> 0")).unionByName(shifted).withColumn("status", F.lit("processed"))
    return catalog.upsert(before, made(keys.where("k % 11 <> 0")), "rel_path", ["size"]).groupBy("state").agg(F.count("*").alias("n_files"))


@query("select 'd' || (o_orderkey % 10) || '/d' || (o_orderkey % 7) || '/file_' || o_orderkey || '.dat' as rel_path, o_orderkey % 4096 as size from orders")
def generated_paths(spark, sf):
    return lines.made_paths(table(spark, sf, "orders"), "o_orderkey", (10, 7), 4096)


@query(f"""with {CATALOG}, k as (select file_id, sha256(file_id || chr(31) || mtime || chr(31) || size || chr(31) || 'parser-1' || chr(31) || 't' || chr(31)) as key from cat where file_id % 4 <> 0),
n as (select file_id, sha256(file_id || chr(31) || (mtime + case when file_id % 5 = 0 then 1 else 0 end) || chr(31) || size || chr(31) || 'parser-1' || chr(31) || 't' || chr(31)) as key from cat)
select file_id from n where key not in (select key from k)""")
def new_generations(spark, sf):
    """Files to process in a second scan: those not seen, and those seen whose time of change is another."""
    df = files(spark, sf)
    keyed = lambda mtime: key_of(F.col("file_id"), mtime, F.col("size"), "parser-1", "t").alias("key")
    done = df.where("file_id % 4 <> 0").select(keyed(F.col("mtime")))
    now = df.select("file_id", keyed(F.col("mtime") + F.when(F.col("file_id") % 5 == 0, 1).otherwise(0)))
    return catalog.to_process(now, done)


@query("with best as (select event_type as k from events group by 1 order by count(*) desc, k limit 3) select coalesce(k, '_MISC') as shard, count(*) as n_rows, cast(sum(event_id) as bigint) as keys from events left join best on event_type = k group by 1")
def shards_read_back(spark, sf):
    """Shards written in folders of their own and read back."""
    at = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    shred.write_shards(shred.shards(table(spark, sf, "events").select("event_id", "event_type"), "event_type", 3), at)
    return spark.read.parquet(at).groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("event_id").alias("keys"))


@query(f"with {ENFORCED} select v.event_type, v.n_rows, coalesce(q.n_quarantined, 0) as n_quarantined from (select event_type, count(*) as n_rows from enforced where _cf_row_error is null group by 1) v left join (select event_type, count(*) as n_quarantined from enforced where _cf_row_error is not null group by 1) q using (event_type)")
def views_over_outputs(spark, sf):
    """Free SQL over views of written outputs, behind the read-only gate."""
    root = f"{shared_folder(spark)}/views-{uuid.uuid4().hex}"
    valid, bad = contract.split(enforced_events(spark, sf), "job-1")
    sinks.register_views(spark, sinks.write_all({"events": valid, "events_quarantine": bad}, root, "job-1"))
    return sql_gate.read_only(spark, """
        select v.event_type, v.n_rows, coalesce(q.n_quarantined, 0) as n_quarantined from (select event_type, count(*) as n_rows from outputs_events group by 1) v
        left join (select event_type, count(*) as n_quarantined from outputs_events_quarantine group by 1) q using (event_type)""", 1000)
