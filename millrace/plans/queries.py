"""Registered queries of the ingestion operators over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import binned, failure_category, key_of, redact_hash, redact_truncate, retryable, safe_name
from millrace.operators import backtest, catalog, contract, inference, listing, paths, shred, sinks, sql_gate
from millrace.operators.catalog import TagRule
from millrace.operators.contract import ContractColumn
from millrace.sources import fix, fix_outputs, lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- contracts

EVENTS = [ContractColumn("event_id", "bigint", False), ContractColumn("ts", "timestamp_ntz"), ContractColumn("event_type", "string", False), ContractColumn("amount", "decimal(10,1)", False)]


def enforced_events(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select("event_id", "ts", "event_type", F.col("value").cast("string").alias("amount"))
    return contract.enforce(raw, EVENTS)


ENFORCED = """
enforced as (
  select event_id, ts, event_type, case when ok then cast(v as decimal(10,1)) end as amount,
    nullif(concat_ws('; ', case when not ok and v <> '' then 'schema: value does not match format ''decimal(10,1)'' for ''amount''' end,
      case when event_id is null then 'schema: null not allowed in ''event_id''' end, case when event_type is null then 'schema: null not allowed in ''event_type''' end,
      case when not coalesce(ok, false) then 'schema: null not allowed in ''amount''' end), '') as _cf_row_error
  from (select *, regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]?|\\.[0-9])') and length(regexp_replace(v, '[^0-9]', '', 'g')) <= 10 as ok from (select *, cast(value as varchar) as v from events))
)"""
VIOLATION = "case when trim(coalesce(_cf_row_error, '')) = '' then 'unknown' when starts_with(_cf_row_error, 'schema:') and contains(_cf_row_error, 'null') then 'null_not_allowed' when starts_with(_cf_row_error, 'schema:') then 'schema' else 'parser' end"


@query(f"with {ENFORCED} select * from enforced")
def contract_enforcement(spark, sf):
    return enforced_events(spark, sf)


@query(f"with {ENFORCED} select {VIOLATION} as _violation_type, count(*) as n_rows from enforced where _cf_row_error is not null group by 1")
def quarantine_by_violation(spark, sf):
    return contract.split(enforced_events(spark, sf), "job-1")[1].groupBy("_violation_type").agg(F.count("*").alias("n_rows"))


@query(f"with {ENFORCED} select 'quarantine' as output, count(*) as n_rows from enforced where _cf_row_error is not null union all select 'valid', count(*) from enforced where _cf_row_error is null")
def output_counts(spark, sf):
    valid, bad = contract.split(enforced_events(spark, sf), "job-1")
    return sinks.count_rows({"valid": valid, "quarantine": bad})


@query(f"with {ENFORCED} select count(*) as n_rows, count(_cf_row_error) as n_quarantined, case when count(_cf_row_error) = 0 then 'accepted' when count(_cf_row_error) * 100 > 10.0 * count(*) then 'too large a share' else 'accepted' end as verdict from enforced")
def quarantine_policy(spark, sf):
    return contract.policy_verdict(enforced_events(spark, sf), contract.QuarantinePolicy(allowed=True))


@query(f"with {ENFORCED} select event_id, ts, event_type, amount, sha256(cast(event_id as varchar) || chr(31)) as _cf_source_hash, 'job-1' as _cf_job_id, '2026-01-01T00:00:00Z' as _cf_processed_at, 'v1' as _cf_parser_version from enforced where _cf_row_error is null")
def lineage_rows(spark, sf):
    valid, _ = contract.split(enforced_events(spark, sf), "job-1")
    return contract.with_lineage(valid, key_of(F.col("event_id")), "job-1", "v1", F.lit("2026-01-01T00:00:00Z"))


@query(f"with {ENFORCED} select event_id, ts, event_type, _cf_row_error as _error_msg, {VIOLATION} as _violation_type, 'job-1' as _cf_job_id from enforced where _cf_row_error is not null order by ts desc, event_id limit 20")
def latest_quarantined(spark, sf):
    _, bad = contract.split(enforced_events(spark, sf), "job-1")
    return bad.orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "ts", "event_type", "_error_msg", "_violation_type", "_cf_job_id")


@query(f"with {ENFORCED} select event_id, event_type, amount, cast(null as varchar) as _error_msg from enforced where _cf_row_error is null union all select event_id, event_type, amount, _cf_row_error from enforced where _cf_row_error is not null")
def job_rows(spark, sf):
    valid, bad = contract.split(enforced_events(spark, sf), "job-1")
    return valid.select("event_id", "event_type", "amount").unionByName(bad.select("event_id", "event_type", "amount", "_error_msg"), allowMissingColumns=True)


@query("select o_orderkey, case when strftime(o_orderdate, '%d') <= '12' then cast(strptime(strftime(o_orderdate, '%Y-%d-%m'), '%Y-%m-%d') as date) end as day, case when strftime(o_orderdate, '%d') > '12' then 'schema: value does not match format ''%Y-%m-%d'' for ''day''' end as _cf_row_error from orders")
def date_contract(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-dd-MM").alias("day"))
    return contract.enforce(raw, [ContractColumn("o_orderkey", "bigint"), ContractColumn("day", "date", True, "%Y-%m-%d")])


@query("""with b as (select unnest(['c_custkey', 'c_acctbal', 'c_mktsegment']) as name, unnest([cast(c_custkey as varchar), cast(cast(floor(c_acctbal) as bigint) as varchar) || '.5', c_mktsegment]) as v from customer),
a as (select unnest(['c_custkey', 'c_mktsegment', 'c_rank']) as name, unnest([case when c_custkey % 50 <> 0 then cast(c_custkey as varchar) end, cast(length(c_mktsegment) * 11 as varchar), 'r' || c_custkey]) as v from customer),
t as (select side, name, case when bool_and(regexp_full_match(v, '-?[0-9]+')) then 'integer' when bool_and(regexp_full_match(v, '-?[0-9]+\\.[0-9]+')) then 'float' else 'string' end as type, count(*) > count(v) as nullable from (select 'b' as side, * from b union all select 'a', * from a) group by 1, 2)
select name, case when o.name is null then 'added' when n.name is null then 'removed' when o.type <> n.type then 'type' else 'nullability' end as change
from (select * from t where side = 'b') o full join (select * from t where side = 'a') n using (name) where o.name is null or n.name is null or o.type <> n.type or o.nullable <> n.nullable""")
def schema_diff(spark, sf):
    """Schemas that the rows of two customer files have, compared."""
    c = table(spark, sf, "customer")
    before = c.select("c_custkey", F.concat(F.floor("c_acctbal").cast("string"), F.lit(".5")).alias("c_acctbal"), "c_mktsegment")
    after = c.select(F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey")).alias("c_custkey"), (F.length("c_mktsegment") * 11).alias("c_mktsegment"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("c_rank"))
    seen = lambda df: inference.infer(df, df.columns).select("name", F.col("resolved").alias("type"), (F.col("n_null") > 0).alias("nullable"))
    return contract.schema_changes(seen(before), seen(after))


@query("select event_id, case when event_id % 7 = 0 or props is null then 'null_values' end as _error_reason from events")
def any_null_split(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("props"))
    return contract.any_null(df).select("event_id", "_error_reason")


@query("select event_id, value * 2 as value_doubled, case when value <= 0 then null when value <= 100 then 'low' when value <= 200 then 'medium' when value <= 300 then 'high' when value <= 500 then 'very_high' end as value_category from events")
def quantity_bins(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", (v * 2).alias("value_doubled"), binned(v, (0, 100, 200, 300, 500), ("low", "medium", "high", "very_high")).alias("value_category"))


# ---- catalog

CATALOG = """
cat as (
  select *, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) as parent_path, regexp_extract(rel_path, '([^/]*)$', 1) as name, lower(regexp_extract(regexp_extract(rel_path, '([^/]*)$', 1), '[^.]\\.([^.]+)$', 1)) as extension
  from (select page_id as file_id, host, host || '/' || path as rel_path, size, mtime, status from (
    select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) as path, cast(length(html) as bigint) as size, page_id * 3600000 as mtime,
      case page_id % 5 when 0 then 'pending' when 1 then 'failed' when 2 then 'deleted' else 'processed' end as status from pages))
)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as a file catalog: the url without its scheme and query is the path."""
    url, k = F.col("url"), F.col("page_id")
    host, path = F.regexp_extract(url, "://([^/?#]*)", 1), F.regexp_extract(url, "://[^/?#]*/([^?#]*)", 1)
    status = F.when(k % 5 == 0, "pending").when(k % 5 == 1, "failed").when(k % 5 == 2, "deleted").otherwise("processed")
    df = table(spark, sf, "pages").select(k.alias("file_id"), host.alias("host"), F.concat(host, F.lit("/"), path).alias("rel_path"), F.length("html").cast("long").alias("size"), (k * 3600000).alias("mtime"), status.alias("status"))
    return catalog.with_path_parts(df)


@query(f"with {CATALOG} select file_id, rel_path, parent_path, name, extension from cat")
def path_parts(spark, sf):
    return files(spark, sf).select("file_id", "rel_path", "parent_path", "name", "extension")


@query(f"with {CATALOG} select file_id, rel_path, size from cat where regexp_full_match(rel_path, '(?i)(.*/)?en/[^/]*') and not regexp_full_match(rel_path, '(?i)(.*/)?[^/]*\\.html') and size >= 500 order by rel_path, file_id")
def filtered_scan(spark, sf):
    return catalog.scan_filter(catalog.without_excluded(files(spark, sf)), ("**/en/*",), ("*.html",), min_size=500).select("file_id", "rel_path", "size").orderBy("rel_path", "file_id")


@query(f"with {CATALOG} select count(*) as n_files, count(*) filter (status = 'pending') as n_pending, count(*) filter (status = 'processed') as n_processed, count(*) filter (status = 'failed') as n_failed, cast(coalesce(sum(size) filter (status = 'pending'), 0) as bigint) as pending_bytes, cast(coalesce(sum(size) filter (status = 'processed'), 0) as bigint) as processed_bytes from cat")
def catalog_stats(spark, sf):
    return catalog.stats(files(spark, sf))


@query(f"with {CATALOG} select case extension when '' then '(no ext)' else extension end as extension, count(*) as n_files, cast(sum(size) as bigint) as n_bytes from cat group by 1")
def files_by_extension(spark, sf):
    return catalog.by_extension(files(spark, sf))


@query(f"with {CATALOG} select string_split(rel_path, '/')[1] as child, count(*) as n_files, bool_or(not contains(rel_path, '/')) as is_file from cat group by 1 order by n_files desc, child limit 500")
def root_folders(spark, sf):
    return catalog.children(files(spark, sf), "", 500)


RULES = [TagRule("english", "**/en/**", "lang-en", 5), TagRule("html", "*.html", "web", 5), TagRule("german", "**/de/*", "lang-de", 9), TagRule("blogs", "blog.*/**", "blog", 1)]
MATCHED = """
matched as (select *, case when regexp_full_match(rel_path, '(?i)(.*/)?de/[^/]*') then 'german' when regexp_full_match(rel_path, '(?i)(.*/)?en/.*') then 'english' when regexp_full_match(rel_path, '(?i)(.*/)?[^/]*\\.html') then 'html' when regexp_full_match(rel_path, '(?i)blog\\.[^/]*/.*') then 'blogs' end as rule from cat),
tagged as (select *, case rule when 'german' then 'lang-de' when 'english' then 'lang-en' when 'html' then 'web' when 'blogs' then 'blog' end as tag from matched)"""


@query(f"with {CATALOG}, {MATCHED} select file_id, rule, tag from tagged")
def first_matching_rule(spark, sf):
    return catalog.first_rule(files(spark, sf), RULES).select("file_id", "rule", "tag")


@query(f"with {CATALOG}, {MATCHED} select coalesce(rule, '(untagged)') as rule, count(*) as n_files, cast(sum(size) as bigint) as n_bytes from tagged group by 1")
def tagging_summary(spark, sf):
    return catalog.first_rule(files(spark, sf), RULES).groupBy(F.coalesce("rule", F.lit("(untagged)")).alias("rule")).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


@query(f"""with {CATALOG}, r(rule, re) as (values ('german', '(?i)(.*/)?de/[^/]*'), ('english', '(?i)(.*/)?en/.*'), ('html', '(?i)(.*/)?[^/]*\\.html'), ('blogs', '(?i)blog\\.[^/]*/.*'))
select rule, count(*) as n_files from cat join r on regexp_full_match(rel_path, re) group by 1""")
def rule_match_counts(spark, sf):
    return catalog.all_rules(files(spark, sf), RULES).groupBy("rule").agg(F.count("*").alias("n_files"))


@query(f"with {CATALOG}, {MATCHED} select tag, count(*) as n_files, count(*) filter (status = 'processed') as n_processed, count(*) filter (status = 'failed') as n_failed, cast(sum(size) as bigint) as n_bytes from tagged where tag is not null group by 1")
def tag_stats(spark, sf):
    done, bad = F.col("status") == "processed", F.col("status") == "failed"
    tagged = catalog.first_rule(files(spark, sf), RULES).where("tag is not null")
    return tagged.groupBy("tag").agg(F.count("*").alias("n_files"), F.count_if(done).alias("n_processed"), F.count_if(bad).alias("n_failed"), F.sum("size").alias("n_bytes"))


@query(f"with {CATALOG}, {MATCHED} select file_id, rel_path from tagged where tag is null")
def untagged_files(spark, sf):
    return catalog.first_rule(files(spark, sf), RULES).where("tag is null").select("file_id", "rel_path")


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    now = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    before = now.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("status", F.lit("processed"))
    return before, now.where("o_orderkey % 11 <> 0")


SNAPSHOTS = """
past as (select o_orderkey, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice, 'processed' as status from orders where o_orderkey % 10 <> 0),
present as (select o_orderkey, o_totalprice from orders where o_orderkey % 11 <> 0),
states as (select coalesce(n.o_orderkey, p.o_orderkey) as o_orderkey, n.o_totalprice as new_price, p.o_totalprice as old_price, case when p.o_orderkey is null then 'new' when n.o_orderkey is null then 'deleted' when n.o_totalprice is not distinct from p.o_totalprice then 'unchanged' else 'changed' end as state from present n full join past p on n.o_orderkey = p.o_orderkey)"""


@query(f"with {SNAPSHOTS} select state, count(*) as n_rows from states group by 1")
def snapshot_diff(spark, sf):
    before, now = snapshots(spark, sf)
    return catalog.diff(before, now, ["o_orderkey"], ["o_totalprice"]).groupBy("state").agg(F.count("*").alias("n_rows"))


@query(f"with {SNAPSHOTS} select o_orderkey, case state when 'deleted' then old_price else new_price end as o_totalprice, case state when 'deleted' then 'deleted' when 'unchanged' then 'processed' else 'pending' end as status, state from states")
def snapshot_upsert(spark, sf):
    before, now = snapshots(spark, sf)
    return catalog.upsert(before, now, "o_orderkey", ["o_totalprice"])


@query(f"with {CATALOG} select cast(file_id as varchar) as uid, rel_path as old_path, rel_path || '.moved' as new_path from cat where file_id % 9 = 0")
def renamed_files(spark, sf):
    before = files(spark, sf).select(F.col("file_id").cast("string").alias("uid"), "rel_path")
    now = before.withColumn("rel_path", F.when(F.col("uid").cast("long") % 9 == 0, F.concat("rel_path", F.lit(".moved"))).otherwise(F.col("rel_path")))
    return catalog.renames(before, now)


@query("""with wanted as (select o_orderkey as file_id, sha256(o_orderkey || chr(31) || 'parser-1' || chr(31) || t || chr(31)) as key, t from orders, (values ('out'), ('audit')) x(t)),
done as (select key from wanted where not (file_id % 3 = 0 or (file_id % 5 = 0 and t = 'audit')))
select file_id from wanted left join done using (key) group by file_id having count(done.key) < count(*)""".replace("left join done using (key)", "left join done on wanted.key = done.key"))
def incremental_skip(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.explode(F.array(F.lit("out"), F.lit("audit"))).alias("t"))
    wanted = wanted.withColumn("key", key_of(F.col("file_id"), "parser-1", F.col("t")))
    gone = (F.col("file_id") % 3 == 0) | ((F.col("file_id") % 5 == 0) & (F.col("t") == "audit"))
    return catalog.to_process(wanted.drop("t"), wanted.where(~gone).select("key"))


@query(f"""with {CATALOG}, s as (select *, sha256(cast(file_id as varchar)) as h from cat where status <> 'deleted' and extension = 'html' and mtime <= 720000000 and mtime >= 120000000)
select count(*) as n_files, max(mtime) as watermark, sha256(concat_ws(',', count(*), {', '.join(f"coalesce(sum(cast(cast('0x' || substr(h, {1 + 8 * i}, 8) as bigint) as hugeint)), 0)" for i in range(4))})) as snapshot_hash from s""")
def pipeline_selection(spark, sf):
    got = catalog.select_files(files(spark, sf), "html", 720000000, 600000000)
    return got.agg(F.count("*").alias("n_files"), F.max("mtime").alias("watermark"), listing.set_digest(got, "file_id").alias("snapshot_hash"))


@query(f"with {CATALOG} select file_id, rel_path, mtime from cat where extension = 'html' order by mtime desc, rel_path limit 50 offset 10")
def newest_files(spark, sf):
    return files(spark, sf).where("extension = 'html'").orderBy(F.desc("mtime"), "rel_path").offset(10).limit(50).select("file_id", "rel_path", "mtime")


@query("select doc_id, lang from documents order by sha256('42:' || doc_id), doc_id limit 100")
def seeded_sample(spark, sf):
    return catalog.sample(table(spark, sf, "documents").select("doc_id", "lang"), 100, "doc_id")


@query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by sha256('42:' || doc_id), doc_id) as rn from documents) where rn <= 8")
def stratified_sample(spark, sf):
    return catalog.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", 8, "doc_id")


@query("select cast(d as date) as day, n_events from (select distinct cast(ts as date) as d, 1 from events) x(d, k) join (select cast(ts as date) as e, count(*) as n_events from events group by 1) on d = e where day(d) % 3 <> 0")
def backfill_days(spark, sf):
    events = table(spark, sf, "events").select(F.to_date("ts").alias("day"))
    span = events.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    runs = events.where(F.dayofmonth("day") % 3 == 0).select("day").distinct()
    counts = events.groupBy("day").agg(F.count("*").alias("n_events"))
    return span.join(runs, "day", "left_anti").join(counts, "day")


# ---- inference

@query("""with texts as (select 'o_orderkey' as name, cast(o_orderkey as varchar) as v from orders union all select 'o_orderstatus', o_orderstatus from orders union all select 'o_totalprice', cast(round(o_totalprice) as bigint) || '.5' from orders union all select 'day', '  ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' from orders
  union all select 'us_day', strftime(o_orderdate, '%m/%d/%y') from orders union all select 'void', 'NA' from orders),
trimmed as (select name, trim(v) as v from texts), judged as (select *, v is null or v = '' or lower(v) = 'null' or v = 'NA' as nul from trimmed),
f as (select name, count(*) filter (nul) as n_null, count(*) filter (not nul) as n_values,
  bool_and(lower(v) in ('true', 'false', 'yes', 'no', 'y', 'n', '1', '0', 't', 'f')) filter (not nul) as boolean, bool_and(regexp_full_match(v, '[+-]?[0-9]+')) filter (not nul) as integer, bool_and(regexp_full_match(v, '[+-]?[0-9]*\\.?[0-9]*')) filter (not nul) as float,
  bool_and(regexp_full_match(v, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') and try_strptime(v, '%Y-%m-%d') is not null) filter (not nul) as ymd, bool_and(regexp_full_match(v, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}') and try_strptime(v, '%m/%d/%y') is not null) filter (not nul) as mdy,
  bool_and(regexp_full_match(v, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}') and try_strptime(v, '%d/%m/%y') is not null) filter (not nul) as dmy, bool_and(regexp_full_match(v, '[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}') and try_strptime(v, '%y/%m/%d') is not null) filter (not nul) as yymd from judged group by name),
p as (select *, list_filter([case when boolean then 'boolean' end, case when integer then 'integer' end, case when float then 'float' end, case when ymd or mdy or dmy or yymd then 'date' end], lambda x: x is not null) as t from f)
select name, n_null, n_values, array_to_string(list_filter([*t, case when n_values > 0 then 'string' end], lambda x: x is not null), ',') as possible,
  case when n_values = 0 then 'null' when len(t) = 0 then 'string' when len(t) = 1 then t[1] when t = ['integer', 'float'] then 'integer' else 'ambiguous' end as resolved,
  array_to_string(list_filter([case when ymd then '%Y-%m-%d' end, case when dmy then '%d/%m/%y' end, case when mdy then '%m/%d/%y' end, case when yymd then '%y/%m/%d' end], lambda x: x is not null), ',') as date_formats from p""".replace("[*t, case when n_values > 0 then 'string' end]", "list_append(t, case when n_values > 0 then 'string' end)"))
def inferred_types(spark, sf):
    df = texts_of_orders(spark, sf)
    return inference.infer(df, df.columns)


def texts_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with columns whose types are to be inferred."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderstatus", F.concat(F.round("o_totalprice").cast("long").cast("string"), F.lit(".5")).alias("o_totalprice"), F.date_format("o_orderdate", "'  'yyyy-MM-dd' '").alias("day"), F.date_format("o_orderdate", "MM/dd/yy").alias("us_day"), F.lit("NA").alias("void"))


# ---- sources

@query(r"select doc_id, unnest(range(1, len(l) + 1)) as line_number, unnest(l) as raw from (select doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) as l from documents)")
def document_lines(spark, sf):
    return lines.raw_lines(table(spark, sf, "documents"), "text", ["doc_id"])


@query("select event_id, k as key, json_extract_string(props, '$.' || k) as value_raw, 'int' as value_type, cast(json_extract_string(props, '$.' || k) as bigint) as value_int64 from (select event_id, props, unnest(json_keys(props)) as k from events)")
def event_properties(spark, sf):
    return lines.json_pairs(table(spark, sf, "events"), "props", ["event_id"])


def fix_lines(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    report = F.concat(F.lit("8=FIX.4.2|35=8|34="), k, F.lit("|11="), k, F.lit("|150="), (F.col("o_orderkey") % 6).cast("string"), F.lit("|39="), F.col("o_orderstatus"), F.lit("|10=000|"))
    order = F.concat(F.lit("log: 8=FIX.4.2|35=D|34="), k, F.lit("|49=C"), F.col("o_custkey").cast("string"), F.lit("|56=BRK|11="), k, F.lit("|38="), F.round("o_totalprice").cast("long").cast("string"), F.lit(".12345678905|10=000|"))
    return o.select("o_orderkey", F.concat(order, report).alias("line"))


FIX = """
l as (select o_orderkey, 'log: 8=FIX.4.2|35=D|34=' || o_orderkey || '|49=C' || o_custkey || '|56=BRK|11=' || o_orderkey || '|38=' || cast(round(o_totalprice) as bigint) || '.12345678905|10=000|' || '8=FIX.4.2|35=8|34=' || o_orderkey || '|11=' || o_orderkey || '|150=' || (o_orderkey % 6) || '|39=' || o_orderstatus || '|10=000|' as line, o_custkey, o_totalprice, o_orderstatus from orders)"""


@query(f"""with {FIX}
select o_orderkey, 0 as message_index, sha256(line) as raw_line_hash, 'order' as kind, 'D' as msg_type, null as exec_type, null as ord_status, o_orderkey as msg_seq_num, 'C' || o_custkey as sender_comp_id, 'BRK' as target_comp_id, cast(o_orderkey as varchar) as cl_ord_id, cast(null as varchar) as symbol, cast(cast(round(o_totalprice) as bigint) || '.1234567891' as decimal(38,10)) as order_qty, cast(null as decimal(38,10)) as price, 'new_order' as lifecycle_event from l
union all
select o_orderkey, 1, sha256(line), 'order', '8', cast(o_orderkey % 6 as varchar), o_orderstatus, o_orderkey, null, null, cast(o_orderkey as varchar), null, null, null, case o_orderkey % 6 when 0 then 'ack' when 1 then 'partial_fill' when 2 then 'fill' when 4 then 'cancel' when 5 then 'replace' else 'exec_report' end from l""")
def fix_messages(spark, sf):
    return fix_outputs.typed_messages(fix_lines(spark, sf))


@query(f"""with {FIX}, m as (select o_orderkey, unnest(['8=FIX' || string_split(line, '8=FIX')[2], '8=FIX' || string_split(line, '8=FIX')[3]]) as message, unnest([0, 1]) as message_index from l),
f as (select o_orderkey, message_index, unnest(string_split(message, '|')) as field, unnest(range(1, len(string_split(message, '|')) + 1)) as position from m)
select o_orderkey, message_index, string_split(field, '=')[1] as tag, substr(field, instr(field, '=') + 1) as value, position from f where field <> ''""")
def fix_tags(spark, sf):
    return fix.tags(fix_lines(spark, sf))


@query("select o_orderkey, msg_seq_num, e as lifecycle_event from (select o_orderkey, o_orderkey as msg_seq_num, unnest(['new_order', case o_orderkey % 6 when 0 then 'ack' when 1 then 'partial_fill' when 2 then 'fill' when 4 then 'cancel' when 5 then 'replace' else 'exec_report' end]) as e from orders where o_orderkey = (select min(o_orderkey) from orders))")
def order_history(spark, sf):
    parsed = fix_outputs.typed_messages(fix_lines(spark, sf))
    first = table(spark, sf, "orders").agg(F.min("o_orderkey").cast("string").alias("id"))
    return parsed.join(F.broadcast(first), parsed.cl_ord_id == F.col("id")).orderBy("msg_seq_num", "message_index").select("o_orderkey", "msg_seq_num", "lifecycle_event")


# ---- paths

@query(
    f"""with {CATALOG}, s as (select file_id, parent_path, unnest(string_split(parent_path, '/')) as seg, unnest(range(0, len(string_split(parent_path, '/')))) as i from cat),
k as (select file_id, i, case when regexp_full_match(seg, '(19[0-9]{{2}}|20[0-9]{{2}}|2100)') then '<date>' when regexp_full_match(seg, '[0-9]{{2,}}') then '<n>' else lower(seg) end as kind from s)
select template, count(*) as n_files, count(distinct parent_path) as n_folders, min(parent_path) as example from (select file_id, string_agg(kind, '/' order by i) as template from k group by 1) join cat using (file_id) group by 1"""
)
def path_archetypes(spark, sf):
    return paths.archetypes(files(spark, sf))


@query("select 'src-<n>_<date>' as template, count(*) as n_files, min('SRC-' || lpad(cast(o_orderkey % 90 + 10 as varchar), 2, '0') || '_' || strftime(o_orderdate, '%Y%m%d')) as example from orders".replace("src-<n>_<date>", "src_<n>_<date>"))
def naming_schemes(spark, sf):
    o = table(spark, sf, "orders")
    name = F.concat(F.lit("SRC-"), (F.col("o_orderkey") % 90 + 10).cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"))
    return paths.naming_schemes(o.select(name.alias("name")))


FIELDS = r"fields as (select page_id, unnest(regexp_extract_all(url, '([a-zA-Z_]\w*=[^/\\&?#]+)', 1)) as pair from pages), named as (select page_id, '_cf_path_' || string_split(pair, '=')[1] as field, substr(pair, instr(pair, '=') + 1) as value from fields)"


@query(f"with {FIELDS} select * from named")
def path_fields(spark, sf):
    p = table(spark, sf, "pages")
    return paths.path_fields(p, "url").select("page_id", "field", "value")


@query(f"with {FIELDS} select field, count(*) as n_found, count(distinct value) as n_values, case when bool_and(regexp_full_match(value, '-?[0-9]+')) then 'int' when bool_and(regexp_full_match(value, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) then 'date' else 'string' end as kind, min(value) as example, round(count(*) / (select count(*) from pages), 6) as coverage from named group by 1")
def path_field_coverage(spark, sf):
    p = table(spark, sf, "pages")
    return paths.field_coverage(paths.path_fields(p, "url"), p.agg(F.count("*").alias("n")))


@query(f"with {CATALOG}, s as (select unnest(string_split(rel_path, '/')) as segment, unnest(range(0, len(string_split(rel_path, '/')))) as position from cat) select position, count(*) as n_rows, count(distinct segment) as n_values, case when count(distinct segment) = 1 then 'fixed' when bool_and(regexp_full_match(segment, '(19|20)[0-9]{{2}}')) then 'year' when bool_and(regexp_full_match(segment, '[0-9]+')) then 'numeric' else 'text' end as kind from s group by 1")
def path_positions(spark, sf):
    return paths.positions(files(spark, sf))


@query("with c as (select source, count(*) as n from documents group by 1), t as (select sum(n) as total, count(*) as k from c) select any_value(k) as n_keys, round(-sum(n / total * ln(n / total)), 6) as entropy, round(1 + sum(n / total * ln(n / total)) / ln(any_value(k)), 6) as concentration from c, t")
def source_concentration(spark, sf):
    return paths.concentration(table(spark, sf, "documents"), "source")


# ---- quality loop

def runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    messages = F.element_at(F.array(*map(F.lit, ("Type mismatch in column", "null value", "bad FORMAT", "could not parse", "schema drift", "No such file", "boom"))), (F.col("event_id") % 7 + 1).cast("int"))
    passed = F.col("event_id") % 4 != 0
    return e.select(F.col("user_id").alias("file"), F.col("event_id").alias("run"), "event_type", passed.alias("passed"), F.when(~passed, messages).alias("error"))


RUNS = "runs as (select user_id as file, event_id as run, event_type, event_id % 4 <> 0 as passed, case when event_id % 4 = 0 then (['Type mismatch in column', 'null value', 'bad FORMAT', 'could not parse', 'schema drift', 'No such file', 'boom'])[event_id % 7 + 1] end as error, (['type_mismatch', 'null_not_allowed', 'format_mismatch', 'parse_error', 'schema_violation', 'file_not_found', 'unknown'])[event_id % 7 + 1] as category from events)"


@query(f"with {RUNS} select event_type, count(*) as n_tested, count(*) filter (passed) as n_passed, count(*) filter (not passed) as n_failed, round(avg(passed::int), 6) as pass_rate from runs group by 1")
def iteration_metrics(spark, sf):
    return backtest.iteration_metrics(runs(spark, sf), "event_type")


@query(f"with {RUNS} select category, count(*) as n_failures, count(distinct file) as n_files, min(error) as example from runs where not passed group by 1")
def failure_summary(spark, sf):
    return backtest.failure_summary(runs(spark, sf))


@query(f"with {RUNS}, p as (select file, count(*) as n_runs, count(*) filter (passed) as n_passed, max(run) filter (passed) as last_pass from runs group by 1) select p.file, n_runs, n_passed, count(r.run) as n_consecutive from p left join runs r on r.file = p.file and not r.passed and (last_pass is null or r.run > last_pass) group by all")
def parser_health(spark, sf):
    return backtest.consecutive_failures(runs(spark, sf))


@query(f"with {RUNS}, m as (select event_type, run // 1000 as iteration, round(avg(passed::int), 6) as pass_rate from runs group by all) select event_type, iteration, pass_rate, coalesce(pass_rate - lag(pass_rate, 2) over (partition by event_type order by iteration) < 0.01, false) as plateau from m")
def pass_rate_plateaus(spark, sf):
    m = runs(spark, sf).groupBy("event_type", F.floor(F.col("run") / 1000).alias("iteration")).agg(F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"))
    return backtest.plateaus(m, "event_type", "iteration")


@query(f"with {RUNS} select run, category, case when error = 'schema drift' then 'permanent' else 'transient' end as retry from runs where not passed")
def failure_categories(spark, sf):
    return runs(spark, sf).where("not passed").select("run", failure_category(F.col("error")).alias("category"), retryable(F.col("error")).alias("retry"))


# ---- redaction, shredding, sinks

@query("select c_custkey, '[hash:' || left(sha256(c_name), 8) || ']' as name_hash, case when length(c_mktsegment) > 4 then left(c_mktsegment, 4) || '...' else c_mktsegment end as segment from customer")
def redacted_customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", redact_hash(F.col("c_name")).alias("name_hash"), redact_truncate(F.col("c_mktsegment"), 4).alias("segment"))


@query(r"select p_partkey, case when regexp_full_match(p_type, '[a-z0-9_]+') then p_type else regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_' || left(sha256(p_type), 8) end as output_id from part")
def safe_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", safe_name(F.col("p_type")).alias("output_id"))


@query("with best as (select event_type as k from events group by 1 order by count(*) desc, k limit 3) select coalesce(k, '_MISC') as shard, count(*) as n_rows, min(event_id) as first_row, max(event_id) as last_row from events left join best on event_type = k group by 1")
def shard_metadata(spark, sf):
    return shred.shard_metadata(shred.shards(table(spark, sf, "events"), "event_type", 3), "event_id")


@query("select event_type as load, count(*) as call, sum(cast(round(value, 2) as decimal(12,2))) as mass from events group by 1")
def guarded_sql(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("guarded_events")
    text = "with sums as (select event_type as load, count(*) as call, sum(cast(round(value, 2) as decimal(12,2))) as mass from guarded_events group by 1) select load, call, mass from sums -- drop; nothing"
    return sql_gate.read_only(spark, text, 1000)


@query("select event_id, ts, event_type, value from events where event_type in ('click', 'purchase', 'error') order by ts, event_id limit 1000")
def event_timeline(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "purchase", "error")).orderBy("ts", "event_id").limit(1000).select("event_id", "ts", "event_type", "value")


@query(f"with {ENFORCED} select user_id as file, count(*) as n_rows from enforced join events using (event_id) where _cf_row_error is not null group by 1 order by n_rows desc, file limit 20")
def worst_files(spark, sf):
    raw = table(spark, sf, "events").select("event_id", "ts", "event_type", F.col("value").cast("string").alias("amount"), F.col("user_id").alias("file"))
    enforced = contract.enforce(raw, [*EVENTS, ContractColumn("file", dict(raw.dtypes)["file"])])
    return contract.split(enforced, "job-1")[1].groupBy("file").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "file").limit(20)
