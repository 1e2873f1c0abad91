"""Registered queries of path fields and positions in full, shards, redaction by type, policies, formats and excluded files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import redacted_json
from millrace.operators import amend, catalog, contract, paths, shred, structure
from millrace.operators.contract import ContractColumn, QuarantinePolicy
from millrace.plans.listing_queries import DATED, dated_paths, is_date
from millrace.plans.queries import CATALOG, ENFORCED, SNAPSHOTS, enforced_events, files, query, snapshots, table

# ---- paths


def partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as files in partition folders, with a day and a pair in the name."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.concat(F.lit("lake/status="), "o_orderstatus", F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/part_key="), F.col("o_custkey").cast("string")).alias("path"))


PAIRS = """
pairs as (select o_orderkey, 'partition' as kind, '_cf_path_status' as field, o_orderstatus as value from orders union all select o_orderkey, 'key_value', '_cf_path_part_key', cast(o_custkey as varchar) from orders
union all select o_orderkey, 'regex', '_cf_path_date', strftime(o_orderdate, '%Y-%m-%d') from orders)"""


@query(f"with {PAIRS} select * from pairs")
def partition_fields(spark, sf):
    return paths.dated_fields(partitioned(spark, sf), "path").drop("path")


@query(f"""with {PAIRS} select field, count(*) as n_found, count(distinct value) as n_values, case when bool_and(regexp_full_match(value, '[+-]?[0-9]+')) then 'int' when bool_and(regexp_full_match(value, '[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}')) then 'date' else 'string' end as kind,
  min(value) as example, round(count(*) / (select count(*) from orders), 6) as coverage from pairs group by 1""")
def partition_field_types(spark, sf):
    p = partitioned(spark, sf)
    return paths.field_coverage(paths.dated_fields(p, "path"), p.agg(F.count("*").alias("n")))


@query(f"""with {DATED}, s as (select unnest(string_split(rel_path, '/')) as s, unnest(range(0, 6)) as position from dated), a as (select position, count(*) as n_rows, min(s) as lo, max(s) as hi,
  bool_and(regexp_full_match(s, '[0-9]{{4}}')) as years, bool_and(regexp_full_match(s, '[0-9]+')) as numeric, count(distinct regexp_extract(s, '([^.]*)$', 1)) as n_ext, count(*) filter (starts_with(s, 'client_') or starts_with(s, 'sum-')) as entity from s group by 1)
select position, case when lo = hi then 'fixed' when entity > 0.8 * n_rows then 'entity' when years then 'year' when numeric then 'numeric' when position = 5 then 'filename' else 'text' end as kind,
  case when lo = hi then null when entity > 0.8 * n_rows then regexp_extract(lo, '^([a-z]+)', 1) when years then 'year' when numeric then 'id_' || position when position = 5 then 'filename' else 'field_' || position end as field,
  case when lo = hi then lo else '*' end as glob, n_rows from a""")
def position_kinds(spark, sf):
    return paths.analyze_positions(dated_paths(spark, sf))


@query(
    f"""with {CATALOG}, s as (select file_id, unnest(string_split(parent_path, '/')) as seg, unnest(range(0, len(string_split(parent_path, '/')))) as i from cat),
k as (select file_id, i, case when regexp_full_match(seg, '(19[0-9]{{2}}|20[0-9]{{2}}|2100)') then '<date>' when regexp_full_match(seg, '[0-9]{{2,}}') then '<n>' else lower(seg) end as kind from s),
t as (select file_id, string_agg(kind, '/' order by i) as template from k group by 1), f as (select template, parent_path, count(*) as n from t join cat using (file_id) group by all),
few as (select template, string_agg(parent_path, '|' order by parent_path) as samples from (select *, row_number() over (partition by template order by parent_path) as rn from f) where rn <= 3 group by 1),
best as (select template, cast(sum(n) as bigint) as n_files, count(*) as n_folders, case when template = '' then 0 else len(string_split(template, '/')) end as depth from f group by 1 order by n_files desc, template limit 10)
select template, n_files, n_folders, depth, samples from best join few using (template)"""
)
def top_archetypes(spark, sf):
    return paths.top_archetypes(files(spark, sf))


@query(f"""with {DATED}, k as (select o_orderkey, cast(o_custkey as varchar) as c, cast(o_orderkey + 10 as varchar) as s from dated),
d as (select *, {is_date('c')} as cd, {is_date('s')} as sd from k)
select o_orderkey, 'Data/v' || (o_orderkey % 3) || '.1/<date:date>/<number:int>/client_' || case when length(c) = 1 then c when cd then '<date_2:date>' else '<number_2:int>' end || '/sum-'
  || case when sd then case when cd then '<date_3:date>' else '<date_2:date>' end when length(c) = 1 or cd then '<number_2:int>' else '<number_3:int>' end || case when o_orderkey % 2 = 0 then '.csv' else '.JSON' end as pattern from d""")
def patterns_of_paths(spark, sf):
    return dated_paths(spark, sf).select("o_orderkey", structure.pattern_of(F.col("rel_path")).alias("pattern"))


# ---- selections


@query(f"""with {CATALOG}, d as (select 'dir' as what, array_to_string(string_split(rel_path, '/')[:3], '/') as which, count(*) as n from cat where extension = 'html' group by 2 order by n desc, which limit 10),
e as (select 'ext' as what, extension as which, count(*) as n from cat where extension = 'html' group by 2), t as (select 'token' as what, k as which, count(*) filter (contains(lower(rel_path), k)) as n from cat, (values ('en'), ('example')) x(k) where extension = 'html' group by 2)
select * from d union all select * from e union all select * from t""")
def selection_evidence(spark, sf):
    return catalog.evidence(files(spark, sf).where("extension = 'html'"), ("en", "example"))


@query(f"""with {SNAPSHOTS} select o_orderkey, case state when 'deleted' then old_price else new_price end as o_totalprice, case when state in ('unchanged', 'deleted') then 't' || (o_orderkey % 3) end as tag, case when state in ('new', 'changed') then 'pending' else 'processed' end as status, state from states""")
def partial_scan_upsert(spark, sf):
    """After a scan of which a batch failed: absent files keep their status, and tags of changed files are cleared."""
    before, now = snapshots(spark, sf)
    before = before.withColumn("tag", F.concat(F.lit("t"), (F.col("o_orderkey") % 3).cast("string")))
    return catalog.upsert(before, now, "o_orderkey", ["o_totalprice"], cleared=("tag",), complete=False)


# ---- contracts


@query(f"""with {ENFORCED}, n as (select count(*) as n_rows, count(_cf_row_error) as n_quarantined from enforced)
select 'disabled' as policy, n_rows, n_quarantined, case when n_quarantined = 0 then 'accepted' else 'quarantine disabled' end as verdict from n union all select 'count', n_rows, n_quarantined, case when n_quarantined > 5 then 'too many rows' else 'accepted' end from n
union all select 'share', n_rows, n_quarantined, case when n_quarantined * 100 > 0.5 * n_rows then 'too large a share' else 'accepted' end from n union all select 'all', n_rows, n_quarantined, 'accepted' from n""")
def policy_branches(spark, sf):
    """Each way a policy can decide."""
    policies = {"disabled": QuarantinePolicy(), "count": QuarantinePolicy(True, 100.0, 5), "share": QuarantinePolicy(True, 0.5), "all": QuarantinePolicy(True, 100.0)}
    out = None
    for name, policy in policies.items():
        one = contract.policy_verdict(enforced_events(spark, sf), policy).select(F.lit(name).alias("policy"), "n_rows", "n_quarantined", "verdict")
        out = one if out is None else out.unionByName(one)
    return out


@query("""with t as (select o_orderkey, case when o_orderkey % 4 = 0 then strftime(o_orderdate, '%d.%m.%Y') when o_orderkey % 4 = 1 then '' else strftime(o_orderdate, '%Y-%m-%d') end as day, (o_orderkey % 25) || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') as clock from orders),
j as (select *, day = '' or o_orderkey % 4 = 0 as day_ok, o_orderkey % 25 < 24 as clock_ok from t)
select o_orderkey, day, case when clock_ok then lpad(cast(o_orderkey % 25 as varchar), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') || ':00' end as clock,
  nullif(concat_ws('; ', case when not day_ok then 'schema: value does not match format ''%d.%m.%Y'' for ''day''' end, case when not clock_ok then 'schema: value does not match format ''%H:%M'' for ''clock''' end), '') as _cf_row_error from j""")
def formatted_texts(spark, sf):
    """A text column with a date format that is checked but not cast, and a time of day."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    day = F.when(k % 4 == 0, F.date_format(d, "dd.MM.yyyy")).when(k % 4 == 1, "").otherwise(F.date_format(d, "yyyy-MM-dd"))
    clock = F.concat((k % 25).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    raw = table(spark, sf, "orders").select("o_orderkey", day.alias("day"), clock.alias("clock"))
    return contract.enforce(raw, [ContractColumn("o_orderkey", "bigint"), ContractColumn("day", "string", True, "%d.%m.%Y"), ContractColumn("clock", "time", True, "%H:%M")])


@query("select event_id, coalesce(event_type, 'none') as kind from events where user_id not in (select user_id from events where event_id % 100 = 0)")
def approved_rows(spark, sf):
    """Rows of the files that an approval keeps, under new names and with defaults."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("user_id").alias("file_id"))
    kept = amend.without_files(e, e.where("event_id % 100 = 0"))
    return amend.apply_changes(kept, [amend.Change("rename", "event_type", "kind"), amend.Change("default", "kind", default="none")]).select("event_id", "kind")


# ---- shards, redaction


@query("""with n as (select user_id, count(*) as n from events group by 1), own as (select user_id from (select user_id from n where user_id is not null order by n desc, user_id limit 5) union select user_id from n where n >= 90),
s as (select coalesce(cast(o.user_id as varchar), '_MISC') as shard, e.event_id, e.user_id, e.event_type from events e left join own o using (user_id))
select shard, count(*) as n_rows, cast(sum(strlen('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}')) as bigint) as n_bytes, min(event_id) as first_row, max(event_id) as last_row, count(distinct user_id) as n_keys from s group by 1""")
def promoted_shards(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    return shred.shard_sizes(shred.promoted_shards(e, "user_id", 5, 90), "user_id", "event_id")


@query("""with h as (select event_id, '[hash:' || left(sha256(event_type), 8) || ']' as t, '[hash:' || left(sha256(cast(event_id as varchar)), 8) || ']' as n, event_id % 2 = 0 as f, event_type as raw from events)
select event_id, '{"type":"' || t || '","id":"' || n || '","even":' || f || ',"list":["' || t || '",null],"in":{"id":"' || n || '"}}' as hashed,
  '{"type":"' || case when length(raw) > 4 then left(raw, 4) || '...' else raw end || '","id":' || event_id || ',"even":' || f || ',"list":["' || case when length(raw) > 4 then left(raw, 4) || '...' else raw end || '",null],"in":{"id":' || event_id || '}}' as cut from h""")
def redacted_json_rows(spark, sf):
    k = F.col("event_id").cast("string")
    even = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('","id":'), k, F.lit(',"even":'), even, F.lit(',"list":["'), "event_type", F.lit('",null],"in":{"id":'), k, F.lit("}}"))
    j = table(spark, sf, "events").select("event_id", text.alias("j"))
    return j.select("event_id", redacted_json(F.col("j"), depth=2).alias("hashed"), redacted_json(F.col("j"), 4, depth=2).alias("cut"))
