"""Registered queries of path groups, confidence scores, amendments, history and job records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import amend, backtest, catalog, confidence, inference, parsers, path_groups, paths
from millrace.operators.amend import Change
from millrace.operators.contract import ContractColumn
from millrace.plans.queries import CATALOG, FIELDS, RUNS, files, query, runs, table

# ---- path groups


def part_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A report file for each part, in a folder named by the part's type, in full or by its first three letters."""
    p = table(spark, sf, "part")
    kind = F.lower("p_type")
    folder = F.when(F.col("p_partkey") % 2 == 0, kind).otherwise(F.substring(kind, 1, 3))
    return p.select("p_partkey", F.concat(F.lit("reports/"), folder, F.lit("/sum_"), (F.col("p_partkey") + 100).cast("string"), F.lit(".csv")).alias("rel_path"))


PART_PATHS = "pp as (select p_partkey, lower(p_type) as kind, case when p_partkey % 2 = 0 then lower(p_type) else left(lower(p_type), 3) end as folder from part)"


@query(f"""with {PART_PATHS}, t as (select kind, 'reports/' || folder as template, count(*) as n_files, min('reports/' || folder || '/sum_' || (p_partkey + 100) || '.csv') as sample, 'csv' as extension from pp group by all)
select min(template) over (partition by case when left(kind, 1) = 's' then 's' else kind end) as "group", template, n_files, sample, extension from t""")
def variant_groups(spark, sf):
    return path_groups.variant_groups(part_paths(spark, sf))


@query(f"""with {CATALOG}, seg as (select unnest(string_split(rel_path, '/')) as segment, unnest(range(0, len(string_split(rel_path, '/')))) as depth from cat),
tok as (select distinct depth, lower(unnest(regexp_split_to_array(segment, '[_.-]'))) as t from seg),
ok as (select * from tok where length(t) >= 2 and not regexp_full_match(t, '[0-9]+') and not (length(t) >= 4 and regexp_matches(t, '[a-z]') and regexp_matches(t, '[0-9]'))),
pairs as (select distinct a.t as a, b.t as b from ok a join ok b on a.depth = b.depth and a.t < b.t and abs(length(a.t) - length(b.t)) <= 3),
scored as (select a, b, levenshtein(a, b) as d, length(a) >= 3 and length(b) >= 3 and (starts_with(a, b) or starts_with(b, a)) as prefix from pairs),
near as (select case when length(b) < length(a) then b else a end as short_form, case when length(b) < length(a) then a else b end as canonical_form, (case d when 1 then 2 when 2 then 1 else 0 end) + prefix::int as score,
  concat_ws(', ', case when d <= 2 then 'edit distance ' || d end, case when prefix then 'prefix match' end) as reason from scored)
select *, case when score >= 3 then 'high' else 'medium' end as confidence from near where score >= 2""")
def token_synonyms(spark, sf):
    return path_groups.synonyms(files(spark, sf), top=None)


@query(f"with {CATALOG} select file_id, regexp_extract(rel_path, '^[^/]*/([^/]+?)/([0-9]+)[^/]*$', 1) as _cf_path_lang, regexp_extract(rel_path, '^[^/]*/([^/]+?)/([0-9]+)[^/]*$', 2) as _cf_path_page from cat where regexp_full_match(rel_path, '[^/]*/([^/]+?)/([0-9]+)[^/]*')")
def placeholder_fields(spark, sf):
    return paths.placeholder_fields(files(spark, sf), "*/<lang>/<page:int>*").select("file_id", "_cf_path_lang", "_cf_path_page")


# ---- confidence

@query(f"""with {CATALOG}, tops as (select parent_path as prefix, count(*) as n from cat where extension = 'html' group by 1 order by n desc, prefix limit 10),
h as (select -sum(n / total * ln(n / total)) as h, count(*) as k from tops, (select sum(n) as total from tops)),
c as (select count(*) as n_files, count(distinct extension) as ke, count(*) filter (contains(lower(rel_path), '/en/')) as hits, count(*) filter (file_id % 4 = 0) as taken from cat where extension = 'html'),
s as (select n_files, round(case when k > 1 then 1 - h / ln(k) else 1 end, 6) as dir_concentration, 1.0::double as extension_narrowness, round(least(hits / n_files, 1), 6) as semantic_tokens, round(1 - taken / n_files, 6) as tag_collision from c, h)
select *, round(0.25 * dir_concentration + 0.2 * extension_narrowness + 0.3 * semantic_tokens + 0.25 * tag_collision, 6) as score from s""")
def selection_confidence(spark, sf):
    df = files(spark, sf)
    return confidence.selection_confidence(df.where("extension = 'html'"), ("/en/",), df.where("file_id % 4 = 0").select("file_id"))


@query(f"""with {FIELDS}, k as (select field, count(*) as n_found, count(distinct value) as n_values from named group by 1),
s as (select field, 1.0::double as pattern_type, round(n_found / (select count(*) from pages), 6) as coverage, 1.0::double as format_validation, case when n_values > 1 then 1.0 else 0.5 end::double as value_uniqueness from k)
select *, round(0.3 * pattern_type + 0.35 * coverage + 0.2 * format_validation + 0.15 * value_uniqueness, 6) as score from s""")
def path_field_confidence(spark, sf):
    p = table(spark, sf, "pages")
    return confidence.path_field_confidence(paths.path_fields(p, "url"), p.agg(F.count("*").alias("n")))


@query("""with n as (select count(*) as k from orders), s as (select name, m::double as inference_method, cl::double as candidate_clarity, ns::double as null_stability, round(case when vals then least(k / 1000, 1) else 0 end, 6)::double as format_hits
  from n, (values ('o_orderkey', 1, 0.6, 1, true), ('o_orderstatus', 1, 1, 1, true), ('void', 0.3, 1, 0, false)) x(name, m, cl, ns, vals))
select *, round(0.35 * inference_method + 0.25 * candidate_clarity + 0.2 * null_stability + 0.2 * format_hits, 6) as score from s""")
def schema_column_confidence(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.lit("NA").alias("void"))
    return confidence.schema_column_confidence(inference.infer(df, df.columns))


@query("select 'ext_only' as rule_id, null as pattern, '.csv' as extension, 1.0::double as recall union all select 'dir_pattern', 'all/**', '.csv', round(count(*) filter (p_partkey % 3 <> 0) / count(*), 6) from part")
def tag_proposals(spark, sf):
    df = part_paths(spark, sf).withColumn("rel_path", F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("all/"), F.element_at(F.split("rel_path", "/"), -1))).otherwise(F.col("rel_path")))
    return confidence.tag_proposals(catalog.with_path_parts(df))


# ---- contracts that change

@query("""with r as (select o_orderkey, case when o_orderkey % 6 = 0 then 'n/a' else o_orderkey || '.5' end as amount, case when o_orderkey % 4 <> 0 then o_orderstatus end as status from orders)
select 'amount' as "column", 'type_mismatch' as reason, 'string' as proposed_type, count(*) as n_rows, 'n/a' as samples from r where amount = 'n/a'
union all select 'status', 'nullability_change', 'string', count(*), null from r where status is null union all select 'extra', 'new_column', 'int', count(*), null from r""")
def amendment_proposals(spark, sf):
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 6 == 0, "n/a").otherwise(F.concat(k.cast("string"), F.lit(".5"))).alias("amount"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("status"), F.lit(1).alias("extra")
    )
    columns = [ContractColumn("o_orderkey", "bigint"), ContractColumn("amount", "decimal(18,2)"), ContractColumn("status", "string", False)]
    return amend.proposals(raw, columns).withColumn("samples", F.array_join("samples", ","))


@query("select c_custkey as id, cast(c_nationkey as varchar) as c_nationkey, c_name, c_mktsegment, 'new' as origin from customer")
def amended_rows(spark, sf):
    changes = [Change("rename", "c_custkey", "id"), Change("remove", "c_acctbal"), Change("retype", "c_nationkey", "string"), Change("add", "origin", "string", "new"), Change("reorder", to="id,c_nationkey")]
    return amend.apply_changes(table(spark, sf, "customer"), changes)


@query("""with r as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderstatus as s from orders),
v as (select o_orderkey, 'day' as name, day as value, unnest(['boolean', 'integer', 'float', 'datetime', 'time', 'duration']) as type from r
  union all select o_orderkey, 's', s, unnest(['boolean', 'integer', 'float', 'date', 'datetime', 'time', 'duration']) from r)
select name, type, arg_min(value, o_orderkey) as value from v where not (type = 'boolean' and lower(value) in ('f', 't', 'y', 'n')) group by name, type""")
def elimination_evidence(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("s"))
    return amend.elimination_evidence(df, ["day", "s"], "o_orderkey")


@query("""select 'key' as name, false as has_null, 'integer' as type, min(cast(o_orderkey as varchar)) as example from orders union all select 'half', true, 'float', min(o_orderkey || '.5') from orders where o_orderkey % 2 = 1
union all select 'flag', false, 'boolean', 'false' from (select 1) union all select 'status', false, 'string', min(o_orderstatus) from orders""")
def column_profile(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(k.alias("key"), F.when(k % 2 == 1, F.concat(k.cast("string"), F.lit(".5"))).alias("half"), (k % 2 == 1).alias("flag"), F.col("o_orderstatus").alias("status"))
    return amend.profile(df, df.columns)


# ---- history and records

@query(f"""with {RUNS}, h as (select file, count(*) filter (not passed) as n_failures, max(run) filter (not passed) as last_failure, max(run) as last_run from runs group by 1)
select h.file, n_failures, last_failure, r.error as last_error, last_failure < last_run as resolved, r.category from h join runs r on r.run = last_failure where n_failures > 0""")
def failure_history(spark, sf):
    return backtest.failure_history(runs(spark, sf))


@query("select o_custkey as job_id, case when bool_or(o_orderkey % 50 = 0) then 'failed' when bool_or(o_orderkey % 7 = 0) then 'partial_success' else 'success' end as status from orders group by 1")
def job_status(spark, sf):
    k = F.col("o_orderkey")
    outputs = table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.when(k % 50 == 0, "failed").when(k % 7 == 0, "partial_success").otherwise("success").alias("status"))
    return backtest.job_status(outputs)


@query(f"""with {RUNS}, l as (select file, arg_max(passed, run) as resolved from runs group by 1), bad as (select file from l where not resolved),
g as (select count(*) as n, avg((file % 3 <> 0)::int) as rate from bad) select l.file, l.file % 3 <> 0 as passed, case when l.file % 3 = 0 then 'boom' end as error from l, g where l.file in (select file from bad) or not (n >= 3 and rate < 0.8)""")
def fail_fast_results(spark, sf):
    log = runs(spark, sf)
    again = lambda f: f.select("file", (F.col("file") % 3 != 0).alias("passed"), F.when(F.col("file") % 3 == 0, "boom").alias("error"))
    return backtest.fail_fast(log.select("file").distinct(), backtest.failure_history(log), again)[0]


@query(f"with {CATALOG} select file_id, case when extension = 'html' and contains(lower(rel_path), 'blog') and regexp_full_match(rel_path, '(?i)(.*/)?en/[^/]*') then 'selected' when extension = 'html' or contains(lower(rel_path), 'blog') then 'near_miss' else 'other' end as verdict from cat")
def near_misses(spark, sf):
    return catalog.near_misses(files(spark, sf), "html", "blog", "**/en/*").select("file_id", "verdict")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1")
def latest_records(spark, sf):
    return catalog.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("select o_orderkey as file_id, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate >= date '1998-01-01' and l_returnflag = 'R') then 'stale' else 'ok' end as status from orders")
def stale_extractions(spark, sf):
    seen = table(spark, sf, "lineitem").where("l_shipdate >= date '1998-01-01'").select(F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("extractor"))
    return catalog.mark_stale(table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.lit("ok").alias("status")), seen, "R")


@query("select c_custkey as job_id, c_name, (select count(*) from orders where o_custkey = c_custkey and o_totalprice > 200000) as n_quarantined from customer")
def job_log(spark, sf):
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), "c_name")
    return catalog.job_log(jobs, table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("job_id")))


@query("select l_orderkey as output, count(*) filter (l_quantity > 10) as n_rows, count(*) filter (l_quantity > 45) as n_quarantined, case when count(*) filter (l_quantity > 10) = 0 then 'no_data' when count(*) filter (l_quantity > 45) > 0 then 'partial_success' else 'success' end as status from lineitem group by 1 having l_orderkey % 9 <> 0")
def materialization_records(spark, sf):
    q = F.col("l_quantity")
    outputs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("output")).agg(F.count_if(q > 10).alias("n_rows"), F.count_if(q > 45).alias("n_quarantined"))
    return catalog.materializations(outputs.withColumn("failed", F.col("output") % 9 == 0))


@query("""select 'bit' as name, 'boolean' as declared_type, false as nullable, 0.0::double as null_rate, 'boolean,integer,float' as candidates, 'ambiguous_requires_human' as method, 'Column ''bit'' has ambiguous type. Which type should be used?' as question
union all select 'price', 'float', true, round(count(*) filter (o_orderkey % 3 = 0) / count(*), 6), 'float', 'constraint_elimination', null from orders
union all select 'void', 'string', true, 1.0, 'string', 'ambiguous_requires_human', null""")
def column_intents(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select((k % 2).cast("string").alias("bit"), F.when(k % 3 != 0, F.concat(k.cast("string"), F.lit(".5"))).alias("price"), F.lit("").alias("void"))
    return inference.intents(inference.infer(df, df.columns))


def parsed_documents(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Documents as files for a Python parser of two outputs; it gives up on those without a sentence."""

    def parse(path: str, content: bytes):
        if b"." not in content:
            raise ValueError(f"no sentence in {path}")
        yield "summary", {"n_bytes": len(content), "n_lines": content.count(b"\n") + 1}
        for line in content.split(b"\n"):
            if b"@" in line:
                yield "mail", {"n_bytes": len(line)}

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return parsers.run_parser(docs, parse, {"summary": StructType().add("n_bytes", "long").add("n_lines", "long"), "mail": StructType().add("n_bytes", "long")})


DOCS = "d as (select cast(doc_id as varchar) as p, doc_id, coalesce(text, '') as text from documents)"


@query(f"with {DOCS} select octet_length(encode(text)) as n_bytes, len(string_split(text, chr(10))) as n_lines, p as _source_path, 0 as _source_row from d where contains(text, '.')")
def parser_summaries(spark, sf):
    return parsed_documents(spark, sf)["summary"]


@query(f"with {DOCS}, l as (select p, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as i from d where contains(text, '.')) select octet_length(encode(line)) as n_bytes, p as _source_path, row_number() over (partition by p order by i) - 1 as _source_row from l where contains(line, '@')")
def parser_mail_lines(spark, sf):
    return parsed_documents(spark, sf)["mail"]


@query("select cast(doc_id as varchar) as path, 'ValueError: no sentence in ' || doc_id as error from documents where not contains(coalesce(text, ''), '.')")
def parser_errors(spark, sf):
    return parsed_documents(spark, sf)["_errors"]
