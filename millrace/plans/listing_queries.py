"""Registered queries of catalog listings, job logs and path structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import catalog, jobs, listing, paths, structure
from millrace.plans.queries import CATALOG, FIELDS, RULES, RUNS, files, query, runs, table

TAGS = "tags as (select file_id, tag from (select *, unnest(['german', 'english', 'html', 'blogs']) as r, unnest(['lang-de', 'lang-en', 'web', 'blog']) as tag, unnest(['(?i)(.*/)?de/[^/]*', '(?i)(.*/)?en/.*', '(?i)(.*/)?[^/]*\\.html', '(?i)blog\\.[^/]*/.*']) as re from cat) where regexp_full_match(rel_path, re))"


def tagged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = files(spark, sf).withColumn("source", F.col("host"))
    return df, catalog.all_rules(df, RULES).select("file_id", "tag")


@query(f"with {CATALOG}, {TAGS} select file_id, rel_path from cat where status = 'processed' and extension = 'html' and file_id in (select file_id from tags where tag = 'lang-en')")
def listed_by_tag(spark, sf):
    df, tags = tagged(spark, sf)
    return listing.list_files(df, tags, status="processed", tag="lang-en", extension="html").select("file_id", "rel_path")


@query(f"with {CATALOG}, {TAGS} select file_id, rel_path from cat where status = 'failed' and file_id not in (select file_id from tags)")
def listed_untagged(spark, sf):
    df, tags = tagged(spark, sf)
    return listing.list_files(df, tags, status="failed", untagged=True).select("file_id", "rel_path")


@query(f"with {CATALOG} select file_id, name, size from cat where parent_path = (select parent_path from cat group by 1 order by count(*) desc, parent_path limit 1) order by name, file_id limit 100")
def folder_contents(spark, sf):
    df = files(spark, sf)
    folder = df.groupBy("parent_path").count().orderBy(F.desc("count"), "parent_path").first()["parent_path"]
    return listing.folder_contents(df, folder).select("file_id", "name", "size")


@query(f"""with {CATALOG}, r as (select substr(rel_path, 6) as rest from cat where starts_with(rel_path, 'blog.') and regexp_full_match(rel_path, '(?i)(.*/)?[^/]*\\.html'))
select string_split(rest, '/')[1] as child, count(*) as n_files, bool_or(not contains(rest, '/')) as is_file from r group by 1 order by n_files desc, child limit 100""")
def children_under_prefix(spark, sf):
    return listing.children_matching(files(spark, sf), "blog.", "*.html")


@query(f"""with {CATALOG} select 'prefix' as what, 'www.' as which, count(*) filter (starts_with(rel_path, 'www.')) as n_files from cat union all select 'prefix', 'blog.', count(*) filter (starts_with(rel_path, 'blog.')) from cat
union all select 'pattern', '**/*.html', count(*) filter (ends_with(name, '.html')) from cat union all select 'pattern', 'a?*', count(*) filter (starts_with(name, 'a') and length(name) >= 2) from cat
union all select 'folder', 'www.example.com/en', count(*) filter (parent_path = 'www.example.com/en') from cat""")
def path_counts(spark, sf):
    return listing.counts(files(spark, sf), ("www.", "blog."), ("**/*.html", "a?*"), ("www.example.com/en",))


@query(f"""with {CATALOG}, n as (select file_id, rel_path, row_number() over (order by rel_path, file_id) - 1 as position, count(*) over () as total from cat)
select file_id, rel_path, position, case when total > 60 then 60 end as next_cursor from n where position between 40 and 59""")
def page_by_cursor(spark, sf):
    return listing.page(files(spark, sf).select("file_id", "rel_path"), ["rel_path", "file_id"], 40, 20)


@query(f"with {CATALOG}, {TAGS} select distinct tag from tags")
def distinct_tags(spark, sf):
    return tagged(spark, sf)[1].select("tag").distinct()


@query(f"with {CATALOG}, {TAGS} select host as source, tag, count(distinct file_id) as n_files from cat left join tags using (file_id) group by 1, 2")
def tag_counts(spark, sf):
    return listing.tag_counts(*tagged(spark, sf))


@query(f"with {CATALOG} select host as source, count(*) as n_files, cast(sum(size) as bigint) as n_bytes from cat group by 1")
def source_stats(spark, sf):
    return listing.source_stats(tagged(spark, sf)[0])


@query(f"with {CATALOG} select file_id, rel_path, mtime from cat where status = 'pending' order by mtime, file_id limit 1000")
def pending_extraction(spark, sf):
    return listing.pending_extraction(files(spark, sf)).select("file_id", "rel_path", "mtime")


@query(f"""with {CATALOG}, p as (select *, string_split(rel_path, '/')[1] as prefix from cat), best as (select prefix from p group by 1 order by count(*) desc, prefix limit 50)
select prefix, rel_path from (select prefix, rel_path, row_number() over (partition by prefix order by sha256('42:' || rel_path), rel_path) as rn from p where prefix in (select prefix from best)) where rn <= 3""")
def prefix_sample(spark, sf):
    return listing.prefix_sample(files(spark, sf), 50, 3).select("prefix", "rel_path")


@query("select o_orderkey as snapshot_id, o_orderdate as created_at from orders where o_orderkey in (select l_orderkey from lineitem where l_partkey = 1) order by created_at desc, snapshot_id")
def selections_with_file(spark, sf):
    members = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_partkey").alias("file_id"))
    snapshots = table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    return listing.snapshots_with(members, snapshots, 1)


@query(f"""with {CATALOG}, p as (select distinct parent_path as path from cat union select distinct host from cat) select a.path as parent, b.path as child from p a join p b on starts_with(b.path, a.path || '/')""")
def overlapping_sources(spark, sf):
    df = files(spark, sf)
    return listing.overlapping_sources(df.select(F.col("parent_path").alias("path")).union(df.select("host")))


@query(f"with {FIELDS}, k as (select distinct lower(replace(n.field, '_cf_path_', '')) as name, contains(p.url, '/en/') as english from named n join pages p using (page_id)) select name from k where english intersect select name from k where not english")
def field_collisions(spark, sf):
    """Fields of English pages' paths that other pages' have too."""
    fields = paths.path_fields(table(spark, sf, "pages").select("page_id", "url"), "url").select("url", F.replace("field", F.lit("_cf_path_"), F.lit("")).alias("name"))
    english = F.contains("url", F.lit("/en/"))
    return listing.collisions(fields.where(english), fields.where(~english))


# ---- job logs


def job_rows_of(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a job log."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "dispatching", "completed", "failed", "aborted", "completed"))), (k % 7 + 1).cast("int"))
    return table(spark, sf, "orders").select(k.alias("job_id"), status.alias("status"), F.when(k % 7 == 3, k % 13).otherwise(0).alias("n_quarantined"))


JOBS = "jobs as (select o_orderkey as job_id, (['queued', 'running', 'dispatching', 'completed', 'failed', 'aborted', 'completed'])[o_orderkey % 7 + 1] as status, case when o_orderkey % 7 = 3 then o_orderkey % 13 else 0 end as n_quarantined from orders)"


@query(f"with {JOBS} select count(*) as total, count(*) filter (status = 'queued') as queued, count(*) filter (status in ('running', 'dispatching')) as running, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'aborted') as aborted, (select count(*) from events where event_type = 'error') as dead_letter from jobs")
def queue_stats(spark, sf):
    return jobs.queue_stats(job_rows_of(spark, sf), table(spark, sf, "events").where("event_type = 'error'"))


@query(f"with {JOBS} select count(*) as n_jobs, count(*) filter (status in ('queued', 'running', 'dispatching')) as n_open, count(*) filter (status = 'completed') as n_done, count(*) filter (status = 'failed') as n_failed, cast(sum(n_quarantined) as bigint) as n_quarantined from jobs")
def job_dashboard(spark, sf):
    return jobs.dashboard(job_rows_of(spark, sf))


@query(f"""with {RUNS}, p as (select file, count(*) as n_runs, count(*) filter (passed) as n_passed, max(run) filter (passed) as last_pass, arg_max(error, run) filter (not passed) as last_reason from runs group by 1)
select p.file, n_runs, n_passed, last_reason, count(r.run) as n_consecutive from p left join runs r on r.file = p.file and not r.passed and (last_pass is null or r.run > last_pass) group by all""")
def health_with_reason(spark, sf):
    return jobs.health(runs(spark, sf))


@query(f"""with {RUNS}, t as (select distinct category, error from runs where not passed), s as (select category, string_agg(error, '|' order by error) as samples from (select *, row_number() over (partition by category order by error) as rn from t) where rn <= 3 group by 1),
c as (select category, count(*) as n_failures from runs where not passed group by 1)
select category, n_failures, round(n_failures / sum(n_failures) over (), 6) as share, row_number() over (order by n_failures desc, category) = 1 as most_common, samples from c join s using (category)""")
def failure_samples(spark, sf):
    return jobs.failure_samples(runs(spark, sf))


@query(f"with {RUNS} select file, count(*) as n_failures from runs where not passed group by 1 order by n_failures desc, file limit 10")
def top_failing_files(spark, sf):
    return jobs.top_failing(runs(spark, sf))


# ---- structure of paths


def dated_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A report of each order, in folders by version, year and month of some orders, else by day."""
    o, d = table(spark, sf, "orders"), F.col("o_orderdate")
    folder = F.concat(F.lit("Data/v"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".1/"), F.date_format(d, "yyyy"), F.lit("/"), F.date_format(d, "MM"))
    name = F.concat(F.lit("/client_"), F.col("o_custkey").cast("string"), F.lit("/sum-"), (F.col("o_orderkey") + 10).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".csv").otherwise(".JSON"))
    return o.select("o_orderkey", F.concat(folder, name).alias("rel_path"))


DATED = "dated as (select o_orderkey, o_orderdate, o_custkey, 'Data/v' || (o_orderkey % 3) || '.1/' || strftime(o_orderdate, '%Y/%m') || '/client_' || o_custkey || '/sum-' || (o_orderkey + 10) || case when o_orderkey % 2 = 0 then '.csv' else '.JSON' end as rel_path from orders)"


@query(f"with {DATED} select '**/*' || e as pattern, count(*) as n_files from (select lower(regexp_extract(rel_path, '(\\.[^./]*)$', 1)) as e from dated) where e <> '' group by e order by n_files desc, pattern limit 10")
def pattern_seeds(spark, sf):
    return structure.pattern_seeds(dated_paths(spark, sf))


@query(f"""with {DATED}, s as (select unnest(list_reverse(string_split(rel_path, '/'))) as s, unnest(range(0, 6)) as position from dated),
k as (select position, case when regexp_matches(s, '\\.\\w+$') then 'files' when regexp_full_match(s, '(19|20)[0-9]{{2}}') then 'year' when regexp_full_match(s, '0[1-9]|1[0-2]') then 'month' when regexp_full_match(s, '(?i)data') then 'category' when regexp_full_match(s, '[a-zA-Z]+[_-]\\w+') then 'entity' else 'unknown' end as kind from s),
c as (select *, case kind when 'files' then 1.0 when 'year' then 0.9 when 'month' then 0.85 when 'category' then 0.95 when 'entity' then 0.8 else 0.0 end as confidence from k)
select position, count(*) as n_rows, case when min(kind) = max(kind) then min(kind) else 'unknown' end as kind, round(case when min(kind) = max(kind) then least(avg(confidence) + least(count(*) / 10.0, 0.1), 1.0) else 0.3 end, 6) as consistency from c group by 1""")
def structure_from_leaf(spark, sf):
    return structure.from_leaf(dated_paths(spark, sf))


def is_date(k: str) -> str:
    """SQL: whether digits are a year from 1900 to 2100, alone or before four more."""
    return f"(length({k}) in (4, 8) and cast(left({k}, 4) as int) between 1900 and 2100)"


def digits_kind(k: str) -> str:
    """SQL: what a template has for a token of digits alone."""
    return f"case when length({k}) = 1 then {k} when {is_date(k)} then '<date>' else '<n>' end"


@query(f"""with {DATED}, k as (select o_orderkey, rel_path, cast(o_custkey as varchar) as c, cast(o_orderkey + 10 as varchar) as s from dated),
t as (select 'data/v' || (o_orderkey % 3) || '.1/<date>/<n>/client_' || {digits_kind('c')} || '/sum_' || {digits_kind('s')} || case when o_orderkey % 2 = 0 then '_csv' else '_json' end as template, rel_path from k)
select template, count(*) as n_files, min(rel_path) as example from t group by 1 order by n_files desc, template limit 10""")
def rule_candidates(spark, sf):
    return structure.rule_candidates(dated_paths(spark, sf)).drop("pattern")
