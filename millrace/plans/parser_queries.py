"""Registered queries of parsers under contracts, previews, ragged tables, column samples, globs in parts, contract changes, widening appends, zones and delimiters."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.text import redact_truncate
from millrace.operators import amend, backtest, contract, listing, manifest, parsers
from millrace.operators.contract import ContractColumn
from millrace.operators.staging import staged
from millrace.plans.file_queries import folder
from millrace.plans.queries import CATALOG, files, query, table
from millrace.sources import fix, lines
from millrace.sources.walk import write_files

# ---- parsers under contracts

OUTPUTS = {
    "lines": StructType().add("n", "long").add("amount", "string").add("head", "string").add("_cf_row_error", "string"),
    "sizes": StructType().add("n_bytes", "long").add("n_lines", "long"),
}
LINES = [ContractColumn("n", "bigint", False), ContractColumn("amount", "decimal(6,0)"), ContractColumn("head", "string")]


def parse_document(path: str, content: bytes) -> Iterator[tuple[str, dict]]:
    """A row a line with words, some with an error of the parser's own, some with an amount that is none; a document in ten is not read at all."""
    if path.endswith("3"):
        raise ValueError("no document")
    rows = content.split(b"\n")
    for n, line in enumerate(rows):
        words = line.split()
        if words:
            yield "lines", {"n": n, "amount": "many" if len(words) % 5 == 0 else str(len(words)), "head": words[0].decode()[:12], "_cf_row_error": "odd line" if len(words) % 3 == 0 else None}
    yield "sizes", {"n_bytes": len(content), "n_lines": len(rows)}


def parsed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    d = table(spark, sf, "documents")
    return parsers.run_parser(d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), parse_document, OUTPUTS)


def enforced_lines(found: dict[str, DataFrame]) -> DataFrame:
    rows = found["lines"]
    own = rows.withColumn("__cf_row_id", F.struct("_source_path", "_source_row"))
    return contract.enforce(own.select("n", "amount", "head", "_cf_row_error", "__cf_row_id"), LINES).select("*", "__cf_row_id.*").drop("__cf_row_id")


PARSED = r"""
split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents where doc_id % 10 <> 3),
each as (select doc_id, unnest(range(0, len(l))) as n, unnest(l) as line from split),
words as (select doc_id, n, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as w from each),
lines as (select doc_id, n, w, row_number() over (partition by doc_id order by n) - 1 as _source_row,
  nullif(concat_ws('; ', case when len(w) % 3 = 0 then 'odd line' end, case when len(w) % 5 = 0 then 'schema: value does not match format ''decimal(6,0)'' for ''amount''' end), '') as _cf_row_error from words where len(w) > 0)"""


@query(f"with {PARSED} select n, case when len(w) % 5 > 0 then cast(len(w) as decimal(6,0)) end as amount, left(w[1], 12) as head, _cf_row_error, 'doc/' || doc_id as _source_path, _source_row from lines")
def parsed_contract(spark, sf):
    """Errors of a parser and of the contract, joined."""
    return enforced_lines(parsed(spark, sf))


@query(f"""with {PARSED}, f as (select 'doc/' || doc_id as file, count(*) as n_rows, count(_cf_row_error) as n_bad, arg_min(_cf_row_error, case when _cf_row_error is not null then _source_row end) as error from lines group by 1
union all select 'doc/' || doc_id, 0, 0, 'ValueError: no document' from documents where doc_id % 10 = 3)
select file, error is null as passed, n_rows, n_bad, error, case when error is not null then case when contains(error, 'format') then 'format_mismatch' else 'unknown' end end as category from f""")
def file_results(spark, sf):
    """Which files pass a parser and its contract."""
    found = parsed(spark, sf)
    return backtest.file_results(enforced_lines(found), found["_errors"])


@query(f"""with {PARSED}, l as (select 'lines' as output, 'doc/' || doc_id as path, _source_row as source_row, case when length(left(w[1], 12)) > 3 then left(w[1], 3) || '...' else left(w[1], 12) end as shown from lines order by path, source_row limit 40),
s as (select 'sizes' as output, 'doc/' || doc_id as path, 0 as source_row, cast(len(l) as varchar) as shown from split order by path limit 40), e as (select '_errors', 'doc/' || doc_id, null, 'ValueError: no document' from documents where doc_id % 10 = 3)
select * from l union all select * from s union all select * from e
union all select 'schema ' || o, c, place, t from (values ('lines', 0, 'n', 'bigint'), ('lines', 1, 'amount', 'string'), ('lines', 2, 'head', 'string'), ('lines', 3, '_cf_row_error', 'string'), ('sizes', 0, 'n_bytes', 'bigint'), ('sizes', 1, 'n_lines', 'bigint')) x(o, place, c, t) where exists (select 1 from documents)""")
def parser_preview(spark, sf):
    """The first 40 rows of each output of a parser over all files, texts cut short; errors whole; and each output's columns."""
    found = parsed(spark, sf)
    shown = parsers.preview(found, 40, {"head": lambda c: redact_truncate(c, 3)})
    rows = lambda name, what: shown[name].select(F.lit(name).alias("output"), F.col("_source_path").alias("path"), F.col("_source_row").alias("source_row"), what.alias("shown"))
    errors = shown["_errors"].select(F.lit("_errors").alias("output"), "path", F.lit(None).cast("long").alias("source_row"), F.col("error").alias("shown"))
    kinds = spark.createDataFrame([(f"schema {o}", c, k, t) for o, k, c, t in parsers.output_schemas(found)], "output string, path string, source_row long, shown string")
    return rows("lines", F.col("head")).unionByName(rows("sizes", F.col("n_lines").cast("string"))).unionByName(errors).unionByName(kinds)


# ---- tables


@query("""select o_orderkey as id, case when o_orderkey % 4 > 0 then o_orderstatus end as status, case when o_orderkey % 4 > 1 then 'a,"b' end as note, case when o_orderkey % 4 = 3 then 'x,' || o_custkey end as rest from orders""")
def ragged_tables(spark, sf):
    """Files of CSV whose lines have one to five fields below a header of three."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    line = F.concat_ws(",", k.cast("string"), F.when(k % 4 > 0, F.col("o_orderstatus")), F.when(k % 4 > 1, F.lit('"a,""b"')), F.when(k % 4 == 3, F.concat(F.lit("x,"), F.col("o_custkey").cast("string"))))
    groups = o.select(F.floor(k / 500).alias("g"), F.struct(k, line.alias("line")).alias("x")).groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    root = folder(spark, "ragged")
    text = F.concat(F.lit("id,status,note\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n"))
    write_files(groups.select(F.concat(F.col("g").cast("string"), F.lit(".csv")).alias("rel_path"), text.alias("content")), root).write.format("noop").mode("overwrite").save()
    got = lines.read_flexible(spark, root)
    return got.select(F.col("id").cast("long").alias("id"), "status", "note", F.array_join("_rest", ",").alias("rest"))


@query("""with v as (select unnest(['o_orderkey', 'o_orderstatus', 'o_orderdate', 'odd']) as name, unnest([cast(o_orderkey as varchar), o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'), case when o_orderkey % 2 = 1 then '' end]) as v from orders),
r as (select name, v, row_number() over (partition by name order by v) as rn from (select distinct name, v from v where v <> '')) select name, string_agg(v, '|' order by v) as samples from r where rn <= 3 group by 1""")
def column_samples(spark, sf):
    o = table(spark, sf, "orders")
    df = o.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.when(F.col("o_orderkey") % 2 == 1, "").alias("odd"))
    return amend.samples_of(df, df.columns).select("name", F.array_join("samples", "|").alias("samples"))


GLOBS = ("*.html", "**/en/*", "**/blog*/*.HTML", "a?b%/*", "**/*_*", "**", "**/fr/**/*.html")


@query(f"""with {CATALOG}, g as (
  select '*.html' as pattern, count(*) filter (extension = 'html') as n from cat union all select '**/en/*', count(*) filter (rel_path like '%en/%') from cat union all select '**/blog*/*.HTML', count(*) filter (extension = 'html' and rel_path like '%blog%/%') from cat
  union all select 'a?b%/*', count(*) filter (rel_path like 'a_b\\%/%' escape '\\') from cat union all select '**/*_*', count(*) filter (rel_path like '%\\_%' escape '\\') from cat union all select '**', count(*) from cat
  union all select '**/fr/**/*.html', count(*) filter (extension = 'html' and rel_path like '%fr/%') from cat) select pattern, n as n_files from g""")
def glob_parts(spark, sf):
    """Files that fit globs whose extension is split from the path's pattern."""
    cat = staged(files(spark, sf).select("rel_path", "extension"), "catalog")
    out = None
    for g in GLOBS:
        one = listing.matching_parts(cat, g).agg(F.count("*").alias("n_files")).select(F.lit(g).alias("pattern"), "n_files")
        out = one if out is None else out.unionByName(one)
    return out


# ---- contracts that change


@query("""with c as (select unnest(['o_custkey', 'o_orderdate', 'o_orderdate', 'o_comment', 'o_rank']) as name, unnest(['nullability', 'type', 'format', 'removed', 'added']) as change, unnest(['false', 'timestamp_ntz', null, 'string', null]) as old, unnest(['true', 'date', '%d.%m.%Y', null, 'int']) as new)
select c.*, count(*) as n_rows from c, orders group by all""")
def contract_diff(spark, sf):
    """Changes between two contracts of a table, formats too, with the rows that they concern."""
    o = table(spark, sf, "orders")
    kinds = {**dict(o.dtypes), "o_orderdate": "timestamp_ntz", "o_comment": "string"}
    before = [ContractColumn(n, kinds[n], n not in ("o_orderkey", "o_custkey")) for n in ("o_orderkey", "o_custkey", "o_orderdate", "o_comment")]
    after = [before[0], ContractColumn("o_custkey", kinds["o_custkey"], True), ContractColumn("o_orderdate", "date", True, "%d.%m.%Y"), ContractColumn("o_rank", "int")]
    rows = spark.createDataFrame(contract.contract_changes(before, after), "name string, change string, old string, new string")
    return rows.crossJoin(F.broadcast(o.agg(F.count("*").alias("n_rows"))))  # a row a change, and one row


@query("""select event_id, case when event_id % 9 > 0 then event_type end as kind, [cast(event_id as varchar), 'x'] as tags, case when event_id % 9 = 0 then 'schema: null not allowed in ''kind''' end as _cf_row_error from events""")
def renamed_contract(spark, sf):
    """A contract approved under new names, nested columns opted in, and enforced."""
    asked = [ContractColumn("event_id", "bigint", False), ContractColumn("event_type", "string", False), ContractColumn("props", "array<string>")]
    approved = contract.approve(asked, {"event_type": "kind", "props": "tags"}, nested=True)
    k = F.col("event_id")
    df = table(spark, sf, "events").select("event_id", F.when(k % 9 > 0, F.col("event_type")).alias("kind"), F.array(k.cast("string"), F.lit("x")).alias("tags"))
    return contract.enforce(df, approved)


@query("""select l_linenumber, count(*) * 2 as n, sum(cast(l_orderkey as bigint)) * 2 as keys, sum(cast(round(l_quantity) as bigint)) * 2 as quantity from lineitem group by 1""")
def widened_append(spark, sf):
    """Rows of narrower types added to a table, which keeps its own; rows that do not fit are refused and change nothing."""
    root = folder(spark, "widened")
    li = table(spark, sf, "lineitem")
    wide = li.select(F.col("l_orderkey").cast("bigint").alias("key"), F.col("l_linenumber").cast("bigint").alias("line"), F.round("l_quantity").cast("double").alias("quantity"))
    manifest.commit(spark, root, {"lines": (wide, "error")}, "wide")
    manifest.commit(spark, root, {"lines": (wide.select(F.col("key").cast("int").alias("key"), F.col("line").cast("tinyint").alias("line"), F.col("quantity").cast("int").alias("quantity")), "append")}, "narrow")
    try:
        manifest.commit(spark, root, {"lines": (wide.withColumn("key", F.col("key").cast("string")), "append")}, "text")
    except ValueError:
        got = manifest.read(spark, root, "lines")
        return got.groupBy(F.col("line").cast("int").alias("l_linenumber")).agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.sum("quantity").cast("long").alias("quantity"))
    raise AssertionError("text was added to numbers")


# ---- zones and delimiters


@query("""select event_id, case when event_id % 4 < 2 then date_trunc('second', ts) end as "at", case event_id % 4 when 2 then 'schema: value does not match format ''timestamp'' for ''at''' when 3 then 'schema: value does not match format ''timestamp'' for ''at''' end as _cf_row_error from events""")
def zoned_timestamps(spark, sf):
    """Instants of a zone from texts: offsets that are the zone's, one that is not, and none."""
    k = F.col("event_id") % 4
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 0, "Z").when(k == 1, "+00:00").when(k == 2, "+02:00").otherwise(""))
    done = contract.enforce(table(spark, sf, "events").select("event_id", text.alias("at")), [ContractColumn("event_id", "bigint", False), ContractColumn("at", "timestamp", zone="UTC")])
    return done.withColumn("at", F.to_utc_timestamp("at", F.current_timezone()).cast("timestamp_ntz"))


@query("""select o_orderkey, 0 as message_index, unnest(['8', '35', '34', '11']) as tag, unnest(['FIX.4.4', 'D', cast(o_orderkey as varchar), 'A' || o_custkey]) as value, unnest([1, 2, 3, 4]) as position from orders""")
def fix_delimiters(spark, sf):
    """Messages whose fields are parted by SOH, a pipe, ^A or a space."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    mark = F.when(k % 4 == 0, fix.SOH).when(k % 4 == 1, "|").when(k % 4 == 2, "^A").otherwise(" ")
    line = F.concat(F.lit("8=FIX.4.4"), mark, F.lit("35=D"), mark, F.lit("34="), k.cast("string"), mark, F.lit("11=A"), F.col("o_custkey").cast("string"), mark)
    return fix.tags(o.select("o_orderkey", line.alias("line")))
