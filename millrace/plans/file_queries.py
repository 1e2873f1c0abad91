"""Registered queries of walks, file generations, streamed inference, nested contracts, positions, budgets, life cycles, commits, shreds and deadlines."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.text import within_bytes
from millrace.operators import catalog, contract, lifecycle, manifest, nested, parsers, positions, shred
from millrace.operators.contract import ContractColumn
from millrace.operators.lifecycle import MOVES, STATES
from millrace.operators.staging import shared_folder
from millrace.plans.queries import ORACLE_SQL, query, table, texts_of_orders
from millrace.sources.walk import WalkOptions, local_path, move_files, walk, write_files
from millrace.streaming.generation_stream import current, process_generations
from millrace.streaming.inference_stream import infer_until_resolved

#: Times (ms) that the queries' files get: of a first and of a second generation.
FIRST, SECOND = 1_700_000_000_000, 1_700_000_600_000


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, as a path that tasks can open."""
    at = local_path(shared_folder(spark))
    if at is None:
        raise ValueError("these queries write files below a mounted folder")
    return f"{at}/{label}-{os.urandom(8).hex()}"


# ---- walks


def named_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files below folders of their urls' hosts and languages; every seventh below a hidden folder, every eleventh below one that walks pass over."""
    steps = F.split("url", "/")
    where = F.when(F.col("page_id") % 7 == 0, ".drafts/").when(F.col("page_id") % 11 == 0, "node_modules/").otherwise("")
    path = F.concat(F.array_join(F.reverse(F.split(steps[2], r"\.")), "/"), F.lit("/"), where, steps[3], F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, sf, "pages").select("page_id", path.alias("rel_path"), F.col("html").alias("content"), F.lit(FIRST).alias("time"))


def page_tree(spark: SparkSession, sf: str) -> str:
    """named_pages() written; the folder's path."""
    root = folder(spark, "tree")
    write_files(named_pages(spark, sf), root, mtime="time").write.format("noop").mode("overwrite").save()
    return root


_TREE = "(select *, array_to_string(list_reverse(string_split(string_split(url, '/')[3], '.')), '/') || '/' as host, case when page_id % 7 = 0 then '.drafts/' when page_id % 11 = 0 then 'node_modules/' else '' end as aside, string_split(url, '/')[4] || '/' as part from pages)"


@query(f"""select host || aside || part || page_id || '.html' as rel_path, page_id || '.html' as name, 'html' as extension, strlen(html) as size, {FIRST} as mtime, cast(len(string_split(host || aside || part, '/')) as int) as depth
from {_TREE} where aside <> 'node_modules/'""")
def walked_pages(spark, sf):
    files, errors = walk(spark, page_tree(spark, sf), budget=500)
    return files.select("rel_path", "name", "extension", "size", "mtime", "depth").unionByName(errors.select(F.col("path").alias("rel_path")), allowMissingColumns=True)


@query(f"""select regexp_extract(host || part, '^(.*)/[^/]*$', 1) as parent_path, count(*) as n_files, cast(sum(strlen(html)) as bigint) as n_bytes from {_TREE}
where aside = '' and len(string_split(host || part, '/')) <= 4 and not contains(host, '/m/') group by 1""")
def walked_folders(spark, sf):
    """No hidden names, four levels at most, no path with `/m/`."""
    files, _ = walk(spark, page_tree(spark, sf), WalkOptions(hidden=False, max_depth=4, skip_paths=("/m/",)), budget=100)
    return files.groupBy("parent_path").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


#: What becomes of a page between two scans.
_FATE = "case when page_id % 5 = 0 then 'changed' when page_id % 7 = 3 then 'moved' when page_id % 9 = 4 then 'deleted' else 'unchanged' end"


def two_scans(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """A lake with the catalog of a page tree, committed, and a second scan after files were written anew, moved and removed."""
    root, lake = page_tree(spark, sf), folder(spark, "catalog")
    scan = lambda: walk(spark, root, budget=500)[0].select("rel_path", "size", "mtime", "uid")
    first = scan().withColumn("status", F.lit("processed"))
    manifest.commit(spark, lake, {"catalog": (first, "error")}, "scan-1")
    p = named_pages(spark, sf).withColumn("fate", F.expr(_FATE))
    again = p.where("fate = 'changed'").select("rel_path", F.concat("content", F.lit("x")).alias("content"), F.lit(SECOND).alias("time"))
    write_files(again, root, mtime="time").write.format("noop").mode("overwrite").save()
    gone = p.where("fate in ('moved', 'deleted')").select("rel_path", F.when(F.col("fate") == "moved", F.concat(F.lit("moved/"), F.col("page_id").cast("string"), F.lit(".html"))).alias("new_path"))
    move_files(gone, root).write.format("noop").mode("overwrite").save()
    return lake, scan()


_SCANS = f"""scans as (select *, host || aside || part || page_id || '.html' as place, {_FATE} as fate, aside <> 'node_modules/' as seen from {_TREE})"""


@query(f"""with {_SCANS} select place as rel_path, case fate when 'moved' then 'deleted' else fate end as state, case fate when 'unchanged' then 'processed' when 'changed' then 'pending' else 'deleted' end as status,
  strlen(html) + (fate = 'changed')::int as size from scans where seen union all select 'moved/' || page_id || '.html', 'new', 'pending', strlen(html) from scans where fate = 'moved'""")
def rescanned_catalog(spark, sf):
    """A second scan merged into the committed catalog, and committed in its place."""
    lake, now = two_scans(spark, sf)
    merged = catalog.upsert(manifest.read(spark, lake, "catalog"), now, "rel_path", ["size", "mtime", "uid"])
    manifest.commit(spark, lake, {"catalog": (merged, "replace")}, "scan-2")
    return manifest.read(spark, lake, "catalog").select("rel_path", "state", "status", "size")


@query(f"with {_SCANS} select place as old_path, 'moved/' || page_id || '.html' as new_path from scans where seen and fate = 'moved'")
def moved_files(spark, sf):
    """Files found under another path by their device and inode, which others that were written meanwhile may have taken over."""
    lake, now = two_scans(spark, sf)
    return catalog.renames(manifest.read(spark, lake, "catalog"), now, same=("size", "mtime")).select("old_path", "new_path")


# ---- generations


def event_files(spark: SparkSession, sf: str, root: str, time: int, value: Column, some: str = "true") -> None:
    """Events as lines of JSON, 500 a file."""
    e = table(spark, sf, "events").withColumn("file", F.floor(F.col("event_id") / 500)).where(some)
    line = F.to_json(F.struct("event_id", value.alias("value")))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n"), F.lit("\n"))
    files = e.groupBy("file").agg(text.alias("content")).select(F.concat(F.lit("day="), (F.col("file") % 5).cast("string"), F.lit("/"), F.col("file").cast("string"), F.lit(".ndjson")).alias("rel_path"), "content", F.lit(time).alias("time"))
    write_files(files, root, mtime="time").write.format("noop").mode("overwrite").save()


def parse_events(lines: DataFrame) -> DataFrame:
    x = F.from_json("line", "event_id long, value decimal(12,2)")
    return lines.select("path", "mtime", "line_number", x["event_id"].alias("event_id"), x["value"].alias("value"))


def two_generations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Rows after a first run; then a third of the files is written anew, and rows after a second and a third run."""
    root, out = folder(spark, "events"), folder(spark, "stream")
    value = F.round("value", 2).cast("decimal(12,2)")
    event_files(spark, sf, root, FIRST, value)
    run = lambda parser="1.0": process_generations(spark, root, parse_events, out, parser, "events")
    run()
    event_files(spark, sf, root, SECOND, value + 1, "file % 3 = 0")
    run()
    return run(), run("1.1")


_EVENTS = "(select event_id, event_id // 500 as file, cast(round(value, 2) as decimal(12,2)) as value from events)"
_BOTH = f"select event_id, {FIRST} as mtime, value, event_id % 500 + 1 as line_number from {_EVENTS} union all select event_id, {SECOND}, value + 1, event_id % 500 + 1 from {_EVENTS} where file % 3 = 0"


@query(_BOTH)
def streamed_generations(spark, sf):
    """Both generations of every file, once each, though the stream was run three times."""
    return two_generations(spark, sf)[0].select("event_id", "mtime", "value", "line_number")


@query(f"""select mtime, count(*) as n, sum(value) as total from (
  {_BOTH.replace(f"from {_EVENTS} union", f"from {_EVENTS} where file % 3 <> 0 union", 1)} union all select event_id, case when file % 3 = 0 then {SECOND} else {FIRST} end, case when file % 3 = 0 then value + 1 else value end, 0 from {_EVENTS}
) group by 1""")
def reprocessed_generations(spark, sf):
    """The last generations, once by each of two versions of the parser: the later one took those that were there."""
    return current(two_generations(spark, sf)[1]).groupBy("mtime").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# ---- inference over a stream


@query(f"select *, (select count(*) from orders) as n_rows, 'end' as stopped from ({ORACLE_SQL['inferred_types']})")
def streamed_types(spark, sf):
    """Types from a stream of files, all of it read: no limit, and a column that is never resolved."""
    df, at = texts_of_orders(spark, sf), folder(spark, "orders")
    df.repartition(6).write.parquet(at)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(at)
    found = infer_until_resolved(stream, df.columns, max_rows=None)
    return found.types.withColumns({"n_rows": F.lit(found.rows).cast("long"), "stopped": F.lit(found.stopped)})


# ---- nested contracts


NESTED = [ContractColumn("event_id", "bigint", False), ContractColumn("cart", "struct<items: array<struct<price: decimal(8,2), n: bigint NOT NULL, day: date>>, note: string>", False)]


def carts(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a cart of two items; some have no cart, prices that are none, items without a number."""
    k = F.col("event_id")
    price = F.round("value", 2).cast("decimal(12,2)").cast("string")
    item = lambda p, n, d: F.struct(p.alias("price"), n.cast("int").alias("n"), d.alias("day"))
    items = F.array(item(price, F.col("user_id"), F.lit("2024-02-29")), item(F.when(k % 5 == 0, "much").otherwise(price), F.when(k % 7 > 0, k), F.when(k % 11 == 0, "2023-02-29").otherwise("")))
    cart = F.when(k % 13 > 0, F.struct(items.alias("items"), F.col("event_type").alias("note")))
    return table(spark, sf, "events").select("event_id", cart.alias("cart"))


@query("""select event_id, case when event_id % 13 = 0 then 'schema: null not allowed in ''cart''' else nullif(concat_ws('; ', case when event_id % 5 = 0 then 'schema: value does not match format ''decimal(8,2)'' for ''cart.items[1].price''' end,
  case when event_id % 7 = 0 then 'schema: null not allowed in ''cart.items[1].n''' end, case when event_id % 11 = 0 then 'schema: value does not match format ''date'' for ''cart.items[1].day''' end), '') end as _cf_row_error,
  case when event_id % 13 > 0 then cast(round(value, 2) as decimal(12,2)) * case when event_id % 5 = 0 then 1 else 2 end end as total, case when event_id % 13 > 0 and event_id % 7 > 0 then event_id + user_id end as numbers, case when event_id % 13 > 0 then event_type end as note from events""")
def nested_contract(spark, sf):
    done = contract.enforce(carts(spark, sf), NESTED)
    items = F.col("cart.items")
    total = F.aggregate(items, F.lit(0).cast("decimal(12,2)"), lambda a, x: (a + F.coalesce(x["price"], F.lit(0))).cast("decimal(12,2)"))
    return done.select("event_id", "_cf_row_error", F.when(items.isNotNull(), total).alias("total"), (items[0]["n"] + items[1]["n"]).alias("numbers"), F.col("cart.note").alias("note"))


@query("""with c(path, wanted) as (values ('o_orderkey', 'compatible'), ('o_custkey', 'mismatch'), ('o_orderdate', 'cast'), ('cart', 'compatible'), ('cart[]', 'compatible'), ('cart[].price', 'cast'), ('cart[].n', 'mismatch'), ('cart[].void', 'null_only'), ('cart[].gone', 'mismatch'), ('cart[].more', 'mismatch'))
select path, wanted as outcome, count(*) as n_rows from orders, c group by 1, 2""")
def type_outcomes(spark, sf):
    """How the columns of a table fit a contract, part by part, with the rows that are concerned."""
    item = F.struct(F.col("o_totalprice").cast("string").alias("price"), F.lit("1").alias("n"), F.lit(None).alias("void"), F.lit(1).alias("more"))
    df = table(spark, sf, "orders").select(F.col("o_orderkey").cast("int").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.array(item).alias("cart"))
    want = StructType.fromDDL("o_orderkey bigint, o_custkey bigint, o_orderdate date, cart array<struct<price: decimal(12,2), n: bigint, void: string, gone: int>>")
    n = df.agg(F.count("*").alias("n_rows"))
    return nested.compatibility_frame(spark, df.schema, want).select("path", "outcome").crossJoin(F.broadcast(n))


# ---- positions and budgets


@query("select l_orderkey, l_linenumber, row_number() over (order by l_shipdate desc, l_orderkey, l_linenumber) - 1 as _output_row_index from lineitem")
def output_row_index(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return positions.with_row_index(df, [F.desc("l_shipdate"), "l_orderkey", "l_linenumber"]).drop("l_shipdate")


_RUNNING = "select doc_id, row_number() over w - 1 as position, cast(sum(strlen(coalesce(text, ''))) over w as bigint) as running_bytes from documents window w as (order by lang, doc_id)"


@query(f"select doc_id, position, running_bytes, (select count(*) > 5000 or sum(strlen(coalesce(text, ''))) > 1000000 from documents) as truncated from ({_RUNNING}) where position < 5000 and running_bytes <= 1000000")
def budgeted_rows(spark, sf):
    """Documents in order until a megabyte of text or 5 000 rows."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return positions.budgeted(d, ["lang", "doc_id"], 5000, 1_000_000, F.octet_length("text")).drop("lang", "text")


@query(_RUNNING)
def running_bytes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return positions.with_positions(d, ["lang", "doc_id"], weight=F.octet_length("text"), running="running_bytes").drop("lang", "text")


@query("select l_orderkey, l_linenumber, position, case when n > 3000 then 3000 end as next_cursor from (select *, row_number() over (order by l_shipdate, l_orderkey, l_linenumber) - 1 as position, count(*) over () as n from lineitem) where position between 2900 and 2999")
def late_page(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return positions.page(df, ["l_shipdate", "l_orderkey", "l_linenumber"], 2900, 100).drop("l_shipdate")


@query("""select doc_id, left(text, (select max(i) from unnest(range(0, 101)) t(i) where strlen(left(text, i)) <= 100)) as cut, strlen(text) > 100 as truncated from documents""")
def cut_texts(spark, sf):
    """Texts within a budget of 100 bytes each, with a flag for those cut short."""
    return table(spark, sf, "documents").select("doc_id", within_bytes(F.col("text"), 100).alias("cut"), (F.octet_length("text") > 100).alias("truncated"))


# ---- life cycle


def status_log(spark: SparkSession, sf: str, file: Column) -> DataFrame:
    """A status change for each line of an order; one in nine has no known status."""
    code = (F.col("l_orderkey") * 5 + F.col("l_linenumber") * 3) % 9
    names = F.array(*[F.lit(s.upper() if k % 2 else s) for k, s in enumerate(STATES)], F.lit("lost"))
    return table(spark, sf, "lineitem").select(file.alias("file_id"), "l_orderkey", "l_linenumber", names[code.cast("int")].alias("status"))


_BITS = "[" + ", ".join(str(sum(1 << STATES.index(t) for t in (*MOVES[s], s))) for s in STATES) + "]"
_NAMES = "['" + "', '".join(s.upper() if k % 2 else s for k, s in enumerate(STATES)) + "', 'lost']"
_STATES = "['" + "', '".join(STATES) + "']"
_HOT = "case when l_suppkey % 3 = 0 then 0 else l_suppkey end"


@query(f"""select file_id, {_STATES}[1 + a % 8] as status, n as n_changes, a // 8 as n_illegal from (
  select file_id, len(xs) as n, list_reduce(xs, lambda a, x: case when ({_BITS}[1 + a % 8] >> x) & 1 = 1 then a - a % 8 + x else a + 8 end, cast(0 as bigint)) as a
  from (select {_HOT} as file_id, list(cast((l_orderkey * 5 + l_linenumber * 3) % 9 as bigint) order by l_orderkey, l_linenumber) as xs from lineitem group by 1))""")
def file_states(spark, sf):
    """A third of all changes are of one file."""
    return lifecycle.final_states(status_log(spark, sf, F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("l_suppkey"))), "file_id", ["l_orderkey", "l_linenumber"])


@query(f"""with recursive log as (
  select l_suppkey as file_id, l_orderkey, l_linenumber, cast((l_orderkey * 5 + l_linenumber * 3) % 9 as bigint) as x, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as nth from lineitem
), walk as (
  select file_id, cast(0 as bigint) as nth, cast(0 as bigint) as before, cast(0 as bigint) as state, true as ok from log group by 1
  union all
  select w.file_id, l.nth, w.state, case when ({_BITS}[1 + w.state] >> x) & 1 = 1 then x else w.state end, ({_BITS}[1 + w.state] >> x) & 1 = 1 from walk w join log l on l.file_id = w.file_id and l.nth = w.nth + 1
)
select file_id, l_orderkey, l_linenumber, {_STATES}[1 + before] as from_status, {_NAMES}[1 + x] as status from walk join log using (file_id, nth) where not ok""")
def illegal_status_moves(spark, sf):
    return lifecycle.illegal_moves(status_log(spark, sf, F.col("l_suppkey")), "file_id", ["l_orderkey", "l_linenumber"])


# ---- commits


@query("""with e as (select event_id, cast(round(value, 2) as decimal(12,2)) as value from events), sums as (select event_id % 10 = 0 as bad, count(*) as n, sum(value) as total, sum(value + 1) as more from e group by 1)
select 'held events' as seen, n as n_rows, total from sums where not bad union all select 'held events_quarantine', n, total from sums where bad union all select 'now events', n, more from sums where not bad union all select 'now events_quarantine', n, more from sums where bad
union all select 'after events', n, more from sums where not bad union all select 'after events_quarantine', n, more from sums where bad union all select 'appended events', n * 2, total + more from sums where not bad union all select 'appended events_quarantine', n, more from sums where bad""")
def replaced_outputs(spark, sf):
    """Two tables replaced at once under a reader that keeps what it held; a commit that fails changes nothing; one more appends."""
    root = folder(spark, "lake")
    e = table(spark, sf, "events").select("event_id", F.round("value", 2).cast("decimal(12,2)").alias("value"))
    bad = F.col("event_id") % 10 == 0
    outputs = lambda df, mode: {"events": (df.where(~bad), mode), "events_quarantine": (df.where(bad), mode)}
    later = e.withColumn("value", (F.col("value") + 1).cast("decimal(12,2)"))
    seen = lambda: {name: manifest.read(spark, root, name) for name in ("events", "events_quarantine")}
    manifest.commit(spark, root, outputs(e, "error"), "first")
    views = {"held": seen()}
    manifest.commit(spark, root, outputs(later, "replace"), "second", "csv")
    views["now"] = seen()
    broken = later.withColumn("value", F.when(F.col("event_id") < 0, F.col("value")).otherwise(F.raise_error(F.lit("broken")).cast("decimal(12,2)")))
    try:
        manifest.commit(spark, root, outputs(broken, "replace"), "third")
    except Exception:  # noqa: BLE001  meant to fail
        views["after"] = seen()
    manifest.commit(spark, root, {"events": (e.where(~bad), "replace"), "events_quarantine": (later.where(bad), "replace")}, "fourth")
    manifest.commit(spark, root, {"events": (later.where(~bad), "append")}, "fifth")
    views["appended"] = seen()
    out = None
    for when, tables in views.items():
        for name, df in tables.items():
            one = df.agg(F.count("*").alias("n_rows"), F.sum("value").alias("total")).select(F.lit(f"{when} {name}").alias("seen"), "n_rows", "total")
            out = one if out is None else out.unionByName(one)
    return out


# ---- shredding raw lines


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as CSV lines below a header, as JSON lines, and as log lines."""
    e = table(spark, sf, "events")
    k, t = F.col("event_id").cast("string"), F.col("event_type")
    return e.select("event_id", F.concat(k, F.lit(',"'), t, F.lit('",'), F.col("user_id").cast("string")).alias("csv"), F.concat(F.lit('{"id":'), k, F.lit(',"event":{"type":"'), t, F.lit('"}}')).alias("json"), F.concat(F.lit("at "), k, F.lit(" type="), t, F.lit(";")).alias("log"))


_SHREDS = """select '{0}' as strategy, coalesce(shard, '_MISC') as shard, count(*) as n_lines, cast(sum(strlen({1}) + 1) as bigint) as n_bytes from (select *, {1} as line, case when event_type in (select k from best) then event_type end as shard from events) group by 2"""
_LINES = {"csv": """event_id || ',"' || event_type || '",' || user_id""", "json": """'{"id":' || event_id || ',"event":{"type":"' || event_type || '"}}'""", "regex": "'at ' || event_id || ' type=' || event_type || ';'"}


@query("with best as (select event_type as k from events group by 1 order by count(*) desc, k limit 2) " + " union all ".join(_SHREDS.format(s, line) for s, line in _LINES.items()))
def shredded_lines(spark, sf):
    """Lines shredded by a CSV field, a JSON path and a named group, written as files of 20 000 bytes at most and read back."""
    df, out = raw_events(spark, sf), None
    header = spark.createDataFrame([(-1, "id,type,user")], "event_id long, line string")
    for strategy, column, options in (("csv", "csv", {"index": 1, "has_header": True}), ("json", "json", {"path": "event.type"}), ("regex", "log", {"pattern": r"type=(?<kind>\w+);", "group": "kind"})):
        lines = df.select("event_id", F.col(column).alias("line"))
        lines = header.unionAll(lines) if strategy == "csv" else lines
        root = folder(spark, f"shreds-{strategy}")
        sharded = shred.shred_lines(lines, "line", strategy, top=2, promotion=1 << 40, order=["event_id"], **options)
        shred.write_line_files(sharded, root, "line", ["event_id"], 20_000, "id,type,user" if strategy == "csv" else None)
        back = spark.read.text(root).select("value", "shard", F.col("_metadata.file_size").alias("size"))
        back = back.where("value <> 'id,type,user' and size <= 20000")
        one = back.groupBy("shard").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("value") + 1).alias("n_bytes")).select(F.lit(strategy).alias("strategy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# ---- extractors


@query("""select 'doc/' || doc_id as path, case doc_id when 7 then 'timeout' when 11 then 'crash' when 13 then 'error' else 'ok' end as status, case when doc_id not in (7, 11, 13) then '{"bytes": ' || strlen(coalesce(text, '')) || ', "words": ' || len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) || '}' end as metadata,
  case doc_id when 7 then 'no answer within 2 s' when 11 then 'exit code 3' when 13 then 'no document' end as error from documents""")
def extracted_with_deadlines(spark, sf):
    """One document hangs its extractor, one takes it down and one makes it fail; all other rows are there."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    content = F.concat(F.when(k == 7, "H").when(k == 11, "C").when(k == 13, "E").otherwise(" "), F.coalesce("text", F.lit(""))).cast("binary")
    return parsers.extract(d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), content.alias("content")), describe, 2.0)


def describe(path: str, content: bytes) -> dict:
    """Bytes and words of a document; its first letter may tell it to hang, to crash or to fail."""
    if content[:1] == b"H":
        time.sleep(3600)
    if content[:1] == b"C":
        os._exit(3)
    if content[:1] == b"E":
        raise ValueError("no document")
    return {"bytes": len(content) - 1, "words": len(content[1:].split())}
