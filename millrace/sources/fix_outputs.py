"""FIX logs as four tables: order lifecycle, session events, parse errors and tags.

Lines come as a table with source_path, line_number, line and source_fingerprint. Each output is one projection over the
messages, so no output shuffles and each reads the lines once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import lifecycle_event
from millrace.sources.fix import ORDER_TYPES, fields, messages

SESSION_TYPES = ("A", "0", "1", "2", "3", "4", "5", "j")
HEAD = ("source_path", "line_number", "message_index", "raw_line_hash", "source_fingerprint")
#: Columns, their FIX tags and kinds, in output order.
STANDARD = (
    ("begin_string", 8, "string"), ("body_length", 9, "bigint"), ("msg_type", 35, "string"), ("msg_seq_num", 34, "bigint"), ("sending_time", 52, "timestamp"),
    ("sender_comp_id", 49, "string"), ("target_comp_id", 56, "string"), ("poss_dup_flag", 43, "string"), ("orig_sending_time", 122, "timestamp"),
    ("sender_sub_id", 50, "string"), ("target_sub_id", 57, "string"),
)
ORDER = (
    *STANDARD, ("sender_location_id", 142, "string"), ("target_location_id", 143, "string"), ("cl_ord_id", 11, "string"), ("orig_cl_ord_id", 41, "string"), ("order_id", 37, "string"),
    ("exec_id", 17, "string"), ("secondary_cl_ord_id", 526, "string"), ("cl_ord_link_id", 583, "string"), ("symbol", 55, "string"), ("side", 54, "string"), ("security_id", 48, "string"),
    ("security_id_source", 22, "string"), ("currency", 15, "string"), ("ord_type", 40, "string"), ("time_in_force", 59, "string"), ("order_qty", 38, "decimal"), ("price", 44, "decimal"),
    ("transact_time", 60, "timestamp"), ("exec_type", 150, "string"), ("ord_status", 39, "string"), ("cum_qty", 14, "decimal"), ("leaves_qty", 151, "decimal"), ("last_qty", 32, "decimal"),
    ("last_px", 31, "decimal"), ("avg_px", 6, "decimal"), ("lifecycle_event", None, "event"), ("account", 1, "string"), ("acct_id_source", 660, "string"), ("account_type", 581, "string"),
    ("text", 58, "string"), ("ord_rej_reason", 103, "string"), ("cxl_rej_reason", 102, "string"), ("business_reject_reason", 380, "string"), ("ref_msg_type", 372, "string"),
    ("ref_seq_num", 45, "bigint"), ("session_reject_reason", 373, "string"),
)
SESSION = (
    *STANDARD, ("ref_msg_type", 372, "string"), ("ref_seq_num", 45, "bigint"), ("business_reject_ref_id", 379, "string"), ("business_reject_reason", 380, "string"),
    ("session_reject_reason", 373, "string"), ("text", 58, "string"), ("cl_ord_id", 11, "string"), ("order_id", 37, "string"), ("exec_id", 17, "string"), ("account", 1, "string"),
    ("symbol", 55, "string"), ("side", 54, "string"),
)
DECIMALS = tuple((name, tag) for name, tag, kind in ORDER if kind == "decimal")
PREVIEW = 200


def parsed(lines: DataFrame) -> DataFrame:
    """A row a message: lines' columns, raw_line_hash, message_index, message, and its tags and values, last field first."""
    m = messages(hashed(lines)).withColumn("fields", F.reverse(F.filter(fields(F.col("message")), lambda f: f["tag"] != "")))
    return m.withColumns({"tags": F.col("fields.tag"), "values": F.col("fields.value")}).drop("fields").withColumn("msg_type", value(35))


def hashed(lines: DataFrame) -> DataFrame:
    """lines with raw_line_hash, of the line as it is without its end; then the line is trimmed."""
    return lines.withColumn("raw_line_hash", F.sha2(F.regexp_replace("line", "[\r\n]+$", ""), 256)).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))


def value(tag: int) -> Column:
    """Value of a tag of parsed(); the last of repeated ones, null without."""
    return F.get("values", (F.array_position("tags", F.lit(str(tag))) - 1).cast("int"))


def timestamp(v: Column, zone: str) -> Column:
    """The instant of `yyyyMMdd-HH:mm:ss` with up to six decimals in a zone, whatever the session's zone is."""
    iso = F.regexp_replace(v, r"^(\d{4})(\d{2})(\d{2})-(\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)$", "$1-$2-$3 $4")
    return F.when(iso != v, F.concat(iso, F.lit(f" {zone}")).try_cast("timestamp"))


def decimal(v: Column) -> Column:
    """decimal(38,10), half up; null if it is no number or has over 18 digits before the point (28 in all are exact)."""
    d = F.when(v.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?\s*$"), v.try_cast("decimal(38,10)"))
    return F.when(F.abs(d) < F.lit(10**18).cast("decimal(38,0)"), d)


def warning(name: str, v: Column) -> Column:
    """What decimal() changed, or null."""
    d = decimal(v)
    beyond = F.regexp_extract(v, r"\.\d{10}(\d*)", 1).rlike("[1-9]") & ~v.rlike("[eE]")
    scaled = v.rlike("[eE]") & (v.try_cast("decimal(38,19)") != d)
    start = F.concat(F.lit(f"field={name} value="), v)
    return F.when(v.isNotNull() & d.isNull(), F.concat(F.lit("Invalid decimal: "), start)).when(beyond | scaled, F.concat(F.lit("Decimal rounded: "), start, F.lit(" rounded="), d.cast("string")))


def _columns(spec: tuple, zone: str) -> list[Column]:
    make = {
        "string": lambda v: v,
        "bigint": lambda v: F.when(v.rlike(r"^\s*[+-]?\d+\s*$"), v.try_cast("bigint")),
        "decimal": decimal,
        "timestamp": lambda v: timestamp(v, zone),
    }
    event = lifecycle_event(F.col("msg_type"), value(150), value(39))
    return [F.col("line_number").alias("__cf_row_id"), *[(event if kind == "event" else make[kind](value(tag))).alias(name) for name, tag, kind in spec]]


def typed_messages(lines: DataFrame) -> DataFrame:
    """Messages with type, ids, quantities, the order's event and the line's digest; `kind` says order, session or error."""
    m = parsed(lines)
    kind = F.when(F.col("msg_type").isNull(), "error").when(F.col("msg_type").isin(*ORDER_TYPES), "order").otherwise("session")
    m = m.withColumns({"exec_type": value(150), "ord_status": value(39)})
    return m.select(
        *[c for c in lines.columns if c != "line"], "message_index", "raw_line_hash", kind.alias("kind"), "msg_type", "exec_type", "ord_status",
        value(34).try_cast("bigint").alias("msg_seq_num"), value(49).alias("sender_comp_id"), value(56).alias("target_comp_id"), value(11).alias("cl_ord_id"), value(55).alias("symbol"),
        decimal(value(38)).alias("order_qty"), decimal(value(44)).alias("price"), lifecycle_event(F.col("msg_type"), F.col("exec_type"), F.col("ord_status")).alias("lifecycle_event"),
    )


def order_lifecycle(lines: DataFrame, zone: str) -> DataFrame:
    """Messages of ORDER_TYPES with 53 columns; times are of `zone`, which has no default as logs do not tell theirs."""
    m = parsed(lines)
    return m.where(F.col("msg_type").isin(*ORDER_TYPES)).select(*HEAD, *_columns(ORDER, zone))


def session_events(lines: DataFrame, zone: str) -> DataFrame:
    """Messages of SESSION_TYPES with 29 columns."""
    m = parsed(lines)
    return m.where(F.col("msg_type").isin(*SESSION_TYPES)).select(*HEAD, *_columns(SESSION, zone))


def tag_rows(lines: DataFrame, allowed: tuple[int, ...]) -> DataFrame:
    """A row a field whose tag is allowed, with its position from 1 among the message's fields; messages of any type."""
    m = parsed(lines).where(F.coalesce("msg_type", F.lit("")) != "")
    m = m.withColumn("all", fields(F.col("message")))
    each = m.select(*HEAD, "msg_type", F.posexplode("all").alias("at", "f"))
    each = each.select(*HEAD, "msg_type", F.col("f.tag").alias("tag"), F.col("f.value").alias("value"), (F.col("at") + 1).cast("long").alias("position"))
    return each.where(F.col("tag").isin(*map(str, allowed)))


def parse_errors(lines: DataFrame) -> DataFrame:
    """Lines with `=` but no message, messages without a type, and decimals of orders that were changed; other lines give none."""
    own = hashed(lines).where((F.col("line") != "") & F.contains("line", F.lit("=")) & ~F.contains("line", F.lit("8=FIX")))
    none = own.select(
        "source_path", "line_number", F.lit(None).cast("int").alias("message_index"), "raw_line_hash", "source_fingerprint",
        F.lit("No FIX message found (missing 8=FIX prefix)").alias("error_reason"), F.substring("line", 1, PREVIEW).alias("raw_line_preview"),
    )
    m = parsed(lines)
    typeless = F.coalesce("msg_type", F.lit("")) == ""
    found = F.when(typeless, F.array(F.lit("Missing msg_type (tag 35)"))).when(F.col("msg_type").isin(*ORDER_TYPES), F.array_compact(F.array(*[warning(n, value(t)) for n, t in DECIMALS])))
    bad = m.select(*HEAD, F.explode(found).alias("error_reason"), F.substring("message", 1, PREVIEW).alias("raw_line_preview"))
    return none.unionByName(bad)


def outputs(lines: DataFrame, zone: str, allowed: tuple[int, ...] = ()) -> dict[str, DataFrame]:
    """All outputs by name; an output without rows keeps its columns. Tags only where some are allowed."""
    found = {"fix_order_lifecycle": order_lifecycle(lines, zone), "fix_session_events": session_events(lines, zone), "fix_parse_errors": parse_errors(lines)}
    return found | ({"fix_tags": tag_rows(lines, allowed)} if allowed else {})
