"""Scalar functions on text columns; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
GUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
UNIT = "\u001f"


def first_of(*cases: tuple[Column, object], default: object = None) -> Column:
    """The value of the first case that holds."""
    out = None
    for test, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def has_any(c: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(p)) for p in parts))


def strict_decimal(c: Column, precision: int, scale: int) -> Column:
    """Decimal from text, or null: no spaces or exponent, and all digits, leading zeros too, count against the precision."""
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    after = F.length(F.regexp_replace(F.regexp_extract(c, r"\.([0-9]*)$", 1), "[^0-9]", ""))
    fits = c.rlike(DECIMAL) & (digits <= precision) & (after <= scale) & (digits - after <= precision - scale)
    return F.when(fits, c.try_cast(f"decimal({precision},{scale})"))


def violation_type(error: Column) -> Column:
    """null_not_allowed, schema, parser, or unknown for an empty error."""
    schema = F.startswith(error, F.lit("schema:"))
    return first_of((error.isNull() | (F.trim(error) == ""), "unknown"), (schema & F.contains(error, F.lit("null")), "null_not_allowed"), (schema, "schema"), default="parser")


def failure_category(error: Column) -> Column:
    low = F.lower(error)
    return first_of(
        (has_any(low, "type") & has_any(low, "mismatch"), "type_mismatch"),
        (has_any(low, "null", "empty"), "null_not_allowed"),
        (has_any(low, "format"), "format_mismatch"),
        (has_any(low, "parse", "parsing"), "parse_error"),
        (has_any(low, "schema"), "schema_violation"),
        (has_any(low, "not found", "no such file"), "file_not_found"),
        default="unknown",
    )


def retryable(error: Column) -> Column:
    """permanent or transient."""
    low = F.lower(error)
    return F.when(has_any(low, "syntaxerror", "importerror", "modulenotfounderror", "schema", "exited with exit status: 1"), "permanent").otherwise("transient")


def value_type(raw: Column) -> Column:
    """empty, bool, hex, int, timestamp, duration, sid, guid or string, the first that fits."""
    v = F.trim(raw)
    low = F.lower(v)
    return first_of(
        (v.isNull(), None),
        (v == "", "empty"),
        (low.isin("true", "false"), "bool"),
        (v.rlike("^0[xX]0*(?:[0-9a-fA-F]{1,15}|[0-7][0-9a-fA-F]{15})$"), "hex"),
        (v.rlike("^[+-]?[0-9]+$") & v.try_cast("bigint").isNotNull(), "int"),
        (v.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), "timestamp"),
        (F.startswith(v, F.lit("P")), "duration"),
        (F.startswith(v, F.lit("S-1-")), "sid"),
        (F.regexp_replace(v, r"^[{}]+|[{}]+$", "").rlike(GUID), "guid"),
        default="string",
    )


def redact_hash(c: Column, length: int = 8) -> Column:
    return F.concat(F.lit("[hash:"), F.substring(F.sha2(c.cast("string"), 256), 1, length), F.lit("]"))


def redact_truncate(c: Column, length: int) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def within_bytes(c: Column, most: int) -> Column:
    """The longest beginning of a text that takes no more than `most` bytes as UTF-8; no character is cut in two."""
    raw = c.cast("binary")
    cuts = [F.substring(raw, 1, max(0, most - k)).cast("string") for k in range(4)]
    return F.when(F.octet_length(c) <= most, c).otherwise(F.coalesce(*[F.when(F.is_valid_utf8(x), x) for x in cuts]))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once a row, however often f names it: inside lambdas an expression is made again wherever it stands, a variable is not."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def redacted_json(text: Column, length: int | None = None, depth: int = 3) -> Column:
    """JSON with its strings cut to `length`, or, without one, strings and numbers as digests; arrays and objects inside are treated alike, `depth` levels deep, deeper ones as one digest. Booleans and nulls pass."""
    quoted = lambda c: once(F.to_json(F.struct(c.alias("v"))), lambda j: j.substr(F.lit(6), F.length(j) - 6))

    def redacted(x: Column, depth: int) -> Column:
        text, whole = x["text"], x["whole"]
        # Of valid JSON the first letter tells the kind.
        first = F.when(whole.isNotNull(), F.substring(F.ltrim(text, F.lit(" \t\r\n")), 1, 1))
        return once(F.struct(text.alias("text"), whole.alias("whole"), first.alias("first")), lambda y: of_kind(y["text"], y["whole"], y["first"], depth))

    def of_kind(text: Column, whole: Column, first: Column, depth: int) -> Column:
        inner = lambda v: once(F.struct(F.to_json(v).alias("text"), v.alias("whole")), lambda x: redacted(x, depth - 1))
        value = F.get_json_object(text, "$")
        plain = F.when(first == '"', quoted(redact_hash(value) if length is None else once(value, lambda s: redact_truncate(s, length))))
        if length is None:
            plain = plain.when(first.isin(*"-0123456789"), quoted(redact_hash(text)))
        if not depth:
            return plain.when(first.isin("[", "{"), quoted(redact_hash(text))).otherwise(text)
        items = F.transform(F.try_variant_get(whole, "$", "array<variant>"), inner)
        members = F.try_variant_get(whole, "$", "map<string,variant>")
        fields = once(members, lambda m: F.transform(F.json_object_keys(text), lambda k: F.concat(quoted(k), F.lit(":"), inner(F.element_at(m, k)))))
        array = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
        return plain.when(first == "[", array).when(first == "{", F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))).otherwise(text)

    return once(F.struct(text.alias("text"), F.try_parse_json(text).alias("whole")), lambda x: redacted(x, depth))


def binned(c: Column, edges: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """The label of the bin (edge, next edge] that a number lies in; null outside all bins."""
    return first_of(*[((c > lo) & (c <= hi), label) for lo, hi, label in zip(edges, edges[1:], labels)])


def key_of(*parts: Column | str) -> Column:
    """Digest of parts, each followed by the unit separator."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("")), F.lit(UNIT)) for p in parts]), 256)


def safe_name(c: Column) -> Column:
    """A name of lower-case letters, digits and underscores as it is; else a slug and eight digits of its digest."""
    slug = F.regexp_replace(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_")), "^_+|_+$", "")
    slug = F.when(slug == "", "output").otherwise(slug)
    return F.when(c.rlike("^[a-z0-9_]+$"), c).otherwise(F.concat(slug, F.lit("_"), F.substring(F.sha2(c, 256), 1, 8)))


def token_kind(t: Column) -> Column:
    """Placeholder of a path token: <datetime>, <date>, <uuid>, <n>, <hex>, <code>, or the token in lower case."""
    year = F.substring(t, 1, 4).try_cast("int").between(1900, 2100)
    return first_of(
        ((F.length(t) < 8) & ~t.rlike("[0-9]"), F.lower(t)),  # all kinds below have a digit or eight letters
        (t.rlike(r"^\d{8}[_-]\d{6}$") & year, "<datetime>"),
        (t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "<date>"),
        (t.rlike(r"^\d{8}$") & year, "<date>"),
        (t.rlike(r"^\d{4}-\d{2}$"), "<date>"),
        (t.rlike(r"^\d{4}$") & year, "<date>"),
        (t.rlike(GUID), "<uuid>"),
        (t.rlike(r"^\d{2,}$"), "<n>"),
        (t.rlike("^[0-9a-fA-F]{8,}$") & t.rlike("[a-fA-F]"), "<hex>"),
        ((F.length(t) >= 4) & t.rlike("[A-Za-z]") & t.rlike("[0-9]"), "<code>"),
        default=F.lower(t),
    )


def path_template(path: Column) -> Column:
    """A path with its varying parts as placeholders: whole segments first, else tokens between `_`, `-` and `.`."""

    def segment(s: Column) -> Column:
        whole = token_kind(s)
        tokens = F.filter(F.split(s, "[_.-]"), lambda t: t != "")
        kinds = F.transform(tokens, token_kind)
        literal = F.forall(kinds, lambda k: ~F.startswith(k, F.lit("<")))
        return first_of((s == "", ""), (whole.isin("<date>", "<datetime>", "<uuid>"), whole), (literal, F.lower(s)), default=F.array_join(kinds, "_"))

    return F.array_join(F.transform(F.split(path, "/"), segment), "/")


def glob_regex(glob: str) -> str:
    """Regular expression of a glob, any case: empty or `*` is all, one without a slash matches at any depth."""
    glob = "**/*" if glob in ("", "*") else glob if "/" in glob else "**/" + glob
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], "\\" + glob[i] if glob[i] in ".+()[]{}^$|\\" else glob[i])
            i += 1
    return f"(?i)^{out}$"


def lifecycle_event(msg_type: Column, exec_type: Column, ord_status: Column) -> Column:
    """What a FIX message says happened to its order."""
    plain = {"D": "new_order", "F": "cancel_request", "G": "replace_request", "9": "cancel_reject", "H": "status_request"}
    report = {"0": "ack", "1": "partial_fill", "2": "fill", "4": "cancel", "5": "replace", "8": "reject"}
    return first_of(
        *[(msg_type == k, v) for k, v in plain.items()],
        (msg_type.isNull() | (msg_type != "8"), None),
        *[(exec_type == k, v) for k, v in report.items()],
        (ord_status == "8", "reject"),
        default="exec_report",
    )
