"""A gate for free SQL: one reading statement over registered views, judged by its parsed plan and not by its words."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

#: Steps of a parsed plan that only read, and functions that make rows from their arguments.
READING = frozenset(
    """Project Filter Join LateralJoin Aggregate Sort Distinct Union Intersect Except SubqueryAlias GlobalLimit LocalLimit Offset Tail Sample
    UnresolvedRelation UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedInlineTable UnresolvedTableValuedFunction LocalRelation OneRowRelation
    ResolvedInlineTable WithWindowDefinition Window Generate Pivot UnresolvedPivot Unpivot UnpivotTransformer Expand ExplainCommand UnresolvedTVFAliases ParameterizedQuery""".split()
)
ROW_MAKERS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split())
#: Functions that reach beyond the tables.
BEYOND = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length".split())
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)


class Refused(ValueError):
    pass


def _seq(found: object) -> list:
    return [found.apply(k) for k in range(found.size())]


def _kind(node: object) -> str:
    return node.getClass().getSimpleName()


def _inner(node: object) -> Iterator[object]:
    """Plans inside a plan: its children, those of expressions, and named ones."""
    yield from _seq(node.children())
    if _kind(node) == "UnresolvedWith":
        for pair in _seq(node.cteRelations()):
            yield pair._2()
    if _kind(node) == "ExplainCommand":
        yield node.logicalPlan()
    todo = _seq(node.expressions())
    while todo:
        e = todo.pop()
        if _kind(e) in ("ScalarSubquery", "ListQuery", "Exists", "InSubquery", "LateralSubquery"):
            inner = e.query() if _kind(e) == "InSubquery" else e
            yield inner.plan()
        if _kind(e) == "UnresolvedFunction":
            name = ".".join(map(str, _seq(e.nameParts()))).lower()
            if name in BEYOND:
                raise Refused(f"the function {name} is not allowed")
        todo += _seq(e.children())


def _names(node: object) -> set[str]:
    return {str(pair._1()).lower() for pair in _seq(node.cteRelations())} if _kind(node) == "UnresolvedWith" else set()


def check_query(spark: SparkSession, query: str) -> str:
    """The statement without its end mark. Raises Refused unless it is one statement that only reads registered views.

    Names of columns, quoted text and comments play no part. Tables of a catalog and paths are refused: only temporary views
    are read.
    """
    text = query.strip()
    bare = _QUOTED.sub(" ", text).strip()
    if ";" in bare.rstrip("; \n\t"):
        raise Refused("only one statement is allowed")
    if bare.endswith(";"):
        text = text.rstrip("; \n\t")
    if not bare.rstrip("; "):
        raise Refused("there is no statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as error:
        raise Refused(f"the statement can't be read: {error}") from error
    todo = [(plan, frozenset())]
    while todo:
        node, known = todo.pop()
        kind = _kind(node).rstrip("$")
        if kind not in READING:
            raise Refused(f"only reading statements are allowed, not {kind}")
        known = known | _names(node)
        if kind == "UnresolvedRelation":
            parts = list(map(str, _seq(node.multipartIdentifier())))
            if len(parts) > 1 or parts[0].lower() not in known and not is_view(spark, parts[0]):
                raise Refused(f"{'.'.join(parts)} is no registered view")
        if kind == "UnresolvedTableValuedFunction":
            name = ".".join(map(str, _seq(node.name()))).lower()
            if name not in ROW_MAKERS:
                raise Refused(f"the function {name} is not allowed")
        todo += [(x, known) for x in _inner(node)]
    return text


def is_view(spark: SparkSession, name: str) -> bool:
    return bool(spark._jsparkSession.sessionState().catalog().getTempView(name).isDefined())


def read_only(spark: SparkSession, query: str, limit: int) -> DataFrame:
    """Rows of one reading statement, at most `limit`."""
    text = check_query(spark, query)
    return spark.sql(text).limit(limit)
