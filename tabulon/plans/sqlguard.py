"""Read-only SQL over named tables, checked on the plan that Spark's own parser makes of it."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from tabulon.errors import InvalidRequest

# Plan nodes a query may consist of, functions that are refused, table functions
# that are allowed, and the form of a table name.
QUERY_NODES = frozenset((
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except",
    "Intersect", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "UnresolvedWith", "UnresolvedRelation",
    "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "OneRowRelation", "WithWindowDefinition",
    "LateralJoin", "Generate", "Sample", "Pivot", "Unpivot", "UnresolvedPivot", "ResolvedInlineTable", "LocalRelation",
))
REFUSED_FUNCTIONS = frozenset(("reflect", "java_method", "try_reflect", "input_file_name"))
TABLE_FUNCTIONS = frozenset(("explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "range"))
NAME = re.compile(r"[A-Za-z_]\w*\Z")


def _items(sequence) -> Iterator:
    return (sequence.apply(i) for i in range(sequence.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _check_name(name: str, allowed: frozenset[str] | None = None) -> None:
    if name.lower() in REFUSED_FUNCTIONS or (allowed is not None and name.lower() not in allowed):
        raise InvalidRequest(f"function '{name}' is not allowed")


def _check_expression(expression, tables: frozenset[str]) -> None:
    kind = _kind(expression)
    if kind == "UnresolvedFunction":
        _check_name(list(_items(expression.nameParts()))[-1])
    elif kind == "UnresolvedGenerator":
        _check_name(expression.name().funcName(), TABLE_FUNCTIONS)
    elif "Identifier" in kind:
        raise InvalidRequest("names must be written out")
    if kind in ("ScalarSubquery", "LateralSubquery", "Exists", "ListQuery"):
        _check_plan(expression.plan(), tables)
    elif "Subquery" in kind and kind != "InSubquery":
        raise InvalidRequest(f"'{kind}' is not allowed in a query")
    for child in _items(expression.children()):
        _check_expression(child, tables)


def _check_plan(plan, tables: frozenset[str]) -> None:
    """Only query nodes, over the given tables and the common table expressions in scope."""
    kind = _kind(plan)
    if kind not in QUERY_NODES:
        raise InvalidRequest(f"'{kind}' is not allowed in a query")
    if kind == "UnresolvedWith":
        for named in _items(plan.cteRelations()):
            _check_plan(named._2().child(), tables | ({named._1().lower()} if plan.allowRecursion() else frozenset()))
            tables = tables | {named._1().lower()}
    elif kind == "UnresolvedRelation":
        parts = list(_items(plan.multipartIdentifier()))
        if len(parts) != 1 or parts[0].lower() not in tables:
            raise InvalidRequest(f"unknown table '{'.'.join(parts)}'")
    elif kind == "UnresolvedTableValuedFunction":
        _check_name(list(_items(plan.name()))[-1], TABLE_FUNCTIONS)
    elif kind == "LateralJoin":
        _check_plan(plan.right().plan(), tables)
    for expression in _items(plan.expressions()):
        _check_expression(expression, tables)
    for child in _items(plan.children()):
        _check_plan(child, tables)


def check_select(text: str, names: list[str]) -> str:
    """The statement without its closing semicolon; anything but a plain query over the named
    tables is refused. Columns, aliases and literals may be called anything."""
    body = (text or "").strip().rstrip(";").strip()
    parser = SparkSession.active()._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(body)
    except ParseException as error:
        raise InvalidRequest(f"no query: {str(error).strip().splitlines()[0]}") from error
    _check_plan(plan, frozenset(n.lower() for n in names))
    return body


def run_select(spark: SparkSession, text: str, tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Run one query over the given tables: all its rows, or at most ``limit``.

    The tables enter as common table expressions and the text, which was checked as a whole, as a
    subquery; the limit is part of the plan.
    """
    if not tables:
        raise InvalidRequest("at least one table is needed")
    for name in tables:
        if not NAME.match(name):
            raise InvalidRequest(f"'{name}' is no table name")
    if limit is not None and limit < 0:
        raise InvalidRequest(f"limit {limit} is out of range")
    body = check_select(text, list(tables))
    heads = ", ".join(f"`{name}` AS (SELECT * FROM {{__table_{i}}})" for i, name in enumerate(tables))
    escaped = body.replace("{", "{{").replace("}", "}}")
    bound = {f"__table_{i}": df for i, df in enumerate(tables.values())}
    result = spark.sql(f"WITH {heads} SELECT * FROM (\n{escaped}\n)", **bound)
    return result if limit is None else result.limit(limit)
