"""A guard for read-only SQL: one SELECT over allowed tables, with a bounded number of rows.

Spark's own parser reads the statement; the guard walks the unresolved plan, subqueries and common
table expressions included, and refuses every node, relation and function that it does not know to
be harmless. Nothing is decided on the text but the first word and the code of a refusal.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the guard: limits, and keywords that name a refusal.
DEFAULT_LIMIT, MAX_LIMIT, MAX_CHARS = 200, 5000, 8000
WRITES = {
    "insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "exec", "execute", "call", "merge", "copy", "vacuum", "attach", "detach", "pragma",
}
#: Plan nodes that only read what their children hold.
READS = {
    "Project", "Filter", "Join", "LateralJoin", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "LimitAll", "Offset", "Distinct", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedWith", "UnresolvedHaving",
    "UnresolvedSubqueryColumnAliases", "WithWindowDefinition", "Generate", "Pivot", "Unpivot", "LocalRelation", "UnresolvedInlineTable", "OneRowRelation", "UnresolvedHint", "Sample",
}
#: Built-in functions that run any code.
CALLS = {"reflect", "try_reflect", "java_method"}


@dataclass
class Verdict:
    allowed: bool
    reason: str
    sql: str = ""
    limit: int = DEFAULT_LIMIT
    limited: bool = False
    tables: list[str] = field(default_factory=list)


class Refused(Exception):
    pass


def _each(seq: JavaObject) -> Iterator[JavaObject]:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


def _parse(spark: SparkSession, sql: str) -> JavaObject | None:
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except (PySparkException, Py4JJavaError):
        return None


def _blank(sql: str) -> bool:
    return not re.sub(r"--[^\n]*|/\*.*?\*/|[\s;]", "", sql, flags=re.S)


def _single(spark: SparkSession, sql: str) -> tuple[str, JavaObject]:
    """The statement without its closing semicolon, and its plan."""
    for at in (m.start() for m in re.finditer(";", sql)):
        # A semicolon ends a statement if what stands before it is one; otherwise it is part of a literal or comment.
        if not _blank(sql[:at]) and (plan := _parse(spark, sql[:at])) is not None:
            if not _blank(sql[at:]):
                raise Refused("multi_statement")
            return sql[:at], plan
    plan = _parse(spark, sql)
    if plan is None:
        words = set(re.findall("[a-z]+", sql.lower()))
        raise Refused("file_access" if words & {"outfile", "dumpfile", "load"} else "blocked_keyword" if words & WRITES else "not_parsed")
    return sql, plan


def harmless(spark: SparkSession, name: str) -> bool:
    """Whether a name is one of Spark's own functions, without those that run any code and those in whose place a session has put its own."""
    found = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return name not in CALLS and found.isDefined() and found.get().getSource() == "built-in"


def _names(expression: JavaObject, functions: Callable[[str], bool]) -> None:
    """Refuses an expression that names what is blocked or calls what is not known to be harmless."""
    kind = _kind(expression)
    if kind in ("UnresolvedFunction", "UnresolvedAttribute"):
        parts = [p.lower() for p in _each(expression.nameParts())]
        if set(parts) & (WRITES | CALLS if kind == "UnresolvedFunction" else WRITES):
            raise Refused("blocked_keyword")
        if kind == "UnresolvedFunction" and (len(parts) > 1 or not functions(parts[0])):
            raise Refused("blocked_function")
    elif kind == "UnresolvedGenerator" and not functions(expression.name().unquotedString().lower()):
        raise Refused("blocked_function")
    for child in _each(expression.children()):
        _names(child, functions)


def _relations(plan: JavaObject, known: frozenset[str], functions: Callable[[str], bool]) -> Iterator[str]:
    """Names of the tables that a plan reads; ``known`` are the common table expressions in scope, ``functions`` what may be called."""
    kind = _kind(plan)
    if kind == "UnresolvedRelation":
        parts = [p.lower() for p in _each(plan.multipartIdentifier())]
        if len(parts) > 1 or parts[0] not in known:
            yield ".".join(parts)
    elif kind not in READS:
        raise Refused("blocked_node")
    for e in _each(plan.expressions()):
        _names(e, functions)
    if kind == "UnresolvedWith":
        # Each expression sees those before it, the statement sees all.
        for cte in _each(plan.innerChildren()):
            yield from _relations(cte, known | {cte.alias().lower()} if plan.allowRecursion() else known, functions)
            known |= {cte.alias().lower()}
    for inner in (*_each(plan.children()), *_each(plan.subqueries())):
        yield from _relations(inner, known, functions)


def _outer_limit(plan: JavaObject) -> tuple[int | None, bool]:
    """(the statement's own limit, whether LIMIT can be written after it)."""
    while _kind(plan) in ("UnresolvedWith", "LimitAll"):
        plan = plan.child()
    if _kind(plan) != "GlobalLimit":
        return None, _kind(plan) != "Offset"
    text = plan.limitExpr().sql()
    if not re.fullmatch("[0-9]+", text) or int(text) < 1:
        raise Refused("bad_limit")
    return int(text), False


def check(spark: SparkSession, sql: str | None, tables: set[str]) -> Verdict:
    """Whether a statement may run, and the statement with its own limit, one that is lowered, or a default one.

    ``tables`` are lower-case names as the statement must write them, with a schema if it must name
    one. Common table expressions may have any name; a table of the same name is not reached
    through them. A limit within the statement does not count as its own.
    """
    try:
        if not (sql or "").strip():
            raise Refused("empty")
        if len(sql) > MAX_CHARS:
            raise Refused("too_long")
        if not re.match(r"(?:\s|\(|--[^\n]*\n|/\*.*?\*/)*(?:select|with)\b", sql, re.I | re.S):
            raise Refused("not_select")
        statement, plan = _single(spark, sql.strip())
        found = list(dict.fromkeys(_relations(plan, frozenset(), partial(harmless, spark))))
        if not found:
            raise Refused("no_table")
        if not tables.issuperset(found):
            raise Refused("blocked_table")
        asked, appendable = _outer_limit(plan)
    except Refused as e:
        return Verdict(False, f"refused:{e}")
    limit = min(asked or DEFAULT_LIMIT, MAX_LIMIT)
    if asked == limit:
        return Verdict(True, "ok", statement, limit, tables=found)
    limited = f"{statement}\nLIMIT {limit}" if appendable else f"SELECT * FROM (\n{statement}\n) LIMIT {limit}"
    return Verdict(True, "ok", limited, limit, True, found)


def run(spark: SparkSession, sql: str, tables: set[str]) -> DataFrame:
    """The result of a statement that the guard lets pass; PermissionError otherwise."""
    verdict = check(spark, sql, tables)
    if not verdict.allowed:
        raise PermissionError(verdict.reason)
    return spark.sql(verdict.sql)
