"""Guarded read-only SQL: one SELECT over allowed tables, with a limit, audited.

The text is parsed by Spark and the parsed plan is walked, so that words in literals, tables joined by commas, CTEs and nested
limits are seen for what they are. The limit holds for the outermost query.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Tables that may be read, and the limits on rows.
ALLOWED_TABLES = ("cases", "devices", "contacts", "messages", "calls", "media", "locations")
DEFAULT_LIMIT, MOST_ROWS = 100, 1000


@dataclass
class Verdict:
    ok: bool
    message: str
    tables: list[str] = field(default_factory=list)
    limit: int | None = None


def _comments(sql: str) -> bool:
    """Whether a text holds a comment outside quotes."""
    quote, i = "", 0
    while i < len(sql):
        c = sql[i]
        if quote:
            if c == "\\" and quote != "`":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif sql.startswith("--", i) or sql.startswith("/*", i):
            return True
        i += 1
    return False


def _statements(sql: str) -> int:
    quote, parts, some = "", 0, False
    for c in sql:
        if quote:
            quote = "" if c == quote else quote
            some = True
        elif c in "'\"`":
            quote, some = c, True
        elif c == ";":
            parts, some = parts + some, False
        elif not c.isspace():
            some = True
    return parts + some


def _walk(plan, seen: list) -> None:
    seen.append(plan)
    for group in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for i in range(group.length()):
            child = group.apply(i)
            if hasattr(child, "innerChildren"):
                _walk(child, seen)


def inspect(spark: SparkSession, sql: str, allowed: tuple[str, ...] = ALLOWED_TABLES) -> Verdict:
    """Whether a statement may run: checks in order on emptiness, number of statements, comments, kind, tables and limit."""
    text = (sql or "").strip()
    if not text or text == ";":
        return Verdict(False, "Empty SQL query")
    if _statements(text) > 1:
        return Verdict(False, "Multiple statements not allowed")
    if _comments(text):
        return Verdict(False, "SQL comments not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text.rstrip("; \n\t"))
    except Exception as e:  # noqa: BLE001 - the parser's own error is the message
        return Verdict(False, f"SQL parsing error: {str(e).splitlines()[0][:160]}")
    nodes: list = []
    _walk(plan, nodes)
    names = [n.getClass().getSimpleName() for n in nodes]
    if any("Command" in n or n.startswith(("Create", "Drop", "Insert", "Delete", "Update", "Merge", "Alter", "Truncate", "Replace", "Set", "Use", "Show", "Describe", "Cache", "Refresh")) for n in names):
        return Verdict(False, "Only SELECT queries are allowed")
    ctes = {a.strip() for n in nodes if n.getClass().getSimpleName() == "UnresolvedWith" for a in _cte_names(n)}
    tables = sorted({n.tableName().strip("`").lower() for n in nodes if n.getClass().getSimpleName() == "UnresolvedRelation"} - ctes)
    wrong = [t for t in tables if t not in allowed]
    if wrong:
        return Verdict(False, f"Table not allowed: {wrong[0]}", tables)
    limit = None
    top = plan
    while top.getClass().getSimpleName() == "UnresolvedWith":
        top = top.child()
    if top.getClass().getSimpleName() == "GlobalLimit":
        said = top.limitExpr().toString()
        limit = int(said) if said.isdigit() else None
    if limit is None:
        return Verdict(False, "LIMIT clause required", tables)
    if limit > MOST_ROWS:
        return Verdict(False, f"LIMIT exceeds maximum of {MOST_ROWS}", tables, limit)
    return Verdict(True, "Valid", tables, limit)


def _cte_names(node) -> list[str]:
    relations = node.cteRelations()
    return [relations.apply(i)._1().lower() for i in range(relations.length())]


def sanitise(spark: SparkSession, sql: str) -> str:
    """The statement without a closing semicolon, with a limit added or brought down to the most allowed."""
    text = sql.strip().rstrip("; \n\t")
    verdict = inspect(spark, text)
    if verdict.message == "LIMIT clause required":
        return f"SELECT * FROM ({text}) LIMIT {DEFAULT_LIMIT}"
    if verdict.limit and verdict.limit > MOST_ROWS:
        return f"SELECT * FROM ({text}) LIMIT {MOST_ROWS}"
    return text


def run(spark: SparkSession, sql: str, user: str = "system", clean: bool = True, audit: str | None = None) -> DataFrame:
    """Result of a statement that passes the guard; a ValueError with the reason otherwise. Every call is audited."""
    began = time.time()
    text = sanitise(spark, sql) if clean and sql and sql.strip() else sql
    verdict = inspect(spark, text)
    entry = {"query_id": f"Q{int(began * 1000)}", "user": user, "status": "OK" if verdict.ok else "REJECTED", "sql": " ".join((sql or "").split())[:200], "details": verdict.message}
    if audit:
        with Path(audit).open("a") as f:
            f.write(json.dumps(entry, ensure_ascii=False) + "\n")
    if not verdict.ok:
        raise ValueError(verdict.message)
    return spark.sql(text)


def register(spark: SparkSession, sf_dir: str) -> None:
    """Make the allowed tables of a folder known as views."""
    from casegrid.session import table

    for name in ("cases", "devices", "contacts", "messages", "calls", "media"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def formatted(df: DataFrame, form: str = "dict"):
    """A guarded result, which its limit bounds, as dict rows, pandas frame, lists or JSON text."""
    if form == "dataframe":
        return df.toPandas()
    rows = [r.asDict(recursive=True) for r in df.collect()]
    if form == "list":
        return [list(r.values()) for r in rows]
    return json.dumps(rows, default=str, ensure_ascii=False) if form == "json" else rows
