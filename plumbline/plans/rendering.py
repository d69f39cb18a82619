"""Statements as SQL text: to read, to log, or to run elsewhere. Running the text gives what lowering gives."""

from __future__ import annotations

import datetime

from pyspark.sql import SparkSession

from plumbline.errors import GuardRefused
from plumbline.functions.expressions import _AS_TEXT, Expr, Ordering, WindowSpec, quoted
from plumbline.plans.statements import Derived, RawQuery, Stack, Statement
from plumbline.sources.tables import Table

_JOINS = {"inner": "JOIN", "left": "LEFT JOIN", "full": "FULL JOIN", "cross": "CROSS JOIN", "semi": "LEFT SEMI JOIN", "anti": "LEFT ANTI JOIN"}


def _constant(v: object) -> str:
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, datetime.datetime):
        return f"TIMESTAMP_NTZ '{v.isoformat(sep=' ')}'"
    if isinstance(v, datetime.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v)


def expression_sql(e: Expr) -> str:
    sql = expression_sql
    a = e.args
    match e.op:
        case "ref":
            return f"{quoted(a[0])}.{quoted(a[1])}"
        case "name":
            return quoted(a[0])
        case "lit":
            return _constant(a[0])
        case "neg":
            return f"(- {sql(a[0])})"
        case "/":
            return f"try_divide({sql(a[0])}, {sql(a[1])})"
        case "+" | "-" | "*" | "=" | "<>" | ">=" | "<=" | ">" | "<":
            return f"({sql(a[0])} {e.op} {sql(a[1])})"
        case "between":
            return f"({sql(a[0])} BETWEEN {sql(a[1])} AND {sql(a[2])})"
        case "in" | "not in":
            return f"({sql(a[0])} {e.op.upper()} ({', '.join(map(_constant, a[1]))}))"
        case "null" | "not null":
            return f"({sql(a[0])} IS {e.op.upper()})"
        case "contains":
            return f"contains({sql(a[0])}, {_constant(a[1])})"
        case "starts":
            return f"startswith({sql(a[0])}, {_constant(a[1])})"
        case "and" | "or":
            return "(" + f" {e.op.upper()} ".join(map(sql, a)) + ")"
        case "case":
            cases = " ".join(f"WHEN {sql(a[1 + 2 * k])} THEN {sql(a[2 + 2 * k])}" for k in range(a[0]))
            return f"CASE {cases}{'' if a[-1] is None else ' ELSE ' + sql(a[-1])} END"
        case "coalesce":
            return f"coalesce({', '.join(map(sql, a))})"
        case "week":
            return f"CAST(next_day(date_sub(CAST({sql(a[0])} AS DATE), 7), 'MO') AS STRING)"
        case "month":
            return f"CAST(trunc(CAST({sql(a[0])} AS DATE), 'MM') AS STRING)"
        case "call":
            text = f"{a[0]}({', '.join(map(sql, a[1:]))})"
            return f"CAST({text} AS STRING)" if a[0] in _AS_TEXT else text
        case "sql":
            text = a[0]
            for n, x in zip(a[1], a[2:], strict=True):
                text = text.replace("{" + n + "}", sql(x))
            return f"({text})"
        case "agg":
            return _aggregate(e)
        case "over":
            return _window(*a)
        case "is_total":
            return f"(grouping({sql(a[0])}) = 1)"
    raise GuardRefused(f"{e.op} has no SQL.")


def _aggregate(e: Expr) -> str:
    if e.args[0] == "call":
        name, args = e.args[1], e.args[2:]
        return f"{'var_pop' if name == 'variance' else name}({', '.join(map(expression_sql, args))})"
    name, column, where = e.args
    value = "1" if column is None else expression_sql(column)
    if where is not None:
        value = f"CASE WHEN {expression_sql(where)} THEN {value} END"
    return f"count(DISTINCT {value})" if name == "count_distinct" else f"{name}({value})"


def _order(o: Ordering) -> str:
    return expression_sql(o.expr) + (" DESC" if o.down else "")


def _window(inner: Expr, spec: WindowSpec) -> str:
    if inner.op == "agg":
        text = _aggregate(inner)
    else:
        name, *args = inner.args
        text = f"{name}({', '.join(expression_sql(x) if isinstance(x, Expr) else str(x) for x in args)})"
    parts = []
    if spec.partition:
        parts.append("PARTITION BY " + ", ".join(map(expression_sql, spec.partition)))
    if spec.order:
        parts.append("ORDER BY " + ", ".join(map(_order, spec.order)))
    if spec.rows is not None or spec.by_range:
        start, end = spec.rows if spec.rows is not None else (None, 0)
        at = lambda n, ways: ways[0] if n is None else "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
        parts.append(f"{'RANGE' if spec.rows is None else 'ROWS'} BETWEEN {at(start, ['UNBOUNDED PRECEDING'])} AND {at(end, ['UNBOUNDED FOLLOWING'])}")
    return f"{text} OVER ({' '.join(parts)})"


def _source(t: Table | Derived) -> str:
    if isinstance(t, Derived):
        return f"({to_sql(t.query)}) {quoted(t.alias)}"
    return f"{'.'.join(map(quoted, t.name.split('.')))} {quoted(t.alias)}"


def to_sql(query: Statement | Stack | RawQuery) -> str:
    """The query as one SELECT."""
    if isinstance(query, RawQuery):
        return query.text
    if isinstance(query, Stack):
        names = ", ".join(quoted(n.name) for n in query.outputs)
        return f" {query.how} ".join(f"(SELECT {names} FROM ({to_sql(p)}))" for p in query.parts)
    if not isinstance(query, Statement):
        raise GuardRefused("a Python step has no SQL.")
    hints = [quoted(j.table.alias) for j in query.joins if j.broadcast]
    lines = ["SELECT " + (f"/*+ BROADCAST({', '.join(hints)}) */ " if hints else "") + ("DISTINCT " if query.distinct else "") + ", ".join(f"{expression_sql(n.expr)} AS {quoted(n.name)}" for n in query.outputs)]
    lines.append("FROM " + _source(query.base))
    lines += [f"{_JOINS[j.how]} {_source(j.table)}" + (f" ON {expression_sql(j.on.expr)}" if j.on is not None else "") for j in query.joins]
    if query.where is not None:
        lines.append("WHERE " + expression_sql(query.where.expr))
    if query.subtotals:
        sets = ("(" + ", ".join(expression_sql(e) for e in (*query.group, *s)) + ")" for s in query.subtotals.sets)
        lines.append("GROUP BY GROUPING SETS (" + ", ".join(sets) + ")")
    elif query.group:
        lines.append("GROUP BY " + ", ".join(map(expression_sql, query.group)))
    if query.having is not None:
        lines.append("HAVING " + expression_sql(query.having.expr))
    if query.order:
        lines.append("ORDER BY " + ", ".join(map(_order, query.order)))
    if query.limit:
        lines.append(f"LIMIT {query.limit}")
    return "\n".join(lines)


def show_sql(query: Statement | Stack) -> None:
    print(to_sql(query))


def export_sql(spark: SparkSession, query: Statement | Stack, path: str) -> None:
    """Writes the text to a folder of any file system that Spark reaches."""
    spark.createDataFrame([(to_sql(query),)], "text string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
