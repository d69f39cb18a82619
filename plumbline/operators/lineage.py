"""Column lineage of statements, fingerprints of logic, and ordered runs."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.errors import GuardRefused, LoadRefused
from plumbline.functions.expressions import Expr, Named, family, quoted
from plumbline.plans.statements import Catalog, Derived, RawQuery, Stack, Statement


@dataclass(frozen=True)
class Edge:
    """From a column to a column: its value goes into it, or it decides which rows there are."""

    source: str
    target: str
    how: str  # value or rows


def edges(name: str, query: Statement | Stack | RawQuery) -> list[Edge]:
    """The edges into the columns of a named query, and of every derived table below it."""
    if isinstance(query, Stack):
        return list(dict.fromkeys(e for p in query.parts for e in edges(name, p)))
    if isinstance(query, PythonStep):
        below = edges(name + " step", query.query)
        return below + [Edge(f"{name} step.{n.name}", f"{name}.{m}", "value") for n in query.query.outputs for m in query.columns]
    if isinstance(query, RawQuery):
        return [Edge("?", f"{name}.{n.name}", "value") for n in query.outputs]
    out: list[Edge] = []
    at = {t.alias: t.name for t in query.sources}
    for t in query.sources:
        if isinstance(t, Derived):
            out += edges(t.name, t.query)
    for n in query.outputs:
        out += [Edge(f"{at[a]}.{c}", f"{name}.{n.name}", "value") for a, c in sorted(n.expr.refs())]
    deciding = [c.expr for c in (query.where, query.having, *(j.on for j in query.joins)) if c is not None] + query.group_expressions()
    for e in deciding:
        out += [Edge(f"{at[a]}.{c}", f"{name}.*", "rows") for a, c in sorted(e.refs())]
    return list(dict.fromkeys(out))


def edges_frame(spark: SparkSession, queries: Mapping[str, Statement | Stack]) -> DataFrame:
    found = [(e.source, e.target, e.how) for n, q in queries.items() for e in edges(n, q)]
    return spark.createDataFrame(found, "source string, target string, how string").distinct()


def logic(queries: Mapping[str, Statement | Stack]) -> dict[str, tuple[str, str]]:
    """Each column's own fingerprint, and its effective one, which also holds those of the columns it comes from."""
    own: dict[str, str] = {}
    into: dict[str, list[str]] = {}
    for name, q in queries.items():
        for e in edges(name, q):
            into.setdefault(e.target, []).append(e.source)
        for p in q.parts if isinstance(q, Stack) else [q]:
            for n in p.outputs:
                rows = [c.expr.key() for c in (getattr(p, "where", None), getattr(p, "having", None), *(j.on for j in getattr(p, "joins", ()))) if c is not None]
                text = repr((n.expr.key(), rows))
                own[f"{name}.{n.name}"] = hashlib.sha256((own.get(f"{name}.{n.name}", "") + text).encode()).hexdigest()[:16]
    done: dict[str, str] = {}

    def effective(column: str, path: frozenset) -> str:
        if column in done:
            return done[column]
        if column in path:
            return "loop"
        above = sorted(effective(s, path | {column}) for s in (*into.get(column, ()), *into.get(column.rpartition(".")[0] + ".*", ())))
        done[column] = hashlib.sha256(repr((own.get(column, column), above)).encode()).hexdigest()[:16]
        return done[column]

    return {c: (own[c], effective(c, frozenset())) for c in own}


def changes(state: DataFrame, now: DataFrame) -> DataFrame:
    """What changed: column, and ADDED, REMOVED, OWN or INHERITED. state: (column, own, effective, recorded), added to only."""
    w = Window.partitionBy("column").orderBy(F.desc("recorded"))
    old = state.withColumn("place", F.row_number().over(w)).where("place = 1").select("column", F.col("own").alias("own0"), F.col("effective").alias("effective0"))
    both = old.join(now.select("column", "own", "effective"), "column", "full_outer")
    kind = F.when(F.col("own0").isNull(), "ADDED").when(F.col("own").isNull(), "REMOVED").when(F.col("own") != F.col("own0"), "OWN").when(F.col("effective") != F.col("effective0"), "INHERITED")
    return both.select("column", kind.alias("change")).where("change IS NOT NULL")


def run_order(reads: Mapping[str, set[str]]) -> list[str]:
    """Tables so that each comes after those it reads; otherwise as given. A loop is refused."""
    out: list[str] = []
    path: list[str] = []

    def visit(t: str) -> None:
        if t in out or t not in reads:
            return
        if t in path:
            raise GuardRefused("tables read each other in a loop: " + " -> ".join([*path[path.index(t) :], t]))
        path.append(t)
        for r in sorted(reads[t]):
            visit(r)
        path.pop()
        out.append(t)

    for t in reads:
        visit(t)
    return out


def run_tables(steps: Mapping[str, tuple[set[str], Callable[[], object]]], leave_out: set[str] = frozenset(), start_from: str | None = None, dry_run: bool = False) -> list[str]:
    """Runs each table's step in order; the first failure stops the rest."""
    order = [t for t in run_order({n: r for n, (r, _) in steps.items()}) if t not in leave_out]
    if start_from is not None:
        order = order[order.index(start_from) :]
    if not dry_run:
        for t in order:
            steps[t][1]()
    return order


class PythonStep:
    """A pandas function's rows as a query: it can be written, checked like any other.

    by: the function sees each group of equal values whole. rows_apart: it sees batches, as its rows do not depend on each
    other. Neither: it sees the whole table, which is refused beyond `most` rows, as one task must hold them.
    """

    def __init__(self, query: Statement | Stack, function: Callable, columns: Mapping[str, str], *, by: Iterable[str] = (), rows_apart: bool = False, most: int = 1_000_000, key: Iterable[str] | None = None):
        self.query, self.function, self.columns, self.by, self.rows_apart, self.most = query, function, dict(columns), tuple(by), rows_apart, most
        self.key = None if key is None else tuple(key)
        self.outputs = tuple(Named(Expr("raw", (c,), family(t)), c) for c, t in self.columns.items())

    def lower(self, catalog: Catalog) -> DataFrame:
        schema = ", ".join(f"{quoted(c)} {t}" for c, t in self.columns.items())
        return python_step(self.query.lower(catalog), self.function, schema, by=self.by, rows_apart=self.rows_apart, most=self.most)


def python_step(df: DataFrame, function: Callable, schema: str, *, by: Iterable[str] = (), rows_apart: bool = False, most: int = 1_000_000) -> DataFrame:
    """A pandas function over a query's rows, whose columns must be the schema's; see PythonStep."""
    if rows_apart:

        def run(batches):
            for pdf in batches:
                yield function(pdf)

        return df.mapInPandas(run, schema)
    by = list(by)
    if by:
        return df.groupBy(*by).applyInPandas(function, schema)
    if df.limit(most + 1).count() > most:
        raise LoadRefused(f"the function would see more than {most} rows at once.", "one task would have to hold them.", "give by=, or rows_apart=True if its rows do not depend on each other")
    return df.groupBy().applyInPandas(function, schema)


def table_edges(queries: Mapping[str, Statement | Stack]) -> list[tuple[str, str]]:
    """(from, to) of tables: each query and what it reads, through derived tables."""
    out = []
    for name, q in queries.items():
        out += [(e.source.rpartition(".")[0], e.target.rpartition(".")[0]) for e in edges(name, q)]
    return sorted(set(out))


def build_run(build: Callable[..., Mapping[str, tuple[set[str], Callable[[], object]]]], parameters: Mapping[str, type] | None = None) -> Callable[..., list[str]]:
    """A run with typed parameters: run(start_from=, leave_out=, dry_run=, **values). Values are converted to their types;
    a missing, unknown or unreadable one is refused before anything runs."""
    parameters = dict(parameters or {})

    def typed(name: str, value: object) -> object:
        kind = parameters[name]
        if isinstance(value, kind):
            return value
        try:
            return datetime.date.fromisoformat(str(value)) if kind is datetime.date else kind(value)
        except (TypeError, ValueError) as e:
            raise GuardRefused(f"{name} is {value!r}, which is no {kind.__name__}.") from e

    def run(*, start_from: str | None = None, leave_out: Iterable[str] = (), dry_run: bool = False, **values) -> list[str]:
        if values.keys() != parameters.keys():
            raise GuardRefused(f"the run takes {sorted(parameters)}, not {sorted(values)}.")
        return run_tables(build(**{n: typed(n, v) for n, v in values.items()}), set(leave_out), start_from, dry_run)

    return run


def run_workflow(steps: Mapping[str, Callable[[], object]], done: Iterable[str] = (), on_done: Callable[[str], None] | None = None, dry_run: bool = False) -> list[str]:
    """Runs named steps in the order given, but those done; on_done records each, so that a run that failed goes on from
    its failing step. Returns what was, or would be, run."""
    left = [n for n in steps if n not in set(done)]
    for n in [] if dry_run else left:
        steps[n]()
        if on_done:
            on_done(n)
    return left
