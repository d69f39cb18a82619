"""Clauses and statements: assembled, checked, given a key, and lowered to a DataFrame.

Everything is checked before anything is lowered; lowering writes plain DataFrame operations, so that pushdown, pruning,
join order and exchange are Catalyst's. A partitioned table that nothing bounds is refused, not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import GuardRefused, LoadRefused, RepeatedRowsWarning
from plumbline.functions.expressions import Condition, Expr, Named, Ordering, all_of, lower, quoted, ref
from plumbline.sources.tables import Table

ORDER = ("INSERT", "SELECT", "FROM", "JOIN", "WHERE", "GROUP_BY", "HAVING", "ORDER_BY", "LIMIT")
Catalog = Mapping[str, DataFrame] | SparkSession | Callable[[str], DataFrame]


@dataclass(frozen=True)
class Clause:
    kind: str
    parts: tuple = ()
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Join:
    how: str
    table: Any
    on: Condition | None
    many_matches: bool = False
    keeps_only_matches: bool = False
    reads_all_partitions: bool = False
    broadcast: bool = False


@dataclass(frozen=True, eq=False)
class Subtotals:
    """Grouping sets, as the expressions each keeps."""

    sets: tuple[tuple[Expr, ...], ...]


class Derived:
    """A named statement: its outputs are columns, its key and additivity are known."""

    def __init__(self, name: str, query: Any, columns: Mapping[str, Expr | None], key: tuple[str, ...] | None):
        self.name = self.alias = name
        self.query, self.columns, self.key, self.partitioned_by = query, dict(columns), key, ()

    def __getitem__(self, column: str) -> Expr:
        if column not in self.columns:
            raise AttributeError(f"{self.name} has no column {column}")
        e = self.columns[column]
        return ref(self.alias, column, e.kind if e is not None else None, e.why_not_additive if e is not None else None)

    def __getattr__(self, column: str) -> Expr:
        if column.startswith("__") or "columns" not in self.__dict__:
            raise AttributeError(column)
        return self[column]

    def aliased(self, alias: str) -> Derived:
        out = Derived(self.name, self.query, self.columns, self.key)
        out.alias = alias
        return out


def AS(what: Any, name: str) -> Any:
    """A named output, or a table under another name."""
    if isinstance(what, Expr):
        return Named(what, name)
    if isinstance(what, Condition):
        return Named(what.expr, name)
    return what.aliased(name)


def _outputs(parts: Iterable) -> tuple[Named, ...]:
    out = []
    for p in parts:
        if isinstance(p, list | tuple):
            out += _outputs(p)
        elif isinstance(p, Named):
            out.append(p)
        elif isinstance(p, Expr) and p.op == "ref":
            out.append(Named(p, p.args[1]))
        else:
            raise GuardRefused("a calculation in SELECT has no name.", fix="name it with AS(calculation, 'name')")
    names = [n.name.lower() for n in out]
    if twice := {n for n in names if names.count(n) > 1}:
        raise GuardRefused(f"SELECT gives {sorted(twice)} twice.", fix="name one of them with AS()")
    return tuple(out)


def SELECT(*columns) -> Clause:
    return Clause("SELECT", _outputs(columns))


def SELECT_DISTINCT(*columns) -> Clause:
    return Clause("SELECT", _outputs(columns), {"distinct": True})


def FROM(table, reads_all_partitions: bool = False) -> Clause:
    return Clause("FROM", (table,), {"all": reads_all_partitions})


def _join(how: str, table: Any, on: Any, **options) -> Clause:
    if on is None and how != "cross":
        raise GuardRefused(f"a {how} join has no ON.", "every row would meet every row.", "give ON=, or use CROSS_JOIN")
    return Clause("JOIN", (Join(how, table, on, **options),))


def JOIN(table, ON=None, many_matches=False, reads_all_partitions=False, broadcast=False) -> Clause:
    return _join("inner", table, ON, many_matches=many_matches, reads_all_partitions=reads_all_partitions, broadcast=broadcast)


def LEFT_JOIN(table, ON=None, keeps_only_matches=False, many_matches=False, reads_all_partitions=False, broadcast=False) -> Clause:
    return _join("left", table, ON, keeps_only_matches=keeps_only_matches, many_matches=many_matches, reads_all_partitions=reads_all_partitions, broadcast=broadcast)


def FULL_JOIN(table, ON=None, keeps_only_matches=False, many_matches=False, reads_all_partitions=False) -> Clause:
    return _join("full", table, ON, keeps_only_matches=keeps_only_matches, many_matches=many_matches, reads_all_partitions=reads_all_partitions)


def CROSS_JOIN(table, reads_all_partitions=False) -> Clause:
    return _join("cross", table, None, reads_all_partitions=reads_all_partitions)


def SEMI_JOIN(table, ON=None, reads_all_partitions=False, broadcast=False) -> Clause:
    return _join("semi", table, ON, reads_all_partitions=reads_all_partitions, broadcast=broadcast)


def ANTI_JOIN(table, ON=None, reads_all_partitions=False, broadcast=False) -> Clause:
    if ON is not None and not any(t.alias == table.alias for pair in ON.equalities for t in [table] if any(a == t.alias for e in pair for a, _ in e.refs())):
        raise GuardRefused("ANTI_JOIN needs an equals() on a column of the joined table.")
    return _join("anti", table, ON, reads_all_partitions=reads_all_partitions, broadcast=broadcast)


def RIGHT_JOIN(table, ON=None, **_) -> Clause:
    raise GuardRefused("RIGHT_JOIN is not written.", "it reads from the end.", "swap the two tables and use LEFT_JOIN")


def WHERE(*conditions) -> Clause:
    c = all_of(*conditions)
    if c.expr.aggregates or c.expr.over_rows():
        raise GuardRefused("WHERE tests single rows; aggregates and windows come later.", fix="use HAVING, or a derived table")
    return Clause("WHERE", (c,))


def GROUP_BY(*columns) -> Clause:
    return Clause("GROUP_BY", columns)


def HAVING(*conditions) -> Clause:
    c = all_of(*conditions)
    if c.expr.over_rows():
        raise GuardRefused("HAVING cannot test a window.", fix="use a derived table")
    return Clause("HAVING", (c,))


def ORDER_BY(*columns, sorts_everything: bool = False) -> Clause:
    return Clause("ORDER_BY", tuple(c if isinstance(c, Ordering) else Ordering(c if isinstance(c, Expr) else Expr("name", (c,))) for c in columns), {"all": sorts_everything})


def LIMIT(n: int) -> Clause:
    if n < 1:
        raise GuardRefused("LIMIT needs one row at least.")
    return Clause("LIMIT", (n,))


def grouping_sets(*sets) -> Subtotals:
    listed = tuple(tuple(s) if isinstance(s, list | tuple) else (s,) for s in sets)
    if len({frozenset(e.key() for e in s) for s in listed}) < len(listed):
        raise GuardRefused("grouping_sets() has a set twice.", "its rows would come twice.")
    return Subtotals(listed)


def rollup(*columns) -> Subtotals:
    return Subtotals(tuple(tuple(columns[:n]) for n in range(len(columns), -1, -1)))


def cube(*columns) -> Subtotals:
    return Subtotals(tuple(c for n in range(len(columns), -1, -1) for c in combinations(columns, n)))


class Statement:
    """A checked query."""

    def __init__(self, clauses: tuple[Clause, ...], returns_all_rows: bool = False):
        places = [ORDER.index(c.kind) for c in clauses]
        if places != sorted(places):
            raise GuardRefused(f"the clauses come in the order {', '.join(ORDER)}.")
        kinds = [c.kind for c in clauses]
        if any(kinds.count(k) > 1 for k in set(kinds) - {"JOIN"}) or "SELECT" not in kinds or "FROM" not in kinds:
            raise GuardRefused("a statement has one SELECT and one FROM, and one of each other clause but JOIN.")
        one = {c.kind: c for c in clauses if c.kind != "JOIN"}
        self.outputs: tuple[Named, ...] = one["SELECT"].parts
        self.distinct = one["SELECT"].options.get("distinct", False)
        self.base, self.base_all = one["FROM"].parts[0], one["FROM"].options["all"]
        self.joins = [c.parts[0] for c in clauses if c.kind == "JOIN"]
        self.where: Condition | None = one["WHERE"].parts[0] if "WHERE" in one else None
        self.having: Condition | None = one["HAVING"].parts[0] if "HAVING" in one else None
        self.order: tuple[Ordering, ...] = one["ORDER_BY"].parts if "ORDER_BY" in one else ()
        self.limit: int | None = one["LIMIT"].parts[0] if "LIMIT" in one else None
        self.returns_all_rows = returns_all_rows
        self.group, self.subtotals = self._groups(one["GROUP_BY"].parts if "GROUP_BY" in one else ())
        self._check(one)
        self.key = self._key()

    # What it consists of

    def _groups(self, parts: tuple) -> tuple[tuple[Expr, ...], Subtotals | None]:
        named = {n.name: n.expr for n in self.outputs}
        group, sets = [], None
        for p in parts:
            if isinstance(p, Subtotals):
                if sets:
                    raise GuardRefused("GROUP_BY has two subtotals; one is allowed.")
                sets = p
            elif isinstance(p, str):
                if p not in named:
                    raise GuardRefused(f"GROUP_BY names {p}, which SELECT does not give.")
                group.append(named[p])
            else:
                group.append(p)
        if any(g.aggregates or g.over_rows() for g in group):
            raise GuardRefused("GROUP_BY takes no aggregates or windows.")
        return tuple(group), sets

    @property
    def grouped(self) -> bool:
        return bool(self.group or self.subtotals or self.having is not None or any(n.expr.aggregates for n in self.outputs))

    @property
    def sources(self) -> list:
        return [self.base, *(j.table for j in self.joins)]

    def group_expressions(self) -> list[Expr]:
        every = [*self.group, *(e for s in (self.subtotals.sets if self.subtotals else ()) for e in s)]
        return list({e.key(): e for e in every}.values())

    # Checks

    def _check(self, one: dict[str, Clause]) -> None:
        aliases = [t.alias for t in self.sources]
        if len(set(aliases)) < len(aliases):
            raise GuardRefused("a table is read twice under one name.", fix="name the second read with AS(table, 'other')")
        for j in self.joins:
            for a, b in j.on.equalities if j.on is not None else ():
                if a.op == b.op == "ref" and a.args == b.args:
                    raise GuardRefused(f"ON compares {'.'.join(a.args)} with itself.", fix="read the table twice, the second time under another name")
            if j.on is not None and j.on.expr.has("agg", "over"):
                raise GuardRefused("ON takes no aggregates or windows.")
        hidden = {j.table.alias for j in self.joins if j.how in ("semi", "anti")}
        seen = set(aliases)
        shown = [*(n.expr for n in self.outputs), *self.group_expressions(), *([self.where.expr] if self.where is not None else []), *([self.having.expr] if self.having is not None else [])]
        for e in shown:
            for alias, column in e.refs():
                if alias not in seen:
                    raise GuardRefused(f"{alias}.{column} is of a table that the statement does not read.")
                if alias in hidden:
                    raise GuardRefused(f"{alias}.{column} is of a table in a SEMI_JOIN or ANTI_JOIN, which is tested only.")
        if self.order and not self.limit and not one["ORDER_BY"].options["all"]:
            raise GuardRefused("ORDER_BY without LIMIT sorts everything.", "a table has no order, and a full sort is slow.", "add LIMIT", "sorts_everything=True")
        if self.grouped:
            groups = {g.key() for g in self.group_expressions()}
            for e in [*(n.expr for n in self.outputs), *([self.having.expr] if self.having is not None else [])]:
                if loose := self._ungrouped(e, groups):
                    raise GuardRefused(f"{'.'.join(loose)} is neither grouped nor aggregated.", fix="add it to GROUP_BY or aggregate it")
        if any(e.has("is_total") for e in shown) and not self.subtotals:
            raise GuardRefused("is_total() needs subtotals in GROUP_BY.")
        self._check_outer()
        self._check_partitions()

    def _ungrouped(self, e: Expr, groups: set) -> tuple[str, str] | None:
        if e.key() in groups or e.op in ("agg", "is_total"):
            return None
        if e.op == "ref":
            return e.args
        if e.op == "over":
            inner, spec = e.args
            parts = [a for a in inner.args if isinstance(a, Expr)] + [*spec.partition, *(o.expr for o in spec.order)]
            return next((x for p in parts if (x := self._ungrouped(p, groups))), None)
        return next((x for a in e.args if isinstance(a, Expr) and (x := self._ungrouped(a, groups))), None)

    def _check_outer(self) -> None:
        if self.where is None:
            return
        lost: dict[str, Join] = {}
        for k, j in enumerate(self.joins):
            if j.how in ("left", "full") and not j.keeps_only_matches:
                lost[j.table.alias] = j
            if j.how == "full" and not j.keeps_only_matches:
                lost.update({t.alias: j for t in self.sources[: k + 1]})
        tested = {a for a, _ in self.where.expr.refs()}
        for alias in sorted(tested & set(lost)):
            if alias not in self.where.keeps:
                raise GuardRefused(f"WHERE tests {alias}, whose unmatched rows the {lost[alias].how} join keeps as NULL.", "the test drops those rows again.", "move the test into ON", "keeps_only_matches=True")

    def _check_partitions(self) -> None:
        inner = [self.where, *(j.on for j in self.joins if j.how == "inner")]
        for table, free, conditions in [(self.base, self.base_all, inner), *((j.table, j.reads_all_partitions, inner if j.how in ("inner", "cross") else [j.on] if j.how in ("left", "semi", "anti") else []) for j in self.joins)]:
            if not table.partitioned_by or free:
                continue
            every = [c for c in inner + conditions if c is not None]
            bound = reduce(frozenset.__or__, (c.bounds for c in [c for c in conditions if c is not None]), frozenset())
            known = reduce(frozenset.__or__, (c.bounds for c in every), frozenset())
            # A column that equals a bounded one is bounded.
            for c in conditions:
                for a, b in c.equalities if c is not None else ():
                    if a.op == b.op == "ref":
                        bound |= {x.args for x, y in ((a, b), (b, a)) if y.args in known}
            if not any((table.alias, p) in bound for p in table.partitioned_by):
                raise LoadRefused(f"nothing bounds the partitions of {table.name}.", "the whole table would be read.", f"test {table.partitioned_by[0]}", "reads_all_partitions=True")

    # The key

    def _key(self) -> tuple[str, ...] | None:
        """Output names that tell the rows apart; () for one row, None if unknown."""
        names = {n.expr.key(): n.name for n in reversed(self.outputs)}
        same: dict[tuple, set] = {}
        fixed: set = set()
        for c in [self.where, *(j.on for j in self.joins if j.how == "inner")]:
            for a, b in c.equalities if c is not None else ():
                if a.op == b.op == "ref":
                    same.setdefault(a.key(), set()).add(b.key())
                    same.setdefault(b.key(), set()).add(a.key())
                elif a.op == "ref" and not b.refs():
                    fixed.add(a.key())
                elif b.op == "ref" and not a.refs():
                    fixed.add(b.key())
        fixed |= {x for f in list(fixed) for x in same.get(f, ())}

        def shown(keys: Iterable[tuple]) -> tuple[str, ...] | None:
            out: list[str] = []
            used: set = set()
            for k in keys:
                if k in fixed or same.get(k, set()) & used:
                    continue
                name = names.get(k) or next((names[s] for s in same.get(k, ()) if s in names), None)
                if name is None:
                    return None
                used.add(k)
                out.append(name)
            return tuple(out)

        rows = self._source_key(fixed)
        if self.subtotals:
            return None
        if self.grouped:
            if not self.group:
                return ()
            group = [g.key() for g in self.group]
            for t in self.sources:  # what a table's key in the group determines
                own = [ref(t.alias, c).key() for c in t.key or ()]
                if own and all(o in group for o in own):
                    group = [g for g in group if g in own or not (g[0] == "ref" and g[1][0] == t.alias)]
            return shown(group)
        found = shown(rows) if rows is not None else None
        if found is None:
            for n in self.outputs:
                if n.expr.op == "over" and n.expr.args[0].op == "place" and n.expr.args[0].args[0] == "row_number":
                    parts = shown(p.key() for p in n.expr.args[1].partition)
                    if parts is not None:
                        return (*parts, n.name)
        if self.distinct and found is None:
            return tuple(n.name for n in self.outputs)
        return found

    def _source_key(self, fixed: set) -> list[tuple] | None:
        own = lambda t: None if t.key is None else [ref(t.alias, c).key() for c in t.key]
        key = own(self.base)
        for j in self.joins:
            if j.how in ("semi", "anti"):
                continue
            right = own(j.table)
            pinned = {e.key() for pair in (j.on.equalities if j.on is not None else ()) for e, o in (pair, pair[::-1]) if j.table.alias not in {a for a, _ in o.refs()}}
            covered = right is not None and all(k in pinned or k in fixed for k in right)
            if not covered and j.how != "cross" and not j.many_matches:
                warnings.warn(f"ON does not pin the whole key of {j.table.name}: a row may meet several of its rows, and sums count it as often. many_matches=True says that this is meant.", RepeatedRowsWarning, stacklevel=5)
            if j.how == "full":
                key = None
            elif not covered:
                key = None if key is None or right is None else key + right
        return key

    # Lowering

    def lower(self, catalog: Catalog) -> DataFrame:
        df = read(self.base, catalog)
        for j in self.joins:
            right = read(j.table, catalog)
            right = F.broadcast(right) if j.broadcast else right
            how = {"full": "full_outer", "semi": "left_semi", "anti": "left_anti"}.get(j.how, j.how)
            df = df.crossJoin(right) if how == "cross" else df.join(right, lower(j.on.expr), how)
        if self.where is not None:
            df = df.where(lower(self.where.expr))
        swap: dict = {}
        if self.grouped:
            df, swap = self._aggregate(df)
            if self.having is not None:
                df = df.where(lower(self.having.expr, swap))
        outs = [lower(n.expr, swap).alias(n.name) for n in self.outputs]
        if self.distinct:
            df = df.select(*outs).distinct()
            swap, outs = {n.expr.key(): F.col(quoted(n.name)) for n in self.outputs}, None
        names = {n.name for n in self.outputs}
        if self.order:
            by = []
            hidden = []
            for k, o in enumerate(self.order):
                if o.expr.op == "name":
                    if o.expr.args[0] not in names:
                        raise GuardRefused(f"ORDER_BY names {o.expr.args[0]}, which SELECT does not give.")
                    c = F.col(quoted(o.expr.args[0]))
                elif outs is None:
                    c = lower(o.expr, swap)
                else:
                    hidden.append(lower(o.expr, swap).alias(f"__order_{k}"))
                    c = F.col(f"__order_{k}")
                by.append(c.desc() if o.down else c.asc())
            df = (df if outs is None else df.select(*outs, *hidden)).orderBy(*by)
            if self.limit:
                df = df.limit(self.limit)
            return df.select(*(F.col(quoted(n.name)) for n in self.outputs))
        df = df if outs is None else df.select(*outs)
        return df.limit(self.limit) if self.limit else df

    def _aggregate(self, df: DataFrame) -> tuple[DataFrame, dict]:
        groups = self.group_expressions()
        tops = [*(n.expr for n in self.outputs), *([self.having.expr] if self.having is not None else []), *(o.expr for o in self.order)]
        swap: dict = {}
        named = [(g.key(), f"__g{i}", lower(g)) for i, g in enumerate(groups)]
        group_keys = {k for k, _, _ in named}
        aggs: dict = {}

        def collect(e: Expr) -> None:
            if e.key() in group_keys:
                return
            if e.op in ("agg", "is_total"):
                aggs.setdefault(e.key(), e)
                return
            if e.op == "over":
                inner, spec = e.args
                for x in [a for a in inner.args if isinstance(a, Expr)] + [*spec.partition, *(o.expr for o in spec.order)]:
                    collect(x)
                return
            for a in e.args:
                if isinstance(a, Expr):
                    collect(a)

        for e in tops:
            collect(e)
        if self.subtotals:
            df = df.select("*", *(c.alias(n) for _, n, c in named))
            at = {k: n for k, n, _ in named}
            columns = [at[k] for k, _, _ in named]
            sets = [[F.col(at[e.key()]) for e in (*self.group, *s)] for s in self.subtotals.sets]
            made = df.groupingSets(sets, *map(F.col, columns))
        else:
            made = df.groupBy(*(c.alias(n) for _, n, c in named))
        outs = []
        for i, (k, e) in enumerate(aggs.items()):
            if e.op == "is_total":
                total = e.args[0].key()
                if total not in group_keys:
                    raise GuardRefused("is_total() takes a column of the subtotals.")
                outs.append((F.grouping(F.col(next(n for g, n, _ in named if g == total))) == 1).alias(f"__a{i}"))
            else:
                outs.append(lower(e).alias(f"__a{i}"))
            swap[k] = F.col(f"__a{i}")
        swap |= {k: F.col(n) for k, n, _ in named}
        return (made.agg(*outs) if outs else made.agg(F.count(F.lit(1)).alias("__n"))), swap


def statement(*clauses: Clause, returns_all_rows: bool = False) -> Statement:
    return Statement(clauses, returns_all_rows)


class Stack:
    """A set operation over statements, by column names."""

    def __init__(self, how: str, parts: tuple):
        if len(parts) < 2:
            raise GuardRefused(f"{how} needs two statements at least.")
        names = [n.name for n in parts[0].outputs]
        for p in parts:
            if isinstance(p, Statement) and (p.order or p.limit):
                raise GuardRefused(f"a branch of {how} has ORDER_BY or LIMIT.", fix="put it into a derived table")
            if sorted(n.name for n in p.outputs) != sorted(names):
                raise GuardRefused(f"the branches of {how} give different columns: {names} and {[n.name for n in p.outputs]}.")
            for n in p.outputs:
                first = next(x for x in parts[0].outputs if x.name == n.name)
                if first.expr.kind and n.expr.kind and first.expr.kind != n.expr.kind:
                    raise GuardRefused(f"{n.name} is a {first.expr.kind} in one branch of {how} and a {n.expr.kind} in another.")
        self.how, self.parts, self.outputs = how, parts, parts[0].outputs
        self.key = None if how == "UNION ALL" else parts[0].key if how in ("INTERSECT", "EXCEPT") and parts[0].key is not None else tuple(names)

    def lower(self, catalog: Catalog) -> DataFrame:
        names = [quoted(n.name) for n in self.outputs]
        parts = [p.lower(catalog).select(*names) for p in self.parts]
        match self.how:
            case "UNION ALL":
                return reduce(DataFrame.unionByName, parts)
            case "UNION":
                return reduce(DataFrame.unionByName, parts).distinct()
            case "INTERSECT":
                return reduce(DataFrame.intersect, parts)
        return reduce(DataFrame.subtract, parts)


def UNION_ALL(*statements, returns_all_rows=False) -> Stack:
    return Stack("UNION ALL", statements)


def UNION(*statements, returns_all_rows=False) -> Stack:
    return Stack("UNION", statements)


def INTERSECT(*statements, returns_all_rows=False) -> Stack:
    return Stack("INTERSECT", statements)


def EXCEPT(*statements, returns_all_rows=False) -> Stack:
    return Stack("EXCEPT", statements)


def derived(name: str, query: Statement | Stack) -> Derived:
    """A statement as a table."""
    if isinstance(query, Statement) and query.order and not query.limit:
        raise GuardRefused(f"{name} is sorted without LIMIT; a table has no order.")
    return Derived(name, query, {n.name: n.expr for n in query.outputs}, query.key)


class RawQuery:
    """SQL text as a query; only its declared columns are known."""

    def __init__(self, text: str, columns: Mapping[str, str | None], key: Iterable[str] | None):
        from plumbline.functions.expressions import family

        self.text, self.key = text, None if key is None else tuple(key)
        self.outputs = tuple(Named(Expr("raw", (c,), family(t)), c) for c, t in columns.items())

    def lower(self, catalog: Catalog) -> DataFrame:
        spark = SparkSession.active()
        df = spark.sql(self.text)
        if sorted(df.columns) != sorted(n.name for n in self.outputs):
            raise GuardRefused(f"the SQL gives {df.columns}, not {[n.name for n in self.outputs]}.")
        return df


def unchecked_derived(name: str, text: str, columns: Mapping[str, str | None], key: Iterable[str] | None = None) -> Derived:
    q = RawQuery(text, columns, key)
    return Derived(name, q, {n.name: n.expr for n in q.outputs}, q.key)


def read(table: Table | Derived, catalog: Catalog) -> DataFrame:
    """The table's rows, under its alias."""
    if isinstance(table, Derived):
        return table.query.lower(catalog).alias(table.alias)
    if isinstance(catalog, SparkSession):
        df = catalog.table(table.name)
    elif callable(catalog):
        df = catalog(table.name)
    else:
        df = catalog[table.name]
    return df.alias(table.alias)


def first_look(table: Table, rows: int = 20) -> Statement:
    return statement(SELECT([table[c] for c in table.columns]), FROM(table, reads_all_partitions=True), LIMIT(rows))


def run_query(query: Statement | Stack, catalog: Catalog, rows: int | None = None) -> DataFrame:
    """The lowered query. rows: an automatic LIMIT, which refuses a result that fills it; the rows are kept, so that the
    query runs once."""
    df = query.lower(catalog)
    if rows is None or getattr(query, "limit", None) or getattr(query, "returns_all_rows", False):
        return df
    from plumbline.operators.ordered import settled

    got = settled(df.limit(rows))
    if got.count() == rows:
        raise LoadRefused(f"the result has {rows} rows or more.", "it may have been cut.", "add LIMIT or narrow WHERE", "returns_all_rows=True")
    return got


def explain(query: Statement | Stack, catalog: Catalog) -> str:
    df = query.lower(catalog)
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
