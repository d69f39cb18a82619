"""Foreign SQL read into checked statements.

Spark's own parser reads the text; its unresolved plan is turned into clauses, so that every check of a statement applies
to queries that were written elsewhere. An expression that has no counterpart is kept as it is written, as an unchecked
column; a clause that has none is refused, with its name.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from plumbline.errors import GuardRefused
from plumbline.functions import expressions as E
from plumbline.functions.expressions import Condition, Expr, Named, Ordering
from plumbline.plans import statements as S
from plumbline.plans.statements import Derived, Stack, Statement
from plumbline.sources.tables import Table

_COMPARED = {"EqualTo": (E.equals, E.not_equals), "GreaterThan": (E.more_than, E.at_most), "GreaterThanOrEqual": (E.at_least, E.less_than), "LessThan": (E.less_than, E.at_least), "LessThanOrEqual": (E.at_most, E.more_than)}
_SIGNS = {"Add": "+", "Subtract": "-", "Multiply": "*", "Divide": "/"}
_TOTALS = {"sum": E.sum_of, "avg": E.average_of, "min": E.min_of, "max": E.max_of}
_STACKED = {"Union": S.UNION_ALL, "Intersect": S.INTERSECT, "Except": S.EXCEPT}


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Scope:
    """Tables of one SELECT, and its expressions."""

    def __init__(self, tables: dict):
        self.tables = tables

    def column(self, parts: list[str]) -> Expr:
        name = parts[-1].lower()
        named = [t for a, t in self.tables.items() if len(parts) == 1 or a.lower() == parts[-2].lower()]
        found = [(t, c) for t in named for c in t.columns if c.lower() == name]
        if len(found) != 1:
            raise GuardRefused(f"{'.'.join(parts)} is in {len(found)} of the tables that are read.")
        return found[0][0][found[0][1]]

    def raw(self, e) -> Expr:
        """An expression as it is written, with its columns."""
        text, columns = e.sql(), {}

        def walk(x) -> None:
            if _kind(x) == "UnresolvedAttribute":
                name = f"c{len(columns)}"
                columns[name] = (x.sql(), self.column(_all(x.nameParts())))
                return
            for y in _all(x.children()):
                walk(y)

        walk(e)
        if re.search(r"\b(?:exists|scalarsubquery|listquery)\b", text, re.I):
            raise GuardRefused("a subquery in an expression is not read.", fix="write it as a join")
        for name, (shown, _) in sorted(columns.items(), key=lambda x: -len(x[1][0])):
            text = re.sub(rf"(?<![\w.`]){re.escape(shown)}(?![\w`])", "{" + name + "}", text)
        return E.unchecked_column(text, **{n: c for n, (_, c) in columns.items() if "{" + n + "}" in text})

    def literal(self, e) -> Expr | None:
        """None for a NULL or a type that a statement has no constants of."""
        value, kind = e.value(), e.dataType().simpleString()
        if value is None:
            return None
        if kind == "string":
            return E.literal(value.toString())
        if kind in ("tinyint", "smallint", "int", "bigint"):
            return E.literal(int(value))
        if kind == "boolean":
            return E.literal(bool(value))
        if kind == "date":
            return E.literal(datetime.date(1970, 1, 1) + datetime.timedelta(days=int(value)))
        if kind in ("double", "float") or kind.startswith("decimal"):
            return E.literal(float(value if isinstance(value, float) else value.toString()))
        return None

    def value(self, e) -> Expr:
        kind = _kind(e)
        kids = _all(e.children())
        if kind == "UnresolvedAttribute":
            return self.column(_all(e.nameParts()))
        if kind == "Literal":
            found = self.literal(e)
            return self.raw(e) if found is None else found
        if kind in ("Alias", "UnresolvedAlias"):
            return self.value(kids[0])
        if kind in _SIGNS:
            return E.arithmetic(_SIGNS[kind], self.value(kids[0]), self.value(kids[1]))
        if kind == "UnaryMinus":
            return -self.value(kids[0])
        if kind == "CaseWhen":
            cases = [(self.condition(b.productElement(0)), self.value(b.productElement(1))) for b in _all(e.branches())]
            rest = e.elseValue()
            if rest.isDefined() and not (_kind(rest.get()) == "Literal" and rest.get().value() is None):
                return E.first_match(cases, self.value(rest.get()))
            return E.first_match(cases)
        if kind == "WindowExpression":
            return self.window(e)
        if kind == "UnresolvedFunction":
            return self.function(e)
        if kind in _COMPARED or kind in ("And", "Or", "Not", "In", "IsNull", "IsNotNull"):
            return self.condition(e).expr
        return self.raw(e)

    def function(self, e, over=None) -> Expr:
        name = e.nameParts().mkString(".").lower()
        args = _all(e.arguments())
        where = self.condition(e.filter().get()) if e.filter().isDefined() else None
        if name == "count":
            if e.isDistinct():
                if len(args) != 1 or over is not None:
                    return self.raw(e)
                return E.count_distinct(self.value(args[0]), where=where)
            if _kind(args[0]) not in ("UnresolvedStar", "Literal"):
                seen = E.is_not_null(self.value(args[0]))
                where = seen if where is None else E.all_of(where, seen)
            return E.count_rows(where=where, over=over)
        if name in _TOTALS and not e.isDistinct():
            return _TOTALS[name](self.value(args[0]), where=where, over=over)
        if name == "if":
            return E.if_else(self.condition(args[0]), self.value(args[1]), self.value(args[2]))
        if e.isDistinct() or where is not None or over is not None or any(_kind(a) == "UnresolvedStar" for a in args):
            raise GuardRefused(f"{name}() with DISTINCT, FILTER or OVER is not read.")
        if name in ("like", "between"):
            return self.condition(e).expr
        if any(_kind(a) == "Literal" and a.value() is None for a in args):
            return self.raw(e)
        return E.sql_function(name, *map(self.value, args))

    def grouping(self, e) -> Expr | None:
        """The column of grouping(column)."""
        return self.value(e.arguments().apply(0)) if _kind(e) == "UnresolvedFunction" and e.nameParts().mkString(".").lower() == "grouping" else None

    def window(self, e) -> Expr:
        f, spec = e.windowFunction(), e.windowSpec()
        if _kind(spec) != "WindowSpecDefinition":
            raise GuardRefused("a named window is not read.")
        partition = [self.value(x) for x in _all(spec.partitionSpec())]
        order = [self.ordering(o) for o in _all(spec.orderSpec())]
        frame, rows = spec.frameSpecification(), None
        by_range = _kind(frame) == "SpecifiedWindowFrame" and _kind(frame.frameType()) == "RangeFrame"
        if _kind(frame) == "SpecifiedWindowFrame" and not by_range:
            rows = (self.bound(frame.lower()), self.bound(frame.upper()))
        over = E.WindowSpec(tuple(partition), tuple(order), rows, by_range or (bool(order) and _kind(frame) == "UnspecifiedFrame"))
        plain = E.WindowSpec(over.partition, over.order, rows)
        name, args = f.nameParts().mkString(".").lower(), _all(f.arguments())
        places: dict[str, Callable] = {"row_number": E.row_number, "rank": E.rank, "dense_rank": E.dense_rank}
        if name in places:
            return places[name](over=plain)
        if name == "ntile":
            return E.ntile(int(args[0].value()), over=plain)
        if name in ("lag", "lead") and len(args) <= 2:
            n = int(args[1].value()) if len(args) > 1 else 1
            return E.lag(self.value(args[0]), over=plain, back=n) if name == "lag" else E.lead(self.value(args[0]), over=plain, ahead=n)
        if name in ("first_value", "last_value", "first", "last"):
            edge = E.WindowSpec(over.partition, over.order, rows if rows is not None else (None, 0) if name.startswith("first") else None)
            if name.startswith("last") and rows is None:
                raise GuardRefused("last_value() without rows gives the current row's value.", fix="say ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
            return (E.first_value if name.startswith("first") else E.last_value)(self.value(args[0]), over=edge)
        return self.function(f, over if over.order else plain)

    @staticmethod
    def bound(x) -> int | None:
        kind = _kind(x)
        if kind.startswith("Unbounded"):
            return None
        if kind.startswith("CurrentRow"):
            return 0
        return -int(x.child().value()) if kind == "UnaryMinus" else int(x.value())

    def ordering(self, o) -> Ordering:
        return Ordering(self.value(o.child()), o.direction().sql() == "DESC")

    def condition(self, e, negated: bool = False) -> Condition:
        """Tests, with NOT carried inwards."""
        kind = _kind(e)
        kids = _all(e.children())
        if kind == "Not":
            return self.condition(kids[0], not negated)
        if kind in ("And", "Or"):
            both = [self.condition(k, negated) for k in kids]
            return (E.all_of if (kind == "And") != negated else E.any_of)(*both)
        if kind in _COMPARED:
            if kind == "EqualTo" and not negated and (of := self.grouping(kids[0])) is not None and _kind(kids[1]) == "Literal" and kids[1].value() == 1:
                return E.is_total(of)
            left, right = map(self.value, kids)
            if left.op == "lit" and right.op != "lit":  # a constant stands on the right
                turned = {"GreaterThan": "LessThan", "LessThan": "GreaterThan", "GreaterThanOrEqual": "LessThanOrEqual", "LessThanOrEqual": "GreaterThanOrEqual"}
                kind, left, right = turned.get(kind, kind), right, left
            return _COMPARED[kind][negated](left, right)
        if kind in ("IsNull", "IsNotNull"):
            return (E.is_null if (kind == "IsNull") != negated else E.is_not_null)(self.value(kids[0]))
        if kind == "In" and all(_kind(x) == "Literal" and x.value() is not None for x in kids[1:]):
            values = [self.literal(x).args[0] for x in kids[1:]]
            return (E.is_not_in if negated else E.is_in)(self.value(kids[0]), values)
        name = e.nameParts().mkString(".").lower() if kind == "UnresolvedFunction" else ""
        if (kind == "Between" or name == "between") and not negated:
            x, low, high = map(self.value, kids[:3])
            return E.between(x, low, high) if low.op == high.op == "lit" else E.all_of(E.at_least(x, low), E.at_most(x, high))
        if (kind == "Like" or name == "like") and not negated and _kind(kids[1]) == "Literal":
            pattern = kids[1].value().toString()
            if m := re.fullmatch(r"(%?)([^%_\\]+)%", pattern):
                return (E.contains if m[1] else E.starts_with)(self.value(kids[0]), m[2])
        if kind == "UnresolvedAttribute":
            return E.equals(self.value(e), not negated)
        if kind == "Literal" and isinstance(e.value(), bool):
            return E.equals(E.literal(1), 1 if e.value() != negated else 0)
        raw = self.raw(e)
        text = f"NOT ({raw.args[0]})" if negated else raw.args[0]
        return E.unchecked_condition(text, **dict(zip(raw.args[1], raw.args[2:], strict=True)))


class _Converter:
    def __init__(self, tables: Mapping[str, Table], options: Mapping[str, bool]):
        self.tables = {n.lower(): t for n, t in tables.items()}
        self.options = dict(options)
        self.made = 0

    def query(self, plan, ctes: dict) -> Statement | Stack:
        kind = _kind(plan)
        if kind == "UnresolvedWith":
            ctes = dict(ctes)
            for pair in _all(plan.cteRelations()):
                ctes[pair.productElement(0).lower()] = self.query(pair.productElement(1).child(), ctes)
            return self.query(plan.child(), ctes)
        if kind in _STACKED or kind == "Distinct" and _kind(plan.child()) == "Union":
            how = S.UNION if kind == "Distinct" else _STACKED[kind]
            if kind in ("Intersect", "Except") and plan.isAll():
                raise GuardRefused(f"{kind.upper()} ALL is not read.")
            inner = plan.child() if kind == "Distinct" else plan
            parts = [self.query(c, ctes) for c in _all(inner.children())]
            return how(*[self.lined_up(p, parts[0]) for p in parts])
        return self.select(plan, ctes)

    def lined_up(self, part: Statement | Stack, first: Statement | Stack) -> Statement | Stack:
        """A branch with the first one's names, by position."""
        names, own = [n.name for n in first.outputs], [n.name for n in part.outputs]
        if names == own:
            return part
        if len(names) != len(own):
            raise GuardRefused(f"the branches give {len(names)} and {len(own)} columns.")
        self.made += 1
        d = S.derived(f"branch_{self.made}", part)
        return S.statement(S.SELECT(*[S.AS(d[o], n) for o, n in zip(own, names, strict=True)]), S.FROM(d))

    def select(self, plan, ctes: dict) -> Statement:
        limit = order = having = where = None
        distinct = False
        if _kind(plan) == "UnresolvedHint":  # how to join is the optimizer's
            return self.query(plan.child(), ctes)
        if _kind(plan) == "GlobalLimit":
            limit, plan = int(plan.limitExpr().value()), plan.child().child()
        if _kind(plan) == "Sort":
            order, plan = _all(plan.order()), plan.child()
        if _kind(plan) == "Distinct":
            distinct, plan = True, plan.child()
        if _kind(plan) == "UnresolvedHaving":
            having, plan = plan.havingCondition(), plan.child()
        kind = _kind(plan)
        if kind not in ("Project", "Aggregate"):
            if kind in ("SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "Union", "Intersect", "Except"):  # SELECT * of a whole query
                self.made += 1
                d = S.derived(f"query_{self.made}", self.query(plan, ctes)) if kind not in ("UnresolvedRelation",) else self.source(plan, ctes)[0]
                clauses = [S.SELECT([d[c] for c in d.columns]), S.FROM(d, self.options.get("reads_all_partitions", False))]
                return S.statement(*clauses, *self.last(order, limit, _Scope({d.alias: d}), {c for c in d.columns}))
            raise GuardRefused(f"{kind} is not read.")
        listed = _all(plan.projectList() if kind == "Project" else plan.aggregateExpressions())
        groups = _all(plan.groupingExpressions()) if kind == "Aggregate" else []
        below = plan.child()
        if _kind(below) == "Filter":
            where, below = below.condition(), below.child()
        base, joins, tables = self.source(below, ctes)
        scope = _Scope(tables)
        outputs: list = []
        for e in listed:
            outputs += self.output(e, scope, tables)
        names = {n.name.lower(): n.expr for n in outputs}
        clauses = [(S.SELECT_DISTINCT if distinct else S.SELECT)(*outputs), S.FROM(base, self.options.get("reads_all_partitions", False)), *[j(scope) for j in joins]]
        if where is not None:
            clauses.append(S.WHERE(scope.condition(where)))
        if groups:
            clauses.append(S.GROUP_BY(*[self.group(g, scope, outputs, names) for g in groups]))
        if having is not None:
            clauses.append(S.HAVING(self.named(scope, names).condition(having)))
        return S.statement(*clauses, *self.last(order, limit, scope, {n.name for n in outputs}, outputs))

    def last(self, order, limit, scope: _Scope, names: set, outputs=()) -> list:
        out = []
        if order:
            by = []
            for o in order:
                x, down = o.child(), o.direction().sql() == "DESC"
                if _kind(x) == "UnresolvedOrdinal" and outputs:
                    by.append(Ordering(Expr("name", (outputs[int(x.ordinal()) - 1].name,)), down))
                elif _kind(x) == "UnresolvedAttribute" and (found := [n for n in names if n.lower() == x.nameParts().mkString(".").lower()]):
                    by.append(Ordering(Expr("name", (found[0],)), down))
                else:
                    by.append(scope.ordering(o))
            out.append(S.ORDER_BY(*by, sorts_everything=limit is None and self.options.get("sorts_everything", False)))
        return out + ([S.LIMIT(limit)] if limit else [])

    @staticmethod
    def named(scope: _Scope, names: dict) -> _Scope:
        """HAVING may name outputs."""
        out = _Scope(scope.tables)
        column = out.column
        out.column = lambda parts: names[parts[0].lower()] if len(parts) == 1 and parts[0].lower() in names else column(parts)
        return out

    @staticmethod
    def output(e, scope: _Scope, tables: dict) -> list:
        kind = _kind(e)
        if kind == "UnresolvedStar":
            target = e.target()
            alias = _all(target.get())[-1].lower() if target.isDefined() else None
            return [Named(t[c], c) for a, t in tables.items() if alias is None or a.lower() == alias for c in t.columns]
        if kind == "Alias":
            return [Named(scope.value(e.child()), e.name())]
        inner = e.child() if kind == "UnresolvedAlias" else e
        value = scope.value(inner)
        return [Named(value, value.args[1] if value.op == "ref" else inner.sql())]

    @staticmethod
    def group(g, scope: _Scope, outputs: list, names: dict):
        kind = _kind(g)
        if kind in ("Rollup", "Cube", "GroupingSets"):
            return S.Subtotals(tuple(tuple(scope.value(x) for x in _all(s)) for s in _all(g.selectedGroupByExprs())))
        if kind == "UnresolvedOrdinal":
            return outputs[int(g.ordinal()) - 1].expr
        try:
            return scope.value(g)
        except GuardRefused:
            if kind == "UnresolvedAttribute" and (found := names.get(g.nameParts().mkString(".").lower())) is not None:
                return found
            raise

    def source(self, plan, ctes: dict, alias: str | None = None) -> tuple:
        """The first table, joins to be made once all tables are known, and the tables by alias."""
        kind = _kind(plan)
        if kind == "Join":
            base, joins, tables = self.source(plan.left(), ctes)
            right, more, others = self.source(plan.right(), ctes)
            if more:
                raise GuardRefused("brackets around joins are not read.")
            how = plan.joinType().sql()
            on = plan.condition().get() if plan.condition().isDefined() else None
            if _kind(plan.joinType()) in ("UsingJoin", "NaturalJoin"):
                raise GuardRefused("USING and NATURAL joins are not read.", fix="write ON")
            if how == "RIGHT OUTER":
                if joins:
                    raise GuardRefused("RIGHT JOIN after other joins is not read.", fix="swap the tables and use LEFT JOIN")
                base, right, how, tables, others = right, base, "LEFT OUTER", others, tables
            make = {"INNER": S.JOIN, "LEFT OUTER": S.LEFT_JOIN, "FULL OUTER": S.FULL_JOIN, "LEFT SEMI": S.SEMI_JOIN, "LEFT ANTI": S.ANTI_JOIN, "CROSS": S.CROSS_JOIN}.get(how)
            if make is None:
                raise GuardRefused(f"a {how} join is not read.")
            tables = tables | others
            options = {"reads_all_partitions": self.options.get("reads_all_partitions", False)}
            if make in (S.JOIN, S.LEFT_JOIN, S.FULL_JOIN) and on is not None:
                options["many_matches"] = self.options.get("many_matches", False)
            if on is None:
                return base, [*joins, lambda _: S.CROSS_JOIN(right, reads_all_partitions=options["reads_all_partitions"])], tables
            return base, [*joins, lambda scope: make(right, ON=_Scope(tables).condition(on), **options)], tables
        if kind == "SubqueryAlias":
            return self.source(plan.child(), ctes, plan.alias())
        if kind == "UnresolvedRelation":
            name = plan.multipartIdentifier().mkString(".")
            if name.lower() in ctes:
                t = S.derived(alias or name, ctes[name.lower()])
            else:
                t = self.tables.get(name.lower()) or self.tables.get(name.rsplit(".", 1)[-1].lower())
                if t is None:
                    raise GuardRefused(f"{name} has no reference.", fix="give its Table")
                t = t.aliased(alias) if alias and alias != t.alias else t
            return t, [], {t.alias: t}
        if kind == "__auto_generated_subquery_name":
            return self.source(plan.child(), ctes)
        self.made += 1
        t = S.derived(alias or f"subquery_{self.made}", self.query(plan, ctes))
        return t, [], {t.alias: t}


@dataclass(frozen=True)
class Insert:
    """INSERT ... SELECT: where to, which partition, and the checked query."""

    table: str
    overwrite: bool
    partition: dict[str, str | None]
    query: Statement | Stack


def convert_query(spark: SparkSession, text: str, tables: Mapping[str, Table], **options: bool) -> Statement | Stack | Insert:
    """A SELECT, a set operation or an INSERT ... SELECT as a checked statement. tables: references by name. options:
    many_matches, reads_all_partitions and sorts_everything, for all of the text."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    made = _Converter(tables, options)
    if _kind(plan) == "InsertIntoStatement":
        spec = plan.partitionSpec()
        partition = {p.productElement(0): p.productElement(1).get() if p.productElement(1).isDefined() else None for p in _all(spec.toSeq())}
        return Insert(plan.table().multipartIdentifier().mkString("."), plan.overwrite(), partition, made.query(plan.query(), {}))
    return made.query(plan, {})


def typed_selected_columns(spark: SparkSession, query: Statement | Stack, tables: Mapping[str, Table] = ()) -> dict[str, str]:
    """Types of a query's columns, from the references' types alone: it is lowered over empty tables."""
    known = dict(tables)

    def gather(q) -> None:
        for part in q.parts if isinstance(q, Stack) else [q]:
            for t in getattr(part, "sources", ()):
                if isinstance(t, Derived):
                    gather(t.query)
                else:
                    known.setdefault(t.name, t)

    gather(query)
    return dict(query.lower(lambda name: spark.createDataFrame([], known[name].schema())).dtypes)
