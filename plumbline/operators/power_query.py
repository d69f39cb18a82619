"""Power Query steps, read from M text and applied to DataFrames.

`let` steps are applied in order; each is a DataFrame, so Catalyst merges them. Equality is null-aware, as in M. Steps that
need an order rows do not have (FillDown, FillUp, an index without a sort) are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import GuardRefused
from plumbline.operators.ordered import numbered

_TOKEN = re.compile(r"""\s*(?://[^\n]*\s*|/\*.*?\*/\s*)*(?:(?P<num>\d+(?:\.\d+)?)|(?P<text>"(?:[^"]|"")*")|(?P<name>\#"(?:[^"]|"")*"|[A-Za-z_][\w.]*)|(?P<op>=>|<=|>=|<>|[-+*/&=<>(){}\[\],]))""", re.S)
_LOOSE = {"or": 1, "and": 2, "=": 3, "<>": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "+": 4, "-": 4, "&": 4, "*": 5, "/": 5}


class _Reader:
    """Trees: ("num"|"text"|"bool"|"null", x), ("name", n), ("field", of, n), ("call", f, args), ("list", [..]), ("record",
    {..}), ("each", x), ("op", s, a, b), ("not", x), ("neg", x), ("if", c, a, b), ("let", [(n, x)], x), ("type",)."""

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, word: str | None = None) -> str:
        found = self.peek()
        if word and found != word:
            raise ValueError(f"{word} is missing before {found!r}")
        self.at += 1
        return found

    @staticmethod
    def word(name: str) -> str:
        return name[2:-1].replace('""', '"') if name.startswith('#"') else name

    def expression(self, least: int = 1) -> tuple:
        match self.peek():
            case "let":
                self.take()
                steps = []
                while True:
                    name = self.word(self.take())
                    self.take("=")
                    steps.append((name, self.expression()))
                    if self.take() == "in":
                        return ("let", steps, self.expression())
            case "each":
                self.take()
                return ("each", self.expression())
            case "if":
                self.take()
                c = self.expression()
                self.take("then")
                a = self.expression()
                self.take("else")
                return ("if", c, a, self.expression())
            case "type":
                self.take()
                self.postfix()
                return ("type",)
        left = self.unary()
        while (p := _LOOSE.get(self.peek(), 0)) >= least:
            sign = self.take()
            left = ("op", sign, left, self.expression(p + 1))
        return left

    def unary(self) -> tuple:
        if self.peek() in ("not", "-"):
            return ("not" if self.take() == "not" else "neg", self.unary())
        return self.postfix()

    def postfix(self) -> tuple:
        x = self.primary()
        while True:
            if self.peek() == "(":
                self.take()
                x = ("call", x[1], self.listed(")"))
            elif self.peek() == "[":
                self.take()
                x = ("field", x, self.fields())
            elif self.peek() == "{":
                self.take()
                x = ("item", x, self.listed("}"))
            else:
                return x

    def fields(self) -> str:
        words = []
        while self.peek() != "]":
            words.append(self.word(self.take()))
        self.take("]")
        return " ".join(words)

    def listed(self, end: str) -> list[tuple]:
        out = []
        while self.peek() != end:
            out.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take(end)
        return out

    def primary(self) -> tuple:
        kind, word = self.tokens[self.at]
        self.at += 1
        match kind:
            case "num":
                return ("num", float(word) if "." in word else int(word))
            case "text":
                return ("text", word[1:-1].replace('""', '"'))
            case "name":
                return ("bool", word == "true") if word in ("true", "false") else ("null", None) if word == "null" else ("name", self.word(word))
        if word == "(":
            x = self.expression()
            self.take(")")
            return x
        if word == "{":
            return ("list", self.listed("}"))
        if word == "[":
            if self.tokens[self.at + 1][1] != "=":
                return ("field", None, self.fields())
            out = {}
            while self.peek() != "]":
                name = self.word(self.take())
                self.take("=")
                out[name] = self.expression()
                if self.peek() == ",":
                    self.take()
            self.take("]")
            return ("record", out)
        raise ValueError(f"a value is missing before {word!r}")


def parse(text: str) -> tuple:
    r = _Reader(text)
    tree = r.expression()
    if r.at < len(r.tokens):
        raise ValueError(f"{r.peek()!r} is left over")
    return tree


_AGGREGATE = {"List.Sum": F.sum, "List.Max": F.max, "List.Min": F.min, "List.Average": F.avg, "List.StandardDeviation": F.stddev_samp}
_JOIN = {"JoinKind.LeftOuter": "left", "JoinKind.Inner": "inner", "JoinKind.RightOuter": "right", "JoinKind.FullOuter": "full_outer", "JoinKind.LeftAnti": "left_anti", "JoinKind.RightAnti": "right_anti"}
_ONE: dict[str, Callable[..., Column]] = {
    "Text.Upper": F.upper, "Text.Lower": F.lower, "Text.Trim": F.trim, "Text.Length": F.length, "Text.Proper": F.initcap, "Text.Start": F.left, "Text.End": F.right, "Text.Middle": lambda x, s, n: F.substr(x, s + 1, n),
    "Text.Replace": F.replace, "Text.Contains": F.contains, "Text.StartsWith": F.startswith, "Text.EndsWith": F.endswith, "Text.From": lambda x: x.cast("string"), "Number.From": lambda x: x.try_cast("double"),
    "Number.RoundDown": F.floor, "Number.RoundUp": F.ceil, "Number.Abs": F.abs, "Number.Mod": F.pmod, "Date.Year": F.year, "Date.Month": F.month, "Date.Day": F.dayofmonth,
    "Date.AddDays": lambda d, n: F.date_add(d.cast("date"), n), "Date.AddMonths": lambda d, n: F.add_months(d.cast("date"), n), "Date.AddYears": lambda d, n: F.add_months(d.cast("date"), n * 12),
    "Date.EndOfMonth": F.last_day, "Date.StartOfMonth": lambda d: F.trunc(d.cast("date"), "MM"), "Date.From": lambda d: d.cast("date"),
}


class _Table:
    """A step's rows, the sort a later step may consume, and nested joins that are not expanded yet."""

    def __init__(self, df: DataFrame, order: list[Column] | None = None, nested: dict | None = None):
        self.df, self.order, self.nested = df, order, nested or {}

    def of(self, df: DataFrame, kept: list[str] | None = None) -> _Table:
        """These rows after a step that keeps their order, and the nested columns that it keeps and whose keys it keeps."""
        there = set(df.columns)
        nested = {n: j for n, j in self.nested.items() if (kept is None or n in kept) and there.issuperset(j[2])}
        return _Table(df, self.order, nested)


class PowerQuery:
    """Queries by name, and the tables they read."""

    def __init__(self, tables: Mapping[str, DataFrame], queries: Mapping[str, str] | None = None):
        self.tables, self.queries, self.notes = dict(tables), dict(queries or {}), []

    def run(self, text: str) -> DataFrame:
        return self.table(parse(text), {}).df

    # Scalars

    def column(self, t: tuple, steps: dict) -> Column:
        c = lambda x: self.column(x, steps)
        match t:
            case ("each", x):
                return c(x)
            case ("num" | "text" | "bool", x):
                return F.lit(x)
            case ("null", _):
                return F.lit(None)
            case ("field", None | ("name", "_"), n):
                return F.col(f"`{n}`")
            case ("name", n) if n in steps and isinstance(steps[n], Column):
                return steps[n]
            case ("not", x):
                return ~c(x)
            case ("neg", x):
                return -c(x)
            case ("if", x, a, b):
                return F.when(c(x), c(a)).otherwise(c(b))
            case ("op", "=", a, b):
                return c(a).eqNullSafe(c(b))
            case ("op", "<>", a, b):
                return ~c(a).eqNullSafe(c(b))
            case ("op", s, a, b):
                x, y = c(a), c(b)
                return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "&": lambda: F.concat(x.cast("string"), y.cast("string")), "and": lambda: x & y, "or": lambda: x | y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[s]()
            case ("call", "Number.Round", [a, *n]):
                return F.bround(c(a), n[0][1] if n else 0)
            case ("call", "List.Contains", [("list", values), x]):
                return c(x).isin(*[v[1] for v in values])
            case ("call", "Text.Combine", [("list", values), *sep]):
                return F.concat_ws(sep[0][1] if sep else "", *map(c, values))
            case ("call", n, args) if n in _ONE:
                return _ONE[n](*map(c, args))
            case ("call", n, _):
                raise GuardRefused(f"{n} is not translated.")
        raise GuardRefused(f"cannot translate {t}")

    # Tables

    def table(self, t: tuple, steps: dict) -> _Table:
        match t:
            case ("let", named, last):
                steps = dict(steps)
                for n, x in named:
                    try:
                        steps[n] = self.table(x, steps)
                    except _NotATable:
                        steps[n] = self.column(x, steps)
                return self.table(last, steps)
            case ("name", n):
                if isinstance(steps.get(n), _Table):
                    return steps[n]
                if n in self.queries:
                    return self.table(parse(self.queries[n]), {})
                if n in self.tables:
                    return _Table(self.tables[n])
                raise _NotATable(n)
            case ("field" | "item", of, _):
                return self.source(t) or self.table(of, steps)
            case ("call", n, args):
                if (step := getattr(self, "m_" + n.removeprefix("Table.").lower(), None)) and n.startswith("Table."):
                    return step(args, steps)
                if n.startswith("Table."):
                    raise GuardRefused(f"{n} is not translated.")
        raise _NotATable(str(t))

    def source(self, t: tuple) -> _Table | None:
        """Excel.CurrentWorkbook(){[Name="x"]}[Content], or a database's table by schema and item."""
        parts = list(_parts(t))
        calls = {x[1] for x in parts if x[0] == "call"}
        if any(n.startswith("Web.") for n in calls):
            raise GuardRefused("web sources are not read.")
        if "Excel.CurrentWorkbook" in calls or any(n.split(".")[-1] in ("Database", "Databases") for n in calls):
            named = [r[k][1] for r in (x[1] for x in parts if x[0] == "record") for k in ("Name", "Item") if k in r and r[k][0] == "text"]
            if not named:
                raise GuardRefused("a source names no table.")
            if named[-1] not in self.tables:  # the innermost record comes first, and the last step names the item
                raise GuardRefused(f"{named[-1]} is no table here.")
            return _Table(self.tables[named[-1]])
        return None

    @staticmethod
    def names(t: tuple) -> list[str]:
        return [x[1] for x in t[1]] if t[0] == "list" else [t[1]]

    def m_selectrows(self, args: list, steps: dict) -> _Table:
        t, test = self.table(args[0], steps), args[1][1]
        negated = test[0] == "not"
        inner = test[1] if negated else test
        if inner[0] == "call" and inner[1] == "List.Contains" and inner[2][0][0] == "field" and inner[2][0][1] is not None:
            (_, of, k), (_, _, own) = inner[2]
            other = self.table(of, steps).df.select(F.col(f"`{k}`").alias("__k")).where("__k IS NOT NULL")
            return t.of(t.df.join(other, F.col(f"`{own}`") == F.col("__k"), "left_anti" if negated else "left_semi"))
        return t.of(t.df.where(self.column(test, steps)))

    def m_selectcolumns(self, args: list, steps: dict) -> _Table:
        t = self.table(args[0], steps)
        names = self.names(args[1])
        return t.of(t.df.select(*[f"`{n}`" for n in names if n not in t.nested]), names)

    m_reordercolumns = m_selectcolumns

    def m_removecolumns(self, args: list, steps: dict) -> _Table:
        t = self.table(args[0], steps)
        gone = self.names(args[1])
        return t.of(t.df.drop(*gone), [n for n in t.nested if n not in gone])

    def m_renamecolumns(self, args: list, steps: dict) -> _Table:
        t = self.table(args[0], steps)
        pairs = args[1][1] if args[1][1][0][0] == "list" else [args[1]]
        new = {a[1]: b[1] for _, (a, b) in pairs}
        nested = {new.get(n, n): (how, right, [new.get(k, k) for k in left], theirs) for n, (how, right, left, theirs) in t.nested.items()}
        return _Table(t.df.withColumnsRenamed({a: b for a, b in new.items() if a not in t.nested}), t.order, nested)

    def m_duplicatecolumn(self, args: list, steps: dict) -> _Table:
        t = self.table(args[0], steps)
        return t.of(t.df.withColumn(args[2][1], F.col(f"`{args[1][1]}`")))

    def m_transformcolumntypes(self, args: list, steps: dict) -> _Table:
        return self.table(args[0], steps)

    m_buffer = m_promoteheaders = m_transformcolumntypes

    def m_addcolumn(self, args: list, steps: dict) -> _Table:
        t, (_, x) = self.table(args[0], steps), args[2]
        if x[0] == "name" and isinstance(steps.get(x[1]), _Table) or x[0] == "name" and (x[1] in self.tables or x[1] in self.queries):
            return _Table(t.df, t.order, t.nested | {args[1][1]: ("cross", self.table(x, steps).df, [], [])})
        return t.of(t.df.withColumn(args[1][1], self.column(x, steps)))

    def m_transformcolumns(self, args: list, steps: dict) -> _Table:
        t = self.table(args[0], steps)
        pairs = args[1][1] if args[1][1][0][0] == "list" else [args[1]]
        changed = {}
        for _, (name, f, *_) in pairs:
            tree = f[1] if f[0] == "each" else ("call", f[1], [("name", "_")])
            changed[name[1]] = self.column(_put(tree, ("field", None, name[1])), steps)
        return t.of(t.df.withColumns(changed))

    def m_replacevalue(self, args: list, steps: dict) -> _Table:
        t, old, new, how = self.table(args[0], steps), args[1], args[2], args[3][1]
        changed = {}
        for n in self.names(args[4]):
            c = F.col(f"`{n}`")
            if old[0] == "null":
                changed[n] = F.coalesce(c, self.column(new, steps))
            elif how == "Replacer.ReplaceText":
                changed[n] = F.replace(c, F.lit(old[1]), F.lit(new[1]))
            else:
                changed[n] = F.when(c == F.lit(old[1]), self.column(new, steps)).otherwise(c)
        return t.of(t.df.withColumns(changed))

    def m_filldown(self, args: list, steps: dict) -> _Table:
        raise GuardRefused("Table.FillDown and FillUp need the order of rows, which a table does not have.")

    m_fillup = m_filldown

    def m_group(self, args: list, steps: dict) -> _Table:
        t, keys = self.table(args[0], steps), self.names(args[1])
        specs = args[2][1] if args[2][1][0][0] == "list" else [args[2]]
        aggs = []
        for _, (name, f, *_) in specs:
            x = f[1]
            if x[0] == "call" and x[1] == "Table.RowCount":
                inner = x[2][0]
                distinct = inner[0] == "call" and inner[1] == "Table.Distinct"
                a = F.count_distinct(F.struct(*t.df.columns)) if distinct else F.count(F.lit(1))
            elif x[0] == "call" and x[1] == "List.Count" and x[2][0][0] == "call":
                a = F.count_distinct(self.column(x[2][0][2][0], steps))
            else:
                a = _AGGREGATE[x[1]](self.column(x[2][0], steps))
            aggs.append(a.alias(name[1]))
        return _Table(t.df.groupBy(*[f"`{k}`" for k in keys]).agg(*aggs))

    def m_nestedjoin(self, args: list, steps: dict) -> _Table:
        t, left, right, theirs, new = self.table(args[0], steps), self.names(args[1]), self.table(args[2], steps), self.names(args[3]), args[4][1]
        how = _JOIN[args[5][1]] if len(args) > 5 else "left"
        if how in ("left_anti", "right_anti"):
            a, b, ka, kb = (t.df, right.df, left, theirs) if how == "left_anti" else (right.df, t.df, theirs, left)
            other = b.select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(kb)])
            return _Table(a.join(other, [F.col(f"`{k}`").eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(ka)], "left_anti"), t.order if how == "left_anti" else None, t.nested if how == "left_anti" else None)
        return _Table(t.df, t.order, t.nested | {new: (how, right.df, left, theirs)})

    def m_expandtablecolumn(self, args: list, steps: dict) -> _Table:
        t = self.table(args[0], steps)
        nested = args[1][1]
        if nested not in t.nested:
            raise GuardRefused(f"{nested} is no nested table here.", fix=f"there are {', '.join(t.nested) or 'none'}")
        how, right, left, theirs = t.nested[nested]
        names = self.names(args[2])
        new = self.names(args[3]) if len(args) > 3 else names
        # The keys of the other nested tables are this table's columns, so they can be expanded later.
        marked = right.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(theirs)], *[F.col(f"`{n}`").alias(f"__n{i}") for i, n in enumerate(names)])
        on = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(left)]
        df = t.df.crossJoin(marked) if how == "cross" else t.df.join(marked, on, how)
        df = df.select(*[F.col(f"`{c}`") for c in t.df.columns], *[F.col(f"__n{i}").alias(n) for i, n in enumerate(new)])
        return _Table(df, t.order, {k: v for k, v in t.nested.items() if k != nested})

    def m_combine(self, args: list, steps: dict) -> _Table:
        return _Table(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.table(x, steps).df for x in args[0][1]]))

    def m_distinct(self, args: list, steps: dict) -> _Table:
        if len(args) > 1:
            raise GuardRefused("Table.Distinct over some columns keeps whichever row comes first.")
        return _Table(self.table(args[0], steps).df.distinct())

    def m_unpivot(self, args: list, steps: dict) -> _Table:
        df, columns = self.table(args[0], steps).df, self.names(args[1])
        return _unpivoted(df, columns, args[2][1], args[3][1])

    def m_unpivotothercolumns(self, args: list, steps: dict) -> _Table:
        df, keep = self.table(args[0], steps).df, self.names(args[1])
        return _unpivoted(df, [c for c in df.columns if c not in keep], args[2][1], args[3][1])

    def m_pivot(self, args: list, steps: dict) -> _Table:
        df, values, by, of = self.table(args[0], steps).df, self.names(args[1]), args[2][1], args[3][1]
        f = args[4][1] if len(args) > 4 else "List.Sum"
        x = F.lit(1) if f == "List.Count" else F.col(f"`{of}`")
        keys = [c for c in df.columns if c not in (by, of)]
        return _Table(df.groupBy(*[f"`{k}`" for k in keys]).pivot(by, values).agg(F.sum(x) if f in ("List.Sum", "List.Count") else _AGGREGATE[f](x)))

    def m_sort(self, args: list, steps: dict) -> _Table:
        t = self.table(args[0], steps)
        specs = args[1][1] if args[1][0] == "list" and args[1][1] and args[1][1][0][0] == "list" else [args[1]] if args[1][0] == "list" and len(args[1][1]) == 2 and args[1][1][1][0] == "name" else [("list", [x]) for x in (args[1][1] if args[1][0] == "list" else [args[1]])]
        order = []
        for _, (name, *way) in specs:
            c = F.col(f"`{name[1]}`")
            order.append(c.desc() if way and way[0][1] == "Order.Descending" else c.asc())
        return _Table(t.df, order, t.nested)

    def m_firstn(self, args: list, steps: dict) -> _Table:
        t = self.table(args[0], steps)
        if not t.order:
            raise GuardRefused("Table.FirstN without Table.Sort keeps whichever rows come first.")
        return _Table(t.df.orderBy(*t.order).limit(args[1][1]))

    def m_addindexcolumn(self, args: list, steps: dict) -> _Table:
        t = self.table(args[0], steps)
        if not t.order:
            raise GuardRefused("Table.AddIndexColumn without Table.Sort numbers rows by chance.")
        start, step = (args[2][1] if len(args) > 2 else 0), (args[3][1] if len(args) > 3 else 1)
        return t.of(numbered(t.df, t.order, args[1][1], start, step))


class _NotATable(ValueError):
    pass


def _parts(t: tuple) -> Iterator[tuple]:
    """The trees of a tree, inner ones first."""
    for x in t[1:]:
        for y in x if isinstance(x, list) else x.values() if isinstance(x, dict) else [x]:
            if isinstance(y, tuple) and y:
                yield from _parts(y)
    yield t


def _put(t: tuple, value: tuple) -> tuple:
    """The tree with value for _."""
    if t == ("name", "_"):
        return value
    return tuple([_put(y, value) for y in x] if isinstance(x, list) else _put(x, value) if isinstance(x, tuple) else x for x in t)


def _unpivoted(df: DataFrame, columns: list[str], attribute: str, value: str) -> _Table:
    keep = [c for c in df.columns if c not in columns]
    return _Table(df.unpivot(keep, columns, attribute, value).where(F.col(f"`{value}`").isNotNull()))
