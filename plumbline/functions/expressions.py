"""Immutable expressions that know their type family, additivity and what they refer to, and lower to Spark columns.

The tree is the source of truth for every check; Spark columns are made from it only when a statement is lowered, so
building and checking needs no session.
"""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from plumbline.errors import GuardRefused

NUMBER, STRING, DATE, TIMESTAMP, BOOLEAN = "number", "string", "date", "timestamp", "boolean"


def family(dtype: str | None) -> str | None:
    """The type family of a type name; None if unknown."""
    base = (dtype or "").split("(")[0].split("<")[0].lower()
    if base in ("tinyint", "smallint", "int", "integer", "bigint", "float", "double", "decimal"):
        return NUMBER
    if base in ("string", "varchar", "char"):
        return STRING
    if base in ("date", "boolean"):
        return base
    return TIMESTAMP if base.startswith("timestamp") else None


@dataclass(frozen=True, eq=False)
class Expr:
    """A node: op, its arguments, and facts about the value."""

    op: str
    args: tuple = ()
    kind: str | None = None  # type family
    why_not_additive: str | None = None

    # Comparisons are functions, so that a condition is never mistaken for Python's truth.
    def _no(self, *_: Any) -> Any:
        raise TypeError("compare columns with equals(), more_than() and the other condition functions")

    __lt__ = __le__ = __gt__ = __ge__ = __bool__ = _no

    def __add__(self, other: Any) -> Expr:
        return arithmetic("+", self, other)

    def __radd__(self, other: Any) -> Expr:
        return arithmetic("+", other, self)

    def __sub__(self, other: Any) -> Expr:
        return arithmetic("-", self, other)

    def __rsub__(self, other: Any) -> Expr:
        return arithmetic("-", other, self)

    def __mul__(self, other: Any) -> Expr:
        return arithmetic("*", self, other)

    def __rmul__(self, other: Any) -> Expr:
        return arithmetic("*", other, self)

    def __truediv__(self, other: Any) -> Expr:
        return arithmetic("/", self, other)

    def __rtruediv__(self, other: Any) -> Expr:
        return arithmetic("/", other, self)

    def __neg__(self) -> Expr:
        return Expr("neg", (self,), NUMBER, self.why_not_additive)

    def key(self) -> tuple:
        """What makes two expressions the same."""
        return (self.op, tuple(a.key() if isinstance(a, Expr | WindowSpec) else a if isinstance(a, str | int | float | bool | None | datetime.date) else repr(a) for a in self.args))

    def walk(self) -> Iterator[Expr]:
        yield self
        for a in self.args:
            if isinstance(a, Expr):
                yield from a.walk()
            elif isinstance(a, WindowSpec):
                for x in (*a.partition, *(o.expr for o in a.order)):
                    yield from x.walk()

    def refs(self) -> set[tuple[str, str]]:
        """(alias, column) pairs."""
        return {e.args for e in self.walk() if e.op == "ref"}

    def has(self, *ops: str) -> bool:
        return any(e.op in ops for e in self.walk())

    @property
    def aggregates(self) -> bool:
        """Whether a plain aggregate stands outside any window's own calculation."""
        if self.op == "over":
            return any(isinstance(a, Expr) and any(x.aggregates for x in a.args if isinstance(x, Expr)) for a in self.args[:1])
        return self.op == "agg" or any(a.aggregates for a in self.args if isinstance(a, Expr))

    def over_rows(self) -> bool:
        return self.has("over")


@dataclass(frozen=True, eq=False)
class Named:
    expr: Expr
    name: str


@dataclass(frozen=True)
class Ordering:
    expr: Expr
    down: bool = False


@dataclass(frozen=True, eq=False)
class WindowSpec:
    partition: tuple[Expr, ...]
    order: tuple[Ordering, ...]
    rows: tuple[int | None, int | None] | None
    by_range: bool = False

    def key(self) -> tuple:
        return (tuple(p.key() for p in self.partition), tuple((o.expr.key(), o.down) for o in self.order), self.rows, self.by_range)


@dataclass(frozen=True, eq=False)
class Condition:
    """A boolean tree, the columns it bounds, and the aliases whose unmatched outer rows it keeps."""

    expr: Expr
    bounds: frozenset = frozenset()
    keeps: frozenset = frozenset()
    equalities: tuple = ()  # (expr, expr) pairs that hold where the condition does

    def __bool__(self) -> bool:
        raise TypeError("join conditions with all_of() and any_of()")


def literal(value: Any) -> Expr:
    """A Python value as an expression."""
    if isinstance(value, Expr):
        return value
    if hasattr(value, "item") and not isinstance(value, str | bytes):
        value = value.item()
    if value is None:
        raise GuardRefused("None is no value to compare or calculate with.", "NULL is never equal to anything.", "use is_null() or is_not_null()")
    if isinstance(value, bool):
        return Expr("lit", (value,), BOOLEAN)
    if isinstance(value, float) and not math.isfinite(value):
        raise GuardRefused(f"{value} is no value for a column.")
    if isinstance(value, int | float):
        return Expr("lit", (value,), NUMBER)
    if isinstance(value, str):
        return Expr("lit", (value,), STRING)
    if isinstance(value, datetime.datetime):
        return Expr("lit", (value,), TIMESTAMP)
    if isinstance(value, datetime.date):
        return Expr("lit", (value,), DATE)
    raise TypeError(f"{type(value).__name__} is no value for a column")


def ref(alias: str, name: str, kind: str | None = None, why_not_additive: str | None = None) -> Expr:
    return Expr("ref", (alias, name), kind, why_not_additive)


def arithmetic(sign: str, left: Any, right: Any) -> Expr:
    left, right = literal(left), literal(right)
    for x in (left, right):
        if x.kind in (STRING, BOOLEAN):
            raise GuardRefused(f"{sign} needs numbers, not a {x.kind}.")
    why = left.why_not_additive or right.why_not_additive
    if sign == "/":
        why = why or "it is a division"
    return Expr(sign, (left, right), NUMBER, why)


# Conditions


def _pair(left: Expr, right: Any) -> tuple[Expr, Expr]:
    right = literal(right)
    if left.kind and right.kind and left.kind != right.kind and {left.kind, right.kind} - {STRING, DATE}:
        raise GuardRefused(f"a {left.kind} is compared with a {right.kind}.", "the comparison would silently convert one of them.", "compare values of one type")
    return left, right


def _compare(op: str, left: Expr, right: Any, bounds: bool = True) -> Condition:
    left, right = _pair(left, right)
    pinned = frozenset(x.args for x, y in ((left, right), (right, left)) if x.op == "ref" and bounds and not (y.refs() and y.op != "ref")) if bounds else frozenset()
    # A comparison with another column pins neither to constants; it bounds only where the other side is fixed.
    if right.refs() and left.refs():
        pinned = frozenset()
    return Condition(Expr(op, (left, right), BOOLEAN), pinned, frozenset(), ((left, right),) if op == "=" else ())


def equals(column: Expr, value: Any) -> Condition:
    return _compare("=", column, value)


def not_equals(column: Expr, value: Any) -> Condition:
    return _compare("<>", column, value, bounds=False)


def at_least(column: Expr, value: Any) -> Condition:
    return _compare(">=", column, value)


def at_most(column: Expr, value: Any) -> Condition:
    return _compare("<=", column, value)


def more_than(column: Expr, value: Any) -> Condition:
    return _compare(">", column, value)


def less_than(column: Expr, value: Any) -> Condition:
    return _compare("<", column, value)


def between(column: Expr, low: Any, high: Any) -> Condition:
    low, high = _pair(column, low)[1], _pair(column, high)[1]
    if low.op == high.op == "lit" and low.args[0] > high.args[0]:
        raise GuardRefused(f"between({low.args[0]!r}, {high.args[0]!r}) holds for no row.", fix="give the lower value first")
    return Condition(Expr("between", (column, low, high), BOOLEAN), frozenset([column.args]) if column.op == "ref" else frozenset())


_clock: Callable[[], datetime.datetime] = lambda: datetime.datetime.now(datetime.UTC)


def set_clock(clock: Callable[[], datetime.datetime] | None) -> None:
    """For tests and reruns: what the time is, in UTC."""
    global _clock
    _clock = clock or (lambda: datetime.datetime.now(datetime.UTC))


def today(utc_offset_hours: float = 0) -> datetime.date:
    return (_clock() + datetime.timedelta(hours=utc_offset_hours)).date()


def last_n_days(column: Expr, n: int) -> Condition:
    """The n whole days before today (UTC)."""
    if n < 1:
        raise GuardRefused("last_n_days() needs at least one day.")
    first, now = today() - datetime.timedelta(days=n), today()
    if column.kind == TIMESTAMP:
        start, end = (datetime.datetime.combine(d, datetime.time()) for d in (first, now))
        return all_of(at_least(column, start), less_than(column, end))
    if column.kind == STRING:
        first, last = first.isoformat(), (now - datetime.timedelta(days=1)).isoformat()
    else:
        last = now - datetime.timedelta(days=1)
    return equals(column, first) if n == 1 else between(column, first, last)


def _values(column: Expr, values: Any) -> tuple:
    values = sorted(values) if isinstance(values, set | frozenset) else list(values)
    if not values:
        raise GuardRefused("a list of no values holds for no row.")
    return tuple(_pair(column, v)[1].args[0] for v in values)


def is_in(column: Expr, values: Any) -> Condition:
    return Condition(Expr("in", (column, _values(column, values)), BOOLEAN), frozenset([column.args]) if column.op == "ref" else frozenset())


def is_not_in(column: Expr, values: Any) -> Condition:
    return Condition(Expr("not in", (column, _values(column, values)), BOOLEAN))


def is_null(column: Expr) -> Condition:
    return Condition(Expr("null", (column,), BOOLEAN), keeps=frozenset(a for a, _ in column.refs()))


def is_not_null(column: Expr) -> Condition:
    return Condition(Expr("not null", (column,), BOOLEAN))


def contains(column: Expr, text: str) -> Condition:
    return Condition(Expr("contains", (column, _text(text)), BOOLEAN))


def starts_with(column: Expr, text: str) -> Condition:
    return Condition(Expr("starts", (column, _text(text)), BOOLEAN), frozenset([column.args]) if column.op == "ref" else frozenset())


def _text(text: str) -> str:
    if not isinstance(text, str) or not text:
        raise GuardRefused("a text to look for must be a string that is not empty.")
    return text


def any_of(*conditions: Condition) -> Condition:
    """OR. It bounds what all of them bound, and keeps the unmatched rows that any of them keeps."""
    if len(conditions) < 2:
        raise GuardRefused("any_of() needs two conditions at least.")
    return Condition(Expr("or", tuple(c.expr for c in conditions), BOOLEAN), reduce(frozenset.__and__, (c.bounds for c in conditions)), reduce(frozenset.__or__, (c.keeps for c in conditions)))


def all_of(*conditions: Condition) -> Condition:
    """AND. It bounds what any of them bounds; unmatched rows survive only if every condition that tests them keeps them."""
    if not conditions:
        raise GuardRefused("all_of() needs a condition.")
    keeps = reduce(frozenset.__or__, (c.keeps for c in conditions))
    lost = {a for c in conditions for a, _ in c.expr.refs() if a not in c.keeps}
    return Condition(Expr("and", tuple(c.expr for c in conditions), BOOLEAN), reduce(frozenset.__or__, (c.bounds for c in conditions)), keeps - lost, sum((c.equalities for c in conditions), ()))


# Calculations


def _aggregate(name: str, column: Expr | None, where: Condition | None, over: WindowSpec | None, kind: str | None, why: str | None = None) -> Expr:
    if column is not None and column.aggregates:
        raise GuardRefused(f"{name} of an aggregate: aggregates cannot be nested.", fix="put the inner one into a derived table")
    inner = Expr("agg", (name, column, where.expr if where is not None else None), kind, why)
    if over is None:
        return inner
    if over.order and over.rows is None and not over.by_range:
        raise GuardRefused("a total over an ordered window without rows= is ambiguous.", "rows that tie would share one total.", "give rows=(None, 0) for a running total")
    return Expr("over", (inner, over), kind, why or "it is a total of other rows")


def count_rows(where: Condition | None = None, over: WindowSpec | None = None) -> Expr:
    return _aggregate("count", None, where, over, NUMBER)


def count_distinct(column: Expr, where: Condition | None = None) -> Expr:
    return _aggregate("count_distinct", column, where, None, NUMBER, "it counts distinct values")


def _summable(name: str, column: Expr, adds_up: bool) -> None:
    if column.kind not in (None, NUMBER):
        raise GuardRefused(f"{name} needs a number, not a {column.kind}.")
    if column.why_not_additive and not adds_up:
        raise GuardRefused(f"{name} of a value that does not add up: {column.why_not_additive}.", "its sum or average means nothing.", "calculate it again from the rows", "adds_up=True")


def sum_of(column: Expr, where: Condition | None = None, adds_up: bool = False, over: WindowSpec | None = None) -> Expr:
    _summable("sum_of", column, adds_up)
    return _aggregate("sum", column, where, over, NUMBER)


def average_of(column: Expr, where: Condition | None = None, adds_up: bool = False, over: WindowSpec | None = None) -> Expr:
    _summable("average_of", column, adds_up)
    return _aggregate("avg", column, where, over, NUMBER, "it is an average")


def min_of(column: Expr, where: Condition | None = None, over: WindowSpec | None = None) -> Expr:
    return _aggregate("min", column, where, over, column.kind, column.why_not_additive)


def max_of(column: Expr, where: Condition | None = None, over: WindowSpec | None = None) -> Expr:
    return _aggregate("max", column, where, over, column.kind, column.why_not_additive)


def _one_kind(values: list[Expr]) -> str | None:
    kinds = {v.kind for v in values if v.kind}
    if len(kinds) > 1 and kinds - {STRING, DATE}:
        raise GuardRefused(f"the results are of several types: {', '.join(sorted(kinds))}.")
    return next(iter(kinds), None)


def if_else(condition: Condition, then: Any, otherwise: Any) -> Expr:
    return first_match([(condition, then)], otherwise)


def first_match(cases: list[tuple[Condition, Any]], otherwise: Any = None) -> Expr:
    if not cases:
        raise GuardRefused("first_match() needs a case.")
    values = [literal(v) for _, v in cases] + ([literal(otherwise)] if otherwise is not None else [])
    flat = [x for (c, _), v in zip(cases, values, strict=False) for x in (c.expr, v)]
    why = next((v.why_not_additive for v in values if v.why_not_additive), None)
    return Expr("case", (len(cases), *flat, values[-1] if otherwise is not None else None), _one_kind(values), why)


def mapped(column: Expr, values: dict, otherwise: Any = None) -> Expr:
    return first_match([(equals(column, k), v) for k, v in values.items()], otherwise)


def fill_null(column: Expr, value: Any) -> Expr:
    value = literal(value)
    return Expr("coalesce", (column, value), _one_kind([column, value]), column.why_not_additive)


def week_start(column: Expr) -> Expr:
    """Monday of the week, as text."""
    return Expr("week", (column,), STRING)


def month_start(column: Expr) -> Expr:
    """First day of the month, as text."""
    return Expr("month", (column,), STRING)


def descending(column: Expr | str) -> Ordering:
    return Ordering(column if isinstance(column, Expr) else Expr("name", (column,)), True)


#: Functions whose number of arguments is checked: least and most (None: any). Fixed values of the SQL dialect.
ARITY = {
    "upper": (1, 1), "lower": (1, 1), "trim": (1, 1), "ltrim": (1, 1), "rtrim": (1, 1), "length": (1, 1), "concat": (1, None), "concat_ws": (2, None),
    "substr": (2, 3), "substring": (2, 3), "instr": (2, 2), "locate": (2, 3), "split": (2, 2), "lpad": (3, 3), "rpad": (3, 3), "regexp_extract": (2, 3),
    "regexp_replace": (3, 3), "rlike": (2, 2), "translate": (3, 3), "reverse": (1, 1), "repeat": (2, 2), "initcap": (1, 1), "ascii": (1, 1), "space": (1, 1),
    "base64": (1, 1), "unbase64": (1, 1), "md5": (1, 1), "sha2": (2, 2), "get_json_object": (2, 2), "format_number": (2, 2), "nvl": (2, 2), "coalesce": (1, None),
    "nullif": (2, 2), "if": (3, 3), "greatest": (2, None), "least": (2, None), "date_format": (2, 2), "datediff": (2, 2), "date_add": (2, 2), "date_sub": (2, 2),
    "add_months": (2, 2), "months_between": (2, 2), "next_day": (2, 2), "trunc": (2, 2), "date_trunc": (2, 2), "last_day": (1, 1), "to_date": (1, 1),
    "from_unixtime": (1, 2), "year": (1, 1), "quarter": (1, 1), "month": (1, 1), "weekofyear": (1, 1), "day": (1, 1), "dayofmonth": (1, 1), "hour": (1, 1),
    "minute": (1, 1), "second": (1, 1), "abs": (1, 1), "round": (1, 2), "bround": (1, 2), "floor": (1, 1), "ceil": (1, 1), "ceiling": (1, 1), "sqrt": (1, 1),
    "exp": (1, 1), "ln": (1, 1), "log": (2, 2), "log10": (1, 1), "log2": (1, 1), "pow": (2, 2), "power": (2, 2), "pmod": (2, 2), "sign": (1, 1), "negative": (1, 1),
    "positive": (1, 1), "rand": (0, 1), "hex": (1, 1), "unhex": (1, 1), "hash": (1, None), "size": (1, 1), "array_contains": (2, 2), "sort_array": (1, 2), "str_to_map": (1, 3),
    "count": (1, None), "sum": (1, 1), "avg": (1, 1), "min": (1, 1), "max": (1, 1), "collect_set": (1, 1), "collect_list": (1, 1), "variance": (1, 1), "var_pop": (1, 1),
    "var_samp": (1, 1), "stddev": (1, 1), "stddev_pop": (1, 1), "stddev_samp": (1, 1), "corr": (2, 2), "covar_pop": (2, 2), "covar_samp": (2, 2), "percentile": (2, 2),
    "percentile_approx": (2, 3), "histogram_numeric": (2, 2), "any": (1, 1), "some": (1, 1), "every": (1, 1), "bool_and": (1, 1), "bool_or": (1, 1), "count_if": (1, 1),
    "max_by": (2, 2), "min_by": (2, 2), "median": (1, 1),
}

#: Functions that aggregate. Fixed values of the SQL dialect.
AGGREGATES = frozenset(
    "count sum avg min max collect_set collect_list variance var_pop var_samp stddev stddev_pop stddev_samp corr covar_pop covar_samp percentile percentile_approx histogram_numeric "
    "any some every bool_and bool_or count_if max_by min_by median any_value approx_count_distinct approx_percentile array_agg bit_and bit_or bit_xor bitmap_construct_agg bitmap_or_agg "
    "bitmap_and_agg count_min_sketch first first_value grouping grouping_id kurtosis last last_value listagg string_agg mean mode percentile_cont percentile_disc "
    "regr_avgx regr_avgy regr_count regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy skewness std try_avg try_sum".split()
)
WINDOW_ONLY = frozenset("row_number rank dense_rank ntile lag lead cume_dist percent_rank nth_value".split())
NOT_IN_SPARK = frozenset("context_ngrams ngrams measure".split())
#: Results that Spark gives as dates where text is meant.
_AS_TEXT = frozenset("next_day trunc last_day add_months".split())
_KINDS = {NUMBER: "length instr locate ascii datediff months_between year quarter month weekofyear day dayofmonth hour minute second abs round bround floor ceil ceiling sqrt exp ln log log10 log2 pow power pmod sign negative positive rand hash size count sum avg corr count_if".split(), STRING: "upper lower trim ltrim rtrim concat concat_ws substr substring lpad rpad regexp_extract regexp_replace translate reverse repeat initcap space base64 md5 sha2 get_json_object format_number date_format from_unixtime next_day trunc last_day add_months hex".split(), BOOLEAN: "rlike array_contains any some every bool_and bool_or".split(), DATE: "to_date date_add date_sub".split()}
_KIND_OF = {n: k for k, names in _KINDS.items() for n in names}


def aggregates(name: str) -> bool:
    """Whether a function aggregates. Sketches are named by a rule: <sketch>_<what>_agg, some with a type."""
    return name in AGGREGATES or re.fullmatch(r"(hll|kll|theta)_\w+_agg(_\w+)?|approx_top_k(_accumulate|_combine)?", name) is not None


def sql_function(name: str, *args: Any) -> Expr:
    """A named function of the SQL dialect; `variance` is the population's."""
    name = name.lower()
    if name in WINDOW_ONLY:
        raise GuardRefused(f"{name}() needs a window.", fix="use the window functions")
    if name in NOT_IN_SPARK or name.startswith("tuple_"):
        raise GuardRefused(f"{name}() is not available on Spark.")
    if name in ARITY:
        least, most = ARITY[name]
        if len(args) < least or most is not None and len(args) > most:
            raise GuardRefused(f"{name}() takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments, not {len(args)}.")
    args = tuple(literal(a) for a in args)
    if aggregates(name):
        if any(a.aggregates for a in args):
            raise GuardRefused(f"{name}() of an aggregate: aggregates cannot be nested.")
        return Expr("agg", ("call", name, *args), _KIND_OF.get(name), None if name in ("count", "sum", "min", "max") else f"it is {name}()")
    return Expr("call", (name, *args), _KIND_OF.get(name), next((a.why_not_additive for a in args if a.why_not_additive), None))


# Windows


def window(PARTITION_BY: Any = None, ORDER_BY: Any = None, rows: tuple[int | None, int | None] | None = None) -> WindowSpec:
    listed = lambda x: () if x is None else tuple(x) if isinstance(x, list | tuple) else (x,)
    order = tuple(o if isinstance(o, Ordering) else Ordering(o) for o in listed(ORDER_BY))
    if rows is not None:
        if not order:
            raise GuardRefused("rows= needs ORDER_BY.", "without an order, which rows they are is left to chance.")
        start, end = rows
        if start is not None and end is not None and start > end:
            raise GuardRefused(f"rows=({start}, {end}) ends before it starts.")
    return WindowSpec(listed(PARTITION_BY), order, rows)


def _place(name: str, over: WindowSpec, *args: Any) -> Expr:
    if not over.order:
        raise GuardRefused(f"{name}() needs ORDER_BY.", "without an order the numbers are left to chance.")
    if over.rows:
        raise GuardRefused(f"{name}() takes no rows=.")
    return Expr("over", (Expr("place", (name, *args), NUMBER), over), NUMBER, "it is a place in an order")


def row_number(*, PARTITION_BY: Any = None, ORDER_BY: Any = None, over: WindowSpec | None = None) -> Expr:
    return _place("row_number", over or window(PARTITION_BY, ORDER_BY))


def rank(*, over: WindowSpec) -> Expr:
    return _place("rank", over)


def dense_rank(*, over: WindowSpec) -> Expr:
    return _place("dense_rank", over)


def ntile(parts: int, *, over: WindowSpec) -> Expr:
    if parts < 1:
        raise GuardRefused("ntile() needs one part at least.")
    return _place("ntile", over, parts)


def _shift(name: str, column: Expr, over: WindowSpec, n: int) -> Expr:
    if n < 1:
        raise GuardRefused(f"{name}() goes one row at least.")
    return replace(_place(name, over, column, n), kind=column.kind, why_not_additive=column.why_not_additive)


def lag(column: Expr, *, over: WindowSpec, back: int = 1) -> Expr:
    return _shift("lag", column, over, back)


def lead(column: Expr, *, over: WindowSpec, ahead: int = 1) -> Expr:
    return _shift("lead", column, over, ahead)


def _edge(name: str, column: Expr, over: WindowSpec) -> Expr:
    if not over.order:
        raise GuardRefused(f"{name}() needs ORDER_BY.")
    return Expr("over", (Expr("place", (name, column), column.kind), replace(over, rows=over.rows or (None, None))), column.kind, column.why_not_additive)


def first_value(column: Expr, *, over: WindowSpec) -> Expr:
    """The first value of the whole partition, unless the window has rows."""
    return _edge("first_value", column, over)


def last_value(column: Expr, *, over: WindowSpec) -> Expr:
    return _edge("last_value", column, over)


def is_total(column: Expr) -> Condition:
    """Whether a row of subtotals is a total over the column."""
    return Condition(Expr("is_total", (column,), BOOLEAN))


# Hand-written SQL


def _filled(text: str, columns: dict[str, Expr]) -> tuple:
    return (text, tuple(sorted(columns))), tuple(columns[k] for k in sorted(columns))


def unchecked_column(text: str, **columns: Expr) -> Expr:
    """A scalar in SQL with {name} for columns; it is not checked."""
    head, args = _filled(text, columns)
    return Expr("sql", (*head, *args))


def unchecked_condition(text: str, **columns: Expr) -> Condition:
    head, args = _filled(text, columns)
    return Condition(Expr("sql", (*head, *args), BOOLEAN), keeps=frozenset(a for c in args for a, _ in c.refs()))


# Lowering

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}
_SIGN: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def lower(e: Expr, swap: dict[tuple, Column] | None = None) -> Column:
    """The expression as a Spark column; swap: columns that stand for whole expressions, by their keys."""
    if swap and (found := swap.get(e.key())) is not None:
        return found
    low = lambda x: lower(x, swap)
    a = e.args
    match e.op:
        case "ref":
            return F.col(f"{quoted(a[0])}.{quoted(a[1])}")
        case "name":
            return F.col(quoted(a[0]))
        case "lit":
            return F.lit(a[0]).cast("timestamp_ntz") if isinstance(a[0], datetime.datetime) else F.lit(a[0])
        case "neg":
            return -low(a[0])
        case "+" | "-" | "*" | "/":
            return _SIGN[e.op](low(a[0]), low(a[1]))
        case "=" | "<>" | ">=" | "<=" | ">" | "<":
            return _COMPARE[e.op](low(a[0]), low(a[1]))
        case "between":
            return low(a[0]).between(low(a[1]), low(a[2]))
        case "in":
            return low(a[0]).isin(*a[1])
        case "not in":
            return ~low(a[0]).isin(*a[1])
        case "null":
            return low(a[0]).isNull()
        case "not null":
            return low(a[0]).isNotNull()
        case "contains":
            return low(a[0]).contains(a[1])
        case "starts":
            return low(a[0]).startswith(a[1])
        case "and":
            return reduce(lambda x, y: x & y, map(low, a))
        case "or":
            return reduce(lambda x, y: x | y, map(low, a))
        case "case":
            n = a[0]
            out = F.when(low(a[1]), low(a[2]))
            for k in range(1, n):
                out = out.when(low(a[1 + 2 * k]), low(a[2 + 2 * k]))
            return out if a[-1] is None else out.otherwise(low(a[-1]))
        case "coalesce":
            return F.coalesce(*map(low, a))
        case "week":
            return F.next_day(F.date_sub(low(a[0]).cast("date"), 7), "MO").cast("string")
        case "month":
            return F.trunc(low(a[0]).cast("date"), "MM").cast("string")
        case "call":
            out = F.call_function(a[0], *map(low, a[1:]))
            return out.cast("string") if a[0] in _AS_TEXT else out
        case "sql":
            text, names = a[0], a[1]
            for n, x in zip(names, a[2:], strict=True):
                if x.op != "ref":
                    raise GuardRefused("unchecked SQL takes plain columns only.")
                text = text.replace("{" + n + "}", f"{quoted(x.args[0])}.{quoted(x.args[1])}")
            return F.expr(text)
        case "agg":
            return _low_aggregate(e, low)
        case "over":
            return _low_window(e, low)
        case "is_total":
            raise GuardRefused("is_total() belongs to a statement with subtotals.")
    raise AssertionError(e.op)


def _low_aggregate(e: Expr, low: Callable[[Expr], Column]) -> Column:
    a = e.args
    if a[0] == "call":
        if a[1] in ("min_by", "max_by"):
            return _low_by(a[1], a[2], a[3], low)
        return F.call_function("var_pop" if a[1] == "variance" else a[1], *map(low, a[2:]))
    name, column, where = a
    value = None if column is None else low(column)
    if where is not None:
        value = F.when(low(where), F.lit(1) if value is None else value)
    match name:
        case "count":
            return F.count(F.lit(1) if value is None else value)
        case "count_distinct":
            return F.count_distinct(value)
    return getattr(F, name)(value)


def _low_by(name: str, of: Expr, by: Expr, low: Callable[[Expr], Column]) -> Column:
    """Of rows that tie, min_by and max_by take the least value that is not NULL: known numbers by size, all else by its
    text. Spark alone takes the row that it happens to meet last."""
    x, y = low(of), low(by)
    tie = [x if of.kind == NUMBER else x.cast("string")]
    if name == "max_by":  # the order of the values is turned round; of integers the least has no opposite
        down = F.try_subtract(F.lit(0), x) if of.kind == NUMBER else F.concat(F.translate(F.hex(tie[0]), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
        tie = [down.isNull(), down]
    missing = x.isNull() if name == "min_by" else x.isNotNull()
    return F.call_function(name, x, F.when(y.isNotNull(), F.struct(y, missing, *tie)))


def _low_window(e: Expr, low: Callable[[Expr], Column]) -> Column:
    inner, spec = e.args
    w = Window.partitionBy(*map(low, spec.partition))
    if spec.order:
        w = w.orderBy(*(low(o.expr).desc() if o.down else low(o.expr).asc() for o in spec.order))
    if spec.rows is not None:
        start, end = spec.rows
        w = w.rowsBetween(Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end)
    elif spec.by_range:
        w = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    if inner.op == "agg":
        return _low_aggregate(inner, low).over(w)
    name, *args = inner.args
    match name:
        case "row_number" | "rank" | "dense_rank":
            return getattr(F, name)().over(w)
        case "ntile":
            return F.ntile(args[0]).over(w)
        case "lag" | "lead":
            return getattr(F, name)(low(args[0]), args[1]).over(w)
    return getattr(F, name)(low(args[0])).over(w)
