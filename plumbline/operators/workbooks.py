"""Spreadsheet formulas of a table's columns, as columns and joins of a DataFrame.

A formula on its own row is an expression; a lookup is a left join, one for each table and key; totals by criteria over
the own table are windows, over another table one grouped join for all totals of the same keys, and with one comparison
or both ends of a range totals of sorted values (`compared_totals`); a total of a whole column is an aggregate joined as
one row, never a window over everything. The formulas that are added together share their joins.

What cannot be known from a table without an order (OFFSET, RAND, SORT and so on), and forms whose meaning would only be
guessed (DATEDIF in "ym", WEEKDAY from another day, SUBSTITUTE of one occurrence, TEXT of numbers), are NULL, with a note.
An error of a row (a division or MOD by zero, a root of a negative number, a text that is no number) is NULL; a book that
is `infinite` divides by zero as SQL's doubles do, except within IFERROR. Branches of text and of numbers are text, with
a note. Texts are equal case by case, but a criterion with * or ? ignores case, as spreadsheets do.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import compared_totals, value_ranks
from plumbline.sources.formulas import parse

#: Functions that are never guessed. Fixed names of the spreadsheet.
REFUSED = frozenset("INDIRECT OFFSET RAND RANDBETWEEN ROW ROWS MEDIAN FILTER UNIQUE SORT SORTBY SEQUENCE NETWORKDAYS LAMBDA LET".split())
_TOTALS = {"SUM": F.sum, "AVERAGE": F.avg, "COUNT": F.count, "COUNTA": F.count, "MIN": F.min, "MAX": F.max, "STDEV.S": F.stddev_samp, "VAR.S": F.var_samp}
_IFS = {"SUMIFS": "sum", "COUNTIFS": "count", "AVERAGEIFS": "avg", "MAXIFS": "max", "MINIFS": "min", "SUMIF": "sum", "COUNTIF": "count", "AVERAGEIF": "avg"}
#: Letters of TEXT's formats and Spark's. Fixed values.
_FORMAT = (("yyyy", "yyyy"), ("yy", "yy"), ("mmmm", "MMMM"), ("mmm", "MMM"), ("mm", "MM"), ("m", "M"), ("dddd", "EEEE"), ("ddd", "EEE"), ("dd", "dd"), ("d", "d"))
#: SUBTOTAL's numbers. Fixed values.
SUBTOTALS = {109: F.sum, 101: F.avg, 102: F.count, 103: F.count, 104: F.max, 105: F.min}


@dataclass
class Workbook:
    """Tables by name, their keys, defined names, and notes on what was not translated."""

    tables: dict[str, DataFrame]
    keys: dict[str, list[str]] = field(default_factory=dict)
    names: dict[str, object] = field(default_factory=dict)
    today: datetime.date | None = None
    first_match: bool = False  # whether a lookup with repeated keys takes one row, or repeats rows
    blanks: dict[str, dict[str, object]] = field(default_factory=dict)  # what a blank reads as, by table and column
    text_dates: dict[str, set[str]] = field(default_factory=dict)  # columns of dates as texts of 8 digits
    notes: list[str] = field(default_factory=list)
    infinite: bool = False  # whether a division by zero gives an infinity or NaN, or is an error of the row

    def read_cells(self, table: str) -> None:
        """Finds, in one pass, the columns with blanks, which formulas read as 0 or as an empty text, and the columns of
        texts that are all dates of 8 digits, which formulas read as dates."""
        df = self.tables[table]
        kinds = {c: _family(t) for c, t in df.dtypes}
        tests = [F.max(F.col(f"`{c}`").isNull()).alias(f"blank {c}") for c, k in kinds.items() if k in ("number", "text")]
        tests += [F.min(F.col(f"`{c}`").rlike(r"^\d{8}$")).alias(f"date {c}") for c, k in kinds.items() if k == "text"]
        found = df.agg(*tests).first().asDict() if tests else {}
        self.blanks[table] = {c: 0 if k == "number" else "" for c, k in kinds.items() if found.get(f"blank {c}")}
        self.text_dates[table] = {c for c in kinds if found.get(f"date {c}")}

    def add(self, table: str, **formulas: str) -> DataFrame:
        """The table with a column for each formula, also kept as the table."""
        trees = {name: parse(formula) for name, formula in formulas.items()}
        writer = _Writer(self, table, self.tables[table], list(trees.values()))
        for name, tree in trees.items():
            self.tables[table] = writer.add(name, tree)
        return self.tables[table]

    def typed_over(self, table: str, name: str, formula: str, values: dict) -> DataFrame:
        """A formula's column where some rows, by their key, hold typed values."""
        df = self.add(table, **{name: formula})
        (key,) = self.keys[table]
        out = F.col(name)
        for k, v in values.items():
            out = F.when(F.col(key) == k, v).otherwise(out)
        self.tables[table] = df.withColumn(name, out)
        return self.tables[table]

    def total_row(self, table: str, **columns: tuple[str, int]) -> DataFrame:
        """One row of SUBTOTALs: output name to (column, SUBTOTAL number)."""
        return self.tables[table].agg(*[SUBTOTALS[n](F.col(c)).alias(name) for name, (c, n) in columns.items()])


def _family(dtype: str) -> str:
    return "date" if dtype.startswith(("date", "timestamp")) else "text" if dtype.startswith(("string", "varchar", "char")) else "bool" if dtype == "boolean" else "number" if dtype.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) else "unknown"


#: What functions give. Fixed names of the spreadsheet.
_GIVES = {
    "text": "UPPER LOWER TRIM PROPER LEFT RIGHT MID CONCAT CONCATENATE TEXTJOIN TEXT SUBSTITUTE".split(), "date": "DATE TODAY EOMONTH EDATE".split(), "bool": "AND OR NOT ISBLANK ISNUMBER".split(),
    "number": "ABS SQRT POWER LEN INT YEAR MONTH DAY MOD ROUND VALUE WEEKDAY DATEDIF FIND SEARCH RANK RANK.EQ SUMPRODUCT SUM AVERAGE COUNT COUNTA SUMIF SUMIFS COUNTIF COUNTIFS AVERAGEIF AVERAGEIFS".split(),
}
_KIND = {n: k for k, names in _GIVES.items() for n in names}


class _Writer:
    """Adds formulas to a table. Columns of joins are kept from formula to formula and left out of what is given."""

    def __init__(self, book: Workbook, table: str, df: DataFrame, trees: list[tuple]):
        self.book, self.table, self.df, self.own, self.made = book, table, df, list(df.columns), 0
        self.trees = trees
        self.shared: dict[tuple, str] = {}
        self.as_is = 0  # within a form that skips blanks
        self.caught = 0  # within a form that replaces errors

    def add(self, name: str, tree: tuple) -> DataFrame:
        self.merge_totals()
        value = self.value(tree)
        at = self.trees.index(tree)
        del self.trees[at]
        self.df = self.df.withColumn(name, value)
        self.own = [c for c in self.own if c != name] + [name]
        self.shared = {k: v for k, v in self.shared.items() if repr(("cell", None, name, False)) not in repr(k)}  # these read the column as it was
        return self.df.select(*[f"`{c}`" for c in self.own])

    def fresh(self) -> str:
        self.made += 1
        return f"__x{self.made}"

    def note(self, text: str) -> Column:
        """Notes what is not translated; it is NULL."""
        self.book.notes.append(f"{text}: NULL")
        return F.lit(None).cast("double")

    def kind(self, tree: tuple) -> str:
        """date, text, number, bool or unknown, from columns and functions."""
        match tree:
            case ("cell", t, c, _):
                own = t in (None, self.table)
                if own and c in self.book.text_dates.get(self.table, ()):
                    return "text"
                return _family(dict((self.df if own else self.book.tables[t]).dtypes).get(c, ""))
            case ("call", "IF", args):
                return self.one_kind(args[1:])
            case ("call", "IFERROR" | "IFNA", args):
                return self.one_kind(args)
            case ("call", "IFS", args):
                return self.one_kind(args[1::2])
            case ("call", "SWITCH", args):
                return self.one_kind(args[2::2] + (args[-1:] if len(args) % 2 == 0 else []))
            case ("call", "MAX" | "MIN", args):
                return self.one_kind(args)
            case ("call", "XLOOKUP", [_, _, ("cell", t, c, _), *_]) | ("call", "INDEX", [("cell", t, c, _), *_]):
                return _family(dict(self.book.tables[t].dtypes).get(c, "")) if t in self.book.tables else "unknown"
            case ("call", n, _):
                return _KIND.get(n, "unknown")
            case ("op", "+" | "-", a, b):
                return "date" if self.dated(a) != self.dated(b) else "number"
            case ("op", "&", _, _):
                return "text"
            case ("op", "=" | "<>" | "<" | ">" | "<=" | ">=", _, _):
                return "bool"
            case ("op" | "neg" | "pct" | "num" | "empty", *_):
                return "number"
            case ("text" | "bool", _):
                return tree[0]
            case ("name", n):
                v = self.book.names.get(n)
                return "text" if isinstance(v, str) else "bool" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "unknown"
        return "unknown"

    def one_kind(self, trees: list[tuple]) -> str:
        kinds = {self.kind(t) for t in trees} - {"unknown"}
        return kinds.pop() if len(kinds) == 1 else "text" if kinds else "unknown"

    def alike(self, n: str, trees: list[tuple]) -> list[Column]:
        """Values of branches; of several kinds they are text."""
        values = [self.value(t) for t in trees]
        kinds = {self.kind(t) for t in trees} - {"unknown"}
        if len(kinds) > 1:
            self.book.notes.append(f"{n} gives {' and '.join(sorted(kinds))}: text")
            values = [v.cast("string") for v in values]
        return values

    def cell(self, c: str) -> Column:
        """A column of the row; a blank reads as 0 or an empty text where the table's cells were read."""
        blank = self.book.blanks.get(self.table, {}).get(c)
        column = F.col(f"`{c}`")
        return column if blank is None or self.as_is else F.coalesce(column, F.lit(blank))

    def dated(self, tree: tuple) -> bool:
        """Whether arithmetic reads a value as a date."""
        return self.kind(tree) == "date" or tree[0] == "cell" and tree[1] in (None, self.table) and tree[2] in self.book.text_dates.get(self.table, ())

    def date(self, tree: tuple) -> Column:
        """A value as a date; a column of dates as texts of 8 digits is made one here."""
        if tree[0] == "cell" and tree[1] in (None, self.table) and tree[2] in self.book.text_dates.get(self.table, ()):
            return F.try_to_date(F.col(f"`{tree[2]}`"), "yyyyMMdd")
        return self.value(tree).try_cast("date") if self.kind(tree) == "text" else self.value(tree).cast("date")

    def value(self, tree: tuple) -> Column:
        v = self.value
        match tree:
            case ("num" | "text" | "bool", x):
                return F.lit(x)
            case ("empty",):
                return F.lit(0)
            case ("neg", x):
                return -v(x)
            case ("pct", x):
                return F.try_divide(v(x), F.lit(100))
            case ("name", n):
                if n in self.book.names:
                    return F.lit(self.book.names[n])
                raise ValueError(f"{n} is no defined name")
            case ("cell", t, c, whole):
                if whole and t is not None:
                    raise ValueError(f"{t}[{c}] is a whole column where one value is needed")
                return self.cell(c)
            case ("op", sign, a, b):
                return self.operator(sign, a, b)
            case ("call", n, args):
                return self.call(n, args)
        raise ValueError(f"cannot translate {tree}")

    def operator(self, sign: str, a: tuple, b: tuple) -> Column:
        # The first of a month, and the Monday of a week, as they are written.
        if sign == "+" and b == ("num", 1):
            match a:
                case ("call", "EOMONTH", [d, ("neg", ("num", 1))]):
                    return F.trunc(self.date(d), "MM")
                case ("op", "-", d, ("call", "WEEKDAY", [e, ("num", 2)])) if d == e:
                    return F.next_day(F.date_sub(self.date(d), 7), "MO")
        if sign == "+" and (merged := _merged(a, b)) is not None:
            return self.value(merged)
        dates = self.dated(a), self.dated(b)
        if sign in "+-" and any(dates):
            if sign == "-" and all(dates):
                return F.datediff(self.date(a), self.date(b))
            if dates[0] and not dates[1]:
                return (F.date_add if sign == "+" else F.date_sub)(self.date(a), self.value(b).cast("int"))
            if sign == "+" and not dates[0]:
                return F.date_add(self.date(b), self.value(a).cast("int"))
        x, y = self.value(a), self.value(b)
        if sign in "+-*/^" and sign:
            x, y = (z.try_cast("double") if self.kind(t) == "text" else z for z, t in ((x, a), (y, b)))
        match sign:
            case "+":
                return x + y
            case "-":
                return x - y
            case "*":
                return x * y
            case "/":
                if self.book.infinite and not self.caught:
                    x, y = x.cast("double"), y.cast("double")
                    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(F.try_divide(x, y))  # the power keeps the sign of a zero
                return F.try_divide(x, y)
            case "^":
                return F.pow(x, y)
            case "&":
                return F.concat(*(F.coalesce(z.cast("string"), F.lit("")) for z in (x, y)))
        if {self.kind(a), self.kind(b)} == {"text", "number"}:  # never equal, and a text is the greater
            self.book.notes.append(f"{sign} compares a text with a number: as texts")
            x, y = x.cast("string"), y.cast("string")
        return _compared(sign, x, y)

    def call(self, n: str, args: list[tuple]) -> Column:
        if n in REFUSED:
            return self.note(f"{n} is not translated")
        if n in _IFS:
            return self.ifs(n, args)
        if n in _TOTALS and len(args) == 1 and args[0][0] == "cell" and args[0][3]:
            return self.whole(n, args[0])
        if n in ("XLOOKUP", "VLOOKUP", "INDEX"):
            return self.lookup(n, args)
        if n in ("RANK", "RANK.EQ"):
            return self.rank(args)
        if n == "SUMPRODUCT":
            return self.sumproduct(args[0])
        if n == "ISNUMBER":
            if args[0][0] == "call" and args[0][1] in ("FIND", "SEARCH"):
                return self.value(args[0]) > 0
            return F.lit(self.kind(args[0]) in ("number", "date")) & self.value(args[0]).isNotNull()
        if n == "ISBLANK":
            self.as_is += 1
            try:
                return self.value(args[0]).isNull()
            finally:
                self.as_is -= 1
        if n in ("IFERROR", "IFNA"):
            self.caught += 1
            try:
                return F.coalesce(*self.alike(n, args))
            finally:
                self.caught -= 1
        if n in ("IF", "IFS", "SWITCH"):
            return self.choice(n, args)
        if n in ("MAX", "MIN"):
            values = self.alike(n, args)
            return (F.greatest if n == "MAX" else F.least)(*values) if len(values) > 1 else values[0]
        if n in ("YEAR", "MONTH", "DAY", "WEEKDAY", "DATEDIF", "EOMONTH", "EDATE", "TEXT"):
            return self.of_dates(n, args)
        return self.scalar(n, [self.value(a) for a in args], args)

    def choice(self, n: str, args: list[tuple]) -> Column:
        if n == "IF":
            tests, given, rest = [args[0]], [args[1]], args[2] if len(args) > 2 else ("bool", False)
        elif n == "IFS":
            tests, given, rest = args[::2], args[1::2], None
        else:
            odd = len(args) % 2 == 0
            tests, given, rest = [("op", "=", args[0], t) for t in (args[1:-1] if odd else args[1:])[::2]], (args[1:-1] if odd else args[1:])[1::2], args[-1] if odd else None
        values = self.alike(n, given + ([rest] if rest is not None else []))
        out = None
        for t, v in zip(tests, values, strict=False):
            test = self.value(t) if self.kind(t) in ("bool", "unknown") else self.value(t) != 0
            out = F.when(test, v) if out is None else out.when(test, v)
        return out if rest is None else out.otherwise(values[-1])

    def of_dates(self, n: str, args: list[tuple]) -> Column:
        day = self.date(args[0])
        match n:
            case "YEAR":
                return F.year(day)
            case "MONTH":
                return F.month(day)
            case "DAY":
                return F.dayofmonth(day)
            case "WEEKDAY":
                if len(args) > 1 and args[1] not in (("num", 1), ("empty",)):
                    return self.note("WEEKDAY counting from another day than Sunday is not translated")
                return F.dayofweek(day)
            case "DATEDIF":
                end, unit = self.date(args[1]), str(args[2][1]).lower() if args[2][0] == "text" else ""
                if unit == "d":
                    return F.datediff(end, day)
                if unit not in ("m", "y"):
                    return self.note(f"DATEDIF in {unit!r} is not translated")
                return F.floor(F.months_between(end, day) / (12 if unit == "y" else 1))
            case "EOMONTH":
                return F.last_day(F.add_months(day, self.value(args[1]).cast("int")))
            case "EDATE":
                return F.add_months(day, self.value(args[1]).cast("int"))
        shown = args[1][1].lower() if args[1][0] == "text" else ""
        if self.kind(args[0]) not in ("date", "text") or not re.fullmatch(r"[ymd\-/. ,]*[ymd][ymd\-/. ,]*", shown):
            return self.note(f"TEXT in the format {shown!r} is not translated").cast("string")
        out, at = "", 0
        while at < len(shown):
            word = next((w for w in _FORMAT if shown.startswith(w[0], at)), (shown[at], shown[at]))
            out, at = out + word[1], at + len(word[0])
        return F.date_format(day, out)

    def scalar(self, n: str, a: list[Column], trees: list[tuple]) -> Column:
        one: dict[str, Callable[..., Column]] = {
            "ABS": F.abs, "POWER": F.pow, "LEN": F.length, "UPPER": F.upper, "LOWER": F.lower, "TRIM": F.trim, "PROPER": F.initcap, "INT": F.floor, "NOT": lambda x: ~x,
            "SQRT": lambda x: F.when(x >= 0, F.sqrt(x)), "MOD": lambda x, y: F.pmod(x, F.nullif(y, F.lit(0))), "VALUE": lambda x: x.try_cast("double"),
        }
        if n in one:
            return one[n](*a)
        match n:
            case "SUBSTITUTE":
                return F.replace(*a) if len(a) == 3 else self.note("SUBSTITUTE of one occurrence is not translated").cast("string")
            case "ROUND":
                digits = trees[1] if len(trees) > 1 else ("num", 0)
                places = digits[1] if digits[0] == "num" else 0 if digits[0] == "empty" else -digits[1][1] if digits[0] == "neg" and digits[1][0] == "num" else None
                return F.round(a[0], places) if isinstance(places, int) else self.note("ROUND to a number of places that is no constant is not translated")
            case "AND" | "OR":
                out = a[0]
                for x in a[1:]:
                    out = out & x if n == "AND" else out | x
                return out
            case "LEFT":
                return F.substr(a[0], F.lit(1), a[1] if len(a) > 1 else F.lit(1))
            case "RIGHT":
                return F.right(a[0], a[1] if len(a) > 1 else F.lit(1))
            case "MID":
                return F.substr(a[0], a[1], a[2])
            case "FIND" | "SEARCH":
                low = F.lower if n == "SEARCH" else (lambda x: x)
                start = a[2].cast("int") if len(a) > 2 and trees[2] != ("empty",) else F.lit(1)
                return F.call_function("locate", low(a[0]), low(a[1]), start)
            case "CONCAT" | "CONCATENATE":
                return F.concat(*(F.coalesce(x.cast("string"), F.lit("")) for x in a))
            case "TEXTJOIN":
                if trees[1] in (("bool", False), ("num", 0)):
                    return F.concat_ws(trees[0][1], *(F.coalesce(x.cast("string"), F.lit("")) for x in a[2:]))
                return F.concat_ws(trees[0][1], *(F.nullif(x.cast("string"), F.lit("")) for x in a[2:]))
            case "TODAY":
                return F.lit(self.book.today) if self.book.today else F.current_date()
            case "DATE":
                # Months and days beyond a year or month run on, as in the spreadsheet.
                year, month, day = (x.try_cast("int") for x in a)
                return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)
        return self.note(f"{n} is not known")

    # Other rows

    @staticmethod
    def lookup_parts(n: str, args: list[tuple], book: Workbook) -> tuple | None:
        """Table, its key column, the column that is given, and the tree that is looked up; None for forms that are not
        of one table."""
        try:
            if n == "XLOOKUP":
                key, (_, t, k, _), (_, _, c, _) = args[:3]
            elif n == "INDEX":
                (_, t, c, _), (_, _, match) = args[:2]
                key, (_, _, k, _) = match[:2]
            else:
                key, table, (_, place) = args[:3]
                t = table[1] if table[0] in ("name", "cell") else None
                k, c = book.tables[t].columns[0], book.tables[t].columns[place - 1]
        except (ValueError, KeyError, IndexError, TypeError):
            return None
        return (t, k, c, key) if t in book.tables else None

    def lookup(self, n: str, args: list[tuple]) -> Column:
        """A left join on the looked-up key, one for all columns that formulas take by it. Of repeated keys one row, the
        least by the table's key, or all of them with a note."""
        default = args[3] if n == "XLOOKUP" and len(args) > 3 else None
        plain = {"XLOOKUP": args[4:], "INDEX": args[1][2][2:] if len(args) > 1 and args[1][0] == "call" else [], "VLOOKUP": []}[n]
        if any(x not in (("num", 0), ("num", 1), ("empty",)) or n == "INDEX" and x != ("num", 0) or n == "XLOOKUP" and i == 0 and x == ("num", 1) for i, x in enumerate(plain)):
            return self.note(f"{n} of another kind of match than an exact one from the start is not translated")
        if (found := self.lookup_parts(n, args, self.book)) is None:
            return self.note(f"{n} of more than one table's columns is not translated")
        t, k, c, key = found
        if t.lower() == "parameters" and self.constant(key):
            return self.parameter(t, k, c, key)
        if n == "VLOOKUP" and (len(args) < 4 or args[3] in (("bool", True), ("num", 1))):
            self.book.notes.append("an approximate VLOOKUP was read as an exact one")
        at = ("lookup", t, k, repr(key))
        if (*at, c) not in self.shared:
            columns = {c: None}
            for tree in self.trees:
                for x in _calls(tree, ("XLOOKUP", "VLOOKUP", "INDEX")):
                    other = self.lookup_parts(x[1], x[2], self.book)
                    if other is not None and (other[0], other[1], repr(other[3])) == (t, k, repr(key)):
                        columns[other[2]] = None
            kn = self.fresh()
            names = {x: self.fresh() for x in columns}
            right = self.book.tables[t]
            if self.book.keys.get(t) != [k]:
                if self.book.first_match:
                    order = [f"`{x}`" for x in self.book.keys.get(t) or right.columns]
                    row = F.min_by(F.struct(*[F.col(f"`{x}`").alias(y) for x, y in names.items()]), F.struct(*order))
                    right = right.groupBy(F.col(f"`{k}`").alias(kn)).agg(row.alias("__row")).select(kn, "__row.*")
                else:
                    self.book.notes.append(f"{t}[{k}] may repeat: a row may meet several")
                    right = right.select(F.col(f"`{k}`").alias(kn), *[F.col(f"`{x}`").alias(y) for x, y in names.items()])
            else:
                right = right.select(F.col(f"`{k}`").alias(kn), *[F.col(f"`{x}`").alias(y) for x, y in names.items()])
            self.df = self.df.join(right, self.value(key) == F.col(kn), "left")
            self.shared |= {(*at, x): y for x, y in names.items()}
        found = F.col(self.shared[(*at, c)])
        if default is None or default == ("empty",):
            return found
        if {self.kind(("call", n, args[:3])), self.kind(default)} == {"text", "number"}:
            self.book.notes.append(f"{n} gives number and text: text")
            return F.coalesce(found.cast("string"), self.value(default).cast("string"))
        return F.coalesce(found, self.value(default))

    def parameter(self, t: str, k: str, c: str, key: tuple) -> Column:
        """A value of the table Parameters by its name, written into the plan."""
        rows = self.book.tables[t].where(F.lower(F.col(f"`{k}`")) == F.lower(self.value(key))).select(f"`{c}`").take(1)
        if not rows:
            return self.note(f"{t} has no {key[1]}")
        self.book.notes.append(f"{key[1]} is {rows[0][0]}, from {t}: a change there is not followed")
        return F.lit(rows[0][0])

    def criteria(self, args: list[tuple]) -> list[tuple[str, str, str, tuple]]:
        """(table, column, sign, value tree) of each pair."""
        out = []
        for (_, t, c, _), test in zip(args[::2], args[1::2], strict=True):
            sign, value = "=", test
            if test[0] == "text" and (m := re.match(r"(<=|>=|<>|<|>|=)(.*)", test[1], re.S)):
                sign, value = m[1], ("num", float(m[2])) if re.fullmatch(r"-?\d+(\.\d+)?", m[2]) else ("text", m[2])
            elif test[0] == "op" and test[1] == "&" and test[2][0] == "text" and test[2][1] in ("<=", ">=", "<>", "<", ">", "="):
                sign, value = test[2][1], test[3]
            out.append((t or self.table, c, sign, value))
        return out

    @staticmethod
    def constant(tree: tuple) -> bool:
        return tree[0] in ("num", "text", "bool", "name", "any")

    def tested(self, column: Column, sign: str, value: Column | None, tree: tuple) -> Column:
        if tree[0] == "any":
            return column.isin(*tree[1])
        if tree[0] == "text" and sign in ("=", "<>") and re.search(r"[*?]", tree[1]):
            like = F.lower(column).like("".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_"}.get(ch, ch) for ch in tree[1].lower()))
            return like if sign == "=" else ~F.coalesce(like, F.lit(False))
        if sign == "<>":
            return ~F.coalesce(column == value, F.lit(False))
        return _compared(sign, column, value)

    def wanted(self, tree: tuple) -> Column | None:
        return None if tree[0] == "any" else self.value(tree)

    def held(self, tests: list, column: Callable[[str], Column]) -> Column | None:
        """The criteria that are constant, as one condition."""
        where = None
        for _, c, s, v in tests:
            if self.constant(v):
                one = self.tested(column(c), s, self.wanted(v), v)
                where = one if where is None else where & one
        return where

    def split_ifs(self, n: str, args: list[tuple]) -> tuple[tuple | None, list]:
        if n in ("SUMIF", "AVERAGEIF"):
            return (args[2] if len(args) > 2 else args[0]), self.criteria(args[:2])
        if n.startswith("COUNT"):
            return None, self.criteria(args)
        return args[0], self.criteria(args[1:])

    def total(self, kind: str, column: Column | None, where: Column | None) -> Column:
        x = F.lit(1) if column is None else column
        x = x if where is None else F.when(where, x)
        return {"sum": F.sum, "count": F.count, "avg": F.avg, "max": F.max, "min": F.min}[kind](x)

    def merge_totals(self) -> None:
        """Totals of one table by the same keys, in any of the formulas that are left, are read once: their grouped join
        is made as soon as the table has the keys."""
        found: dict[tuple, list] = {}
        for tree in self.trees:
            for t in _calls(tree, _IFS):
                of, tests = self.split_ifs(t[1], t[2])
                tables = {x[0] for x in tests}
                if ("ifs", repr(t)) in self.shared or len(tables) != 1 or (other := next(iter(tables))) == self.table:
                    continue
                keys = tuple((c, repr(v)) for _, c, s, v in tests if not self.constant(v))
                there = all(c[2] in self.df.columns for _, _, _, v in tests for c in _cells(v) if c[1] in (None, self.table))
                if keys and there and all(s == "=" or self.constant(v) for _, _, s, v in tests) and repr(t) not in {repr(u[0]) for u in found.get((other, keys), ())}:
                    found.setdefault((other, keys), []).append((t, of, tests))
        for (other, _), uses in found.items():
            moving = [(c, v) for _, c, s, v in uses[0][2] if not self.constant(v)]
            names = [self.fresh() for _ in moving]
            aggs = []
            for t, of, tests in uses:
                name = self.shared[("ifs", repr(t))] = self.fresh()
                aggs.append(self.total(_IFS[t[1]], None if of is None else F.col(f"`{of[2]}`"), self.held(tests, lambda c: F.col(f"`{c}`"))).alias(name))
            grouped = self.book.tables[other].groupBy(*[F.col(f"`{c}`").alias(k) for k, (c, _) in zip(names, moving, strict=True)]).agg(*aggs)
            on = [self.value(v) == F.col(k) for k, (_, v) in zip(names, moving, strict=True)]
            self.df = self.df.join(grouped, on, "left")

    def ifs(self, n: str, args: list[tuple]) -> Column:
        tree, kind = ("call", n, args), _IFS[n]
        empty = (lambda c: c) if kind == "avg" else (lambda c: F.coalesce(c, F.lit(0)))
        if (name := self.shared.get(("ifs", repr(tree)))) is not None:
            return empty(F.col(name))
        of, tests = self.split_ifs(n, args)
        other = tests[0][0]
        plain = lambda c: F.col(f"`{c}`")
        value = None if of is None else plain(of[2])
        if other == self.table and all(s == "=" and v[0] == "cell" and v[2] == c or self.constant(v) for _, c, s, v in tests):
            moving = [c for _, c, _, v in tests if not self.constant(v)]
            if moving:
                return empty(self.total(kind, value, self.held(tests, plain)).over(Window.partitionBy(*map(plain, moving))))
        if all(self.constant(v) for _, _, _, v in tests):
            name = self.shared[("ifs", repr(tree))] = self.fresh()
            self.df = self.df.crossJoin(F.broadcast(self.book.tables[other].agg(self.total(kind, value, self.held(tests, plain)).alias(name))))
            return empty(F.col(name))
        if (name := self.compared(kind, of, tests, other)) is None:
            name = self.joined(kind, of, tests, other)
        self.shared[("ifs", repr(tree))] = name
        return empty(F.col(name))

    def compared(self, kind: str, of: tuple | None, tests: list, other: str) -> str | None:
        """Totals with one comparison, or both ends of a range of one column, by sorted values; None for other forms."""
        moving = [(c, s, v) for _, c, s, v in tests if not self.constant(v)]
        same, ordered = [(c, v) for c, s, v in moving if s == "="], [(c, s, v) for c, s, v in moving if s != "="]
        signs = sorted(s for _, s, _ in ordered)
        both = len(ordered) == 2 and signs[0][0] == "<" and signs[1][0] == ">" and ordered[0][0] == ordered[1][0] and kind in ("sum", "count", "avg")
        if not (len(ordered) == 1 and signs[0] != "<>" or both):
            return None
        right = self.book.tables[other]
        family = _family(dict(right.dtypes)[ordered[0][0]])
        if any(self.kind(v) != family for _, _, v in ordered) or family not in ("number", "date", "text"):
            return None
        where = self.held(tests, lambda c: F.col(f"`{c}`"))
        rows = right if where is None else right.where(where)
        names = [f"__k{i}" for i in range(len(same))]
        source = rows.select(*[F.col(f"`{c}`").alias(k) for k, (c, _) in zip(names, same, strict=True)], F.col(f"`{ordered[0][0]}`").alias("c"), (F.lit(1) if of is None else F.col(f"`{of[2]}`")).alias("v"))
        keys = [self.fresh() for _ in same]
        found: dict[str, str] = {}
        parts = ("sum", "count") if both and kind == "avg" else (kind,)

        def add(sign: str, v: tuple, part: str) -> str:
            total, x = self.fresh(), self.fresh()
            asked = self.df.select(*[self.value(w).alias(k) for k, (_, w) in zip(names, same, strict=True)], self.value(v).alias("x"))
            made = compared_totals(asked, source, names, sign, part, total).withColumnsRenamed({"x": x, **dict(zip(names, keys, strict=True))})
            on = self.value(v) == F.col(x)
            for k, (_, w) in zip(keys, same, strict=True):
                on = on & self.value(w).eqNullSafe(F.col(k))
            self.df = self.df.join(made, on, "left").drop(x, *keys)
            return total

        if not both:
            return add(ordered[0][1], ordered[0][2], kind)
        (_, up, high), (_, down, low) = sorted(ordered, key=lambda o: o[1])
        # Rows up to the higher end less those before the lower one; none where the ends cross.
        before = "<" if down == ">=" else "<="
        for part in parts:
            a, b = add(up, high, part), add(before, low, part)
            found[part] = self.fresh()
            held = F.when(self.value(low) <= self.value(high), F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0)))
            held = F.when(self.value(low).isNotNull() & self.value(high).isNotNull(), held)
            self.df = self.df.withColumn(found[part], F.greatest(held, F.lit(0)) if part == "count" else held)
        if kind != "avg":
            return found[kind]
        name = self.fresh()
        self.df = self.df.withColumn(name, F.try_divide(F.col(found["sum"]), F.col(found["count"])))
        return name

    def joined(self, kind: str, of: tuple | None, tests: list, other: str) -> str:
        """Totals with other comparisons: a range join, grouped by the rows' key and joined back."""
        key = self.book.keys[self.table]
        right = self.book.tables[other]
        renamed = {c: self.fresh() for c in right.columns}
        right = right.select(*[F.col(f"`{c}`").alias(r) for c, r in renamed.items()])
        on = [self.tested(F.col(renamed[c]), s, self.wanted(v), v) for _, c, s, v in tests]
        name = self.fresh()
        back = {k: self.fresh() for k in key}
        grouped = self.df.join(right, on, "inner").groupBy(*[F.col(f"`{k}`").alias(b) for k, b in back.items()]).agg(self.total(kind, None if of is None else F.col(renamed[of[2]]), None).alias(name))
        self.df = self.df.join(grouped, [F.col(f"`{k}`") == F.col(b) for k, b in back.items()], "left")
        return name

    def whole(self, n: str, cell: tuple) -> Column:
        at = ("whole", n, cell[1] or self.table, cell[2])
        if at not in self.shared:
            name = self.fresh()
            source = self.book.tables[cell[1] or self.table]
            self.df = self.df.crossJoin(F.broadcast(source.agg(_TOTALS[n](F.col(f"`{cell[2]}`")).alias(name))))
            self.shared[at] = name
        return F.col(self.shared[at])

    def rank(self, args: list[tuple]) -> Column:
        down = len(args) < 3 or args[2] in (("num", 0), ("empty",))
        c = F.col(f"`{args[1][2]}`")
        vn, rn = self.fresh(), self.fresh()
        self.df = self.df.join(value_ranks(self.book.tables[self.table], c, down, vn, rn), self.value(args[0]) == F.col(vn), "left")
        return F.col(rn)

    def sumproduct(self, tree: tuple) -> Column:
        """Conditions by * (and) and + (or), and at most one column of values."""
        source = {c[1] or self.table for c in _cells(tree)}
        if len(source) != 1:
            raise ValueError("SUMPRODUCT reads one table")
        df = self.book.tables[next(iter(source))]

        def number(t: tuple) -> Column:
            match t:
                case ("op", "*", a, b):
                    return number(a) * number(b)
                case ("op", "+", a, b):
                    return (number(a) + number(b) > 0).cast("int") if _is_test(a) and _is_test(b) else number(a) + number(b)
                case ("op", sign, a, b) if sign in ("=", "<>", "<", ">", "<=", ">="):
                    x, y = number(a), number(b)
                    return F.coalesce({"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[sign], F.lit(False)).cast("int")
                case ("neg", x):
                    return -number(x)
                case ("cell", _, c, _):
                    return F.col(f"`{c}`")
            return self.value(t)

        name = self.fresh()
        self.df = self.df.crossJoin(F.broadcast(df.agg(F.coalesce(F.sum(number(tree)), F.lit(0)).alias(name))))
        return F.col(name)


def _compared(sign: str, x: Column, y: Column) -> Column:
    return {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[sign]()


def _calls(t: tuple, names) -> Iterator[tuple]:
    """Calls of the functions in a tree, outer ones first."""
    if t[0] == "call" and t[1] in names:
        yield t
    for x in t[1:]:
        for y in x if isinstance(x, list) else [x]:
            if isinstance(y, tuple) and y and isinstance(y[0], str):
                yield from _calls(y, names)


def _merged(a: tuple, b: tuple) -> tuple | None:
    """Two totals by criteria that are added and differ in one constant, as one total of rows with any of its values."""
    if a[0] == "op" and a[1] == "+":
        a = _merged(a[2], a[3]) or a
    if not (a[0] == b[0] == "call" and a[1] == b[1] and a[1] in ("SUMIFS", "COUNTIFS", "SUMIF", "COUNTIF") and len(a[2]) == len(b[2])):
        return None
    differing = [i for i, (x, y) in enumerate(zip(a[2], b[2], strict=True)) if x != y]
    if len(differing) != 1:
        return None
    x, y = a[2][differing[0]], b[2][differing[0]]
    old = x[1] if x[0] == "any" else (x[1],)
    if x[0] not in ("any", "num", "text") or y[0] not in ("num", "text") or y[1] in old or any(isinstance(v, str) and re.match(r"[<>=]|.*[*?~]", v) for v in (*old, y[1])):
        return None
    return ("call", a[1], [*a[2][: differing[0]], ("any", (*old, y[1])), *a[2][differing[0] + 1 :]])


def _is_test(t: tuple) -> bool:
    return t[0] == "op" and (t[1] in ("=", "<>", "<", ">", "<=", ">=") or t[1] in "*+" and _is_test(t[2]) and _is_test(t[3]))


def _cells(t: tuple) -> list[tuple]:
    if t[0] == "cell":
        return [t]
    if t[0] == "any":
        return []
    return [c for x in t[1:] for y in (x if isinstance(x, list) else [x]) if isinstance(y, tuple) and y for c in _cells(y)]
