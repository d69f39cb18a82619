"""Pivot tables as one table at the finest grain: groups, summaries, then what is shown as shares, ranks or differences."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.errors import GuardRefused
from plumbline.sources.formulas import parse

SUMMARY = {"sum": F.sum, "count": F.count, "count numbers": lambda c: F.count(c.try_cast("double")), "average": F.avg, "max": F.max, "min": F.min, "stddev": F.stddev_samp, "stddevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop, "distinct": F.count_distinct}
#: Ways of showing that are not translated.
REFUSED = frozenset(["index", "% of parent", "% running total", "product"])


@dataclass(frozen=True)
class Field:
    """A row or column field: a source column, grouped by date part, number bins or by hand."""

    column: str
    name: str | None = None
    part: str | None = None  # years, quarters, months or days
    bins: tuple[float, float, float] | None = None  # start, end, width
    groups: Mapping[str, tuple] | None = None

    @property
    def output(self) -> str:
        return self.name or self.column

    def expression(self) -> Column:
        c = F.col(f"`{self.column}`")
        match self.part:
            case "years":
                return F.year(c)
            case "quarters":
                return F.concat(F.lit("Qtr"), F.quarter(c).cast("string"))
            case "months":
                return F.date_format(c, "MMM")
            case "days":
                return F.date_format(c, "d-MMM")
        if self.bins:
            start, end, width = self.bins
            low = F.floor((c - start) / width) * width + start
            whole = lambda x: x.cast("long").cast("string")
            return F.when(c < start, f"<{start:g}").when(c > end, f">{end:g}").otherwise(F.concat(whole(low), F.lit("-"), whole(low + width - 1)))
        if self.groups:
            out = c.cast("string")
            for name, values in self.groups.items():
                out = F.when(c.isin(*values), name).otherwise(out)
            return out
        return c


@dataclass(frozen=True)
class Value:
    """A summary of a column or a formula over sums, and how it is shown."""

    name: str
    column: str | None = None
    how: str = "sum"
    formula: str | None = None  # SQL over sums of columns, as sum_<column>
    show: str | None = None  # % of total, % of row, % of column, running total, rank, rank down, difference, % difference, % of
    base: str | None = None  # the field a running total, rank or difference goes along
    item: object = None  # the base item of a difference


@dataclass(frozen=True)
class Pivot:
    rows: tuple[Field, ...]
    columns: tuple[Field, ...] = ()
    values: tuple[Value, ...] = ()
    keep: Mapping[str, tuple] = field(default_factory=dict)  # shown items by column; None stands for blank
    drop: Mapping[str, tuple] = field(default_factory=dict)  # hidden items
    between: Mapping[str, tuple] = field(default_factory=dict)  # timelines
    top: tuple[str, int, str] | None = None  # field, n (below zero: bottom), summed column
    items: Mapping[str, Mapping[str, str]] = field(default_factory=dict)  # calculated items, by field: name to a formula over its items

    def filtered(self, df: DataFrame) -> DataFrame:
        for c, items in self.keep.items():
            test = F.col(c).isin(*[i for i in items if i is not None])
            df = df.where(F.coalesce(test, F.lit(None in items)) if None in items else test)
        for c, items in self.drop.items():
            test = ~F.col(c).isin(*[i for i in items if i is not None])
            df = df.where(test if None in items else F.coalesce(test, F.lit(True)))
        for c, (low, high) in self.between.items():
            df = df.where(F.col(c).between(low, high))
        if self.top:
            c, n, of = self.top
            totals = df.groupBy(c).agg(F.sum(of).alias("__t"))
            order = F.col("__t").desc() if n > 0 else F.col("__t").asc()
            # Ties are kept: every item whose total is no worse than the n-th; finding that one sorts n rows.
            last = totals.orderBy(order).limit(abs(n)).agg((F.min if n > 0 else F.max)("__t").alias("__last"))
            best = totals.crossJoin(F.broadcast(last)).where("__t >= __last" if n > 0 else "__t <= __last").select(F.col(c).alias("__c"))
            df = df.join(best, F.col(c).eqNullSafe(F.col("__c")), "left_semi")
        return df

    def lower(self, df: DataFrame) -> DataFrame:
        for v in self.values:
            if v.how in REFUSED or v.show in REFUSED:
                raise GuardRefused(f"{v.name}: {v.how if v.how in REFUSED else v.show} is not translated.")
        df = self.filtered(df)
        fields = [*self.rows, *self.columns]
        keys = [f.output for f in fields]
        aggs = []
        for v in self.values:
            if v.formula:
                text = v.formula
                for c in sorted(df.columns, key=len, reverse=True):
                    text = text.replace(f"sum_{c}", f"sum(`{c}`)")
                aggs.append(F.expr(text).alias(v.name))
            else:
                aggs.append((F.count(F.lit(1)) if v.column is None else SUMMARY[v.how](F.col(f"`{v.column}`"))).alias(v.name))
        out = df.groupBy(*[f.expression().alias(f.output) for f in fields]).agg(*aggs)
        for of, items in self.items.items():
            for item, formula in items.items():
                out = self.with_item(out.select(*keys, *[v.name for v in self.values]), of, item, formula)
        for v in self.values:
            if v.show:
                out = self.shown(out, v)
        return out.select(*keys, *[v.name for v in self.values])

    def with_item(self, out: DataFrame, of: str, item: str, formula: str) -> DataFrame:
        """The cells, and for each group of the other fields one more: the item, calculated from the sums of the field's
        other items, where an item without rows counts as 0."""
        if any(v.formula or v.how not in ("sum", "count", "count numbers") for v in self.values):
            raise GuardRefused(f"{item} is calculated from items, whose averages, extremes and distinct counts do not add up.")
        others = [f.output for f in (*self.rows, *self.columns) if f.output != of]

        def value(tree: tuple, c: str) -> Column:
            match tree:
                case ("name" | "text", n):
                    return F.coalesce(F.sum(F.when(F.col(f"`{of}`").cast("string") == str(n), F.col(f"`{c}`"))), F.lit(0))
                case ("num", x):
                    return F.lit(x)
                case ("neg", x):
                    return -value(x, c)
                case ("op", "/", a, b):
                    return F.try_divide(value(a, c), value(b, c))
                case ("op", "+" | "-" | "*" as sign, a, b):
                    x, y = value(a, c), value(b, c)
                    return x + y if sign == "+" else x - y if sign == "-" else x * y
            raise GuardRefused(f"{item}: {formula} is not translated.")

        tree = parse(formula)
        made = out.groupBy(*[f"`{k}`" for k in others]).agg(*[value(tree, v.name).alias(v.name) for v in self.values])
        return out.withColumn(of, F.col(f"`{of}`").cast("string")).unionByName(made.withColumn(of, F.lit(item)))

    def shown(self, out: DataFrame, v: Value) -> DataFrame:
        """Windows over the aggregated rows, which are as few as the pivot's cells."""
        c = F.col(v.name)
        rows, columns = [f.output for f in self.rows], [f.output for f in self.columns]
        others = [k for k in rows + columns if k != v.base]
        match v.show:
            case "% of total":
                total = out.agg(F.sum(c).alias("__total"))
                return out.crossJoin(F.broadcast(total)).withColumn(v.name, F.try_divide(c, F.col("__total"))).drop("__total")
            case "% of row":
                return out.withColumn(v.name, F.try_divide(c, F.sum(c).over(Window.partitionBy(*rows))))
            case "% of column":
                return out.withColumn(v.name, F.try_divide(c, F.sum(c).over(Window.partitionBy(*columns))))
            case "running total":
                return out.withColumn(v.name, F.sum(c).over(Window.partitionBy(*others).orderBy(v.base).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            case "rank" | "rank down":
                return out.withColumn(v.name, F.rank().over(Window.partitionBy(*others).orderBy(c.desc() if v.show == "rank down" else c.asc())))
            case "difference" | "% difference" | "% of":
                base = F.max(F.when(F.col(v.base) == v.item, c)).over(Window.partitionBy(*others))
                new = c - base if v.show == "difference" else F.try_divide(c, base) if v.show == "% of" else F.try_divide(c - base, base)
                return out.withColumn(v.name, new)
        raise GuardRefused(f"{v.show} is not translated.")

    def totals(self, df: DataFrame, *level: str) -> DataFrame:
        """The totals by some of the fields, from the source rows, as averages and distinct counts do not add up."""
        keep = {f.output: f for f in (*self.rows, *self.columns)}
        return Pivot(tuple(keep[n] for n in level), (), tuple(Value(v.name, v.column, v.how, v.formula) for v in self.values), self.keep, self.drop, self.between, self.top).lower(df)

    def value_of(self, df: DataFrame, name: str, out: str, **items: str) -> DataFrame:
        """df with the pivot's value at the cells that its columns name: field to column of df."""
        cells = self.totals(df, *items).select(*[F.col(f).alias(f"__{f}") for f in items], F.col(name).alias(out))
        return df.join(cells, [F.col(c).eqNullSafe(F.col(f"__{f}")) for f, c in items.items()], "left").drop(*[f"__{f}" for f in items])
