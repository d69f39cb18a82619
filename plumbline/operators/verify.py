"""Comparing two queries' rows, two versions of a table, and a workbook's formulas with the values it holds."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.workbooks import Workbook
from plumbline.sources.xlsx import Book


def same_plan(a: DataFrame, b: DataFrame) -> bool:
    """Whether the optimizer makes the same of both."""
    return a.sameSemantics(b)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one has more often, with how often: `extra` > 0 in a, < 0 in b. NULLs are equal. One shuffle."""
    names = a.columns
    if sorted(names) != sorted(b.columns):
        raise ValueError(f"different columns: {names} and {b.columns}")
    both = a.select(*names, F.lit(1).alias("extra")).unionByName(b.select(*names, F.lit(-1).alias("extra")))
    return both.groupBy(*[f"`{n}`" for n in names]).agg(F.sum("extra").alias("extra")).where("extra <> 0")


@dataclass(frozen=True)
class Comparison:
    only_left: int
    only_right: int
    samples: tuple

    @property
    def same(self) -> bool:
        return not (self.only_left or self.only_right)


def compare(a: DataFrame, b: DataFrame, samples: int = 5) -> Comparison:
    """How many rows each has that the other lacks, and some of them."""
    found = differences(a, b).cache()
    try:
        n = found.agg(F.coalesce(F.sum(F.when(F.col("extra") > 0, F.col("extra"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("extra") < 0, -F.col("extra"))), F.lit(0))).first()
        shown = [*found.where("extra > 0").take(samples), *found.where("extra < 0").take(samples)] if any(n) else []
        return Comparison(n[0], n[1], tuple(shown))
    finally:
        found.unpersist()


def compare_copies(original: DataFrame, copy: DataFrame, partitions: Iterable[str]) -> DataFrame:
    """Row counts by partition where a copy has not as many as the original."""
    keys = list(partitions)
    a = original.groupBy(*keys).agg(F.count(F.lit(1)).alias("original"))
    b = copy.groupBy(*keys).agg(F.count(F.lit(1)).alias("copied"))
    return a.join(b, keys, "full_outer").where(~F.col("original").eqNullSafe(F.col("copied")))


def near(a: DataFrame, b: DataFrame, key: Iterable[str], relative: float = 1e-9, absolute: float = 1e-12) -> DataFrame:
    """Cells that differ, by key: numbers within the tolerances are equal, and so are NULL and NULL."""
    key = list(key)
    names = [c for c in a.columns if c not in key]
    left = a.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], *[F.col(n).alias(f"__a{i}") for i, n in enumerate(names)], F.lit(1).alias("__in_a"))
    right = b.select(*key, *[F.col(n).alias(f"__b{i}") for i, n in enumerate(names)], F.lit(1).alias("__in_b"))
    joined = left.join(right, reduce(lambda x, y: x & y, [F.col(f"__k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(key)]), "full_outer")
    numeric = {n for n, t in a.dtypes if t.startswith(("int", "bigint", "double", "float", "decimal", "smallint", "tinyint"))}
    cells = []
    for i, n in enumerate(names):
        x, y = F.col(f"__a{i}"), F.col(f"__b{i}")
        same = x.eqNullSafe(y)
        if n in numeric:
            same = same | F.coalesce(F.abs(x - y) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(x), F.abs(y))), F.lit(False))
        cells.append(F.when(~same | F.col("__in_a").isNull() | F.col("__in_b").isNull(), F.struct(F.lit(n).alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right"))))
    keys = [F.coalesce(F.col(f"__k{i}"), F.col(k)).alias(k) for i, k in enumerate(key)]
    return joined.select(*keys, F.inline(F.array_compact(F.array(*cells))))


def check_workbook(spark: SparkSession, book: Book, **options) -> DataFrame:
    """Every formula column of a workbook computed from its typed cells and compared with the values that the workbook
    holds: table, row (from 0), column, left (held) and right (computed) of the cells that differ by more than the
    tolerance. Cells that hold an error are compared as NULL. options: of Workbook."""
    out = spark.createDataFrame([], "`table` string, `row` long, `column` string, `left` string, `right` string")
    work = Workbook({}, names={n: v for n, v in ((n, _constant(t)) for n, t in book.names.items()) if v is not None}, **options)
    held = {}
    for name in book.order():
        t = book.tables[name]
        key = next(k for k in ("row", *(f"row_{i}" for i in range(len(t.columns) + 1))) if k not in t.columns)
        held[name] = t.frame(spark, key)
        work.tables[name] = held[name].drop(*t.formulas)
        work.keys[name] = [key]
        work.read_cells(name)
        if not t.formulas:
            continue
        made = work.add(name, **t.formulas)
        typed = {c: rows for c, rows in t.typed_over.items() if rows}
        for c, rows in typed.items():
            made = made.join(held[name].select(F.col(key).alias("__r"), F.col(f"`{c}`").alias("__typed")), F.col(key) == F.col("__r"), "left")
            made = made.withColumn(c, F.when(F.col(key).isin(rows), F.col("__typed")).otherwise(F.col(f"`{c}`").cast(held[name].schema[c].dataType))).drop("__r", "__typed")
        work.tables[name] = made.select(*[f"`{c}`" for c in [key, *t.columns]])
        columns = [key, *t.formulas]
        kinds = dict(held[name].dtypes)
        cells = near(held[name].select(*[f"`{c}`" for c in columns]), made.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in columns]), [key])
        out = out.unionByName(cells.select(F.lit(name).alias("table"), F.col(f"`{key}`").alias("row"), "column", "left", "right"))
    return out


def _constant(text: str) -> object:
    """A defined name's value, if it is a number or a text."""
    text = text.strip()
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return float(text) if "." in text else int(text)
    return text[1:-1].replace('""', '"') if re.fullmatch(r'"(?:[^"]|"")*"', text) else None


def compare_batch(spark: SparkSession, pairs: Mapping[str, tuple[DataFrame, DataFrame]], partitions: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Several comparisons at once: name, partition (its values, joined by /; empty without), only_left and only_right of
    every pair and partition that differ, and of pairs that do not a row with an empty partition and zeros."""
    rows = []
    for name, (a, b) in pairs.items():
        by = list((partitions or {}).get(name, ()))
        found = differences(a, b)
        at = F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in by]) if by else F.lit("")
        counts = found.groupBy(at.alias("partition")).agg(F.sum(F.greatest("extra", F.lit(0))).alias("only_left"), F.sum(F.greatest(-F.col("extra"), F.lit(0))).alias("only_right"))
        none = spark.range(1).select(F.lit("").alias("partition"), F.lit(0).cast("long").alias("only_left"), F.lit(0).cast("long").alias("only_right"))
        # The row of zeros stays only where nothing differs.
        both = none.withColumn("__none", F.lit(1)).unionByName(counts.withColumn("__none", F.lit(0)))
        least = counts.agg(F.count(F.lit(1)).alias("__n"))
        rows.append(both.crossJoin(F.broadcast(least)).where("__none = 0 OR __n = 0").select(F.lit(name).alias("name"), "partition", "only_left", "only_right"))
    return reduce(DataFrame.unionByName, rows)
