"""What needs an order of all rows, without one task that has them all: row numbers, ranks and running totals.

Rows are dealt to ranges by the order and kept in the shared folder, so that every later reading, also after an executor
is lost, sees the same ranges. What lies before a range is a total of few rows; what lies before a row within its range is
a window over that range alone. Rows that tie may be in several ranges, so that a frequent value fills no range.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.shared import shared_dir


def settled(df: DataFrame) -> DataFrame:
    """df's rows, partitions and orders as they are now, whatever happens: checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def dealt(df: DataFrame, order: list[Column], tie: list[Column] | None = None) -> DataFrame:
    """df in ranges of the order, sorted within, with __part, the range's number, and __at, a row's place in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = [F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")])] if tie is None else tie
    kept = settled(df.repartitionByRange(parts, *order, *tie).sortWithinPartitions(*order, *tie))
    return kept.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0, step: int = 1) -> DataFrame:
    """Rows numbered in an order; rows that tie in it, by a hash of their columns."""
    rows = dealt(df, order)
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = rows.join(F.broadcast(starts), F.col("__part") == F.col("__p")).withColumn(name, (F.col("__at") + F.col("__before")) * step + start)
    return out.drop("__part", "__at", "__p", "__before")


def value_ranks(df: DataFrame, c: Column, down: bool, value: str, place: str) -> DataFrame:
    """Each distinct value and its rank."""
    counts = df.where(c.isNotNull()).groupBy(c.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    rows = dealt(counts, [F.col("__v").desc() if down else F.col("__v").asc()], [])
    sums = rows.groupBy("__part").agg(F.sum("__n").alias("__s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(F.broadcast(starts), F.col("__part") == F.col("__p"))
    return ranked.select(F.col("__v").alias(value), (F.coalesce(F.sum("__n").over(within), F.lit(0)) + F.col("__before") + 1).alias(place))


#: How totals of parts are made totals: of counts, sums, least and greatest values.
_PARTS = {"n": F.sum, "s": F.sum, "lo": F.min, "hi": F.max}


def compared_totals(asked: DataFrame, source: DataFrame, same: Iterable[str], sign: str, kind: str, name: str) -> DataFrame:
    """For each distinct (same..., x) of asked: the total of source's v over its rows (same..., c, v) whose `same` columns
    are equal, NULL to NULL, and whose c is <, <=, > or >= x. kind: sum, count (of v that is not NULL), avg, min or max.

    One sort of both tables' distinct values instead of a join of rows with all rows they are compared with.
    """
    same = list(same)
    down = sign in (">", ">=")
    needed = {"sum": ["s"], "count": ["n"], "avg": ["n", "s"], "min": ["lo"], "max": ["hi"]}[kind]
    made = {"n": F.count("v"), "s": F.sum("v"), "lo": F.min("v"), "hi": F.max("v")}
    keys = [F.col(f"`{k}`") for k in same]
    # On ties the rows asked for come last where they count equal ones, and first where they do not.
    strict = sign in ("<", ">")
    given = source.where("c IS NOT NULL").groupBy(*keys, "c").agg(*[made[p].alias(p) for p in needed]).withColumn("__asks", F.lit(False))
    asks = asked.where("x IS NOT NULL").select(*keys, F.col("x").alias("c")).distinct().withColumn("__asks", F.lit(True))
    both = given.unionByName(asks, allowMissingColumns=True).withColumn("__turn", F.col("__asks") != F.lit(strict))
    order = [*(k.asc() for k in keys), F.col("c").desc() if down else F.col("c").asc(), F.col("__turn").asc()]
    rows = dealt(both, order, [])
    # Totals of each group's rows in earlier ranges: one row for each range and group in it.
    ranges = rows.groupBy("__part", *keys).agg(*[_PARTS[p](p).alias(f"__{p}") for p in needed])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(F.col("__part").alias("__p"), *[F.col(f"`{k}`").alias(f"__same{i}") for i, k in enumerate(same)], *[_PARTS[p](f"__{p}").over(before).alias(f"__{p}") for p in needed])
    within = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("__part", *keys, "c", "__asks", *[_PARTS[p](p).over(within).alias(p) for p in needed]).where("__asks")
    on = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        on = on & k.eqNullSafe(F.col(f"__same{i}"))
    rows = rows.join(starts, on, "left")
    whole = {"n": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "s": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "lo": F.least, "hi": F.greatest}
    total = {p: whole[p](F.col(p), F.col(f"__{p}")) for p in needed}
    value = F.try_divide(total["s"], total["n"]) if kind == "avg" else total[needed[0]]
    return rows.select(*keys, F.col("c").alias("x"), value.alias(name))
