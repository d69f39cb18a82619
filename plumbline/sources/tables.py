"""Table references: what is known of a table before it is read."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.errors import GuardRefused
from plumbline.functions.expressions import Expr, family, ref

#: The table property that holds a key.
KEY = "plumbline.key"
_SIMPLE = frozenset("tinyint smallint int integer bigint float double string boolean binary date timestamp timestamp_ntz".split())


def split_types(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def check_type(dtype: str) -> None:
    """Refuses a type that a table cannot be declared with."""
    t = dtype.strip().lower()
    if t in _SIMPLE:
        return
    if m := re.fullmatch(r"decimal(?:\((\d+)(?:,\s*(\d+))?\))?", t):
        p, s = int(m[1] or 10), int(m[2] or 0)
        if not 1 <= p <= 38 or s > p:
            raise GuardRefused(f"{dtype} has a precision over 38 or a scale over its precision.")
        return
    if m := re.fullmatch(r"(varchar|char)\((\d+)\)", t):
        if not 1 <= int(m[2]) <= (65535 if m[1] == "varchar" else 255):
            raise GuardRefused(f"{dtype} is too long.")
        return
    if m := re.fullmatch(r"array<(.+)>", t):
        return check_type(m[1])
    if m := re.fullmatch(r"map<(.+)>", t):
        parts = split_types(m[1])
        if len(parts) != 2 or "<" in parts[0]:
            raise GuardRefused(f"{dtype}: a map has a simple key and a value.")
        check_type(parts[0])
        return check_type(parts[1])
    if m := re.fullmatch(r"struct<(.+)>", t):
        for part in split_types(m[1]):
            name, colon, of = part.partition(":")
            if not colon or not name.strip():
                raise GuardRefused(f"{dtype}: a struct's parts are name:type.")
            check_type(of)
        return
    raise GuardRefused(f"{dtype} is no type of a column.")


class Table:
    """A table's name, columns in order, partitions, key, and what does not add up. Columns are its attributes."""

    def __init__(self, name: str, columns: Mapping[str, str | None], *, partitioned_by: Iterable[str] | None = None, key: Iterable[str] | None = None, does_not_add_up: Iterable[str] = (), location: str | None = None, purge: bool | None = None, properties: Mapping[str, str] | None = None, stored_as: str = "parquet", compression: str | None = None, bucketed_by: Iterable[str] | None = None, buckets: int | None = None, sorted_by: Iterable[str] | None = None, descriptions: Mapping[str, str] | None = None, alias: str | None = None):
        self.name, self.columns = name, dict(columns)
        self.partitioned_by = tuple(partitioned_by or ())
        self.key = None if key is None else tuple(key)
        self.does_not_add_up, self.location, self.purge = frozenset(does_not_add_up), location, purge
        self.properties, self.stored_as, self.compression = dict(properties or {}), stored_as.lower(), compression
        self.bucketed_by, self.buckets, self.sorted_by = tuple(bucketed_by or ()), buckets, tuple(sorted_by or ())
        self.descriptions, self.alias = dict(descriptions or {}), alias or name.split(".")[-1]
        for dtype in self.columns.values():
            if dtype is not None:
                check_type(dtype)
        if len({c.lower() for c in self.columns}) < len(self.columns):
            raise GuardRefused(f"{name} has two columns of one name.")
        for c in (*self.partitioned_by, *(self.key or ()), *self.does_not_add_up, *self.bucketed_by, *self.sorted_by, *self.descriptions):
            self._known(c)
        if self.stored_as not in ("parquet", "orc"):
            raise GuardRefused(f"{name} is stored as {stored_as}; parquet and orc are known.")
        if bool(self.bucketed_by) != bool(buckets):
            raise GuardRefused("bucketed_by and buckets go together.")

    def _known(self, column: str) -> None:
        if column not in self.columns:
            near = difflib.get_close_matches(column, self.columns, 1)
            raise AttributeError(f"{self.name} has no column {column}" + (f"; did you mean {near[0]}?" if near else ""))

    def __getattr__(self, column: str) -> Expr:
        if column.startswith("__") or "columns" not in self.__dict__:
            raise AttributeError(column)
        return self[column]

    def __getitem__(self, column: str) -> Expr:
        self._known(column)
        return ref(self.alias, column, family(self.columns[column]), "it is declared so" if column in self.does_not_add_up else None)

    def aliased(self, alias: str) -> Table:
        """The table under another name, for a second read of it."""
        out = object.__new__(Table)
        out.__dict__.update(self.__dict__, alias=alias)
        return out

    def schema(self) -> StructType:
        return StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in self.columns.items()))


def all_columns(t) -> list[Expr]:
    return [t[c] for c in t.columns]


def table_of(name: str, df: DataFrame, **facts) -> Table:
    """A reference with the columns and types of a DataFrame."""
    return Table(name, dict(df.dtypes), **facts)


def reference_source(t: Table) -> str:
    """Python source that makes the reference."""
    facts = [f"{n}={v!r}" for n, v in (("partitioned_by", t.partitioned_by), ("key", t.key), ("location", t.location)) if v]
    return f"Table({t.name!r}, {t.columns!r}" + "".join(f", {f}" for f in facts) + ")"


def describe_table(spark: SparkSession, name: str) -> Table:
    """A reference from the catalog: columns, partitions, format, location and buckets."""
    columns = spark.catalog.listColumns(name)
    facts = {r.col_name.strip(): r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    properties = dict(spark.sql(f"SHOW TBLPROPERTIES {name}").collect())
    key = properties.get(KEY)
    return Table(name, {c.name: c.dataType for c in columns}, partitioned_by=[c.name for c in columns if c.isPartition], key=None if key is None else [k for k in key.split(",") if k], location=facts.get("Location"), stored_as=facts.get("Provider", "parquet"))


def add_references(spark: SparkSession, names: Iterable[str]) -> tuple[dict[str, Table], dict[str, str]]:
    """References of many tables, and why others could not be made."""
    made, failed = {}, {}
    for n in names:
        try:
            made[n] = describe_table(spark, n)
        except Exception as e:  # noqa: BLE001
            failed[n] = str(e).splitlines()[0]
    return made, failed


#: What stands for NULL in the name of a partition's folder. Fixed value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def partitions_of(spark: SparkSession, name: str) -> list[dict[str, str | None]]:
    """The values of each partition as texts, NULL as None, from the catalog alone."""
    rows = [dict(p.split("=", 1) for p in r[0].split("/")) for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    return [{unquote(p): None if v == NO_VALUE else unquote(v) for p, v in r.items()} for r in rows]


def latest_partition(spark: SparkSession, name: str, column: str):
    """The largest value of a partition column, from the catalog alone; compared as dates, else as integers, else as text."""
    values = [v for r in partitions_of(spark, name) if (v := r[column]) is not None]
    if not values:
        raise GuardRefused(f"{name} has no partition of {column}.")
    if all(re.fullmatch(r"-?\d+", v) for v in values):
        return max(map(int, values))
    return max(values)


@dataclass(frozen=True)
class Verdict:
    """Whether a check passed, and what it found."""

    ok: bool
    lines: tuple[str, ...] = ()

    def __bool__(self) -> bool:
        return self.ok


def check_key(df: DataFrame, key: Iterable[str], most: int = 20) -> DataFrame:
    """At most `most` keys that repeat, with how many copies there are."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").orderBy(F.desc("copies"), *key).limit(most)


def check_reference(t: Table, df: DataFrame) -> Verdict:
    """Whether the columns and types are still those of the reference."""
    there, lines = dict(df.dtypes), []
    for c, dtype in t.columns.items():
        if c not in there:
            lines.append(f"{c} is gone")
        elif dtype is not None and there[c] != dtype.replace("integer", "int"):
            lines.append(f"{c} is {there[c]}, not {dtype}")
    lines += [f"{c} is new" for c in there if c not in t.columns]
    return Verdict(not lines, tuple(lines))


def propose_key(df: DataFrame, partitions: Iterable[str] = ()) -> tuple[str, ...] | None:
    """The first id-like column, alone or with the partition columns, whose values tell all rows apart; of a partitioned
    table, those of its latest partition."""
    partitions = tuple(partitions)
    for p in partitions[:1]:
        latest = df.agg(F.max(p)).first()[0]
        df = df.where(F.col(p).eqNullSafe(F.lit(latest)))
    named = [c for c, dtype in df.dtypes if c not in partitions and (c.lower().endswith(("id", "key")) or dtype in ("bigint", "int"))]
    if not named:
        return None
    asked = [(c,) for c in named] + ([(*partitions, c) for c in named] if partitions else [])
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(*k).alias(f"k{i}") for i, k in enumerate(asked)]).first()
    return next((k for i, k in enumerate(asked) if row[f"k{i}"] == row.n), None)
