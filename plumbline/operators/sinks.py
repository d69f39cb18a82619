"""Writes and table upkeep. An overwrite replaces the partitions that the rows fill, so that a rerun gives the same table.

Nothing is deleted before its replacement is written in full: a query that fails leaves the table as it was, and one may
read what it overwrites.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import GuardRefused
from plumbline.functions.expressions import quoted
from plumbline.plans.statements import Catalog, Derived, Stack, Statement
from plumbline.sources.tables import KEY, Table, partitions_of

_log: str | None = None
#: Named groups of session settings.
SETTINGS = {
    "dynamic_partitions": {"spark.sql.sources.partitionOverwriteMode": "dynamic"},
    "map_joins": {"spark.sql.autoBroadcastJoinThreshold": "64m"},
    "statistics_on_write": {"spark.sql.statistics.size.autoUpdate.enabled": "true"},
    "merge_small_files": {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"},
}


def set_admin_log(path: str | None) -> None:
    global _log
    _log = path


def _ran(spark: SparkSession, text: str) -> DataFrame:
    """Runs a statement, and appends it to the admin log."""
    if _log:
        spark.createDataFrame([(json.dumps(text),)], "statement string").coalesce(1).write.mode("append").text(_log)
    return spark.sql(text)


def unchecked_sql(spark: SparkSession, text: str) -> DataFrame:
    """A whole statement as it is written, unchecked; appended to the admin log."""
    return _ran(spark, text)


def settings(spark: SparkSession, *names: str, sets: Mapping[str, str] | None = None) -> None:
    for n in names:
        if n not in SETTINGS:
            raise GuardRefused(f"{n} is no group of settings; there are {', '.join(SETTINGS)}.")
        for k, v in SETTINGS[n].items():
            spark.conf.set(k, v)
    for k, v in (sets or {}).items():
        spark.conf.set(k, v)


def _has_subtotals(query: Statement | Stack) -> bool:
    if isinstance(query, Stack):
        return any(map(_has_subtotals, query.parts))
    if not isinstance(query, Statement):
        return False
    return bool(query.subtotals) or any(_has_subtotals(t.query) for t in query.sources if isinstance(t, Derived))


def check_write(table: Table, query: Statement | Stack, unproven_key: bool = False, partition: Mapping[str, object] | None = None) -> None:
    """Columns by name, a partition that is a prefix, no subtotal rows, and a key that is proven unless opted out."""
    partition = dict(partition or {})
    if tuple(partition) != table.partitioned_by[: len(partition)]:
        raise GuardRefused(f"partition names {list(partition)}, not the first of {list(table.partitioned_by)}.")
    names, wanted = {n.name for n in query.outputs}, set(table.columns) - set(partition)
    if names != wanted:
        raise GuardRefused(f"SELECT gives {sorted(names - wanted)} too many and {sorted(wanted - names)} too few for {table.name}.")
    if _has_subtotals(query):
        raise GuardRefused("subtotal rows would stand among the rows of a saved table.", fix="write the rows, and total them when reading")
    if table.key is not None and not unproven_key:
        key = set(table.key) - set(partition)
        if query.key is None or not set(query.key) <= key:
            raise GuardRefused(f"nothing proves that {sorted(key)} tell the rows of {table.name} apart.", "a key that repeats doubles every join on it.", "group by the key", "unproven_key=True")


def _rows(table: Table, query: Statement | Stack, catalog: Catalog, partition: Mapping[str, object] | None) -> DataFrame:
    df = query.lower(catalog)
    for p, v in (partition or {}).items():
        df = df.withColumn(p, F.lit(v))
    last = [c for c in table.columns if c not in table.partitioned_by] + list(table.partitioned_by)
    return df.select(*[F.col(quoted(c)).cast(t) if (t := table.columns[c]) else F.col(quoted(c)) for c in last])


def insert_overwrite(table: Table, query: Statement | Stack, catalog: Catalog, unproven_key: bool = False, partition: Mapping[str, object] | None = None) -> None:
    """Replaces the partitions the rows fill, or the named ones even where no row fills them, or the whole table."""
    check_write(table, query, unproven_key, partition)
    df = _rows(table, query, catalog, partition)
    if table.partitioned_by:
        before = _files(df.sparkSession, table, partition) if partition else {}
        # Spark stages the rows and puts each partition in place once the job has succeeded.
        _writer(table, df).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*table.partitioned_by).save(table.location)
        after = _files(df.sparkSession, table, partition) if partition else {}
        for folder in [f for f, files in before.items() if after.get(f) == files]:  # no row has filled it
            _delete(df.sparkSession, folder)
        return
    new, old = (f"{table.location.rstrip('/')}{end}{uuid.uuid4().hex}" for end in ("__new_", "__old_"))
    try:
        _writer(table, df).save(new)
        _swap(df.sparkSession, new, table.location, old)
    finally:
        _delete(df.sparkSession, new)


def _writer(table: Table, df: DataFrame) -> DataFrameWriter:
    writer = df.write.format(table.stored_as)
    return writer.option("compression", table.compression) if table.compression else writer


def insert_into(table: Table, query: Statement | Stack, catalog: Catalog, unproven_key: bool = False, partition: Mapping[str, object] | None = None) -> None:
    """Appends; running it twice appends twice."""
    check_write(table, query, unproven_key, partition)
    writer = _writer(table, _rows(table, query, catalog, partition)).mode("append")
    (writer.partitionBy(*table.partitioned_by) if table.partitioned_by else writer).save(table.location)


def _fs(spark: SparkSession, path: str):
    """The path and its file system, whatever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    path, fs = _fs(spark, path)
    if fs.exists(path):
        fs.delete(path, True)


def _swap(spark: SparkSession, new: str, place: str, old: str) -> None:
    """Puts a folder in another's place; the other is moved aside first, and back if that fails."""
    (new, fs), (place, _), (old, _) = (_fs(spark, p) for p in (new, place, old))
    there = fs.exists(place)
    if there and not fs.rename(place, old):
        raise OSError(f"{place} cannot be moved aside")
    if not fs.rename(new, place):
        if there:
            fs.rename(old, place)
        raise OSError(f"{place} cannot be replaced")
    if there:
        fs.delete(old, True)


def _files(spark: SparkSession, table: Table, partition: Mapping[str, object]) -> dict[str, frozenset]:
    """The files of each folder of a partition prefix."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    top, fs = _fs(spark, table.location.rstrip("/") + "/" + "/".join(name(p, str(v)) for p, v in partition.items()))
    found: dict[str, frozenset] = {}
    waiting = [top] if fs.exists(top) else []
    while waiting:
        folder = waiting.pop()
        entries = fs.listStatus(folder)
        waiting += [e.getPath() for e in entries if e.isDirectory()]
        files = frozenset(e.getPath().getName() for e in entries if not e.isDirectory())
        if files:
            found[folder.toString()] = files
    return found


def seed_copy(table: Table, original: DataFrame, limits: Mapping[str, object] | None = None) -> None:
    """A one-time copy: by column a least value, {"from":, "to":}, or a list."""
    df = original
    for c, limit in (limits or {}).items():
        if isinstance(limit, Mapping):
            df = df.where(F.col(c).between(limit["from"], limit["to"]))
        elif isinstance(limit, list | tuple | set):
            df = df.where(F.col(c).isin(*limit))
        else:
            df = df.where(F.col(c) >= limit)
    writer = df.select(*table.columns).write.mode("overwrite").format(table.stored_as)
    (writer.option("partitionOverwriteMode", "dynamic").partitionBy(*table.partitioned_by) if table.partitioned_by else writer).save(table.location)


def _text(value: object) -> str:
    """A value as a text of SQL."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_table_sql(t: Table, may_exist: bool = False) -> str:
    """The key is kept as the property KEY, as formats of files have no keys."""
    columns = ", ".join(f"{quoted(c)} {d}" + (f" COMMENT {_text(t.descriptions[c])}" if c in t.descriptions else "") for c, d in t.columns.items())
    text = f"CREATE TABLE {'IF NOT EXISTS ' if may_exist else ''}{t.name} ({columns}) USING {t.stored_as}"
    if t.partitioned_by:
        text += f" PARTITIONED BY ({', '.join(map(quoted, t.partitioned_by))})"
    if t.bucketed_by:
        text += f" CLUSTERED BY ({', '.join(map(quoted, t.bucketed_by))})" + (f" SORTED BY ({', '.join(map(quoted, t.sorted_by))})" if t.sorted_by else "") + f" INTO {t.buckets} BUCKETS"
    if t.location:
        text += f" LOCATION {_text(t.location)}"
    properties = t.properties | ({KEY: ",".join(t.key)} if t.key is not None else {})
    if properties:
        text += " TBLPROPERTIES (" + ", ".join(f"{_text(k)}={_text(v)}" for k, v in properties.items()) + ")"
    return text


def create_table(spark: SparkSession, t: Table, may_exist: bool = False) -> None:
    _ran(spark, create_table_sql(t, may_exist))


def repair_partitions(spark: SparkSession, t: Table) -> None:
    _ran(spark, f"MSCK REPAIR TABLE {t.name}")


def compute_statistics(spark: SparkSession, t: Table, partition: Mapping[str, object] | None = None, columns: bool = False) -> None:
    part = f" PARTITION ({', '.join(f'{quoted(p)}={_text(v)}' for p, v in partition.items())})" if partition else ""
    _ran(spark, f"ANALYZE TABLE {t.name}{part} COMPUTE STATISTICS" + (" FOR ALL COLUMNS" if columns else ""))


def drop_table(spark: SparkSession, t: Table) -> None:
    _ran(spark, f"DROP TABLE IF EXISTS {t.name}" + (" PURGE" if t.purge else ""))


def drop_partitions(spark: SparkSession, t: Table, where: Callable[[dict[str, str | None]], bool]) -> list[dict[str, str | None]]:
    """Drops the partitions whose values, texts or None, pass the test, one by one; returns them."""
    gone = [r for r in partitions_of(spark, t.name) if where(r)]
    for r in gone:
        spec = ", ".join(f"{quoted(p)}={'NULL' if v is None else _text(v)}" for p, v in r.items())
        _ran(spark, f"ALTER TABLE {t.name} DROP IF EXISTS PARTITION ({spec})")
    return gone


def add_columns(spark: SparkSession, t: Table) -> list[str]:
    """Adds the reference's columns that the table lacks."""
    there = {c.name for c in spark.catalog.listColumns(t.name)}
    new = [c for c in t.columns if c not in there]
    if new:
        _ran(spark, f"ALTER TABLE {t.name} ADD COLUMNS ({', '.join(f'{quoted(c)} {t.columns[c]}' for c in new)})")
    return new


def set_properties(spark: SparkSession, t: Table) -> None:
    _ran(spark, f"ALTER TABLE {t.name} SET TBLPROPERTIES ({', '.join(f'{_text(k)}={_text(v)}' for k, v in t.properties.items())})")


def move_to_own_folder(spark: SparkSession, name: str, t: Table) -> None:
    """Copies a table into the reference's own location; check the copy before the old one goes."""
    seed_copy(t, spark.table(name))
