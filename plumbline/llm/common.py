"""What the training-data operators share: the shared folder, written tables, hot-key lookups."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an operator yields in one Arrow batch, at most.
BATCH_ROWS = 2048


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local one will do in local
    mode, where all share it; on a cluster it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver.")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables written since `scratch` began, in the scopes that are open.
_SCOPES: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and lost executors lose nothing. It stays until the
    `scratch` around it ends, or for good."""
    path = f"{shared_dir(df.sparkSession)}/plumbline/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return _kept(df, path)


def result(df: DataFrame, name: str) -> DataFrame:
    """As `written`, but no `scratch` removes it."""
    return _kept(df, f"{shared_dir(df.sparkSession)}/plumbline/{name}-{uuid.uuid4().hex}")


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were written within, once they have served."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def remainder_of(value, modulus: int) -> int | None:
    return None if value is None else zlib.crc32(str(value).encode()) % modulus


#: The one large object that a Python worker keeps between its tasks, by its key.
_KEPT: dict = {}


def kept(key: tuple, make):
    """What make() gives, kept for this worker's next tasks until an operator with another key runs in it."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Frees what an earlier operator kept in this worker; every operator that keeps nothing begins with it."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()


def text_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of the batches as tuples, one at a time, so that one batch's Python objects are all that is held."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(lo, BATCH_ROWS)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most `most` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> list[tuple[str, int]]:
    """At most `most` labelled (text, label) rows that are not held out, the same ones on every run.

    Only ids and labels take part in the choice: the `most` smallest hashes of the ids. Rows with a null id or label
    are no examples. Of documents that share an id the smallest text counts.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (crc_remainder("id", modulus) != held_out))
        .orderBy(F.xxhash64("id"), "id", "y")
        .limit(most)
    )
    rows = documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r.id).encode()), r.id, r.y))]


#: A key is hot if more than one row in so many has it; there are no more hot keys than this.
HOT = 1000


def lookup_by_hot_key(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined to groups on key, where groups has one row a key with n, the rows that have it.

    A key with more than 1/HOT of the rows that groups counts is hot. Its rows meet the group by a broadcast of the hot
    groups, of which there are fewer than HOT; all other keys meet by a shuffle, in which none is large.
    """
    groups = written(groups, "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") > max(1, total // HOT)).drop("n")
    cold = groups.where(F.col("n") <= max(1, total // HOT)).drop("n")
    hot_rows = rows.join(F.broadcast(hot), key, how="inner")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return hot_rows.unionByName(rest.join(cold.hint("merge"), key, how), allowMissingColumns=True)


@contextmanager
def no_cycles() -> Iterator[None]:
    """Python's cycle collector rests: it would walk large tables of kept words again and again, which have no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
