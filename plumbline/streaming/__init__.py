"""The same statements over streams: micro-batches that replace the partitions they fill, so that a retry changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from plumbline.plans.statements import Stack, Statement
from plumbline.sources.tables import Table


def overwrite_batches(table: Table, query: Statement | Stack, source: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the query over each batch, which it reads as `source`, overwrites the partitions it fills."""
    from plumbline.operators.sinks import insert_overwrite

    def write(batch: DataFrame, _: int) -> None:
        insert_overwrite(table, query, {source: batch}, unproven_key=True)

    return write
