"""Ordered folds over the rows of a document, one document in memory at a time and many in a batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 5000
#: What Arrow brings to Python at once, and may give back.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python hold BATCH_BYTES at most, so that a task's memory does not grow with the lengths of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def by_document(rows: DataFrame, fold: Callable[[list[dict]], list[dict]], out: DataFrame) -> DataFrame:
    """fold over each document's rows in the order of seq. out is any DataFrame with the schema of the result.

    Rows are dealt and sorted by document once; partitions then stream through Python, so that small documents
    share Arrow batches instead of making one pandas frame each.
    """
    small_batches(rows.sparkSession)
    schema = out.schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        doc, held, made = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["doc_id"] != doc:
                    made += fold(held)
                    held = []
                    if len(made) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(made, arrow)
                        made = []
                doc = r["doc_id"]
                held.append(r)
        if held:
            made += fold(held)
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow)

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(run, schema)
