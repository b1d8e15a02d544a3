"""The same transforms over a stream of documents (an extension; rows are documents, so no state is kept)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import lines, quality


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def narrate(docs: DataFrame, **options) -> DataFrame:
    """Cleaned and assessed documents, batch or stream."""
    return quality.assess(lines.clean_markdown(docs, **options))


def write_passed(assessed: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Q15 as a stream: what passes the gate is appended as Parquet, exactly once."""
    return quality.passed(assessed).select("doc_id", "narration", "status").writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
