"""What the corpus operators share: words, shared-folder checkpoints and exact distributed ranks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Above so many rows a lookup table is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 50_000
#: Bytes of one batch of rows that Python gets.
BATCH_BYTES = 4 << 20


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that others, whatever their names, cannot clash with an operator's own."""
    return df.select(*names)


def shared_folder(spark) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one that was set on the context.

    Only where neither is set and the master is local (tests) does this make a folder of its own.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    A checkpoint keeps the size that the planner estimated for its plan, and estimates of joins are
    products; carried through loops they grow to numbers of millions of digits. So the rows get a new plan
    without an estimate, and joins are planned by the sizes that adaptive execution measures.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def in_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) on batches of at most BATCH_BYTES.

    Spark's own bound (64 MB, or 10,000 rows) is for short rows; each task would hold texts of that size twice. The
    setting is the session's, as Spark has none for a single plan; a smaller one stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).removesuffix("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def delete(spark, path: str) -> None:
    """Delete a file or folder of any store that Spark reaches."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one run of an operator, in the shared folder: written once, so that a lost executor costs no finished step.

    As Parquet they are small and tell the planner their sizes. They go at drop(), or at the end of the with block;
    what outlives the block must be materialised before.
    """

    def __init__(self, spark):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.tables: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.tables.clear()
        delete(self.spark, self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and read it back."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = (out, path)
        return out

    def drop(self, *done: DataFrame) -> None:
        """Delete tables that keep() gave; anything else is left alone."""
        for df in done:
            if id(df) in self.tables:
                delete(self.spark, self.tables.pop(id(df))[1])

def lookup_join(df: DataFrame, small: DataFrame, on, rows: int, how: str = "inner") -> DataFrame:
    """Join with a lookup table: broadcast only if its counted rows are few, else shuffled."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body as a bound variable (Catalyst would inline it in lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)
