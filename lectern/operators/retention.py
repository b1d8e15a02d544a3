"""Retention of finished cases (TK1, TK2, WN14, OR6)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.errors import LecternError
from lectern.operators import chunking

KEEP, WINDOW_SECONDS = 15, 408 * 3600
STATES = ("running", "complete", "incomplete", "unknown")


def candidates(cases: DataFrame) -> DataFrame:
    """TK2: root, name, completed_at and activity of cases that may be pruned.

    A case has a narration, no link, no partial or empty file, and is complete, or has no state and as many
    audio files as its narration has chunks.
    """
    audio = F.filter("files", lambda f: F.lower(f["path"]).endswith(".mp3"))
    clean = F.size("files") == F.size(F.filter("files", lambda f: ~f["is_link"] & ~F.lower(f["path"]).endswith(".partial") & ~(F.lower(f["path"]).endswith(".mp3") & (f["size"] == 0))))
    newest = F.array_max(F.transform("files", lambda f: f["mtime"]))
    legacy = F.col("status").isNull() & (F.size(audio) == F.size(chunking.chunks(F.col("narration"))))
    ok = F.col("narration").isNotNull() & clean & (F.size(audio) > 0) & ((F.col("status") == "complete") | legacy)
    done = F.coalesce(F.col("completed_at"), F.array_max(F.transform(audio, lambda f: f["mtime"])))
    return cases.where(F.coalesce(ok, F.lit(False))).select("root", "name", done.alias("completed_at"), F.greatest(done, newest).alias("activity"))


def ranked(cases: DataFrame, by: str = "root") -> DataFrame:
    """WN14: rank by completed_at, name and activity, all descending."""
    order = Window.partitionBy(by).orderBy(F.col("completed_at").desc(), F.col("name").desc(), F.col("activity").desc())
    return cases.withColumn("rank", F.row_number().over(order))


def prunable(cases: DataFrame, now: float, keep: int = KEEP, window: int = WINDOW_SECONDS, by: str = "root") -> DataFrame:
    """TK1: beyond the newest `keep`, cases idle for strictly more than `window` seconds."""
    return ranked(cases, by).where((F.col("rank") > keep) & (F.lit(now) - F.col("activity") > window))


def begin(state: DataFrame, names: list[str], token: str) -> DataFrame:
    """OR6: state (name, status, token, completed_at, files) with these cases running under the token."""
    busy = state.where(F.col("name").isin(names) & (F.col("status") == "running")).select("name").limit(1).collect()
    if busy:
        raise ValueError(f"another run is already using {busy[0]['name']}")
    fresh = state.sparkSession.createDataFrame([(n, "running", token) for n in names], "name string, status string, token string")
    fresh = fresh.select("name", "status", "token", F.lit(None).cast("double").alias("completed_at"), F.expr("cast(array() AS array<string>)").alias("files"))
    return state.where(~F.col("name").isin(names)).unionByName(fresh)


def complete(state: DataFrame, name: str, token: str, files: list[str], now: float) -> DataFrame:
    """OR6: a case is complete, if it runs under this token and has files."""
    if not files:
        raise ValueError("missing or empty audio")
    if not state.where((F.col("name") == name) & (F.col("token") == token)).limit(1).collect():
        raise ValueError(f"{name} belongs to a different run")
    mine = F.col("name") == name
    return state.withColumns({
        "status": F.when(mine, F.lit("complete")).otherwise(F.col("status")),
        "completed_at": F.when(mine, F.lit(now)).otherwise(F.col("completed_at")),
        "files": F.when(mine, F.array(*[F.lit(f) for f in files])).otherwise(F.col("files")),
    })


def finish(state: DataFrame, token: str) -> DataFrame:
    """OR6: what still runs under the token is incomplete."""
    return state.withColumn("status", F.when((F.col("token") == token) & (F.col("status") == "running"), F.lit("incomplete")).otherwise(F.col("status")))


def progress(state: DataFrame) -> DataFrame:
    """AG12: cases by status."""
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n_cases"))


class StateTable:
    """OR6: the state of a folder's runs, as numbered versions of a table; a version appears as a whole or not at all.

    A writer takes the next number by creating its lock, which only one can do, so that of two runs that read the same version
    one is refused. The lock of a writer that died before its version was complete counts no more after `stale` seconds.
    """

    def __init__(self, spark: SparkSession, path: str, stale: float = 600.0):
        self._spark, self._path, self._stale = spark, path.rstrip("/"), stale
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self._path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        return self._fs.exists(self._at(f"{self._path}/{name}"))

    def version(self) -> int:
        """The number of the last complete version; 0 before the first."""
        n = 0
        while self._has(f"v{n + 1}/_SUCCESS"):
            n += 1
        return n

    def read(self, schema: str) -> tuple[DataFrame, int]:
        """The last version, or an empty table of the schema, and its number."""
        n = self.version()
        return (self._spark.read.schema(schema).parquet(f"{self._path}/v{n}") if n else self._spark.createDataFrame([], schema)), n

    def write(self, state: DataFrame, after: int) -> int:
        """Write state as the version that follows `after`; refused if another run has it."""
        lock = self._at(f"{self._path}/v{after + 1}.lock")
        if self._fs.exists(lock) and not self._has(f"v{after + 1}/_SUCCESS") and time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000 > self._stale:
            self._fs.delete(lock, False)
        if self.version() != after or not self._fs.createNewFile(lock):
            raise LecternError(f"another run has changed {self._path}")
        state.write.mode("overwrite").parquet(f"{self._path}/v{after + 1}")
        return after + 1
