"""Quality classifier by importance resampling.

Two bags of hashed n-grams are generative models: the raw model is counted over every document, the
target model over labelled good documents. Tokens are runs of letters, digits and non-ASCII bytes
or runs of other marks, case kept; features are tokens and pairs of neighbouring tokens, hashed to
2 ** BITS places. Both models are smoothed at the target's size, so that an n-gram too rare to
judge weighs nothing. A document's log weight is the sum, over its n-grams, of the log of target
over raw probability. Gumbel top-k then resamples without replacement: a document's key is its log
weight plus Gumbel noise drawn from its doc_id, and the k largest keys stay. The k-th key is found
by histogram levels, never by sorting the corpus.

The target model is counted on a bounded sample: at most TARGET_MOST labelled good documents, those
with the smallest hashed doc_id. The raw model and the resampling cover every document. k is the
number of documents times ``keep_share``, by default the share of good labels.

Defined results: a null or empty text has no n-gram, a log weight of 0 and a score of 0.5; without good
labels all log weights are 0; rows with equal keys (repeated rows) stay or go together, so more than
k rows stay where a tie meets the k-th key; very long texts are counted and weighed whole; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import in_batches, materialise
from lectern.llm.samples import held_out, per_class
from lectern.llm.textcore import U, groups, mix, sliced, spans_of

BITS = 16
TARGET_MOST = 5000
SMOOTH = 4.0
#: Fan-out of a histogram level of the search for the k-th key, and its number of levels.
LEVEL_BITS, LEVELS = 12, 5

_kind = np.array([0 if c in (9, 10, 11, 12, 13, 32) else 1 if chr(c).isalnum() or c >= 128 else 2 for c in range(256)], dtype=np.uint8)


def features(texts: list[bytes]):
    """(from, to, places of all n-grams, their number by text) for runs of texts."""
    for lo, hi in groups(texts):
        joined = b" ".join(texts[lo:hi]) + b" "
        data = np.frombuffer(joined, dtype=np.uint8)
        kind = _kind[data]
        change = np.flatnonzero(np.diff(kind)) + 1
        begin = np.concatenate(([0], change)).astype(np.int64)
        end = np.concatenate((change, [len(data)])).astype(np.int64)
        token = kind[begin] > 0
        starts, stops = begin[token], end[token]
        value = spans_of(data, starts, stops)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts[lo:hi]), dtype=np.int64, count=hi - lo))
        owner = np.searchsorted(ends, starts, side="right")
        same = owner[1:] == owner[:-1]
        pair = mix(mix(value[:-1]) * U(0x100000001B3) + value[1:])[same] if len(value) > 1 else value[:0]
        shift = U(64 - BITS)
        places = np.concatenate([value >> shift, pair >> shift]).astype(np.int64)
        owners = np.concatenate([owner, owner[1:][same]]) if len(value) > 1 else owner
        yield lo, hi, places, owners


def counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) n-gram counts of docs (text, target): summed by place in the cluster, 2 ** BITS rows to the driver."""

    def run(batches):
        size = 1 << BITS
        total = np.zeros((2, size), dtype=np.int64)
        for batch in sliced(batches):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            target = np.array(batch.column("target").to_pylist(), dtype=bool)
            for lo, _, places, owners in features(texts):
                total[0] += np.bincount(places, minlength=size)
                chosen = places[target[lo + owners]]
                if len(chosen):
                    total[1] += np.bincount(chosen, minlength=size)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[0][seen]), pa.array(total[1][seen])], ["place", "raw", "target"])

    rows = in_batches(docs.select("text", "target"), run, "place int, raw long, target long").groupBy("place").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in rows.collect():
        raw[r["place"]], target[r["place"]] = r["raw"], r["target"]
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Per place, log of target over raw probability, both with `smooth` added to counts at the target's size."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    return np.log(target + smooth) - np.log(raw * (target.sum() / raw.sum()) + smooth)


def train(docs: DataFrame, labels: DataFrame, most: int = TARGET_MOST) -> tuple[np.ndarray, float]:
    """(log ratios, share of good labels) from docs (doc_id, text) and labels (doc_id, quality)."""
    known = labels.where("quality IN (0, 1)").select("doc_id", "quality")
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = per_class(known.where("quality = 1"), "quality", most, most).select(F.col("doc_id").alias("__id")).distinct()
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"), "left")  # at most `most` ids
    raw, target = counts(marked.select("text", F.col("__id").isNotNull().alias("target")))
    return log_ratio(raw, target), totals.get(1, 0) / max(1, sum(totals.values()))


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_features, log_weight, score for each row of docs (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        table = shared.value
        for batch in sliced(batches):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            number, weight = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            for lo, hi, places, owners in features(texts):
                number[lo:hi] = np.bincount(owners, minlength=hi - lo)
                weight[lo:hi] = np.bincount(owners, weights=table[places], minlength=hi - lo)
            score = 1 / (1 + np.exp(-np.clip(weight / np.sqrt(np.maximum(1, number)), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(number), pa.array(weight), pa.array(score)], ["doc_id", "n_features", "log_weight", "score"])

    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_features long, log_weight double, score double")


def gumbel(seed: int = 0) -> Column:
    """Standard Gumbel noise, the same for a doc_id in every run."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The exact k-th largest of a double column `key`, by histogram levels of 2 ** LEVEL_BITS bins each."""
    ends = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("key").alias("n")).first()
    if k <= 0 or not ends["n"]:
        return None
    if k >= ends["n"]:
        return ends["lo"]
    lo, hi, bins, left = ends["lo"], ends["hi"], 1 << LEVEL_BITS, k
    for _ in range(LEVELS):
        if lo == hi:
            return lo
        wide = (hi - lo) / bins
        inside = keys.where(F.col("key").between(lo, hi))
        at = F.least(F.lit(bins - 1), F.floor((F.col("key") - F.lit(lo)) / F.lit(wide))).cast("int")
        rows = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if left <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            left -= r["n"]
    return lo  # the last bin is far narrower than a double's noise on such keys: its rows stay together


def resample(weighed: DataFrame, keep_share: float, seed: int = 0) -> DataFrame:
    """weighed rows and kept: the round(keep_share * rows) of them with the largest log weight plus Gumbel noise."""
    keyed = materialise(weighed.withColumn("key", F.col("log_weight") + gumbel(seed)))
    edge = kth_largest(keyed, round(keep_share * keyed.count()))
    return keyed.withColumn("kept", F.lit(False) if edge is None else F.col("key") >= F.lit(edge)).drop("key")


def query(spark, sf_dir: str) -> DataFrame:
    """Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = held_out(5, 0)
    ratio, share = train(docs, labels.where(~out))
    return resample(weigh(docs, ratio), share).select("doc_id", out.alias("held_out"), "n_features", "log_weight", "score", "kept")
