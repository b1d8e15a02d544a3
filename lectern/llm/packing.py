"""Bound-certified best-fit-decreasing packing of token sequences.

Documents become pieces of at most LIMIT tokens; only longer documents are cut. Pieces are dealt
to parts of about PART pieces, and each part is packed by best-fit decreasing. Dual-feasible
functions give a lower bound on the part's bins; a part that meets its bound is certified optimal.
From parts with a gap, all bins that are not nearly full change places as wholes (so pieces of
different parts meet), and best-fit decreasing runs again; a part keeps the new packing only if
it needs fewer bins. This repeats until no part has a gap, or a round saves fewer than 1 in SAVED of the bins it moved.
Each piece comes with its part's certificate: `part`, and `gap`, by how many bins the part may be over the optimum (0: optimal).

Defined results: a null or empty text is the single end token; repeated rows are packed each; pieces of equal length (ties)
are placed in the order they came; very long texts are cut into whole pieces, none is dropped; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import in_batches, materialise
from lectern.llm.textcore import sliced
from lectern.llm.tokens import default_vocabulary, encoder

LIMIT = 4096
END_ID = 1
PART = 16384
SAVED = 10_000
FULL = 0.995


def best_fit(lengths: np.ndarray, limit: int) -> np.ndarray:
    """A bin for each length, by best-fit decreasing; free space is looked up in one bit set."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(limit + 1)]
    free, made = 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                free &= ~(1 << room)
        else:
            b, room, made = made, limit, made + 1
        bins[i] = b
        if left := room - n:
            open_[left].append(b)
            free |= 1 << left
    return bins


def lower_bound(lengths: np.ndarray, limit: int) -> int:
    """The best bound of two dual-feasible families (and their compositions) on the number of bins.

    cut(a): lengths over limit - a count as full bins, lengths under a as nothing.
    step(k): x where (k + 1) x is whole in bins, else floor((k + 1) x) / k.
    """
    if not len(lengths):
        return 0
    sizes = np.arange(limit + 1)
    count = np.bincount(lengths, minlength=limit + 1).astype(np.int64)
    total = int((count * sizes).sum())
    best = -(-total // limit)
    mass, number = np.cumsum(count * sizes), np.cumsum(count)
    a = np.arange(1, limit // 2 + 1)
    big = number[-1] - number[limit - a]
    middle = mass[limit - a] - mass[a - 1]
    best = max(best, int((big + -(-middle // limit)).max()))
    for eps in {1, *np.linspace(1, limit // 2, 64, dtype=int).tolist()}:
        cut = np.where(sizes > limit - eps, limit, np.where(sizes < eps, 0, sizes))
        for k in (1, 2, 3, 4, 5, 7, 10):
            up = (k + 1) * cut
            whole = up % limit == 0  # then x itself: k (k+1) x / ((k+1) limit), kept over one denominator
            value = np.where(whole, up // limit * k, up // limit * (k + 1))  # in units of 1 / (k (k + 1))
            best = max(best, -(-int((count * value).sum()) // (k * (k + 1))))
    return best


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a unique rid for the pieces of docs (doc_id, text)."""

    def run(batches):
        encode = encoder(vocabulary).encode
        end = np.array([END_ID], dtype="<u4").tobytes()
        rid = TaskContext.get().partitionId() << 36
        for batch in sliced(batches):
            rows, out = [], []
            for row, ids in enumerate(encode([x or "" for x in batch.column("text").to_pylist()])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    cut = ids[at : at + 4 * limit]
                    rows.append(row)
                    out.append((k, at // 4, len(cut) // 4, zlib.crc32(cut), rid))
                    rid += 1
            made = np.array(out, dtype=np.int64).reshape(-1, 5)
            own = [pa.array(made[:, 0].astype(np.int32)), *(pa.array(made[:, c]) for c in range(1, 5))]
            ids_of = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of, *own], ["doc_id", "piece", "start", "length", "ids_crc32", "rid"])

    kind = dict(docs.dtypes)["doc_id"]
    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rid long")


def _pack(limit: int, kind: str, full: float):
    def run(rows: pa.Table) -> pa.Table:
        lengths, rid = rows.column("length").to_numpy(), rows.column("rid").to_numpy()
        bins = best_fit(lengths, limit)
        made = int(bins.max()) + 1
        if not rows.column("bin").null_count:  # bins that changed places: keep them as they were unless some are saved
            old, was = np.unique(rows.column("bin").to_numpy(), return_inverse=True)
            if len(old) <= made:
                bins, made = was, len(old)
        filled = np.bincount(bins, weights=lengths, minlength=made)
        order = np.lexsort((rid, bins))
        sorted_bins, sorted_lengths = bins[order], lengths[order]
        before = np.cumsum(sorted_lengths) - sorted_lengths
        first = np.searchsorted(sorted_bins, np.arange(made))
        offset = np.empty(len(lengths), dtype=np.int64)
        offset[order] = before - before[first][sorted_bins]
        gap = made - lower_bound(lengths, limit)
        own = [(rows.column("place").to_numpy() << 24) + bins, offset, (gap > 0) & (filled < full * limit)[bins], np.full(len(lengths), gap)]
        out = rows.select(["doc_id", "piece", "start", "length", "ids_crc32", "rid"])
        for name, values in zip(("bin", "offset", "loose", "gap"), own, strict=True):
            out = out.append_column(name, pa.array(values))
        return out

    return run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rid long, bin long, offset long, loose boolean, gap long"


def pack(docs: DataFrame, vocabulary_path: str | None = None, limit: int = LIMIT, part: int = PART, saved: int = SAVED) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, part, gap."""
    with open(vocabulary_path or default_vocabulary(), encoding="utf-8") as f:
        vocabulary = f.read()
    kind = dict(docs.dtypes)["doc_id"]
    run, schema = _pack(limit, kind, FULL)
    rows = materialise(pieces(docs, vocabulary, limit))
    parts = max(1, -(-rows.count() // part))
    done = materialise(
        rows.withColumn("bin", F.lit(None).cast("long"))
        .withColumn("place", F.pmod(F.xxhash64("rid"), F.lit(parts)))
        .groupBy("place")
        .applyInArrow(run, schema)
    )
    k = 0
    while True:
        k += 1
        n, were = done.where("loose").agg(F.count(F.lit(1)), F.count_distinct("bin")).first()
        if parts == 1 or not n:
            break
        base = k << 34
        moved = done.where("loose").select(
            "doc_id", "piece", "start", "length", "ids_crc32", "rid", "bin", (F.pmod(F.xxhash64("bin", F.lit(k)), F.lit(max(1, -(-n // part)))) + base).alias("place")
        )
        done = materialise(done.where("NOT loose").unionByName(moved.groupBy("place").applyInArrow(run, schema)))
        now = done.where(F.shiftright("bin", 24) >= base).agg(F.count_distinct("bin")).first()[0]
        if (were - now) * saved < were or k == 1 << 12:
            break
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", F.shiftright("bin", 24).alias("part"), "gap")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
