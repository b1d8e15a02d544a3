"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group that stays in one shard. Only a group larger than a shard's
fair share of all bytes, which no balanced layout can hold, is cut by rank into the fewest equal runs
that fit (rows of a group have one size; fewer than ``shards`` groups can be so large, so that lookup is bounded).
Ranks come from counts of hash bins, so no group is ordered in one task, and the shards of units with many rows
are looked up by broadcast (at most HOT * shards of them), so no such unit meets in one. Sizes of runs follow from
their group's, so rows are grouped once.

Groups are dealt by hash to parts of about PART groups. In a part, each group starts as a tuple of
sums (0, ..., 0, bytes); the two tuples of largest spread are combined again and again, one sorted
up and the other down, until one tuple is left. The parts' tuples are then combined in the same
way, FAN at a time, until one tuple is left, whose places are the shards. Groups that are more than a part's
share of a shard (fewer than LARGE * shards) no part could even out: they are differenced first, on the driver,
and each part starts with its share of their sums as one more tuple. Only shards of equal such sums then change places
between parts (with no large group: all). Slots come from exact
counts per (shard, bin), so no shard is ever sorted as a whole.

Checkpoints are the rows, the groups and the units' shards. A checkpoint writes a file for each partition, empty ones
too, and where Hadoop has no native library a local folder starts a process for each; so tables of few rows
are Parquet, which has none for empty partitions, and what joins to the checkpoints is not written at all.

Defined results: a null text has no bytes, CRC 0, and is a group apart from the empty text;
repeated rows are rows of one group, each with a slot of its own; groups of equal bytes (ties) are taken by their
text's MD5; very long texts count whole and are never cut, so one over a fair share makes its shard larger; which of
equal rows falls behind a cut, and slots, depend on the input's partitioning; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, lookup_join, materialise

SHARDS = 24
PART = 4096
FAN = 512
#: Groups of more than 1 / LARGE of a shard are placed before the parts, and in fewer parts those of more than 1 / parts.
LARGE = 64
BIN_ROWS = 100_000
#: Units of more than 1 / (HOT * shards) of all rows are looked up by broadcast.
HOT = 64


def difference(tuples: list[list[int]], k: int) -> list[list[int]]:
    """Karmarkar-Karp over tuples of k sums: for each tuple, the final place of each of its k entries."""
    if not tuples:
        return []
    heap = []
    for i, sums in enumerate(tuples):
        order = sorted(range(k), key=lambda j: -sums[j])
        heap.append((-(sums[order[0]] - sums[order[-1]]), i, [sums[j] for j in order], [[(i, j)] for j in order]))
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        _, _, a, bags_a = heapq.heappop(heap)
        _, _, b, bags_b = heapq.heappop(heap)
        joined = []
        for x, y, p, q in zip(a, reversed(b), bags_a, reversed(bags_b), strict=True):
            if len(p) < len(q):
                p, q = q, p
            p.extend(q)
            joined.append((x + y, p))
        joined.sort(key=lambda e: -e[0])
        low = joined[-1][0]
        heapq.heappush(heap, (-(joined[0][0] - low), fresh, [e[0] - low for e in joined], [e[1] for e in joined]))
        fresh += 1
    places = [[0] * k for _ in tuples]
    for place, bag in enumerate(heap[0][3]):
        for i, j in bag:
            places[i][j] = place
    return places


def _first(sums: list[int], rest: int):
    """Places in a part: the number of the first shard with the same sum of large units, and the number among those; rest: bytes of all parts."""
    start = [sums.index(x) for x in sums]
    k = len(sums)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key", "run"], ascending=[False, True, True])
        here = int(pdf["bytes"].sum())
        places = difference([[x * here // rest for x in sums]] + [[0] * (k - 1) + [int(b)] for b in pdf["bytes"]], k)
        at = {place: j for j, place in enumerate(places[0])}
        to = [at[p[k - 1]] for p in places[1:]]
        return pdf.assign(start=[start[j] for j in to], place=[j - start[j] for j in to])[["key", "run", "bytes", "n_rows", "part", "start", "place"]]

    return run


def _later(sums: list[int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, start, to = sorted(pdf["part"].unique()), int(pdf["start"].iloc[0]), pdf["up"].iloc[0]
        k = sums.count(sums[start])
        own = {p: [0] * k for p in parts}
        for p, j, b in zip(pdf["part"], pdf["place"], pdf["bytes"], strict=True):
            own[p][j] += int(b)
        places = difference([own[p] for p in parts], k)
        return pd.DataFrame([(p, start, j, to, places[i][j], own[p][j]) for i, p in enumerate(parts) for j in range(k)], columns=["part", "start", "place", "up", "place_up", "bytes"])

    return run


def _runs(size: int, n: int, runs: int) -> list[tuple[int, int, int]]:
    """(run, bytes, rows) of each run that `_cut` makes of n rows of this size; with more runs than rows, some have none."""
    starts = [-(-r * n // runs) for r in range(runs + 1)]
    return [(r, size * (b - a), b - a) for r, (a, b) in enumerate(zip(starts, starts[1:])) if b > a]


def _cut(rows: DataFrame, heavy: DataFrame, n: int) -> DataFrame:
    """rows with the run of each: of a heavy group (key, runs), runs of equal numbers of rows; 0 in other groups."""
    bins = max(SHARDS, n // BIN_ROWS)
    plain = rows.join(F.broadcast(heavy), "key", "left_anti").withColumn("run", F.lit(0).cast("long"))
    large = rows.join(F.broadcast(heavy), "key").withColumn("__bin", F.pmod(F.xxhash64("rid"), F.lit(bins)))
    counts = large.groupBy("key", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("key")
    offsets = counts.select(
        "key", "__bin", (F.sum("__n").over(whole.orderBy("__bin")) - F.col("__n")).alias("__ahead"), F.sum("__n").over(whole).alias("__all"))
    ranked = large.withColumn("__at", F.row_number().over(Window.partitionBy("key", "__bin").orderBy("rid")) - 1)
    ranked = lookup_join(ranked, offsets, ["key", "__bin"], bins * SHARDS)
    return plain.unionByName(ranked.withColumn("run", F.floor((F.col("__ahead") + F.col("__at")) * F.col("runs") / F.col("__all")).cast("long")).select(*plain.columns))


def _places(s: Scratch, units: DataFrame, parts: int, total: int, shards: int, fan: int) -> DataFrame:
    """key, run, n_rows and shard of each unit (key, run, bytes, n_rows; so many bytes in total), dealt to so many parts."""
    spark, most = units.sparkSession, max(1, total // (shards * min(parts, LARGE)))
    large = sorted(units.where(F.col("bytes") > most).collect(), key=lambda u: (-u.bytes, u.key, u.run))
    places = [p[shards - 1] for p in difference([[0] * (shards - 1) + [u.bytes] for u in large], shards)]
    sums = [0] * shards
    for u, place in zip(large, places, strict=True):
        sums[place] += u.bytes
    order = sorted(range(shards), key=lambda j: -sums[j])
    rank, sums = {j: r for r, j in enumerate(order)}, [sums[j] for j in order]
    placed = s.keep(
        units.where(F.col("bytes") <= most)
        .withColumn("part", F.pmod(F.xxhash64("key", "run"), F.lit(parts)))
        .groupBy("part")
        .applyInPandas(_first(sums, max(1, total - sum(sums))), "key string, run long, bytes long, n_rows long, part long, start long, place long")
    )
    level = placed.groupBy("part", "start", "place").agg(F.sum("bytes").alias("bytes"))
    way = placed.select("key", "run", "n_rows", "part", "start", "place")
    while parts > 1:
        up = s.keep(
            level.withColumn("up", F.floor(F.col("part") / fan).cast("long"))
            .groupBy("up", "start")
            .applyInPandas(_later(sums), "part long, start long, place long, up long, place_up long, bytes long")
        )
        way = lookup_join(way, up.select("part", "start", "place", "up", "place_up"), ["part", "start", "place"], parts * shards)
        way = way.select("key", "run", "n_rows", F.col("up").alias("part"), "start", F.col("place_up").alias("place"))
        level = up.groupBy(F.col("up").alias("part"), "start", F.col("place_up").alias("place")).agg(F.sum("bytes").alias("bytes"))
        parts = -(-parts // fan)
    way = way.select("key", "run", "n_rows", (F.col("start") + F.col("place")).cast("int").alias("shard"))
    if not large:
        return way
    return way.unionByName(spark.createDataFrame([(u.key, u.run, u.n_rows, rank[p]) for u, p in zip(large, places, strict=True)], way.schema))


def shard(docs: DataFrame, shards: int = SHARDS, part: int = PART, fan: int = FAN) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot per row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5("text"), F.lit("null")).alias("key"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows")))
    zero = F.lit(0).cast("long")
    n, total, n_units = groups.agg(F.coalesce(F.sum("n_rows"), zero), F.coalesce(F.sum("bytes"), zero), F.count(F.lit(1))).first()
    fair = max(1, total // shards)
    heavy = [(g.key, g.bytes // g.n_rows, g.n_rows, -(-g.bytes // fair)) for g in groups.where(F.col("bytes") > fair).collect()]  # fewer than `shards` + 1
    rows, units = rows.withColumn("run", zero), groups.select("key", zero.alias("run"), "bytes", "n_rows")
    if heavy:
        spark = docs.sparkSession
        rows = _cut(rows.drop("run"), spark.createDataFrame([(key, runs) for key, _, _, runs in heavy], "key string, runs long"), n)
        cut = [(key, *run) for key, size, m, runs in heavy for run in _runs(size, m, runs)]
        units = units.where(F.col("bytes") <= fair).unionByName(spark.createDataFrame(cut, units.schema))
        n_units += len(cut) - len(heavy)
    with Scratch(docs.sparkSession) as s:
        way = materialise(_places(s, units, max(1, -(-n_units // part)), total, shards, fan))
    bins = max(1, n // BIN_ROWS)
    hot = way.where(F.col("n_rows") > max(1, n // (HOT * shards)))
    found = rows.join(F.broadcast(hot.select("key", "run", "shard")), ["key", "run"])
    rest = rows.join(F.broadcast(hot.select("key", "run")), ["key", "run"], "left_anti").join(way.select("key", "run", "shard"), ["key", "run"])
    done = found.unionByName(rest).select("doc_id", "size", "text_crc32", "shard", "rid", F.pmod(F.xxhash64("rid"), F.lit(bins)).alias("bin"))
    counts = done.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bin", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bin").orderBy("doc_id", "rid")
    numbered = done.withColumn("at", F.row_number().over(inside) - 1)
    return lookup_join(numbered, offsets, ["shard", "bin"], bins * shards).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
