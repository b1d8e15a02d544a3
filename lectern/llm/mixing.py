"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

1.  Sizes and targets. A document's size is its word count. Each source gets its weight's share of
    all words; a target above ``max_epochs`` times its source stops there and the excess is shared
    out again by weight (water filling, in closed form by a window over the sources).
2.  Blocks. Every document has a keyed 60-bit hash; a block is a hash range of its source of about
    BLOCK_WORDS words, so the blocks in hash order are a random permutation of the source. Whole
    epochs take every block, and the fraction left takes the first blocks of the permutation. The
    block at which the target falls is found by two histogram levels of at most 4096 ranges each,
    never by sorting a source; in that block alone, documents are taken largest first as they fit.
    So each source has an exact quota of blocks, one for each epoch of each block drawn.
3.  Tree. The tree halves the output shards again and again and gives each side its exact share of the
    node's blocks. Which blocks go left is a uniform draw without replacement: those that come first in one
    keyed permutation of all drawn blocks. The sources' counts on the left are then, at every node and
    at any size, one multivariate-hypergeometric draw from the node's quotas (`allotment` gives them);
    nothing is rounded, and no source is merged with another. Only the places where the permutation is cut are
    needed, one for each shard: they are found by histogram levels over the blocks, so no task orders them all.
4.  A block lies in one shard, and rows are shuffled only inside their shard, in as many tasks as its words ask for.

Defined results: null or empty texts have size 0, are taken 0 words and never drawn; null is a
source of its own, last; rows with the same doc_id in a source share a fate (all or none of them
get the fraction's extra copy) and their shards, and so do rows of the same text without a doc_id; ties of hashes are ordered by source, epoch and block; very long texts
count whole, and one that does not fit the room left is not taken for it; an empty table gives an empty
result; other columns, whatever their names, are carried by `mixed_documents` and ignored by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import lookup_join, materialise, n_words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 1 << 16
SHARDS = 16
BITS = 60
#: About so many words of a shard are laid out by one task.
TASK_WORDS = 1_000_000


def keyed_hash(seed: str) -> Column:
    """60 uniform bits of a document and a seed; md5, so that other engines can repeat it. Without a doc_id the text counts."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit(""))))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> and rank, weight, target. weights: a cycle, or a DataFrame (source, weight)."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double"))
        ranked = ranked.join(given, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").fillna(0.0, ["weight"])
    else:
        cycle = F.array(*[F.lit(float(w)) for w in weights])
        ranked = ranked.withColumn("weight", F.get(cycle, F.col("rank") % len(weights)))
    cap = F.col("source_size").cast("double") * max_epochs
    whole = Window.partitionBy(F.lit(0))
    fill = whole.orderBy(F.when(F.col("weight") > 0, cap / F.col("weight")).asc_nulls_last(), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = (
        ranked.withColumn("__level", F.when(F.col("weight") > 0, level))
        .withColumn("__at", F.row_number().over(fill))
        .withColumn("__open", cap >= F.col("__level") * F.col("weight"))
    )
    first = F.min_by("__level", F.when(F.col("__open"), F.col("__at"))).over(whole)
    return leveled.withColumn("target", F.coalesce(F.least(cap, first * F.col("weight")), F.lit(0.0))).select(
        "source", "source_size", "rank", "weight", "target"
    )


def _locate(blocks: DataFrame) -> DataFrame:
    """Of (source, need, block, words): each source's block at which the running words pass need, and the words before."""
    run = Window.partitionBy("source").orderBy("block")
    cum = blocks.withColumn("__cum", F.sum("words").over(run))
    return cum.where((F.col("__cum") > F.col("need")) & (F.col("__cum") - F.col("words") <= F.col("need"))).select(
        F.col("source").alias("__s"), F.col("block").alias("at"), (F.col("__cum") - F.col("words")).alias("before")
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def plan(slim: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """A row per source: targets, epochs, the boundary block and the hashes picked inside it. And their number."""
    t = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    some = F.col("source_size") > 0
    t = (
        t.withColumn("epochs", F.when(some, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long"))
        .withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
        .withColumn("bits", F.least(F.lit(24), F.length(F.bin((F.col("source_size") / block_words).cast("long"))) - 1))
        .withColumn("hi", F.least(F.lit(12), F.col("bits")))
    )
    t = materialise(t)
    n = t.count()
    drawn = lookup_join(slim.where("size > 0").withColumnRenamed("source", "__d"), t.where(some), _same("__d", "source"), n).drop("__d")
    top = drawn.groupBy("source", "need", F.expr(f"shiftright(h, {BITS} - hi)").alias("block")).agg(F.sum("size").alias("words"))
    t = t.join(_locate(top), _same("source", "__s"), "left").drop("__s").withColumnsRenamed({"at": "at_hi", "before": "before_hi"})
    t = materialise(t)
    inside = lookup_join(slim.where("size > 0").withColumnRenamed("source", "__d"), t.where("at_hi IS NOT NULL"), _same("__d", "source"), n).drop("__d")
    inside = inside.where(F.expr(f"shiftright(h, {BITS} - hi) = at_hi"))
    low = inside.groupBy("source", (F.col("need") - F.col("before_hi")).alias("need"), F.expr(f"shiftright(h, {BITS} - bits)").alias("block")).agg(
        F.sum("size").alias("words")
    )
    t = t.join(_locate(low), _same("source", "__s"), "left").drop("__s")
    t = materialise(t)
    edge = lookup_join(slim.where("size > 0").withColumnRenamed("source", "__d"), t.where("at IS NOT NULL"), _same("__d", "source"), n).drop("__d")
    edge = (
        edge.where(F.expr(f"shiftright(h, {BITS} - bits) = at"))
        .groupBy("source", "need", "before_hi", "before", "h")
        .agg(F.sum("size").alias("words"))
        .groupBy("source", (F.col("need") - F.col("before_hi") - F.col("before")).alias("need"))
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("words")).alias("w"), "h"))).alias("docs"))
    )
    picks = edge.select(
        F.col("source").alias("__s"),
        F.expr(
            "aggregate(docs, struct(need AS left, cast(array() AS array<bigint>) AS got), "
            "(a, d) -> CASE WHEN -d.w <= a.left THEN struct(a.left + d.w AS left, array_append(a.got, d.h) AS got) ELSE a END, a -> a.got)"
        ).alias("picks"),
    )
    return materialise(t.join(picks, _same("source", "__s"), "left").drop("__s")), n


def leaves(blocks: int, shards: int) -> list[int]:
    """Where each shard's run of permuted blocks ends: a node's shards are halved, and each side gets its share of the blocks."""
    if shards == 1:
        return [blocks]
    left = shards // 2
    share = blocks * left // shards
    return leaves(share, left) + [share + x for x in leaves(blocks - share, shards - left)]


def block_hash(rank: Column, epoch: Column, block: Column, seed: str) -> Column:
    """The place of a drawn block in the permutation: 60 uniform bits, which other engines can repeat."""
    key = F.concat_ws(":", F.lit(f"{seed}-tree"), rank.cast("string"), epoch.cast("string"), block.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def drawn_blocks(par: DataFrame, seed: str) -> DataFrame:
    """(h, rank, epoch, block): a row for each block of each source's quota. par is plan()'s table."""
    each = par.where("source_size > 0").select("rank", "epochs", F.coalesce(F.when(F.col("need") > 0, F.col("at")), F.lit(-1)).alias("at"), F.explode(F.expr("sequence(0L, shiftleft(1L, bits) - 1)")).alias("block"))
    copies = each.withColumn("n", F.col("epochs") + F.when(F.col("block") <= F.col("at"), 1).otherwise(0)).where("n > 0")
    rows = copies.select("rank", F.explode(F.expr("sequence(0L, n - 1)")).alias("epoch"), "block")
    return rows.select(block_hash(F.col("rank"), F.col("epoch"), F.col("block"), seed).alias("h"), F.col("rank").cast("long"), "epoch", "block")


def cuts(blocks: DataFrame, shards: int) -> list[tuple]:
    """For each shard but the last, the first (h, rank, epoch, block) behind its run of the permutation; shards behind all blocks have none.

    Two histogram levels of 4096 ranges each bracket the ranks sought; only the ranges that hold one are ordered.
    """
    total = blocks.count()
    open_ = {(): sorted({x for x in leaves(total, shards)[:-1] if x < total})}  # prefix of ranges -> ranks inside it
    for level in (1, 2):
        shift, prefixes = BITS - 12 * level, [p[-1] for p in open_ if p]
        inside = blocks.where(F.shiftright("h", shift + 12).isin(prefixes)) if prefixes else blocks
        rows = inside.groupBy(F.shiftright("h", shift).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()  # 4096 ranges of each of at most `shards` prefixes
        found: dict[tuple, list[int]] = {}
        for prefix, ranks in open_.items():
            before = 0
            for r in sorted((r for r in rows if not prefix or r["k"] >> 12 == prefix[-1]), key=lambda r: r["k"]):
                mine = [x - before for x in ranks if before <= x < before + r["n"]]
                if mine:
                    found[(*prefix, r["k"])] = mine
                before += r["n"]
        open_ = found
    if not open_:
        return []
    last = F.shiftright("h", BITS - 24)
    order = Window.partitionBy("k").orderBy("h", "rank", "epoch", "block")
    ranked = blocks.withColumn("k", last).where(F.col("k").isin([p[-1] for p in open_])).withColumn("at", F.row_number().over(order) - 1)
    wanted = F.lit(False)
    for p, ranks in open_.items():
        wanted = wanted | ((F.col("k") == p[-1]) & F.col("at").isin(ranks))
    return sorted(tuple(r) for r in ranked.where(wanted).select("h", "rank", "epoch", "block").collect())


def shard_of(place: Column, found: list[tuple], total: int, shards: int) -> Column:
    """The shard of a block: the number of runs that end at or before it. Runs that are empty share their neighbour's cut."""
    ends = [x for x in leaves(total, shards)[:-1]]
    distinct = sorted({x for x in ends if x < total})
    at = {x: found[k] for k, x in enumerate(distinct)}
    shown = [at[x] for x in ends if x < total]
    if not shown:
        return F.lit(0)
    table = F.array(*[F.struct(*[F.lit(int(v)).cast("long") for v in c]) for c in shown])
    return F.size(F.filter(table, lambda c: c <= place))


def _dealt(rows: DataFrame, slim: DataFrame, weights, max_epochs: int, shards: int, block_words: int, seed: str) -> tuple[DataFrame, int]:
    """rows (doc_id, source, size, h and others) with copies, taken, targets and the shard of each copy; and the number of words taken. slim is rows' (source, size, h)."""
    par, n = plan(slim, weights, max_epochs, block_words)
    blocks = materialise(drawn_blocks(par, seed))
    total = blocks.count()
    found = cuts(blocks, shards)
    small = par.withColumnRenamed("source", "__s")
    rows = lookup_join(rows.withColumnRenamed("source", "__d"), small, _same("__d", "__s"), n)
    block = F.expr(f"shiftright(h, {BITS} - bits)")
    edge = F.coalesce(F.col("at"), F.lit(-1))
    extra = F.when(F.col("size") == 0, 0).when(block < edge, 1).when((block == edge) & F.array_contains("picks", F.col("h")), 1).otherwise(0)
    rows = rows.withColumn("__block", block).withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + extra).otherwise(0).cast("long"))

    def one(i: Column) -> Column:
        place = F.struct(block_hash(F.col("rank"), i, F.col("__block"), seed), F.col("rank").cast("long"), i, F.col("__block"))
        return shard_of(place, found, total, shards).cast("int")

    spread = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), one)).otherwise(F.expr("cast(array() AS array<int>)"))
    words = par.agg(F.sum("target")).first()[0] or 0
    return rows.withColumns({"source": F.col("__d"), "taken": (F.col("copies") * F.col("size")).cast("long"), "shards": spread}), int(words)


def allotment(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """(source, shard, blocks): what the tree gives each shard of each source's quota."""
    slim = _slim(docs, seed)
    par, _ = plan(slim, weights, max_epochs, block_words)
    blocks = materialise(drawn_blocks(par, seed))
    total = blocks.count()
    place = F.struct("h", "rank", "epoch", "block")
    counted = blocks.groupBy("rank", shard_of(place, cuts(blocks, shards), total, shards).alias("shard")).agg(F.count(F.lit(1)).alias("blocks"))
    return counted.join(par.select("source", F.col("rank").cast("long")), "rank").select("source", "shard", "blocks")


def _slim(docs: DataFrame, seed: str) -> DataFrame:
    return materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), keyed_hash(seed).alias("h")))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """A row per document: doc_id, source, size, h, source_size, target, copies, taken and the shard of each copy."""
    slim = _slim(docs, seed)
    rows, _ = _dealt(slim, slim, weights, max_epochs, shards, block_words, seed)
    return rows.select("doc_id", "source", "size", "h", "source_size", "target", "copies", "taken", "shards")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """The mix itself: docs' rows, each as often as the mix takes it, laid out by shard and shuffled inside it.

    A document that the mix takes no words of (its text is empty, or its source is cut) is left out.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), keyed_hash(seed).alias("h"))
    dealt, words = _dealt(rows, _slim(docs, seed), weights, max_epochs, shards, block_words, seed)
    tasks = max(1, -(-words // (shards * TASK_WORDS)))
    out = dealt.where("copies > 0").select("row", "h", F.explode("shards").alias("shard"))
    out = out.repartition("shard", F.pmod("h", F.lit(tasks))).sortWithinPartitions("shard", F.xxhash64("h", "shard"))
    return out.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """shards: the shard of each copy, in order of epochs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("shards", lambda x: x.cast("string")), ",").alias("shards"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, source_size::DOUBLE * 3 AS cap FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS k,
    (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT *, least(cap, (SELECT min_by(level, k) FROM l WHERE cap >= level * weight) * weight) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS epochs,
    least(24, length(bin(source_size // 65536)) - 1) AS bits FROM t),
q AS (SELECT *, greatest(0.0, target - epochs * source_size) AS need FROM p),
b AS (SELECT d.source, h >> (60 - bits)::BIGINT AS block, sum(size)::BIGINT AS words FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source WHERE size > 0 GROUP BY ALL),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY block) AS cum FROM b),
e AS (SELECT c.source, block AS edge, need - (cum - words) AS room FROM c JOIN q ON q.source IS NOT DISTINCT FROM c.source WHERE cum > need AND cum - words <= need),
f AS (SELECT d.source, h, size, room, row_number() OVER (PARTITION BY d.source ORDER BY size DESC, h) AS n
      FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source JOIN e ON e.source IS NOT DISTINCT FROM d.source WHERE size > 0 AND h >> (60 - bits)::BIGINT = edge),
g AS (SELECT source, h, n, size <= room AS pick, CASE WHEN size <= room THEN room - size ELSE room END AS room FROM f WHERE n = 1
      UNION ALL SELECT f.source, f.h, f.n, f.size <= g.room, CASE WHEN f.size <= g.room THEN g.room - f.size ELSE g.room END
      FROM g JOIN f ON f.source IS NOT DISTINCT FROM g.source AND f.n = g.n + 1),
nb AS (SELECT rank, epochs, CASE WHEN need > 0 THEN coalesce(edge, -1) ELSE -1 END AS edge, unnest(range((1::BIGINT << bits::BIGINT))) AS block
    FROM q LEFT JOIN e ON e.source IS NOT DISTINCT FROM q.source WHERE source_size > 0),
db AS (SELECT rank, block, unnest(range(epochs + CASE WHEN block <= edge THEN 1 ELSE 0 END)) AS epoch FROM nb),
ph AS (SELECT *, ('0x' || substr(md5('mix-tree:' || rank || ':' || epoch || ':' || block), 1, 15))::BIGINT AS place FROM db),
pn AS (SELECT *, row_number() OVER (ORDER BY place, rank, epoch, block) - 1 AS at FROM ph),
tree AS (SELECT 0::BIGINT AS lo, (SELECT count(*) FROM pn)::BIGINT AS n, 16 AS k, 0 AS shard
    UNION ALL SELECT CASE side WHEN 0 THEN lo ELSE lo + n * (k // 2) // k END, CASE side WHEN 0 THEN n * (k // 2) // k ELSE n - n * (k // 2) // k END,
      CASE side WHEN 0 THEN k // 2 ELSE k - k // 2 END, CASE side WHEN 0 THEN shard ELSE shard + k // 2 END FROM tree, (VALUES (0), (1)) v(side) WHERE k > 1),
bs AS (SELECT pn.rank, pn.block, pn.epoch, tree.shard FROM pn JOIN tree ON tree.k = 1 AND pn.at >= tree.lo AND pn.at < tree.lo + tree.n),
o AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.rank, d.h >> (60 - bits)::BIGINT AS block,
  CASE WHEN d.size = 0 THEN 0 ELSE epochs + CASE WHEN d.h >> (60 - bits)::BIGINT < coalesce(edge, -1) OR coalesce(g.pick, false) THEN 1 ELSE 0 END END AS copies
  FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source LEFT JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.h = d.h)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
  coalesce((SELECT string_agg(bs.shard::VARCHAR, ',' ORDER BY bs.epoch) FROM bs WHERE bs.rank = o.rank AND bs.block = o.block AND bs.epoch < o.copies), '') AS shards
FROM o"""
