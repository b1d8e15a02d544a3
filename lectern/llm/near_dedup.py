"""MinHash near-duplicate detection with sequential Bayesian verification.

1.  One pass over the texts gives each row its number of distinct shingles, a 128-bit
    fingerprint of the shingle set and a signature: the low 8 bits of BANDS * ROWS min-hashes.
    Rows with equal sets form a class; one row of its smallest doc_id stands for it.
2.  A band is ROWS neighbouring bytes of the signature; classes with an equal band share a
    bucket. Buckets of one member are dropped before members are gathered. In a first round each bucket
    proposes its members against its first one. Candidates are compared a batch of min-hashes at a time; a pair
    is dropped as soon as the posterior probability (uniform prior) that its similarity reaches the
    threshold falls below MISS. Survivors are verified exactly on the full shingle sets of their texts, and
    verified links are contracted to components. For that, the texts are dealt by the first of the pair in
    parts of about STAR rows, so each text travels once for each pair's first, and no large group meets in one task.
3.  Further rounds each take a share of the bands; a bucket proposes those members that are not yet
    in the component of a member drawn at random. So candidates grow with the members of buckets
    and not with their squares, while a large group comes together in a round or two.
4.  The pairs of different components that still share a bucket are left. If they are fewer than the
    buckets' members, all of them are checked. Else bounds that are exact narrow them (see `narrowed`):
    documents that only resemble a large group have rare shingles of their own, so too few common
    ones to reach the threshold. Every banded pair is thus checked, ruled out or already connected:
    no link between pairs that share a bucket is lost.

Words are runs of non-white-space, A-Z lower-cased; a document with fewer words than a shingle is
one shingle of them all. A pair at the threshold shares no band with a probability of
(1 - 0.8 ** ROWS) ** BANDS = 5e-6; unlike pairs rarely share one (at similarity 0.1, 1 in 25000).

Defined results: null or empty text has an empty set and links with nothing; rows with a null
doc_id link with nothing and have a null component; rows with equal doc_id but different texts are told apart
(each links by its own text); ties cannot occur, as the smallest doc_id decides and equal ones share it; very long texts
are taken whole, a run of texts at a time; an empty table gives an empty result; other columns, whatever their
names, are ignored (`deduplicated` carries them).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, in_batches, materialise
from lectern.llm.components import components
from lectern.llm.textcore import U, groups, mix, sliced, word_hashes

ROWS, BANDS = 6, 40
HASHES = ROWS * BANDS
BATCH = 40
THRESHOLD = 80
MISS = 1e-7
#: The bands are dealt to so many rounds of random centres.
ROUNDS = 8
#: A shingle that at most so many members of a crowd have is rare.
RARE = 16
#: At most so many rows of two or three ids are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rows of one part of a pair's first member, on average, when texts are compared.
STAR = 500

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_MUL = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]


def shingle_sets(texts: list[bytes], width: int):
    """Each text's sorted distinct shingle hashes (uint64)."""
    for lo, hi in groups(texts):
        hashes, counts = word_hashes(texts[lo:hi])
        at = 0
        for n in counts.tolist():
            w = hashes[at : at + n]
            at += n
            k = min(width, n)
            if not k:
                yield w
                continue
            value = w[: n - k + 1].copy()
            for j in range(1, k):
                value = mix(value) * U(0x100000001B3) + w[j : n - k + 1 + j]
            yield np.unique(mix(value + U(k)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low bytes of HASHES min-hashes."""
    x = (shingles >> U(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, ((x[None, at : at + 512] ^ _XOR) * _MUL).min(axis=1), out=low)
    return low.astype(np.uint8)


def fingerprint(shingles: np.ndarray) -> tuple[int, int, int]:
    """The size of a set and two independent 64-bit sums over it (signed)."""
    if not len(shingles):
        return 0, 0, 0
    p, q = np.array([mix(shingles).sum(), mix(shingles ^ U(0x5851F42D4C957F2D)).sum()], dtype=U).view(np.int64).tolist()
    return len(shingles), p, q


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, rid, n_shingles, fingerprint (p, q) and signature of each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        rid = TaskContext.get().partitionId() << 36
        for batch in sliced(batches):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            n = len(texts)
            prints, sig = np.zeros((n, 3), dtype=np.int64), []
            for i, x in enumerate(shingle_sets(texts, width)):
                prints[i] = fingerprint(x)
                sig.append(signature(x).tobytes() if len(x) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.arange(rid, rid + n)), *(pa.array(prints[:, k].copy()) for k in range(3)), pa.array(sig, pa.binary())],
                ["doc_id", "rid", "n_shingles", "p", "q", "sig"],
            )
            rid += n

    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, rid long, n_shingles long, p long, q long, sig binary")


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes seen, matches needed) after each batch: fewer matches leave a posterior below miss.

    Bytes of unlike min-hashes match once in 256, which the threshold takes in.
    """
    out = []
    threshold += (1 - threshold) / 256
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, need = 0.0, n + 1
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                need = m
                break
        out.append((n, need))
    return out


def _prune(threshold: int):
    steps = least_matches(threshold / 100, MISS)

    def run(batches):
        for batch in sliced(batches):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            left, seen = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
            for n, need in steps:
                seen = seen + (a[left, n - BATCH : n] == b[left, n - BATCH : n]).sum(axis=1)
                good = seen >= need
                left, seen = left[good], seen[good]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(left)) for c in ("a", "b")], ["a", "b"])

    return run


def _exact(width: int, threshold: int):
    """Over rows (a, part, rid, text), each part's first row being a itself: the pairs (a, rid) that reach the threshold."""

    def run(batches):
        key = star = None
        for batch in sliced(batches):
            firsts, parts, rids = (batch.column(c).to_pylist() for c in ("a", "part", "rid"))
            texts, good = batch.column("text"), []
            for i, (a, part, rid) in enumerate(zip(firsts, parts, rids, strict=True)):
                own = next(shingle_sets([texts[i].as_py().encode()], width))
                if (a, part) != key:
                    key, star = (a, part), own
                    continue
                shared = len(np.intersect1d(star, own, assume_unique=True))
                if 100 * shared >= threshold * (len(star) + len(own) - shared):
                    good.append((a, rid))
            made = np.array(good, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])

    return run


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows (of few ids) are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def verified(s: Scratch, pairs: DataFrame, sig: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Of candidate (a, b), a table of those whose full sets reach the threshold. sig (rid, n, sig) and texts (rid, text) have all ends."""
    a, b = (sig.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").where(_near_enough("n_a", "n_b", threshold))
    near = s.keep(in_batches(both.select("a", "b", "sig_a", "sig_b"), _prune(threshold), "a long, b long"))
    load = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts")).where("parts > 1")
    dealt = near.join(load, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    member = dealt.select(F.col("b").alias("rid"), "a", "part", F.lit(True).alias("member"))
    wants = s.keep(member.unionByName(dealt.select(F.col("a").alias("rid"), "a", "part", F.lit(False).alias("member")).distinct()))
    rows = texts.join(few(wants), "rid").repartition("a", "part").sortWithinPartitions("a", "part", "member")
    out = s.keep(in_batches(rows.select("a", "part", "rid", "text"), _exact(width, threshold), "a long, b long"))
    s.drop(near, wants)
    return out


def _near_enough(x: str, y: str, threshold: int):
    """Sets of so different sizes cannot reach the threshold."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * threshold


def texts_of(docs: DataFrame, rows: DataFrame, twice: DataFrame, width: int) -> DataFrame:
    """(rid, text) for rows (doc_id, rid, n_shingles, p, q): texts found by doc_id, and by fingerprint where doc_ids of twice (doc_id) repeat."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(few(rows), "doc_id")
    if twice.isEmpty():
        return found.select("rid", "text")

    def run(batches):
        for batch in sliced(batches):
            texts = [x.encode() for x in batch.column("text").to_pylist()]
            same = [fingerprint(x) for x in shingle_sets(texts, width)]
            want = zip(*(batch.column(c).to_pylist() for c in ("n_shingles", "p", "q")), strict=True)
            good = pa.array([i for i, (x, y) in enumerate(zip(same, want, strict=True)) if x == y], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(good) for c in ("rid", "text")], ["rid", "text"])

    return in_batches(found, run, "rid long, text string").dropDuplicates(["rid"])


def links(s: Scratch, reps: DataFrame, docs: DataFrame, twice: DataFrame, width: int, threshold: int) -> DataFrame:
    """A table (node, component), by rid, of all linked classes of reps (doc_id, rid, n_shingles, p, q, sig)."""
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), j -> xxhash64(j, substring(sig, {ROWS} * j + 1, {ROWS})))")
    buckets = reps.select("rid", F.explode(keys).alias("key"))
    stars = s.keep(buckets.groupBy("key").agg(F.min("rid").alias("a"), F.max("rid").alias("z"), F.count(F.lit(1)).alias("m")).where("a <> z"))
    # A bucket of two is a pair already; only members of larger ones are gathered.
    crowded = s.keep(buckets.join(few(stars.where("m > 2").select("key", "a")), "key"))
    members = crowded.count()
    seen = stars.where("m = 2").select("a", F.col("z").alias("b")).unionByName(crowded.where("rid <> a").select("a", F.col("rid").alias("b")))
    seen = s.keep(seen.distinct())
    s.drop(stars)
    ids = s.keep(seen.select(F.col("a").alias("rid")).unionByName(seen.select(F.col("b").alias("rid"))).distinct())
    found = reps.join(few(ids), "rid", "left_semi")
    sig = s.keep(found.select("rid", F.col("n_shingles").alias("n"), "sig"))
    texts = s.keep(texts_of(docs, found.select("doc_id", "rid", "n_shingles", "p", "q"), twice, width))
    s.drop(ids)
    comp = _contracted(s, None, verified(s, seen, sig, texts, width, threshold))
    crowded = crowded.drop("a")
    k, going = 0, True
    while True:
        named = crowded.join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("c", F.coalesce("component", "rid")).drop("component")
        sizes = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"))
        sizes = s.keep(sizes.where("m * m > mm").select("key", ((F.col("m") * F.col("m") - F.col("mm")) / 2).alias("open")))
        left = sizes.agg(F.sum("open")).first()[0] or 0
        if not left:
            break
        split = s.keep(named.join(few(sizes.select("key")), "key"))
        s.drop(sizes)
        last = left <= members or not going
        if left <= members:
            x, y = (split.select("key", F.col("rid").alias(d), F.col("c").alias(f"c_{d}")) for d in "ab")
            cross = x.join(y, "key").where("a < b AND c_a <> c_b")
        elif last:
            cross = narrowed(s, split, sig, texts, width, threshold)
        else:
            part = split.where(F.pmod("key", F.lit(ROUNDS)) == k)
            centre = part.groupBy("key").agg(F.min_by(F.struct(F.col("rid").alias("a"), F.col("c").alias("c_a")), F.xxhash64("rid", "key")).alias("s"))
            cross = part.join(centre.select("key", "s.*"), "key").where("c <> c_a").select(F.least("a", "rid").alias("a"), F.greatest("a", "rid").alias("b"))
        cross = s.keep(cross.select("a", "b").distinct().join(seen, ["a", "b"], "left_anti"))
        n_cross = cross.count()
        more = verified(s, cross, sig, texts, width, threshold)
        n_found = more.count()
        if n_found:
            comp = _contracted(s, comp, more)
        if last:
            break
        going = k + 1 < ROUNDS and n_found * 10 > n_cross
        seen = seen.unionByName(cross)
        crowded = split.select("key", "rid")
        k += 1
    return comp


def narrowed(s: Scratch, crowded: DataFrame, sig: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of crowded (key, rid, c), of different c, that can reach the threshold.

    Members that share buckets, directly or by others, are a crowd. In it a shingle is rare if at most RARE
    members have it. Similar sets x and y share t / (1 + t) (|x| + |y|) shingles; so they share a rare one,
    or that many common ones. The first kind of pairs is found by rare shingles. For the second kind, x can
    only have partners of |x| t to (1 + t) / t common(x) - |x| shingles, and y likewise: rows are joined by crowd
    and both size classes where different components face each other, one side without its largest
    component, and a pair comes out only if it has enough common shingles. So members that only resemble a
    large group make no pairs with it.
    """

    def run(batches):
        for batch in sliced(batches):
            sets = list(shingle_sets([x.encode() for x in batch.column("text").to_pylist()], width))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, dtype=U)]).view(np.int64)))], ["rid", "h"])

    members = s.keep(crowded.select("rid", "c").distinct().join(sig.select("rid", "n"), "rid"))
    stars = crowded.groupBy("key").agg(F.min("rid").alias("a"))
    crowds = components(s, crowded.join(stars, "key").select("a", F.col("rid").alias("b")).distinct()).select(F.col("node").alias("rid"), F.col("component").alias("crowd"))
    rows = in_batches(texts.join(few(members.select("rid")), "rid", "left_semi"), run, "rid long, h array<long>")
    rows = s.keep(rows.join(crowds, "rid").select("rid", "crowd", F.explode("h").alias("h")))
    df = rows.groupBy("crowd", "h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = s.keep(rows.join(df, ["crowd", "h"]))
    s.drop(rows)

    rare = known.where(F.col("df") <= RARE).join(members, "rid")
    several = rare.groupBy("crowd", "h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("crowd", "h")
    rare = rare.join(several, ["crowd", "h"], "left_semi")
    x, y = (rare.select("crowd", "h", F.col("rid").alias(d), F.col("c").alias(f"c_{d}"), F.col("n").alias(f"n_{d}")) for d in "ab")
    by_rare = x.join(y, ["crowd", "h"]).where("a < b AND c_a <> c_b").where(_near_enough("n_a", "n_b", threshold)).select("a", "b").distinct()

    common = s.keep(known.where(F.col("df") > RARE).groupBy("rid").agg(F.collect_list("h").alias("hs")))
    least, most = F.ceil(F.col("n") * threshold / F.lit(100)), F.floor(F.least(F.col("n") * F.lit(100) / threshold, F.size("hs") * F.lit(100 + threshold) / threshold - F.col("n")))
    open_ = members.join(common, "rid").select("rid", "n", "c", least.cast("long").alias("least"), most.cast("long").alias("most")).where("least <= most")

    def size_class(v: str):
        return F.floor(F.log(F.col(v).cast("double")) / F.lit(math.log(1.02))).cast("int")

    sides = open_.join(crowds, "rid").withColumn("own", size_class("n")).withColumn("other", F.explode(F.sequence(size_class("least"), size_class("most"))))
    x, y = _sides(s.keep(sides))
    some = facing(s, x, y)
    hs = [common.select(F.col("rid").alias(f"{v}_rid"), F.col("hs").alias(f"{v}_hs")) for v in "xy"]
    x = x.join(some, ["crowd", "s", "t"]).where("x_c <> largest").drop("largest").join(hs[0], "x_rid")
    y = y.join(some.drop("largest"), ["crowd", "s", "t"], "left_semi").join(hs[1], "y_rid")
    fits = F.expr("x_c <> y_c AND y_n BETWEEN x_least AND x_most AND x_n BETWEEN y_least AND y_most")
    enough = F.size(F.array_intersect("x_hs", "y_hs")) * (100 + threshold) >= (F.col("x_n") + F.col("y_n")) * threshold
    by_common = x.join(y, ["crowd", "s", "t"]).where(fits & enough).select(F.least("x_rid", "y_rid").alias("a"), F.greatest("x_rid", "y_rid").alias("b")).distinct()
    return by_rare.unionByName(by_common)


def _sides(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each member as x, of its own class s with partners of class t, and as y, the other way round."""
    names = ("rid", "n", "c", "least", "most")
    x = sides.select("crowd", F.col("own").alias("s"), F.col("other").alias("t"), *[F.col(v).alias(f"x_{v}") for v in names])
    y = sides.select("crowd", F.col("other").alias("s"), F.col("own").alias("t"), *[F.col(v).alias(f"y_{v}") for v in names])
    return x, y


def facing(s: Scratch, x: DataFrame, y: DataFrame) -> DataFrame:
    """(crowd, s, t, largest): where members of different components face each other, and the largest of these."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = x.select("crowd", "s", "t", F.col("x_c").alias("c"), one.alias("i"), none.alias("j")).unionByName(y.select("crowd", "s", "t", F.col("y_c").alias("c"), none.alias("i"), one.alias("j")))
    by = both.groupBy("crowd", "s", "t", "c").agg(F.sum("i").alias("i"), F.sum("j").alias("j")).groupBy("crowd", "s", "t")
    pairs = F.sum("i") * F.sum("j") - F.sum(F.col("i") * F.col("j"))
    return s.keep(by.agg(pairs.alias("pairs"), F.max(F.struct(F.col("i") + F.col("j"), "c"))["c"].alias("largest")).where("pairs > 0").drop("pairs"))


def _contracted(s: Scratch, comp: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components after further edges, in place of comp; edges and comp are dropped."""
    if comp is None:
        out = components(s, edges)
        s.drop(edges)
        return out
    ends = edges
    for x in "ab":
        ends = ends.join(comp.select(F.col("node").alias(x), F.col("component").alias("__c")), x, "left").withColumn(x, F.coalesce("__c", x)).drop("__c")
    later = components(s, ends)
    old = comp.join(later.select(F.col("node").alias("component"), F.col("component").alias("__to")), "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
    fresh = later.join(comp.select(F.col("node").alias("__n")), F.col("node") == F.col("__n"), "left_anti")
    out = s.keep(old.unionByName(fresh))
    s.drop(edges, later, comp)
    return out


def grouped(s: Scratch, docs: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: a row for each row of docs (doc_id, rid, n_shingles, p, q, rep_rid, node, component_id), and the doc_ids (doc_id) of several rows.

    node is the component's rid, null for rows that link with nothing by themselves (no shingle or no doc_id).
    """
    slim = s.keep(sketches(docs, width))
    twice = s.keep(slim.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id"))
    keyed = slim.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = keyed.groupBy("n_shingles", "p", "q").agg(F.min("doc_id").alias("rep"), F.min_by("rid", "doc_id").alias("rep_rid"))
    classes = s.keep(classes)
    reps = s.keep(keyed.join(classes.select(F.col("rep_rid").alias("rid")), "rid", "left_semi"))
    comp = links(s, reps, docs, twice, width, threshold)
    s.drop(reps)
    named = s.keep(classes.join(comp.withColumnRenamed("node", "rep_rid"), "rep_rid", "left").withColumn("node", F.coalesce("component", "rep_rid")).drop("component"))
    least = named.groupBy("node").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "node").select("n_shingles", "p", "q", "rep_rid", "node", "component_id")
    rows = slim.select("doc_id", "rid", "n_shingles", "p", "q")
    bare = rows.where("n_shingles = 0 OR doc_id IS NULL").withColumns({"rep_rid": F.lit(None).cast("long"), "node": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return rows.where("n_shingles > 0 AND doc_id IS NOT NULL").join(named, ["n_shingles", "p", "q"]).unionByName(bare), twice


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text). threshold in percent."""
    with Scratch(docs.sparkSession) as s:
        rows, _ = grouped(s, docs.select("doc_id", "text"), width, threshold)
        return materialise(rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))


def deduplicated(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row for each group of near duplicates: that of the smallest doc_id.

    Rows with a null doc_id all stay. Of rows that repeat a doc_id and a text, one does; of rows that repeat
    a doc_id with different texts, each is judged by its own text.
    """
    with Scratch(docs.sparkSession) as s:
        rows, twice = grouped(s, docs.select("doc_id", "text"), width, threshold)
        rows = s.keep(rows.where("doc_id IS NOT NULL"))
        first = rows.where("doc_id = component_id").groupBy(F.coalesce("node", "rid").alias("node")).agg(F.min("rid").alias("rid")).select("rid")
        gone = rows.select("doc_id", "rid").join(first, "rid", "left_anti").select("doc_id").unionByName(twice).distinct()
        gone = materialise(gone)
        out = docs.join(few(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
        if twice.isEmpty():
            return out
        again = rows.join(few(twice), "doc_id", "left_semi")
        # Rows without a shingle repeat by doc_id alone.
        stay = materialise(again.join(first, "rid", "left_semi").groupBy("doc_id", "n_shingles", "p", "q").agg(F.min("rid").alias("rid")))
    return out.unionByName(_by_print(docs, stay, width))


def _by_print(docs: DataFrame, stay: DataFrame, width: int) -> DataFrame:
    """One row of docs for each of stay (doc_id, n_shingles, p, q)."""
    names = {c: f"__nd_{i}" for i, c in enumerate(docs.columns)}
    mine = docs.join(few(stay.select("doc_id").distinct()), "doc_id", "left_semi")
    mine = mine.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    text = names["text"]

    def run(batches):
        for batch in sliced(batches):
            prints = [fingerprint(x) for x in shingle_sets([(x or "").encode() for x in batch.column(text).to_pylist()], width)]
            made = [pa.array([x[k] for x in prints], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "n_shingles", "p", "q"])

    kinds = ", ".join(f"{n} {kind}" for n, kind in mine.dtypes)
    printed = in_batches(mine, run, f"{kinds}, n_shingles long, p long, q long").withColumnRenamed(names["doc_id"], "doc_id")
    once = printed.join(stay.select("doc_id", "n_shingles", "p", "q"), ["doc_id", "n_shingles", "p", "q"], "left_semi").dropDuplicates(["doc_id", "n_shingles", "p", "q"])
    return once.select(*[F.col("doc_id") if c == "doc_id" else F.col(n).alias(c) for c, n in names.items()])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=2)


def _oracle() -> str:
    """Exact: all pairs that share a shingle, by an inverted index."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS c FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node),
m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id)::BIGINT AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = w.doc_id"""


ORACLE = _oracle()
