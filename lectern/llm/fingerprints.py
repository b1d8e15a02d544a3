"""Document fingerprints as threshold-scaled sketches (DataFrame functions only).

A sketch holds every shingle hash (the first 48 bits of the MD5 of WIDTH words) below a fixed
fraction of the hash space. As the threshold does not depend on the document, sketches of parts
merge by union, and their overlap estimates containment between very unequal documents too. A
text none of whose hashes is below the threshold is held by its smallest hash. The fingerprint is
the sketch's sorted hashes, 12 hex digits each.

The query also needs each document's successor by descending doc_id. Documents are dealt to ranges of about RANGE
documents, cut at quantiles of doc_id, and each of those at quantiles of its own, so that clustered ids are dealt
as evenly as others (at most QUANTILES * INSIDE ranges; larger tables have larger ranges). Null ids are dealt by their text's MD5. A
window looks one row ahead in a range, and a row per range carries on to the next range.

Defined results: a null text is empty; an empty text has an empty sketch and fingerprint; fewer
words than WIDTH are one shingle of them all; two empty sketches are alike by 1, an empty and
another by 0; equal doc_ids (ties) are ordered by their text, null doc_ids come last, by their text's MD5; very long texts are
sketched whole, with sketches in proportion; rows that repeat one doc_id are one range, whose window spills to disk; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, lookup_join, materialise

WIDTH = 5
#: Hashes whose first hex digit is below this are kept: one in eight.
BELOW = "2"
RANGE = 1000
QUANTILES, INSIDE = 256, 1024


def sketch(text: str, width: int = WIDTH, below: str = BELOW) -> Column:
    """The sorted kept hashes of a text column (not null)."""
    gram = ", ".join(f"w[i + {j}]" for j in range(width))
    return F.expr(
        f"""element_at(transform(array(regexp_extract_all({text}, '{WORD.replace(chr(92), chr(92) * 2)}', 0)), w ->
        CASE WHEN size(w) = 0 THEN cast(array() AS array<string>)
             WHEN size(w) < {width} THEN array(substr(md5(array_join(w, ' ')), 1, 12))
             ELSE element_at(transform(array(transform(sequence(0, size(w) - {width}), i -> substr(md5(concat_ws(' ', {gram})), 1, 12))), all ->
               element_at(transform(array(filter(all, h -> h < '{below}')), low ->
                 CASE WHEN size(low) > 0 THEN sort_array(array_distinct(low)) ELSE array(array_min(all)) END), 1)), 1) END), 1)"""
    )


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity as two sketches estimate it."""
    return F.expr(
        f"""element_at(transform(array(size(array_intersect({a}, {b}))), n -> CASE WHEN size({a}) + size({b}) = 0 THEN 1D
        ELSE n / cast(size({a}) + size({b}) - n AS double) END), 1)"""
    )


def containment(a: str, b: str) -> Column:
    """The share of a's shingles that b has too, as two sketches estimate it."""
    return F.expr(f"CASE WHEN size({a}) = 0 THEN 1D ELSE size(array_intersect({a}, {b})) / cast(size({a}) AS double) END")


def _at_or_below(bounds: Column, value: Column) -> Column:
    return F.size(F.filter(bounds, lambda x: x <= value))


def ranged(docs: DataFrame, rows: int = RANGE) -> DataFrame:
    """docs (doc_id, text) with `range`, in the order of doc_id and about `rows` documents each, and `tie`, the order of null ids (below all)."""
    tie = F.when(F.col("doc_id").isNull(), F.md5("text"))
    nulls = F.lit(-1).cast("long") - F.conv(F.substring(tie, 1, 2), 16, 10).cast("long")
    dealt = docs.withColumn("tie", tie)
    n = docs.count()
    cuts = max(1, min(QUANTILES, n // rows))
    inside = max(1, min(INSIDE, -(-n // (cuts * rows))))
    outer = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 10_000)).first()[0] if cuts > 1 else None
    first = _at_or_below(F.array(*[F.lit(x) for x in sorted(set(outer))]), F.col("doc_id")) if outer else F.lit(0)
    dealt = dealt.withColumn("__outer", first)
    if inside == 1:
        number = F.col("__outer").cast("long")
    else:
        # A row for each outer range, with at most INSIDE - 1 bounds.
        bounds = dealt.where("doc_id IS NOT NULL").groupBy("__outer").agg(F.percentile_approx("doc_id", [i / inside for i in range(1, inside)], 4 * INSIDE).alias("__bounds"))
        dealt = dealt.join(F.broadcast(materialise(bounds)), "__outer", "left")
        number = F.col("__outer").cast("long") * INSIDE + F.coalesce(_at_or_below(F.array_distinct("__bounds"), F.col("doc_id")), F.lit(0))
    return dealt.withColumn("range", F.when(F.col("doc_id").isNull(), nulls).otherwise(number)).select("doc_id", "text", "tie", "range")


def edited(docs: DataFrame, rows: int = RANGE) -> DataFrame:
    """doc_id, text, n_chars, sketch, edited (text), next_sketch for each row of docs (doc_id, text)."""
    dealt = ranged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rows)
    # A row for each range: its first doc_id and the range that follows it (the next lower one; after the lowest the highest).
    heads = dealt.groupBy("range").agg(F.max("doc_id").alias("top"))
    heads = materialise(heads.withColumn("leads", F.coalesce(F.lag("range").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(-1, -1)), F.max("range").over(Window.partitionBy(F.lit(0))))))
    follow = heads.select(F.col("range").alias("from"), F.col("leads").alias("range"))
    n_ranges = heads.count()
    top = lookup_join(dealt, heads.select(F.col("range").alias("__r"), "top"), (F.col("range") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("top")), n_ranges)
    first = top.groupBy("range").agg(F.min(F.struct("tie", "text"))["text"].alias("head"))
    heads = materialise(follow.join(first, "range").select(F.col("from").alias("__from"), "head"))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "tie", "text")
    # Sketches are made behind the shuffle, which then carries texts only.
    ahead = dealt.repartition("range").withColumn("sketch", sketch("text")).select("*", F.lead("text").over(order).alias("__text"), F.lead("sketch").over(order).alias("__sketch"))
    # Both sides are dealt by range, so that the join moves the heads only.
    both = ahead.join(heads.withColumn("head_sketch", sketch("head")), F.col("range") == F.col("__from"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    after = F.coalesce("__text", "head")
    return both.select(
        "doc_id", "text", n.cast("long").alias("n_chars"), "sketch",
        F.concat(F.substring("text", F.lit(1), n - third), F.substring(after, F.lit(1), third)).alias("edited"),
        F.coalesce("__sketch", "head_sketch").alias("next_sketch"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.withColumn("edited_sketch", sketch("edited")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"), F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d),
e AS (SELECT *, text[1:length(text) - length(text) // 3] || nxt[1:length(text) // 3] AS edited FROM l),
t AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e UNION ALL SELECT doc_id, 2, nxt FROM e),
w AS (SELECT doc_id, kind, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (SELECT doc_id, kind, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
        ELSE list_transform(range(1, len(w) - 3), lambda i: md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS h,
        len(w) < 5 AS short FROM w),
k AS (SELECT doc_id, kind, h, CASE WHEN short THEN h ELSE list_filter(h, lambda x: x < '2') END AS low FROM g),
s AS (SELECT doc_id, kind, list_sort(list_distinct(list_transform(CASE WHEN len(low) > 0 OR len(h) = 0 THEN low ELSE [list_min(h)] END, lambda x: substr(x, 1, 12)))) AS s FROM k),
p AS (SELECT a.doc_id, a.s AS sa, b.s AS sb, c.s AS sc, len(list_intersect(a.s, b.s)) AS ib, len(list_intersect(a.s, c.s)) AS ic
      FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.kind = 1 JOIN s c ON a.doc_id = c.doc_id AND c.kind = 2 WHERE a.kind = 0)
SELECT e.doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(sa, '') AS fingerprint, array_to_string(sb, '') AS edited_fingerprint,
  CASE WHEN len(sa) + len(sb) = 0 THEN 1.0 ELSE ib::DOUBLE / (len(sa) + len(sb) - ib) END::DOUBLE AS near_edited,
  CASE WHEN len(sa) + len(sc) = 0 THEN 1.0 ELSE ic::DOUBLE / (len(sa) + len(sc) - ic) END::DOUBLE AS near_next
FROM e JOIN p USING (doc_id)"""
