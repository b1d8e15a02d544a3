"""Bounded, repeatable training samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import lookup_join, materialise


def held_out(modulus: int, remainder: int) -> Column:
    """crc32 of doc_id as text, modulo, equals remainder; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def per_class(rows: DataFrame, label: str, each: int, most: int) -> DataFrame:
    """Of (doc_id, label): the `each` rows of every class with the smallest hashed ids, `most` rows at most in all.

    Classes are counted first, and only ids hashed below a little more than a class's share are ranked, so that no
    class meets in one task as a whole. Hashes are uniform, so that share holds enough but for a chance of 1e-9; then the
    bound is widened until it does. Where the classes are too many for `most`, every class gives its first rows first.
    """
    h = F.xxhash64("doc_id")
    known = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label).distinct()
    counts = materialise(known.groupBy(label).agg(F.count(F.lit(1)).alias("__n")))
    few, slack = counts.count(), each + 6 * each**0.5 + 20
    while True:
        bounded = lookup_join(known.withColumn("__h", h), counts, label, few)
        inside = bounded.where(F.pmod("__h", F.lit(1 << 40)) < F.lit(slack) * (1 << 40) / F.col("__n"))
        got = inside.groupBy(label).agg(F.count(F.lit(1)).alias("__got"))
        short = lookup_join(counts, got, label, few, "left").where(F.coalesce("__got", F.lit(0)) < F.least("__n", F.lit(each)))
        if short.isEmpty():
            break
        slack *= 4
    order = Window.partitionBy(label).orderBy(F.pmod("__h", F.lit(1 << 40)), "__h", "doc_id")
    ranked = inside.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= each)
    return ranked.orderBy("__k", "__h").limit(most).select("doc_id", label)
