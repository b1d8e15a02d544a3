"""Quality rules as a short-circuit cascade (DataFrame functions only).

Base rules come first. The further rules are independent predicates; on a bounded sample the
operator measures for each its cost (seconds a row, from TIMES evaluations of each row in one job, less a job that
evaluates nothing, so that starting a job does not count) and its selectivity
(share of rows it rejects), and nests them by rejection per cost in one CASE, so that a row
leaves at the first rule that it fails. The order changes the work, never the verdict. Rules over counts that the
result has anyway cost next to nothing and come first unless they reject nothing; those that scan the text again are what the cascade saves.

Defined results: null or empty text has no words, fails the base rule and is not kept; repeated
rows are each judged; rules of equal gain (ties) keep the order given; very long texts are counted whole; without a row in the
sample the order given stays; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD, words

SYMBOLS = r"[#*$%&|<>]"
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
#: Evaluations of a rule on each row of the sample when its cost is measured.
TIMES = 20


def repeat_words(w: str) -> str:
    """SQL for the number of words inside 3-word windows that occur at least twice in array w.

    Windows are sorted, equal neighbours mark repeats, and the marked starts are swept once.
    """
    return f"""element_at(transform(array({w}), w -> CASE WHEN size(w) < 4 THEN 0L ELSE
      element_at(transform(array(sort_array(transform(sequence(0, size(w) - 3),
          i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g, i AS p)))), s ->
        aggregate(sort_array(filter(transform(sequence(0, size(s) - 1), k ->
            CASE WHEN s[k].g = get(s, k - 1).g OR s[k].g = get(s, k + 1).g THEN s[k].p END), p -> p IS NOT NULL)),
          struct(0L AS c, -1 AS e),
          (a, p) -> struct(a.c + p + 3 - greatest(p, a.e) AS c, p + 3 AS e), a -> a.c)), 1) END), 1)"""


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text and the counts that the rules look at."""
    ws = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    return ws.select(
        "doc_id",
        "text",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.expr(repeat_words("__w")).alias("n_repeat_words"),
    ).select(
        "*",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    ).drop("__lines")


@dataclass(frozen=True)
class Rule:
    """A named predicate that is true for rows to reject."""

    name: str
    fails: Column


def rules() -> list[Rule]:
    n = F.col("n_words")
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("word_length", (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 14)),
        Rule("dup_lines", F.col("n_dup_lines") * 2 > F.col("n_lines")),
        Rule("letters", F.regexp_count("text", F.lit(r"\p{L}")) * 10 < F.col("word_chars") * 7),
        Rule("capitals", F.regexp_count("text", F.lit(r"\p{Lu}")) * 2 > F.col("word_chars")),
        Rule("punctuation", F.regexp_count("text", F.lit(r"[!?]")) * 10 > n),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def costs(sample: DataFrame, these: list[Rule]) -> dict[str, float]:
    """Seconds that each rule takes for TIMES passes over the sample."""
    again = sample.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(fails: Column) -> float:
        began = time.perf_counter()
        again.agg(F.count_if(fails & (F.col("__again") > 0))).first()
        return time.perf_counter() - began

    seconds(F.col("n_words") < 0)  # the first job compiles
    nothing = min(seconds(F.col("n_words") < 0) for _ in range(2))
    return {r.name: seconds(r.fails) - nothing for r in these}


def order_rules(sample: DataFrame, these: list[Rule], cost: dict[str, float] | None = None) -> list[Rule]:
    """The rules by rejection per cost on the sample, best first; ties keep the given order. cost: by name, else measured."""
    rejected = sample.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r.fails).alias(r.name) for r in these]).first()
    if not rejected["n"]:
        return these
    cost = costs(sample, these) if cost is None else cost
    gain = {r.name: rejected[r.name] / rejected["n"] / max(cost[r.name], 1e-3) for r in these}
    return sorted(these, key=lambda r: -gain[r.name])


def judge(docs: DataFrame, these: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """features() plus base_failed, failed_rule (the first rule of the cascade that rejects, or null) and kept."""
    these = rules() if these is None else these
    n = docs.count()
    sample = (
        features(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // sample_rows))) == 0).limit(2 * sample_rows))
        .where(~base_failed())
        .persist()
    )
    try:
        ordered = order_rules(sample, these)
    finally:
        sample.unpersist()
    failed = F.when(base_failed(), F.lit("base"))
    for r in ordered:
        failed = failed.when(r.fails, F.lit(r.name))
    return features(docs).select("*", base_failed().alias("base_failed"), failed.alias("failed_rule")).withColumn("kept", F.col("failed_rule").isNull())


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
tri AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
tg AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM tri),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tg WHERE n > 1) GROUP BY doc_id),
f AS (SELECT d.doc_id, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 14 OR n_dup_lines * 2 > n_lines
    OR (length(text) - length(regexp_replace(text, '\p{L}', '', 'g'))) * 10 < word_chars * 7
    OR (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) * 2 > word_chars
    OR (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) * 10 > n_words) AS kept
FROM b"""
