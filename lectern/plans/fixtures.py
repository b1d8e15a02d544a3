"""Deterministic damage and geometry over the documents, so that operators meet what they repair.

Each recipe has a form for both engines: SQL text that both accept, or a DataFrame and its SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import spread, table

#: A damage is appended by doc_id % 8; 6 replaces the text, 7 is left alone.
DECORATE = """CASE doc_id % 8
  WHEN 0 THEN concat(text, chr(10), 'Page 9 | Sample Title')
  WHEN 1 THEN concat(text, chr(10), 'Sales reached 7 0% this year.')
  WHEN 2 THEN concat(text, chr(10), '1998 - 2004 was a busy period.')
  WHEN 3 THEN concat(text, chr(10), '```', chr(10), 'x = 1', chr(10), '```')
  WHEN 4 THEN concat(text, chr(10), 'See https://example.org/a.')
  WHEN 5 THEN concat(text, chr(10), 'Results held (Author & Author, 2015; with caveats) and agreed (Lone, 2016).', chr(10), '# References', chr(10), '- Lone, Z. (2016). A study.')
  WHEN 6 THEN repeat('161 162 163 i255 ', 30)
  ELSE text END"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("text", F.expr(DECORATE))


def appended(spark: SparkSession, sf_dir: str, sentences: tuple[str, ...], glue: str = "\n") -> DataFrame:
    """documents, with one of the sentences behind glue, by doc_id."""
    some = F.array(*[F.lit(s) for s in sentences])
    return documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit(glue), F.get(some, F.pmod(F.col("doc_id"), F.lit(len(sentences))).cast("int"))))


def quoted(sentence: str | None) -> str:
    return "NULL" if sentence is None else "'" + sentence.replace("'", "''") + "'"


def appended_sql(sentences: tuple[str | None, ...], column: str = "text", glue: int = 1) -> str:
    """The same in SQL; of a null sentence nothing is left, its newlines (glue) neither."""
    some = ", ".join(map(quoted, sentences))
    return f"concat_ws(repeat(chr(10), {glue}), text, [{some}][doc_id % {len(sentences)} + 1]) AS {column}"


def rtf_of(text: str) -> bytes:
    """A text as RTF in cp1252, characters outside it as numbers."""
    out = []
    for c in text:
        if c in "\\{}":
            out.append("\\" + c)
        elif c == "\n":
            out.append("\\par ")
        elif ord(c) < 128:
            out.append(c)
        else:
            own = c.encode("cp1252", "ignore")
            out.append(f"\\'{own[0]:02x}" if own else "".join(f"\\u{int.from_bytes(b, 'little')}?" for b in _pairs(c)))
    return ("{\\rtf1\\ansi\\ansicpg1252 " + "".join(out) + "}").encode("ascii")


def _pairs(c: str) -> list[bytes]:
    raw = c.encode("utf-16-le")
    return [raw[i : i + 2] for i in range(0, len(raw), 2)]


WIDTH, HEIGHT = 612.0, 792.0


def line_blocks(docs: DataFrame) -> DataFrame:
    """A block per line, five to a page, from top to bottom; lines that start with ``#`` are headings."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))
    slot = F.col("seq") % 5
    return rows.select(
        "doc_id", "seq", F.regexp_replace("text", "^# ", "").alias("text"), F.when(F.col("text").startswith("# "), F.lit("section_header")).otherwise(F.lit("text")).alias("label"),
        (F.floor(F.col("seq") / 5) + 1).cast("int").alias("page"), F.lit(50.0).alias("left"), (700 - 130 * slot).cast("double").alias("top"), F.lit(550.0).alias("right"),
        (640 - 130 * slot).cast("double").alias("bottom"), F.lit(WIDTH).alias("page_width"), F.lit(HEIGHT).alias("page_height"),
    )


def line_blocks_sql(docs: str) -> str:
    return f"""(SELECT doc_id, seq, regexp_replace(line, '^# ', '') AS text, CASE WHEN starts_with(line, '# ') THEN 'section_header' ELSE 'text' END AS label,
      cast(floor(seq / 5.0) AS INTEGER) + 1 AS page, 50.0::DOUBLE AS "left", (700 - 130 * (seq % 5))::DOUBLE AS "top", 550.0::DOUBLE AS "right", (640 - 130 * (seq % 5))::DOUBLE AS "bottom"
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS seq FROM {docs}))"""


def page_dims(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "page").distinct().withColumns({"page_width": F.lit(WIDTH), "page_height": F.lit(HEIGHT)})


def _per_page(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "page").distinct()


def footers(blocks: DataFrame) -> DataFrame:
    """The same footer block on every page, behind its lines."""
    p = _per_page(blocks)
    return p.select(
        "doc_id", (F.col("page") + 100_000).alias("seq"), F.lit("Sample Running Title").alias("text"), F.lit("text").alias("label"), "page", F.lit(50.0).alias("left"),
        F.lit(60.0).alias("top"), F.lit(550.0).alias("right"), F.lit(44.0).alias("bottom"), F.lit(WIDTH).alias("page_width"), F.lit(HEIGHT).alias("page_height"),
    )


def pictures(blocks: DataFrame) -> DataFrame:
    """A picture on each page of even documents, over the third block."""
    return _per_page(blocks).where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("picture"), "page", F.lit(190.0).alias("left"), F.lit(540.0).alias("top"), F.lit(409.0).alias("right"), F.lit(380.0).alias("bottom"))


def redactions(blocks: DataFrame) -> DataFrame:
    """A black box over the third line of each page of every tenth document."""
    box = {"left": 50.0, "bottom": 380.0, "right": 550.0, "top": 440.0, "filled": True, "red": 0, "green": 0, "blue": 0, "alpha": 255}
    return _per_page(blocks).where("doc_id % 10 = 0").select("doc_id", "page", *[F.lit(v).alias(k) for k, v in box.items()])


def text_objects(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "page", F.col("seq").alias("obj_seq"), "text", "left", "bottom", "right", "top")


def raised_refs(blocks: DataFrame) -> DataFrame:
    """A reference in the second line's box of each page, with the page as its marker."""
    return _per_page(blocks).select("doc_id", F.col("page").alias("ref_seq"), "page", F.col("page").cast("string").alias("marker"), F.lit(".").alias("anchor"), F.lit(300.0).alias("left"), F.lit(540.0).alias("bottom"))
