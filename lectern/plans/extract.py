"""The plan from blocks to narration (CP4), and from narration to a manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import text as X
from lectern.operators import citations, evidence, layout, lines, quality, reading_order, redaction, tables
from lectern.sources import sinks


@dataclass
class Parsed:
    """What a parser finds in documents; tables that are None are empty."""

    blocks: DataFrame
    page_dims: DataFrame
    pictures: DataFrame | None = None
    tables: DataFrame | None = None
    objects: DataFrame | None = None
    paths: DataFrame | None = None
    page_texts: DataFrame | None = None

    def table(self, name: str, schema) -> DataFrame:
        got = getattr(self, name)
        return self.blocks.sparkSession.createDataFrame([], schema) if got is None else got


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias(name))


def extract(parsed: Parsed, table_mode: str = "smart", drop_patterns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, markdown, narration, the signals, findings, blocked and status of each document.

    What several branches need (blocks once repaired, in order, and without citations) is persisted, so that it is computed once;
    it stays until the session's cache is cleared. The order of passes is part of the result: margin text goes before anything is merged, cover notices before
    pages are joined, footnotes move once the body is in order, citations go by stream, and parentheses after lines are joined.
    """
    # Joins and windows by document and page take rows that are dealt by document as they are.
    parsed.blocks.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    objects = parsed.table("objects", schemas.TEXT_OBJECTS)
    refs, joins = evidence.raised_references(objects), evidence.word_joins(objects)
    hidden_rows = layout.hidden_objects(objects, layout.redaction_boxes(parsed.table("paths", schemas.PATHS), parsed.page_dims))
    hidden = layout.hidden_texts(hidden_rows)
    pictures = layout.content_pictures(parsed.table("pictures", schemas.PICTURES), parsed.page_dims)

    marked = layout.margin_furniture(parsed.blocks.repartition("doc_id"))
    signals = [_count(marked.where("furniture"), "removed_margin_blocks")]
    covered = layout.front_matter(marked.where("NOT furniture").drop("furniture"))
    signals.append(_count(covered.where("front"), "removed_front_matter_blocks"))
    body = covered.where("NOT front").drop("front").withColumn("text", X.strip_notice(F.col("text"))).where("text <> ''")
    noted = layout.strip_table_notes(body)
    signals.append(_count(body.where(F.col("text").rlike(layout.LOW_VALUE_NOTE)), "omitted_table_notes"))

    repaired = evidence.repair_blocks(noted, refs, layout.known_markers(noted, refs), joins, parsed.table("page_texts", schemas.PAGE_TEXTS)).persist()
    signals.append(
        repaired.groupBy("doc_id").agg(
            F.sum("removed_markers").cast("int").alias("removed_inline_markers"), F.sum("joined_words").cast("int").alias("repaired_source_words"),
            F.sum("restored_numbers").cast("int").alias("repaired_source_numbers"), F.sum("restored_forms").cast("int").alias("repaired_source_forms"),
        )
    )
    blocks = repaired.select(*schemas.BLOCKS.fieldNames())
    kept = layout.strip_visual_labels(blocks, pictures)
    signals.append(_count(blocks.join(kept.select("doc_id", "seq"), ["doc_id", "seq"], "left_anti"), "removed_visual_labels"))

    grids = tables.table_blocks(parsed.table("tables", schemas.TABLES), parsed.page_dims, table_mode)
    figures = layout.visual_notes(pictures)
    signals.append(grids.groupBy("doc_id").agg(F.count_if("narrated").cast("int").alias("narrated_text_tables"), F.count_if(~F.col("narrated")).cast("int").alias("omitted_data_tables")))
    signals.append(figures.groupBy("doc_id").agg(F.sum("n_pictures").cast("int").alias("marked_visuals")))
    notes = grids.drop("narrated", "table_no").unionByName(figures.drop("n_pictures"))

    ordered = reading_order.order_for_narration(layout.insert_notes(kept, notes)).persist()
    placed = layout.place_footnotes(ordered, refs)
    cited = citations.filter_citation_blocks(placed).persist()
    signals.append(cited.groupBy("doc_id").agg(F.max("omitted").alias("omitted_citation_blocks"), F.max("explanations").alias("retained_explanatory_notes")))
    docs = parsed.blocks.select("doc_id").distinct().join(reading_order.render_markdown(cited), "doc_id", "left").withColumn("markdown", F.coalesce("markdown", F.lit("")))
    raw = reading_order.render_markdown(ordered).withColumnRenamed("markdown", "__all")

    for s in [*signals, hidden, raw]:
        docs = docs.join(s, "doc_id", "left")
    docs = docs.withColumn("hidden_texts", F.coalesce("hidden_texts", F.expr("cast(array() AS array<string>)")))
    docs = docs.fillna(0, [c for c in docs.columns if c in schemas.SIGNALS])
    docs = docs.withColumn("redacted_text_items", F.size("hidden_texts")).withColumns({c: redaction.scrub(F.col(c), F.col("hidden_texts")) for c in ("markdown", "__all")})
    docs = citations.strip_parenthetical(lines.clean_markdown(docs, "markdown", "narration", table_mode, drop_patterns), "narration", "__all")
    docs = docs.withColumn("removed_parenthetical_citations", F.col("n_citations").cast("int")).drop("n_citations", "__all")
    return quality.assess(docs, "narration", "hidden_texts").drop("hidden_texts")


def speech_manifest(extracted: DataFrame, options: sinks.SpeechOptions) -> DataFrame:
    """Q15 and CH1: chunks of the documents that pass the gate."""
    return sinks.manifest(quality.passed(extracted).withColumn("name", F.concat(F.lit("doc"), F.col("doc_id").cast("string"))), options=options)
