"""Layout-aware filters and spatial joins over blocks (FL1-FL6, FL18-FL20, JN1, JN6-JN10, WN3, WN7, WN15, AG2, AG5, SC8, SC9).

Spatial joins always carry (doc_id, page) as equi keys, so they are hash or sort-merge joins with a
residual predicate, never products. What is tested against every key of a document (JN7) is an array
of that document and a higher-order function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import lexicons as L
from lectern.functions import text as X

#: A reference may lie this far outside a block's box.
SLACK = 3.0
LOW, HIGH, RIGHT, LEFT = 0.11, 0.94, 0.87, 0.11
REPEATS, KEY_CHARS, FRAGMENT_CHARS = 2, 4, 12
PAGE_LABEL = r"(?i)\bpage\s+\d+\s*\||\|\s*page\s+\d+\b"
BYLINE = r"^\s*BY\s+\p{Lu}"
LOGO = r"^\s*[•·]\s*\S"


def blocks_from_items(items: DataFrame, page_dims: DataFrame, layer: str = "body") -> DataFrame:
    """FL1, SC8, SC9: body items with provenance as blocks with page sizes.

    An item over several pages is split by its character spans, if they are in order, do not overlap
    and leave out only white space; else it stays whole on its first page. A page's part may be blank.
    """
    body = items.where((F.col("layer") == layer) & (F.size("prov") > 0))
    gaps = F.expr(
        "transform(sequence(0, size(prov)), i -> substring(text, coalesce(get(prov, i - 1).stop, 0) + 1, coalesce(get(prov, i).start, length(text)) - coalesce(get(prov, i - 1).stop, 0)))"
    )
    ordered = F.expr("forall(sequence(0, size(prov) - 1), i -> prov[i].start >= coalesce(get(prov, i - 1).stop, 0) AND prov[i].stop >= prov[i].start AND prov[i].stop <= length(text))")
    whole = ~(ordered & F.forall(gaps, lambda g: X.strip(g) == ""))
    one = F.transform(F.slice("prov", 1, 1), lambda p: F.struct(F.col("text").alias("text"), *[p[c].alias(c) for c in ("page", "left", "top", "right", "bottom")]))
    each = F.transform("prov", lambda p: F.struct(F.substring(F.col("text"), p["start"] + 1, p["stop"] - p["start"]).alias("text"), *[p[c].alias(c) for c in ("page", "left", "top", "right", "bottom")]))
    parts = F.when((F.size("prov") == 1) | whole, one).otherwise(each)
    rows = body.select("doc_id", F.col("seq").alias("__item"), "label", F.posexplode(parts).alias("__k", "b")).select("doc_id", "__item", "__k", "label", "b.*")
    rows = rows.withColumn("text", X.strip(F.col("text")))
    order = Window.partitionBy("doc_id").orderBy("__item", "__k")
    rows = rows.withColumn("seq", (F.row_number().over(order) - 1).cast("int"))
    return rows.join(page_dims, ["doc_id", "page"]).select(*schemas.BLOCKS.fieldNames())


def in_margin() -> Column:
    """FL2: the whole block lies in a margin of its page."""
    w, h = F.col("page_width"), F.col("page_height")
    return (F.col("top") <= h * LOW) | (F.col("bottom") >= h * HIGH) | (F.col("left") >= w * RIGHT) | (F.col("right") <= w * LEFT)


def margin_furniture(blocks: DataFrame) -> DataFrame:
    """FL3, AG2, JN7: blocks with `furniture`, true for running headers, footers and their fragments."""
    df = blocks.withColumn("__key", X.margin_key(F.col("text"))).withColumn("__m", in_margin() & ~F.col("label").isin("footnote", "note"))
    same = Window.partitionBy("doc_id", "__key")
    df = df.withColumn("__pages", F.size(F.collect_set(F.when(F.col("__m"), F.col("page"))).over(same)))
    repeated = (F.col("__pages") >= REPEATS) & (F.length("__key") >= KEY_CHARS)
    named = F.col("text").rlike(PAGE_LABEL) | F.col("text").rlike(BYLINE)
    df = df.withColumn("__known", F.col("__m") & (named | repeated))
    doc = Window.partitionBy("doc_id")
    df = df.withColumn("__keys", F.collect_set(F.when(F.col("__known"), F.col("__key"))).over(doc))
    long_enough = (F.length("__key") >= FRAGMENT_CHARS) | F.col("text").rlike("[†‡]\\s*$") | F.col("text").rlike(BYLINE)
    fragment = long_enough & F.exists("__keys", lambda k: F.contains(k, F.col("__key")) & (k != F.col("__key")))
    logo = F.col("text").rlike(LOGO) & (F.col("bottom") >= F.col("page_height") * HIGH)
    header = F.col("label").isin("page_header", "page_footer")
    return df.withColumn("furniture", header | F.col("__known") | (F.col("__m") & (F.col("__key") != "") & (fragment | logo))).drop("__key", "__m", "__pages", "__known", "__keys")


def strip_margin_furniture(blocks: DataFrame) -> DataFrame:
    return margin_furniture(blocks).where(~F.col("furniture")).drop("furniture")


def front_matter(blocks: DataFrame) -> DataFrame:
    """FL4, WN3: blocks with `front`, true for a cover's production row, series badge and the author's particulars."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    heading = (F.col("label") == "section_header") & F.regexp_replace(F.lower(X.strip(F.col("text"))), ":$", "").isin(*L.FRONT_HEADINGS)
    # An island starts at each heading and at each page; a block belongs to its island's first row.
    starts = (F.col("label") == "section_header") | (F.col("page") != F.lag("page", 1, -1).over(order))
    df = blocks.withColumn("__head", heading).withColumn("__scope", F.last(F.when(starts, F.col("__head")), ignorenulls=True).over(upto))
    tiny = (F.col("page") == 1) & ((F.col("top") - F.col("bottom")) < 2) & (F.col("top") > F.col("page_height") * 0.9)
    doc = Window.partitionBy("doc_id")
    df = df.withColumn("__row", F.max(F.when(tiny, F.col("top"))).over(doc))
    beside = (F.col("page") == 1) & (F.col("label") != "section_header") & (F.abs(F.col("top") - F.col("__row")) <= 12)
    badge = (F.col("page") == 1) & F.col("text").rlike(r"^(?=.{4,60}$)[^\p{Ll}]*\bSERIES$")
    return df.withColumn("front", F.coalesce(F.col("__scope"), F.lit(False)) | F.coalesce(beside, F.lit(False)) | badge).drop("__head", "__scope", "__row")


def strip_front_matter(blocks: DataFrame) -> DataFrame:
    return front_matter(blocks).where(~F.col("front")).drop("front")


LOW_VALUE_NOTE = r"(?i)^\s*notes?\s*:\s*(?:\p{L}+ ){1,3}(?:is|are) [\p{L} ]+\. (?:\p{L}+ ){1,3}include"


def strip_table_notes(blocks: DataFrame) -> DataFrame:
    """FL5: notes that only list what a table's rows stand for."""
    return blocks.where(~F.col("text").rlike(LOW_VALUE_NOTE))


def content_pictures(pictures: DataFrame, page_dims: DataFrame) -> DataFrame:
    """FL6: pictures large enough, and far enough from the margins, to be content."""
    p = pictures.join(page_dims, ["doc_id", "page"])
    w, h = F.col("right") - F.col("left"), F.col("top") - F.col("bottom")
    pw, ph = F.col("page_width"), F.col("page_height")
    big = (w * h >= pw * ph * 0.02) & (w >= pw * 0.18) & (h >= ph * 0.06)
    return p.where(big & (F.col("top") >= ph * 0.10) & (F.col("bottom") <= ph * 0.94) & (F.col("bottom") >= ph * 0.05))


def _box(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select("doc_id", "page", *[F.col(c).alias(prefix + c) for c in ("left", "top", "right", "bottom", *more)])


def strip_visual_labels(blocks: DataFrame, pictures: DataFrame) -> DataFrame:
    """JN8: an anti join; loose labels whose centre lies in a picture of their page go."""
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = x.between(F.col("p_left"), F.col("p_right")) & y.between(F.col("p_bottom"), F.col("p_top"))
    loose = ~F.col("label").isin("caption", "section_header", "footnote")
    b, p = blocks.alias("b"), _box(pictures, "p_").alias("p")
    return b.join(p, (F.col("b.doc_id") == F.col("p.doc_id")) & (F.col("b.page") == F.col("p.page")) & inside & loose, "left_anti")


def visual_notes(pictures: DataFrame) -> DataFrame:
    """AG5, SF48: one note for each page with pictures, at the topmost one."""
    g = pictures.groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("n_pictures"), F.max_by(F.struct("left", "top", "right", "bottom", "page_width", "page_height"), F.struct("top", -F.col("left"))).alias("b")
    )
    word = F.when(F.col("n_pictures") == 1, F.lit("Figure")).otherwise(F.lit("Figures"))
    return g.select("doc_id", F.concat(word, F.lit(" omitted page "), F.col("page").cast("string"), F.lit(".")).alias("text"), F.lit("note").alias("label"), "page", "n_pictures", "b.*")


def insert_notes(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """ST1, WN7: notes go before the first block of their page with a smaller top, else after the page's last; seq is renewed."""
    n = notes.select("doc_id", "page", F.col("top").alias("n_top"), F.xxhash64("text", "top").alias("n_id")).distinct()
    at = blocks.select("doc_id", "page", "seq", "top").join(n, ["doc_id", "page"]).groupBy("doc_id", "page", "n_top", "n_id").agg(
        F.coalesce(F.min(F.when(F.col("top") < F.col("n_top"), F.col("seq"))) - 0.5, F.max("seq") + 0.5).alias("__at")
    )
    placed = notes.withColumn("n_id", F.xxhash64("text", "top")).join(at.drop("n_top"), ["doc_id", "page", "n_id"], "left")
    placed = placed.withColumn("__at", F.coalesce("__at", F.lit(1e9))).withColumn("seq", F.lit(0)).select(*schemas.BLOCKS.fieldNames(), "__at")
    both = blocks.withColumn("__at", F.col("seq").cast("double")).unionByName(placed)
    order = Window.partitionBy("doc_id").orderBy("__at", F.col("top").desc(), "text")
    return both.withColumn("seq", (F.row_number().over(order) - 1).cast("int")).drop("__at")


def redaction_boxes(paths: DataFrame, page_dims: DataFrame) -> DataFrame:
    """FL19, FL20: filled dark boxes that can hide text."""
    p = paths.join(page_dims, ["doc_id", "page"])
    w, h = F.col("right") - F.col("left"), F.col("top") - F.col("bottom")
    dark = F.col("filled") & (F.greatest("red", "green", "blue") <= 40) & (F.col("alpha") >= 200)
    return p.where(dark & (w >= 6) & (h >= 4) & (w * h >= 50) & (w * h <= F.col("page_width") * F.col("page_height") * 0.25))


def coverage(a: str, b: str) -> Column:
    """The share of box a that box b covers; a's area counts as 1 at least."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.least(c(a, "right"), c(b, "right")) - F.greatest(c(a, "left"), c(b, "left"))
    h = F.least(c(a, "top"), c(b, "top")) - F.greatest(c(a, "bottom"), c(b, "bottom"))
    area = F.greatest(F.lit(1.0), (c(a, "right") - c(a, "left")) * (c(a, "top") - c(a, "bottom")))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h) / area


def hidden_objects(objects: DataFrame, boxes: DataFrame, least: float = 0.6) -> DataFrame:
    """JN6: text objects that a redaction box covers by `least` or more (a semi join on document and page)."""
    o = objects.select("*", *[F.col(c).alias(f"o_{c}") for c in ("left", "top", "right", "bottom")]).alias("o")
    b = _box(boxes, "b_").alias("b")
    found = o.join(b, (F.col("o.doc_id") == F.col("b.doc_id")) & (F.col("o.page") == F.col("b.page")) & (coverage("o_", "b_") >= least), "left_semi")
    return found.select(*[f"o.{c}" for c in objects.columns])


def hidden_texts(hidden: DataFrame) -> DataFrame:
    """TK3: each document's distinct hidden texts, longest first."""
    texts = F.array_distinct(F.filter(F.collect_list(X.strip(F.col("text"))), lambda t: t != ""))
    longest = F.transform(F.array_sort(F.transform(texts, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
    return hidden.groupBy("doc_id").agg(longest.alias("hidden_texts"))


def sequence_markers(refs: DataFrame) -> DataFrame:
    """WN15: all numeric markers of documents with three in a row among them (doc_id, marker)."""
    nums = refs.where(F.col("marker").rlike("^[0-9]{1,3}$")).select("doc_id", F.col("marker").cast("int").alias("n")).distinct()
    order = Window.partitionBy("doc_id").orderBy("n")
    runs = nums.withColumn("__run", F.coalesce(F.lead("n", 2).over(order) == F.col("n") + 2, F.lit(False)))
    return runs.withColumn("__any", F.max("__run").over(Window.partitionBy("doc_id"))).where("__any").select("doc_id", F.col("n").cast("string").alias("marker"))


def known_markers(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """ST3, JN5: markers of footnotes, and those that a sequence proves (doc_id, marker)."""
    notes = blocks.where(F.col("label") == "footnote").select("doc_id", F.lower(F.regexp_extract("text", r"^\s*(\d{1,3}|[ivxIVX]{1,5})\b", 1)).alias("marker")).where("marker <> ''")
    return notes.unionByName(sequence_markers(refs)).distinct()


def block_refs(blocks: DataFrame, refs: DataFrame, markers: DataFrame) -> DataFrame:
    """JN1, JN5: raised references with the block that holds them: a range join inside document and page."""
    known = refs.withColumn("__m", F.lower("marker")).join(markers.withColumnRenamed("marker", "__m"), ["doc_id", "__m"], "left_semi").drop("__m")
    r = known.select("doc_id", "page", "ref_seq", "marker", "anchor", F.col("left").alias("r_left"), F.col("bottom").alias("r_bottom"))
    b = blocks.select("doc_id", "page", "seq", "left", "top", "right", "bottom")
    near = F.col("r_left").between(F.col("left") - SLACK, F.col("right") + SLACK) & F.col("r_bottom").between(F.col("bottom") - SLACK, F.col("top") + SLACK)
    return b.join(r, ["doc_id", "page"]).where(near).select("doc_id", "page", "seq", "ref_seq", "marker", "anchor")


def place_footnotes(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """JN9, JN10: a footnote moves behind the first paragraph of its page that has its reference's anchor; seq is renewed."""
    note = blocks.where(F.col("label") == "footnote").select("doc_id", "page", F.col("seq").alias("note_seq"), F.lower(F.regexp_extract("text", r"^\s*(\d{1,3}|[ivxIVX]{1,5})\b", 1)).alias("__m"))
    r = refs.select("doc_id", "page", "ref_seq", "anchor", F.lower("marker").alias("__m"))
    body = blocks.where(F.col("label").isin("text", "list_item")).select("doc_id", "page", F.col("seq").alias("to_seq"), X.straight_quotes(F.col("text")).alias("__t"))
    hits = note.join(r, ["doc_id", "page", "__m"]).join(body, ["doc_id", "page"]).where(F.contains(F.col("__t"), X.straight_quotes(F.col("anchor"))))
    first = Window.partitionBy("doc_id", "note_seq").orderBy("ref_seq", "to_seq")
    hits = hits.withColumn("__k", F.row_number().over(first)).where("__k = 1").select("doc_id", F.col("note_seq").alias("seq"), "to_seq")
    df = blocks.join(hits, ["doc_id", "seq"], "left")
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("to_seq", "seq"), F.col("to_seq").isNotNull(), "seq")
    return df.withColumn("__new", (F.row_number().over(order) - 1).cast("int")).drop("seq", "to_seq").withColumnRenamed("__new", "seq").select(*blocks.columns)
