"""Repairs that the page itself proves (FL21, FL22, JN2, JN3, JN11, JN12, WN1, AG10, SF31, SF38-SF42, TK4, ST4).

Edits accumulate: each sees what the one before did. So evidence is gathered per block by joins on
document and page, and a vectorised fold makes the edits of one block.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import text as X
from lectern.operators import layout
from lectern.operators.folds import by_document

QUOTES = str.maketrans("‘’‚‛“”„‟", "''''\"\"\"\"")


# FL21, FL22, WN1: from native text objects


def neighbours(objects: DataFrame) -> DataFrame:
    """WN1: each object with the one before it on its page; white space objects part their neighbours."""
    order = Window.partitionBy("doc_id", "page").orderBy("obj_seq")
    names = ("text", "left", "bottom", "right", "top")
    return objects.withColumns({f"p_{c}": F.lag(c).over(order) for c in names}).where(F.col("p_text").isNotNull())


def _height(p: str = "") -> Column:
    return F.col(f"{p}top") - F.col(f"{p}bottom")


def raised_references(objects: DataFrame) -> DataFrame:
    """FL21: small raised markers right behind punctuation, a percent sign or a year. With clusters (``1``, ``,``, ``2``), whose anchor is their first's."""
    order = Window.partitionBy("doc_id", "page").orderBy("obj_seq")
    # An object that only has a comma, or a marker, inside a cluster leans on the last other object.
    thin = F.trim("text").rlike(r"^(?:,|\d{1,3}|[ivx]{1,5})$")
    o = objects.withColumn("__base", F.when(~thin, F.struct("text", "left", "bottom", "right", "top", "obj_seq")))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    o = o.withColumn("b", F.last("__base", ignorenulls=True).over(upto)).withColumn("p_right", F.lag("right").over(order)).withColumn("p_text", F.lag("text").over(order))
    # A lone stop or quote belongs to the words before it.
    o = o.withColumn("w", F.last(F.when(~thin & F.col("text").rlike(r"\w"), F.struct("text", "bottom", "top")), ignorenulls=True).over(upto))
    joined = F.when(F.col("b.text").rlike(r"\w"), F.col("b.text")).otherwise(F.concat(F.coalesce(F.col("w.text"), F.lit("")), F.regexp_replace("b.text", r"(?U)^\s+", "")))
    anchor = X.strip(joined)
    base_h = F.when(F.col("b.text").rlike(r"\w"), F.col("b.top") - F.col("b.bottom")).otherwise(F.coalesce(F.col("w.top") - F.col("w.bottom"), F.col("b.top") - F.col("b.bottom")))
    base_low = F.when(F.col("b.text").rlike(r"\w"), F.col("b.bottom")).otherwise(F.coalesce(F.col("w.bottom"), F.col("b.bottom")))
    marker = X.strip(F.col("text"))
    good = (
        marker.rlike(r"^(?:\d{1,3}|[ivx]{1,5})$")
        & anchor.rlike(r"(?:[.,;:!?)%'\"’”]|\b(?:19|20)\d\d)$")
        & (_height() < base_h * 0.8)
        & (F.col("bottom") - base_low > base_h * 0.15)
        & (F.col("left") - F.col("p_right")).between(-1.0, 8.0)
    )
    return o.where(F.col("b").isNotNull() & good).select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "obj_seq")) - 1).cast("int").alias("ref_seq"), "page", marker.alias("marker"), anchor.alias("anchor"), "left", "bottom")


def word_joins(objects: DataFrame) -> DataFrame:
    """FL22: word fragments that touch on one line, with no space between them."""
    o = neighbours(objects)
    gap = F.col("left") - F.col("p_right")
    overlap = F.least("top", "p_top") - F.greatest("bottom", "p_bottom")
    h = F.least(_height(), _height("p_"))
    touch = F.col("p_text").rlike(r"\p{L}$") & F.col("text").rlike(r"^\p{L}") & gap.between(F.lit(-0.5), h * 0.16) & (overlap > h * 0.5)
    return o.where(touch).select(
        "doc_id", "page", F.regexp_extract("p_text", r"(\p{L}+)$", 1).alias("left_word"), F.regexp_extract("text", r"^(\p{L}+)", 1).alias("right_word"), "left", "bottom"
    )


# SF38, SF39: raised markers


def anchor_pattern(anchor: str) -> str:
    """SF39: an anchor with white space flexible and quotes of any form; a blank may stand before a stop."""
    out = []
    for ch in anchor.translate(QUOTES):
        if ch.isspace():
            if out[-1:] != [r"\s+"]:
                out.append(r"\s+")
        elif ch in "'\"":
            out.append(r"\s?[\"'‘’“”]")
        elif ch == ".":
            out.append(r"\s?\.")
        else:
            out.append(re.escape(ch))
    return "".join(out)


def strip_markers(text: str, refs: list[tuple[str, str]]) -> tuple[str, int]:
    """SF38: (text without the markers behind their anchors, how many). refs: (anchor, marker), in order."""
    removed = 0
    by_anchor: dict[str, list[str]] = {}
    for anchor, marker in refs:
        by_anchor.setdefault(anchor, []).append(marker)
    for anchor, markers in by_anchor.items():
        one = "|".join(map(re.escape, sorted(set(markers), key=lambda m: (-len(m), m))))
        found = re.search(rf"({anchor_pattern(anchor)})(\s*(?:{one})(?:\s*,\s*(?:{one}))*)(?![\w]|[.,]\d)", text, re.I)
        if not found:
            continue
        removed += len(re.findall(rf"(?:{one})", found[2], re.I))
        rest = text[found.end() :]
        gap = " " if rest[:1] and (rest[0].isalnum() or rest[0] in "'\"“‘") else ""
        text = text[: found.end(1)] + gap + rest
    return text, removed


# JN2: joins of touching fragments


def apply_word_joins(text: str, joins: list[tuple[str, str]]) -> tuple[str, int]:
    n = 0
    for left, right in joins:
        found = list(re.finditer(rf"\b{re.escape(left)}\s+{re.escape(right)}\b", text))
        if len(found) == 1:
            text = text[: found[0].start()] + left + right + text[found[0].end() :]
            n += 1
    return text, n


# SF40, SF41, JN12, AG10: tokens of the page


AMOUNT = re.compile(r"([$€£¥])(\d[\d,]*\.\d+)\s+(thousand|million|billion|trillion)")


def amounts(page: str) -> dict[tuple[str, str, str], set[str]]:
    """AG10: values by (currency, scale, whole part)."""
    out: dict[tuple[str, str, str], set[str]] = {}
    for sign, value, scale in AMOUNT.findall(page):
        out.setdefault((sign, scale, value.split(".")[0]), set()).add(value)
    return out


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def _stands(flat: str, part: str, inside: Callable[[str], bool]) -> bool:
    """Whether part is in flat with no character beside it that is `inside` a word."""
    at = flat.find(part)
    while at >= 0:
        end = at + len(part)
        if not (at and inside(flat[at - 1])) and not inside(flat[end : end + 1]):
            return True
        at = flat.find(part, at + 1)
    return False


class Page:
    """What repairs look up in a page's text, read out of it once for all blocks, and only if one asks."""

    #: So many words are looked for in the text before it is taken apart.
    FEW = 64

    def __init__(self, text: str):
        self.flat = " ".join(text.split())
        self.lines = set(text.split("\n"))
        self.forms = punctuation_forms(text)
        self.asked = 0

    @functools.cached_property
    def known(self) -> set[str]:
        return set(re.findall(r"[^\W\d_]+", self.flat))

    @functools.cached_property
    def beside(self) -> set[tuple[str, str]]:
        return set(re.findall(r"\b([^\W\d_]+) (?=([^\W\d_]+)\b)", self.flat))

    @functools.cached_property
    def amounts(self) -> dict[tuple[str, str, str], set[str]]:
        return amounts(self.flat)

    def torn(self, a: str, b: str) -> bool:
        """Whether a and b are one word here, and never two."""
        self.asked += 1
        if self.asked > self.FEW:
            return a + b in self.known and (a, b) not in self.beside
        return _stands(self.flat, a + b, _letter) and not _stands(self.flat, f"{a} {b}", _word)


def repair_tokens(text: str, page: str | Page | None) -> tuple[str, int, int]:
    """SF40, SF41, JN12: (text, words joined, numbers restored), only where the page has one reading."""
    if not page:
        return text, 0, 0
    page = page if isinstance(page, Page) else Page(page)
    flat = page.flat
    words = numbers = 0
    # A line that the page has as it is has no torn word or share.
    changed = own = text not in page.lines
    while changed:
        changed = False
        for m in re.finditer(r"\b([^\W\d_]+) (?=([^\W\d_]+)\b)", text):
            a, b = m[1], m[2]
            if page.torn(a, b):
                text = text[: m.start()] + a + text[m.end() :]
                words += 1
                changed = True
                break
    for m in reversed(list(re.finditer(r"(?<![\d.])(\d) (\d+) ?%", text)) if own else []):
        whole = f"{m[1]}{m[2]}%"
        if re.search(rf"(?<![\d.]){re.escape(whole)}", flat) and m[0] not in flat:
            text = text[: m.start()] + whole + text[m.end() :]
            numbers += 1
    for m in reversed(list(re.finditer(r"([$€£¥])(\d[\d,]*)\.\s+(thousand|million|billion|trillion)", text))):
        values = page.amounts.get((m[1], m[3], m[2]), set())
        if len(values) == 1:
            text = text[: m.start()] + f"{m[1]}{next(iter(values))} {m[3]}" + text[m.end() :]
            numbers += 1
    return text, words, numbers


# SF42, JN11, ST4: compounds and dashes of the page


def punctuation_forms(page: str) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """SF42, ST4: (parts, separators) of hyphened and dashed words, in order, each once. Suspended compounds are no forms."""
    flat = " ".join(w for w in re.sub("￾\\s*", "-", page).split() if "-" in w or "—" in w)
    out: dict[tuple[tuple[str, ...], tuple[str, ...]], None] = {}
    for m in re.finditer(r"(?<![\w-])\w+(?:[-—]\w+)+(?![-—]?\w)(?!-)", flat):
        pieces = re.split(r"([-—])", m[0])
        out[(tuple(pieces[::2]), tuple(" - " if s == "—" else "-" for s in pieces[1::2]))] = None
    return list(out)


def repair_forms(text: str, forms: list[tuple[tuple[str, ...], tuple[str, ...]]]) -> tuple[str, int]:
    """JN11: a form whose separators were lost or misplaced is restored, if it occurs exactly once."""
    n = 0
    for parts, separators in forms:
        whole = parts[0] + "".join(s + p for s, p in zip(separators, parts[1:], strict=True))
        if whole in text or not all(p in text for p in parts):
            continue
        loose = r"\b" + r"(?: ?[-–—] ?)?".join(map(re.escape, parts)) + r"\b"
        found = [m for m in re.finditer(loose, text)]
        if len(found) == 1 and found[0][0] != whole:
            text = text[: found[0].start()] + whole + text[found[0].end() :]
            n += 1
    return text, n


# The fold over blocks


def repair_blocks(blocks: DataFrame, refs: DataFrame, markers: DataFrame, joins: DataFrame, page_texts: DataFrame) -> DataFrame:
    """Blocks with repaired text and counts removed_markers, joined_words, restored_numbers, restored_forms.

    JN1, JN2 and JN3 gather the evidence of each block by document and page. page_texts without a page has one text that proves all
    pages of a document. Texts of pages come as rows of their own to the fold, so that none is repeated for each block.
    """
    at = layout.block_refs(blocks, refs, markers).groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(F.struct("ref_seq", "anchor", "marker"))).alias("__refs"))
    j = joins.select("doc_id", "page", "left_word", "right_word", F.col("left").alias("j_left"), F.col("bottom").alias("j_bottom"))
    s = layout.SLACK
    near = F.col("j_left").between(F.col("left") - s, F.col("right") + s) & F.col("j_bottom").between(F.col("bottom") - s, F.col("top") + s)
    boxes = blocks.select("doc_id", "page", "seq", "left", "top", "right", "bottom")
    held = boxes.join(j, ["doc_id", "page"]).where(near).groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(F.struct((-F.col("j_bottom")).alias("y"), "j_left", "left_word", "right_word"))).alias("__joins"))
    names = schemas.BLOCKS.fieldNames()
    by_page = "page" in page_texts.columns
    pages = page_texts.select("doc_id", *(["page"] if by_page else []), F.col("page_text").alias("text"))
    rows = blocks.select(*names).withColumn("__kind", F.lit("block"))
    for more, kind in ((at, "refs"), (held, "joins"), (pages, "page")):
        rows = rows.unionByName(more.withColumn("__kind", F.lit(kind)), allowMissingColumns=True)

    def fold(rows: list[dict]) -> list[dict]:
        had = {kind: {r["seq"]: r[f"__{kind}"] for r in rows if r["__kind"] == kind} for kind in ("refs", "joins")}
        pages = {r["page"]: Page(r["text"]) for r in rows if r["__kind"] == "page" and r["text"]}
        out = []
        for r in rows:
            if r["__kind"] != "block":
                continue
            page = pages.get(r["page"] if by_page else None)
            t, m = strip_markers(r["text"] or "", [(x["anchor"], x["marker"]) for x in had["refs"].get(r["seq"], [])])
            t, a = apply_word_joins(t, [(x["left_word"], x["right_word"]) for x in had["joins"].get(r["seq"], [])])
            t, b, n = repair_tokens(t, page)
            t, f = repair_forms(t, page.forms if page else [])
            out.append({c: r[c] for c in names} | {"text": t, "removed_markers": m, "joined_words": a + b, "restored_numbers": n, "restored_forms": f})
        return out

    zero = [F.lit(0).alias(c) for c in ("removed_markers", "joined_words", "restored_numbers", "restored_forms")]
    return by_document(rows, fold, blocks.select(*names, *zero))
