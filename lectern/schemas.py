"""Explicit schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

import re


class Schema(str):
    """A schema as DDL, which Spark takes wherever it takes a StructType, and its column names."""

    def fieldNames(self) -> list[str]:  # noqa: N802 as StructType has it
        flat = self
        while "<" in flat:
            flat = re.sub(r"<[^<>]*>", "", flat)
        return [field.split()[0] for field in flat.split(",")]


#: A laid-out span of text. Coordinates are points from the bottom left, so top > bottom; seq is the order in the document.
BLOCKS_DDL = (
    "doc_id long, seq int, text string, label string, page int, left double, top double, right double, bottom double, page_width double, page_height double"
)
BLOCKS = Schema(BLOCKS_DDL)
LABELS = ("text", "list_item", "caption", "section_header", "footnote", "note", "page_header", "page_footer")

#: An item of a parsed document, before it is split by page.
ITEMS = Schema("doc_id long, seq int, text string, label string, layer string, prov array<struct<page:int, left:double, top:double, right:double, bottom:double, start:int, stop:int>>")
PAGE_DIMS = Schema("doc_id long, page int, page_width double, page_height double")
PICTURES = Schema("doc_id long, picture int, page int, left double, top double, right double, bottom double")
TABLES = Schema("doc_id long, table_no int, page int, left double, top double, right double, bottom double, grid array<array<string>>")
RAISED_REFS = Schema("doc_id long, ref_seq int, page int, marker string, anchor string, left double, bottom double")
WORD_JOINS = Schema("doc_id long, page int, left_word string, right_word string, left double, bottom double")
SOURCE_FORMS = Schema("doc_id long, page int, form_seq int, parts array<string>, separators array<string>")
PAGE_TEXTS = Schema("doc_id long, page int, page_text string")
TEXT_OBJECTS = Schema("doc_id long, page int, obj_seq int, text string, left double, bottom double, right double, top double")
PATHS = Schema("doc_id long, page int, left double, bottom double, right double, top double, filled boolean, red int, green int, blue int, alpha int")
HIDDEN_TEXTS = Schema("doc_id long, hidden_text string")

#: What a narration's text cannot tell: counts of the passes before it.
SIGNALS = (
    "redacted_text_items",
    "narrated_text_tables",
    "omitted_data_tables",
    "marked_visuals",
    "omitted_citation_blocks",
    "retained_explanatory_notes",
    "removed_margin_blocks",
    "removed_inline_markers",
    "removed_parenthetical_citations",
    "repaired_source_words",
    "repaired_source_numbers",
    "repaired_source_forms",
    "removed_front_matter_blocks",
    "omitted_table_notes",
    "removed_visual_labels",
)
SIGNALS_SCHEMA = Schema("doc_id long, " + ", ".join(f"{s} int" for s in SIGNALS) + ", full_page_ocr boolean")
FINDINGS = "array<struct<severity:string, code:string, message:string>>"
CASES = Schema("root string, name string, status string, completed_at double, files array<struct<path:string, size:long, mtime:double, is_link:boolean>>, narration string")
MANIFEST = Schema("doc_id long, part int, parts int, key string, file string, chars int, text string")
