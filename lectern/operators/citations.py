"""Citations: classifiers, bibliography evidence, parenthetical citations and scoped folds (FL16, FL17, JN4, AG9, SF34, SF35, WN3, WN4, WN11, WN12, ST5, CP2)."""

from __future__ import annotations

import html
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schemas
from lectern.functions import lexicons as L
from lectern.operators.folds import by_document

YEAR = r"(?:18|19|20)\d\d[a-z]?"
_HEADING = re.compile(rf"(?:(?:{'|'.join(L.REFERENCE_ADJECTIVES)})\s+)?(?:{'|'.join(L.REFERENCE_HEADINGS)})(?:\s*\(continued\))?\s*[:.]?", re.I)
_CLAUSE = re.compile(rf"(?P<names>.+?),\s*(?P<year>{YEAR})(?:\s*[,/&–-]\s*(?:{YEAR}|[a-z]))*(?:\s*[,;:]\s*(?:pp?\.\s*)?\d+(?:\s*[-–]\s*\d+)?)?\.?")
_DATE = re.compile(rf"(?:{'|'.join(L.DATES_AND_UNITS)})\.?", re.I)
_NAME = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
_PARENTHESES = re.compile(rf"\([^()]*{YEAR}[^()]*\)")
_SEVERAL = re.compile(r",|&|\band\b|\bet\s+al\b")
_MARK = re.compile(r"^\s*(?:\d{1,3}|[ivxIVX]{1,5})[.)]?\s+(?=\S)")
_NOTE = re.compile(r"\bNotes?:\s*(.+)$", re.S)
_SOURCE = re.compile(r"^\s*[·•*-]?\s*Sources?\s*(?::|$)", re.I)
_URL_ONLY = re.compile(r"^\s*(?:https?://|www\.)\S+\s*$")
_VERB = re.compile(r"\b(?:is|are|was|were|be|been|has|have|had|can|could|may|might|will|would|should|does|do|did|grew|rose|fell|includes?|included|excludes?|excluded|assumes?|differs?|varies|vary|means?|equals?|reported|stood|controlled|applies|apply)\b")
_PROVENANCE = re.compile(r"\b(?:used with attribution|confirm permission|required by a licen[sc]e|interview(?:ed)? with|case writers?|could not be verified|unless otherwise noted|for a popular book|accessed|retrieved from)\b", re.I)
_CITED = re.compile(rf"(?:[“\"‘'][^”\"]{{3,}}[,.]?[”\"’'],?\s.*{YEAR}|\([^()]*{YEAR}\)|{YEAR}\)?\s*(?::\s*[\d–-]+)?\.?$)", re.S)
#: Stops after these are no ends of sentences.
_ABBREVIATED = re.compile(r"(?:\b(?:[A-Z]|Inc|Corp|Co|Ltd|Mr|Ms|Dr|St|No|vol|pp?|e\.g|i\.e|al|U\.S|et al))\.$")


def author_key(name: str) -> str:
    """SF33."""
    return re.sub(r"\W", "", name).casefold()


def reference_heading(text: str) -> bool:
    return bool(_HEADING.fullmatch(text.strip()))


def bibliography(text: str) -> set[tuple[str, str]]:
    """AG9: (author key, year) of the entries under reference headings only: what stands before the first comma, and the first year."""
    found: set[tuple[str, str]] = set()
    inside = False
    for line in html.unescape(text).splitlines():
        if head := re.match(r"\s*#{1,6}\s+(.+)", line):
            inside = reference_heading(head[1])
        elif inside and (year := re.search(rf"\b{YEAR}\b", entry := re.sub(r"^\s*(?:[-*+]\s+|\d+[.)]\s+)", "", line).lstrip("["))):
            found.add((author_key(entry[: year.start()].partition(",")[0].rstrip(" .(")), year[0]))
    return found


def author_year(clause: str, sources: set[tuple[str, str]]) -> bool:
    """FL17: whether a clause is nothing but authors and years. One name alone needs an entry of the bibliography."""
    m = _CLAUSE.fullmatch(" ".join(clause.split()))
    if not m:
        return False
    names = re.sub(r"^(?:see(?: also)?|cf\.|e\.g\.,)\s+", "", m["names"], flags=re.I)
    words = _NAME.findall(names)
    if _DATE.fullmatch(names) or not words or _NAME.sub("", names).strip(" .,\t&"):
        return False
    if not all(w[0].isupper() or w in L.CONNECTORS for w in words) or not any(w[0].isupper() for w in words):
        return False
    return bool(_SEVERAL.search(names)) or (author_key(_SEVERAL.split(names, maxsplit=1)[0]), m["year"]) in sources


def strip_citations(text: str | None, sources: set[tuple[str, str]] = frozenset()) -> tuple[str | None, int]:
    """SF34: (text without parenthetical author-year citations, how many clauses went). Spaces are settled only where some went."""
    if not text or "(" not in text:
        return text, 0
    out: list[str] = []
    removed = at = 0
    for m in re.finditer(r"\(([^()]*)\)([ \t]*[-–—])?", text):
        clauses = m[1].split(";")
        kept = [c.strip() for c in clauses if not author_year(c, sources)]
        if len(kept) == len(clauses):
            continue
        removed += len(clauses) - len(kept)
        touching = text[max(0, m.start() - 1) : m.start()].isalnum() and text[m.end() : m.end() + 1].isalnum()
        left = f"({'; '.join(kept)}){m[2] or ''}" if kept else " - " if m[2] else " " if touching else ""
        out += [text[at : m.start()], left]
        at = m.end()
    if not removed:
        return text, 0
    joined = "".join([*out, text[at:]])
    for pattern, to in ((r"[ \t]+", " "), (r" +([,.;:!?)])", r"\1"), (r" *\n *", "\n")):
        joined = re.sub(pattern, to, joined)
    return joined.lstrip(" \t"), removed


def strip_parenthetical(docs: DataFrame, text: str = "text", reference: str | None = None) -> DataFrame:
    """docs with `text` stripped and n_citations. reference: the column with the bibliography (default: the text itself)."""

    fields = [f for f in docs.schema.fields if f.name != "n_citations"]
    names, schema = [f.name for f in fields], T.StructType([*fields, T.StructField("n_citations", T.LongType())])

    def run(batches):
        for batch in batches:
            texts, refs = batch.column(text).to_pylist(), batch.column(reference or text).to_pylist()
            # Only a text with a year in parentheses needs its bibliography.
            got = [strip_citations(t, bibliography(r) if r and "#" in r else set()) if t and _PARENTHESES.search(t) else (t, 0) for t, r in zip(texts, refs, strict=True)]
            columns = [pa.array([t for t, _ in got], pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in got], pa.int64())], [*names, "n_citations"])

    return docs.select(*names).mapInArrow(run, schema)


def evidence(docs: DataFrame, text: str = "text") -> DataFrame:
    """AG9 as rows: doc_id, author, year of the bibliography of each text."""

    @F.pandas_udf("array<struct<author:string, year:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"author": a, "year": y} for a, y in sorted(bibliography(t or ""))])

    headed = docs.where(F.col(text).rlike(r"(?m)^\s*#"))  # without a heading there is no bibliography
    return headed.select("doc_id", F.explode(run(F.col(text))).alias("e")).select("doc_id", "e.*")


def sentences(text: str) -> list[str]:
    out: list[str] = []
    for part in re.split(r"(?<=[.!?])\s+(?=[\"“'‘(]?[A-Z])", text.strip()):
        if out and _ABBREVIATED.search(out[-1]):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def _is_cited(s: str) -> bool:
    """A sentence that is a source: it has no verb of its own outside quotes, or it is about provenance."""
    if _PROVENANCE.search(s):
        return True
    bare = re.sub(r"[“\"‘][^”\"’]*[”\"’]|'[^']{8,}'", "", s)
    return bool(_CITED.search(s)) and not _VERB.search(bare)


def without_marker(text: str) -> str:
    """SF35."""
    return _MARK.sub("", text, count=1).strip()


def explanation(text: str) -> str:
    """SF35: what a note says apart from its sources."""
    body = without_marker(text)
    if m := _NOTE.search(body):
        return m[1].strip()
    return " ".join(s for s in sentences(body) if not _is_cited(s) and _VERB.search(s)).strip()


def source_explanation(text: str) -> str:
    """SF35: what follows the source in a source line."""
    if m := _NOTE.search(text):
        return m[1].strip()
    return " ".join(s for s in sentences(_SOURCE.sub("", text))[1:] if _VERB.search(s) and not _is_cited(s)).strip()


def citation_only(text: str) -> bool:
    """FL16."""
    body = without_marker(text)
    if _NOTE.search(body):
        return False
    parts = sentences(body)
    return bool(parts) and all(_is_cited(s) or _URL_ONLY.match(s) for s in parts)


def _join_source_labels(rows: list[dict]) -> list[dict]:
    """WN11: a bare label takes the cited or colon text behind it; then fragments beside it."""
    out: list[dict] = []
    for b in rows:
        a = out[-1] if out else None
        if a is not None and b["label"] not in ("section_header", "footnote") and a["page"] == b["page"]:
            bare = re.match(r"^\s*Sources?\s*:?\s*$", a["text"], re.I)
            colon = b["text"].lstrip().startswith(":")
            if bare and (colon or _is_cited(b["text"])):
                out[-1] = a | {"text": a["text"].rstrip() + ("" if colon else " ") + b["text"].lstrip(), "right": b["right"]}
                continue
            beside = abs(a["top"] - b["top"]) <= 3 and -2 <= b["left"] - a["right"] <= 24
            if _SOURCE.match(a["text"]) and beside:
                out[-1] = a | {"text": a["text"].rstrip() + " " + b["text"].lstrip(), "right": b["right"]}
                continue
        out.append(b)
    return out


def filter_document(rows: list[dict]) -> tuple[list[dict], int, int]:
    """CP2 for one stream of a document: (blocks, omitted, explanations)."""
    rows = _join_source_labels(rows)
    out: list[dict] = []
    omitted = kept = 0
    scope = headed = after_source = False
    for i, b in enumerate(rows):
        text = b["text"] or ""
        if b["label"] == "section_header":
            after_source = False
            starts = reference_heading(text)
            if text.strip().rstrip(":.").lower() == "notes":
                ahead = [x for x in rows[i + 1 : i + 4] if x["label"] != "section_header"]
                starts = sum(citation_only(x["text"] or "") for x in ahead) >= 2
            scope = starts
            if starts:
                omitted += 1
                headed = False
            else:
                out.append(b)
        elif scope:
            omitted += 1
            if said := explanation(text) if not citation_only(text) else "":
                if not headed:
                    out.append(b | {"text": "Explanatory notes", "label": "section_header"})
                    headed = True
                if out[-1]["text"] != said:
                    out.append(b | {"text": said, "label": "text"})
                    kept += 1
        elif _SOURCE.match(text):
            omitted += 1
            after_source = True
            if said := source_explanation(text):
                out.append(b | {"text": said})
                kept += 1
        elif after_source and (_URL_ONLY.match(text) or re.match(r"^\s*Sources?:?\s*$", rows[i - 1]["text"] or "", re.I) and _is_cited(text)):
            omitted += 1
        elif b["label"] == "footnote":
            after_source = False
            said = "" if citation_only(text) else explanation(text) or without_marker(text)
            if said:
                out.append(b | {"text": f"Explanatory note: {said}"})
                kept += 1
            else:
                omitted += 1
        else:
            after_source = False
            out.append(b)
    return out, omitted, kept


def filter_citation_blocks(ordered: DataFrame) -> DataFrame:
    """CP2 over ordered blocks (with `stream`): the blocks that stay, with the document's omitted and explanations (AG11)."""
    names = [*schemas.BLOCKS.fieldNames(), "stream"]

    def fold(rows: list[dict]) -> list[dict]:
        made, omitted, kept = [], 0, 0
        for stream in sorted({r["stream"] for r in rows}):
            got, o, k = filter_document([r for r in rows if r["stream"] == stream])
            made += got
            omitted, kept = omitted + o, kept + k
        # A document that loses every block still reports what was omitted, in one empty block.
        made = made or [rows[0] | {"text": ""}]
        return [r | {"seq": i, "omitted": omitted, "explanations": kept} for i, r in enumerate(made)]

    return by_document(ordered.select(*names), fold, ordered.select(*names, F.lit(0).alias("omitted"), F.lit(0).alias("explanations")))
