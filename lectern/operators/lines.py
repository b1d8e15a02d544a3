"""Line stage of cleaning (FL7-FL12, WN2, WN5, SF3-SF8) on whole texts, with no shuffle.

A pass over lines is one regular expression in multi-line mode over the text, so that it stays a plain column expression;
only what compares lines with each other (repeats of the introduction) or reads table rows takes a text apart,
and only in texts that have such lines. `exploded` gives lines as rows for other uses.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import lexicons as L
from lectern.functions import text as X

# Lines that say nothing aloud, as whole lines without white space around them, in any case.
PAGE_NUMBER = r"(?:page\s+)?\d{1,3}$"
PAGE_FOOTER = r"(?:#{1,6}\s+)?page\s+\d+\s*\|\s*\S"
SOURCE_LINE = r"(?:[·•▪◦]\s*)?sources?\s*:\s*\S"
TABLE_DIVIDER = r"\|?(?:\s*:?-{3,}:?\s*\|)+$"
TABLE_ROW = r"\|[^\n]*\|$"
FENCE = "```"
INTRO_CHARS = 180
MODES = ("smart", "skip", "linearize")
#: Stands at the end of a line that must stay apart when lines are joined (SF8); no line has it after SF3.
HARD = "\u000b"


def exploded(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per line: doc_id, pos, line."""
    return docs.select("doc_id", F.posexplode(X.lines_of(F.coalesce(F.col(text), F.lit("")))).alias("pos", "line"))


def tidy_lines(text: Column) -> Column:
    """SF3: every line boundary is a newline, and lines have no white space around them."""
    one = X.guarded(text, lambda x: x.rlike(r"[\u000b\f\r\u001c-\u001e\u0085\u2028\u2029]"), lambda x: X.sub(x, r"\r\n|[\u000b\f\r\u001c-\u001e\u0085\u2028\u2029]", "\n"))
    return X.strip_ends(X.sub(one, r"(?U)[^\S\n]*\n[^\S\n]*", "\n"))


def spoken_urls(text: Column) -> Column:
    """SF4 on every line of a text that has a URL."""
    return X.guarded(text, lambda x: x.rlike(r"(?i)https?://|www\."), lambda x: F.array_join(F.transform(F.split(x, "\n", -1), lambda y: F.when(y.rlike(r"(?i)https?://|www\."), X.speak_urls(y)).otherwise(y)), "\n"))


def without_fences(text: Column) -> Column:
    """FL11, WN2: fences and what is between them go; an open one takes all that follows."""
    return X.guarded(text, lambda x: F.contains(x, F.lit(FENCE)), lambda x: X.sub(x, rf"(?ms)^{FENCE}(?:[^\n]*\n.*?^{FENCE}[^\n]*(?:\n|\z)|.*\z)", ""))


def drop_pattern(extra: tuple[str, ...] = ()) -> str:
    """FL7-FL10: one expression that takes whole lines with their newline. Extra patterns may match anywhere in a line."""
    for p in extra:
        re.compile(p)
    inside = [p.replace(r"\s", r"[^\S\n]") for p in (PAGE_NUMBER, PAGE_FOOTER, SOURCE_LINE, *L.DROP_LINES)]
    anywhere = [rf"(?=[^\n]*?(?:{p}))" for p in extra]
    return "(?im)^(?:" + "|".join(inside + anywhere) + r")[^\n]*(?:\n|\z)"


def without_dropped(text: Column, drop: str | None = None) -> Column:
    """FL7-FL10 on tidy lines."""
    return X.sub(text, drop or drop_pattern(), "")


def table_lines(text: Column, mode: str = "smart") -> Column:
    """FL12, SF7 on tidy lines: dividers go; rows go too, or are read as clauses and stay apart."""
    divider, row = TABLE_DIVIDER.replace(r"\s", r"[^\S\n]"), TABLE_ROW

    def body(x):
        if mode != "linearize":
            return X.sub(x, rf"(?m)^(?:{divider}|{row})(?:\n|\z)", "")
        read = F.transform(F.split(X.sub(x, rf"(?m)^{divider}(?:\n|\z)", ""), "\n", -1), lambda y: F.when(y.rlike("^" + row), F.concat(X.table_row(y), F.lit(HARD))).otherwise(y))
        return F.array_join(read, "\n")

    return X.guarded(text, lambda x: x.rlike(r"(?m)^\||\|$"), body)


def without_marks(text: Column) -> Column:
    """SF5, SF6 on tidy lines: headings, bullets, list markers, emphasis."""
    return X.strip_emphasis(X.chain(text, *[("(?m)" + p.replace(r"\s", r"[^\S\n]"), "") for p in X.MARKERS]))


def intro_once(text: Column) -> Column:
    """WN5: a line that repeats one of the introduction goes.

    The introduction ends with the first line of more than INTRO_CHARS characters; without one it is the
    whole document. Lines are compared with white space and case folded; blank lines stay.
    """

    def key(line):
        return F.lower(X.fold_space(line))

    def body(lines):
        def filtered(keys):
            # 1 behind the introduction's last line, or behind all.
            end = F.array_position(F.transform(lines, lambda x: F.length(x) > INTRO_CHARS), True)
            end = F.when(end > 0, end).otherwise(F.size(lines)).cast("int")

            def kept(intro):
                at = F.transform(keys, lambda k: F.array_position(intro, k))
                return F.filter(lines, lambda x, i: (F.get(keys, i) == "") | (F.get(at, i) == 0) | (F.get(at, i) == i + 1))

            return F.element_at(F.transform(F.array(F.slice(keys, 1, end)), kept), 1)

        keys = F.filter(F.transform(lines, key), lambda k: k != "")
        again = F.size(F.array_distinct(keys)) < F.size(keys)
        return F.when(again, F.element_at(F.transform(F.array(F.transform(lines, key)), filtered), 1)).otherwise(lines)

    split = F.split(text, "\n", -1)
    return F.array_join(F.element_at(F.transform(F.array(split), body), 1), "\n")


def clean_markdown(docs: DataFrame, text: str = "text", out: str = "narration", table_mode: str = "smart", drop_patterns: tuple[str, ...] = ()) -> DataFrame:
    """CP1: docs with a cleaned narration. Null stays null.

    table_mode: ``smart`` and ``skip`` leave table rows out, ``linearize`` reads them. Other columns, whatever their names, are carried.
    """
    if table_mode not in MODES:
        raise ValueError(f"table_mode is one of {', '.join(MODES)}")
    drop = drop_pattern(drop_patterns)
    steps = (
        X.newlines, X.decode_entities, X.strip_markup, X.strip_notices, tidy_lines, spoken_urls, without_fences, lambda c: without_dropped(c, drop), lambda c: table_lines(c, table_mode),
        without_marks, intro_once, X.join_lines, lambda c: X.guarded(c, lambda x: F.contains(x, F.lit(HARD)), lambda x: X.sub(x, rf" ?{HARD}\s*", "\n")),
        X.repair_words, X.repair_hyphens, X.repair_spacing, X.repair_amounts, X.clean_bylines, X.strip_contacts, X.join_sections, X.end_with_newline,
    )
    value = F.col(text)
    for step in steps:
        value = step(value)
    return docs.withColumn(out, value)
