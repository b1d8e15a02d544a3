"""Cleaning and the gate on small texts of our own."""

import pytest

from lectern.operators import lines, quality

LONG = "An opening paragraph that goes on for so many words that nobody could take it for a title or a byline any more, because it has far more than one hundred and eighty characters in its single line of prose."
CLEANED = [
    ("# Title\n\nThe nego-\n\n   tiator had **two** offers and [one link](https://e.org/x).\n\n3\n", "Title\n\nThe negotiator had two offers and one link.\n"),
    ("Before.\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nAfter.", "Before.\n\nAfter.\n"),
    ("Y ESTERDAY the plan began.\n\n# A MARKET OF ONE", "YESTERDAY the plan began.\n\nA MARKET OF ONE\n"),
    ("They teach. They can be reached at a.b@example.edu.\n\n# Next", "They teach.\n\nNext\n"),
    ("https://e.org/r.pdf (accessed May 1, 2010)\n\nIt is at https://e.org/r.pdf.", "It is at the linked source.\n"),
    ("Exhibit 2\n\n• Source: Filings, 2001.", "Exhibit 2\n"),
    ("-  Stock falls.\n\n Speed rises.", "Stock falls.\n\nSpeed rises.\n"),
    ("BY A PERSON * AND B PERSON †", "BY A PERSON AND B PERSON\n"),
    ("Costs of c. €3 fell, 1999 - 2003.", "Costs of approximately €3 fell, 1999 to 2003.\n"),
    ("© 2011 Example House. All rights reserved. Prose goes on.", "Prose goes on.\n"),
    ("Copyright law matters to the firm.", "Copyright law matters to the firm.\n"),
    (f"BY ONE\n\n{LONG}\n\nBY ONE\n\nTail.\n\nTail.", f"BY ONE\n\n{LONG}\n\nTail.\n\nTail.\n"),
    ("```\ncode\n```\nText.", "Text.\n"),
    ("", "\n"),
    (None, None),
]


def test_clean_markdown(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEANED)], "doc_id long, text string")
    got = {r.doc_id: r.narration for r in lines.clean_markdown(df).collect()}
    assert [got[i] for i in range(len(CLEANED))] == [w for _, w in CLEANED]


def test_tables_can_be_read_and_patterns_added(spark):
    df = spark.createDataFrame([(1, "| a | b |\n| --- | --- |\n| 1 | 2 |\n\nSECRET COPY\n\nEnd.")], "doc_id long, text string")
    got = lines.clean_markdown(df, table_mode="linearize", drop_patterns=("^secret copy$",)).first().narration
    assert got == "a; b\n1; 2\nEnd.\n"
    with pytest.raises(ValueError, match="table_mode"):
        lines.clean_markdown(df, table_mode="all")


def test_cleaning_twice_changes_nothing(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEANED) if t], "doc_id long, text string")
    once = lines.clean_markdown(df)
    twice = lines.clean_markdown(once.select("doc_id", "narration"), "narration", "again")
    assert all(r.narration == r.again for r in twice.collect())


FOUND = [
    ("401 402 i777 cid:12 " * 60, {"CORRUPT_TEXT"}),
    ("In 2024, plan 1 cost $100 million, or 12.5%, over 10 years. " * 60, set()),
    (" \n", {"CORRUPT_TEXT"}),
    ("\x02\x03 word " * 60, {"CORRUPT_TEXT"}),
    ("b c d f g h lines", {"CORRUPT_TEXT"}),
    ("Some Title | Page 4\nText", {"PAGE_FOOTER"}),
    ("Firm  Other", {"UNSPOKEN_GLYPHS"}),
    ("It was 7 0% then.", {"DAMAGED_NUMBERS"}),
    ("It was $1. trillion then.", {"DAMAGED_NUMBERS"}),
    ("Stores grew; s (see it).", {"DAMAGED_SENTENCE"}),
    ("A claim. 4\nNext", {"POSSIBLE_INLINE_CITATIONS"}),
    ("A damag d word.", {"POSSIBLE_SPLIT_WORDS"}),
    ("Nvidia VIDIA makes it.", {"POSSIBLE_DUPLICATED_WORDS"}),
    ("A marketdriven one.", {"SUSPICIOUS_WORDS"}),
    ("BY A B\nText\nBY A B", {"REPEATED_BYLINES"}),
    (None, {"CORRUPT_TEXT"}),
]


def test_findings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FOUND)], "doc_id long, narration string")
    rows = {r.doc_id: r for r in quality.assess(df).collect()}
    assert [{f.code for f in rows[i].findings} for i in range(len(FOUND))] == [w for _, w in FOUND]
    assert rows[1].status == "PASS" and rows[9].status == "PASS WITH WARNINGS" and rows[5].status == "BLOCKED"
    assert quality.passed(quality.assess(df)).count() == sum(not r.blocked for r in rows.values())


def test_signals_and_leaks(spark):
    df = spark.createDataFrame([(1, "A Private  PERSON spoke.", ["private person"], 2, 1), (2, "Nobody.", ["private person"], 2, 0)], "doc_id long, narration string, hidden array<string>, redacted_text_items int, marked_visuals int")
    got = {r.doc_id: {f.code for f in r.findings} for r in quality.assess(df, hidden="hidden").collect()}
    assert got == {1: {"REDACTION_LEAK", "VISUALS"}, 2: {"REDACTION_SCRUBBED"}}
    assert quality.assess(df, hidden="hidden").columns[-3:] == ["findings", "blocked", "status"]
