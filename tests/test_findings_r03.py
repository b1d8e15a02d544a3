"""Queries against their SQL on texts of the kind that differed in round 3."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare

from lectern import schemas
from lectern.operators import evidence, lines
from lectern.queries import ORACLE, QUERIES

#: A line of more than 40,000 characters between short ones.
_LONG = "A short line.\n" + "Nine boats left. " * 3000 + "\nAn end."
#: By query, texts that each stand under ids of all kinds; of pages, their HTML.
ODD = {
    "chunk_pack": [_LONG],
    "chunk_manifest": [_LONG],
    "findings_by_code": ["The ÉATHED THED came.", "It made $1. millioné.", "épage 3 | there"],
    "quality_status_by_lang": ["The ÉATHED THED came.", "It made $1. millioné.", "épage 3 | there"],
    "quality_status_decorated": ["The ÉATHED THED came.", "It made $1. millioné.", "épage 3 | there"],
    "html_to_text": ["<title>A &amp;&amp;&amp</title><p>&copy; &notit; &amp;quot; b &am</p>"],
    "item_blocks": ["", "One line."],
    "notice_strip": ["All rights reserved.\nA body of\ntwo lines.", "", "Spaced.\n\n\nWide.\n"],
    "ocr_polish": ["A word$$$ 1234### and so on."],
    "sentence_repairs": ["A word$$$ 1234### and so on."],
    "retry_corrupt": ["Esqueta y y y y y y y en.\nOs arco.", "A sound text."],
}


@pytest.mark.parametrize("name", ODD)
def test_odd_texts_match_the_sql(spark, tmp_path, name):
    texts = [t for t in ODD[name] for _ in range(120)]
    ids = pa.array(range(len(texts)), pa.int64())
    pq.write_table(pa.table({"doc_id": ids, "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"page_id": ids, "url": ["u"] * len(texts), "html": texts}), tmp_path / "pages.parquet")
    n, ours, theirs = compare(spark, QUERIES[name], ORACLE[name], str(tmp_path))
    assert n > 0
    assert not ours and not theirs


def test_one_text_proves_all_pages_of_a_document(spark):
    """the text of a document comes once to its blocks, and is read once."""
    lines = ["A deep-water quay."] + [f"Line {i} of the quay." for i in range(40)] + ["A deepwater qu ay, 4 0% full, for $2. billion."]
    blocks = spark.createDataFrame([(1, i, t, "text", i // 5 + 1, 50.0, 600.0, 550.0, 500.0, 612.0, 792.0) for i, t in enumerate(lines)], schemas.BLOCKS)
    text = spark.createDataFrame([(1, "\n".join([*lines[:-1], "It is 40% full, for $2.5 billion."]))], "doc_id long, page_text string")
    none = [spark.createDataFrame([], s) for s in (schemas.RAISED_REFS, "doc_id long, marker string", schemas.WORD_JOINS)]
    got = evidence.repair_blocks(blocks, *none, text).orderBy("seq").collect()
    assert [r.text for r in got] == [*lines[:-1], "A deep-water quay, 40% full, for $2.5 billion."]
    assert [(r.joined_words, r.restored_numbers, r.restored_forms) for r in got][-2:] == [(0, 0, 0), (1, 2, 1)]


def test_rtf_is_read_in_small_batches(spark, sf):
    """Python gets 4 MB of texts at once, not 10,000 texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    QUERIES["rtf_decode"](spark, sf)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_guards_of_cleaning_let_every_repair_through(spark):
    """a rule that is looked for first is applied wherever it was before."""
    texts = [("An&amp;d &&& so & on, acq\t uired &#33;", "An&d &&& so & on, acquired!\n"), ("( A ROduct ) : made ; by MAN POWER", "( A product): made; by manpower\n".replace("( ", "(")), ("Nego-\n  tiators\tmet.  Twice.", "Negotiators met. Twice.\n")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert [r.narration for r in lines.clean_markdown(docs).orderBy("doc_id").collect()] == [w for _, w in texts]
