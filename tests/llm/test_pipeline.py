import corpus_pipeline
from lectern.llm import packing


def test_stages_take_effect_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(now) <= ids
        assert name == "mixing" or len(now) == len(set(now))
        ids = set(now)
    assert ids


def test_run_packs_what_the_stages_keep(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part", "gap"]
    fill: dict = {}
    for r in rows.collect():
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert fill and max(fill.values()) <= packing.LIMIT


def test_empty_tables(spark, tmp_path):
    for t, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
