"""Readers of documents as DataFrames (SC1, SC2, SC5-SC7, SC10, SC11)."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.errors import LecternError
from lectern.functions import text as X
from lectern.operators.folds import small_batches
from lectern.sources.rtf import read_rtf

SUFFIXES = (".pdf", ".txt", ".rtf")


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, content, length of files; one row each, read where the tasks run. Spark lists no file of 0 bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def dispatch(inputs: DataFrame) -> DataFrame:
    """SC5: inputs with `kind`: pdf, txt, rtf or null for others."""
    s = suffix(F.col("path"))
    return inputs.withColumn("kind", F.when(s.isin(*SUFFIXES), F.substring(s, 2, 9)))


def decode_text(content: Column) -> Column:
    """SC2: strict UTF-8 without its mark, universal newlines; null where the bytes are not UTF-8."""
    text = F.try_validate_utf8(content.cast("string"))
    return X.newlines(X.sub(text, "^\ufeff", ""))


def read_texts(inputs: DataFrame) -> DataFrame:
    """SC2, SC3: path, narration and error for txt and rtf rows of files(); one of the two is null."""

    @F.pandas_udf("struct<text:string, error:string>")
    def rtf(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            try:
                out.append((read_rtf(bytes(data)), None))
            except LecternError as e:
                out.append((None, f"RTF: {e}"))
        return pd.DataFrame(out, columns=["text", "error"])

    small_batches(inputs.sparkSession)
    kinds = dispatch(inputs)
    plain = kinds.where("kind = 'txt'").withColumn("narration", decode_text(F.col("content")))
    plain = plain.select("path", "narration", F.when(F.col("narration").isNull(), F.lit("not UTF-8 text")).alias("error"))
    rich = kinds.where("kind = 'rtf'").withColumn("r", rtf("content")).select("path", F.col("r.text").alias("narration"), F.col("r.error").alias("error"))
    return plain.unionByName(rich)


def duplicate_stems(inputs: DataFrame, path: str = "path") -> DataFrame:
    """SC10: case-folded stems that several inputs share, which would write the same outputs: stem, n."""
    return inputs.select(F.lower(X.stem(F.col(path))).alias("stem")).where("stem <> ''").groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate(inputs: DataFrame) -> None:
    """SC10: every input has a known suffix, and no two have the same case-folded stem."""
    bad = dispatch(inputs).where("kind IS NULL").limit(1).collect()
    if bad:
        raise LecternError(f"{bad[0]['path']}: inputs end in {', '.join(SUFFIXES)}")
    twice = duplicate_stems(inputs).limit(1).collect()
    if twice:
        raise LecternError(f"several inputs are named {twice[0]['stem']}")


def resolve(name: str, folders: tuple[str, ...] = ("input", os.path.expanduser("~/Downloads"))) -> str:
    """SC11: a bare name is looked for in the folders, in order; with a slash it is a path."""
    if "/" in name:
        return name
    for folder in folders:
        if os.path.exists(p := os.path.join(folder, name)):
            return p
    raise LecternError(f"{name} is in none of {', '.join(folders)}")


#: A parser of a PDF's bytes gives rows of one of the schemas below, as dicts, without doc_id.
Parser = Callable[[bytes], list[dict]]


def read_pdf(inputs: DataFrame, parser: Parser, schema=schemas.ITEMS) -> DataFrame:
    """SC1, SC6, SC7: rows that a parser finds in each PDF (items, pictures, tables, text objects or paths).

    No PDF parser comes with the engine; any function of the file's bytes does, one file at a time in a task.
    doc_id is a hash of the path.
    """
    names = schema.fieldNames()

    def run(frames):
        for pdf in frames:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                rows = parser(bytes(content))
                if rows:
                    yield pd.DataFrame([{n: doc_id if n == "doc_id" else r.get(n) for n in names} for r in rows], columns=names)

    own = dispatch(inputs).where("kind = 'pdf'").select(F.xxhash64("path").alias("doc_id"), "content")
    return own.mapInPandas(run, schema)
