"""A thin command line over the engine (OR8, OR9): extract, speak, make, doctor."""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import sys

from pyspark.sql import functions as F

from lectern import schemas
from lectern.errors import LecternError
from lectern.functions import text as X
from lectern.operators import chunking, lines, quality
from lectern.plans import extract
from lectern.session import local_session
from lectern.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="clean markdown or text files to narration, with a report")
    s = sub.add_parser("speak", help="gate texts as they are and list their speech tasks")
    m = sub.add_parser("make", help="clean, gate and list speech tasks")
    for x in (e, s, m):
        x.add_argument("inputs", nargs="+")
        x.add_argument("--output", required=True)
        x.add_argument("--max-chars", type=int, default=chunking.MAX_CHARS)
    for x in (e, m):
        x.add_argument("--pdf-parser", help="module:function from a PDF's bytes to rows of blocks, for PDF inputs")
        x.add_argument("--table-mode", choices=lines.MODES, default="smart")
        x.add_argument("--drop-regex", action="append", default=[])
    sub.add_parser("doctor", help="say what is missing")
    return p


def doctor() -> list[str]:
    return [f"{name}: {'found' if importlib.util.find_spec(name) else 'MISSING'}" for name in ("pyspark", "pyarrow", "pandas")]


def _parser_of(name: str | None):
    """The function that --pdf-parser names; PDF inputs need one."""
    if not name or ":" not in name:
        raise LecternError("PDF inputs need --pdf-parser module:function")
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError) as e:
        raise LecternError(f"--pdf-parser {name}: {e}") from e


def _extracted(spark, pdfs, args):
    """path, narration and the report's columns of PDF inputs, by the whole plan from blocks."""
    blocks = readers.read_pdf(pdfs, _parser_of(args.pdf_parser), schemas.BLOCKS).persist()
    dims = blocks.select("doc_id", "page", "page_width", "page_height").distinct()
    got = extract.extract(extract.Parsed(blocks, dims), args.table_mode, tuple(args.drop_regex))
    return pdfs.select("path", F.xxhash64("path").alias("doc_id")).join(got, "doc_id", "left")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "doctor":
        print("\n".join(doctor()))
        return 0
    try:
        spark = local_session("lectern-cli")
        inputs = readers.files(spark, [readers.resolve(p) for p in args.inputs])
        readers.validate(inputs)
        if inputs.count() < len(args.inputs):
            raise LecternError("an input is empty")
        pdfs = readers.dispatch(inputs).where("kind = 'pdf'")
        some = not pdfs.isEmpty()
        if some and args.command == "speak":
            raise LecternError("speak takes texts; make takes PDFs")
        docs = readers.read_texts(inputs).withColumn("doc_id", F.xxhash64("path"))
        if bad := docs.where("error IS NOT NULL").limit(1).collect():
            raise LecternError(f"{bad[0]['path']}: {bad[0]['error']}")
        if args.command != "speak":
            docs = lines.clean_markdown(docs, "narration", "narration", args.table_mode, tuple(args.drop_regex))
        assessed = quality.assess(docs).select("doc_id", "path", "narration", "findings", "blocked", "status")
        if some:
            assessed = assessed.unionByName(_extracted(spark, pdfs, args).select(*assessed.columns))
        assessed = assessed.withColumn("name", X.stem(F.col("path"))).persist()
        for r in assessed.select("path", quality.render_report("findings").alias("report")).toLocalIterator():
            print(r["path"], r["report"], sep="\n")
        if args.command == "extract":
            sinks.write_artifacts(assessed, args.output)
            return 0
        if assessed.where("blocked").limit(1).collect():
            raise LecternError("the quality gate stopped an input; see the report")
        sinks.manifest(assessed, options=sinks.SpeechOptions(bucket="", max_chars=args.max_chars)).write.parquet(args.output)
        return 0
    except LecternError as e:
        print(f"lectern: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
