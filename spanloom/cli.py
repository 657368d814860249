"""Redact a text or a file from the command line: ``python -m spanloom.cli TEXT`` or ``--file PATH``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.redact import Scrubber


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom", description="Redact personal data.")
    p.add_argument("text", nargs="?", help="text to redact")
    p.add_argument("--file", help="UTF-8 file to read instead")
    p.add_argument("--entities", help="entity types, separated by commas and taken as written")
    p.add_argument("--mapping-out", help="where the mapping goes as JSON")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if bool(args.text) == bool(args.file):  # an empty text counts as missing
        raise SystemExit("provide exactly one of TEXT or --file")
    spark = SparkSession.builder.appName("spanloom").getOrCreate()
    text = args.text or Path(args.file).read_text("utf-8")
    entities = set(args.entities.split(",")) if args.entities else None
    row = Scrubber().scrub(spark.createDataFrame([(text,)], "text string"), entities=entities).first()
    print(row.redacted_text)
    if args.mapping_out:
        Path(args.mapping_out).write_text(json.dumps([m.asDict() for m in row.mapping], ensure_ascii=False, indent=2), "utf-8")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
