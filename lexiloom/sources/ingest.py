"""Delimited text to message records: `python -m lexiloom.sources.ingest IN OUT [-r READER] [-debug N]`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import readers


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Messages of delimited text as Parquet")
    p.add_argument("input_file")
    p.add_argument("output_dir")
    p.add_argument("-r", "--reader", default="default", choices=sorted(readers.READERS))
    p.add_argument("-debug", type=int, help="take so many messages only, and show them")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    readers.save_messages(readers.read_messages(spark, a.input_file, a.reader, a.debug), a.output_dir)
    share = readers.kept_percent(spark.read.text(a.input_file), a.reader).first()[0]
    print("no lines" if share is None else f"kept {share:.2f} percent of lines")
    if a.debug:
        for r in readers.display(readers.load_messages(spark, a.output_dir)).collect():  # as many as asked for
            print(r.json)


if __name__ == "__main__":
    main()
