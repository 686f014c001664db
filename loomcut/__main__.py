"""``python -m loomcut``: chunk a folder into Parquet, or report on rows of metrics."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import loomcut as L
from loomcut.operators.evaluation import summary_report
from loomcut.sources.files import load_metrics, read_files, write_summary


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="loomcut", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    chunk = commands.add_parser("chunk", help="chunks of all source files below a folder")
    chunk.add_argument("folder")
    chunk.add_argument("out")
    chunk.add_argument("--max-chunk-size", type=int, default=L.Options.max_chunk_size)
    chunk.add_argument("--overlap-lines", type=int, default=L.Options.overlap_lines)
    report = commands.add_parser("report", help="summary of metrics by variant")
    report.add_argument("metrics")
    report.add_argument("--split", default="test")
    report.add_argument("--instance", action="append", help="only this instance; may be repeated")
    report.add_argument("--skip", action="append", default=[], help="leave out a variant; may be repeated")
    report.add_argument("--out", help="where the summary goes as JSON")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> None:
    args = arguments(given)
    spark = SparkSession.builder.appName("loomcut").getOrCreate()
    if args.command == "chunk":
        L.chunk_files(read_files(spark, args.folder), L.Options(max_chunk_size=args.max_chunk_size, overlap_lines=args.overlap_lines)).write.parquet(args.out)
        return
    metrics = load_metrics(spark, args.metrics).where(~F.col("agent_variant").isin(args.skip))
    if args.instance:
        metrics = metrics.where(F.col("instance_id").isin(args.instance))
    summary = L.aggregate_metrics(metrics)
    if args.out:
        write_summary(summary, args.out)
    print(summary_report(summary, args.split, metrics.select("instance_id").distinct().count()))


if __name__ == "__main__":
    main()
