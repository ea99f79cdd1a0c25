"""Command line: run a query, run the research-front analysis, or show how far it is.

    python -m tallygrove query entity_cube --tables DIR --out DIR
    python -m tallygrove run --tables DIR --root DIR [--force-from LEVEL]
    python -m tallygrove status --root DIR
    python -m tallygrove setup --root DIR
    python -m tallygrove embed --texts DIR --root DIR
    python -m tallygrove all --tables DIR --texts DIR --root DIR

``setup`` makes the store of vectors, empty; ``embed`` fills it with vectors of
the texts that have none yet; ``all`` does both, then runs and shows the analysis.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import vectors
from .plans import fronts, registry, stages
from .session import session
from .sources import readers, writers
from .streaming import incremental


VECTORS = T.StructType([T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
DIM = 64


def embedded(spark: SparkSession, texts: str, store: str) -> int:
    """Append vectors of the texts (id, text) that the store has none of; their number."""
    rows = spark.read.parquet(texts).select(F.col("id").cast("string").alias("id"), "text")
    known = readers.row_count(spark, store)
    vectors.text_embedded(incremental.missing(rows, store, "id"), "id", "text", DIM).write.mode("append").parquet(store)
    return readers.row_count(spark, store) - known


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallygrove", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--master", help="for use without spark-submit, such as local[8]")
    commands = parser.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query")
    query.add_argument("name", choices=sorted(registry.queries()), metavar="NAME")
    query.add_argument("--tables", required=True)
    query.add_argument("--out", required=True)
    run = commands.add_parser("run")
    run.add_argument("--tables", required=True)
    run.add_argument("--root", required=True)
    run.add_argument("--force-from", choices=stages.LEVELS)
    status = commands.add_parser("status")
    status.add_argument("--root", required=True)
    commands.add_parser("setup").add_argument("--root", required=True)
    embed, whole = commands.add_parser("embed"), commands.add_parser("all")
    whole.add_argument("--tables", required=True)
    for command in (embed, whole):
        command.add_argument("--texts", required=True)
        command.add_argument("--root", required=True)
    args = parser.parse_args(argv)
    spark = session(master=args.master)
    if args.command == "query":
        registry.queries()[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
    if args.command in ("setup", "all"):
        writers.create_store(spark, f"{args.root}/vectors", VECTORS)
    if args.command in ("embed", "all"):
        print("embedded:", embedded(spark, args.texts, f"{args.root}/vectors"))
    if args.command in ("run", "all"):
        done, _ = fronts.analysis(spark, args.tables, args.root, getattr(args, "force_from", None))
        print("computed:", ", ".join(done.computed) or "nothing")
    if args.command in ("status", "all"):
        for level, rows in stages.Run(spark, args.root).status().items():
            print(f"{level:12} {'-' if rows is None else rows}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
