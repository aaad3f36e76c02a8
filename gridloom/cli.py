"""spark-submit gridloom/cli.py files|reconstruct|score|inventory ...: the operators over tables in storage."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.operators import inventory, score
from gridloom.plans import boreholes, process, specs
from gridloom.sinks import sheets


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gridloom")
    commands = p.add_subparsers(dest="command", required=True)
    r = commands.add_parser("reconstruct", help="words and a layout grid to cells")
    for name in ("words", "grid", "out"):
        r.add_argument(f"--{name}", required=True)
    r.add_argument("--kind", choices=specs.KINDS, required=True)
    r.add_argument("--width", type=float, required=True)
    r.add_argument("--height", type=float, required=True)
    r.add_argument("--engine", choices=("hybrid", "reader", "layout"), default="hybrid")
    w = commands.add_parser("files", help="whole files: located objects, words and replies to sheets, meta rows and reports")
    for name in ("pages", "objects", "words", "replies", "out"):
        w.add_argument(f"--{name}", required=True)
    w.add_argument("--engine", choices=("hybrid", "reader", "layout"), default="hybrid")
    w.add_argument("--raw", help="the text engine's readings of forms, for engine reader")
    w.add_argument("--first-only", action="store_true", help="the first borehole of each file alone")
    s = commands.add_parser("score", help="sheets of a run against truth files")
    for name in ("truth", "sheets", "out"):
        s.add_argument(f"--{name}", required=True)
    i = commands.add_parser("inventory", help="objects of half pages, and their counts")
    for name in ("halves", "out"):
        i.add_argument(f"--{name}", required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName(f"gridloom {a.command}").getOrCreate()
    if a.command == "reconstruct":
        process.run(spark, a.words, a.grid, a.out, a.kind, a.width, a.height, a.engine).show(truncate=False)
    elif a.command == "files":
        pages = spark.read.parquet(a.pages)
        if a.first_only:
            pages = pages.where("page < 2")
        objects = spark.read.parquet(a.objects).join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
        grid, replies = boreholes.from_replies(boreholes.routed(objects), spark.read.parquet(a.replies))
        found = boreholes.run(pages, objects, spark.read.parquet(a.words), grid, replies, a.engine, spark.read.parquet(a.raw) if a.raw else None, subset=a.first_only)
        sheets.write_result(found, a.out)
        boreholes.numbered(spark.read.parquet(f"{a.out}/boreholes")).orderBy("doc_id", "position").show(truncate=False)
    elif a.command == "score":
        tables = spark.read.parquet(f"{a.sheets}/tables")
        found = score.report(score.read_truth(spark, a.truth), spark.read.parquet(f"{a.sheets}/cells").withColumn("text", F.col("grid_text")), tables, sheets.merges(spark.read.parquet(f"{a.sheets}/sheets").where("rs > 1 or cs > 1")))
        score.write_report(found, a.out)
        print("\n".join(score.summary_lines({name: spark.read.schema(df.schema).json(f"{a.out}/{name}") for name, df in found.items()})))
    else:
        inventory.locate(spark.read.parquet(a.halves)).write.mode("overwrite").parquet(f"{a.out}/objects")
        found = inventory.counts(spark.read.parquet(f"{a.out}/objects"))
        found.orderBy("kind").write.mode("overwrite").json(f"{a.out}/counts")
        found.orderBy("kind").show()
        if "path" in spark.read.parquet(f"{a.out}/objects").columns:
            inventory.report(spark.read.parquet(f"{a.out}/objects")).orderBy("path", "n").select("line").write.mode("overwrite").text(f"{a.out}/summary")


if __name__ == "__main__":
    main()
