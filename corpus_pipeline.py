"""Cleans `documents` and packs what is left into training sequences.

Documents without a language go; later copies of repeated runs of lines go; of near-duplicates the
one of the least id stays; documents that hold a benchmark item go; the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, util

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontaminate", decontaminate.stage),
    ("packing", packing.stage),
]

ORACLE_SQL = None  # a learned classifier and a vocabulary take part; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = util.stash(docs)
    return docs
