"""Pages of documents: files of a folder, one partition for each page, and a seam for what renders them.

Rendering itself needs a program that isn't part of this library; a renderer is a function from
(file's bytes, page, dpi) to a gray image as (bytes, height, width).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """(path, modificationTime, length, content) of the files that match, each once."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).dropDuplicates(["path"])


def page_count(content: F.Column) -> F.Column:
    """The pages of a file from the counts in its page tree, without rendering; 0 for a file that keeps them compressed."""
    text = F.decode(content, "ISO-8859-1")
    counts = F.transform(F.regexp_extract_all(text, F.lit(r"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b"), F.lit(0)), lambda x: F.regexp_extract(x, r"/Count\s+(\d+)", 1).cast("int"))
    return F.coalesce(F.array_max(counts), F.lit(0))


def pages(listed: DataFrame, count: F.Column, only: list[int] | None = None) -> DataFrame:
    """(path, page) from 0 for each file; count gives a file's pages, of which one without a count has none; `only` keeps some of them before any is rendered."""
    found = listed.select("path", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("page"))
    return found if only is None else found.where(F.col("page").isin(only))


def rendered(spark: SparkSession, listed: DataFrame, wanted: DataFrame, render: Callable[[bytes, int, int], tuple[bytes, int, int]], dpi: int = 300) -> DataFrame:
    """(path, page, image, height, width): wanted pages dealt out evenly, whatever file they are of."""

    def run(batches):
        for pdf in batches:
            made = [render(c, int(p), dpi) for c, p in zip(pdf["content"], pdf["page"])]
            out = pd.DataFrame(made, columns=["image", "height", "width"])
            yield pd.concat([pdf[["path", "page"]].reset_index(drop=True), out], axis=1)

    dealt = wanted.join(listed.select("path", "content"), "path").repartition("path", "page")
    return dealt.mapInPandas(run, "path string, page int, image binary, height int, width int")
