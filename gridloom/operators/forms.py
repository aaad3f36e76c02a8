"""Forms: fields by name from a reply, and rows of a reply as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.plans import specs


def spec_fields(spark: SparkSession) -> DataFrame:
    rows = [(form, i, key) for form, keys in specs.FORM_FIELDS.items() for i, key in enumerate(keys)]
    return spark.createDataFrame(rows, "form string, ord int, key string")


def fill(replies: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, form, ord, key, value, needs_review): every field of a form, blank where the reply has none.

    replies: (keys, form, values map<string,string>, low_conf array<string>).
    """
    each = replies.join(F.broadcast(fields), "form")
    value = F.coalesce(F.try_element_at("values", F.col("key")), F.lit(""))  # also where there is no reply
    return each.select(*keys, "form", "ord", "key", X.strip(value).alias("value"), F.coalesce(F.array_contains("low_conf", F.col("key")), F.lit(False)).alias("needs_review"))


def pad_row(row: F.Column, n: F.Column | int) -> F.Column:
    """An array of n strings: null as empty, longer rows cut."""
    n = n if isinstance(n, F.Column) else F.lit(n)
    return F.slice(F.concat(F.transform(row, lambda x: F.coalesce(x, F.lit(""))), F.array_repeat(F.lit(""), n)), F.lit(1), n)
