"""Each text rule on hand-written strings; a branch that no string reaches fails here."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as X

CASES = {
    X.is_ditto: [("l", True), ("ll", True), (".", True), ("/", True), ("-ll-", True), ("L", False), ("II", False), ("3,6", False), ("-------", False), ("------", True), ("\xa0-\xa0", True), ("", False), (None, False)],
    X.is_ditto_loose: [("-u_", True), ("— и —", True), ("-k-", True), ("-abc-", False), ("ab", False), ("", False), (None, False)],
    X.norm: [("Ёлка-1", "елка1"), (" A b ", "ab"), (None, "")],
    X.norm_code: [("nc", "пс"), ("Нз", "нз"), (" h 3 ", "нз"), ("cл.", "сл"), ("6/o", "б/о"), ("nэ", "пс"), ("нэ", "нз"), ("zz", "zz")],
    X.clean_cell: [("a \n b", "a b"), ("\xa0a\xa0", "a"), (None, "")],
    X.is_junk: [("", True), (None, True), ("Описание", True), ("объём", True), ("объ", False), ("АБВГ", False), ("12", False)],
    X.digits: [("a1²b3", "1²3"), (None, "")],
    X.first_number: [("x 12,5 м 7", "12,5"), ("3.14.15", "3.14"), ("нет", ""), (None, "")],
    X.fuzzy: [("L", "<ditto>"), (">>", "<ditto>"), ("10 000,5", "10000.5"), ("1 2 3 4", "1234"), ("Ёж  и", "еж и"), (None, "")],
    X.mask_secrets: [("api-key  q_9 z", "api-key  *** z"), ("AQVNabcdefghij1234", "***"), ("sk-or-abcdef.123456", "***"), ("AQVNshort", "AQVNshort")],
    X.reply_json: [('```json\n{"a": 1}\n```', '{"a": 1}'), ('Here {"a": 1} ok', '{"a": 1}'), ("{broken", None), ('x {"a": 1} y }', None), ("", None), ("1, 2", None), ("1],[2", None)],
}


@pytest.mark.parametrize("rule", CASES, ids=lambda f: f.__name__)
def test_rule(spark, rule):
    rows = [(i, s) for i, (s, _) in enumerate(CASES[rule])]
    got = spark.createDataFrame(rows, "i int, s string").select("i", rule(F.col("s")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [w for _, w in CASES[rule]]


def test_agree_and_keys(spark):
    df = spark.createDataFrame([("abc", "AB"), ("ab", "x"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(X.agree(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    keys = spark.createDataFrame([("1)", 0), ("(2).", 0), ("ab", 0), ("12,5 м", 1), ("12345678", 1), ("5", 2)], "t string, c int")
    assert [r[0] for r in keys.select(X.looks_key(F.col("t"), F.col("c"))).collect()] == [True, True, False, True, False, False]
