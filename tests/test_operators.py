from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import cache, cluster, ditto, forms, identity, inventory, layout, reconcile, score
from gridloom.plans import specs
from gridloom.streaming import sessions


def words(spark, ys, table=1):
    return spark.createDataFrame([(table, i, float(y)) for i, y in enumerate(ys)], "table_id long, word_id long, y double")


def groups(spark, ys, tol=10.0):
    return [r["grp"] for r in cluster.gap_groups(words(spark, ys), ["table_id"], "y", tol, ["word_id"]).orderBy("word_id").collect()]


def test_gap_equal_to_tolerance_merges(spark):
    assert groups(spark, [0, 10, 20.5, 20.5]) == [0, 0, 1, 1]
    assert groups(spark, []) == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 200), min_size=1, max_size=30), st.integers(0, 9))
def test_clusters_do_not_depend_on_order(spark, ys, seed):
    mixed = ys[:]
    random.Random(seed).shuffle(mixed)
    assert max(groups(spark, ys)) == max(groups(spark, mixed))


def test_nearest_prefers_the_lower_index_and_may_leave_the_own_cluster(spark):
    c = spark.createDataFrame([(1, 0, 0.0), (1, 1, 10.0), (1, 2, 30.0)], "table_id long, ri int, cy double")
    got = cluster.nearest(words(spark, [5, 5.1, -3, 99, 20]), c, ["table_id"], "y").orderBy("word_id").collect()
    assert [r["ri"] for r in got] == [0, 1, 0, 2, 1]


def test_pitch_of_one_row(spark):
    c = spark.createDataFrame([(1, 0, 5.0), (2, 0, 0.0), (2, 1, 4.0), (2, 2, 14.0)], "table_id long, ri int, cy double")
    assert {r["table_id"]: r["pitch"] for r in cluster.pitch(c, ["table_id"], 70.0).collect()} == {1: 70.0, 2: 7.0}


def test_bounds_and_bands(spark):
    b = layout.column_bounds(layout.spec_columns(spark), 1000).where("kind = 'journal_left'").orderBy("ci")
    assert [r["hi"] for r in b.collect()] == [49, 125, 207, 288, 689, 796, 885, 1000]
    w = spark.createDataFrame([(0, 0.0), (1, 49.0), (2, 1000.0), (3, -1.0)], "i int, cx double")
    assert [r["ci"] for r in layout.place(w, b).orderBy("i").collect()] == [0, 1, None, None]


def body(spark, rows):
    df = spark.createDataFrame([(1, *r) for r in rows], "table_id long, ri int, ci int, text string")
    return [r["ri"] for r in layout.table_body(df).orderBy("ri", "ci").collect()]


def test_header_and_footer(spark):
    assert body(spark, [(0, 0, "Описание"), (1, 0, "1"), (2, 0, "глубина"), (3, 0, "3"), (4, 0, "Геолог"), (5, 0, "5")]) == [1, 3]
    assert body(spark, [(0, 0, "aa"), (1, 0, "bb")]) == [0, 1]  # no key at all
    assert body(spark, [(0, 0, "мастер"), (1, 0, "bb")]) == []  # the first row ends it
    assert body(spark, [(0, 0, "мастер"), (1, 0, "1")]) == [1]  # a footer above the body doesn't count


def test_fixed_rows(spark):
    rows = [(1, i, 450.0 + 200 * i, 0, "метка") for i in range(5)] + [(1, 9, 550.0, 2, "7"), (1, 10, 555.0, 2, "8"), (1, 11, 5.0, 2, "9"), (2, 1, 500.0, 2, "5"), (1, 12, 450.0, 2, "геолог")]
    df = spark.createDataFrame(rows, "table_id long, word_id long, y double, ci int, text string")
    got = {(r["table_id"], r["word_id"]): r["r"] for r in layout.fixed_rows(df, 1400.0, 2, 5).where("ci = 2").collect()}
    assert got == {(1, 9): 0, (1, 10): 1, (2, 1): 0}


def test_ditto(spark):
    col = ["-ll-", "a", "", "-ll-", " ", "ll", "b", "-"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(col)], "table_id long, r int, text string")
    got = ditto.expand(df, ["table_id"], ["r"]).orderBy("r").collect()
    assert [r["value"] for r in got] == ["-ll-", "a", "", "a", " ", "a", "b", "b"]
    assert [r["expanded"] for r in got] == [False, False, False, True, False, True, False, True]


RULES = [  # kind, q, y, ink -> text, source, conf, review
    ("journal_left", "", "", False, None),
    ("journal_left", "-ll-", "x", True, ("-ll-", "layout", None, False)),
    ("journal_left", "abc", "AB", True, ("abc", "hybrid", 0.95, False)),
    ("journal_left", "abc", "zz", True, ("abc", "layout", 0.45, True)),
    ("journal_left", "abc", "", True, ("abc", "layout", 0.5, False)),
    ("journal_left", "", "zz", False, ("zz", "reader", 0.7, False)),
    ("journal_left", "", "", True, None),
    ("sampling_right", "abc", "AB", True, ("AB", "hybrid", 0.7, False)),
    ("sampling_right", "abc", "zz", True, ("zz", "reader", 0.7, True)),
    ("sampling_right", "abc", "", True, ("abc", "layout", 0.5, True)),
    ("sampling_right", "", "H3", True, ("нз", "reader", 0.7, False)),
    ("podschet", "4,5 м", "", True, ("4,5", "layout", 0.5, False)),
    ("podschet", "нет", "", True, None),
]


@pytest.mark.parametrize("kind", ["journal_left", "sampling_right", "podschet"])
def test_reconcile(spark, kind):
    rules = [r for r in RULES if r[0] == kind]
    df = spark.createDataFrame([(i, 2, q, y, 0.7, ink) for i, (_, q, y, ink, _) in enumerate(rules)], "r int, c int, q string, y string, y_conf double, ink boolean")
    got = {r["r"]: (r["text"], r["source"], r["conf"], r["needs_review"]) for r in reconcile.cells(df, kind).collect()}
    assert got == {i: w for i, (*_, w) in enumerate(rules) if w}


def test_blank_repeats(spark):
    row = ["x", "", "", "", "75", "12", "5", "7", "", "120"]
    df = spark.createDataFrame([(1, 0, c, t) for c, t in enumerate(row)], "t long, r int, c int, text string")
    got = [r["text"] for r in reconcile.blank_repeats(df, ["t", "r"], [4, 5, 6], [7, 8, 9]).orderBy("c").collect()]
    assert got[4:7] == ["", "", "5"]


def test_objects(spark):
    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    rows = [(1, "L", 999, 1401, (1, 2, 900, 1300), None), (2, "R", 999, 1401, (1, 2, 900, 1300), None), (3, "L", 999, 1401, None, (5, 6, 700, 300)), (4, "L", 999, 1401, None, None), (5, "R", 999, 1401, None, None), (6, "full", 9, 9, None, None)]
    df = spark.createDataFrame(rows, f"id int, side string, width int, height int, main {box}, top {box}")
    got = {}
    for r in inventory.locate(df).orderBy("id").collect():
        got.setdefault(r["id"], []).append((r["kind"], r["x0"], r["y0"], r["x1"], r["y1"]))
    assert got[1] == [("journal_left", 1, 2, 900, 1300)]
    assert [k for k, *_ in got[2]] == ["sampling_right", "pokazateli", "kontrol"] and got[2][0][1:] == (57, 2, 491, 1300)
    assert got[3] == [("samorodki", 5, 6, 700, 300), ("form_act", 0, 300, 999, 1401)]
    assert [k for k, *_ in got[4]] == ["samorodki", "form_act"] and [k for k, *_ in got[5]] == ["form_journal", "podschet"] and got[6][0][0] == "unknown"


def test_identity(spark):
    p = spark.createDataFrame([(1, i) for i in range(5)], "doc int, page int")
    assert [r["hole"] for r in identity.spreads(p, ["doc"], "page", [7, 9, 11]).orderBy("page").collect()] == [7, 7, 9, 9, 11]
    with pytest.raises(Exception, match="3 spreads but 2 numbers"):
        identity.spreads(p, ["doc"], "page", [7, 9]).collect()
    f = spark.createDataFrame([(1, 0, "Отряд", "5"), (1, 1, "Скважина №", None), (1, 2, "4. Скважина №", "№ 12"), (2, 0, "Дата", "3")], "doc int, ord int, key string, value string")
    assert {r["doc"]: r["hint"] for r in identity.hole_hint(f, ["doc"]).collect()} == {1: "12", 2: "1"}
    n = spark.createDataFrame([("a/b:c" + "x" * 40,)], "n string").select(identity.safe_name(F.col("n"))).first()[0]
    assert n == "a_b_c" + "x" * 26


def test_forms_and_cache(spark):
    r = spark.createDataFrame([(1, "form_act", {"Геолог": " x "}, ["Дата"])], "id int, form string, values map<string,string>, low_conf array<string>")
    got = {x["key"]: (x["value"], x["needs_review"]) for x in forms.fill(r, forms.spec_fields(spark), ["id"]).collect()}
    assert len(got) == len(specs.ACT_FIELDS) and got["Геолог"] == ("x", False) and got["Дата"] == ("", True)
    rows = spark.createDataFrame([(["a", None, "c"],), (["a"],)], "a array<string>").select(forms.pad_row(F.col("a"), 2)).collect()
    assert [x[0] for x in rows] == [["a", ""], ["a", ""]]
    q, c = spark.createDataFrame([("a",), ("b",), ("b",)], "key string"), spark.createDataFrame([("a", 1)], "key string, v int")
    assert [x["key"] for x in cache.misses(q, c).collect()] == ["b"] and cache.hits(q, c).count() == 1


def test_score(spark):
    t = spark.createDataFrame([("podschet", 0, 0, "a", False, False, False), ("podschet", 0, 2, "1,5", False, False, False), ("kontrol", 0, 1, "x", False, True, False), ("kontrol", 1, 1, "x", False, False, True)], "kind string, r int, c int, text string, ditto boolean, empty boolean, graphic boolean")
    f = spark.createDataFrame([("podschet", 0, 2, "1.5")], "kind string, r int, c int, text string")
    hits = score.judged(t, f, [])
    assert sorted((r["c"], r["strict"], r["fuzzy"], r["fixed"]) for r in hits.collect()) == [(0, False, False, True), (2, False, True, False)]
    assert {(r["kind"], r["total"], r["n_fuzzy"]) for r in score.accuracy(hits, ["kind"]).collect()} == {("podschet", 2, 1), (None, 2, 1)}


def test_sessions_are_the_same_for_a_stream(spark, tmp_path):
    rows = [(1, y) for y in (0, 1_000_000, 3_000_000, 9_000_000)] + [(2, 0), (9, 10**12)]
    df = spark.createDataFrame(rows, "table_id long, y long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r["table_id"], r["first"], r["last"], r["n"]) for r in sessions.by_gap(df, "2 seconds").collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions.by_gap(stream, "2 seconds", "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["table_id"], r["first"], r["last"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {x for x in batch if x[0] != 9} and (1, 0, 3_000_000, 3) in batch


def test_recognised_once(spark, tmp_path):
    def run():
        stream = spark.readStream.schema("key string").parquet(str(tmp_path / "in"))
        sessions.recognise_new(stream, str(tmp_path / "cache"), lambda d: d.withColumn("out", F.upper("key")), str(tmp_path / "ck")).awaitTermination()

    spark.createDataFrame([("a",), ("b",), ("a",)], "key string").write.parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame([("b",), ("c",)], "key string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r["out"] for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == ["A", "B", "C"]
