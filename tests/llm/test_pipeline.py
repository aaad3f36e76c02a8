from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose, write


def test_stages_take_effect(spark, docs, tmp_path):
    passage = prose(4444, 40)
    words = prose(801, 300).split(" ")
    near = [(800 + i, " ".join(f"edit{i}" if i and k % 48 == 40 else w for k, w in enumerate(words))) for i in range(4)]  # too many edits for a copied run of lines
    extra = spark.createDataFrame([(700, prose(701, 200) + "\n" + passage + "\n" + prose(702, 200)), *near], "doc_id long, text string")
    docs.unionByName(extra, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    write(spark, tmp_path, "benchmark", [(1, passage)], "item_id long, text string")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"] for r in at.select("doc_id").collect()})
    first, lines, near, clean, packed = seen
    assert first >= set(range(24)) | {700} and not first & {500, 501, 502, 505}
    assert lines >= set(range(24)) - {3} and not lines & {3, 300, 301}  # whole copies have no line left; that of 3 without an id stands first
    assert near >= set(range(20)) - {3} and near & set(range(800, 804)) == {800} and lines >= set(range(800, 804))
    assert clean == near - {700} and packed == clean
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == packed


def test_only_contaminated_rows_go(spark, tmp_path):
    """Clean rows that share a null or repeated id with a contaminated one stay."""
    from gridloom.llm import decontaminate

    passage = prose(4444, 40)
    write(spark, tmp_path, "benchmark", [(1, passage)], "item_id long, text string")
    bad = prose(1, 50) + " " + passage
    rows = [(None, bad), (None, prose(2, 50)), (None, None), (7, bad), (7, prose(3, 50)), (8, prose(4, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = decontaminate.stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


CLASHING = "score lang_pred runner_up ambiguous told removed_lines d d_ th th_ spans spans_ cut held_id held_d held_th class_id n_links part m copies shingles paths sketch key u v label".split()


@pytest.mark.parametrize("i", range(4))
def test_names_that_stages_use_themselves(spark, docs, tmp_path, i):
    """Columns with the stages' own names, some spelled in capitals, one with odd signs, come through as they are."""
    write(spark, tmp_path, "benchmark", [(1, prose(3, 40))], "item_id long, text string")
    names = [n.upper() if k % 3 == 0 else n for k, n in enumerate(CLASHING)] + ["a.b `c`"]
    rows = docs.select("doc_id", "text", "lang")
    for k, n in enumerate(names):
        rows = rows.withColumn(n, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    rows = rows.withColumn("big", F.lit(2**60 + 1)).withColumn("when", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("map", F.create_map(F.lit("k"), F.col("doc_id")))
    name, stage = corpus_pipeline.STAGES[i]
    out = stage(spark, rows, str(tmp_path))
    assert out.columns == rows.columns and [f.dataType for f in out.schema] == [f.dataType for f in rows.schema]
    got = out.collect()
    assert len(got) > 20
    for r in got:
        assert r["big"] == 2**60 + 1 and r["map"] == {"k": r["doc_id"]}
        assert all(r[n] == f"{k}:{'-' if r['doc_id'] is None else r['doc_id']}" for k, n in enumerate(names)), name


def test_language_decides(spark, tmp_path):
    """The stage goes by what the classifiers say: texts of unwanted languages and those of no one language go."""
    from gridloom.llm import language_id

    say = {"one": "the cat and the dog sat on the mat by the door", "two": "der hund und die katze liegen auf dem teppich", "six": "le chat et le chien sont assis sur le tapis"}
    rows = [(i, " ".join(random.Random(i).choices(say[x].split(), k=40)), x) for i, x in enumerate(list(say) * 60)]
    rows += [(900, rows[0][1], None), (901, rows[1][1], None), (902, "12 ½ ² ① --", None), (903, None, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language_id.stage(spark, df, "").collect()}
    assert kept == {r[0] for r in rows} - {902, 903}
    only = {r["doc_id"]: r["lang"] for r in language_id.stage(spark, df, "", wanted=["two"]).collect()}
    assert 901 in only and 900 not in only and set(only.values()) == {"two", None} and len(only) == 61
    sure = {r["doc_id"] for r in language_id.stage(spark, df, "", least_score=1.01).collect()}
    assert sure == set()


def test_one_python_worker_for_a_task(spark, docs, folder):
    """No text is cut or told twice in a task: each further worker stays in an executor's memory."""
    from gridloom.llm import language_id, line_dedup

    cut = line_dedup.stage(spark, docs, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert cut.count("ArrowEvalPython") == 1, cut
    told = language_id.stage(spark, docs, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("ArrowEvalPython") == 1, told


@pytest.mark.parametrize("i", [0, 4])
def test_frames_of_the_driver(spark, folder, monkeypatch, i):
    """The shares of languages and the plan of slots are relations, not rows that Python workers read."""
    made, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: made.append(make(*a, **b)) or made[-1])
    name, stage = corpus_pipeline.STAGES[i]
    assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count() > 20
    assert len(made) == 1 and "LocalRelation" in made[0]._jdf.queryExecution().optimizedPlan().toString(), name


def test_empty(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    write(spark, tmp_path, "benchmark", [], "item_id long, text string")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
