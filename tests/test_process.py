from __future__ import annotations

import json

from gridloom import cli
from gridloom.plans import process


def test_recognise_journal(spark, tmp_path):
    # 1000 wide: bands 0 49 125 207 288 689 796 885 1000
    at = {0: 20, 1: 80, 4: 400, 6: 830}
    rows = [(0, 4, "описание"), (1, 0, "1"), (1, 1, "2,5"), (1, 4, "глина"), (2, 0, "2"), (2, 1, "3,0"), (2, 4, "-//-"), (2, 6, "IV"), (3, 0, "мастер")]
    words = spark.createDataFrame([(1, i, float(at[c]), 100.0 * r + i % 3, t, 0.8) for i, (r, c, t) in enumerate(rows)], "table_id long, word_id long, cx double, y double, text string, conf double")
    reply = json.dumps({"rows": [["1", "2,5", "", "", "Глина."], ["2", "9,9", "", "", "-ll-", "", "", "", "extra"], ["7"]], "low_conf": [[1, 1]]})
    replies = spark.createDataFrame([(1, f"```json\n{reply}\n```")], "table_id long, reply string")
    grid = process.reply_cells(replies, "journal_left")
    assert grid.count() == 24 and grid.where("low").collect()[0]["q"] == "9,9"
    cells = process.recognise(words, grid, "journal_left", 1000, 1400)
    got = {(r["r"], r["c"]): (r["text"], r["source"], r["needs_review"], r["expanded"]) for r in cells.collect()}
    assert got == {
        (0, 0): ("1", "hybrid", False, False), (0, 1): ("2,5", "hybrid", False, False), (0, 4): ("Глина.", "hybrid", False, False),
        (1, 0): ("2", "hybrid", False, False), (1, 1): ("9,9", "layout", True, False), (1, 4): ("-ll-", "layout", False, True), (1, 6): ("IV", "reader", False, False),
    }
    s = process.summary(cells, grid).first()
    assert (s["n_cells"], s["n_rows"], s["n_review"], s["n_expanded"], s["layout_rows"], s["n_disagree"]) == (7, 2, 1, 1, 3, 1)
    words.write.parquet(str(tmp_path / "w"))
    grid.write.parquet(str(tmp_path / "g"))
    cli.main(["reconstruct", "--words", str(tmp_path / "w"), "--grid", str(tmp_path / "g"), "--out", str(tmp_path / "o"), "--kind", "journal_left", "--width", "1000", "--height", "1400"])
    assert spark.read.parquet(str(tmp_path / "o" / "cells")).count() == 7


def test_recognise_labelled(spark):
    labels = [(1, i, 100.0, 400.0 + 250 * i + 20, "метка", 0.9) for i in range(5)]
    words = spark.createDataFrame([*labels, (1, 9, 480.0, 425.0, "4,5 м", 0.9), (1, 10, 560.0, 920.0, "без", 0.9)], "table_id long, word_id long, cx double, y double, text string, conf double")
    grid = spark.createDataFrame([(1, 2, 3, "12")], "table_id long, r int, c int, q string")
    got = {(r["r"], r["c"]): (r["text"], r["conf"]) for r in process.recognise(words, grid, "podschet", 1000, 1400).collect()}
    assert got == {(0, 2): ("4,5", None), (2, 3): ("12", 0.45)}


def test_prompt_names_all_columns():
    assert "Глубина, м — скважины" in process.prompt("journal_left") and "8 texts" in process.prompt("journal_left")
