from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d int, spans string, `key` string"


def prose(seed: int, n: int, lines: int = 12) -> str:
    """n invented words, with a line feed after about every twelfth."""
    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "san", "vo", "ri", "del", "up", "no", "qua", "fes"]
    out = []
    for i in range(n):
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        out.append(w + (".\n" if i % lines == lines - 1 else " "))
    return "".join(out).strip()


def corpus() -> list[tuple[int | None, str | None]]:
    """Prose with exact and near copies, shared passages, and every odd text: null, empty, blank, short, long, repeated rows and ids."""
    rows: list[tuple[int | None, str | None]] = [(i, prose(i, 40 + 17 * i)) for i in range(24)]
    passage = prose(900, 130)
    rows += [(100 + i, prose(100 + i, 60) + "\n" + passage + "\n" + prose(200 + i, 60)) for i in range(6)]
    rows += [(300 + i, prose(20, 380)) for i in range(5)]
    for i in range(8):
        words = prose(21, 300).split(" ")
        words[37 * (i + 1) % 280] = f"edit{i}"
        rows.append((400 + i, " ".join(words)))
    rows += [(500, ""), (501, None), (502, " \n "), (503, "one two"), (504, "one two"), (505, "!!!"), (506, "same line here\n" * 80), (507, prose(7, 9000)), (508, "漢字 テスト " * 60), (None, prose(3, 91)), (None, None)]
    rows += [rows[5], rows[30], (7, prose(77, 50))]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else None, None, len(t or ""), 1, "x", None) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(docs, tmp_path_factory):
    """A folder with `documents` alone, as the queries read it."""
    at = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{at}/documents.parquet")
    return str(at)


def write(spark, at, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{at}/{name}.parquet")
