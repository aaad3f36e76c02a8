from __future__ import annotations

import numpy as np

from gridloom.llm import embedding_join, util
from tests.llm.conftest import write


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((60, 64))
    rows = []
    for i in range(700):
        c = centre[i % 60] if i % 3 else centre[0]
        rows.append((i, (c + rng.standard_normal(64) * 0.1 * rng.random()).astype(np.float32).tolist(), i % 4))
    rows += [(700 + i, rows[9][1], rows[9][2]) for i in range(20)]
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] + [1.0] * 63, 1), (903, [None] + [1.0] * 63, 1), (904, rows[9][1], None), (905, [float("inf")] * 64, 1), (906, [], 1), (907, [1.0] * 3, 1), (908, [1.0] * 3, 1), (910, rows[1][1], rows[1][2]), (910, rows[1][1], rows[1][2])]
    write(spark, tmp_path, "embeddings", [(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, label int, component_id string, copies int")
    good = rows + odd[7:]
    x = [np.array(r[1], dtype=np.float64) for r in good]
    links = {k: set() for k in range(len(good))}
    for i in range(len(good)):
        for j in range(i):
            if good[i][2] == good[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    part = list(range(len(good)))
    for _ in range(len(good)):
        new = [min([part[i], *(part[j] for j in links[i])]) for i in range(len(good))]
        if new == part:
            break
        part = new
    want = sorted((good[i][0], len(links[i]), good[part[i]][0], good[part[i]][0] == good[i][0]) for i in range(len(good)))
    want += [(v, 0, v, True) for v in range(900, 907)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.op6_embedding_near_dedup(spark, str(tmp_path)).collect())
    assert got == sorted(want) and max(w[1] for w in want) > 20


def test_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, (np.ones(16) + rng.standard_normal(16) * 0.05).astype(np.float32).tolist(), 0) for i in range(60)]
    write(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {r["vec_id"]: r["n_links"] for r in embedding_join.op6_embedding_near_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: int(n) - 1 for i, n in enumerate((x @ x.T >= 0.98).sum(axis=1))}


def test_doubles_are_compared_as_doubles(spark, tmp_path):
    """Pairs within 1e-9 of the threshold, on either side, and components whose squares overflow."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(150):
        a, b = rng.standard_normal((2, 24))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.98 + (1e-9 if i % 2 else -1e-9)
        big = 1e200 if i < 20 else 1.0
        rows += [(2 * i, (a * big).tolist(), i), (2 * i + 1, ((c * a + np.sqrt(1 - c * c) * b) * big).tolist(), i)]
    write(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_join.op6_embedding_near_dedup(spark, str(tmp_path)).collect()}
    assert got == {j: i % 2 for i in range(150) for j in (2 * i, 2 * i + 1)}


def test_recall_where_keys_are_long(spark):
    """Pairs just above the threshold among many vectors of one label, with ten signs a key."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.981 * a + np.sqrt(1 - 0.981**2) * b
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate([*a, *near])], "vec_id long, embedding array<double>, label int")
    got = {r["v"]: r["component_id"] for r in embedding_join.classes(df, bucket=8).collect()}
    found = sum(got[4000 + i] == i for i in range(4000))
    assert found >= 3990, found


def test_empty(spark, tmp_path):
    write(spark, tmp_path, "embeddings", [], "vec_id long, embedding array<float>, label int")
    assert embedding_join.op6_embedding_near_dedup(spark, str(tmp_path)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    code, factor = embedding_join.encode(unit)
    turned = unit @ embedding_join.rotation(0, 64).T
    truth, got = unit @ unit.T, (turned @ code.T) / (8 * factor[None])
    off = ~np.eye(400, dtype=bool)
    assert abs((got - truth)[off].mean()) < 0.002 and (embedding_join.upper_bounds(turned, code, factor) >= truth)[off].mean() > 0.9999


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 80), (7, 7)] + [(500, 200 + i) for i in range(50)]
    got = dict(map(tuple, util.components(spark.createDataFrame(edges, "u long, v long")).distinct().collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 80, 90: 80, 80: 80, 500: 200, **{200 + i: 200 for i in range(50)}}
