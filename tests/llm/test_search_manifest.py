from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest

from gridloom.llm import merkle, ranked_search, toxicity
from tests.llm.conftest import SCHEMA, prose, write


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: tuple, text) -> str:
    doc_id, _, lang, source, n_chars = row[:5]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each node what stands before and after it in its run, level by level."""
    steps, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i in range(len(nodes)):
            run = range(i - i % 8, min(len(nodes), i - i % 8 + 8))
            step = ("".join(nodes[k] for k in run if k < i), "".join(nodes[k] for k in run if k > i))
            for x in below[i]:
                steps[x].append(step)
        below = [sum(below[i : i + 8], []) for i in range(0, len(nodes), 8)]
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], steps


def whole(rows: list[tuple]) -> list[tuple]:
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    found = [tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in langs]
    root, top = tree([r for r, _ in found])
    out = []
    for k, (subroot, steps), over in zip(langs, found, top):
        for (_, _, own, r), mine in zip(sorted(by[k], key=lambda x: x[:3]), steps):
            path = mine + over
            test = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                test = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
            for a, b in path:
                test = sha(a + test + b)
            out.append((r[0], own, subroot, root, sha("".join(a + b for a, b in path)), test, test == root))
    return sorted(out, key=str)


def odd_rows() -> list[tuple]:
    rows = [(i, f"Text {i} with Capitals" if i % 5 else f"text {i}", ("en", "de", None, "", "é")[i * i % 7 % 5], "src" if i % 4 else None, i, 1, "x", None) for i in range(300)]
    rows += [(i, "plain", "zz", "s", 1, 1, "x", None) for i in range(73)] + [(900, "One Only", "single", "s", None, 1, "x", None)]
    rows += [(None, "no id A", "en", "s", 1, 1, "x", None), (None, None, "en", None, None, 1, "x", None), (5, "", "en", "s", 0, 1, "x", None)]
    return rows + [rows[3], rows[3], rows[-1], (7, "Other Text", "de", "s", 2, 1, "x", None), (77, "É" + "Long " * 50_000, "fr", "s", 2, 1, "x", None)]


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    rows = odd_rows()
    for parts, at in ((1, "a"), (7, "b")):
        (tmp_path / at).mkdir()
        spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{tmp_path / at}/documents.parquet")
        got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path / at)).collect()]
        assert sorted(got, key=str) == whole(rows)


def test_manifest_of_few(spark, tmp_path):
    for i, rows in enumerate([[], [(1, "A", "en", None, 1, 1, "x", None)], [(1, "A", None, None, 1, 1, "x", None), (1, "A", "en", None, 1, 1, "x", None)]]):
        (tmp_path / str(i)).mkdir()
        write(spark, tmp_path / str(i), "documents", rows, SCHEMA)
        got = sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path / str(i))).collect()), key=str)
        assert got == (whole(rows) if rows else [])


def test_witnesses_grow_with_each_completion():
    frontier = merkle.Frontier(2)
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(17)]
    for i, d in enumerate(digests):
        frontier.append(d)
        assert len(frontier.witness[0]) == 32 * 7 * (i >= 7), "partial until the first run is complete"
    root = frontier.close()
    assert [len(w) // 32 for w in frontier.witness] == [7 + 2] * 16 + [0 + 2]
    for i, d in enumerate(digests):
        assert merkle.fold(d, bytes(frontier.witness[i]), [(i, 17)]) == root
        assert merkle.fold(d[::-1], bytes(frontier.witness[i]), [(i, 17)]) != root


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text) -> list[str]:
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    df: dict = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in set(items):
        scores = []
        for i, t in held:
            m, score = 25 + (75 * len(t) * n_docs) // length, 0
            tf = {x: t.count(x) for x in set(terms(text)) & set(t)}
            for x in terms(text):
                if x in tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:10])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("most_docs", "a_bundle", "owners"), [(4096, 256, 4), (7, 3, 3), (1, 1, 1)])
def test_search(spark, most_docs, a_bundle, owners):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["the", "of", "And", "Ünder", "x1", *(f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(6))]) for _ in range(r.randint(1, 60)))) for i in range(160)]
    docs += [(500, None), (501, ""), (502, "!!! ..."), (503, "ÜNDER ünder"), (None, docs[4][1]), (None, None), docs[9], docs[9], (504, "w1-w2_w3 " * 3000), (11, "the the")]
    items = [(i, " ".join(r.choice(docs[:160])[1].split()[:25])) for i in range(20)] + [(90, None), (91, ""), (92, "zzz"), (93, "the the THE of"), (None, "w1 w2"), (94, "w1"), (94, "w2"), (93, "the the THE of")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score long").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    got = ranked_search.search(frame, asked, most_docs=most_docs, items_a_bundle=a_bundle, owners=owners).select("item_id", "rank", "doc_id", "score")
    assert sorted((tuple(x) for x in got.collect()), key=str) == ranked(docs, items)


def test_search_of_nothing(spark, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    some, docs = spark.createDataFrame([(1, "a b")], "item_id long, text string"), spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert ranked_search.search(nothing, some).collect() == [] == ranked_search.search(docs, none).collect()
    assert [tuple(x) for x in ranked_search.search(docs, some).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


BAD = ["blorkface", "snizzle", "grumpod", "vexwad"]


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    at, r = tmp_path_factory.mktemp("toxic"), random.Random(1)
    rows, labels = [], []
    for i in range(1200):
        words = prose(i, 30 + i % 90).split()
        if toxic := i % 4 == 0:
            for _ in range(max(2, len(words) // 20)):
                words.insert(r.randrange(len(words)), r.choice(BAD).upper() if i % 8 else r.choice(BAD))
        rows.append((i, " ".join(words), "en", "s", 1, 1, "x", None))
        if i % 3:
            labels.append((i, 0, int(toxic), 0.5))
    rows += [(5000, None, None, None, None, 1, "x", None), (5001, "", None, None, None, 1, "x", None), (5002, "?!", None, None, None, 1, "x", None), (5003, "word " * 60_000, None, None, None, 1, "x", None), (None, rows[4][1], None, None, None, 1, "x", None), rows[4]]
    labels += [(5000, None, None, 1.0), (None, 0, 1, 1.0), (1, 0, 0, 1.0)]
    write(spark, at, "documents", rows, SCHEMA)
    write(spark, at, "labels", labels, "doc_id long, quality int, toxic int, score double")
    return str(at), rows


def test_toxicity(spark, judged):
    at, rows = judged
    got = [r.asDict() for r in toxicity.op12_toxicity(spark, at).collect()]
    assert len(got) == len(rows)
    assert all(g["held_out"] == (g["doc_id"] is not None and zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0) and 0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got)
    right = [g["predicted"] == (g["doc_id"] % 4 == 0) for g in got if g["doc_id"] is not None and g["doc_id"] < 5000 and g["held_out"]]
    assert sum(right) >= 0.97 * len(right) > 200
    odd = {g["doc_id"]: g for g in got}
    assert odd[5000]["score"] == odd[5001]["score"] == odd[5002]["score"] < 0.5 and odd[5003]["predicted"] == 0 and odd[5003]["n_windows"] == 60_000
    assert len({g["score"] for g in got if g["doc_id"] in (4, None)}) == 1


def test_toxicity_learns_from_trainable_rows_alone(spark, judged, tmp_path):
    """Labels of held-out rows and other columns don't change a score."""
    at, _ = judged
    first = sorted((tuple(r) for r in toxicity.op12_toxicity(spark, at).collect()), key=str)
    docs = spark.read.parquet(f"{at}/documents.parquet").selectExpr("doc_id", "text", "'q' as lang", "'z' as source", "n_chars")
    labels = spark.read.parquet(f"{at}/labels.parquet").selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted((tuple(r) for r in toxicity.op12_toxicity(spark, str(tmp_path)).collect()), key=str) == first


def test_toxicity_without_labels_of_both_kinds(spark, nothing):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0), (2, None)], 0.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["score"] for r in toxicity.score(docs, model).collect()} == {want}
    assert toxicity.score(nothing, model).collect() == []
