"""Line and substring dedup and the Jaccard join against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import jaccard_join, kernels, line_dedup, substring_dedup
from tests.llm.conftest import prose


def repeated_lines(rows, least):
    """Lines in a later copy of a run of at least `least` words, by trying the shortest such runs from either end of each line."""
    first, runs = {}, []
    for key, lines in rows:
        n, size = len(lines), [line.count(" ") + 1 for line in lines]
        spans = set()
        for a in range(n):
            b = next((b for b in range(a, n) if sum(size[a : b + 1]) >= least), None)
            spans |= {(a, b + 1)} if b is not None else set()
            c = next((c for c in range(a, -1, -1) if sum(size[c : a + 1]) >= least), None)
            spans |= {(c, a + 1)} if c is not None else set()
        for a, b in spans:
            run = tuple(line.rstrip(" ") for line in lines[a:b])
            runs.append((key, a, b, run))
            first[run] = min(first.get(run, (key, a)), (key, a))
    out = defaultdict(set)
    for key, a, b, run in runs:
        if first[run] < (key, a):
            out[key].update(range(a, b))
    return out


def test_lines(spark, docs):
    from pyspark.sql import functions as F

    from gridloom.llm import util

    keyed = docs.where("text is not null").select(*util.key_of(F.col("doc_id"), F.col("text")), "text").distinct().collect()
    want = repeated_lines([((r["d"], r["th"]), r["text"].split("\n")) for r in keyed], 50)
    got = {}
    for r in line_dedup.copies(docs).collect():
        got[r["d"], r["th"]] = {i for a, b in line_dedup.merged(r["spans"]) for i in range(a, b)}
    assert got == want and len(got) > 8
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "removed_lines"] and out.count() == docs.count()
    kept = {r["doc_id"]: r["text"] for r in out.where("doc_id in (20, 300, 304, 501, 506, 100, 101)").collect()}
    assert kept[300] == kept[304] == "" and kept[20] and kept[501] is None  # of equal texts the least id's stays
    assert kept[506].count("same line here") < 60 and len(kept[101]) < len(kept[100])


def test_lines_of_nothing(nothing):
    assert line_dedup.dedup(nothing).count() == 0


def test_files_of_lines(spark, folder, tmp_path, monkeypatch):
    """Rounds and results are written to files by size, not by shuffle partitions: each file has an executor start children, which show the JVM's memory once more."""
    from gridloom.llm import util

    settings = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    rounds, stash = [], util.stash
    monkeypatch.setattr(util, "stash", lambda *a, **b: (out := stash(*a, **b), rounds.append(len(out.inputFiles())))[0])

    def written(at):
        line_dedup.op1_line_dedup(spark, folder).write.parquet(f"{tmp_path}/{at}")
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{at}").collect()), key=str), len(list((tmp_path / at).glob("part-*")))

    want, _ = written("few")
    rounds.clear()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got, n = written("many")
        most = spark.sparkContext.defaultParallelism
        assert got == want and n <= most and len(rounds) > 2 and max(rounds[1:]) <= most, (n, rounds)
        monkeypatch.setattr(util, "A_FILE", 5)  # more rows, more files
        got, n = written("more")
        assert got == want and n > most and max(rounds) > most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def passages(texts, width=250, words=50):
    """How many maximal runs of bytes under windows that occur twice have so many words."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        runs = []
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + width
                else:
                    runs.append([i, i + width])
        out.append(sum(len(r[a:b].split()) >= words for a, b in runs))
    return out


def covered(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        hit = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                hit[i : i + width] = True
        kept = bytes(b for b, h in zip(r, hit) if not h)
        out.append((len(r), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(spark, docs, folder):
    rows = docs.select("doc_id", "text").collect()
    texts = [r["text"] for r in rows]
    want = Counter((r["doc_id"], *w, n, n > 0) for r, w, n in zip(rows, covered(texts, 400), passages(texts)))
    got = Counter(map(tuple, substring_dedup.op9_substring_dedup(spark, folder).collect()))
    assert got == want and sum(n * (k[2] > 0) for k, n in got.items()) > 15


@pytest.mark.parametrize(("most", "split"), [(1, 1), (3, 2), (1000, 1)])
def test_substrings_of_anchors_with_many_contexts(docs, most, split):
    rows = docs.select("doc_id", "text").collect()
    found = substring_dedup.removed(docs, width=120, least=80, gram=30, most=most, split=split).collect()
    for width in (120, 80):
        want = sorted(w[:2] for w in covered([r["text"] for r in rows], width))
        size = [len((r["text"] or "").encode()) for r in found]
        assert sorted((n, sum(b - a for a, b in substring_dedup.union_of(r["starts"], r["ends"], np.array(r["sizes"] or []), n, width))) for r, n in zip(found, size)) == want


def test_substrings_of_periodic_text(spark):
    """Contexts of one document that repeat at every step are one row, however long it is."""
    rows = [(1, "abcdefghij klmno. " * 3000), (2, "x" * 5000), (3, "y" * 120), (4, "0123456789" * 30 + "k" * 130)]
    found = substring_dedup.anchors([t.encode() for _, t in rows], 400, 250, 50)
    assert len(found["doc"]) < 40
    got = {r["doc_id"]: substring_dedup.union_of(r["starts"], r["ends"], np.array(r["sizes"] or []), len(r["text"]), 400) for r in substring_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(0, 54000)], 2: [(0, 5000)], 3: [], 4: []}


@pytest.mark.parametrize("parts", [1, 5, 200])
def test_substrings_end_with_their_document(spark, tmp_path, parts):
    """Texts that end and begin with periodic stretches, several of them in one batch or each in its own, against all windows."""
    import random

    r = random.Random(8)
    rows = [(0, prose(50, 20) + "-" * 900), (1, "=" * 900 + prose(51, 20)), (2, "=" * 399), (3, "-" * 401 + "x"), (4, "." * 401), (5, "." * 700 + "-" * 700)]
    for i in range(60):
        ends = [r.choice("-=.#*") * r.randint(0, 700) if r.random() < 0.8 else r.choice(["ab", "=-", "xyz "]) * r.randint(1, 300) for _ in range(2)]
        rows.append((10 + i, ends[0] + prose(60 + i, r.randint(0, 12)) + ends[1]))
    at = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(parts, "doc_id").write.parquet(str(at))
    got = sorted(tuple(x)[:5] for x in substring_dedup.op9_substring_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, covered([t for _, t in rows], 400)))


def test_runs_of_many_small_texts():
    """The windows that are repeats by themselves, of lists of short texts, against each window held against the one a period on."""
    import random

    r = random.Random(9)
    for _ in range(60):
        raw = [(r.choice("ab") * r.randint(0, 90) + "".join(r.choice("abc") for _ in range(r.randint(0, 30))) + r.choice("ab") * r.randint(0, 90)).encode() for _ in range(5)]
        found = substring_dedup.anchors(raw, 40, 25, 5)
        for doc, first, last, n, size in zip(*(found[k].tolist() for k in ("doc", "first", "last", "n", "c"))):
            if n == 0:
                assert 0 <= first < last <= len(raw[doc])
                seen = Counter(raw[doc][i : i + size] for i in range(len(raw[doc]) - size + 1))
                assert all(any(seen[raw[doc][i : i + size]] > 1 for i in range(max(first, x - size + 1), min(x, last - size) + 1)) for x in range(first, last))


def test_substrings_in_junk(spark):
    """Words said over and over, in stretches of every length, with the same and with other texts about them, against brute force."""
    import random

    r = random.Random(6)
    rows = []
    for i in range(90):
        parts = []
        for _ in range(r.randint(1, 6)):
            word = r.choice(["de ", "a ", "on and ", "xyzzy, said he. "])
            parts += [prose(r.randint(0, 3), r.randint(1, 30)), word * r.randint(1, 260 // len(word) + 20)]
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = dict(rows)
    for least, gram in ((80, 30), (120, 20)):
        found = substring_dedup.removed(df, width=120, least=least, gram=gram, split=4).collect()
        for width in {least, 120}:
            want = sorted(w[:2] for w in covered(texts.values(), width))
            assert sorted((len(r["text"]), sum(b - a for a, b in substring_dedup.union_of(r["starts"], r["ends"], np.array(r["sizes"] or []), len(r["text"]), width))) for r in found) == want


def test_intervals():
    assert {x for x in substring_dedup.intervals([0, 3, 3, 1, 2]) if x[0]} == {(1, 0, 4), (2, 3, 4), (3, 0, 2)}
    assert substring_dedup.common(b"abcd", b"abxd") == 2 and substring_dedup.common(b"", b"a") == 0 and substring_dedup.common(b"ab", b"abc") == 2


def similar(sets):
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j], assume_unique=True))
            if both and both >= 0.8 * (len(a) + len(sets[j]) - both):
                links[i].add(j)
                links[j].add(i)
    return links


def test_jaccard(docs):
    rows = docs.select("doc_id", "text").where("doc_id is not null and doc_id not in (5, 7)").collect()
    rows = list({r["doc_id"]: r for r in rows}.values())
    spark = docs.sparkSession
    links = similar(jaccard_join.sets([r["text"] or "" for r in rows]))
    part = {i: i for i in range(len(rows))}
    for _ in rows:
        part = {i: min([part[i], *(part[j] for j in links[i])], key=lambda k: rows[k]["doc_id"]) for i in part}
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(3)
    got = {r["d"]: (r["class_id"], r["n_links"]) for r in jaccard_join.classes(df).collect()}
    want = {r["doc_id"]: (rows[part[i]]["doc_id"], len(links[i])) for i, r in enumerate(rows) if len(jaccard_join.sets([r["text"] or ""])[0])}
    assert got == want and got[504] == (503, 1) and got[407][0] == got[400][0]


def test_jaccard_in_blocks(spark, monkeypatch):
    """A class larger than a block is solved by pairs of blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: 3 * i], f"x{i}", *base[3 * i + 1 :]])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = similar(jaccard_join.sets([t for _, t in rows]))
    got = {r["d"]: (r["class_id"], r["n_links"]) for r in jaccard_join.classes(df, most=5).collect()}
    assert got == {i: (0, len(links[i])) for i in range(30)}


def test_jaccard_of_split_buckets(spark):
    """Pairs at the threshold are found as surely where every bucket is split down to the deepest: a share of 0.037 was lost."""
    rows = []
    for i in range(800):
        own = [f"p{i}w{k}" for k in range(184)]
        rows += [(2 * i, " ".join([*own[:164], *own[164:]])), (2 * i + 1, " ".join([*own[:164], *(f"q{i}w{k}" for k in range(20))]))]
    one, other = jaccard_join.sets([t for _, t in rows[:2]])
    both = len(np.intersect1d(one, other))
    assert 0.8 <= both / (len(one) + len(other) - both) < 0.81
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["d"]: (r["class_id"], r["n_links"]) for r in jaccard_join.classes(df, most=1).collect()}
    assert sum(got[2 * i + 1] == (2 * i, 1) for i in range(800)) >= 799


def test_jaccard_stage_keeps_one_of_a_class(spark, docs, nothing):
    out = jaccard_join.stage(spark, docs, "")
    assert out.columns == docs.columns
    ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert ids[20] == 1 and not any(ids[300 + i] for i in range(5)) and ids[503] == 1 and not ids[504]
    assert ids[500] == ids[501] == ids[505] == 1 and ids[5] == 1  # a row that repeats another goes, texts without words stay
    assert jaccard_join.stage(spark, nothing, "").count() == 0


def test_words_and_shingles():
    h, at = kernels.words(["Ab c\xa0d—e", "", "«ab» C"])
    assert at.tolist() == [0, 4, 4, 6] and h[0] == h[4] and h[1] == h[5]
    s, at = kernels.shingles(["a b c d e f", "b C d, e f", "a b"])
    assert at.tolist() == [0, 2, 3, 3] and s[1] == s[2] != s[0]
