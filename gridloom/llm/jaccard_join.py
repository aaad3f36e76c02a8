"""Near-duplicate texts: a join of sets of five-word shingles by Jaccard similarity, with chosen paths.

Sets are embedded as MinHash values, of which two sets share each with the probability of their
similarity. A run splits all sets along a path of sampled values: sets that agree in the first
`DEPTH` of them share a bucket; a bucket of more than `most` sets is split on further values of the path, up
to `DEEPEST`. Runs are repeated until a pair at the threshold is found with probability
`recall` (14 runs for 0.9999 at 0.8). Splitting parts pairs, but only pairs of which both sets were in a split bucket: these
sets alone get as many further runs, over other choices of `DEEPEST` of their values, as give `recall` at that depth (see `choices_for`). Inside a small bucket all pairs are compared by all their MinHash values, and those
that may reach the threshold are joined; what shares the whole path in a larger bucket is joined to its least
member. The pairs to look at are those inside connected parts, which hold every pair so found.

Each part is then solved exactly, by block pairs of bounded size: intersections of all its sets come
from products of incidence matrices, so links are counted one by one but never emitted.
Equal sets are one set throughout, with the number of its documents.

A text of one to four words has one shingle, all its words; a text without words is linked with nothing.

Edge cases: null text counts as empty; a null id is stood in for by a negative number made from the
text; rows that repeat an id count as documents of their own in n_links and share the class;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import kernels, util

DEPTH, DEEPEST = 3, 7
BLOCK, BLOCK_SHINGLES = 500, 500_000  # sets and shingles in a block of a part, about


def runs_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth)))


def choices_for(recall: float, similarity: float, values: int) -> int:
    """How many random choices of `DEEPEST` of two sets' MinHash values it takes until one agrees in all with probability `recall`.

    Of the values k agree, binomially; a choice then agrees with the probability that all its places are among the k.
    """
    k = range(DEEPEST, values + 1)
    chance = [math.comb(values, i) * similarity**i * (1 - similarity) ** (values - i) for i in k]
    agree = [math.comb(i, DEEPEST) / math.comb(values, DEEPEST) for i in k]
    few = 1 - sum(chance)
    n = 1
    while n < 1 << 12 and few + sum(c * (1 - a) ** n for c, a in zip(chance, agree)) > 1 - recall:
        n += max(1, n // 16)
    return n


def seeds_for(runs: int) -> np.ndarray:
    return np.random.default_rng(4).integers(1, 2**63, runs * DEEPEST, dtype=np.uint64) | np.uint64(1)


def sets(texts: list[str], n: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    hashes, first = kernels.words(texts)
    shingles, at = kernels.shingles(texts, n)
    out = []
    for i in range(len(texts)):
        if at[i + 1] > at[i]:
            out.append(np.unique(shingles[at[i] : at[i + 1]]))
        elif first[i + 1] > first[i]:
            own = hashes[first[i] : first[i + 1]]
            up, _ = kernels.powers(kernels.BASE2, 8)
            out.append(kernels.mix(np.array([(own * up[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))])))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def sketches(docs: DataFrame, runs: int) -> DataFrame:
    """(d, th, n, h1, h2, paths array<array<long>>, sketch): the set's size and digest, a bucket for each run and depth, and 16 bits of each MinHash value."""
    depths = DEEPEST - DEPTH + 1
    seeds = seeds_for(runs)
    schema = "d long, th long, n long, h1 long, h2 long, paths array<array<long>>, sketch binary"

    def run(batches):
        for pdf in batches:
            for first, texts in kernels.chunks(pdf["text"]):
                each = sets(texts)
                size = np.array([len(s) for s in each])
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                data = np.concatenate([each[i] for i in full])
                at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                h1 = np.add.reduceat(kernels.mix(data), at)
                h2 = np.add.reduceat(kernels.mix(data ^ np.uint64(0x5851F42D4C957F2D)), at)
                least = [np.minimum.reduceat(data * s, at) for s in seeds]
                sketch = (kernels.mix(np.stack(least, axis=1)) >> np.uint64(48)).astype(np.uint16)
                paths = np.zeros((len(full), runs, depths), dtype=np.int64)
                for r in range(runs):
                    key = np.full(len(full), r + 1, dtype=np.uint64)
                    for depth in range(DEEPEST):
                        key = kernels.mix(key * np.uint64(kernels.BASE) + kernels.mix(least[r * DEEPEST + depth]))
                        if depth >= DEPTH - 1:
                            paths[:, r, depth - DEPTH + 1] = key.view(np.int64)
                part = pdf.iloc[first : first + len(texts)].iloc[full]
                yield pd.DataFrame({"d": part["d"].to_numpy(), "th": part["th"].to_numpy(), "n": size[full], "h1": _signed(h1), "h2": _signed(h2), "paths": [list(p) for p in paths], "sketch": [r.tobytes() for r in sketch]})

    return docs.select(*util.key_of(F.col("doc_id"), F.col("text")), "text").mapInPandas(run, schema)


def deep_keys(nodes: DataFrame, values: int, choices: int) -> DataFrame:
    """(d, key): a bucket for each of so many choices of `DEEPEST` of the values in the sketches of nodes (d, sketch)."""
    rng = np.random.default_rng(44)
    places = np.stack([rng.choice(values, DEEPEST, replace=False) for _ in range(choices)])

    def run(batches):
        for pdf in batches:
            for first in range(0, len(pdf), 1000):
                part = pdf.iloc[first : first + 1000]
                sketch = np.frombuffer(b"".join(part["sketch"]), dtype=np.uint16).reshape(len(part), -1).astype(np.uint64)
                key = np.tile(np.arange(1, choices + 1, dtype=np.uint64), (len(part), 1))
                for i in range(DEEPEST):
                    key = kernels.mix(key * np.uint64(kernels.BASE) + sketch[:, places[:, i]])
                yield pd.DataFrame({"d": np.repeat(part["d"].to_numpy(), choices), "key": _signed(key).ravel()})

    return nodes.mapInPandas(run, "d long, key long")


def _bucket_edges(nodes: DataFrame, most: int, similarity: float, recall: float, runs: int) -> DataFrame:
    """(u, v): members of each small bucket that may be similar, and of each bucket that stays large and its least member."""
    hashes = runs * DEEPEST
    least = similarity - 4.5 * math.sqrt(similarity * (1 - similarity) / hashes)  # a pair at the threshold is below it about three times in 10 ** 6

    def compare(batches):
        at, rows = None, []

        def done():
            ids = np.array([r[0] for r in rows])
            sketch = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint16).reshape(len(rows), -1)
            alike = np.stack([(sketch == one).mean(axis=1) >= least for one in sketch])
            found = kernels.links_of(alike, np.arange(len(ids)), np.arange(len(ids)), ids, np.ones(len(ids), dtype=np.int64), True)
            return [(u, v) for u, v, _ in found if u != v]

        for pdf in batches:
            out = []
            for key, d, sketch in zip(pdf["key"], pdf["d"], pdf["sketch"]):
                if key != at:
                    out += done() if len(rows) > 1 else []
                    at, rows = key, []
                rows.append((d, sketch))
            yield pd.DataFrame(out, columns=["u", "v"])
        if len(rows) > 1:
            yield pd.DataFrame(done(), columns=["u", "v"])

    at, small, edges, split = nodes.select("d", F.explode("paths").alias("path")), None, None, None
    for depth in range(DEEPEST - DEPTH + 1):
        key = F.col("path")[depth].alias("key")
        size = at.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min("d").alias("v")).where("size > 1").hint("rebalance")
        both = at.withColumn("key", F.col("path")[depth]).join(size, "key")
        new = both.where(f"size <= {most}").select("d", "key")
        small = new if small is None else small.unionAll(new)
        if depth == DEEPEST - DEPTH:
            edges = both.where(f"size > {most} and d <> v").select(F.col("d").alias("u"), "v")
        else:
            at = util.stash(both.where(f"size > {most}").select("d", "path"))
            if at.isEmpty():
                break
            split = at if split is None else split
    if split is not None:
        hot = nodes.select("d", "sketch").join(split.select("d").distinct(), "d", "left_semi").dropDuplicates(["d"])  # rows that repeat an id and text hold one set
        deep = util.stash(deep_keys(hot, hashes, choices_for(recall, similarity, hashes)))
        size = deep.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("d").alias("v")).where("size > 1").hint("rebalance")
        both = deep.join(size, "key")
        small = small.unionAll(both.where(f"size <= {most}").select("d", "key"))
        large = both.where(f"size > {most} and d <> v").select(F.col("d").alias("u"), "v")
        edges = large if edges is None else edges.unionAll(large)
    dealt = small.join(nodes.select("d", "sketch").dropDuplicates(["d"]), "d").repartition("key").sortWithinPartitions("key")
    found = dealt.select("key", "d", "sketch").mapInPandas(compare, "u long, v long")
    return found if edges is None else found.unionAll(edges)


def links_within(ids: np.ndarray, count: np.ndarray, block: np.ndarray, each: list[np.ndarray], least: float, same: bool) -> list[tuple[int, int, int]]:
    """(id, least id linked through this block pair, linked documents) of the sets that have a link."""
    left = np.arange(len(ids)) if same else np.flatnonzero(block == block.min())
    right = left if same else np.flatnonzero(block != block.min())
    size = np.array([len(s) for s in each], dtype=np.float64)
    inter = np.zeros((len(left), len(right)), dtype=np.float64)
    data = np.concatenate(each)
    value, column, seen = np.unique(data, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(each)), size.astype(np.int64))
    many = np.flatnonzero(seen > 1)
    new = np.full(len(value), -1, dtype=np.int64)
    new[many] = np.arange(len(many))
    column = new[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for c0 in range(0, len(many), 4096):
        a, b = np.searchsorted(column, [c0, c0 + 4096])
        m = np.zeros((len(ids), min(4096, len(many) - c0)), dtype=np.float32)
        m[row[a:b], column[a:b] - c0] = 1
        inter += m[left] @ m[right].T
    linked = inter >= least * (size[left][:, None] + size[right][None] - inter) - 1e-9
    return kernels.links_of(linked, left, right, ids, count, same)


def classes(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9999, most: int = 60) -> DataFrame:
    """(d, th, class_id, n_links) of each document with words, by key; the class is named by its least id."""
    runs = runs_for(recall, similarity)
    own = util.stash(sketches(docs, runs))
    of_set = own.groupBy("h1", "h2", "n").agg(F.min("d").alias("m"), F.count(F.lit(1)).alias("copies")).hint("rebalance")  # dealt anew, so that the join can split a hot set
    member = util.stash(own.select("d", "th", "n", "h1", "h2").join(of_set, ["h1", "h2", "n"]).select("d", "th", "m", "copies", "n"))
    nodes = own.select("d", "th", "paths", "sketch").join(member.where("d = m").select("d", "th").distinct(), ["d", "th"], "left_semi")

    part = util.stash(util.components(_bucket_edges(nodes, most, similarity, recall, runs)).withColumnsRenamed({"id": "d", "component": "part"}).distinct())
    sized = util.stash(member.where("d = m").distinct().join(part, "d").select("d", "th", "copies", "n", "part"))
    blocks = sized.groupBy("part").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    todo = sized.join(blocks.hint("rebalance"), "part").select("d", "th", "copies", "part", "blocks")
    key_d, key_th = util.key_of(F.col("doc_id"), F.col("text"))
    texts = docs.select(key_d.alias("d"), key_th.alias("th"), "text").join(todo.hint("merge"), ["d", "th"])  # the same way at every size

    def shingled(batches):
        for pdf in batches:
            for first, part_ in kernels.chunks(pdf["text"]):
                out = pdf.iloc[first : first + len(part_)].drop(columns="text")
                yield out.assign(shingles=[s.tobytes() for s in sets(part_)])

    bags = texts.mapInPandas(shingled, "d long, th long, copies long, part long, blocks int, shingles binary")
    b = F.pmod(F.xxhash64("d"), "blocks").cast("int")
    pairs = bags.withColumn("block", b).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = pairs.select("part", "i", "j", "block", "d", "copies", "shingles").repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")

    def solve(batches):
        at, rows = None, []

        def done():
            rows_ = list({r[1]: r for r in rows}.values())  # rows that repeat an id and text hold one set
            if len(rows_) < 2:
                return pd.DataFrame(columns=["u", "v", "links"])
            block, ids, count, bags_ = zip(*rows_)
            each = [np.frombuffer(x, dtype=np.uint64) for x in bags_]
            found = links_within(np.array(ids), np.array(count), np.array(block), each, similarity, at[1] == at[2])
            return pd.DataFrame(found, columns=["u", "v", "links"])

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (key := (r.part, r.i, r.j)) != at:
                    if at is not None:
                        yield done()
                    at, rows = key, []
                rows.append((r.block, r.d, r.copies, r.shingles))
        if at is not None:
            yield done()

    found = util.stash(dealt.mapInPandas(solve, "u long, v long, links long"))
    group = util.components(found.where("u <> v").select("u", "v")).distinct()
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    of_node = group.withColumnsRenamed({"id": "m", "component": "class_id"}).join(links.withColumnRenamed("u", "m"), "m", "full")
    return member.join(of_node, "m", "left").select("d", "th", F.coalesce("class_id", "m").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classes(docs).distinct()
    keyed = docs.select("doc_id", *util.key_of(F.col("doc_id"), F.col("text")))
    return keyed.join(found, ["d", "th"], "left").select("doc_id", F.coalesce("class_id", "d").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that of the least id. Of rows that repeat an id and text one stays; so of null texts, by id."""
    found = util.stash(classes(docs).distinct())
    d_, th_ = util.free(docs.columns, "d", "th")
    d, th = util.key_of(F.col("doc_id"), F.col("text"))
    drop = found.where("d <> class_id").select(F.col("d").alias(d_), F.col("th").alias(th_))
    left = docs.join(drop, (d == F.col(d_)) & (th == F.col(th_)), "left_anti")
    rows = docs.select(d.alias("d"), th.alias("th")).groupBy("d", "th").count().where("count > 1")
    return (left if rows.isEmpty() else left.dropDuplicates(["doc_id", "text"])).select(*util.named(docs.columns))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [list_aggregate(w, 'string_agg', ' ')]
         ELSE list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: list_aggregate(w[i : i + 4], 'string_agg', ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.8 * (any_value(na.n) + any_value(nb.n) - count(*)) - 1e-9
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b
), least AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT l.a AS doc_id, class_id, coalesce(n_links, 0) AS n_links FROM least AS l LEFT JOIN many USING (a)
"""
