"""Benchmark items inside documents, by MinHash containment search over size partitions.

A MinHash signature estimates Jaccard similarity, which is tiny between a short item and a long
document that holds it. So items are partitioned by their number of shingles, and documents are
searched, for each partition, in windows little longer than its largest item: an item of q shingles
of which 0.8 are in a window of u has a Jaccard similarity of at least 0.8 q / (u + 0.2 q), for 17 shingles or
more at least 0.4, and one of 32 minima then agrees but for one in 10 ** 7. Shorter items, whose similarity would be less, are
looked up by their shingles instead, exactly. Windows are unions of blocks of 8 shingles, whose minima are
computed once for all partitions. Candidates are verified by exact containment: the share of
an item's distinct five-word shingles that occur anywhere in the document.

The items' minima and shingles are sent to all executors. Their size is checked against
`most_shingles`; a larger benchmark is searched in slices of that size, one pass over the documents each,
whose result is written before the next slice is fetched: the driver holds one slice at a time.

Edge cases: null or empty texts and texts of under five words hold nothing and are in nothing; equal
items are each reported; repeated documents each get their rows; a null doc_id or item_id stays null;
empty tables give no rows; other columns are ignored. `stage` keeps what holds nothing, null and empty texts
among it, with all columns, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import kernels, util

BLOCK, HASHES = 8, 32
SHORT = 16  # items of up to so many distinct shingles are looked up exactly
_SEEDS = np.random.default_rng(8).integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)


class Index:
    """Items' distinct shingles, partitioned by size, with the minima to look candidates up by."""

    def __init__(self, items: list[tuple[int | None, str]], n: int = 5):
        shingles, at = kernels.shingles([t or "" for _, t in items], n)
        sets = [(i, np.unique(shingles[a:b])) for (i, _), a, b in zip(items, at, at[1:])]
        self.ids = [i for i, s in sets if len(s)]
        self.sets = [s for _, s in sets if len(s)]
        by = defaultdict(list)
        short = []
        for k, s in enumerate(self.sets):
            if len(s) <= SHORT:
                short.append(k)
            else:
                by[self.blocks(len(s))].append(k)
        value = np.concatenate([self.sets[k] for k in short]) if short else np.empty(0, dtype=np.uint64)
        item = np.repeat(np.array(short, dtype=np.int64), [len(self.sets[k]) for k in short])
        order = np.argsort(value, kind="stable")
        self.items = item[order]  # of each distinct shingle of short items in turn
        self.values, self.first = np.unique(value[order], return_index=True)
        self.first = np.append(self.first, len(value))
        self.top = np.zeros(1 << 16, dtype=bool)
        self.top[self.values >> np.uint64(48)] = True
        self.parts = []  # blocks in a window; for each hash the items by minimum, and which top 16 bits occur
        for blocks, ks in sorted(by.items()):
            tables, tops = [], np.zeros((HASHES, 1 << 16), dtype=bool)
            for h, seed in enumerate(_SEEDS):
                table = defaultdict(list)
                for k in ks:
                    table[int((self.sets[k] * seed).min())].append(k)
                tops[h, [m >> 48 for m in table]] = True
                tables.append(dict(table))
            self.parts.append((blocks, tables, tops))

    @staticmethod
    def blocks(size: int) -> int:
        """Sizes up to 8, 16, 24, 32, 48, 64, 96, 128 ... shingles are partitions; a window has one block more."""
        b, step = -(-size // BLOCK), 1
        while b > 4 * step:
            step *= 2
        return -(-b // step) * step + 1

    def candidates(self, shingles: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) where a window over the document, or over it and its neighbours, shares a minimum with the item."""
        found: set[tuple[int, int]] = set()
        starts = np.arange(0, len(shingles), BLOCK)
        first_doc = np.searchsorted(at, starts, "right") - 1
        last_doc = np.searchsorted(at, np.append(starts[1:], len(shingles)) - 1, "right") - 1
        for h, seed in enumerate(_SEEDS):
            window, have = np.minimum.reduceat(shingles * seed, starts), 1
            for blocks, tables, tops in self.parts:
                while have < min(blocks, len(starts)):  # the least of `blocks` blocks in a row, from that of fewer
                    step = min(have, blocks - have, len(window) - 1)
                    window = np.minimum(window[:-step], window[step:])
                    have += step
                for w in np.flatnonzero(tops[h][window >> np.uint64(48)]).tolist():
                    for k in tables[h].get(int(window[w]), ()):
                        found.update((d, k) for d in range(first_doc[w], last_doc[min(w + have, len(starts)) - 1] + 1))
        return found

    def short(self, shingles: np.ndarray, at: np.ndarray, least: float) -> list[tuple[int, int, int]]:
        """(document, item, shingles shared) for items of few shingles, exactly."""
        if not len(self.values):
            return []
        place = np.flatnonzero(self.top[shingles >> np.uint64(48)])
        v = np.minimum(np.searchsorted(self.values, shingles[place]), len(self.values) - 1)
        hit = self.values[v] == shingles[place]
        d = np.searchsorted(at, place[hit], "right") - 1
        d, v = np.divmod(np.unique(d * len(self.values) + v[hit]), len(self.values))
        n = self.first[v + 1] - self.first[v]
        k = self.items[np.repeat(self.first[v] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        both, shared = np.unique(np.repeat(d, n) * len(self.sets) + k, return_counts=True)
        d, k = np.divmod(both, len(self.sets))
        keep = shared >= least * np.array([len(s) for s in self.sets])[k] - 1e-9
        return list(zip(d[keep].tolist(), k[keep].tolist(), shared[keep].tolist()))

    def search(self, shingles: np.ndarray, at: np.ndarray, least: float) -> list[tuple[int, int | None, float, int]]:
        """(document, item, containment, shingles shared) for documents whose shingles begin at `at`."""
        if not len(shingles) or not self.sets:
            return []
        out = [(d, self.ids[k], shared / len(self.sets[k]), shared) for d, k, shared in self.short(shingles, at, least)]
        for d, k in sorted(self.candidates(shingles, at)):
            shared = int(np.isin(self.sets[k], shingles[at[d] : at[d + 1]]).sum())
            if shared >= least * len(self.sets[k]) - 1e-9:
                out.append((d, self.ids[k], shared / len(self.sets[k]), shared))
        return out


def contained(docs: DataFrame, items: DataFrame, least: float = 0.8, most_shingles: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, containment, n_shared) of each item of which `least` of the shingles are in a document."""
    return _contained(docs.select("doc_id", "text"), items, ["doc_id"], least, most_shingles)


def _contained(docs: DataFrame, items: DataFrame, keys: list[str], least: float = 0.8, most_shingles: int = 2_000_000) -> DataFrame:
    """The same, by any long columns of a document."""

    def slices():
        part, size = [], 0
        for r in items.select("item_id", "text").toLocalIterator():
            part.append((r["item_id"], r["text"]))
            size += len(r["text"] or "") // 2
            if size > most_shingles:
                yield part
                part, size = [], 0
        yield part

    def search_in(items):
        def run(batches):
            index = Index(items)
            for pdf in batches:
                rows = []
                ids = list(zip(*(pdf[k].astype("Int64").tolist() for k in keys)))
                for first, texts in kernels.chunks(pdf["text"]):
                    rows += [(*ids[first + d], *x) for d, *x in index.search(*kernels.shingles(texts), least)]
                out = pd.DataFrame(rows, columns=[*keys, "item_id", "containment", "n_shared"])
                yield out.astype({k: "Int64" for k in keys} | {"item_id": "Int64", "containment": float, "n_shared": "int64"})

        return docs.mapInPandas(run, ", ".join(f"{k} long" for k in keys) + ", item_id long, containment double, n_shared long")

    todo, done = slices(), []
    part = next(todo)
    for after in todo:
        done.append(util.stash(search_in(part)))
        part = after
    return reduce(DataFrame.unionAll, [*done, search_in(part)])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(util.table(spark, sf_dir, "documents"), util.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    d_, th_ = util.free(docs.columns, "held_d", "held_th")
    d, th = util.key_of(F.col("doc_id"), F.col("text"))
    held = _contained(docs.select(d.alias(d_), th.alias(th_), "text"), util.table(spark, sf_dir, "benchmark"), [d_, th_]).select(d_, th_).distinct()
    return docs.join(held, (d == F.col(d_)) & (th == F.col(th_)), "left_anti").select(*util.named(docs.columns))


SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: list_aggregate(w[i : i + 4], 'string_agg', ' '))) AS s FROM w
), n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) / any_value(n.n) AS containment, count(*) AS n_shared
FROM s AS b JOIN s AS d ON b.s = d.s AND b.kind = 'b' AND d.kind = 'd' JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n.n)
"""
