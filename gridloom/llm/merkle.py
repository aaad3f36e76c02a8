"""A Merkle manifest of a table: one digest for all rows, and for every row the siblings that prove it.

Rows are leaves, in order within trees, the languages; every `FAN` consecutive nodes, the last run fewer,
become their parent until one is left, the tree's subroot; subroots in order are the leaves of the tree above.

Witnesses are incremental. A block of FAN ** LEVELS consecutive nodes is appended in order to a frontier of
open subtrees. A node enters with an empty witness; when a run is complete, each of its nodes hands the digests
of the others to the witnesses of all leaves below it, so witnesses of open subtrees are partial and grow with each
completion. Blocks are aligned, so executors append them apart from one another: a block's root is a further node to append,
one round up, and what that round adds to the root's witness extends those of all its leaves.

Places come from a sort by ranges: rows number themselves within their partition, and the counts of partitions,
few rows for each, are summed. No tree, however large, is in one task; a task holds one block.

Edge cases: a null field is `-` and an empty one `0:`; equal ids are ordered by their leaves, null ids stand first; rows that repeat
all fields are leaves each; a null id is never tampered with; a tree of one leaf has it as its subroot and no siblings there, one tree's subroot is the root;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import util

FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def combine(digests: bytes) -> bytes:
    """The parent of these digests of 32 bytes each, which are hashed as hexadecimal text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def height(n: int, fan: int = FAN) -> int:
    """The levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


class Frontier:
    """Open subtrees of one aligned block, and the witnesses of all leaves appended so far."""

    def __init__(self, levels: int, fan: int = FAN):
        self.open: list[list[tuple[bytes, range]]] = [[] for _ in range(levels + 1)]
        self.witness: list[bytearray] = []
        self.fan = fan

    def append(self, digest: bytes) -> None:
        self.witness.append(bytearray())
        self._add(0, digest, range(len(self.witness) - 1, len(self.witness)))

    def _add(self, level: int, digest: bytes, leaves: range) -> None:
        self.open[level].append((digest, leaves))
        if level < len(self.open) - 1 and len(self.open[level]) == self.fan:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = b"".join(d for d, _ in run)
        for i, (_, leaves) in enumerate(run):
            others = digests[: 32 * i] + digests[32 * i + 32 :]
            for leaf in leaves:
                self.witness[leaf] += others
        self._add(level + 1, combine(digests), range(run[0][1].start, run[-1][1].stop))

    def close(self) -> bytes:
        """Completes the open runs, as nothing follows; the block's root."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self._complete(level)
        return self.open[-1][0][0]


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds to nodes with a column `tree` each one's place `at` within the tree by `order`, and the tree's size `n`."""
    spread = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    spread = util.stash(spread.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")))
    parts = spread.groupBy("tree", "part").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("m"))
    along = Window.partitionBy("tree").orderBy("part")
    parts = parts.select("tree", "part", (F.sum("m").over(along) - F.col("m") - F.col("first")).alias("shift"), F.sum("m").over(Window.partitionBy("tree")).alias("n"))
    return spread.join(parts, ["tree", "part"]).select(*nodes.columns, (F.col("pos") + F.col("shift")).alias("at"), "n")


def appended(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, at, n, digest) with the witness of each within its block, and the block's root."""

    def run(batches):
        for pdf in util.groups(batches, ["tree", "block"]):
            frontier = Frontier(min(LEVELS, height(int(pdf["n"].iloc[0]))))
            for digest in pdf["digest"]:
                frontier.append(digest)
            root = frontier.close()
            yield pdf.assign(witness=[bytes(w) for w in frontier.witness], root=root)

    blocks = nodes.select("tree", "at", "n", "digest", F.floor(F.col("at") / BLOCK).alias("block"))
    dealt = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    return dealt.mapInPandas(run, "tree string, at long, n long, digest binary, block long, witness binary, root binary")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """`appended` of the nodes, of the roots of their blocks, and so on until every tree has one root."""
    out = [util.stash(appended(nodes))]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        heads = out[-1].where(F.col("at") % BLOCK == 0)
        out.append(util.stash(appended(heads.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest")))))
    return out


def extended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, at, path, *) of the nodes of the first round: their witnesses, extended by those of later rounds and then by `above`, (tree, path, *)."""
    moved = [c for c in above.columns if c not in ("tree", "path")]
    path = F.concat("witness", "path").alias("path")
    up = levels[-1].select("tree", "at", "witness").join(above, "tree").select("tree", "at", path, *moved)
    for level in reversed(levels[:-1]):
        up = level.select("tree", "at", "block", "witness").join(up.withColumnRenamed("at", "block"), ["tree", "block"]).select("tree", "at", path, *moved)
    return up


def fold(digest: bytes, path: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that a leaf's digest and its siblings give; places: (place, number of leaves) in each of the trees that stand upon one another."""
    used = 0
    for at, n in places:
        while n > 1:
            first = at - at % FAN
            left, others = 32 * (at - first), 32 * (min(FAN, n - first) - 1)
            run = path[used : used + others]
            digest = combine(run[:left] + digest + run[left:])
            used, at, n = used + others, at // FAN, -(-n // FAN)
    return digest


def leaf_of(**changed: Column) -> Column:
    """The digest of a row's fields, or of what stands in their place."""
    told = [(changed.get(c, F.col(c))).cast("string") for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in told]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """For each row: doc_id, leaf, subroot, root, path (all siblings) and the places `at`, `n`, `t_at`, `t_n` of leaf and tree; with `tampered`, a digest to test or null, the column `test`."""
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of().alias("leaf"),
        (F.lit(None).cast("binary") if tampered is None else tampered).alias("test"),
    )
    leaves = util.stash(placed(util.stash(rows), ["doc_id", "leaf"]))
    levels = rounds(leaves.select("tree", "at", "n", F.col("leaf").alias("digest")))
    subroots = levels[-1].where("at = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    ordered = util.stash(placed(subroots, ["name"]))
    top = rounds(ordered.select("tree", "at", "n", "digest"))
    whole = top[-1].where("at = 0").select("tree", F.col("root").alias("whole"), F.lit(b"").alias("path"))
    above = extended(top, whole).join(ordered.drop("tree"), "at")
    above = above.select(F.col("name").alias("tree"), "path", F.col("at").alias("t_at"), F.col("n").alias("t_n"), F.col("digest").alias("subroot"), F.col("whole").alias("root"))
    paths = extended(levels, above)
    return leaves.join(paths, ["tree", "at"]).select("doc_id", "leaf", "test", "subroot", "root", "path", "at", "n", "t_at", "t_n")


def verified(found: DataFrame) -> DataFrame:
    """Folds each row's digest, or the one to test, with its siblings and compares the result with the root."""

    def run(batches):
        for pdf in batches:
            out = {"doc_id": pdf["doc_id"].astype("Int64"), **{c: [x.hex() for x in pdf[c]] for c in ("leaf", "subroot", "root")}}
            out["proof_sha256"] = [hashlib.sha256(p.hex().encode()).hexdigest() for p in pdf["path"]]
            moved = zip(*(pdf[c].tolist() for c in ("leaf", "test", "path", "at", "n", "t_at", "t_n")))
            out["folded_root"] = [fold(test or leaf, path, [(at, n), (t_at, t_n)]).hex() for leaf, test, path, at, n, t_at, t_n in moved]
            out["verified"] = [a == b for a, b in zip(out["folded_root"], out["root"])]
            yield pd.DataFrame(out)

    text = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return found.mapInPandas(run, "doc_id long, " + ", ".join(f"{c} string" for c in text) + ", verified boolean")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    test = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_of(text=lower))
    return verified(manifest(util.table(spark, sf_dir, "documents"), test))


SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, lang, sha256(concat(f, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
         sha256(concat(f, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))) AS lower,
         -- crc32 of the decimal id: each byte, then eight steps, marked -1
         coalesce(xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(s) + 1), lambda i: list_prepend(ascii(s[i])::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1])))),
                  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 3 = 0, false) AS tampered
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
               coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS f FROM documents)),
t AS (SELECT coalesce('1' || lang, '0') AS tree, 0 AS level, list(leaf ORDER BY doc_id NULLS FIRST, leaf) AS nodes FROM d GROUP BY 1
      UNION ALL
      SELECT tree, level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1 : i * 8 + 8], ''))) FROM t WHERE len(nodes) > 1),
s AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS t_at FROM t WHERE len(nodes) = 1),
u AS (SELECT 100 AS level, list(subroot ORDER BY tree) AS nodes FROM s
      UNION ALL
      SELECT level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1 : i * 8 + 8], ''))) FROM u WHERE len(nodes) > 1),
l AS MATERIALIZED (SELECT *, coalesce('1' || lang, '0') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER () AS r FROM d),
p AS (SELECT r, level, place // CAST(pow(8, level) AS BIGINT) AS k, nodes FROM l JOIN t USING (tree) WHERE len(nodes) > 1
      UNION ALL
      SELECT r, level, t_at // CAST(pow(8, level - 100) AS BIGINT), nodes FROM l JOIN s USING (tree), u WHERE len(nodes) > 1),
q AS (SELECT r, level, array_to_string(nodes[k - k % 8 + 1 : k], '') AS a, array_to_string(nodes[k + 2 : k - k % 8 + 8], '') AS b FROM p),
w AS (SELECT r, string_agg(concat(a, b), '' ORDER BY level) AS path, list(concat(a, '|', b) ORDER BY level) AS steps FROM q GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(path, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT *, list_reduce(list_prepend(CASE WHEN tampered THEN lower ELSE leaf END, coalesce(steps, [])), lambda x, e: sha256(concat(split_part(e, '|', 1), x, split_part(e, '|', 2)))) AS folded
      FROM l JOIN s USING (tree) LEFT JOIN w USING (r), (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1))
"""
