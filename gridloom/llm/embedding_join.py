"""Near-duplicate vectors by randomised-rotation binary codes (RaBitQ: Gao and Long, 2024).

Only vectors of one label and length are compared. Equal vectors are one vector, with its number of
rows. A unit vector is rotated at random; its code is the signs, stored with the correction
factor <code, vector>. For another vector q the estimate <code, q> / factor of the cosine is unbiased,
with a confidence bound from the factor; pairs whose upper bound is below the threshold are dropped and
all others are computed exactly, in double precision.

Pairs come from buckets of vectors that agree in the first k signs of further rotations, k growing
with the logarithm of a label's vectors, in so many tables that a pair at the threshold meets in one
with probability `recall`; a label of few vectors is one bucket, compared whole. A pair counts in
the first table where it meets. Large buckets are solved by pairs of blocks; links are counted where they
are found and never emitted. Only ids and keys take part in dealing the buckets out; vector, code and
factor move once for each block pair, and vectors alone in a bucket not at all.

Edge cases: null, empty or zero vectors, those with null or non-finite components and those of null
label are linked with nothing; a null vec_id is stood in for by a negative number made from the
vector in component_id, and kept is then null; rows that repeat an id share its component; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import kernels, util

BLOCK = 2048
MOST_BITS = 40
MOST_LABELS = 10_000  # whose sizes are sent out
EPSILON = 4.5  # of the confidence bound: a pair is wrongly dropped about once in 10 ** 5


def rotation(seed: int, size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([6, seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def agreement(cosine: float) -> float:
    """How often one sign of a random rotation agrees."""
    return 1 - math.acos(cosine) / math.pi


class Signs:
    """The first `bits` signs of each table's rotations, as a number."""

    def __init__(self):
        self.planes: dict[tuple[int, int], np.ndarray] = {}

    def of(self, unit: np.ndarray, table: int, bits: int) -> np.ndarray:
        size = unit.shape[1]
        out = np.zeros(len(unit), dtype=np.int64)
        for i in range(bits):
            part, row = divmod(i, size)
            at = (table * MOST_BITS + part, size)
            if at not in self.planes:
                self.planes[at] = rotation(*at)
            out = (out << 1) | (unit @ self.planes[at][row] > 0)
        return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that makes its largest component about 1: no square overflows or vanishes, and no cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit_of(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs after the rotation as -1 and 1, correction factors)."""
    turned = unit @ rotation(0, unit.shape[1]).T
    code = np.where(turned > 0, 1.0, -1.0)
    return code, np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def upper_bounds(turned: np.ndarray, code: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Of the cosine of each rotated unit vector to each coded one."""
    size = code.shape[1]
    estimate = (turned @ code.T) / (math.sqrt(size) * factor[None])
    return estimate + EPSILON * np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * max(size - 1, 1)))[None] + 1e-9


def linked(x: np.ndarray, code: np.ndarray, factor: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the exact cosine of each x[left] and x[right] reaches `cosine`, computed where the bound doesn't rule it out."""
    x = scaled(x)
    norm = np.sqrt((x * x).sum(axis=1))
    turned = (x[left] / norm[left][:, None]) @ rotation(0, x.shape[1]).T
    a, b = np.nonzero(upper_bounds(turned, code[right], factor[right]) >= cosine)
    out = np.zeros((len(left), len(right)), dtype=bool)
    for s in range(0, len(a), 1 << 16):
        i, j = left[a[s : s + (1 << 16)]], right[b[s : s + (1 << 16)]]
        out[a[s : s + (1 << 16)], b[s : s + (1 << 16)]] = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= cosine
    return out


def classes(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.9999, bucket: int = 1024) -> DataFrame:
    """(v, label, embedding, n_links, component_id) of each distinct vector that can be linked, v the least id of its rows."""
    ok = vectors.where("label is not null and embedding is not null and size(embedding) > 0").where(
        F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("embedding", lambda c: c != 0)
    )
    own = F.coalesce(F.col("vec_id").cast("long"), -F.pmod(F.xxhash64("label", "embedding"), F.lit(2**62)) - 1)
    each = util.stash(ok.groupBy("label", "embedding").agg(F.min(own).alias("v"), F.count(F.lit(1)).alias("copies")))
    n = each.groupBy("label", F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / bucket)))).cast("int")
    tables = F.when(F.col("bits") == 0, 1).otherwise(F.ceil(F.lit(math.log(1 - recall)) / F.log(1 - F.pow(F.lit(agreement(cosine)), "bits")))).cast("int")
    n = util.stash(n.withColumn("bits", bits).withColumn("tables", tables).select("label", "size", "bits", "tables"))
    few = n.limit(MOST_LABELS + 1).count() <= MOST_LABELS  # then no label is one task's

    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    exact = np.float32 if kind == "float" else np.float64  # components travel as they are given

    def sketch(batches):
        signs = Signs()
        for pdf in batches:
            out = []
            for (size, k, t), g in pdf.groupby([pdf["embedding"].map(len), "bits", "tables"]):
                x = np.array(g["embedding"].tolist(), dtype=np.float64)
                unit = unit_of(x)
                code, factor = encode(unit)
                keys = np.stack([signs.of(unit, i, k) for i in range(t)], axis=1)
                out.append(pd.DataFrame({
                    "label": g["label"], "size": size, "v": g["v"], "copies": g["copies"], "bits": k, "x": [r.astype(exact).tobytes() for r in x],
                    "code": [r.tobytes() for r in np.packbits(code > 0, axis=1)], "factor": factor, "keys": list(keys),
                }))
            if out:
                yield pd.concat(out)

    label = vectors.schema["label"].dataType.simpleString()
    schema = f"label {label}, size int, v long, copies long, bits int, x binary, code binary, factor double, keys array<long>"
    coded = util.stash(each.withColumn("size", F.size("embedding")).join(F.broadcast(n) if few else n.hint("rebalance"), ["label", "size"]).drop("size").mapInPandas(sketch, schema))
    bucket_of = ["label", "size", "t", "key"]
    keyed = coded.select("label", "size", "v", F.posexplode("keys").alias("t", "key"))
    blocks = keyed.groupBy(*bucket_of).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = blocks.select(*bucket_of, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).hint("rebalance")
    dealt = keyed.join(blocks, bucket_of).withColumn("block", F.pmod(F.xxhash64("v", "label"), "blocks").cast("int"))
    of_vector = dealt.groupBy("label", "v").agg(F.collect_list(F.struct("t", "key", "block", "blocks")).alias("places"))  # one for each table at most
    moved = coded.drop("keys").join(of_vector, ["label", "v"]).select("*", F.explode("places").alias("p")).select("*", "p.*").drop("p", "places")
    moved = moved.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["label", "size", "t", "key", "i", "j"]
    moved = moved.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select(*group, "block", "v", "copies", "bits", "x", "code", "factor")
    moved = moved.repartition(*group).sortWithinPartitions(*group)

    def solve(batches):
        signs = Signs()
        for g in util.groups(batches, group):
            if len(g) < 2:
                continue
            size, t, i, j, bits = (int(g[c].iloc[0]) for c in ("size", "t", "i", "j", "bits"))
            x = np.frombuffer(b"".join(g["x"]), dtype=exact).reshape(len(g), size).astype(np.float64)
            bit = np.unpackbits(np.frombuffer(b"".join(g["code"]), dtype=np.uint8).reshape(len(g), -1), axis=1)[:, :size]
            block = g["block"].to_numpy()
            left = np.arange(len(g)) if i == j else np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            found = linked(x, np.where(bit, 1.0, -1.0), g["factor"].to_numpy(), left, right, cosine)
            a, b = np.nonzero(found)
            if not len(a):
                continue
            unit = unit_of(x)
            for e in range(t):  # the pair has met before
                keys = signs.of(unit, e, bits)
                met = keys[left[a]] == keys[right[b]]
                found[a[met], b[met]] = False
            yield pd.DataFrame(kernels.links_of(found, left, right, g["v"].to_numpy(), g["copies"].to_numpy(), i == j), columns=["u", "v", "links"])

    found = util.stash(moved.mapInPandas(solve, "u long, v long, links long"))
    part = util.components(found.where("u <> v").select("u", "v")).distinct().withColumnsRenamed({"id": "v", "component": "component_id"})
    links = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "v")
    of = part.join(links, "v", "full")
    return each.join(of, "v", "left").select("v", "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "v").alias("component_id"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = util.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    found = classes(vectors).select("label", "embedding", "n_links", "component_id")
    out = vectors.join(found, ["label", "embedding"], "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT l.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, l.a = component_id AS kept FROM least AS l LEFT JOIN many USING (a)
"""
