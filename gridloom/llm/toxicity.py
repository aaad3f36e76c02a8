"""Toxicity by compression distance: which of two dictionaries, of toxic or of ordinary text, makes a window of text shorter.

A window is a word (up to `LONGEST` bytes of letters and digits; a longer one is cut into several), in lower case with a space
on both sides, after `MARK`, which stands before every entry of the dictionaries too: so a window is compressed by one
match where a dictionary has its beginning, and each byte that it hasn't costs about a byte.

Learning, from labelled rows alone:
1. For every window its number of toxic and of ordinary texts is counted. Windows that toxic texts hold more often, by a
   likelihood ratio of `least_ratio`, make the toxic dictionary; the most frequent others make the ordinary one.
2. Ordinary windows that the toxic dictionary makes shorter take half of the ordinary dictionary, three times over, so that what
   is left shorter is so because of the label.
3. A text's excess is what its windows are shorter by with the toxic dictionary. A logistic curve turns number, share and size of the excess into the
   score, so that 0.5 is the calibrated threshold. It is fitted on texts that had no part in their dictionaries: each half is
   measured with the other's; in the end the dictionaries are learned from both.

The sample has at most about `per_class` labelled rows of each class, picked by a hash of the row; the dictionaries have `SIZE` bytes at most. Nothing else
is bounded: every window of every text is measured.

Edge cases: a null or empty text has no windows and the score of the curve for none; null labels and null ids are not learned, and a null id isn't held
out; rows that repeat an id with other labels count for each; without labels of both kinds every score is 1 where all labels are toxic, else 0;
repeated rows get the same score; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import kernels, util

MARK = bytes(range(1, 13))
LONGEST = 40
SIZE = 1 << 16
ENTRIES = SIZE // len(MARK)
LEVEL, MIN_MATCH = 13, 4
SHORTER = 2  # bytes from which a window counts
KNOWN = 500_000  # windows that a task remembers
_WORD = re.compile(rb"[a-z0-9\x80-\xff]{1,%d}" % LONGEST)


def windows(text: str) -> list[bytes]:
    return _WORD.findall(kernels.utf8(text.lower()))


def dictionary(words: list[bytes], size: int = SIZE) -> bytes:
    """As many of the words as fit, the first ones last, where they cost least."""
    entries, used = [], 0
    for w in words:
        used += len(MARK) + len(w) + 2
        if used > size:
            break
        entries.append(MARK + b" " + w + b" ")
    return b"".join(reversed(entries)) + MARK


class Measure:
    """How many bytes shorter each window is with the toxic dictionary than with the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.both = [self.compressor(d) for d in (ordinary, toxic)]
        self.known: dict[bytes, int] = {}

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        form = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        return zstandard.ZstdCompressor(compression_params=form, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def lengths(self, found: list[bytes], compressor: zstandard.ZstdCompressor) -> np.ndarray:
        whole = [MARK + b" " + w + b" " for w in found]
        size = np.array([len(w) for w in whole], dtype="<u8")
        spans = np.stack([np.cumsum(size) - size, size], axis=1).astype("<u8").tobytes()
        done = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(b"".join(whole), spans))
        return np.fromiter((len(done[i]) for i in range(len(done))), dtype=np.int64, count=len(done))

    def __call__(self, found: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list({w for w in found if w not in self.known})
        if new:
            ordinary, toxic = (self.lengths(new, c) for c in self.both)
            self.known.update(zip(new, (ordinary - toxic).tolist()))
        return np.fromiter(map(self.known.__getitem__, found), dtype=np.int64, count=len(found))


def excess(measure: Measure, texts: list[str]) -> np.ndarray:
    """For each text: windows that are shorter, bytes that they are, the most of one, and all windows."""
    each = [windows(t) for t in texts]
    d = measure([w for ws in each for w in ws])
    row = np.repeat(np.arange(len(texts)), [len(ws) for ws in each])
    n = np.bincount(row, minlength=len(texts))
    most = np.zeros(len(texts))
    np.maximum.at(most, row, np.maximum(d, 0))
    return np.stack([np.bincount(row, d >= SHORTER, len(texts)), np.bincount(row, np.maximum(d - SHORTER + 1, 0), len(texts)), most, n], axis=1)


def features(found: np.ndarray) -> np.ndarray:
    count, bytes_, most, n = found.T
    per = 100 / np.maximum(n, 1)
    return np.stack([np.log1p(count), np.log1p(count * per), np.log1p(bytes_), np.log1p(bytes_ * per), np.minimum(most, 8), np.log1p(n), np.ones(len(n))], axis=1)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None  # of the features, None: `constant`
    constant: float = 0.0


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression by Newton's method with a small ridge on all but the last."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[-1], spread[-1] = 0, 1
    z, w = (x - mean) / spread, np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    w = w / spread
    w[-1] -= (w[:-1] * mean[:-1]).sum()
    return w


def learned(bag: DataFrame, texts: tuple[int, int], least_ratio: float, rounds: int = 3) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries from (word, n0, n1), the numbers of ordinary and toxic texts that hold each window; texts: of all."""
    n0, n1 = (float(max(n, 1)) for n in texts)
    a, b = F.col("n0"), F.col("n1")
    p = (a + b) / (n0 + n1)

    def part(x: Column, of: Column) -> Column:
        return F.when(x > 0, x * F.log(x / of)).otherwise(0.0)

    ratio = 2 * (part(b, n1 * p) + part(n1 - b, n1 * (1 - p)) + part(a, n0 * p) + part(n0 - a, n0 * (1 - p)))
    told = bag.withColumn("ratio", F.when(b / n1 > a / n0, ratio).otherwise(-ratio))
    ours = F.col("ratio") > least_ratio
    toxic = dictionary([bytes(r["word"]) for r in told.where(ours).orderBy(F.desc("ratio"), "word").limit(ENTRIES).collect()])
    common = [bytes(r["word"]) for r in told.where(~ours & (a > 0)).orderBy(F.desc("n0"), "word").limit(ENTRIES).collect()]
    hard: list[bytes] = []
    for _ in range(rounds):
        taken = set(hard)
        ordinary = dictionary(hard, SIZE // 2)[: -len(MARK)] + dictionary([w for w in common if w not in taken], SIZE // 2)

        def misled(batches, ordinary=ordinary):
            measure = Measure(ordinary, toxic)
            for pdf in batches:
                d = measure([bytes(w) for w in pdf["word"]])
                yield pdf[d >= SHORTER]

        # of windows that toxic texts hold no more often than twice as often as ordinary ones
        open_ = told.where(~ours & (a > 0) & (a / n0 >= b / n1 / 2)).select("word", "n0")
        hard += [bytes(r["word"]) for r in open_.mapInPandas(misled, "word binary, n0 long").orderBy(F.desc("n0"), "word").limit(ENTRIES // 6).collect()]
    taken = set(hard)
    return dictionary(hard, SIZE // 2)[: -len(MARK)] + dictionary([w for w in common if w not in taken], SIZE // 2), toxic


def fit(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, per_class: int = 6000, least_ratio: float = 15.0) -> Model:
    """Learns from documents (doc_id, text) with labels (doc_id, toxic) among the rows that `learnable` picks; see the module's text for the sample."""
    told = labels.where("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    told = (told if learnable is None else told.where(learnable)).distinct()

    def by_class(rows: DataFrame) -> dict[int, int]:
        return {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def sampled(rows: DataFrame, n_by: dict[int, int], column: str) -> DataFrame:
        place = F.xxhash64(column, F.lit(12)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
        return rows.where(place < F.when(F.col("toxic") == 1, per_class / max(1, n_by.get(1, 0))).otherwise(per_class / max(1, n_by.get(0, 0))))

    # The labels picked are about 2 * per_class at most, so they are sent to the texts, which aren't shuffled.
    picked = F.broadcast(sampled(told, by_class(told), "doc_id"))
    n_by = by_class(docs.select("doc_id").join(picked, "doc_id"))
    if len(n_by) < 2:
        return Model(b"", b"", None, float(n_by.get(1, 0) > 0))
    rows = docs.select("doc_id", "text").join(picked, "doc_id")
    half = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2)).cast("int")
    sample = util.stash(sampled(rows, {k: n * 0.9 for k, n in n_by.items()}, "text").select("text", "toxic", half.alias("half")))  # fewer only where many rows repeat an id

    def held(batches):
        for pdf in batches:
            for text, toxic, h in zip(pdf["text"], pdf["toxic"], pdf["half"]):
                words = list(set(windows(text if isinstance(text, str) else "")))
                yield pd.DataFrame({"word": words, "half": h, "toxic": toxic})

    counts = [F.count_if((F.col("half") == h) & (F.col("toxic") == t)).alias(f"n{t}{h}") for h in (0, 1) for t in (0, 1)]
    bags = util.stash(sample.mapInPandas(held, "word binary, half int, toxic int").groupBy("word").agg(*counts))
    texts = {(r["toxic"], r["half"]): r["n"] for r in sample.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}

    def of(*halves: int) -> tuple[bytes, bytes]:
        bag = bags.select("word", *[sum(F.col(f"n{t}{h}") for h in halves).alias(f"n{t}") for t in (0, 1)])
        return learned(bag, tuple(sum(texts.get((t, h), 0) for h in halves) for t in (0, 1)), least_ratio * len(halves))  # a ratio grows with the texts

    halves = [of(0), of(1)]

    def measured(batches):
        by = [Measure(*halves[1]), Measure(*halves[0])]
        for pdf in batches:
            for first, part in kernels.chunks(pdf["text"]):
                now = pdf.iloc[first : first + len(part)]
                for h in (0, 1):
                    at = np.flatnonzero(now["half"].to_numpy() == h)
                    if len(at):
                        yield pd.DataFrame({"toxic": now["toxic"].to_numpy()[at], "f": list(excess(by[h], [part[i] for i in at]).astype(float))})

    found = sample.mapInPandas(measured, "toxic int, f array<double>").toPandas()  # about 2 * per_class rows at most
    return Model(*of(0, 1), logistic(features(np.array(found["f"].tolist())), found["toxic"].to_numpy(dtype=float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_windows, n_shorter) of each row of docs (doc_id, text)."""

    def run(batches):
        measure = Measure(model.ordinary, model.toxic) if model.weights is not None else None
        for pdf in batches:
            for first, part in kernels.chunks(pdf["text"]):
                if measure is None:
                    p, found = np.full(len(part), model.constant), np.zeros((len(part), 4))
                else:
                    found = excess(measure, part)
                    p = 1 / (1 + np.exp(-np.clip(features(found) @ model.weights, -30, 30)))
                ids = pdf["doc_id"].iloc[first : first + len(part)].astype("Int64").to_numpy()
                yield pd.DataFrame({"doc_id": ids, "score": p, "n_windows": found[:, 3].astype(np.int64), "n_shorter": found[:, 0].astype(np.int64)}).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, n_windows long, n_shorter long")


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, util.table(spark, sf_dir, "labels"), remainder() != 0)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return score(docs, model).select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", predicted, "n_windows", "n_shorter")
