"""Language identification by error-correcting output codes.

Every learned language gets a binary codeword. For every bit, a naive Bayes classifier over hashed
byte trigrams says on which side of the bit a text stands; the codeword with the least weighted
logistic loss against all bits wins. Two codewords of nearly the same loss flag a text as ambiguous.

The classifiers are fitted on a sample of labelled rows of at most about `per_lang` rows a language
(all rows of a language that has fewer) and `most_rows` in all, picked by a hash of the row, over the
`most_langs` most frequent labels; the sample is the only thing here that doesn't cover all rows. Its
counts are summed on the executors, so that the driver gets one number for each language and bucket.

Edge cases: a text that is null or has no letter (Unicode category L) is `und` with score 0; null labels are not learned;
a null id is neither held out nor learned; without any learned language every text is `und`;
repeated rows get the same answer; other columns are kept, and where one has the name of a new
column, that gets an underscore more; `stage` treats each case alike and returns the columns it got.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import kernels, util

BUCKETS = 1 << 13
TEXTS = 256  # of one matrix of counts at most
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # BUCKETS x bits
    bias: np.ndarray
    scale: np.ndarray
    trust: np.ndarray  # weight of each bit's loss


def chunks(texts):
    """(index of the first, texts) in runs of at most about half a million characters and `TEXTS` texts."""
    for first, part in kernels.chunks(texts, 1 << 19):
        for i in range(0, len(part), TEXTS):
            yield first + i, part[i : i + TEXTS]


def counts(texts: list[str]) -> np.ndarray:
    """Trigram counts, texts x BUCKETS; whatever isn't a letter counts as a space."""
    raw = [b"  " + kernels.utf8(t.lower()) for t in texts]
    data = _FOLD[np.frombuffer(b"".join(raw) + b"  ", dtype=np.uint8)]
    code = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code >>= np.uint32(19)
    blank = (data[1:-1] == 32) & (data[2:] == 32)
    row = np.repeat(np.arange(len(raw), dtype=np.int64) * BUCKETS, [len(r) for r in raw])
    at = (row + code[: len(row)])[~blank[: len(row)]]
    return np.bincount(at, minlength=len(raw) * BUCKETS).reshape(len(raw), BUCKETS)


def codewords(n: int) -> np.ndarray:
    """One row of -1 and 1 for each language: all splits of up to five languages, else random ones kept far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for b in range(1, 2 ** (n - 1))] for i in range(n)])
    rng, bits = np.random.default_rng(7), max(15, 10 * int(np.ceil(np.log2(n))))
    tries = [rng.choice([-1, 1], size=(n, bits)) for _ in range(200)]
    return max(tries, key=lambda c: (c @ c.T - 2 * bits * np.eye(n)).max() * -1)


def margins(texts: list[str], model: Model) -> np.ndarray:
    c = counts(texts).astype(np.float32)
    n = c.sum(axis=1, keepdims=True)
    return ((c @ model.weights) / np.maximum(n, 1) + model.bias) / model.scale * (n / (n + 10))


def decode(f: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The winner's index, its share of the probability and the runner-up's, of each row of margins."""
    loss = (model.trust * np.log1p(np.exp(-np.clip(2 * f[:, None, :] * model.codes[None], -30, 30)))).sum(axis=2)
    p = np.exp(-2 * (loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
    return best, p[np.arange(len(p)), best], second


def fit(docs: DataFrame, per_lang: int = 1500, trainable=None, most_rows: int = 60_000, most_langs: int = 1000) -> Model | None:
    """Learns from the columns doc_id, text and lang of the rows that `trainable` picks; see the module's text for the sample."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    rows = rows if trainable is None else rows.where(trainable)
    n_by = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    n_by = {r["lang"]: r["n"] for r in n_by.collect()}
    langs = sorted(n_by)
    if not langs:
        return None
    each = min(per_lang, max(1, most_rows // len(langs)))
    shares = {"lang": pa.array(langs, pa.string()), "share": pa.array([min(1.0, each / n_by[x]) for x in langs], pa.float64())}
    shares = docs.sparkSession.createDataFrame(pa.table(shares))  # a relation in the plan; rows would be read by Python workers of their own on the executors
    place = F.xxhash64("doc_id", F.lit(11)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    sample = util.stash(rows.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("text", "lang"))

    def add(batches):
        for pdf in batches:
            for first, part in chunks(pdf["text"]):
                who, c = pdf["lang"].iloc[first : first + len(part)].to_numpy(), counts(part)
                for x in np.unique(who):
                    total = c[who == x].sum(axis=0)
                    at = np.flatnonzero(total)
                    yield pd.DataFrame({"lang": x, "bucket": at, "n": total[at]})

    found = sample.mapInPandas(add, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # len(langs) * BUCKETS rows at most
    seen = np.zeros((len(langs), BUCKETS))
    seen[np.searchsorted(langs, found["lang"].to_numpy(dtype=str)), found["bucket"].to_numpy(dtype=np.int64)] = found["n"]

    codes = codewords(len(langs))
    share_of = (seen + 0.5) / (seen + 0.5).sum(axis=1, keepdims=True)  # languages count alike, however many rows they have
    weights = np.zeros((BUCKETS, codes.shape[1]), dtype=np.float32)
    for b in range(codes.shape[1]):
        yes, no = share_of[codes[:, b] > 0], share_of[codes[:, b] < 0]
        if len(yes) and len(no):
            weights[:, b] = np.log(yes.mean(axis=0)) - np.log(no.mean(axis=0))
    model = Model(langs, codes, weights, np.zeros(codes.shape[1], dtype=np.float32), np.ones(codes.shape[1], dtype=np.float32), np.ones(codes.shape[1]))

    def score(batches):
        for pdf in batches:
            for first, part in chunks(pdf["text"]):
                yield pd.DataFrame({"lang": pdf["lang"].iloc[first : first + len(part)].to_numpy(), "f": list(margins(part, model).astype(float))})

    found = sample.mapInPandas(score, "lang string, f array<double>").toPandas()  # about most_rows rows at most
    f, truth = np.array(found["f"].tolist()), codes[[langs.index(x) for x in found["lang"]]]
    for b in range(codes.shape[1]):
        one, other = f[truth[:, b] > 0, b], f[truth[:, b] < 0, b]
        if len(one) and len(other):
            model.bias[b] = -(np.median(one) + np.median(other)) / 2
            model.scale[b] = max(1e-3, (np.median(one) - np.median(other)) / 2)
            right = ((f[:, b] + model.bias[b]) * truth[:, b] > 0).mean()
            model.trust[b] = min(1.0, max(0.05, np.log((right + 0.01) / (1.01 - right)) / np.log(101)))
    return model


NEW = ("lang_pred", "score", "runner_up", "ambiguous")


def predict(docs: DataFrame, model: Model | None, ambiguous_below: float = 0.6) -> DataFrame:
    """docs with the columns `NEW`, or the names that `util.free` makes of them."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in series:
            out = []
            for _, part in chunks(text):
                letters = np.array([bool(_LETTER.search(t)) for t in part])
                if model is None:
                    letters[:] = False
                    best, p, q = np.zeros(len(part), dtype=int), np.zeros(len(part)), np.zeros(len(part))
                else:
                    best, p, q = decode(margins(part, model), model)
                lang = [model.langs[i] if ok else "und" for i, ok in zip(best, letters)]
                out.append(pd.DataFrame({"lang_pred": lang, "score": np.where(letters, p, 0.0), "runner_up": np.where(letters, q, 0.0), "ambiguous": letters & (p < ambiguous_below)}))
            yield pd.concat(out) if out else pd.DataFrame({"lang_pred": [], "score": [], "runner_up": [], "ambiguous": []}).astype({"lang_pred": str, "ambiguous": bool})

    told = F.pandas_udf(run, "lang_pred string, score double, runner_up double, ambiguous boolean")
    (at,) = util.free(docs.columns, "told")
    names = util.free(docs.columns, *NEW)
    return docs.withColumn(at, told("text")).select(*util.named(docs.columns), *[F.col(at)[x].alias(y) for x, y in zip(NEW, names)])


def remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, trainable=remainder() != 2)
    held = F.coalesce(remainder() == 2, F.lit(False))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: list[str] | None = None, least_score: float = 0.4) -> DataFrame:
    """Drops documents without a letter, those of whose language the classifiers are not sure, and those of other languages than `wanted` (none: all).

    `least_score` is the share of the probability that the language must have; a text of two languages
    in equal parts has about half, a text of syllables of several less.
    """
    lang, score, *_ = util.free(docs.columns, *NEW)
    told = predict(docs, fit(docs, trainable=remainder() != 2))
    keep = (F.col(lang) != "und") & (F.col(score) >= least_score)
    if wanted is not None:
        keep &= F.col(lang).isin(wanted)
    return told.where(keep).select(*util.named(docs.columns))
