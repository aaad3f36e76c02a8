"""Ranked lexical search: item bundles travel through the owners of the terms and gather scores.

1. Documents are read once, in blocks of at most `DOCS` documents. A block yields, for each term that any item may have,
   its documents and how often each holds the term; terms that no item has are dropped by a bitmap of
   fixed size, which lets a few others pass. Counts of documents by term come from the same rows.
2. Terms are dealt to `OWNERS` owners, the rarest to the first; the postings of each go to that owner's stage.
3. Items travel in bundles, one for each block of documents, and carry a sparse accumulator: document and
   integer score so far. At every owner's stage a bundle meets (cogroup) the owner's postings of its block, and the
   contributions of that owner's terms are added.
   A document that could not be among an item's best `k` any more, were all terms to come in it at their largest, is let go;
   it can't come back among them, as its score only lacks parts. This loses nothing and keeps accumulators sparse where frequent terms would fill them.
4. The best k of every block and item are ranked once more.

Work and rows grow with blocks times bundles; no group holds more than a bundle and a block, so frequent terms
and a source with a third of all rows are no hot keys. Terms are told apart by hashes of 64 bits.

Edge cases: null and empty texts have no term and don't count; an item is a distinct (item_id, text), so repeated rows
are one, and those of one id with other texts are ranked apart; an item without a term that some document holds gives no rows; documents that repeat an id
are documents each; null ids come first among equal scores; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import kernels, util

DOCS, TERMS = 4096, 1 << 22  # of a block at most, but for a longer document
OWNERS = 4
ITEMS = 256  # of a bundle, about
BITS = 24  # of the bitmap's size
MOST = 1_000_000  # no contribution of weight 1 exceeds it
NULL = -(1 << 63)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term of all texts in turn, and each text's first place among them (one more at the end)."""
    raw = [kernels.utf8(t) for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(_TERM[data].view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    hashes = kernels.span_hash(kernels.prefix_hash(data), start, end)
    begin = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=begin[1:])
    return hashes.view(np.int64), np.searchsorted(start, begin)


def counted(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, doc), by key and doc, and how often each occurs."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], docs[first], np.diff(np.append(first, len(keys)))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, th, term, c): the terms of each distinct item, and how often it has them."""

    def run(batches):
        for pdf in batches:
            for first, part in kernels.chunks(pdf["text"]):
                h, at = terms(part)
                key, doc, c = counted(h, np.repeat(np.arange(len(part)), np.diff(at)))
                of = pdf.iloc[first : first + len(part)]
                yield pd.DataFrame({"item_id": of["item_id"].astype("Int64").to_numpy()[doc], "th": of["th"].to_numpy()[doc], "term": key, "c": c}).astype({"item_id": "Int64"})

    th = F.xxhash64(F.coalesce("text", F.lit("")))
    return items.select(F.col("item_id").cast("long").alias("item_id"), th.alias("th"), "text").distinct().mapInPandas(run, "item_id long, th long, term long, c long")


def bitmap(wanted: DataFrame) -> np.ndarray:
    """The bits of all terms: 2 ** BITS of them, however many terms there are."""
    word = F.shiftrightunsigned("term", 64 - BITS + 6)
    bit = F.shiftrightunsigned("term", 64 - BITS).bitwiseAND(F.lit(63)).cast("int")
    rows = wanted.select(word.alias("word"), bit.alias("bit")).distinct().groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def has(bits: np.ndarray, term: np.ndarray) -> np.ndarray:
    place = term.view(np.uint64) >> np.uint64(64 - BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def blocks(docs: DataFrame, bits: np.ndarray, most_docs: int = DOCS, most_terms: int = TERMS) -> DataFrame:
    """(block, term, n, docs, tf) of each term that passes, and for each block one row without term: n documents with a term, ids in `docs`, lengths in `tf`."""

    def run(batches):
        task, done = TaskContext.get().partitionId(), 0
        ids, lengths, found, size = [], [], [], 0

        def block():
            nonlocal done
            name = (task << 32) + done
            done += 1
            n = np.concatenate(lengths)
            key, doc, tf = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(key, kind="stable")
            key, doc, tf = key[order], doc[order].astype("<u4"), tf[order].astype("<u4")
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
            ends = np.append(first[1:], len(key))
            rows = [(int(b - a), doc[a:b].tobytes(), tf[a:b].tobytes()) for a, b in zip(first, ends)]
            rows.append((int((n > 0).sum()), np.concatenate(ids).tobytes(), n.astype("<i8").tobytes()))
            out = pd.DataFrame(rows, columns=["n", "docs", "tf"])
            out.insert(0, "block", name)
            out.insert(1, "term", pd.array([*key[first].tolist(), None], dtype="Int64"))
            return out

        for pdf in batches:
            own = pdf["doc_id"].astype("Int64").fillna(NULL).to_numpy(dtype="<i8")
            for first, part in kernels.chunks(pdf["text"]):
                h, at = terms(part)
                for i in range(0, len(part), most_docs):
                    cut = at[i : i + most_docs + 1]
                    held = sum(map(len, lengths))
                    if held and (held + len(cut) - 1 > most_docs or size + cut[-1] - cut[0] > most_terms):
                        yield block()
                        ids, lengths, found, size, held = [], [], [], 0, 0
                    these, doc = h[cut[0] : cut[-1]], np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                    keep = has(bits, these)
                    key, doc, tf = counted(these[keep], doc[keep])
                    found.append((key, doc + held, tf))
                    ids.append(own[first + i : first + i + len(cut) - 1])
                    lengths.append(np.diff(cut))
                    size += int(cut[-1] - cut[0])
        if lengths:
            yield block()

    return docs.select("doc_id", "text").mapInPandas(run, "block long, term long, n long, docs binary, tf binary")


def bundled(weighted: DataFrame, n_bundles: int) -> DataFrame:
    """One row for each bundle: its items, and their terms with owner and weight, as arrays of numbers."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(item_id=pdf["item_id"].astype("Int64").fillna(NULL).astype("int64")).sort_values(["item_id", "th", "term"], kind="stable")
        new = (pdf[["item_id", "th"]] != pdf[["item_id", "th"]].shift(fill_value=0)).any(axis=1).to_numpy()
        new[0] = True
        items = pdf[new]
        blob = {"ids": items["item_id"], "ths": items["th"], "term": pdf["term"], "cw": pdf["c"] * pdf["w"], "owner": pdf["owner"], "of": pd.Series(np.cumsum(new) - 1)}
        return pd.DataFrame({"b": [pdf["b"].iloc[0]], **{k: [v.to_numpy().astype("<i8").tobytes()] for k, v in blob.items()}})

    b = F.pmod(F.xxhash64("item_id", "th"), F.lit(n_bundles)).alias("b")
    return weighted.select(b, "item_id", "th", "term", "c", "w", "owner").groupBy("b").applyInPandas(pack, "b long, ids binary, ths binary, term binary, cw binary, owner binary, of binary")


ITEM = ("ids", "ths", "term", "cw", "owner", "of")
CARRIED = "b long, block long, " + ", ".join(f"{c} binary" for c in (*ITEM, "doc", "m", "a_item", "a_doc", "a_score"))


def numbers(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<i8")


def owner_stage(owner: int, k: int):
    """One bundle at one owner: adds the contributions of the owner's terms to the accumulator, lets go of what can't be among the best k, and moves on."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return left
        cell = left.iloc[0].copy()
        term, cw, own, of, m = (numbers(cell[c]) for c in ("term", "cw", "owner", "of", "m"))
        n_items = len(numbers(cell["ids"]))
        score = np.zeros((n_items, len(m)), dtype=np.int64)
        score[np.frombuffer(cell["a_item"], dtype="<u4"), np.frombuffer(cell["a_doc"], dtype="<u4")] = numbers(cell["a_score"])
        mine = np.flatnonzero(own == owner)
        mine = mine[np.argsort(term[mine], kind="stable")]
        for t, docs, tf in zip(right["term"].to_numpy(), right["docs"], right["tf"]):
            a, b = np.searchsorted(term[mine], (t, t), "left")[0], np.searchsorted(term[mine], t, "right")
            d, f = np.frombuffer(docs, dtype="<u4"), np.frombuffer(tf, dtype="<u4").astype(np.int64)
            part = (1_000_000_000 * f) // (1000 * f + 8 * m[d])
            for i in mine[a:b]:
                score[of[i], d] += cw[i] * part
        later = np.bincount(of[own > owner], weights=cw[own > owner], minlength=n_items).astype(np.int64) * MOST
        kept = score > 0
        for i in np.flatnonzero(kept.sum(axis=1) > k):
            kept[i] &= score[i] + later[i] >= np.partition(score[i], len(m) - k)[len(m) - k]
        item, doc = np.nonzero(kept)
        cell["a_item"], cell["a_doc"], cell["a_score"] = item.astype("<u4").tobytes(), doc.astype("<u4").tobytes(), score[item, doc].astype("<i8").tobytes()
        return pd.DataFrame([cell])[list(left.columns)]

    return run


def best(k: int):
    """The best k documents of each item in each block."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                item, doc, score = np.frombuffer(r.a_item, dtype="<u4"), numbers(r.doc)[np.frombuffer(r.a_doc, dtype="<u4")], numbers(r.a_score)
                order = np.lexsort((doc, -score, item))
                item, doc, score = item[order], doc[order], score[order]
                first = np.searchsorted(item, item, "left")
                keep = np.arange(len(item)) - first < k
                item, doc, score = item[keep], doc[keep], score[keep]
                ids = pd.array(numbers(r.ids)[item], dtype="Int64")
                ids[numbers(r.ids)[item] == NULL] = pd.NA
                who = pd.array(doc, dtype="Int64")
                who[doc == NULL] = pd.NA
                yield pd.DataFrame({"item_id": ids, "th": numbers(r.ths)[item], "doc_id": who, "score": score})

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, most_docs: int = DOCS, most_terms: int = TERMS, items_a_bundle: int = ITEMS, owners: int = OWNERS) -> DataFrame:
    """(item_id, th, rank, doc_id, score) of the k best documents (doc_id, text) of every item (item_id, text); th tells items of one id apart."""
    wanted = util.stash(item_terms(items))
    posted = util.stash(blocks(docs, bitmap(wanted), most_docs, most_terms))
    heads = posted.where("term is null")
    total = heads.agg(F.sum("n"), F.sum(F.length("docs") / 8), F.count(F.lit(1))).first()
    n, n_blocks = total[0] or 0, total[2]
    lengths = heads.mapInPandas(lambda batches: (pd.DataFrame({"l": [int(numbers(x).sum()) for x in pdf["tf"]]}) for pdf in batches), "l long")
    length = lengths.agg(F.sum("l")).first()[0] or 0
    n_bundles = wanted.select("item_id", "th").distinct().count() // items_a_bundle + 1

    df = posted.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = F.least(F.lit(owners - 1), F.floor(F.log("df") / np.log(n + 1.0) * owners)).cast("int")
    weighted = util.stash(wanted.join(df, "term").select("item_id", "th", "term", "c", w.alias("w"), owner.alias("owner")), instead_of=[wanted])
    b = F.pmod(F.xxhash64("item_id", "th"), F.lit(n_bundles)).alias("b")
    asked = weighted.select(b, "term", "owner").distinct().hint("rebalance")  # dealt anew, so that the join can split the postings of a frequent term
    routed = util.stash(posted.join(asked, "term").select("b", "owner", "block", "term", "docs", "tf"), by="owner")

    # Every bundle visits every block: bundles are dealt out in copies, so that none meets more than some hundred blocks in one task.
    salts = n_blocks // 128 + 1
    visits = heads.select(F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1)).cast("array<long>")).alias("b"), F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), "block", F.col("docs").alias("doc"), F.col("tf").alias("n"))
    copies = bundled(weighted, n_bundles).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))

    def started(batches):
        for pdf in batches:
            m = [(25 + (75 * n) * numbers(x) // max(length, 1)).astype("<i8").tobytes() for x in pdf["n"]]
            yield pdf.assign(m=m, a_item=b"", a_doc=b"", a_score=b"").drop(columns="n")

    cells = visits.join(copies, ["b", "salt"]).select("b", "block", *ITEM, "doc", "n").mapInPandas(started, CARRIED)
    for i in range(owners):
        own = routed.where(F.col("owner") == i).select("b", "block", "term", "docs", "tf")
        cells = cells.groupBy("b", "block").cogroup(own.groupBy("b", "block")).applyInPandas(owner_stage(i, k), CARRIED)
    found = cells.select("ids", "ths", "doc", "a_item", "a_doc", "a_score").mapInPandas(best(k), "item_id long, th long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id", "th").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "th", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(util.table(spark, sf_dir, "documents"), util.table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM a) GROUP BY r, term),
s AS MATERIALIZED (SELECT r, doc_id, len(terms) AS n FROM a WHERE len(terms) > 0),
k AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM s),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
i AS (SELECT item_id, text, term, count(*) AS c FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
w AS (SELECT item_id, text, term, c * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS cw FROM i JOIN f USING (term), k),
m AS (SELECT r, doc_id, 25 + (75 * n * docs) // l AS m FROM s, k),
x AS (SELECT item_id, text, r, doc_id, CAST(sum(cw * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM w JOIN t USING (term) JOIN m USING (r) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM x QUALIFY rank <= 10
"""
