"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of at most `capacity` tokens. Best-fit decreasing is run over the counts of
each length (at most `capacity` numbers, whatever the corpus), which gives a plan of slots: so many
sequences of one class with a place for a length at an offset. Pieces then take the slots of their
length by rank. The rank within a length is the number of pieces of that length in earlier buckets,
plus the place inside the piece's own bucket, so a length shared by a third of all pieces is never in one task.

Edge cases: a null or empty text is a document of the end token alone; rows that repeat an
id are packed each on their own; an empty table gives no sequences; other columns are ignored.
The order of equal lengths is that of doc_id, then piece.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import util

CAPACITY = 2048
_PLAIN = re.compile("[\x00-\u024f]*")  # where both libraries know the same letters and digits
_RARE = re.compile(r"[^\S \n]")


class Words(dict):
    """Token ids, as bytes, by word; words are looked up far more often than encoded."""

    def __init__(self, encode, most: int = 300_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = self.encode(word)
        return ids


class Tokenize:
    """Ids of the byte-level BPE file, little-endian unsigned 32-bit.

    For this vocabulary a single space between two other characters always begins a new word, and a
    single line feed between two is a word of its own, so texts are cut there and words
    looked up. The same vocabulary's ranks give the ids of words within Latin script; anything
    else, and a text with the string of a special token, is left to the tokenizers library.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k.json"):
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(P.path(vocabulary))
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if vocabulary == "byte_bpe_50k.json":
            with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.single = self.fast._core_bpe.encode_single_piece
            self.feed = self.whole("\n")
        self.words = Words(self.word)

    def whole(self, text: str) -> bytes:
        if self.fast and (text.isascii() or _PLAIN.fullmatch(text)):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.slow.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def word(self, word: str) -> bytes:
        """Of a word that a space precedes, or, if it begins with one, a line feed."""
        if word[0] == "\n":
            return self.feed + self.whole(word[1:])
        if word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)):
            return array("I", self.single(f" {word}".encode())).tobytes()
        return self.whole(" " + word)

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        odd = not self.fast or not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n " in text or " \n" in text or "\n\n" in text or _RARE.search(text)
        if odd:
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.whole(first) + b"".join(map(self.words.__getitem__, rest))


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document; the first piece is the shorter one."""

    def run(batches):
        tokenize = Tokenize(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            out = defaultdict(list)
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                ids = (tokenize(text) if isinstance(text, str) else b"") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out["doc_id"].append(doc_id)
                    out["piece"].append(i)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(ids[4 * a : 4 * b]))
                    if with_ids:
                        out["ids"].append(np.frombuffer(ids[4 * a : 4 * b], dtype="<u4").astype(np.int64))
            if out:
                yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(length, first rank, number, first sequence, offset)], number of sequences) of best-fit decreasing.

    A class is a run of sequences filled alike. Every step puts one item into each sequence of a class
    (or of a part of it, which splits the class), so the work depends on the capacity only.
    """
    slots, opened = [], 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: (first sequence, number)
    rooms: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if room:
            if not free[room]:
                insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = free[room].pop()
                if not free[room]:
                    rooms.pop(at)
                take = min(n, left)
                if take < n:
                    put(room, first + take, n - take)
                slots.append((length, rank, take, first, capacity - room))
                put(room - length, first, take)
            else:
                each = capacity // length  # items of this length that a new sequence holds
                take = min(left, max(1, left // each))
                room, first, opened = capacity, opened, opened + take
                slots.append((length, rank, take, first, 0))
                put(room - length, first, take)
            left -= take
            rank += take
    return slots, opened


def pack(parts: DataFrame, capacity: int = CAPACITY, rows_a_bucket: int = 20_000, most_slots: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces, a stored table with columns doc_id, piece and length."""
    spark = parts.sparkSession
    counted = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(counted, capacity)
    ends = np.cumsum([s[2] for s in sorted(slots)]) if slots else []
    columns = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5).T
    planned = spark.createDataFrame(pa.table(dict(zip(("l", "from_rank", "n", "first", "slot_offset"), columns))))  # a relation in the plan; rows would be read by Python workers of their own on the executors
    buckets = max(16, int(ends[-1] // rows_a_bucket) + 1) if slots else 1

    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    by = parts.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = by.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = parts.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    # Slots cover stretches of a length's ranks. They depend on the capacity, hardly on the corpus, and are
    # sent out while they are `most_slots` at most; more are joined by length and stretch of ranks.
    inside = (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("n"))
    if len(slots) <= most_slots:
        found = ranked.join(F.broadcast(planned), inside)
    else:
        stretch = F.sequence(F.floor(F.col("from_rank") / rows_a_bucket), F.floor((F.col("from_rank") + F.col("n") - 1) / rows_a_bucket))
        found = ranked.withColumn("stretch", F.floor(F.col("rank") / rows_a_bucket)).join(planned.withColumn("of", F.explode(stretch)), inside & (F.col("stretch") == F.col("of")))
    keep = [c for c in parts.columns if c != "bucket"]
    return found.select(*keep, (F.col("first") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), F.col("slot_offset").alias("offset"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(util.stash(pieces(util.table(spark, sf_dir, "documents"))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(util.stash(pieces(docs)))
