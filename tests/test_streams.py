"""Keyed replies, and sessions of late words."""

from __future__ import annotations

import os

from gridloom.streaming import sessions


def test_replies_are_kept_by_key(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def ask(image: bytes) -> str | None:
        n = len(list(asked.iterdir()))
        (asked / f"{n}-{image.decode()}").write_text("")
        return None if image == b"bad" else image.decode().upper()

    def batch(*keys):
        spark.createDataFrame([(k, k.encode()) for k in keys], "key string, image binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, image binary").parquet(str(tmp_path / "in"))
        sessions.recognised(stream, ask).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(p.name.partition("-")[2] for p in asked.iterdir())

    assert batch("a", "b", "a", "bad") == ["a", "b", "bad"]
    assert batch("b", "c", "bad") == ["a", "b", "bad", "bad", "c"], "known keys aren't asked for, failures are"
    got = sorted((r["key"], r["reply"], r["known"]) for r in spark.read.parquet(str(tmp_path / "out")).fillna("-", ["reply"]).collect())
    assert got == [("a", "A", False), ("a", "A", False), ("b", "B", False), ("b", "B", True), ("bad", "-", False), ("bad", "-", False), ("c", "C", False)]


def test_sessions_of_late_words(spark, tmp_path):
    """Words of a run that is open still join it, however they come; words behind the watermark don't; runs come out when it has passed them."""
    second = 1_000_000
    for i, words in enumerate([[(1, 0), (1, 2)], [(1, 1), (2, 30)], [(2, 31)], [(1, 3), (9, 100)]]):
        spark.createDataFrame([(t, y * second) for t, y in words], "table_id long, y long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        os.utime(next((tmp_path / "in" / str(i)).glob("*.parquet")), (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("table_id long, y long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {(r["table_id"], r["first"] // second, r["last"] // second, r["n"]) for r in sessions.appended(sessions.by_gap(stream, "5 seconds", "10 seconds")).collect()}
    assert got == {(1, 0, 2, 3), (2, 30, 31, 2)}
