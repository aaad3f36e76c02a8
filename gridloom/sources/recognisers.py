"""External recognisers behind a table of known results: only misses are sent out, failures are not kept."""

from __future__ import annotations

import asyncio
import inspect
import time
from collections.abc import Awaitable, Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import cache

RETRYABLE = (429, 500, 502, 503)


class Refused(Exception):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def with_retries(call: Callable[[bytes], str], tries: int = 4, base: float = 2.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[bytes], str | None]:
    """None once the tries are used up or for a status that no retry mends."""

    def run(image: bytes) -> str | None:
        for attempt in range(tries):
            try:
                return call(image)
            except Refused as e:
                if e.status not in RETRYABLE:
                    return None
            except OSError:
                pass
            sleep(min(base**attempt, most))
        return None

    return run


class Pace:
    """Lets calls begin at least 1 / per_second apart; None lets them begin at once."""

    def __init__(self, per_second: float | None):
        self.step, self.next = 1 / per_second if per_second else 0.0, 0.0

    async def turn(self, sleep: Callable[[float], Awaitable]) -> None:
        now = time.monotonic()
        self.next = max(self.next, now) + self.step
        if self.step and self.next - self.step > now:
            await sleep(self.next - self.step - now)


async def in_flight(images: list[bytes], call: Callable[[bytes], Awaitable[str]], most: int, pace: Pace, tries: int = 4, base: float = 2.0, longest: float = 30.0, sleep: Callable[[float], Awaitable] = asyncio.sleep) -> list[str | None]:
    """The replies in the images' order, with up to `most` calls open at once; retries as in `with_retries`, each call waiting for its own alone."""
    gate = asyncio.Semaphore(most)

    async def one(image: bytes) -> str | None:
        for attempt in range(tries):
            async with gate:
                await pace.turn(sleep)
                try:
                    return await call(image)
                except Refused as e:
                    if e.status not in RETRYABLE:
                        return None
                except OSError:
                    pass
            if attempt < tries - 1:
                await sleep(min(base**attempt, longest))  # others take its place meanwhile
        return None

    return await asyncio.gather(*map(one, images))


def recognise(requests: DataFrame, known: DataFrame, call: Callable[[bytes], str] | Callable[[bytes], Awaitable[str]], tries: int = 4, most: int = 16, per_second: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(results of all requests, rows new to the cache): requests (key, image, ...), known (key, reply).

    A coroutine function is called for up to `most` images of a task at once, at most `per_second` of a task; a service's whole
    limit is that of a task times the tasks that run. A plain function is called for one image after another.
    """

    def run(batches):
        asked, pace = with_retries(call, tries), Pace(per_second)
        for pdf in batches:
            if inspect.iscoroutinefunction(call):
                yield pd.DataFrame({"key": pdf["key"], "reply": asyncio.run(in_flight([bytes(x) for x in pdf["image"]], call, most, pace, tries))})
                continue
            yield pd.DataFrame({"key": pdf["key"], "reply": [asked(bytes(x)) for x in pdf["image"]]})

    fresh = cache.misses(requests, known).select("key", "image").mapInPandas(run, "key string, reply string").where("reply is not null")
    every = known.select("key", "reply").unionByName(fresh)
    return requests.join(every, "key", "left"), fresh


def counters(results: DataFrame, known: DataFrame) -> DataFrame:
    """(n_requests, n_cached, n_called, n_failed)."""
    marked = results.join(known.select("key", F.lit(1).alias("_hit")), "key", "left")
    return marked.agg(F.count(F.lit(1)).alias("n_requests"), F.count("_hit").alias("n_cached"), F.count_if(F.col("_hit").isNull()).alias("n_called"), F.count_if(F.col("reply").isNull()).alias("n_failed"))
