"""Streaming faces of the engine: an extension beyond a batch catalogue.

Cache replay keeps a shard's SIEVE state between micro-batches; commits are
idempotent, so a repeated micro-batch adds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestore.operators import catalogue as C
from lodestore.operators.sieve import COLUMNS, RESULT, Sieve, even_budget, fold, on_each_shard


def replay_stream(trace: DataFrame, limit: int, shards: int | None = None) -> DataFrame:
    """Outcomes of a streaming trace ``(shard, seq, op, key, cost)``, in append mode.

    Each shard has ``limit``; with ``shards`` that is the whole cache's, dealt evenly,
    and ``resize``, ``clear`` and ``purge`` reach every shard. An entry larger than its
    shard's limit is refused, as shards don't touch each other here. Rows of one
    micro-batch are put in order; rows must not arrive in a later micro-batch than one
    with a larger ``seq`` of their shard.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = lambda whole: even_budget(max(1, whole), shards)[int(key[0])] if shards else whole
        cache = Sieve.load(json.loads(state.get[0])) if state.exists else Sieve(own(limit))
        pdf = pd.concat(list(parts)).sort_values("seq")
        pdf["cost"] = [own(c) if op == "resize" else c for op, c in zip(pdf["op"], pdf["cost"].tolist())]
        out = list(fold(cache, zip(pdf["shard"].tolist(), pdf["seq"].tolist(), pdf["op"], pdf["key"], pdf["cost"].tolist())))
        state.update((json.dumps(cache.dump()),))
        yield pd.DataFrame(out, columns=COLUMNS)

    # A null cost counts as 1, and a column without nulls stays whole numbers in pandas.
    cost = F.coalesce(F.col("cost").cast("long"), F.lit(1).cast("long")).alias("cost")
    rows = trace.select(F.col("shard").cast("int"), F.col("seq").cast("long"), "op", "key", cost)
    if shards:
        rows = on_each_shard(rows, shards)
    return rows.groupBy("shard").applyInPandasWithState(step, RESULT, "state string", "append", GroupStateTimeout.NoTimeout)


def commit_batches(read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that commits each micro-batch of described payloads:
    ``write`` gets the rows that ``read``'s catalogue lacks."""

    def each(batch: DataFrame, epoch: int) -> None:
        write(C.commit(batch, read()), epoch)

    return each


def coalesce_access_stream(events: DataFrame, key: str, ts: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """The latest access of each key in each interval, once its watermark has passed."""
    rows = events.select(F.col(key), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy(key, F.window("at", every).alias("w")).agg(F.max("at").alias("last_access"), F.count("*").alias("accesses")).select(key, F.col("w.start").alias("since"), "last_access", "accesses")
