"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import Intervals, ranked, save


def ring(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points of the ring, as signed 64-bit hashes, and each one's shard."""
    points = sorted(
        (int.from_bytes(hashlib.blake2b(b"%d/%d" % (s, v), digest_size=8).digest(), "big", signed=True), s)
        for s in range(shards)
        for v in range(nodes)
    )
    return np.array([p for p, _ in points]), np.array([s for _, s in points])


def capacities(n: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may hold: with slack 0 the counts are at most one apart."""
    if slack > 0:
        return [int(-(-n * (1 + slack) // shards))] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def allot(counts: dict[int, int], owners: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int]]:
    """Deals each arc's ranks out to shards: (arc, first rank, shard, first slot).

    Keys at home come first, in the order of the ring, up to the shard's room;
    what overflows goes on clockwise to the next shard with room.
    """
    room, used, rows, over = list(room), [0] * len(room), [], []

    def put(arc: int, first: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            rows.append((arc, first, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return n

    for arc in sorted(counts):
        n = put(arc, 0, counts[arc], int(owners[arc]))
        if n < counts[arc]:
            over.append((arc, n))
    for arc, done in over:
        at = arc
        while done < counts[arc]:
            at = (at + 1) % len(owners)
            done += put(arc, done, counts[arc] - done, int(owners[at]))
    return rows


def shard_documents(
    docs: DataFrame, shards: int = 24, *, nodes: int = 128, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Puts every row on one shard: doc_id, size, text_crc32, shard, slot.

    A row's key is its id; it belongs to the virtual node next clockwise from
    the key's hash.  A shard holds at most its capacity, and keys beyond it go
    on clockwise.  The loads are settled on the counts of the arcs (shards times
    nodes numbers, whatever the input), and each arc's ranks are dealt out as
    whole intervals.  slack 0 gives counts at most one apart; a larger one moves
    fewer keys when the data change.

    A null text has size 8 and CRC 0; null ids share the key null; repeated rows
    each get a slot of their own; an empty table gives no rows.
    """
    points, owners = ring(shards, nodes)

    @F.pandas_udf("int")
    def arc(h: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, h.to_numpy()) % len(points)).astype(np.int32))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = save(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            arc(F.xxhash64(F.col(id_col).cast("long"))).alias("arc"),
        )
    )
    counts = {r["arc"]: r["count"] for r in rows.groupBy("arc").count().collect()}  # at most shards times nodes
    table = Intervals(allot(counts, owners, capacities(sum(counts.values()), shards, slack)), ["shard", "slot"])
    place = table.column(
        "arc",
        "rank",
        "shard int, slot long",
        lambda t, at, within: {"shard": t.payload["shard"][at].astype(np.int32), "slot": t.payload["slot"][at] + within},
    )
    return (
        ranked(rows, "arc", ["doc_id", "size", "text_crc32"], counts)
        .withColumn("at", place)
        .select("doc_id", "size", "text_crc32", "at.shard", "at.slot")
    )
