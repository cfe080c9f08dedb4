"""Exact top-k by inner product: dual-tree search over cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.llm.common import drop_since, lean, save, written

LEAF, BASE = 32, 1.3
#: Vectors and queries of one pair of blocks, which one tree each holds.
ROWS, QUERIES = 2048, 1024
#: Vectors that are looked at to choose the centers of groups, and centers at most.  They only decide which vectors lie together.
SAMPLE, CENTERS = 4096, 256
#: Rows that are compared at once with a group of queries.
BULK = 512


class CoverTree:
    """A cover tree over the vectors, which it puts in an order of its own.

    A node of level i has a vector as its center and covers vectors within
    BASE ** i of it.  Its children, of lower levels, have centers more than
    BASE ** (i - 1) apart, the node's own among them, and each vector goes to the
    nearest child, within that distance.  Levels at which a node has no other
    child than itself are left out; LEAF vectors or fewer, or vectors all alike,
    make up a leaf.
    """

    def __init__(self, vectors: np.ndarray):
        self.order: list[int] = []
        self.centers: list[int] = []
        self.radius: list[float] = []
        self.level: list[int | None] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[np.ndarray] = []
        squares = (vectors**2).sum(axis=1)
        self.away = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * (vectors @ vectors.T), 0.0))
        self.root = self._node(0, np.arange(len(vectors)))
        del self.away
        self.center = vectors[self.centers]
        self.norm = np.sqrt(squares[self.centers])
        self.reach = np.array(self.radius)
        self.vectors = vectors[self.order]

    def _node(self, center: int, members: np.ndarray) -> int:
        nearest = self.away[center, members]
        radius, start, level, children = float(nearest.max()), len(self.order), None, []
        if len(members) <= LEAF or radius == 0:
            self.order.extend(members.tolist())
        else:
            level = math.ceil(math.log(radius, BASE))
            cover = min(BASE ** (level - 1), radius * (1 - 1e-9))
            centers, label = [center], np.zeros(len(members), dtype=np.int64)
            while nearest.max() > cover:
                centers.append(int(members[nearest.argmax()]))
                d = self.away[centers[-1], members]
                closer = d < nearest
                label[closer], nearest = len(centers) - 1, np.minimum(nearest, d)
            by = members[np.argsort(label, kind="stable")]
            ends = np.bincount(label, minlength=len(centers)).cumsum()
            children = [self._node(c, by[a:b]) for c, a, b in zip(centers, [0, *ends[:-1]], ends, strict=True)]
        self.centers.append(center)
        self.radius.append(radius)
        self.level.append(level)
        self.span.append((start, len(self.order)))
        self.children.append(np.array(children, dtype=np.int64))
        return len(self.centers) - 1


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest inner products of each query that reach its floor, and their ids; of equal ones the smaller id. Empty places hold -inf."""
    left, right = CoverTree(queries), CoverTree(vectors)
    own, least, other = query_ids[left.order], floor[left.order], ids[right.order]
    best = np.full((len(queries), k), -np.inf)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)

    def limits(q: int, nodes: np.ndarray) -> np.ndarray:
        """No product of a query and a vector below the two nodes is higher, rounding included."""
        reach, norm = right.reach[nodes], right.norm[nodes]
        top = right.center[nodes] @ left.center[q] + left.reach[q] * norm + left.norm[q] * reach + left.reach[q] * reach
        return top + 1e-9 * np.abs(top) + 1e-6

    def worst(q: int) -> float:
        rows = slice(*left.span[q])
        return np.maximum(best[rows, -1], least[rows]).min()

    def compare(q: int, nodes: np.ndarray) -> None:
        rows = slice(*left.span[q])
        cols = np.concatenate([np.arange(*right.span[n]) for n in nodes])
        score = left.vectors[rows] @ right.vectors[cols].T
        score[own[rows, None] == other[None, cols]] = -np.inf
        gain = np.flatnonzero(score.max(axis=1) >= np.maximum(best[rows, -1], least[rows]))
        if not len(gain):
            return
        at = gain + rows.start
        score = np.concatenate([best[at], score[gain]], axis=1)
        name = np.concatenate([found[at], np.broadcast_to(other[cols], (len(at), len(cols)))], axis=1)
        top = np.lexsort((name, -score), axis=-1)[:, :k]
        best[at], found[at] = np.take_along_axis(score, top, 1), np.take_along_axis(name, top, 1)

    def go(q: int, d: int) -> None:
        """Compares what is below a node of queries with what is below one of vectors, unless no query of the group can gain."""
        if limits(q, np.array([d]))[0] < worst(q):
            return
        kids, size = right.children[d], lambda span: span[1] - span[0]
        if len(left.children[q]) and (not len(kids) or size(left.span[q]) > size(right.span[d])):
            for child in left.children[q]:
                go(int(child), d)
            return
        if not len(kids):
            compare(q, np.array([d]))
            return
        top = limits(q, kids)
        by = np.argsort(-top, kind="stable")
        kids, top = kids[by], top[by]
        flat = np.array([not len(right.children[n]) for n in kids])
        small, high = kids[flat], top[flat]
        ends = np.cumsum([size(right.span[n]) for n in small])
        at = 0
        while at < len(small) and high[at] >= worst(q):  # leaves side by side make one product
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BULK)))
            compare(q, small[at:end][high[at:end] >= worst(q)])
            at = end
        for n in kids[~flat]:
            go(q, int(n))

    if len(queries) and len(vectors):
        go(left.root, right.root)
    back = np.argsort(left.order)
    return best[back], found[back]


def whole_numbers(embedding: Column, factor: int) -> Column:
    """floor(factor * x) of each component; null where the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("double")))


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors at most, each the farthest from those before it."""
    chosen = [0]
    nearest = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1)[None, :] - 2 * x @ centers.T
    group = d.argmin(axis=1)
    return group, np.sqrt(np.maximum(d[np.arange(len(x)), group], 0.0))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, factor: int = 1024, rows: int = ROWS, per_block: int = QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors with the highest integer inner product for each query: query_id, rank, vec_id, score.

    Vectors lie in groups by the nearest of a bounded number of centers, with
    the radius that covers the group; a group is dealt into blocks.  Each query
    is first searched in one block of its most promising group, which gives a
    floor under its kth score.  Then it goes only to the groups whose ball may
    hold a product that reaches the floor; a pair of blocks is one task's work, a
    dual-tree search that starts from the floors, and the k best of all blocks
    are taken.  Centers, radii and counts of groups are all that reach the driver.

    Vectors that are null or hold a null or a component that isn't finite, and
    null ids, take no part; only vectors of equal length are compared; ties go
    to the smaller id; rows with the query's id are its own, whatever they hold,
    and a query repeated with the same vector is answered once, with other
    vectors by one ranking of the products of all of them; fewer than k rows give
    them all.  Vectors so long that a product may not be exact raise an error.
    """
    spark, before = vectors.sparkSession, written()
    part = lambda df: df.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), factor).alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    asked, held = part(queries).dropDuplicates(["id", "v"]), part(vectors)
    n = held.count()
    share = min(1.0, SAMPLE / 2 / max(1, n))
    seen: dict[int, list] = {}
    for (v,) in held.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 20)) < max(1, math.ceil(share * (1 << 20)))).select("v").limit(SAMPLE).collect():
        seen.setdefault(len(v), []).append(v)
    centers = {size: far_apart(np.array(v), min(CENTERS, max(1, n // rows))) for size, v in seen.items()}
    origin = lambda size: centers.get(size, np.zeros((1, size)))

    def by_length(frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
        lengths = frame["v"].map(len).to_numpy()
        for size in np.unique(lengths):
            own = frame[lengths == size]
            yield int(size), own, np.stack(list(own["v"]))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, own, x in by_length(frame):
                if (x**2).sum(axis=1).max(initial=0) > 1 << 52:
                    raise ValueError("components are too large for exact products")
                group, away = _nearest(x, origin(size))
                yield pd.DataFrame({"id": own["id"], "v": own["v"], "size": size, "g": group, "away": away})

    placed = save(held.mapInPandas(lean(place), "id long, v array<double>, size int, g int, away double"), "placed")
    # One row a length and center.
    groups = placed.groupBy("size", "g").agg(F.max("away").alias("radius"), F.count("*").alias("n")).toPandas()
    groups["blocks"] = -(-groups["n"] // rows)
    balls = {int(s): (np.stack([origin(int(s))[g] for g in x["g"]]), x["radius"].to_numpy() * (1 + 1e-9) + 1e-6, x["g"].to_numpy()) for s, x in groups.groupby("size")}

    def reach(x: np.ndarray, size: int) -> np.ndarray:
        center, radius, _ = balls[size]
        return x @ center.T + np.sqrt((x**2).sum(axis=1))[:, None] * radius[None, :]

    def promising(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, own, x in by_length(frame):
                if size in balls:
                    yield pd.DataFrame({"id": own["id"], "v": own["v"], "floor": -np.inf, "size": size, "g": balls[size][2][reach(x, size).argmax(axis=1)]})

    def possible(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, own, x in by_length(frame):
                if size in balls:
                    top = reach(x, size)
                    query, group = np.nonzero(top + 1e-9 * np.abs(top) + 1e-6 >= own["floor"].to_numpy()[:, None])
                    yield pd.DataFrame({"id": own["id"].to_numpy()[query], "v": own["v"].to_numpy()[query], "floor": own["floor"].to_numpy()[query], "size": size, "g": balls[size][2][group]})

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = a["id"].to_numpy()
        score, found = search(np.stack(list(a["v"])), ids, a["floor"].to_numpy(), np.stack(list(b["v"])), b["id"].to_numpy(), k)
        there = score > -np.inf
        times = there.sum(axis=1)
        return pd.DataFrame({"query": np.repeat(a["query"].to_numpy(), times), "query_id": np.repeat(ids, times), "vec_id": found[there], "score": score[there].astype(np.int64)})

    known = spark.createDataFrame(groups[["size", "g", "blocks"]].astype({"size": "int32", "g": "int32", "blocks": "int64"}) if len(groups) else [], "size int, g int, blocks long")

    def meet(left: DataFrame, every: bool) -> DataFrame:
        """Searches queries (query, id, v, floor, size, g) in all blocks of their group, or in one."""
        left = left.join(F.broadcast(known), ["size", "g"])
        # One row a group again.
        loads = F.broadcast(left.groupBy("size", "g").agg(F.ceil(F.count("*") / per_block).alias("loads")))
        first = F.pmod(F.xxhash64("query"), F.col("blocks"))
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)) if every else first
        left = left.join(loads, ["size", "g"]).withColumn("load", F.pmod(F.xxhash64("query", F.lit(1)), F.col("loads"))).withColumn("block", block)
        right = placed.join(F.broadcast(known), ["size", "g"]).join(loads, ["size", "g"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
        right = right.withColumn("load", F.explode(F.sequence(F.lit(0).cast("long"), F.col("loads") - 1)))
        key = ["size", "g", "block", "load"]
        a, b = left.select("query", "id", "v", "floor", *key), right.select("id", "v", *key)
        return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(pair, "query long, query_id long, vec_id long, score long")

    named = save(asked.withColumn("query", F.monotonically_increasing_id()), "queries")

    def with_groups(df: DataFrame, run) -> DataFrame:
        """run over the queries, whose own number goes along as their id."""
        inner = df.select(F.col("query").alias("id"), "v", F.col("floor") if "floor" in df.columns else F.lit(0.0).alias("floor"))
        dealt = inner.mapInPandas(lean(run), "id long, v array<double>, floor double, size int, g int").withColumnRenamed("id", "query")
        return dealt.join(df.select("query", "id"), "query")

    first = save(meet(with_groups(named, promising), False), "first")
    floors = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= k).select("query", "floor")
    bounded = named.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    near = save(meet(save(with_groups(bounded, possible), "dealt"), True), "near")
    drop_since(before, near)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
