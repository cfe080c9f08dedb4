"""What several operators share: written intermediate tables and ranks."""

from __future__ import annotations

import atexit
import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evalspark.sources.shared import shared_folder


#: Folders of tables that this process wrote and has not deleted.
_written: dict[str, SparkSession] = {}


#: While a table is written, Spark deletes the shuffle files of the query at its end, and Python gets batches of
#: bounded rows and bytes: whole texts make batches of Spark's usual 10,000 rows large.  So do those of a scan.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session has these settings inside, and those it had before afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def save(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors.

    The session's settings are the same afterwards.  The table stays until
    drop() or clear() or the end of the driver's process.
    """
    spark = df.sparkSession
    top = shared_folder(spark)
    if not _written:
        atexit.register(clear)
    _written[top] = spark
    with settings(spark, WRITING):
        df.write.parquet(f"{top}/{name}")
    return spark.read.schema(df.schema).parquet(f"{top}/{name}")


def _delete(top: str) -> None:
    spark = _written.pop(top)
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Deletes the folders of tables that save() wrote."""
    for df in tables:
        for top in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
            for known in [t for t in _written if t.rsplit("/", 1)[1] == top.rsplit("/", 1)[1]]:
                _delete(known)


def drop_since(before: list[str], *keep: DataFrame) -> None:
    """Deletes the folders written since written() gave before, but for those of the tables to keep."""
    kept = {f.rsplit("/", 3)[1] for df in keep for f in df.inputFiles()}
    clear([t for t in _written if t not in set(before) and t.rsplit("/", 1)[1] not in kept])


def written() -> list[str]:
    """The folders of tables that stand at this time."""
    return list(_written)


def clear(tops: Iterable[str] | None = None) -> None:
    """Deletes these folders, or all that save() wrote and drop() has left; frames that read them can't be used any more."""
    for top in list(_written) if tops is None else tops:
        with suppress(Exception):  # at the end of the process the session may be gone
            _delete(top)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which a worker process gives freed memory back; workers are used again by later tasks."""

    def leaner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return leaner


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int = 512, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut to so many rows, and to about size bytes of the column numbered text; a longer text comes alone."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns under fixed names; a null text is the empty text."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the key (a, b) of id and text; rows alike in both share one."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    return docs.select(F.coalesce(own, F.lit(0)).alias("a"), F.xxhash64(text, own.isNull()).alias("b"), own.alias("doc_id"), text.cast("binary").alias("bytes"), *keep)


def repeats(rows: DataFrame, *key: str) -> DataFrame | None:
    """The keys, (a, b) of keyed() if none are named, that n rows share, two at least; None if all rows have keys of their own."""
    key, before = key or ("a", "b"), written()
    again = save(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "repeats")
    if not again.isEmpty():
        return again
    drop_since(before)
    return None


def once(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """One row of each key (a, b); those of a frequent key are merged before the shuffle."""
    return rows if again is None else rows.dropDuplicates(["a", "b"])


def join_keys(rows: DataFrame, table: DataFrame, again: DataFrame | None, key: list[str], how: str = "inner") -> DataFrame:
    """rows joined, inner or left, with table, which has a bounded number of rows for each key; again: repeats() of rows.

    Keys with more than a part in 4 times the shuffle partitions of all rows, that
    many at most, have their part of the table broadcast, so their rows stay
    spread.  Where that is bounded by a row's text, it is no larger than as many
    texts of mean size.
    """
    hot = None if again is None else again.where(F.col("n") > rows.count() / (4 * partitions(rows.sparkSession))).select(*key)
    if hot is None or hot.isEmpty():
        return rows.join(table, key, how)
    hot = F.broadcast(hot)
    cold = rows.join(hot, key, "left_anti").join(table, key, how)
    return cold.unionByName(rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_spread(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows joined with table, which has one row for each of their keys and in weight the number of rows of it.

    Keys with more than a part in 4 times the shuffle partitions of all rows,
    which are that many at most, are broadcast, so their rows stay spread as they
    are; all others are joined by a shuffle.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > total / (4 * partitions(rows.sparkSession))
    large, small = F.broadcast(table.where(hot).drop(weight)), table.where(~hot).drop(weight)
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(small, key))


def ranked(df: DataFrame, group: str, ties: list[str], sizes: dict[int, int], name: str = "rank") -> DataFrame:
    """Adds each row's place, from 0 and without gaps, among the rows of its group.

    sizes holds the rows of each group; their number is bounded by the caller.
    A group is split into as many hash buckets as its share of all rows asks
    for, so no task gets a whole hot group; a bucket's rows are numbered after
    those of the buckets before it.  Rows alike in all of ties are interchangeable.
    """
    spark = df.sparkSession
    total, want = max(1, sum(sizes.values())), 4 * partitions(spark)
    parts = spark.createDataFrame([(int(g), max(1, -(-n * want // total))) for g, n in sizes.items()], f"{group} int, _parts long")
    rows = df.join(F.broadcast(parts), group).withColumn("_bucket", F.pmod(F.xxhash64(*ties), F.col("_parts")))
    # At most 4 counts a shuffle partition and one a group: bounded by settings, not by the data.
    counts = rows.groupBy(group, "_bucket").count().toPandas().sort_values([group, "_bucket"])
    counts["_before"] = counts.groupby(group)["count"].cumsum() - counts["count"]
    before = spark.createDataFrame(
        counts[[group, "_bucket", "_before"]] if len(counts) else [], f"{group} int, _bucket long, _before long"
    )
    number = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*ties))
    return (
        rows.withColumn("_number", number - 1)
        .join(F.broadcast(before), [group, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_number"))
        .drop("_parts", "_bucket", "_before", "_number")
    )


class Intervals:
    """Maps (group, rank) to the interval of ranks that holds it.

    Rows are (group, first rank, payload ...); groups times ranks fit in 63 bits.
    """

    SHIFT = 44

    def __init__(self, rows: list[tuple], names: list[str]):
        rows = sorted(rows)
        table = np.array(rows or [(0,) * (2 + len(names))], dtype=np.int64)
        self.starts = (table[:, 0] << self.SHIFT) + table[:, 1]
        self.first = table[:, 1]
        self.payload = {n: table[:, 2 + i] for i, n in enumerate(names)}

    def find(self, group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval's row and the place within the interval."""
        at = np.searchsorted(self.starts, (group.astype(np.int64) << self.SHIFT) + rank, side="right") - 1
        return at, rank - self.first[at]

    def column(self, group: str, rank: str, fields: str, make) -> Column:
        """A struct column; make gets the interval's rows and the places within."""
        table = self

        def look(g: pd.Series, r: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(make(table, *table.find(g.to_numpy(), r.to_numpy())))

        look.__annotations__ = {"g": pd.Series, "r": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(look, T._parse_datatype_string(fields))(group, rank)
