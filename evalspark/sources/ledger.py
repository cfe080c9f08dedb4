"""The ledger: JSON lines that are only ever appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "schema_version string, case_id string, revision_identity string, context_fingerprint string, status string, payload string"
# What a record's status can be.
STATUSES = ("passed", "failed", "skipped")


class LedgerError(ValueError):
    """A ledger holds something that isn't a record."""


def record_violation() -> Column:
    """Why a record isn't valid, else null."""
    return (
        F.when(F.col("case_id").isNull() | (F.trim("case_id") == ""), "case_id")
        .when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status")
        .when(~F.coalesce(F.col("revision_identity").rlike(r"^sha256:[0-9a-f]{64}\z"), F.lit(False)), "revision_identity")
        .when(~F.coalesce(F.col("context_fingerprint").rlike(r"^sha256:[0-9a-f]{64}\z"), F.lit(False)), "context_fingerprint")
    )


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Data files of a ledger and their sizes, oldest first; none where nothing is at path."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [(x.getModificationTime(), x.getPath().toString(), x.getLen()) for x in fs.listStatus(top) if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return [(name, size) for _, name, size in sorted(found)]


def _last_byte(spark: SparkSession, name: str, size: int) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(size - 1)
        return stream.read()
    finally:
        stream.close()


def append(records: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Adds records to a folder of JSON lines, in the order of columns if given; all are checked first, and Spark commits all or none.

    Each record gets a seq beyond all that are there, so reading goes by the
    order of appending.  One writer at a time may append to a ledger.
    """
    spark = records.sparkSession
    if bad := records.withColumn("why", record_violation()).where("why IS NOT NULL").select("case_id", "why").take(3):
        raise LedgerError(f"not a record: {bad}")
    last = read_file(spark, path).agg(F.max("seq")).first()[0] if files(spark, path) else None
    if order:
        records = records.orderBy(*order)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    given = [F.col(n) if n in records.columns else F.lit(None).cast("string").alias(n) for n in names]
    rows = records.select((F.lit((last or 0) + 1) + F.monotonically_increasing_id()).alias("seq"), *given)
    rows.write.mode("append").json(path)


#: Files of a ledger are told apart above this bit of a line's place, which is its byte or less.
_FILE_BIT = 44


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Records with seq of a ledger: a folder of JSON lines, as append() writes it, or one file of any writer.

    Lines without a seq are numbered by file, oldest first, and place; such
    numbers rise from line to line but have gaps.  A cut last line, a blank or a
    bad one raises LedgerError; no file, no records.  Files are read in splits.
    """
    known = files(spark, path)
    if cut := [name for name, size in known if size and _last_byte(spark, name, size) != 10]:
        raise LedgerError(f"{cut[0]}: the last line is cut off")
    if not known:
        return spark.createDataFrame([], f"seq long, {SCHEMA}")
    at = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text([name for name, _ in known]).select("value", F.col("_metadata.file_name").alias("file"), at.alias("at"))
    names = spark.createDataFrame([(name.rsplit("/", 1)[1], i) for i, (name, _) in enumerate(known)], "file string, n long")
    read = lines.join(F.broadcast(names), "file").select("file", "at", "n", F.try_parse_json("value").alias("v"), F.from_json("value", f"seq long, {SCHEMA}").alias("r"))
    rows = read.select("file", "at", F.coalesce("r.seq", F.shiftleft("n", _FILE_BIT) + F.col("at")).alias("seq"), *(f"r.{f.split()[0]}" for f in SCHEMA.split(", ")), F.when(F.col("v").isNull(), "JSON").alias("why"))
    rows = rows.withColumn("why", F.coalesce("why", record_violation()))
    if bad := rows.where("why IS NOT NULL").orderBy("seq").select("file", "at", "why").take(1):
        before = lines.where((F.col("file") == bad[0]["file"]) & (F.col("at") < bad[0]["at"])).count()
        raise LedgerError(f"{path}/{bad[0]['file']}:{before + 1}: {bad[0]['why']}")
    return rows.drop("why", "file", "at")


def passing_checkpoints(ledger: DataFrame) -> DataFrame:
    """The last identity that passed, for each case; a later failure doesn't clear it."""
    return ledger.where("status = 'passed'").groupBy("case_id").agg(F.max_by("revision_identity", "seq").alias("revision_identity"))


def resume_filter(cases: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Cases whose current identity hasn't passed."""
    return cases.join(checkpoints, ["case_id", "revision_identity"], "left_anti")
