"""Document fingerprints: threshold-scaled sketches, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.llm.common import drop_since, join_keys, once, partitions, repeats, save, written

WORDS = 5
#: Of long texts one hash in SCALE is retained, on average.
SCALE = 8
#: A sketch of fewer hashes takes a larger fraction, up to all hashes.
LEAST = 32


def _below(hashes: Column, scale: int) -> Column:
    """Those hashes of which one in scale is kept; the cut must not be a parameter of the test, where it would be the place."""
    cut = F.lit(-(1 << 63) + (1 << 64) // scale) if scale > 1 else None
    return hashes if cut is None else F.filter(hashes, lambda h: h < cut)


def with_sketch(df: DataFrame, text: str, name: str, *, words: int = WORDS, scale: int = SCALE, runs: str | None = None) -> DataFrame:
    """Adds the sorted distinct hashes below a cut of all runs of words, and in the column runs, if named, all of them.

    The cut lets one hash in scale pass, or where LEAST hashes are not below it
    one in half of scale, and so on up to all.  A sketch has all hashes below its
    cut, which follows from the sketch itself, so only a text without words has an
    empty one.  Below the smaller cut, the sketch of a union is the union of
    sketches.  A text of fewer words is one run; one without a word has no hash.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("_words") - words), lambda i: F.xxhash64(*[F.col("_words").getItem(i + j) for j in range(words)])
    )
    out = (
        df.withColumn("_words", F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
        .withColumn("_runs", F.array_distinct(F.when(F.size("_words") >= words, hashes).when(F.size("_words") > 0, F.array(F.xxhash64(F.array_join("_words", " ")))).otherwise(F.array().cast("array<bigint>"))))
        .withColumn("_low", _below(F.col("_runs"), scale))
    )
    while scale > 1:
        scale //= 2
        more = _below(F.col("_runs"), scale)
        out = out.withColumn("_low", F.when(F.size("_low") >= LEAST, F.col("_low")).otherwise(more))
    out = out.withColumn(name, F.array_sort("_low"))
    return (out.withColumn(runs, F.col("_runs")) if runs else out).drop("_words", "_runs", "_low")


def as_text(sketch: Column) -> Column:
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def containment(a: Column, b: Column) -> Column:
    """The part of the sketch a's hashes that b has, which estimates how much of a's document is in b's; of two empty ones 1.

    b has all hashes of its document, or is a sketch with a cut that isn't smaller.
    """
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def following(rows: DataFrame) -> DataFrame:
    """For distinct keys (a, b) in the order of doc_id, b: the next key next_a, next_b; after the last the first.

    Ranges of keys are ordered each by itself; the first key of each range, one
    row a partition, links a range with the next.
    """
    spread = save(rows.repartitionByRange(partitions(rows.sparkSession), F.col("doc_id").asc_nulls_first(), "b").withColumn("part", F.spark_partition_id()), "order")
    key = F.struct("a", "b")
    first = spread.groupBy("part").agg(F.min_by(key, F.struct("doc_id", "b")).alias("first"))
    whole = Window.orderBy("part")
    first = first.select("part", F.coalesce(F.lead("first").over(whole), F.first("first").over(whole)).alias("after"))
    own = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "b")
    return (
        spread.withColumn("next", F.lead(key).over(own))
        .join(F.broadcast(first), "part")
        .withColumn("next", F.coalesce("next", "after"))
        .select("a", "b", "doc_id", "n_chars", F.col("next.a").alias("next_a"), F.col("next.b").alias("next_b"))
    )


def edited_fingerprints(docs: DataFrame, *, words: int = WORDS, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next.  The edited text has its last quarter replaced by
    the beginning of the next document.  A fingerprint is the sketch's hashes in
    hexadecimal; likeness is the part of them that is among all runs of the other
    text, so it is exact where the sketch has all hashes.

    A null text is empty, and equal texts have equal fingerprints.  Null ids
    come first in the order, equal ids follow in the order of their text's hash.
    Rows alike in id and text stand in one place of the order and each give the
    same row.  A single row is its own next document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own_id = F.col(id_col).cast("long")
    base = docs.select(own_id.alias("doc_id"), F.coalesce(own_id, F.lit(0)).alias("a"), F.xxhash64(text, own_id.isNull()).alias("b"), text.alias("text"))
    ids = base.groupBy("a", "b", "doc_id", F.length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("rows"))
    before = written()
    order = save(following(ids), "next")
    drop_since(before, order)
    again = repeats(base) if order.count() < docs.count() else None
    # Texts are shuffled once for three uses, without sketches: making these again takes no disk.
    texts = once(base.select("a", "b", "text"), again).repartition(partitions(docs.sparkSession), "a", "b")
    sketched = with_sketch(texts, "text", "sketch", words=words, scale=scale)
    sketches = sketched.select("a", "b", "sketch").join(order.hint("shuffle_hash"), ["a", "b"])
    # Each sketch goes to the next text, where all runs of that are at hand.
    wanted = sketches.select(F.col("a").alias("from_a"), F.col("b").alias("from_b"), F.floor(F.col("n_chars") / 4).cast("int").alias("k"), "sketch", F.col("next_a").alias("a"), F.col("next_b").alias("b"))
    sent = with_sketch(texts, "text", "_own", words=words, scale=1, runs="next_runs").join(wanted.hint("shuffle_hash"), ["a", "b"]).select(
        F.col("from_a").alias("a"), F.col("from_b").alias("b"), F.substring("text", F.lit(1), F.col("k")).alias("head"), containment(F.col("sketch"), F.col("next_runs")).alias("near_next")
    )
    n = F.length("text").cast("long")
    whole = (
        sketched.join(sent.hint("shuffle_hash"), ["a", "b"])
        .join(order.select("a", "b", "doc_id").hint("shuffle_hash"), ["a", "b"])
        .select("a", "b", "doc_id", "sketch", "near_next", n.alias("n_chars"), F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int")), "head").alias("edited"))
    )
    result = with_sketch(whole, "edited", "edited_sketch", words=words, scale=scale, runs="edited_runs").select(
        "a",
        "b",
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_runs")).alias("near_edited"),
        "near_next",
    )
    if again is not None:
        result = join_keys(base.select("a", "b"), save(result, "result"), again, ["a", "b"])
    return result.drop("a", "b")
