"""URL rules: expressions of host suffix and path prefix, joined on short hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import join_spread, save

#: Rules up to this many are sent to all executors (about 1 MB); more are joined by a shuffle.
BROADCAST_RULES = 10_000


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows; the host is without a leading dot."""
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def digests(rules: DataFrame) -> DataFrame:
    rule = F.concat("rule_host", "rule_path")
    return rules.select("verdict", rule.alias("rule"), F.sha2(_expression(F.col("rule_host"), F.col("rule_path")), 256).alias("digest"),
                        (F.length("rule_host") * F.lit(1 << 20) + F.length("rule_path")).alias("weight"), F.length("rule_path").alias("path_length"))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def short(digest: Column) -> Column:
    """The short hash: the first 32 bits of the digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Each page's host, path, the rule that decides and its verdict.

    Each distinct (host, path) is expanded into all suffixes of the host at its
    dots and all prefixes of the path of a length that some rule has.  They are
    joined with the rules on 32 bits of their digests, the full digests confirm,
    and of the rules that fit the one with the longest host, then the longest
    path, wins.  A frequent host and path costs one expansion, and the pages that
    have it stay spread when the rule comes back to them.

    A null URL, or one without ://, has an empty host and path and no rule, so
    its verdict is the default; repeated pages each give a row; rules that are
    stated twice count once, a block before an allow.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    known = digests(rules).groupBy("digest", "rule", "weight", "path_length").agg(F.max("verdict").alias("verdict"))
    # Distinct lengths of rules' paths: at most a URL's length of them.
    lengths = [r[0] for r in known.select("path_length").distinct().orderBy("path_length").collect()]
    few = known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    labels = F.split("host", r"\.", -1)
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    paths = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>"),
        lambda p: p.isNotNull(),
    )
    # A host ends where the path's first / is, so both together name the pair.
    rows = rows.withColumn("pair", F.concat("host", "path"))
    pairs = rows.groupBy("pair", "host", "path").agg(F.count("*").alias("n"))
    wanted = (
        pairs.where(F.col("host") != "").select("pair", F.explode(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.sha2(_expression(h, p), 256))))).alias("wanted"))
        .withColumn("short", short(F.col("wanted")))
    )
    known = known.withColumn("short", short(F.col("digest")))
    best = (
        wanted.join(F.broadcast(known) if few else known, "short")
        .where(F.col("wanted") == F.col("digest"))
        .groupBy("pair")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct("weight", "rule")).alias("best"))
    )
    judged = save(pairs.select("pair", "n").join(best, "pair", "left"), "judged")
    return join_spread(rows, judged, "pair", "n").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
