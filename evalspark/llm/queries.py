"""The queries of the ten operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.bpe import encode_decode
from evalspark.llm.langid import fit, fold, predict
from evalspark.llm.packing import pack_documents
from evalspark.llm.ppm import score_documents
from evalspark.llm.sharding import shard_documents
from evalspark.llm.simhash import simhash_groups
from evalspark.llm.sketch import edited_fingerprints
from evalspark.llm.suffix import remove_repeats
from evalspark.llm.topk import top_k
from evalspark.llm.urlfilter import judge_urls, rule_table

SHARDS, SEQUENCE = 24, 1024
#: Bytes of a repeated passage: those of the law, and those of the further text, 50 words of five with their blanks.
REPEAT, PASSAGE = 400, 250
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), SEQUENCE)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = fit(docs.where(fold("doc_id", 3) != 1))
    return predict(docs, filters).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), words=3, threshold=2)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # text is what the law leaves, text_without_passages what shorter passages would.
    rows = remove_repeats(table(spark, sf_dir, "documents"), REPEAT, shorter=PASSAGE)
    return rows.withColumnsRenamed({"kept": "text", "kept_shorter": "text_without_passages"})


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, docs.where(fold("doc_id", 7) != 2))
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), digests=True)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_packing, op2_sharding, op3_language_id, op4_simhash, op5_suffix_dedup, op6_lm_score, op7_url_filter, op8_top_k, op9_bpe, op10_fingerprints)
    return {f.__name__: f for f in own}


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_HOST = r"translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"


def oracle_sql() -> dict[str, str]:
    return {
        "op8_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                       WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
        "op7_url_filter": f"""
            WITH rules(verdict, rh, rp) AS (VALUES {_VALUES}),
            p AS (SELECT row_number() OVER () AS n, page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
            best AS (
                SELECT n, arg_max(rh || rp, length(rh) * 1048576 + length(rp)) AS rule,
                       arg_max(verdict, length(rh) * 1048576 + length(rp)) AS verdict
                FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (n)""",
    }
