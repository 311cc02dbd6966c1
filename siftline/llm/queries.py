"""One query for each operator of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import backoff, collision_search, decontam, language_id, lengths, line_dedup, merkle, mixing, secret_scan, simhash, source_audit, toxicity, weak_quality
from siftline.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"), toxicity.not_held_out())
    place = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        "predicted",
        F.array_join(place, ",").alias("spans"),
    )


@query
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "flow")
    return found.select(
        "doc_id",
        *[secret_scan.count_of(F.col("spans"), k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query
def op6_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.length_table(table(spark, folder, "documents"), TOKENIZER)


@query
def op7_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


ORACLES["op7_poisson_mix"] = "WITH docs AS (SELECT * FROM documents), " + mixing.mix_sql(["doc_id", "text", "lang", "source", "n_chars"]).lstrip()


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), "text", shingle=4, bits=4)
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


@query
def op10_backoff_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return backoff.score_texts(docs, fold("doc_id") == 1)


@query
def op4_template_decontam(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n_lines",
        "n_kept",
        F.concat_ws(",", F.transform("removed", lambda i: i.cast("string"))).alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


@query
def op3_collision_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return collision_search.search(vectors, F.col("vec_id") % 20 == 0, k=20)


@query
def op9_weak_quality(spark: SparkSession, folder: str) -> DataFrame:
    return weak_quality.score(table(spark, folder, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audit(table(spark, folder, "documents"))


ORACLES["op11_merkle_manifest"] = merkle.audit_sql()


@query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.audit(table(spark, folder, "documents"))


ORACLES["op12_source_divergence"] = source_audit.audit_sql()


@query
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))
