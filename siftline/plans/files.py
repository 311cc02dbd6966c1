"""Sinks and sources: whole tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import sequences as s
from siftline.ordering import add_index
from siftline.plans.candidates import order_manifest
from siftline.plans.registry import Tables, query
from siftline.session import new_path
from siftline.sources import sinks, tables, text

_JOINED = "array_to_string(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(x)), '')"


@query(f"SELECT doc_id::VARCHAR AS header, {_JOINED} AS sequence FROM documents")
def fasta_round_trip(t: Tables) -> DataFrame:
    path = new_path(t.spark, "fasta")
    sinks.write_fasta(t.documents.select(F.col("doc_id").cast("string").alias("header"), F.col("text").alias("sequence")), path)
    return text.read_fasta(t.spark, path).select("header", "sequence")


@query(
    f"""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5('23:' || doc_id), 1, 15))::BIGINT, doc_id) - 1 AS position FROM documents)
SELECT doc_id::VARCHAR AS header, {_JOINED} AS sequence, 'docs-' || lpad((position % 16)::VARCHAR, 5, '0') || '-of-00016' AS shard
FROM k JOIN documents USING (doc_id)"""
)
def shards_round_trip(t: Tables) -> DataFrame:
    path = new_path(t.spark, "shards")
    placed = s.permute_to_shards(t.documents.select("doc_id", "text"), "doc_id", 16)
    records = placed.select("shard", "place", F.col("doc_id").cast("string").alias("header"), F.col("text").alias("sequence"))
    sinks.write_shards(records, path, "docs", 16)
    found = text.read_fasta(t.spark, f"{path}/shard_name=*")
    return found.select("header", "sequence", F.regexp_extract("source_file", "shard_name=([^/]+)/", 1).alias("shard"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def typed_csv_round_trip(t: Tables) -> DataFrame:
    path = new_path(t.spark, "series")
    kept = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    sinks.write_series(kept, path, ["o_orderkey"])
    return tables.read_typed_csv(t.spark, path, kept.schema)


@query(
    """SELECT l_orderkey::VARCHAR AS pos, l_linenumber::VARCHAR AS line, l_extendedprice::DOUBLE AS efficacy, l_returnflag AS flag
FROM lineitem WHERE l_linestatus = 'F'"""
)
def evidence_tsv_round_trip(t: Tables) -> DataFrame:
    path = new_path(t.spark, "screen")
    screen = t.lineitem.select(
        F.col("l_orderkey").alias("pos"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").cast("string").alias("efficacy"),
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("filter"),
    )
    sinks.write_screen(screen, path, "lines", ["pos", "line"])
    columns = ["pos", "line", "efficacy", "flag", "filter"]
    return tables.read_evidence_tsv(t.spark, f"{path}/lines_ranked_filtered", columns, ["efficacy"]).drop("filter")


@query("SELECT 'e' || event_id AS candidate_id, user_id, event_type, value FROM events")
def jsonl_round_trip(t: Tables) -> DataFrame:
    path = new_path(t.spark, "jsonl")
    rows = t.events.select(F.concat(F.lit("e"), F.col("event_id")).alias("candidate_id"), "user_id", "event_type", "value")
    order = add_index(rows.select("candidate_id"), ["candidate_id"], 0, "position")
    sinks.write_jsonl(rows, path, order)
    return tables.read_jsonl(t.spark, path, rows.schema, "candidate_id")


@query("SELECT 'order-' || o_orderkey AS candidate_id, o_orderstatus AS status_part FROM orders")
def manifest_round_trip(t: Tables) -> DataFrame:
    path = new_path(t.spark, "manifest")
    part = t.orders.select(F.concat(F.lit("order-"), F.col("o_orderkey")).alias("candidate_id"), F.col("o_orderstatus").alias("status_part"))
    full = tables.empty_manifest(t.spark).unionByName(order_manifest(t), allowMissingColumns=True)
    sinks.write_table(full.join(part, "candidate_id"), path, ["status_part"])
    return tables.read_manifest(t.spark, path).select("candidate_id", "status_part")
