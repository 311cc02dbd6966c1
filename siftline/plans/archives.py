"""Named files, zipped dumps, JSON verdicts, checked joins and the shuffle-free permutation over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import checked
from siftline.ordering import add_index
from siftline.plans.registry import Tables, query
from siftline.session import new_path
from siftline.sources import archives, json_files, tables, text

_SHARDS = 24


def _records(t: Tables) -> DataFrame:
    """Documents as FASTA records, dealt to the even ones of 24 shards."""
    record = F.concat(F.lit(">"), F.col("doc_id"), F.lit("\n"), F.translate("text", "\r\n>", "  "))
    return t.documents.select((F.col("doc_id") % 12 * 2).alias("shard"), F.col("doc_id").alias("place"), record.alias("value"))


@query(
    f"""WITH s AS (SELECT i AS shard, 'docs-' || lpad(i::VARCHAR, 5, '0') || '-of-000{_SHARDS}' AS file_name FROM range({_SHARDS}) r(i)),
d AS (SELECT doc_id % 12 * 2 AS shard, count(*) AS records, sum(doc_id)::BIGINT AS ids,
  sum(strlen('>' || doc_id || chr(10) || translate(text, chr(13) || chr(10) || '>', '  ')) + 1)::BIGINT AS size_bytes FROM documents GROUP BY 1)
SELECT file_name, coalesce(records, 0) AS records, ids, coalesce(size_bytes, 0) AS size_bytes FROM s LEFT JOIN d ON s.shard = d.shard"""
)
def named_shards(t: Tables) -> DataFrame:
    path = new_path(t.spark, "named")
    archives.write_named_shards(_records(t), path, "docs", _SHARDS)
    # names as Spark lists them; bytes of the files that have any
    names = t.spark.createDataFrame([(x,) for x in t.spark.read.text(path).inputFiles()], "path string")
    listed = tables.read_listing(t.spark, path, suffixes=()).select("file_name", "size_bytes")
    found = text.read_fasta(t.spark, path).groupBy(F.substring_index("source_file", "/", -1).alias("file_name")).agg(
        F.count("*").alias("records"), F.sum(F.col("header").cast("bigint")).alias("ids")
    )
    return (
        names.select(F.substring_index("path", "/", -1).alias("file_name"))
        .join(found, "file_name", "left")
        .join(listed, "file_name", "left")
        .select("file_name", F.coalesce("records", F.lit(0)).alias("records"), "ids", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"))
    )


@query(
    """SELECT upper(replace(p_name, ' ', '-')) AS header, replace(replace(upper(p_type), '-', ''), 'T', 'U') || p_partkey AS sequence
FROM part WHERE p_brand = 'Brand#7'"""
)
def zipped_reference(t: Tables) -> DataFrame:
    path = new_path(t.spark, "dumps")
    cells = [
        F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit(" ")),
        F.concat(F.lit(" "), F.col("p_brand")),
        F.concat(F.lower("p_type"), F.lit("--"), F.col("p_partkey")),
    ]
    shard = F.col("p_partkey") % 4
    rows = t.part.select(shard.alias("shard"), F.col("p_partkey").alias("place"), F.concat_ws("\t", *cells).alias("value"))
    heads = t.part.select(shard.alias("shard")).distinct().select("shard", F.lit(-2).alias("place"), F.lit("transcript\tspecies\tsequence").alias("value"))
    short = heads.select("shard", F.lit(-1).alias("place"), F.lit("too\tshort").alias("value"))
    archives.write_named_shards(rows.unionByName(heads).unionByName(short), path, "dump", 4, packed=True, suffix=".zip")
    return archives.read_zipped_reference(t.spark, path, "Brand#7", 0, 1, 2)


_JSON_FILES = 40
_JSON_SQL = f"""
WITH e AS (SELECT event_id, user_id % {_JSON_FILES} AS f, CASE WHEN user_id % {_JSON_FILES} = 9 THEN event_id // 1000 ELSE event_id END AS k FROM events),
j AS (SELECT f, count(*) AS records, CASE WHEN f % 10 = 3 THEN 'unparsable' WHEN f % 10 = 5 THEN 'not an object' WHEN f % 10 = 7 THEN 'no key'
  WHEN count(*) > count(DISTINCT k) THEN 'repeated key' END AS reason FROM e GROUP BY f),
v AS (SELECT 'events-' || lpad(i::VARCHAR, 5, '0') || '-of-000{_JSON_FILES}' AS file_name, coalesce(records, 0) AS records,
  CASE WHEN records IS NULL THEN 'empty' ELSE reason END AS reason, i AS f FROM range({_JSON_FILES}) r(i) LEFT JOIN j ON f = i)
"""


def _judged(t: Tables) -> json_files.Judged:
    path = new_path(t.spark, "judged")
    shard, first = F.col("user_id") % _JSON_FILES, t.events.groupBy((F.col("user_id") % _JSON_FILES).alias("shard")).agg(F.min("event_id").alias("first"))
    key = F.when(shard == 9, F.floor(F.col("event_id") / 1000)).otherwise(F.col("event_id"))
    rows = t.events.select(shard.alias("shard"), F.col("event_id").alias("place"), F.to_json(F.struct(F.concat(F.lit("e"), key).alias("id"), "value", "event_type")).alias("value"))
    # the first line of some files is broken in one way or another
    bad = F.when(F.col("shard") % 10 == 3, '{"id": "e').when(F.col("shard") % 10 == 5, '["id"]').when(F.col("shard") % 10 == 7, '{"id": 7}')
    broken = rows.join(first, "shard").withColumn("value", F.when(F.col("place") == F.col("first"), F.coalesce(bad, "value")).otherwise(F.col("value")))
    archives.write_named_shards(broken, path, "events", _JSON_FILES)
    return json_files.judge_jsonl(t.spark, path, "id")


@query(_JSON_SQL + "SELECT file_name, records, reason FROM v")
def jsonl_verdicts(t: Tables) -> DataFrame:
    files = _judged(t).files
    return files.select(F.substring_index("source_file", "/", -1).alias("file_name"), "records", "reason")


@query(_JSON_SQL + "SELECT file_name, 'e' || k AS id, event_type, value FROM v JOIN e USING (f) JOIN events USING (event_id) WHERE reason IS NULL")
def jsonl_good_rows(t: Tables) -> DataFrame:
    rows = _judged(t).rows
    return rows.select(
        F.substring_index("source_file", "/", -1).alias("file_name"),
        "id",
        F.try_variant_get("record", "$.event_type", "string").alias("event_type"),
        F.try_variant_get("record", "$.value", "double").alias("value"),
    )


@query(
    """WITH k AS (SELECT s_suppkey AS i, s_suppkey % 7 = 0 AS bad, s_suppkey % 7 = 1 AS plain, s_suppkey % 7 = 2 AS nested FROM supplier),
m AS (SELECT 's-' || s_suppkey AS candidate_id, i, unnest(['key', 'nation', 'gone']) AS name, bad, plain, nested, s_nationkey FROM k JOIN supplier ON i = s_suppkey)
SELECT candidate_id, name, CASE name WHEN 'key' THEN i::VARCHAR WHEN 'nation' THEN s_nationkey::VARCHAR END AS value,
  CASE name WHEN 'gone' THEN 'VOID' ELSE 'BIGINT' END AS kind FROM m WHERE NOT bad AND NOT plain AND NOT (nested AND name = 'nation')"""
)
def metric_files(t: Tables) -> DataFrame:
    path, n = new_path(t.spark, "metrics"), F.col("s_suppkey") % 7
    named = F.concat(F.lit("s-"), F.col("s_suppkey"), F.lit(".json"))
    plain = F.concat(F.lit('{"key": '), F.col("s_suppkey"), F.lit(', "gone": null, "nation": '), F.col("s_nationkey"), F.lit("}"))
    nested = F.concat(F.lit('{"key": '), F.col("s_suppkey"), F.lit(', "gone": null, "nation": {"key": '), F.col("s_nationkey"), F.lit("}}"))
    body = F.when(n == 0, F.concat(F.lit('{"key": '), F.col("s_suppkey"))).when(n == 1, "[1]").when(n == 2, nested).otherwise(plain)
    archives.write_named_files(t.supplier.select(named.alias("name"), body.alias("value")), path, t.spark.sparkContext.defaultParallelism)
    found = json_files.judge_metrics(t.spark, f"{path}/files-*", "stage1").rows
    return found.select("candidate_id", "name", "value", "kind")


@query(
    """SELECT o_orderkey, o_custkey AS candidate_id, c_name, c_mktsegment
FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def checked_join(t: Tables) -> DataFrame:
    required = t.orders.select("o_orderkey", F.col("o_custkey").alias("candidate_id"))
    available = t.customer.select(F.col("c_custkey").alias("candidate_id"), "c_name", "c_mktsegment")
    return checked.checked_join(required, available, allow_missing=True)


_SIZES = "sizes AS (SELECT n, a, ((n + a - 1) // a)::BIGINT AS b FROM (SELECT n, (floor(sqrt(n - 1)) + 1)::BIGINT AS a FROM (SELECT count(*) AS n FROM documents)))"


@query(
    f"""WITH {_SIZES}, i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
p AS (SELECT doc_id, {checked.permuted_sql("i", "n")} AS position FROM i, sizes)
SELECT doc_id, position, (position % 16)::INTEGER AS shard, position // 16 AS place FROM p"""
)
def permuted_rows(t: Tables) -> DataFrame:
    ordinals = add_index(t.documents.select("doc_id"), ["doc_id"], 0, "i")
    return checked.permute_to_shards(ordinals, "i", 16, t.documents.count()).drop("i")
