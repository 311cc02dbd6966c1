"""Mix sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import join_small, saved, whole

_BLOCK = 1024  # equal rows dealt out at once
_PART = 32.0  # larger means are sums of Poisson variables with at most this mean


def uniform(*parts: Column) -> Column:
    """Number in (0, 1) from the first 52 bits of the MD5 of ``parts`` joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def tempered(docs: DataFrame, power: float = 0.5) -> DataFrame:
    """Target weights ``(source, weight)``: each source's number of rows to ``power``."""
    return docs.groupBy("source").agg(F.pow(F.count("*"), F.lit(power)).alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """``(source, rate, parts, cdf)``: mean repetitions of a source's documents.

    The rates make the expected number of rows ``total`` (as many as there are
    now, if None), dealt out by the weights of the sources that have rows. A null
    source is a source. Sources without a weight, or with one that is null or
    not above 0, have rate 0; of repeated weights the largest counts. ``cdf``
    holds the Poisson distribution of rate / parts until it reaches 1.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    given = weights.groupBy(F.col("source").alias("_s")).agg(F.max("weight").cast("double").alias("_w"))
    joined = saved(sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left"), "sources")
    known = joined.withColumn("weight", F.when(F.col("_w") > 0, F.col("_w")).otherwise(0.0))
    sums = known.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    rows, weight = float(sums.n or 0), float(sums.w or 0.0)
    scale = (rows if total is None else total) / weight if weight else 0.0
    mean = F.col("rate") / F.col("parts")
    # k from 1 until the tail is below the smallest step of the hash
    steps = F.sequence(F.lit(1), F.ceil(mean + F.lit(12) * F.sqrt(mean) + F.lit(40)).cast("int"))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))
    walk = F.aggregate(
        steps,
        start,
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            (a["sum"] + a["p"] * mean / k).alias("sum"),
            F.concat(a["all"], F.array(a["sum"] + a["p"] * mean / k)).alias("all"),
        ),
        lambda a: a["all"],
    )
    return (
        known.withColumn("rate", F.lit(scale) * F.col("weight") / F.col("n"))
        .withColumn("parts", F.greatest(F.ceil(F.col("rate") / F.lit(_PART)), F.lit(1)).cast("int"))
        .select("source", "rate", "parts", walk.alias("cdf"))
    )


def row_digest(docs: DataFrame) -> Column:
    """MD5 of a row: for each column ``-`` if null, else the bytes of its text, a colon and the text."""
    parts = []
    for c in docs.columns:
        value = F.col(f"`{c}`").cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.md5(F.concat(*parts))


def draw_keys(docs: DataFrame) -> DataFrame:
    """``(d, _k, _none, key)``: each row as a struct, its source, and a key that no other row has.

    It is the id where that occurs once. Rows that share an id, or have none, take
    their digest and a number among equal rows with it. Equal rows are counted
    before they are moved and dealt out again in blocks, so a hot id or row is
    spread over tasks; ids that repeat are looked up in a table of their own.
    """
    source = [F.coalesce("source", F.lit("")).alias("_k"), F.col("source").isNull().alias("_none")]
    own = [whole(docs).alias("d"), *source, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id")]
    row = ["d", "_k", "_none"]
    keyed = docs.select(*own, F.col("doc_id").isNull().alias("_null"))
    counted = keyed.groupBy("id").agg(F.count("*").alias("n"), F.max("_null").alias("_null"))
    often = saved(counted.filter("n > 1 or _null").select("id", F.lit(True).alias("_often")), "repeated-ids")
    if often.isEmpty():
        return keyed.select(*row, F.col("id").alias("key"))
    marked = join_small(docs.select(*own, row_digest(docs).alias("h")), often, "id", "left")
    once = marked.filter("_often is null").select(*row, F.col("id").alias("key"))
    equal = marked.filter("_often").groupBy("id", "h", "_k", "_none").agg(F.first("d").alias("d"), F.count("*").alias("n"))
    blocks = equal.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _BLOCK))))
    rows = blocks.repartition("id", "h", "block").withColumn(
        "at", F.explode(F.sequence(F.col("block") * _BLOCK + 1, F.least("n", (F.col("block") + 1) * _BLOCK)))
    )
    return once.unionByName(rows.select(*row, F.concat_ws(":", "id", "h", "at").alias("key")))


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """Documents repeated by Poisson counts and shuffled: ``docs`` plus ``copy`` and ``shuffle_key``.

    A row's count inverts the Poisson distribution with its source's mean at a
    number hashed from ``seed`` and its key, so it is the same on every run and
    machine; means above 32 add several such counts. The key is the id, or, where
    ids repeat or are null, one of the row's own (``draw_keys``): every row is drawn
    for itself. ``copy`` runs from 1 to the count. Rows are dealt to partitions by a
    hash of (seed, key, copy) and sorted by it there, which no source or order of
    the input can sway. Without ``weights`` the sources are ``tempered``. Columns
    named copy and shuffle_key are replaced. The look-up of the sources is broadcast
    if it is counted to be small, else joined with AQE splitting the hot sources.
    """
    docs = docs.drop("copy", "shuffle_key")
    table = saved(rates(docs, tempered(docs) if weights is None else weights, total), "rates")
    look = table.select(F.coalesce("source", F.lit("")).alias("_k"), F.col("source").isNull().alias("_none"), "parts", "cdf")
    joined = join_small(draw_keys(docs), look, ["_k", "_none"], rows=50_000)
    draws = F.transform(
        F.sequence(F.lit(1), F.col("parts")),
        lambda part: F.size(F.filter(F.col("cdf"), lambda c: c < uniform(F.lit(seed), F.col("key"), part))),
    )
    count = F.aggregate(draws, F.lit(0), lambda a, x: a + x)
    digest = F.md5(F.concat_ws(":", F.lit(f"{seed}s"), "key", "copy"))
    copies = (
        joined.select("d", "key", count.alias("n"))
        .filter("n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .select("d", "copy", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("shuffle_key"))
    )
    dealt = copies.repartition(partitions, "shuffle_key") if partitions else copies.repartition("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key", "d.doc_id", "copy").select("d.*", "copy", "shuffle_key")


def mix_sql(columns: Sequence[str], seed: int = 17, power: float = 0.5) -> str:
    """DuckDB SQL for ``mix`` of a table ``docs`` with ``columns``, tempered sources and rates below 32."""
    digest = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)
    return f"""
sizes AS (SELECT source, count(*) AS n, pow(count(*), {power}) AS w FROM docs GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM sizes) / (SELECT sum(w) FROM sizes) * w / n AS rate FROM sizes),
terms AS (
  SELECT source, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END AS p
  FROM rates, range(0, 160) t(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
digests AS (SELECT *, md5({digest}) AS h, count(*) OVER (PARTITION BY doc_id) AS same FROM docs),
keyed AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND same = 1 THEN doc_id::VARCHAR
    ELSE coalesce(doc_id::VARCHAR, 'null') || ':' || h || ':' || row_number() OVER (PARTITION BY doc_id, h) END AS key FROM digests),
draws AS (SELECT key, source, (('0x' || substr(md5('{seed}:' || key || ':1'), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS u FROM keyed),
counts AS (SELECT d.key, count(*) AS n FROM draws d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c < d.u GROUP BY d.key)
SELECT {", ".join(f"keyed.{c}" for c in columns)}, i.copy::INTEGER AS copy,
  ('0x' || substr(md5('{seed}s:' || keyed.key || ':' || i.copy), 1, 15))::BIGINT AS shuffle_key
FROM keyed JOIN counts ON keyed.key = counts.key, range(1, counts.n + 1) i(copy)"""
