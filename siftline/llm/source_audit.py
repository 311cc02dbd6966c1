"""How the sources of a language differ in their words, in exact integers.

Texts are counted by an Arrow compute pipeline inside ``mapInArrow``: ASCII
lower-casing, splitting by a pattern, dictionary encoding and hash group-bys make
one partial count for each language, source and term of a task. Spark merges them;
the terms of a language are then dealt to shards of bounded size, and each shard
adds up the differences of all pairs of sources over its columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import saved
from siftline.ordering import top_k_per_group

#: What separates terms, least documents of a term, scale and smoothing of shares.
SEPARATOR = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 30
SCALE = 1000  # three times: shares are in 10^-9
SMOOTH = 5
TOP = 50
_PIECE = 1 << 22  # bytes of text counted at once
_HELD = 1 << 19  # partial counts that a task holds before it sends them on
_SHARD = 1 << 18  # counts in a shard
_TILE = 256  # sources on one side of a shard's pairs
_TERMS = 1 << 12  # terms whose shares are laid out at once
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each term by language and source; the empty term marks a group."""
    text, lang, source = (pc.fill_null(c, "") for c in batch.columns)
    pair = pa.table({"lang": lang, "source": source})
    groups = pair.group_by(["lang", "source"]).aggregate([])
    group = pc.index_in(pc.binary_join_element_wise(pc.cast(pc.binary_length(lang), pa.string()), lang, source, ":"), _names(groups))
    parts = pc.split_pattern_regex(pc.ascii_lower(text), pattern=SEPARATOR)
    row, term = pc.list_parent_indices(parts), pc.list_flatten(parts)
    real = pc.greater(pc.binary_length(term), 0)
    row, term = row.filter(real), term.filter(real).dictionary_encode()
    by_row = pa.table({"row": row, "term": term.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    by_row = by_row.append_column("group", group.take(by_row.column("row")))
    done = by_row.group_by(["group", "term"]).aggregate([("count_all", "sum"), ("count_all", "count")])
    found = groups.take(done.column("group"))
    found = pa.table([*found.columns, term.dictionary.take(done.column("term")), done.column("count_all_sum"), done.column("count_all_count")], _NAMES)
    nothing = pa.array(np.zeros(groups.num_rows, np.int64))
    return pa.concat_tables([found, pa.table([*groups.columns, pa.array([""] * groups.num_rows, pa.string()), nothing, nothing], _NAMES)])


_NAMES = ["lang", "source", "term", "n", "docs"]


def _names(groups: pa.Table) -> pa.Array:
    lang, source = groups.column("lang").combine_chunks(), groups.column("source").combine_chunks()
    return pc.binary_join_element_wise(pc.cast(pc.binary_length(lang), pa.string()), lang, source, ":")


def _merged(held: list[pa.Table]) -> pa.Table:
    done = pa.concat_tables(held).group_by(_NAMES[:3]).aggregate([("n", "sum"), ("docs", "sum")])
    return done.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_NAMES)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``_PIECE`` bytes of text; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _PIECE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and rows with the term; a group has also a row of the empty term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for piece in _pieces(batch):
                held.append(_counted(piece))
                rows += held[-1].num_rows
                if rows > _HELD:
                    held = [_merged(held)]
                    rows = held[0].num_rows
                    if rows > _HELD // 2:
                        yield from held[0].to_batches(max_chunksize=1 << 16)
                        held, rows = [], 0
        if held:
            yield from _merged(held).to_batches(max_chunksize=1 << 16)

    picked = docs.select(*[F.col(c).cast("string") for c in (text, lang, source)])
    return picked.mapInArrow(run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """``1 + floor(10^9 (count + 5) / total)``, three digits at a time; exact for totals below 9 * 10^15."""
    rest, out = count + SMOOTH, F.lit(0).cast("bigint")
    for _ in range(3):
        # whole-number division by way of what it leaves
        left = (rest * SCALE) % total
        out = out * SCALE + F.call_function("div", rest * SCALE - left, total)
        rest = left
    return out + 1


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    rest, out = count + SMOOTH, np.zeros(len(count), np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * SCALE, total)
        out = out * SCALE + digits
    return out + 1


def _shard_sums(rows: pa.Table) -> pa.Table:
    """Sum of differences of each pair of sources over the terms of a shard, and how many terms those were.

    Rows without a term name the sources of both sides with their totals.
    """
    head = rows.filter(pc.is_null(rows.column("term")))
    body = rows.filter(pc.is_valid(rows.column("term")))
    at, total, tile = (head.column(c).to_numpy() for c in ("at", "total", "tile"))
    order = np.argsort(at)
    at, total, tile = at[order], total[order], tile[order]
    first, second = rows.column("first")[0].as_py(), rows.column("second")[0].as_py()
    none = _shares(np.zeros(len(at), np.int64), total)
    terms = body.column("term").combine_chunks().dictionary_encode()
    codes = terms.indices.to_numpy()
    by_term = np.argsort(codes, kind="stable")
    codes = codes[by_term]
    column = np.searchsorted(at, body.column("at").to_numpy())[by_term]
    value = _shares(body.column("n").to_numpy()[by_term], total[column])
    left, right = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
    sums = np.zeros((len(left), len(right)), np.int64)
    seen = len(terms.dictionary)
    for start in range(0, seen, _TERMS):
        a, b = np.searchsorted(codes, [start, start + _TERMS])
        laid = np.repeat(none[None, :], min(_TERMS, seen - start), 0)
        laid[codes[a:b] - start, column[a:b]] = value[a:b]
        theirs = laid[:, right]
        for i, c in enumerate(left):
            sums[i] += np.abs(theirs - laid[:, c : c + 1]).sum(0)
    i, j = (x.ravel() for x in np.meshgrid(at[left], at[right], indexing="ij"))
    n = len(i)
    lang = rows.column("lang")[0].as_py()
    return pa.table([pa.array([lang] * n, pa.string()), pa.array(i), pa.array(j), pa.array(sums.ravel()), pa.array(np.full(n, seen, np.int64))], ["lang", "a", "b", "value", "seen"])


def _pairs(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """Difference of each two sources of a language, over all its kept terms."""
    # a source stands in each tile pair that holds its tile: one pair if there are few sources
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("first"), F.greatest("tile", t).alias("second"))))
    placed = groups.filter("total > 0").join(langs.select("lang", "shards"), "lang").withColumn("pair", tiles).select("*", "pair.*")
    # sides of one pair come from both tiles, so each tile pair has every source of its two tiles
    heads = placed.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"), "first", "second", "at", "tile", "total",
        F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"),
    )
    body = kept.join(placed, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"), "first", "second", "at", "tile", "total", "term", "n"
    )
    sums = (
        heads.unionByName(body)
        .groupBy("lang", "shard", "first", "second")
        .applyInArrow(_shard_sums, "lang string, a bigint, b bigint, value bigint, seen bigint")
    )
    # each two once; a shard without a term of either tile adds nothing here
    sums = sums.filter("a < b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    sums = saved(sums, "audit-sums")
    mine = groups.select("lang", "source", F.col("at").alias("x"), "terms", F.col("none").alias("p0"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("y"), F.col("none").alias("q0"))
    both = mine.join(other, "lang").filter("x <> y").withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y"))
    unseen = (F.col("terms") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("p0") - F.col("q0"))
    value = F.coalesce("value", F.lit(0)) + F.coalesce(unseen, F.lit(0))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = both.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return out.withColumn("rank", F.row_number().over(ranked))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far sources of a language are from each other, and by which terms.

    A language keeps the terms that at least ``least_docs`` of its rows hold. A
    term's share in a group is ``1 + floor(10^9 (count + 5) / (N + 5 V))``: N adds
    up the group's counts of the V kept terms. Part ``pair`` has, for each source,
    every other source of the language with the sum of their shares' differences.
    Part ``term`` has the ``top`` terms whose share is above the language's.
    Ranks start at 1 with the largest value; ties go to the smaller item in bytes.

    Null texts, languages and sources are empty ones. A row counts as a document
    even if another has its id. Groups without kept terms take part with the
    shares of count 0; without any kept term all pairs differ by 0. An empty
    table gives no row; columns that are not named take no part.
    """
    counts = saved(term_counts(docs), "audit-counts")
    same = Window.partitionBy("lang", "term")
    kept = counts.filter("term <> ''").select(
        "lang", "source", "term", "n",
        F.sum("docs").over(same).alias("docs"),
        F.sum("n").over(same).alias("all_n"),
        (F.min("source").over(same) == F.col("source")).alias("once"),
    )
    kept = saved(kept.filter(F.col("docs") >= least_docs).drop("docs"), "audit-kept")
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count_if("once").alias("terms"), F.count("*").alias("rows"))
    named = counts.filter("term = ''").select("lang", "source").join(by_group, ["lang", "source"], "left").na.fill(0)
    in_lang = Window.partitionBy("lang")
    zero = F.lit(0).cast("bigint")
    total = F.col("words") + SMOOTH * F.col("terms")
    groups = (
        named.withColumn("terms", F.sum("terms").over(in_lang))
        .withColumn("at", (F.row_number().over(in_lang.orderBy("source")) - 1).cast("bigint"))
        .withColumn("tile", F.floor(F.col("at") / _TILE))
        .withColumn("tiles", F.max("tile").over(in_lang) + 1)
        .withColumn("total", total)
        .withColumn("none", F.when(F.col("total") > 0, share(zero, F.col("total"))).otherwise(1))
    )
    groups = saved(groups, "audit-groups")
    langs = groups.groupBy("lang").agg(
        (F.sum("words") + SMOOTH * F.first("terms")).alias("lang_total"), (F.floor(F.sum("rows") / _SHARD) + 1).alias("shards")
    )
    part = kept.join(groups.select("lang", "source", "total"), ["lang", "source"]).join(langs, "lang")
    above = share(F.col("n"), F.col("total")) - share(F.col("all_n"), F.col("lang_total"))
    terms = part.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value")).filter("value > 0")
    best = top_k_per_group(terms, ["lang", "source"], [F.desc("value"), F.asc("item")], top)
    columns = ("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank"))
    return _pairs(kept, groups, langs).select(*columns).unionByName(best.select(*columns))


def audit_sql(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """``audit`` in DuckDB's SQL."""
    share_sql = "1 + (1000000000::HUGEINT * (coalesce({0}, 0) + 5)) // ({1} + 5 * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT i, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= {least_docs}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(total) AS total FROM n GROUP BY lang),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share_sql.format("c.n", "n.total")} AS p, {share_sql.format("lc.n", "ln.total")} AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) JOIN ln USING (lang) JOIN lc USING (lang, term) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= {top}
"""
