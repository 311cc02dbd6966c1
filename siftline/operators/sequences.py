"""Sequence records: statistics, signatures, shards, windows, references."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.digest import LANES, record_digest, square_words, word, wrapped
from siftline.functions.keys import basename, safe_name
from siftline.functions.letters import letter_windows
from siftline.functions.numbers import complement, sequence_flags
from siftline.ordering import add_index, index_by_hash

MAX_IMBALANCE = 0.05
_SALTS = 1024  # word sums stay below 2^63 up to 2^31 records of a salt, copies or not
_PIECE = 1024


def seq_stats(df: DataFrame, by: str, sequence: str = "sequence") -> DataFrame:
    """Records and residues per ``by`` value, and in total (``by`` null, is_total true)."""
    per = df.groupBy(by).agg(
        F.count("*").alias("num_seqs"), F.coalesce(F.sum(F.length(sequence)), F.lit(0)).alias("sum_len")
    )
    # the total is summed from the groups, so the records are read once
    return (
        per.groupingSets([[by], []], by)
        .agg(
            F.sum("num_seqs").alias("num_seqs"),
            F.sum("sum_len").alias("sum_len"),
            (F.grouping(by) == 1).alias("is_total"),
        )
        .select(F.col(by).alias("file"), "is_total", "num_seqs", "sum_len")
    )


def imbalance(stats: DataFrame, size: str = "sum_len") -> DataFrame:
    """Largest relative distance of a shard from the mean, and whether it is allowed."""
    spread = stats.agg(
        F.avg(size).alias("mean"), F.min(size).alias("low"), F.max(size).alias("high")
    )
    worst = F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low")) / F.col("mean")
    return spread.select(
        F.col("mean").alias("mean_len"),
        worst.alias("imbalance"),
        (worst <= MAX_IMBALANCE).alias("balanced"),
    )


def shard_names(spark_df: DataFrame, stem: str, count: int) -> DataFrame:
    """The names ``stem-%05d-of-%05d`` of a shard set."""
    return spark_df.sparkSession.range(count).select(
        F.format_string(f"{stem}-%05d-of-{count:05d}", F.col("id").cast("int")).alias("name")
    )


def shard_gate(source: DataFrame, shards: DataFrame, names: DataFrame) -> DataFrame:
    """Findings on shard statistics: (problem, name).

    ``source`` and ``shards`` have file, num_seqs, sum_len; ``names`` has name.
    """
    had = shards.withColumn("name", basename(F.col("file")))
    lost = names.join(had.select("name"), "name", "left_anti").select(F.lit("missing_shard").alias("problem"), "name")
    odd = had.select("name").join(names, "name", "left_anti").select(F.lit("unknown_shard").alias("problem"), "name")
    both = source.select("num_seqs", "sum_len", F.lit(1).alias("side")).unionByName(
        had.select("num_seqs", "sum_len", F.lit(-1).alias("side"))
    )
    totals = both.agg(
        *[F.sum(F.col(c) * F.col("side")).alias(c) for c in ("num_seqs", "sum_len")]
    )
    unequal = totals.select(
        F.explode(
            F.array_compact(
                F.array(
                    *[F.when(F.col(c) != 0, f"{c}_differs") for c in ("num_seqs", "sum_len")]
                )
            )
        ).alias("problem"),
        F.lit(None).cast("string").alias("name"),
    )
    skewed = imbalance(had).filter("not balanced").select(
        F.lit("imbalance").alias("problem"), F.lit(None).cast("string").alias("name")
    )
    return lost.unionByName(odd).unionByName(unequal).unionByName(skewed)


def multiset_signature(
    df: DataFrame, header: str = "header", sequence: str = "sequence", by: Sequence[str] = ()
) -> DataFrame:
    """Order-free signature of a record multiset, per ``by`` group.

    Counts, byte totals and, for each 64-bit lane of the record digests, the sum
    modulo 2^64, the XOR, and the sum of squares modulo 2^64. Words of 32 bits
    are summed as longs per salt, so a group of any size is spread over tasks
    and no long overflows; the few salted rows are then added as decimals.
    """
    digest = record_digest(F.col(header), F.col(sequence))
    head, body = F.octet_length(F.col(header).cast("binary")), F.octet_length(F.col(sequence).cast("binary"))
    words = df.select(
        *by,
        head.cast("bigint").alias("_header"),
        body.cast("bigint").alias("_sequence"),
        digest.alias("_digest"),
    ).select(
        *by,
        "_header",
        "_sequence",
        F.pmod(F.xxhash64("_digest", F.spark_partition_id()), F.lit(_SALTS)).alias("_salt"),
        *[word("_digest", i).alias(f"_w{i}") for i in range(2 * LANES)],
    )
    lanes = [(f"_w{2 * i + 1}", f"_w{2 * i}") for i in range(LANES)]  # high and low word
    parts = {}
    for i, (high, low) in enumerate(lanes):
        parts[f"_qh{i}"], parts[f"_ql{i}"] = square_words(high, low)
    squares = [(f"_qh{i}", f"_ql{i}") for i in range(LANES)]
    sums = [c for pair in (*lanes, *squares) for c in pair]
    xors = [c for pair in lanes for c in pair]
    salted = words.withColumns(parts).groupBy(*by, "_salt").agg(
        F.expr("count(*) as _n"),
        *[F.expr(f"sum({c}) as {c}") for c in ("_header", "_sequence", *sums)],
        *[F.expr(f"bit_xor({c}) as _x{c}") for c in xors],
    )

    def total(c: str) -> str:
        return f"coalesce(sum(cast({c} as decimal(20,0))), 0)"

    def xor(c: str) -> str:
        return f"coalesce(bit_xor(_x{c}), 0)"

    finals = {f"sum_{i}": wrapped(total(h), total(w)) for i, (h, w) in enumerate(lanes)}
    finals |= {f"xor_{i}": wrapped(xor(h), xor(w)) for i, (h, w) in enumerate(lanes)}
    finals |= {f"square_{i}": wrapped(total(h), total(w)) for i, (h, w) in enumerate(squares)}
    counts = {"records": "_n", "header_bytes": "_header", "sequence_bytes": "_sequence"}
    return salted.groupBy(*by).agg(
        *[F.expr(f"coalesce(sum({c}), 0) as {name}") for name, c in counts.items()],
        *[value.alias(name) for name, value in finals.items()],
    )


def same_records(left: DataFrame, right: DataFrame, header: str = "header", sequence: str = "sequence") -> DataFrame:
    """One row: do both tables hold the same records with the same counts?"""
    sides = left.select(header, sequence, F.lit("left").alias("_side")).unionByName(
        right.select(header, sequence, F.lit("right").alias("_side"))
    )
    signed = multiset_signature(sides, header, sequence, ["_side"])
    measures = [c for c in signed.columns if c != "_side"]
    apart = signed.groupBy(*measures).agg(F.count("*").alias("_n"))
    return apart.agg(
        F.coalesce(F.max("_n") == F.sum("_n"), F.lit(True))
        .alias("_one"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_sides"),
    ).select(((F.col("_sides") == 0) | (F.col("_one") & (F.col("_sides") == 2))).alias("same"))


def exact_differences(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Records whose counts differ: (columns, left_n, right_n)."""
    sides = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return (
        sides.groupBy(*columns)
        .agg(F.sum("_l").alias("left_n"), F.sum("_r").alias("right_n"))
        .filter("left_n <> right_n")
    )


_HASH_BITS = 60


def permutation_key(ordinal: Column, seed: int) -> Column:
    """Uniform 60-bit number of a record ordinal under a seed."""
    text = F.concat(F.lit(f"{seed}:"), ordinal.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def permute(df: DataFrame, ordinal: str, seed: int = 23, name: str = "position") -> DataFrame:
    """Zero-based place of every record in a reproducible permutation.

    ``ordinal`` is unique; every occurrence appears once.
    """
    return index_by_hash(df, permutation_key(F.col(ordinal), seed), [ordinal], _HASH_BITS, name=name)


def permute_to_shards(df: DataFrame, ordinal: str, shards: int, seed: int = 23) -> DataFrame:
    """Permuted records dealt to shards, with their place in the shard."""
    placed = permute(df, ordinal, seed)
    return placed.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn(
        "place", F.floor(F.col("position") / shards).cast("bigint")
    )


def chunk(df: DataFrame, order: Sequence[Column | str], k: int, name: str = "chunk") -> DataFrame:
    """At most ``k`` contiguous chunks of ceil(n / k) rows."""
    indexed = add_index(df, order, 0, "_i", total="_n")
    size = F.ceil(F.col("_n") / F.lit(k))
    return indexed.select(*df.columns, F.floor(F.col("_i") / size).cast("bigint").alias(name))


def stride(df: DataFrame, order: Sequence[Column | str], k: int, name: str = "worker") -> DataFrame:
    """Rows dealt to ``k`` workers in turn."""
    indexed = add_index(df, order, 0, "_i")
    return indexed.select(*df.columns, F.pmod("_i", F.lit(k)).cast("bigint").alias(name))


def tile_windows(df: DataFrame, keys: Sequence[str], sequence: str = "sequence", k: int = 19) -> DataFrame:
    """Every window of ``k`` letters with its one-based position and sense strand.

    The window is the guide strand; targets shorter than ``k`` have none. A
    target is cut into overlapping pieces first: finding a letter in UTF-8 text
    takes time proportional to its position.
    """
    last = F.length(sequence) - k + 1
    pieces = (
        df.filter(last >= 1)
        .select(*keys, sequence, F.explode(F.sequence(F.lit(1), last, F.lit(_PIECE))).alias("_start"))
        .select(
            *keys, "_start", F.substring(F.col(sequence), F.col("_start"), F.lit(_PIECE + k - 1)).alias("_piece")
        )
    )
    return (
        pieces.select("*", F.explode(F.sequence(F.lit(1), F.length("_piece") - k + 1)).alias("_at"))
        .select(*keys, "_start", "_at", F.substring(F.col("_piece"), F.col("_at"), F.lit(k)).alias("siRNA"))
        .select(
            *keys,
            (F.col("_start") + F.col("_at") - 1).cast("bigint").alias("pos"),
            "siRNA",
            complement(F.col("siRNA")).alias("sense"),
        )
    )


def window_summary(
    df: DataFrame,
    keys: Sequence[str],
    sequence: str = "sequence",
    k: int = 19,
    gc_min: float = 0.3,
    gc_max: float = 0.65,
    run: int = 5,
    gc_run: int = 6,
    palindrome: int = 4,
) -> DataFrame:
    """Per key, what ``tile_windows`` and ``add_sequence_flags`` say of all its windows.

    Number of windows, last position, least window, greatest sense strand, and how
    many windows have each flag and any. No window becomes a row: each text's
    letters are compared as arrays inside the tasks, so a text costs its length.
    """
    each = "windows bigint, last_pos bigint, first_window string, last_sense string, gc bigint, run bigint, gc_run bigint, palindrome bigint, func bigint"
    kinds = T.StructType([*df.select(*keys).schema.fields, *T.StructType.fromDDL(each).fields])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [letter_windows(x.as_py(), k, gc_min, gc_max, run, gc_run, palindrome) for x in batch.column(len(keys))]
            columns = list(zip(*found)) if found else [()] * 9
            kind = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], *[pa.array(c, t) for c, t in zip(columns, kind)]], kinds.names
            )

    texts = df.filter(F.length(sequence) >= k).select(*keys, F.col(sequence).cast("string"))
    found = texts.mapInArrow(summed, kinds)
    return found.groupBy(*keys).agg(
        F.sum("windows").alias("windows"),
        F.max("last_pos").alias("last_pos"),
        F.min("first_window").alias("first_window"),
        F.max("last_sense").alias("last_sense"),
        *[F.sum(c).alias(c) for c in ("gc", "run", "gc_run", "palindrome", "func")],
    )


def add_sequence_flags(df: DataFrame, sequence: str = "siRNA", **limits: float) -> DataFrame:
    """Rule flags and func_filter, which is 1 if any rule fails."""
    flags = sequence_flags(F.col(sequence), **limits)
    return df.withColumns(flags).withColumn("func_filter", F.greatest(*flags))


def convert_reference_table(
    df: DataFrame, species: str, transcript: str, species_col: str, sequence_col: str
) -> DataFrame:
    """RNA records of one species from an aligned table: no gaps, U for T."""
    header = F.trim(transcript)
    body = F.translate(F.upper(F.trim(sequence_col)), "T-", "U")
    return (
        df.filter(F.trim(species_col) == species)
        .select(header.alias("header"), body.alias("sequence"))
        .filter("header <> '' and sequence <> ''")
    )


def align_references(utr: DataFrame, orf: DataFrame, keep_all: bool = True) -> DataFrame:
    """Each UTR record with the ORF sequence of the same name, if any."""
    side = orf.select("name", F.col("sequence").alias("orf_sequence"))
    joined = utr.select("name", F.col("sequence").alias("utr_sequence")).join(
        side, "name", "left" if keep_all else "inner"
    )
    return joined


def check_pairs(utr: DataFrame, orf: DataFrame, name: str = "name") -> DataFrame:
    """Safe names that stand for different raw names on the two sides.

    One row per safe name, however many rows share it: the least raw name of
    each side, or the greatest if the least ones are equal.
    """
    both = utr.select(F.lit(True).alias("_utr"), F.col(name).alias("_raw")).unionByName(
        orf.select(F.lit(False).alias("_utr"), F.col(name).alias("_raw"))
    )
    sides = {"utr": F.when(F.col("_utr"), F.col("_raw")), "orf": F.when(~F.col("_utr"), F.col("_raw"))}
    ends = [f(c).alias(f"{side}_{end}") for side, c in sides.items() for end, f in (("low", F.min), ("high", F.max))]
    found = both.groupBy(safe_name(F.col("_raw")).alias("safe_name")).agg(*ends)
    low_differs = F.col("utr_low") != F.col("orf_low")
    return found.filter(low_differs | (F.col("utr_high") != F.col("orf_high"))).select(
        "safe_name",
        *[F.when(low_differs, F.col(f"{side}_low")).otherwise(F.col(f"{side}_high")).alias(f"{side}_name") for side in sides],
    )


def intersect_names(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """Names on both sides."""
    return left.select(name).intersect(right.select(name))


def blocks(df: DataFrame, order: Sequence[Column | str], count: int) -> DataFrame:
    """Rows with a ``block`` of 0..count-1, contiguous in ``order``."""
    return chunk(df, order, count, "block")


def tile_pairs(left: DataFrame, right: DataFrame, right_blocks: int) -> DataFrame:
    """Work list of block pairs with their sizes; rows are never paired up.

    Both sides carry ``block``; the right side was cut into ``right_blocks``. The
    list has one row per pair of blocks, a number set by the caller's block
    counts. A tile's rows are the rows of its two blocks.
    """
    sizes = [
        t.groupBy("block").agg(F.count("*").alias(f"n_{p}")).withColumnRenamed("block", f"{p}_block")
        for p, t in (("left", left), ("right", right))
    ]
    spread = sizes[0].withColumn(
        "right_block", F.explode(F.expr(f"sequence(0L, {right_blocks - 1}L)"))
    )
    return spread.join(sizes[1], "right_block").select(
        "left_block", "right_block", "n_left", "n_right", (F.col("n_left") * F.col("n_right")).alias("pairs")
    )


def tile_of(df: DataFrame, tiles: DataFrame, side: str) -> DataFrame:
    """Rows of one side with the (left_block, right_block) of each tile that needs them."""
    wanted = tiles.select("left_block", "right_block")
    return df.join(wanted, df["block"] == wanted[f"{side}_block"]).drop("block")


def repeats(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows after the first of their value; ``order`` is unique."""
    first = df.groupBy(key).agg(F.min(order).alias(order))
    return df.join(first, [key, order], "left_anti")


def table_facts(df: DataFrame, name: str, content: bool = False) -> DataFrame:
    """Row count and column list of a table; with ``content`` an order-free hash too."""
    facts = [F.lit(name).alias("table_name"), F.col("n").alias("row_count")]
    facts.append(F.lit(",".join(df.columns)).alias("columns"))
    if not content:
        return df.agg(F.count("*").alias("n")).select(*facts)
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    signed = multiset_signature(df.select(F.lit("").alias("header"), row.alias("sequence")))
    lanes = [F.col(c).cast("string") for c in signed.columns]
    return signed.withColumnRenamed("records", "n").select(
        *facts, F.sha2(F.concat_ws(",", *[F.col("n").cast("string"), *lanes[1:]]), 256).alias("content_hash")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def union_loose(*tables: DataFrame) -> DataFrame:
    """Union in which a missing column is null."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    return merged


def union_exact(*tables: DataFrame) -> DataFrame:
    """Union of tables with the same columns; raises if they differ."""
    merged = tables[0]
    for table in tables[1:]:
        if set(table.columns) != set(merged.columns):
            raise ValueError(f"columns differ: {merged.columns} and {table.columns}")
        merged = merged.unionByName(table)
    return merged
