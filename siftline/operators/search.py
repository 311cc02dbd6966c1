"""Search planning and the merge of shard hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.keys import content_hash, hit_id, hit_name
from siftline.ordering import first_per_key, last_per_key, ordered_groups, top_k, top_k_per_group

# Databases searched per polymer, in merge order.
DATABASES = {
    "protein": {"unpaired": ("uniref90", "small_bfd", "mgnify"), "paired": ("uniprot",)},
    "rna": {"unpaired": ("rfam", "rnacentral", "ntrna"), "paired": ()},
}


def plan_assemblies(chains: DataFrame) -> DataFrame:
    """Distinct (polymer, sequence) with the fields any chain still needs.

    ``chains`` has polymer, sequence, unpaired_present, paired_present.
    """
    unpaired = ~F.col("unpaired_present")
    paired = (F.col("polymer") == "protein") & ~F.col("paired_present")
    return (
        chains.groupBy("polymer", "sequence")
        .agg(
            F.bool_or(unpaired).alias("include_unpaired"),
            F.bool_or(paired).alias("include_paired"),
        )
        .filter("include_unpaired or include_paired")
    )


def plan_searches(assemblies: DataFrame) -> DataFrame:
    """Distinct (polymer, sequence, database) searches of the assemblies."""
    def names(polymer: str, field: str) -> Column:
        flag = F.col(f"include_{field}")
        listed = [F.lit(d) for d in DATABASES[polymer][field]]
        return F.when(flag, F.array(*listed).cast("array<string>")).otherwise(
            F.array().cast("array<string>")
        )

    by_polymer = {p: F.concat(names(p, "unpaired"), names(p, "paired")) for p in DATABASES}
    databases = F.when(F.col("polymer") == "protein", by_polymer["protein"]).when(
        F.col("polymer") == "rna", by_polymer["rna"]
    )
    return assemblies.select("polymer", "sequence", F.explode(databases).alias("database"))


def plan_tasks(chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(searches, assemblies) of a set of chains."""
    assemblies = plan_assemblies(chains)
    return plan_searches(assemblies), assemblies


def missing(planned: DataFrame, cached: DataFrame, on: Sequence[str]) -> DataFrame:
    """Planned work that has no cached result."""
    return planned.join(cached.select(*on), list(on), "left_anti")


def group_chains(tasks: DataFrame, identity: str, index: str = "chain_index", **sizes: int) -> DataFrame:
    """Ordered chain indices per task identity: (identity, segment, items)."""
    return ordered_groups(tasks, [identity], [index], F.col(index), **sizes)


def parse_hits(lines: DataFrame, line: str = "value") -> DataFrame:
    """Hit rows of whitespace-separated result lines; a short line fails the query.

    Fields 1-15 are positional, the rest of the line stays in one piece.
    """
    text, keep = F.col(line), [c for c in lines.columns if c != line]
    short = F.raise_error(F.concat(F.lit("invalid hit row: "), text))
    fields = F.split(F.ltrim(text), r"\s+", 16)
    # explode: a filter on a parsed column must not repeat the split below it
    return (
        lines.filter((text != "") & ~text.startswith("#"))
        .select(*keep, line, F.explode(F.array(fields)).alias("_f"))
        .select(*keep, F.when(F.size("_f") < 14, short.cast("array<string>")).otherwise(F.col("_f")).alias("_f"))
        .select(
            *keep,
            hit_id(F.col("_f")).alias("hit_id"),
            F.col("_f")[12].cast("double").alias("e_value"),
            F.col("_f")[13].cast("double").alias("score"),
            F.try_element_at("_f", F.lit(16)).alias("description"),
        )
    )


def join_hits(
    alignments: DataFrame, hits: DataFrame, order: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Alignments with the last score row of their hit; others are dropped.

    ``alignments`` has description (its first word is the hit id).
    """
    on = [*keys, "hit_id"]
    scores = last_per_key(hits.select(*on, "e_value", "score", *order), on, order).drop(*order)
    named = alignments.withColumn("hit_id", hit_name(F.col("description")))
    return named.join(scores, on)


_HIT_ORDER = ("e_value", "score", "hit_id")


def merge_top_k(rows: DataFrame, max_sequences: int, query: Sequence[str] = ()) -> DataFrame:
    """Best ``max_sequences - 1`` hits over all shards, ranked.

    Order is (e-value, score descending, hit id). Give ``query`` to rank each
    query on its own.
    """
    if max_sequences <= 1:
        raise ValueError("max_sequences must be greater than one")
    e_value, score, name = (F.col(c) for c in _HIT_ORDER)
    order = [e_value.asc(), score.desc(), name.asc()]
    if query:
        return top_k_per_group(rows, query, order, max_sequences - 1)
    return top_k(rows, order, max_sequences - 1)


def stack_databases(
    hits: DataFrame,
    databases: Sequence[str],
    order: Sequence[str],
    query: Sequence[str] = (),
    sequence: str = "sequence",
    database: str = "database",
    distinct: bool = True,
) -> DataFrame:
    """Hits with their place in a fixed order of databases; others are left out.

    With ``distinct`` the first hit of each sequence stays, else all do.
    """
    listed = F.array(*[F.lit(d) for d in databases])
    ranked = hits.withColumn("database_order", F.array_position(listed, F.col(database))).filter(
        "database_order > 0"
    )
    if not distinct:
        return ranked
    digest = content_hash(F.col(sequence))
    return first_per_key(
        ranked.withColumn("_digest", digest), [*query, "_digest"], ["database_order", *order]
    ).drop("_digest")


def filter_templates(
    hits: DataFrame,
    cutoff: str,
    query: Sequence[str] = ("query",),
    min_length: int = 10,
    min_align: float = 0.1,
    max_sub: float = 0.95,
    k: int = 4,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Template hits released by ``cutoff``, long and aligned enough, best ``k`` per query.

    ``hits`` has release_date, hit_sequence, align_ratio, sub_ratio, e_value, name.
    Of equal hit sequences of a query the best stays.
    """
    order = list(order or [F.col("e_value").asc(), F.col("name").asc()])
    kept = hits.filter(
        (F.col("release_date") <= F.lit(cutoff).cast("date"))
        & (F.length("hit_sequence") >= min_length)
        & (F.col("align_ratio") >= min_align)
        & (F.col("sub_ratio") <= max_sub)
    )
    return best_distinct(kept, query, "hit_sequence", order, k)


def best_distinct(
    df: DataFrame, keys: Sequence[str], distinct: str, order: Sequence[Column], k: int
) -> DataFrame:
    """Best ``k`` rows per key after keeping the best row of each ``distinct`` value."""
    once = top_k_per_group(df, [*keys, distinct], order, 1, "_once").drop("_once")
    return top_k_per_group(once, keys, order, k)
