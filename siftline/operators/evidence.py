"""Off-target and toxicity evidence: reductions, flags, final tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.keys import offset_name, seed_slice
from siftline.functions.numbers import to_double
from siftline.ordering import add_index

# Largest score that still counts, by site type (None: any score).
SITE_CUTS = {"6mer": None, "7mer-1a": -0.01, "7mer-m8": -0.02, "8mer-1a": -0.03}
NOT_EVALUATED = -5


def site_cut(
    df: DataFrame,
    site: str = "site_type",
    score: str = "score",
    cuts: Mapping[str, float | None] = SITE_CUTS,
) -> DataFrame:
    """Rows of a known site type whose score is below that type's cut."""
    keep = F.lit(False)
    for kind, cut in cuts.items():
        match = F.col(site) == kind
        keep = keep | (match if cut is None else match & (F.col(score) < cut))
    return df.filter(F.col(score).isNotNull() & keep)


def neg_sum(df: DataFrame, keys: Sequence[str], score: str = "score", name: str = "targetscan_score") -> DataFrame:
    """Negated sum of a score per key."""
    return df.groupBy(*keys).agg((-F.sum(score)).alias(name))


def min_with_text(
    df: DataFrame, key: str, text: str, order: Sequence[Column | str], name: str = "score"
) -> DataFrame:
    """Smallest number per key and the text it was written as.

    The first row in ``order`` wins ties, and is taken where no text is a number.
    """
    value = to_double(F.col(text))
    return (
        df.withColumn("_value", value)
        .groupBy(key)
        .agg(
            F.min_by(
                F.struct(F.col(text), F.col("_value")),
                F.struct(F.col("_value").isNull(), F.col("_value"), *order),
            ).alias("_best")
        )
        .select(key, F.col(f"_best.{text}").alias(f"{name}_text"), F.col("_best._value").alias(name))
    )


def max_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(value).alias(value))


def lse_average(df: DataFrame, keys: Sequence[str], energy: str, digits: int = 2) -> DataFrame:
    """``-log(sum(exp(-energy)))`` and the row count per key.

    Energies are grouped by magnitude so that no exponential overflows; both
    steps are plain sums, combined on the map side, without a join back.
    """
    step = 64.0
    shifted = df.select(*keys, (-F.col(energy)).alias("_x")).withColumn(
        "_top", (F.floor(F.col("_x") / step) + 1) * step
    )
    partial = shifted.groupBy(*keys, "_top").agg(
        F.sum(F.exp(F.col("_x") - F.col("_top"))).alias("_s"), F.count("*").alias("_n")
    )
    peak = F.max("_top").over(Window.partitionBy(*keys))
    scaled = partial.withColumn("_peak", peak).withColumn(
        "_scaled", F.col("_s") * F.exp(F.col("_top") - F.col("_peak"))
    )
    score = -(F.max("_peak") + F.log(F.sum("_scaled")))
    return scaled.groupBy(*keys).agg(
        F.sum("_n").alias("sites"), F.round(score, digits).alias("score")
    )


def off_target_candidates(result: DataFrame, top_n: int = 20, index: str | None = None) -> DataFrame:
    """(name, siRNA) of the candidates sent to the off-target tools.

    Names carry the zero-based row number in ``pos`` order; give ``index`` if the
    table already has it. With ``top_n=-1`` all rows are sent, named from ``pos``.
    """
    if top_n == -1:
        return result.select(offset_name(F.col("pos")).alias("name"), "siRNA")
    if index is None:
        result, index = add_index(result.select("pos", "siRNA", "efficacy"), ["pos", "siRNA"], 0, "_i"), "_i"
    best = result.orderBy(F.desc("efficacy"), F.asc(index)).limit(top_n)
    return best.select(F.concat(F.lit("RNA"), F.col(index).cast("string")).alias("name"), "siRNA")


def apply_evidence(
    result: DataFrame,
    pita: DataFrame,
    targetscan: DataFrame,
    pita_order: Sequence[Column | str],
    pita_min: float = -10.0,
    targetscan_max: float = 1.0,
    top_n: int = 20,
    index: str | None = None,
) -> DataFrame:
    """Add pita_score, targetscan_score and the three-state off_target_filter.

    ``pita`` is (microRNA, Score text, order columns), ``targetscan`` is (siRNA,
    targetscan_score). Both are reduced to one row per candidate before joining.
    """
    evaluated = off_target_candidates(result, top_n, index).select(
        F.col("name").alias("_name"), F.lit(True).alias("_evaluated")
    )
    lowest = min_with_text(pita, "microRNA", "Score", pita_order, "_pita").select(
        F.col("microRNA").alias("_name"), F.col("_pita_text").alias("pita_score"), "_pita"
    )
    highest = max_by_key(targetscan, "siRNA", "targetscan_score").select(
        F.col("siRNA").alias("_name"), F.col("targetscan_score").alias("_targetscan")
    )
    joined = (
        result.withColumn("_name", offset_name(F.col("pos")))
        .join(evaluated, "_name", "left")
        .join(lowest, "_name", "left")
        .join(highest, "_name", "left")
    )
    repaired = F.when(F.col("_pita").isNotNull(), F.coalesce("_targetscan", F.lit(0.0))).otherwise(
        F.col("_targetscan")
    )
    hits = [F.col("_pita") < pita_min, repaired > targetscan_max]
    was = F.lit(True) if top_n == -1 else F.coalesce("_evaluated", F.lit(False))
    return joined.select(
        *result.columns,
        "pita_score",
        repaired.alias("targetscan_score"),
        three_state(was, *hits).alias("off_target_filter"),
    )


def three_state(evaluated: Column, *hits: Column) -> Column:
    """-5 if not evaluated, 1 if any hit, else 0; a null comparison is no hit."""
    any_hit = F.lit(False)
    for hit in hits:
        any_hit = any_hit | F.coalesce(hit, F.lit(False))
    return F.when(~evaluated, NOT_EVALUATED).when(any_hit, 1).otherwise(0)


def apply_toxicity(result: DataFrame, table: DataFrame, below: float = 50.0) -> DataFrame:
    """Look the 6-letter seed up; an unknown seed is not toxic."""
    return (
        result.withColumn("Seed", seed_slice(F.col("siRNA")))
        .join(table.select("Seed", "cell_viability"), "Seed", "left")
        .select(
            *result.columns,
            "Seed",
            "cell_viability",
            F.when(F.col("cell_viability") < below, 1).otherwise(0).alias("toxicity_filter"),
        )
    )


def failed_count(flags: Sequence[str]) -> Column:
    """How many flags are not 0."""
    total = F.lit(0).cast("bigint")
    for flag in flags:
        total = total + (F.col(flag) != 0).cast("bigint")
    return total


def apply_final_filter(
    result: DataFrame, functionality: bool = True, off_target: bool = True, toxicity: bool = True
) -> DataFrame:
    """Set ``filter`` to the number of failed enabled rules."""
    enabled = [
        name
        for name, on in (
            ("func_filter", functionality),
            ("off_target_filter", off_target),
            ("toxicity_filter", toxicity),
        )
        if on
    ]
    return result.drop("filter").withColumn("filter", failed_count(enabled))


def sort_with_text(df: DataFrame, score: str = "Score") -> DataFrame:
    """Ascending by number, then by the whole row as text."""
    return df.orderBy(F.col(score).cast("double"), F.concat_ws("\t", *df.columns))


def sort_pair(*tables: DataFrame) -> DataFrame:
    """Union of hit tables ordered by (refseq, siRNA)."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return merged.orderBy("refseq", "siRNA")
