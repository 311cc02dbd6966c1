"""Ranking of designs and predictions, and the checks around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.keys import candidate_key, row_key
from siftline.functions.numbers import composite_score, first_metric, softmax
from siftline.ordering import add_index, last_per_key, top_k
from siftline.schemas import RANKED

# Rank metrics in order of preference, by design mode; failure prefixes.
BINDER_METRICS = ["iptm", "ranking_score"]
OTHER_METRICS = ["iptm_A_C", "chain_A_iptm", "iptm", "ranking_score"]
MODEL_PREFIX = r"\A(?:Average|[1-5])_"


def rank_designs(
    structures: DataFrame,
    scores: Sequence[tuple[DataFrame, Sequence[str]]],
    mode: str = "binder",
    dockq_min: float = 0.49,
) -> DataFrame:
    """Score structures from docking, prediction and interface tables.

    ``structures`` has filename. ``scores`` lists (table, order columns); within
    a kind of score the last row of a key counts, and a later table beats an
    earlier one. A docking score at or below ``dockq_min`` drops the structure.
    """
    def present(df: DataFrame, c: str) -> Column:
        return F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull() if c in df.columns else F.lit(False)

    metrics = BINDER_METRICS if mode == "binder" else OTHER_METRICS
    wanted = {"dockq": ["dockq"], "iptm": metrics, "interface_score": ["interface_score"]}
    best: dict[str, DataFrame] = {}
    for n, (table, order) in enumerate(scores):
        for kind, columns in wanted.items():
            if kind == "iptm":
                usable = F.lit(any("iptm" in c.lower() for c in table.columns))
            else:
                usable = present(table, kind)
            raw = [c for c in columns if c in table.columns]
            # a later table with other iptm columns still takes the place of an earlier score
            if not raw and not (kind == "iptm" and any("iptm" in c.lower() for c in table.columns)):
                continue
            rows = table.filter(usable).select(
                row_key(table).alias("design"), *raw, F.struct(*order).alias("_order")
            )
            # the value is parsed after the last row is picked: others may be no numbers
            last = last_per_key(rows, ["design"], ["_order"])
            value = first_metric(last, raw) if raw else F.lit(None).cast("double")
            last = last.select("design", F.lit(n).alias("_table"), value.alias(kind))
            best[kind] = best[kind].unionByName(last) if kind in best else last
    out = structures.select("filename", candidate_key(F.col("filename")).alias("design"))
    for kind in wanted:
        if kind in best:
            out = out.join(last_per_key(best[kind], ["design"], ["_table"]).drop("_table"), "design", "left")
        else:
            out = out.withColumn(kind, F.lit(None).cast("double"))
    score = composite_score(F.col("dockq"), F.col("iptm"), F.col("interface_score"))
    return (
        out.filter(F.col("dockq").isNull() | ~(F.col("dockq") <= dockq_min))
        .withColumn("rank_score", score)
        .filter("rank_score is not null")
        .select(*RANKED.names)
    )


def sort_scores(df: DataFrame, score: str, ties: Sequence[str]) -> DataFrame:
    """Descending by score; ``ties`` makes the order total."""
    return df.orderBy(F.desc(score), *ties)


def rank_by(df: DataFrame, score: str, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """Rank 1..n by descending score."""
    return add_index(df, [F.desc(score), *[F.asc(t) for t in ties]], 1, name)


def total_rank(ranking: DataFrame, name: str = "rank") -> DataFrame:
    """Predictions numbered by (score descending, seed, sample)."""
    return rank_by(ranking, "ranking_score", ["seed", "sample_index"], name)


def best_row(ranking: DataFrame) -> DataFrame:
    """The first prediction of that order."""
    return top_k(
        ranking, [F.desc("ranking_score"), F.asc("seed"), F.asc("sample_index")], 1
    ).drop("rank")


def expected_grid(seeds: DataFrame, samples: int) -> DataFrame:
    """Every seed with every sample index, by expanding each seed row."""
    return seeds.select("seed").distinct().withColumn(
        "sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    )


def grid_check(seeds: DataFrame, samples: int, observed: DataFrame) -> DataFrame:
    """(seed, sample_index, n, status) with status ok, missing, extra or duplicate."""
    seen = observed.groupBy("seed", "sample_index").agg(F.count("*").alias("n"))
    wanted = expected_grid(seeds, samples).withColumn("_wanted", F.lit(True))
    joined = wanted.join(seen, ["seed", "sample_index"], "full_outer")
    status = (
        F.when(F.col("n").isNull(), "missing")
        .when(F.col("_wanted").isNull(), "extra")
        .when(F.col("n") > 1, "duplicate")
        .otherwise("ok")
    )
    return joined.select(
        "seed", "sample_index", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), status.alias("status")
    )


def check_ranking(
    ranking: DataFrame, seeds: DataFrame, samples: int, best: tuple[int, int] | None = None
) -> DataFrame:
    """Findings on a published ranking: (problem, seed, sample_index).

    ``ranking`` has position (1-based), seed, sample_index, ranking_score.
    Predictions listed twice with one score may stand either way round.
    """
    score = F.col("ranking_score")
    infinite = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    cells = ["seed", "sample_index"]
    bad_score = ranking.filter(infinite).select(F.lit("not_finite").alias("problem"), *cells)
    grid = grid_check(seeds, samples, ranking).filter("status <> 'ok'").select(
        F.col("status").alias("problem"), *cells
    )
    expected = rank_by(ranking, "ranking_score", ["seed", "sample_index", "position"], "_expected")
    ranked = expected.filter(F.col("_expected") != F.col("position"))
    order = ranked.select(F.lit("wrong_order").alias("problem"), *cells)
    out = bad_score.unionByName(grid).unionByName(order)
    if best is not None:
        first = ranking.filter("position = 1").filter(
            (F.col("seed") != best[0]) | (F.col("sample_index") != best[1])
        )
        out = out.unionByName(first.select(F.lit("wrong_best").alias("problem"), *cells))
    return out


def novel_sequences(
    df: DataFrame,
    seen: DataFrame,
    banned: str,
    sequence: str = "sequence",
    order: Sequence[str] = ("sequence_id",),
) -> DataFrame:
    """New sequences without banned letters; the last row of each sequence counts.

    Copies are reduced to one row before the join with what was seen.
    """
    kept = df
    if banned:
        letters = "".join(f"\\{x}" if not x.isalnum() else x for x in banned.upper())
        kept = kept.filter(~F.upper(sequence).rlike(f"[{letters}]"))
    return last_per_key(kept, [sequence], order).join(seen.select(sequence), sequence, "left_anti")


def rule_failures(designs: DataFrame, failed: str = "failed_rules") -> DataFrame:
    """Designs that failed each base rule; model prefixes are folded."""
    base = F.transform(F.col(failed), lambda r: F.regexp_replace(r, MODEL_PREFIX, ""))
    return (
        designs.select(F.explode(F.array_distinct(base)).alias("rule"))
        .groupBy("rule")
        .agg(F.count("*").alias("failures"))
    )


def average_metrics(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric over the models of a design."""
    return df.groupBy(key).agg(*[F.avg(m).alias(f"Average_{m}") for m in metrics])


def match_accepted(
    designs: DataFrame, files: DataFrame, score: str, design: str = "Design", file: str = "file_name"
) -> DataFrame:
    """Ranked designs with an accepted file ``<design>_model<n>.<ext>``.

    A design with several files is ranked once, with its first file.
    """
    named = F.substring_index(F.col(file), "_model", -1)
    key = F.substring(F.col(file), F.lit(1), F.length(file) - F.length(named) - F.lit(len("_model")))
    first = (
        files.filter(F.col(file).contains("_model"))
        .groupBy(key.alias(design))
        .agg(F.min(file).alias(file))
    )
    return rank_by(designs.join(first, design), score, [design], "Rank")


def passing(df: DataFrame, budget: int, flag: str = "pass_filters", rank: str = "final_rank") -> DataFrame:
    """All rows that pass, or the best ``budget`` rows by rank."""
    kept = df.filter(F.col(flag))
    return kept if budget <= 0 else kept.orderBy(rank).limit(budget)


def top_tokens(df: DataFrame, keys: Sequence[str], logits: str, k: int = 5, digits: int = 4) -> DataFrame:
    """Most probable tokens per record: (keys, rank, token, probability).

    Works inside the row: the logits of a record are one array.
    """
    chances = F.transform(
        softmax(F.col(logits)), lambda p, i: F.struct((-p).alias("neg"), i.alias("token"))
    )
    best = F.slice(F.array_sort(chances), 1, k)
    return df.select(*keys, F.posexplode(best).alias("_i", "_t")).select(
        *keys,
        (F.col("_i") + 1).cast("bigint").alias("rank"),
        F.col("_t.token").cast("bigint").alias("token"),
        F.round(-F.col("_t.neg"), digits).alias("probability"),
    )
