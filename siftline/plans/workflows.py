"""The three data flows from their input files to their output tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.rules import default_rules, filename_column
from siftline.operators import manifests as m
from siftline.operators import ranking, search
from siftline.plans.screens import screen
from siftline.schemas import PITA
from siftline.sources import sinks, tables


def screen_files(
    spark: SparkSession,
    candidates: str,
    pita: str | list[str],
    context: str | list[str],
    toxicity: str,
    out: str,
    stem: str,
    **limits: float,
) -> DataFrame:
    """Candidate screen from tool outputs; writes the three ranked tables.

    ``candidates`` is a tab-separated table with pos, sense, siRNA, efficacy and
    func_filter; ``context`` the wide per-site score tables; ``toxicity`` a table
    with Seed and cell_viability.
    """
    table = spark.read.option("sep", "\t").option("header", True)
    rows = table.csv(candidates).withColumns(
        {
            "pos": F.col("pos").cast("bigint"),
            "efficacy": F.col("efficacy").cast("double"),
            "func_filter": F.col("func_filter").cast("int"),
        }
    )
    hits = tables.read_evidence_tsv(spark, pita, PITA.names)
    names = {0: "refseq", 2: "siRNA", 3: "site_type", 27: "score"}
    sites = tables.read_positional(spark, context, names)
    sites = sites.withColumn("score", F.col("score").try_cast("double"))
    seeds = table.csv(toxicity).withColumn("cell_viability", F.col("cell_viability").cast("double"))
    done = screen(rows, hits, sites, seeds, ["RefSeq", "Sites", "Score"], **limits)
    sinks.write_screen(done, out, stem)
    return done


def filter_stage(
    spark: SparkSession,
    manifest_path: str,
    score_paths: str | list[str],
    stage: str,
    out: str,
    config: Mapping[str, object] | None = None,
) -> DataFrame:
    """One filtering stage from a manifest and score CSVs; returns the audit.

    Writes ``manifest`` (retained rows), ``audit`` and ``attrition`` below
    ``out``. Of several scores of a candidate the one in the last file, and
    within a file the last one, counts.
    """
    manifest = tables.read_manifest(spark, manifest_path)
    scores = tables.read_scores(spark, score_paths).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rules = default_rules(stage, config)
    name = filename_column(scores, str((config or {}).get("filename_col") or "description"))
    kept, _, audit = m.filter_with_audit(
        manifest, scores, rules, name, stage, ["_file", "_block", "_row"]
    )
    sinks.write_table(audit, f"{out}/audit")
    written = spark.read.parquet(f"{out}/audit")
    sinks.write_table(m.keep_ids(manifest, written.filter("passed")), f"{out}/manifest")
    sinks.write_table(m.attrition(manifest, written, stage), f"{out}/attrition")
    return written


def rank_stage(
    structures: DataFrame,
    scores: Sequence[tuple[DataFrame, Sequence[str]]],
    out: str,
    mode: str = "binder",
    dockq_min: float = 0.49,
) -> DataFrame:
    """Rank retained structures and write the ranked table with its ranks."""
    ranked = ranking.rank_designs(structures, scores, mode, dockq_min)
    numbered = ranking.rank_by(ranked, "rank_score", ["design", "filename"])
    sinks.write_table(numbered, f"{out}/ranked")
    return numbered


def search_round(
    chains: DataFrame,
    cached: DataFrame,
    lines: DataFrame,
    alignments: DataFrame,
    max_sequences: int,
) -> tuple[DataFrame, DataFrame]:
    """(searches still to run, merged hits per sequence) of a search request.

    ``cached`` lists finished (polymer, sequence, database) searches. ``lines``
    are result lines and ``alignments`` aligned hits of all shards, both with
    query and database; line_no orders the lines. Hits of the unpaired databases
    are stacked without repeated sequences; those of the paired ones all stay.
    """
    searches, _ = search.plan_tasks(chains)
    todo = search.missing(searches, cached, ["polymer", "sequence", "database"])
    hits = search.parse_hits(lines)
    keys = ["query", "database"]
    joined = search.join_hits(alignments, hits, ["line_no"], keys)
    best = search.merge_top_k(joined, max_sequences, keys)
    order = {part: [d for polymer in search.DATABASES.values() for d in polymer[part]] for part in ("unpaired", "paired")}
    stacks = [
        search.stack_databases(best, names, ["rank"], ["query"], "aligned_sequence", distinct=part == "unpaired").withColumn("part", F.lit(part))
        for part, names in order.items()
    ]
    return todo, stacks[0].unionByName(stacks[1])
