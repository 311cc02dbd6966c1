"""The candidate screen and the search merge as whole plans, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import evidence as ev
from siftline.operators import search
from siftline.operators.ranking import top_tokens
from siftline.ordering import add_index
from siftline.plans.registry import Tables, query


def screen(
    candidates: DataFrame,
    pita: DataFrame,
    context: DataFrame,
    toxicity: DataFrame,
    pita_order: list[str],
    top_n: int = 20,
    pita_min: float = -10.0,
    targetscan_max: float = 1.0,
    toxic_below: float = 50.0,
    index: str | None = None,
) -> DataFrame:
    """Evidence, toxicity and the final filter of a candidate table, as one plan.

    ``context`` has refseq, siRNA, site_type, score per site.
    """
    sites = ev.neg_sum(ev.site_cut(context), ["refseq", "siRNA"])
    flagged = ev.apply_evidence(
        candidates, pita, sites, pita_order, pita_min, targetscan_max, top_n, index
    )
    return ev.apply_final_filter(ev.apply_toxicity(flagged, toxicity, toxic_below))


SITES = """CASE l_returnflag || l_linestatus WHEN 'AF' THEN '6mer' WHEN 'NO' THEN '7mer-1a'
  WHEN 'RF' THEN '7mer-m8' WHEN 'AO' THEN '8mer-1a' ELSE 'other' END"""

_SITE_SUMS = f"""
WITH sites AS (SELECT l_suppkey AS refseq, 'RNA' || l_partkey AS sirna, {SITES} AS site, -l_discount AS score FROM lineitem),
sums AS (SELECT refseq, sirna, -sum(score) AS targetscan_score FROM sites
  WHERE site = '6mer' OR (site = '7mer-1a' AND score < -0.01) OR (site = '7mer-m8' AND score < -0.02)
    OR (site = '8mer-1a' AND score < -0.03) GROUP BY refseq, sirna)
"""


def _candidates(t: Tables) -> DataFrame:
    return t.part.select(
        (F.col("p_partkey") + 1).alias("pos"),
        F.col("p_type").alias("siRNA"),
        F.col("p_retailprice").alias("efficacy"),
        F.when(F.col("p_size") > 25, 4).otherwise(0).alias("func_filter"),
        F.col("p_partkey").alias("row_number"),
    )


def _pita(t: Tables) -> DataFrame:
    text = F.when(F.col("l_quantity") == 50, "none").otherwise((-F.col("l_quantity")).cast("string"))
    return t.lineitem.select(
        F.concat(F.lit("RNA"), F.col("l_partkey")).alias("microRNA"),
        F.concat(text, F.when(F.col("l_linestatus") == "F", "0").otherwise("")).alias("Score"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
    )


_PITA_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey"]
_PITA_SQL = """
pita_rows AS (
  SELECT 'RNA' || l_partkey AS rna, l_orderkey, l_linenumber, l_suppkey,
    CASE WHEN l_quantity = 50 THEN 'none' ELSE (-l_quantity)::VARCHAR END ||
      CASE WHEN l_linestatus = 'F' THEN '0' ELSE '' END AS txt,
    CASE WHEN l_quantity = 50 THEN NULL ELSE -l_quantity END AS v FROM lineitem),
pita AS (SELECT rna, txt, v FROM pita_rows QUALIFY row_number() OVER (
  PARTITION BY rna ORDER BY v NULLS LAST, l_orderkey, l_linenumber, l_suppkey) = 1)
"""


def _context(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_suppkey").alias("refseq"),
        F.concat(F.lit("RNA"), F.col("l_partkey")).alias("siRNA"),
        F.expr(SITES).alias("site_type"),
        (-F.col("l_discount")).alias("score"),
    )


def _toxicity(t: Tables) -> DataFrame:
    return (
        t.part.groupBy(F.substring("p_type", 2, 6).alias("Seed"))
        .agg((F.min("p_size") * 20 + F.max(F.length("p_type")) * 5).cast("bigint").alias("cell_viability"))
    )


@query(_SITE_SUMS + 'SELECT refseq, sirna AS "siRNA", round(targetscan_score, 6) AS targetscan_score FROM sums')
def site_scores(t: Tables) -> DataFrame:
    sums = ev.neg_sum(ev.site_cut(_context(t)), ["refseq", "siRNA"])
    return sums.withColumn("targetscan_score", F.round("targetscan_score", 6))


@query("WITH " + _PITA_SQL + 'SELECT rna AS "microRNA", txt AS score_text, v AS score FROM pita')
def lowest_with_text(t: Tables) -> DataFrame:
    return ev.min_with_text(_pita(t), "microRNA", "Score", _PITA_ORDER)


@query(
    """SELECT 'RNA' || p_partkey AS name, p_type AS "siRNA" FROM part
ORDER BY p_retailprice DESC, p_partkey LIMIT 50"""
)
def top_candidates(t: Tables) -> DataFrame:
    return ev.off_target_candidates(_candidates(t), 50)


@query(
    _SITE_SUMS
    + ","
    + _PITA_SQL
    + """, best AS (SELECT sirna, max(targetscan_score) AS ts FROM sums GROUP BY sirna),
top AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50),
tox AS (SELECT substr(p_type, 2, 6) AS seed, min(p_size) * 20 + max(length(p_type)) * 5 AS viability
  FROM part GROUP BY 1),
joined AS (
  SELECT p.*, txt, v, CASE WHEN v IS NOT NULL THEN coalesce(ts, 0.0) ELSE ts END AS ts2, t.p_partkey IS NOT NULL AS was, viability
  FROM part p LEFT JOIN top t ON t.p_partkey = p.p_partkey LEFT JOIN pita ON rna = 'RNA' || p.p_partkey
  LEFT JOIN best ON best.sirna = 'RNA' || p.p_partkey LEFT JOIN tox ON seed = substr(p_type, 2, 6)),
flags AS (
  SELECT *, CASE WHEN p_size > 25 THEN 4 ELSE 0 END AS func_filter,
    CASE WHEN NOT was THEN -5 WHEN coalesce(v < -48.5, false) OR coalesce(ts2 > 0.135, false) THEN 1 ELSE 0 END AS off_target_filter,
    CASE WHEN viability < 50 THEN 1 ELSE 0 END AS toxicity_filter FROM joined)
SELECT p_partkey + 1 AS pos, p_type AS "siRNA", p_retailprice AS efficacy, func_filter, txt AS pita_score,
  round(ts2, 6) AS targetscan_score, off_target_filter, substr(p_type, 2, 6) AS "Seed", viability AS cell_viability,
  toxicity_filter, ((func_filter <> 0)::INT + (off_target_filter <> 0)::INT + (toxicity_filter <> 0)::INT)::BIGINT AS filter
FROM flags"""
)
def evidence_flags(t: Tables) -> DataFrame:
    out = screen(
        _candidates(t),
        _pita(t),
        _context(t),
        _toxicity(t),
        _PITA_ORDER,
        top_n=50,
        pita_min=-48.5,
        targetscan_max=0.135,
        index="row_number",
    )
    return out.drop("row_number").withColumn("targetscan_score", F.round("targetscan_score", 6))


@query(
    """WITH tox AS (SELECT substr(p_type, 2, 6) AS seed, min(p_size) * 20 + max(length(p_type)) * 5 AS viability
  FROM part GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, substr(p_type, 2, 6) AS "Seed", viability AS cell_viability,
  CASE WHEN viability < 60 THEN 1 ELSE 0 END AS toxicity_filter
FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN tox ON seed = substr(p_type, 2, 6)"""
)
def seed_lookup(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("siRNA"))
    return ev.apply_toxicity(lines.join(parts, "l_partkey"), _toxicity(t), 60.0).drop("siRNA")


@query(
    """SELECT l_partkey, count(*) AS sites, round(-(max(-e) + ln(sum(exp(-e - m)))), 2) AS score FROM (
  SELECT l_partkey, l_discount * 37.3 AS e, max(-l_discount * 37.3) OVER (PARTITION BY l_partkey) AS m FROM lineitem)
GROUP BY l_partkey"""
)
def lse_average(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", (F.col("l_discount") * 37.3).alias("energy"))
    return ev.lse_average(rows, ["l_partkey"], "energy")


def _hit_lines(t: Tables) -> DataFrame:
    """Result lines as an aligner prints them, one per event."""
    dash = F.lit("-")
    fields = [
        F.concat(F.lit("u"), F.col("user_id")),
        *[dash] * 5,
        F.col("event_id"),
        F.col("event_id") + 9,
        *[dash] * 4,
        F.floor(F.col("value") / 10),
        F.length("props"),
        dash,
        F.concat(F.col("event_type"), F.lit(" hit of "), F.col("user_id")),
    ]
    line = F.concat_ws("  ", *[f.cast("string") for f in fields])
    return t.events.select("event_type", "event_id", line.alias("value"))


def _alignments(t: Tables) -> DataFrame:
    name = F.concat(F.lit("u"), F.col("user_id"), F.lit("/"), F.col("event_id"), F.lit("-"), F.col("event_id") + 9)
    return t.events.select(
        "event_type", F.concat(name, F.lit(" "), F.col("event_type")).alias("description")
    )


_HITS_SQL = """
WITH hits AS (
  SELECT event_type, 'u' || user_id || '/' || event_id || '-' || (event_id + 9) AS hit_id,
    floor(value / 10)::DOUBLE AS e_value, length(props)::DOUBLE AS score FROM events)
"""


@query(
    _HITS_SQL
    + """SELECT hit_id, e_value, score, row_number() OVER (ORDER BY e_value, score DESC, hit_id) AS rank
FROM hits ORDER BY rank LIMIT 100"""
)
def topk_merge(t: Tables) -> DataFrame:
    hits = search.parse_hits(_hit_lines(t)).select("hit_id", "e_value", "score", "event_id")
    merged = search.merge_top_k(search.join_hits(_alignments(t), hits, ["event_id"]), 101)
    return merged.select("hit_id", "e_value", "score", "rank")


@query(
    _HITS_SQL
    + """SELECT event_type, hit_id, e_value, score,
  row_number() OVER (PARTITION BY event_type ORDER BY e_value, score DESC, hit_id) AS rank
FROM hits QUALIFY rank <= 25"""
)
def topk_per_query(t: Tables) -> DataFrame:
    hits = search.parse_hits(_hit_lines(t)).select("event_type", "hit_id", "e_value", "score", "event_id")
    rows = search.join_hits(_alignments(t), hits, ["event_id"], ["event_type"])
    merged = search.merge_top_k(rows, 26, ["event_type"])
    return merged.select("event_type", "hit_id", "e_value", "score", "rank")


@query(
    """SELECT doc_id, source, list_position(['fr', 'en', 'de', 'es'], lang)::BIGINT AS database_order FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY list_position(['fr', 'en', 'de', 'es'], lang), doc_id) = 1"""
)
def stacked_databases(t: Tables) -> DataFrame:
    hits = t.documents.select("doc_id", "source", F.col("lang").alias("database"), F.col("text").alias("sequence"))
    kept = search.stack_databases(hits, ["fr", "en", "de", "es"], ["doc_id"])
    return kept.select("doc_id", "source", F.col("database_order").cast("bigint").alias("database_order"))


def _chains(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("chain_index"),
        F.when(F.col("l_returnflag") == "R", "rna").otherwise("protein").alias("polymer"),
        F.concat_ws("-", F.lit("S"), "l_partkey", "l_suppkey").alias("sequence"),
        (F.col("l_linestatus") == "F").alias("unpaired_present"),
        (F.col("l_discount") > 0.05).alias("paired_present"),
    )


_PLAN_SQL = """
WITH chains AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'rna' ELSE 'protein' END AS polymer,
    'S-' || l_partkey || '-' || l_suppkey AS sequence, l_linestatus <> 'F' AS unpaired,
    l_returnflag <> 'R' AND l_discount <= 0.05 AS paired FROM lineitem),
plan AS (SELECT polymer, sequence, bool_or(unpaired) AS include_unpaired, bool_or(paired) AS include_paired
  FROM chains GROUP BY ALL HAVING bool_or(unpaired) OR bool_or(paired))
"""


@query(_PLAN_SQL + "SELECT * FROM plan")
def plan_assemblies(t: Tables) -> DataFrame:
    return search.plan_tasks(_chains(t))[1]


@query(
    _PLAN_SQL
    + """SELECT polymer, sequence, unnest(
  (CASE WHEN NOT include_unpaired THEN [] WHEN polymer = 'rna' THEN ['rfam', 'rnacentral', 'ntrna']
     ELSE ['uniref90', 'small_bfd', 'mgnify'] END) ||
  (CASE WHEN include_paired THEN ['uniprot'] ELSE [] END)) AS database FROM plan"""
)
def plan_searches(t: Tables) -> DataFrame:
    return search.plan_tasks(_chains(t))[0]


@query(
    """SELECT l_partkey AS identity, 0::BIGINT AS segment, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS chains
FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY l_partkey"""
)
def chains_by_identity(t: Tables) -> DataFrame:
    tasks = t.lineitem.select(F.col("l_partkey").alias("identity"), F.col("l_orderkey").alias("chain_index")).distinct()
    grouped = search.group_chains(tasks, "identity")
    return grouped.select("identity", "segment", F.array_join(F.col("items").cast("array<string>"), ",").alias("chains"))


@query(
    """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS token, unnest(embedding)::DOUBLE AS v FROM embeddings),
p AS (SELECT vec_id, token, exp(v - max(v) OVER w) / sum(exp(v)) OVER w * exp(max(v) OVER w) AS p
  FROM x WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, token) AS rank, token, round(p, 4) AS probability
FROM p QUALIFY rank <= 5"""
)
def topk_softmax(t: Tables) -> DataFrame:
    return top_tokens(t.embeddings, ["vec_id"], "embedding")


@query(
    """SELECT 'RNA' || p_partkey AS name, p_type AS "siRNA", p_retailprice AS efficacy,
  row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part"""
)
def ranked_candidates(t: Tables) -> DataFrame:
    from siftline.functions.keys import offset_name
    from siftline.operators.ranking import sort_scores

    ranked = add_index(
        sort_scores(_candidates(t), "efficacy", ["pos"]), [F.desc("efficacy"), F.asc("pos")], 1, "rank"
    )
    return ranked.select(offset_name(F.col("pos")).alias("name"), "siRNA", "efficacy", "rank")
