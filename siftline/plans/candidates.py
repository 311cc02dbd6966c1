"""Manifest, join and ranking operators bound to the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import keys
from siftline.operators import manifests as m
from siftline.operators import quality, ranking, runs, search
from siftline.operators import sequences as s
from siftline.operators import structures as st
from siftline.ordering import add_index
from siftline.plans.registry import Tables, query


def name(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]


def order_manifest(t: Tables) -> DataFrame:
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'partial' END")
    return t.orders.select(
        name("order-", "o_orderkey").alias("candidate_id"),
        F.concat(F.lit("runs/stage__order-"), F.col("o_orderkey"), F.lit(".pdb")).alias("source_path"),
        F.lit(None).cast("string").alias("derived_path"),
        status.alias("candidate_status"),
    )


def line_scores(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        F.concat(F.lit("artifact__order-"), F.col("l_orderkey"), F.lit("_model.pdb")).alias("filename"),
        "l_extendedprice",
        "l_discount",
        *LINE_ORDER,
    )
    strangers = t.supplier.select(
        F.concat(F.lit("supplier-"), F.col("s_suppkey"), F.lit(".pdb")).alias("filename"),
        F.col("s_acctbal").alias("l_extendedprice"),
        F.lit(0.0).alias("l_discount"),
    )
    return s.union_loose(lines, strangers)


RULES = {"l_extendedprice": "> 20000", "l_discount": {"<=": 0.08}}


def audited(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return m.filter_with_audit(order_manifest(t), line_scores(t), RULES, "filename", "stage1", LINE_ORDER)


_LAST_SCORE = """
WITH ranked AS (
  SELECT 'order-' || l_orderkey AS candidate_id, l_extendedprice, l_discount,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC,
           l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn
  FROM lineitem),
latest AS (
  SELECT candidate_id, l_extendedprice, l_discount FROM ranked WHERE rn = 1
  UNION ALL SELECT 'supplier-' || s_suppkey, s_acctbal, 0.0 FROM supplier),
manifest AS (
  SELECT 'order-' || o_orderkey AS candidate_id,
         'runs/stage__order-' || o_orderkey || '.pdb' AS source_path,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'partial' END AS candidate_status
  FROM orders),
joined AS (
  SELECT coalesce(m.candidate_id, l.candidate_id) AS candidate_id,
         m.candidate_id IS NOT NULL AS known, l.candidate_id IS NOT NULL AS scored,
         coalesce(m.candidate_id IS NOT NULL AND l.l_extendedprice > 20000 AND l.l_discount <= 0.08, false) AS passed,
         l_extendedprice, l_discount
  FROM manifest m FULL OUTER JOIN latest l ON m.candidate_id = l.candidate_id),
audit AS (
  SELECT candidate_id, 'stage1' AS stage_name, passed,
         CASE WHEN NOT known THEN 'missing_manifest' WHEN NOT scored THEN 'missing_score'
              WHEN passed THEN 'passed' ELSE 'filtered' END AS reason,
         CASE WHEN known THEN l_extendedprice END AS metric_l_extendedprice,
         CASE WHEN known THEN l_discount END AS metric_l_discount
  FROM joined)
"""


@query(_LAST_SCORE + "SELECT * FROM audit")
def audit_filter(t: Tables) -> DataFrame:
    return audited(t)[2]


@query(
    _LAST_SCORE
    + """SELECT candidate_id, source_path, candidate_status FROM manifest
WHERE candidate_id IN (SELECT candidate_id FROM audit WHERE passed)"""
)
def audit_retained(t: Tables) -> DataFrame:
    return audited(t)[0].select("candidate_id", "source_path", "candidate_status")


@query(
    _LAST_SCORE
    + """SELECT 'order-' || l_orderkey AS candidate_id, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE 'order-' || l_orderkey IN (SELECT candidate_id FROM audit WHERE passed)"""
)
def audit_retained_scores(t: Tables) -> DataFrame:
    return audited(t)[1].select("candidate_id", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    _LAST_SCORE
    + """SELECT 'stage1' AS stage_name,
  (SELECT count(*) FROM manifest) AS input_candidates,
  (SELECT count(*) FROM audit WHERE passed) AS retained,
  (SELECT count(*) FROM audit WHERE NOT passed) AS rejected,
  (SELECT count(*) FROM manifest WHERE candidate_status = 'failed') AS failed,
  (SELECT count(*) FROM manifest WHERE candidate_status = 'partial') AS partial,
  (SELECT count(*) FROM manifest WHERE candidate_status = 'succeeded') AS succeeded"""
)
def stage_attrition(t: Tables) -> DataFrame:
    return m.attrition(order_manifest(t), audited(t)[2], "stage1")


@query(
    """SELECT o_orderkey, o_custkey AS candidate_id, c_name, c_mktsegment
FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def strict_join(t: Tables) -> DataFrame:
    required = t.orders.select("o_orderkey", F.col("o_custkey").alias("candidate_id"))
    available = t.customer.select(F.col("c_custkey").alias("candidate_id"), "c_name", "c_mktsegment")
    return m.strict_join(required, available, allow_missing=True)


def part_manifest(t: Tables) -> DataFrame:
    label = F.replace("p_name", F.lit(" "), F.lit("_"))
    return t.part.select(
        name("part-", "p_partkey").alias("candidate_id"),
        F.concat(F.lit("in\\\\"), F.lit("/x__"), label, F.lit("-"), F.col("p_partkey"), F.lit(".pdb")).alias("source_path"),
        F.concat(F.lit("out/a_refold-"), label, F.lit("_model.cif")).alias("derived_path"),
        F.col("p_partkey").alias("ordinal"),
    )


_LOOKUP = """
WITH pairs AS (
  SELECT lower(replace(p_name, ' ', '_')) || '-' || p_partkey AS candidate_key, p_partkey FROM part
  UNION ALL SELECT lower(replace(p_name, ' ', '_')), p_partkey FROM part),
lookup AS (
  SELECT candidate_key, 'part-' || min(p_partkey) AS candidate_id FROM pairs GROUP BY candidate_key)
"""


@query(_LOOKUP + "SELECT * FROM lookup")
def key_lookup(t: Tables) -> DataFrame:
    return m.key_lookup(part_manifest(t), ["ordinal"])


@query(
    _LOOKUP
    + """, named AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE l_linenumber WHEN 1 THEN lower(replace(p_name, ' ', '_'))
      WHEN 2 THEN lower(replace(p_name, ' ', '_')) || '-' || p_partkey
      ELSE 'line-' || l_partkey END AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(candidate_id, k) AS candidate_id
FROM named LEFT JOIN lookup ON k = candidate_key"""
)
def attach_ids(t: Tables) -> DataFrame:
    label = F.replace("p_name", F.lit(" "), F.lit("_"))
    file = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("a__"), label, F.lit("_model_scores.csv")))
        .when(F.col("l_linenumber") == 2, F.concat(label, F.lit("-"), F.col("l_partkey"), F.lit("_seed-1_sample-0_model.cif")))
        .otherwise(F.concat(F.lit("d/x_refold-line-"), F.col("l_partkey"), F.lit("_summary_confidences.json")))
    )
    lines = t.lineitem.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    scores = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", file.alias("description"))
    return m.attach_candidate_ids(scores, "description", part_manifest(t), ["ordinal"]).drop("description")


def _customer_refs(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("file_name"))


def _order_models(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select(
        F.col("o_custkey").alias("candidate_id"),
        F.concat(day, F.lit("-"), F.col("o_orderkey").cast("string")).alias("file_name"),
    )


@query(
    """SELECT c_custkey AS candidate_id, c_name AS reference_file_name,
  min(strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey) AS model_file_name
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL"""
)
def pair_files(t: Tables) -> DataFrame:
    return m.pair_by_candidate(_customer_refs(t), _order_models(t), check=False)


@query(
    """SELECT coalesce(c_custkey, o_custkey) AS id,
  CASE WHEN o_custkey IS NULL THEN 'left' ELSE 'right' END AS side
FROM customer FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey
WHERE c_custkey IS NULL OR o_custkey IS NULL"""
)
def pair_check(t: Tables) -> DataFrame:
    return m.diff_both(_customer_refs(t), _order_models(t), "candidate_id")


@query(
    """SELECT c_custkey AS candidate_id, c_name AS file_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def pending_anti(t: Tables) -> DataFrame:
    return m.pending(_customer_refs(t), _order_models(t))


@query(
    """SELECT p_partkey, database FROM (SELECT p_partkey, unnest(['small', 'large']) AS database FROM part) p
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey
  AND CASE WHEN l_quantity < 25 THEN 'small' ELSE 'large' END = database)"""
)
def missing_searches(t: Tables) -> DataFrame:
    planned = t.part.select("p_partkey", F.explode(F.array(F.lit("small"), F.lit("large"))).alias("database"))
    kind = F.when(F.col("l_quantity") < 25, "small").otherwise("large")
    cached = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), kind.alias("database"))
    return search.missing(planned, cached, ["p_partkey", "database"])


@query(
    """SELECT coalesce(n_nationkey, p_size) AS id,
  CASE WHEN p_size IS NULL THEN 'missing' WHEN n_nationkey IS NULL THEN 'unselected' ELSE 'valid' END AS status
FROM nation FULL OUTER JOIN (SELECT DISTINCT p_size FROM part) ON n_nationkey = p_size"""
)
def profile_inventory(t: Tables) -> DataFrame:
    return m.inventory(
        t.nation.select(F.col("n_nationkey").alias("id")), t.part.select(F.col("p_size").alias("id")), "id"
    )


def _seen_grid(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup", "error")])
    return t.events.select(
        F.floor(F.col("value") / 50).cast("int").alias("seed"),
        (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("sample_index"),
    )


@query(
    """WITH seen AS (
  SELECT floor(value / 50)::INTEGER AS seed,
    list_position(['click', 'view', 'purchase', 'signup', 'error'], event_type)::INTEGER - 1 AS sample_index,
    count(*) AS n FROM events GROUP BY ALL),
grid AS (SELECT r_regionkey AS seed, unnest([0, 1, 2, 3, 4, 5]) AS sample_index FROM region)
SELECT coalesce(g.seed, o.seed) AS seed, coalesce(g.sample_index, o.sample_index) AS sample_index,
  coalesce(n, 0) AS n,
  CASE WHEN n IS NULL THEN 'missing' WHEN g.seed IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status
FROM grid g FULL OUTER JOIN seen o ON g.seed = o.seed AND g.sample_index = o.sample_index"""
)
def grid_check(t: Tables) -> DataFrame:
    return ranking.grid_check(t.region.select(F.col("r_regionkey").alias("seed")), 6, _seen_grid(t))


def _customer_ranking(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_nationkey").alias("seed"),
        F.col("c_custkey").alias("sample_index"),
        F.col("c_acctbal").alias("ranking_score"),
    )


@query(
    """SELECT c_nationkey AS seed, c_custkey AS sample_index, c_acctbal AS ranking_score,
  row_number() OVER (ORDER BY c_acctbal DESC, c_nationkey, c_custkey) AS rank FROM customer"""
)
def total_rank(t: Tables) -> DataFrame:
    return ranking.total_rank(_customer_ranking(t))


@query(
    """SELECT c_nationkey AS seed, c_custkey AS sample_index, c_acctbal AS ranking_score
FROM customer ORDER BY c_acctbal DESC, c_nationkey, c_custkey LIMIT 1"""
)
def best_prediction(t: Tables) -> DataFrame:
    return ranking.best_row(_customer_ranking(t))


@query(
    """WITH r AS (
  SELECT s_nationkey AS seed, 0 AS sample_index, s_acctbal AS ranking_score,
    row_number() OVER (ORDER BY floor(s_acctbal) DESC, s_suppkey) AS position FROM supplier),
e AS (SELECT *, row_number() OVER (ORDER BY ranking_score DESC, seed, sample_index) AS expected FROM r)
SELECT 'wrong_order' AS problem, seed, sample_index FROM e WHERE expected <> position
UNION ALL
SELECT CASE WHEN count(seed) = 0 THEN 'missing' ELSE 'duplicate' END, n_nationkey, 0
FROM nation LEFT JOIN r ON n_nationkey = seed GROUP BY n_nationkey HAVING count(seed) <> 1"""
)
def ranking_integrity(t: Tables) -> DataFrame:
    published = add_index(
        t.supplier, [F.floor("s_acctbal").desc(), F.col("s_suppkey").asc()], 1, "position"
    ).select(
        "position",
        F.col("s_nationkey").alias("seed"),
        F.lit(0).alias("sample_index"),
        F.col("s_acctbal").alias("ranking_score"),
    )
    return ranking.check_ranking(published, t.nation.select(F.col("n_nationkey").alias("seed")), 1)


@query(
    """WITH dock AS (
  SELECT l_suppkey AS k, l_discount * 10 AS dockq FROM lineitem WHERE l_discount > 0
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1),
pred AS (
  SELECT o_custkey AS k, round(o_totalprice / 500000, 4) AS iptm FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
iface AS (
  SELECT c_custkey AS k, c_acctbal AS interface_score FROM customer WHERE c_mktsegment <> 'BUILDING'),
joined AS (
  SELECT 'supplier-' || s_suppkey AS design, 'runs/stage__supplier-' || s_suppkey || '_model.pdb' AS filename,
    dockq, iptm, interface_score FROM supplier
  LEFT JOIN dock ON dock.k = s_suppkey LEFT JOIN pred ON pred.k = s_suppkey
  LEFT JOIN iface ON iface.k = s_suppkey),
scored AS (SELECT *, coalesce(100 * iptm - interface_score, dockq, iptm) AS rank_score FROM joined
  WHERE dockq IS NULL OR dockq > 0.49)
SELECT design, filename, rank_score, dockq, iptm, interface_score,
  row_number() OVER (ORDER BY rank_score DESC, design) AS rank FROM scored WHERE rank_score IS NOT NULL"""
)
def rank_designs(t: Tables) -> DataFrame:
    structures = t.supplier.select(
        F.concat(F.lit("runs/stage__supplier-"), F.col("s_suppkey"), F.lit("_model.pdb")).alias("filename")
    )
    dock = t.lineitem.select(
        F.concat(F.lit("Supplier-"), F.col("l_suppkey"), F.lit(".pdb")).alias("reference"),
        F.when(F.col("l_discount") > 0, (F.col("l_discount") * 10).cast("string")).otherwise("").alias("dockq"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )
    prediction = t.orders.select(
        F.concat(F.lit("supplier-"), F.col("o_custkey"), F.lit("_seed-1_sample-0_model.cif")).alias("description"),
        F.round(F.col("o_totalprice") / 500000, 4).alias("iptm"),
        "o_orderkey",
    )
    interface = t.customer.select(
        F.lit("").alias("candidate_id"),
        name("supplier-", "c_custkey").alias("name"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("interface_score"),
    )
    ranked = ranking.rank_designs(
        structures,
        [
            (dock, ["l_orderkey", "l_linenumber", "l_partkey"]),
            (prediction, ["o_orderkey"]),
            (interface, ["name"]),
        ],
    )
    return ranking.rank_by(ranked, "rank_score", ["design"])


@query(
    """WITH f AS (
  SELECT 'part-' || l_partkey AS "Design", min('part-' || l_partkey || '_model' || l_linenumber || '.pdb') AS file_name
  FROM lineitem GROUP BY l_partkey)
SELECT f."Design", p_retailprice, file_name,
  row_number() OVER (ORDER BY p_retailprice DESC, f."Design") AS "Rank"
FROM part JOIN f ON 'part-' || p_partkey = f."Design" """
)
def accepted_rank(t: Tables) -> DataFrame:
    designs = t.part.select(name("part-", "p_partkey").alias("Design"), "p_retailprice")
    files = t.lineitem.select(
        F.concat(F.lit("part-"), F.col("l_partkey"), F.lit("_model"), F.col("l_linenumber"), F.lit(".pdb")).alias("file_name")
    )
    return ranking.match_accepted(designs, files, "p_retailprice")


@query(
    """SELECT rule, count(DISTINCT p_partkey) AS failures FROM (
  SELECT p_partkey, 'size' AS rule FROM part WHERE p_size > 25
  UNION ALL SELECT p_partkey, 'size' FROM part WHERE p_size > 40
  UNION ALL SELECT p_partkey, 'price' FROM part WHERE p_retailprice > 950
  UNION ALL SELECT p_partkey, 'brand_10' FROM part WHERE p_brand < 'Brand#2') GROUP BY rule"""
)
def rule_failures(t: Tables) -> DataFrame:
    failed = F.array_compact(
        F.array(
            F.when(F.col("p_size") > 25, "Average_size"),
            F.when(F.col("p_size") > 40, "1_size"),
            F.when(F.col("p_retailprice") > 950, "2_price"),
            F.when(F.col("p_brand") < "Brand#2", "brand_10"),
        )
    )
    return ranking.rule_failures(t.part.select(failed.alias("failed_rules")))


@query(
    """SELECT l_partkey, avg(l_quantity) AS "Average_l_quantity", avg(round(l_extendedprice * 100)) AS "Average_cents"
FROM lineitem GROUP BY l_partkey"""
)
def average_models(t: Tables) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).alias("cents")
    models = t.lineitem.select("l_partkey", "l_quantity", cents)
    return ranking.average_metrics(models, "l_partkey", ["l_quantity", "cents"])


@query(
    """SELECT p_type, count(*) AS total_trajectories, count(*) FILTER (p_size > 45) AS passing_designs
FROM part GROUP BY p_type"""
)
def pass_counts(t: Tables) -> DataFrame:
    return runs.run_counts(t.part, t.part.filter("p_size > 45"), "p_type")


@query(
    """SELECT p_partkey, p_size FROM part WHERE p_size > 45 ORDER BY p_retailprice DESC, p_partkey LIMIT 30"""
)
def passing_top(t: Tables) -> DataFrame:
    flagged = t.part.select(
        "p_partkey",
        "p_size",
        (F.col("p_size") > 45).alias("pass_filters"),
        F.struct((-F.col("p_retailprice")).alias("a"), F.col("p_partkey").alias("b")).alias("final_rank"),
    )
    return ranking.passing(flagged, 30).select("p_partkey", "p_size")


@query(
    """SELECT doc_id, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text) AND NOT regexp_matches(text, '[zZ]')
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1"""
)
def novel_records(t: Tables) -> DataFrame:
    return ranking.novel_sequences(t.documents, t.benchmark, "Z", "text", ["doc_id"]).select("doc_id", "n_chars")


@query(
    """WITH h AS (
  SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority || '/' || o_orderstatus AS hit_sequence FROM orders
  WHERE o_orderdate::DATE <= DATE '1997-06-30' AND length(o_orderpriority || '/' || o_orderstatus) >= 10
    AND o_totalprice / 500000 >= 0.1 AND o_totalprice / 500000 <= 0.95),
once AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY o_custkey, hit_sequence ORDER BY o_totalprice, o_orderkey) = 1)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank
FROM once QUALIFY rank <= 4"""
)
def dated_top4(t: Tables) -> DataFrame:
    share = F.col("o_totalprice") / 500000
    hits = t.orders.select(
        "o_custkey",
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("release_date"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("hit_sequence"),
        share.alias("align_ratio"),
        share.alias("sub_ratio"),
        F.col("o_totalprice").alias("e_value"),
    )
    order = [F.col("e_value").asc(), F.col("o_orderkey").asc()]
    kept = search.filter_templates(hits, "1997-06-30", ["o_custkey"], order=order)
    return kept.select("o_custkey", "o_orderkey", "rank")


@query(
    """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS index,
  l_orderkey, l_linenumber, p_name, s_name, o_orderpriority
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND l_returnflag <> 'R'
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey"""
)
def triple_lookup(t: Tables) -> DataFrame:
    tasks = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("script"),
        F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("flags"),
        F.col("l_orderkey").alias("structure"),
    )
    return m.resolve_tasks(
        tasks,
        ["l_orderkey", "l_linenumber", "p", "flags"],
        {
            "script": (t.part, "p_partkey", "p_name"),
            "flags": (t.supplier, "s_suppkey", "s_name"),
            "structure": (t.orders, "o_orderkey", "o_orderpriority"),
        },
    ).select(
        "index",
        "l_orderkey",
        "l_linenumber",
        F.col("script").alias("p_name"),
        F.col("flags").alias("s_name"),
        F.col("structure").alias("o_orderpriority"),
    )


@query(
    """SELECT 'supplier-' || s_suppkey AS candidate_id, coalesce(a.n_name, b.r_name, c.n_name, 'NONE') AS fixed_positions
FROM supplier LEFT JOIN nation a ON s_suppkey = a.n_nationkey
LEFT JOIN region b ON s_nationkey = b.r_regionkey
LEFT JOIN nation c ON length(s_name) + s_nationkey = c.n_nationkey"""
)
def fallback_lookup(t: Tables) -> DataFrame:
    structures = t.supplier.select(
        name("supplier-", "s_suppkey").alias("candidate_id"),
        F.concat(F.lit("f/region-"), F.col("s_nationkey"), F.lit("_model.pdb")).alias("file_name"),
        F.concat(F.lit("g/x__nation-"), F.length("s_name") + F.col("s_nationkey"), F.lit(".cif")).alias("source_path"),
    )
    lookup = s.union_exact(
        t.nation.select(name("supplier-", "n_nationkey").alias("candidate_key"), F.col("n_name").alias("fixed_positions")),
        t.region.select(name("region-", "r_regionkey").alias("candidate_key"), F.col("r_name").alias("fixed_positions")),
        t.nation.select(name("nation-", "n_nationkey").alias("candidate_key"), F.col("n_name").alias("fixed_positions")),
    )
    return m.fixed_positions_for(structures, lookup, "NONE").select("candidate_id", "fixed_positions")


@query(
    """SELECT 'order-' || o_orderkey AS candidate_id,
  CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'succeeded' ELSE 'failed' END AS status,
  CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN NULL ELSE 'worker error' END AS error
FROM orders"""
)
def job_outcomes(t: Tables) -> DataFrame:
    path = F.concat(F.lit("out/order-"), F.col("key"), F.lit("/score.sc"))
    jobs = t.orders.select(
        name("order-", "o_orderkey").alias("candidate_id"), F.col("o_orderkey").alias("key")
    ).select("candidate_id", path.alias("expected_score_file"))
    files = t.lineitem.select(F.col("l_orderkey").alias("key")).select(path.alias("path"))
    done = m.job_outcomes(jobs, files)
    return done.withColumn("error", F.when(F.col("status") == "failed", F.lit("worker error")))


def _line_manifest(t: Tables) -> DataFrame:
    file = m.file_record(
        role=F.when(F.col("l_linestatus") == "F", "score").otherwise("log"),
        volume_name=F.lit("app"),
        app_volume_path=F.concat(F.lit("o"), F.col("l_orderkey"), F.lit("/l"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey")),
        path=F.concat(F.lit("l"), F.col("l_linenumber"), F.lit(".csv")),
        size_bytes=F.col("l_quantity"),
        expected=F.col("l_returnflag") != "N",
    )
    # a manifest row holds all its files, so each order's are gathered at once, where the join wants them
    lines = t.lineitem.select(name("order-", "l_orderkey").alias("candidate_id"), F.struct("l_linenumber", file.alias("file")).alias("line"))
    files = lines.groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["file"]).alias("files"))
    return order_manifest(t).join(files, "candidate_id", "left")


def _line_listing(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.lit("app").alias("volume_name"),
        F.concat(F.lit("o"), F.col("l_orderkey"), F.lit("/l"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey")).alias("path"),
        F.when(F.col("l_tax") > 0.07, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).cast("bigint").alias("size_bytes"),
    )


_FILE_ERRORS = """
WITH errors AS (
  SELECT 'order-' || l_orderkey AS candidate_id,
    'wrong_size' AS problem,
    'app' AS volume_name, 'o' || l_orderkey || '/l' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS path
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag <> 'N' AND l_tax > 0.07)
"""


@query(_FILE_ERRORS + "SELECT * FROM errors")
def file_errors(t: Tables) -> DataFrame:
    found = m.expected_file_errors(_line_manifest(t), _line_listing(t), ["app"], "flow")
    return found.select("candidate_id", "problem", "volume_name", "path")


@query(
    _FILE_ERRORS
    + """SELECT 'order-' || o_orderkey AS candidate_id FROM orders
WHERE o_orderstatus = 'O' AND 'order-' || o_orderkey NOT IN (SELECT candidate_id FROM errors)"""
)
def reusable_candidates(t: Tables) -> DataFrame:
    return m.reusable_ids(_line_manifest(t), _line_listing(t), ["app"], "flow")


@query(
    """SELECT 'order-' || o_orderkey AS candidate_id,
  CASE WHEN l_orderkey IS NOT NULL THEN CASE WHEN l_linestatus = 'F' THEN 'score' ELSE 'log' END END AS role,
  CASE WHEN l_orderkey IS NOT NULL THEN 'l' || l_linenumber || '.csv' END AS path,
  l_quantity::BIGINT AS size_bytes
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"""
)
def flat_files(t: Tables) -> DataFrame:
    return m.explode_files(_line_manifest(t)).select("candidate_id", "role", "path", "size_bytes")


@query(
    """SELECT 'order-' || o_orderkey AS candidate_id FROM orders
WHERE o_orderstatus = 'P' AND o_orderkey IN (
  SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber::VARCHAR BETWEEN '1' AND '3')"""
)
def artifact_selector(t: Tables) -> DataFrame:
    artifacts = _line_manifest(t).select(
        "candidate_id", F.col("candidate_status").alias("kind"), F.lit("rank").alias("producing_node_id"), "files"
    )
    return runs.select_artifacts(artifacts, "rank", kind="partial", glob="l[1-3].csv", role="score").select("candidate_id").distinct()


@query(
    """SELECT o_orderpriority AS id, unnest(['duplicate', 'unsafe']) AS problem, count(*) AS n FROM orders
WHERE o_orderpriority = '4-NOT SPECIFIED' GROUP BY o_orderpriority
UNION ALL SELECT o_orderpriority, 'duplicate', count(*) FROM orders
WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY o_orderpriority HAVING count(*) > 1"""
)
def id_checks(t: Tables) -> DataFrame:
    return quality.unique_safe_ids(t.orders, "o_orderpriority")


@query(
    """SELECT regexp_replace(p_name, ' ', '_@_') AS safe_name, 'collision' AS problem, count(*) AS n
FROM part GROUP BY p_name HAVING count(*) > 1"""
)
def name_collisions(t: Tables) -> DataFrame:
    return quality.check_names(t.part, "p_name")


@query(
    """SELECT candidate_id, candidate_status, index FROM (
  SELECT candidate_id, candidate_status, row_number() OVER (ORDER BY candidate_id) AS index FROM (
    SELECT 'order-' || o_orderkey AS candidate_id, 'succeeded' AS candidate_status FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'order-' || o_orderkey, 'failed' FROM orders WHERE o_orderstatus <> 'O'))"""
)
def merged_manifest(t: Tables) -> DataFrame:
    kept = order_manifest(t).filter("candidate_status = 'succeeded'")
    outcomes = m.drop_ids(order_manifest(t), kept).select(
        "candidate_id", F.lit("failed").alias("status"), F.lit("x").alias("error")
    )
    new = m.manifest_from_outcomes(outcomes, "stage2", "refold", "predict")
    return add_index(m.merge_rows(kept, new), ["candidate_id"]).select("candidate_id", "candidate_status", "index")


@query(
    """SELECT DISTINCT o_orderpriority FROM orders"""
)
def distinct_priorities(t: Tables) -> DataFrame:
    return s.distinct_values(t.orders, "o_orderpriority")


@query(
    r"""WITH runs AS (
  SELECT n_name, 'ns-' || n_name AS run_name, unnest([1, 2, 3]) AS replicate FROM nation)
SELECT run_name, replicate, run_name || '-r00' || replicate AS replicate_run_name,
  'cand_' || substr(sha256('{"basename":"' || n_name || '.pdb","kind":"initial","source_artifact_id":"art","source_path":"in/' ||
    n_name || '.pdb","stage_name":"prep"}'), 1, 16) AS initial_id,
  'cand_' || substr(sha256('{"derived_basename":"' || n_name || '.cif","kind":"derived","operation_mode":"relax","parent_candidate_id":"' ||
    n_name || '","stage_name":"prep"}'), 1, 16) AS derived_id
FROM runs"""
)
def replicates(t: Tables) -> DataFrame:
    inputs = t.nation.select(F.concat(F.lit("in/./"), F.col("n_name"), F.lit(".pdb")).alias("file"), "n_name")
    expanded = m.expand_replicates(inputs, "file", 3, "ns")
    return expanded.select(
        "run_name",
        "replicate",
        "replicate_run_name",
        keys.initial_id(F.lit("prep"), F.lit("art"), F.col("file")).alias("initial_id"),
        keys.derived_id(
            F.col("n_name"), F.lit("prep"), F.lit("relax"), F.concat(F.lit("out/"), F.col("n_name"), F.lit(".cif"))
        ).alias("derived_id"),
    )


@query(
    """SELECT printf('stage2_input_%06d', row_number() OVER (ORDER BY 'out/' || p_type || '/' || p_partkey || '.pdb')) AS candidate_id,
  'out/' || p_type || '/' || p_partkey || '.pdb' AS source_path,
  '{"file_name":"' || p_partkey || '.pdb"}' AS summary_json, p_size::BIGINT AS size_bytes
FROM part"""
)
def listing_manifest(t: Tables) -> DataFrame:
    file = F.concat(F.col("p_partkey"), F.lit(".pdb"))
    listing = t.part.select(
        F.concat_ws("/", F.lit("out"), "p_type", file).alias("path"),
        F.lit("vol").alias("volume_name"),
        F.lit("art").alias("artifact_id"),
        file.alias("file_path"),
        F.lit("chemical/x-pdb").alias("media_type"),
        F.col("p_size").alias("size_bytes"),
    )
    rows = m.manifest_from_listing(listing)
    return rows.select("candidate_id", "source_path", "summary_json", F.col("files")[0]["size_bytes"].alias("size_bytes"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(t: Tables) -> DataFrame:
    return quality.value_counts(t.orders, "o_orderstatus")


@query(
    """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
)
def semi_anti(t: Tables) -> DataFrame:
    big = t.lineitem.filter("l_quantity >= 49").withColumnRenamed("l_orderkey", "o_orderkey")
    back = t.lineitem.filter("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    kept = m.drop_ids(m.keep_ids(t.orders, big, "o_orderkey"), back, "o_orderkey")
    return kept.select("o_orderkey", "o_totalprice")


@query(
    """SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('O', 'P')
AND o_orderdate <= TIMESTAMP '1997-01-01'"""
)
def retention_candidates(t: Tables) -> DataFrame:
    state = F.expr("CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'partial' END")
    jobs = t.orders.select(
        "o_orderkey",
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderpriority").alias("workload"),
        state.alias("state"),
        F.col("o_orderdate").alias("completed_at"),
        F.lit("run").alias("run_name"),
        F.lit(None).cast("timestamp").alias("intermediates_cleaned_at"),
    )
    return runs.retention(jobs, "1-URGENT", F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query(
    """SELECT job_id, row_number() OVER (ORDER BY created_at, job_id) AS position FROM (
  SELECT event_id AS job_id, ts AS created_at FROM events WHERE event_type <> 'signup')"""
)
def reconcilable_jobs(t: Tables) -> DataFrame:
    from siftline.plans.ledgers import event_jobs
    from siftline.schemas import RECONCILABLE_STATES

    listed = runs.in_states(event_jobs(t), RECONCILABLE_STATES)
    return add_index(listed, ["created_at", "job_id"], 1, "position").select("job_id", "position")


@query(
    """SELECT 'run1_' || s_suppkey AS id, 'run1_' || s_name AS file_name, s_acctbal AS balance, NULL AS segment FROM supplier
UNION ALL SELECT 'run2_' || c_custkey, 'run2_' || c_name, c_acctbal, c_mktsegment FROM customer"""
)
def diagonal_union(t: Tables) -> DataFrame:
    left = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("file_name"), F.col("s_acctbal").alias("balance")
    )
    right = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("file_name"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    both = [keys.prefix_ids(df, run, ["id", "file_name"]) for df, run in ((left, "run1"), (right, "run2"))]
    return s.union_loose(*both)


@query(
    """SELECT p_partkey, concat_ws(' ', p_type, p_size::VARCHAR) AS label,
  row_number() OVER (ORDER BY p_size, concat_ws(chr(9), p_partkey::VARCHAR, p_type, p_size::VARCHAR)) AS position FROM part"""
)
def number_then_text(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_type", F.col("p_size").cast("string").alias("Score"))
    text = F.concat_ws("\t", "p_partkey", "p_type", "Score")
    placed = add_index(rows, [F.col("Score").cast("double"), text], 1, "position")
    return placed.select("p_partkey", F.concat_ws(" ", "p_type", "Score").alias("label"), "position")


@query(
    """SELECT refseq, "siRNA", position FROM (
  SELECT refseq, "siRNA", row_number() OVER (ORDER BY refseq, "siRNA", k) AS position FROM (
    SELECT p_type AS refseq, p_brand AS "siRNA", 'p' || p_partkey AS k FROM part
    UNION ALL SELECT c_mktsegment, 'c', 'c' || c_custkey FROM customer))"""
)
def sorted_pairs(t: Tables) -> DataFrame:
    from siftline.operators.evidence import sort_pair

    left = t.part.select(F.col("p_type").alias("refseq"), F.col("p_brand").alias("siRNA"), name("p", "p_partkey").alias("k"))
    right = t.customer.select(F.col("c_mktsegment").alias("refseq"), F.lit("c").alias("siRNA"), name("c", "c_custkey").alias("k"))
    return add_index(sort_pair(left, right), ["refseq", "siRNA", "k"], 1, "position").drop("k")


@query(
    """SELECT file, row_number() OVER (ORDER BY CASE WHEN n < 15 THEN n ELSE 1000000 END, file) AS position FROM (
  SELECT s_nationkey AS n, s_suppkey,
    CASE WHEN s_nationkey < 15 THEN 'run_' || s_nationkey || '.pdb' ELSE 'run_x' || s_suppkey || '.pdb' END AS file
  FROM supplier) GROUP BY file, n"""
)
def numeric_suffix(t: Tables) -> DataFrame:
    small = F.col("s_nationkey") < 15
    file = F.when(small, F.concat(F.lit("run_"), F.col("s_nationkey"), F.lit(".pdb"))).otherwise(
        F.concat(F.lit("run_x"), F.col("s_suppkey"), F.lit(".pdb"))
    )
    files = t.supplier.select(file.alias("file")).distinct()
    return add_index(files, st.suffix_order(F.col("file"), "run"), 1, "position")
