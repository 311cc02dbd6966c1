"""Structure files and Python workers: whole tables as atom records, and functions over rows and chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators import structures as st
from siftline.operators import workers
from siftline.plans.registry import Tables, query
from siftline.session import new_path
from siftline.sources import text


def _record(kind: Column, z: Column) -> Column:
    """A fixed-width atom line of a line item; ``z`` is its last coordinate as text."""
    x, y, b = (F.format_string(f, F.col(c).cast("double")) for f, c in (("%8.3f", "l_quantity"), ("%8.3f", "l_discount"), ("%6.2f", "l_quantity")))
    name = F.when(F.col("l_linenumber") <= 2, "CA").otherwise("CB")
    residue = F.concat(F.lit("RE"), F.col("l_returnflag"))
    index = F.lpad((F.col("l_partkey") % 5000).cast("string"), 4, " ")
    code = F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise(" ")
    head = F.concat(kind, F.lpad(F.col("l_linenumber").cast("string"), 5, " "), F.lit("  "), F.rpad(name, 4, " "), F.rpad(residue, 3, " "), F.lit(" "), F.col("l_linestatus"))
    tail = F.when(z == "", F.lit("")).otherwise(F.concat(F.lit("  1.00"), b))
    return F.concat(head, index, code, F.lit("   "), x, y, z, tail)


def _z() -> Column:
    return F.format_string("%8.3f", F.col("l_tax").cast("double"))


def _written(t: Tables, part: Column, line: Column) -> DataFrame:
    """Atom fields of lines that were written below one folder for each ``part``."""
    path = new_path(t.spark, "atoms")
    t.lineitem.select(part.alias("part"), line.alias("value")).write.partitionBy("part").text(path)
    atoms = text.read_atoms(t.spark, f"{path}/part=*")
    return atoms.withColumn("part", F.regexp_extract("file", "/part=([^/]+)/", 1))


_ATOMS = """SELECT l_orderkey, l_returnflag AS part, l_linenumber::INT AS serial, CASE WHEN l_linenumber <= 2 THEN 'CA' ELSE 'CB' END AS atom_name, 'RE' || l_returnflag AS residue,
  l_linestatus AS chain, (l_partkey % 5000)::INT AS residue_index, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE '' END AS insertion_code,
  l_quantity::DOUBLE AS x, l_discount::DOUBLE AS y, l_tax::DOUBLE AS z, l_quantity::DOUBLE AS b_factor FROM lineitem"""
_FIELDS = ["part", "serial", "atom_name", "residue", "chain", "residue_index", "insertion_code", "x", "y", "z", "b_factor"]


@query(f"SELECT {', '.join(_FIELDS)} FROM ({_ATOMS})")
def atom_records(t: Tables) -> DataFrame:
    found = _written(t, F.col("l_returnflag"), _record(F.lit("ATOM  "), _z()))
    return found.filter("is_atom").select(*_FIELDS)


@query(
    f"""SELECT part, chain, residue_index, insertion_code, min(serial) AS serial FROM ({_ATOMS}) WHERE atom_name = 'CA'
GROUP BY part, chain, residue_index, insertion_code"""
)
def first_ca_atoms(t: Tables) -> DataFrame:
    found = _written(t, F.col("l_returnflag"), _record(F.lit("HETATM"), _z()))
    return st.first_ca(found, ["part", "chain"]).select("part", "chain", "residue_index", "insertion_code", "serial")


@query(
    """SELECT 's' || l_suppkey % 8 AS part, 'malformed' AS problem, count(*) AS n FROM lineitem WHERE l_linenumber = 6 AND l_suppkey % 8 <> 3 GROUP BY l_suppkey % 8
UNION ALL SELECT DISTINCT 's3', 'no_atoms', 0::BIGINT FROM lineitem WHERE l_suppkey % 8 = 3"""
)
def atom_problems(t: Tables) -> DataFrame:
    group = F.col("l_suppkey") % 8
    kind = F.when(group == 3, "REMARK").otherwise("ATOM  ")
    cut = F.when(F.col("l_linenumber") == 6, F.lit("")).otherwise(_z())
    found = _written(t, F.concat(F.lit("s"), group), _record(kind, cut))
    return st.check_atoms(found, ["part"])


def _measure(row: dict) -> dict:
    if row["lang"] == "de":
        raise ValueError(f"no reader for {row['lang']}")
    return {"size": len(row["text"])}


@query(
    """SELECT doc_id::VARCHAR AS candidate_id, CASE WHEN lang = 'de' THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN lang = 'de' THEN 'no reader for de' END AS error, CASE WHEN lang <> 'de' THEN length(text) END::BIGINT AS size FROM documents"""
)
def worker_rows(t: Tables) -> DataFrame:
    outputs = T.StructType([T.StructField("size", T.LongType())])
    done = workers.run_rows(t.documents.select("doc_id", "lang", "text"), _measure, "doc_id", outputs)
    return done.select("candidate_id", "status", "error", "size")


def _summary(chunk: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"first_key": [chunk["o_orderkey"].iloc[0]], "n": [len(chunk)], "customers": [chunk["o_custkey"].nunique()]})


@query(
    """WITH k AS (SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders)
SELECT min(o_orderkey)::BIGINT AS first_key, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS customers FROM k GROUP BY chunk"""
)
def worker_chunks(t: Tables) -> DataFrame:
    return workers.run_chunks(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 1000, _summary, "first_key bigint, n bigint, customers bigint")
