import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siftline.operators import series as se
from siftline.operators import structures as st
from siftline.ordering import add_index
from siftline.sources.text import parse_atoms


def test_residue_positions(frame):
    cells = frame(
        "pdb string, chain string, cell string",
        ("d/Design-1_1.pdb", "B", "{5: -6.0, 12: -4.9}"), ("Design-1_2.pdb", "A", "{7: -5.5, 30: -5.0}"),
        ("Design-1_3.pdb", "A", "{'30': -7}"), ("other_x.pdb", "A", "{1: 2.0}"),
    )
    rows_ = st.mapping_rows(cells.withColumn("structure", st.structure_name(F.col("pdb"))), "cell", ["structure", "chain"])
    assert rows(st.residue_positions(rows_), "structure", "segment", "fixed_positions") == [
        ("design-1", 0, "A7,A30,B5"), ("other_x", 0, "NONE"),
    ]
    split = st.residue_positions(rows_, block=2)
    assert rows(split) == [("design-1", 0, "A7,A30"), ("design-1", 1, "B5"), ("other_x", 0, "NONE")]
    with pytest.raises(Exception):
        st.mapping_rows(frame("c string", ("nonsense",)), "c", []).collect()


def test_chain_sequences(frame):
    res = frame("structure string, chain string, position int, residue string", ("s", "A", 2, "GLY"), ("s", "A", 1, "ALA"), ("s", "A", 3, "ASH"), ("s", "A", 4, "ZZZ"), ("s", "B", 1, "DG"))
    assert rows(st.chain_sequences(res, overrides={"ASH": "D"}), "chain", "segment", "sequence") == [("A", 0, "AGDX"), ("B", 0, "G")]


@pytest.fixture
def atoms(frame):
    random.seed(3)
    data = [(0, f, a, *[random.uniform(-9, 9) for _ in range(3)], a + 1.0) for f in range(5) for a in range(7)]
    return data, frame("traj int, frame int, atom int, x double, y double, z double, mass double", *data)


def test_geometry(atoms):
    data, df = atoms
    by = {(f, a): (x, y, z, w) for _, f, a, x, y, z, w in data}
    dist2 = lambda p, q: sum((p[i] - q[i]) ** 2 for i in range(3))
    for r in st.rmsd(df).collect():
        want = math.sqrt(sum(dist2(by[r["frame"], a], by[0, a]) for a in range(7)) / 7)
        assert r["rmsd"] == pytest.approx(want)
    for r in st.gyration(df, mass=F.col("mass")).collect():
        pts = [by[r["frame"], a] for a in range(7)]
        total = sum(p[3] for p in pts)
        c = [sum(p[i] * p[3] for p in pts) / total for i in range(3)]
        assert r["rg"] == pytest.approx(math.sqrt(sum(p[3] * dist2(p, c) for p in pts) / total))
    named = df.withColumn("atom_name", F.lit("CA")).withColumnRenamed("atom", "residue_index")
    for r in st.rmsf(named).collect():
        pts = [by[f, r["residue_index"]] for f in range(5)]
        c = [sum(p[i] for p in pts) / 5 for i in range(3)]
        assert r["rmsf"] == pytest.approx(math.sqrt(sum(dist2(p, c) for p in pts) / 5))
    assert st.rmsf(named.withColumn("atom_name", F.lit("CB"))).count() == 0


def test_mask(frame):
    atoms = frame("structure string, label string, b_factor double", ("s", "A1", 0.0), ("s", "A1", 1.0), ("s", "A2", 0.0), ("s", "A3", 2.0), ("s", "A4", 1.0))
    mask = frame("structure string, label string, is_fixed boolean", ("s", "A1", True), ("s", "A2", True), ("s", "A3", False), ("s", "A9", True))
    assert rows(st.mask_mismatch(atoms, mask), "label", "problem") == [
        ("A2", "fixed_without_factor"), ("A3", "redesigned_with_factor"), ("A4", "not_in_mask"), ("A9", "no_residue"),
    ]


def test_suffix_order(frame):
    files = frame("f string", ("run_10.pdb",), ("run_9.pdb",), ("run_x.pdb",), ("7.pdb",))
    got = add_index(files, st.suffix_order(F.col("f"), "run")).orderBy("index").collect()
    assert [r["f"] for r in got] == ["7.pdb", "run_9.pdb", "run_10.pdb", "run_x.pdb"]


@pytest.mark.parametrize(
    ("axis", "points", "problem"),
    [
        ("time_ns", [(0.0, 1.0), (1.0, float("nan"))], "not_finite"),
        ("time_ns", [(0.0, 1.0), (1.0, float("inf"))], "not_finite"),
        ("time_ns", [(0.0, 1.0), (0.0, 1.0)], "not_increasing"),
        ("time_ns", [(1.0, 1.0), (0.5, 1.0)], "not_increasing"),
        ("residue_index", [(1.0, 1.0), (1.5, 1.0)], "not_integral"),
        ("residue_index", [(0.0, 1.0)], "axis_start"),
        ("time_ns", [(-1.0, 1.0)], "axis_start"),
        ("time_ns", [(0.0, -0.1)], "negative"),
        ("time_ns", [(0.0, None)], "null"),
        ("time_ns", [], "empty"),
    ],
)
def test_series_problems(frame, axis, points, problem):
    df = frame(f"o int, {axis} double, v double", *[(i, *p) for i, p in enumerate(points)])
    assert problem in [r[0] for r in rows(se.check_series(df, axis, "v", "o"))]


def test_good_series(frame):
    df = frame("k string, o int, time_ns double, v double", *[(k, i, i / 10, 0.0) for k in "ab" for i in range(20)])
    assert se.check_series(df, "time_ns", "v", "o", ["k"]).count() == 0
    assert rows(se.is_increasing(df, ["k"], "o", "time_ns")) == [("a", 0, True), ("b", 0, True)]
    bad = df.withColumn("time_ns", F.when(F.col("o") == 7, 0.1).otherwise(F.col("time_ns")))
    assert rows(se.falling_steps(bad, ["k"], "o", "time_ns"), "k", "o") == [("a", 7), ("b", 7)]


def test_gyration_far_from_the_origin(frame):
    atoms = frame("traj int, frame int, x double, y double, z double", (0, 0, 1e8, 0.0, 0.0), (0, 0, 1e8 + 1, 0.0, 0.0))
    assert rows(st.gyration(atoms), "rg") == [(0.5,)]


def test_codes_of_modified_residues(frame):
    residues = frame("position int, residue string", (1, "MSE"), (2, "ALA"), (3, "ZZZ"))
    codes = frame("residue string, code string", ("MSE", "m"), ("MSE", "m"), ("SEP", "S"))
    assert rows(st.code_residues(residues, codes), "position", "code") == [(1, "M"), (2, "A"), (3, "X")]


def test_chain_with_insertion_codes(frame):
    def atom(serial, name, residue, number):
        return f"ATOM  {serial:>5}  {name:<3} {residue} H{number:<5}   {0.0:>8.3f}{0.0:>8.3f}{0.0:>8.3f}  1.00  0.00"

    lines = [atom(1, "N", "ALA", " 100 "), atom(2, "CA", "ALA", " 100 "), atom(3, "CA", "GLY", " 100A"), atom(4, "CA", "SER", " 100B"), atom(5, "CA", "THR", " 100B"), atom(6, "CA", "TRP", " 101 ")]
    atoms = parse_atoms(frame("file string, value string", *[("f", x) for x in lines]))
    chain = st.chain_sequences(st.first_ca(atoms), ("file", "chain"), "serial")
    assert rows(chain, "sequence") == [("AGSW",)]
