import gzip
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siftline.operators.quality import assert_empty
from siftline.operators.structures import check_atoms
from siftline.sources import sinks
from siftline.sources import tables as tb
from siftline.sources import text as tx

ATOM = "ATOM      1  CA  GLY A   7      11.104   6.134  -6.504  1.00 12.50           C  "


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def test_scores_are_text(spark, tmp_path):
    df = tb.read_scores(spark, write(tmp_path / "s.csv", "name,iptm\na,0.50\nb,\n"))
    assert rows(df) == [("a", "0.50"), ("b", None)]


def test_typed_csv(spark, tmp_path):
    good = write(tmp_path / "g.csv", "time_ns,rg\n0,1.5\n1,2\n")
    assert rows(tb.read_typed_csv(spark, good, "time_ns double, rg double")) == [(0.0, 1.5), (1.0, 2.0)]
    for name, text in (("type", "time_ns,rg\n0,x\n"), ("header", "time_ns,rmsd\n0,1\n")):
        with pytest.raises(Exception):
            tb.read_typed_csv(spark, write(tmp_path / f"{name}.csv", text), "time_ns double, rg double").collect()


def test_evidence_tsv(spark, tmp_path):
    paths = [
        write(tmp_path / "1.tab", "refseq\tsiRNA\ttargetscan_score\nr1\tRNA0\t0.5\n"),
        write(tmp_path / "2.tab", "r2\tRNA1\tbad\n"),
        write(tmp_path / "3.tab", ""),
        write(tmp_path / "4.tab", "refseq\tsiRNA\ttargetscan_score\n"),
    ]
    df = tb.read_evidence_tsv(spark, paths, ["refseq", "siRNA", "targetscan_score"], ["targetscan_score"])
    assert rows(df) == [("r1", "RNA0", 0.5), ("r2", "RNA1", None)]


def test_positional(spark, tmp_path):
    names = [f"col {i}" for i in range(28)]
    wide = write(tmp_path / "w.tsv", "\t".join(names) + "\n" + "\t".join(str(i) for i in range(28)) + "\n")
    df = tb.read_positional(spark, wide, {0: "refseq", 2: "siRNA", 3: "site_type", 27: "score"})
    assert rows(df) == [("0", "2", "3", "27")] and df.columns == ["refseq", "siRNA", "site_type", "score"]
    with pytest.raises(ValueError, match="at least 28"):
        tb.read_positional(spark, write(tmp_path / "n.tsv", "a\tb\n1\t2\n"), {0: "x"})


@pytest.mark.parametrize("preamble", [True, False])
def test_fasta(spark, tmp_path, preamble):
    write(tmp_path / "a.fa", ">design-a  \nAC\nD \n\n>design-b\nEFG\n>design-a\n\n>empty\n")
    write(tmp_path / "b.fa", "\n>crlf one\r\nAC\r\nGT\r\n>last\r\nU")
    got = rows(tx.read_fasta(spark, str(tmp_path), preamble), "header", "sequence")
    assert got == [("crlf one", "ACGT"), ("design-a", ""), ("design-a", "ACD"), ("design-b", "EFG"), ("empty", ""), ("last", "U")]


def test_fasta_preamble(spark, tmp_path):
    write(tmp_path / "p.fa", "note\nmore > text\n>a\nAC\n")
    write(tmp_path / "q.fa", ">b\nGG\n")
    write(tmp_path / "none.fa", "only text\n")
    assert rows(tx.read_fasta(spark, str(tmp_path)), "header", "sequence") == [("a", "AC"), ("b", "GG")]


def test_fasta_splits(spark, tmp_path):
    """Records survive any split size."""
    text = "".join(f">r{i}\n{'ACGU' * (i % 40)}\n{'G' * 7}\n" for i in range(400))
    path = write(tmp_path / "big.fa", text)
    whole = rows(tx.read_fasta(spark, path), "header", "sequence")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        split = tx.read_fasta(spark, path)
        assert split.rdd.getNumPartitions() > 10
        assert rows(split, "header", "sequence") == whole and len(whole) == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sequence_rows(spark, tmp_path):
    write(tmp_path / "x" / "s.fa", ">Design-A_model\nACD\n>\nEFG\n")
    write(tmp_path / "x" / "notes.txt", ">not\nread\n")
    got = tx.fasta_sequence_rows(spark, str(tmp_path / "x"), "seq", "parent")
    assert rows(got, "candidate_id", "parent_candidate_id", "stage_name", "sequence_id", "sequence") == [
        ("design-a", "parent", "seq", "Design-A_model", "ACD"), ("s", "parent", "seq", "", "EFG"),
    ]


def test_metric_json(spark, tmp_path):
    write(tmp_path / "d1_summary_confidences.json", json.dumps({"ranking_score": 0.7, "iptm": 0.8, "nested": {"skip": True}, "l": [1]}, indent=1))
    write(tmp_path / "d2.json", json.dumps({"nested": {"only": 1}}))
    got = tb.read_metric_json(spark, str(tmp_path), "refold")
    assert rows(got, "candidate_id", "stage_name", "iptm", "ranking_score") == [("d1", "refold", 0.8, 0.7)]
    assert "nested" not in got.columns and "l" not in got.columns
    fixed = tb.read_metric_json(spark, str(tmp_path), "refold", "iptm double, nested struct<skip:boolean>")
    assert rows(fixed, "candidate_id", "iptm") == [("d1", 0.8)]


def test_jsonl(spark, tmp_path):
    schema = "siRNA string, score double"
    good = write(tmp_path / "g.jsonl", '{"siRNA":"a","score":1}\n{"siRNA":"b","score":2}\n')
    assert tb.read_jsonl(spark, good, schema, "siRNA").count() == 2
    for bad in ('{"siRNA":"a"}\n{"siRNA":"a"}\n', '{"score":1}\n', '{"siRNA":\n'):
        with pytest.raises(Exception):
            tb.read_jsonl(spark, write(tmp_path / "b.jsonl", bad), schema, "siRNA").collect()


def test_listing(spark, tmp_path):
    for name in ("a/x_1.pdb", "a/b/y.CIF", "a/notes.txt", "z.pdb"):
        write(tmp_path / name, "12345")
    got = tb.read_listing(spark, str(tmp_path))
    assert rows(got, "relative_path", "file_name", "size_bytes") == [("a/b/y.CIF", "y.CIF", 5), ("a/x_1.pdb", "x_1.pdb", 5), ("z.pdb", "z.pdb", 5)]
    assert rows(tb.read_listing(spark, str(tmp_path), ["a/*_1.pdb", "y.*"]), "file_name") == [("x_1.pdb",), ("y.CIF",)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_atoms(spark, tmp_path):
    write(tmp_path / "ok.pdb", f"HEADER\n{ATOM}\r\n{ATOM.replace('ATOM  ', 'HETATM')}\nTER\n")
    write(tmp_path / "bad.pdb", f"{ATOM[:40]}\n{ATOM.replace('11.104', '11.x04')}\n{ATOM.replace('    1  CA', '    0  CA')}\n{ATOM.replace('6.134', '  NaN')}\n")
    write(tmp_path / "none.pdb", "HEADER\nREMARK\n")
    atoms = tx.read_atoms(spark, str(tmp_path))
    good = rows(atoms.filter("is_atom and file like '%ok.pdb'"), "serial", "atom_name", "residue", "chain", "residue_index", "x", "y", "z", "b_factor")
    assert good == [(1, "CA", "GLY", "A", 7, 11.104, 6.134, -6.504, 12.5)] * 2
    found = check_atoms(atoms.withColumn("file", F.substring_index("file", "/", -1)))
    assert rows(found) == [("bad.pdb", "malformed", 4), ("none.pdb", "no_atoms", 0)]


def test_log_metrics(frame):
    df = frame("t string", ("DockQ 0.5 iRMSD: 1.2\tfnat x F1: .5 dockq: 0.75 lrmsd -1e-3\nclashes 2 mapping AB:CD z",), ("nothing",))
    got = tx.extract_log_metrics(df, "t").collect()
    assert got[0].asDict() == {
        "dockq": "0.75", "irmsd": "1.2", "lrmsd": "-1e-3", "fnat": None, "fnonnat": None, "f1": None, "clashes": "2", "mapping": "AB:CD",
    }
    assert set(got[1].asDict().values()) == {None}


def read_parts(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_series_and_screen(frame, tmp_path):
    sinks.write_series(frame("time_ns double, rmsd double", (0.1, 1 / 3), (0.2, 2.0)), str(tmp_path / "s"), ["time_ns"])
    assert "0.10000,0.33333\n" in read_parts(tmp_path / "s")
    df = frame("pos int, siRNA string, efficacy double, filter int", (2, "B", 0.1, 0), (1, "A", 0.5, 1), (3, "C", 0.9, 0))
    sinks.write_screen(df, str(tmp_path / "o"), "stem")
    first = [line.split("\t")[0] for line in read_parts(tmp_path / "o" / "stem").splitlines() if not line.startswith("pos")]
    ranked = [line.split("\t")[0] for line in read_parts(tmp_path / "o" / "stem_ranked").splitlines() if not line.startswith("pos")]
    kept = [line.split("\t")[0] for line in read_parts(tmp_path / "o" / "stem_ranked_filtered").splitlines() if not line.startswith("pos")]
    assert (first, ranked, kept) == (["1", "2", "3"], ["3", "1", "2"], ["3", "2"])


def test_jsonl_order(frame, tmp_path):
    df = frame("candidate_id string, v int", ("a", 1), ("b", 2), ("c", 3))
    order = frame("candidate_id string, position int", ("c", 0), ("a", 1), ("b", 2))
    sinks.write_jsonl(df, str(tmp_path / "j"), order)
    lines = read_parts(tmp_path / "j").split()
    assert [json.loads(x)["candidate_id"] for x in lines] == ["c", "a", "b"]


def test_shards(spark, frame, tmp_path):
    df = spark.range(50).select(
        F.concat(F.lit("r"), "id").alias("header"), F.lit("ACGU").alias("sequence"), (F.col("id") % 2).alias("shard"), F.floor(F.col("id") / 2).alias("place")
    )
    sinks.write_shards(df, str(tmp_path / "db"), "db", 2)
    folders = sorted(p.name for p in (tmp_path / "db").iterdir() if p.is_dir())
    assert folders == ["shard_name=db-00000-of-00002", "shard_name=db-00001-of-00002"]
    text = read_parts(tmp_path / "db" / folders[1])
    assert [x for x in text.split() if x.startswith(">")] == [f">r{i}" for i in range(1, 50, 2)]
    back = tx.read_fasta(spark, str(tmp_path / "db"))
    assert back.select("header").distinct().count() == 50


def test_compressed_fasta(spark, tmp_path):
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress(b">a\nAC\n>b\nGT\n"))
    assert rows(tx.read_fasta(spark, str(tmp_path / "c.fa.gz")), "header", "sequence") == [("a", "AC"), ("b", "GT")]


def test_assert_empty(frame):
    assert_empty(frame("a int", (1,)).limit(0), "x")
    with pytest.raises(ValueError, match="x: "):
        assert_empty(frame("a int", (1,)), "x")
