from conftest import rows

from siftline.operators import manifests as m
from siftline.operators.sequences import table_facts
from siftline.plans import workflows as w
from siftline.sources import tables as tb
from siftline.sources.sinks import write_table


def test_screen_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text(
        "pos\tsense\tsiRNA\tefficacy\tfunc_filter\n1\tx\tAAUUAAUU\t0.1\t0\n2\tx\tCGGGGGGC\t0.9\t0\n3\tx\tGACACACA\t0.2\t4\n"
    )
    (tmp_path / "p1.tab").write_text("RefSeq\tmicroRNA\tSites\tScore\nr1\tRNA1\t1\t-12.50\n")
    (tmp_path / "p2.tab").write_text("RefSeq\tmicroRNA\tSites\tScore\n")
    names = "\t".join(f"c{i}" for i in range(28))
    row = lambda name, site, score: "\t".join(["r1", "x", name, site, *["-"] * 23, score])
    (tmp_path / "ctx.txt").write_text("\n".join([names, row("RNA2", "6mer", "-1.5"), row("RNA2", "8mer-1a", "bad")]) + "\n")
    (tmp_path / "tox.txt").write_text("Seed\tcell_viability\nGGGGGG\t12.5\n")
    out = w.screen_files(
        spark, str(tmp_path / "c.txt"), [str(tmp_path / "p1.tab"), str(tmp_path / "p2.tab")], str(tmp_path / "ctx.txt"),
        str(tmp_path / "tox.txt"), str(tmp_path / "out"), "gene", top_n=2,
    )
    assert rows(out, "pos", "pita_score", "targetscan_score", "off_target_filter", "toxicity_filter", "filter") == [
        (1, None, None, -5, 0, 1), (2, "-12.50", 0.0, 1, 1, 2), (3, None, 1.5, 1, 0, 2),
    ]
    ranked = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / "gene_ranked"))
    assert [r["pos"] for r in ranked.collect()] == ["2", "3", "1"]


def test_filter_stage(spark, frame, tmp_path):
    listing = frame(
        "path string, volume_name string, artifact_id string, file_path string, media_type string, size_bytes bigint",
        *[(f"v/{n}.pdb", "vol", "art", f"{n}.pdb", None, 1) for n in "abc"],
    )
    write_table(m.manifest_from_listing(listing), str(tmp_path / "m"))
    (tmp_path / "s1.csv").write_text("description,iptm\na_model,0.9\nb_model,0.9\n")
    (tmp_path / "s2.csv").write_text("description,iptm\nb_model,0.2\nx,0.9\n")
    paths = [str(tmp_path / "s2.csv"), str(tmp_path / "s1.csv")]
    audit = w.filter_stage(spark, str(tmp_path / "m"), paths, "Stage1Filter", str(tmp_path / "o"))
    assert rows(audit, "candidate_id", "reason") == [
        ("stage2_input_000001", "passed"), ("stage2_input_000002", "filtered"), ("stage2_input_000003", "missing_score"), ("x", "missing_manifest"),
    ]
    assert tb.read_manifest(spark, str(tmp_path / "o" / "manifest")).count() == 1
    assert rows(spark.read.parquet(str(tmp_path / "o" / "attrition"))) == [("Stage1Filter", 3, 1, 3, 0, 0, 3)]


def test_rank_stage(spark, frame, tmp_path):
    structures = frame("filename string", ("a.pdb",), ("b.pdb",))
    scores = frame("name string, iptm double, o int", ("a", 0.5, 0), ("b", 0.7, 0))
    w.rank_stage(structures, [(scores, ["o"])], str(tmp_path))
    assert rows(spark.read.parquet(str(tmp_path / "ranked")), "rank", "design") == [(1, "b"), (2, "a")]


def test_search_round(frame):
    chains = frame(
        "chain_index int, polymer string, sequence string, unpaired_present boolean, paired_present boolean",
        (0, "rna", "ACG", False, False),
    )
    cached = frame("polymer string, sequence string, database string", ("rna", "ACG", "rfam"))
    line = "{} - q - - - 1 9 1 9 1 + {} {} 0.0 d"
    lines = frame(
        "query string, database string, line_no int, value string",
        ("ACG", "rfam", 0, line.format("h1", "1e-3", 10)), ("ACG", "rfam", 1, line.format("h2", "1e-4", 10)), ("ACG", "ntrna", 0, line.format("h3", "1e-9", 10)),
    )
    alns = frame(
        "query string, database string, description string, aligned_sequence string",
        ("ACG", "rfam", "h1/1-9", "AA"), ("ACG", "rfam", "h2/1-9", "BB"), ("ACG", "ntrna", "h3/1-9", "BB"),
    )
    todo, merged = w.search_round(chains, cached, lines, alns, 3)
    assert rows(todo, "database") == [("ntrna",), ("rnacentral",)]
    assert rows(merged, "database", "hit_id", "rank") == [("rfam", "h1/1-9", 2), ("rfam", "h2/1-9", 1)]


def test_paired_hits_all_stay(frame):
    chains = frame("chain_index int, polymer string, sequence string, unpaired_present boolean, paired_present boolean", (0, "protein", "ACG", False, False))
    cached = frame("polymer string, sequence string, database string")
    line = "{} - q - - - 1 9 1 9 1 + {} {} 0.0 d"
    names = [("uniref90", "h1"), ("uniprot", "h2"), ("uniprot", "h3"), ("mgnify", "h4")]
    lines = frame("query string, database string, line_no int, value string", *[("ACG", d, i, line.format(h, "1e-3", 10)) for i, (d, h) in enumerate(names)])
    alns = frame("query string, database string, description string, aligned_sequence string", *[("ACG", d, f"{h}/1-9", "AA") for d, h in names])
    _, merged = w.search_round(chains, cached, lines, alns, 5)
    assert rows(merged, "part", "hit_id") == [("paired", "h2/1-9"), ("paired", "h3/1-9"), ("unpaired", "h1/1-9")]


def test_reference_dump(spark, tmp_path):
    (tmp_path / "utr.txt").write_text('id\tgene\tx\tspecies\tseq\nT1\tg"\t-\t9606\tac-gT\nT2\tg\t-\t10090\tAA\nshort\tg\n\nT3\tg\t-\t9606\t--\n')
    assert rows(tb.read_reference_table(spark, str(tmp_path / "utr.txt"), "9606", 0, 3, 4)) == [("T1", "ACGU")]


def test_content_hash(frame):
    a = frame("x int, y string", (1, "a"), (2, None))
    again = frame("y string, x int", (None, 2), ("a", 1))
    other = frame("x int, y string", (1, "a"), (2, "null"))
    got = [table_facts(t, "t", content=True).first()["content_hash"] for t in (a, again, other)]
    assert got[0] == got[1] != got[2]
    assert table_facts(a, "t", content=True).first()["row_count"] == 2
