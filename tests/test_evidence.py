import math

import pytest
from conftest import rows

from siftline.operators import evidence as ev
from siftline.sources.tables import read_evidence_tsv


@pytest.fixture
def result(frame):
    return frame(
        "pos int, siRNA string, efficacy double, func_filter int",
        (1, "AAAA", 0.1, 0), (2, "CCCC", 0.9, 4), (3, "GGGG", 0.2, 0),
    )


def test_top_candidates(result):
    assert rows(ev.off_target_candidates(result, 2)) == [("RNA1", "CCCC"), ("RNA2", "GGGG")]
    assert ev.off_target_candidates(result, -1).count() == 3


def test_min_with_text_ties(frame):
    hits = frame(
        "guide string, energy string, o int",
        ("g7", "0.50", 5), ("g7", ".5", 3), ("g7", "5e-1", 4), ("g8", "n/a", 2), ("g8", "", 1), ("g9", "-0", 1), ("g9", "NaN?", 0), ("g9", "0.0", 2),
    )
    got = ev.min_with_text(hits, "guide", "energy", ["o"])
    # equal numbers go to the first row; a key without any number keeps its first text
    assert rows(got) == [("g7", ".5", 0.5), ("g8", "", None), ("g9", "-0", 0.0)]


def test_evidence(frame, result):
    pita = frame("microRNA string, Score string, o int", ("RNA0", "-10.50", 7), ("RNA0", "-10.5", 9), ("RNA1", "-10", 0), ("RNA1", "-9", 1), ("RNA2", "8", 0))
    ts = frame("siRNA string, targetscan_score double", ("RNA0", 0.25), ("RNA0", 1.75))
    got = ev.apply_evidence(result, pita, ts, ["o"], top_n=-1)
    assert rows(got, "pos", "pita_score", "targetscan_score", "off_target_filter") == [
        (1, "-10.50", 1.75, 1), (2, "-10", 0.0, 0), (3, "8", 0.0, 0),
    ]
    top = ev.apply_evidence(result, pita, ts, ["o"], top_n=2)
    assert rows(top, "pos", "off_target_filter") == [(1, -5), (2, 0), (3, 0)]


def test_header_only_evidence(spark, frame, result, tmp_path):
    (tmp_path / "pita.tab").write_text("RefSeq\tmicroRNA\tSites\tScore\n")
    (tmp_path / "ts.tab").write_text("")
    pita = read_evidence_tsv(spark, str(tmp_path / "pita.tab"), ["RefSeq", "microRNA", "Sites", "Score"])
    ts = read_evidence_tsv(spark, str(tmp_path / "ts.tab"), ["refseq", "siRNA", "targetscan_score"], ["targetscan_score"])
    got = ev.apply_evidence(result, pita, ts, ["RefSeq"], top_n=-1)
    assert rows(got, "pos", "pita_score", "targetscan_score", "off_target_filter") == [
        (1, None, None, 0), (2, None, None, 0), (3, None, None, 0),
    ]
    assert got.schema["pita_score"].dataType.simpleString() == "string"


def test_site_cuts(frame):
    # on, just below and far below each type's cut
    cases = [(kind, cut + step, step < 0) for kind, cut in ev.SITE_CUTS.items() if cut is not None for step in (0.0, -1 / 1024, -7.0, 2.0)]
    cases += [("6mer", 12.5, True), ("6mer", -3.25, True), ("6mer", None, False), ("9mer", -50.0, False), (None, -50.0, False)]
    sites = frame("n int, site_type string, score double, owner string", *[(i, kind, score, f"o{i % 2}") for i, (kind, score, _) in enumerate(cases)])
    kept = ev.site_cut(sites)
    assert [r[0] for r in rows(kept, "n")] == sorted((i for i, case in enumerate(cases) if case[2]), key=str)
    want = {}
    for i, (_, score, keep) in enumerate(cases):
        if keep:
            want[f"o{i % 2}"] = want.get(f"o{i % 2}", 0.0) - score
    assert dict(ev.neg_sum(kept, ["owner"]).collect()) == pytest.approx(want)
    own = frame("n int, site_type string, score double", (1, "x", 4.0), (2, "x", 5.0), (3, "6mer", 0.0))
    assert rows(ev.site_cut(own, cuts={"x": 5.0}), "n") == [(1,)]


def test_toxicity_and_final_filter(frame):
    result = frame("siRNA string, func_filter int, off_target_filter int", ("xABCDEFy", 4, -5), ("xUUUUUUy", 0, 0))
    table = frame("Seed string, cell_viability double", ("ABCDEF", 49.0))
    got = ev.apply_final_filter(ev.apply_toxicity(result, table))
    assert rows(got, "Seed", "toxicity_filter", "filter") == [("ABCDEF", 1, 3), ("UUUUUU", 0, 0)]
    only = ev.apply_final_filter(got, off_target=False, toxicity=False)
    assert rows(only, "filter") == [(0,), (1,)]


def test_lse(frame):
    values = [-1.0, 2.5, -700.0, 800.0]
    df = frame("k string, e double", *[("a", v) for v in values], ("b", 3.25))
    got = {r[0]: (r[1], r[2]) for r in ev.lse_average(df, ["k"], "e", 9).collect()}
    peak = max(-v for v in values)
    want = -(peak + math.log(sum(math.exp(-v - peak) for v in values)))
    assert got == {"a": (4, pytest.approx(want)), "b": (1, pytest.approx(3.25))}


def test_sorting(frame):
    hits = frame("gene string, Score string", *[(g, t) for g in ("k2", "k10") for t in ("7", "-0.125", "1e2", "7.0", "-64")])
    assert [tuple(r) for r in ev.sort_with_text(hits).collect()] == [
        ("k10", "-64"), ("k2", "-64"), ("k10", "-0.125"), ("k2", "-0.125"),
        ("k10", "7"), ("k10", "7.0"), ("k2", "7"), ("k2", "7.0"), ("k10", "1e2"), ("k2", "1e2"),
    ]
    pairs = [(f"r{i}", f"s{j}") for i in (3, 1, 2) for j in (2, 1)]
    tables = [frame("refseq string, siRNA string", *pairs[i::3]) for i in range(3)]
    assert [tuple(r) for r in ev.sort_pair(*tables).collect()] == sorted(pairs)


def test_split_equals_whole(frame, result):
    pita = frame("microRNA string, Score string, o int", *[(f"RNA{i % 3}", str(-i), i) for i in range(30)])
    ts = frame("siRNA string, targetscan_score double", *[(f"RNA{i % 3}", i / 10) for i in range(30)])
    whole = rows(ev.apply_evidence(result, pita, ts, ["o"], top_n=-1))
    for parts in (1, 8):
        again = ev.apply_evidence(result.repartition(parts), pita.repartition(parts), ts.repartition(parts), ["o"], top_n=-1)
        assert rows(again) == whole
