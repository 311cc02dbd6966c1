from conftest import rows
from pyspark.sql import functions as F

from siftline.operators import ranking as r


def test_rank_designs(frame):
    structures = frame("filename string", ("x__design-a.pdb",), ("design-b.pdb",), ("design-c.pdb",))
    dock = frame("reference string, dockq string, o int", ("design-a.pdb", "0.8", 0), ("design-b.pdb", "0.3", 0), ("design-b.pdb", "", 1))
    pred = frame("description string, iptm double, o int", ("design-b", 0.9, 0))
    got = r.rank_designs(structures, [(dock, ["o"]), (pred, ["o"])])
    assert rows(got, "design", "rank_score", "dockq") == [("design-a", 0.8, 0.8)]


def test_rank_designs_modes_and_last_rows(frame):
    structures = frame("filename string", ("a.pdb",), ("b.pdb",))
    first = frame("name string, iptm string, iptm_A_C string, interface_score string, o int",
                  ("a", "0.5", "0.7", "-3", 0), ("a", "junk", "junk", "", 1), ("a", "0.6", "", "", 2))
    later = frame("id string, ranking_score double, chain_A_iptm double, o int", ("b.cif", 0.4, None, 0))
    binder = r.rank_designs(structures, [(first, ["o"]), (later, ["o"])], "binder")
    assert rows(binder, "design", "rank_score", "iptm") == [("a", 63.0, 0.6), ("b", 0.4, 0.4)]
    other = r.rank_designs(structures, [(first, ["o"])], "vhh")
    assert rows(other, "design", "iptm") == [("a", 0.6)]


def test_grid_and_ranking_checks(frame):
    seeds = frame("seed int", (1,), (2,))
    seen = frame(
        "position int, seed int, sample_index int, ranking_score double",
        (1, 1, 0, 0.9), (2, 2, 1, 0.9), (3, 2, 1, 0.8), (4, 3, 0, 0.85), (5, 1, 1, float("nan")),
    )
    assert rows(r.grid_check(seeds, 2, seen), "seed", "sample_index", "status") == [
        (1, 0, "ok"), (1, 1, "ok"), (2, 0, "missing"), (2, 1, "duplicate"), (3, 0, "extra"),
    ]
    problems = {x[0] for x in rows(r.check_ranking(seen, seeds, 2, best=(2, 1)), "problem")}
    assert problems == {"not_finite", "missing", "duplicate", "extra", "wrong_order", "wrong_best"}
    good = frame("position int, seed int, sample_index int, ranking_score double",
                 (1, 2, 0, 0.9), (2, 2, 1, 0.5), (3, 1, 0, 0.4), (4, 1, 1, 0.4))
    assert r.check_ranking(good, seeds, 2, best=(2, 0)).count() == 0
    assert rows(r.best_row(good), "seed", "sample_index") == [(2, 0)]
    assert rows(r.total_rank(good), "rank", "position") == [(i, i) for i in range(1, 5)]


def test_novel_sequences(frame):
    df = frame("sequence_id int, sequence string, score double", (1, "AAA", 3.0), (2, "AAA", 1.0), (3, "ACC", 2.0), (4, "seen", 0.1), (5, "gg-", 0.2))
    seen = frame("sequence string", ("seen",), ("seen",))
    assert rows(r.novel_sequences(df, seen, "C-"), "sequence_id") == [(2,)]
    assert rows(r.novel_sequences(df, seen, ""), "sequence_id") == [(2,), (3,), (5,)]


def test_rule_failures(frame):
    df = frame("failed_rules array<string>", (["Average_pLDDT", "1_pLDDT", "2_pTM"],), (["pLDDT", "6_x"],), ([],))
    assert rows(r.rule_failures(df)) == [("6_x", 1), ("pLDDT", 2), ("pTM", 1)]


def test_accepted_and_averages(frame):
    designs = frame("Design string, s double", ("a_model_x", 0.5), ("b", 0.9), ("c", 0.7))
    files = frame("file_name string", ("a_model_x_model1.pdb",), ("b_model2.pdb",), ("b_model1.pdb",), ("zzz.pdb",))
    assert rows(r.match_accepted(designs, files, "s"), "Rank", "Design", "file_name") == [
        (1, "b", "b_model1.pdb"), (2, "a_model_x", "a_model_x_model1.pdb"),
    ]
    models = frame("d string, x double", ("a", 1.0), ("a", 2.0))
    assert rows(r.average_metrics(models, "d", ["x"])) == [("a", 1.5)]


def test_passing_and_tokens(frame):
    df = frame("id int, pass_filters boolean, final_rank int", (1, True, 2), (2, True, 1), (3, False, 0))
    assert rows(r.passing(df, 0), "id") == [(1,), (2,)]
    assert rows(r.passing(df, 1), "id") == [(2,)]
    logits = frame("i int, v array<float>", (7, [0.0, 2.0, 1.0, 2.0]))
    got = r.top_tokens(logits, ["i"], "v", 3).orderBy("rank").collect()
    assert [(x["rank"], x["token"]) for x in got] == [(1, 1), (2, 3), (3, 2)]
    assert abs(got[0]["probability"] - 0.3995) < 1e-9
    assert rows(r.sort_scores(df, "final_rank", ["id"]).select(F.col("id"))) == [(1,), (2,), (3,)]


def test_later_table_without_the_metric_takes_the_score_away(frame):
    structures = frame("filename string", ("a.pdb",), ("b.pdb",))
    first = frame("description string, iptm string, n int", ("a.pdb", "0.9", 0), ("b.pdb", "0.8", 0))
    later = frame("description string, chain_A_iptm string, n int", ("a.pdb", "0.5", 0))
    got = r.rank_designs(structures, [(first, ["n"]), (later, ["n"])])
    assert rows(got, "design", "rank_score") == rows(r.rank_designs(structures.filter("filename = 'b.pdb'"), [(first, ["n"])]), "design", "rank_score")


def test_a_prediction_listed_twice_may_stand_either_way_round(spark, frame):
    # the same seed, sample and score: the order of the two rows is open
    df = frame("position int, seed int, sample_index int, ranking_score double", (3, 1, 0, 0.4), (2, 2, 0, 0.9), (1, 2, 0, 0.9))
    got = r.check_ranking(df.coalesce(1), frame("seed int", (1,), (2,)), 1)
    assert rows(got, "problem", "seed") == [("duplicate", 2)]
