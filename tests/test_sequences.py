import hashlib
import random
import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siftline.operators import search
from siftline.operators import sequences as s

MOD = 1 << 64


def plain_signature(records):
    """The signature by a loop over the records."""
    out = {"records": 0, "header_bytes": 0, "sequence_bytes": 0}
    out |= {f"{kind}_{i}": 0 for kind in ("sum", "xor", "square") for i in range(4)}
    for header, body in records:
        h, b = header.encode(), body.encode()
        digest = hashlib.sha256(b"AF3_FASTA_RECORD_V1\x01" + h + b"\x02" + b + struct.pack("<QQ", len(h), len(b))).digest()
        out["records"] += 1
        out["header_bytes"] += len(h)
        out["sequence_bytes"] += len(b)
        for i, v in enumerate(struct.unpack("<4Q", digest)):
            out[f"sum_{i}"] = (out[f"sum_{i}"] + v) % MOD
            out[f"xor_{i}"] ^= v
            out[f"square_{i}"] = (out[f"square_{i}"] + v * v) % MOD
    return out


def signature(df, **kw):
    return [{k: int(v) if k not in ("g",) else v for k, v in r.asDict().items()} for r in s.multiset_signature(df, **kw).collect()]


def test_signature_matches_a_loop(frame):
    random.seed(1)
    records = [(f"h{i % 90} é", "".join(random.choices("ACGU", k=i % 50))) for i in range(300)]
    df = frame("header string, sequence string", *records)
    assert signature(df) == [plain_signature(records)]
    assert signature(df.repartition(7)) == [plain_signature(records)]
    assert signature(df.limit(0)) == [plain_signature([])]
    grouped = df.withColumn("g", F.lit(1)).unionByName(df.limit(1).withColumn("g", F.lit(2)))
    got = {r.pop("g"): r for r in signature(grouped, by=["g"])}
    assert got[1] == plain_signature(records)


def test_same_records(frame):
    a = frame("header string, sequence string", ("a", "X"), ("a", "X"), ("b", "Y"))
    b = frame("header string, sequence string", ("b", "Y"), ("a", "X"))
    assert rows(s.same_records(a, a.orderBy("sequence"))) == [(True,)]
    assert rows(s.same_records(a, b)) == [(False,)]
    assert rows(s.same_records(a, a.limit(0))) == [(False,)]
    assert rows(s.same_records(a.limit(0), a.limit(0))) == [(True,)]
    assert rows(s.exact_differences(a, b, ["header", "sequence"])) == [("a", "X", 2, 1)]


def test_stats_and_gate(frame):
    df = frame("file string, sequence string", ("/d/db-00000-of-00002", "A" * 50), ("/d/db-00001-of-00002", "A" * 51))
    stats = s.seq_stats(df, "file")
    assert rows(stats, "is_total", "num_seqs", "sum_len") == [(False, 1, 50), (False, 1, 51), (True, 2, 101)]
    shards, source = stats.filter("not is_total"), stats.filter("is_total")
    names = s.shard_names(df, "db", 2)
    assert s.shard_gate(source, shards, names).count() == 0
    assert rows(s.imbalance(shards), "balanced") == [(True,)]
    off = df.unionByName(frame("file string, sequence string", ("/d/db-00001-of-00002", "A" * 20), ("/d/other", "")))
    found = s.shard_gate(source, s.seq_stats(off, "file").filter("not is_total"), names)
    assert rows(found) == [("imbalance", None), ("num_seqs_differs", None), ("sum_len_differs", None), ("unknown_shard", "other")]


@pytest.mark.parametrize("parts", [1, 8])
def test_permutation(spark, parts):
    df = spark.range(1000).repartition(parts)
    got = s.permute(df, "id").collect()
    assert sorted(r["position"] for r in got) == list(range(1000))
    again = {r["id"]: r["position"] for r in s.permute(spark.range(1000), "id").collect()}
    assert {r["id"]: r["position"] for r in got} == again
    other = {r["id"]: r["position"] for r in s.permute(spark.range(1000), "id", seed=24).collect()}
    assert other != again
    dealt = s.permute_to_shards(df, "id", 7)
    sizes = [r["n"] for r in dealt.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1


def test_chunks(spark):
    df = spark.range(10)
    sizes = s.chunk(df, ["id"], 4).groupBy("chunk").count().orderBy("chunk").collect()
    assert [(r[0], r[1]) for r in sizes] == [(0, 3), (1, 3), (2, 3), (3, 1)]
    assert s.chunk(spark.range(2), ["id"], 5).select("chunk").distinct().count() == 2
    assert s.chunk(spark.range(0), ["id"], 5).count() == 0
    assert rows(s.stride(df, ["id"], 3).filter("worker = 1"), "id") == [(1,), (4,), (7,)]


def test_tiles_cover_every_pair(frame):
    left, right = frame("l int", (1,), (2,), (3,)), frame("r int", (1,), (2,))
    a, b = s.blocks(left, ["l"], 2), s.blocks(right, ["r"], 2)
    tiles = s.tile_pairs(a, b, 2)
    assert tiles.count() == 4
    assert tiles.agg(F.sum("pairs")).first()[0] == 6
    pairs = s.tile_of(a, tiles, "left").join(s.tile_of(b, tiles, "right"), ["left_block", "right_block"])
    assert pairs.select("l", "r").distinct().count() == pairs.count() == 6


def test_windows(frame):
    df = frame("id int, sequence string", (1, "ACGUACGUACGUACGUACGUA"), (2, "ACG"), (3, "A" * 19))
    got = s.tile_windows(df, ["id"]).collect()
    assert [(r["id"], r["pos"]) for r in got] == [(1, 1), (1, 2), (1, 3), (3, 1)]
    assert got[3]["sense"] == "U" * 19
    text = "".join(random.Random(2).choices("ACGU", k=5000))
    tiled = s.tile_windows(frame("id int, sequence string", (1, text)), ["id"]).collect()
    assert [(r["pos"], r["siRNA"]) for r in tiled] == [(i + 1, text[i : i + 19]) for i in range(5000 - 18)]
    assert [r["run_flag"] for r in s.add_sequence_flags(s.tile_windows(df, ["id"])).collect()] == [0, 0, 0, 1]


def test_window_summary_equals_the_windows_one_by_one(frame, monkeypatch):
    from siftline.functions import letters

    monkeypatch.setattr(letters, "_PIECE", 50)
    rng = random.Random(8)
    texts = ["".join(rng.choices(letters_of, k=n)) for letters_of in ("ACGU", "GGCCA", "abba é😀", "AU") for n in (18, 19, 20, 68, 69, 150)]
    data = [(i % 9, t) for i, t in enumerate([*texts, "A" * 30, "", None])]
    df = frame("id int, sequence string", *data)
    flags = ("gc_flag", "run_flag", "gc_run_flag", "palindrome_flag", "func_filter")
    tiled = {}
    for r in s.add_sequence_flags(s.tile_windows(df, ["id"])).collect():
        tiled.setdefault(r.id, []).append(r)
    wanted = [
        (i, len(w), max(r.pos for r in w), min(r.siRNA for r in w), max(r.sense for r in w), *[sum(r[c] for r in w) for c in flags])
        for i, w in tiled.items()
    ]
    found = s.window_summary(df, ["id"])
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert "Generate" not in found._jdf.queryExecution().toString()  # windows are no rows


def test_references(frame):
    table = frame("t string, sp string, q string", (" ENST1 ", "9606 ", " acg-t "), ("ENST2", "10090", "AC"), ("", "9606", "A"), ("ENST3", "9606", "--"), ("ENST4", "9606", None))
    assert rows(s.convert_reference_table(table, "9606", "t", "sp", "q")) == [("ENST1", "ACGU")]
    utr = frame("name string, sequence string", ("a b", "U"), ("c", "U"))
    orf = frame("name string, sequence string", ("c", "O"), ("a_@_b", "O"))
    assert rows(s.align_references(utr, orf)) == [("a b", "U", None), ("c", "U", "O")]
    assert rows(s.align_references(utr, orf, keep_all=False)) == [("c", "U", "O")]
    assert rows(s.check_pairs(utr, orf)) == [("a_@_b", "a b", "a_@_b")]
    assert rows(s.intersect_names(utr, orf)) == [("c",)]


def test_check_pairs_of_many_equal_names(spark):
    many = spark.range(300).select(F.lit("a b").alias("name"))
    one = s.check_pairs(many, many.select(F.lit("a_@_b").alias("name")))
    assert rows(one) == [("a_@_b", "a b", "a_@_b")]
    assert s.check_pairs(many, many).count() == 0


def test_repeats_and_unions(frame):
    df = frame("o int, seed int", (1, 5), (2, 6), (3, 5), (4, 5))
    assert rows(s.repeats(df, "seed", "o"), "o") == [(3,), (4,)]
    assert rows(s.union_loose(df, frame("seed int, x int", (9, 1)))) == [(None, 9, 1), (1, 5, None), (2, 6, None), (3, 5, None), (4, 5, None)]
    with pytest.raises(ValueError):
        s.union_exact(df, frame("seed int", (1,)))
    assert rows(s.table_facts(df, "t")) == [("t", 4, "o,seed")]


def test_hit_merge(frame):
    def line(name, e, score):
        return f"{name} - q - - - 1 9 1 9 1 + {e} {score} 0.0 more  words"

    lines = frame("shard int, value string", (0, "# comment"), (0, ""), (0, line("hitB", "1e-5", "50")), (1, line("hitA", "1e-5", "50")), (1, line("hitC", "1e-2", "60")), (1, line("noaln", "1e-9", "90")), (0, line("hitB", "1e-6", "1")), (2, line("hitB", "1e-5", "50")))
    hits = search.parse_hits(lines)
    assert rows(hits.filter("hit_id like 'noaln%'"), "e_value", "score", "description") == [(1e-9, 90.0, "more  words")]
    alns = frame("description string, sequence string", ("hitA/1-9 x", "AA"), ("hitB/1-9", "BB"), ("hitC/1-9 y z", "CC"), ("gone/1-9", "DD"))
    merged = search.merge_top_k(search.join_hits(alns, hits, ["shard"]), 3)
    assert [(r["rank"], r["hit_id"]) for r in merged.orderBy("rank").collect()] == [(1, "hitA/1-9"), (2, "hitB/1-9")]
    with pytest.raises(ValueError):
        search.merge_top_k(merged, 1)
    with pytest.raises(Exception, match="invalid hit row"):
        search.parse_hits(frame("value string", ("too short",))).collect()


def test_plan(frame):
    chains = frame(
        "chain_index int, polymer string, sequence string, unpaired_present boolean, paired_present boolean",
        (0, "protein", "AAA", True, False), (1, "protein", "AAA", False, True), (2, "rna", "ACG", False, False), (3, "rna", "GGG", True, False),
    )
    searches, assemblies = search.plan_tasks(chains)
    assert rows(assemblies) == [("protein", "AAA", True, True), ("rna", "ACG", True, False)]
    assert searches.count() == 7
    cached = searches.filter("polymer = 'rna'")
    assert search.missing(searches, cached, ["polymer", "sequence", "database"]).count() == 4
    grouped = search.group_chains(chains.withColumnRenamed("sequence", "identity"), "identity")
    assert rows(grouped.filter("identity = 'AAA'"), "segment", "items") == [(0, [0, 1])]


def test_databases_and_templates(frame):
    hits = frame("database string, o int, sequence string", ("mgnify", 0, "S1"), ("uniref90", 1, "S1"), ("uniref90", 0, "S2"), ("other", 0, "S3"))
    got = search.stack_databases(hits, ["uniref90", "small_bfd", "mgnify"], ["o"])
    assert rows(got, "database", "o", "sequence") == [("uniref90", 0, "S2"), ("uniref90", 1, "S1")]
    t = "query string, release_date date, hit_sequence string, align_ratio double, sub_ratio double, e_value double, name string"
    import datetime as d

    day, late = d.date(2020, 1, 1), d.date(2022, 1, 1)
    templates = frame(
        t,
        *[("q", day, f"SEQUENCE{i:02d}", 0.5, 0.5, float(i), f"n{i}") for i in range(6)],
        ("q", day, "SEQUENCE00", 0.5, 0.5, 9.0, "again"),
        ("q", late, "LATESEQUENCE", 0.5, 0.5, 0.0, "late"),
        ("q", day, "SHORT", 0.5, 0.5, 0.0, "short"),
        ("q", day, "LOWALIGNED10", 0.05, 0.5, 0.0, "align"),
        ("q", day, "WHOLEQUERY10", 0.5, 0.99, 0.0, "sub"),
    )
    assert rows(search.filter_templates(templates, "2021-09-30"), "rank", "name") == [(1, "n0"), (2, "n1"), (3, "n2"), (4, "n3")]
