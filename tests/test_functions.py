import hashlib
import json
import math
import random
import struct

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftline.functions import digest, keys, numbers, rules


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("name", "key"),
    [
        ("artifact__nested__design-1.pdb", "design-1"),
        ("design-2.cif", "design-2"),
        (
            "refold_5b8c_vhh_refold-flow_5b8c_vhh_stage2_abmpnn-sample0_1_seed-1_sample-0_model.cif",
            "flow_5b8c_vhh_stage2_abmpnn-sample0_1",
        ),
        ("x_model_scores.csv", "x"),
        ("x_scores_model.csv", "x_scores"),
        ("x_summary_confidences.json", "x"),
        ("x_confidences_summary_confidences.json", "x"),
        ("x_summary_confidences_confidences.json", "x_summary_confidences"),
        ("A/B/Deep.Name.pdb", "deep.name"),
        ("dir/./", "dir"),
        ("a/d.x//./", "d"),
        ("./", ""),
        (".", ""),
        ("/", ""),
        ("a/..", ".."),
        (".hidden", ".hidden"),
        ("trailing.", "trailing."),
        ("", ""),
        ("a.b_model.pdb", "a.b"),
        ("x.tar_model", "x"),
        ("x_model.tar_scores", "x"),
        ("_model.pdb", ""),
        (".pdb_model", ".pdb"),
        ("a_model.", "a_model."),
        ("a..b", "a."),
        ("..b", "."),
        ("s_scores_seed-1_sample-2_model.cif", "s"),
    ],
)
def test_candidate_key(spark, name, key):
    assert one(spark, keys.candidate_key(F.lit(name))) == key


@pytest.mark.parametrize(
    ("path", "posix", "flat"),
    [
        ("a\\b/./c//d", "a/b/c/d", "a\\b_c_d"),
        ("/x/../y", "/x/../y", "y"),
        ("//x", "//x", "x"),
        ("///x", "/x", "x"),
        ("", ".", None),
        ("a/../../b", "a/../../b", "b"),
        (" a ", " a ", "a"),
    ],
)
def test_paths(spark, path, posix, flat):
    assert one(spark, keys.posix_path(F.lit(path))) == posix
    assert one(spark, keys.sanitize(F.lit(path))) == flat


def test_row_key_takes_first_non_empty(frame):
    df = frame(
        "candidate_id string, reference string, name string",
        ("", "ref-1.pdb", "n"), (None, None, "N_model.cif"), (None, "", ""), ("c", "r", "n"),
    )
    got = [r[0] for r in df.select(keys.row_key(df)).collect()]
    assert got == ["ref-1", "n", "", "c"]


def test_row_key_skips_zero_and_false(frame):
    df = frame("candidate_id int, reference boolean, name string", (0, False, "n"), (0, True, "n"), (7, None, "n"))
    assert [r[0] for r in df.select(keys.row_key(df)).collect()] == ["n", "true", "7"]


def test_candidate_ids_hash_compact_sorted_json(spark):
    nasty = 'q"uote\\u000B\x0b\x1f\té.pdb'
    got = one(spark, keys.initial_id(F.lit("s"), F.lit("art"), F.lit(f"in/{nasty}")))
    payload = {
        "basename": nasty.replace("\\", "/").split("/")[-1],
        "kind": "initial",
        "source_artifact_id": "art",
        "source_path": f"in/{nasty}".replace("\\", "/"),
        "stage_name": "s",
    }
    text = json.dumps(payload, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert got == "cand_" + hashlib.sha256(text.encode()).hexdigest()[:16]


def test_json_text_escapes(spark):
    for value in ['a"b', "back\\slash", "\x0b\x1b\x7f", "\\u001B", "\\\\\x1a", "line\nbreak", "é€"]:
        got = one(spark, keys.json_text(F.lit(value)))
        assert got == json.dumps(value, ensure_ascii=False), value


def test_framed_hash(spark):
    want = hashlib.sha256()
    for part in ("ab", "c\td"):
        data = json.dumps(part).encode()
        want.update(len(data).to_bytes(8, "big") + data)
    assert one(spark, keys.framed_hash(F.lit("ab"), F.lit("c\td"))) == want.hexdigest()


def test_safe_name(spark):
    assert one(spark, keys.safe_name(F.lit("gene 1|x__y."))) == "gene_@_1_x_y"
    assert one(spark, keys.safe_name(F.lit("___"))) is None
    long = "a" * 181
    want = "a" * 160 + "_" + hashlib.sha256(long.encode()).hexdigest()[:16]
    assert one(spark, keys.safe_name(F.lit(long))) == want
    assert one(spark, keys.safe_name(F.lit("a" * 180))) == "a" * 180


def test_small_keys(spark):
    assert one(spark, keys.seed_slice(F.lit("ABCDEFGH"))) == "BCDEFG"
    assert one(spark, keys.offset_name(F.lit(5))) == "RNA4"
    assert one(spark, keys.int_list(F.lit("1, 2,,3 "))) == [1, 2, 3]
    assert one(spark, keys.strip_replicate(F.lit("a_b_12"))) == "a_b"
    assert one(spark, keys.strip_replicate(F.lit("a_b12"))) == "a_b12"
    assert one(spark, keys.redact(F.lit("id fc-1 fc-12"), F.lit("fc-1"))) == (
        "id [function-call-id-redacted] [function-call-id-redacted]2"
    )
    assert one(spark, keys.redact(F.lit("x"), F.lit(""))) == "x"


def test_prefix_ids(frame):
    df = keys.prefix_ids(frame("id string, n int", ("a", 1), (None, 2)), "r", ["id"])
    assert rows(df) == [(None, 2), ("r_a", 1)]


@pytest.mark.parametrize(
    ("text", "value"),
    [(" 0.8 ", 0.8), ("1e3", 1000.0), (".5", 0.5), ("1.0d", None), ("0x1p3", None), ("", None), ("abc", None), ("-inf", -math.inf)],
)
def test_lenient_numbers(spark, text, value):
    assert one(spark, numbers.to_double(F.lit(text))) == value


def check(df, conditions):
    return [r[0] for r in df.select(rules.compile_rules(df, conditions)).collect()]


def test_rules(frame):
    df = frame("iptm string, dockq double", ("0.81", 0.55))
    assert check(df, {"iptm": "> 0.8", "dockq": ">= 0.5"}) == [True]
    assert check(df, {"iptm": "> 0.9"}) == [False]
    assert check(df, {"iptm": 0.81}) == [True]
    assert check(df, {"iptm": {">": 0.8, "<=": 0.81}}) == [True]
    assert check(df, {"iptm": "> 0.8, < 0.81"}) == [False]
    assert check(df, {"dockq": "!= 0.5"}) == [True]
    for bad in ({"iptm": "roughly 0.8"}, {"iptm": {"~": 1}}, {"absent": "> 1"}):
        with pytest.raises(ValueError):
            check(df, bad)


def test_rules_on_nan_and_text(frame):
    df = frame("a double, b string", (float("nan"), "x"))
    for op in (">", ">=", "<", "<=", "=="):
        assert check(df, {"a": f"{op} 0"}) == [False]
    assert check(df, {"a": "!= 0"}) == [True]
    # the row fails on `a`, so the text in `b` is never looked at
    assert check(df, {"a": "> 0", "b": "> 0"}) == [False]
    with pytest.raises(PySparkException, match="invalid or missing filter metric"):
        check(df, {"a": "!= 0", "b": "> 0"})


def test_default_rules(frame):
    assert rules.default_rules("Stage1Filter") == {"iptm": "> 0.7"}
    assert rules.default_rules("Stage2Filter") == {"iptm": "> 0.8"}
    assert rules.default_rules("x", {"score_column": "s", "threshold": 3}) == {"s": ">= 3"}
    with pytest.raises(ValueError):
        rules.default_rules("x", {"filters": {}})
    assert rules.filename_column(frame("pdb string", ("a",))) == "pdb"
    with pytest.raises(ValueError):
        rules.filename_column(frame("other string", ("a",)))


def test_softmax_and_flags(frame):
    df = frame("v array<double>", ([1000.0, 1000.0],), ([0.0, math.log(3)],))
    got = [r[0] for r in df.select(numbers.softmax(F.col("v"))).collect()]
    assert got[0] == [0.5, 0.5]
    assert got[1] == pytest.approx([0.25, 0.75])
    flags = numbers.sequence_flags(F.col("s"))
    seqs = frame("s string", ("ACGUACGUACGUACGUACG",), ("AAAAAUUCUGUACUAGCUA",), ("GGCCGGAAUUAUAUCAUCA",))
    got = [tuple(r) for r in seqs.select(flags["run_flag"], flags["gc_run_flag"], flags["palindrome_flag"]).collect()]
    assert got[0][2] == 1 and got[1][0] == 1 and got[2][1] == 1


def test_digest_words_and_squares(frame):
    random.seed(5)
    values = [0, 1, (1 << 64) - 1, 1 << 32, (1 << 32) - 1] + [random.getrandbits(64) for _ in range(50)]
    df = frame("h bigint, l bigint", *[(v >> 32, v & 0xFFFFFFFF) for v in values])
    high, low = digest.square_words("h", "l")
    got = [(r[0] << 32) | r[1] for r in df.select(high, low).collect()]
    assert got == [v * v % (1 << 64) for v in values]


def test_record_digest(spark):
    header, body = "h é", "ACGT"
    data = b"AF3_FASTA_RECORD_V1\x01" + header.encode() + b"\x02" + body.encode()
    data += struct.pack("<QQ", len(header.encode()), len(body))
    want = hashlib.sha256(data)
    assert one(spark, digest.record_digest(F.lit(header), F.lit(body))) == want.hexdigest()
    first = struct.unpack("<Q", want.digest()[:8])[0]
    hexed = f"'{want.hexdigest()}'"
    assert (one(spark, digest.word(hexed, 1)) << 32) | one(spark, digest.word(hexed, 0)) == first
