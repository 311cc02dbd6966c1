"""Named files, zipped dumps, JSON verdicts, checked joins and the row-by-row permutation."""

import os
import zipfile

import pytest
from conftest import rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

from siftline.operators import checked
from siftline.sources import archives, json_files


def named(count, stem="x", suffix=""):
    return [f"{stem}-{i:05d}-of-{count:05d}{suffix}" for i in range(count)]


def test_every_shard_is_one_file(spark, frame, tmp_path):
    df = frame("shard int, place int, value string", (2, 2, "c"), (2, 1, "é b"), (0, 1, "a"))
    archives.write_named_shards(df, str(tmp_path / "o"), "x", 4)
    assert sorted(os.listdir(tmp_path / "o")) == named(4)
    assert [(tmp_path / "o" / n).read_text() for n in named(4)] == ["a\n", "", "é b\nc\n", ""]
    archives.write_named_shards(df.limit(0), str(tmp_path / "none"), "x", 2)
    assert sorted(os.listdir(tmp_path / "none")) == named(2)


def test_a_large_shard_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    df = spark.range(0, 20_000, 1, 7).selectExpr("cast(if(id % 10 = 0, 2, 0) as int) AS shard", "-id AS place", "concat('é', id) AS value")
    monkeypatch.setattr(archives, "_PIECE", 20_000)
    tasks = []
    real = archives._put_together
    # rows of each piece before they are put together
    monkeypatch.setattr(archives, "_put_together", lambda s, w: tasks.extend(x.read_bytes().count(b"\n") for x in (tmp_path / "o").glob("_staging-*/0*")) or real(s, w))
    archives.write_named_shards(df, str(tmp_path / "o"), "x", 3)
    assert len(tasks) > 5 and max(tasks) < 5_000 and sum(tasks) == 20_000
    assert sorted(os.listdir(tmp_path / "o")) == named(3)
    wanted = [[f"é{i}" for i in range(19_999, -1, -1) if i % 10], [], [f"é{i}" for i in range(19_990, -1, -10)]]
    assert [(tmp_path / "o" / n).read_text().splitlines() for n in named(3)] == wanted


@pytest.mark.parametrize("shard", [None, 7, -1])
def test_a_failed_query_leaves_no_file(frame, tmp_path, shard):
    df = frame("shard int, place int, value string", (0, 1, "a"), (shard, 1, "b"))
    with pytest.raises(Exception, match="out of range"):
        archives.write_named_shards(df, str(tmp_path / "o"), "x", 4)
    assert not (tmp_path / "o").exists() or os.listdir(tmp_path / "o") == []


def test_a_failed_task_is_repeated(tmp_path):
    writer = archives._ShardWriter(str(tmp_path), "x", 2, False, "")

    def rows_of(text, fail=False):
        yield {"shard": 1, "value": text}
        if fail:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(rows_of("half", True))
    writer.commit([writer.write(rows_of("whole"))])
    assert sorted(os.listdir(tmp_path)) == named(2)
    assert (tmp_path / named(2)[1]).read_text() == "whole\n"
    other = archives._ShardWriter(str(tmp_path / "b"), "x", 2, False, "")
    with pytest.raises(ValueError, match="two tasks"):
        other.commit([other.write(rows_of("a")), other.write(rows_of("b"))])


def test_zipped_lines(spark, frame, tmp_path):
    first = [f"line {i}" for i in range(10_000)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("folder.txt/", "")
        z.writestr("readme.md", "no")
        z.writestr("data.txt", "\r\n".join(first) + "\r\n")
        z.writestr("later.txt", "not read")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("empty.txt", "")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("z.txt", "\tü\n\nlast")
    (tmp_path / "other.dat").write_text("x")
    got = archives.read_zipped_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 3
    a = got.filter(F.col("archive").endswith("a.zip")).orderBy("line_number").collect()
    assert [r.line for r in a] == first
    assert rows(archives.read_zipped_lines(spark, str(tmp_path / "c.zip")), "line_number", "line") == [(0, "\tü"), (1, ""), (2, "last")]
    assert archives.read_zipped_lines(spark, str(tmp_path / "[bc].zip")).count() == 3
    assert archives.read_zipped_lines(spark, f"file://{tmp_path}/?.zip").count() == 10_003
    (tmp_path / "none").mkdir()
    assert archives.read_zipped_lines(spark, str(tmp_path / "none")).count() == 0
    with zipfile.ZipFile(tmp_path / "none" / "d.zip", "w") as z:
        z.writestr("a.csv", "x")
    with pytest.raises(Exception, match="no member"):
        archives.read_zipped_lines(spark, str(tmp_path / "none")).count()


def test_zip_and_text_give_the_same_records(spark, tmp_path):
    from siftline.sources import tables

    body = "t\tx\ts\tseq\nA \t1\t 9606\tac-gT\nB\t1\t10\tAC\nC\t1\n\t1\t9606\tAA\nD\t1\t9606\tt\n"
    (tmp_path / "d.txt").write_text(body)
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.txt", body)
    zipped = archives.read_zipped_reference(spark, str(tmp_path / "d.zip"), "9606", 0, 2, 3)
    assert rows(zipped) == rows(tables.read_reference_table(spark, str(tmp_path / "d.txt"), "9606", 0, 2, 3)) == [("A", "ACGU"), ("D", "U")]


def test_json_lines_are_judged_by_file(spark, tmp_path):
    files = {
        "good one": '{"k":"1","v":{"a":[1]}}\n\n  \r\n{"k":"2"}', "bad": '{"k":"1"}\n{"k":', "list": '[1]\n{"k":"9"}', "number": '{"k":"1"}\n{"k":1}',
        "null": '{"k":null}', "twice": '{"k":"1"}\n{"k":"2"}\n{"k":"1"}', "empty": "", "blank": "\n \n",
    }
    for name, body in files.items():
        (tmp_path / f"{name}.jsonl").write_text(body)
    judged = json_files.judge_jsonl(spark, str(tmp_path), "k")
    got = {os.path.basename(r.source_file).replace("%20", " ")[:-6]: (r.records, r.reason) for r in judged.files.collect()}
    assert got == {
        "good one": (2, None), "bad": (2, "unparsable"), "list": (2, "not an object"), "number": (2, "no key"), "null": (1, "no key"),
        "twice": (3, "repeated key"), "empty": (0, "empty"), "blank": (0, "empty"),
    }
    assert rows(judged.rows.select("k", F.to_json("record").alias("j"))) == [("1", '{"k":"1","v":{"a":[1]}}'), ("2", '{"k":"2"}')]


def test_metrics_keep_each_files_own_types(spark, tmp_path):
    for name, body in {"A_model": '{"x":1,"y":null,"z":{"q":1},"b":true}', "B": '{"x":{"a":1},"z":"s"}', "C": "[1]", "D": '{"x":nul', "E": '{"x":null}', "F": "{}"}.items():
        (tmp_path / f"{name}.json").write_text(body)
    judged = json_files.judge_metrics(spark, str(tmp_path), "s")
    assert rows(judged.rows, "candidate_id", "name", "value", "kind") == [
        ("a", "b", "true", "BOOLEAN"), ("a", "x", "1", "BIGINT"), ("a", "y", None, "VOID"), ("b", "z", "s", "STRING"), ("e", "x", None, "VOID"),
    ]
    reasons = {os.path.basename(r.source_file): (r.records, r.reason) for r in judged.files.collect()}
    assert reasons == {"A_model.json": (3, None), "B.json": (1, None), "C.json": (0, "not an object"), "D.json": (0, "unparsable"), "E.json": (1, None), "F.json": (0, "empty")}


def test_checked_join(spark, frame):
    need = frame("candidate_id string, a int", ("x", 1), ("y", 2), ("x", 3))
    have = frame("candidate_id string, b int", ("x", 10), ("y", 20), ("z", 30))
    seen = Observation()
    good = checked.checked_join(need, have, seen=seen)
    assert rows(good) == [("x", 1, 10), ("x", 3, 10), ("y", 2, 20)]
    assert seen.get == {"rows": 3, "missing": 0}
    twice = have.unionByName(frame("candidate_id string, b int", ("y", 21)))
    for act in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("a").collect(), lambda df: df.write.format("noop").mode("overwrite").save()):
        with pytest.raises(Exception, match="repeated id: y"):
            act(checked.checked_join(need, twice))
        with pytest.raises(Exception, match="missing id: y"):
            act(checked.checked_join(need, have.filter("candidate_id <> 'y'")))
    assert checked.checked_join(need, have.filter("candidate_id <> 'y'"), allow_missing=True).count() == 2
    with pytest.raises(Exception, match="missing id: null"):
        checked.checked_join(frame("candidate_id string, a int", (None, 1)), have).count()
    # a repeated id that is not asked for does no harm
    assert checked.checked_join(need, have.unionByName(frame("candidate_id string, b int", ("z", 31)))).count() == 3


def test_a_checked_join_scans_each_side_once(spark, frame, tmp_path):
    frame("candidate_id string, a int", ("x", 1)).write.parquet(str(tmp_path / "n"))
    frame("candidate_id string, b int", ("x", 1)).write.parquet(str(tmp_path / "h"))
    df = checked.checked_join(spark.read.parquet(str(tmp_path / "n")), spark.read.parquet(str(tmp_path / "h")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 1000, 4095])
def test_permutation(spark, n):
    df = spark.range(-1, n + 1)
    got = {r[0]: r[1] for r in checked.permuted(df, "id", n, 7, "p").collect()}
    assert sorted(got[i] for i in range(n)) == list(range(n))
    assert got[-1] is None
    assert got[n] is None
    if n == 1000:
        other = {r[0]: r[1] for r in checked.permuted(df, "id", n, 8, "p").collect()}
        assert sum(got[i] == other[i] for i in range(n)) < 30
        assert sum(abs(got[i] - got[i + 1]) == 1 for i in range(n - 1)) < 30


def test_the_permutation_is_a_projection(spark):
    placed = checked.permute_to_shards(spark.range(1000).withColumnRenamed("id", "i"), "i", 7, 1000)
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    counts = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
    big = spark.createDataFrame([(0,), (10**15 - 1,), (123_456_789_012_345,)], "i bigint")
    big = checked.permuted(big, "i", 10**15, name="p")
    assert all(0 <= r.p < 10**15 for r in big.collect())


def test_each_row_is_a_file_in_its_tasks_folder(spark, frame, tmp_path):
    path = str(tmp_path / "files")
    df = frame("name string, value string", *[(f"a{i}.json", f'{{"x": {i}}}') for i in range(40)], ("é.json", '{"x": "ü"}'))
    archives.write_named_files(df, path, 3)
    folders = os.listdir(path)
    assert len(folders) <= 3
    assert all(f.startswith("files-") for f in folders)
    assert sorted(n for f in folders for n in os.listdir(f"{path}/{f}")) == sorted([f"a{i}.json" for i in range(40)] + ["é.json"])
    found = json_files.judge_metrics(spark, f"{path}/files-*", "s").rows
    assert rows(found, "candidate_id", "value") == sorted([(f"a{i}", str(i)) for i in range(40)] + [("é", "ü")])


def test_a_name_that_comes_twice_leaves_no_file(frame, tmp_path):
    path = str(tmp_path / "files")
    with pytest.raises(Exception, match="comes twice"):
        archives.write_named_files(frame("name string, value string", ("a", "1"), ("a", "2")), path, 2)
    assert os.listdir(path) == []
