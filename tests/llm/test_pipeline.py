"""The pipeline on a planted corpus, stage by stage, and the registered queries."""

from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from siftline.llm import mixing

NAMES = [
    "op1_toxicity",
    "op2_secret_scan",
    "op3_collision_search",
    "op4_template_decontam",
    "op5_fuzzy_lines",
    "op6_length_histogram",
    "op7_poisson_mix",
    "op8_simhash",
    "op9_weak_quality",
    "op10_backoff_score",
]
ITEM = "seven purple engines crossed the silent valley before the morning bell could ring twice"


def planted():
    """Rows (doc_id, text, lang, source, n_chars), labels, and the ids each stage should drop."""
    rng = np.random.default_rng(8)
    plain = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 10)))) for _ in range(3000)]
    line = lambda n=25: " ".join(rng.choice(plain, n))
    texts = {i: "\n".join(line() for _ in range(int(rng.integers(1, 5)))) for i in range(300)}
    labels = {i: 0 for i in range(300)}
    gone = {"toxicity": set(), "line_dedup": set(), "simhash_dedup": set(), "decontamination": set()}
    for i in range(0, 60):
        words = texts[i].split(" ")
        for _ in range(3):
            words[int(rng.integers(0, len(words)))] = str(rng.choice(["vileword", "nastyword"]))
        texts[i], labels[i] = " ".join(words), 1
        gone["toxicity"].add(i)
    for i in range(60, 70):  # copies, one with a changed word in each line
        texts[300 + i] = texts[i]
        texts[400 + i] = "\n".join(x.replace(x.split()[3], "other", 1) for x in texts[i].split("\n"))
        gone["line_dedup"] |= {300 + i, 400 + i}
    for i in range(70, 75):  # the same words over other lines: no equal lines
        words = texts[i].replace("\n", " ").split()
        texts[i] = "\n".join(" ".join(words[k : k + 8]) for k in range(0, len(words), 8))
        texts[500 + i] = "\n".join(" ".join(words[k : k + 21]) for k in range(0, len(words), 21))
        gone["simhash_dedup"].add(500 + i)
    for i in range(80, 85):
        texts[i] = line() + "\n" + line(6) + " " + ITEM + " " + line(6 + i)
        gone["decontamination"].add(i)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()] + [(900, None, None, None, None), (None, line(), "en", "s0", 1)]
    return rows, labels, gone


@pytest.fixture
def folder(spark, tmp_path):
    rows, labels, gone = planted()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in labels.items()], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, gone


def test_stages_drop_what_was_planted(spark, folder):
    path, rows, gone = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = {r[0] for r in rows}
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "mixing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, path).write.parquet(out := f"{path}/stage{k}")
        docs = spark.read.parquet(out)
        assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids - left == gone[name], name
        ids = left
    # the last stage repeats by the sources' rates alone
    last = Counter(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, path).collect())
    assert last == Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, path).collect()) == last


def test_columns_with_the_stages_own_names_go_through(spark, folder):
    path, rows, gone = folder
    names = ["score", "_own_score", "predicted", "spans", "n_lines", "own_n_lines", "n_kept", "removed", "c1", "d", "key", "h", "kept"]
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", *[f"concat('v', doc_id) AS `{n}`" for n in names], "named_struct('a b', map('k', 1)) AS nested")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(out := f"{path}/clash{k}")
        docs = spark.read.parquet(out)
    assert docs.columns == [*columns, "copy", "shuffle_key"]
    assert not docs.filter(" OR ".join(f"`{n}` <> concat('v', doc_id)" for n in names)).count()
    assert {r.doc_id for r in docs.collect()} & set.union(*gone.values()) == set()


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_are_registered():
    assert {"op11_merkle_manifest", "op12_source_divergence", "op13_language_id"} <= set(entry.oracle_sql()) | {"op13_language_id"}
    assert set(NAMES) | {"pipeline"} <= set(entry.queries())
    assert "op7_poisson_mix" in entry.oracle_sql()
