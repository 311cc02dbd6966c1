"""Merkle manifests against a plain tree in memory."""

import hashlib
import zlib

import pytest

from siftline.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text):
    values = (doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text)
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(digests):
    """Top, and for each leaf the (siblings before, siblings after) of each level."""
    proofs = [[] for _ in digests]
    spans = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, reach = [], []
        for a in range(0, len(digests), 16):
            run = digests[a : a + 16]
            for i in range(len(run)):
                for x in spans[a + i]:
                    proofs[x].append((run[:i], run[i + 1 :]))
            up.append(h(run))
            reach.append([x for s in spans[a : a + 16] for x in s])
        digests, spans = up, reach
    return digests[0], proofs


def slow(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d["source"], []).append((d, leaf(d, d["text"])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, proofs = [], {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        top, proofs[s] = tree([x[1] for x in groups[s]])
        tops.append(top)
    root, upper = tree(tops)
    out = []
    for s, top, more in zip(names, tops, upper):
        for (d, own), proof in zip(groups[s], proofs[s]):
            runs = proof + more
            hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0
            folded = leaf(d, lowered(d["text"])) if hit else own
            for before, after in runs:
                folded = h([*before, folded, *after])
            listed = h(x for before, after in runs for x in (*before, *after))
            out.append((d["doc_id"], own, top, root, listed, folded, folded == root))
    return out


def check(spark, docs, schema=SCHEMA):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    found = [tuple(r[c] for c in names) for r in merkle.audit(spark.createDataFrame(docs, schema)).collect()]
    assert sorted(found, key=str) == sorted(slow([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), d)) for d in docs]), key=str)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 273, 4097])
def test_sizes_of_one_source(spark, n):
    check(spark, [(i * 7, f"Text {i}", "en", "a", i) for i in range(n)])


def test_many_sources_nulls_ties_and_clashing_columns(spark):
    docs = [(i, f"Ünï Text {i} X", "en" if i % 3 else None, f"s{i % 41}", i) for i in range(700)]
    docs += [(None, None, None, None, None), (None, "", "", "", 0), (3, "other", "en", "s3", 1), (5, None, "de", None, 4), (0, "A" * 200_000, "en", "Ω", -1)]
    docs += [(9, "Same Text", "en", "s9", 9)] * 1300 + [(10, "Same Text", "en", "s9", 9)] * 15
    rows = [(*d, "x", 1, 2) for d in docs]
    check(spark, rows, SCHEMA + ", leaf string, block int, copies int")


def test_more_sources_than_a_block(spark):
    check(spark, [(i, "T", "en", f"source {i % 300}", 1) for i in range(600)])


def test_an_empty_table(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_proofs_of_other_shapes(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "g") for i in range(30)], "id int, body string, part string")
    found = merkle.manifest(docs, ("id", "body"), "id", "part", fan=2, height=3)
    done = found.select("root", merkle.fold(found.leaf, found.proof).alias("folded")).distinct().collect()
    assert len(done) == 1
    assert done[0].root == done[0].folded
    assert {len(r.proof) for r in found.collect()} == {5}
