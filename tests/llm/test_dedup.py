"""SimHash components, fuzzy lines and connected components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from siftline.llm import line_dedup, simhash
from siftline.llm.components import components

SCHEMA = "doc_id bigint, text string, fp string, kept int, h string"


def docs_of(spark, *texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], SCHEMA)


def test_components_of_paths_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(100, 400)] + [(5, x) for x in range(10, 60)] + [(7, 7), (3, 2), (2, 3), (None, 1)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found == {**{i: 100 for i in range(100, 401)}, 5: 5, **{x: 5 for x in range(10, 60)}, 2: 2, 3: 2}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    best = {}
    for x, i in zip(label, ids):
        if i is not None:
            best[x] = min(best.get(x, i), i)
    return [best.get(x) for x in label]


def test_simhash_rows(spark):
    rng = random.Random(1)
    base = [rng.choice("ab cd Ef gh ij kl mn op qr st".split()) for _ in range(80)]
    texts = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join([*base[:-1], "zz"])), (4, None), (5, ""), (6, " \n\t"), (7, "one two"), (7, "one two"), (None, "one\ttwo"), (9, "é ü")]
    texts += [(20 + i, " ".join(rng.choice(base) for _ in range(60))) for i in range(30)]
    found = simhash.near_duplicates(docs_of(spark, *texts)).select("doc_id", simhash.hex16("fp"), "component_id").collect()
    prints = [fingerprint(t) for _, t in texts]
    expected = [(i, f"{p:016x}", c) for (i, _), p, c in zip(texts, prints, brute_components([i for i, _ in texts], prints, 4))]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_simhash_of_no_rows_and_kept_rows(spark):
    assert simhash.near_duplicates(docs_of(spark)).count() == 0
    kept = simhash.keep_one(docs_of(spark, (1, "a b c"), (2, "A b c"), (3, "other words here now"), (3, "other words here now"), (None, "a b c")))
    assert sorted((r.doc_id or 0, r.text, r.fp, r.kept) for r in kept.collect()) == [(0, "a b c", "x", 1), (1, "a b c", "x", 1), (3, "other words here now", "x", 1)]


def test_kept_rows_are_those_of_all_pairs_at_the_similarity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for i in range(0, 150, 5):
        words = [word() for _ in range(rng.choice([60, 90, 200]))]
        texts.append((i, " ".join(words)))
        for k in range(1, 5):  # edits on edits, and the same words over other lines
            words[rng.randrange(len(words))] = word()
            texts.append((i + k, rng.choice([" ", "\n"]).join(words)))
    # mostly one repeated word: equal fingerprints, but few common shingles
    texts += [(200 + i, "x " * 300 + " ".join(word() for _ in range(8))) for i in range(3)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in texts)]
    prints = [fingerprint(t) for _, t in texts]
    label, far = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                far += bin(prints[i] ^ prints[j]).count("1") > 4
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    assert far > 20
    kept = simhash.keep_one(docs_of(spark, *texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(texts[x][0] for x in set(label))


@pytest.mark.parametrize("shard", [64, 100_000])
@pytest.mark.parametrize("bits", [4, 6])
def test_hamming_links_are_exact(spark, shard, bits):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**63, 400).astype(np.uint64)
    for i in range(0, 300, 3):  # neighbours at 1 to 7 bits, in either half
        flips = rng.choice(64, int(rng.integers(1, 8)), replace=False)
        points[i + 1] = points[i] ^ np.uint64(sum(1 << int(b) for b in flips))
    dense = points[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))  # a ball that no vantage point divides
    points = np.unique(np.concatenate([points, dense]))
    fps = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp bigint")
    found = {r.node: r.root for r in components(simhash.hamming_links(fps, bits, shard=shard)).collect()}
    groups = {}
    for p in points.view(np.int64).tolist():
        groups.setdefault(found.get(p, p), set()).add(p)
    label = brute_components(list(range(len(points))), [int(p) for p in points], bits)
    wanted = {}
    for p, x in zip(points.view(np.int64).tolist(), label):
        wanted.setdefault(x, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def brute_lines(texts):
    """Removed line numbers by all pairs; rows with equal ids and texts are one text."""
    places = {}
    for i, t in texts:
        for n, line in enumerate((t or "").split("\n")):
            line = line.strip(" ").lower()
            if line:
                places.setdefault(line, set()).add((-1 if i is None else i, n))
    lines = list(places)
    sets = [{x[j : j + 8] for j in range(max(1, len(x) - 7))} for x in lines]
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    first = {}
    for x, line in zip(label, lines):
        first[x] = min(first.get(x, (1 << 60, 0)), *places[line])
    kept = set(first.values())
    return sorted((-1 if i is None else i, [n for n, x in enumerate((t or "").split("\n")) if x.strip(" ") and (-1 if i is None else i, n) not in kept]) for i, t in texts)


def test_lines_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(20)]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(passages).split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = word()
            lines.append(rng.choice([" ".join(words), " ".join(words).upper(), "  " + " ".join(words), ""]))
        texts.append((i, "\n".join(lines)))
    texts += [(100, None), (101, ""), (102, "\n\n"), (103, "short"), (104, "Short "), (105, "é𝄞é"), (None, "only with a null id, long enough"), (106, "x" * 30000), (107, "x" * 30001)]
    done = line_dedup.dedup_lines(docs_of(spark, *texts)).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, list(r.removed or [])) for r in done)
    # bands may miss a pair near the threshold; on these fixed rows they find all
    assert found == brute_lines(texts)
    assert {r.doc_id: r.n_lines for r in done}[100] == 0
    assert all((r.fp, r.kept, r.h) == ("x", 1, "y") for r in done)


def test_lines_repeated_rows_and_no_rows(spark):
    same = "this is one line of text\nand this is another one"
    done = line_dedup.dedup_lines(docs_of(spark, (1, same), (1, same), (2, same))).collect()
    assert sorted((r.doc_id, r.n_kept) for r in done) == [(1, 2), (1, 2), (2, 0)]
    kept = line_dedup.clean(docs_of(spark, (1, same), (2, same), (3, None), (4, "")))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert line_dedup.dedup_lines(docs_of(spark)).count() == 0


def test_pairs_across_components_are_few_and_lose_no_link(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(45)]
    texts = set()
    for _ in range(160):  # about 0.6 to 0.8 alike, some more
        own = list(base)
        for _ in range(rng.choice([2, 3, 3, 3, 3])):
            own[rng.randrange(len(own))] = word()
        texts.add(" ".join(own))
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(texts))], "h bigint, line string")
    coded = line_dedup.saved(line_dedup.bands(lines, 8, line_dedup.BANDS, line_dedup.ROWS), "bands")
    rounds = []

    def compare(pairs):
        rounds.append([(r.a, r.b, r.near, r.far) for r in line_dedup.compared(pairs, lines, 8, 0.8).collect()])
        return spark.createDataFrame(rounds[-1], "a bigint, b bigint, near boolean, far double")

    found = {r.h: r.root for r in line_dedup.classes(coded, compare, lambda ids: line_dedup.profiles(lines, ids, 8), 0.8).collect()}
    sets = [{t[j : j + 8] for j in range(len(t) - 7)} for t in sorted(texts)]
    keys = {r.h: set(r["keys"]) for r in coded.collect()}
    label, linked = list(range(len(sets))), 0
    for i in range(len(sets)):
        for j in range(i):
            if keys[i] & keys[j]:
                linked += 1
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    x, y = label[i], label[j]
                    label = [y if z == x else z for z in label]
    groups = [sorted(i for i, z in enumerate(label) if z == x) for x in set(label)]
    merged = {}
    for i in range(len(sets)):
        merged.setdefault(found.get(i, i), []).append(i)
    assert sorted(groups) == sorted(merged.values())
    # of all pairs that share a band, few that are far apart are judged, and each once
    assert linked > 5000
    assert len({(a, b) for a, b, *_ in rounds[2]}) == len(rounds[2])
    assert sum(far > 240 for *_, far in rounds[2]) < 0.01 * linked
