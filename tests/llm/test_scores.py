"""Toxicity, quality and language-model scores on small and odd tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import backoff, toxicity, weak_quality
from siftline.llm.common import fold

SCHEMA = "doc_id bigint, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [" "]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


TEXTS = [(i, " ".join(["the", "cat", "sat", "The", "dog", f"w{i % 7}", "the cat sat on the mat"][: 2 + i % 6])) for i in range(40)]
TEXTS += [(50, None), (51, ""), (None, "the cat"), (52, "É unseen\tword"), (3, "the cat sat"), (3, "the cat sat"), (60, "the cat sat on " * 3000)]


def test_base_scores(spark):
    found = backoff.score_texts(spark.createDataFrame(TEXTS, SCHEMA), fold("doc_id") == 1).collect()
    counts = Counter(w for i, t in TEXTS if not held(i) for w in words(t))
    total, ground = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    wanted = sorted((str(i), held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), total, round(sum(math.log10((counts[w] + 0.5) / ground) for w in words(t)), 6)) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == wanted
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def learnt(rows, order=3):
    """Counts of all n-grams of the training texts, by tuple."""
    found = Counter()
    for t in (words(t) for i, t in rows if not held(i)):
        for n in range(1, order + 1):
            found.update(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
    return found


def brute(found, strength, history, word):
    """P(word | history) by recursion; an unknown history says nothing."""
    if not history:
        ones = {g: c for g, c in found.items() if len(g) == 1}
        return (ones.get((word,), 0) + 0.5) / (sum(ones.values()) + 0.5 * (len(ones) + 1))
    lower = brute(found, strength, history[1:], word)
    return (found[(*history, word)] + strength * lower) / (found[history] + strength)


def brute_score(found, text, order=3, strength=128.0):
    w = words(text)
    seen = {}
    total = 0.0
    for k in range(len(w)):
        key = (tuple(w[max(0, k - order + 1) : k]), w[k])
        if key not in seen:
            seen[key] = math.log10(brute(found, strength, *key))
        total += seen[key]
    return total


@pytest.mark.parametrize("order, strength", [(3, 128.0), (1, 64.0), (2, 0.25), (4, 3.0)])
def test_walk_follows_the_recursion(spark, order, strength):
    found = backoff.score_texts(spark.createDataFrame(TEXTS, SCHEMA), fold("doc_id") == 1, order=order, strength=strength).collect()
    grams = learnt(TEXTS, order)
    wanted = sorted((str(i), round(brute_score(grams, t, order, strength), 5)) for i, t in TEXTS)
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in found) == wanted


def test_counts_meet_over_blocks_and_buckets(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60, 70))) for i in range(60)]
    rows += [(100 + i, " ".join(["and"] * 3000)) for i in range(3)] + [(None, "w1 w2 new w1 w2 w3"), (5, rows[5][1])]
    grams = learnt(rows)
    wanted = sorted((str(i), round(brute_score(grams, t), 5)) for i, t in rows)
    monkeypatch.setattr(backoff, "_BUCKET", 10)
    for block in (200, 5000):
        monkeypatch.setattr(backoff, "_BLOCK", block)
        for parts in (1, 5):
            found = backoff.score_texts(spark.createDataFrame(rows, SCHEMA).repartition(parts), fold("doc_id") == 1).collect()
            assert sorted((str(r.doc_id), round(r.score, 5)) for r in found) == wanted


def test_rows_in_another_order_fail(spark, monkeypatch):
    whole = backoff.saved
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(6)], SCHEMA).coalesce(1)
    # other names stand in for a second reading that differs
    monkeypatch.setattr(backoff, "saved", lambda df, label: whole(df, label).withColumn("block", F.col("block") + 1))
    with pytest.raises(Exception, match="another order"):
        backoff.score_texts(docs, F.lit(False)).collect()


def test_packed_numbers_come_back():
    for numbers in (np.array([0, 1, 2**64 - 1], np.uint64), np.arange(-5, 1000), np.array([7], np.int64)):
        assert backoff._unpack(backoff._pack(numbers), len(numbers), numbers.dtype).tolist() == numbers.tolist()


def test_keys_are_those_of_spark(spark):
    keys = np.array([0, 1, -1, 2**63 - 1, -(2**63), 123456789], np.int64)
    pairs = spark.createDataFrame(list(zip(keys.tolist(), keys[::-1].tolist())), "p bigint, s bigint").select("p", F.xxhash64("p", "s").alias("k")).collect()
    assert {r.p: r.k for r in pairs} == dict(zip(keys.tolist(), backoff.joined_keys(keys, keys[::-1].copy()).tolist()))


def automaton_of(train, texts, order, strength):
    """The automaton of ``texts`` (lists of words), learnt from those at ``train``; its starts; the ground."""
    numbers = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    ones, others, ends, places = backoff.ngrams(np.array([numbers[w] for t in texts for w in t]), rows, order)
    learnt_ = np.isin(rows, train)
    counts = sum(np.bincount(p[learnt_[at]], minlength=len(ones) + len(others)) for at, p in zip(ends, places))
    own = counts[places[0]][learnt_]
    ground = len(own) + 0.5 * (len({w for k in train for w in texts[k]}) + 1)
    starts = np.cumsum([0, *map(len, texts)]).tolist()
    return backoff.automaton(counts, ends, places, ground, strength), starts, ground


def test_probabilities_sum_to_one():
    # the first text is learnt; the others try every word after each pair
    learnt_ = ["a", "b", "a", "c", "a", "b", "b", "c", "a", " "]
    letters = ["a", "b", "c", " "]
    tries = [[x, y, w] for x in "abc" for y in "abc" for w in [*letters, "new"]]
    starts_only = [[x, y] for x in "abc" for y in "abc"]
    (tables, arcs), starts, _ = automaton_of([0], [learnt_, *tries, *starts_only], 3, 0.7)
    walk = backoff.walker(tables, arcs)
    scores = [walk(i, j) for i, j in zip(starts, starts[1:])]
    for k in range(9):
        before = scores[1 + len(tries) + k]
        assert sum(10 ** (scores[1 + 5 * k + w] - before) for w in range(5)) == pytest.approx(1.0)


def test_failure_arcs_lead_to_the_longest_known_suffix():
    (tables, arcs), starts, ground = automaton_of([0], [["x", "y", "z", " "], ["x", "y", "y", "z"]], 3, 2.0)
    at = starts[1]
    pair, word = tables["target"][arcs[1][at + 1]], tables["target"][arcs[0][at + 1]]
    assert (tables["depth"][pair], tables["depth"][word], tables["fail"][pair], tables["fail"][word]) == (2, 1, word, 0)
    # "x y" has no arc for "y", nor has "y"; the root has
    assert [a[at + 2] > 0 for a in arcs] == [True, False, False]
    half = math.log10(1.5 / ground)
    want = half + math.log10((1 + 2 * 1.5 / ground) / 3) + 2 * math.log10(2 / 3) + half + math.log10((1 + 2 * 1.5 / ground) / 3)
    assert backoff.walker(tables, arcs)(at, starts[2]) == pytest.approx(want)


def test_no_training_rows_and_no_rows(spark):
    rows = backoff.score_texts(spark.createDataFrame([(1, "a b")], SCHEMA), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(3, 0, 0, 0.0, 0.0)]
    assert backoff.score_texts(spark.createDataFrame([], SCHEMA), fold("doc_id") == 1).count() == 0


def corpus():
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("abcdefghijklm"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        own = rng.choice(plain, int(rng.integers(10, 60))).tolist()
        toxic = int(i % 7 == 0)
        if toxic:
            for _ in range(3):
                own[int(rng.integers(0, len(own)))] = str(rng.choice(["zzvile", "zzvileo", "nastyq", "Nastyq,"]))
        rows.append((i, " ".join(own)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_is_learnt_and_held_out(spark):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (1002, "zzvileish person"), (1003, "lark " * 20000 + "nastyq"), (None, "zzvile zzvile"), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "s", 0.5) for r in rows], SCHEMA + ", spans string, score double")
    table = spark.createDataFrame([*labels, (None, 1), (2, None), (3, 9)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, table, toxicity.not_held_out())
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows)
    truth = dict(labels)
    assert all(r.predicted == truth[r.doc_id] for r in found if r.doc_id in truth)
    odd = {r.doc_id: r for r in found if r.doc_id is None or r.doc_id >= 1000}
    assert (odd[1000].predicted, odd[1001].predicted, odd[1002].predicted, odd[1003].predicted, odd[None].predicted) == (0, 0, 1, 1, 1)
    assert [(s.start, s.end) for s in odd[1002].spans] == [(0, 9)]
    assert [(s.start, s.end) for s in odd[1003].spans] == [(100000, 100006)]
    assert all(0 <= r.score <= 1 for r in found)


@pytest.mark.parametrize(("labels", "wanted"), [([], 0), ([(1, 0)], 0), ([(1, 1)], 1)])
def test_toxicity_with_one_label_or_none(spark, labels, wanted):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {wanted}
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_marginals_by_enumeration():
    weights = np.zeros(toxicity._SPACE, np.float32)
    trans = np.array([[0.3, -0.7], [-0.2, 0.9]])
    text = [b"one", b"bad", b"worse", b"end"]
    for w, x in zip(text, (-1.0, 2.0, 0.5, -0.4)):
        weights[toxicity._slots(w)[1]] += x
    emit = [float(weights[toxicity._slots(w)].sum()) for w in text]
    total, ones = 0.0, np.zeros(4)
    for code in range(16):
        y = [code >> i & 1 for i in range(4)]
        p = math.exp(sum(e * t for e, t in zip(emit, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total, ones = total + p, ones + p * np.array(y)
    assert toxicity.tagger(weights, trans)(text) == pytest.approx(ones / total)


def test_samples_hold_one_row_of_an_id(spark, monkeypatch):
    rows = [(1, f"some text of number {i}") for i in range(30)] + [(2, "another text"), (2, "another text"), (3, None)]
    docs, sizes = spark.createDataFrame(rows, SCHEMA), []
    monkeypatch.setattr(weak_quality, "_train", lambda sample: sizes.append(len(sample)) or np.zeros(weak_quality._SPACE))
    weak_quality.score(docs)
    monkeypatch.setattr(toxicity, "saved", lambda df, label: sizes.append(df.count()) or df)
    toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id bigint, toxic int"))
    assert sizes == [3, 2]


def test_quality_of_kinds_of_texts(spark):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abcdefghijklm"), int(rng.integers(2, 9)))) for _ in range(500)]

    def prose(n):
        return " ".join(w.capitalize() + "." if k % 9 == 8 else w for k, w in enumerate(rng.choice(plain, n)))

    rows = [(i, prose(80)) for i in range(150)]
    rows += [(200 + i, prose(80).upper()) for i in range(15)]
    rows += [(300 + i, " | ".join(prose(80).split())) for i in range(15)]
    rows += [(400 + i, "%%% ".join(prose(80).split())) for i in range(15)]
    rows += [(500 + i, (plain[i] + " ") * 90) for i in range(15)]
    rows += [(600, None), (601, ""), (None, prose(80)), (0, rows[0][1])]
    found = weak_quality.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    assert all(r.keep == int(r.doc_id is None or r.doc_id < 200) for r in found)
    assert weak_quality.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_maximisation_finds_planted_accuracies():
    # kinds of bad texts overlap and false alarms are rare: less overlap tells kinds apart less exactly
    own, other = 0.95, 0.3
    rng = np.random.default_rng(8)
    n, width = 200_000, 8
    kind = rng.choice(width + 1, n, p=[0.6] + [0.05] * width)
    alarms = np.linspace(0.0, 0.004, width)
    bad = np.array([[alarms[k], *[own if c == k else other for c in range(width)]] for k in range(width)])
    found = (rng.random((n, width)) >= bad[:, kind].T).astype(int)
    found[rng.random((n, width)) < 0.1] = 2
    patterns, counts = np.unique(found, axis=0, return_counts=True)
    _, shares, prior = weak_quality.expectation_maximisation(patterns, counts.astype(float), rounds=1500)
    assert np.abs(shares[:, 0, 0] - alarms).max() < 0.02
    assert np.abs(np.diagonal(shares[:, 1:, 0]) - own).max() < 0.02
    assert abs(prior[0] - 0.6) < 0.02


def slow_maximisation(marks, rounds, weight=0.5, alarm=0.002, pull=1000.0):
    """Posterior of "good" of each text, one text and one labeller at a time."""
    width = len(marks[0])
    votes_ = [sum(m[k] == 0 for m in marks) for k in range(width)]
    p = []
    for m in marks:
        shown = [k for k in range(width) if m[k] == 0]
        first = 1 + min(shown, key=lambda k: (votes_[k], k)) if shown else 0
        p.append([1 - 1e-4 * width if c == first else 1e-4 for c in range(width + 1)])
    for _ in range(rounds):
        prior = [(sum(q[c] for q in p) + weight) / (len(marks) + weight * (width + 1)) for c in range(width + 1)]
        shares = {}
        for k in range(width):
            for c in range(width + 1):
                no, yes = (sum(q[c] for q, m in zip(p, marks) if m[k] == v) + weight for v in (0, 1))
                if c == 0:
                    no, yes = no + pull * alarm, yes + pull * (1 - alarm)
                shares[k, c] = (no / (no + yes), yes / (no + yes), 1.0)
        p = [[prior[c] * math.prod(shares[k, c][m[k]] for k in range(width)) for c in range(width + 1)] for m in marks]
        p = [[x / sum(q) for x in q] for q in p]
    return [q[0] for q in p]


def slow_training(described, rounds=150, rate=0.1, ridge=1e-5):
    """Weights by slot: the same steps, one text and one slot at a time."""
    theta = Counter()
    first, second = Counter(), Counter()
    for step in range(1, rounds + 1):
        grad = Counter({s: ridge * x for s, x in theta.items()})
        for slots, values, y in described:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(v * theta[s] for s, v in zip(slots, values))))))
            for s, v in zip(slots, values):
                grad[s] += v * (p - y) / len(described)
        for s, g in grad.items():
            first[s] = 0.9 * first[s] + 0.1 * g
            second[s] = 0.99 * second[s] + 0.01 * g * g
            theta[s] -= rate * (first[s] / (1 - 0.9**step)) / (math.sqrt(second[s] / (1 - 0.99**step)) + 1e-8)
    return theta


def test_quality_agrees_with_a_slow_version(spark):
    rng = np.random.default_rng(12)
    plain = ["".join(rng.choice(list("abcdefghijklm"), int(rng.integers(2, 9)))) for _ in range(60)]
    texts = [" ".join(w + "." if k % 7 == 6 else w for k, w in enumerate(rng.choice(plain, 45))) for _ in range(24)]
    texts += [" | ".join(rng.choice(plain, 30)) for _ in range(4)] + [" ".join(rng.choice(plain, 40)).upper() for _ in range(4)]
    texts += [None, "", "one two", (plain[0] + " ") * 50]
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in weak_quality.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    kinds, shapes = weak_quality._kinds(), weak_quality._Shapes()
    split = [(t or "").split() for t in texts]
    marks = [weak_quality.votes(t or "", w, kinds) for t, w in zip(texts, split)]
    posterior = slow_maximisation(marks, 200)
    described = [(*(x.tolist() for x in weak_quality.features(w, shapes)), p) for w, p in zip(split, posterior)]
    theta = slow_training(described)
    for (i, _), (slots, values, p), m in zip(rows, described, marks):
        score = 1 / (1 + math.exp(-sum(v * theta[s] for s, v in zip(slots, values))))
        assert found[i].votes == "".join(map(str, m))
        assert found[i].posterior == pytest.approx(p, abs=1e-6)
        assert found[i].score == pytest.approx(score, abs=1e-5)
