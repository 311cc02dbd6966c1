"""Language identification: vectors and machines against slow ones, held-out accuracy, odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from siftline.llm import language_id as ident

SCHEMA = "doc_id bigint, text string, lang string, source string"
SOUNDS = {
    "no": ["sk", "øy", "ing", "het", "og", "jeg", "ikk", "er"],
    "da": ["sk", "øj", "ing", "hed", "og", "jeg", "ikk", "af"],
    "it": ["zio", "ne", "che", "gli", "ella", "per", "are", "di"],
    "pt": ["ção", "nho", "que", "lhe", "ela", "por", "ar", "do"],
    "fi": ["kä", "yy", "ssa", "nen", "ään", "ja", "ko", "tt"],
}


def texts(n, seed=0, size=12):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        words = ["".join(rng.choices(SOUNDS[lang], k=rng.choice([1, 2, 3]))) for _ in range(size)]
        out.append((i, " ".join(words).capitalize() + rng.choice([".", "!", " 12", "\n"]), lang, "s"))
    return out


def slow_features(text, dims):
    low = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower())
    data = (" " + " ".join(low.encode().decode("latin-1").split(" ")).replace("  ", " ").strip(" ") + " ").encode("latin-1")
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    counts, bits = Counter(), dims.bit_length() - 1
    for n in (1, 2, 3, 4):
        for i in range(len(data) - n + 1):
            key = int.from_bytes(data[i : i + n], "little")
            h = ((key * 2654435761 + n * 0x9E3779B1) * 2654435761) % 2**32 >> (32 - bits)
            counts[h] += 1
    total = sum(counts.values())
    return [(counts[k] / total) ** 0.5 for k in range(dims)] + [1.0]


@pytest.mark.parametrize("window", [3, 1 << 20])
def test_vectors(monkeypatch, window):
    monkeypatch.setattr(ident, "_WINDOW", window)
    cases = ["Jeg er ØYHET, og ikke 12 skøy!", "a", "日本 x", "  two\n\twords  "]
    got = ident.features([*cases, None, ""], 64)
    assert np.allclose(got[:4], [slow_features(t, 64) for t in cases], atol=1e-6)
    assert not got[4:, :-1].any()


def test_machine_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(size=(60, 4)), np.ones((60, 1))])
    y = np.where(x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=60) > 0, 1, -1)
    weights = ident.train_machine(x, y, cost=1.0, epochs=2000)
    share = {s: len(y) / (2 * (y == s).sum()) for s in (-1, 1)}
    cost = np.array([share[s] for s in y])

    def loss(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    w, best = np.zeros(5), np.inf
    for step in range(1, 40_000):  # plain subgradient steps
        hit = y * (x @ w) < 1
        w -= (w - (cost * y * hit) @ x) / (step + 100)
        best = min(best, loss(w))
    assert loss(weights) <= best * 1.001


def test_families_join_alike_languages():
    means = np.array([[1, 0.9, 0, 0], [0, 0, 1, 0.9], [0.9, 1, 0, 0.1], [0, 0.1, 0.9, 1.0]])
    family = ident.families_of(means)
    assert family[0] == family[2] != family[1] == family[3]
    assert ident.families_of(np.ones((1, 4))) == [0]


def test_held_out_accuracy_and_columns(spark):
    rows = [(*r, 1, "x") for r in texts(1500)]
    docs = spark.createDataFrame(rows, SCHEMA + ", score int, lang_pred string")
    found = {r.doc_id: r for r in ident.identify(docs).collect()}
    assert set(found[0].__fields__) == {"doc_id", "held_out", "lang_pred", "score"}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in found.items() if r.held_out} == {r[0] for r in held}
    assert sum(found[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_odd_rows(spark):
    rows = texts(300, 1) + [(None, "jeg ikke skøy", "no", None), (2000, None, "no", None), (2001, "", "it", None), (2002, "12 -- 7\n!", "it", None)]
    rows += [(2003, "che gli ella " * 60_000, None, None), (2004, "CHE GLI ELLA", None, None)] + [texts(1, 2)[0]] * 500
    got = ident.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    assert [(found[i].lang_pred, found[i].score) for i in (2000, 2001, 2002)] == [("und", 0.0)] * 3
    assert (found[2003].lang_pred, found[2004].lang_pred, found[None].held_out) == ("it", "it", False)


def test_few_languages_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ident.identify(none).count() == 0
    got = ident.identify(spark.createDataFrame([(0, "abc", None, "s"), (1, "abc", None, "s")], SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    one = spark.createDataFrame([(i, f"abc {'x' * i}", "xx", "s") for i in range(9)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in ident.identify(one).collect()} == {("xx", 1.0)}


def test_a_hot_text_is_learnt_from_once(spark):
    docs = spark.createDataFrame([*texts(200, 3), *[(900 + i, "same text", "no", "s") for i in range(300)]], SCHEMA)
    got = ident.sample(docs, "text", "lang", 100).collect()
    assert len(got) == len(set(got))
    assert max(Counter(r.lang for r in got).values()) <= 20
