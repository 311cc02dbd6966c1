"""Source divergence against plain counting, with shards, tiles and pieces of one size or another."""

import random
import re
from collections import Counter, defaultdict

import pytest

from siftline.llm import source_audit

SCHEMA = "doc_id bigint, text string, lang string, source string"


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def slow(rows, least, top):
    docs, counts, groups = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = terms_of(text)
        counts.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for (g, t), n in docs.items() if g == lang and n >= least]
        n = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        whole = {t: sum(counts[lang, s, t] for s in sources) for t in kept}

        def share(count, total):
            return 1 + 10**9 * (count + 5) // (total + 5 * len(kept))

        p = {s: {t: share(counts[lang, s, t], n[s]) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(n.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return sorted(out)


def random_rows(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "été", "ÉTÉ", "naïve", "x1y", "don't", "日本", "a\x00b", "_z_", "İ", "Q"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "\n", "-", "..."]).join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))
        rows.append((i, rng.choice([text, text, text, "", None]), rng.choice(["en", "fr", "", None]), f"s{min(rng.randrange(12), 7)}" if rng.random() > 0.1 else None))
    rows += [(0, "the the", "xx", "rare"), (1, None, "xx", "other"), (2, "of " * 60_000, "en", "long")]
    return rows + [rows[0]] * 3 + [(5, "copy of the copies", "en", "s7")] * (n // 3)


def found(spark, rows, least, top, schema=SCHEMA):
    got = source_audit.audit(spark.createDataFrame(rows, schema), least, top)
    return sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect())


def test_random_rows(spark):
    rows = random_rows(600)
    assert found(spark, rows, 30, 4) == slow(rows, 30, 4)


@pytest.mark.parametrize("tile", [1, 3])
def test_small_shards_and_tiles(spark, monkeypatch, tile):
    for name, value in (("_PIECE", 50), ("_HELD", 20), ("_SHARD", 10), ("_TERMS", 2), ("_TILE", tile)):
        monkeypatch.setattr(source_audit, name, value)
    rows = random_rows(150, 2)
    assert found(spark, rows, 5, 3) == slow(rows, 5, 3)


def test_no_kept_terms_and_empty_tables(spark):
    rows = [(1, "a b", "en", "x"), (2, None, "en", None), (3, "", None, "x")]
    assert found(spark, rows, 30, 50) == slow(rows, 30, 50)
    assert found(spark, [], 30, 50) == []


def test_clashing_columns(spark):
    rows = [(*r, 1, "t", 2, 3) for r in random_rows(100, 3)]
    assert found(spark, rows, 10, 5, SCHEMA + ", n int, term string, total int, value int") == slow(rows, 10, 5)


def test_shares_are_exact(spark):
    cases = [(0, 5), (0, 7), (10**14, 10**14 + 5), (3, 8_999_999_999_999_999), (123_456_789_012, 987_654_321_098_765)]
    df = spark.createDataFrame(cases, "c bigint, t bigint")
    got = [r[0] for r in df.select(source_audit.share(df.c, df.t)).collect()]
    assert got == [1 + 10**9 * (c + 5) // t for c, t in cases]
