"""Fuzzy line deduplication: MinHash bands, exact Jaccard, distributed union-find."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import join_small, let, saved, whole
from siftline.llm.components import components
from siftline.session import new_path

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 7, 3
_WORDS = 16  # of 64 bits
_SEED = 0x9E3779B97F4A7C15


def _mask(i: int) -> int:
    """i-th of a row of fixed, well spread 64-bit numbers, signed."""
    x = (_SEED * (i + 1)) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 29
    x = (x * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 32
    return x - (1 << 64) if x >> 63 else x


def _named(key: Column) -> Column:
    """A text's id and key as one value that joins nulls like others."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), key.alias("t"))


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def _key(text: Column) -> Column:
    """Identity of a text among the rows of one id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _points(shingle: int) -> tuple[Column, Column]:
    """Of a UTF-16 text in ``_b``: starts of its shingles, and the shingle at ``_i``.

    Binary data can be cut anywhere without counting characters. A text shorter
    than a shingle is one shingle.
    """
    return _starts(F.col("_b"), shingle), F.col("_b").substr(F.col("_i"), F.lit(2 * shingle))


def _starts(b: Column, shingle: int) -> Column:
    """Places, from 1, of the bytes at which the shingles of a UTF-16 text begin."""
    return F.sequence(F.lit(1), F.greatest(F.length(b) - F.lit(2 * shingle - 1), F.lit(1)), F.lit(2))


def _shingles(line: str, shingle: int) -> Column:
    """Distinct shingle hashes of a line, as an array."""

    def cut(b: Column) -> Column:
        return F.array_distinct(F.transform(_starts(b, shingle), lambda i: F.xxhash64(b.substr(i, F.lit(2 * shingle)))))

    return let(F.encode(F.col(line), "UTF-16BE"), cut)


def distinct_lines(docs: DataFrame) -> DataFrame:
    """``(h, first, line)``: distinct normalised lines and where each stands first.

    ``first`` is (doc_id, key of the text, line number); lines without visible
    characters are left out. Written into files by the hash of ``h``, so that
    grouping by it and joining on it need no further shuffle of the lines.
    """
    spark = docs.sparkSession
    lines = docs.select("doc_id", F.col("text").cast("string").alias("text")).select(
        "doc_id", _key(F.col("text")).alias("t"), F.posexplode_outer(F.split("text", "\n")).alias("at", "raw")
    )
    found = lines.select(F.struct("doc_id", "t", "at").alias("first"), normal(F.col("raw")).alias("line")).filter("line <> ''")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = found.withColumn("h", F.xxhash64("line")).repartition(parts, "h").groupBy("h").agg(F.min("first").alias("first"), F.first("line").alias("line"))
    name = f"lines_{uuid.uuid4().hex}"
    grouped.write.bucketBy(parts, "h").option("path", new_path(spark, "lines")).saveAsTable(name)
    return spark.table(name)


def bands(lines: DataFrame, shingle: int, count: int, rows: int) -> DataFrame:
    """``(h, keys)``: for each line, hashes of groups of its minima.

    A shingle's hash is flipped by a fixed mask for each minimum. XOR with a mask
    maps the hashes one to one, so each minimum is a uniform pick from the union
    of two sets, and agrees with the probability of their Jaccard similarity.
    """
    starts, piece = _points(shingle)
    points = lines.select("h", F.encode("line", "UTF-16BE").alias("_b")).select("h", "_b", F.explode_outer(starts).alias("_i"))
    hashed = points.select("h", F.xxhash64(piece).alias("_x"))
    names = [f"m{i}" for i in range(count * rows)]
    minima = hashed.groupBy("h").agg(*[F.min(F.col("_x").bitwiseXOR(F.lit(_mask(i)))).alias(m) for i, m in enumerate(names)])
    keys = [F.xxhash64(F.lit(b), *names[b * rows : (b + 1) * rows]) for b in range(count)]
    return minima.select("h", F.array(*keys).alias("keys"))


def profiles(lines: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``(h, size, w0 ...)``: of the lines in ``ids``, the number of shingles and a parity bitmap of them.

    Each distinct shingle flips one of 1,024 bits. What two lines share cancels out
    between their bitmaps, so a bit in which these differ stands for at least one
    shingle that only one line has, and few such shingles hide each other.
    """
    texts = join_small(lines.select("h", "line"), saved(ids.distinct(), "profile_ids"), "h")
    points = texts.select("h", F.explode_outer(_shingles("line", shingle)).alias("x"))
    words = [f"bit_xor(if(shiftright(x & {64 * _WORDS - 1}, 6) = {k}, shiftleft(1L, cast(x & 63 as int)), 0L))" for k in range(_WORDS)]
    return points.groupBy("h").agg(F.count("*").alias("size"), *[F.expr(w).alias(f"w{k}") for k, w in enumerate(words)])


def compared(pairs: DataFrame, lines: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` with ``near``, whether their Jaccard similarity is that high, and ``far``.

    ``far`` is the exact Jaccard distance of the two shingle sets, in thousandths.
    """
    pairs = saved(pairs, "pairs")
    ids = saved(pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct(), "pair_ids")
    texts = saved(join_small(lines.select("h", "line"), ids, "h"), "pair_texts")
    left = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("left")), "a")
    both = left.join(texts.select(F.col("h").alias("b"), F.col("line").alias("right")), "b")

    def judge(s: Column) -> Column:
        sizes = F.size(s["x"]) + F.size(s["y"])
        return let(F.size(F.array_intersect(s["x"], s["y"])), lambda c: F.struct(c.alias("c"), (sizes - c).alias("n")))

    sets = F.struct(_shingles("left", shingle).alias("x"), _shingles("right", shingle).alias("y"))
    return both.select("a", "b", let(sets, judge).alias("v")).select(
        "a",
        "b",
        (F.col("v.c") * 1000 >= F.lit(round(similarity * 1000)) * F.col("v.n")).alias("near"),
        (F.lit(1000.0) - F.lit(1000.0) * F.col("v.c") / F.col("v.n")).alias("far"),
    )


def line_classes(lines: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(h, root)`` of the lines that have a near-duplicate; the others are not listed."""
    coded = saved(bands(lines, shingle, count, rows), "bands")
    members = coded.select("h", F.explode("keys").alias("band"))
    repeated = saved(members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"), "repeated")
    candidates = saved(join_small(members, repeated, "band").select("h").distinct(), "candidates")
    # most lines share no band: the rest of the work reads those few that do
    few = saved(join_small(coded, candidates, "h"), "candidate_bands")
    texts = saved(join_small(lines.select("h", "line"), candidates, "h"), "candidate_lines")
    return classes(few, lambda pairs: compared(pairs, texts, shingle, similarity), lambda ids: profiles(texts, ids, shingle), similarity)


def classes(coded: DataFrame, compare: Callable[[DataFrame], DataFrame], profile: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """``(h, root)`` of the lines of ``coded`` (see ``bands``) that have a near-duplicate.

    ``compare`` judges pairs as ``compared`` does, ``profile`` describes lines as
    ``profiles`` does. Lines that share a band are candidates. A band's head is the line whose bands
    hold most lines in all: of a text and its variants that is the text itself,
    as changes make bands of their own. Each line is compared with its best head,
    then with the heads of those bands whose head it has not been connected
    with. That joins a large group at a few pairs per line. Only in bands that
    then still hold several components are other pairs compared, those across
    components that can be near: their distances from the head differ by no
    more than the limit (the triangle rule of the Jaccard distance), and their
    bitmaps differ in no more bits than shingles may differ. Both rules only
    leave out pairs that are not near. A pair meets in the first band it shares, and
    not at all if one of the two is its head: that pair has been compared.
    """
    members = coded.select("h", F.explode("keys").alias("band"))
    shared_bands = saved(members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "shared_bands")
    joined = saved(join_small(members, shared_bands, "band"), "members")
    weights = joined.groupBy("h").agg(F.sum("n").alias("weight"))
    weighed = joined.join(weights, "h").select("band", "h", "weight")
    best = weighed.groupBy("band").agg(F.max(F.struct("weight", "h")).alias("best"))
    shared = saved(weighed.join(best, "band").select("band", "h", F.col("best.h").alias("head"), F.col("best.weight").alias("head_weight")), "headed")
    first = shared.groupBy("h").agg(F.max(F.struct("head_weight", "head")).alias("best")).select(F.col("best.head").alias("a"), F.col("h").alias("b"))
    seen = saved(compare(first.filter("a <> b")), "stars")

    def rooted(seen: DataFrame) -> DataFrame:
        """Rows of the bands that hold several components."""
        roots = components(seen.filter("near")).withColumnRenamed("node", "h")
        placed = shared.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
        mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.when(F.col("head") == F.col("h"), F.col("root"))).alias("head_root"))
        return saved(placed.join(mixed.filter("lo <> hi").select("band", "head_root"), "band"), "mixed_bands")

    mixed = rooted(seen)
    others = mixed.filter("root <> head_root").select(F.col("head").alias("a"), F.col("h").alias("b")).distinct()
    known = seen.select("a", "b")
    seen = saved(seen.unionByName(compare(others.join(known, ["a", "b"], "left_anti"))), "stars")
    mixed = rooted(seen)
    distances = seen.select(F.col("a").alias("head"), F.col("b").alias("h"), "far")
    spaced = saved(mixed.join(distances, ["head", "h"], "left").filter("h <> head").select("band", "h", "root", "far"), "spaced")
    ids = saved(spaced.select("h").distinct(), "spaced_ids")
    keys = saved(join_small(coded.select("h", "keys"), ids, "h"), "spaced_keys")
    known = spaced.join(saved(profile(ids), "profiles"), "h").join(keys, "h")
    own = ["h", "root", "far", "keys", "size", *[f"w{k}" for k in range(_WORDS)]]
    one, two = (known.select("band", *[F.col(c).alias(f"{side}_{c}") for c in own]) for side in "ab")
    cut = round(1000 * similarity)
    differing = sum((F.bit_count(F.col(f"a_w{k}").bitwiseXOR(F.col(f"b_w{k}"))) for k in range(_WORDS)), F.lit(0))
    count = coded.select(F.size("keys").alias("n")).first()
    met = F.lit(True)
    for k in range(count.n if count else 0):  # from the last band to the first
        same = F.col("a_keys")[count.n - 1 - k] == F.col("b_keys")[count.n - 1 - k]
        met = F.when(same, F.col("a_keys")[count.n - 1 - k] == F.col("band")).otherwise(met)
    apart = (
        (F.col("a_h") < F.col("b_h"))
        & (F.col("a_root") != F.col("b_root"))
        & (F.coalesce(F.abs(F.col("a_far") - F.col("b_far")), F.lit(0.0)) <= F.lit(1000.0 - cut + 1e-6))
        & (differing * F.lit(1000 + cut) <= (F.col("a_size") + F.col("b_size")) * F.lit(1000 - cut))
        & met
    )
    across = one.join(two, "band").filter(apart).select(F.col("a_h").alias("a"), F.col("b_h").alias("b"))
    # written, as a filter on the result would compute it again
    rest = saved(compare(across), "across")
    return components(seen.unionByName(rest).filter("near")).select(F.col("node").alias("h"), "root")


def removals(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, t, kept)``: numbers of the lines that stay, for texts that keep any.

    One line of each component stays, its first by (doc_id, text, line number).
    ``t`` tells texts of equal ids apart. Texts without an entry keep only their
    blank lines. A text's list is as long as the text, at most.
    """
    lines = distinct_lines(docs)
    roots = line_classes(lines, shingle, similarity, count, rows).withColumnRenamed("h", "_h")
    placed = lines.select("h", "first").join(roots, F.col("h") == F.col("_h"), "left")
    firsts = placed.groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("first").alias("first"))
    return firsts.select("first.*").groupBy("doc_id", "t").agg(F.sort_array(F.collect_list("at")).alias("kept"))


def dedup_lines(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one line of each group of near-equal lines, plus counts of lines.

    Lines are compared trimmed and in lower case, as sets of ``shingle``-character
    shingles with a Jaccard similarity of ``similarity`` or more (shorter lines
    are one shingle, so only equal ones match). Bands of minima find a pair at the
    threshold with a probability of 1 - (1 - s^rows)^count, 0.993, and more above it. The
    first line of a group by (doc_id, text, line number) stays, in its own text.
    Lines without visible characters stay. ``n_lines`` counts the others,
    ``n_kept`` those that stay, ``removed`` lists the numbers of removed ones.

    Null texts stay null with no lines. A null id sorts first. Rows with equal
    ids and texts are one text listed twice and keep the same lines. Columns
    named n_lines, n_kept and removed are replaced. Lines are told apart by a
    64-bit hash.
    """
    docs = docs.drop("n_lines", "n_kept", "removed")
    kept = removals(docs, shingle, similarity, count, rows).select(_named(F.col("t")).alias("k"), "kept")
    keyed = docs.select(whole(docs).alias("d"), _named(_key(F.col("text").cast("string"))).alias("k"))
    # cut into lines after the join, so that a text moves once
    joined = keyed.join(kept, "k", "left").select("d", "kept", F.split(F.col("d.text").cast("string"), "\n").alias("raw"))
    told = F.transform("raw", lambda x, i: F.struct(x.alias("x"), i.alias("i"), (normal(x) != "").alias("f"), F.coalesce(F.array_contains("kept", i), F.lit(False)).alias("k")))

    def judge(lines: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(F.filter(lines, lambda r: ~r["f"] | r["k"]), lambda r: r["x"]), "\n").alias("text"),
            F.coalesce(F.size(F.filter(lines, lambda r: r["f"])), F.lit(0)).cast("bigint").alias("n_lines"),
            F.coalesce(F.size(F.filter(lines, lambda r: r["f"] & r["k"])), F.lit(0)).cast("bigint").alias("n_kept"),
            F.transform(F.filter(lines, lambda r: r["f"] & ~r["k"]), lambda r: r["i"]).alias("removed"),
        )

    done = joined.select("d", let(told, judge).alias("v"))
    columns = [F.col("v.text").alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    return done.select(*columns, "v.n_lines", "v.n_kept", "v.removed")


def clean(docs: DataFrame) -> DataFrame:
    """Documents with duplicate lines taken out; those that lose every line go.

    A document goes only if all its lines stay in another place. Columns are
    those of ``docs``; ``n_chars``, if there is one, is counted anew.
    """
    # named by place, so that no column of the documents meets one of the counts
    names = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    done = dedup_lines(docs.toDF(*names)).filter("n_lines = 0 or n_kept > 0")
    sizes = {names[i]: F.length("text").cast(docs.schema[i].dataType) for i, c in enumerate(docs.columns) if c == "n_chars"}
    return done.withColumns(sizes).select(*names).toDF(*docs.columns)
