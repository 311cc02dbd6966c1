"""Benchmark decontamination by templates whose slots must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import join_small, let, saved

_MASKED = 8  # longest windows of which all ways to put <name> are listed
_SPACES = r"[\x09-\x0D\x20\x85\xA0]+"
#: Units that follow a number and stand for one another.
UNITS = (
    "mm|cm|m|km|inch|inches|ft|feet|yd|yards?|miles?|meters?|metres?|kilometers?|kilometres?|mg|g|kg|grams?|kilograms?|lb|lbs|pounds?|oz|ounces?|"
    "ml|cl|l|liters?|litres?|gallons?|seconds?|secs?|s|min|mins|minutes?|h|hours?|days?|weeks?|months?|years?|percent|%|dollars?|euros?|cents?|"
    "usd|eur|degrees?|mph|kmh|km/h|watts?|kw|volts?|joules?|newtons?|bytes?|kb|mb|gb|tb"
)
_NUMBER = r"(?<=^|\x20)[$€£#(]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?(?=\x20|$)"
_EDGES = r"(?<=[\p{L}\p{N}%>])[.,;:!?\"'’”)\]}]+(?=\x20|$)|(?<=^|\x20)[\"'‘“(\[{]+(?=[\p{L}\p{N}])"
_CAPITAL = r"(?<=^|\x20|[\"'‘“(\[{])\p{Lu}[\p{Ll}'’-]+(?=[.,;:!?\"'’”)\]}]*(?:\x20|$))"
#: A word with a capital letter anywhere; every name is one.
_CASED = r"(?<![^\x20])[^\x20\p{Lu}]*+\p{Lu}[^\x20]*+"
_NAME = r"(?<=[^.!?:\x20]\x20)\p{Lu}[\p{Ll}'’-]+(?=[.,;:!?\"'’”)\]}]*(?:\x20|$))"


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " "))


def _bare(spaced: Column) -> Column:
    """Quotes, brackets and sentence marks go where they stand next to a word's letter or digit."""
    return F.regexp_replace(spaced, _EDGES, "")


def _split(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def tokens(text: Column) -> Column:
    """Words of a text without marks at their edges; words of marks alone stay. Null has none."""
    return let(_bare(_spaced(text)), _split)


def template(text: Column, names: str | None = _NAME) -> Column:
    """Words of the text's template, one for each of ``tokens``.

    Numbers become <num>, a unit after a number <unit>, a capitalised word that
    does not begin a sentence <name>; all else is lower-cased. ``names`` is the
    pattern of names; without it no word is one. Replacements stay within words,
    so both arrays have the same length.
    """

    def numbered(named: Column, spaced: Column) -> Column:
        placed = F.regexp_replace(F.regexp_replace(named, _NUMBER, "<num>"), rf"(?<=<num>\x20)(?i:{UNITS})(?=\x20|$)", "<unit>")
        return F.when(spaced.rlike(r"\d"), placed).otherwise(named)

    def made(spaced: Column) -> Column:
        named = spaced if names is None else F.regexp_replace(spaced, names, "<name>")
        return F.lower(let(_bare(named), lambda n: numbered(n, spaced)))

    return let(let(_spaced(text), made), _split)


def windows(words: Column, size: int = 5) -> Column:
    """Hashes of all windows of ``size`` words, in order; null without words.

    A text shorter than that has one window, of all its words. Built by doubling:
    hashes of 1, 2, 4 ... words are zipped with themselves further on, so each
    word is hashed about log(size) times.
    """

    def paired(left: Column, right: Column, shift: int) -> Column:
        n = F.greatest(F.size(right) - F.lit(shift), F.lit(0))
        return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(shift + 1), n), lambda a, b: F.xxhash64(a, b))

    def longer(made: Column, ones: Column, length: int) -> Column:
        if length == size:
            return made
        step = length if 2 * length <= size else 1
        return let(paired(made, made if step == length else ones, length), lambda h: longer(h, ones, length + step))

    def whole(w: Column) -> Column:
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(w)))
        return F.when(F.size(w) < size, short).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), lambda ones: longer(ones, ones, 1)))

    return let(words, whole)


def variants(text: Column, size: int) -> Column:
    """For each window, its distinct hashes with names within sentences, with every capitalised word and with no word as a name."""
    zipped = F.arrays_zip(*[windows(template(text, names), size).alias(a) for a, names in (("a", _NAME), ("b", _CAPITAL), ("c", None))])
    return F.transform(zipped, lambda r: F.array_distinct(F.array(r["a"], r["b"], r["c"])))


def possible(texts: DataFrame, listed: DataFrame, size: int, share: float, least: int, broadcast_rows: int) -> DataFrame:
    """Those of ``texts`` that may hold an item, by one cheap form in place of three; none that does is left out.

    A text is cut into windows once, with <name> for every word that has a capital
    letter. The three forms of a window differ in such words only, so where any of them is an
    item's window, this one is that window with <name> in some places. All these
    are made of the items, 2^size for each window. A hash weighs the largest share
    that its windows are of those an item needs; below a sum of 1 no item can be matched.
    """
    forms = listed.select("item_id", "it", F.size(F.array_distinct("hashes")).alias("windows"), "hashes", F.explode(F.array_distinct(F.array("inner", "form", "plain"))).alias("words"))
    starts = forms.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - F.lit(size), F.lit(0)))).alias("at"))
    cut = starts.select("item_id", "it", "windows", F.get("hashes", F.col("at")).alias("g"), F.slice("words", F.col("at") + 1, F.lit(size)).alias("words"))
    masked = cut.distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << size) - 1))).alias("mask"))
    words = F.transform("words", lambda w, i: F.when(F.getbit(F.col("mask"), i) == 1, F.lit("<name>")).otherwise(w))
    hashed = masked.select("item_id", "it", "windows", "g", F.explode(windows(words, size)).alias("h"))
    needed = F.least(F.lit(share) * F.col("windows"), F.lit(float(least)))
    weights = hashed.groupBy("item_id", "it", "windows", "h").agg(F.count_distinct("g").alias("n")).groupBy("h").agg(F.max(F.col("n") / needed).alias("weight"))
    found = texts.select("doc_id", F.xxhash64("text").alias("t"), F.explode_outer(windows(template(F.col("text"), _CASED), size)).alias("h")).filter("h is not null")
    sums = join_small(found, saved(weights, "window_weights"), "h", rows=broadcast_rows).groupBy("doc_id", "t").agg(F.sum("weight").alias("weight"))
    ids = saved(sums.filter(F.col("weight") > 1 - 1e-6).select("doc_id", "t"), "possible_ids")
    return saved(join_small(texts.withColumn("t", F.xxhash64("text")), ids, ["doc_id", "t"], "left_semi").select("doc_id", "text"), "possible_texts")


def _is_slot(word: Column) -> Column:
    return word.isin("<num>", "<unit>", "<name>")


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8, run: int = 20, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, with the evidence.

    A pair is found if a run holds at least ``share`` of the item's template windows,
    or windows that span ``run`` words, and its slots agree: within the run's matched
    windows, equal slot values of the item meet equal values of the document and
    different ones different ones. Then the item may be re-parameterised
    (``same_slots`` false) but is the same question. A run is what stands at one
    shift, or at shifts that differ by less than the item's length, so that
    words may be put in or left out; each item window then takes the place whose
    shift has most windows. Every place of the document counts. Slots beyond the
    matched windows decide nothing, and ``run`` words that agree are enough.
    Windows match by any of ``variants``, so names may begin a sentence and be in
    any case; the slots that must agree then include sentences' first words,
    ``n_slots`` counts the others.

    Gives ``doc_id, item_id, windows, matched, coverage, n_slots, same_slots``, one
    row per pair of ids. Null or empty texts on either side, and null ids, match
    nothing. Repeated rows of a document count as one;
    rows with equal ids and different texts are judged by the best of them.
    Items shorter than ``size`` words are one window, found only as whole texts.

    Documents first pass ``possible``, which leaves those out that can hold no item;
    windows of more than 8 words skip it. The item windows' distinct hashes are
    broadcast if there are at most ``broadcast_rows``; beyond that Spark joins by
    shuffle. Only document windows that meet one go on.
    """
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null")
    items = items.distinct().withColumn("it", F.xxhash64("text"))
    listed = saved(
        items.select("item_id", "it", F.transform(tokens(F.col("text")), F.lower).alias("words"), template(F.col("text")).alias("inner"), template(F.col("text"), _CAPITAL).alias("form"), template(F.col("text"), None).alias("plain"), variants(F.col("text"), size).alias("variants"))
        .withColumn("hashes", windows(F.col("inner"), size)),
        "items",
    )
    # g numbers the distinct windows
    placed = saved(
        listed.select(
            "item_id", "it", "hashes", F.size("words").alias("length"), F.size(F.array_distinct("hashes")).alias("windows"), F.posexplode("variants").alias("at", "hs")
        ).select("item_id", "it", "length", "windows", "at", F.array_position("hashes", F.get("hashes", F.col("at"))).alias("g"), F.explode("hs").alias("h")),
        "item_windows",
    )
    wanted = saved(placed.select("h").distinct(), "window_hashes")
    least = max(run - size + 1, 1)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    if size <= _MASKED:
        texts = possible(texts, listed, size, share, least, broadcast_rows)
    # the outer form, as Spark would compute the array twice to drop rows without any
    exploded = texts.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode_outer(variants(F.col("text"), size)).alias("pos", "hs"))
    exploded = exploded.select("doc_id", "t", "pos", F.explode_outer("hs").alias("h")).filter("h is not null")
    hits = saved(join_small(exploded, wanted, "h", rows=broadcast_rows), "window_hits")
    pair = ["doc_id", "t", "item_id", "it", "length", "windows"]
    shifted = (
        hits.join(placed, "h")
        .groupBy(*pair, (F.col("pos") - F.col("at")).alias("shift"))
        .agg(F.collect_set(F.struct("at", "g")).alias("ats"))
    )

    def enough(n: Column) -> Column:
        return (n >= F.lit(share) * F.col("windows")) | (n >= F.lit(least))

    def distinct_of(shifts: Column, field: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(shifts, lambda r: F.transform(r["ats"], lambda a: a[field]))))

    # bands of shifts as wide as the item, which overlap by half, and each shift on its own
    half = F.floor(F.col("length") / 2)
    bands = F.array(
        F.struct(F.lit(0).alias("kind"), F.floor(F.col("shift") / F.col("length")).alias("number")),
        F.struct(F.lit(1).alias("kind"), F.floor((F.col("shift") + half) / F.col("length")).alias("number")),
        F.when(enough(F.size("ats")), F.struct(F.lit(2).alias("kind"), F.col("shift").cast("bigint").alias("number"))),
    )
    found = (
        shifted.select("*", F.explode(bands).alias("band"))
        .filter("band is not null")
        .groupBy(*pair, "band")
        .agg(F.collect_list(F.struct(F.size("ats").alias("n"), (-F.col("shift")).alias("back"), "ats")).alias("shifts"))
        .withColumn("matched", F.size(distinct_of(F.col("shifts"), "g")))
        .filter(enough(F.col("matched")))
    )
    pairs = saved(found.drop("length"), "leak_pairs")
    ids = pairs.select("doc_id", "t").distinct()
    held = texts.withColumn("t", F.xxhash64("text")).distinct().join(ids, ["doc_id", "t"], "left_semi")
    held = held.select("doc_id", "t", F.transform(tokens(F.col("text")), F.lower).alias("d_words"))
    both = pairs.join(held, ["doc_id", "t"]).join(listed.select("item_id", "it", "words", "inner", "form"), ["item_id", "it"])

    def aligned(shifts: Column) -> Column:
        """(at, back) of the matched item windows in order; the shift of most windows comes first."""

        def place(at: Column) -> Column:
            there = F.filter(shifts, lambda r: F.exists(r["ats"], lambda a: a["at"] == at))
            return F.struct(at.alias("at"), F.element_at(there, 1)["back"].alias("back"))

        return F.transform(F.sort_array(distinct_of(shifts, "at")), place)

    def slots(run: Column) -> Column:
        def of(r: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.least(F.lit(size), F.size("words")) - 1),
                lambda k: F.struct((r["at"] + k).alias("j"), (r["at"] + k - r["back"]).alias("i")),
            )

        rows = F.transform(
            F.array_distinct(F.flatten(F.transform(run, of))),
            lambda r: F.struct(F.get("inner", r["j"]).alias("inner"), F.get("form", r["j"]).alias("a"), F.get("words", r["j"]).alias("x"), F.get("d_words", r["i"]).alias("y")),
        )
        return F.filter(rows, lambda r: _is_slot(r["a"]))

    def agree(s: Column) -> Column:
        one, two, three = (F.size(F.array_distinct(F.transform(s, f))) for f in (lambda r: F.struct(r["a"], r["x"], r["y"]), lambda r: F.struct(r["a"], r["x"]), lambda r: F.struct(r["a"], r["y"])))
        return (one == two) & (one == three)

    def judge(run: Column) -> Column:
        def any_part(run: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(run) - least + 1)
            return F.exists(starts, lambda i: let(slots(F.slice(run, i, F.lit(least))), agree))

        def told(s: Column) -> Column:
            ok = F.when(agree(s), True).when(F.size(run) > least, any_part(run)).otherwise(False)
            return F.struct(ok.alias("ok"), F.size(F.filter(s, lambda r: _is_slot(r["inner"]))).cast("bigint").alias("n"), F.forall(s, lambda r: r["x"] == r["y"]).alias("same"))

        return let(slots(run), told)

    run_of = let(F.sort_array("shifts", asc=False), aligned)
    judged = both.select("doc_id", "item_id", "windows", "matched", let(run_of, judge).alias("v"))
    return (
        judged.filter("v.ok")
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("windows").cast("bigint").alias("windows"),
            F.max("matched").cast("bigint").alias("matched"),
            F.max("v.n").alias("n_slots"),
            F.max("v.same").alias("same_slots"),
        )
        .select("doc_id", "item_id", "windows", "matched", (F.col("matched") / F.col("windows")).alias("coverage"), "n_slots", "same_slots")
    )


def clean(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; rows with a null id stay."""
    return docs.join(leaks(docs, benchmark, **limits).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
