"""Language of whole texts: first a family of languages, then the language within it.

Texts become hashed counts of byte n-grams. The families are learnt: the mean
vectors of the languages are joined by average linkage. One linear support vector
machine for each family against the rest picks the family; within it one for each
two languages votes. All machines are trained as groups of one Spark job, each on
its part of a bounded sample of labelled texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import saved
from siftline.ordering import top_k_per_group

FIT_ROWS = 4096  # labelled texts of the sample, dealt evenly to the languages
DIMS = 1 << 12
UNKNOWN = "und"
_ORDERS = (1, 2, 3, 4)
_MIX = 2654435761
_WINDOW = 1 << 20  # bytes hashed at once
_ROWS = 128  # texts laid out at once
_COST, _EPOCHS = 4.0, 40
#: ASCII letters stay; other ASCII becomes a blank; bytes of other characters stay.
_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _plain(text: str) -> bytes:
    """Lower-cased words, one blank before and after each."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).split()) + b" "


def features(texts: Sequence[str | None], dims: int = DIMS) -> np.ndarray:
    """A row for each text: square roots of its hashed n-gram counts, of length one, and a one."""
    shift = np.uint32(32 - (dims.bit_length() - 1))
    out = np.zeros((len(texts), dims + 1), np.float32)
    for row, text in enumerate(texts):
        if not text:
            continue
        plain = _plain(text)
        counts = np.zeros(dims, np.int64)
        for start in range(0, len(plain), _WINDOW):
            # a window ends with the n-grams that begin in it
            data = np.frombuffer(plain[start : start + _WINDOW + max(_ORDERS) - 1], np.uint8).astype(np.uint32)
            begun = min(_WINDOW, len(plain) - start)
            key = np.zeros(len(data), np.uint32)
            for n in _ORDERS:
                size = min(begun, len(data) - n + 1)
                if size <= 0:
                    break
                key = key[:size] | (data[n - 1 : n - 1 + size] << np.uint32(8 * (n - 1)))
                counts += np.bincount((key * np.uint32(_MIX) + np.uint32(n * 0x9E3779B1 % 2**32)) * np.uint32(_MIX) >> shift, minlength=dims)
        root = np.sqrt(counts)
        out[row, :dims] = root / math.sqrt(counts.sum())
    out[:, dims] = 1.0
    return out


def train_machine(x: np.ndarray, y: np.ndarray, cost: float = _COST, epochs: int = _EPOCHS) -> np.ndarray:
    """Weights of a linear support vector machine, by dual coordinate ascent; the same at each run."""
    rng = np.random.default_rng(5)
    alpha, weights = np.zeros(len(y)), np.zeros(x.shape[1])
    norm = np.einsum("ij,ij->i", x, x, dtype=np.float64)
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}  # both sides weigh the same
    top = np.array([cost * share[s] for s in y])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            slope = y[i] * (x[i] @ weights) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), top[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return weights


def families_of(means: np.ndarray) -> list[int]:
    """Family of each language: average linkage of mean vectors to the root of their number, rounded up."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    groups = [[i] for i in range(len(means))]
    while len(groups) > math.ceil(math.sqrt(len(means))):
        best = max(itertools.combinations(range(len(groups)), 2), key=lambda p: near[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[best[0]] += groups.pop(best[1])
    place = {i: k for k, g in enumerate(groups) for i in g}
    return [place[i] for i in range(len(means))]


@dataclass
class Model:
    """Languages with their families, and a column of weights for each machine.

    ``machines`` names them: ``(family, None)`` for a family against the rest,
    ``(i, j)`` for language i (positive) against language j.
    """

    langs: list[str]
    family: list[int]
    machines: list[tuple[int, int | None]]
    weights: np.ndarray

    def pick(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Language number and score of each row of ``x``."""
        n, families = len(x), max(self.family) + 1
        margin = x @ self.weights if self.machines else np.zeros((n, 0))
        first = [k for k, (_, j) in enumerate(self.machines) if j is None]
        if first:
            of = np.exp(2 * (margin[:, first] - margin[:, first].max(1, keepdims=True)))
            of /= of.sum(1, keepdims=True)
        else:
            of = np.ones((n, families))
        family = of.argmax(1)
        chosen, score = np.zeros(n, np.int64), np.zeros(n)
        for f in range(families):
            rows = np.flatnonzero(family == f)
            members = [i for i, g in enumerate(self.family) if g == f]
            if not len(rows):
                continue
            if len(members) == 1:
                chosen[rows], score[rows] = members[0], of[rows, f]
                continue
            # votes first, the sum of margins for ties
            votes, belief = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            at = {m: k for k, m in enumerate(members)}
            for k, (i, j) in enumerate(self.machines):
                if j is None or i not in at:
                    continue
                m = margin[rows, k]
                votes[:, at[i]] += m > 0
                votes[:, at[j]] += m <= 0
                sure = 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
                belief[:, at[i]] += sure
                belief[:, at[j]] += 1 - sure
            belief /= len(members) - 1
            best = (votes + belief / 2).argmax(1)
            chosen[rows] = np.array(members)[best]
            score[rows] = of[rows, f] * belief[np.arange(len(rows)), best]
        return chosen.tolist(), np.clip(score, 0, 1)


_VECTORS = "lang string, x array<float>"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            x = features(part.column("text").to_pylist())
            offsets = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["lang", "x"])


def _rows(table: pa.Table) -> np.ndarray:
    flat = table.column("x").combine_chunks().flatten().to_numpy()
    return flat.reshape(table.num_rows, -1)


def _mean(table: pa.Table) -> pa.Table:
    return pa.table({"lang": table.column("lang").slice(0, 1), "x": pa.array([_rows(table).mean(0)], pa.list_(pa.float32()))})


def _trained(table: pa.Table) -> pa.Table:
    # an order that does not depend on how rows came in
    x, y = _rows(table), table.column("y").to_numpy()
    order = np.lexsort((*x[:, :32].T, y))
    weights = train_machine(x[order], y[order])
    return pa.table({"machine": table.column("machine").slice(0, 1), "x": pa.array([weights], pa.list_(pa.float64()))})


def sample(docs: DataFrame, text: str, lang: str, rows: int) -> DataFrame:
    """``(lang, text)``: different texts with letters, at most ``rows``, as many of each language.

    Those with the smallest hashes are taken; equal texts of a language count once.
    """
    fit = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    fit = fit.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).withColumn("h", F.xxhash64("text"))
    hashes = saved(fit.groupBy("lang", "h").agg(F.count("*").alias("n")), "language-hashes")
    each = max(1, rows // max(1, hashes.select("lang").distinct().count()))
    picked = saved(top_k_per_group(hashes, ["lang"], [F.col("h")], each).select("lang", "h"), "language-picked")
    # at most `rows` rows of two numbers, or one a language
    return fit.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Model | None:
    """Model of the languages that occur in ``docs``; None if there are none.

    Rows with a null language or a text without a letter teach nothing. The
    number of languages must be small enough for a vector of each on the driver.
    """
    spark = docs.sparkSession
    vectors = saved(sample(docs, text, lang, rows).mapInArrow(_vectors, _VECTORS), "language-vectors")
    means = sorted(vectors.groupBy("lang").applyInArrow(_mean, _VECTORS).collect(), key=lambda r: r.lang.encode())
    if not means:
        return None
    langs = [r.lang for r in means]
    family = families_of(np.array([r.x for r in means], np.float64))
    number = max(family) + 1
    machines: list[tuple[int, int | None]] = [(f, None) for f in range(number)] if number > 1 else []
    machines += [(i, j) for i, j in itertools.combinations(range(len(langs)), 2) if family[i] == family[j]]
    sides = []
    for k, (i, j) in enumerate(machines):
        if j is None:
            sides += [(k, name, 1 if family[n] == i else -1) for n, name in enumerate(langs)]
        else:
            sides += [(k, langs[i], 1), (k, langs[j], -1)]
    if not machines:
        return Model(langs, family, [], np.zeros((DIMS + 1, 0)))
    # rows of sides: languages times families and the pairs within families
    dealt = vectors.join(F.broadcast(spark.createDataFrame(sides, "machine int, lang string, y int")), "lang").select("machine", "y", "x")
    found = {r.machine: r.x for r in dealt.groupBy("machine").applyInArrow(_trained, "machine int, x array<double>").collect()}
    return Model(langs, family, machines, np.array([found[k] for k in range(len(machines))]).T)


def predict(docs: DataFrame, model: Model | None, keep: Sequence[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` for each row of ``docs``.

    A null text or one without a letter is ``und`` with a score of 0, and so is
    every text if there is no model. The score is the share of the family times
    the mean share of the language against its relatives; repeated rows are
    scored each, extra columns take no part.
    """
    carried = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, carried)], F.col(text).cast("string").alias("text"))
    kind = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                texts = part.column("text").to_pylist()
                known = [i for i, t in enumerate(texts) if learnt is not None and has_letter(t)]
                name, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known:
                    chosen, scores = learnt.pick(features([texts[i] for i in known]))
                    score[known] = scores
                    for i, k in zip(known, chosen):
                        name[i] = learnt.langs[k]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(name, pa.string()), pa.array(score)], [*carried, "lang_pred", "score"])

    return rows.mapInArrow(run, kind).select(*[F.col(n).alias(c) for c, n in zip(keep, carried)], "lang_pred", "score")


def quarter(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learnt from three quarters of the documents, applied to all.

    Rows with a null id are neither learnt from nor held out.
    """
    held = quarter("doc_id") == 2
    model = fit(docs.filter(~held))
    found = predict(docs, model, ["doc_id"])
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
