"""Toxic spans and document scores from a linear-chain conditional random field."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import bottom_sample, fold, one_text, saved

FIT_ROWS = 16384  # labelled documents that the model is fitted on, at most
_SPACE = 1 << 18
_CACHE = 1_000_000
_AROUND = 8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”„‘’«»¿¡–—"


def cues(word: str) -> list[str]:
    """Names of a word's features: itself, its beginnings and its end, without case or edge marks."""
    w = word.lower().strip(_MARKS)
    return ["=" + w, *("^" + w[:n] for n in (3, 4, 5, 6) if len(w) > n), *([w[-4:] + "$"] if len(w) > 4 else [])] if w else []


def _slots(word: bytes) -> list[int]:
    """Hashed features of a word: the bias, itself, its beginnings and its end in bytes."""
    w = word.decode().lower().strip(_MARKS).encode()
    n, crc = len(w), zlib.crc32
    if not n:
        return [0]
    found = [crc(w, 1)]
    start = crc(w[:3], 2)
    for i in range(3, min(n, 7)):
        found.append(start)
        start = crc(w[i : i + 1], start)
    if n > 4:
        found.append(crc(w[-4:], 3))
    return [0, *[1 + x % (_SPACE - 1) for x in found]]


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def cue_counts(sample: DataFrame) -> DataFrame:
    """``(cue, toxic, clean)``: documents of either label that hold the cue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist()):
                for cue in {c for w in set(_WORD.findall(text)) for c in cues(w)}:
                    found.setdefault(cue, [0, 0])[1 - toxic] += 1
            n = np.array(list(found.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(n[:, 0]), pa.array(n[:, 1])], ["cue", "toxic", "clean"])

    return sample.mapInArrow(run, "cue string, toxic bigint, clean bigint").groupBy("cue").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_cues(sample: DataFrame, least: int = 5) -> list[str]:
    """Few cues that together explain the toxic documents, by greedy cover.

    Candidates stand in at least ``least`` toxic documents and nine times as
    often in those as in others. The one that explains most documents not
    explained so far is taken, then the next. Words that only come along, as in
    many copies of one toxic document, explain nothing new and are not taken. All
    candidates are weighed: their number is bounded by the sample's words.
    """
    counted = cue_counts(sample).filter((F.col("toxic") >= least) & (F.col("toxic") >= 9 * F.col("clean")))
    rows = counted.orderBy(F.desc(F.col("toxic") - F.col("clean")), "cue").collect()
    number = {r.cue: i for i, r in enumerate(rows)}

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for text in _texts(batch):
                lists.append(sorted({number[c] for w in set(_WORD.findall(text)) for c in cues(w) if c in number}))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], ["held"])

    held = [r.held for r in sample.filter("toxic = 1").mapInArrow(holders, "held array<int>").collect()] if rows else []
    doc = np.repeat(np.arange(len(held)), [len(x) for x in held])
    cue = np.concatenate([np.array(x, np.int64) for x in held]) if len(doc) else np.empty(0, np.int64)
    penalty = np.array([r.clean for r in rows])
    chosen: list[str] = []
    while len(cue):
        gain = np.bincount(cue, minlength=len(rows)) - penalty
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen.append(rows[best].cue)
        open_ = ~np.isin(doc, doc[cue == best])
        doc, cue = doc[open_], cue[open_]
    return chosen


def windows(sample: DataFrame, chosen: list[str]) -> DataFrame:
    """Labelled tokens: up to three windows of each document, ``(words, tags)``.

    A token of a toxic document with a chosen cue is tagged 1, all others 0. One
    window stands around a tagged token, if there is one, the others lie
    anywhere, fixed by the text.
    """
    wanted, size = set(chosen), 2 * _AROUND + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, tags = [], []
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist()):
                own = _WORD.findall(text)
                if not own:
                    continue
                rng = np.random.default_rng(zlib.crc32(text.encode()))
                marks = [int(toxic == 1 and any(c in wanted for c in cues(w))) for w in own]
                at = np.nonzero(marks)[0]
                middles = [*(rng.choice(at, min(2, len(at)), replace=False) if len(at) else []), rng.integers(0, len(own))]
                for m in middles:
                    lo = max(0, min(int(m) - int(rng.integers(0, size)), len(own) - size))
                    out.append(own[lo : lo + size])
                    tags.append(marks[lo : lo + size])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int32()))], ["words", "tags"])

    return sample.mapInArrow(run, "words array<string>, tags array<int>")


def fit_field(rows: list, rounds: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the emissions (hashed) and of the transitions by maximum likelihood.

    Forward and backward passes run over all windows at once; Adam on the exact
    gradient, expected minus observed features. Label 0 emits 0.
    """
    n, size = len(rows), 2 * _AROUND + 1
    width = 7
    slots = np.full((n, size, width), -1, np.int64)
    tags, there = np.zeros((n, size)), np.zeros((n, size), bool)
    memory: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        for j, (w, tag) in enumerate(zip(r.words, r.tags)):
            if w not in memory:
                memory[w] = _slots(w.encode())
            slots[i, j, : len(memory[w])] = memory[w]
            tags[i, j], there[i, j] = tag, True
    ids, flat = np.unique(slots[slots >= 0], return_inverse=True)
    used = slots >= 0
    token = np.nonzero(used)[0] * size + np.nonzero(used)[1]
    theta, trans = np.zeros(len(ids)), np.zeros((2, 2))
    moments = [np.zeros(len(ids) + 4), np.zeros(len(ids) + 4)]
    seen_emit = np.bincount(flat, tags.reshape(-1)[token], len(ids))
    pairs = there[:, 1:] & there[:, :-1]
    seen_trans = np.array([[(pairs & (tags[:, :-1] == a) & (tags[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    for step in range(1, rounds + 1):
        emit = np.bincount(token, theta[flat], n * size).reshape(n, size)
        alpha, beta = np.zeros((n, size, 2)), np.zeros((n, size, 2))
        alpha[:, 0, 1] = emit[:, 0]
        for t in range(1, size):
            alpha[:, t] = np.logaddexp(alpha[:, t - 1, :1] + trans[0], alpha[:, t - 1, 1:] + trans[1])
            alpha[:, t, 1] += emit[:, t]
            alpha[:, t] = np.where(there[:, t, None], alpha[:, t], alpha[:, t - 1])
        for t in range(size - 2, -1, -1):
            ahead = beta[:, t + 1] + np.stack([np.zeros(n), emit[:, t + 1]], 1)
            new = np.logaddexp(ahead[:, :1] + trans[:, 0], ahead[:, 1:] + trans[:, 1])
            beta[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        whole = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - whole[:, None]) * there
        joint = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                score = alpha[:, :-1, a] + trans[a, b] + (emit[:, 1:] if b else 0) + beta[:, 1:, b] - whole[:, None]
                joint[a, b] = np.exp(score[pairs]).sum()
        grad = np.concatenate([np.bincount(flat, p.reshape(-1)[token], len(ids)) - seen_emit, (joint - seen_trans).ravel()]) / max(n, 1)
        grad += ridge * np.concatenate([theta, trans.ravel()])
        for m, g, decay in zip(moments, (grad, grad * grad), (0.9, 0.99)):
            m *= decay
            m += (1 - decay) * g
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        theta -= move[: len(ids)]
        trans -= move[len(ids) :].reshape(2, 2)
    weights = np.zeros(_SPACE, np.float32)
    weights[ids] = theta
    return weights, trans


class _Odds(dict):
    """Word to the odds that its own features give; emptied when it has grown large."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: bytes) -> float:
        if len(self) > _CACHE:
            self.clear()
        value = self[word] = math.exp(min(max(sum(map(self.weights.__getitem__, _slots(word))), -30.0), 30.0))
        return value


def tagger(weights: np.ndarray, trans: np.ndarray) -> Callable[[list[bytes]], np.ndarray]:
    """Function of a text's words to each word's marginal probability of being toxic.

    With two labels the forward and backward messages are odds, so either pass
    is one recursion over numbers; words' own odds are kept from text to text.
    """
    (a, b), (c, d) = np.exp(np.clip(trans - trans[0, 0], -30, 30)).tolist()
    own = _Odds(weights).__getitem__

    def tag(words: list[bytes]) -> np.ndarray:
        emit = list(map(own, words))
        ahead = np.fromiter(accumulate(emit, lambda r, e: (b + d * r) / (a + c * r) * e), float, len(emit))
        back = accumulate(emit[:0:-1], lambda r, e: (c + d * e * r) / (a + b * e * r), initial=1.0)
        both = ahead * np.fromiter(back, float, len(emit))[::-1]
        return both / (1 + both)

    return tag


def _figures(p: np.ndarray) -> tuple[float, float, float]:
    """Chance of any toxic word, log of the expected number, root of their share."""
    total = float(p.sum())
    return 1 - float(np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), float(np.log1p(total)), float(np.sqrt(total / len(p)))


def _link(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton steps; the first column is the constant."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = x.T @ (p - y) + ridge * beta
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), step)
    return beta


class Model:
    """What scoring needs: hashed weights, transitions, and the link to a document's score."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, link: np.ndarray) -> None:
        self.weights, self.trans, self.link = weights, trans, link


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = FIT_ROWS) -> Model:
    """Model from the labelled rows of ``docs`` whose id satisfies ``learn``.

    At most ``rows`` documents are used, those with the smallest hashes of their
    ids, one text of each id; equal texts count once, toxic if any of them is. Null labels, texts and
    ids are left out. With one label only, every score is that label's 0 or 1
    (0 without labels).
    """
    learn = F.lit(True) if learn is None else learn
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & learn)
    picked = bottom_sample(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("doc_id is not null"), "doc_id", rows)
    # at most `rows` rows
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    joined = one_text(texts.join(F.broadcast(picked), "doc_id"))
    sample = saved(joined.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic_sample").repartition(32)
    kinds = {r.toxic for r in sample.select("toxic").distinct().collect()}
    flat = np.zeros(_SPACE, np.float32)
    if kinds != {0, 1}:
        return Model(flat, np.zeros((2, 2)), np.array([40.0 if kinds == {1} else -40.0, 0, 0, 0]))
    weights, trans = fit_field(windows(sample, choose_cues(sample)).collect())

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = tagger(weights, trans)
        for batch in batches:
            lists = [_figures(tag(w)) if (w := t.encode().split()) else (0.0, 0.0, 0.0) for t in _texts(batch)]
            columns = [pa.array(list(c), pa.float64()) for c in zip(*lists)] or [pa.array([], pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([*columns, batch.column("toxic")], ["a", "b", "c", "toxic"])

    seen = np.array([tuple(r) for r in sample.mapInArrow(figures, "a double, b double, c double, toxic int").collect()], float)
    return Model(weights, trans, _link(np.column_stack([np.ones(len(seen)), seen[:, :3]]), seen[:, 3]))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``spans``.

    ``spans`` are the stretches of words whose marginal reaches ``threshold``:
    start and end in code points, and the largest marginal. A null or empty text
    has no span and the score of a text without toxic words. Columns of these
    names in ``docs`` are replaced.
    """
    weights, trans, link = model.weights, model.trans, model.link
    kept = docs.drop("score", "predicted", "spans")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = tagger(weights, trans)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for text in _texts(batch):
                found = text.encode().split()  # the same words as _WORD's
                p = tag(found) if found else np.zeros(1)
                z = float(link @ np.array([1.0, *_figures(p)]))
                scores.append(float(1 / (1 + np.exp(-z))))
                own: list[dict] = []
                hot = np.nonzero(p >= threshold)[0] if found else []
                if len(hot):
                    at = [m.span() for m in _WORD.finditer(text)]
                    cuts = [0, *(i + 1 for i, (x, y) in enumerate(pairwise(hot)) if y > x + 1), len(hot)]
                    for lo, hi in pairwise(cuts):
                        run_ = hot[lo:hi]
                        own.append({"start": at[run_[0]][0], "end": at[run_[-1]][1], "p": float(p[run_].max())})
                spans.append(own)
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], [*names, "score", "spans"])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])
    out = kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def not_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) != 0, F.lit(False))
