"""Document quality without labels: weak labellers, their accuracies, a hashed scorer."""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import bottom_sample, one_text

FIT_ROWS = 8192  # documents that the scorer is fitted on, at most
_SPACE = 1 << 14
_CACHE = 400_000
_PLAIN = 0x3000  # code points from here on count as letters

#: Labellers in the order of their votes: 1 good, 0 bad, 2 no opinion.
LABELLERS = ("symbols", "separators", "capitals", "echoes", "variety", "word_size", "sentences", "size")


def _kinds() -> np.ndarray:
    """Kind of each code point: 0 other letter, 1 capital, 2 space, 3 digit, 4 mark."""
    out = np.zeros(_PLAIN + 1, np.uint8)
    for i in range(_PLAIN):
        c = chr(i)
        out[i] = 2 if c.isspace() else 3 if c.isdigit() else 1 if c.isupper() else 0 if c.isalpha() else 4
    return out


def _vote(good: bool, bad: bool) -> int:
    return 0 if bad else 1 if good else 2


def votes(text: str, words: list[str], kinds: np.ndarray) -> tuple[int, ...]:
    """One vote of each labeller on a whole text."""
    n = len(words)
    if not n:
        return (2, 2, 2, 2, 2, 2, 2, 0)
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), _PLAIN)
    other, capital, _, digit, mark = np.bincount(kinds[codes], minlength=5).tolist()
    letters = other + capital
    marks, shout = mark / max(letters + digit + mark, 1), capital / max(letters, 1)
    bars = sum(w in ("|", "-", "*", "/", "\\", "•", "»") for w in words) / n
    echo = sum(map(operator.eq, words, words[1:])) / n
    variety = len(set(words)) / n
    size = letters / n
    ends = sum(text.count(c) for c in ".!?")
    return (
        _vote(marks < 0.06, marks > 0.15),
        _vote(bars < 0.02, bars > 0.12),
        _vote(shout < 0.15, shout > 0.5) if letters >= 20 else 2,
        _vote(echo < 0.04, echo > 0.25),
        _vote(variety > 0.45, variety < 0.2) if n >= 40 else 2,
        _vote(3 <= size <= 9, size < 2 or size > 20),
        _vote(ends * 60 >= n, ends * 200 < n) if n >= 30 else 2,
        0 if n < 3 else 1 if n >= 20 else 2,
    )


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, weight: float = 0.5, alarm: float = 0.002, pull: float = 1000.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of "good" for each vote pattern, each labeller's vote shares, and the priors.

    The hidden class is good, or bad in the way of one labeller, as kinds of bad
    texts differ and each shows to few labellers. A labeller that has an opinion
    votes bad or good with a share that depends on the class, apart from the
    other labellers; no opinion tells nothing. Starts from texts without a bad
    vote as good and the others as their rarest bad vote says. ``weight`` smooths
    the shares. A bad vote that no other labeller shares could as well be noise on
    good texts; so the share of false alarms is drawn towards ``alarm``, with the
    weight of ``pull`` good texts at any number of texts: it decides where there
    are few, and the votes decide where there are many. ``shares[k, c]`` is labeller k's (bad, good) in class c.
    """
    n, width = patterns.shape
    bad = patterns == 0
    rarity = np.where(bad, (bad * counts[:, None]).sum(axis=0), np.inf)
    first = np.where(bad.any(axis=1), rarity.argmin(axis=1) + 1, 0) if n else np.empty(0, np.int64)
    p = np.full((n, width + 1), 1e-4)
    p[np.arange(n), first] = 1 - 1e-4 * width
    shares = np.full((width, width + 1, 3), 1.0)  # the third column stands for no opinion
    prior = np.full(width + 1, 1 / (width + 1))
    for _ in range(rounds):
        held = p * counts[:, None]
        prior = (held.sum(axis=0) + weight) / (held.sum() + weight * (width + 1))
        for k in range(width):
            for c in range(width + 1):
                votes_ = np.bincount(patterns[:, k], held[:, c], 3)[:2] + weight
                if c == 0:
                    votes_ += pull * np.array([alarm, 1 - alarm])
                shares[k, c, :2] = votes_ / votes_.sum()
        logs = np.log(prior) + sum(np.log(shares[k][:, patterns[:, k]]).T for k in range(width))
        new = np.exp(logs - logs.max(axis=1, keepdims=True)) if n else logs
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - p).max(initial=0.0) < 1e-9
        p = new
        if done:
            break
    return p[:, 0], shares, prior


def _shape(word: str) -> str:
    """Word with letters as a or A, digits as 0, runs shortened to two."""
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:24])
    return re.sub(r"(.)\1{2,}", r"\1\1", out)


class _Shapes(dict):
    """Word to the hashed slot of its shape."""

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        slot = self[word] = 1 + zlib.crc32(_shape(word).encode()) % (_SPACE - 9)
        return slot


def features(words: list[str], shapes: _Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: shares of its word shapes, and of repeated words."""
    n = len(words)
    if not n:
        return np.array([0, _SPACE - 1]), np.array([1.0, 1.0])
    slots, times = np.unique(np.fromiter(map(shapes.__getitem__, words), np.int64, n), return_counts=True)
    echo, variety = sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n
    return np.concatenate([[0], slots, [_SPACE - 8, _SPACE - 7, _SPACE - 6]]), np.concatenate([[1.0], np.sqrt(times / n), [echo, variety, float(np.log1p(n)) / 10]])


def _train(rows: list, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by Adam, full batches."""
    lengths = [len(r.slots) for r in rows]
    row = np.repeat(np.arange(len(rows)), lengths)
    slot = np.concatenate([np.array(r.slots, np.int64) for r in rows])
    value = np.concatenate([np.array(r.vals) for r in rows])
    y = np.array([r.p for r in rows])
    theta, first, second = np.zeros(_SPACE), np.zeros(_SPACE), np.zeros(_SPACE)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * theta[slot], len(rows)), -30, 30)))
        grad = np.bincount(slot, value * (p - y)[row], _SPACE) / len(rows) + ridge * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta


def _votes_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, votes(t, t.split(), kinds))) for t in texts], pa.string())], ["votes"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "votes string")


def score(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, score, keep, posterior, votes`` of every row of ``docs``.

    All texts are voted on; the driver gets only the number of texts of each vote
    pattern (at most 3^8), and finds by expectation-maximisation how far each
    labeller is to be believed. The posteriors then label at most ``rows``
    documents (smallest hashes of their ids, one row of each) on which a linear scorer of hashed
    word shapes is trained. ``score`` (0 to 1) is the scorer's, ``keep`` is 1 from
    0.5 on. Null texts count as empty, which only the size labeller votes on, as
    bad. Null ids are scored but not fitted on; repeated rows stay. An empty
    table gives none.
    """
    counted = _votes_of(docs).groupBy("votes").count().collect()
    patterns = np.array([[int(x) for x in r.votes] for r in counted], np.int64).reshape(-1, len(LABELLERS))
    posterior, _, _ = expectation_maximisation(patterns, np.array([r["count"] for r in counted], float))
    believed = {r.votes: float(p) for r, p in zip(counted, posterior)}
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, shapes = _kinds(), _Shapes()
        for batch in batches:
            slots, values, p = [], [], []
            for t in batch.column("text").to_pylist():
                words = (t or "").split()
                s, v = features(words, shapes)
                slots.append(s.tolist())
                values.append(v.tolist())
                p.append(believed["".join(map(str, votes(t or "", words, kinds)))])
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array(p, pa.float64())], ["slots", "vals", "p"])

    ids = bottom_sample(docs.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", rows)
    # at most `rows` ids, one row of each
    sample = one_text(texts.join(F.broadcast(ids), "doc_id")).mapInArrow(describe, "slots array<int>, vals array<double>, p double").collect()
    theta = _train(sample) if sample else np.zeros(_SPACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, shapes = _kinds(), _Shapes()
        for batch in batches:
            scores, labels, marks = [], [], []
            for t in batch.column("text").to_pylist():
                words = (t or "").split()
                s, v = features(words, shapes)
                scores.append(float(1 / (1 + np.exp(-np.clip(v @ theta[s], -30, 30)))))
                mark = "".join(map(str, votes(t or "", words, kinds)))
                marks.append(mark)
                labels.append(believed[mark])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(labels, pa.float64()), pa.array(marks, pa.string())], ["doc_id", "score", "posterior", "votes"]
            )

    out = texts.mapInArrow(run, "doc_id bigint, score double, posterior double, votes string")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("keep"), "posterior", "votes")
