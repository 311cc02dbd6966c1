"""Language-model scores by a weighted backoff automaton."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import as_bytes, saved, words

END = b" "  # no word holds a space
_BLOCK = 5_000_000  # bytes of text
_BUCKET = 1_000_000
_SENT = "bucket bigint, block bigint, word boolean, size bigint, keys binary, counts binary"
_FOUND = "bucket bigint, block bigint, word boolean, size bigint, counts binary, known bigint, total bigint"
_HELD = "block bigint, texts binary"
_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class _Vocabulary(dict):
    """Word to a number of its own; hashes in the same order."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.hashes)
        self.hashes.append(_hash(word))
        return number


def _long_hash(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x << np.uint64(31) | x >> np.uint64(33)) * np.uint64(0x9E3779B185EBCA87)
    x ^= seed + np.uint64(0x27D4EB2F165667C5 + 8)
    x = (x << np.uint64(27) | x >> np.uint64(37)) * np.uint64(0x9E3779B185EBCA87) + np.uint64(0x85EBCA77C2B2AE63)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)
    return x ^ x >> np.uint64(32)


def joined_keys(states: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Keys of the arcs with these sources and words: Spark's ``xxhash64(state, word)``."""
    return _long_hash(labels.view(np.uint64), _long_hash(states.view(np.uint64), np.uint64(42))).view(np.int64)


def ngrams(keys: np.ndarray, rows: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams of texts whose words follow one another in ``keys``, ``rows`` naming each word's text.

    Gives the keys of the distinct words and of the longer n-grams, both sorted, and, for
    each length from 1 to ``order``, the words at which an n-gram of that length ends
    and its place among the words' keys followed by the others. The key of an
    n-gram is that of the arc that reads its last word after the others.
    """
    at, ends, made = np.arange(len(keys)), [], []
    longer = keys
    for n in range(1, order + 1):
        if n > 1:
            near = (at + 1 < len(keys)) & (rows[at] == rows[np.minimum(at + 1, len(keys) - 1)])
            longer, at = longer[near], at[near] + 1
            longer = joined_keys(longer, keys[at])
        ends.append(at)
        made.append(longer)
    ones, first = np.unique(keys.view(np.uint64), return_inverse=True)
    rest = np.concatenate([keys[:0], *made[1:]]).view(np.uint64)
    others, places = np.unique(rest, return_inverse=True)
    return ones, others, ends, [first, *np.split(places + len(ones), np.cumsum([len(m) for m in made[1:]])[:-1])][:order]


def automaton(counts: np.ndarray, ends: list[np.ndarray], places: list[np.ndarray], ground: float, strength: float) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """States and arcs of the n-grams of ``ngrams`` with these training counts, and the arcs along the texts.

    State 0 is the root; state k + 1 is the k-th n-gram, if it occurs in training
    and is shorter than the order. Arc k + 1 reads the last word of the k-th n-gram
    in the state of the words before; there is one for each n-gram that occurs, and
    the root has one for every word. ``target`` is the n-gram's own state, or its
    suffix's if it is of the last order. ``fail`` leads to the longest proper
    suffix, at the weight ``backoff``. With counts c and strength m,

        P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m),   b(h) = m / (c(h) + m),

    and (c(w) + 0.5) / ``ground`` at the root. Every n-gram of the training
    texts has a part, however rare, and the probabilities after a state sum to 1.

    The second result holds, for each length, the arc that reads a word after the
    n - 1 words before it: one entry per word, 0 where there is none.
    """
    size, words_ = len(counts) + 1, len(ends[0])
    count = np.append(0, counts)
    chance, target, fail, depth = np.zeros(size), np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.uint8)
    before = np.zeros(words_, np.int32)
    arcs = []
    for n, (at, place) in enumerate(zip(ends, places), 1):
        own = place + 1
        here = np.zeros(words_, np.int32)
        here[at] = own
        if n == 1:
            chance[own] = (count[own] + 0.5) / ground
        else:
            suffix, history = before[at], before[at - 1]
            chance[own] = (count[own] + strength * chance[suffix]) / (count[history] + strength)
            fail[own] = suffix
        seen = count[own] > 0
        target[own] = np.where(seen, fail[own] if n == len(ends) else own, 0)
        depth[own] = n
        before = here
        arcs.append(here if n == 1 else np.where(count[here] > 0, here, 0))
    logs = np.log10(chance, out=np.zeros(size), where=chance > 0)
    return {"weight": logs, "target": target, "backoff": np.log10(strength / (count + strength)), "fail": fail, "depth": depth}, arcs


def walker(tables: dict[str, np.ndarray], arcs: list[np.ndarray]) -> Callable[[int, int], float]:
    """Function of the first word and the one after the last of a text to the text's log10 probability.

    One pass from left to right, beginning at the root. Where the state has no arc
    for the word, its backoff weight is added and its failure arc followed.
    """
    weight, backoff, target, fail, depth = (memoryview(tables[c]) for c in ("weight", "backoff", "target", "fail", "depth"))
    after = [memoryview(a) for a in arcs]

    def walk(start: int, stop: int) -> float:
        state, score = 0, 0.0
        for i in range(start, stop):
            arc = after[depth[state]][i]
            while not arc:
                score += backoff[state]
                state = fail[state]
                arc = after[depth[state]][i]
            score += weight[arc]
            state = target[arc]
        return score

    return walk


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, each compressed: equal high bytes take next to no room."""
    planes = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in numbers.view(np.uint8).reshape(len(numbers), -1).T]
    return np.array([len(p) for p in planes], np.int32).tobytes() + b"".join(planes)


def _unpack(packed: bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    cuts = np.cumsum([4 * width, *np.frombuffer(packed, np.int32, width)]).tolist()
    out = np.empty((size, width), np.uint8)
    for k, (i, j) in enumerate(pairwise(cuts)):
        out[:, k] = np.frombuffer(pa.decompress(packed[i:j], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return out.view(kind).ravel()


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of a schema of long, boolean and binary columns."""
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [pa.field(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Hashes of the words and ends of texts, the number of each one's text, and the texts' numbers of them."""
    names, flat, sizes = _Vocabulary(), [], []
    for text in texts:
        before = len(flat)
        flat += map(names.__getitem__, words(text))
        flat.append(names[END])
        sizes.append(len(flat) - before)
    hashes = np.array(names.hashes, np.uint64).view(np.int64)
    return hashes[np.array(flat, np.int64)], np.repeat(np.arange(len(sizes)), sizes), sizes


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows ``(doc_id, text, held_out)`` of a task, texts as bytes, in blocks named by place and texts."""
    rows, size, made = [], 0, 0

    def name() -> int:
        found = xxhash.xxh64(f"{TaskContext.get().partitionId()} {made}")
        for _, t, held in rows:
            found.update(b"%d %d " % (len(t), held))
            found.update(t)
        return found.intdigest() - (1 << 63)

    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            rows.append(row)
            size += len(row[1]) + 1
            if size > _BLOCK:
                yield name(), rows
                rows, size, made = [], 0, made + 1
    if rows:
        yield name(), rows


def written(rows: list[tuple]) -> bytes:
    """Rows of a block as a compressed Arrow stream."""
    kinds = {"doc_id": pa.int64(), "text": pa.large_binary(), "held_out": pa.bool_()}
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def score_texts(docs: DataFrame, held_out: Column, text: str = "text", order: int = 3, strength: float = 128.0) -> DataFrame:
    """log10 probability of every text, learnt from the rows that are not ``held_out``.

    Tokens are the words and one end. All training tokens and all their n-grams of
    at most ``order`` words are counted; the smoothing is that of ``automaton``.
    Texts are taken in blocks of a bounded size (a longer text ends its block). A
    block sends each of its distinct n-grams once, by an 8-byte key, with its number
    in the block's training texts, to the bucket of the key's range; the bucket
    adds the numbers up and sends the sums back. From them the block builds the states, arcs and failure arcs of its own n-grams, which are
    all that its texts can reach, and walks each text once.

    Blocks and buckets grow in number with the corpus, not in size. A bucket has
    a frequent n-gram at most once from each block. Blocks are cut from the rows
    twice, first to count and then to score, in the order of the rows; so
    ``docs`` should come from files or a written table. Where rows came in
    another order, texts and counts have blocks of other names, and the query fails.

    Gives ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` for each row of ``docs``. A null text is the empty one (one token,
    the end); a null ``held_out`` counts as false; repeated rows stay. With no
    training rows every token has probability 1 at the root.
    """
    marked = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    # a word and its blank take about six characters; only the number of buckets depends on it
    tokens = int(marked.select(F.coalesce(F.sum(F.length("text")), F.lit(0)) / F.lit(6)).first()[0])
    shift = np.uint64(64 - max(6, (tokens // _BUCKET).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks(batches):
            keys, of, _ = word_keys([r[1] for r in rows])
            ones, others, ends, places = ngrams(keys, of, order)
            learnt = ~np.array([r[2] for r in rows])[of]
            counts = sum(np.bincount(p[learnt[at]], minlength=len(ones) + len(others)) for at, p in zip(ends, places)).astype(np.int64)
            out = []
            for word, own, sums in ((True, ones, counts[: len(ones)]), (False, others, counts[len(ones) :])):
                bucket = own >> shift
                starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(own)]).tolist()
                for i, j in pairwise([*starts, len(own)]):
                    out.append((int(bucket[i]), block, word, j - i, _pack(np.diff(own[i:j], prepend=np.uint64(0))), _pack(sums[i:j])))
            yield _batch(_SENT, out)

    def add_up(sent: pa.Table) -> pa.Table:
        out = []
        for word in (True, False):
            rows = [r for r in zip(*(c.to_pylist() for c in sent.columns)) if r[2] == word]
            if not rows:
                continue
            keys = np.concatenate([np.cumsum(_unpack(r[4], r[3], np.uint64), dtype=np.uint64) for r in rows])
            counts = np.concatenate([_unpack(r[5], r[3], np.int64) for r in rows])
            by = np.argsort(keys, kind="stable")
            keys = keys[by]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sums = np.add.reduceat(counts[by], starts)
            counts[by] = np.repeat(sums, np.diff(np.append(starts, len(keys))))
            cuts = np.cumsum([0, *[r[3] for r in rows]]).tolist()
            out += [(*r[:4], _pack(counts[i:j]), None, None) for r, (i, j) in zip(rows, pairwise(cuts))]
            if word:
                out.append((rows[0][0], None, True, None, None, int(np.count_nonzero(sums)), int(sums.sum())))
        return pa.Table.from_batches([_batch(_FOUND, out)])

    counted = saved(marked.mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(add_up, _FOUND), "ngram_counts")
    row = counted.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("known"), F.lit(0)).alias("known")).first()
    total = int(row.total)
    ground = total + 0.5 * (int(row.known) + 1)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks(batches):
            yield _batch(_HELD, [(block, written(rows))])

    def score(held: pa.Table, found: pa.Table) -> pa.Table:
        if len(held) != 1 or not len(found):
            raise RuntimeError("texts and counts have different blocks: the rows of docs came in another order")
        table = pa.ipc.open_stream(held["texts"][0].as_buffer()).read_all()
        keys, of, sizes = word_keys(table["text"].to_pylist())
        ones, others, ends, places = ngrams(keys, of, order)
        rows = sorted(zip(*(found[c].to_pylist() for c in ("word", "bucket", "size", "counts"))), key=lambda r: (not r[0], r[1]))
        counts = np.concatenate([_unpack(c, n, np.int64) for _, _, n, c in rows])
        own, size = counts[places[0]], len(sizes)
        walk = walker(*automaton(counts, ends, places, ground, strength))
        stops = np.cumsum(sizes).tolist()
        out = [
            table["doc_id"],
            table["held_out"],
            pa.array(sizes, pa.int64()),
            pa.array(np.bincount(of, own > 0, size).astype(np.int64)),
            pa.array(np.full(size, total)),
            pa.array(np.bincount(of, np.log10((own + 0.5) / ground), size)),
            pa.array([walk(i, j) for i, j in pairwise([0, *stops])], pa.float64()),
        ]
        return pa.table(out, names=[c.split()[0] for c in _SCORED.split(", ")])

    texts = marked.mapInArrow(keep, _HELD).groupBy("block")
    return texts.cogroup(counted.filter("block is not null").groupBy("block")).applyInArrow(score, _SCORED)
