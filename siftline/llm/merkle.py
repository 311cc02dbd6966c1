"""Merkle manifest of a dataset: leaves, one subtree per group, one root, and a proof per row.

Time-forward processing: nodes are labelled by level and place, children before
parents. A node takes the digests that its children sent and sends its own to
its parent; a priority queue ordered by label holds what is on its way. The
reversed sweep goes from the root down and sends every node the part of the
proof that lies above it.

The queue is external. ``fan ** height`` consecutive nodes and what is built on
them form a block, the unit of work of a task; messages between nodes of a block
stay in a heap there, messages to other blocks are rows of a table, which Spark
deals to the blocks and sorts by label. Each round goes up by ``height`` levels, so
10^9 rows take four rounds of blocks of 256, and no task holds more than a block.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import saved, within

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
HEIGHT = 2
PROOF = "array<struct<before:string,after:string>>"
_OFFSET_ROWS = 100_000
_OUT_ROWS = 512


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value as text, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of a proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, run: F.sha2(F.concat(run["before"], acc, run["after"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda run: F.concat(run["before"], run["after"])), "")


def _digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(n: int, fan: int, most: int) -> int:
    """Levels above ``n`` nodes, counted up to ``most``."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // fan), levels + 1
    return levels


def sweep_up(digests: Sequence[str], levels: int, fan: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """Top of a block and, by the label of each inner node, its children's digests."""
    if not levels:
        return digests[0], {}
    queue = [(1, i // fan, i, d) for i, d in enumerate(digests)]  # in order of labels: a heap
    children: dict[tuple[int, int], list[str]] = {}
    while True:
        level, place = queue[0][:2]
        got = []
        while queue and queue[0][:2] == (level, place):
            got.append(heapq.heappop(queue)[3])
        children[level, place] = got
        digest = _digest(got)
        if level == levels:
            return digest, children
        heapq.heappush(queue, (level + 1, place // fan, place, digest))


def sweep_down(children: Mapping[tuple[int, int], list[str]], n: int, levels: int, fan: int, above: tuple | None) -> list[tuple | None]:
    """For each of ``n`` nodes of a block its proof as a chain ``(before, after, rest)``."""
    out: list[tuple | None] = [None] * n
    queue: list[tuple] = [(-levels, 0, 0, above)]
    while queue:
        label, place, _, rest = heapq.heappop(queue)
        if not label:
            out[place] = rest
            continue
        got = children[-label, place]
        for i in range(len(got)):
            heapq.heappush(queue, (label + 1, place * fan + i, 0, ("".join(got[:i]), "".join(got[i + 1 :]), rest)))
    return out


def _chain(runs: Sequence[Mapping[str, str]]) -> tuple | None:
    rest = None
    for run in reversed(runs):
        rest = (run["before"], run["after"], rest)
    return rest


def _proofs(chains: Sequence[tuple | None]) -> pa.Array:
    offsets, before, after = [0], [], []
    for chain in chains:
        while chain is not None:
            before.append(chain[0])
            after.append(chain[1])
            chain = chain[2]
        offsets.append(len(before))
    runs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows of one (group, block) after the other; rows of a block follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("group").to_pylist(), batch.column("block").to_pylist()))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield held
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield held


@dataclass
class Round:
    """Nodes of one level: ``group, n, block, lo, copies, digest`` and, in the first one, what rows carry.

    ``n`` counts the group's nodes on this level; a row stands for ``copies``
    equal nodes from place ``lo`` of its block on.
    """

    nodes: DataFrame
    carried: tuple[str, ...]


def _in_order(df: DataFrame) -> DataFrame:
    """Blocks dealt to tasks, each block's rows sorted by label; a block is at most fan ** height rows."""
    return df.repartition("group", "block").sortWithinPartitions("group", "block", "lo")


def _read(parts: list[pa.RecordBatch]) -> tuple[pa.Table, list[str]]:
    rows = pa.Table.from_batches(parts)
    digests: list[str] = []
    for copies, digest in zip(rows.column("copies").to_pylist(), rows.column("digest").to_pylist()):
        digests.extend([digest] * copies)
    return rows, digests


def climb(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """``(group, n, block, digest)``: the top of each block; ``n`` are the group's nodes below."""
    kind = T.StructType([nodes.schema["group"], *[T.StructField(c, T.LongType()) for c in ("n", "block")], T.StructField("digest", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _blocks(batches):
            rows, digests = _read(parts)
            n = rows.column("n")[0].as_py()
            top, _ = sweep_up(digests, levels_of(n, fan, height), fan)
            yield pa.RecordBatch.from_arrays([*[pa.array([rows.column(c)[0].as_py()], rows.column(c).type) for c in ("group", "n", "block")], pa.array([top])], ["group", "n", "block", "digest"])

    return _in_order(nodes.select("group", "n", "block", "lo", "copies", "digest")).mapInArrow(run, kind)


def descend(level: Round, above: DataFrame, fan: int, height: int) -> DataFrame:
    """Proofs of a round's nodes, given those of its blocks: ``group, block, subroot, root, proof``.

    Gives a row for each node: group, place in the group, digest, subroot, root,
    proof and the carried columns.
    """
    carried = level.carried
    nodes = level.nodes
    shape = {f.name: f.dataType for f in nodes.schema.fields}
    out = T.StructType(
        [
            T.StructField("group", shape["group"]),
            T.StructField("place", T.LongType()),
            *[T.StructField(c, T.StringType()) for c in ("digest", "subroot", "root")],
            T.StructField("proof", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("before", "after")]))),
            *[T.StructField(c, shape[c]) for c in carried],
        ]
    )
    size = fan**height
    # a block's message from above comes first in it
    sent = above.select("group", "block", F.lit(-1).cast("bigint").alias("lo"), "subroot", "root", "proof")
    both = nodes.unionByName(sent, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _blocks(batches):
            table = pa.Table.from_batches(parts)
            head, body = table.slice(0, 1).to_pylist()[0], table.slice(1)
            rows, digests = _read(body.to_batches())
            levels = levels_of(rows.column("n")[0].as_py(), fan, height)
            _, children = sweep_up(digests, levels, fan)
            chains = sweep_down(children, len(digests), levels, fan, _chain(head["proof"]))
            at = np.repeat(np.arange(rows.num_rows), rows.column("copies").to_numpy())
            first = head["block"] * size
            for a in range(0, len(digests), _OUT_ROWS):
                b = min(len(digests), a + _OUT_ROWS)
                some = rows.take(pa.array(at[a:b])).combine_chunks()
                columns = [
                    some.column("group"),
                    pa.array(np.arange(first + a, first + b)),
                    some.column("digest"),
                    *[pa.array([head[c]] * (b - a), pa.string()) for c in ("subroot", "root")],
                    _proofs(chains[a:b]),
                    *[some.column(c) for c in carried],
                ]
                arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, out.names)

    return _in_order(both).mapInArrow(run, out)


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``n`` and ``place``: the group's nodes, and those before a row in its group in ``order``.

    ``rows`` are sorted by range over all tasks and numbered within their own
    task and group; the groups' counts by task, a row for each of the two, give
    the rest.
    """
    kept = rows.columns
    out = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("ahead", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("group").to_pylist()
            ahead = []
            for group, copies in zip(groups, batch.column("copies").to_pylist()):
                if last is None or last[0] != group:
                    last, total = (group,), 0
                ahead.append(total)
                total += copies
            arrays = [*batch.columns, pa.array([part] * len(groups), pa.int32()), pa.array(ahead, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, out.names)

    # written, as the tasks' numbers are used
    placed = saved(rows.orderBy(F.asc_nulls_first("group"), *[F.asc_nulls_first(c) for c in order]).mapInArrow(run, out), "merkle-places")
    parts = Window.partitionBy("group").orderBy("part")
    whole = Window.partitionBy("group")
    counts = placed.groupBy("group", "part").agg(F.sum("copies").alias("c"))
    counts = saved(
        counts.select(
            F.col("group").alias("g"),
            F.col("part").alias("p"),
            (F.sum("c").over(parts) - F.col("c")).alias("before"),
            F.sum("c").over(whole).alias("n"),
        ),
        "merkle-counts",
    )
    small = F.broadcast(counts) if within(counts, _OFFSET_ROWS) else counts
    same = F.col("group").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p"))
    return placed.join(small, same).select(*kept, "n", (F.col("before") + F.col("ahead")).alias("place"))


def _first_round(numbered: DataFrame, carried: Sequence[str], size: int) -> Round:
    """Places cut into blocks; equal rows that reach over several blocks become a row for each."""
    end = F.col("place") + F.col("copies")
    block = F.explode(F.sequence(F.floor(F.col("place") / size), F.floor((end - 1) / size)))
    cut = numbered.select("*", block.alias("block"))
    lo, hi = F.greatest(F.col("place"), F.col("block") * size), F.least(end, (F.col("block") + 1) * size)
    nodes = cut.select("group", "n", "block", (lo - F.col("block") * size).alias("lo"), (hi - lo).alias("copies"), "digest", *carried)
    return Round(nodes, tuple(carried))


def _trees(first: Round, fan: int, height: int) -> tuple[list[Round], DataFrame]:
    """All rounds up to the groups' tops, and those with the round that reached them: ``(group, digest, round)``."""
    size = fan**height
    rounds, tops = [first], None
    while True:
        done = saved(climb(rounds[-1].nodes, fan, height), "merkle-tops")
        ends = done.filter(F.col("n") <= size).select("group", "digest", F.lit(len(rounds) - 1).alias("round"))
        tops = ends if tops is None else tops.unionByName(ends)
        rest = done.filter(F.col("n") > size)
        if rest.isEmpty():
            return rounds, tops
        up = F.ceil(F.col("n") / size).cast("bigint")
        inner = F.floor(F.col("block") / size)
        nodes = rest.select("group", up.alias("n"), inner.alias("block"), (F.col("block") - inner * size).alias("lo"), F.lit(1).cast("bigint").alias("copies"), "digest")
        rounds.append(Round(nodes, ()))


def _deliver(rounds: Sequence[Round], tops: DataFrame, fan: int, height: int) -> DataFrame:
    """Proofs of the lowest nodes; ``tops`` has ``group, round, subroot, root, proof`` of each group."""
    columns = ("group", "subroot", "root", "proof")
    below = None
    for i in range(len(rounds) - 1, -1, -1):
        sent = tops.filter(F.col("round") == i).select(*columns, F.lit(0).cast("bigint").alias("block"))
        if below is not None:
            sent = sent.unionByName(below.select(*columns, F.col("place").alias("block")))
        if i == 0:
            return descend(rounds[0], sent, fan, height)
        below = saved(descend(rounds[i], sent, fan, height), "merkle-proofs")
    raise AssertionError("no round")


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    key: str = "doc_id",
    group: str = "source",
    carry: Callable[[], Mapping[str, Column]] | None = None,
    fan: int = FAN,
    height: int = HEIGHT,
) -> DataFrame:
    """A row for each row of ``docs``: ``key, group, leaf, subroot, root, proof`` and the carried columns.

    A leaf is the digest of the row's ``fields``. Leaves of a group ascend by key;
    while several nodes remain, ``fan`` consecutive ones become their digest. The
    groups' tops, ordered by group, become the root in the same way. ``proof``
    lists for each level what stands before and after the row's node in its run.

    Nulls are fields of their own and a null group is one; null keys and the null
    group come first. Rows with one key are ordered by their leaf, so equal rows
    may change places without any effect; they are counted before the sort and
    take a row for each block, however many there are. An empty table has no row
    and no root. Columns that are not named take no part.
    """
    extra = carry() if carry else {}
    rows = docs.select(
        F.col(group).alias("group"),
        F.col(key).alias("key"),
        leaf_digest(*[F.col(c) for c in fields]).alias("digest"),
        *[c.alias(f"c_{name}") for name, c in extra.items()],
    )
    carried = [f"c_{name}" for name in extra]
    counted = rows.groupBy("group", "key", "digest", *carried).agg(F.count("*").alias("copies"))
    size = fan**height
    first = _first_round(_numbered(counted, ["key", "digest", *carried]), ["key", *carried], size)
    first = Round(saved(first.nodes, "merkle-leaves"), first.carried)
    rounds, tops = _trees(first, fan, height)
    tops = saved(tops, "merkle-subroots")

    # the same over the groups' tops, which form one group, in the groups' order
    over = tops.select(F.lit(0).alias("group"), F.col("group").alias("name"), F.col("round").alias("own"), "digest", F.lit(1).cast("bigint").alias("copies"))
    upper = _first_round(_numbered(over, ["name"]), ["name", "own"], size)
    upper = Round(saved(upper.nodes, "merkle-groups"), upper.carried)
    upper_rounds, root = _trees(upper, fan, height)
    head = root.select("group", "round", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast(PROOF).alias("proof"))
    heads = saved(_deliver(upper_rounds, head, fan, height), "merkle-heads")
    found = _deliver(rounds, heads.select(F.col("name").alias("group"), F.col("own").alias("round"), F.col("digest").alias("subroot"), "root", "proof"), fan, height)
    return found.select(
        F.col("key").alias(key),
        F.col("group").alias(group),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "proof",
        *[F.col(f"c_{name}").alias(name) for name in extra],
    )


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, checked against a copy in which a fifth of the texts is lower-cased.

    Rows whose key's crc32 (of its decimal text) is divisible by 5 are tampered
    with: A-Z of the text become a-z. A null key is never tampered with.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    changed = [F.translate("text", upper, lower) if c == "text" else F.col(c) for c in FIELDS]
    # null where the row is as it was, so that a digest travels only where there are two
    found = manifest(docs, carry=lambda: {"other": F.when(hit, leaf_digest(*changed))})
    folded = found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        fold(F.coalesce("other", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(start: str, name: str, depth: int) -> str:
    """Tables ``{name}{k}`` of the nodes after k levels, with what stands beside each node in its run."""
    out = []
    for k in range(depth + 1):
        nodes = start if k == 0 else f"SELECT g, p // 16 AS p, CASE WHEN min(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d FROM {name}{k - 1} GROUP BY g, p // 16"
        beside = "coalesce(string_agg(d, '') OVER (PARTITION BY g, p // 16 ORDER BY p ROWS BETWEEN {}), '')"
        out.append(
            f"{name}{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, {beside.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b,"
            f" {beside.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a FROM ({nodes}))"
        )
    return ",\n".join(out)


def audit_sql(depth: int = 6) -> str:
    """``audit`` in DuckDB's SQL, for up to 16 ** depth rows a source and as many sources."""
    value = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    digest = "sha256(" + " || ".join(value.format(c) for c in FIELDS) + ")"
    other = digest.replace("text::", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')::")
    # crc32 of the decimal text: each byte goes in, then eight shifts
    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [1000 + ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN x >= 1000 THEN xor(s, x - 1000) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda s, x: {step}), 4294967295)"
    folds = []
    for k in range(depth):
        for name, key, place in (("s", "g", "p"), ("u", "0", "q")):
            prev = f"f{name}{k - 1}" if k else ("leaves" if name == "s" else f"fs{depth - 1}")
            same = f"t.g IS NOT DISTINCT FROM f.g AND t.p = f.{place} // {16**k}" if name == "s" else f"t.p = f.{place} // {16**k}"
            folds.append((name, k, f"f{name}{k} AS (SELECT f.* REPLACE (f.seen || t.b || t.a AS seen, CASE WHEN t.n = 1 THEN f.x ELSE sha256(t.b || f.x || t.a) END AS x) FROM {prev} f JOIN {name}{k} t ON {same})"))
    folded = ",\n".join(f[2] for f in sorted(folds, key=lambda f: (f[0] == "u", f[1])))
    return f"""
WITH dig AS (SELECT doc_id, source AS g, {digest} AS d, CASE WHEN {crc} % 5 = 0 THEN {other} ELSE {digest} END AS x FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS p FROM dig),
{_levels_sql("SELECT g, p, d FROM placed", "s", depth)},
names AS (SELECT g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS q, d FROM s{depth}),
{_levels_sql("SELECT 0 AS g, q AS p, d FROM names", "u", depth)},
leaves AS (SELECT l.*, m.q, m.d AS subroot, '' AS seen FROM placed l JOIN names m ON l.g IS NOT DISTINCT FROM m.g),
{folded}
SELECT doc_id, f.d AS leaf, subroot, r.d AS root, sha256(seen) AS proof_sha256, x AS folded_root, x = r.d AS verified FROM fu{depth - 1} f, u{depth} r
"""
