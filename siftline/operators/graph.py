"""Dependency and lineage questions over edge tables.

Iterations run over tables written to the shared folder, so no plan grows with
the number of rounds and a lost executor repeats only its round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import materialise, new_path


def terminal_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no other node depends on."""
    return nodes.select("node").join(
        edges.select(F.col("dependency").alias("node")), "node", "left_anti"
    )


def ready_steps(nodes: DataFrame, edges: DataFrame, known: DataFrame, completed: DataFrame) -> DataFrame:
    """Nodes not started yet whose dependencies have all completed."""
    done = completed.select(F.col("node").alias("dependency")).distinct()
    blocked = edges.join(done, "dependency", "left_anti").select("node").distinct()
    return (
        nodes.select("node")
        .join(known.select("node"), "node", "left_anti")
        .join(blocked, "node", "left_anti")
    )


def all_done(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """One row: has every planned node completed?"""
    left = plan.select("node").join(completed.select("node"), "node", "left_anti")
    return left.agg((F.count("*") == 0).alias("all_done"), F.count("*").alias("open"))


def _chains(edges: DataFrame) -> DataFrame:
    """``(i, j)``: nodes with a single dependency, and it."""
    counted = edges.groupBy("node").agg(F.min("dependency").alias("j"), F.count("*").alias("n"))
    return counted.filter("n = 1 and j <> node").select(F.col("node").alias("i"), "j")


def ancestors(nodes: DataFrame, edges: DataFrame, completed: DataFrame) -> DataFrame:
    """Terminal nodes and everything they need, not looking behind completed nodes.

    Runs of nodes with a single dependency are followed by pointer doubling, so a
    run of n nodes takes log2(n) rounds; where dependencies branch, a round takes
    one step. The tables of doubled steps are made once, as far as a frontier needs
    them. Every round adds a part to one written table, so no plan grows.
    """
    spark = nodes.sparkSession
    finished = completed.select("node").distinct()
    live = materialise(
        edges.select("node", "dependency").join(finished, "node", "left_anti").distinct(), "edges"
    )
    doubled = [materialise(_chains(live), "steps")]
    kind = nodes.select("node").schema
    path = new_path(spark, "reached")

    def reached() -> DataFrame:
        return spark.read.schema(kind).parquet(path)

    def add(found: DataFrame) -> DataFrame:
        new = materialise(found.select("node").distinct().join(reached(), "node", "left_anti"), "frontier")
        new.write.mode("append").parquet(path)
        return new

    terminal_nodes(nodes, edges).distinct().write.parquet(path)
    frontier = reached()
    while not frontier.isEmpty():
        # all that single dependencies lead to, twice as far in each round
        tail, far = frontier, 0
        while not doubled[far].isEmpty():
            steps = doubled[far].select(F.col("i").alias("node"), "j")
            further = tail.join(steps, "node").select(F.col("j").alias("node"))
            if further.isEmpty():
                break
            tail = materialise(tail.unionByName(further).distinct(), "tail")
            far += 1
            if far == len(doubled):
                twice = steps.select(F.col("node").alias("i"), F.col("j").alias("k")).join(steps.select(F.col("node").alias("k"), "j"), "k")
                doubled.append(materialise(twice.filter("i <> j").select("i", "j"), "steps"))
        whole = add(tail).unionByName(frontier) if far else frontier
        frontier = add(whole.join(live, "node").select(F.col("dependency").alias("node")))
    return reached()


def unknown_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependencies that are no nodes."""
    return (
        edges.select(F.col("dependency").alias("node"))
        .distinct()
        .join(nodes.select("node"), "node", "left_anti")
    )


def _chase(chain: DataFrame, rounds: int) -> DataFrame:
    """Follow ``(i, j)``, one j for each i: ``(i, end, least, open)`` after 2 ** ``rounds`` steps at most.

    ``open`` says that the path has not left the chain; ``least`` is the least
    node passed, without ``end``.
    """
    inside = chain.select(F.col("i").alias("j"), F.lit(True).alias("open"))
    first = chain.join(inside, "j", "left").select("i", F.col("j").alias("end"), F.col("i").alias("least"), F.coalesce("open", F.lit(False)).alias("open"))
    state = materialise(first, "chase")
    for _ in range(rounds):
        moving = state.filter("open")
        if moving.isEmpty():
            break
        ahead = state.select(F.col("i").alias("end"), F.col("end").alias("_end"), F.col("least").alias("_least"), F.col("open").alias("_open"))
        moved = moving.join(ahead, "end").select("i", F.col("_end").alias("end"), F.least("least", "_least").alias("least"), F.col("_open").alias("open"))
        state = materialise(state.filter("not open").unionByName(moved), "chase")
    return state


def _peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take off what single dependencies decide: ``(a, b)`` edges left, ``(node, component)`` of closed cycles.

    A path of single dependencies that ends in a node without any is on no cycle.
    One that never ends leads into a cycle that nothing leaves, a component of its own.
    """
    chain = materialise(edges.groupBy("a").agg(F.min("b").alias("j"), F.count("*").alias("n")).filter("n = 1").select(F.col("a").alias("i"), "j"), "chain")
    rounds = chain.count().bit_length()
    state = _chase(chain, rounds)
    # 2 ** rounds steps are more than there are nodes, so open paths stand on a cycle now
    on = state.filter("open").select(F.col("end").alias("node")).distinct()
    found = materialise(state.join(on, state["i"] == on["node"], "left_semi").select(F.col("i").alias("node"), F.col("least").alias("component")), "cycles")
    going = edges.select(F.col("a").alias("end")).distinct()
    dead = state.filter("not open").join(going, "end", "left_anti").select(F.col("i").alias("node"))
    gone = materialise(dead.unionByName(state.filter("open").select(F.col("i").alias("node"))), "gone")
    left = edges.join(gone.select(F.col("node").alias("a")), "a", "left_anti")
    # edges to nodes that have none themselves lead nowhere
    return left.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), found


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, component)`` of some components, and all nodes that are settled by them.

    Each node takes the largest node that leads to it as its colour; those that
    lead back to that node within the colour are its component. Rounds grow with
    the length of the paths left.
    """
    colour = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("colour", F.col("node")), "colour")
    while True:
        came = edges.join(colour.select(F.col("node").alias("a"), F.col("colour").alias("_c")), "a").groupBy(F.col("b").alias("node")).agg(F.max("_c").alias("_c"))
        now = materialise(colour.join(came, "node", "left").select("node", F.greatest("colour", F.coalesce("_c", "colour")).alias("colour"), (F.col("_c") > F.col("colour")).alias("_new")), "colour")
        changed = not now.filter("_new").isEmpty()
        colour = now.select("node", "colour")
        if not changed:
            break
    same = edges.join(colour.select(F.col("node").alias("a"), F.col("colour").alias("_ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("colour").alias("_cb")), "b")
    back = materialise(same.filter("_ca = _cb").select("a", "b"), "colour-edges")
    reached = materialise(colour.filter("node = colour"), "back")
    frontier = reached
    while not frontier.isEmpty():
        step = back.join(frontier.select(F.col("node").alias("b"), "colour"), "b").select(F.col("a").alias("node"), "colour").distinct()
        frontier = materialise(step.join(reached, "node", "left_anti"), "back")
        reached = materialise(reached.unionByName(frontier), "back")
    least = reached.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n")).filter("n > 1")
    return reached.join(least, "colour").select("node", "component"), reached.select("node")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node on a cycle: the nodes that lead to each other, by their least one.

    Nodes between cycles are on none. Paths and cycles without branches are
    settled by pointer doubling from both sides, so a path of n nodes takes log2(n)
    rounds; what remains is coloured. Edges to unknown nodes are ignored, a node
    that depends on itself is on a cycle. Every round is written.
    """
    known = nodes.select(F.col("node").alias("dependency")).distinct()
    usable = materialise(
        edges.join(known, "dependency", "left_semi").join(nodes.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("a"), F.col("dependency").alias("b")).distinct(),
        "edges",
    )
    live = usable.filter("a <> b")
    found = []
    while True:
        size = live.count()
        while size:
            before = size
            for turn in (lambda e: e, _turned):
                left, cycles = _peel(turn(live))
                found.append(cycles)
                live = materialise(turn(left).select("a", "b"), "edges")
            size = live.count()
            if size == before:
                break
        if not size:
            break
        some, done = _coloured(live)
        found.append(some)
        gone = materialise(done, "gone")
        live = live.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti")
        live = materialise(live.select("a", "b"), "edges")
    own = usable.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    # a loop counts only where its node is in no larger component
    return reduce(DataFrame.unionByName, found, own).groupBy("node").agg(F.min("component").alias("component"))


def cyclic_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on a cycle."""
    return strong_components(nodes, edges).select("node")


def bad_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, problem) with problem ``unknown`` or ``cycle``."""
    return (
        unknown_dependencies(nodes, edges)
        .withColumn("problem", F.lit("unknown"))
        .unionByName(cyclic_nodes(nodes, edges).withColumn("problem", F.lit("cycle")))
    )


def lineage(df: DataFrame, node: str = "candidate_id", parent: str = "parent_candidate_id") -> DataFrame:
    """Root and depth of every node of a forest: (node, root, depth).

    A node without a known parent is its own root. Each round doubles the
    distance looked back, so a chain of n nodes takes log2(n) rounds. Rows that
    have found their root leave the loop. Nodes that never do are on or behind a
    cycle and have a null root.
    """
    rows = df.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    known = rows.select(F.col("node").alias("up"), F.lit(True).alias("_known"))
    start = rows.join(known, "up", "left").select(
        "node",
        F.when(F.col("_known"), F.col("up")).alias("up"),
        F.when(F.col("_known"), 1).otherwise(0).cast("bigint").alias("depth"),
    )
    state = materialise(start, "lineage")
    settled = state.filter("up is null").select("node", F.col("node").alias("root"), "depth")
    active = state.filter("up is not null")
    total, rounds = None, 0
    while not active.isEmpty():
        if total is None:
            total = state.count()
        if 1 << rounds > total:
            break
        rounds += 1
        roots = settled.select(F.col("node").alias("up"), F.col("root").alias("_root"), F.lit(None).cast(rows.schema["node"].dataType).alias("_up"), F.col("depth").alias("_d"))
        jumps = active.select(F.col("node").alias("up"), F.lit(None).cast(rows.schema["node"].dataType).alias("_root"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        moved = materialise(
            active.join(roots.unionByName(jumps), "up").select(
                "node", "_root", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth")
            ),
            "lineage",
        )
        found = moved.filter("_root is not null").select("node", F.col("_root").alias("root"), "depth")
        settled = settled.unionByName(found)
        active = moved.filter("_root is null").select("node", "up", "depth")
    lost = active.select("node", F.lit(None).cast(rows.schema["node"].dataType).alias("root"), F.lit(None).cast("bigint").alias("depth"))
    return settled.unionByName(lost)


def outputs_complete(nodes: DataFrame, outputs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(node, complete): succeeded, and every recorded output has an artifact."""
    lost = (
        outputs.join(artifacts.select("artifact_id"), "artifact_id", "left_anti")
        .select("node")
        .distinct()
        .withColumn("_lost", F.lit(True))
    )
    return nodes.join(lost, "node", "left").select(
        "node",
        (F.col("_lost").isNull() & F.coalesce(F.col("status") == "succeeded", F.lit(False))).alias("complete"),
    )
