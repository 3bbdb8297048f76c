"""Connected components of an edge table: forests of its parts, then one pass or alternating stars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators.skew import join_groups
from docflow.plans.staging import staged

#: A task holds about two times so many edges; a reduced table of no more of them is settled in one task.
AT_ONCE = 1 << 20

#: Edges that a task gathers before it reduces them, and rows of the batches that it gives.
_BATCH = 1 << 16


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of edges: each node but the least of its component, with that least node.

    Roots are hooked on lesser ones, so there is no cycle; edges between the new roots are left
    for the next turn, until none joins two roots.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    own = np.arange(len(nodes))
    label, left, right = own.copy(), ends[: len(a)], ends[len(a) :]
    while len(left):
        low, high = np.minimum(left, right), np.maximum(left, right)
        order = np.argsort(-low, kind="stable")  # of several, the least is written last
        label[high[order]] = low[order]
        while (label[label] != label).any():
            label = label[label]
        left, right = label[low], label[high]
        apart = left != right
        left, right = left[apart], right[apart]
    moved = label != own
    return nodes[moved], nodes[label[moved]]


def _forests(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forests that join what a partition's edges join; one, if there are at most ``at_once`` edges.

    Edges are reduced as they come, so that a partition of any size is held in part only.
    """
    none = np.empty(0, dtype=np.int64)
    node, root, more, waiting = none, none, [], 0
    for batch in batches:
        more.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        waiting += batch.num_rows
        if waiting >= max(_BATCH, len(node)):
            node, root = forest(np.concatenate([node, *(a for a, _ in more)]), np.concatenate([root, *(b for _, b in more)]))
            more, waiting = [], 0
            if len(node) > at_once:
                yield node, root
                node, root = none, none
    yield forest(np.concatenate([node, *(a for a, _ in more)]), np.concatenate([root, *(b for _, b in more)]))


def _reduce(names: tuple[str, str], roots: bool, at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the forests of a partition's edges; with ``roots``, a row of each root, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, root in _forests(batches, at_once):
            if roots:
                own = np.unique(root)
                node, root = np.concatenate([node, own]), np.concatenate([root, own])
            for i in range(0, len(node), _BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(node[i : i + _BATCH]), pa.array(root[i : i + _BATCH])], names=list(names))

    return run


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself.

    A root's leaves all carry its id, so hubs are joined apart from the others, without a shuffle.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("degree"))
    linked = join_groups(both.filter("b > a"), least, "a", "degree", 2 * total)
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    moved = linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """(a long, b long) edges -> (node, root): root is the least node of the component.

    Only nodes of edges appear, roots among them. Loops and rows with a null are ignored,
    repeated edges count once, an empty table gives an empty result. Each task first reduces the
    edges that it reads to a forest, which joins the same nodes. Where ``at_once`` edges or fewer
    are left in all (16 MB by default), one task settles them. A larger table is settled in rounds of
    large and small stars: each costs a few shuffles of narrow rows and the number of rounds grows
    with the logarithm of the size; every round is staged in the shared folder, so that lineage
    stays short and a lost executor costs one round. Rounds of near-empty tasks would only fill the
    driver with their records.
    """
    known = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    current = staged(known.mapInArrow(_reduce(("a", "b"), False, at_once), "a long, b long"), "edges")
    before = _fingerprint(current)
    if before[0] <= at_once:
        return staged(current.repartition(1).mapInArrow(_reduce(("node", "root"), True, at_once), "node long, root long"), "roots")
    for _ in range(rounds):
        current = staged(_small_star(_large_star(current, before[0])), "edges")
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
