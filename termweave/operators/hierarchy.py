"""Walk the is-a graph of ``relationship(source, type, target, group_id, active, view)`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.runtime import materialise
from termweave.schemas import IS_A


def split_relationships(relationship: DataFrame, view: str) -> tuple[DataFrame, DataFrame]:
    """Active parents and active attributes of one view (``stated`` or ``inferred``)."""
    shown = relationship.filter(F.col("active") & (F.col("view") == view))
    return shown.filter(F.col("type") == IS_A), shown.filter(F.col("type") != IS_A)


def is_a_edges(relationship: DataFrame, view: str) -> DataFrame:
    """Distinct (child, parent) pairs of one view."""
    parents, _ = split_relationships(relationship, view)
    return parents.select(F.col("source").alias("child"), F.col("target").alias("parent")).distinct()


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))


def children_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Concepts one step below any of the ``ids`` (column concept_id)."""
    wanted = ids.select(F.col("concept_id").alias("parent")).distinct()
    return edges.join(wanted, "parent", "left_semi").select(F.col("child").alias("concept_id")).distinct()


def parents_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return children_of(_reversed(edges), ids)


def descendants_of(edges: DataFrame, ids: DataFrame, include_self: bool = False) -> DataFrame:
    """Concepts any number of steps below the ``ids``.

    Each round joins only the concepts found in the round before and drops those seen already, so
    every concept is written once and a cycle ends. With ``include_self`` false, an id shows only if
    it lies below another id (or itself, on a cycle).
    """
    frontier = materialise(children_of(edges, ids))
    found = frontier
    while not frontier.isEmpty():
        frontier = materialise(children_of(edges, frontier).join(found, "concept_id", "left_anti"))
        found = found.unionByName(frontier)
    if include_self:
        return found.unionByName(ids.select("concept_id")).distinct()
    return found


def ancestors_of(edges: DataFrame, ids: DataFrame, include_self: bool = False) -> DataFrame:
    return descendants_of(_reversed(edges), ids, include_self)


def self_of(concepts: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``ids`` that are known concepts."""
    return concepts.select("concept_id").join(ids.select("concept_id"), "concept_id", "left_semi").distinct()


def _step_through(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs that go from an ancestor over a middle node of ``first`` to a descendant of ``second``."""
    middle = second.select(F.col("ancestor").alias("middle"), "descendant")
    return (
        first.select("ancestor", F.col("descendant").alias("middle"))
        .join(middle, "middle")
        .select("ancestor", "descendant")
    )


def closure(edges: DataFrame) -> DataFrame:
    """Distinct (ancestor, descendant) pairs; a concept is not its own descendant.

    Path lengths double: with the pairs below length 2^k and those of length 2^k, one join gives the
    pairs below 2^(k+1). A graph of depth d takes about log2(d) rounds, and in a tree each pair is
    built once. A round without new pairs ends the walk, also on cycles.
    """
    leaps = materialise(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct())
    pairs, size = leaps, leaps.count()
    while size:
        leaps = materialise(_step_through(leaps, leaps).distinct())
        reached = pairs.unionByName(leaps).unionByName(_step_through(leaps, pairs))
        pairs = materialise(reached.distinct())
        grown = pairs.count()
        if grown == size:
            break
        size = grown
    return pairs.filter("ancestor <> descendant")


def fold_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contract a graph: leaves with one parent go into it, round by round, as weight.

    Returns the edges left, the nodes left with their ``weight`` (themselves and all folded into them), and the folded
    nodes with their final weight. A folded node is below exactly the ancestors of its one parent, so nothing is counted
    twice; nodes on a cycle or above a node of several parents stay. Each round writes only what is left, and there are as many rounds
    as the folded trees are high.
    """
    edges = materialise(edges.select("child", "parent").distinct())
    nodes = materialise(edges.select(F.explode(F.array("child", "parent")).alias("concept_id")).distinct().withColumn("weight", F.lit(1).cast("long")))
    edges = edges.dropna()
    # the number of a node's parents never changes, so only the edges of single parents take part in the rounds
    alone = edges.groupBy("child").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("parents")).filter("parents = 1")
    single = materialise(alone.select("child", "parent"))
    shared = materialise(edges.join(single.select("child"), "child", "left_anti"))
    blocked = materialise(shared.select(F.col("parent").alias("child")).distinct())
    folded = nodes.limit(0)
    while True:
        inner = single.select(F.col("parent").alias("child")).distinct()
        leaves = single.join(blocked, "child", "left_anti").join(inner, "child", "left_anti")
        leaves = materialise(leaves.join(nodes.withColumnRenamed("concept_id", "child"), "child"))
        if leaves.isEmpty():
            return shared.unionByName(single), nodes, folded
        folded = folded.unionByName(leaves.select(F.col("child").alias("concept_id"), "weight"))
        gained = leaves.groupBy(F.col("parent").alias("concept_id")).agg(F.sum("weight").alias("gained"))
        gone = leaves.select(F.col("child").alias("concept_id"))
        weight = (F.col("weight") + F.coalesce("gained", F.lit(0))).alias("weight")
        nodes = materialise(nodes.join(gone, "concept_id", "left_anti").join(gained, "concept_id", "left").select("concept_id", weight))
        single = materialise(single.join(leaves.select("child"), "child", "left_anti"))


def _below_shared(bottom: DataFrame, top: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weight of the childless nodes below each node of the graph above them: (concept_id, n), several rows for a node.

    ``bottom`` holds child, parent and the child's weight, ``top`` the edges above and ``pairs`` their closure. A parent with
    one parent hands its children over to that one, so the children meet the ancestors once for each grandparent and not
    for each parent. A child's own parents are counted as they are, unless they also lie above another of its parents.
    """
    up = top.groupBy("child").agg(F.min("parent").alias("above"), F.count(F.lit(1)).alias("parents")).select(
        F.col("child").alias("parent"), F.when(F.col("parents") == 1, F.col("above")).otherwise(F.col("child")).alias("hand")
    )
    handed = bottom.join(up, "parent").select("child", "weight", "hand").distinct()
    hands = up.select("hand").distinct()
    reach = materialise(
        pairs.withColumnRenamed("descendant", "hand").join(hands, "hand", "left_semi").select("hand", "ancestor")
        .unionByName(hands.select("hand", F.col("hand").alias("ancestor")))
    )
    higher = reach.select(F.col("ancestor").alias("parent")).distinct()
    plain = bottom.join(higher, "parent", "left_anti").groupBy(F.col("parent").alias("concept_id")).agg(F.sum("weight").alias("n"))
    twice = bottom.join(higher, "parent", "left_semi").select("child", "weight", F.col("parent").alias("concept_id"))
    reached = handed.join(reach, "hand").select("child", "weight", F.col("ancestor").alias("concept_id")).unionByName(twice).distinct()
    return plain.unionByName(reached.groupBy("concept_id").agg(F.sum("weight").alias("n")))


def descendant_counts(edges: DataFrame) -> DataFrame:
    """Number of distinct descendants of every concept, 0 for leaves.

    Trees below the graph's shared part are folded into weights, since a concept below several parents counts once per
    ancestor. Of what is left, only the nodes with children go into the closure; the others are joined to it.
    """
    left, nodes, folded = fold_leaves(edges)
    inner = materialise(left.select(F.col("parent").alias("child")).distinct())
    top = materialise(left.join(inner, "child", "left_semi"))
    weights = nodes.withColumnRenamed("concept_id", "child")
    bottom = materialise(left.join(inner, "child", "left_anti").join(weights, "child"))
    pairs = materialise(closure(top))
    below = pairs.join(nodes.withColumnRenamed("concept_id", "descendant"), "descendant")
    parts = below.groupBy(F.col("ancestor").alias("concept_id")).agg(F.sum("weight").alias("n"))
    sums = parts.unionByName(_below_shared(bottom, top, pairs)).groupBy("concept_id").agg(F.sum("n").alias("n"))
    own = nodes.join(sums, "concept_id", "left").select("concept_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("descendants"))
    return own.unionByName(folded.select("concept_id", (F.col("weight") - 1).alias("descendants")))
