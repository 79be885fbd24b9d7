"""Walks over parent edges and chains of aliases: a bounded number of joins each, or pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.sources.staging import released, staged

from .skew import joined


def fold_roots(nodes: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """(id, root): each id after following (id, parent) edges at most `hops` times, never back to where it was.

    The edges are joined once a hop, so the plan is fixed; a cycle ends the walk before it closes.
    """
    walk = nodes.select("id", F.col("id").alias("root"), F.array("id").alias("_seen"))
    step = edges.select(F.col("id").alias("root"), F.col("parent").alias("_next"))
    for _ in range(hops):
        walk = walk.join(step, "root", "left")
        go = F.col("_next").isNotNull() & ~F.array_contains("_seen", F.col("_next"))
        walk = walk.select("id", F.when(go, F.col("_next")).otherwise(F.col("root")).alias("root"), F.when(go, F.array_append("_seen", F.col("_next"))).otherwise(F.col("_seen")).alias("_seen"))
    return walk.select("id", "root")


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(alias, target) with chains followed to their ends, by pointer jumping: a chain of n takes log2(n) rounds.

    Each round is one join over a written table, whatever the rounds before. Aliases that run in a circle,
    or into one, have no end and are left out: after a round in which as many moved as before, only they still move.
    """
    current, before = staged(aliases.select("alias", "target"), "aliases"), -1
    while True:
        up = current.select(F.col("alias").alias("target"), F.col("target").alias("_next"))
        jumped = current.join(up, "target", "left").select("alias", F.coalesce("_next", "target").alias("target"), F.col("_next").isNotNull().alias("moved"))
        following = staged(jumped, "aliases")
        moving = following.filter("moved").count()
        if moving in (0, before):
            return following.filter("not moved").select("alias", "target")
        released(current)
        current, before = following.select("alias", "target"), moving


def chain_depths(aliases: DataFrame) -> DataFrame:
    """(alias, target, hops) with each chain's end and the steps to it; target and hops are null in a circle, or on the way into one."""
    current, before = staged(aliases.select("alias", "target", F.lit(1).cast("long").alias("hops")), "depths"), -1
    while True:
        up = current.select(F.col("alias").alias("target"), F.col("target").alias("_next"), F.col("hops").alias("_more"))
        jumped = current.join(up, "target", "left").select("alias", F.coalesce("_next", "target").alias("target"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), F.col("_next").isNotNull().alias("moved"))
        following = staged(jumped, "depths")
        moving = following.filter("moved").count()
        if moving in (0, before):
            end = lambda c: F.when(~F.col("moved"), F.col(c)).alias(c)
            return following.select("alias", end("target"), end("hops"))
        released(current)
        current, before = following.drop("moved"), moving


def components(pairs: DataFrame, node: str, key: str) -> DataFrame:
    """(node, component) for nodes that share keys, at any distance: the component is its smallest node.

    Nodes and keys that are null don't tie; nodes without a key are not in the result. Each round every
    component hooks on to the smallest that one of its keys leads to, hooks are followed to their ends and
    the rest goes on with components instead of nodes, without the keys that tie nothing any more: the
    components of a tie are at least halved. Keys of many nodes are dealt to several tasks.
    """
    ties = staged(pairs.select(F.col(node).alias("label"), F.col(key).alias("key")).dropna().distinct(), "ties")
    nodes, hooks = ties.select(F.col("label").alias("alias")), None
    while True:
        groups = staged(ties.groupBy("key").agg(F.min("label").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
        rest = staged(joined(ties, groups, ["key"], "n").select("label", "key", "low"), "rest")
        hooked = staged(rest.filter("low < label").groupBy(F.col("label").alias("alias")).agg(F.min("low").alias("target")), "hooks")
        if hooked.isEmpty():
            break
        hooks = hooked if hooks is None else hooks.unionByName(hooked)
        ends = resolve_aliases(hooked)
        moved = rest.join(ends.withColumnRenamed("alias", "label"), "label", "left").select(F.coalesce("target", "label").alias("label"), "key").distinct()
        ties = staged(moved, "ties")
        released(groups, rest)
    nodes = nodes.distinct()
    if hooks is not None:
        nodes = nodes.join(resolve_aliases(hooks), "alias", "left")
        return nodes.select(F.col("alias").alias(node), F.coalesce("target", "alias").alias("component"))
    return nodes.select(F.col("alias").alias(node), F.col("alias").alias("component"))


def kin(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, kin, relation): parents, children and siblings by (id, parent) links, both ways."""
    up = links.select("id", F.col("parent").alias("kin"), F.lit("parent").alias("relation"))
    down = links.select(F.col("parent").alias("id"), F.col("id").alias("kin"), F.lit("child").alias("relation"))
    other = links.select("parent", F.col("id").alias("kin"))
    beside = links.join(other, "parent").filter("id <> kin").select("id", "kin", F.lit("sibling").alias("relation"))
    return up.unionByName(down).unionByName(beside).join(nodes.select("id"), "id", "left_semi").distinct()


# The type of a remake, and types that are another form of one game.
REMAKE, SAME_GAME = 8, (0, 9, 10, 11)


def lineage(graph: DataFrame, hops: int = 4) -> DataFrame:
    """(id, version_root, same_game_root, remake_of) for each node (id, type, version_parent, parent); a version's parent comes before the other.

    version_root: the oldest ancestor, but a remake is where its line begins. same_game_root: the oldest reached
    through forms of one game only. remake_of: for a remake, the same-game root of what it was made of. A walk
    takes `hops` steps at most, never goes back to where it was, and may end at an id that the graph doesn't have.
    """
    nodes = graph.select("id", F.coalesce("type", F.lit(-1)).alias("type"), F.coalesce(F.nullif("version_parent", F.lit(0)), F.nullif("parent", F.lit(0))).alias("up"))
    step = nodes.select(F.col("id").alias("at"), F.col("type").alias("_type"), F.col("up").alias("_up"))

    def walk(rows: DataFrame, go: Column) -> DataFrame:
        rows = rows.withColumn("seen", F.array("at"))
        for _ in range(hops):
            on = go & F.col("_up").isNotNull() & ~F.array_contains("seen", F.col("_up"))
            rows = rows.join(step, "at", "left").withColumn("_on", F.coalesce(on, F.lit(False)))
            rows = rows.select("id", F.when(F.col("_on"), F.col("_up")).otherwise(F.col("at")).alias("at"), F.when(F.col("_on"), F.array_append("seen", F.col("_up"))).otherwise(F.col("seen")).alias("seen"))
        return rows.select("id", "at")

    same = F.col("_type").isin(*SAME_GAME)
    here = nodes.select("id", F.col("id").alias("at"))
    version = walk(here, F.col("_type") != REMAKE).withColumnRenamed("at", "version_root")
    game = walk(here, same).withColumnRenamed("at", "same_game_root")
    made = walk(nodes.filter((F.col("type") == REMAKE) & F.col("up").isNotNull()).select("id", F.col("up").alias("at")), same).withColumnRenamed("at", "remake_of")
    return version.join(game, "id").join(made, "id", "left")
