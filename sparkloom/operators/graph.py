"""Graph operators over edge tables (src, dst, ...)."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only in local mode where that is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparkloom-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def undirected_pairs(edges: DataFrame, weight: Column) -> DataFrame:
    """Weighted pairs (a < b); loops are dropped, parallel edges add up."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(weight).alias("weight"))


def degrees(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("node"), "weight").union(pairs.select(F.col("b").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def layers(pairs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth): the least number of steps in either direction from each seed, up to depth. pairs: a, b; seeds: (seed, node).

    Each step joins the frontier only; what was visited is left out by an anti join.
    """
    seen = frontier = seeds.select("seed", "node", F.lit(0).alias("depth"))
    steps = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a")).distinct()
    for d in range(1, depth + 1):
        new = frontier.join(steps, frontier["node"] == steps["src"]).select("seed", F.col("dst").alias("node"), F.lit(d).alias("depth")).distinct()
        frontier = checkpointed(new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        seen = checkpointed(seen.unionByName(frontier))
    return seen


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(subject, node, depth, confidence): every node that each subject reaches along edges (src, dst, confidence).

    Breadth first: a node's depth is that of the round that reaches it, its confidence the best of the paths of that
    length, a path's being the least of its edges. Stops when a round finds nothing new. seeds: subjects.
    """
    seen = frontier = seeds.select("subject", F.col("subject").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"))
    steps = checkpointed(edges.groupBy("src", "dst").agg(F.max("confidence").alias("own")))  # read in each round
    depth = 0
    while True:
        depth += 1
        step = frontier.join(steps, frontier["node"] == steps["src"]).select("subject", F.col("dst").alias("node"), F.least("confidence", "own").alias("confidence"))
        new = step.groupBy("subject", "node").agg(F.lit(depth).alias("depth"), F.max("confidence").alias("confidence"))
        frontier = checkpointed(new.join(seen.select("subject", "node"), ["subject", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)  # its parts are written


#: Nodes that more edges than this lead to are walked through once for all (see ancestors).
HUB = 64


def walked(steps: DataFrame, seeds: DataFrame, stops: DataFrame) -> DataFrame:
    """(seed, node): seeds and what they reach along steps (src, dst), not beyond stops (node)."""
    own = checkpointed(steps.join(stops.select(F.col("node").alias("src")), "src", "left_anti"))
    seen = frontier = checkpointed(seeds.select("seed", "node").distinct())
    while True:
        new = frontier.join(own, frontier["node"] == own["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(new.join(seen, ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = checkpointed(seen.union(frontier))


def ancestors(edges: DataFrame, subjects: DataFrame, unreal: Column, hub: int = HUB) -> DataFrame:
    """(subject, n): from how many other nodes each subject is reached along edges (src, dst); nodes of which unreal holds don't count.

    A walk back ends at hubs, nodes that more than hub edges lead to. What lies before a hub is walked once, not for each
    subject; subjects that reach the same hubs share the number of nodes before these, and add what only they reach.
    """
    back = checkpointed(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())
    hubs = checkpointed(back.groupBy(F.col("src").alias("node")).count().where(F.col("count") > hub).select("node"))
    before = walked(back, back.join(hubs.select(F.col("node").alias("src")), "src").select(F.col("src").alias("seed"), F.col("dst").alias("node")), hubs)
    beyond = walked(before.join(hubs, "node").select(F.col("seed").alias("src"), F.col("node").alias("dst")).distinct(), hubs.select(F.col("node").alias("seed"), "node"), hubs.limit(0))
    near = walked(back, subjects.select(F.col("subject").alias("seed"), F.col("subject").alias("node")), hubs)
    reached = near.join(beyond.select(F.col("seed").alias("node"), F.col("node").alias("hub")), "node").select("seed", "hub").distinct()
    group = lambda df, k, v, name: df.groupBy(k).agg(F.array_sort(F.collect_set(v)).alias(name))
    signs = checkpointed(group(reached, "seed", "hub", "sign"))
    marks = checkpointed(group(before.where(~unreal), "node", "seed", "mark"))
    many = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    ends = signs.select("sign").distinct().select("sign", F.explode("sign").alias("hub"))
    shared = ends.join(many.select("mark", "n", F.explode("mark").alias("hub")), "hub").select("sign", "mark", "n").distinct().groupBy("sign").agg(F.sum("n").alias("shared"))
    alone = near.where(~unreal).join(signs, "seed", "left").join(marks, "node", "left").where("NOT coalesce(arrays_overlap(sign, mark), false)").groupBy("seed").agg(F.count(F.lit(1)).alias("alone"))
    return near.select("seed").distinct().join(signs, "seed", "left").join(shared, "sign", "left").join(alone, "seed", "left").select(F.col("seed").alias("subject"), (F.coalesce("shared", F.lit(0)) + F.coalesce("alone", F.lit(0)) - 1).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable without regard to direction, by contraction.

    In a round each node points to the least of its neighbours and itself, pointers are followed to their ends, and the edges
    become those between different ends: far fewer in each round, until none is left.
    """
    edges = checkpointed(edges.select("src", "dst"))
    labels = None
    while True:
        ends = edges.groupBy("src").agg(F.min("dst").alias("low")).union(edges.groupBy("dst").agg(F.min("src").alias("low"))).toDF("node", "low")
        up = checkpointed(ends.groupBy("node").agg(F.least("node", F.min("low")).alias("up")))
        while True:
            jump = up.select(F.col("node").alias("up"), F.col("up").alias("further"))
            new = checkpointed(up.join(jump, "up").select("node", F.col("further").alias("up"), F.col("up").alias("before")))
            up = new.select("node", "up")
            if new.where("up <> before").isEmpty():
                break
        labels = up.toDF("node", "component") if labels is None else checkpointed(labels.join(up.toDF("component", "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        a, b = up.toDF("src", "a"), up.toDF("dst", "b")
        edges = checkpointed(edges.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        if edges.isEmpty():
            return labels


def modularity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of a partition (node, community) of weighted pairs (a, b, weight)."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    inside = pairs.join(la, "a").join(lb, "b").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("w"))
    k = degrees(pairs).join(labels, "node").groupBy("community").agg(F.sum("strength").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    return inside.crossJoin(k).select((F.col("w") / F.col("m") - F.col("k2") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def moved(pairs: DataFrame, k: DataFrame, m2: float) -> DataFrame:
    """(node, community) after moves between neighbouring communities, until a round no longer gains modularity.

    In a round the nodes of one half (by a hash of node and round) move at once, each to the neighbouring community of the largest
    gain k_in - k_node * k_community / 2m; ties go to the least community. pairs may hold loops, which stay within.
    """
    both = checkpointed(pairs.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").union(pairs.where("a <> b").select("b", "a", "weight")))
    labels = k.select("node", F.col("node").alias("community"), "k")
    best_value, still, r = modularity(pairs, labels).first()[0] or 0.0, 0, 0
    while still < 2:
        total = labels.groupBy("community").agg(F.sum("k").alias("total"))
        other = labels.select(F.col("node").alias("other"), "community")
        links = both.join(other, "other").groupBy("node", "community").agg(F.sum("weight").alias("own_in"))
        links = links.unionByName(labels.select("node", "community", F.lit(0).cast("long").alias("own_in"))).groupBy("node", "community").agg(F.sum("own_in").alias("own_in"))
        options = links.join(labels.select("node", "k", F.col("community").alias("now")), "node").join(total, "community")
        gain = F.col("own_in") - F.col("k") * (F.col("total") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0)) / m2
        best = options.withColumn("loss", -F.round(gain, 9)).groupBy("node", "k", "now").agg(F.min_by("community", F.struct("loss", "community")).alias("best"))
        mine = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
        new = checkpointed(best.select("node", F.when(mine, F.col("best")).otherwise(F.col("now")).alias("community"), "k"))
        value = modularity(pairs, new).first()[0] or 0.0
        if value > best_value + 1e-9:
            labels, best_value, still = new, value, 0
        else:
            still += 1
        r += 1
    return labels.select("node", "community")


def communities(pairs: DataFrame) -> DataFrame:
    """(node, community) of weighted pairs (a, b, weight), level by level.

    Nodes move between communities as long as that gains modularity (see moved), then each community becomes one node, its
    inner weight a loop, and moves again; it ends when a level moves nothing. A community is named by its least member.
    """
    pairs = checkpointed(pairs.select("a", "b", F.col("weight").cast("long").alias("weight")))
    k = degrees(pairs).select("node", F.col("strength").alias("k"))
    m2 = float(k.agg(F.sum("k")).first()[0] or 1)
    member = checkpointed(k.select("node", F.col("node").alias("community")))
    while True:
        step = checkpointed(moved(pairs, k, m2))
        if step.where("node <> community").isEmpty():
            break
        member = checkpointed(member.join(step.select(F.col("node").alias("community"), F.col("community").alias("next")), "community").select("node", F.col("next").alias("community")))
        a, b = step.select(F.col("node").alias("a"), F.col("community").alias("ca")), step.select(F.col("node").alias("b"), F.col("community").alias("cb"))
        pairs = checkpointed(pairs.join(a, "a").join(b, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")))
        k = checkpointed(k.join(step, "node").groupBy(F.col("community").alias("node")).agg(F.sum("k").alias("k")))
    least = member.groupBy("community").agg(F.min("node").alias("name"))
    return member.join(least, "community").select("node", F.col("name").alias("community"))
