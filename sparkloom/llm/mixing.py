"""Mixing overlapping sources to target weights with a min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern, so the flow problem has
at most 2 ** sources patterns whatever the input, and is solved exactly on the driver. Words flow from a pattern to
the sources it belongs to, up to each source's quota (weight x budget); using a pattern for the e-th time costs
e - 1 per word, so repetition is spread before anything is repeated more, and at most max_epochs copies are made.
Among the largest flows, the cheapest is taken. A pattern's flow makes whole copies of all its documents, and for the rest
documents are taken in a seeded order while their words fit.

The order's cut is found in two steps: words are summed by pattern and the upper bits of the seeded hash, then only
documents of the one bucket in which the cut falls are sorted.

Defined results: null or empty text has 0 words and is selected with its pattern's whole copies only; a null source or lang meets
no predicate on it; null doc_id hashes like any value; rows of one doc_id come in order of their words, and those that tie in this too are taken together or not at all; documents in no
source are left out; an empty table gives an empty one; extra columns pass through mixed(), whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shielded, word_count, written

EPOCHS = 4
#: Sources as predicates over documents (with their n_words), and their target weights.
SOURCES = {
    "web": "source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9')",
    "books": "source IN ('src10', 'src11', 'src12', 'src13', 'src14')",
    "reference": "source IN ('src15', 'src16', 'src17', 'src18', 'src19')",
    "multilingual": "lang <> 'en'",
    "long_form": "__words >= 1000",
}
WEIGHTS = {"web": 0.45, "books": 0.17, "reference": 0.17, "multilingual": 0.13, "long_form": 0.08}
BUCKET_BITS = 12


def min_cost_flow(supply: dict[int, int], quota: list[int], epochs: int) -> dict[int, int]:
    """Flow of each pattern (bit i: belongs to source i): a largest flow of least convex cost.

    By rising cost: when all flow of cost e - 1 and less is there, patterns get another epoch of capacity and the flow is
    augmented until it is maximal. What a pattern sends never falls, so each level adds as much as any flow could at its cost. Paths
    run over the sources: flow of some pattern moves from a source to another that it belongs to. All patterns that
    move along one step are taken together, so a path costs one pass over an array of patterns.
    """
    patterns = np.array([p for p in sorted(supply) if supply[p] > 0 and p], np.int64)
    have, sources = np.array([supply[p] for p in patterns.tolist()], np.int64), len(quota)
    member = (patterns[:, None] >> np.arange(sources)) & 1 == 1
    flow, open_ = np.zeros(member.shape, np.int64), np.array(quota, np.int64)

    def taken(room: np.ndarray, amount: int) -> np.ndarray:
        """amount, from the first that have room."""
        before = np.cumsum(room) - room
        return np.clip(amount - before, 0, room)

    for epoch in range(epochs):
        room = have * (epoch + 1) - flow.sum(1)
        while True:
            # Breadth first from the sources of patterns with room to a source whose quota isn't met.
            by, line, end = {int(s): -1 for s in np.flatnonzero(member[room > 0].any(0))}, [], -1
            line = sorted(by)
            for s in line:
                if open_[s] > 0:
                    end = s
                    break
                for t in np.flatnonzero(member[flow[:, s] > 0].any(0)).tolist():
                    if t not in by:
                        by[t] = s
                        line.append(t)
            if end < 0:
                break
            path = [end]
            while by[path[-1]] >= 0:
                path.append(by[path[-1]])
            path.reverse()
            steps = list(zip(path, path[1:]))
            amount = min([int(open_[end]), int(room[member[:, path[0]]].sum()), *[int(flow[member[:, t], s].sum()) for s, t in steps]])
            for s, t in reversed(steps):
                moved = taken(np.where(member[:, t], flow[:, s], 0), amount)
                flow[:, s] -= moved
                flow[:, t] += moved
            new = taken(np.where(member[:, path[0]], room, 0), amount)
            flow[:, path[0]] += new
            room = room - new
            open_[end] -= amount
    return dict(zip(patterns.tolist(), flow.sum(1).tolist()))


def selected(docs: DataFrame, sources: dict[str, str] | None = None, weights: dict[str, float] | None = None, budget_share: float = 1.0, max_epochs: int = EPOCHS, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """All columns (or those of keep) of the selected documents with __words, __pattern and __copies (1 at least). The budget is budget_share of all words.

    The text is read once: its words are counted and the columns are written with the count, all else reads what was written.
    """
    spark = docs.sparkSession
    sources, weights = sources or SOURCES, weights or WEIGHTS
    if len(sources) > 16 or set(sources) != set(weights):
        raise ValueError("weights has to name the sources, 16 at most")
    member = [F.when(F.expr(p), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(sources.values())]
    pattern: Column = sum(member[1:], member[0])
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    counted = docs.withColumn("__words", word_count(F.col("text")))
    df = counted.select("*", pattern.cast("int").alias("__pattern"), order.alias("__order"), F.shiftright(order, 64 - BUCKET_BITS).cast("int").alias("__bucket"))
    if keep is not None:
        df = df.select("doc_id", *[F.col(f"`{c}`") for c in keep if c != "doc_id"], "__words", "__pattern", "__order", "__bucket")
    df = written(df, "counted")
    sums = written(df.groupBy("__pattern", "__bucket").agg(F.sum("__words").alias("words")), "mix")  # at most patterns x buckets rows
    supply = {r["__pattern"]: r["words"] for r in sums.groupBy("__pattern").agg(F.sum("words").alias("words")).collect()}
    total = sum(supply.values())
    share = sum(weights.values())
    flow = min_cost_flow(supply, [int(total * budget_share * weights[s] / share) for s in sources], max_epochs)
    # A row for each pattern, 2 ** 16 at most: whole copies, words of the rest, and the bucket in which the rest ends.
    plan = spark.createDataFrame([(p, f // supply[p], f % supply[p]) for p, f in flow.items()], "__pattern int, __base long, __rest long")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("__pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    running = sums.withColumn("before", before).join(F.broadcast(plan), "__pattern").where("before <= __rest AND before + words > __rest")
    cut = {r["__pattern"]: (r["b"], r["left"]) for r in running.groupBy("__pattern").agg(F.min("__bucket").alias("b"), F.min_by(F.col("__rest") - F.col("before"), "__bucket").alias("left")).collect()}
    plan = spark.createDataFrame([(p, f // supply[p], int(f % supply[p] > 0), *cut.get(p, (1 << BUCKET_BITS, 0))) for p, f in flow.items()], "__pattern int, __base long, __some long, __cut int, __left long")
    known = df.join(F.broadcast(plan), "__pattern")
    clear = known.where("__bucket <> __cut").withColumn("__copies", F.expr("__base + CASE WHEN __bucket < __cut THEN __some ELSE 0 END"))
    line = Window.partitionBy("__pattern").orderBy("__order", "doc_id", "__words").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = known.where("__bucket = __cut").withColumn("__copies", F.col("__base") + F.when(F.sum("__words").over(line) <= F.col("__left"), F.col("__some")).otherwise(F.lit(0)))
    out = clear.unionByName(edge).where("__copies > 0")
    names = docs.columns if keep is None else keep
    return out.select(*[F.col(f"`{c}`") for c in names], "__words", "__pattern", F.col("__copies").cast("int").alias("__copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The selected documents, each as often as it is used, with the columns of docs."""
    return shielded(docs, lambda d: selected(d, **options).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*[F.col(f"`{c}`") for c in d.columns]))
