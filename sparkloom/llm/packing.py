"""Hierarchical best-fit packing of documents into sequences of a fixed number of words.

A document longer than the capacity is cut into pieces of that length and a rest. Documents are dealt to partitions by a
hash of doc_id and length (only these two are shuffled), so the bins depend on the documents and on
spark.sql.shuffle.partitions, not on how files are split. Each partition packs its pieces best-fit, longest first, and emits
the bins that are at least FULL full. The others go up a tree of fan-in FAN: each node takes its children's underfull bins
as items, packs them best-fit, and emits full ones again; the root emits all. A bin that not even the emptiest of all
underfull bins fits into is emitted at once, as no later round could add to it. Each level is written, so bins that were emitted
and bins that went up always come from one packing.

Defined results: null or empty text has no words and is in no bin; null doc_id is packed and stays null; repeated rows are packed
each; ties order by doc_id and start; very long texts are cut; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, word_count, written

CAPACITY = 2048
FULL = 0.98
FAN = 8
BINS = "node int, bin_id bigint, fill int, done boolean, doc_id array<bigint>, start array<int>, length array<int>"
FIELDS = [("node", pa.int32()), ("bin_id", pa.int64()), ("fill", pa.int32()), ("done", pa.bool_()), ("doc_id", pa.list_(pa.int64())), ("start", pa.list_(pa.int32())), ("length", pa.list_(pa.int32()))]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: each item, in the given order, goes to the fullest bin that has room, or to a new one.

    A bit mask of the free spaces that exist finds that bin in one step.
    """
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = {}
    mask = 0
    for i, size in enumerate(sizes):
        room = mask >> size
        if room:
            space = size + (room & -room).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask &= ~(1 << space)
            bins[b].append(i)
        else:
            space, b = capacity, len(bins)
            bins.append([i])
        left = space - size
        by_space.setdefault(left, []).append(b)
        if left:
            mask |= 1 << left
    return bins


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, FIELDS)], [n for n, _ in FIELDS])


def local_bins(items: list[tuple], node: int, capacity: int, full: float) -> list[tuple]:
    """Bins of pieces (doc_id, start, length)."""
    items.sort(key=lambda x: (-x[2], x[0] is None, x[0] or 0, x[1]))
    out = []
    for k, members in enumerate(best_fit([x[2] for x in items], capacity)):
        doc, start, length = zip(*[items[i] for i in members])
        out.append((node, (node << 32) + k, sum(length), sum(length) >= full * capacity, doc, start, length))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, full: float = FULL, fan: int = FAN, length: str | None = None) -> DataFrame:
    """bin_id, doc_id, start_word, n_words and bin_offset of each piece. length: a column of lengths to use in place of words."""
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.col(length).cast("long"), F.lit(0)) if length else word_count(F.col("text"))).alias("n"))
    parts = buckets(docs.sparkSession)
    first = lengths.where("n > 0").withColumn("node", F.pmod(F.xxhash64("doc_id", "n"), F.lit(parts)).cast("int"))

    def local(t: pa.Table) -> pa.Table:
        items, node = [], t.column("node")[0].as_py()
        for doc, n in zip(t.column("doc_id").to_pylist(), t.column("n").to_pylist()):
            items += [(doc, s, min(capacity, n - s)) for s in range(0, n, capacity)]
        return pa.Table.from_batches([table_of(local_bins(items, node, capacity, full))])

    def merge(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*[t.column(n).to_pylist() for n, _ in FIELDS]), key=lambda r: (-r[2], r[1]))
        out = []
        for members in best_fit([r[2] for r in rows], capacity):
            own = [rows[i] for i in members]
            fill = sum(r[2] for r in own)
            out.append((own[0][0], own[0][1], fill, fill >= full * capacity, *[sum((r[k] for r in own), []) for k in (4, 5, 6)]))
        return pa.Table.from_batches([table_of(out)])

    level, nodes, results = written(first.groupBy("node").applyInArrow(local, BINS), "bins"), parts, []
    while nodes > 1:
        least = level.where("NOT done").agg(F.min("fill")).first()[0]
        over = F.col("done") | (F.col("fill") > capacity - (least or 0))
        results.append(level.where(over))
        up = level.where(~over).withColumn("node", F.floor(F.col("node") / fan).cast("int"))
        level = written(up.groupBy("node").applyInArrow(merge, BINS), "bins")
        nodes = -(-nodes // fan)
    every = level
    for r in results:
        every = every.unionByName(r)
    piece = every.select("bin_id", F.posexplode(F.arrays_zip("doc_id", "start", "length")).alias("k", "p"), F.col("length").alias("all"))
    before = F.aggregate(F.slice("all", 1, F.col("k")), F.lit(0), lambda s, x: s + x)
    return piece.select("bin_id", F.col("p.doc_id").alias("doc_id"), F.col("p.start").cast("long").alias("start_word"), F.col("p.length").cast("long").alias("n_words"), before.cast("long").alias("bin_offset"))
