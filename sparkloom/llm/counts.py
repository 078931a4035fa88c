"""Corpus-wide n-gram counts, partitioned by hash and joined back to the documents they came from.

Documents are hashed by doc_id into chunks. A chunk sends its distinct n-gram keys with their counts, sorted
and packed, to the buckets that own their key ranges; a bucket adds up the counts of all chunks and answers
each in the order of its keys. So an n-gram crosses the network once per chunk instead of once per occurrence,
and an answer needs no key. The text is shuffled once: asking and using share one exchange.

A chunk depends on nothing but the doc_ids and texts in it, so a task that runs again gives the same packets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import U, pack_sorted, planes, unpack_sorted, unplanes

#: Bits of a key. Two n-grams of one corpus of n share a key with probability of about n / 2 ** BITS.
BITS = 52
ANSWER = "chunk int, bucket int, n array<int>, totals array<binary>, items bigint, rows bigint"


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """doc_id, text and chunk, hash-partitioned by chunk. A null doc_id falls in a chunk by its text."""
    key = F.coalesce(F.xxhash64(F.col("doc_id")), F.lit(0).cast("long")) + F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    return docs.select("doc_id", "text", F.pmod(key, F.lit(chunks)).cast("int").alias("chunk")).repartition(chunks, "chunk")


def ask(base: DataFrame, levels, chunks: int) -> DataFrame:
    """The answers for each chunk. levels(text column) gives per level the sorted distinct keys and their counts, and the number of items that they come from."""
    answer_columns = [f.split()[0] for f in ("chunk int", "bucket int", "n array<int>", "totals array<binary>", "items bigint", "rows bigint")]

    def request(t: pa.Table) -> pa.Table:
        found, items = levels(t.column("text"))
        chunk, edges = t.column("chunk")[0].as_py(), (np.arange(1, chunks, dtype=U) << U(BITS)) // U(chunks)
        cuts = [np.concatenate(([0], np.searchsorted(k, edges), [len(k)])) for k, _ in found]
        n, keys, counts = [], [], []
        for b in range(chunks):
            part = [(k[c[b] : c[b + 1]], v[c[b] : c[b + 1]]) for (k, v), c in zip(found, cuts)]
            n.append([len(k) for k, _ in part])
            keys.append([pack_sorted(k) for k, _ in part])
            counts.append([planes(v) for _, v in part])
        return pa.table({"chunk": pa.array([chunk] * chunks, pa.int32()), "bucket": pa.array(range(chunks), pa.int32()), "n": pa.array(n, pa.list_(pa.int32())), "ids": pa.array(keys, pa.list_(pa.binary())), "counts": pa.array(counts, pa.list_(pa.binary())), "items": pa.array([items] * chunks, pa.int64()), "rows": pa.array([t.num_rows] * chunks, pa.int64())})

    def total(t: pa.Table) -> pa.Table:
        n, ids, counts = t.column("n").to_pylist(), t.column("ids").to_pylist(), t.column("counts").to_pylist()
        out = [[] for _ in n]
        for level in range(len(n[0])):
            keys = np.concatenate([unpack_sorted(x[level], m[level]) for x, m in zip(ids, n)])
            own = np.concatenate([unplanes(x[level], m[level]) for x, m in zip(counts, n)])
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            sums = np.empty(len(keys), U)
            if len(keys):
                sums[order] = np.repeat(np.add.reduceat(own[order], first), np.diff(np.append(first, len(keys))))
            at = 0
            for row, m in zip(out, n):
                row.append(planes(sums[at : at + m[level]]))
                at += m[level]
        items, rows = sum(t.column("items").to_pylist()), sum(t.column("rows").to_pylist())
        data = {"chunk": t.column("chunk"), "bucket": t.column("bucket"), "n": t.column("n"), "totals": pa.array(out, pa.list_(pa.binary())), "items": pa.array([items] * t.num_rows, pa.int64()), "rows": pa.array([rows] * t.num_rows, pa.int64())}
        return pa.table({c: data[c] for c in answer_columns})

    packets = base.groupBy("chunk").applyInArrow(request, "chunk int, bucket int, n array<int>, ids array<binary>, counts array<binary>, items bigint, rows bigint")
    return packets.groupBy("bucket").applyInArrow(total, ANSWER)


def unpack_answers(t: pa.Table) -> tuple[list[np.ndarray], int, int]:
    """Of a chunk's answers: per level the totals in the order of its sorted distinct keys; items and rows of the corpus."""
    order = np.argsort(t.column("bucket").to_numpy())
    n, totals = t.column("n").to_pylist(), t.column("totals").to_pylist()
    levels = [np.concatenate([unplanes(totals[i][level], n[i][level]) for i in order]) for level in range(len(n[0]))]
    return levels, t.column("items")[0].as_py(), t.column("rows")[0].as_py()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place among them of each key, and their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, U)
    order = np.argsort(keys)
    s = keys[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return s[first], place, np.diff(np.append(first, len(s))).astype(U)
