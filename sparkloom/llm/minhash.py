"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are pairs of neighbouring words, with ASCII letters in lower case and ASCII punctuation dropped (the
word itself where a text has one only). The weight of a shingle is its count in the document times log(1 + N / df),
df counted over all documents (counts.py). K samples of each weighted set make BANDS bands of ROWS samples.

Documents that share a band's key are candidates. First each is paired with the least doc_id of its bucket;
pairs are verified by exact weighted Jaccard similarity, and verified pairs form components. Then every pair
of a bucket whose components still differ is a candidate too, if at least LEAST of its K samples agree, so large
groups of copies cost a row per copy and no pair is left out for being in a large bucket. A pair of
similarity 0.5 shares a band with a probability of 0.93 and fails LEAST with one of 4e-7.

Defined results: documents without words, with null text or null doc_id are in no group; repeated rows of one
doc_id count as one document if their texts agree, else the row with the greatest text counts; ties in a group
keep the least doc_id; very long texts count whole; an empty table gives no groups; extra columns are not read
by groups() and pass through deduplicate().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, shielded, shuffle_files_go, written
from .counts import BITS, ask, chunked, distinct, unpack_answers
from .graphs import components
from .textops import U, buffers, folded_table, mix, pack_sorted, slices, unpack_sorted, words

BANDS, ROWS = 20, 3
K = BANDS * ROWS
THRESHOLD = 0.5
LEAST = 12


def weighted_shingles(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and count of each distinct shingle of each row, sorted by row and key."""
    at, data = buffers(column)
    table, cache, out = folded_table(), {}, []
    for lo, hi in slices(at):
        row, h, _, _ = words(at, data, lo, hi, table, cache)
        if not len(row):
            continue
        two = mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]) >> U(64 - BITS)
        same = row[:-1] == row[1:]
        n = np.bincount(row, minlength=hi - lo)
        single = n[row] == 1
        rows, keys = np.concatenate((row[:-1][same], row[single])), np.concatenate((two[same], h[single] >> U(64 - BITS)))
        order = np.lexsort((keys, rows))
        rows, keys = rows[order], keys[order]
        first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1]))))
        out.append((rows[first] + lo, keys[first], np.diff(np.append(first, len(rows)))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def levels(column):
    rows, keys, _ = weighted_shingles(column)
    found, _, n = distinct(keys)
    return [(found, n)], len(rows)


def weights(column, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and TF-IDF weight of each shingle of a whole chunk."""
    rows, keys, tf = weighted_shingles(column)
    (df,), _, documents = unpack_answers(answers)
    _, place, _ = distinct(keys)
    return rows, keys, tf * np.log1p(documents / df[place].astype(np.float64)) if len(rows) else tf.astype(np.float64)


def samples(rows: np.ndarray, keys: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles, and k consistent weighted samples of each, as 32-bit hashes of (shingle, level)."""
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
    out = np.zeros((len(first), k), np.uint32)
    if not len(first):
        return rows, out
    part = 1 << 16  # entries at a time, so that the work stays in cache
    cuts = [0]
    while cuts[-1] < len(first):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + part))))
    f = np.float32
    for a, b in zip(cuts, cuts[1:]):
        b = min(b, len(first))
        lo, hi = first[a], first[b] if b < len(first) else len(rows)
        key, log_s, at = keys[lo:hi], np.log(weight[lo:hi]).astype(f), first[a:b] - lo
        for j in range(k):
            x = key * U(2 * int(mix(np.array([2 * j + 1], U))[0] >> U(1)) + 1)
            y = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
            z = (y ^ (y >> U(32))) * U(0x94D049BB133111EB)
            uniform = lambda v, s: (((v >> U(s)) & U(0xFFFFFF)).astype(f) + f(0.5)) * f(1 / (1 << 24))  # noqa: B023, E731
            r = -np.log(uniform(y, 40) * uniform(y, 13))
            c = -np.log(uniform(z, 40) * uniform(z, 13))
            beta = uniform(x, 40)
            t = np.floor(log_s / r + beta)
            log_a = np.log(c) - r * (t - beta + f(1))
            bits = log_a.view(np.int32)
            bits = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) + (1 << 31)
            chosen = (key ^ (t.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15))) * U(0xD6E8FEB86659FD93) >> U(32)
            out[a:b, j] = np.minimum.reduceat((bits.view(U) << U(32)) | chosen, at) & U(0xFFFFFFFF)
    return rows[first], out


def weighted_jaccard(a_keys, a_weights, b_keys, b_weights) -> float:
    """Of two sets of sorted distinct keys with weights."""
    _, i, j = np.intersect1d(a_keys, b_keys, assume_unique=True, return_indices=True)
    low = np.minimum(a_weights[i], b_weights[j]).sum()
    total = a_weights.sum() + b_weights.sum() - low
    return float(low / total) if total > 0 else 0.0


def verify(pairs: DataFrame, base: DataFrame, answers: DataFrame, threshold: float, chunks: int) -> DataFrame:
    """The pairs (a, b) of at least threshold similarity, with it. Only documents in pairs send their weights."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    right = answers.withColumn("id", F.lit(None).cast("long")).unionByName(wanted.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")), allowMissingColumns=True)

    def vectors(key, t: pa.Table, other: pa.Table) -> pa.Table:
        known = other.column("id").is_valid()
        ids = np.sort(other.filter(known).column("id").to_numpy())
        own = t.column("doc_id").cast(pa.int64())
        rows, keys, weight = weights(t.column("text"), other.filter(pa.compute.invert(known))) if t.num_rows else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0))
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
        end = np.append(first[1:], len(rows))
        doc = own.to_pylist()
        wanted = set(ids.tolist())
        out: dict = {}
        for s, e in zip(first.tolist(), end.tolist()):
            d = doc[rows[s]]
            if d in wanted:
                new = (e - s, pack_sorted(keys[s:e]), weight[s:e].astype(np.float32).tobytes())
                out[d] = max(out[d], new) if d in out else new
        return pa.table({"id": pa.array(list(out), pa.int64()), "n": pa.array([x[0] for x in out.values()], pa.int32()), "k": pa.array([x[1] for x in out.values()], pa.binary()), "w": pa.array([x[2] for x in out.values()], pa.binary())})

    vec = base.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(vectors, "id bigint, n int, k binary, w binary")
    vec = written(vec, "vectors")
    side = lambda s: vec.select(F.col("id").alias(s), *[F.col(c).alias(s + c) for c in ("n", "k", "w")])

    def compare(batches):
        for t in batches:
            cols = [t.column(c).to_pylist() for c in ("a", "b", "an", "ak", "aw", "bn", "bk", "bw")]
            kept = []
            for a, b, an, ak, aw, bn, bk, bw in zip(*cols):
                s = 1.0 if ak == bk and aw == bw else weighted_jaccard(unpack_sorted(ak, an), np.frombuffer(aw, np.float32).astype(np.float64), unpack_sorted(bk, bn), np.frombuffer(bw, np.float32).astype(np.float64))
                if s >= threshold:
                    kept.append((a, b, s))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.int64()), pa.array([x[2] for x in kept], pa.float64())], ["a", "b", "similarity"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "an", "ak", "aw", "bn", "bk", "bw")
    return written(both.mapInArrow(compare, "a bigint, b bigint, similarity double"), "pairs")


def edges(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (a, b, similarity), a > b, that connect all groups; and (node, root) of the documents in groups."""
    with shuffle_files_go(docs.sparkSession):
        return connected(docs, threshold)


def connected(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    chunks = buckets(docs.sparkSession, 2)
    base = chunked(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), chunks)
    answers = written(ask(base, levels, chunks), "answers")

    def sign(key, t: pa.Table, other: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "sig": pa.array([], pa.list_(pa.int32()))})
        rows, sig = samples(*weights(t.column("text"), other), K)
        flat = pa.array(sig.reshape(-1).view(np.int32))
        return pa.table({"id": t.column("doc_id").cast(pa.int64()).combine_chunks().take(pa.array(rows)), "sig": pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * K, pa.int32()), flat)})

    signed = written(base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sign, "id bigint, sig array<int>"), "signatures")
    band = F.explode(F.array(*[F.xxhash64(F.lit(i), *[F.col("sig")[i * ROWS + j] for j in range(ROWS)]) for i in range(BANDS)])).alias("band")
    member = signed.select("id", band)
    hub = member.groupBy("band").agg(F.min("id").alias("b"), F.max("id").alias("z")).where("b <> z").select("band", "b")
    stars = member.join(hub, "band").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    good = verify(written(stars, "candidates"), base, answers, threshold, chunks)
    root = components(good)
    placed = member.join(hub.select("band"), "band").join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # In a bucket of several components, the largest pairs with the others only: its own members are connected.
    sizes = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("band", "main")
    mixed = placed.join(main, "band").join(signed, "id")
    small = mixed.where("root <> main").select("band", F.col("id").alias("x"), F.col("root").alias("rx"), F.col("sig").alias("sx"))
    pairs = small.join(mixed.select("band", F.col("id").alias("y"), F.col("root").alias("ry"), F.col("sig").alias("sy"), "main"), "band").where("rx <> ry AND (ry = main OR x > y)")
    agree = F.aggregate(F.zip_with("sx", "sy", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    pairs = pairs.where(agree >= LEAST).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = verify(written(pairs, "candidates"), base, answers, threshold, chunks)
    every = good.union(more)
    return every, components(every)


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document of a group but the one that stays: doc_id, duplicate_of (the least doc_id of the group)."""
    _, root = edges(docs, threshold)
    return root.where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents without those that groups() lists."""
    gone = groups(docs, threshold).select(F.col("doc_id").alias("__gone"))
    return shielded(docs, lambda d: d.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti"))
