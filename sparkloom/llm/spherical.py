"""Near-duplicate embeddings by spherical-cap filters of structured random product codes.

Vectors are normalised, rotated at random and cut into two blocks. Each block has a random code of unit vectors; a filter
is one code word of each block, so side ** 2 filters are described by 2 * side short vectors. A vector is
list-decoded to every filter whose direction its inner product exceeds: code words of a block that can't reach the bound
with the best of the other are left out before they are combined. Vectors that share a filter are joined and verified.

Filters of one code resemble each other, so a vector that misses one misses its neighbours as well; ROTATIONS codes, each with
a rotation of its own, need a third of the filters for the same recall. The size of the code follows from the number of
vectors, so that a filter holds about FILL unrelated ones at any size; the bound is the highest at which simulated pairs at the
threshold share a filter with the wanted probability. Pairs above the threshold are more likely found than that. What
the plan holds on the driver is SIMULATED rows of code scores, whatever the number of vectors. Vectors of more than FOLD dimensions
are decoded in a random projection to FOLD, but compared whole.

Vectors go to their filters rounded to 16 bits, packed by the group of filters they go to; pairs nearer to the threshold than this
may err are verified on the vectors themselves. Rotations are taken in rounds: a round sends about the size of the
vectors at most and its shuffle files go with it. Filters of more than TILE vectors, as a sample has it, are cut into blocks,
each two of which meet in a place of their own: what the sample misses costs time, no pair.

A group of near copies costs a row per copy and not one per pair: in a filter, vectors are linked to the least of those
they are connected with there, so the links connect what all pairs would connect. The components
are the classes. Each class is then counted through, in tiles of TILE x TILE vectors, so n_links is the exact number
of other vectors near to one in its class, whatever the size of the class, and no pair leaves its tile. Equal vectors are one
vector of several ids there.

Defined results: a row for each id with a vector (class_id is its own and n_links 0 where nothing is near); null, empty, zero
and non-finite vectors and null ids have no row; vectors of different lengths are never near, each length is searched by
itself; repeated rows of one id count once, with the greatest vector; very long vectors are used whole; equal vectors are
near; a class is named by its least id, so ties can't change it; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, shuffle_files_go, written
from .graphs import components
from .textops import buffers

THRESHOLD = 0.9
RECALL = 0.96
#: Codes with rotations of their own, and unrelated vectors that a filter is to hold.
ROTATIONS, FILL = 12, 256
#: Simulated pairs, and the most dimensions of a code.
SIMULATED, FOLD = 1000, 512
#: Vectors of a side of a tile.
TILE = 2048
#: Bytes that a round sends even where the vectors have fewer, and bytes that a task packs at a time.
ROUND, PACK = 64 << 20, 16 << 20


def plan(n: int, dim: int, threshold: float, recall: float, seed: int) -> dict:
    """Size of the codes and bound for n vectors of dim dimensions; filters is how many a vector has in a rotation, on average."""
    own = min(dim, FOLD)
    parts = [len(x) for x in np.array_split(np.arange(own), min(2, own))]
    side = max(8, math.ceil(math.sqrt(2 * n / FILL)))
    # Few dimensions have no room for many directions.
    p = {"dim": dim, "seed": seed, "parts": parts, "sides": [min(side, 4 ** min(x, 12)) for x in parts]}
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((2, SIMULATED, own))
    if own < dim:  # a projection of a pair of unit vectors is a pair of correlated normal ones
        b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
    else:
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-9)
    # Per pair the highest bound at which it has a filter in common, among the words that are best for both.
    most = np.full(SIMULATED, -1.0)
    for r in range(ROTATIONS):
        for lo in range(0, SIMULATED, 100):
            x, y = np.zeros((2, len(a[lo : lo + 100]), 1))
            for c in code(p, r):
                s, t = a[lo : lo + 100] @ c, b[lo : lo + 100] @ c
                top = np.argsort(-(s + t), 1)[:, :64]
                s, t = np.take_along_axis(s, top, 1), np.take_along_axis(t, top, 1)
                x, y = ((u[:, :, None] + w[:, None, :]).reshape(len(u), -1) for u, w in ((x, s), (y, t)))
            most[lo : lo + 100] = np.maximum(most[lo : lo + 100], np.minimum(x, y).max(1))
    p["bound"] = float(np.quantile(most, 1 - recall)) - 1e-4
    p["filters"] = sum(len(decode(a[:100].astype(np.float32), code(p, r), p["bound"])[0]) for r in range(ROTATIONS)) / 100 / ROTATIONS
    return p


def code(p: dict, rotation: int) -> list[np.ndarray]:
    """The directions of each block's words, as columns, in the space before the rotation."""
    rng = np.random.default_rng((p["seed"], rotation))
    own = sum(p["parts"])
    turn, out, at = np.linalg.qr(rng.standard_normal((own, own)))[0], [], 0
    for k, side in zip(p["parts"], p["sides"]):
        c = rng.standard_normal((side, k)) if k > 1 else np.array([[1.0], [-1.0]])
        c *= math.sqrt(k / own) / np.linalg.norm(c, axis=1, keepdims=True)
        out.append((turn[:, at : at + k] @ c.T).astype(np.float32))
        at += k
    return out


def fold(p: dict) -> np.ndarray | None:
    own = sum(p["parts"])
    return None if own == p["dim"] else np.random.default_rng((p["seed"], ROTATIONS)).standard_normal((p["dim"], own), np.float32)


def decode(v: np.ndarray, words: list[np.ndarray], bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and filters of all (vector, filter) whose inner product is the bound at least."""
    scores = [v @ c for c in words]
    best = np.stack([s.max(1) for s in scores])
    rest = np.concatenate((np.cumsum(best[::-1], 0)[::-1], np.zeros((1, len(v)), np.float32)))
    rows, key, total = np.arange(len(v)), np.zeros(len(v), np.int64), np.zeros(len(v), np.float32)
    for i, s in enumerate(scores):
        # Words of this block that reach the bound with the best of the other; then each partial sum with each of them.
        row, word = np.divmod(np.flatnonzero(s >= (bound - (rest[0] - best[i]))[:, None]), s.shape[1])  # faster than nonzero
        n = np.bincount(row, minlength=len(v))
        first, score = np.cumsum(n) - n, s[row, word]
        own = n[rows]
        at = np.repeat(np.arange(len(rows)), own)
        k = np.repeat(first[rows], own) + np.arange(len(at)) - np.repeat(np.cumsum(own) - own, own)
        sums = total[at] + score[k]
        ok = sums + rest[i + 1][rows[at]] >= bound
        total, key, rows = sums[ok], key[at[ok]] * s.shape[1] + word[k[ok]], rows[at[ok]]
    return rows, key


def decoded(batches, p: dict, rotations: range):
    """(ids, 16-bit vectors, filters) of the batches of coded vectors, some rows at a time; a row for each filter of a vector."""
    words, down = [code(p, r) for r in rotations], fold(p)
    step = max(16, min((1 << 20) // max(p["sides"]), (1 << 21) // p["dim"]))
    for batch in batches:
        if not len(batch):
            continue
        at, data = buffers(batch.column(1))
        ids, every = batch.column(0).to_numpy(), data[at[0] : at[-1]].view(np.int16).reshape(len(batch), -1)
        for lo in range(0, len(batch), step):
            q = every[lo : lo + step]
            v = q.astype(np.float32)
            v = v if down is None else v @ down
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            for r, w in zip(rotations, words):
                rows, key = decode(v, w, p["bound"])
                yield ids[lo : lo + step][rows], q[rows], r * math.prod(p["sides"]) + key


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def expand(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, within groups of these sizes that lie one after the other."""
    left = np.repeat(np.cumsum(size), size) - np.arange(int(size.sum())) - 1
    i = np.repeat(np.arange(len(left)), left)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)


def connect(least: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j; least: the least row of each row's component."""
    while len(i):
        a, b = least[i], least[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least[:] = least[least]


def classes(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 11, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, class_id (least id of those that chains of near vectors connect) and n_links (number of ids near to it)."""
    with shuffle_files_go(vectors.sparkSession):
        return classes_of(vectors, threshold, recall, seed, id_column, column)


def classes_of(vectors: DataFrame, threshold: float, recall: float, seed: int, id_column: str, column: str) -> DataFrame:
    spark = vectors.sparkSession
    array = F.col(f"`{column}`").cast("array<float>")
    clean = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), array.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    clean = clean.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.max("v").alias("v"))
    # Equal vectors are found by a hash, as a key that is shuffled once with each id; a group of copies is only a count and its least id.
    own = written(clean.withColumn("h", F.xxhash64("v")), "vectors")
    one = written(own.groupBy("h", "v").agg(F.min("id").alias("k"), F.count(F.lit(1)).alias("m")).select("h", "k", "v", "m"), "distinct")
    sizes = one.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("dim").collect()
    found = spark.createDataFrame([], "a bigint, b bigint")
    for s in sizes:
        found = found.unionByName(of_length(one.where(F.size("v") == s["dim"]), s["n"], plan(s["n"], s["dim"], threshold, recall, seed), threshold))
    root = components(found)
    member = written(one.join(root, one["k"] == root["node"]).select("k", "v", "m", "root"), "members")
    linked = written(counted(member, threshold), "linked")
    every = one.select("k", "m").join(member.select("k", "root"), "k", "left").join(linked, "k", "left")
    every = every.select("k", F.coalesce("root", "k").alias("root"), (F.coalesce("near", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    many = own.join(one.where("m > 1").select("h", "v", "k"), ["h", "v"]).select("id", "k")
    ids = one.where("m = 1").select(F.col("k").alias("id"), "k").unionByName(many)
    return ids.join(every, "k").select(F.col("id").alias("vec_id"), F.col("root").alias("class_id"), F.col("n_links").cast("long").alias("n_links"))


def of_length(one: DataFrame, n: int, p: dict, threshold: float) -> DataFrame:
    """Links (a, b) of near vectors of one length that connect the classes; one: k and v of n vectors."""
    spark, dim = one.sparkSession, p["dim"]
    # Rounding to 16 bits moves a unit vector by at most half a step in each dimension.
    margin = 3 * math.sqrt(dim) / 65534
    item = np.dtype([("filter", "<i8"), ("id", "<i8"), ("q", "<i2", (dim,))])
    groups = buckets(spark, 8)

    def coded(batches):
        step = max(16, (1 << 21) // dim)
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                v = unit(np.asarray(part.column(1).flatten(), np.float32).reshape(len(part), -1))
                q = np.round(v * (32767 / np.abs(v).max(1, keepdims=True))).astype(np.int16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in q], pa.binary())], ["id", "q"])

    def sampled(batches):
        for _, _, key in decoded(batches, p, range(ROTATIONS)):
            key, count = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], ["filter", "n"])

    def packed(waiting: list) -> pa.RecordBatch:
        """A row for each group of filters, with all that goes there."""
        own = np.empty(sum(len(x[0]) for x in waiting), item)
        for k, name in enumerate(("id", "q", "filter")):
            own[name] = np.concatenate([x[k] for x in waiting])
        group = ((own["filter"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % groups
        order = np.argsort(group, kind="stable")
        group = group[order]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        at = (np.append(first, len(group)) * item.itemsize).astype(np.int32)
        blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(own[order].tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(group[first]), blob], ["group", "own"])

    def share(t: pa.Table) -> pa.Table:
        """Links within the filters, and pairs that have to be verified on the vectors."""
        every = np.frombuffer(b"".join(t.column("own").to_pylist()), item)
        order = np.lexsort((every["id"], every["filter"]))
        key = every["filter"][order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        order, size = order[np.repeat(size > 1, size)], size[size > 1]
        if not len(size):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "sure": pa.array([], pa.bool_())})
        ids, v = every["id"][order], every["q"][order].astype(np.float32)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        first = np.cumsum(size) - size
        a, b, sure = [], [], []
        small = size <= 16
        rows = np.flatnonzero(np.repeat(small, size))
        step = max(16, (1 << 20) // dim)
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(size[small]), np.arange(0, len(rows), step)), int(small.sum())))
        for lo, hi in zip(cuts, cuts[1:]):  # all pairs of the small filters, some filters at a time
            own = size[small][lo:hi]
            begin = int(size[small][:lo].sum())
            i, j = expand(own)
            i, j = rows[begin + i], rows[begin + j]
            c = np.einsum("ij,ij->i", v[i], v[j])
            ok = np.flatnonzero(c >= threshold - margin)
            a.append(i[ok])
            b.append(j[ok])
            sure.append(c[ok] >= threshold + margin)
        for start, count in zip(first[~small].tolist(), size[~small].tolist()):
            own, least, open_ = v[start : start + count], np.arange(count), []
            for lo in range(0, count, 512):
                c = own[lo : lo + 512] @ own[lo:].T
                i, j = np.divmod(np.flatnonzero(c >= threshold - margin), count - lo)
                i, j = i[i < j], j[i < j]
                high = c[i, j] >= threshold + margin
                connect(least, lo + i[high], lo + j[high])
                open_.append((lo + i[~high], lo + j[~high]))
            i, j = (np.concatenate(x) for x in zip(*open_))
            apart = least[i] != least[j]
            linked = np.flatnonzero(least != np.arange(count))
            a += [start + least[linked], start + i[apart]]
            b += [start + linked, start + j[apart]]
            sure += [np.ones(len(linked), bool), np.zeros(int(apart.sum()), bool)]
        a, b, sure = np.concatenate(a), np.concatenate(b), np.concatenate(sure)
        pairs = np.unique(np.stack([ids[a], ids[b], sure], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "sure": pairs[:, 2].astype(bool)})

    def verify(batches):
        for batch in batches:
            a, b = (np.asarray(batch.column(i).flatten(), np.float32).reshape(len(batch), -1) for i in (2, 3))
            ok = np.einsum("ij,ij->i", unit(a), unit(b)) >= threshold if len(batch) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    codes = written(one.select("k", "v").mapInArrow(coded, "id bigint, q binary"), "codes", {"parquet.enable.dictionary": "false"})
    # Filters of more than a tile: at most as many as all filters' vectors make tiles, 12 bytes each.
    hot, tiles = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > TILE:
        part = max(1, min(16, n // (8 * TILE)))
        counts = codes.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0).mapInArrow(sampled, "filter bigint, n bigint").groupBy("filter").agg((F.sum("n") * part).alias("n"))
        large = counts.where(F.col("n") > TILE).orderBy("filter").toArrow()
        hot, tiles = large.column("filter").to_numpy(), -(-large.column("n").to_numpy() // TILE)
    base = np.cumsum(tiles**2) - tiles**2
    each = max(1, min(ROTATIONS, int(max(ROUND, n * (4 * dim + 16)) / max(1.0, n * p["filters"] * item.itemsize))))

    def sent(rotations: range):
        def send(batches):
            waiting, size = [], 0
            for ids, q, key in decoded(batches, p, rotations):
                at = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
                is_hot = hot[at] == key if len(hot) else np.zeros(len(key), bool)
                times = np.where(is_hot, tiles[at], 1) if len(hot) else np.ones(len(key), np.int64)
                ends = np.cumsum(times)
                for lo in range(0, int(times.sum()), max(1, PACK // item.itemsize)):  # each block of a hot filter meets each
                    here = np.arange(lo, min(lo + max(1, PACK // item.itemsize), int(times.sum())))
                    k = np.searchsorted(ends, here, "right")
                    to = key[k]
                    if (wide := is_hot[k]).any():
                        row, t = at[k][wide], times[k][wide]
                        other = (here - (ends[k] - times[k]))[wide]
                        own = ((ids[k][wide].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % t
                        to[wide] = -1 - base[row] - np.minimum(own, other) * t - np.maximum(own, other)
                    waiting.append((ids[k], q[k], to))
                    size += len(k) * item.itemsize
                    if size >= PACK:
                        yield packed(waiting)
                        waiting, size = [], 0
            if size:
                yield packed(waiting)

        return send

    near = None
    for lo in range(0, ROTATIONS, each):
        placed = codes.mapInArrow(sent(range(lo, min(lo + each, ROTATIONS))), "group bigint, own binary")
        own = written(placed.groupBy("group").applyInArrow(share, "a bigint, b bigint, sure boolean"), "near")
        near = own if near is None else near.unionByName(own)
    open_ = near.where("NOT sure").select("a", "b").distinct()
    open_ = open_.join(one.select(F.col("k").alias("a"), F.col("v").alias("va")), "a").join(one.select(F.col("k").alias("b"), F.col("v").alias("vb")), "b")
    return near.where("sure").select("a", "b").unionByName(open_.select("a", "b", "va", "vb").mapInArrow(verify, "a bigint, b bigint"))


def counted(member: DataFrame, threshold: float) -> DataFrame:
    """k and the number of ids with other vectors near to it, for the vectors of classes of several."""
    size = member.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    placed = member.join(size, "root").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("k", "v", "m", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "root", "own")
    spread = spread.withColumn("group", F.pmod(F.xxhash64("root", "x", "y"), F.lit(buckets(member.sparkSession, 8))))

    def count(t: pa.Table) -> pa.Table:
        k, root, x, y, own, m = (t.column(c).to_numpy() for c in ("k", "root", "x", "y", "own", "m"))
        order = np.lexsort((own, y, x, root))
        k, root, x, y, own, m = (c[order] for c in (k, root, x, y, own, m))
        first = np.flatnonzero(np.concatenate(([True], (root[1:] != root[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        end = np.append(first[1:], len(k))
        out = np.zeros(len(k), np.int64)
        column = t.column("v").combine_chunks()
        for a, b in zip(first.tolist(), end.tolist()):
            v = unit(np.asarray(column.take(pa.array(order[a:b])).flatten(), np.float32).reshape(b - a, -1))
            cut = int(np.searchsorted(own[a:b], x[a], "right")) if x[a] != y[a] else 0  # two blocks, or one against itself
            for lo in range(0, b - a, 512):
                if x[a] == y[a]:
                    c = v[lo : lo + 512] @ v.T >= threshold
                    c[np.arange(len(c)), lo + np.arange(len(c))] = False
                    out[a + lo : a + lo + len(c)] += c @ m[a:b]
                elif lo < cut:
                    c = v[lo : min(lo + 512, cut)] @ v[cut:].T >= threshold
                    out[a + lo : a + lo + len(c)] += c @ m[a + cut : b]
                    out[a + cut : b] += m[a + lo : a + lo + len(c)] @ c
        return pa.table({"k": k, "near": out})

    return spread.groupBy("group").applyInArrow(count, "k bigint, near bigint").groupBy("k").agg(F.sum("near").alias("near"))
